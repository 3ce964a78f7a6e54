"""Connected components: union-find inside partitions, then alternating large and small stars."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoebox.scratch import materialise

#: Links that one task joins alone; more go through the rounds of stars. The result is the same.
ONE_TASK = 500_000
#: Links that a task folds into a forest at a time.
CHUNK = 250_000


def _priority(x: np.ndarray, seed: int) -> np.ndarray:
    """A pseudo-random order of the records, another one for every seed (bijective 64-bit mix)."""
    z = x.astype(np.uint64) + np.uint64((0x9E3779B97F4A7C15 * (seed + 1)) % 2**64)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        z = (z ^ (z >> np.uint64(shift))) * np.uint64(factor)
    return z ^ (z >> np.uint64(31))


def spanning_forest(a: np.ndarray, b: np.ndarray, seed: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(root, node) of a star-shaped spanning forest of the edges a-b, roots left out as nodes.

    The root is the smallest record of its tree, or with a seed the first in that seed's pseudo-random order.
    Union by order with path compression, in whole-array steps.
    """
    names, flat = np.unique(np.concatenate([a, b]), return_inverse=True)
    if seed is not None:
        order = np.argsort(_priority(names, seed), kind="stable")
        names, place = names[order], np.argsort(order, kind="stable")
        flat = place[flat]
    u, v = flat[: len(a)], flat[len(a) :]
    parent = np.arange(len(names))
    while len(u):
        ru, rv = parent[u], parent[v]
        open_ = ru != rv
        u, v, ru, rv = u[open_], v[open_], ru[open_], rv[open_]
        np.minimum.at(parent, np.maximum(ru, rv), np.minimum(ru, rv))
        while True:
            up = parent[parent]
            if np.array_equal(up, parent):
                break
            parent = up
    child = np.flatnonzero(parent != np.arange(len(names)))
    return names[parent[child]], names[child]


def _fold(batches: Iterator[pd.DataFrame], whole: bool) -> Iterator[pd.DataFrame]:
    """Forests (u, v) of a stream of links, one for each chunk, or one for all of them."""
    u, v, held = np.empty(0, np.int64), np.empty(0, np.int64), 0
    for batch in batches:
        u, v = np.concatenate([u, batch["u"].to_numpy(np.int64)]), np.concatenate([v, batch["v"].to_numpy(np.int64)])
        held += len(batch)
        if held >= CHUNK:
            v, u = spanning_forest(u, v)
            held = 0
            if not whole:
                yield pd.DataFrame({"u": u, "v": v})
                u = v = np.empty(0, np.int64)
    if len(u):
        v, u = spanning_forest(u, v)
        yield pd.DataFrame({"u": u, "v": v})


def connected_components(links: DataFrame, a: str = "a", b: str = "b", one_task: int = ONE_TASK) -> DataFrame:
    """(group_id, node): every node that is linked to another one, group_id the smallest node of its component.

    Links are folded into forests where they lie. Up to ``one_task`` counted links are then joined by one task; with more,
    each round rehangs every node's larger neighbours, then its smaller ones, below its smallest neighbour,
    as two aggregations with equi-joins, and stores the links, until nothing changes; a hub's neighbours stay spread
    over all tasks. Null ends and self links are ignored; no links give no rows.
    """
    schema = "u long, v long"
    e = links.select(F.col(a).cast("bigint").alias("x"), F.col(b).cast("bigint").alias("y")).where("x is not null and y is not null and x <> y")
    e = e.select(F.greatest("x", "y").alias("u"), F.least("x", "y").alias("v"))
    e = materialise(e.mapInPandas(lambda rows: _fold(rows, False), schema), "stars")
    if e.count() <= one_task:
        e = materialise(e.coalesce(1).mapInPandas(lambda rows: _fold(rows, True), schema), "stars")
    else:
        e = _settle(e.distinct())
    roots = e.select(F.col("v").alias("group_id"), F.col("v").alias("node")).distinct()
    return e.select(F.col("v").alias("group_id"), F.col("u").alias("node")).unionByName(roots)


def _settle(e: DataFrame) -> DataFrame:
    """Rounds of large and small stars until every link (u, v) joins a node to the smallest of its component."""
    e, before = materialise(e, "stars"), None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = materialise(large, "stars")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = materialise(small.unionByName(low.withColumnRenamed("m", "v")).where("u <> v").distinct(), "stars")
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            return e
        before = now
