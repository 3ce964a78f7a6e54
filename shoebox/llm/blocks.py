"""Vectors in overlapping blocks: every row has one home block and visits a few others.

A home row meets every visitor of its block. Groups above ``TILE_ROWS`` are cut into tiles by a hash of the id,
and each pair of tiles is a task of its own, so a hot block is spread over many tasks of bounded size.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shoebox.scratch import materialise

TILE_ROWS = 16_384
STRIPE_ROWS = 2048
HOT_ROWS = 500
SAMPLE_ROWS = 20_000
TILE_PAIRS = 500_000


def comparable(vec: Column, dim: int) -> Column:
    """Full length, no null, NaN or infinite element, not all zero; never null."""
    finite = ~F.exists(vec, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce((F.size(vec) == dim) & finite & F.exists(vec, lambda x: x != 0), F.lit(False))


def _normalise(batches: Iterator[pa.RecordBatch], dim: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        flat = batch.column("vec").flatten().to_numpy(zero_copy_only=False).reshape(-1, dim).astype(np.float64)
        flat /= np.abs(flat).max(axis=1, keepdims=True)
        flat /= np.linalg.norm(flat, axis=1, keepdims=True)
        unit = flat.astype(np.float32)
        whole = pa.FixedSizeBinaryArray.from_buffers(pa.binary(4 * dim), len(unit), [None, pa.py_buffer(np.ascontiguousarray(unit))])
        yield pa.RecordBatch.from_arrays([batch.column("id"), whole.cast(pa.binary())], ["id", "unit"])


def unit_vectors(rows: DataFrame, id_: str, vec: str, dim: int) -> DataFrame:
    """(id, unit): comparable vectors at length one, as float32 bytes; rows without an id are left out."""
    src = rows.select(F.col(id_).cast("bigint").alias("id"), F.col(vec).cast("array<float>").alias("vec")).where(F.col("id").isNotNull() & comparable(F.col("vec"), dim))
    return src.mapInArrow(lambda b: _normalise(b, dim), "id long, unit binary")


def matrix(units, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(units), np.float32).reshape(-1, dim)


def sample_rows_of(units: DataFrame, dim: int, rows: int = SAMPLE_ROWS, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """Ids and vectors of at most ``rows`` records, chosen by a hash of the id, the same ones on every run."""
    at = units.select("id", "unit", F.xxhash64("id", F.lit(seed)).alias("o")).orderBy("o", "id").limit(rows).select("id", "unit").toArrow()
    return at.column("id").to_numpy(), matrix(at.column("unit").to_pylist(), dim)


Router = Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]]


def _lists(routes: list[tuple[np.ndarray, np.ndarray | list[np.ndarray]]]) -> pa.Array:
    """For each row the home and the visits of every router."""
    rows = len(routes[0][0])
    homes = np.stack([h for h, _ in routes], axis=1).astype(np.int32).ravel()
    if all(isinstance(v, np.ndarray) for _, v in routes):
        flat = np.concatenate([v for _, v in routes], axis=1).ravel()
        sizes = np.tile([v.shape[1] for _, v in routes], rows)
    else:
        each = [v[i] for i in range(rows) for _, v in routes]
        flat, sizes = np.concatenate(each) if each else np.empty(0), np.array([len(e) for e in each], np.int64)
    starts = lambda n: pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32())
    visits = pa.ListArray.from_arrays(starts(sizes), pa.array(flat.astype(np.int32)))
    both = pa.StructArray.from_arrays([pa.array(homes), visits], ["home", "visits"])
    return pa.ListArray.from_arrays(starts(np.full(rows, len(routes))), both)


def _route(batches: Iterator[pa.RecordBatch], routers: list[Router], dim: int, leaders: np.ndarray | None, threshold: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x = matrix(batch.column("unit").to_pylist(), dim)
        led = np.full(len(x), -1, np.int32)
        if leaders is not None:
            s = x @ leaders.T
            led = np.where(s.max(1) >= threshold + 1e-5, s.argmax(1), -1).astype(np.int32)
        yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("unit"), pa.array(led), _lists([r(x) for r in routers])], ["id", "unit", "leader", "routes"])


def _share(z: np.ndarray) -> np.ndarray:
    """Log probabilities of the parts from their scores."""
    z = z - z.max(1, keepdims=True)
    return z - np.log(np.exp(z).sum(1, keepdims=True))


class Nested:
    """A model whose parts are divided again by models of their own, for more rows than the parts of one model can hold.

    A model has ``scores(x)``, one column a part. A row's parts are ranked by the product of both probabilities, among the
    divisions of its most probable parts.
    """

    def __init__(self, root, children: dict[int, object]):
        self.root, self.children = root, children
        width = {g: c.scores(np.zeros((1, c.width), np.float32)).shape[1] for g, c in children.items()}
        self.start = {g: sum(width[h] for h in sorted(width) if h < g) for g in width}
        self.parts = sum(width.values())

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Log probabilities of all parts; for a few rows."""
        z = _share(self.root.scores(x))
        return np.concatenate([_share(self.children[g].scores(x)) + z[:, g][:, None] for g in sorted(self.children)], axis=1)

    def route(self, visits: int):
        def router(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            z = _share(self.root.scores(x))
            z[:, [g for g in range(z.shape[1]) if g not in self.children]] = -np.inf
            take, each = min(max(visits, 1), len(self.children)), max(visits, 1)
            near = np.argpartition(-z, take - 1, axis=1)[:, :take]
            value, part = np.full((len(x), take, each), -np.inf, np.float32), np.zeros((len(x), take, each), np.int32)
            for g in np.unique(near):
                rows, place = np.nonzero(near == g)
                s = _share(self.children[g].scores(x[rows])) + z[rows, g][:, None]
                m = min(each, s.shape[1])
                best = np.argpartition(-s, m - 1, axis=1)[:, :m]
                value[rows, place, :m] = np.take_along_axis(s, best, axis=1)
                part[rows, place, :m] = best + self.start[g]
            value, part = value.reshape(len(x), -1), part.reshape(len(x), -1)
            home = part[np.arange(len(x)), value.argmax(1)] if len(x) else np.empty(0, np.int32)
            m = min(visits, value.shape[1])
            return home, np.take_along_axis(part, np.argpartition(-value, max(m - 1, 0), axis=1)[:, :m], axis=1)

        return router


def divide(units: DataFrame, root, dim: int, fit: Callable[[np.ndarray, int], object], rows_per_part: int, sample_rows: int = SAMPLE_ROWS) -> Nested:
    """Fit a model for each part of ``root`` on at most ``sample_rows`` of its rows, one task each; ``fit`` gets the sample and the number of rows.

    As many models come to the driver as the root has parts.
    """
    home = units.mapInArrow(lambda b: _route(b, [root.route(1)], dim, None, 2.0), "id long, unit binary, leader int, routes array<struct<home:int,visits:array<int>>>")
    home = materialise(home.select("id", "unit", F.col("routes")[0]["home"].alias("part")), "parts")
    n = home.groupBy("part").agg(F.count("*").alias("n"))
    w = Window.partitionBy("part").orderBy(F.xxhash64("id"), "id")
    few = home.withColumn("r", F.row_number().over(w)).where(F.col("r") <= sample_rows).join(F.broadcast(n), "part")

    def learn(rows: pd.DataFrame) -> pd.DataFrame:
        model = fit(matrix(rows["unit"], dim), int(rows["n"].iloc[0]))
        return pd.DataFrame({"part": [rows["part"].iloc[0]], "model": [pickle.dumps(model)]})

    found = few.groupBy("part").applyInPandas(learn, "part int, model binary").collect()
    return Nested(root, {r["part"]: pickle.loads(r["model"]) for r in found})


def exact_router(units: DataFrame, model, dim: int, threshold: float) -> Router:
    """Visits of every part that can hold a row of cosine >= ``threshold``, so no pair is missed.

    By the triangle inequality: a part's rows lie within its radius of its pivot (its row of smallest id), so a row
    further from the pivot than radius and threshold angle has no partner there.
    """
    kind = "id long, unit binary, leader int, routes array<struct<home:int,visits:array<int>>>"
    home = units.select("id", "unit").mapInArrow(lambda b: _route(b, [model.route(1)], dim, None, 2.0), kind)
    home = materialise(home.select("id", "unit", F.col("routes")[0]["home"].alias("part")), "parts")
    pivots = home.groupBy("part").agg(F.min_by("unit", "id").alias("unit")).orderBy("part").toArrow()
    parts, p = pivots.column("part").to_numpy(), matrix(pivots.column("unit").to_pylist(), dim).astype(np.float64)
    angle = lambda x: np.arccos(np.clip(x.astype(np.float64) @ p.T, -1, 1))
    place = {g: i for i, g in enumerate(parts.tolist())}

    def away(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            at = np.array([place[g] for g in b["part"]], int)
            yield pd.DataFrame({"part": b["part"], "away": angle(matrix(b["unit"], dim))[np.arange(len(b)), at]})

    far = home.mapInPandas(away, "part int, away double").groupBy("part").agg(F.max("away").alias("r")).collect()
    reach = np.zeros(len(parts))
    for r in far:
        reach[place[r["part"]]] = r["r"]
    most = float(np.arccos(np.clip(threshold, -1, 1))) + 1e-6

    def router(x: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        return model.route(1)(x)[0], [parts[a <= reach + most] for a in angle(x)]

    return router


def routed(units: DataFrame, routers: list[Router], dim: int, leaders: np.ndarray | None = None, threshold: float = 2.0) -> DataFrame:
    """(id, unit, leader, routes): home and visited blocks of each router; visits hold the home too.

    ``leader`` is the most similar of the ``leaders`` where that reaches ``threshold``, else -1.
    """
    return units.mapInArrow(lambda b: _route(b, routers, dim, leaders, threshold), "id long, unit binary, leader int, routes array<struct<home:int,visits:array<int>>>")


def meet(assigned: DataFrame, compare: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame], schema: str, tile_rows: int = TILE_ROWS) -> DataFrame:
    """``compare(home rows, visiting rows)`` for each tile pair of each block of each router.

    ``assigned`` as from :func:`routed`, stored, since it is read several times. Rows of one leader that are more than
    ``HOT_ROWS`` have tiles of their own in each block, and two tiles of one leader do not meet: the caller has already
    joined such rows through their leader.
    """
    hot = assigned.where("leader >= 0").groupBy("leader").agg(F.count("*").alias("n")).where(F.col("n") > min(tile_rows, HOT_ROWS))
    # As many rows as there are leaders at most, which is the number of components of a model.
    hot = F.broadcast(hot.select("leader", F.col("leader").alias("grp")))
    flat = assigned.join(hot, "leader", "left").select("id", "unit", F.coalesce("grp", F.lit(-1)).alias("grp"), F.posexplode("routes").alias("router", "r"))
    block = ["router", "block"]
    homes = flat.select("id", "unit", "grp", "router", F.col("r.home").alias("block"))
    visitors = flat.select("id", "unit", "grp", "router", F.explode("r.visits").alias("block"))
    tiles = lambda d: materialise(d.groupBy(*block, "grp").agg(F.ceil(F.count("*") / tile_rows).cast("int").alias("n")), "tiles")
    nh, nv = tiles(homes), tiles(visitors)
    each = lambda d, g, t: d.select(*block, F.col("grp").alias(g), F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias(t))
    pairs = each(nh, "gh", "i").join(each(nv, "gv", "j"), block).where("gh <> gv or gh < 0")
    pairs = materialise(pairs.select(*block, "gh", "i", "gv", "j", F.xxhash64(*block, "gh", "i", "gv", "j").alias("task")), "pairs")
    small = pairs.count() <= TILE_PAIRS
    near = lambda d: F.broadcast(d) if small else d

    def side(rows: DataFrame, n: DataFrame, g: str, t: str, at_home: bool) -> DataFrame:
        tile = F.pmod(F.xxhash64("id", F.lit(t)), F.col("n")).cast("int").alias(t)
        rows = rows.join(near(n), [*block, "grp"]).select(*block, F.col("grp").alias(g), tile, "id", "unit")
        return rows.join(near(pairs), [*block, g, t]).select("task", "id", "unit", F.lit(at_home).alias("at_home"))

    def task(rows: pd.DataFrame) -> pd.DataFrame:
        home = rows["at_home"].to_numpy()
        return compare(rows[home], rows[~home])

    return side(homes, nh, "gh", "i", True).unionByName(side(visitors, nv, "gv", "j", False)).groupBy("task").applyInPandas(task, schema)
