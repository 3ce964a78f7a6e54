"""Most similar vectors for every vector.

Learned partitions: the exact neighbour graph of a bounded sample is cut into balanced parts, a small
classifier learns the part from the vector, every vector is indexed in its most probable part, and a query is
reranked exactly in its several most probable parts. How many are visited follows from a recall target: some queries are
answered by brute force, and the ranks at which the parts of their true neighbours come tell how far to go.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shoebox.llm.blocks import SAMPLE_ROWS, STRIPE_ROWS, divide, exact_router, matrix, meet, routed, sample_rows_of, unit_vectors
from shoebox.scratch import materialise

#: Queries answered by brute force to find how many parts have to be visited.
TRIALS = 512
#: Rows of a part, and parts of one classifier; where these cannot hold all rows, each part is divided again.
ROWS_PER_PART, PARTS = 2000, 256


def neighbour_graph(x: np.ndarray, k: int) -> np.ndarray:
    """Exact k nearest rows of each row by cosine, itself left out, in blocks."""
    k = min(k, len(x) - 1)
    out = np.empty((len(x), k), np.int32)
    for i in range(0, len(x), 1024):
        s = x[i : i + 1024] @ x.T
        s[np.arange(len(s)), np.arange(i, i + len(s))] = -2
        out[i : i + 1024] = np.argpartition(-s, k - 1, axis=1)[:, :k] if k else np.empty((len(s), 0))
    return out


def balanced_parts(graph: np.ndarray, parts: int, seed: int, slack: float = 1.1, passes: int = 4) -> np.ndarray:
    """A part for each node with few cut edges and no part above ``slack`` times the mean.

    Nodes are taken in breadth-first order and put where most of their neighbours are, weighted by the room left
    there; further passes move nodes again under the same bound.
    """
    n = len(graph)
    rng = np.random.default_rng(seed)
    room = max(1, int(np.ceil(slack * n / parts)))
    part, load = np.full(n, -1), np.zeros(parts)
    order, seen = [], np.zeros(n, bool)
    for start in rng.permutation(n):
        if seen[start]:
            continue
        seen[start] = True
        line = [start]
        while line:
            order += line
            ahead = graph[line].ravel()
            ahead = np.unique(ahead[~seen[ahead]])
            seen[ahead] = True
            line = ahead.tolist()
    back: list[list[int]] = [[] for _ in range(n)]
    for i, row in enumerate(graph):
        for j in row:
            back[j].append(i)
    around = [np.concatenate([graph[i], np.array(back[i], graph.dtype)]) for i in range(n)]
    for _ in range(passes):
        for i in order:
            if part[i] >= 0:
                load[part[i]] -= 1
            near = part[around[i]]
            score = np.bincount(near[near >= 0], minlength=parts) + 0.1
            score = score * (1 - load / room)
            part[i] = int(score.argmax())
            load[part[i]] += 1
    return part


class PartClassifier:
    """One hidden layer and a softmax over the parts, trained by Adam on the labelled sample."""

    def __init__(self, x: np.ndarray, part: np.ndarray, parts: int, seed: int, hidden: int = 128, epochs: int = 12):
        rng = np.random.default_rng(seed)
        d = x.shape[1]
        w = [rng.normal(0, np.sqrt(2), (d, hidden)), np.zeros(hidden), rng.normal(0, 1 / np.sqrt(hidden), (hidden, parts)), np.zeros(parts)]
        w = [a.astype(np.float32) for a in w]
        m, s = [np.zeros_like(a) for a in w], [np.zeros_like(a) for a in w]
        step = 0
        for _ in range(epochs):
            for at in np.array_split(rng.permutation(len(x)), max(1, len(x) // 256)):
                xb = x[at]
                h = np.maximum(xb @ w[0] + w[1], 0)
                z = h @ w[2] + w[3]
                z = np.exp(z - z.max(1, keepdims=True))
                z /= z.sum(1, keepdims=True)
                z[np.arange(len(at)), part[at]] -= 1
                z /= len(at)
                back = (z @ w[2].T) * (h > 0)
                step += 1
                for i, g in enumerate((xb.T @ back, back.sum(0), h.T @ z, z.sum(0))):
                    m[i] = 0.9 * m[i] + 0.1 * g
                    s[i] = 0.999 * s[i] + 0.001 * g * g
                    w[i] -= 3e-3 * (m[i] / (1 - 0.9**step)) / (np.sqrt(s[i] / (1 - 0.999**step)) + 1e-8)
        self.w = w

    def scores(self, x: np.ndarray) -> np.ndarray:
        return np.maximum(x @ self.w[0] + self.w[1], 0) @ self.w[2] + self.w[3]

    @property
    def width(self) -> int:
        return self.w[0].shape[0]

    @property
    def parts(self) -> int:
        return self.w[2].shape[1]

    def route(self, visits: int):
        def router(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            z = self.scores(x)
            m = min(visits, z.shape[1])
            return z.argmax(1), np.argpartition(-z, max(m - 1, 0), axis=1)[:, :m]

        return router


def learn_partitions(sample: np.ndarray, rows: int, tables: int, rows_per_part: int = 2000, most: int = 256) -> list[PartClassifier]:
    """``tables`` independent partitions into parts of about ``rows_per_part`` of the ``rows`` to index."""
    parts = int(min(most, max(1, rows // rows_per_part), max(1, len(sample) // 20)))
    graph = neighbour_graph(sample, 10)
    return [PartClassifier(sample, balanced_parts(graph, parts, seed), parts, seed) for seed in range(tables)]


def _trial_tops(batches: Iterator[pa.RecordBatch], ids: np.ndarray, q: np.ndarray, models: list, ranks: list[np.ndarray], k: int, least: float, dim: int) -> Iterator[pa.RecordBatch]:
    """The trial queries' most similar rows of each batch, with the rank of their home part for the query in each model."""
    for batch in batches:
        x = matrix(batch.column("unit").to_pylist(), dim)
        s = q @ x.T
        s[ids[:, None] == batch.column("id").to_numpy()[None, :]] = -2
        take = min(k, len(x))
        i, j = np.repeat(np.arange(len(q)), take), np.argpartition(-s, take - 1, axis=1)[:, :take].ravel()
        keep = s[i, j] >= max(least, -1.5)
        i, j = i[keep], j[keep]
        at = np.stack([r[i, m.route(1)(x)[0][j]] for r, m in zip(ranks, models)], axis=1)
        yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(s[i, j].astype(np.float64)), pa.array(at.tolist(), pa.list_(pa.int32()))], ["query", "similarity", "ranks"])


def visits_for(reps: DataFrame, asks: DataFrame, models: list[PartClassifier], k: int, least: float, dim: int, recall: float, visits: int) -> tuple[int, int]:
    """(tables, visits): the cheapest at which ``recall`` of the trial queries' true neighbours are met.

    ``visits`` in all tables is the least; fewer tables are taken only where that least is not enough.
    """
    parts = models[0].parts
    if visits >= parts:
        return 1, parts
    # Fewer trials where the parts are many, as each needs the rank of every part.
    ids, q = sample_rows_of(asks, dim, max(64, min(TRIALS, (1 << 19) // parts)), seed=11)
    if len(ids) == 0:
        return len(models), visits
    ranks = [np.argsort(np.argsort(-m.scores(q), axis=1), axis=1).astype(np.int32) for m in models]
    tops = reps.select("id", "unit").mapInArrow(lambda b: _trial_tops(b, ids, q, models, ranks, k, least, dim), "query int, similarity double, ranks array<int>")
    w = Window.partitionBy("query").orderBy(F.desc("similarity"))
    true = tops.withColumn("r", F.row_number().over(w)).where(F.col("r") <= k).select("ranks").toArrow().column("ranks").to_pylist()
    if not true:
        return len(models), visits
    best = np.minimum.accumulate(np.array(true), axis=1)
    need = [int(np.sort(best[:, t])[int(np.ceil(recall * len(best))) - 1]) + 1 for t in range(len(models))]
    if need[-1] <= visits:
        return len(models), visits
    rows, asking = reps.count(), asks.count()
    return min(((t + 1) * (rows + asking * v), t + 1, v) for t, v in enumerate(need))[1:]


def _top_tile(home: pd.DataFrame, visiting: pd.DataFrame, k: int, least: float, dim: int) -> pd.DataFrame:
    empty = pd.DataFrame({"id": np.empty(0, np.int64), "other": np.empty(0, np.int64), "similarity": np.empty(0)})
    if home.empty or visiting.empty:
        return empty
    home = home.sort_values("id")
    h, v = matrix(home["unit"], dim), matrix(visiting["unit"], dim)
    hid, vid = home["id"].to_numpy(np.int64), visiting["id"].to_numpy(np.int64)
    take = min(k + 4, len(hid))
    parts = []
    for at in range(0, len(v), STRIPE_ROWS // 4):
        mine, own = v[at : at + STRIPE_ROWS // 4], vid[at : at + STRIPE_ROWS // 4]
        s = mine @ h.T
        s[own[:, None] == hid[None, :]] = -2
        i = np.repeat(np.arange(len(mine)), take)
        j = np.argpartition(-s, take - 1, axis=1)[:, :take].ravel()
        keep = s[i, j] >= max(least, -1.5) - 1e-5
        i, j = i[keep], j[keep]
        exact = np.einsum("ij,ij->i", mine[i].astype(np.float64), h[j].astype(np.float64)).round(7)
        parts.append(pd.DataFrame({"id": own[i], "other": hid[j], "similarity": exact}))
    out = pd.concat(parts)
    out = out[out["similarity"] >= least].sort_values(["id", "similarity", "other"], ascending=[True, False, True])
    return out.groupby("id", sort=False).head(k)


def nearest(
    rows: DataFrame, id_: str, vec: str, dim: int, k: int = 5, least: float = -1.0, queries=None, visits: int = 4, tables: int = 2, sample_rows: int = SAMPLE_ROWS, recall: float = 0.95, exact: bool = False, rows_per_part: int = ROWS_PER_PART, most: int = PARTS
) -> DataFrame:
    """(id, other, similarity, rank_no): the ``k`` most similar other comparable vectors of each query.

    ``queries`` is a condition on ``id`` (by default every row asks); only neighbours of cosine >= ``least`` are
    listed. Ties go to the smaller id. The partition is learned on at most ``sample_rows`` vectors; every row is
    indexed. Equal vectors are indexed once: since ties go to the smaller id, only their k + 1 smallest ids can be
    anyone's neighbours, and all of them ask. At least ``visits`` parts of each of the ``tables`` partitions are
    visited, and as many as it takes to meet ``recall`` of the neighbours of trial queries. More rows than ``most`` parts of
    four times ``rows_per_part`` can hold have their parts divided again. With ``exact`` every part is visited that can hold a neighbour of cosine >= ``least`` by the
    triangle inequality, so none is missed, at a cost that grows with the square of the rows. Rows without a comparable vector neither ask nor answer; an empty
    table gives no rows.
    """
    spark = rows.sparkSession
    units = materialise(unit_vectors(rows, id_, vec, dim).dropDuplicates(["id"]), "units")
    # The k + 1 smallest ids of equal vectors; salted, so a vector that many rows share is cut down before it meets.
    salt = units.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(64)))
    first = Window.partitionBy("unit", "salt").orderBy("id")
    few = salt.withColumn("r", F.row_number().over(first)).where(F.col("r") <= k + 1)
    reps = few.groupBy("unit").agg(F.slice(F.array_sort(F.collect_list("id")), 1, k + 1).alias("ids"))
    reps = materialise(reps.select(F.col("ids")[0].alias("id"), "unit", "ids"), "reps")
    _, sample = sample_rows_of(reps, dim, sample_rows)
    if len(sample) == 0:
        return spark.createDataFrame([], "id bigint, other bigint, similarity double, rank_no bigint")
    asks = units.where(queries) if queries is not None else units
    if queries is not None:
        asked = asks.select("unit").distinct().join(reps.select("unit", "id"), "unit").select("id", F.lit(True).alias("asked"))
        places = materialise(reps.select("id", "unit").join(asked, "id", "left"), "asking")
        asking, silent = places.where("asked").select("id", "unit"), places.where("asked is null").select("id", "unit")
    else:
        asking, silent = reps.select("id", "unit"), None
    count = reps.count()
    models: list = learn_partitions(sample, count, 1 if exact else tables, rows_per_part, most)
    if count > 4 * models[0].parts * rows_per_part:
        models = [divide(reps, m, dim, lambda x, n: learn_partitions(x, n, 1, rows_per_part, most)[0], rows_per_part, sample_rows) for m in models]
    if exact:
        routers = [exact_router(reps, models[0], dim, least)]
        tables = 1
    else:
        tables, visits = visits_for(reps, asking, models, k, least, dim, recall, visits)
        routers = [m.route(visits) for m in models[:tables]]
    placed = routed(asking, routers, dim)
    if silent is not None:
        placed = placed.unionByName(routed(silent, [m.route(0) for m in models[:tables]], dim))
    placed = materialise(placed, "placed")
    found = meet(placed, lambda h, v: _top_tile(h, v, k, least, dim), "id long, other long, similarity double").distinct()
    w = Window.partitionBy("id").orderBy(F.desc("similarity"), "other")
    groups = found.withColumn("r", F.row_number().over(w)).where(F.col("r") <= k).select(F.col("id").alias("rep"), "other", "similarity")
    # Back from distinct vectors to rows: own copies first, then the ids of every neighbouring vector.
    other = groups.join(reps.select(F.col("id").alias("other"), "ids"), "other").select("rep", "similarity", "ids")
    own = reps.where((F.size("ids") > 1) & (F.lit(1.0) >= least)).select(F.col("id").alias("rep"), F.lit(1.0).alias("similarity"), "ids")
    answers = other.unionByName(own).groupBy("rep").agg(F.collect_list(F.struct("similarity", "ids")).alias("found"))
    members = asks.join(reps.select("unit", F.col("id").alias("rep")), "unit").select("id", "rep")
    listed = members.join(answers, "rep").select("id", F.explode("found").alias("f")).select("id", "f.similarity", F.explode("f.ids").alias("other"))
    listed = listed.where("id <> other").withColumn("rank_no", F.row_number().over(w).cast("bigint"))
    return listed.where(F.col("rank_no") <= k).select("id", "other", "similarity", "rank_no")


def similar_pairs(rows: DataFrame, id_: str, vec: str, dim: int, k: int = 5, least: float = 0.85) -> DataFrame:
    """(a, b): pairs at cosine >= ``least`` of which at least one is among the ``k`` most similar of the other."""
    found = nearest(rows, id_, vec, dim, k, least)
    return found.select(F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b")).distinct()
