"""Centroids, assignment, exemplars and top-k over vectors, and exact clusters."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoebox.functions.vectors import comparable, dot, unit
from shoebox.scratch import materialise

BROADCAST_VECTORS = 50_000


def units(rows: DataFrame, dim: int, vec: str = "vec") -> DataFrame:
    """Rows with a comparable vector, ``vec`` brought to length one."""
    return rows.where(comparable(F.col(vec), dim)).withColumn(vec, unit(F.col(vec)))


def centroids(rows: DataFrame, key: str, vec: str = "vec", dim: int = 128) -> DataFrame:
    """(key, centroid): mean of the unit vectors of each key, at length one again; keys whose mean is zero are left out.

    Means are taken position by position in one partial aggregate, so no key's vectors are gathered.
    """
    u = units(rows.where(F.col(key).isNotNull()), dim, vec)
    means = u.groupBy(key).agg(*[F.avg(F.get(vec, F.lit(i))).alias(f"_{i}") for i in range(dim)])
    return means.select(key, unit(F.array(*[F.col(f"_{i}") for i in range(dim)])).alias("centroid")).where("centroid is not null")


def _best_of(x: np.ndarray, keys: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Key and similarity of the most similar of ``m`` (in the order of its keys) for each row."""
    s = (x @ m.T).round(9)
    at = s.argmax(1)
    return keys[at], s[np.arange(len(s)), at]


def best_match(rows: DataFrame, side: DataFrame, dim: int, most: int = BROADCAST_VECTORS) -> DataFrame:
    """(id, key, similarity): for each row (id, vec) the most similar of ``side`` (key, vec); ties go to the smaller key.

    A counted side of at most ``most`` vectors is sent to every task as one matrix. A larger one is cut into tiles, as
    are the rows; each pair of tiles is a task of bounded size and the best answers of a row are compared.
    """
    u = units(rows.select("id", "vec"), dim)
    side = materialise(units(side.select("key", "vec"), dim), "side")
    size, schema = side.count(), "id long, key long, similarity double"
    if size <= most:
        held = side.orderBy("key").toArrow()
        keys = held.column("key").to_numpy()
        m = np.array(held.column("vec").to_pylist(), np.float64).reshape(-1, dim)

        def match(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                if len(batch) and len(keys):
                    key, similarity = _best_of(np.stack(batch["vec"].to_list()), keys, m)
                    yield pd.DataFrame({"id": batch["id"], "key": key, "similarity": similarity})

        return u.mapInPandas(match, schema)
    u = materialise(u, "rows")
    tiles, parts = -(-size // most), max(1, -(-u.count() // most))
    deal = lambda d, c, own, n, other, k: d.withColumn(own, F.pmod(F.xxhash64(c, "vec"), F.lit(n)).cast("int")).withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(k - 1))))

    def meet(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if a.empty or b.empty:
            return pd.DataFrame({"id": [], "key": [], "similarity": []})
        b = b.sort_values("key")
        key, similarity = _best_of(np.stack(a["vec"].to_list()), b["key"].to_numpy(), np.stack(b["vec"].to_list()))
        return pd.DataFrame({"id": a["id"].to_numpy(), "key": key, "similarity": similarity})

    mine, theirs = deal(u, "id", "part", parts, "tile", tiles), deal(side, "key", "tile", tiles, "part", parts)
    found = mine.groupBy("part", "tile").cogroup(theirs.groupBy("part", "tile")).applyInPandas(meet, schema)
    best = found.groupBy("id").agg(F.max(F.struct("similarity", (-F.col("key")).alias("k"))).alias("b"))
    return best.select("id", (-F.col("b.k")).alias("key"), "b.similarity")


def assign_to_centroids(rows: DataFrame, means: DataFrame, key: str, least: float = 0.55, dim: int = 128) -> DataFrame:
    """(id, key, similarity): the most similar centroid of each row, strictly above ``least``; ties go to the smaller key."""
    found = best_match(rows, means.select(F.col(key).alias("key"), F.col("centroid").alias("vec")), dim)
    return found.where(F.col("similarity") > least).withColumnRenamed("key", key)


def exemplar_similarity(rows: DataFrame, exemplars: DataFrame, dim: int = 128) -> DataFrame:
    """(id, similarity): the greatest cosine of each row to any exemplar (id, vec), 0 at least."""
    found = best_match(rows, exemplars.select(F.col("id").alias("key"), "vec"), dim)
    return found.select("id", F.greatest("similarity", F.lit(0.0)).alias("similarity"))


def strangers(files: DataFrame, faces: DataFrame, keep_persons: list[int], keep_clusters: list[int], margin: float = 0.45, dim: int = 128) -> DataFrame:
    """(file_id, n_faces, closest): files with faces of which none belongs to the kept people or is within ``margin`` of one."""
    known = F.coalesce(F.col("person_id").isin(keep_persons), F.lit(False)) | F.coalesce(F.col("cluster_id").isin(keep_clusters), F.lit(False))
    here = faces.join(files.where("status <> 'trashed'").select(F.col("id").alias("file_id")), "file_id", "left_semi")
    close = exemplar_similarity(here, faces.where(known), dim)
    rated = here.withColumn("known", known).join(close, "id", "left").withColumn("similarity", F.coalesce("similarity", F.lit(0.0)))
    out = rated.groupBy("file_id").agg(F.bool_or(F.col("known") | (F.col("similarity") >= margin)).alias("known"), F.count("*").alias("n_faces"), F.round(F.max("similarity"), 2).alias("closest"))
    return out.where("not known").drop("known")


def numbered(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """Add ``name``: 1, 2, ... in an order without ties, without gathering the rows in one task.

    Rows are cut into sorted ranges; the counts of the ranges before, one number a range, are added up on the driver.
    """
    part = F.spark_partition_id()
    ranged = materialise(rows.repartitionByRange(*order).sortWithinPartitions(*order).select("*", part.alias("_part"), F.monotonically_increasing_id().alias("_at")), "ranges")
    counts = {r["_part"]: r["count"] for r in ranged.groupBy("_part").count().collect()}
    before, total = [], 0
    for i in range(max(counts, default=-1) + 1):
        before.append(total)
        total += counts.get(i, 0)
    start = F.get(F.expr("array(" + ", ".join(f"{b}L" for b in before or [0]) + ")"), F.col("_part"))
    return ranged.withColumn(name, start + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + 1).drop("_part", "_at")


def top_k(rows: DataFrame, query: list[float], k: int, id_: str = "id", vec: str = "vec", least: float | None = None) -> DataFrame:
    """The k rows most similar to one query vector, best first; ties go to the smaller id."""
    q = np.asarray(query, dtype=float)
    q = F.array(*[F.lit(float(x)) for x in q / np.linalg.norm(q)])
    scored = units(rows.select(id_, vec), len(query), vec).select(id_, dot(F.col(vec), q).alias("score"))
    if least is not None:
        scored = scored.where(F.col("score") >= least)
    return scored.orderBy(F.round("score", 9).desc(), F.col(id_)).limit(k).select(id_, F.round("score", 3).alias("score"))


def _ball_router(batches: Iterator[pd.DataFrame], pivots: np.ndarray, reach: np.ndarray | None, angle: float) -> Iterator[pd.DataFrame]:
    for batch in batches:
        x = np.stack([np.asarray(v, np.float64) for v in batch["vec"]]) if len(batch) else np.empty((0, pivots.shape[1]))
        away = np.arccos(np.clip(x @ pivots.T, -1, 1))
        home = away.argmin(1) if len(x) else np.empty(0, int)
        out = {"id": batch["id"], "vec": batch["vec"], "home": home, "away": away[np.arange(len(x)), home]}
        if reach is not None:
            out["visits"] = [np.flatnonzero(a <= reach + angle + 1e-9).tolist() for a in away]
        yield pd.DataFrame(out)


def similar_links(rows: DataFrame, threshold: float, dim: int = 128, pivots: int = 64) -> DataFrame:
    """(a, b): all pairs of ids at cosine >= ``threshold``, smaller id first. Exact.

    Rows go home to the nearest of some pivots; a row also visits every pivot whose ball of home rows, widened by
    the angle of the threshold, reaches it, so by the triangle inequality no pair is missed. Balls are cut into tiles.
    """
    u = materialise(units(rows.select("id", "vec"), dim).dropDuplicates(["id"]), "units")
    sample = u.select("vec", F.xxhash64("id").alias("o"), "id").orderBy("o", "id").limit(pivots).select("vec").collect()
    schema = "id long, vec array<double>, home int, away double"
    if not sample:
        return rows.sparkSession.createDataFrame([], "a bigint, b bigint")
    p = np.array([r["vec"] for r in sample])
    radii = u.mapInPandas(lambda b: _ball_router(b, p, None, 0.0), schema).groupBy("home").agg(F.max("away").alias("r")).collect()
    reach, angle = np.full(len(p), -np.inf), float(np.arccos(threshold))
    for r in radii:
        reach[r["home"]] = r["r"]
    placed = materialise(u.mapInPandas(lambda b: _ball_router(b, p, reach, angle), schema + ", visits array<int>"), "balls")
    tile = 1024
    n = placed.groupBy("home").agg(F.ceil(F.count("*") / tile).cast("int").alias("nh"))
    v = placed.select(F.explode("visits").alias("home")).groupBy("home").agg(F.ceil(F.count("*") / tile).cast("int").alias("nv"))
    sizes = F.broadcast(materialise(n.join(v, "home"), "sizes"))
    part = lambda n, salt: F.pmod(F.xxhash64("id", F.lit(salt)), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    h = placed.select("id", "vec", "home").join(sizes, "home").withColumn("i", part("nh", 1)).withColumn("j", each("nv")).withColumn("own", F.lit(True))
    w = placed.select("id", "vec", F.explode("visits").alias("home")).join(sizes, "home").withColumn("j", part("nv", 2)).withColumn("i", each("nh")).withColumn("own", F.lit(False))

    def meet(g: pd.DataFrame) -> pd.DataFrame:
        own = g["own"].to_numpy()
        a, b = g[own], g[~own]
        if a.empty or b.empty:
            return pd.DataFrame({"a": [], "b": []}, dtype=np.int64)
        s = np.stack(a["vec"].to_list()) @ np.stack(b["vec"].to_list()).T
        i, j = np.nonzero(s >= threshold)
        x, y = a["id"].to_numpy()[i], b["id"].to_numpy()[j]
        keep = x != y
        return pd.DataFrame({"a": np.minimum(x, y)[keep], "b": np.maximum(x, y)[keep]})

    cols = ["home", "i", "j", "id", "vec", "own"]
    return h.select(*cols).unionByName(w.select(*cols)).groupBy("home", "i", "j").applyInPandas(meet, "a long, b long").distinct()


def greedy_clusters(rows: DataFrame, eps: float = 0.35, dim: int = 128) -> DataFrame:
    """(id, cluster_no) by one pass in id order: join the nearest running centroid closer than ``eps``, else begin a cluster.

    The result depends on the order, so one task streams the sorted rows; it holds the running centroids, no rows. Clusters
    of one row have a null number; the others are numbered by first appearance. Meant for libraries where a
    pass is wanted; :func:`similar_links` with components is the parallel way.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums, counts, ids, mine = np.empty((0, dim)), [], [], []
        for batch in batches:
            for i, v in zip(batch["id"], batch["vec"]):
                v = np.asarray(v, float)
                best = -1
                if counts:
                    away = 1 - (sums / np.linalg.norm(sums, axis=1, keepdims=True).clip(1e-12)) @ v
                    best = int(away.argmin()) if away.min() < eps else -1
                if best < 0:
                    best = len(counts)
                    sums, counts = np.vstack([sums, np.zeros(dim)]), [*counts, 0]
                sums[best] += v
                counts[best] += 1
                ids.append(i)
                mine.append(best)
        numbers, n = {}, 0
        for c in mine:
            if counts[c] > 1 and c not in numbers:
                n += 1
                numbers[c] = n
        yield pd.DataFrame({"id": pd.array(ids, "Int64"), "cluster_no": pd.array([numbers.get(c) for c in mine], "Int64")})

    u = units(rows.select("id", "vec"), dim).orderBy("id").coalesce(1)
    return u.mapInPandas(run, "id long, cluster_no long")
