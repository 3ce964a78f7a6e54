"""Grouping records into similarity clusters.

Records are linked exactly at the threshold and links are joined into clusters. A Gaussian mixture, fitted by
expectation-maximisation with covariances shrunk towards their pooled value on standardised, reduced features, with the number
of components of the lowest Bayesian information criterion, says how typical a record's look is: the
members of highest density describe each cluster.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shoebox.llm.blocks import SAMPLE_ROWS, matrix, meet, unit_vectors  # noqa: F401
from shoebox.llm.components import connected_components
from shoebox.operators.alike import PIVOT_ROWS, alike_links
from shoebox.scratch import materialise

COMPONENTS = (1, 2, 4, 8, 16, 32, 64, 128, 256)
#: Rows whose share in a step is computed at a time.
CHUNK_ROWS = 8192


class Reduction:
    """Standardises vectors and turns them into fewer dimensions, from their means, deviations and correlations."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, alike: np.ndarray, dims: int, seed: int):
        self.mean, self.scale = mean, scale
        _, axes = np.linalg.eigh(alike)
        # Leading axes, then a seeded rotation that keeps some of them: mixtures of other seeds err elsewhere.
        lead = axes[:, ::-1][:, : min(len(mean), dims * 3 // 2)]
        turn, _ = np.linalg.qr(np.random.default_rng(seed).normal(size=(lead.shape[1], min(dims, lead.shape[1]))))
        self.axes = lead @ turn
        self.spread = ((alike @ self.axes) * self.axes).sum(0) + 1e-6

    def __call__(self, x: np.ndarray) -> np.ndarray:
        """Reduced rows, rounded: equal vectors are equal whatever rows they are computed with."""
        z = ((x - self.mean) / self.scale) @ self.axes
        return (np.rint(z * 2**14) / 2**14).astype(np.float32)


class Mixture:
    """A Gaussian mixture with regularised diagonal covariances on standardised, reduced features."""

    def __init__(self, sample: np.ndarray, components: int, dims: int, seed: int, shrink: float = 0.9, steps: int = 12):
        mean, scale = sample.mean(0, dtype=np.float64), sample.std(0, dtype=np.float64) + 1e-6
        x = (sample - mean) / scale
        view = Reduction(mean, scale, x.T @ x / len(x), dims, seed)
        z = view(sample)
        self._begin(view, z, components, seed, shrink)
        for _ in range(steps):
            self.step(self.sums(z))

    @classmethod
    def begun(cls, view: Reduction, few: np.ndarray, components: int, seed: int, shrink: float = 0.9) -> Mixture:
        """A mixture before its first step, whose components begin at some of a ``few`` reduced rows."""
        out = cls.__new__(cls)
        out._begin(view, few, components, seed, shrink)
        return out

    def _begin(self, view: Reduction, few: np.ndarray, components: int, seed: int, shrink: float) -> None:
        self.view, self.shrink, self.log_likelihood = view, shrink, -np.inf
        k = self.k = min(components, len(few))
        self.mu = self._spread_out(few, k, np.random.default_rng((seed, 1)))
        self.var, self.weight = np.tile(view.spread / 2, (k, 1)).astype(np.float32), np.full(k, 1 / k, np.float32)

    def sums(self, z: np.ndarray) -> np.ndarray:
        """What a step needs to know of the rows, in whole units, so that sums over parts of the rows add up alike in any order.

        A component's mass, sums and squares come in units of 2**-24, the likelihood last, of 2**-8. The squares of all rows
        are at most as many as rows times vector dimensions, so 2**32 rows of 128 fit.
        """
        dens = self._log_density(z)
        top = dens.max(1, keepdims=True)
        r = np.exp(dens - top)
        total = r.sum(1, keepdims=True)
        likely = (np.log(total) + top).sum(dtype=np.float64)
        r /= total
        each = np.concatenate([r.sum(0)[:, None], r.T @ z, r.T @ (z * z)], axis=1).astype(np.float64)
        return np.rint(np.r_[each.ravel() * 2**24, likely * 2**8]).astype(np.int64)

    def step(self, total: np.ndarray) -> None:
        """Parameters of highest likelihood for the sums over all rows."""
        self.log_likelihood = float(total[-1]) / 2**8
        each, dims = total[:-1].reshape(self.k, -1) / 2**24, self.mu.shape[1]
        mass = each[:, 0] + 1e-6
        mu = each[:, 1 : dims + 1] / mass[:, None]
        own = np.maximum(each[:, dims + 1 :] / mass[:, None] - mu**2, 0)
        pooled = (own * mass[:, None]).sum(0) / mass.sum()
        self.mu = mu.astype(np.float32)
        self.var = ((1 - self.shrink) * own + self.shrink * pooled + 1e-3 * self.view.spread).astype(np.float32)
        self.weight = (mass / mass.sum()).astype(np.float32)

    @staticmethod
    def _spread_out(z: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
        """Rows to begin with, each drawn by its squared distance to those drawn before, from at most 20 rows for each."""
        z = z[rng.permutation(len(z))[: max(1000, 20 * k)]]
        first = int(rng.integers(len(z)))
        chosen, away = [first], ((z - z[first]) ** 2).sum(1).astype(np.float64)
        while len(chosen) < k:
            total = away.sum()
            at = int(rng.choice(len(z), p=away / total)) if total > 0 else int(rng.integers(len(z)))
            chosen.append(at)
            away = np.minimum(away, ((z - z[at]) ** 2).sum(1))
        return z[chosen].copy()

    def _log_density(self, z: np.ndarray) -> np.ndarray:
        mu, inv = self.mu.astype(z.dtype), 1 / self.var.astype(z.dtype)
        quad = (z * z) @ inv.T - 2 * z @ (mu * inv).T + (mu**2 * inv).sum(1)
        return np.log(self.weight) - 0.5 * (quad - np.log(inv).sum(1) + z.shape[1] * float(np.log(2 * np.pi)))

    def log_density(self, x: np.ndarray) -> np.ndarray:
        """Weighted log density of each row under each component."""
        return self._log_density(self.view(x))

    @property
    def width(self) -> int:
        return len(self.view.mean)

    scores = log_density

    def bic(self, rows: int) -> float:
        """Variances count as far as they are a component's own, after the shrinking towards the pooled ones."""
        dims = self.mu.shape[1]
        free = self.k * (dims + 1) - 1 + dims + (1 - self.shrink) * (self.k - 1) * dims
        return -2 * self.log_likelihood + free * np.log(rows)

    def route(self, visits: int):
        """Home (most probable component) and the ``visits`` most probable components of each row."""

        def router(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            d = self.log_density(x)
            m = min(visits, self.k)
            return d.argmax(1), np.argpartition(-d, m - 1, axis=1)[:, :m]

        return router


def fit_mixtures(sample: np.ndarray, mixtures: int, dims: int) -> list[Mixture]:
    """``mixtures`` models of one size, the size chosen by the information criterion of the first."""
    sizes = [k for k in COMPONENTS if k == 1 or k * 32 <= len(sample)]
    best = min((Mixture(sample, k, dims, 0, steps=6).bic(len(sample)), k) for k in sizes)[1]
    return [Mixture(sample, best, dims, seed) for seed in range(mixtures)]


def _moments(batches: Iterator[pa.RecordBatch], dim: int) -> Iterator[pa.RecordBatch]:
    """Number, sums and products of a task's unit vectors, which count in whole units of 2**-18, so exactly."""
    total = np.zeros((dim + 1, dim + 1), np.int64)
    for batch in batches:
        u = matrix(batch.column("unit").to_pylist(), dim)
        for i in range(0, len(u), CHUNK_ROWS):
            x = np.rint(u[i : i + CHUNK_ROWS].astype(np.float64) * 2**18)
            x = np.concatenate([np.ones((len(x), 1)), x], axis=1)
            total += (x.T @ x).astype(np.int64)
    if total[0, 0]:
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()])], ["raw"])


def _reduced(batches: Iterator[pa.RecordBatch], view: Reduction, dim: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        z = view(matrix(batch.column("unit").to_pylist(), dim))
        yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([row.tobytes() for row in z], pa.binary())], ["id", "z"])


def _chunks(batches: Iterator[pa.RecordBatch], dims: int) -> Iterator[np.ndarray]:
    """The stored rows of a chunk, at most ``CHUNK_ROWS`` at a time, however tasks and batches are cut."""
    at, held, n = None, [], 0
    for batch in batches:
        chunk, z, start = batch.column("chunk").to_numpy(), matrix(batch.column("z").to_pylist(), dims), 0
        while start < len(z):
            if chunk[start] != at:
                if n:
                    yield np.concatenate(held)
                at, held, n = chunk[start], [], 0
            stop = min(len(z), start + CHUNK_ROWS - n)
            stop = start + int(np.r_[chunk[start:stop] != at, True].argmax())
            held.append(z[start:stop])
            n, start = n + stop - start, stop
            if n == CHUNK_ROWS:
                yield np.concatenate(held)
                held, n = [], 0
    if n:
        yield np.concatenate(held)


def _sums(batches: Iterator[pa.RecordBatch], models: list[Mixture], dims: int) -> Iterator[pa.RecordBatch]:
    total = None
    for z in _chunks(batches, dims):
        more = np.concatenate([m.sums(z) for m in models])
        total = more if total is None else total + more
    if total is not None:
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()])], ["raw"])


def fit_to_all(units: DataFrame, dim: int, dims: int) -> tuple[Mixture, DataFrame] | None:
    """(model, stored (id, z, chunk)): a mixture fitted to all rows of (id, unit), of the size of the lowest criterion; None for no rows.

    Every row counts in the means, in the correlations and in each step; only the rows where components begin, at most 20 for each,
    are drawn, by a hash of id and vector. Rows are summed in chunks by the same hash, so tasks and partitions change nothing.
    A task's sums of all sizes, half a megabyte, come to the driver at each step.
    """
    add = lambda rows, kind: sum(np.frombuffer(bytes(r["raw"]), np.int64).astype(kind) for r in rows.collect())
    total = add(units.mapInArrow(lambda b: _moments(b, dim), "raw binary"), object)
    if isinstance(total, int):
        return None
    total = total.reshape(dim + 1, dim + 1)
    n, first = total[0, 0], total[0, 1:]
    spread = (n * total[1:, 1:] - np.outer(first, first)).astype(np.float64) / (float(n) ** 2 * 2.0**36)
    scale = np.sqrt(np.diag(spread)) + 1e-6
    view = Reduction(first.astype(np.float64) / (n * 2.0**18), scale, spread / np.outer(scale, scale), dims, 0)
    width, chunks = view.axes.shape[1], -(-n // CHUNK_ROWS)
    order = F.xxhash64("id", "z")
    rows = units.mapInArrow(lambda b: _reduced(b, view, dim), "id long, z binary").withColumn("chunk", F.pmod(order, F.lit(chunks)).cast("int"))
    rows = rows.repartitionById(min(chunks, 256 + chunks // 8), F.col("chunk"))
    rows = materialise(rows, "reduced", sort_by=["chunk", "id", "z"])
    few = rows.orderBy(order, "id", "z").limit(20 * COMPONENTS[-1]).select("z").toArrow()
    few = matrix(few.column("z").to_pylist(), width)
    models = [Mixture.begun(view, few, k, 0) for k in COMPONENTS if k == 1 or k * 32 <= n]
    for step in range(12):
        if step == 6:
            models = [min(models, key=lambda m: (m.bic(n), m.k))]
        total = add(rows.mapInArrow(lambda b, models=models: _sums(b, models, width), "raw binary"), np.int64)
        ends = np.cumsum([m.k * (2 * width + 1) + 1 for m in models])
        for m, part in zip(models, np.split(total, ends[:-1])):
            m.step(part)
    return models[0], rows


def _density(batches: Iterator[pd.DataFrame], model: Mixture) -> Iterator[pd.DataFrame]:
    """Densities to six places, so that those of equal vectors are equal in every batch."""
    for batch in batches:
        d = model._log_density(matrix(batch["z"], model.mu.shape[1]).astype(np.float64))
        top = d.max(1)
        yield pd.DataFrame({"id": batch["id"], "density": (np.log(np.exp(d - top[:, None]).sum(1)) + top).round(6)})


def cluster_vectors(
    rows: DataFrame, id_: str = "id", vec: str = "vec", dim: int = 128, threshold: float = 0.65, mixtures: int = 1, visits: int = 4, dims: int = 64, sample_rows: int = SAMPLE_ROWS, described: bool = False, exact: bool = True, rows_per_component: int = PIVOT_ROWS
) -> DataFrame:
    """(cluster_key, id[, density]) of every record in a cluster of at least two; cluster_key is its smallest id.

    Two records are linked at cosine >= ``threshold``; clusters are everything linked directly or through others. All links
    count, at any size (:func:`alike_links`): ``rows_per_component``, the records to a pivot, changes the cost only, and ``visits``
    and ``exact``, of the time when a mixture proposed the pairs, ``mixtures`` and ``sample_rows``, of the time when it was fitted on a sample, change
    nothing. ``density`` comes from a mixture fitted on all vectors (:func:`fit_to_all`). Null, short, all-zero and non-finite vectors and null ids
    are in no cluster and count nowhere; repeated ids are one record, of the greater density; an empty table gives no rows.
    """
    links = alike_links(rows, threshold, dim, id_, vec, pivot_rows=rows_per_component)
    out = connected_components(links).select(F.col("group_key").alias("cluster_key"), F.col("node").alias("id"))
    if not described:
        return out
    fitted = fit_to_all(unit_vectors(rows, id_, vec, dim), dim, dims)
    if fitted is None:
        return out.limit(0).withColumn("density", F.lit(0.0))
    model, reduced = fitted
    dense = reduced.select("id", "z").mapInPandas(lambda b: _density(b, model), "id long, density double").groupBy("id").agg(F.max("density").alias("density"))
    return out.join(dense, "id").select("cluster_key", "id", "density")


def describe_clusters(members: DataFrame, typical: int = 3) -> DataFrame:
    """(cluster_key, n_members, rank_no, id): each cluster's size and its ``typical`` members of highest density.

    Equal densities go by the smaller id. Sizes are counted and the leaders picked in partial aggregates, so a cluster
    of a third of all records is not gathered in one place.
    """
    salted = members.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(64)))
    w = Window.partitionBy("cluster_key", "salt").orderBy(F.desc("density"), "id")
    few = salted.withColumn("r", F.row_number().over(w)).where(F.col("r") <= typical).drop("r", "salt")
    t = Window.partitionBy("cluster_key").orderBy(F.desc("density"), "id")
    few = few.withColumn("rank_no", F.row_number().over(t).cast("bigint")).where(F.col("rank_no") <= typical)
    sizes = members.groupBy("cluster_key").agg(F.count("*").alias("n_members"))
    return few.join(sizes, "cluster_key").select("cluster_key", "n_members", "rank_no", "id")
