from pathlib import Path
from urllib.parse import urlparse

import numpy as np
import pytest

import __spark_entry__
from shoebox.operators.alike import _stripes, alike_links
from shoebox.operators.components import connected_components
from shoebox.scratch import shared_root


def joined(ids, v, threshold):
    """(smallest id, id) of every id that some link joins to another one."""
    u = v.astype(np.float32).astype(float)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    group = {int(i): int(i) for i in ids}
    linked = set()
    for a, b in zip(*np.nonzero(np.triu(u @ u.T >= threshold, 1))):
        a, b = int(ids[a]), int(ids[b])
        if a != b:
            linked |= {a, b}
            x, y = sorted((group[a], group[b]))
            if x != y:
                group = {k: x if g == y else g for k, g in group.items()}
    return sorted((group[i], i) for i in linked)


def looks(seed, dim=24):
    """A hot look in two halves, looks of all sizes, chains between them, copies, scaled copies and rows with repeated ids."""
    rnd = np.random.default_rng(seed)
    hot, turn = rnd.normal(size=(2, dim))
    v = [hot + t * turn + rnd.normal(scale=0.12, size=(150, dim)) for t in (0, 0.6)]
    v += [rnd.normal(size=dim) + rnd.normal(scale=0.3, size=(n, dim)) for n in rnd.integers(1, 12, 80)]
    v += [rnd.normal(size=(200, dim))]
    v = np.concatenate(v).astype(np.float32)
    v = np.concatenate([v, v[::7], v[::9] * 3, v[:40]])
    ids = np.concatenate([rnd.permutation(len(v) - 40), np.arange(40)])
    return ids, v


@pytest.mark.parametrize("threshold", [0.65, 0.9, 0.2, -0.3, 1.0])
@pytest.mark.parametrize("how", [{}, {"pivot_rows": 60, "group_rows": 50, "stripe_rows": 90}])
def test_links_join_what_all_pairs_join(spark, rows, threshold, how):
    ids, v = looks(3)
    if threshold == 1.0:
        v = np.sign(v)  # Lengths and products without rounding; 24 equal signs or none.
        v = np.concatenate([v[:, :16], v[:, :0]], axis=1)
    dim = v.shape[1]
    more = [(9001, None), (9002, [0.0] * dim), (9003, [1.0]), (9004, [float("nan")] * dim), (9005, [None] * dim), (None, v[0].tolist())]
    df = spark.createDataFrame([(int(i), x) for i, x in zip(ids, v.tolist())] + more, "id long, vec array<float>").repartition(3)
    assert rows(connected_components(alike_links(df, threshold, dim, **how))) == sorted(joined(ids, v, threshold), key=repr)
    assert alike_links(df.limit(0), threshold, dim, **how).count() == 0


def test_stripes_hold_all_places_once_and_few_rows_each():
    bounds = _stripes({1: 1000, 2: 40, 3: 30, 7: 70, 50: 250}, 100)
    assert bounds[0][0] == -np.inf and bounds[-1][1] == np.inf
    assert all(a[1] == b[0] and a[0] < a[1] for a, b in zip(bounds, bounds[1:]))
    assert len(bounds) <= 16


def test_dbscan_stores_and_sends_the_vectors_a_few_times(spark, tmp_path):
    """Rows visited nearly all of 64 balls, in tiles of 1 024, as doubles: 28 times their bytes on disk."""
    v = np.random.default_rng(4).normal(size=(6000, 128)).astype(np.float32)
    spark.createDataFrame([(i, x) for i, x in enumerate(v.tolist())], "id long, vec array<float>").write.parquet(f"{tmp_path}/faces.parquet")

    def disk():
        blocks = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        shuffled = sum(f.length() for f in spark.sparkContext._jvm.scala.jdk.javaapi.CollectionConverters.asJava(blocks))
        return shuffled + sum(p.stat().st_size for p in Path(urlparse(shared_root(spark)).path).rglob("*.parquet"))

    before = disk()
    assert __spark_entry__.queries()["G4_dbscan"](spark, str(tmp_path)).count() == 0
    assert disk() - before < 4 * v.nbytes
