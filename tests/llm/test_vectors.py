import numpy as np
import pytest

from shoebox.llm.blocks import meet, routed
from shoebox.llm.clusters import Mixture, cluster_vectors, describe_clusters, fit_mixtures
from shoebox.llm.components import connected_components
from shoebox.llm.neighbours import balanced_parts, nearest, neighbour_graph, similar_pairs
from shoebox.plans.tables import table

VEC = "id long, vec array<float>"
LARGER = "/root/testdata/sf0.01"


def unit_rows(df, dim, id_="id"):
    got = [(r[id_], np.array(r["vec"], np.float64)) for r in df.select(id_, "vec").collect() if r["vec"] and len(r["vec"]) == dim and any(r["vec"])]
    return np.array([i for i, _ in got]), np.array([v / np.linalg.norm(v) for _, v in got])


def components(ids, s, threshold):
    group = {int(i): int(i) for i in ids}
    for a, b in zip(*np.nonzero(np.triu(s >= threshold, 1))):
        x, y = group[int(ids[a])], group[int(ids[b])]
        if x != y:
            low, high = min(x, y), max(x, y)
            group = {k: low if v == high else v for k, v in group.items()}
    sizes = {}
    for v in group.values():
        sizes[v] = sizes.get(v, 0) + 1
    return sorted((v, k) for k, v in group.items() if sizes[v] > 1)


@pytest.mark.parametrize("folder", ["/root/testdata/sf0.001", LARGER])
def test_clusters_equal_brute_force_on_the_table(spark, folder):
    faces = table(spark, folder, "faces").where("person_id is null")
    ids, u = unit_rows(faces, 128)
    got = sorted((r["cluster_key"], r["id"]) for r in cluster_vectors(faces).collect())
    assert got == components(ids, u @ u.T, 0.65)


def test_a_third_of_all_records_in_one_look(spark, monkeypatch):
    """The hot look fills many tiles; its records meet through their leader."""
    rnd = np.random.default_rng(6)
    hot = rnd.normal(size=16)
    v = np.vstack([hot + rnd.normal(scale=0.25, size=(400, 16)), rnd.normal(size=(800, 16))]).astype(np.float32)
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], VEC)
    import shoebox.llm.clusters as c

    monkeypatch.setattr(c, "meet", lambda *a: meet(*a, tile_rows=64))
    ids, u = unit_rows(df, 16)
    want = components(ids, u @ u.T, 0.8)
    got = sorted((r["cluster_key"], r["id"]) for r in cluster_vectors(df, dim=16, threshold=0.8, visits=6).collect())
    assert len(set(want) & set(got)) >= 0.97 * len(want) and len(got) <= 1.03 * len(want)


def test_clusters_of_dirty_rows(spark, rows):
    a, b = [1.0, 0.0, 0.0], [0.0, 1.0, 0.0]
    df = spark.createDataFrame([(1, a, 1), (2, [2.0, 0.0, 0.0], 1), (2, [2.0, 0.0, 0.0], 1), (3, a, 1), (4, b, 1), (5, None, 1), (6, [0.0] * 3, 1), (7, [1.0, 0.0], 1), (8, [1.0, None, 0.0], 1), (9, [float("nan"), 1.0, 0.0], 1), (None, a, 1)], VEC + ", unit int")
    assert rows(cluster_vectors(df, dim=3)) == [(1, 1), (1, 2), (1, 3)]
    described = cluster_vectors(df, dim=3, described=True)
    assert rows(describe_clusters(described, 2).select("cluster_key", "n_members", "rank_no")) == [(1, 3, 1), (1, 3, 2)]
    assert cluster_vectors(df.limit(0), dim=3).count() == 0
    assert cluster_vectors(df.limit(0), dim=3, described=True).columns == ["cluster_key", "id", "density"]


def test_mixture_grows_likelier_and_the_criterion_finds_the_groups():
    rnd = np.random.default_rng(3)
    centres = rnd.normal(scale=6, size=(8, 12))
    x = (centres[rnd.integers(0, 8, 2000)] + rnd.normal(size=(2000, 12))).astype(np.float32)
    steps = [Mixture(x, 8, 6, 1, steps=n).log_likelihood for n in (1, 4, 10)]
    assert steps[0] <= steps[1] + 1 and steps[1] <= steps[2] + 1
    assert fit_mixtures(x, 1, 6)[0].k in (8, 16)


def truth_neighbours(ids, u, k, least):
    s = (u @ u.T).round(7)
    out = set()
    for i, a in enumerate(ids):
        order = sorted((-s[i, j], ids[j]) for j in range(len(ids)) if j != i and s[i, j] >= least)[:k]
        out |= {(int(a), int(b), n + 1) for n, (_, b) in enumerate(order)}
    return out


def test_neighbours_on_the_tables(spark):
    emb = table(spark, LARGER, "file_embeddings")
    ids, u = unit_rows(emb, 64, "file_id")
    want = {(min(a, b), max(a, b)) for a, b, _ in truth_neighbours(ids, u, 5, 0.85)}
    got = {(r["a"], r["b"]) for r in similar_pairs(emb, "file_id", "vec", 64).collect()}
    assert len(want & got) >= 0.99 * len(want) and got <= want
    faces = table(spark, LARGER, "faces")
    ids, u = unit_rows(faces, 128)
    want = {w[:2] for w in truth_neighbours(ids, u, 5, -1) if w[0] % 20 == 0}
    got = {(r["id"], r["other"]) for r in nearest(faces, "id", "vec", 128, queries="id % 20 = 0").collect()}
    assert len(want & got) >= 0.9 * len(want)


@pytest.mark.parametrize("how", [{"rows_per_part": 50}, {"rows_per_part": 20, "most": 4}])
def test_recall_holds_where_parts_outnumber_visits(spark, how):
    """Neighbours of low cosine, spread over parts of which 4 were visited whatever the recall; also in divided parts."""
    v = np.random.default_rng(9).normal(size=(1500, 32)).astype(np.float32)
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], VEC)
    ids, u = unit_rows(df, 32)
    want = {w[:2] for w in truth_neighbours(ids, u, 5, -1) if w[0] % 3 == 0}
    got = {(r["id"], r["other"]) for r in nearest(df, "id", "vec", 32, queries="id % 3 = 0", **how).collect()}
    assert len(want & got) >= 0.9 * len(want)


def test_exact_modes_lose_nothing(spark):
    emb = table(spark, LARGER, "file_embeddings")
    ids, u = unit_rows(emb, 64, "file_id")
    got = {(r["id"], r["other"], r["rank_no"]) for r in nearest(emb, "file_id", "vec", 64, 5, 0.85, exact=True, rows_per_part=20, most=4).collect()}
    assert got == truth_neighbours(ids, u, 5, 0.85)
    faces = table(spark, LARGER, "faces").where("person_id is null")
    fast = {tuple(r) for r in cluster_vectors(faces).select("cluster_key", "id").collect()}
    exact = {tuple(r) for r in cluster_vectors(faces, exact=True).select("cluster_key", "id").collect()}
    divided = {tuple(r) for r in cluster_vectors(faces, rows_per_component=20).select("cluster_key", "id").collect()}
    ids, u = unit_rows(faces, 128)
    at = {}
    for i, j in zip(*np.nonzero(np.triu(u @ u.T >= 0.65, 1))):
        at.setdefault(int(ids[i]), set()).add(int(ids[j]))
    assert {i for _, i in exact} == set(at) | set().union(*at.values())
    assert len(fast & exact) >= 0.99 * len(exact) and len(divided & exact) >= 0.97 * len(exact)


def test_copies_and_ties_are_exact(spark):
    rnd = np.random.default_rng(2)
    one, other = rnd.normal(size=8), rnd.normal(size=8)
    near = one + 0.05 * other
    df = spark.createDataFrame([(i, one.tolist()) for i in range(20)] + [(100, near.tolist()), (101, other.tolist()), (102, None), (103, [0.0] * 8)], VEC)
    got = {(r["id"], r["other"], r["rank_no"]) for r in nearest(df, "id", "vec", 8, 3, 0.5).collect()}
    ids, u = unit_rows(df, 8)
    assert got == {w for w in truth_neighbours(ids, u, 3, 0.5)}
    assert nearest(df.limit(0), "id", "vec", 8).count() == 0


def test_parts_are_balanced_and_follow_the_graph():
    rnd = np.random.default_rng(1)
    x = np.repeat(rnd.normal(size=(20, 10)), 50, 0) + rnd.normal(scale=0.2, size=(1000, 10))
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    graph = neighbour_graph(x, 8)
    part = balanced_parts(graph, 10, 0)
    assert np.bincount(part, minlength=10).max() <= 112
    assert (part[graph] == part[:, None]).mean() > 0.8


def test_tiles_meet_every_pair_once_a_block(spark):
    rnd = np.random.default_rng(7)
    df = spark.createDataFrame([(i, bytearray(rnd.normal(size=4).astype(np.float32).tobytes())) for i in range(50)], "id long, unit binary")
    import pandas as pd

    both = lambda h, v: pd.DataFrame([(a, b) for a in h["id"] for b in v["id"]], columns=["a", "b"])
    all_in_one = routed(df, [lambda x: (np.zeros(len(x), int), np.zeros((len(x), 1), int))], 4)
    got = [tuple(r) for r in meet(all_in_one, both, "a long, b long", tile_rows=8).collect()]
    assert len(got) == 2500 and len(set(got)) == 2500
    assert connected_components(spark.createDataFrame(got, "a long, b long")).count() == 50


def test_clusters_store_and_send_the_vectors_a_few_times(spark):
    """Every vector went to 20 blocks of the mixtures: more than 20 times its bytes in shuffle files."""
    from pathlib import Path
    from urllib.parse import urlparse

    from shoebox.scratch import shared_root

    v = np.random.default_rng(4).normal(size=(20_000, 128)).astype(np.float32)
    df = spark.createDataFrame([(i, x) for i, x in enumerate(v.tolist())], VEC)

    def disk():
        blocks = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        shuffled = sum(f.length() for f in spark.sparkContext._jvm.scala.jdk.javaapi.CollectionConverters.asJava(blocks))
        return shuffled + sum(p.stat().st_size for p in Path(urlparse(shared_root(spark)).path).rglob("*.parquet"))

    before = disk()
    assert cluster_vectors(df).count() == 0
    assert disk() - before < 4 * v.nbytes


@pytest.mark.parametrize("rows_per_component", [20, 50_000])
def test_no_link_is_missed_whatever_the_size_of_components(spark, rows_per_component):
    """Chains of records joined just above the threshold or apart just below it; more records than components hold were divided, and lost links."""
    rnd = np.random.default_rng(12)
    steps = []
    for _ in range(150):
        a, b = np.linalg.qr(rnd.normal(size=(64, 2)))[0].T
        turn = np.arccos(rnd.choice([0.64, 0.66], size=10))
        steps.append(np.array([np.cos(t) * a + np.sin(t) * b for t in np.cumsum(turn)]))
    v = np.concatenate(steps)[rnd.permutation(1500)].astype(np.float32)
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], VEC)
    ids, u = unit_rows(df, 64)
    got = sorted((r["cluster_key"], r["id"]) for r in cluster_vectors(df, dim=64, rows_per_component=rows_per_component).collect())
    assert got == components(ids, u @ u.T, 0.65)


def test_densities_come_from_all_vectors_whatever_the_size(spark):
    """A sample beyond 20 000 rows was taken by the number of all rows, so rows without a vector thinned it out, or left nothing to describe clusters by."""
    rnd = np.random.default_rng(8)
    v = np.concatenate([rnd.normal(size=16) + rnd.normal(scale=0.3, size=(n, 16)) for n in (9, 14, 30, 40, 60)] + [rnd.normal(size=(200, 16))])
    df = spark.createDataFrame([(i, x) for i, x in enumerate(v.tolist())], VEC)
    ask = lambda d, **how: sorted(tuple(r) for r in cluster_vectors(d, dim=16, dims=8, described=True, **how).collect())
    want = ask(df)
    assert [w[:2] for w in want] == sorted((r["cluster_key"], r["id"]) for r in cluster_vectors(df, dim=16).collect())
    assert ask(df.repartition(7), sample_rows=40) == want
    empty = spark.range(1000, 2_000_000, numPartitions=8).selectExpr("id", "cast(null as array<float>) vec")
    assert ask(df.unionByName(empty)) == want


def test_a_mixture_is_fitted_alike_on_tasks_of_any_cut(spark, monkeypatch):
    """Chunks of fewer rows than a batch, and steps over all rows as likely as those of one task."""
    import shoebox.llm.clusters as c

    rnd = np.random.default_rng(5)
    centres = rnd.normal(scale=3, size=(8, 12))
    v = (centres[rnd.integers(0, 8, 3000)] + rnd.normal(size=(3000, 12))).astype(np.float32)
    df = spark.createDataFrame([(i, x) for i, x in enumerate(v.tolist())], VEC)
    monkeypatch.setattr(c, "CHUNK_ROWS", 500)
    (a, stored), (b, _) = (c.fit_to_all(c.unit_vectors(d, "id", "vec", 12), 12, 6) for d in (df, df.repartition(5)))
    assert stored.select("chunk").distinct().count() == 6 and stored.count() == 3000
    assert a.k == b.k and np.array_equal(a.mu, b.mu) and np.array_equal(a.var, b.var)
    whole = Mixture(v / np.linalg.norm(v, axis=1, keepdims=True), a.k, 6, 0)
    assert a.k in (4, 8, 16) and abs(a.log_likelihood - whole.log_likelihood) < 0.1 * abs(whole.log_likelihood)
