import numpy as np
import pytest
from pyspark.sql import functions as F

from shoebox.llm import components
from shoebox.llm.components import connected_components, consolidate, deal, match_links, spanning_forest


def truth(links):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in links:
        if a is not None and b is not None and a != b:
            low, high = sorted((find(a), find(b)))
            parent[high] = low
    return sorted((find(x), x) for x in parent)


def graphs():
    rnd = np.random.default_rng(4)
    yield "path", [(i, i + 1) for i in range(500)]
    yield "star", [(250, i) for i in range(500)]
    yield "random", [tuple(map(int, p)) for p in rnd.integers(0, 700, (450, 2))]
    yield "negative and huge", [(-5, 2**62), (2**62, 7), (-(2**63), 2**63 - 1), (1, 2)]
    yield "dirty", [(2, 1), (1, 2), (1, 1), (None, 4), (4, None), (5, 6), (6, 5), (5, 6)]
    yield "empty", []


@pytest.mark.parametrize("name,links", list(graphs()))
@pytest.mark.parametrize("bound", [10**6, 120])
def test_components(spark, rows, name, links, bound):
    df = spark.createDataFrame(links, "a long, b long")
    assert rows(connected_components(df, edges_per_partition=bound, fan_in=2)) == sorted(truth(links), key=repr)


def test_contraction_is_reached_and_right(spark, rows, monkeypatch):
    """A path that no bounded partition can hold, so roots have to be contracted."""
    links = [(i, i + 1) for i in range(400)]
    seen = []
    whole = components.materialise
    monkeypatch.setattr(components, "materialise", lambda df, name, **kw: (seen.append(name), whole(df, name, **kw))[1])
    assert rows(connected_components(spark.createDataFrame(links, "a long, b long"), edges_per_partition=60, fan_in=2)) == sorted(truth(links), key=repr)
    assert "hung" in seen


def test_hub_is_spread(spark, rows):
    """A star of 40 times the bound: no partition holds much more than the bound."""
    links = [(0, i) for i in range(1, 40_001)]
    df = spark.createDataFrame(links, "a long, b long")
    sizes = deal(df, 40, 1000).groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
    assert sizes <= 1500
    assert rows(connected_components(df, edges_per_partition=1000)) == sorted([(0, i) for i in range(40_001)], key=repr)


def test_forest_is_a_forest():
    rnd = np.random.default_rng(1)
    a, b = rnd.integers(0, 200, 300), rnd.integers(0, 200, 300)
    keep = a != b
    for seed in (None, 3):
        root, node = spanning_forest(a[keep], b[keep], seed)
        assert len(set(node.tolist())) == len(node) and not set(root.tolist()) & set(node.tolist())
        assert truth(list(zip(root.tolist(), node.tolist()))) == truth(list(zip(a[keep].tolist(), b[keep].tolist())))


FILES = "id long, phash string"
PAIRS = "file_id_a long, file_id_b long, is_match boolean"
GROUPS = "group_id long, file_id long"


def test_all_kinds_of_links(spark, rows):
    files = spark.createDataFrame([(1, "ff"), (2, "0xFF "), (3, "fe"), (4, "ff00"), (5, None), (6, "0000"), (7, "0000"), (8, "n/a"), (None, "ff")], FILES)
    pairs = spark.createDataFrame([(10, 11, True), (11, 10, False), (12, 12, True), (13, None, True), (11, 14, None), (20, 11, True)], PAIRS)
    groups = spark.createDataFrame([(1, 30), (1, 31), (1, 31), (2, 32), (None, 33), (None, 34), (3, None), (3, 35), (4, 31), (4, 20)], GROUPS)
    assert rows(consolidate(files, pairs, groups)) == sorted([(1, 1), (1, 2), (1, 3)] + [(10, x) for x in (10, 11, 20, 30, 31)], key=repr)
    assert rows(consolidate(files.limit(0), pairs.limit(0), groups.limit(0))) == []


def test_distance_edge_and_hot_hash(spark, rows):
    h = 0xF0F0F0F0F0F0F0F0
    files = [(i, f"{h:016x}") for i in range(300)] + [(1000, f"{h ^ 0x7F:016x}"), (1001, f"{h ^ 0x7F00_0000_0000_00:016x}"), (1002, f"{h ^ 0xFF0F00000000:016x}")]
    got = rows(consolidate(spark.createDataFrame(files, FILES), spark.createDataFrame([], PAIRS), spark.createDataFrame([], GROUPS)))
    assert got == sorted([(0, i) for i in [*range(300), 1000, 1001]], key=repr)
    links = match_links(spark.createDataFrame(files, FILES), spark.createDataFrame([], PAIRS), spark.createDataFrame([], GROUPS))
    assert links.count() < 400
