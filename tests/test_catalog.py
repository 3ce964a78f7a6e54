import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from shoebox.functions import media, names
from shoebox.functions.hashes import checksum, phash64
from shoebox.operators import changes, duplicates, frames, listing, trees, vectors
from shoebox.operators.components import connected_components
from shoebox.operators.hamming import cheapest_errors, hamming_join, layout
from shoebox.operators.search import parse_query, search
from shoebox.scratch import materialise

FILE = "id long, name string, kind string, status string, md5 string, sha256 string, phash string, quality double, size long, width int, height int, taken_time string, created_time string"


def one(spark, value):
    return spark.range(1).select(value.alias("v")).first()["v"]


def file(i, name="a.jpg", kind="photo", status="analyzed", md5=None, sha=None, phash=None, quality=None, size=10, width=1, height=1, taken=None, created=None):
    return (i, name, kind, status, md5, sha, phash, quality, size, width, height, taken, created)


def test_hash_spellings(spark):
    read = lambda s: one(spark, phash64(F.lit(s)))
    assert read("0xFF") == read(" 00ff\n") == read("FF") == 255
    assert read("ffffffffffffffff") == -1
    assert [read(s) for s in ("0000000000000000", "", "n/a", "0x", "fffffffffffffffff", None)] == [None] * 6


def test_checksum_spellings(spark):
    read = lambda s, kind="md5": one(spark, checksum(F.lit(s), kind))
    want = bytes.fromhex("935eda00494c4dd62dbc072af4b0e06c")
    assert all(bytes(read(s)) == want for s in ("935EDA00494C4DD62DBC072AF4B0E06C", " md5:935eda00494c4dd62dbc072af4b0e06c\n", "k17aAElMTdYtvAcq9LDgbA==", "k17aAElMTdYtvAcq9LDgbA"))
    assert [read(s) for s in ("d41d8cd98f00b204e9800998ecf8427e", "1B2M2Y8AsgTpgAmY7PhCfg==", "0" * 32, "AAAAAAAAAAAAAAAAAAAAAA==", "", "xyz", None)] == [None] * 7
    assert len(read("47DEQpj8HBSa+/TImW+5JCeuQeRkm5NMpJWZG3hSuFV=", "sha256") or b"") in (0, 32)


@settings(max_examples=12, deadline=None)
@given(st.lists(st.integers(-(2**63), 2**63 - 1), min_size=2, max_size=40), st.sampled_from([1, 3, 7, 8]), st.sampled_from([None, 1, 2, 3]))
def test_hamming_join_misses_nothing(spark, seeds, d, errors):
    rnd = np.random.default_rng(abs(seeds[0]) % 2**32)
    flip = lambda x: int(np.int64(x ^ sum(1 << int(b) for b in rnd.choice(63, rnd.integers(0, d + 2), replace=False))))
    values = sorted({*seeds, *(flip(s) for s in seeds)})
    h = materialise(spark.createDataFrame([(v,) for v in values], "h long"), "test")
    got = [(r["h_a"], r["h_b"]) for r in hamming_join(h, h, d, same=True, errors=errors).collect()]
    assert len(got) == len(set(got))
    got = set(got)
    want = {(a, b) for a in values for b in values if a < b and ((a ^ b) & (2**64 - 1)).bit_count() <= d}
    assert got == want


def test_chunk_layout_covers_all_bits():
    for d in range(1, 16):
        for errors in (1, 2, 3):
            chunks = layout(d, errors)
            assert sum(w for _, w in chunks) == 64 and d // len(chunks) <= errors


def test_layout_follows_the_rows():
    assert [cheapest_errors(7, n) for n in (1_000, 1_000_000, 1_000_000_000)] == [1, 2, 3]
    assert [cheapest_errors(7, n, True) for n in (1_000, 5_000_000, 1_000_000_000)] == [1, 2, 3]


def _components(links):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        if a is not None and b is not None and a != b:
            a, b = sorted((find(a), find(b)))
            parent[b] = a
    return sorted((find(x), x) for x in parent)


@pytest.mark.parametrize("links", [[], [(1, 1)], [(2, 1), (1, 2), (None, 3), (3, 4)], [(i, i + 1) for i in range(60)], [(50, i) for i in range(100)], [(int(a), int(b)) for a, b in np.random.default_rng(5).integers(0, 90, (70, 2))]])
def test_components(spark, rows, links):
    for one_task in (1_000, 0):
        got = connected_components(spark.createDataFrame(links, "a long, b long"), one_task=one_task)
        assert rows(got) == sorted(_components(links), key=repr)


def test_keeper_ties_and_order(spark):
    m = "0123456789abcdef0123456789abcdef"
    keep = lambda *fs, **kw: {r["keep_id"] for r in duplicates.exact_groups(spark.createDataFrame(list(fs), FILE), **kw).collect()}
    assert keep(file(2, md5=m), file(1, md5=m)) == {1}
    assert keep(file(1, "a copy.jpg", md5=m), file(2, md5=m)) == {2}
    assert keep(file(1, md5=m, width=1), file(2, md5=m.upper(), width=5)) == {2}
    assert keep(file(1, md5=m, taken="2020-01-01T00:00:00"), file(2, md5=m, taken="2019-12-31T00:00:00")) == {2}
    assert keep(file(1, md5=m, taken="2020-01-01T00:00:00"), file(2, md5=m, taken="2019-12-31T00:00:00"), compat=True) == {1}
    assert keep(file(1, md5=m), file(2, md5=m, status="trashed")) == set()
    assert keep(file(1), file(2), file(3, md5=""), file(4, md5="")) == set()


def test_exact_copies_stay_out_of_near_groups(spark):
    m, h = "0123456789abcdef0123456789abcdef", "ff00ff00ff00ff00"
    f = spark.createDataFrame([file(1, md5=m, phash=h), file(2, md5=m, phash=h), file(3, phash="ff00ff00ff00ff7f"), file(4, phash="00ff00ff00ff00ff"), file(5, phash="ff00ff00ff00fe7f")], FILE)
    exact = materialise(duplicates.exact_groups(f), "exact")
    near = duplicates.near_groups(f, exact)
    assert {r["file_id"] for r in near.collect()} == {1, 3, 5}
    assert all(r["similarity"] == (1.0 if r["file_id"] == r["keep_id"] else 0.891) for r in near.collect())


def test_video_overlap_counts_frames_of_the_shorter(spark, rows):
    fr = spark.createDataFrame([(1, 0.0, "f0"), (1, 1.0, "f0"), (1, 2.0, "0f0f0f0f0f0f0f0f"), (2, 0.0, "f1"), (2, 1.0, "f1f1f1f1f1f1f1f1"), (2, 2.0, "f3f1f1f1f1f1f1f1"), (2, 3.0, "f7"), (3, 0.0, None)], "file_id long, t double, phash string")
    v = spark.createDataFrame([(1,), (2,), (3,)], "id long")
    assert rows(duplicates.video_overlaps(fr, v, least=0.6)) == [(1, 2, pytest.approx(2 / 3))]
    assert rows(duplicates.video_overlaps(fr, v, least=0.7)) == []


def test_scene_fold_compares_with_the_last_kept(spark):
    at = [0, 0x3F, 0xFFF, 0x3FFFF, 0xFFFFFF]
    fr = spark.createDataFrame([(1, float(i), i, f"{(1 << 60) | h:016x}") for i, h in enumerate(at)], "file_id long, t double, id long, phash string")
    assert [r["id"] for r in frames.scene_changes(fr).orderBy("t").collect()] == [0, 2, 4]


def test_filename_years(spark):
    cases = {"IMG_20220305.jpg": 2022, "IMG-20220305-WA0001.jpg": 2022, "2022-03-05.png": 2022, "20221399.jpg": None, "120220305.jpg": None, "Screenshot 2024-01-05.png": 2024, "a.jpg": None, "20221399 20200101.jpg": 2020}
    got = spark.createDataFrame([(k,) for k in cases], "n string").select("n", names.year_in_name(F.col("n"), 2027).alias("y")).collect()
    assert {r["n"]: r["y"] for r in got} == cases


def test_resolved_year_priority(spark):
    r = lambda s, e, v, n, m: tuple(one(spark, names.resolved_year(*[F.lit(x).cast("int") for x in (s, e)], F.lit(v), F.lit(n).cast("int"), F.lit(m).cast("int"))))
    assert r(2001, 2002, False, 2003, 2004) == (2001, "takeout-sidecar")
    assert r(None, 2002, False, 2003, 2004) == (2002, "embedded-metadata")
    assert r(None, 1970, True, 2003, 2004) == (2003, "filename")
    assert r(None, None, True, None, 2004) == (2004, "file-mtime")


def test_small_scalars(spark):
    assert one(spark, media.date_text_rank(F.lit("2019-12-31"))) == 493 and one(spark, media.date_text_rank(F.lit(None).cast("string"))) == 228
    assert one(spark, names.human_seconds(F.lit(3700.0))) == "1h 01m" and one(spark, names.human_seconds(F.lit(-1.0))) == "—"
    assert one(spark, names.safe_name(F.lit(" a/b "))) == "a⁄b" and one(spark, names.safe_name(F.lit(" "))) == "_"
    assert [r["label"] for r in one(spark, media.heuristic_labels(F.lit("IMG-20200101-WA0001 screen shot.png"), F.lit(1), F.lit(1), F.lit("image/png"), F.lit(False)))] == ["screenshot", "messaging_download"]
    assert one(spark, media.padded_box(F.array(*[F.lit(float(x)) for x in (0, 0, 10, 20)]), F.lit(12), F.lit(30))) == [0.0, 0.0, 12.0, 27.0]


def test_upsert_keeps_what_a_listing_lacks_and_is_idempotent(spark, rows):
    old = spark.createDataFrame([("s", "a", 1, "m1", "analyzed"), ("s", "b", 2, "m2", "trashed"), ("s", None, 3, None, "indexed")], "source string, path string, size long, md5 string, status string")
    new = spark.createDataFrame([("s", "a", 9, None, 1), ("s", "c", 5, "m5", 1), ("s", "c", 6, None, 2)], "source string, path string, size long, md5 string, seq int")
    merge = lambda f: changes.upsert_index(f, new, ["source", "path"], ["size"], ["md5"])
    want = sorted([("s", "a", 9, "m1", "analyzed"), ("s", "b", 2, "m2", "trashed"), ("s", None, 3, None, "indexed"), ("s", "c", 6, None, None)], key=repr)
    assert rows(merge(old)) == want and rows(merge(merge(old))) == want


def test_transfer_plan(spark, rows):
    items = spark.createDataFrame([(1, "a"), (2, "a"), (3, None), (4, None), (5, "b")], "id long, md5 string")
    ledger = spark.createDataFrame([("b",), ("b",)], "md5 string")
    assert rows(changes.transfer_plan(items, ledger)) == sorted([(1, "a", True), (2, "a", False), (3, None, True), (4, None, True), (5, "b", False)], key=repr)


def test_numbered_names_never_take_a_taken_one(spark):
    r = spark.createDataFrame([(1, "f", "x.jpg"), (2, "f", "x.jpg"), (3, "f", "x.jpg"), (4, "f", "x (2).jpg"), (5, "g", "x.jpg"), (6, "f", "noext"), (7, "f", "noext")], "id long, folder string, name string")
    got = {x["id"]: x["target"] for x in changes.numbered_names(r, "folder", "name", ["id"]).collect()}
    assert got == {1: "x.jpg", 2: "x (3).jpg", 3: "x (4).jpg", 4: "x (2).jpg", 5: "x.jpg", 6: "noext", 7: "noext (2)"}


def test_walk_and_resolve(spark, rows):
    n = spark.createDataFrame([("a" * 20, None, "top"), ("b", "a" * 20, "x/y"), ("c", "b", "z"), ("d", None, "twin"), ("e", None, "twin")], "id string, parent string, name string")
    assert rows(trees.walk(n, n.where("name = 'top'"))) == [("a" * 20, 0, "top"), ("b", 1, "top/x⁄y"), ("c", 2, "top/x⁄y/z")]
    assert trees.resolve_folder(n, "a" * 20) == "a" * 20 and trees.resolve_folder(n, "z") == "c"
    for bad in ("twin", "none"):
        with pytest.raises(KeyError):
            trees.resolve_folder(n, bad)
    with pytest.raises(ValueError):
        trees.walk(spark.createDataFrame([("a", "b", "n"), ("b", "a", "n")], n.schema), n.where("false").unionByName(spark.createDataFrame([("a", None, "n")], n.schema)))


def test_query_parsing():
    people = [(1, "Mom"), (2, "Ann Lee")]
    assert parse_query("Mom 2022", people) == ([1], 2022, "person")
    assert parse_query("beach 2022", people) == ([], 2022, "beach")
    assert parse_query("2022", people) == ([], 2022, "")
    assert parse_query("Momentum", people) == ([], None, "Momentum")
    assert parse_query("with ann lee", people) == ([2], None, "with person")


def test_search_routes(spark):
    f = spark.createDataFrame([file(1, "beach.jpg", created="2020-05-01"), file(2, "sea.jpg", created="2021-05-01"), file(3, "beach.jpg", status="trashed", created="2020-05-01")], FILE)
    faces = spark.createDataFrame([(1, 7)], "file_id long, person_id long")
    persons = spark.createDataFrame([(7, "Mom")], "id long, name string")
    labels = spark.createDataFrame([(2, "beach day", 0.9, "x")], "file_id long, label string, score double, method string")
    emb = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.6, 0.8]), (3, [1.0, 0.0])], "file_id long, vec array<float>")
    run = lambda q, **kw: [(r["id"], r["score"]) for r in search(q, f, faces, persons, labels, **kw).collect()]
    assert run("") == [] and run("BEACH") == [(1, 0.5), (2, 0.5)] and run("2021") == [(2, 1.0)]
    assert run("beach", embeddings=emb, embed=lambda s: [1.0, 0.0]) == [(1, 1.0), (2, 0.6)]
    assert run("Mom sea", embeddings=emb, embed=lambda s: [0.0, 1.0]) == [(1, 0.0)]


def test_similar_links_equal_all_pairs_and_greedy(spark, rows):
    rnd = np.random.default_rng(2)
    base = rnd.normal(size=(12, 8))
    v = np.vstack([base[i % 12] + rnd.normal(scale=0.35, size=8) for i in range(120)])
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)] + [(500, [0.0] * 8), (501, None), (502, [1.0])], "id long, vec array<float>")
    u = v.astype(np.float32).astype(float)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    s = u @ u.T
    want = sorted(((i, j) for i in range(120) for j in range(i + 1, 120) if s[i, j] >= 0.8), key=repr)
    assert rows(vectors.similar_links(df, 0.8, 8, 6)) == want
    assert vectors.similar_links(df.limit(0), 0.8, 8).count() == 0
    greedy = vectors.greedy_clusters(df, 0.35, 8).collect()
    assert len(greedy) == 120 and {r["cluster_no"] for r in greedy} - {None}


def test_paging_and_lookup(spark):
    f = spark.createDataFrame([file(i, taken=f"20{i:02d}-01-01") for i in range(10)], FILE)
    assert [r["id"] for r in listing.page(f, listing.newest_first(), 1, 3).collect()] == [6, 5, 4]
    with pytest.raises(ValueError):
        listing.page(f, listing.newest_first(), 0, 201)
    with pytest.raises(KeyError):
        listing.required(listing.lookup(f, "id", 99), "file")
    assert listing.with_persons(f, spark.createDataFrame([(1, 2)], "file_id long, person_id long"), []).count() == 0


def test_bytes_at_rounding_ties(spark):
    """Every size has its text, also odd multiples of 50 000 and of 5 000 000 bytes."""
    import os
    import tempfile

    from shoebox.plans import registry

    sizes = [0, 1, 49_999, 50_001, *range(50_000, 20_000_000, 100_000), 250_000, 999_950_000, 999_999_999, 10**9, *range(1_005_000_000, 4_000_000_000, 10_000_000), 1_004_999_999, 2**53 + 1, 9 * 10**18]
    with tempfile.TemporaryDirectory() as d:
        spark.createDataFrame([(i, n) for i, n in enumerate(sizes)] + [(len(sizes), None)], "id long, size long").write.parquet(os.path.join(d, "files.parquet"))
        got = {r["id"]: r["h"] for r in registry.collect("QUERIES")["X26_human_bytes"](spark, d).collect()}
    assert got == {i: f"{n / 1e9:.2f} GB" if n >= 1e9 else f"{n / 1e6:.1f} MB" for i, n in enumerate(sizes)}
