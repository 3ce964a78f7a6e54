import random
import shutil

import pytest

from shoebox.llm.history import HashForest, screen_batches, signatures
from shoebox.scratch import materialise

ROW = "id long, md5 string, sha256 string, phash string"


def rows_of(n, start, rnd, pool):
    out = []
    for i in range(n):
        h = rnd.choice(pool) ^ sum(1 << b for b in rnd.sample(range(64), rnd.randrange(10)))
        md5 = rnd.choice([None, "", "d41d8cd98f00b204e9800998ecf8427e", "0" * 32, f"{rnd.randrange(40):032x}", f"MD5:{rnd.randrange(40):032X}"])
        sha = rnd.choice([None, f"{rnd.randrange(60):064x}", "0" * 64])
        out.append((start + i, md5, sha, rnd.choice([f"{h:016x}", f"0x{h:X}", None, "0"])))
    return out


def read(row):
    hexed = lambda s, p: (s or "").lower().removeprefix(p).strip()
    m, s = hexed(row[1], "md5:"), hexed(row[2], "sha256:")
    h = int(row[3], 16) if row[3] else 0
    return row[0], m if m.strip("0") and m != "d41d8cd98f00b204e9800998ecf8427e" else None, s if s.strip("0") else None, h or None


def truth(old, new):
    new = [read(r) for r in new]
    pairs = set()
    for b in new:
        for a in [*(read(r) for r in old), *new]:
            if a[0] < b[0] and (a[1] and a[1] == b[1] or a[2] and a[2] == b[2] or a[3] and b[3] and (a[3] ^ b[3]).bit_count() <= 7):
                pairs.add((a[0], b[0]))
    return pairs


def test_equals_brute_force(spark):
    rnd = random.Random(8)
    pool = [rnd.getrandbits(64) | 1 for _ in range(12)]
    old, new = rows_of(150, 1, rnd, pool), rows_of(60, 1000, rnd, pool)
    got = screen_batches(spark.createDataFrame(old, ROW), spark.createDataFrame([*new, *new[:5]], ROW))
    got = [tuple(r) for r in got.collect()]
    assert len(got) == len(set(got)) and set(got) == truth(old, new)


def test_batches_one_after_the_other_and_merged_runs(spark, tmp_path):
    rnd = random.Random(9)
    pool = [rnd.getrandbits(64) | 1 for _ in range(8)]
    batches = [rows_of(25, 1000 * k, rnd, pool) for k in range(1, 5)]
    path, seen, found = f"file://{tmp_path}/forest", [], set()
    for k, batch in enumerate(batches):
        forest = HashForest(spark, path, rows_per_range=16)
        sig = materialise(signatures(spark.createDataFrame(batch, ROW)), "batch")
        found |= {tuple(r) for r in forest.pairs(sig).collect()}
        assert found == {p for p in truth(seen, [r for b in batches[: k + 1] for r in b]) if p[0] // 1000 < p[1] // 1000}
        assert forest.accept(sig) == 25 and forest.accept(sig) == 0
        forest.merge_runs(fan=2)
        assert len(HashForest(spark, path).runs) <= 3
        assert HashForest(spark, path).ids().count() == 25 * (k + 1)


def test_screening_again_adds_nothing(spark, tmp_path):
    rnd = random.Random(3)
    pool = [rnd.getrandbits(64) | 1 for _ in range(6)]
    files, listing = rows_of(40, 1, rnd, pool), [(*r, rnd.choice([1, None])) for r in rows_of(40, 1000, rnd, pool)]
    path = f"file://{tmp_path}/kept"
    for _ in range(2):
        got = screen_batches(spark.createDataFrame(files, ROW), spark.createDataFrame(listing, ROW + ", batch_no int"), path)
        assert sorted(tuple(r) for r in got.collect()) == sorted(truth(files, [r[:4] for r in listing]))
        assert HashForest(spark, path).ids().count() == 80


def test_only_touched_ranges_are_read(spark, tmp_path, monkeypatch):
    rnd = random.Random(4)
    forest = HashForest(spark, f"file://{tmp_path}/r", rows_per_range=64)
    forest.accept(materialise(signatures(spark.createDataFrame([(i, None, None, f"{rnd.getrandbits(64) | 1:016x}") for i in range(4096)], ROW)), "batch"))
    assert forest.runs[0].bits == 6
    one = materialise(signatures(spark.createDataFrame([(9999, None, None, "123456789abcdef1")], ROW)), "batch")
    read, seen = forest._read, []
    monkeypatch.setattr(forest, "_read", lambda *a: (seen.append(read(*a)), seen[-1])[1])
    forest.similar(one)
    ranges = lambda d: d.select("kind", "range").distinct().count()
    assert 0 < ranges(seen[0]) < ranges(forest._entries(forest.runs, [f"tree{i}" for i in range(4)])) / 2


@pytest.mark.parametrize("errors", [1, 2, 3])
def test_every_layout_misses_nothing(spark, tmp_path, monkeypatch, errors):
    monkeypatch.setattr("shoebox.llm.history.cheapest_errors", lambda *a: errors)
    rnd = random.Random(errors)
    base = [rnd.getrandbits(64) | 1 for _ in range(20)]
    near = [b ^ sum(1 << x for x in rnd.sample(range(64), 7)) for b in base]
    forest = HashForest(spark, f"file://{tmp_path}/l")
    forest.accept(materialise(signatures(spark.createDataFrame([(i, None, None, f"{h:016x}") for i, h in enumerate(base)], ROW)), "batch"))
    batch = materialise(signatures(spark.createDataFrame([(100 + i, None, None, f"{h:016x}") for i, h in enumerate(near)], ROW)), "batch")
    got = [tuple(r) for r in forest.similar(batch).collect()]
    assert len(got) == len(set(got)) == 20


def test_half_written_and_merged_runs_do_not_count(spark, tmp_path):
    forest = HashForest(spark, f"file://{tmp_path}/f")
    for i in range(2):
        forest.accept(materialise(signatures(spark.createDataFrame([(i, None, None, "ff")], ROW)), "batch"))
    old = [r.name for r in forest.runs]
    (tmp_path / "f/run=00000002-00000002-1-1-0").mkdir()
    assert [r.name for r in HashForest(spark, f"file://{tmp_path}/f").runs] == old
    for r in old:
        shutil.copytree(tmp_path / "f" / r, tmp_path / "kept" / r)
    forest.merge_runs(fan=2)
    for r in old:
        # As if the job had been lost before it removed the small runs.
        shutil.copytree(tmp_path / "kept" / r, tmp_path / "f" / r, dirs_exist_ok=True)
    again = HashForest(spark, f"file://{tmp_path}/f")
    assert [(r.first, r.last) for r in again.runs] == [(0, 1)] and again.ids().count() == 2


def test_prefixes_widen_to_the_target(spark, tmp_path):
    forest = HashForest(spark, f"file://{tmp_path}/g")
    forest.accept(materialise(signatures(spark.createDataFrame([(1, None, None, "ffff")], ROW)), "batch"))
    run = forest.runs[0]
    assert 0.3 < forest.recall(run, 0) < 0.6 and forest.recall(run, 1) == 1
    assert (forest.radius(run, 0.3), forest.radius(run, 0.9), forest.radius(run, 1.0)) == (0, 1, 1)
    # One bit in each of the four chunks: the narrow prefixes miss it, the wider ones do not.
    far = materialise(signatures(spark.createDataFrame([(2, None, None, f"{0xFFFF ^ (1 | 1 << 17 | 1 << 33 | 1 << 49):x}")], ROW)), "batch")
    assert forest.similar(far, recall=0.3).count() == 0 and forest.similar(far).count() == 1


def test_empty_tables(spark):
    e = spark.createDataFrame([], ROW)
    assert screen_batches(e, e).count() == 0
