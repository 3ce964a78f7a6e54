import random

import pytest

from shoebox.llm.runs import collapse_runs

FRAME = "id long, file_id long, t double, phash string"


def truth(frames, distance=4):
    kept = {}
    for i, f, t, p in frames:
        try:
            h = int(p.strip(), 16) if p else 0
        except ValueError:
            h = 0
        if f is None or t is None or t != t or not h:
            continue
        if (f, t) not in kept or kept[f, t][0] > i:
            kept[f, t] = (i, h)
    out, run = [], []
    for key in sorted(kept):
        here = (key, *kept[key])
        if run and (run[-1][0][0] != key[0] or (run[-1][2] ^ here[2]).bit_count() > distance):
            out.append(run)
            run = []
        run.append(here)
    out.append(run)
    return sorted((r[0][0][0], r[0][1], r[-1][1], len(r), r[0][0][1], r[-1][0][1], r[-1][0][1] - r[0][0][1]) for r in out if len(r) > 1)


def frames(n=900):
    rnd = random.Random(5)
    h, out = rnd.getrandbits(64), []
    for i in range(n):
        h = rnd.getrandbits(64) if rnd.random() < 0.2 else h ^ sum(1 << rnd.randrange(64) for _ in range(rnd.randrange(4)))
        f = 1 if i % 3 else rnd.randrange(2, 9)
        p = rnd.choice([f"{h:016x}", f"0x{h:X}", f" {h:016X} "]) if rnd.random() < 0.95 else rnd.choice([None, "", "n/a", "0" * 16])
        out.append((rnd.choice([i, 10_000 - i]) * 2 + rnd.randrange(2), f if rnd.random() < 0.98 else None, rnd.choice([None, float("nan")]) if rnd.random() < 0.03 else float(i // 2) * 0.5, p))
    return list({x[0]: x for x in out}.values())


@pytest.mark.parametrize("slice_rows", [10**6, 100, 7])
def test_runs_do_not_depend_on_the_slices(spark, slice_rows):
    data = frames()
    got = sorted(tuple(r) for r in collapse_runs(spark.createDataFrame(data, FRAME), slice_rows=slice_rows).collect())
    assert got == truth(data)


def test_one_long_run_over_many_slices(spark):
    data = [(i, 1, float(i), "ff") for i in range(200)]
    assert [tuple(r)[:4] for r in collapse_runs(spark.createDataFrame(data, FRAME), slice_rows=9).collect()] == [(1, 0, 199, 200)]


def test_repeats_ties_clashes_and_empty(spark):
    df = spark.createDataFrame([(5, 1, 1.0, "ff", 9), (3, 1, 1.0, "0f", 9), (3, 1, 1.0, "0f", 9), (4, 1, 2.0, "0f", 9), (6, 1, -0.0, "0f", 9), (7, 1, 0.0, "0f", 9)], FRAME + ", run int")
    assert [tuple(r)[:4] for r in collapse_runs(df).collect()] == [(1, 6, 4, 3)]
    assert collapse_runs(df.limit(0)).count() == 0
