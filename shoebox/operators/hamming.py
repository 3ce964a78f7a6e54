"""Lossless Hamming-distance join of 64-bit hashes.

Pigeonhole: cut the 64 bits into n chunks; two hashes within distance d then differ by at most d // n bits in some
chunk. Of these errors one side's keys take up to one and the other side's keys the rest, so the join is an
equi-join that AQE can split where a bucket is hot. Fewer, longer chunks cost more keys a row but meet far fewer
other rows; which layout is cheapest follows from the number of rows, the result never depends on it.
"""

from __future__ import annotations

from itertools import combinations
from math import comb

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows whose keys are spread by one task before they are shuffled.
ROWS_PER_TASK = 20_000


def layout(max_distance: int, errors: int = 1) -> list[tuple[int, int]]:
    """(offset, width) of every chunk, as few chunks as leave at most ``errors`` differing bits to one of them."""
    n = -(-(max_distance + 1) // (errors + 1))
    bounds = [round(64 * i / n) for i in range(n + 1)]
    return [(lo, hi - lo) for lo, hi in zip(bounds, bounds[1:])]


def _ring(width: int, radius: int) -> int:
    return sum(comb(width, r) for r in range(radius + 1))


def cheapest_errors(max_distance: int, rows: int, stored_keys: bool = False) -> int:
    """The number of errors a chunk may have (1 to 3) at which a row's keys and the rows it meets cost least.

    ``stored_keys``: the indexed side has one key a chunk, so the probing side takes all errors.
    """
    cost = {}
    for e in (1, 2, 3):
        chunks, own = layout(max_distance, e), 0 if stored_keys else e // 2
        keys = sum(_ring(w, own) + _ring(w, e - own) for _, w in chunks)
        met = sum(_ring(w, own) * _ring(w, e - own) / 2**w for _, w in chunks) * rows
        cost[e] = keys + met
    return min(cost, key=cost.get)


def chunk(value: Column, off: int, width: int) -> Column:
    out = F.shiftrightunsigned(value, off) if off else value
    return out.bitwiseAND(F.lit((1 << width) - 1).cast("bigint")) if width < 64 else out


def _key(i: int, value: Column, n: int) -> Column:
    return value * F.lit(n).cast("bigint") + F.lit(i).cast("bigint") if n > 1 else value


def ring_keys(value: Column, chunks: list[tuple[int, int]], radius: int) -> Column:
    """Array of (k, flipped): per chunk its value and all values up to ``radius`` bits away, and which bits were turned."""

    def ring(i: int, off: int, width: int) -> Column:
        bits = [sum(1 << b for b in some) for r in range(radius + 1) for some in combinations(range(width), r)]
        turns = F.expr("array(" + ", ".join(f"cast('{x - ((x >> 63) << 64)}' as bigint)" for x in bits) + ")")
        base = chunk(value, off, width)
        return F.transform(turns, lambda t: F.struct(_key(i, base.bitwiseXOR(t), len(chunks)).alias("k"), t.alias("flipped")))

    return F.concat(*[ring(i, o, w) for i, (o, w) in enumerate(chunks)])


def first_meeting(key: Column, xor: Column, turned: Column, chunks: list[tuple[int, int]], errors: int, own: int) -> Column:
    """True for one of the keys under which a pair meets, so that each pair comes out once.

    It is the key of the first chunk with few enough errors, the indexed side turning nothing where the probing side
    can turn all, else the lowest differing bit.
    """
    n = len(chunks)
    at = F.pmod(key, F.lit(n).cast("bigint")) if n > 1 else F.lit(0)
    out = F.lit(False)
    for i, (o, w) in enumerate(chunks):
        x = chunk(xor, o, w)
        earlier = F.lit(True)
        for p, v in chunks[:i]:
            earlier = earlier & (F.bit_count(chunk(xor, p, v)) > errors)
        lowest = x.bitwiseAND(-x) if own else F.lit(0).cast("bigint")
        out = out | ((at == i) & earlier & (turned == F.when(F.bit_count(x) <= errors - own, F.lit(0).cast("bigint")).otherwise(lowest)))
    return out


def spread(rows: DataFrame, count: int) -> DataFrame:
    """Counted rows dealt to enough tasks before each of them is exploded into many."""
    return rows.repartition(max(1, -(-count // ROWS_PER_TASK)))


def hamming_join(probe: DataFrame, index: DataFrame, max_distance: int = 7, *, same: bool = False, errors: int | None = None) -> DataFrame:
    """Pairs (h_a, h_b, distance) of ``probe.h`` and ``index.h``, each column of distinct non-null values.

    With ``same`` the two sides are one table and each unordered pair comes out once, equal values left out.
    Null hashes never pair; an empty side gives no rows. ``errors`` fixes the layout, which else follows from the counts.
    """
    p = probe.select(F.col("h").alias("h_a")).where("h_a is not null")
    i = index.select(F.col("h").alias("h_b")).where("h_b is not null")
    n_i = i.count()
    n_p = n_i if same else p.count()
    e = errors or cheapest_errors(max_distance, max(n_i, n_p))
    chunks, own = layout(max_distance, e), e // 2
    p = spread(p, n_p).select("h_a", F.explode(ring_keys(F.col("h_a"), chunks, e - own)).alias("r")).select("h_a", F.col("r.k").alias("k"))
    i = spread(i, n_i).select("h_b", F.explode(ring_keys(F.col("h_b"), chunks, own)).alias("r")).select("h_b", F.col("r.k").alias("k2"), F.col("r.flipped").alias("turned"))
    xor = F.col("h_a").bitwiseXOR(F.col("h_b"))
    cond = (F.col("k") == F.col("k2")) & (F.bit_count(xor) <= max_distance) & first_meeting(F.col("k"), xor, F.col("turned"), chunks, e, own)
    if same:
        cond = cond & (F.col("h_a") < F.col("h_b"))
    # The planner takes the exploded probes for as small as their source; a merge join never broadcasts them.
    return p.hint("merge").join(i, cond).select("h_a", "h_b", F.bit_count(xor).alias("distance"))
