"""Deduplicating new batches against all history.

A hash forest keeps every accepted signature in several permutations, each with another chunk of the hash leading, cut
into ranges of its leading bits and sorted within them. A batch locates its entries by prefix: the ranges of its own
prefixes, then of those one, two or three bits away, until the recall target is met; only ranges that a prefix falls into
are read, the batch goes to them, and candidates are verified on the whole signature. Checksums are kept in ranges as well.
Every accepted batch is one immutable run; runs of one size are merged, so a row is rewritten a logarithmic number of times.
"""

from __future__ import annotations

from math import comb, log

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shoebox.functions.hashes import checksum, phash64
from shoebox.operators.hamming import cheapest_errors, first_meeting, layout, ring_keys, spread
from shoebox.scratch import materialise, scratch_path

#: Rows of a range; a run has as many ranges of each permutation as this asks for.
ROWS_PER_RANGE = 1_000_000
#: Rows of 16 to 48 bytes each that are broadcast; more are joined by shuffle.
BROADCAST_ROWS = 2_000_000
#: Runs of about one size that are merged into one.
FAN = 4
_RUN = "run string, kind string, range int, key bigint, sig binary, id bigint"


def signatures(rows: DataFrame) -> DataFrame:
    """(id, h, md5, sha256) with unreadable or meaningless signatures null; rows without an id are left out."""
    return rows.select(
        F.col("id").cast("bigint").alias("id"), phash64(F.col("phash")).alias("h"), checksum(F.col("md5"), "md5").alias("md5"), checksum(F.col("sha256"), "sha256").alias("sha256")
    ).where("id is not null").distinct()


def _turned(h: Column, off: int, width: int) -> Column:
    """The hash rotated so that the chunk of ``width`` bits at ``off`` leads."""
    by = (off + width) % 64
    return F.shiftrightunsigned(h, by).bitwiseOR(F.shiftleft(h, 64 - by)) if by else h


def _turned_back(p: Column, off: int, width: int) -> Column:
    by = (off + width) % 64
    return F.shiftleft(p, by).bitwiseOR(F.shiftrightunsigned(p, 64 - by)) if by else p


def _lead(sig: Column) -> Column:
    """The first eight bytes of a checksum as a number."""
    return F.conv(F.hex(F.substring(sig, 1, 8)), 16, -10).cast("bigint")


def _digest(h: Column) -> Column:
    return F.unhex(F.lpad(F.hex(h), 16, "0"))


class Run:
    """One immutable part of a forest; its name tells the batches it holds, its rows, its layout and its range bits."""

    def __init__(self, name: str):
        self.name = name
        self.first, self.last, self.rows, self.errors, self.bits = (int(x) for x in name.removeprefix("run=").split("-"))

    @staticmethod
    def of(first: int, last: int, rows: int, max_distance: int, rows_per_range: int) -> Run:
        bits = max(0, (max(rows, 1) - 1).bit_length() - (rows_per_range.bit_length() - 1))
        return Run(f"run={first:08d}-{last:08d}-{rows}-{cheapest_errors(max_distance, rows, True)}-{min(bits, 12)}")

    @property
    def tier(self) -> int:
        return int(log(max(self.rows, 1), FAN))


class HashForest:
    """All accepted signatures as runs below ``path``.

    A run has the layout that is cheapest for its number of rows: with one error to a chunk four permutations and 16-bit
    prefixes (for a distance of 7), with two three of 21 bits, with three two of 32 bits. The prefixes of at most that many
    bits away guarantee every pair within ``max_distance``.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, max_distance: int = 7, rows_per_range: int = ROWS_PER_RANGE):
        self.spark, self.path, self.max_distance, self.rows_per_range = spark, path or scratch_path(spark, "forest"), max_distance, rows_per_range
        self.runs = self._stored()

    def _at(self, name: str = ""):
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)
        return p, p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _stored(self) -> list[Run]:
        """Complete runs; a half-written one is left aside, and so is one whose batches a merged run holds too."""
        p, fs = self._at()
        if not fs.exists(p):
            return []
        found = [Run(s.getPath().getName()) for s in fs.listStatus(p) if s.getPath().getName().startswith("run=") and fs.exists(self._at(f"{s.getPath().getName()}/_SUCCESS")[0])]
        covers = lambda a, b: a.name != b.name and a.first <= b.first and a.last >= b.last and (a.first, a.last) != (b.first, b.last)
        return sorted((r for r in found if not any(covers(o, r) for o in found)), key=lambda r: r.first)

    def _entries(self, runs: list[Run], kinds: list[str]) -> DataFrame:
        """(kind, range, key, sig, id) of some kinds: tree0.. (key the turned hash), hash, md5, sha256 (with ids), row."""
        return self.spark.read.schema(_RUN).option("basePath", self.path).parquet(*[f"{self.path}/{r.name}" for r in runs]).where(F.col("kind").isin(kinds))

    def ids(self) -> DataFrame:
        return self._entries(self.runs, ["row"]).select("id") if self.runs else self.spark.range(0)

    def unseen(self, batch: DataFrame) -> DataFrame:
        """Rows of a stored batch whose id was not accepted before; only ids of the history are read."""
        if not self.runs:
            return batch
        mine = batch.select("id").distinct()
        mine = F.broadcast(mine) if mine.count() <= BROADCAST_ROWS else mine
        known = materialise(self.ids().join(mine, "id", "left_semi").distinct(), "known")
        return batch if known.isEmpty() else materialise(batch.join(known, "id", "left_anti"), "unseen")

    def _write(self, rows: DataFrame, run: Run) -> None:
        """One run from (kind, key, sig, id): cut into ranges of leading bits, sorted within them."""
        bits = F.shiftrightunsigned("key", 64 - run.bits).cast("int") if run.bits else F.lit(0)
        ranged = rows.withColumn("range", F.when(F.col("kind") == "row", F.lit(0)).otherwise(bits))
        parts = max(1, -(-run.rows * 8 // self.rows_per_range))
        dealt = ranged.repartitionByRange(parts, "kind", "range", "key", "id") if parts > 1 else ranged.coalesce(1)
        dealt.sortWithinPartitions("kind", "range", "key").write.mode("overwrite").option("compression", "zstd").partitionBy("kind", "range").parquet(f"{self.path}/{run.name}")

    def _kinds(self, rows: DataFrame, errors: int) -> DataFrame:
        """(kind, key, sig, id) of rows (id, h, md5, sha256): each distinct hash once in each permutation."""
        none = F.lit(None).cast("bigint")
        trees = [F.struct(F.lit(f"tree{i}").alias("kind"), _turned(F.col("h"), o, w).alias("key"), F.lit(None).cast("binary").alias("sig"), none.alias("id")) for i, (o, w) in enumerate(layout(self.max_distance, errors))]
        hashed = rows.where("h is not null").select("h").distinct().select(F.explode(F.array(*trees)).alias("e")).select("e.*")
        sums = [F.when(F.col(c).isNotNull(), F.struct(F.lit(c).alias("kind"), _lead(F.col(c)).alias("key"), F.col(c).alias("sig"), F.col("id").alias("id"))) for c in ("md5", "sha256")]
        sums.append(F.when(F.col("h").isNotNull(), F.struct(F.lit("hash").alias("kind"), F.col("h").alias("key"), _digest(F.col("h")).alias("sig"), F.col("id").alias("id"))))
        sums.append(F.struct(F.lit("row").alias("kind"), F.col("id").alias("key"), F.lit(None).cast("binary").alias("sig"), F.col("id").alias("id")))
        return hashed.unionByName(rows.select(F.explode(F.array_compact(F.array(*sums))).alias("e")).select("e.*"))

    def accept(self, batch: DataFrame) -> int:
        """Accept the rows of a batch (stored, as from :func:`signatures`) whose ids are new, as one more run; gives their number.

        A run is written once and never changed, so a job that fails leaves the forest as it was, and a batch that is
        offered again changes nothing.
        """
        new = self.unseen(batch)
        rows = new.count()
        if rows == 0:
            return 0
        number = max((r.last for r in self.runs), default=-1) + 1
        run = Run.of(number, number, rows, self.max_distance, self.rows_per_range)
        self._write(self._kinds(new, run.errors), run)
        self.runs = [*self.runs, run]
        return rows

    def merge_runs(self, fan: int = FAN) -> None:
        """Merge the last ``fan`` runs while they are of one size or less, as one run of the layout for their rows."""
        while len(self.runs) >= fan and max(r.tier for r in self.runs[-fan:]) <= self.runs[-fan].tier:
            old = self.runs[-fan:]
            merged = Run.of(old[0].first, old[-1].last, sum(r.rows for r in old), self.max_distance, self.rows_per_range)
            parts = self._entries(old, ["hash", "md5", "sha256", "row"]).select("kind", "key", "sig", "id")
            none = F.lit(None)
            hashes = parts.where("kind = 'hash'").select(F.col("key").alias("h"), none.cast("bigint").alias("id"))
            trees = self._kinds(hashes.withColumns({"md5": none.cast("binary"), "sha256": none.cast("binary")}), merged.errors).where("kind like 'tree%'")
            self._write(parts.unionByName(trees), merged)
            self.runs = [*self.runs[:-fan], merged]
            for r in old:
                p, fs = self._at(r.name)
                fs.delete(p, True)

    def recall(self, run: Run, radius: int) -> float:
        """Share of the pairs at the greatest distance, their bits anywhere, that prefixes up to ``radius`` bits away find."""
        chunks, d = layout(self.max_distance, run.errors), self.max_distance
        # Ways to put d bits so that every chunk has more than radius of them: those pairs are missed.
        missed = [1] + [0] * d
        for _, w in chunks:
            missed = [sum(missed[t - x] * comb(w, x) for x in range(radius + 1, t + 1)) for t in range(d + 1)]
        return 1 - missed[d] / comb(64, d)

    def radius(self, run: Run, target: float) -> int:
        """Prefixes are widened until the recall target is met."""
        return next(r for r in range(run.errors + 1) if r == run.errors or self.recall(run, r) >= target)

    def _read(self, runs: list[Run], kinds: list[str], asked: DataFrame, leading: Column) -> DataFrame:
        """Entries of the ranges into which the asked keys fall; ``leading`` is a key with its prefix in the highest bits.

        The runs have the same number of range bits, and the prefixes are longer than these. At most 4096 range numbers come to the driver.
        """
        found, bits = self._entries(runs, kinds), runs[0].bits
        if bits == 0:
            return found
        touched = [r[0] for r in asked.select(F.shiftrightunsigned(leading, 64 - bits).cast("int").alias("r")).distinct().collect()]
        return found.where(F.col("range").isin(touched)) if len(touched) < 1 << bits else found

    def _groups(self, *by: str) -> list[list[Run]]:
        """Runs of one layout and one number of range bits are read together."""
        out: dict[tuple, list[Run]] = {}
        for r in self.runs:
            out.setdefault(tuple(getattr(r, n) for n in by), []).append(r)
        return list(out.values())

    def similar(self, batch: DataFrame, recall: float = 1.0) -> DataFrame:
        """(h_a, h_b): hash of an accepted row, hash of the batch, within ``max_distance``."""
        hashes = materialise(batch.where("h is not null").select(F.col("h").alias("h_b")).distinct(), "asked")
        n = hashes.count()
        parts = []
        for runs in self._groups("errors", "bits"):
            chunks, radius = layout(self.max_distance, runs[0].errors), self.radius(runs[0], recall)
            probes = spread(hashes, n).select("h_b", F.explode(ring_keys(F.col("h_b"), chunks, radius)).alias("r")).select("h_b", F.col("r.k").alias("k"))
            size = n * sum(comb(w, r) for _, w in chunks for r in range(radius + 1))
            if runs[0].bits:
                probes = materialise(probes, "probes")
            tree, number, prefix = F.lit(0), F.lit(len(chunks)).cast("bigint"), F.col("k")
            if len(chunks) > 1:
                tree, prefix = F.pmod("k", number).cast("int"), F.floor(F.col("k") / number).cast("bigint")
            pick = lambda on, of: F.coalesce(*[F.when(on == i, of(o, w)) for i, (o, w) in enumerate(chunks)])
            leading = pick(tree, lambda o, w: F.shiftleft(prefix, 64 - w))
            index = self._read(runs, [f"tree{i}" for i in range(len(chunks))], probes, leading)
            of_kind = F.substring("kind", 5, 2).cast("int")
            head = pick(of_kind, lambda o, w: F.shiftrightunsigned("key", 64 - w)) * number + of_kind if len(chunks) > 1 else F.col("key")
            index = index.select(head.alias("k"), pick(of_kind, lambda o, w: _turned_back(F.col("key"), o, w)).alias("h_a"))
            xor = F.col("h_a").bitwiseXOR(F.col("h_b"))
            once = first_meeting(F.col("k"), xor, F.lit(0).cast("bigint"), chunks, radius, 0)
            mine = F.broadcast(probes) if size <= BROADCAST_ROWS else probes.hint("merge")
            parts.append(index.join(mine, "k").where((F.bit_count(xor) <= self.max_distance) & once).select("h_a", "h_b"))
        return self._union(parts, "h_a bigint, h_b bigint")

    def _union(self, parts: list[DataFrame], schema: str) -> DataFrame:
        if not parts:
            return self.spark.range(0).selectExpr(*[f"cast(null as {c.split()[1]}) {c.split()[0]}" for c in schema.split(", ")])
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    def _accepted(self, asked: DataFrame) -> DataFrame:
        """(kind, sig, id_a): accepted ids of asked signatures (kind, key, sig, each once, stored)."""
        few = asked.count() <= BROADCAST_ROWS
        parts = []
        for runs in self._groups("bits"):
            have = self._read(runs, ["hash", "md5", "sha256"], asked, F.col("key")).select("kind", "key", "sig", F.col("id").alias("id_a"))
            parts.append(have.join(F.broadcast(asked) if few else asked, ["kind", "key", "sig"], "left_semi").select("kind", "sig", "id_a"))
        return self._union(parts, "kind string, sig binary, id_a bigint")

    def repeats(self, batch: DataFrame, recall: float = 1.0) -> tuple[DataFrame, DataFrame, DataFrame]:
        """What a stored batch repeats: ``matches`` (kind, sig, sig_b), and who has these signatures, ``accepted`` (kind, sig, id_a) and ``new`` (kind, sig_b, id_b).

        Matches are between signatures, equal checksums or hashes within the distance, however many rows share one; null
        signatures match nothing. :meth:`pairs` has the rows.
        """
        rows = batch.select("id", F.explode(F.array_compact(F.array(*[F.when(F.col(c).isNotNull(), F.struct(F.lit(k).alias("kind"), sig.alias("sig"))) for c, k, sig in (("h", "hash", _digest(F.col("h"))), ("md5", "md5", F.col("md5")), ("sha256", "sha256", F.col("sha256")))]))).alias("s"))
        new = rows.select("s.kind", F.col("s.sig").alias("sig_b"), F.col("id").alias("id_b"))
        close = self.similar(batch, recall).distinct().select(F.lit("hash").alias("kind"), _digest(F.col("h_a")).alias("sig"), _digest(F.col("h_b")).alias("sig_b"))
        equal = new.where("kind <> 'hash'").select("kind", F.col("sig_b").alias("sig"), "sig_b").distinct()
        matches = materialise(close.unionByName(equal), "matches")
        asked = materialise(matches.select("kind", "sig").distinct().withColumn("key", _lead(F.col("sig"))), "asked")
        return matches, self._accepted(asked), new

    def pairs(self, batch: DataFrame, recall: float = 1.0) -> DataFrame:
        """(id_a, id_b): accepted row and row of a stored batch with equal md5, equal sha256 or hashes within the distance.

        Each pair once, ids different, whichever of the three made it.
        """
        matches, accepted, new = self.repeats(batch, recall)
        return accepted.join(matches, ["kind", "sig"]).join(new, ["kind", "sig_b"]).where("id_a <> id_b").select("id_a", "id_b").distinct()


def screen_batches(files: DataFrame, listing: DataFrame, path: str | None = None, max_distance: int = 7, batch: str = "batch_no") -> DataFrame:
    """(id_a, id_b): id_b a listing row, id_a a files row or another listing row that it repeats, smaller id first.

    The history is accepted once; the batches of the listing (numbered by ``batch``, rows without a number last) are
    accepted one after the other, each screened against all that the forest then holds, itself included. Signatures are
    read as bytes whatever their spelling; a checksum of nothing and an unreadable or zero hash match nothing. Both
    tables need id, phash, md5, sha256. ``path`` keeps the forest: rows that it holds already are not accepted again.
    """
    spark = files.sparkSession
    forest = HashForest(spark, path, max_distance)
    forest.accept(materialise(signatures(files), "batch"))
    number = F.col(batch).cast("bigint") if batch in listing.columns else F.lit(0).cast("bigint")
    sig = signatures(listing).join(listing.select(F.col("id").cast("bigint").alias("id"), number.alias("batch")).groupBy("id").agg(F.min("batch").alias("batch")), "id")
    sig = materialise(sig, "batch")
    parts = []
    for (no,) in sig.select("batch").distinct().orderBy(F.col("batch").asc_nulls_last()).collect():
        mine = sig.where(F.col("batch").eqNullSafe(F.lit(no))).drop("batch")
        forest.accept(mine)
        found = forest.pairs(mine).select(F.least("id_a", "id_b").alias("id_a"), F.greatest("id_a", "id_b").alias("id_b"))
        parts.append(materialise(found, "found"))
        forest.merge_runs()
    return forest._union(parts, "id_a bigint, id_b bigint").distinct()
