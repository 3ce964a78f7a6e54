"""Versions of tables: upserts, replacements and ledgers. A change is a new DataFrame, never an update in place."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def last_wins(rows: DataFrame, key: list[str], order: str) -> DataFrame:
    """One row for each key, the one of the greatest ``order`` (no ties expected); keys are compared null-safe."""
    rest = [c for c in rows.columns if c not in key]
    return rows.groupBy(*key).agg(F.max_by(F.struct(*rest), order).alias("_r")).select(*key, "_r.*").select(*rows.columns)


def upsert_index(files: DataFrame, listing: DataFrame, key: list[str], refreshed: list[str], kept: list[str]) -> DataFrame:
    """``files`` with a listing merged in by ``key``.

    Rows in both take the ``refreshed`` columns of the listing, and its ``kept`` columns where these are not null; all
    else stays, so does every row the listing lacks. Rows only in the listing are added, their other columns
    null. Of listing rows of one key the last by ``seq`` counts; null keys never match and are added.
    """
    new = last_wins(listing, key, "seq") if "seq" in listing.columns else listing
    inner = [*refreshed, *kept]
    n = new.select(*key, *[F.col(c).alias(f"_n_{c}") for c in inner], F.lit(True).alias("_new"))
    both = files.withColumn("_old", F.lit(True)).join(n, key, "full_outer")
    out = {c: F.when(F.col("_new"), F.col(f"_n_{c}")).otherwise(F.col(c)) for c in refreshed}
    out |= {c: F.coalesce(F.col(f"_n_{c}"), F.col(c)) for c in kept}
    return both.withColumns(out).select(*files.columns)


def merge_labels(old: DataFrame, new: DataFrame) -> DataFrame:
    """(file_id, label, score, method): greatest score of both, rounded to three places, and the method of the newer row."""
    rows = old.withColumn("_seq", F.lit(0)).unionByName(new.withColumn("_seq", F.lit(1)))
    return rows.groupBy("file_id", "label").agg(F.round(F.max("score"), 3).alias("score"), F.max_by("method", "_seq").alias("method"))


def replace_rows(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Rows of ``old`` whose key ``new`` lacks, and all of ``new``."""
    return old.join(new.select(*key).distinct(), key, "left_anti").select(*old.columns).unionByName(new.select(*old.columns))


def set_columns(rows: DataFrame, condition: str, **values) -> DataFrame:
    """Columns set where a condition holds."""
    return rows.withColumns({c: F.when(F.expr(condition), F.lit(v)).otherwise(F.col(c)) for c, v in values.items()})


def id_union(*parts: DataFrame) -> DataFrame:
    """Distinct ids of all parts."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.distinct()


def transfer_plan(items: DataFrame, ledger: DataFrame | None = None) -> DataFrame:
    """(id, md5, fetch): what a download has to fetch; of equal md5 only the first, none that the ledger has.

    A null md5 is always fetched. ``items`` has id and md5, ``ledger`` md5.
    """
    first = items.where("md5 is not null").groupBy("md5").agg(F.min("id").alias("_first"))
    if ledger is not None:
        first = first.join(ledger.select("md5").distinct(), "md5", "left_anti")
    out = items.join(first, "md5", "left")
    return out.select("id", "md5", (F.col("md5").isNull() | (F.coalesce("_first", F.lit(None)) == F.col("id"))).alias("fetch")).withColumn("fetch", F.coalesce("fetch", F.lit(False)))


def numbered_names(rows: DataFrame, folder: str, name: str, order: list[str]) -> DataFrame:
    """Add ``target``: names that recur in a folder get ' (n)' before the extension, n from 2, never one that is already taken.

    Numbering leaves out the numbers that stand in the folder as names of their own.
    """
    w = Window.partitionBy(folder, name).orderBy(*order)
    r = rows.withColumn("_n", F.row_number().over(w))
    stem, ext = F.regexp_extract(name, r"^(.*?)(\.[^.]*)?$", 1), F.regexp_extract(name, r"^(.*?)(\.[^.]*)?$", 2)
    taken = rows.select(folder, name).distinct().withColumn("_k", F.regexp_extract(name, r"^(.*) \((\d+)\)(\.[^.]*)?$", 2)).where("_k <> ''")
    taken = taken.withColumn("_base", F.concat(F.regexp_extract(name, r"^(.*) \((\d+)\)(\.[^.]*)?$", 1), F.regexp_extract(name, r"^(.*) \((\d+)\)(\.[^.]*)?$", 3)))
    taken = taken.where(F.length("_k") < 10).groupBy(folder, F.col("_base").alias("_b")).agg(F.collect_set(F.col("_k").cast("int")).alias("_taken"))
    recurring = r.where("_n > 1").select(F.col(folder).alias("_f"), F.col(name).alias("_b")).distinct()
    need = taken.join(recurring, (F.col(folder) == F.col("_f")) & taken["_b"].eqNullSafe(recurring["_b"]), "left_semi").select(F.col(folder).alias("_f"), F.col("_b"), "_taken")
    out = r.join(need, (r[folder] == need["_f"]) & (r[name] == need["_b"]), "left")
    free = F.expr("filter(sequence(2, cast(_n as int) + size(_taken)), x -> not array_contains(_taken, x))[cast(_n as int) - 2]")
    number = F.when(F.col("_taken").isNull(), F.col("_n")).otherwise(free)
    target = F.when(F.col("_n") == 1, F.col(name)).otherwise(F.concat(stem, F.lit(" ("), number.cast("string"), F.lit(")"), ext))
    return out.withColumn("target", target).drop("_n", "_f", "_b", "_taken")


def sibling_names(rows: DataFrame, folder: str, name: str, id_: str) -> DataFrame:
    """Add ``target``: from the second of equal names in a folder on, ' [last six characters of the id]' before the extension."""
    w = Window.partitionBy(folder, name).orderBy(id_)
    stem, ext = F.regexp_extract(name, r"^(.+?)(\.[^.]*)?$", 1), F.regexp_extract(name, r"^(.+?)(\.[^.]*)?$", 2)
    other = F.concat(stem, F.lit(" ["), F.expr(f"right(cast({id_} as string), 6)"), F.lit("]"), ext)
    return rows.withColumn("target", F.when(F.row_number().over(w) == 1, F.col(name)).otherwise(other))
