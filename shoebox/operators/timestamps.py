"""Mixed timestamp formats and time zones, normalised to one UTC instant.

Raw strings are first reduced to a dictionary of distinct (text, zone, date order); only entries that an
earlier run has not parsed are parsed, by built-in expressions, and appended; the instants are joined back.
"""

from __future__ import annotations

from zoneinfo import available_timezones

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shoebox.scratch import scratch_path

# Zone abbreviations as minutes east of UTC.
ABBREVIATIONS = {
    "Z": 0, "UTC": 0, "GMT": 0, "UT": 0, "WET": 0, "WEST": 60, "BST": 60, "CET": 60, "CEST": 120, "MEZ": 60, "MESZ": 120,
    "EET": 120, "EEST": 180, "MSK": 180, "IST": 330, "NPT": 345, "JST": 540, "KST": 540, "AWST": 480, "ACST": 570, "ACDT": 630,
    "AEST": 600, "AEDT": 660, "NZST": 720, "NZDT": 780, "EST": -300, "EDT": -240, "CST": -360, "CDT": -300, "MST": -420,
    "MDT": -360, "PST": -480, "PDT": -420, "AKST": -540, "AKDT": -480, "HST": -600,
}
# The first three letters of English month names.
MONTHS = ["JAN", "FEB", "MAR", "APR", "MAY", "JUN", "JUL", "AUG", "SEP", "OCT", "NOV", "DEC"]

KEY = ["raw", "zone", "date_order"]
SCHEMA = "raw string, zone string, date_order string, utc_us bigint"


def _clean(raw: Column) -> Column:
    """Upper case, invisible characters gone, every run of white space one blank."""
    seen = F.regexp_replace(raw, r"[\p{Cf}\x00-\x08\x0e-\x1f]", "")
    return F.upper(F.trim(F.regexp_replace(seen, r"[\s\p{Z}\u0085]+", " ")))


def _canonical(s: Column, date_order: Column) -> Column:
    """Text with a date in any known order as 'Y-M-D rest', else null."""
    rest = r"(\d{1,2}:.*)$"
    month = F.array_position(F.array(*[F.lit(m) for m in MONTHS]), F.regexp_extract(s, r"([A-Z]{3})[A-Z]*\.? ?(?:\d{1,2},? )?\d{4}", 1))
    named = r"^([A-Z]{3})[A-Z]*\.? (\d{1,2}),? (\d{4}),? (?:AT )?" + rest
    mail = r"^(?:[A-Z]{2,9}\.?,? )?(\d{1,2})[ -]([A-Z]{3})[A-Z]*\.?[ -](\d{4}),? " + rest
    mail_month = F.array_position(F.array(*[F.lit(m) for m in MONTHS]), F.regexp_extract(s, mail, 2))
    joined = lambda y, m, d, r: F.concat(y, F.lit("-"), m, F.lit("-"), d, F.lit(" "), r)
    g = lambda p, i: F.regexp_extract(s, p, i)
    year_first = r"^(\d{4})[-:/.](\d{1,2})[-:/.](\d{1,2})[T _]+" + rest
    packed = r"^(\d{4})(\d{2})(\d{2})[T _-]?(\d{2})(\d{2})(\d{2})?((?:[.,]\d+)?(?: ?[A-Z+-].*)?)$"
    slashed = r"^(\d{1,2})/(\d{1,2})/(\d{4}),?[T ]+" + rest
    dotted = r"^(\d{1,2})\.(\d{1,2})\.(\d{4}),?[T ]+" + rest
    american = F.lower(date_order) == "mdy"
    return (
        F.when(s.rlike(year_first), joined(g(year_first, 1), g(year_first, 2), g(year_first, 3), g(year_first, 4)))
        .when(
            s.rlike(packed),
            joined(g(packed, 1), g(packed, 2), g(packed, 3), F.concat(g(packed, 4), F.lit(":"), g(packed, 5), F.when(g(packed, 6) != "", F.concat(F.lit(":"), g(packed, 6))).otherwise(""), g(packed, 7))),
        )
        .when(s.rlike(slashed) & american, joined(g(slashed, 3), g(slashed, 1), g(slashed, 2), g(slashed, 4)))
        .when(s.rlike(slashed), joined(g(slashed, 3), g(slashed, 2), g(slashed, 1), g(slashed, 4)))
        .when(s.rlike(dotted), joined(g(dotted, 3), g(dotted, 2), g(dotted, 1), g(dotted, 4)))
        .when(s.rlike(named) & (month > 0), joined(g(named, 3), month.cast("string"), g(named, 2), g(named, 4)))
        .when(s.rlike(mail) & (mail_month > 0), joined(g(mail, 3), mail_month.cast("string"), g(mail, 1), g(mail, 4)))
    )


def parse_instant(df: DataFrame) -> DataFrame:
    """Add ``utc_us`` to rows of (raw, zone, date_order).

    Microseconds since 1970-01-01 UTC to the precision of the text, missing parts zero; null where the text
    is no real date with a time of day. Plain digits of 10, 13 or 16 places count s, ms or us. A zone or
    offset in the text wins over ``zone``; a null or unknown ``zone`` is UTC. A local time that occurs twice is
    the earlier instant, a skipped one is read with the offset before the jump. Dates with slashes follow
    ``date_order`` (day first unless mdy), dates with dots are day first.
    """
    tail = (
        r"^(\d{4})-(\d{1,2})-(\d{1,2}) (\d{1,2}):(\d{2})(?::(\d{2})(?:[.,](\d{1,9}))?)?"
        r" ?([AP]\.?M\.?(?![A-Z]))?(?: ?(?:(Z|UTC|GMT)?([+-])(\d{2}):?(\d{2})?|([A-Z]{1,5})|([A-Z_]+/[A-Z_/+-]+[0-9]{0,2})))?(?: ?\[([A-Z_/+-]+[0-9]{0,2})\])?$"
    )
    zones = sorted(available_timezones())
    known = F.create_map(*[F.lit(x) for z in zones for x in (z.upper(), z)])
    abbreviations = F.create_map(*[F.lit(x) for k, v in ABBREVIATIONS.items() for x in (k, v)])
    d = df.withColumn("_s", _clean(F.col("raw")))
    d = d.withColumn("_c", _canonical(F.col("_s"), F.col("date_order")))
    fields = ["y", "mo", "d", "h", "mi", "s", "f", "ap", "_z", "sign", "oh", "om", "abbr", "region", "bracket"]
    d = d.withColumn("_p", F.when(F.col("_c").rlike(tail), F.struct(*[F.regexp_extract("_c", tail, i + 1).alias(n) for i, n in enumerate(fields)])))
    p = lambda n: F.col("_p." + n)
    num = lambda n: F.when(p(n) != "", p(n)).cast("int")
    hour = F.when(p("ap") == "", num("h")).when(num("h").between(1, 12), num("h") % 12 + F.when(p("ap").startswith("P"), 12).otherwise(0))
    micros = F.rpad(F.substring(p("f"), 1, 6), 6, "0").cast("bigint")
    offset = F.when(p("sign") != "", F.when(p("sign") == "-", -1).otherwise(1) * (num("oh") * 60 + F.coalesce(num("om"), F.lit(0))))
    offset = F.when(offset.isNotNull(), offset).when(p("abbr") != "", F.try_element_at(abbreviations, p("abbr")))
    region = F.when(p("region") != "", p("region")).when(p("bracket") != "", p("bracket"))
    named = F.try_element_at(known, region)
    local = F.coalesce(F.try_element_at(known, F.upper("zone")), F.lit("UTC"))
    zone = F.when(offset.isNotNull(), F.lit("UTC")).when(region.isNotNull(), named).when(p("abbr") != "", F.lit(None)).otherwise(local)
    seconds = F.coalesce(num("s"), F.lit(0))
    at = F.expr("try_make_timestamp(_y, _mo, _d, _h, _mi, cast(_sec as decimal(8,6)), _zone)")
    d = d.withColumns({"_zone": zone, "_off": F.coalesce(offset, F.lit(0)), "_y": num("y"), "_mo": num("mo"), "_d": num("d"), "_h": hour, "_mi": num("mi"), "_sec": F.when(seconds < 60, seconds), "_us": F.coalesce(F.when(p("f") != "", micros), F.lit(0))})
    sane = (F.col("_off").between(-18 * 60, 18 * 60)) & (F.coalesce(num("om"), F.lit(0)) < 60)
    spelled = F.when(F.col("_zone").isNotNull() & sane, F.unix_micros(at) + F.col("_us") - F.col("_off").cast("bigint") * 60_000_000)
    digits = F.when(F.col("_s").rlike(r"^(?:\d{10}|\d{13}|\d{16})$"), F.col("_s").cast("bigint") * F.when(F.length("_s") == 10, 1_000_000).when(F.length("_s") == 13, 1_000).otherwise(1))
    return d.withColumn("utc_us", F.coalesce(digits, spelled)).select(*df.columns, "utc_us")


def extend_dictionary(spark: SparkSession, path: str, wanted: DataFrame) -> DataFrame:
    """Parse those distinct (raw, zone, date_order) that the dictionary at ``path`` lacks, append them, return all.

    Every distinct text is parsed once over the life of the dictionary. Each call adds one Parquet batch, so
    a failed write leaves the earlier batches whole.
    """
    distinct = wanted.select(*KEY).where("raw is not null").distinct()
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    if at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        have = spark.read.schema(SCHEMA).parquet(path)
        match = [distinct[k].eqNullSafe(have[k]) for k in KEY]
        distinct = distinct.join(have, match, "left_anti")
    parse_instant(distinct).write.mode("append").parquet(path)
    return spark.read.schema(SCHEMA).parquet(path)


def normalise_times(files: DataFrame, origins: DataFrame, fields: tuple[str, ...] = ("taken_time", "created_time", "modified_time"), dictionary: str | None = None) -> DataFrame:
    """(file_id, field, utc_us): one row per value of ``fields`` that is a real date with a time of day.

    ``files`` needs id, origin_id and the fields, ``origins`` origin_id, tz, date_order; other columns are
    ignored. Null, blank and unreadable values give no row; a null or unknown origin means UTC, day first. Repeated
    ids give one row each. ``dictionary`` is the folder of a dictionary kept between runs; by default it
    lasts as long as the session.
    """
    spark = files.sparkSession
    o = origins.where("origin_id is not null").groupBy("origin_id").agg(F.min_by("tz", F.coalesce("tz", F.lit(""))).alias("zone"), F.min("date_order").alias("date_order"))
    values = (
        files.select("id", F.col("origin_id").alias("origin_id"), F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("raw")) for f in fields])).alias("v"))
        .select(F.col("id").alias("file_id"), "origin_id", "v.field", "v.raw")
        .where(F.col("raw").rlike("[0-9]"))
        .join(o, "origin_id", "left")
        .withColumns({"zone": F.coalesce("zone", F.lit("UTC")), "date_order": F.coalesce("date_order", F.lit("dmy"))})
    )
    # An explicit zone or a bare count does not depend on the origin: one dictionary entry serves all origins.
    absolute = F.trim("raw").rlike(r"^\d+$") | F.col("raw").rlike(r"(?i)\d(z|[+-]\d{2}:?\d{2}(\[.*\])?)\s*$") & ~F.col("raw").contains("/")
    values = values.withColumns({"zone": F.when(absolute, "UTC").otherwise(F.col("zone")), "date_order": F.when(F.col("raw").contains("/"), F.col("date_order")).otherwise("dmy")})
    known = extend_dictionary(spark, dictionary or scratch_path(spark, "times"), values)
    return values.join(known.where("utc_us is not null"), KEY).select("file_id", "field", "utc_us")
