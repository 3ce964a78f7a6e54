"""Listings and side files as DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shoebox.functions.names import SCANNED_EXTENSIONS, extension

LEDGER = "md5 string, path string, size bigint, _corrupt string"
SKIPPED = "drive_path string, md5 string, kept_copy string, size bigint, _corrupt string"
# Media types by extension.
MIME = {".jpg": "image/jpeg", ".jpeg": "image/jpeg", ".png": "image/png", ".gif": "image/gif", ".webp": "image/webp", ".heic": "image/heic", ".heif": "image/heif", ".bmp": "image/bmp", ".tiff": "image/tiff", ".mp4": "video/mp4", ".mov": "video/quicktime", ".m4v": "video/x-m4v", ".avi": "video/x-msvideo", ".mkv": "video/x-matroska", ".webm": "video/webm", ".3gp": "video/3gpp"}

DRIVE = """files array<struct<id:string,name:string,mimeType:string,size:string,md5Checksum:string,createdTime:string,modifiedTime:string,trashed:boolean,
  imageMediaMetadata:struct<time:string,cameraMake:string,cameraModel:string,width:int,height:int,location:struct<latitude:double,longitude:double>>,
  videoMediaMetadata:struct<width:int,height:int,durationMillis:string>>>, nextPageToken string"""


def local_media(spark: SparkSession, root: str) -> DataFrame:
    """Media files below a folder: source_id, name, path below the root, mime, size, md5 (null), modified_time; no content is read."""
    base = root.rstrip("/")
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(base).select("path", "length", "modificationTime")
    full = F.regexp_replace(F.url_decode(F.regexp_replace("path", r"\+", "%2B")), "^file:/+", "/")
    mimes = F.create_map(*[F.lit(x) for kv in MIME.items() for x in kv])
    out = found.select(full.alias("source_id"), F.element_at(F.split(full, "/"), -1).alias("name"), F.col("length").alias("size"), "modificationTime")
    ext = extension(F.col("name"))
    return out.where(ext.isin(SCANNED_EXTENSIONS)).select(
        "source_id", "name", F.substring(F.col("source_id"), F.lit(len(base) + 2), F.lit(1 << 20)).alias("path"), F.coalesce(F.try_element_at(mimes, ext), F.lit("application/octet-stream")).alias("mime"),
        "size", F.lit(None).cast("string").alias("md5"), F.date_format("modificationTime", "yyyy-MM-dd'T'HH:mm:ss").alias("modified_time"),
    ).orderBy("source_id")


def drive_listing(pages: DataFrame) -> DataFrame:
    """Media of drive listing pages (value: JSON text of a page), flattened; only live images and videos."""
    f = pages.select(F.explode(F.from_json("value", DRIVE)["files"]).alias("f")).select("f.*")
    f = f.where((F.contains("mimeType", F.lit("image/")) | F.contains("mimeType", F.lit("video/"))) & ~F.coalesce("trashed", F.lit(False)))
    img, vid = "imageMediaMetadata", "videoMediaMetadata"
    camera = F.concat_ws(" ", F.nullif(F.col(f"{img}.cameraMake"), F.lit("")), F.nullif(F.col(f"{img}.cameraModel"), F.lit("")))
    return f.select(
        F.col("id").alias("source_id"), "name", F.col("name").alias("path"), F.col("mimeType").alias("mime"), F.coalesce(F.try_to_number("size", F.lit("9" * 18)).cast("bigint"), F.lit(0)).alias("size"), F.col("md5Checksum").alias("md5"),
        F.col("createdTime").alias("created_time"), F.col("modifiedTime").alias("modified_time"), F.col(f"{img}.time").alias("taken_time"), F.nullif(camera, F.lit("")).alias("camera"),
        F.col(f"{img}.location.latitude").alias("gps_lat"), F.col(f"{img}.location.longitude").alias("gps_lon"), F.coalesce(f"{img}.width", f"{vid}.width").alias("width"), F.coalesce(f"{img}.height", f"{vid}.height").alias("height"),
        (F.col(f"{vid}.durationMillis").cast("double") / 1000).alias("duration"),
    )


def ledger(spark: SparkSession, path: str) -> DataFrame:
    """(md5, path, size) of a JSON-lines ledger: broken lines and lines without md5 are skipped, the last line of an md5 wins."""
    rows = spark.read.schema(LEDGER).option("columnNameOfCorruptRecord", "_corrupt").json(path).select("*", F.col("_metadata.file_path").alias("_f"), F.monotonically_increasing_id().alias("_n"))
    rows = rows.where("_corrupt is null and md5 is not null and md5 <> ''")
    return rows.groupBy("md5").agg(F.max_by(F.struct("path", "size"), F.struct("_f", "_n")).alias("r")).select("md5", "r.path", "r.size")


def skipped_report(spark: SparkSession, path: str) -> DataFrame:
    """(drive_path, md5, kept_copy, size) of a JSON-lines report; broken lines are skipped."""
    rows = spark.read.schema(SKIPPED).option("columnNameOfCorruptRecord", "_corrupt").json(path)
    return rows.where("_corrupt is null").drop("_corrupt")


def sidecar_years(media: DataFrame, sidecars: DataFrame) -> DataFrame:
    """(path, year): UTC year of the capture, else creation, second in the sidecar 'name*.json' of the same folder.

    ``media`` has path, ``sidecars`` path and value (JSON text). Of several sidecars 'name.json' comes first, then by
    path; those without a positive second or of broken JSON are passed over.
    """
    split = lambda d, p: d.select("*", F.regexp_extract(p, r"^(.*/)?([^/]*)$", 1).alias("_dir"), F.regexp_extract(p, r"^(.*/)?([^/]*)$", 2).alias("_name"))
    second = lambda k: F.expr(f"try_cast(get_json_object(value, '$.{k}.timestamp') as bigint)")
    at = F.coalesce(F.when(second("photoTakenTime") > 0, second("photoTakenTime")), F.when(second("creationTime") > 0, second("creationTime")))
    s = split(sidecars.where(F.col("path").endswith(".json")), "path").select("_dir", F.col("_name").alias("_side"), at.alias("at")).where("at is not null")
    # The media name is the sidecar's name up to one of its dots: an equi-join on each of these beginnings.
    dots = F.filter(F.transform(F.sequence(F.lit(1), F.length("_side")), lambda i: F.substring(F.col("_side"), F.lit(1), i - 1)), lambda p: (p != "") & F.col("_side").startswith(p) & (F.substring(F.col("_side"), F.length(p) + 1, F.lit(1)) != ""))
    s = s.select("_dir", "_side", "at", F.explode(dots).alias("_name"))
    m = split(media, "path").select(F.col("path").alias("_path"), "_dir", "_name")
    met = m.join(s, ["_dir", "_name"]).withColumn("_exact", F.col("_side") != F.concat("_name", F.lit(".json")))
    return met.groupBy(F.col("_path").alias("path")).agg(F.min_by(F.year(F.timestamp_seconds("at")), F.struct("_exact", "_side")).alias("year"))
