"""Counts and rollups over the catalogue."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoebox.functions.hashes import checksum
from shoebox.functions.names import category_of, top_folder


def overview(files: DataFrame) -> DataFrame:
    """One row of totals."""
    n = lambda c, name: F.count_if(c).alias(name)
    kind, status = F.col("kind"), F.col("status")
    return files.agg(F.count("*").alias("total"), n(kind == "photo", "photos"), n(kind == "video", "videos"), n(status == "analyzed", "analyzed"), n(status == "error", "errors"), n(status == "trashed", "trashed"))


def people(faces: DataFrame, persons: DataFrame) -> DataFrame:
    """Faces and files of every person, also of those without any."""
    stats = faces.where("person_id is not null").groupBy("person_id").agg(F.count("*").alias("n_faces"), F.count_distinct("file_id").alias("n_files"), F.min("id").alias("sample_face_id"))
    out = persons.withColumnRenamed("id", "person_id").join(stats, "person_id", "left")
    return out.select("person_id", "name", F.coalesce("n_faces", F.lit(0)).alias("n_faces"), F.coalesce("n_files", F.lit(0)).alias("n_files"), "sample_face_id")


def unnamed_clusters(faces: DataFrame) -> DataFrame:
    """Clusters of nameless faces with a sample face and its file."""
    f = faces.where("person_id is null and cluster_id is not null")
    return f.groupBy("cluster_id").agg(F.count("*").alias("n_faces"), F.count_distinct("file_id").alias("n_files"), F.min("id").alias("sample_face_id"), F.min_by("file_id", "id").alias("sample_file_id"))


def loners(faces: DataFrame) -> DataFrame:
    return faces.where("person_id is null and cluster_id is null").agg(F.count("*").alias("n_faces"), F.count_distinct("file_id").alias("n_files"))


def folder_people(files: DataFrame, faces: DataFrame, persons: DataFrame) -> DataFrame:
    """Persons per top folder of live files."""
    f = files.where("status <> 'trashed'").select(F.col("id").alias("file_id"), top_folder(F.col("path")).alias("folder")).where("folder is not null")
    return (
        faces.where("person_id is not null").join(f, "file_id").groupBy("folder", "person_id")
        .agg(F.count("*").alias("n_faces"), F.count_distinct("file_id").alias("n_files"), F.min("id").alias("sample_face_id"))
        .join(persons.select(F.col("id").alias("person_id"), "name"), "person_id")
    )


def folder_rollup(files: DataFrame, faces: DataFrame) -> DataFrame:
    """Live files, and those with a face below the folder, per top folder; a file at the root is its own folder."""
    f = files.where("status <> 'trashed' and path is not null").select("id", "path", top_folder(F.col("path")).alias("folder")).where("folder is not null")
    seen = faces.select(F.col("file_id").alias("id"), F.lit(1).alias("seen")).distinct()
    below = F.col("path").contains("/") & F.col("seen").isNotNull()
    return f.join(seen, "id", "left").groupBy("folder").agg(F.count("*").alias("files"), F.count_if(below).alias("files_with_faces"))


def folder_size(items: DataFrame) -> DataFrame:
    """Totals of a listing (id, name, size, md5): bytes, first copies, repeats, categories; a row without md5 is a first copy."""
    key = checksum(F.col("md5"), "md5")
    size = F.coalesce("size", F.lit(0))
    n = lambda c, name: F.count_if(F.col("category") == c).alias(name)
    rows = items.select("id", size.alias("size"), key.alias("key"), category_of(F.col("name")).alias("category"))
    firsts = rows.where("key is not null").groupBy("key").agg(F.min("id").alias("first"))
    rows = rows.join(firsts, "key", "left").withColumn("unique", F.col("first").isNull() | (F.col("first") == F.col("id")))
    return rows.agg(
        F.count("*").alias("files"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"), F.count_if("unique").alias("uniq_files"),
        F.coalesce(F.sum(F.when(F.col("unique"), F.col("size"))), F.lit(0)).alias("uniq_bytes"), F.coalesce(F.sum(F.when(~F.col("unique"), F.col("size"))), F.lit(0)).alias("dup_bytes"),
        n("photos", "photos"), n("videos", "videos"), n("audio", "audio"), n("other", "other"),
    )


def latest_per_group(rows: DataFrame, group: str, order: str, columns: list[str]) -> DataFrame:
    """The row of the greatest ``order`` in each group."""
    return rows.groupBy(group).agg(F.max(order).alias(order), *[F.max_by(c, order).alias(c) for c in columns])


def trashed_register(files: DataFrame, actions: DataFrame, reasons: DataFrame) -> DataFrame:
    """Trashed files with their latest action that was not undone and its reason ('manual' without one).

    ``actions`` has id, rec_id, file_id, executed_at, undone_at; ``reasons`` rec_id, reason.
    """
    last = latest_per_group(actions.where("undone_at is null"), "file_id", "id", ["rec_id", "executed_at"]).drop("id")
    gone = files.where("status = 'trashed'").select(F.col("id").alias("file_id"), "size", "md5", "sha256")
    out = gone.join(last, "file_id", "left").join(reasons, "rec_id", "left")
    return out.select("file_id", "size", "md5", "sha256", "executed_at", F.coalesce("reason", F.lit("manual")).alias("reason"))


def register_summary(register: DataFrame) -> DataFrame:
    return register.groupBy("reason").agg(F.count("*").alias("n"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"), F.count_if(F.coalesce("md5", F.lit("")) != "").alias("with_md5"))


def year_counts(rows: DataFrame) -> DataFrame:
    """Files per (year, source) of a struct column ``resolved``."""
    return rows.groupBy("resolved.year", "resolved.source").agg(F.count("*").alias("n"))
