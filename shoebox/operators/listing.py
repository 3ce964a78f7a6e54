"""Faceted listings, lookups and pages."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shoebox.functions.media import heuristic_labels
from shoebox.functions.names import contains_text, in_folder

MOST_PER_PAGE = 200
# Labels of the metadata heuristics are file labels of this method.
HEURISTIC = "heuristic"


def labels_of(files: DataFrame) -> DataFrame:
    """(file_id, label, score, method): labels guessed from name, size and type."""
    found = heuristic_labels(F.col("name"), F.col("width"), F.col("height"), F.col("mime"), F.col("camera").isNotNull())
    return files.select(F.col("id").alias("file_id"), F.explode(found).alias("l")).select("file_id", "l.label", "l.score", F.lit(HEURISTIC).alias("method"))


def file_filter(kind: str | None = None, status: str | None = None) -> Column:
    """Conjunction of the conditions asked for; without a status everything but trashed rows."""
    parts = [F.col("kind") == kind] if kind else []
    parts.append(F.col("status") == status if status else F.col("status") != "trashed")
    return reduce(lambda a, b: a & b, parts)


def browse(files: DataFrame, labels: DataFrame | None = None, kind: str | None = None, status: str | None = None, label: str | None = None) -> DataFrame:
    """Files by kind, status and label; a file with the label comes out once."""
    out = files.where(file_filter(kind, status))
    if label:
        out = out.join(labels.where(F.col("label") == label).select(F.col("file_id").alias("id")), "id", "left_semi")
    return out


def page(rows: DataFrame, order: list[Column], number: int = 0, size: int = 60) -> DataFrame:
    """One page of an ordered listing."""
    if not 0 < size <= MOST_PER_PAGE or number < 0:
        raise ValueError(f"a page has 1 to {MOST_PER_PAGE} rows")
    return rows.orderBy(*order).offset(number * size).limit(size)


def newest_first() -> list[Column]:
    """By the text of taken_time, else created_time, missing ones last, then by id."""
    return [F.coalesce("taken_time", "created_time").desc_nulls_last(), F.col("id").asc()]


def lookup(rows: DataFrame, key: str, value) -> DataFrame:
    """The row with a key."""
    return rows.where(F.col(key) == F.lit(value))


def required(rows: DataFrame, what: str) -> DataFrame:
    """The same rows; an error where there are none."""
    if rows.isEmpty():
        raise KeyError(f"no such {what}")
    return rows


def keyword_search(files: DataFrame, labels: DataFrame, text: str) -> DataFrame:
    """Live files with the text in their name, in their summary (where the files have one) or in one of their labels."""
    labelled = labels.where(contains_text(F.col("label"), text)).select(F.col("file_id").alias("id"), F.lit(True).alias("_hit")).distinct()
    said = contains_text(F.concat_ws("\n", *[c for c in ("name", "summary") if c in files.columns]), text)
    return files.where("status <> 'trashed'").join(labelled, "id", "left").where(F.coalesce(said, F.lit(False)) | F.col("_hit")).drop("_hit")


def folder_files(files: DataFrame, folder: str) -> DataFrame:
    """Live files below a folder."""
    return files.where(in_folder(F.col("path"), folder) & (F.col("status") != "trashed"))


def year_text(files: DataFrame) -> Column:
    return F.substring(F.coalesce("taken_time", "created_time"), 1, 4)


def with_persons(files: DataFrame, faces: DataFrame, persons: list[int]) -> DataFrame:
    """Files with a face of any of the persons; no person asked for, no file."""
    return files.join(faces.where(F.col("person_id").isin(persons)).select(F.col("file_id").alias("id")), "id", "left_semi")


def without_faces(files: DataFrame, faces: DataFrame) -> DataFrame:
    return files.join(faces.select(F.col("file_id").alias("id")), "id", "left_anti")


def live_members(groups: DataFrame, files: DataFrame, least: int = 2) -> DataFrame:
    """Members whose file is live, in groups that keep at least ``least`` of them."""
    alive = groups.join(files.where("status <> 'trashed'").select(F.col("id").alias("file_id"), "name"), "file_id").distinct()
    sizes = alive.groupBy("group_id").agg(F.count_distinct("file_id").alias("n")).where(F.col("n") >= least).select("group_id")
    return alive.join(sizes, "group_id", "left_semi")


def hydrate(hits: DataFrame, files: DataFrame, columns: list[str]) -> DataFrame:
    """Columns of the files for hits (file_id, rank_no, score), in one join."""
    return hits.join(files.select(F.col("id").alias("file_id"), *columns), "file_id")


def tall(rows: DataFrame, limit: int, by: list[Column]) -> DataFrame:
    """The first ``limit`` rows in an order."""
    return rows.orderBy(*by).limit(limit)
