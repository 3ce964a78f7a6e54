"""Sampled frames of videos."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shoebox.functions.hashes import phash64
from shoebox.functions.media import frame_times
from shoebox.functions.vectors import unit


def frame_hashes(frames: DataFrame) -> DataFrame:
    """(file_id, t, id, h): readable hashes in the order of t within each file."""
    f = frames.select("file_id", "t", "id", phash64(F.col("phash")).alias("h")).where("h is not null and t is not null")
    return f.repartitionByRange("file_id", "t", "id").sortWithinPartitions("file_id", "t", "id")


def sampled_times(files: DataFrame, most: int = 300) -> DataFrame:
    """(file_id, n, t) of the frames to sample from each video with a duration."""
    return files.where("kind = 'video'").select(F.col("id").alias("file_id"), F.posexplode(frame_times(F.col("duration"), most)).alias("n", "t"))


def scene_changes(frames: DataFrame, jump: int = 10) -> DataFrame:
    """(file_id, t, id): frames more than ``jump`` bits from the last kept frame of their file.

    The comparison is with the last frame kept, not with the one before, so it is a fold in order of t: files are dealt to
    tasks, sorted, and streamed with one remembered frame; no file is gathered.
    """

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        file, last = None, 0
        for batch in batches:
            keep = np.zeros(len(batch), bool)
            for k, (f, h) in enumerate(zip(batch["file_id"].to_numpy(), batch["h"].to_numpy())):
                if f != file or (int(h ^ last) & 0xFFFFFFFFFFFFFFFF).bit_count() > jump:
                    keep[k], file, last = True, f, h
            yield batch[keep][["file_id", "t", "id"]]

    f = frames.select("file_id", "t", "id", phash64(F.col("phash")).alias("h")).where("h is not null and t is not null and file_id is not null")
    return f.repartition("file_id").sortWithinPartitions("file_id", "t", "id").mapInPandas(fold, "file_id long, t double, id long")


def sharpest(frames: DataFrame, k: int = 20) -> DataFrame:
    """(file_id, id, rank_no): the k sharpest frames of each file; equal sharpness goes by the smaller id.

    Salted before the final ranking, so that a file of any number of frames is ranked in bounded pieces.
    """
    f = frames.where("sharpness is not null and file_id is not null").withColumn("s", F.pmod(F.xxhash64("id"), F.lit(32)))
    order = [F.desc("sharpness"), F.asc("id")]
    few = f.withColumn("r", F.row_number().over(Window.partitionBy("file_id", "s").orderBy(*order))).where(F.col("r") <= k)
    out = few.withColumn("rank_no", F.row_number().over(Window.partitionBy("file_id").orderBy(*order)).cast("bigint"))
    return out.where(F.col("rank_no") <= k).select("file_id", "id", "rank_no")


def mean_vectors(rows: DataFrame, key: str, dim: int, vec: str = "vec") -> DataFrame:
    """(key, vec): mean of the vectors of each key at length one."""
    means = rows.where(F.size(vec) == dim).groupBy(key).agg(*[F.avg(F.get(vec, F.lit(i)).cast("double")).alias(f"_{i}") for i in range(dim)])
    return means.select(key, unit(F.array(*[F.col(f"_{i}") for i in range(dim)])).alias(vec)).where(F.col(vec).isNotNull())


def best_labels(scores: DataFrame, k: int = 3) -> DataFrame:
    """(file_id, label, score, rank_no): greatest score of each label, the k best labels of each file."""
    top = scores.groupBy("file_id", "label").agg(F.max("score").alias("score"))
    w = Window.partitionBy("file_id").orderBy(F.desc("score"), "label")
    return top.withColumn("rank_no", F.row_number().over(w).cast("bigint")).where(F.col("rank_no") <= k)


def video_summaries(files: DataFrame, frames: DataFrame, faces: DataFrame) -> DataFrame:
    """(file_id, summary): duration, sampled frames, distinct scenes and face detections of every video in words."""
    n = frames.groupBy("file_id").agg(F.count("*").alias("n"), F.coalesce(F.sum("is_representative"), F.lit(0)).alias("scenes"))
    seen = faces.groupBy("file_id").agg(F.count("*").alias("faces"))
    v = files.where("kind = 'video'").select(F.col("id").alias("file_id"), "duration").join(n, "file_id", "left").join(seen, "file_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    parts = F.array_compact(F.array(
        F.format_string("%ds video", F.coalesce(F.bround("duration", 0), F.lit(0.0)).cast("bigint")), F.format_string("%d frames sampled across full duration", zero("n")), F.format_string("%d distinct scenes", zero("scenes")),
        F.when(F.col("faces") > 0, F.format_string("%d face detections", "faces")),
    ))
    return v.select("file_id", F.concat(F.concat_ws("; ", parts), F.lit(".")).alias("summary"))
