"""Repeated consecutive events in sequences: each run becomes one row with count and duration."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shoebox.functions.hashes import hamming, phash64
from shoebox.scratch import materialise

SLICE_ROWS = 500_000
BROADCAST_SEQUENCES = 10_000


def collapse_runs(frames: DataFrame, max_distance: int = 4, min_frames: int = 2, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """(file_id, first_frame_id, last_frame_id, n_frames, t_first, t_last, duration) of every run.

    Frames with null or NaN t, null file_id or no readable phash are dropped; of frames with the same file_id and t
    the smallest id stays. Each frame is compared with its predecessor by t in a lag window; a distance above
    ``max_distance`` sets a flag, the running sum of flags numbers the runs, and runs are aggregated. Runs shorter
    than ``min_frames`` are left out; an empty table gives no rows.

    A sequence of more than ``slice_rows`` frames is cut at quantiles of t into slices that are
    windowed apart; runs that touch a cut are joined again from their first and last frames, so the result does not
    depend on the cuts.
    """
    f = frames.select("file_id", "id", F.col("t").cast("double").alias("t"), phash64(F.col("phash")).alias("h"))
    f = f.where("file_id is not null and id is not null and t is not null and not isnan(t) and h is not null").withColumn("t", F.col("t") + F.lit(0.0))
    kept = materialise(f.groupBy("file_id", "t").agg(F.min_by("h", "id").alias("h"), F.min("id").alias("id")), "frames")
    sizes = kept.groupBy("file_id").agg(F.count("*").alias("n"))
    hot = materialise(sizes.where(F.col("n") > slice_rows), "hot")
    n_hot = hot.count()
    if n_hot:
        cuts = kept.join(F.broadcast(hot) if n_hot <= BROADCAST_SEQUENCES else hot, "file_id")
        parts = F.ceil(F.max("n") / slice_rows).cast("int")
        spread = F.percentile_approx("t", F.array(*[F.lit(i / 1024) for i in range(1, 1024)]), F.lit(20_000))
        # Up to 1024 quantiles; thinned to the number of slices the sequence needs.
        cuts = cuts.groupBy("file_id").agg(spread.alias("q"), parts.alias("parts"))
        step = F.greatest(F.lit(1), F.floor(F.lit(1024) / F.col("parts"))).cast("int")
        cuts = materialise(cuts.select("file_id", F.array_distinct(F.filter("q", lambda q, i: (i + 1) % step == 0)).alias("cuts")), "cuts")
        kept = kept.join(F.broadcast(cuts) if n_hot <= BROADCAST_SEQUENCES else cuts, "file_id", "left")
        kept = kept.withColumn("slice", F.coalesce(F.size(F.filter("cuts", lambda c: c <= F.col("t"))), F.lit(0))).drop("cuts")
    else:
        kept = kept.withColumn("slice", F.lit(0))
    w = Window.partitionBy("file_id", "slice").orderBy("t")
    flag = F.coalesce((hamming(F.col("h"), F.lag("h").over(w)) > max_distance).cast("int"), F.lit(0))
    runs = kept.withColumn("flag", flag).withColumn("run", F.sum("flag").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    ends = [("min", "first"), ("max", "last")]
    parts = [getattr(F, f"{m}_by")(c, "t").alias(f"{c}_{e}") for m, e in ends for c in ("id", "h")] + [getattr(F, m)("t").alias(f"t_{e}") for m, e in ends]
    runs = runs.groupBy("file_id", "slice", "run").agg(*parts, F.count("*").alias("n"))
    if n_hot:
        # Only the outer runs of a slice can go on across a cut: number those again, over a few rows a slice.
        s = Window.partitionBy("file_id", "slice")
        runs = runs.withColumn("outer", (F.col("run") == 0) | (F.col("run") == F.max("run").over(s)))
        runs = materialise(runs, "runs")
        o = Window.partitionBy("file_id").orderBy("slice", "run")
        edge = runs.where("outer")
        new = F.coalesce(((F.lag("slice").over(o) == F.col("slice")) | (hamming(F.col("h_first"), F.lag("h_last").over(o)) > max_distance)).cast("int"), F.lit(0))
        edge = edge.withColumn("new", new).withColumn("joined", F.sum("new").over(o.rowsBetween(Window.unboundedPreceding, 0)))
        edge = edge.groupBy("file_id", "joined").agg(
            F.min_by("id_first", "t_first").alias("id_first"), F.max_by("id_last", "t_last").alias("id_last"), F.min("t_first").alias("t_first"), F.max("t_last").alias("t_last"), F.sum("n").alias("n")
        )
        kept_columns = ["file_id", "id_first", "id_last", "t_first", "t_last", "n"]
        runs = runs.where("not outer").select(*kept_columns).unionByName(edge.select(*kept_columns))
    return runs.where(F.col("n") >= min_frames).select(
        "file_id", F.col("id_first").alias("first_frame_id"), F.col("id_last").alias("last_frame_id"), F.col("n").alias("n_frames"),
        "t_first", "t_last", (F.col("t_last") - F.col("t_first")).alias("duration"),
    )
