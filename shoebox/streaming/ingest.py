"""Streams of listings and events."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from shoebox.operators.changes import upsert_index


def listing_stream(spark: SparkSession, folder: str, schema) -> DataFrame:
    """Listing batches as Parquet files that arrive in a folder."""
    return spark.readStream.schema(schema).parquet(folder)


def index_stream(batches: DataFrame, table: str, key: list[str], refreshed: list[str], kept: list[str], checkpoint: str) -> StreamingQuery:
    """Merge each batch into versions of an index below ``table``; a batch that is replayed gives the same version."""
    spark = batches.sparkSession

    def merge(batch: DataFrame, number: int) -> None:
        before = f"{table}/v{number}"
        merged = upsert_index(spark.read.parquet(before), batch, key, refreshed, kept)
        merged.write.mode("overwrite").parquet(f"{table}/v{number + 1}")

    return batches.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def first_copies(items: DataFrame, time: str = "listed_at", late: str = "30 days") -> DataFrame:
    """Rows of a stream whose md5 was not seen within the watermark."""
    return items.where("md5 is not null").withWatermark(time, late).dropDuplicatesWithinWatermark(["md5"])


def windowed_counts(events: DataFrame, length: str = "1 hour", late: str = "2 hours", time: str = "ts", kind: str = "event_type") -> DataFrame:
    """(start, kind, n, total) in tumbling windows; works on a stream, with late rows dropped after the watermark, and on a table."""
    e = events.withColumn(time, F.col(time).cast("timestamp"))
    e = e.withWatermark(time, late) if events.isStreaming else e
    out = e.groupBy(F.window(time, length).alias("w"), kind).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("w.start").cast("timestamp_ntz").alias("start"), kind, "n", F.round("total", 6).alias("total"))


def session_counts(events: DataFrame, gap: str = "30 minutes", late: str = "2 hours", time: str = "ts", key: str = "user_id") -> DataFrame:
    """(key, start, end, n) of sessions that a gap separates."""
    e = events.withColumn(time, F.col(time).cast("timestamp"))
    e = e.withWatermark(time, late) if events.isStreaming else e
    out = e.groupBy(F.session_window(time, gap).alias("w"), key).agg(F.count("*").alias("n"))
    return out.select(key, F.col("w.start").cast("timestamp_ntz").alias("start"), F.col("w.end").cast("timestamp_ntz").alias("end"), "n")


def progress_listener(report: Callable[[str, int], None]):
    """A listener that reports (query id, rows) of every finished batch."""
    from pyspark.sql.streaming import StreamingQueryListener

    class Progress(StreamingQueryListener):
        def onQueryStarted(self, event) -> None: ...

        def onQueryProgress(self, event) -> None:
            report(str(event.progress.id), event.progress.numInputRows)

        def onQueryTerminated(self, event) -> None: ...

    return Progress()
