"""Structured Streaming front-end: files or rows that arrive, taken in batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docmill.operators.history import upsert


def drain(stream: DataFrame, checkpoint: str, each) -> None:
    """Run each(batch, number) over everything that waits, then stop."""
    q = stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(each).start()
    q.awaitTermination()


def upsert_stream(spark: SparkSession, source: str, schema, target: str, checkpoint: str, files_each: int = 1) -> DataFrame:
    """Rows of Parquet files that arrive in a folder, upserted into snapshots below target; the last snapshot.
    Every batch writes a new one, so a batch that is run again after a failure gives the same table."""

    def take(batch: DataFrame, number: int) -> None:
        before = f"{target}/snapshot={number - 1}"
        old = spark.read.parquet(before) if number > 0 else batch.limit(0)
        upsert(old, batch).write.mode("overwrite").parquet(f"{target}/snapshot={number}")

    drain(spark.readStream.schema(schema).option("maxFilesPerTrigger", files_each).parquet(source), checkpoint, take)
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(target)
    fs = hadoop.getFileSystem(spark._jsc.hadoopConfiguration())
    last = max(int(s.getPath().getName().split("=")[1]) for s in fs.listStatus(hadoop) if "=" in s.getPath().getName())
    return spark.read.parquet(f"{target}/snapshot={last}")


def sessions(events: DataFrame, time: str, gap: str, late: str, *by: str) -> DataFrame:
    """Sessions that end after a gap without events; works on streams (with a watermark) and on tables."""
    base = events.withWatermark(time, late) if events.isStreaming else events
    return base.groupBy(F.session_window(time, gap).alias("w"), *by).agg(F.count("*").alias("n")).select(*by, F.col("w.start").alias("session_start"), "n")


def windowed(events: DataFrame, time: str, width: str, late: str, *by: str, slide: str | None = None) -> DataFrame:
    """Counts and sums of value in tumbling or sliding windows; works on streams (with a watermark) and on tables."""
    w = F.window(time, width, slide) if slide else F.window(time, width)
    base = events.withWatermark(time, late) if events.isStreaming else events
    return base.groupBy(w.alias("w"), *by).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("w.start").alias("window_start"), *by, "n", "total")


def first_of_each(events: DataFrame, keys: list[str], time: str, late: str) -> DataFrame:
    """Each key once, within the watermark on streams."""
    return events.withWatermark(time, late).dropDuplicatesWithinWatermark(keys) if events.isStreaming else events.dropDuplicates(keys)
