"""Event-time windows of a stream: tumbling and session windows in append mode, rows behind the watermark dropped and counted.

A window is written once, when the watermark (the latest event time seen by the batches before, less the
allowed lateness) has passed its end; windows that are still open when the input ends are not written, as
rows for them may yet come. A row is late if its window had been written before its batch. Rows without
an event time belong to no window.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass
class Drained:
    table: DataFrame
    batches: int
    late_rows: int


def _sums(stream: DataFrame, window: Callable[[Column], Column], key: str, value: str, ts: str, late: str) -> DataFrame:
    kind = stream.schema[ts].dataType
    # Watermarks take timestamps alone; times without a zone are read in the session's, and returned without one.
    timed = stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
    g = timed.groupBy(window(F.col(ts)).alias("w"), key).agg(F.sum(value).alias("total"), F.count(value).alias("n"), F.count("*").alias("rows"))
    return g.select(F.col("w.start").cast(kind).alias("start"), F.col("w.end").cast(kind).alias("end"), key, "total", "n", "rows")


def tumbling(stream: DataFrame, key: str, value: str, ts: str = "ts", width: str = "1 hour", late: str = "1 day") -> DataFrame:
    """Sums by key and window of ``width``."""
    return _sums(stream, lambda t: F.window(t, width), key, value, ts, late)


def sessions(stream: DataFrame, key: str, value: str, ts: str = "ts", gap: str = "30 minutes", late: str = "1 day") -> DataFrame:
    """Sums by key and session: rows of a key that follow one another within ``gap``; a session ends ``gap`` after its last row."""
    return _sums(stream, lambda t: F.session_window(t, gap), key, value, ts, late)


def read_stream(spark: SparkSession, path: str, schema, files_per_batch: int | None = None) -> DataFrame:
    """A stream of the Parquet files at ``path``, a folder or a single file; the files are read where they are."""
    head, last = path.rstrip("/").rsplit("/", 1)
    reader = spark.readStream.schema(schema)
    reader = reader.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else reader
    # A pattern that fits this name alone: a stream's source is a folder or a pattern.
    return reader.parquet(f"{head}/{last[:-1]}[{last[-1]}]")


def drain(stream: DataFrame, sink: str, checkpoint: str) -> Drained:
    """Run a windowed stream in append mode until its input has been read; what it wrote, and the rows it dropped as late."""
    query = stream.writeStream.outputMode("append").format("parquet").option("path", sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    progress = query.recentProgress
    late = sum(op.get("numRowsDroppedByWatermark", 0) for p in progress for op in p["stateOperators"])
    return Drained(stream.sparkSession.read.schema(stream.schema).parquet(sink), len(progress), late)
