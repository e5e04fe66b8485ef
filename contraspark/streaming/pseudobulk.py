"""Sums of a stream of values by key and gene, in batch and as a stream; both give the same table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from contraspark.streaming.windows import read_stream


def fold(df: DataFrame, key: str = "user_id", gene: str = "event_type", value: str = "value") -> DataFrame:
    return df.groupBy(key, gene).agg(F.sum(value).alias("total"), F.count(value).alias("n"))


def drain(spark: SparkSession, source: str, schema, transform, sink: str, checkpoint: str, mode: str = "complete") -> DataFrame:
    """Run a stream over the files at ``source`` until all are read and return what it wrote to Parquet ``sink``."""

    def put(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").parquet(sink)

    transform(read_stream(spark, source, schema)).writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(put).start().awaitTermination()
    return spark.read.parquet(sink)
