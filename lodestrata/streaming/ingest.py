"""Incremental runs as streams: new documents become chunks once, whatever is replayed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import chunking


def read(spark: SparkSession, path: str, schema, files_per_batch: int | None = None) -> DataFrame:
    r = spark.readStream.schema(schema)
    if files_per_batch:
        r = r.option("maxFilesPerTrigger", files_per_batch)
    return r.parquet(path)


def current(documents: DataFrame, lateness: str = "7 days") -> DataFrame:
    """Documents of a stream once each: replays of an artifact's text within ``lateness`` are dropped, so the state that
    is kept stays bounded."""
    x = documents.withColumn("created_at", F.timestamp_seconds("created_utc")).withColumn("content", F.xxhash64("text_content"))
    return x.withWatermark("created_at", lateness).dropDuplicatesWithinWatermark(["artifact_id", "content"])


def chunks(documents: DataFrame) -> DataFrame:
    return chunking.chunk(documents, "text_content", ("artifact_id", "logical_path"))


def arrivals(documents: DataFrame, window: str = "1 day", lateness: str = "7 days") -> DataFrame:
    """(window_start, producer_expert, n): documents by day of creation, late ones included up to ``lateness``."""
    x = documents.withColumn("created_at", F.timestamp_seconds("created_utc")).withWatermark("created_at", lateness)
    g = x.groupBy(F.window("created_at", window).alias("w"), "producer_expert").agg(F.count(F.lit(1)).alias("n"))
    return g.select(F.col("w.start").alias("window_start"), "producer_expert", "n")


def write(df: DataFrame, path: str, checkpoint: str):
    """Run until what is there has been read, and return the finished query."""
    q = df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return q


def write_batches(df: DataFrame, each, checkpoint: str):
    """As ``write``, with a function (DataFrame, batch id) for each batch, e.g. an upsert of a registry."""
    q = df.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return q
