"""Statistics of the corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

POINTS = (0.0, 0.5, 0.95, 1.0)


def percentiles(df: DataFrame, column: str, group: str | None = None, points: tuple[float, ...] = POINTS) -> DataFrame:
    """(metric, n, p, value): the value at place round((n - 1) * p), halves to even; no row without values.

    Values are counted first, so what is ordered is the distinct values, not the rows.
    """
    g = F.lit(column) if group is None else F.col(group)
    c = df.where(F.col(column).isNotNull()).groupBy(g.alias("metric"), F.col(column).cast("long").alias("v")).agg(F.count(F.lit(1)).alias("k"))
    w = Window.partitionBy("metric").orderBy("v")
    c = c.withColumn("upto", F.sum("k").over(w)).withColumn("n", F.sum("k").over(Window.partitionBy("metric")))
    c = c.select("metric", "n", "v", "upto", F.explode(F.array(*map(F.lit, points))).alias("p"))
    place = F.bround((F.col("n") - 1) * F.col("p")).cast("long")
    return c.where(F.col("upto") > place).groupBy("metric", "n", "p").agg(F.min("v").alias("value"))


def corpus(documents: DataFrame, chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    """One row of counts: documents, chunks, vectors, what is missing, empty or twice."""
    d = documents.agg(
        F.count(F.lit(1)).alias("document_count"), F.count_distinct("artifact_id").alias("distinct_documents"),
        F.count_if(~F.coalesce("text_content", F.lit("")).rlike(r"\S")).alias("blank_documents"),
        F.count_if(F.col("title").isNull()).alias("documents_without_title"), F.count_if(F.col("run_id").isNull()).alias("documents_without_run"),
        F.coalesce(F.sum(F.length("text_content")), F.lit(0)).alias("document_chars"),
    )
    n = F.length("text")
    tokens = F.coalesce("token_count", F.bround(n / 4).cast("long"))
    c = chunks.agg(
        F.count(F.lit(1)).alias("chunk_count"), F.count_distinct("chunk_id").alias("distinct_chunk_ids"), F.count_if(~F.coalesce("text", F.lit("")).rlike(r"\S")).alias("blank_chunks"),
        F.count_if(F.col("text_hash").isNull() | (F.col("text_hash") == "")).alias("chunks_without_hash"), F.count_distinct("artifact_id").alias("documents_with_chunks"),
        F.min(n).alias("min_chars"), F.max(n).alias("max_chars"), F.round(F.avg(n), 6).alias("mean_chars"), F.min(tokens).alias("min_tokens"), F.max(tokens).alias("max_tokens"), F.round(F.avg(tokens), 6).alias("mean_tokens"),
    )
    v = vectors.agg(F.count(F.lit(1)).alias("embedding_count"), F.count_distinct("chunk_key").alias("embedded_chunks"))
    return d.join(F.broadcast(c)).join(F.broadcast(v))  # one row each


def file_types(documents: DataFrame) -> DataFrame:
    return documents.groupBy(F.coalesce(T.file_type("logical_path"), F.lit("unknown")).alias("file_type")).agg(F.count(F.lit(1)).alias("n_documents"))


def duplicates(df: DataFrame, key: str) -> DataFrame:
    """(key, copies, excess) of keys that occur more than once."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("copies")).where(F.col("copies") > 1).withColumn("excess", F.col("copies") - 1)


def duplicate_summary(df: DataFrame, key: str, examples: int = 25) -> DataFrame:
    """(duplicate_keys, excess, examples): how many keys occur more than once, by how much, and the first of them."""
    d = duplicates(df, key)
    first = d.orderBy(key).limit(examples).agg(F.array_sort(F.collect_list(key)).alias("examples"))
    n = d.agg(F.count(F.lit(1)).alias("duplicate_keys"), F.coalesce(F.sum("excess"), F.lit(0)).cast("long").alias("excess"))
    return n.join(F.broadcast(first))  # one row each


def dataset_summary(tables: dict[str, DataFrame], known: dict[str, int] | None = None) -> DataFrame:
    """(dataset, n_rows) of named tables; those that earlier statistics (``known``) tell aren't counted again."""
    out = None
    for name, df in sorted(tables.items()):
        n = (known or {}).get(name)
        x = df.agg(F.count(F.lit(1)).alias("n_rows")) if n is None else df.sparkSession.range(1).select(F.lit(n).cast("long").alias("n_rows"))
        x = x.select(F.lit(name).alias("dataset"), "n_rows")
        out = x if out is None else out.unionByName(x)
    return out
