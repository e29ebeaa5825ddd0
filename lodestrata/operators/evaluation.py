"""Measures of retrieval quality, and their change between two runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def metrics(results: DataFrame, expected: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, n_expected, n_returned, n_hits, precision_at_k, precision_over_returned, recall, reciprocal_rank).

    ``results`` (query_id, source, rank, score): a source counts once, with its best score and that row's rank.
    ``expected`` (query_id, source).
    """
    best = Window.partitionBy("query_id", "source").orderBy(F.desc("score"), "rank")
    r = results.withColumn("b", F.row_number().over(best)).where(F.col("b") == 1)
    r = r.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy("rank", "source"))).select("query_id", "source", "place")
    e = expected.select("query_id", "source").distinct()
    hit = r.join(e.withColumn("hit", F.lit(1)), ["query_id", "source"], "left")
    m = hit.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_returned"), F.count("hit").alias("n_hits"), F.min(F.when(F.col("hit").isNotNull(), F.col("place"))).alias("first"))
    x = e.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_expected")).join(m, "query_id", "full_outer").na.fill(0, ["n_expected", "n_returned", "n_hits"])
    ratio = lambda a, b: F.round(F.coalesce(a / F.nullif(b, F.lit(0)), F.lit(0.0)), 6)
    return x.select(
        "query_id", "n_expected", "n_returned", "n_hits", F.round(F.col("n_hits") / k, 6).alias("precision_at_k"), ratio(F.col("n_hits"), F.col("n_returned")).alias("precision_over_returned"),
        ratio(F.col("n_hits"), F.col("n_expected")).alias("recall"), F.round(F.coalesce(1 / F.col("first"), F.lit(0.0)), 6).alias("reciprocal_rank"),
    )


def summary(m: DataFrame) -> DataFrame:
    return m.agg(
        F.count(F.lit(1)).alias("n_queries"), F.round(F.avg("precision_at_k"), 6).alias("mean_precision"), F.round(F.avg("recall"), 6).alias("mean_recall"),
        F.round(F.avg("reciprocal_rank"), 6).alias("mrr"), F.count_if(F.col("n_returned") == 0).alias("empty_queries"), F.count_if(F.col("n_hits") == 0).alias("queries_without_hit"),
    )


def compare(before: DataFrame, after: DataFrame) -> DataFrame:
    """(query_id, before_precision, after_precision, delta, status) of two results of ``metrics``."""
    a = before.select("query_id", F.col("precision_at_k").alias("before_precision"))
    b = after.select("query_id", F.col("precision_at_k").alias("after_precision"))
    x = a.join(b, "query_id", "full_outer").withColumn("delta", F.round(F.col("after_precision") - F.col("before_precision"), 6))
    status = F.when(F.col("before_precision").isNull(), "ADDED").when(F.col("after_precision").isNull(), "REMOVED").when(F.col("delta") > 0, "IMPROVED").when(F.col("delta") < 0, "REGRESSED").otherwise("UNCHANGED")
    return x.withColumn("status", status)


def source_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """(query_id, added, removed): sources that only the later and only the earlier results (query_id, source) have."""
    a, b = (x.groupBy("query_id").agg(F.collect_set("source").alias(n)) for x, n in ((before, "before"), (after, "after")))
    none = F.array().cast("array<string>")
    x = a.join(b, "query_id", "full_outer").select("query_id", F.coalesce("before", none).alias("before"), F.coalesce("after", none).alias("after"))
    return x.select("query_id", F.array_sort(F.array_except("after", "before")).alias("added"), F.array_sort(F.array_except("before", "after")).alias("removed"))


def pattern_hits(texts: DataFrame, good: tuple[str, ...], bad: tuple[str, ...]) -> DataFrame:
    """(query_id, good_hits, bad_hits): how many of the patterns a query's text (query_id, text) contains."""
    count = lambda ps: sum((F.coalesce(F.lower("text").contains(p.lower()), F.lit(False)).cast("int") for p in ps), F.lit(0))
    return texts.select("query_id", count(good).alias("good_hits"), count(bad).alias("bad_hits"))


def report(m: DataFrame) -> DataFrame:
    """(query_id, line): each query's measures for reading."""
    return m.select("query_id", F.format_string("precision@k=%.2f recall@k=%.2f rr=%.2f", "precision_at_k", "recall", "reciprocal_rank").alias("line"))


def usable_ranker(wanted: str, vectors_available: bool) -> tuple[str, str]:
    """The ranker to run and why: without vectors hybrid ranking falls back to BM25."""
    if wanted == "hybrid" and not vectors_available:
        return "bm25", "vectors_unavailable"
    return wanted, "requested"
