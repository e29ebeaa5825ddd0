"""Context of limited size from ranked chunks, and an extractive answer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

#: Sentences that the answer makes of words in its evidence, and the one without such words.
RULES = (
    (("price swings", "inflated prices", "volatility", "volatile"), "Retrieved evidence highlights trading risk tied to price swings and market volatility."),
    (("weather", "demand", "warmer than normal winter"), "It also points to weather-driven demand variability as an important source of exposure."),
    (("hedging", "demand swaps", "options", "cross-commodity"), "The strongest chunks describe hedging approaches such as demand swaps, options, and related risk-management tools."),
)
OTHERWISE = "Retrieved evidence is relevant but mixed, with the top chunks emphasizing energy-market risk, trading strategy, and risk-management themes."
NOTHING = "No relevant context was found for the query."


def block() -> Column:
    return F.concat(F.lit("[SOURCE: "), "logical_path", F.lit(" | CHUNK: "), F.col("chunk_index").cast("string"), F.lit(" | SCORE: "), F.col("score").cast("string"), F.lit("]\n"), F.trim("text"), F.lit("\n"))


def judged(ranked: DataFrame, max_chars: int = 6000, per_source: int = 2) -> DataFrame:
    """Each row with its block, and ``verdict``: included, source_cap, empty_text, max_context_chars or beyond.

    In the order of ranks: rows of a source above the cap and blank texts are skipped; the first block that doesn't fit
    ends the context, and what comes after it is ``beyond``.
    """
    blank = ~F.coalesce(F.col("text"), F.lit("")).rlike(r"\S")
    src = Window.partitionBy("query_id", "logical_path").orderBy("rank")
    x = ranked.withColumn("blank", blank)
    x = x.withColumn("before", F.coalesce(F.sum((~F.col("blank")).cast("int")).over(src.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    x = x.withColumn("capped", F.col("before") >= per_source).withColumn("block", block())
    fits = ~F.col("blank") & ~F.col("capped")
    order = Window.partitionBy("query_id").orderBy("rank")
    x = x.withColumn("fits", fits).withColumn("total", F.sum(F.when(F.col("fits"), F.length("block") + 2).otherwise(0)).over(order))
    over = F.min(F.when(F.col("fits") & (F.col("total") > max_chars), F.col("rank"))).over(Window.partitionBy("query_id"))
    x = x.withColumn("stop", over)
    verdict = F.when(F.col("rank") > F.col("stop"), "beyond").when(F.col("rank") == F.col("stop"), "max_context_chars").when(F.col("capped"), "source_cap").when(F.col("blank"), "empty_text").otherwise("included")
    return x.withColumn("verdict", verdict).drop("blank", "before", "capped", "fits", "total", "stop")


def assemble(ranked: DataFrame, max_chars: int = 6000, per_source: int = 2) -> DataFrame:
    """(query_id, query_text, context_text, n_sources, context_chars): a query's included blocks, joined by line ends."""
    x = judged(ranked, max_chars, per_source).where(F.col("verdict") == "included")
    g = x.groupBy("query_id", "query_text").agg(F.array_sort(F.collect_list(F.struct("rank", "block", "logical_path", "chunk_index", "score"))).alias("l"))
    t = F.array_join(F.transform("l", lambda y: y["block"]), "\n")
    return g.select("query_id", "query_text", t.alias("context_text"), F.size("l").alias("n_sources"), F.length(t).alias("context_chars"), F.transform("l", lambda y: F.struct(y["logical_path"], y["chunk_index"], y["score"])).alias("sources"))


def excluded(ranked: DataFrame, max_chars: int = 6000, per_source: int = 2) -> DataFrame:
    x = judged(ranked, max_chars, per_source).where(~F.col("verdict").isin("included", "beyond"))
    return x.select("query_id", "rank", "chunk_key", F.col("verdict").alias("reason"))


def answer(assembled: DataFrame, rules=RULES, otherwise: str = OTHERWISE) -> DataFrame:
    """(query_id, answer_text, source_count): sentences by rules on the evidence, and the list of sources.

    Evidence: of the first two blocks up to three lines that share a word with the query, else their first three.
    """
    words = T.index_tokens("query_text")
    cleaned = F.trim(F.regexp_replace(F.replace("context_text", F.lit("﻿"), F.lit("")), r"^\s+|\s+$", ""))
    blocks = F.slice(F.filter(F.transform(F.split(cleaned, r"\n\n\[SOURCE: "), lambda b: F.trim(b)), lambda b: b != ""), 1, 2)

    def evidence(b: Column) -> Column:
        lines = F.filter(F.transform(F.split(b, r"\r\n|\r|\n"), lambda s: F.regexp_replace(s, r"^\s+|\s+$", "")), lambda s: s != "")
        body = F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(0)))
        hits = F.slice(F.filter(body, lambda s: F.arrays_overlap(T.index_tokens(s), words)), 1, 3)
        return F.when(F.size(hits) > 0, hits).otherwise(F.slice(body, 1, 3))

    blob = F.lower(F.array_join(F.flatten(F.transform(blocks, evidence)), " "))
    x = assembled.withColumn("blob", blob)
    said = [F.when(F.exists(F.array(*map(F.lit, terms)), lambda t: F.col("blob").contains(t)), F.lit(s)) for terms, s in rules]
    text = F.array_join(F.array_compact(F.array(*said)), " ")
    sources = F.transform("sources", lambda s: F.concat(F.lit("- "), s["logical_path"], F.lit(" (chunk "), s["chunk_index"].cast("string"), F.lit(", score="), s["score"].cast("string"), F.lit(")")))
    full = F.concat(F.when(text == "", otherwise).otherwise(text), F.lit("\n\nSources used:\n"), F.array_join(sources, "\n"))
    none = F.coalesce(F.trim("context_text"), F.lit("")) == ""
    return x.select("query_id", F.when(none, NOTHING).otherwise(full).alias("answer_text"), F.when(none, 0).otherwise(F.size("sources")).alias("source_count"))
