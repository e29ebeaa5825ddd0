"""Scores and orders of candidates, for a batch of queries."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

#: Words that speak for or against a chunk, with what they add.
INTENT = (
    (0.10, ("discuss", "discussed", "discussion", "issues", "concerns", "meeting", "talk", "debate")),
    (0.08, ("risk", "risks", "volatility", "swings", "prices", "weather", "regulatory", "backlash", "competitive", "dynamics", "turmoil")),
    (0.08, ("strategy", "strategies", "trading", "investment", "market", "markets", "hedging", "industry", "structure")),
    (0.05, ("executive", "executives", "skilling")),
    (-2.5, ("born", "died", "undergraduate", "master", "degree", "professor", "university", "earned")),
)


def _ranked(df: DataFrame, score: str, k: int | None = None) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(F.desc(score), "chunk_index", "logical_path", "chunk_key")
    out = df.withColumn("rank", F.row_number().over(w))
    return out if k is None else out.where(F.col("rank") <= k)


def overlap(cand: DataFrame, k: int | None = None) -> DataFrame:
    """Number of common words, 3 more if the text holds the whole query; rows without score are left out."""
    s = F.size("matched_terms") + F.when(F.col("phrase"), 3).otherwise(0)
    return _ranked(cand.withColumn("score", s.cast("double")).where(F.col("score") > 0), "score", k)


def intent_bonus(words: Column) -> Column:
    s = F.lit(0.0)
    for add, terms in INTENT:
        s = s + F.when(F.arrays_overlap(words, F.array(*map(F.lit, terms))), add).otherwise(0.0)
    return s


def bm25(cand: DataFrame, k: int | None = None, k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """BM25 with the candidates of a query as its corpus, plus intent and phrase bonus; rounded to 6 places, > 0 only.

    ``cand`` comes from ``lexical.hydrate``; only terms, frequencies and lengths move.
    """
    of_query = cand.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl"))
    t = cand.select("query_id", "chunk_key", "dl", F.explode(F.arrays_zip("matched_terms", "tfs")).alias("z"))
    t = t.select("query_id", "chunk_key", "dl", F.col("z.matched_terms").alias("term"), F.col("z.tfs").alias("tf"))
    df = t.groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("df"))
    t = t.join(df.join(of_query, "query_id"), ["query_id", "term"])
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    below = F.when(F.col("avgdl") == 0, F.lit(1.0)).otherwise(F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    core = t.groupBy("query_id", "chunk_key").agg(F.sum(idf * F.col("tf") * (k1 + 1) / below).alias("core"))
    y = cand.join(core, ["query_id", "chunk_key"]).withColumn("score", F.round(F.col("core") + F.col("intent_bonus") + F.when(F.col("phrase"), 1.0).otherwise(0.0), 6))
    return _ranked(y.where(F.col("score") > 0).drop("core"), "score", k)


def score_gap(ranked: DataFrame, floor: float = 0.35, least: int = 3, most: int | None = None) -> DataFrame:
    """Rows with at least ``floor`` of the first row's score; the first ``least`` if those are fewer; order is kept."""
    w = Window.partitionBy("query_id").orderBy("rank")
    top = F.first("score").over(w)
    kept = F.when(top > 0, F.coalesce("score", F.lit(0.0)) >= floor * top).otherwise(True)
    x = ranked.withColumn("kept", kept)
    n = F.sum(F.col("kept").cast("int")).over(Window.partitionBy("query_id"))
    x = x.withColumn("n_kept", n).where(F.when(F.col("n_kept") < least, F.col("rank") <= least).otherwise(F.col("kept")))
    x = x.drop("kept", "n_kept")
    return x if most is None else x.withColumn("r", F.row_number().over(w)).where(F.col("r") <= most).drop("r")


def variant_weight(kind: Column, variant: Column, query: Column) -> Column:
    words = lambda c: F.size(F.split(F.trim(c), r"\s+"))
    return F.when(kind.isin("original", "rewrite"), 1.0).otherwise(F.when(words(variant) > words(query), 0.75).otherwise(0.9))


def variant_merge(rows: DataFrame) -> DataFrame:
    """Best row of each chunk over the variants of a query: rows (query_id, variant_ord, weight, rank, score, chunk_key).

    Scores are weighted; of equal ones the earlier variant counts; ties of the order go to what came first.
    """
    x = rows.withColumn("score", F.col("score") * F.col("weight"))
    best = Window.partitionBy("query_id", "chunk_key").orderBy(F.desc("score"), "variant_ord", "rank")
    seen = F.min(F.struct("variant_ord", "rank")).over(Window.partitionBy("query_id", "chunk_key"))
    x = x.withColumn("seen", seen).withColumn("r", F.row_number().over(best)).where(F.col("r") == 1).drop("r", "rank")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "seen", "chunk_key")
    return x.withColumn("rank", F.row_number().over(order)).drop("seen")


def source_diversity(ranked: DataFrame) -> DataFrame:
    """Second and later chunks of a source count 0.92 and 0.80; the order is made anew."""
    n = F.row_number().over(Window.partitionBy("query_id", "logical_path").orderBy("rank"))
    x = ranked.withColumn("source_occurrence", n)
    x = x.withColumn("diversity_weight", F.when(F.col("source_occurrence") == 1, 1.0).when(F.col("source_occurrence") == 2, 0.92).otherwise(0.80))
    x = x.withColumn("diversity_score", F.col("score") * F.col("diversity_weight")).withColumnRenamed("rank", "rank_before")
    return x.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("diversity_score"), "rank_before")))


def mmr(ranked: DataFrame, weight: float = 0.5, most: int = 5, same_source: float = 0.2, too_near: float = 0.85, depth: int = 100) -> DataFrame:
    """(query_id, chunk_key, rank, mmr_score): greedy choice of relevant and different chunks.

    It is sequential, so each query is one group; a group holds ``depth`` rows at most, of which only word sets move.
    """
    x = ranked.where(F.col("rank") <= depth).select("query_id", "chunk_key", "logical_path", "rank", "score", T.diversity_tokens(F.coalesce("text", F.lit(""))).alias("words"))

    def pick(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("rank")
        rows = list(zip(g["chunk_key"], g["logical_path"], g["score"], map(frozenset, g["words"])))
        top = max((r[2] for r in rows), default=0.0)
        chosen, out = [], []
        rest = list(range(len(rows)))
        while rest and len(chosen) < most:
            best, value = None, None
            for i in rest:
                near = max((_jaccard(rows[i][3], rows[j][3]) for j in chosen), default=0.0)
                if chosen and near >= too_near:
                    continue
                v = weight * (rows[i][2] / top if top > 0 else 0.0) - (1 - weight) * near
                if any(rows[j][1] == rows[i][1] for j in chosen):
                    v -= same_source
                if not chosen:
                    best, value = i, v
                    break
                if value is None or v > value:
                    best, value = i, v
            if best is None:
                break
            chosen.append(best)
            rest.remove(best)
            out.append((rows[best][0], len(chosen), value))
        return pd.DataFrame({"query_id": [g["query_id"].iloc[0]] * len(out), "chunk_key": [o[0] for o in out], "rank": [o[1] for o in out], "mmr_score": [o[2] for o in out]})

    return x.groupBy("query_id").applyInPandas(pick, "query_id long, chunk_key long, rank int, mmr_score double")


def _jaccard(a: frozenset, b: frozenset) -> float:
    return len(a & b) / len(a | b) if a and b else 0.0


def fuse(lexical: DataFrame, vector: DataFrame, lexical_weight: float = 0.7, vector_weight: float = 0.3, floor: float = 0.6, k: int | None = None) -> DataFrame:
    """Lexical and vector results (query_id, chunk_key, logical_path, chunk_index, rank, score) of each query in one list.

    Scores are brought to 0..1 within each list. A lexical row without a vector has the cosine 0, which is scaled like the
    others and may go below 0; a row found by vectors only has the scaled lexical score 0 and needs a cosine of ``floor``.
    """
    cols = ["query_id", "chunk_key", "logical_path", "chunk_index"]
    a = lexical.select(*cols, F.col("rank").alias("lexical_rank"), F.col("score").alias("lexical_score"))
    b = vector.select(*cols, F.col("rank").alias("vector_rank"), F.col("score").alias("vector_score"))
    x = a.join(b, cols, "full_outer")
    w = Window.partitionBy("query_id")

    def scaled(c: str) -> Column:
        lo, hi = F.min(c).over(w), F.max(c).over(w)  # nulls don't count
        return F.when(hi > lo, (F.coalesce(c, F.lit(0.0)) - lo) / (hi - lo)).otherwise(0.0)

    lexical_part = F.when(F.col("lexical_rank").isNull(), 0.0).otherwise(scaled("lexical_score"))
    x = x.withColumn("ln", lexical_part).withColumn("vn", scaled("vector_score"))
    x = x.where(F.col("lexical_rank").isNotNull() | (F.col("vector_score") >= floor))
    origin = F.when(F.col("vector_rank").isNull(), "lexical_only").when(F.col("lexical_rank").isNull(), "vector_only").otherwise("both")
    score = lexical_weight * F.coalesce("ln", F.lit(0.0)) + vector_weight * F.coalesce("vn", F.lit(0.0))
    x = x.withColumn("match_origin", origin).withColumn("fusion_score", F.round(score, 6)).withColumnsRenamed({"ln": "lexical_score_normalized", "vn": "vector_score_normalized"})
    w = Window.partitionBy("query_id").orderBy(F.desc("fusion_score"), F.desc("logical_path"), F.desc("chunk_index"), "chunk_key")
    x = x.withColumn("rank", F.row_number().over(w))
    return x if k is None else x.where(F.col("rank") <= k)


def variant_summary(rows: DataFrame) -> DataFrame:
    """(query_id, variant_ord, n_rows, top_hit): merged rows (query_id, variant_ord, rank) of each variant, and whether the
    first row of the query is one of them."""
    return rows.groupBy("query_id", "variant_ord").agg(F.count(F.lit(1)).alias("n_rows"), F.max(F.col("rank") == 1).alias("top_hit"))


def full_trace(final: DataFrame) -> DataFrame:
    """One row per result with all that the stages say of it: ranks and scores before fusion, raw and scaled, origin, fused
    score, and what weights and the diversity of sources made of it. Rows of ``fuse`` with their raw_score, weight, query_text
    and variant_kind, after ``source_diversity``."""
    has = lambda c: F.col(c).isNotNull()
    return final.select(
        "query_id", F.col("rank").alias("final_rank"), "chunk_key", "logical_path", "chunk_index", "chunk_id",
        F.col("lexical_rank").alias("lexical_rank_before_fusion"), F.col("vector_rank").alias("vector_rank_before_fusion"),
        has("lexical_rank").alias("present_in_lexical"), has("vector_rank").alias("present_in_vector"), has("lexical_rank").alias("seen_in_lexical"), has("vector_rank").alias("seen_in_vector"), "match_origin",
        F.coalesce("lexical_score", F.lit(0.0)).alias("lexical_score"), F.coalesce("vector_score", F.lit(0.0)).alias("vector_score"), "lexical_score_normalized", "vector_score_normalized",
        F.col("fusion_score").alias("fusion_score_pre_doc_boost"), F.col("fusion_score").alias("fusion_score_post_doc_boost"),
        F.col("score").alias("pre_diversity_score"), F.col("diversity_score").alias("final_score_after_diversity"), F.col("diversity_score").alias("final_score"),
        "raw_score", F.col("weight").alias("expansion_weight"), F.col("query_text").alias("matched_query"), F.col("variant_kind").alias("query_variant_kind"),
        F.col("diversity_weight").alias("source_diversity_weight"), F.max("source_occurrence").over(Window.partitionBy("query_id", "logical_path")).alias("source_occurrence_count"),
    )


def trace(final: DataFrame) -> DataFrame:
    """One row per result with what each stage said of it."""
    return final.select("query_id", F.col("rank").alias("final_rank"), "chunk_key", "chunk_id", "logical_path", "chunk_index", "score", "source_occurrence", "diversity_weight", "diversity_score", F.array_join("matched_terms", ",").alias("matched_terms"))
