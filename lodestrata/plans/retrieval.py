"""A batch of queries from text to context and answer, as one DataFrame program."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import context, lexical, query, ranking
from ..shared import materialise


@dataclass(frozen=True)
class Settings:
    ranker: str = "bm25"  # or overlap, hybrid
    ranked: int = 100
    floor: float = 0.35
    most: int = 5
    per_source: int = 1
    max_chars: int = 6000
    allowed: list[str] | None = None


def feedback(lexical_rows: DataFrame, vectors: DataFrame) -> DataFrame:
    """(query_id, vector): for each query the vector of its best lexical row that has one, to ask with where no service
    embeds the query itself."""
    x = lexical_rows.select("query_id", "chunk_key", "rank").join(vectors.select("chunk_key", "vector"), "chunk_key")
    return x.groupBy("query_id").agg(F.min_by("vector", "rank").alias("vector"))


def ranked(queries: DataFrame, index: lexical.Index, s: Settings = Settings(), vectors: DataFrame | None = None) -> DataFrame:
    """Candidates of the original query, ranked for each of its variants and merged."""
    cand = lexical.candidates(queries, index, allowed=s.allowed)
    v = query.variants(queries)
    v = v.join(queries.select("query_id", "query_text"), "query_id")
    v = v.withColumn("weight", ranking.variant_weight(F.col("variant_kind"), F.col("variant_text"), F.col("query_text")))
    # Each variant is a query of its own over the candidates of its original.
    v = v.withColumn("vid", F.xxhash64("query_id", "variant_ord"))
    vq = v.select(F.col("vid").alias("query_id"), F.col("variant_text").alias("query_text"))
    vc = cand.join(v.select("query_id", "vid"), "query_id").select(F.col("vid").alias("query_id"), "chunk_key")
    full = materialise(lexical.hydrate(vc, vq, index), "hydrated")
    r = (ranking.overlap if s.ranker == "overlap" else ranking.bm25)(full, s.ranked)
    if s.ranker == "hybrid" and vectors is not None:
        vr = vectors.join(v.select("query_id", "vid"), "query_id").drop("query_id").withColumnRenamed("vid", "query_id")
        vr = vr.join(index.chunks.select("chunk_key", "logical_path", "chunk_index"), "chunk_key")
        fused = ranking.fuse(r, vr, k=s.ranked).select("query_id", "chunk_key", F.col("rank"), F.col("lexical_score"), F.col("vector_score"), "fusion_score")
        r = fused.join(r.select("query_id", "chunk_key", "matched_terms"), ["query_id", "chunk_key"], "left").join(index.chunks.select("chunk_key", "logical_path", "document_hash", "chunk_index", "chunk_id"), "chunk_key")
        r = r.withColumn("score", F.coalesce("lexical_score", "vector_score")).join(vq, "query_id").withColumn("matched_terms", F.coalesce("matched_terms", F.array().cast("array<string>")))
    r = r.drop("query_text").withColumnRenamed("query_id", "vid").join(v.select("vid", "query_id", "query_text", "variant_ord", "variant_kind", "weight"), "vid").drop("vid")
    return ranking.variant_merge(r)


def final(queries: DataFrame, index: lexical.Index, s: Settings = Settings(), vectors: DataFrame | None = None) -> DataFrame:
    """Score gap, diversity by content, diversity by source: at most ``s.most`` rows of a query."""
    r = materialise(ranking.score_gap(ranked(queries, index, s, vectors), s.floor), "ranked")
    # Only what diversity may look at gets its text back.
    r = lexical.add_text(r.where(F.col("rank") <= s.ranked), index)
    picked = ranking.mmr(r, most=s.most).select("query_id", "chunk_key", F.col("rank").alias("mmr_rank"))
    r = r.join(picked, ["query_id", "chunk_key"]).drop("rank").withColumnRenamed("mmr_rank", "rank")
    return ranking.source_diversity(r)


def contexts(queries: DataFrame, index: lexical.Index, s: Settings = Settings(), vectors: DataFrame | None = None) -> DataFrame:
    return context.assemble(final(queries, index, s, vectors), s.max_chars, s.per_source)


def answers(queries: DataFrame, index: lexical.Index, s: Settings = Settings(), vectors: DataFrame | None = None) -> DataFrame:
    return context.answer(contexts(queries, index, s, vectors))
