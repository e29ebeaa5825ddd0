"""Contracts of artifacts: required fields and types as columns of errors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fields that artifacts must have.
COMMON = ("artifact_type", "schema_version", "created_utc", "producer_expert", "run_id", "status")
DOCUMENT = ("source_path", "logical_path", "document_hash", "text_content")
CHUNK = ("chunk_id", "chunk_index", "logical_path", "source_path", "document_hash", "text", "text_hash", "token_count")
EMBEDDING = ("chunk_id", "logical_path", "document_hash", "text_hash", "embedding_model", "embedding_dim", "vector")


#: Fields of the other artifact types with their kinds.
ARTIFACTS: dict[str, dict[str, str]] = {
    "search_context_chunk_collection": {"source": "struct", "chunking": "struct", "chunks": "array"},
    "query_context": {"query_text": "", "ranker": "", "top_k": "", "context_text": "", "sources": "array"},
    "query_answer": {"query_text": "", "ranker": "", "top_k": "", "answer_text": "", "source_count": "", "sources": "array"},
    "query_diagnostics": {"query_text": "", "ranker": "", "expanded_queries": "", "candidate_count": "", "ranked_count": "", "results": ""},
    "vector_index_metadata": {"embedding_count": "", "embedding_dim": "", "index_type": "", "distance_metric": "", "entries": "array"},
    "corpus_stats": {"document_count": "int", "chunk_count": "int", "embedding_count": "int", "matched_embedding_count": "int", "missing_embedding_count": "int", "orphan_embedding_count": "int", "embedding_coverage_pct": ""},
    "query_eval": {"query_count": "int", "results": "array"},
    "query_eval_run_manifest": {"dataset": "", "query_set_path": "string", "query_set_sha256": "string", "chunk_root": "string", "ranker_requested": "string", "top_k": "int", "vector_deps_available": "boolean", "vector_deps_unavailable_reason": ""},
    "query_eval_compare": {"dataset": "string", "inputs": "struct", "top_level_metrics": "struct", "summary": "struct", "per_query_deltas": "array"},
}
_KINDS = {"int": ("int", "bigint", "smallint", "tinyint"), "string": ("string",), "boolean": ("boolean",)}


def artifact(df: DataFrame, kind: str) -> DataFrame:
    """Checks a table of artifacts of one kind: its columns at once, the values of a row as ``errors``."""
    if kind == "search_context_document":
        return documents(df)
    if kind == "embedding_artifact":
        check_fields(df, COMMON + EMBEDDING, kind)
        return vectors(df)
    if kind == "search_context_chunk":
        return chunks(df)
    if kind not in ARTIFACTS:
        raise ValueError(f"unknown artifact type {kind!r}")
    fields = ARTIFACTS[kind]
    check_fields(df, COMMON + tuple(fields), kind)
    types = dict(df.dtypes)
    for f, want in fields.items():
        have = types[f]
        if want in _KINDS and have not in _KINDS[want] or want in ("struct", "array") and not have.startswith((want, "map") if want == "struct" else want):
            raise ValueError(f"{kind}.{f} must be {want}, not {have}")
    tests = [(~F.col("artifact_type").eqNullSafe(F.lit(kind)), "artifact_type")]
    tests += [(F.col(f).isNull(), f) for f, want in fields.items() if want]
    if kind == "query_answer":
        tests.append((F.col("source_count") != F.size("sources"), "source_count"))
    if kind == "query_eval_run_manifest":
        tests.append((F.col("query_set_sha256") == "", "query_set_sha256"))
    return df.withColumn("errors", _errors(*tests))


def check_fields(df: DataFrame, fields: tuple[str, ...], name: str) -> None:
    """A table without a required field is refused."""
    missing = [f for f in fields if f not in df.columns]
    if missing:
        raise ValueError(f"{name} lacks {missing}")


def _errors(*tests: tuple[Column, str]) -> Column:
    return F.array_compact(F.array(*(F.when(F.coalesce(bad, F.lit(False)), F.lit(what)) for bad, what in tests)))


def documents(df: DataFrame) -> DataFrame:
    check_fields(df, COMMON + DOCUMENT, "document")
    return df.withColumn("errors", _errors((~F.col("artifact_type").eqNullSafe(F.lit("search_context_document")), "artifact_type"), (F.col("text_content").isNull() | (F.col("text_content") == ""), "empty_text")))


def chunks(df: DataFrame) -> DataFrame:
    check_fields(df, CHUNK, "chunk")
    return df.withColumn(
        "errors",
        _errors(
            (F.col("text").isNull() | (F.col("text") == ""), "empty_text"), (F.col("chunk_index").isNull(), "chunk_index"),
            (F.col("text_hash").isNull() | (F.col("text_hash") == ""), "text_hash"), (F.col("token_count").isNull(), "token_count"),
            (F.col("chunk_index") >= F.col("chunk_count"), "index_beyond_count"), (F.col("end_char") - F.col("start_char") != F.length("text"), "position"),
        ),
    )


def vectors(df: DataFrame) -> DataFrame:
    """For rows (vector, embedding_dim)."""
    v = F.col("vector")
    return df.withColumn(
        "errors",
        _errors(
            (v.isNull() | (F.size(v) <= 0), "empty_vector"), (v.isNotNull() & (F.size(v) != F.col("embedding_dim")), "dimension"),
            (F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))), "not_finite"), ((F.size(v) > 0) & F.forall(v, lambda x: x == 0), "zero_vector"),
        ),
    )


def error_counts(checked: DataFrame) -> DataFrame:
    return checked.select(F.explode("errors").alias("error")).groupBy("error").agg(F.count(F.lit(1)).alias("n_rows"))
