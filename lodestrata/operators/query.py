"""Queries before retrieval: expansion by synonyms, checked rewrites, variants."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Synonyms of words and phrases.
SYNONYMS = {
    "statement of work": ["sow"],
    "sow": ["statement of work"],
    "deliverables": ["milestones", "outputs"],
    "risk": ["risk_management", "hedging"],
    "risks": ["risk_management", "hedging"],
    "issue": ["watchlist"],
    "issues": ["watchlist"],
    "procurement": ["acquisition", "requisition", "purchasing"],
    "simulation": ["model", "modeling"],
}
#: What makes a rewrite an answer instead of a query.
ANSWER_MARKS = ("the answer is", "they discussed", "this means", "in summary")
#: What a rewrite may say of itself.
STATUSES = ("OK", "FALLBACK_ORIGINAL", "REJECTED")


def normal(q: Column | str) -> Column:
    c = F.col(q) if isinstance(q, str) else q
    return F.trim(F.regexp_replace(F.lower(c), r"\s+", " "))


def expand(q: Column | str, synonyms: dict[str, list[str]] = SYNONYMS, most: int = 2) -> Column:
    """The query and, if some word has synonyms, the query with all of them appended (``most`` for each word)."""
    c = F.col(q) if isinstance(q, str) else q
    words = F.split(normal(c), " ")
    found = lambda w: F.coalesce(*(F.when(w == k, F.array(*map(F.lit, v[:most]))) for k, v in synonyms.items() if " " not in k), F.array().cast("array<string>"))
    extra = F.flatten(F.transform(words, found))
    return F.when(F.size(extra) > 0, F.array(c, F.concat(normal(c), F.lit(" "), F.array_join(extra, " ")))).otherwise(F.array(c))


def check_rewrite(df: DataFrame) -> DataFrame:
    """Rewrites (query_id, original_query, rewritten_query, rewrite_status, rationale) with rejection reasons; a rejected
    one falls back to the original, an accepted one tells kept, added and removed words."""
    words = lambda c: F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9_]+"), F.lit(0)))
    a, b = F.coalesce("original_query", F.lit("")), F.coalesce("rewritten_query", F.lit(""))
    only = lambda p: F.size(F.array_except(F.regexp_extract_all(b, F.lit(p), F.lit(0)), F.regexp_extract_all(a, F.lit(p), F.lit(0)))) > 0
    same = lambda name, value: [(~F.col(name).eqNullSafe(F.lit(value)), f"invalid_{name}")] if name in df.columns else []
    tests = (
        *same("artifact_type", "query_rewrite"),
        *same("schema_version", "query_rewrite_v1"),
        (~F.coalesce(F.col("rewrite_status").isin(*STATUSES), F.lit(False)), "invalid_rewrite_status"),
        (F.trim(b) == "", "empty_rewritten_query"),
        (F.length(b) > 160, "rewritten_query_too_long"),
        (F.length(F.coalesce("rationale", F.lit(""))) > 160, "rewrite_rationale_too_long"),
        (only(r"\b\d+\b"), "added_numbers_not_in_original"),
        (only(r"\b[A-Z][a-zA-Z0-9_-]+\b"), "added_capitalized_terms_not_in_original"),
        (F.lower(b).rlike("|".join(ANSWER_MARKS)), "answer_like_output"),
    )
    x = df.withColumn("rejection_reasons", F.array_compact(F.array(*(F.when(t, F.lit(s)) for t, s in tests))))
    bad = F.size("rejection_reasons") > 0
    sort = lambda c: F.array_join(F.array_sort(c), ",")
    return x.select(
        "query_id", F.when(bad, a).otherwise(b).alias("query_text"), F.when(bad, "FALLBACK_ORIGINAL").otherwise(F.col("rewrite_status")).alias("rewrite_status"), bad.alias("used_fallback"),
        F.array_join("rejection_reasons", ",").alias("rejection_reasons"), F.when(bad, sort(words(a))).otherwise(sort(F.array_intersect(words(a), words(b)))).alias("preserved_terms"),
        F.when(bad, "").otherwise(sort(F.array_except(words(b), words(a)))).alias("added_terms"), F.when(bad, "").otherwise(sort(F.array_except(words(a), words(b)))).alias("removed_terms"),
    )


def variants(queries: DataFrame, rewrites: DataFrame | None = None) -> DataFrame:
    """(query_id, variant_ord, variant_kind, variant_text): original, a rewrite that differs, expansions not yet present."""
    q = queries.select("query_id", "query_text")
    r = q.withColumn("rewritten", F.lit(None).cast("string")) if rewrites is None else q.join(rewrites.select("query_id", F.col("query_text").alias("rewritten")), "query_id", "left")
    base = F.array(F.struct(F.lit("original").alias("kind"), F.col("query_text").alias("text")))
    rewrite = F.when(F.col("rewritten").isNotNull() & (F.col("rewritten") != F.col("query_text")), F.array(F.struct(F.lit("rewrite").alias("kind"), F.col("rewritten").alias("text")))).otherwise(F.slice(base, 1, 0))
    had = F.array_compact(F.array("query_text", "rewritten"))
    more = F.transform(F.array_distinct(F.filter(expand("query_text"), lambda t: ~F.array_contains(had, t))), lambda t: F.struct(F.lit("expansion").alias("kind"), t.alias("text")))
    x = r.select("query_id", F.posexplode(F.concat(base, rewrite, more)).alias("variant_ord", "v"))
    return x.select("query_id", "variant_ord", F.col("v.kind").alias("variant_kind"), F.col("v.text").alias("variant_text"))
