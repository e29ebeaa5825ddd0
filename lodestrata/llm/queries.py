"""Queries of this subpackage, by name: callables (spark, sf_dir) and, where SQL can say it, the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import encoding, mixing, neardup, newtext, pii, splitting, truncation, vectors
from .common import records, table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.similar_pairs(table(spark, sf_dir, "embedding_vector_batch"))


def p1_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.most_similar(table(spark, sf_dir, "embedding_vector_batch"), least=-1.0)


def p1_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.recall(table(spark, sf_dir, "embedding_vector_batch"), least=-1.0)


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.Similar(records(spark, sf_dir)).links()


def p2_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.Similar(records(spark, sf_dir)).groups()


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splitting.oversized(records(spark, sf_dir))


def p3_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splitting.split_records(records(spark, sf_dir))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return newtext.newly_written(table(spark, sf_dir, "search_context_document"))


def p4_new_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return newtext.new_texts(table(spark, sf_dir, "search_context_document"))


def p4_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return newtext.steps(table(spark, sf_dir, "search_context_document"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = pii.lexicon(table(spark, sf_dir, "search_context_document"))
    return pii.spans(records(spark, sf_dir), names).select("tbl", "record_key", "start_char", "kind")


def p5_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = pii.lexicon(table(spark, sf_dir, "search_context_document"))
    return pii.redacted(records(spark, sf_dir), names)


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoding.encode(table(spark, sf_dir, "documents"))


def p6_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The texts that the ids give again, by their digests."""
    back = encoding.decode(encoding.encode(table(spark, sf_dir, "documents")))
    return back.select("doc_id", F.md5("text").alias("digest"), F.length("text").alias("n_chars"))


def _mixture(spark: SparkSession, sf_dir: str) -> mixing.Mixture:
    return mixing.Mixture(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_target"))


def p7_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mixture(spark, sf_dir).selection()


def p7_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mixture(spark, sf_dir).report()


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return truncation.truncated(table(spark, sf_dir, "documents"))


def p8_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return truncation.report(table(spark, sf_dir, "documents"))


def p8_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return truncation.storage_limits(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = {k: v for k, v in globals().items() if k[0] == "p" and k[1].isdigit() and callable(v)}
    return dict(sorted(found.items()))


P3_FOUND = """
with r as (
  select 'document' as tbl, artifact_id as record_key, text_content as text from search_context_document
  union all select 'chunk', chunk_key, text from search_context_chunk),
d as (select distinct tbl, record_key, regexp_matches(text, '[^ \\t\\n\\r]{1000}[^ \\t\\n\\r]{1000}[^ \\t\\n\\r]') as f from r where length(text) > 2000)
select tbl, record_key, 'oversized' as kind from d union all select tbl, record_key, 'forced' from d where f
"""


#: Every pair of valid vectors, ranked for each; copies are each other's nearest.
P1_FOUND = """
with z as (select unnest(chunk_keys) as k, unnest(embeddings) as v from embedding_vector_batch),
ok as (select k, any_value(v) as v from z where k is not null and v is not null and len(v) = 64 and len(list_filter(v, lambda x: x is null or isnan(x) or isinf(x))) = 0 and len(list_filter(v, lambda x: x <> 0)) > 0 group by 1),
u as (select k, list_transform(v, lambda x: x::double / sqrt(list_sum(list_transform(v, lambda y: y::double * y::double))))::double[64] as v from ok),
s as (select a.k as a, b.k as b, array_inner_product(a.v, b.v) as sim from u a join u b on a.k <> b.k),
r as (select *, row_number() over (partition by a order by sim desc, b) as n from s)
select distinct least(a, b) as chunk_key_a, greatest(a, b) as chunk_key_b from r where n <= 10 and sim >= 0.9 - 1e-7
"""
#: Pairs that share one of their rarest triples (a pair that shares 0.70 of its union must), counted exactly.
P2_FOUND = """
with r as (select 'document' as tbl, artifact_id as k, text_content as text from search_context_document union select 'chunk', chunk_key, text from search_context_chunk),
w as (select tbl, k, regexp_extract_all(lower(text), '[\\p{L}\\p{Nd}]+') as w from r where length(text) > 0),
t as (select distinct tbl, k, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) as t from w where len(w) > 2),
a as (select *, count(*) over (partition by tbl, t) as df, count(*) over (partition by tbl, k) as n from t),
p as (select * from a qualify row_number() over (partition by tbl, k order by df, t) <= n - ceil(0.7 * n - 1e-9) + 1),
c as (select distinct x.tbl, x.k as key_a, y.k as key_b, x.n as na, y.n as nb from p x join p y using (tbl, t) where x.k < y.k and x.n >= 0.7 * y.n - 1e-9 and y.n >= 0.7 * x.n - 1e-9),
s as (select c.tbl, key_a, key_b, na, nb, count(*) as shared from c join t x on x.tbl = c.tbl and x.k = key_a join t y on y.tbl = c.tbl and y.k = key_b and y.t = x.t group by all)
select tbl, key_a, key_b from s where shared >= 0.7 * (na + nb - shared) - 1e-9
"""


def oracle_sql() -> dict[str, str]:
    return {"p1_found": P1_FOUND, "p2_found": P2_FOUND, "p3_found": P3_FOUND, "p6_round_trip": "select doc_id, md5(coalesce(text, '')) as digest, length(coalesce(text, ''))::int as n_chars from documents"}
