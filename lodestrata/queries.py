"""All queries on the reference operators by name, each with the same in SQL where SQL can say it."""

from __future__ import annotations

import io
import json
import uuid
import zipfile
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import text as T
from .operators import chunking, context, evaluation, lexical, lifecycle, query, ranking, redaction, registry, stats, validation, vector
from .plans import retrieval
from .shared import materialise, shared_dir
from .sources import files, samples

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def register(sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name or f.__name__] = f
        if sql is not None:
            SQL[name or f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(s: SparkSession, d: str) -> DataFrame:
    """Each document once; replays differ in run and time of creation only."""
    return table(s, d, "search_context_document").dropDuplicates(["artifact_id"])


def chunks(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "search_context_chunk").dropDuplicates(["chunk_key"])


def index(s: SparkSession, d: str) -> lexical.Index:
    return lexical.index_of(s, f"{d}/search_context_chunk.parquet")


def titles(s: SparkSession, d: str) -> DataFrame:
    """The batch of queries: all titles of the documents table."""
    x = table(s, d, "documents").where(F.trim("title") != "").select(F.col("title").alias("query_text")).distinct()
    return x.select(F.conv(F.substring(F.md5("query_text"), 1, 15), 16, 10).cast("long").alias("query_id"), "query_text")


_STOP = ",".join(f"'{w}'" for w in T.STOPWORDS)


def _bag(x: str) -> str:
    return f"list_filter(regexp_extract_all(lower({x}), '[a-zA-Z0-9_]+'), lambda w: length(w) >= 3 and w not in ({_STOP}))"


def _tok(x: str) -> str:
    return f"list_distinct({_bag(x)})"


def _ix(x: str) -> str:
    return f"list_distinct(list_filter(regexp_extract_all(lower({x}), '[a-zA-Z0-9_]+'), lambda w: length(w) >= 3))"


_CH = "ch as (select distinct chunk_key, artifact_id, chunk_id, logical_path, source_path, document_hash, chunk_index, chunk_count, text, text_hash, token_count, start_char, end_char from search_context_chunk)"
_DC = "dc as (select distinct artifact_id, producer_expert, source_path, logical_path, document_hash, text_content, title, metadata from search_context_document)"
_Q = "q as (select ('0x' || substr(md5(query_text), 1, 15))::bigint as query_id, query_text from (select distinct title as query_text from documents where trim(title) <> ''))"
_QT = f"qt as (select query_id, unnest({_tok('query_text')}) as term from q)"
_CAND = f"""{_CH}, {_Q}, {_QT},
p as (select unnest({_ix('text')}) as term, chunk_key from ch),
dfq as (select term, count(*) as df from p group by term),
rare as (select query_id, term, row_number() over (partition by query_id order by df, term) as r from qt join dfq using (term) qualify r <= 3),
hits as (select query_id, chunk_key, sum(power(2, r - 1))::int as m from rare join p using (term) group by all),
dep as (select query_id, chunk_key, case when m = 7 then 3 when m & 3 = 3 then 2 when m & 1 = 1 then 1 else 0 end as width from hits),
cand as (select query_id, chunk_key, width from dep where width > 0 qualify width = max(width) over (partition by query_id)),
ft as (select c.query_id, q.query_text, ch.chunk_key, ch.logical_path, ch.chunk_index, ch.chunk_id, ch.text, list_sort(list_intersect({_tok('q.query_text')}, {_tok('ch.text')})) as mt from cand c join ch using (chunk_key) join q using (query_id)),
f as (select * from ft where len(mt) > 0)"""
_INTENT = " + ".join(f"case when list_has_any(bag, [{','.join(repr(w) for w in ws)}]) then {a} else 0.0 end" for a, ws in ranking.INTENT)
_BM25 = f"""{_CAND},
b as (select *, {_bag('text')} as bag from f),
x as (select query_id, chunk_key, term, len(list_filter(bag, lambda y: y = term)) as tf, len(bag) as dl from b join qt using (query_id)),
st as (select query_id, count(*) as n, avg(dl) as avgdl from (select query_id, len(bag) as dl from b) group by 1),
dt as (select query_id, term, count(*) filter (tf > 0) as df from x group by all),
core as (select query_id, chunk_key, sum(case when tf = 0 then 0.0 else ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl)) end) as core from x join st using (query_id) join dt using (query_id, term) group by all),
sc as (select b.*, round(core + ({_INTENT}) + case when contains(lower(text), lower(trim(query_text))) then 1.0 else 0.0 end, 6) as score from b join core using (query_id, chunk_key)),
rk as (select *, row_number() over (partition by query_id order by score desc, chunk_index, logical_path, chunk_key) as rank from sc where score > 0)"""


# Text and chunks


@register(f"with {_CH} select chunk_key, len(t) as n_tokens, array_to_string(list_sort(t), ' ') as tokens from (select chunk_key, {_tok('text')} as t from ch)")
def tokenize_canonical(s, d):
    t = T.tokens("text")
    return chunks(s, d).select("chunk_key", F.size(t).alias("n_tokens"), F.array_join(F.array_sort(t), " ").alias("tokens"))


@register(f"with {_CH} select term, count(*) as occurrences, count(distinct chunk_key) as n_chunks from (select chunk_key, unnest({_bag('text')}) as term from ch) group by term")
def term_frequency(s, d):
    x = chunks(s, d).select("chunk_key", F.explode(T.token_bag("text")).alias("term")).groupBy("term", "chunk_key").agg(F.count(F.lit(1)).alias("n"))
    return x.groupBy("term").agg(F.sum("n").alias("occurrences"), F.count(F.lit(1)).alias("n_chunks"))


@register(f"with {_CH} select chunk_key, len(t) as n_tokens, md5(array_to_string(list_sort(t), ' ')) as digest from (select chunk_key, list_distinct(list_filter(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+'), lambda w: regexp_full_match(w, '[a-z0-9]+'))) as t from ch)")
def mmr_tokens(s, d):
    t = T.diversity_tokens("text")
    return chunks(s, d).select("chunk_key", F.size(t).alias("n_tokens"), F.md5(F.array_join(F.array_sort(t), " ")).alias("digest"))


_NORM = "regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text_content, '\\r\\n|\\r', chr(10), 'g'), '[ \\t]+', ' ', 'g'), '\\n{3,}', chr(10) || chr(10), 'g'), '^[ \\t\\n\\x0B\\f\\r]+', ''), '[ \\t\\n\\x0B\\f\\r]+$', '')"


@register(f"with {_DC} select artifact_id, length(t) as n_chars, md5(t) as digest from (select artifact_id, {_NORM} as t from dc)")
def normalize_text(s, d):
    t = T.normalize("text_content")
    return documents(s, d).select("artifact_id", F.length(t).alias("n_chars"), F.md5(t).alias("digest"))


_PIECES = """pc as (select *, unnest(case when text is null or length(text) = 0 then [] when length(text) <= 2000 then [0] else range(0, ceil((length(text) - 2000) / 1800.0)::int + 1) end) as i from src)"""


@register(f"with {_DC}, src as (select artifact_id, text_content as text from dc), {_PIECES} select artifact_id, i::int as chunk_index, (i * 1800)::int as start_char, least(i * 1800 + 2000, length(text))::int as end_char, substring(text, i * 1800 + 1, 2000) as chunk_text, sha256(substring(text, i * 1800 + 1, 2000)) as text_hash, greatest(1, length(substring(text, i * 1800 + 1, 2000)) // 4)::int as token_estimate from pc")
def chunk_fixed(s, d):
    return chunking.chunk(documents(s, d), "text_content", ("artifact_id",))


_COLLECTION = f"""{_DC}, {_CH}, n as (select artifact_id, count(*) as n from ch group by 1),
m as (select artifact_id, text_content, case when coalesce(metadata.chunking_status = 'REQUIRES_RECHUNK', false) then 'text_content_rechunk' when n is null then 'text_content_fallback' else 'document_chunks' end as mode from dc left join n using (artifact_id)),
src as (select artifact_id, mode, 0 as o, text_content as text from m where mode = 'text_content_rechunk' or (mode = 'text_content_fallback' and regexp_matches(text_content, '[^ \\t\\n\\x0B\\f\\r]'))
  union all select artifact_id, mode, chunk_index, text from m join ch using (artifact_id) where mode = 'document_chunks'), {_PIECES}
select artifact_id, mode, (row_number() over (partition by artifact_id order by o, i) - 1)::int as chunk_index, (i * 1800)::int as start_char, least(i * 1800 + 2000, length(text))::int as end_char, substring(text, i * 1800 + 1, 2000) as chunk_text from pc"""


@register(_COLLECTION)
def chunk_collection(s, d):
    return chunking.chunk_collection(documents(s, d), chunks(s, d))


@register(f"select * from ({_COLLECTION.replace('with ', '') if False else 'with ' + _COLLECTION}) where mode = 'text_content_rechunk'")
def chunk_rechunk(s, d):
    return chunking.chunk_collection(documents(s, d), chunks(s, d)).where(F.col("mode") == "text_content_rechunk")


SQL["chunk_collection"] = "with " + _COLLECTION


@register(f"with {_DC} select artifact_id, logical_path, regexp_extract(lower(logical_path), '([^/]*)$', 1) as name from dc where list_has_any(list_slice(string_split(lower(logical_path), '/'), 1, len(string_split(logical_path, '/')) - 1), ['maildir','inbox','sent','sent_items','_sent_mail','deleted_items','discussion_threads','all_documents']) and regexp_matches(regexp_extract(lower(logical_path), '([^/]*)$', 1), '^[^.]*$|^\\.[^.]*$|\\.$')")
def maildir_filter(s, d):
    return documents(s, d).where(T.is_maildir("logical_path")).select("artifact_id", "logical_path", F.regexp_extract(F.lower("logical_path"), "([^/]*)$", 1).alias("name"))


@register(f"with {_DC} select coalesce(nullif(lower(regexp_extract(logical_path, '\\.([^./]+)$', 1)), ''), 'unknown') as file_type, count(*) as n_documents from dc group by 1")
def file_type_counts(s, d):
    return stats.file_types(documents(s, d))


@register("select artifact_id, source_type from source_artifacts where lower(source_type) in ('docx', 'doc', 'rtf')")
def convertible_filter(s, d):
    return registry.convertible(table(s, d, "source_artifacts")).select("artifact_id", "source_type")


@register(f"with {_Q} select query_id, substring(regexp_replace(trim(regexp_replace(lower(query_text), '\\s+', ' ', 'g')), ' ', '_', 'g'), 1, 80) || '.bm25' as stem, regexp_replace(query_text, '[^A-Za-z0-9._-]+', '_', 'g') as safe_id from q")
def artifact_naming(s, d):
    return titles(s, d).select("query_id", T.safe_stem("query_text", "bm25").alias("stem"), T.safe_id("query_text").alias("safe_id"))


_MAILDIR = "(list_has_any(list_slice(string_split(lower(logical_path), '/'), 1, len(string_split(logical_path, '/')) - 1), ['maildir','inbox','sent','sent_items','_sent_mail','deleted_items','discussion_threads','all_documents']) and regexp_matches(regexp_extract(lower(logical_path), '([^/]*)$', 1), '^[^.]*$|^\\.[^.]*$|\\.$'))"


@register(f"select artifact_id, 'context' as mode from source_artifacts where regexp_matches(lower(logical_path), '\\.(docx|doc|rtf|pdf)$') or {_MAILDIR} union all select artifact_id, 'pdf' from source_artifacts where regexp_matches(lower(logical_path), '\\.(docx|doc|rtf|odt)$')")
def mode_filter(s, d):
    a = table(s, d, "source_artifacts")
    both = [registry.mode_filter(a, m).select("artifact_id", F.lit(m).alias("mode")) for m in ("context", "pdf")]
    return both[0].unionByName(both[1])


@register("select artifact_id, created_utc, coalesce(try_cast(run_id as bigint), -1) as run_no from search_context_document")
def cast_with_default(s, d):
    """Runs that are written in several ways, as numbers."""
    return table(s, d, "search_context_document").select("artifact_id", "created_utc", T.cast_or("run_id", "bigint", -1).alias("run_no"))


@register("select run_id, (date '1970-01-01' + (started_utc // 86400)::int)::varchar as started_on, finished_utc - started_utc as seconds, files_converted as n_converted, greatest(files_converted, files_skipped, files_failed) as most from runs")
def run_times(s, d):
    n = F.create_map(*(x for k in ("converted", "skipped", "failed") for x in (F.lit(k), F.col(f"files_{k}"))))
    r = table(s, d, "runs").withColumn("counts", n)
    return r.select("run_id", T.day("started_utc").cast("string").alias("started_on"), (F.col("finished_utc") - F.col("started_utc")).alias("seconds"), F.col("counts")["converted"].alias("n_converted"), F.array_max(F.map_values("counts")).alias("most"))


# Index


@register(f"with {_CH} select unnest({_ix('text')}) as term, document_hash, logical_path, chunk_index, chunk_id, chunk_key from ch")
def lexical_postings(s, d):
    return lexical.postings(chunks(s, d))


@register(f"with {_CH}, p as (select unnest({_ix('text')}) as term from ch) select count(distinct document_hash) as doc_count, count(*) as chunk_count, (select count(distinct term) from p) as term_count, (select count(*) from p) as posting_count from ch")
def lexical_index_stats(s, d):
    return lexical.index_stats(index(s, d))


@register(f"with {_CH}, p as (select distinct unnest({_ix('text')}) as term from ch) select term, (('0x' || substr(sha256(term), 15, 2))::int % 64)::int as shard from p")
def term_shard(s, d):
    return index(s, d).postings.select("term", F.col("shard").cast("int").alias("shard")).distinct()


@register(f"with {_CAND} select term, count(*) as df, min(chunk_key) as first_chunk from p where term in (select term from qt) group by term")
def postings_lookup(s, d):
    q = lexical.query_terms(titles(s, d)).select("term").distinct()
    return lexical.lookup(q, index(s, d)).groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.min("chunk_key").alias("first_chunk"))


@register(f"with {_CAND} select query_id, chunk_key, width::int as width, array_to_string(mt, ',') as matched_terms from f join cand using (query_id, chunk_key)")
def candidate_retrieval(s, d):
    ix, q = index(s, d), titles(s, d)
    found = materialise(lexical.candidates(q, ix), "found")
    x = lexical.hydrate(found, q, ix).join(found.select("query_id", "chunk_key", "width"), ["query_id", "chunk_key"])
    return x.select("query_id", "chunk_key", "width", F.array_join("matched_terms", ",").alias("matched_terms"))


@register(f"with {_CAND} select query_id, chunk_key from cand join ch using (chunk_key) where lower(regexp_extract(logical_path, '\\.([^./]+)$', 1)) in ('pdf', 'docx')")
def file_type_filter(s, d):
    return lexical.candidates(titles(s, d), index(s, d), allowed=[".PDF", "docx "]).select("query_id", "chunk_key")


@register(f"with {_CAND}, k as (select query_id, coalesce(lower(regexp_extract(logical_path, '\\.([^./]+)$', 1)) in ('pdf', 'docx'), false) as yes from cand join ch using (chunk_key)) select query_id, count(*) filter (yes) as candidate_count, count(*) filter (not yes) as filtered_out_by_file_type from k group by 1")
def file_type_rejected(s, d):
    ix = index(s, d)
    return lexical.filter_counts(lexical.candidates(titles(s, d), ix), ix, [".PDF", "docx "])


@register(f"with {_CH} select chunk_key, source_path from ch where contains(source_path, '/contracts/')")
def source_filter(s, d):
    return registry.from_sources(chunks(s, d), "/contracts/").select("chunk_key", "source_path")


# Queries


@register(f"with {_Q} select query_id, query_text || ' risk issues' as query_text, trim(regexp_replace(lower(query_text || ' risk issues'), '\\s+', ' ', 'g')) || ' risk_management hedging watchlist' as expanded from q")
def query_expansion(s, d):
    q = titles(s, d).withColumn("query_text", F.concat("query_text", F.lit(" risk issues")))
    return q.select("query_id", "query_text", F.element_at(query.expand("query_text"), -1).alias("expanded"))


@register(f"""with {_Q}, r as (select query_id, query_text, case (query_id % 8)::int when 1 then query_text || ' overview' when 2 then query_text || ' 42' when 3 then query_text || ' Report' when 4 then '   ' when 5 then query_text || repeat(' more', 40) when 6 then query_text || ' in summary' else query_text end as rw from q),
a as (select *, list_distinct(regexp_extract_all(lower(query_text), '[a-z0-9_]+')) as x, list_distinct(regexp_extract_all(lower(rw), '[a-z0-9_]+')) as y,
 concat_ws(',', case when query_id % 8 = 7 then 'invalid_rewrite_status' end, case when query_id % 8 = 4 then 'empty_rewritten_query' end, case when length(rw) > 160 then 'rewritten_query_too_long' end, case when query_id % 16 = 8 then 'rewrite_rationale_too_long' end,
 case when query_id % 8 = 2 then 'added_numbers_not_in_original' end, case when query_id % 8 = 3 and not list_contains(regexp_extract_all(query_text, '[A-Z][a-zA-Z]+'), 'Report') then 'added_capitalized_terms_not_in_original' end, case when query_id % 8 = 6 then 'answer_like_output' end) as reasons from r)
select query_id, case when reasons <> '' then query_text else rw end as query_text, case when reasons <> '' then 'FALLBACK_ORIGINAL' else 'OK' end as rewrite_status, reasons <> '' as used_fallback, reasons as rejection_reasons,
 array_to_string(list_sort(case when reasons <> '' then x else list_intersect(x, y) end), ',') as preserved_terms,
 case when reasons <> '' then '' else array_to_string(list_sort(list_filter(y, lambda t: not list_contains(x, t))), ',') end as added_terms,
 case when reasons <> '' then '' else array_to_string(list_sort(list_filter(x, lambda t: not list_contains(y, t))), ',') end as removed_terms from a""")
def rewrite_validate(s, d):
    """Rewrites of all titles, of eight kinds: good ones, and one for each guard."""
    t, kind = F.col("query_text"), F.col("query_id") % 8
    add = {1: " overview", 2: " 42", 3: " Report", 5: " more" * 40, 6: " in summary"}
    rewritten = F.when(kind == 4, "   ")
    for k, v in add.items():
        rewritten = rewritten.when(kind == k, F.concat(t, F.lit(v)))
    long = F.when(F.col("query_id") % 16 == 8, "r" * 161).otherwise("")
    q = titles(s, d).select("query_id", t.alias("original_query"), rewritten.otherwise(t).alias("rewritten_query"), F.when(kind == 7, "DONE").otherwise("OK").alias("rewrite_status"), long.alias("rationale"))
    return query.check_rewrite(q)


_VARIANTS = f"{_Q}, vq as (select query_id, query_text || case when query_id % 2 = 0 then ' risk' else '' end as query_text from q), vr as (select query_id, 0 as variant_ord, 'original' as variant_kind, query_text as variant_text from vq union all select query_id, 1, 'expansion', trim(regexp_replace(lower(query_text), '\\s+', ' ', 'g')) || ' risk_management hedging' from vq where query_id % 2 = 0)"


def _variant_queries(s, d):
    return titles(s, d).withColumn("query_text", F.concat("query_text", F.when(F.col("query_id") % 2 == 0, " risk").otherwise("")))


@register(f"with {_VARIANTS} select v.*, case when variant_kind = 'original' then 1.0 else 0.75 end::double as weight from vr v")
def query_variants(s, d):
    q = _variant_queries(s, d)
    v = query.variants(q).join(q, "query_id")
    return v.select("query_id", "variant_ord", "variant_kind", "variant_text", ranking.variant_weight(F.col("variant_kind"), F.col("variant_text"), F.col("query_text")).alias("weight"))


# Ranking


def _candidates(s, d):
    ix, q = index(s, d), titles(s, d)
    return materialise(lexical.hydrate(lexical.candidates(q, ix), q, ix), "candidates")


@register(f"with {_CAND} select query_id, chunk_key, score, row_number() over (partition by query_id order by score desc, chunk_index, logical_path, chunk_key) as rank from (select *, (len(mt) + case when contains(lower(text), lower(trim(query_text))) then 3 else 0 end)::double as score from f) qualify rank <= 50")
def rank_overlap(s, d):
    return ranking.overlap(_candidates(s, d), 50).select("query_id", "chunk_key", "score", "rank")


@register(f"with {_BM25} select query_id, chunk_key, score, rank from rk where rank <= 100")
def rank_bm25(s, d):
    return ranking.bm25(_candidates(s, d), 100).select("query_id", "chunk_key", "score", "rank")


@register(f"with {_CH} select chunk_key, round({_INTENT}, 6)::double as bonus from (select chunk_key, {_bag('text')} as bag from ch)")
def intent_bonus(s, d):
    return chunks(s, d).select("chunk_key", F.round(ranking.intent_bonus(T.token_bag("text")), 6).alias("bonus"))


_GAP = f"""{_BM25}, rt as (select * from rk where rank <= 100), g as (select *, score >= 0.35 * first_value(score) over (partition by query_id order by rank) as kept from rt),
gk as (select *, sum(kept::int) over (partition by query_id) as nk from g), gap as (select * from gk where case when nk < 3 then rank <= 3 else kept end)"""


@register(f"with {_GAP} select query_id, chunk_key, rank, score from gap")
def score_gap_filter(s, d):
    return ranking.score_gap(ranking.bm25(_candidates(s, d), 100)).select("query_id", "chunk_key", "rank", "score")


_DIV = f"""{_GAP}, dv as (select *, row_number() over (partition by query_id, logical_path order by rank) as occ from gap),
dw as (select *, case occ when 1 then 1.0 when 2 then 0.92 else 0.80 end as w from dv), dr as (select *, score * w as ds, row_number() over (partition by query_id order by score * w desc, rank) as nr from dw)"""


@register(f"with {_DIV} select query_id, chunk_key, occ as source_occurrence, round(ds, 6)::double as diversity_score, nr as rank from dr")
def source_diversity(s, d):
    x = ranking.source_diversity(ranking.score_gap(ranking.bm25(_candidates(s, d), 100)))
    return x.select("query_id", "chunk_key", "source_occurrence", F.round("diversity_score", 6).alias("diversity_score"), "rank")


def _mmr_sql(rows: str, most: int = 5) -> str:
    """The greedy choice, one step after the other: what was chosen so far, how near the others are to it, the best of them."""
    words = "list_distinct(list_filter(regexp_extract_all(lower(coalesce(text, '')), '[\\p{L}\\p{N}_]+'), lambda x: regexp_full_match(x, '[a-z0-9]+')))"
    sql = f"""m0 as (select query_id, chunk_key, logical_path, rank, case when max(score) over (partition by query_id) > 0 then score / max(score) over (partition by query_id) else 0.0 end as rel, {words} as words from {rows} where rank <= 100),
p1 as (select *, 1 as pos, 0.5::double * rel - 0.5::double * 0.0::double as val from m0 qualify row_number() over (partition by query_id order by rank) = 1)"""
    for i in range(2, most + 1):
        sql += f""", n{i - 1} as (select m.query_id, m.chunk_key, case when len(m.words) = 0 or len(c.words) = 0 then 0.0 else len(list_intersect(m.words, c.words)) / len(list_distinct(list_concat(m.words, c.words))) end::double as near, m.logical_path = c.logical_path as same from m0 m join p{i - 1} c using (query_id) where m.chunk_key <> c.chunk_key),
g{i} as (select query_id, chunk_key, max(near) as near, bool_or(same) as same, count(*) as k from ({" union all ".join(f"select * from n{j}" for j in range(1, i))}) group by 1, 2),
p{i} as (select m0.*, {i} as pos, 0.5::double * rel - 0.5::double * near - case when same then 0.2::double else 0.0::double end as val from m0 join g{i} using (query_id, chunk_key) where k = {i - 1} and near < 0.85 qualify row_number() over (partition by query_id order by val desc, rank) = 1)"""
    return sql


@register(f"with {_GAP}, {_mmr_sql('gap')} {' union all '.join(f'select query_id, chunk_key, pos as rank, round(val, 6) as mmr_score from p{i}' for i in range(1, 6))}")
def mmr_rerank(s, d):
    x = ranking.mmr(lexical.add_text(ranking.score_gap(ranking.bm25(_candidates(s, d), 100)), index(s, d)))
    return x.withColumn("mmr_score", F.round("mmr_score", 6))


@register(f"with {_CH}, w as (select chunk_key, artifact_id, chunk_index, list_distinct(list_filter(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+'), lambda x: regexp_full_match(x, '[a-z0-9]+'))) as t from ch) select a.chunk_key, b.chunk_key as next_key, round(case when len(a.t) = 0 or len(b.t) = 0 then 0.0 else len(list_intersect(a.t, b.t)) / len(list_distinct(list_concat(a.t, b.t))) end, 6)::double as jaccard from w a join w b on a.artifact_id = b.artifact_id and b.chunk_index = a.chunk_index + 1")
def jaccard_pairs(s, d):
    w = chunks(s, d).select("chunk_key", "artifact_id", "chunk_index", T.diversity_tokens("text").alias("t"))
    b = w.select(F.col("chunk_key").alias("next_key"), "artifact_id", (F.col("chunk_index") - 1).alias("chunk_index"), F.col("t").alias("u"))
    return w.join(b, ["artifact_id", "chunk_index"]).select("chunk_key", "next_key", F.round(T.jaccard("t", "u"), 6).alias("jaccard"))


_MERGE = f"{_BM25}, o as (select query_id, chunk_key, logical_path, chunk_index, row_number() over (partition by query_id order by sc2 desc, chunk_index, logical_path, chunk_key) as rank, sc2 as score from (select *, (len(mt) + case when contains(lower(text), lower(trim(query_text))) then 3 else 0 end)::double as sc2 from f)), u as (select query_id, chunk_key, rank, score * 1.0 as score, 0 as variant_ord from rk where rank <= 100 union all select query_id, chunk_key, rank, score * 0.75, 1 from o where rank <= 100), best as (select *, min(variant_ord * 1000000 + rank) over (partition by query_id, chunk_key) as seen from u qualify row_number() over (partition by query_id, chunk_key order by score desc, variant_ord, rank) = 1)"


def _merged(s, d):
    c = _candidates(s, d)
    a = ranking.bm25(c, 100).select("query_id", "chunk_key", "rank", "score", F.lit(1.0).alias("weight"), F.lit(0).alias("variant_ord"))
    b = ranking.overlap(c, 100).select("query_id", "chunk_key", "rank", "score", F.lit(0.75).alias("weight"), F.lit(1).alias("variant_ord"))
    return ranking.variant_merge(a.unionByName(b))


@register(f"with {_MERGE} select query_id, chunk_key, round(score, 6)::double as score, variant_ord, row_number() over (partition by query_id order by score desc, seen, chunk_key) as rank from best")
def variant_merge(s, d):
    return _merged(s, d).select("query_id", "chunk_key", F.round("score", 6).alias("score"), "variant_ord", "rank")


@register(f"with {_MERGE}, mr as (select *, row_number() over (partition by query_id order by score desc, seen, chunk_key) as nr from best) select query_id, variant_ord, count(*) as n_rows, max(nr = 1) as top_hit from mr group by all")
def variant_summary(s, d):
    return ranking.variant_summary(_merged(s, d))


# Vectors

_EM = """ez as (select batch_id, embedding_model, embedding_dim, unnest(chunk_keys) as chunk_key, unnest(embeddings) as vector from embedding_vector_batch),
es as (select * from ez where chunk_key is not null and vector is not null and len(vector) > 0),
ev as (select chunk_key, min(vector) as vector from es where len(vector) = embedding_dim and len(list_filter(vector, lambda x: x is null or isnan(x) or isinf(x))) = 0 and len(list_filter(vector, lambda x: x <> 0)) > 0 group by 1)"""
_QV = "qv as (select vec_id as query_id, embedding as v from embeddings where vec_id % 100 = 0)"
_VK = f"{_EM}, {_QV}, vs as (select query_id, chunk_key, round(list_dot_product(list_transform(vector, lambda x: x::double), list_transform(v, lambda x: x::double)) / (sqrt(list_dot_product(list_transform(vector, lambda x: x::double), list_transform(vector, lambda x: x::double))) * sqrt(list_dot_product(list_transform(v, lambda x: x::double), list_transform(v, lambda x: x::double)))), 6) as score from ev, qv where len(v) = len(vector)), vk as (select query_id, chunk_key, row_number() over (partition by query_id order by score desc, chunk_key) as rank, score from vs qualify rank <= 50)"


def _vectors(s, d):
    return vector.valid_vectors(table(s, d, "embedding_vector_batch"))


def _vector_queries(s, d):
    """The batch of query vectors: every one whose id is divisible by 100."""
    return table(s, d, "embeddings").where(F.col("vec_id") % 100 == 0).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))


@register(f"with {_EM} select len(vector)::int as dim, count(*) as n_vectors, count(distinct chunk_key) as n_keys from es group by 1")
def embedding_scan(s, d):
    return vector.scan(table(s, d, "embedding_vector_batch")).groupBy(F.size("vector").alias("dim")).agg(F.count(F.lit(1)).alias("n_vectors"), F.count_distinct("chunk_key").alias("n_keys"))


@register(f"with {_EM} select chunk_key, len(vector)::int as dim, round(sqrt(list_dot_product(list_transform(vector, lambda x: x::double), list_transform(vector, lambda x: x::double))), 6) as norm from ev")
def vector_index_build(s, d):
    return vector.index(table(s, d, "embedding_vector_batch")).select("chunk_key", "dim", F.round("norm", 6).alias("norm"))


@register(f"with {_VK} select query_id, chunk_key, rank, score from vk")
def vector_topk(s, d):
    return vector.top_k(_vector_queries(s, d), _vectors(s, d), 50).select("query_id", "chunk_key", "rank", "score")


_COS = "round(list_dot_product(list_transform({0}, lambda x: x::double), list_transform({1}, lambda x: x::double)) / (sqrt(list_dot_product(list_transform({0}, lambda x: x::double), list_transform({0}, lambda x: x::double))) * sqrt(list_dot_product(list_transform({1}, lambda x: x::double), list_transform({1}, lambda x: x::double)))), 6)"


_FUSED = f"""{_BM25}, {_EM}, lx as (select query_id, chunk_key, logical_path, chunk_index, rank, score from rk where rank <= 100),
fv as (select query_id, vector as v from lx join ev using (chunk_key) qualify row_number() over (partition by query_id order by rank) = 1),
vx as (select query_id, chunk_key, row_number() over (partition by query_id order by score desc, chunk_key) as rank, score from (select query_id, chunk_key, {_COS.format("vector", "v")} as score from ev join fv on len(v) = len(vector)) qualify rank <= 50),
j as (select coalesce(a.query_id, b.query_id) as query_id, coalesce(a.chunk_key, b.chunk_key) as chunk_key, a.score as ls, b.score as vs, a.rank as lr, b.rank as vr from lx a full join vx b on a.query_id = b.query_id and a.chunk_key = b.chunk_key),
jc as (select j.*, ch.logical_path, ch.chunk_index, ch.chunk_id from j join ch using (chunk_key)),
bounds as (select query_id, min(ls) as ll, max(ls) as lh, min(vs) as vl, max(vs) as vh from jc group by 1),
sn as (select jc.*, case when ls is not null and lh > ll then (ls - ll) / (lh - ll) else 0 end::double as ln, case when vh > vl then (coalesce(vs, 0) - vl) / (vh - vl) else 0 end::double as vn from jc join bounds using (query_id) where ls is not null or vs >= 0.6),
o as (select *, case when vs is null then 'lexical_only' when ls is null then 'vector_only' else 'both' end as match_origin,
 round(0.7 * ln + 0.3 * vn, 6) as fusion_score from sn),
fu as (select *, row_number() over (partition by query_id order by fusion_score desc, logical_path desc, chunk_index desc, chunk_key) as rank from o)"""


def _fused(s, d):
    lex = materialise(ranking.bm25(_candidates(s, d), 100), "lexical")
    v = materialise(_vectors(s, d), "vectors")
    near = vector.top_k(retrieval.feedback(lex, v), v, 50).join(index(s, d).chunks.select("chunk_key", "logical_path", "chunk_index"), "chunk_key")
    return ranking.fuse(lex, near)


@register(f"with {_FUSED} select query_id, chunk_key, match_origin, fusion_score, rank from fu")
def hybrid_fusion(s, d):
    """BM25 of the titles fused with vectors. As the titles have no vector here, each asks with that of its first chunk
    that has one (feedback from the lexical list)."""
    return _fused(s, d).select("query_id", "chunk_key", "match_origin", "fusion_score", "rank")


_TRACE = f"""{_FUSED}, fs as (select *, coalesce(ls, vs) as score from fu where rank <= 100), fo as (select * replace (row_number() over (partition by query_id order by score desc, rank, chunk_key) as rank) from fs),
fd as (select *, row_number() over (partition by query_id, logical_path order by rank) as occ from fo where rank <= 20),
fw as (select *, case occ when 1 then 1.0 when 2 then 0.92 else 0.80 end::double as w from fd), ft2 as (select *, score * w as ds, row_number() over (partition by query_id order by score * w desc, rank) as nr from fw)"""


@register(f"""with {_TRACE} select ft2.query_id, nr as final_rank, chunk_key, logical_path, chunk_index, chunk_id, lr as lexical_rank_before_fusion, vr as vector_rank_before_fusion, lr is not null as present_in_lexical, vr is not null as present_in_vector,
lr is not null as seen_in_lexical, vr is not null as seen_in_vector, match_origin, coalesce(ls, 0) as lexical_score, coalesce(vs, 0) as vector_score, round(ln, 6) as lexical_score_normalized, round(vn, 6) as vector_score_normalized, fusion_score as fusion_score_pre_doc_boost, fusion_score as fusion_score_post_doc_boost,
score as pre_diversity_score, round(ds, 6) as final_score_after_diversity, round(ds, 6) as final_score, score as raw_score, 1.0::double as expansion_weight, q.query_text as matched_query, 'original' as query_variant_kind, w as source_diversity_weight, max(occ) over (partition by ft2.query_id, logical_path) as source_occurrence_count from ft2 join q using (query_id)""")
def retrieval_trace(s, d):
    """Fused results in the order of their raw scores after the diversity of sources, with everything that led to their places."""
    x = _fused(s, d).where(F.col("rank") <= 100).withColumn("score", F.coalesce("lexical_score", "vector_score"))
    x = x.withColumnRenamed("rank", "fusion_rank").withColumns({"rank": F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "fusion_rank", "chunk_key")), "raw_score": F.col("score"), "weight": F.lit(1.0), "variant_kind": F.lit("original")})
    x = x.where(F.col("rank") <= 20).join(index(s, d).chunks.select("chunk_key", "chunk_id"), "chunk_key").join(titles(s, d), "query_id")
    t = ranking.full_trace(ranking.source_diversity(x))
    return t.withColumns({c: F.round(c, 6) for c in ("lexical_score_normalized", "vector_score_normalized", "final_score_after_diversity", "final_score")})


@register(f"with {_EM}, {_CH}, a as (select distinct chunk_key from ch), b as (select chunk_key from ev) select count(a.chunk_key) as chunk_count, count(b.chunk_key) as embedding_count, count(*) filter (a.chunk_key is not null and b.chunk_key is not null) as covered, count(*) filter (b.chunk_key is null) as missing, count(*) filter (a.chunk_key is null) as orphaned, round(100.0 * count(*) filter (a.chunk_key is not null and b.chunk_key is not null) / count(a.chunk_key), 6)::double as coverage_pct from a full join b on a.chunk_key = b.chunk_key")
def embedding_coverage(s, d):
    return vector.coverage(chunks(s, d), _vectors(s, d))


@register(f"with {_EM}, {_CH} select chunk_key, text_hash from ch where chunk_key not in (select ev.chunk_key from ev join (select distinct chunk_key from es where embedding_model = 'local-embed-text') using (chunk_key))")
def embedding_pending(s, d):
    b = table(s, d, "embedding_vector_batch")
    c = chunks(s, d)
    done = _vectors(s, d).select("chunk_key").join(vector.scan(b).select("chunk_key", "embedding_model").distinct(), "chunk_key").join(c.select("chunk_key", "text_hash"), "chunk_key")
    return vector.pending(c, done, "local-embed-text")


# Context

_CTX = f"""{_BM25}, t as (select *, not regexp_matches(coalesce(text, ''), '[^ \\t\\n\\x0B\\f\\r]') as blank from rk where rank <= 20),
t1 as (select *, coalesce(sum((not blank)::int) over (partition by query_id, logical_path order by rank rows between unbounded preceding and 1 preceding), 0) >= 2 as capped, '[SOURCE: ' || logical_path || ' | CHUNK: ' || chunk_index || ']' as head, length(trim(text)) as lt from t),
t2 as (select *, sum(case when not blank and not capped then length(logical_path) + length(chunk_index::varchar) + length(score::varchar) + lt + 33 else 0 end) over (partition by query_id order by rank) as total from t1),
t3 as (select *, min(case when not blank and not capped and total > 6000 then rank end) over (partition by query_id) as stop from t2),
t4 as (select *, case when rank > stop then 'beyond' when rank = stop then 'max_context_chars' when capped then 'source_cap' when blank then 'empty_text' else 'included' end as verdict from t3)"""


def _top(s, d):
    return lexical.add_text(ranking.bm25(_candidates(s, d), 20), index(s, d))


@register(f"with {_CTX} select query_id, count(*)::int as n_sources, array_to_string(list(chunk_key order by rank), ',') as chunk_keys from t4 where verdict = 'included' group by 1")
def context_assembly(s, d):
    x = context.judged(_top(s, d)).where(F.col("verdict") == "included")
    g = x.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "chunk_key"))).alias("l"))
    return g.select("query_id", F.size("l").alias("n_sources"), F.array_join(F.transform("l", lambda y: y["chunk_key"].cast("string")), ",").alias("chunk_keys"))


@register(f"with {_CTX} select query_id, rank, chunk_key, verdict as reason from t4 where verdict not in ('included', 'beyond')")
def context_excluded(s, d):
    return context.excluded(_top(s, d))


_LINES = "list_filter(list_transform(regexp_split_to_array(replace(text, chr(65279), ''), '\\r\\n|\\r|\\n'), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> '')"
_SAID = ", ".join("case when " + " or ".join(f"contains(blob, '{t}')" for t in terms) + f" then '{said}' end" for terms, said in context.RULES)


@register(f"""with {_CTX}, ai as (select *, row_number() over (partition by query_id order by rank) as b from t4 where verdict = 'included'),
ev as (select query_id, b, lines, list_filter(lines, lambda x: list_has_any({_ix('x')}, {_ix('query_text')})) as hit from (select *, {_LINES} as lines from ai where b <= 2)),
bl as (select query_id, lower(string_agg(array_to_string(case when len(hit) > 0 then hit[1:3] else lines[1:3] end, ' '), ' ' order by b)) as blob from ev group by 1),
sr as (select query_id, count(*)::int as n, string_agg('- ' || logical_path || ' (chunk ' || chunk_index || ', score=' || score || ')', chr(10) order by rank) as l from ai group by 1)
select query_id, coalesce(nullif(concat_ws(' ', {_SAID}), ''), '{context.OTHERWISE}') || chr(10) || chr(10) || 'Sources used:' || chr(10) || l as answer_text, n as source_count from bl join sr using (query_id)""")
def answer_extract(s, d):
    return context.answer(context.assemble(_top(s, d)))


_Q_RISK = _Q.replace("query_text from (select", "query_text || case when ('0x' || substr(md5(query_text), 1, 15))::bigint % 2 = 0 then ' risk' else '' end as query_text from (select")


_HYBRID = f"""{_EM}, fv as (select query_id, vector as v from hr join ev using (chunk_key) where o = 0 qualify row_number() over (partition by query_id order by rank) = 1),
vx as (select query_id, chunk_key, row_number() over (partition by query_id order by score desc, chunk_key) as rank, score from (select query_id, chunk_key, {_COS.format("vector", "v")} as score from ev join fv on len(v) = len(vector)) qualify rank <= 50),
vo as (select vx.*, o, weight from vx join va using (query_id)),
ju as (select coalesce(a.query_id, b.query_id) as query_id, coalesce(a.o, b.o) as o, coalesce(a.weight, b.weight) as weight, coalesce(a.chunk_key, b.chunk_key) as chunk_key, a.score as ls, b.score as vs from hr a full join vo b on a.query_id = b.query_id and a.o = b.o and a.chunk_key = b.chunk_key),
jb as (select query_id, o, min(ls) as ll, max(ls) as lh, min(vs) as vl, max(vs) as vh from ju group by all),
jf as (select ju.query_id, ju.o, weight, ch.*, coalesce(ls, vs) as score, round(0.7 * case when ls is not null and lh > ll then (ls - ll) / (lh - ll) else 0 end + 0.3 * case when vh > vl then (coalesce(vs, 0) - vl) / (vh - vl) else 0 end, 6) as fusion from ju join jb using (query_id, o) join ch using (chunk_key) where ls is not null or vs >= 0.6),
h2 as (select *, row_number() over (partition by query_id, o order by fusion desc, logical_path desc, chunk_index desc, chunk_key) as rank from jf qualify rank <= 100)"""


def _pipeline_sql(hybrid: bool = False) -> str:
    """Variants of each query ranked by BM25 over the query's candidates (fused with vectors if hybrid), merged; score gap,
    MMR, diversity, context."""
    ranked = "h2" if hybrid else "hr"
    core = "sum(case when tf = 0 then 0.0 else ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl)) end)"
    return f"""{_CAND.replace(_Q, _Q_RISK)},
va as (select query_id, 0 as o, 'original' as kind, query_text as vt, 1.0::double as weight from q union all select query_id, 1, 'expansion', trim(regexp_replace(lower(query_text), '\\s+', ' ', 'g')) || ' risk_management hedging', 0.75 from q where query_id % 2 = 0),
hb as (select c.query_id, o, weight, vt, ch.*, {_bag('ch.text')} as bag, {_tok('vt')} as qt from cand c join va using (query_id) join ch using (chunk_key)),
h as (select *, len(bag) as dl from hb where len(list_intersect(qt, bag)) > 0),
ht as (select query_id, o, chunk_key, dl, term, len(list_filter(bag, lambda y: y = term)) as tf from (select *, unnest(qt) as term from h)),
hs as (select query_id, o, count(*) as n, avg(dl) as avgdl from h group by all),
hd as (select query_id, o, term, count(*) filter (tf > 0) as df from ht group by all),
hc as (select query_id, o, chunk_key, {core} as core from ht join hs using (query_id, o) join hd using (query_id, o, term) group by all),
hx as (select h.*, round(core + ({_INTENT}) + case when contains(lower(text), lower(trim(vt))) then 1.0 else 0.0 end, 6) as score from h join hc using (query_id, o, chunk_key)),
hr as (select *, row_number() over (partition by query_id, o order by score desc, chunk_index, logical_path, chunk_key) as rank from hx where score > 0 qualify rank <= 100),
{_HYBRID + ", " if hybrid else ""}hm as (select * replace (score * weight as score), min(o * 1000 + rank) over (partition by query_id, chunk_key) as seen from {ranked}),
ho as (select * from hm qualify row_number() over (partition by query_id, chunk_key order by score desc, o, rank) = 1),
me as (select * replace (row_number() over (partition by query_id order by score desc, seen, chunk_key) as rank) from ho),
mk as (select *, sum((score >= 0.35 * top)::int) over (partition by query_id) as nk from (select *, first_value(score) over (partition by query_id order by rank) as top from me)),
gap as (select * from mk where case when nk < 3 then rank <= 3 else score >= 0.35 * top end),
{_mmr_sql('gap')},
pk as ({' union all '.join(f'select query_id, chunk_key, pos from p{i}' for i in range(1, 6))}),
sd as (select g.query_id, g.chunk_key, g.logical_path, g.chunk_index, g.text, g.score, pos, case row_number() over (partition by query_id, logical_path order by pos) when 1 then 1.0 when 2 then 0.92 else 0.80 end::double * g.score as ds from gap g join pk using (query_id, chunk_key)),
fr as (select *, row_number() over (partition by query_id order by ds desc, pos) as rank from sd),
f1 as (select *, not regexp_matches(coalesce(text, ''), '[^ \\t\\n\\x0B\\f\\r]') as blank, '[SOURCE: ' || logical_path || ' | CHUNK: ' || chunk_index || ' | SCORE: ' || score || ']' || chr(10) || trim(text) || chr(10) as block from fr),
f2 as (select *, coalesce(sum((not blank)::int) over (partition by query_id, logical_path order by rank rows between unbounded preceding and 1 preceding), 0) >= 1 as capped from f1),
f3 as (select *, sum(case when not blank and not capped then length(block) + 2 else 0 end) over (partition by query_id order by rank) as total from f2),
f4 as (select *, min(case when not blank and not capped and total > 6000 then rank end) over (partition by query_id) as stop from f3),
cx as (select query_id, count(*)::int as n_sources, string_agg(block, chr(10) order by rank) as context_text from f4 where not blank and not capped and (stop is null or rank < stop) group by 1)"""


@register(f"with {_pipeline_sql()} select query_id, query_text, context_text, n_sources, length(context_text)::int as context_chars from cx join q using (query_id)")
def retrieve_end_to_end(s, d):
    """Titles as queries, with variants, score gap, both diversities and the context of each."""
    return retrieval.contexts(_variant_queries(s, d), index(s, d)).drop("sources")


@register(f"with {_pipeline_sql(True)} select query_id, query_text, context_text, n_sources, length(context_text)::int as context_chars from cx join q using (query_id)")
def retrieve_hybrid(s, d):
    """The same with BM25 and vectors fused; each query asks with the vector of its first lexical hit that has one."""
    ix, q = index(s, d), _variant_queries(s, d)
    lex = materialise(ranking.bm25(lexical.hydrate(lexical.candidates(q, ix), q, ix), 100).select("query_id", "chunk_key", "rank"), "lexical")
    v = materialise(_vectors(s, d), "vectors")
    near = materialise(vector.top_k(retrieval.feedback(lex, v), v, 50), "near")
    return retrieval.contexts(q, ix, retrieval.Settings(ranker="hybrid"), near).drop("sources")


# Registries

_ART = "sa as (select artifact_id, physical_path, logical_path, source_type, size_bytes, sha256, first_seen_run_id, last_seen_run_id, is_active, modified_utc from source_artifacts)"
_REG = f"""{_DC}, {_CH}, {_ART},
reg as (select logical_path as source_path, document_hash as source_hash, 'search_context_document' as artifact_type, artifact_id % 40 as run_id, 'documents/' || document_hash || '.json' as artifact_path from dc where artifact_id % 17 <> 0
  union all select distinct logical_path, document_hash, 'search_context_chunks', artifact_id % 40, 'chunks/' || document_hash || '.json' from ch where artifact_id % 19 <> 0),
ov as (select artifact_id, artifact_id * 10 as redacted_artifact_id, 'identity_contact' as profile, coalesce(modified_utc, 0) as created_utc, 'redacted/' || artifact_id || '.json' as override_path from sa where artifact_id % 9 = 0)"""


def _registry(s, d):
    """What earlier runs registered: documents and chunk collections, some of them missing."""
    cols = lambda kind, folder: (F.col("logical_path").alias("source_path"), F.col("document_hash").alias("source_hash"), F.lit(kind).alias("artifact_type"), (F.col("artifact_id") % 40).alias("run_id"), F.concat(F.lit(folder), "document_hash", F.lit(".json")).alias("artifact_path"))
    a = documents(s, d).where(F.col("artifact_id") % 17 != 0).select(*cols(registry.DOCUMENT, "documents/"))
    b = chunks(s, d).where(F.col("artifact_id") % 19 != 0).select(*cols(registry.CHUNKS, "chunks/")).distinct()
    return a.unionByName(b)


def _overrides(s, d):
    x = table(s, d, "source_artifacts").where(F.col("artifact_id") % 9 == 0)
    return x.select("artifact_id", (F.col("artifact_id") * 10).alias("redacted_artifact_id"), F.lit("identity_contact").alias("profile"), F.coalesce("modified_utc", F.lit(0).cast("long")).alias("created_utc"), F.concat(F.lit("redacted/"), F.col("artifact_id").cast("string"), F.lit(".json")).alias("override_path"))


@register(f"with {_ART} select max(artifact_id) as artifact_id, logical_path, sha256 from sa group by all")
def artifact_lookup(s, d):
    return registry.artifact_lookup(table(s, d, "source_artifacts"))


@register("select run_id, status, source_root from runs where status in ('SUCCESS', 'FAILED') order by run_id desc limit 10")
def recent_runs(s, d):
    return registry.recent_runs(table(s, d, "runs"), 10, ("SUCCESS", "FAILED")).select("run_id", "status", "source_root")


@register(f"with {_ART} select first_seen_run_id as run_id, artifact_id, logical_path from sa where first_seen_run_id is not null union select last_seen_run_id, artifact_id, logical_path from sa where last_seen_run_id is not null")
def artifacts_for_run(s, d):
    return registry.artifacts_for_run(table(s, d, "source_artifacts"))


@register(f"with {_REG} select artifact_id, case when exists (select 1 from reg where source_path = logical_path and source_hash = sha256) then 'skip' else 'convert' end as action, case when sha256 is null then 'missing_source_hash' when exists (select 1 from reg where source_path = logical_path and source_hash = sha256) then 'unchanged_already_converted' else 'new_or_changed' end as reason from sa")
def conversion_plan(s, d):
    return registry.conversion_plan(table(s, d, "source_artifacts"), _registry(s, d))


@register(f"""with {_REG}, t as (select source_path, source_hash, count(distinct artifact_type) as n from reg group by all),
x as (select sa.artifact_id, case when ov.artifact_id is not null then 'redaction_override_active' when t.n = 2 then 'unchanged_already_contextualized' else 'new_or_changed_source' end as reason from sa left join t on source_path = logical_path and source_hash = sha256 left join ov using (artifact_id))
select artifact_id, case when reason = 'new_or_changed_source' then 'convert' else 'skip' end as action, reason from x""")
def context_plan(s, d):
    return registry.context_plan(table(s, d, "source_artifacts"), _registry(s, d), _overrides(s, d))


_STATE = f"{_ART}, ls as (select logical_path, arg_max(sha256, artifact_id) as sha256 from (select * from sa where is_active = 1 qualify last_seen_run_id = max(last_seen_run_id) over (partition by logical_path)) group by 1)"


@register(f"with {_STATE} select * from ls")
def latest_state(s, d):
    return registry.latest_state(table(s, d, "source_artifacts"))


@register(f"with {_STATE}, cur as (select distinct logical_path, case when artifact_id % 7 = 0 then sha256(sha256) else sha256 end as sha256 from sa where artifact_id % 13 <> 1) select c.logical_path, case when ls.logical_path is null then 'new' when ls.sha256 = c.sha256 then 'unchanged' else 'changed' end as change from cur c left join ls using (logical_path)")
def delta_detect(s, d):
    a = table(s, d, "source_artifacts")
    now = a.where(F.col("artifact_id") % 13 != 1).select("logical_path", F.when(F.col("artifact_id") % 7 == 0, F.sha2("sha256", 256)).otherwise(F.col("sha256")).alias("sha256")).distinct()
    return registry.delta(registry.latest_state(a), now)


@register(f"with {_ART}, seen as (select distinct logical_path, case when artifact_id % 7 = 0 then sha256(sha256) else sha256 end as sha256, size_bytes + 1 as size_bytes from sa where artifact_id % 3 = 0) select sa.artifact_id, coalesce(sa.logical_path, n.logical_path) as logical_path, coalesce(sa.sha256, n.sha256) as sha256, coalesce(n.size_bytes, sa.size_bytes) as size_bytes, coalesce(first_seen_run_id, case when sa.artifact_id is null or first_seen_run_id is null then 99 end) as first_seen_run_id, case when n.sha256 is not null then 99 else last_seen_run_id end as last_seen_run_id from sa full join seen n on sa.logical_path = n.logical_path and sa.sha256 = n.sha256")
def artifact_upsert(s, d):
    a = table(s, d, "source_artifacts")
    seen = a.where(F.col("artifact_id") % 3 == 0).select("logical_path", F.when(F.col("artifact_id") % 7 == 0, F.sha2("sha256", 256)).otherwise(F.col("sha256")).alias("sha256"), (F.col("size_bytes") + 1).alias("size_bytes"))
    return registry.artifact_upsert(a, seen, 99)


@register(f"with {_REG}, u as (select source_path, artifact_type, source_hash, run_id, 0 as o from reg union all select logical_path, 'search_context_document', sha256, 99, 1 from sa where artifact_id % 3 = 0) select source_path, artifact_type, source_hash, run_id from u qualify row_number() over (partition by source_path, artifact_type order by o desc, run_id desc, source_hash desc) = 1")
def registry_upsert(s, d):
    new = table(s, d, "source_artifacts").where(F.col("artifact_id") % 3 == 0).select(F.col("logical_path").alias("source_path"), F.lit(registry.DOCUMENT).alias("artifact_type"), F.col("sha256").alias("source_hash"), F.lit(99).cast("long").alias("run_id"))
    return registry.registry_upsert(_registry(s, d).drop("artifact_path"), new)


@register(f"with {_REG}, u as (select artifact_id, redacted_artifact_id, profile, created_utc from ov union all select artifact_id, artifact_id * 10 + 1, 'business_sensitive', 1800000000 from sa where artifact_id % 6 = 0) select * from u qualify row_number() over (partition by artifact_id order by created_utc desc, redacted_artifact_id desc) = 1")
def truth_override_upsert(s, d):
    new = table(s, d, "source_artifacts").where(F.col("artifact_id") % 6 == 0).select("artifact_id", (F.col("artifact_id") * 10 + 1).alias("redacted_artifact_id"), F.lit("business_sensitive").alias("profile"), F.lit(1800000000).cast("long").alias("created_utc"))
    return registry.override_upsert(_overrides(s, d).drop("override_path"), new)


_TRUTH = f"""{_REG}, rd as (select * from reg where artifact_type = 'search_context_document'), ex as (select source_path, source_hash, min(artifact_path) as ep from rd group by all), an as (select source_path, min(artifact_path) as ap from rd group by all),
tr as (select sa.artifact_id, case when override_path is not null then 'override' when ep is not null then 'registry_exact' when ap is not null then 'registry_path' else 'none' end as origin, coalesce(override_path, ep, ap) as truth_path from sa left join ov using (artifact_id) left join ex on ex.source_path = logical_path and ex.source_hash = sha256 left join an on an.source_path = logical_path),
seen as (select first_seen_run_id as run_id, artifact_id, logical_path from sa where first_seen_run_id is not null union select last_seen_run_id, artifact_id, logical_path from sa where last_seen_run_id is not null)"""


@register(f"with {_TRUTH} select * from tr")
def active_truth(s, d):
    return registry.active_truth(table(s, d, "source_artifacts"), _overrides(s, d), _registry(s, d))


@register(f"with {_TRUTH} select run_id, status from runs where run_id in (select run_id from seen join tr using (artifact_id) where origin <> 'none') order by run_id desc limit 50")
def redaction_candidate_runs(s, d):
    return registry.candidate_runs(table(s, d, "runs"), table(s, d, "source_artifacts"), _overrides(s, d), _registry(s, d)).select("run_id", "status")


@register(f"with {_TRUTH} select run_id, artifact_id, logical_path, truth_path from seen join tr using (artifact_id) where origin <> 'none'")
def redaction_candidate_artifacts(s, d):
    return registry.candidate_artifacts(table(s, d, "source_artifacts"), _overrides(s, d), _registry(s, d))


@register(f"""with {_TRUTH}, disk as (select logical_path, sha256, 'disk/' || artifact_id || '.json' as p from sa where artifact_id % 2 = 0 union all select logical_path, 'other', 'disk/a' || artifact_id || '.json' from sa where artifact_id % 3 = 0),
de as (select logical_path, sha256, min(p) as dep from disk group by all), dp as (select logical_path, min(p) as dpp from disk group by all)
select tr.artifact_id, case when origin <> 'none' then origin when dep is not null then 'disk_exact' when dpp is not null then 'disk_path' else 'none' end as origin, coalesce(truth_path, dep, dpp) as truth_path from tr join sa using (artifact_id) left join de on de.logical_path = sa.logical_path and de.sha256 = sa.sha256 left join dp on dp.logical_path = sa.logical_path""")
def truth_with_disk(s, d):
    a = table(s, d, "source_artifacts")
    of = lambda k, h, folder: a.where(F.col("artifact_id") % k == 0).select(F.col("logical_path").alias("source_path"), h.alias("source_hash"), F.concat(F.lit(folder), F.col("artifact_id").cast("string"), F.lit(".json")).alias("artifact_path"))
    return registry.active_truth(a, _overrides(s, d), _registry(s, d), of(2, F.col("sha256"), "disk/").unionByName(of(3, F.lit("other"), "disk/a")))


@register("""with n as (select max(run_id) + 1 as id from runs), c as (select count(*) as found, count(*) filter (lower(source_type) in ('docx', 'doc', 'rtf')) as fit from source_artifacts)
select run_id, started_utc, finished_utc, source_root, status, files_discovered, files_eligible, files_converted, files_skipped, files_failed, notes from runs union all select id, 1800000000, 1800000600, '/corpus', case when fit > 100 then 'FAILED' else 'SUCCESS' end, found, fit, fit - 3, 0, 3, 'three failed' from n, c""")
def run_lifecycle(s, d):
    """A run over all artifacts: created, then finalised."""
    a = table(s, d, "source_artifacts")
    found, fit = a.agg(F.count(F.lit(1)), F.count_if(F.lower("source_type").isin("docx", "doc", "rtf"))).first()
    runs, run_id = lifecycle.create_run(table(s, d, "runs"), "/corpus", found, fit, 1_800_000_000)
    return lifecycle.finalize_run(runs, run_id, fit - 3, 3, 1_800_000_600, "FAILED" if fit > 100 else "SUCCESS", "three failed")


@register(f"""with {_REG}, cp as (select artifact_id, case when exists (select 1 from reg where source_path = logical_path and source_hash = sha256) then 'skip' else 'convert' end as action, case when sha256 is null then 'missing_source_hash' when exists (select 1 from reg where source_path = logical_path and source_hash = sha256) then 'unchanged_already_converted' else 'new_or_changed' end as reason, sha256 from sa)
select 99::bigint as run_id, artifact_id, case when artifact_id % 5 = 0 then 'earlier' else action end as decision_type, case when artifact_id % 5 = 0 then 'earlier' else reason end as reason, case when artifact_id % 5 = 0 then null else sha256 end as source_hash, case when artifact_id % 5 = 0 then 1 else 2 end::bigint as created_utc from cp""")
def conversion_decisions(s, d):
    """Decisions of a run that was interrupted after a fifth of them, appended once."""
    a = table(s, d, "source_artifacts")
    new = lifecycle.decisions(registry.conversion_plan(a, _registry(s, d)), a, 99, 2)
    had = a.where(F.col("artifact_id") % 5 == 0).select(F.lit(99).cast("long").alias("run_id"), "artifact_id", F.lit("earlier").alias("decision_type"), F.lit("earlier").alias("reason"), F.lit(None).cast("string").alias("source_hash"), F.lit(1).cast("long").alias("created_utc"))
    return lifecycle.append_once(had, new, ["run_id", "artifact_id"])


@register("select artifact_id, 99::bigint as run_id, case when artifact_id % 10 <> 3 then regexp_replace(regexp_extract(logical_path, '([^/]*)$', 1), '(.)\\.[^.]*$', '\\1') || '__' || substr(sha256(logical_path), 1, 12) || '.pdf' end as output_pdf_path, 'office' as converter_used, case when artifact_id % 10 = 3 then 'FAILED' else 'SUCCESS' end as conversion_status, case when artifact_id % 10 = 3 then 'timeout' end as error_message, 5::bigint as created_utc from source_artifacts where lower(source_type) in ('docx', 'doc', 'rtf')")
def conversion_receipts(s, d):
    done = registry.convertible(table(s, d, "source_artifacts")).select("artifact_id", "logical_path", F.when(F.col("artifact_id") % 10 == 3, "timeout").alias("error_message"))
    return lifecycle.receipts(done, 99, "office", 5)


@register("select run_id, count(*) as n, 'candidate' as kind from (select first_seen_run_id as run_id, artifact_id from source_artifacts where is_active = 1 and first_seen_run_id is not null) group by 1 union all select run_id, 0, 'plain' from runs where status = 'SUCCESS'")
def candidate_fallback(s, d):
    """Candidates where there are some, else the plain list: once each way."""
    a = table(s, d, "source_artifacts").where((F.col("is_active") == 1) & F.col("first_seen_run_id").isNotNull()).groupBy(F.col("first_seen_run_id").alias("run_id")).agg(F.count(F.lit(1)).alias("n")).withColumn("kind", F.lit("candidate"))
    plain = table(s, d, "runs").where("status = 'SUCCESS'").select("run_id", F.lit(0).cast("long").alias("n"), F.lit("plain").alias("kind"))
    return lifecycle.or_else(a, plain).unionByName(lifecycle.or_else(a.where("n < 0"), plain))


@register("select run_id, status, files_converted, files_failed, files_skipped, case when finished_utc is null then 'RUNNING' when files_failed = 0 then 'SUCCESS' else 'FAILED' end as derived_status from runs")
def run_counters(s, d):
    return registry.run_counters(table(s, d, "runs"))


@register("select run_id, json_merge_patch('{}', to_json({files_converted: files_converted, files_discovered: files_discovered, files_eligible: files_eligible, files_failed: files_failed, files_skipped: files_skipped, finished_utc: finished_utc, notes: notes, run_id: run_id, source_root: source_root, started_utc: started_utc, status: status}))::varchar as manifest from runs")
def run_manifest(s, d):
    return files.manifest(table(s, d, "runs"))


@register("select run_id, count(*) as batches, coalesce(sum(written_count), 0)::bigint as written, coalesce(sum(skipped_valid_count), 0)::bigint as skipped, count(*) filter (status is distinct from 'COMPLETE') as failed, case when count(*) filter (status is distinct from 'COMPLETE') > 0 then 'PARTIAL' else 'COMPLETE' end as status from embedding_vector_batch group by run_id")
def batch_totals(s, d):
    return registry.batch_totals(table(s, d, "embedding_vector_batch"))


# Redaction

_SPAN = " union all ".join(
    f"select artifact_id, {i} as rule_order, '{r.category}' as category, '{r.rule_id}' as rule_id, unnest(range(1, len(m) + 1)) as i, m, g from (select artifact_id, regexp_extract_all(text_content, '{r.pattern}') as m, regexp_split_to_array(text_content, '{r.pattern}') as g from dc where length(text_content) > 0)"
    for i, r in enumerate(redaction.PROFILES["identity_contact"])
)
_MONEY = " union all ".join(
    f"select artifact_id, {i} as rule_order, '{r.category}' as category, '{r.rule_id}' as rule_id, unnest(range(1, len(m) + 1)) as i, m, g from (select artifact_id, regexp_extract_all(text_content, '{r.pattern}') as m, regexp_split_to_array(text_content, '{r.pattern}') as g from dc where length(text_content) > 0)"
    for i, r in enumerate(redaction.PROFILES["business_sensitive"])
)


def _spans_sql(parts: str) -> str:
    return f"""{_DC}, rs as ({parts}),
sp as (select artifact_id, rule_order, category, rule_id, m[i] as original, (coalesce(list_sum(list_transform(g[1:i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0))::int as start_char from rs),
so as (select *, start_char + length(original)::int as end_char, row_number() over (partition by artifact_id order by start_char, start_char + length(original), rule_order) as rn from sp)"""


_RESOLVED = _spans_sql(_SPAN) + """, acc as (select artifact_id, rn, end_char from so where rn = 1 union all select so.artifact_id, so.rn, so.end_char from acc a join so on so.artifact_id = a.artifact_id and so.rn > a.rn and so.start_char >= a.end_char qualify row_number() over (partition by so.artifact_id order by so.rn) = 1),
res as (select so.* from so join acc using (artifact_id, rn)),
pl as (select artifact_id, category, original, '[' || category || ']' as replacement, rule_id, row_number() over (partition by artifact_id order by min(start_char), category, rule_id, original)::int as suggestion_no from res group by artifact_id, category, original, rule_id)"""


@register(f"with {_spans_sql(_SPAN)} select artifact_id, start_char, end_char, rule_order, category, rule_id, original from so")
def redaction_spans(s, d):
    return redaction.span_rows(documents(s, d), "identity_contact", False)


@register(f"with {_spans_sql(_MONEY)} select artifact_id, start_char, end_char, rule_order, category, rule_id, original from so")
def redaction_spans_business(s, d):
    return redaction.span_rows(documents(s, d), "business_sensitive", False)


@register(f"with recursive {_RESOLVED} select artifact_id, start_char, end_char, rule_order, category, rule_id, original from res")
def redaction_resolve(s, d):
    return redaction.span_rows(documents(s, d), "identity_contact", True)


def _plan(s, d):
    return redaction.plan(documents(s, d), "identity_contact")


@register(f"with recursive {_RESOLVED} select artifact_id, suggestion_no, category, original, replacement, rule_id from pl")
def redaction_plan(s, d):
    return _plan(s, d)


@register(f"with recursive {_RESOLVED}, cats as (select unnest(['EMAIL', 'PHONE_NUMBER', 'SSN', 'DATE_OF_BIRTH']) as category) select category, count(artifact_id) as n_suggestions, count(distinct artifact_id) as n_artifacts from cats left join pl using (category) group by 1")
def redaction_category_counts(s, d):
    return redaction.category_counts(_plan(s, d), "identity_contact")


_APPLY = _RESOLVED + """, ap as (select artifact_id, 0 as k, text_content as t, 0 as c from dc union all select ap.artifact_id, k + 1, replace(t, p.original, p.replacement), c + contains(t, p.original)::int from ap join pl p on p.artifact_id = ap.artifact_id and p.suggestion_no = ap.k + 1),
done as (select artifact_id, t as redacted_text, c as applied_count from ap qualify k = max(k) over (partition by artifact_id))"""


@register(f"with recursive {_APPLY} select artifact_id, redacted_text, applied_count from done")
def redaction_apply(s, d):
    return redaction.apply(documents(s, d), _plan(s, d))


@register(f"with recursive {_APPLY} select done.artifact_id, dc.source_path, dc.document_hash as source_hash, sha256(redacted_text) as redacted_hash, applied_count, 'identity_contact' as profile, 7::bigint as plan_id, 'REQUIRES_RECHUNK' as chunking_status, case when done.artifact_id % 9 = 0 then done.artifact_id * 10 end as previous_redacted_artifact_id, case when done.artifact_id % 9 = 0 then 'identity_contact' end as previous_profile from done join dc using (artifact_id)")
def redaction_provenance(s, d):
    x = documents(s, d)
    before = x.where(F.col("artifact_id") % 9 == 0).select("artifact_id", (F.col("artifact_id") * 10).alias("redacted_artifact_id"), F.lit("identity_contact").alias("profile"))
    return redaction.provenance(x, redaction.apply(x, _plan(s, d)), before, "identity_contact", 7)


@register(f"with recursive {_APPLY}, src as (select artifact_id, case when done.artifact_id % 9 = 0 then 'override' else 'original' end as origin, case when done.artifact_id % 9 = 0 then redacted_text else text_content end as text from done join dc using (artifact_id)), {_PIECES} select artifact_id, origin, i::int as chunk_index, sha256(substring(text, i * 1800 + 1, 2000)) as text_hash from pc")
def truth_chunks(s, d):
    """Chunks of what counts as each document's text: redacted where an override is active."""
    x = documents(s, d)
    done = redaction.apply(x, _plan(s, d)).where(F.col("artifact_id") % 9 == 0).select("artifact_id", "redacted_text")
    return chunking.chunk(registry.effective_texts(x, done), "text_content", ("artifact_id", "origin")).select("artifact_id", "origin", "chunk_index", "text_hash")


_PLANS = """pn as (select run_id * 10 + p as plan_id, run_id, case when p % 5 = 0 then 'business_sensitive' else 'identity_contact' end as profile, case when run_id % 7 = 0 then 'FAILED' else 'PLANNED' end as status, started_utc + case when p >= 5 then 100 else 0 end as created_utc from runs, (select unnest([0, 1, 5]) as p) where p < 5 or run_id % 5 = 0),
rq as (select plan_id, profile, case when plan_id % 13 = 0 then 'old' else profile || '_v1' end as rv, profile || '_v1' as rh, plan_id % 11 <> 0 as yes from pn union all select 99999, 'identity_contact', 'identity_contact_v1', 'identity_contact_v1', true),
ap0 as (select plan_id, plan_id * 100 as approval_id from pn where plan_id % 2 = 0)"""


def _plans(s, d):
    r = table(s, d, "runs").select("run_id", "started_utc", F.explode(F.array(*map(F.lit, (0, 1, 5)))).alias("p")).where((F.col("p") < 5) | (F.col("run_id") % 5 == 0))
    profile = F.when(F.col("p") % 5 == 0, "business_sensitive").otherwise("identity_contact")
    return r.select((F.col("run_id") * 10 + F.col("p")).alias("plan_id"), "run_id", profile.alias("profile"), F.concat(profile, F.lit("_v1")).alias("ruleset_version"), F.concat(profile, F.lit("_v1")).alias("ruleset_hash"), F.when(F.col("run_id") % 7 == 0, "FAILED").otherwise("PLANNED").alias("status"), (F.col("started_utc") + F.when(F.col("p") >= 5, 100).otherwise(0)).alias("created_utc"))


def _approvals(s, d):
    return _plans(s, d).where(F.col("plan_id") % 2 == 0).select("plan_id", (F.col("plan_id") * 100).alias("approval_id"))


@register(f"with {_PLANS} select rq.plan_id, (reason is null) as allowed, coalesce(reason, 'approved') as reason from (select rq.*, case when not yes then 'yes_commit_missing' when pn.plan_id is null then 'plan_not_found' when rv <> pn.profile || '_v1' then 'ruleset_mismatch' when status <> 'PLANNED' then 'plan_not_planned' when exists (select 1 from pn n where n.run_id = pn.run_id and n.profile = pn.profile and n.created_utc > pn.created_utc) then 'superseded' end as reason from rq left join pn using (plan_id)) rq")
def approval_gate(s, d):
    p = _plans(s, d)
    r = p.select("plan_id", "profile", F.when(F.col("plan_id") % 13 == 0, "old").otherwise(F.col("ruleset_version")).alias("ruleset_version"), "ruleset_hash", (F.col("plan_id") % 11 != 0).alias("yes_commit"))
    unknown = s.createDataFrame([(99999, "identity_contact", "identity_contact_v1", "identity_contact_v1", True)], r.schema)
    return redaction.approval_gate(p, r.unionByName(unknown))


_SUGG = _RESOLVED + f", {_PLANS}, sg as (select (artifact_id % 48 + 1) * 10 + 1 as plan_id, artifact_id, artifact_id * 1000 + suggestion_no as suggestion_id from pl), rdx as (select (artifact_id % 48 + 1) * 10 + 1 as plan_id, artifact_id, artifact_id * 10 as redacted_artifact_id from dc where artifact_id % 4 = 0)"


def _suggestions(s, d):
    return _plan(s, d).select(((F.col("artifact_id") % 48 + 1) * 10 + 1).alias("plan_id"), "artifact_id", (F.col("artifact_id") * 1000 + F.col("suggestion_no")).alias("suggestion_id"))


@register(f"with recursive {_SUGG}, r as (select artifact_id, (artifact_id % 48 + 1) * 10 + artifact_id % 2 as plan_id from dc), x as (select r.*, case when pn.plan_id is null then 'plan_not_found' when status <> 'PLANNED' then 'plan_not_planned' when approval_id is null then 'not_approved' when not exists (select 1 from sg where sg.plan_id = r.plan_id and sg.artifact_id = r.artifact_id) then 'no_suggestions' end as reason from r left join pn using (plan_id) left join ap0 using (plan_id)) select plan_id, artifact_id, reason is null as ok, coalesce(reason, 'ok') as reason from x")
def redaction_guards(s, d):
    r = documents(s, d).select("artifact_id", ((F.col("artifact_id") % 48 + 1) * 10 + F.col("artifact_id") % 2).alias("plan_id"))
    return redaction.guards(_plans(s, d), _approvals(s, d), _suggestions(s, d), r)


@register(f"with recursive {_SUGG} select sg.artifact_id, pn.plan_id, run_id, profile, status, count(suggestion_id) as n_joined, count(distinct suggestion_id) as n_suggestions, max(approval_id) as approval_id, max(redacted_artifact_id) as redacted_artifact_id from pn join sg using (plan_id) left join ap0 using (plan_id) left join rdx on rdx.plan_id = pn.plan_id and rdx.artifact_id = sg.artifact_id group by all")
def plan_history(s, d):
    done = documents(s, d).where(F.col("artifact_id") % 4 == 0).select(((F.col("artifact_id") % 48 + 1) * 10 + 1).alias("plan_id"), "artifact_id", (F.col("artifact_id") * 10).alias("redacted_artifact_id"))
    return redaction.plan_history(_plans(s, d), _suggestions(s, d), _approvals(s, d), done)


@register(f"""with {_PLANS}, rq2 as (select plan_id, plan_id % 17 as approved_utc from pn union all select plan_id, 20 from pn where plan_id % 3 = 0 union all select 99999, 1),
rs2 as (select r.plan_id, r.approved_utc, case when pn.plan_id is null then 'plan_not_found' when status <> 'PLANNED' then 'plan_not_planned' when ap0.plan_id is not null or row_number() over (partition by r.plan_id order by r.approved_utc) > 1 then 'already_approved' else 'RECORDED' end as status from rq2 r left join pn using (plan_id) left join ap0 using (plan_id)),
nn as (select plan_id, row_number() over (order by plan_id) + (select max(approval_id) from ap0) as id from rs2 where status = 'RECORDED')
select rs2.plan_id, status, case when status = 'RECORDED' then id end as approval_id, approved_utc from rs2 left join nn using (plan_id)""")
def approval_record(s, d):
    p = _plans(s, d)
    r = p.select("plan_id", (F.col("plan_id") % 17).alias("approved_utc"))
    again = p.where(F.col("plan_id") % 3 == 0).select("plan_id", F.lit(20).cast("long").alias("approved_utc"))
    unknown = s.createDataFrame([(99999, 1)], "plan_id long, approved_utc long")
    return lifecycle.approve(p, _approvals(s, d), r.unionByName(again).unionByName(unknown))


_COMMIT = f"""{_APPLY}, {_PLANS}, rc as (select artifact_id, (artifact_id % 48 + 1) * 10 as plan_id, case when artifact_id % 11 = 0 then 7 when artifact_id % 13 = 0 then ((artifact_id + 1) % 48 + 1) * 1000 else (artifact_id % 48 + 1) * 1000 end as approval_id from dc),
er as (select rc.artifact_id, rc.plan_id, profile, case when a.plan_id is null then 'approval_not_found' when a.plan_id <> rc.plan_id then 'approval_of_other_plan' when pn.status is distinct from 'PLANNED' then 'plan_not_planned' when rc.artifact_id not in (select artifact_id from pl) then 'artifact_not_in_plan' when redacted_text is null then 'no_text' end as error, redacted_text from rc left join ap0 a using (approval_id) left join pn on pn.plan_id = rc.plan_id left join done using (artifact_id)),
co as (select artifact_id, plan_id, case when error is null then 'COMPLETE' else 'FAILED' end as status, coalesce(error, '') as error, case when error is null then 5000 + row_number() over (partition by error is null order by artifact_id) end as redacted_artifact_id, case when error is null then 'artifact_' || artifact_id || '.plan_' || plan_id || '.' || profile || '.redacted.json' end as artifact_path, case when error is null then sha256(redacted_text) end as artifact_hash, 1800000000::bigint as created_utc from er)"""


def _commits(s, d):
    x, planned = documents(s, d), materialise(_plan(s, d), "plan")
    n = F.col("artifact_id") % 48 + 1
    approval = F.when(F.col("artifact_id") % 11 == 0, 7).when(F.col("artifact_id") % 13 == 0, ((F.col("artifact_id") + 1) % 48 + 1) * 1000).otherwise(n * 1000)
    r = x.select("artifact_id", (n * 10).alias("plan_id"), approval.cast("long").alias("approval_id"), F.lit(1_800_000_000).cast("long").alias("created_utc"))
    return lifecycle.commit(redaction.apply(x, planned), _plans(s, d), _approvals(s, d), planned.select((n * 10).alias("plan_id"), "artifact_id"), r, 5000)


@register(f"with recursive {_COMMIT} select * from co")
def redaction_commit(s, d):
    """All documents of the plans in one batch: commits, and what stopped the others."""
    return _commits(s, d)


@register(f"with recursive {_COMMIT}, {_ART}, u as (select artifact_id, artifact_id * 10 as redacted_artifact_id, 'identity_contact' as profile, coalesce(modified_utc, 0) as created_utc from sa where artifact_id % 9 = 0 union all select artifact_id, redacted_artifact_id, 'identity_contact', created_utc from co where status = 'COMPLETE') select * from u qualify row_number() over (partition by artifact_id order by created_utc desc, redacted_artifact_id desc) = 1")
def commit_overrides(s, d):
    """What is the truth of each artifact after the batch."""
    return registry.override_upsert(_overrides(s, d).drop("override_path"), lifecycle.overrides_of(_commits(s, d), "identity_contact"))


@register(f"with recursive {_COMMIT} select plan_id, count(*) as n_requests, count(*) filter (status = 'COMPLETE') as n_complete, count(*) filter (status = 'FAILED') as n_failed, case when count(*) filter (status = 'FAILED') > 0 then 'PARTIAL' else 'COMPLETE' end as status from co group by 1")
def batch_commit(s, d):
    c = _commits(s, d)
    failed = F.count_if(F.col("status") == "FAILED")
    return c.groupBy("plan_id").agg(F.count(F.lit(1)).alias("n_requests"), F.count_if(F.col("status") == "COMPLETE").alias("n_complete"), failed.alias("n_failed"), F.when(failed > 0, "PARTIAL").otherwise("COMPLETE").alias("status"))


# Statistics

_BLANK = "not regexp_matches(coalesce({}, ''), '[^ \\t\\n\\x0B\\f\\r]')"


@register(f"""with {_EM}, d as (select distinct artifact_id, text_content, title from search_context_document), dn as (select artifact_id, min(case when run_id is null then 0 else 1 end) as r from search_context_document group by 1), {_CH},
dd as (select count(*) as document_count, count(distinct artifact_id) as distinct_documents, count(*) filter ({_BLANK.format('text_content')}) as blank_documents, count(*) filter (title is null) as documents_without_title, coalesce(sum(length(text_content)), 0)::bigint as document_chars from d), rn as (select count(*) filter (r = 0) as documents_without_run from dn),
cc as (select count(*) as chunk_count, count(distinct chunk_id) as distinct_chunk_ids, count(*) filter ({_BLANK.format('text')}) as blank_chunks, count(*) filter (text_hash is null or text_hash = '') as chunks_without_hash, count(distinct artifact_id) as documents_with_chunks, min(length(text))::int as min_chars, max(length(text))::int as max_chars, round(avg(length(text)), 6) as mean_chars, min(coalesce(token_count, round_even(length(text) / 4, 0)::bigint)) as min_tokens, max(coalesce(token_count, round_even(length(text) / 4, 0)::bigint)) as max_tokens, round(avg(coalesce(token_count, round_even(length(text) / 4, 0)::bigint)), 6) as mean_tokens from ch),
vv as (select count(*) as embedding_count, count(distinct chunk_key) as embedded_chunks from ev) select * from dd, rn, cc, vv""")
def corpus_stats(s, d):
    # A document that comes with and without a run counts as one without.
    x = table(s, d, "search_context_document").groupBy("artifact_id").agg(F.first("text_content").alias("text_content"), F.first("title").alias("title"), F.when(F.count("run_id") == F.count(F.lit(1)), "all").alias("run_id"))
    return stats.corpus(x, chunks(s, d), _vectors(s, d))


@register(f"with {_CH}, v as (select 'n_chars' as metric, length(text) as v from ch union all select 'token_count', token_count from ch where token_count is not null), r as (select *, row_number() over (partition by metric order by v) - 1 as i, count(*) over (partition by metric) as n from v) select metric, n, p::double as p, v as value from r, (select unnest([0.0, 0.5, 0.95, 1.0]) as p) where i = round_even((n - 1) * p, 0)")
def char_percentiles(s, d):
    c = chunks(s, d).withColumn("n_chars", F.length("text"))
    return stats.percentiles(c, "n_chars").unionByName(stats.percentiles(c, "token_count"))


@register("select chunk_id, count(*) as copies, count(*) - 1 as excess from search_context_chunk group by 1 having count(*) > 1")
def duplicate_chunk_ids(s, d):
    return stats.duplicates(table(s, d, "search_context_chunk"), "chunk_id")


@register("with x as (select chunk_id, count(*) as n from search_context_chunk group by 1 having count(*) > 1) select count(*) as duplicate_keys, coalesce(sum(n - 1), 0)::bigint as excess, (select array_to_string(list(chunk_id order by chunk_id), '|') from (select chunk_id from x order by chunk_id limit 25)) as examples from x")
def duplicate_summary(s, d):
    return stats.duplicate_summary(table(s, d, "search_context_chunk"), "chunk_id").withColumn("examples", F.array_join("examples", "|"))


@register("select 'search_context_chunk' as dataset, count(*) as n_rows from search_context_chunk union all select 'search_context_document', count(*) from search_context_document union all select 'embedding_vector_batch', count(*) from embedding_vector_batch")
def dataset_summary(s, d):
    return stats.dataset_summary({n: table(s, d, n) for n in ("search_context_chunk", "search_context_document", "embedding_vector_batch")})


@register("select 'empty_text' as error, count(*) as n_rows from search_context_chunk where coalesce(text, '') = '' having count(*) > 0 union all select 'position', count(*) from search_context_chunk where end_char - start_char <> length(text) having count(*) > 0 union all select 'index_beyond_count', count(*) from search_context_chunk where chunk_index >= chunk_count having count(*) > 0 union all select 'text_hash', count(*) from search_context_chunk where coalesce(text_hash, '') = '' having count(*) > 0 union all select 'token_count', count(*) from search_context_chunk where token_count is null having count(*) > 0 union all select 'chunk_index', count(*) from search_context_chunk where chunk_index is null having count(*) > 0")
def validate_chunks(s, d):
    return validation.error_counts(validation.chunks(table(s, d, "search_context_chunk")))


@register("select 'empty_text' as error, count(*) as n_rows from search_context_document where coalesce(text_content, '') = '' having count(*) > 0 union all select 'artifact_type', count(*) from search_context_document where artifact_type is distinct from 'search_context_document' having count(*) > 0")
def validate_documents(s, d):
    return validation.error_counts(validation.documents(table(s, d, "search_context_document")))


@register("with z as (select unnest(embeddings) as v, embedding_dim as d from embedding_vector_batch) select 'empty_vector' as error, count(*) as n_rows from z where v is null or len(v) = 0 having count(*) > 0 union all select 'dimension', count(*) from z where v is not null and len(v) <> d having count(*) > 0 union all select 'not_finite', count(*) from z where len(list_filter(v, lambda x: x is null or isnan(x) or isinf(x))) > 0 having count(*) > 0 union all select 'zero_vector', count(*) from z where len(v) > 0 and len(list_filter(v, lambda x: x <> 0 or x is null)) = 0 having count(*) > 0")
def validate_embeddings(s, d):
    x = table(s, d, "embedding_vector_batch").select(F.explode("embeddings").alias("vector"), "embedding_dim")
    return validation.error_counts(validation.vectors(x))


def _artifact_errors() -> str:
    """For each kind of artifact what ``validate_artifacts`` spoils: the type, all fields with a kind, two values."""
    out = []
    for kind, fields in validation.ARTIFACTS.items():
        spoilt = [("artifact_type", "run_id % 5 = 0"), *((f, "run_id % 7 = 0") for f, want in fields.items() if want)]
        if kind == "query_answer":
            spoilt.append(("source_count", "run_id % 3 = 0 and run_id % 7 <> 0"))
        if kind == "query_eval_run_manifest":
            spoilt = [(f, w + (" or run_id % 4 = 1" if f == "query_set_sha256" else "")) for f, w in spoilt]
        out += [(kind, f, w) for f, w in spoilt]
    rows = " union all ".join(f"select '{k}' as kind, '{f}' as error, count(*) as n_rows from runs where {w}" for k, f, w in out)
    return f"select kind, error, sum(n_rows)::bigint as n_rows from ({rows}) group by all having sum(n_rows) > 0"


@register(_artifact_errors())
def validate_artifacts(s, d):
    """Artifacts of all other kinds, one for each run, some of them spoilt."""
    gone, out = F.col("run_id") % 7 == 0, None
    values = {"int": F.lit(1), "string": F.lit("x"), "boolean": F.lit(True), "struct": F.struct(F.lit(1).alias("v")), "array": F.array(F.lit("x")), "": F.lit("x")}
    for kind, fields in validation.ARTIFACTS.items():
        cols = {f: values[want] if not want else F.when(~gone, values[want]) for f, want in fields.items()}
        if kind == "query_answer":
            cols["source_count"] = F.when(F.col("run_id") % 3 == 0, 2).otherwise(1)
        if kind == "query_eval_run_manifest":
            cols["query_set_sha256"] = F.when(F.col("run_id") % 4 == 1, "").otherwise(cols["query_set_sha256"])
        common = {"artifact_type": F.when(F.col("run_id") % 5 == 0, "other").otherwise(kind), "schema_version": F.lit("v1"), "created_utc": F.col("started_utc"), "producer_expert": F.lit("p"), "run_id": F.col("run_id"), "status": F.lit("COMPLETE")}
        x = table(s, d, "runs").select(*(c.alias(n) for n, c in (common | cols).items()))
        x = validation.error_counts(validation.artifact(x, kind)).select(F.lit(kind).alias("kind"), "error", "n_rows")
        out = x if out is None else out.unionByName(x)
    return out


# Evaluation

_EVAL = f"""{_BM25}, {_DC}, ex as (select distinct query_id, logical_path as source from dc join q on dc.title = q.query_text),
ov50 as (select query_id, chunk_key, logical_path, sc2 as score, row_number() over (partition by query_id order by sc2 desc, chunk_index, logical_path, chunk_key) as rank from (select *, (len(mt) + case when contains(lower(text), lower(trim(query_text))) then 3 else 0 end)::double as sc2 from f) qualify rank <= 50),"""


def _metrics_sql(rows: str, out: str) -> str:
    return f"""{out}b as (select query_id, source, row_number() over (partition by query_id order by rank, source) as place from (select query_id, logical_path as source, rank, score from {rows} where rank <= 50 qualify row_number() over (partition by query_id, logical_path order by score desc, rank) = 1)),
{out}m as (select query_id, count(*) as n_returned, count(ex.source) as n_hits, min(case when ex.source is not null then place end) as first from {out}b left join ex using (query_id, source) group by 1),
{out} as (select query_id, coalesce(n_expected, 0) as n_expected, coalesce(n_returned, 0) as n_returned, coalesce(n_hits, 0) as n_hits, round(coalesce(n_hits, 0) / 10.0, 6)::double as precision_at_k, round(coalesce(n_hits / nullif(n_returned, 0), 0), 6)::double as precision_over_returned, round(coalesce(n_hits / nullif(n_expected, 0), 0), 6)::double as recall, round(coalesce(1.0 / first, 0), 6)::double as reciprocal_rank from (select query_id, count(*) as n_expected from ex group by 1) full join {out}m using (query_id))"""


def _metrics(s, d, ranker):
    q = titles(s, d)
    e = documents(s, d).select(F.col("title").alias("query_text"), F.col("logical_path").alias("source")).join(q, "query_text").select("query_id", "source")
    return evaluation.metrics(ranker(_candidates(s, d), 50).select("query_id", F.col("logical_path").alias("source"), "rank", "score"), e)


@register(f"with {_EVAL} {_metrics_sql('rk', 'me')} select * from me")
def eval_metrics(s, d):
    return _metrics(s, d, ranking.bm25)


@register(f"with {_EVAL} {_metrics_sql('rk', 'me')} select count(*) as n_queries, round(avg(precision_at_k), 6) as mean_precision, round(avg(recall), 6) as mean_recall, round(avg(reciprocal_rank), 6) as mrr, count(*) filter (n_returned = 0) as empty_queries, count(*) filter (n_hits = 0) as queries_without_hit from me")
def eval_summary(s, d):
    return evaluation.summary(_metrics(s, d, ranking.bm25))


@register(f"with {_EVAL} {_metrics_sql('ov50', 'be')}, {_metrics_sql('rk', 'af')} select query_id, be.precision_at_k as before_precision, af.precision_at_k as after_precision, round(af.precision_at_k - be.precision_at_k, 6)::double as delta, case when be.query_id is null then 'ADDED' when af.query_id is null then 'REMOVED' when round(af.precision_at_k - be.precision_at_k, 6) > 0 then 'IMPROVED' when round(af.precision_at_k - be.precision_at_k, 6) < 0 then 'REGRESSED' else 'UNCHANGED' end as status from be full join af using (query_id)")
def eval_compare(s, d):
    return evaluation.compare(_metrics(s, d, ranking.overlap), _metrics(s, d, ranking.bm25))


@register(f"with {_EVAL} b0 as (select query_id, list(distinct logical_path) as l from ov50 group by 1), a0 as (select query_id, list(distinct logical_path) as l from rk where rank <= 50 group by 1) select query_id, array_to_string(list_sort(list_filter(coalesce(a0.l, []), lambda x: not list_contains(coalesce(b0.l, []), x))), '|') as added, array_to_string(list_sort(list_filter(coalesce(b0.l, []), lambda x: not list_contains(coalesce(a0.l, []), x))), '|') as removed from b0 full join a0 using (query_id)")
def eval_source_changes(s, d):
    c = _candidates(s, d)
    a, b = (r(c, 50).select("query_id", F.col("logical_path").alias("source")) for r in (ranking.overlap, ranking.bm25))
    return evaluation.source_changes(a, b).select("query_id", F.array_join("added", "|").alias("added"), F.array_join("removed", "|").alias("removed"))


@register(f"with {_CH} select chunk_key as query_id, contains(lower(text), 'invoice')::int + contains(lower(text), 'contract')::int as good_hits, contains(lower(text), 'confidential')::int as bad_hits from ch")
def pattern_hits(s, d):
    return evaluation.pattern_hits(chunks(s, d).select(F.col("chunk_key").alias("query_id"), "text"), ("invoice", "contract"), ("confidential",))


@register(f"with {_EVAL} {_metrics_sql('rk', 'me')} select query_id, printf('precision@k=%.2f recall@k=%.2f rr=%.2f', precision_at_k, recall, reciprocal_rank) as line from me")
def eval_report(s, d):
    return evaluation.report(_metrics(s, d, ranking.bm25))


# Files: a folder of small ones, made of the tables that don't grow

_EXT = "case n_nationkey % 5 when 0 then 'docx' when 1 then 'PDF' when 2 then 'txt' when 3 then 'rtf' else '' end"
_FILES = f"fs as (select n_nationkey, r_name || '/' || n_name || case when n_nationkey % 5 = 4 then '.' else '.' || {_EXT} end as logical_path, lower({_EXT}) as source_type, repeat(n_name || chr(10), n_nationkey::int + 1) as body from nation join region on n_regionkey = r_regionkey)"


def _folder(s, d) -> str:
    """A file for each nation below a folder for its region, an archive for each region, one archive that can't be read, a
    query set; with times."""
    at = f"{shared_dir(s)}/files-{uuid.uuid4().hex}"
    n = table(s, d, "nation").join(table(s, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "n_name", "r_name").orderBy("n_nationkey").collect()  # 25 rows
    zips: dict[str, tuple[io.BytesIO, zipfile.ZipFile]] = {}
    for r in n:
        ext = ("docx", "PDF", "txt", "rtf", "")[r.n_nationkey % 5]
        body = f"{r.n_name}\n".encode() * (r.n_nationkey + 1)
        files.put(s, f"{at}/in/{r.r_name}/{r.n_name}.{ext}", body, 1_700_000_000 + r.n_nationkey * 60)
        if r.r_name not in zips:
            b = io.BytesIO()
            zips[r.r_name] = b, zipfile.ZipFile(b, "w")
        zips[r.r_name][1].writestr(f"sub/{r.n_name}.{ext or 'bin'}", body)
    for name, (b, z) in zips.items():
        z.close()
        files.put(s, f"{at}/zip/{name}.zip", b.getvalue())
    files.put(s, f"{at}/zip/broken.zip", b"no archive")
    queries = [r.n_name if r.n_nationkey % 2 else {"query": r.n_name, **({"expected_sources": [f"{r.r_name}/{r.n_name}", "x"]} if r.n_nationkey % 4 else {})} for r in n]
    files.put(s, f"{at}/set/queries.json", json.dumps({"dataset": "nations", "top_k": 7, "queries": queries}, indent=1).encode())
    return at


@register(f"with {_FILES} select logical_path, source_type, length(body) as size_bytes, sha256(body) as sha256, 1700000000 + n_nationkey * 60 as modified_utc from fs where source_type in ('docx', 'pdf', 'rtf', '')")
def inventory_scan(s, d):
    return files.inventory(s, f"{_folder(s, d)}/in").select("logical_path", "source_type", "size_bytes", "sha256", "modified_utc")


@register(f"with {_FILES} select sha256(body) as source_hash, length(body) as size_bytes from fs where source_type in ('docx', 'pdf', 'rtf', '')")
def fingerprint(s, d):
    return files.fingerprints(files.inventory(s, f"{_folder(s, d)}/in")).select("source_hash", "size_bytes")


@register(f"with {_FILES} select r_name || '.zip' as logical_path, 'zip' as source_type, null as sha256, 'archive' as origin from region union all select 'broken.zip', 'zip', null, 'archive' union all select split_part(logical_path, '/', 1) || '.zip::sub/' || split_part(logical_path, '/', 2), source_type, sha256(body), 'member' from fs where source_type in ('docx', 'rtf') union all select 'broken.zip', null, null, 'failed'")
def expand_inventory(s, d):
    """Archives, their members, and the archive that can't be read."""
    inv, failed = files.expanded(files.inventory(s, f"{_folder(s, d)}/zip", content=True))
    member = F.col("container_path").isNotNull()
    a = inv.select("logical_path", "source_type", F.when(member, F.col("sha256")).alias("sha256"), F.when(member, "member").otherwise("archive").alias("origin"))
    return a.unionByName(failed.select("logical_path", F.lit(None).cast("string").alias("source_type"), F.lit(None).cast("string").alias("sha256"), F.lit("failed").alias("origin")))


@register(f"with {_FILES} select logical_path from fs order by n_nationkey desc limit 10")
def recent_artifacts(s, d):
    x = files.recent(s, f"{_folder(s, d)}/in", "*", 10)
    return x.select(F.regexp_extract("path", "/in/(.*)$", 1).alias("logical_path"))


@register("select 'nations' as dataset, 'hybrid' as ranker, 7 as top_k, n_nationkey::int as query_no, n_name as query_text, case when n_nationkey % 4 = 2 then r_name || '/' || n_name || '|x' else '' end as expected_sources from nation join region on n_regionkey = r_regionkey")
def query_set(s, d):
    return files.query_set(s, f"{_folder(s, d)}/set").withColumn("expected_sources", F.array_join("expected_sources", "|"))


_STRIP = "regexp_replace(regexp_replace({}, '^[ \\t\\n\\x0B\\f\\r\\x1c-\\x1f\\x{{85}}\\x{{a0}}\\x{{2028}}\\x{{2029}}\\x{{3000}}]+', ''), '[ \\t\\n\\x0B\\f\\r\\x1c-\\x1f\\x{{85}}\\x{{a0}}\\x{{2028}}\\x{{2029}}\\x{{3000}}]+$', '')"
_MAIL = "'Subject: ' || coalesce(trim(title), '') || chr(10) || 'From: ' || artifact_id || '@mail.example' || chr(10) || 'To: ' || chr(10) || 'Date: Mon, 03 Jun 2024 10:00:00 +0000' || chr(10) || chr(10) || text_content"


@register(f"with {_DC} select artifact_id, 'COMPLETE' as status, md5({_STRIP.format(_MAIL)}) as digest, length({_STRIP.format(_MAIL)}) as n_chars from dc where producer_expert = 'EmailToSearchContextExpert' and length(text_content) > 0")
def email_document(s, d):
    """Mails in transfer form (encoded header words, body in base64, every third of several parts) read by the extractor."""
    m = documents(s, d).where((F.col("producer_expert") == "EmailToSearchContextExpert") & (F.length("text_content") > 0))
    coded = lambda c: F.base64(F.encode(c, "UTF-8"))
    subject = F.when(F.trim("title") != "", F.concat(F.lit("Subject: =?utf-8?b?"), coded(F.trim("title")), F.lit("?=\r\n"))).otherwise("")
    head = F.concat(subject, F.lit("From: "), F.col("artifact_id").cast("string"), F.lit("@mail.example\r\nDate: Mon, 03 Jun 2024 10:00:00 +0000\r\nMIME-Version: 1.0\r\n"))
    part = F.concat(F.lit("Content-Type: text/plain; charset=utf-8\r\nContent-Transfer-Encoding: base64\r\n\r\n"), coded("text_content"), F.lit("\r\n"))
    several = F.concat(F.lit('Content-Type: multipart/mixed; boundary="=-=-="\r\n\r\n--=-=-=\r\n'), part, F.lit("\r\n--=-=-=\r\nContent-Type: application/octet-stream\r\n\r\nxyz\r\n--=-=-=--\r\n"))
    raw = F.concat(head, F.when(F.col("artifact_id") % 3 == 0, several).otherwise(part))
    x = files.extract(m.select("artifact_id", "logical_path", F.col("document_hash").alias("sha256"), F.lit("eml").alias("source_type"), F.encode(raw, "UTF-8").alias("content")))
    return x.select("artifact_id", "status", F.md5("text_content").alias("digest"), F.length("text_content").alias("n_chars"))


@register("select n_nationkey as artifact_id, kind as logical_path, case when kind = 'doc' then 'FAILED' else 'COMPLETE' end as status, case when kind <> 'doc' then 'Name ' || n_name || chr(10) || 'Second line – ' || r_name end as text_content from nation join region on n_regionkey = r_regionkey, (select unnest(['docx', 'odt', 'rtf', 'pdf', 'doc']) as kind)")
def extract_office(s, d):
    """Small files of each office kind, made of the tables that don't grow, and their text; a binary one that can't be read."""
    n = table(s, d, "nation").join(table(s, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "n_name", "r_name").collect()  # 25 rows
    rows = [(r.n_nationkey, kind, kind, bytearray(make(f"Name {r.n_name}", f"Second line – {r.r_name}")), "x") for r in n for kind, make in samples.MAKERS.items()]
    x = s.createDataFrame(rows, "artifact_id long, logical_path string, source_type string, content binary, sha256 string")
    return files.extract(x).select("artifact_id", "logical_path", "status", "text_content")


@register(f"with {_CH}, lp as (select document_hash, max(logical_path) as logical_path from ch group by 1) select document_hash, logical_path, chunk_index, chunk_id, md5(text) as digest, text_hash from ch join lp using (document_hash, logical_path)")
def chunk_scan(s, d):
    """Chunk collections written as JSON and read back as rows."""
    at = f"{shared_dir(s)}/collections-{uuid.uuid4().hex}"
    files.write_artifacts(files.collections(chunks(s, d)), at)
    x = files.scan_collections(s, at)
    return x.select("document_hash", "logical_path", "chunk_index", "chunk_id", F.md5("text").alias("digest"), "text_hash")
