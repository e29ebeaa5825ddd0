"""Inverted index on disk, and candidates by intersection of the rarest terms of many queries at once."""

from __future__ import annotations

import os
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..shared import materialise, shared_dir, write_table

WIDTH = 3


def postings(chunks: DataFrame) -> DataFrame:
    """(term, document_hash, logical_path, chunk_index, chunk_id, chunk_key): each term of a chunk once. No shuffle."""
    return chunks.select(F.explode(T.index_tokens("text")).alias("term"), "document_hash", "logical_path", "chunk_index", "chunk_id", "chunk_key")


@dataclass(frozen=True)
class Index:
    """What retrieval reads instead of texts.

    ``postings`` (term, chunk_key, tf, shard) lie in a folder for each shard, sorted by term, so a lookup reads its shards
    and, within them, the row groups that hold its terms. ``terms`` (term, df). ``chunks`` (chunk_key, logical_path,
    source_path, document_hash, chunk_index, chunk_id, text, dl, intent_bonus): texts are read for candidates' phrases and
    for final rows only.
    """

    postings: DataFrame
    terms: DataFrame
    chunks: DataFrame


def _open(spark: SparkSession, at: str) -> Index:
    chunks, terms = (spark.read.parquet(f"{at}/{n}") for n in ("chunks", "terms"))
    key = chunks.schema["chunk_key"].dataType.simpleString()  # an index without postings has no file to tell
    return Index(spark.read.schema(f"term string, chunk_key {key}, tf int, shard int").parquet(f"{at}/postings"), terms, chunks)


def build_index(chunks: DataFrame, at: str) -> Index:
    """Write the index of ``chunks`` below ``at``. A chunk_key counts once; null texts have no terms.

    Texts move once, to make chunks distinct. Postings are counted where they are made and spread over files by shard;
    Spark parts a shard that a frequent term makes too large.
    """
    from .ranking import intent_bonus

    c = chunks.dropDuplicates(["chunk_key"])
    cols = [c for c in ("chunk_key", "logical_path", "source_path", "document_hash", "chunk_index", "chunk_id", "text") if c in chunks.columns]
    counted = F.filter("bag", lambda w: ~w.isin(*T.STOPWORDS))
    c = c.select(*cols, F.coalesce(T.index_bag("text"), F.array().cast("array<string>")).alias("bag"))
    c = write_table(c.select("*", F.size(counted).alias("dl"), intent_bonus(counted).alias("intent_bonus")), f"{at}/chunks")
    p = c.select("chunk_key", F.explode("bag").alias("term")).groupBy("term", "chunk_key").agg(F.count(F.lit(1)).cast("int").alias("tf"))
    p = p.select("*", T.term_shard("term").alias("shard")).hint("rebalance", "shard").sortWithinPartitions("shard", "term", "chunk_key")
    p = write_table(p.select("term", "chunk_key", "tf", "shard"), f"{at}/postings", ("shard",))
    write_table(p.groupBy("term").agg(F.count(F.lit(1)).alias("df")), f"{at}/terms")  # last: an index that has it is complete
    return _open(chunks.sparkSession, at)


def index_of(spark: SparkSession, path: str) -> Index:
    """The index of a table of chunks on disk, built when it is first asked for and again when the table's files change.

    It lies in the shared folder under a name made of the files' paths, sizes and times.
    """
    m = spark.read.parquet(path).select("_metadata.file_path", "_metadata.file_size", "_metadata.file_modification_time").distinct()
    n = m.agg(F.count(F.lit(1)), F.sum(F.xxhash64("file_path", "file_size", "file_modification_time").cast("decimal(38,0)"))).first()
    at = os.path.join(shared_dir(spark), f"lexical-index-{n[0]}-{n[1]}")
    try:
        return _open(spark, at)
    except AnalysisException:
        return build_index(spark.read.parquet(path), at)


def index_stats(index: Index) -> DataFrame:
    t = index.terms.agg(F.count(F.lit(1)).alias("term_count"), F.coalesce(F.sum("df"), F.lit(0)).cast("long").alias("posting_count"))
    c = index.chunks.agg(F.count_distinct("document_hash").alias("doc_count"), F.count(F.lit(1)).alias("chunk_count"))
    return c.join(F.broadcast(t))  # one row each


def query_terms(queries: DataFrame) -> DataFrame:
    """(query_id, term) of queries (query_id, query_text)."""
    return queries.select("query_id", F.explode(T.tokens("query_text")).alias("term"))


def lookup(terms: DataFrame, index: Index) -> DataFrame:
    """Postings of ``terms`` (term, ...): by shard and term, so Spark reads the shards that occur only."""
    t = terms.withColumn("shard", T.term_shard("term"))
    return index.postings.join(t, ["shard", "term"]).drop("shard")


def kinds_of(allowed: list[str]) -> list[str]:
    return sorted({a.strip().lower().removeprefix(".") for a in allowed} - {""})


def candidates(queries: DataFrame, index: Index, width: int = WIDTH, allowed: list[str] | None = None) -> DataFrame:
    """(query_id, chunk_key, width): chunks with all of a query's rarest terms.

    Terms without postings are left out. Of the rarest 3, 2 and 1 terms the first combination that some chunk has counts.
    Each combination has the rarest term, so only its postings are read as a list; the next terms are looked up for those
    chunks, by term and chunk, which parts the list of a frequent term.
    """
    rank = Window.partitionBy("query_id").orderBy("df", "term")
    rare = query_terms(queries).join(index.terms, "term").withColumn("r", F.row_number().over(rank)).where(F.col("r") <= width)
    rare = materialise(rare.select("query_id", "term", "r", T.term_shard("term").alias("shard")), "rare")
    found = index.postings.join(rare.where(F.col("r") == 1), ["shard", "term"]).select("query_id", "chunk_key", F.lit(1).alias("width"))
    for r in range(2, width + 1):
        nxt = rare.where(F.col("r") == r).select("query_id", "shard", "term")
        on = found.join(nxt, "query_id", "left").withColumn("asks", (F.col("width") == r - 1) & F.col("term").isNotNull())
        has = index.postings.select("shard", "term", "chunk_key", F.lit(True).alias("has")).join(nxt.select("shard", "term").distinct(), ["shard", "term"], "left_semi")
        found = on.join(has, ["shard", "term", "chunk_key"], "left").select("query_id", "chunk_key", F.when(F.col("asks") & F.col("has"), r).otherwise(F.col("width")).alias("width"))
    found = materialise(found, "met")
    best = found.join(found.groupBy("query_id").agg(F.max("width").alias("width")), ["query_id", "width"])
    if allowed is not None:
        paths = index.chunks.select("chunk_key", T.file_type("logical_path").alias("kind")).where(F.col("kind").isin(kinds_of(allowed)))
        best = best.join(paths.select("chunk_key"), "chunk_key", "left_semi")
    return best.select("query_id", "chunk_key", F.col("width").cast("int").alias("width"))


def filter_counts(found: DataFrame, index: Index, allowed: list[str]) -> DataFrame:
    """(query_id, candidate_count, filtered_out_by_file_type) of candidates found without a filter."""
    kind = index.chunks.select("chunk_key", T.file_type("logical_path").isin(kinds_of(allowed)).alias("in"))
    x = found.join(kind, "chunk_key")
    kept = F.coalesce("in", F.lit(False))
    return x.groupBy("query_id").agg(F.count_if(kept).alias("candidate_count"), F.count_if(~kept).alias("filtered_out_by_file_type"))


def hydrate(cand: DataFrame, queries: DataFrame, index: Index) -> DataFrame:
    """Candidates (query_id, chunk_key) with what ranking needs, and without their text.

    Adds query_text, place and ids of the chunk, ``matched_terms`` (sorted words of the query that it has) with their
    frequencies ``tfs``, its length ``dl`` in words, ``intent_bonus``, and ``phrase``: whether it holds the whole query.
    Terms and frequencies come from the index, by term and chunk.
    """
    terms = query_terms(queries).withColumn("shard", T.term_shard("term"))
    mine = index.postings.join(terms.select("shard", "term").distinct(), ["shard", "term"], "left_semi")
    hits = cand.join(terms, "query_id").join(mine, ["shard", "term", "chunk_key"]).groupBy("query_id", "chunk_key").agg(F.array_sort(F.collect_list(F.struct("term", "tf"))).alias("hits"))
    of_chunk = index.chunks.select("chunk_key", "logical_path", "document_hash", "chunk_index", "chunk_id", F.lower("text").alias("low"), "dl", "intent_bonus")
    x = hits.join(queries.select("query_id", "query_text"), "query_id").join(of_chunk, "chunk_key")
    phrase = F.col("low").contains(F.lower(F.trim("query_text")))
    return x.select(
        "query_id", "query_text", "chunk_key", "logical_path", "document_hash", "chunk_index", "chunk_id", F.transform("hits", lambda h: h["term"]).alias("matched_terms"),
        F.transform("hits", lambda h: h["tf"]).alias("tfs"), "dl", "intent_bonus", phrase.alias("phrase"),
    )


def add_text(ranked: DataFrame, index: Index) -> DataFrame:
    """The texts of the rows that are left after ranking."""
    return ranked.join(index.chunks.select("chunk_key", "text"), "chunk_key")
