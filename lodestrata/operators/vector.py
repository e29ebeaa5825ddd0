"""Embedding batches as rows, unit vectors, and the exact nearest neighbours of a batch of query vectors."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def scan(batches: DataFrame) -> DataFrame:
    """(chunk_key, vector, embedding_model, batch_id): every vector that is neither null nor empty."""
    z = F.explode(F.arrays_zip(F.col("chunk_keys").alias("k"), F.col("embeddings").alias("v"))).alias("z")
    x = batches.select("batch_id", "embedding_model", "embedding_dim", z)
    x = x.select(F.col("z.k").alias("chunk_key"), F.col("z.v").alias("vector"), "embedding_model", "embedding_dim", "batch_id")
    return x.where(F.col("chunk_key").isNotNull() & (F.size("vector") > 0))


def is_valid(v: Column | str, dim: Column | int | None = None) -> Column:
    """Not empty, all components finite, some not zero, of length ``dim`` if given."""
    c = F.col(v) if isinstance(v, str) else v
    ok = c.isNotNull() & (F.size(c) > 0) & F.forall(c, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(c, lambda x: x != 0)
    return F.coalesce(ok if dim is None else ok & (F.size(c) == dim), F.lit(False))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def valid_vectors(batches: DataFrame) -> DataFrame:
    """(chunk_key, vector): one valid vector for each key, the least if there were several."""
    x = scan(batches)
    return x.where(is_valid("vector", F.col("embedding_dim"))).groupBy("chunk_key").agg(F.min("vector").alias("vector"))


def index(batches: DataFrame) -> DataFrame:
    """(chunk_key, dim, norm, unit): what is kept to search by inner product."""
    v = valid_vectors(batches)
    n = norm(F.col("vector"))
    return v.select("chunk_key", F.size("vector").alias("dim"), n.alias("norm"), F.transform("vector", lambda x: x / n).alias("unit"))


AT_ONCE = 4096
BLOCK = 16_384


def _units(column: pa.ChunkedArray, dim: int) -> np.ndarray:
    m = column.combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
    return m / np.linalg.norm(m, axis=1, keepdims=True)


def top_k(queries: DataFrame, vectors: DataFrame, k: int = 50, at_once: int = AT_ONCE, block: int = BLOCK) -> DataFrame:
    """(query_id, chunk_key, rank, score): exact cosines of queries (query_id, vector) with all vectors of their length.

    Queries in parts of ``at_once`` and vectors in blocks of ``block`` meet in groups, each of them one matrix product of
    which the k best of a query are kept. A task holds a part and a block; what is ranked afterwards grows with queries and
    blocks. Invalid vectors take no part; ties go to the smaller key.
    """
    side = lambda df, key: df.select(F.col(key).cast("long").alias(key), F.col("vector").cast("array<double>").alias("vector")).where(is_valid("vector"))
    q, v = side(queries, "query_id"), side(vectors, "chunk_key")
    parts, blocks = (max(1, -(-df.count() // n)) for df, n in ((q, at_once), (v, block)))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    mine = lambda key, n: F.pmod(F.xxhash64(key), F.lit(n)).cast("int")
    q = q.select("*", F.size("vector").alias("dim"), mine("query_id", parts).alias("part"), every(blocks).alias("block"))
    v = v.select("*", F.size("vector").alias("dim"), mine("chunk_key", blocks).alias("block"), every(parts).alias("part"))

    def best(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        ids, keys = left["query_id"].to_numpy(), right["chunk_key"].to_numpy()
        out: tuple[list, list, list] = ([np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)])
        if len(ids) and len(keys):
            x, y = (_units(t["vector"], key[0].as_py()) for t in (left, right))
            for lo in range(0, len(ids), 256):
                s = np.round(x[lo : lo + 256] @ y.T, 6)
                cut = np.full(len(s), -2.0) if s.shape[1] <= k else -np.partition(-s, k - 1, axis=1)[:, k - 1]
                r, c = np.nonzero(s >= cut[:, None])
                order = np.lexsort((keys[c], -s[r, c], r))
                r, c = r[order], c[order]
                first = np.arange(len(r)) - np.searchsorted(r, r) < k
                r, c = r[first], c[first]
                out[0].append(ids[lo + r]), out[1].append(keys[c]), out[2].append(s[r, c])
        return pa.table(dict(zip(("query_id", "chunk_key", "score"), map(np.concatenate, out))))

    on = ["dim", "part", "block"]
    x = q.groupBy(*on).cogroup(v.groupBy(*on)).applyInArrow(best, "query_id long, chunk_key long, score double")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_key")
    return x.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "chunk_key", "rank", "score")


def coverage(chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    """Chunks with and without a vector and vectors without a chunk, with the share as a percentage (0 without chunks)."""
    a = chunks.select("chunk_key").distinct().withColumn("c", F.lit(1))
    b = vectors.select("chunk_key").distinct().withColumn("v", F.lit(1))
    n = a.join(b, "chunk_key", "full_outer").agg(
        F.count("c").alias("chunk_count"), F.count("v").alias("embedding_count"),
        F.count_if(F.col("c").isNotNull() & F.col("v").isNotNull()).alias("covered"),
        F.count_if(F.col("v").isNull()).alias("missing"), F.count_if(F.col("c").isNull()).alias("orphaned"),
    )
    return n.withColumn("coverage_pct", F.coalesce(F.round(100.0 * F.col("covered") / F.nullif("chunk_count", F.lit(0)), 6), F.lit(0.0)))


def pending(chunks: DataFrame, done: DataFrame, model: str) -> DataFrame:
    """Chunks (chunk_key, text_hash) that have no valid vector of this text by this model yet."""
    have = done.where(F.col("embedding_model") == model).select("chunk_key", "text_hash")
    return chunks.select("chunk_key", "text_hash").join(have, ["chunk_key", "text_hash"], "left_anti")
