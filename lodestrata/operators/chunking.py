"""Texts cut into pieces of fixed size with overlap, and collections cut anew."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

TARGET, OVERLAP = 2000, 200


def check(target: int, overlap: int) -> None:
    if target <= 0 or not 0 <= overlap < target:
        raise ValueError("target must be positive, overlap at least 0 and less than target")


def piece_count(text: Column, target: int = TARGET, overlap: int = OVERLAP) -> Column:
    n = F.length(text)
    more = F.ceil((n - target) / (target - overlap)).cast("int") + 1
    return F.when(n.isNull() | (n == 0), 0).when(n <= target, 1).otherwise(more)


def pieces(text: Column, target: int = TARGET, overlap: int = OVERLAP) -> Column:
    """Array of (index, start, end, text); empty for null and empty texts."""
    check(target, overlap)
    step = target - overlap
    n = piece_count(text, target, overlap)
    one = lambda i: F.struct(i.alias("index"), (i * step).alias("start"), F.least(i * step + target, F.length(text)).alias("end"), F.substring(text, i * step + 1, F.lit(target)).alias("text"))
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), one)).otherwise(F.array())


def chunk(df: DataFrame, text_col: str = "text", keep: tuple[str, ...] = (), target: int = TARGET, overlap: int = OVERLAP) -> DataFrame:
    """One row per piece: ``keep``, chunk_index, start_char, end_char, chunk_text, text_hash, token_estimate. No shuffle."""
    x = df.select(*keep, F.explode(pieces(F.col(text_col), target, overlap)).alias("p"))
    t = F.col("p.text")
    return x.select(*keep, F.col("p.index").alias("chunk_index"), F.col("p.start").alias("start_char"), F.col("p.end").alias("end_char"), t.alias("chunk_text"), F.sha2(t, 256).alias("text_hash"), T.token_estimate(t).alias("token_estimate"))


def chunk_collection(documents: DataFrame, chunks: DataFrame, target: int = TARGET, overlap: int = OVERLAP) -> DataFrame:
    """(artifact_id, mode, chunk_index, start_char, end_char, chunk_text) by the state of each document.

    ``text_content_rechunk``: metadata.chunking_status asks for it. ``text_content_fallback``: there are no chunks and
    the text isn't blank. ``document_chunks``: every chunk is cut anew; indexes run on over the chunks, positions count
    from the start of the chunk.
    """
    rows = chunks.groupBy("artifact_id").agg(F.count(F.lit(1)).alias("n"))
    d = documents.join(rows, "artifact_id", "left")
    again = F.coalesce(F.col("metadata.chunking_status") == "REQUIRES_RECHUNK", F.lit(False))
    mode = F.when(again, "text_content_rechunk").when(F.col("n").isNull(), "text_content_fallback").otherwise("document_chunks")
    d = d.select("artifact_id", "text_content", mode.alias("mode"))
    whole = d.where((F.col("mode") == "text_content_rechunk") | ((F.col("mode") == "text_content_fallback") & F.col("text_content").rlike(r"\S")))
    a = chunk(whole, "text_content", ("artifact_id", "mode"), target, overlap)
    per = d.where(F.col("mode") == "document_chunks").select("artifact_id", "mode").join(chunks.select("artifact_id", F.col("chunk_index").alias("outer_index"), "text"), "artifact_id")
    b = chunk(per, "text", ("artifact_id", "mode", "outer_index"), target, overlap)
    w = Window.partitionBy("artifact_id").orderBy("outer_index", "chunk_index")
    b = b.withColumn("chunk_index", F.row_number().over(w) - 1).drop("outer_index")
    return a.unionByName(b).select("artifact_id", "mode", "chunk_index", "start_char", "end_char", "chunk_text")
