"""Readers and helpers shared by the operators of this subpackage."""

from __future__ import annotations

import functools

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import materialise, shared_dir

__all__ = ["CHUNK", "DOCUMENT", "code_points", "letters", "materialise", "mix64", "powers", "present", "records", "shared_dir", "table"]

DOCUMENT = "document"
CHUNK = "chunk"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(tbl, record_key, text) of both text tables; replayed rows are still in."""
    d = table(spark, sf_dir, "search_context_document").select(
        F.lit(DOCUMENT).alias("tbl"), F.col("artifact_id").alias("record_key"), F.col("text_content").alias("text")
    )
    c = table(spark, sf_dir, "search_context_chunk").select(
        F.lit(CHUNK).alias("tbl"), F.col("chunk_key").alias("record_key"), "text"
    )
    return d.unionByName(c)


def present(c: Column | str) -> Column:
    """Neither null nor empty."""
    c = F.col(c) if isinstance(c, str) else c
    return c.isNotNull() & (F.length(c) > 0)


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


@functools.cache
def letters() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each code point whether it is a letter or digit, its lower case, and whether it is a digit."""
    word, lower, digit = np.zeros(0x110000, bool), np.arange(0x110000, dtype=np.uint32), np.zeros(0x110000, bool)
    for i in range(0x110000):
        if 0xD800 <= i < 0xE000:
            continue
        c = chr(i)
        digit[i] = c.isdecimal()
        if digit[i] or c.isalpha():
            word[i] = True
            lower[i] = ord(c.lower()[0])
    return word, lower, digit


_P = np.uint64(0x9E3779B97F4A7C15)
_P_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


@functools.lru_cache(maxsize=2)
def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse, by which a hash of a stretch follows from sums up to its ends."""
    up, down = np.full(n, _P), np.full(n, _P_INVERSE)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def mix64(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))
