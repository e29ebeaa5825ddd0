"""Embedding and rewrite services behind small interfaces, with offline stand-ins."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Embedder(Protocol):
    dim: int

    def __call__(self, texts: list[str]) -> list[list[float]]: ...


class HashEmbedder:
    """Deterministic vectors of the words of a text, for tests without a service."""

    def __init__(self, dim: int = 64):
        self.dim = dim

    def __call__(self, texts: list[str]) -> list[list[float]]:
        out = []
        for t in texts:
            v = np.zeros(self.dim)
            for w in t.lower().split():
                h = hashlib.blake2b(w.encode(), digest_size=8).digest()
                v[int.from_bytes(h[:4], "big") % self.dim] += 1 if h[4] & 1 else -1
            out.append(v.tolist())
        return out


def _post(url: str, body: dict, timeout: float) -> dict:
    import json
    import urllib.request

    r = urllib.request.Request(url, json.dumps(body).encode(), {"Content-Type": "application/json"})
    with urllib.request.urlopen(r, timeout=timeout) as f:
        out = json.loads(f.read().decode())
    if not isinstance(out, dict):
        raise ValueError("the service gave no object")
    return out


def numeric(v: object) -> bool:
    """Whether a vector of a service is a list of finite numbers and not empty."""
    return isinstance(v, list) and bool(v) and all(isinstance(x, (int, float)) and not isinstance(x, bool) and np.isfinite(x) for x in v)


class HttpEmbedder:
    """An embedding service, by the form of its address: ``/api/embed`` takes a batch as ``input`` and gives ``embeddings``;
    ``/api/embeddings`` takes one text as ``prompt`` and gives ``embedding``; any other is asked for a batch, and text by
    text where it doesn't give one vector for each."""

    def __init__(self, url: str, model: str, dim: int, timeout: float = 120.0):
        self.url, self.model, self.dim, self.timeout = url, model, dim, timeout

    def _batch(self, texts: list[str]) -> list:
        return _post(self.url, {"model": self.model, "input": texts}, self.timeout).get("embeddings") or []

    def _single(self, text: str, field: str = "input") -> list | None:
        r = _post(self.url, {"model": self.model, field: text}, self.timeout)
        return r["embedding"] if r.get("embedding") else (r.get("embeddings") or [None])[0]

    def __call__(self, texts: list[str]) -> list[list[float]]:
        path = self.url.rstrip("/")
        if path.endswith("/api/embeddings"):
            out = [self._single(t, "prompt") for t in texts]
        elif path.endswith("/api/embed"):
            out = self._batch(texts)
        else:
            try:
                out = self._batch(texts)
            except Exception:
                out = []
            if len(out) != len(texts):
                out = [self._single(t) for t in texts]
        if len(out) != len(texts) or not all(map(numeric, out)):
            raise ValueError("the service gave no vector of numbers for some text")
        return out


class HttpRewriter:
    """A language model that rewrites one query as a JSON object; a call that fails raises, and ``rewrites`` falls back."""

    def __init__(self, url: str, model: str, timeout: float = 30.0):
        self.url, self.model, self.timeout = url, model, timeout

    def prompt(self, text: str) -> str:
        return (
            "Turn the search request below into a short query for a document index. Answer with one JSON object and nothing else, with the fields "
            'rewritten_query (at most 160 characters), rewrite_status ("OK") and rewrite_rationale (one short sentence). Keep the meaning; bring in no name, date, '
            f"number or fact that the request lacks, and don't answer it. If it can't be improved, repeat it.\n\nRequest: {text}"
        )

    def __call__(self, text: str) -> dict:
        import json

        r = _post(self.url, {"model": self.model, "prompt": self.prompt(text), "stream": False, "format": "json", "options": {"temperature": 0}}, self.timeout).get("response")
        if not isinstance(r, str) or not r.strip():
            raise ValueError("empty_model_response")
        out = json.loads(r)
        if not isinstance(out, dict):
            raise ValueError("model_output_not_object")
        return out


def healthy(e: Embedder) -> bool:
    """Whether the service gives exactly one vector of numbers for one text."""
    try:
        v = e(["ok"])
    except Exception:
        return False
    return len(v) == 1 and numeric(list(v[0]))


def query_vector(text: str, e: Embedder) -> list[float]:
    """The vector of one query, asked for by the driver."""
    if not text.strip():
        raise ValueError("a query to embed must not be empty")
    return e([text.strip()])[0]


def embed(chunks: DataFrame, embedder: Embedder, model: str, batch: int = 64) -> DataFrame:
    """(chunk_key, text_hash, embedding_model, vector) of chunks (chunk_key, text) that aren't blank, in batches."""
    schema = "chunk_key long, text_hash string, embedding_model string, vector array<float>"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for i in range(0, len(b), batch):
                part = b.iloc[i : i + batch]
                yield pd.DataFrame({"chunk_key": part["chunk_key"], "text_hash": part["text_hash"], "embedding_model": model, "vector": embedder(list(part["text"]))})

    stripped = F.regexp_replace(F.regexp_replace("text", r"^\s+", ""), r"\s+$", "")
    x = chunks.where(F.col("text").rlike(r"\S")).select("chunk_key", F.sha2(stripped, 256).alias("text_hash"), stripped.alias("text"))
    return x.mapInPandas(run, schema)


def rewrites(queries: DataFrame, ask, model: str = "unknown") -> DataFrame:
    """(query_id, original_query, rewritten_query, rewrite_status, rationale): ``ask`` (text -> dict) may fail, which
    gives the original with status FALLBACK_ORIGINAL. The queries are the batch at hand; executors ask."""
    schema = "query_id long, original_query string, rewritten_query string, rewrite_status string, rationale string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for q in b.itertuples(index=False):
                try:
                    r = ask(q.query_text)
                    rows.append((q.query_id, q.query_text, str(r["rewritten_query"]).strip(), str(r.get("rewrite_status", "OK")).strip(), str(r.get("rewrite_rationale", "")).strip()))
                except Exception as e:
                    rows.append((q.query_id, q.query_text, q.query_text, "FALLBACK_ORIGINAL", f"{model}: {e}"[:160]))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in schema.split(", ")])

    return queries.select("query_id", "query_text").mapInPandas(run, schema)
