r"""The whole corpus in ids of a public byte-level BPE.

Method: a table of distinct words. Texts are split into words by the tokenizer's own pattern, each distinct word is encoded
once, and the ids are joined back by position.

1. *Pages.* One narrow pass over the texts cuts them into pages of about ``PAGE`` code points (a longer text is a page of
   its own), splits all words of a page at once, and writes the page's distinct words and, for each position, the number
   of its word on the page.
2. *Words.* The distinct words of all pages are made distinct (by a hash of 64 bits; words that share a hash are noticed
   and hashed anew) and each is encoded once.
3. *Positions.* Ids are joined to the distinct words of each page, so a word moves once for a page, however often it
   stands there; each page then lays them out by its positions.

The splitting follows Unicode's letters, numbers and white space. A text with a character that this Python doesn't know
counts as one word, which the tokenizer splits itself.

Scale: texts never move. Positions move once, as two bytes each; no key has more rows than there are pages.

Defined results: null and empty texts give an empty list; strings that look like special tokens are ordinary text; a
repeated row counts once; a document id that comes with several texts gives a row for each. Other columns are not read.
"""

from __future__ import annotations

import base64
import functools
import os
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import code_points, materialise, mix64, powers

TOKENIZERS = os.environ.get("LODESTRATA_TOKENIZERS", "/opt/tokenizers")
#: Fixed value: the pattern that parts a text before merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: White space of Unicode.
SPACES = (*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
PAGE = 1 << 20
_OTHER, _LETTER, _NUMBER, _SPACE, _UNKNOWN = range(5)


@functools.lru_cache(maxsize=4)
def encoding(path: str):
    """The tokenizer of a rank file, loaded once in each Python worker."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def rank_file(name: str = "byte_bpe_50k", folder: str | None = None) -> str:
    return os.path.join(folder or TOKENIZERS, f"{name}.tiktoken")


def _shipped(spark: SparkSession, path: str) -> str:
    """Gives a rank file to all executors; its name there."""
    spark.sparkContext.addFile(path)
    return os.path.basename(path)


@functools.cache
def _classes() -> np.ndarray:
    kind = np.zeros(0x110000, np.uint8)
    for i in range(0x110000):
        c = unicodedata.category(chr(i))
        kind[i] = _LETTER if c[0] == "L" else _NUMBER if c[0] == "N" else _UNKNOWN if c == "Cn" else _OTHER
    kind[list(SPACES)] = _SPACE
    return kind


def words_of(texts: list[str]) -> tuple[str, np.ndarray, np.ndarray]:
    """All texts as one, where each word starts in it, and the number of words of each text; no text is empty."""
    whole = "".join(texts)
    a = code_points(whole)
    sizes = np.array([len(t) for t in texts])
    begin = np.cumsum(sizes) - sizes
    kind = _classes()[a]
    first = np.zeros(len(a) + 1, bool)  # of a text
    first[begin] = first[-1] = True
    word = first.copy()
    word[1:-1] |= kind[1:] != kind[:-1]
    start = np.flatnonzero(word)[:-1]
    end = np.append(start[1:], len(a))
    more = ~first[end]  # the text goes on
    # White space gives its last character, if it is a space, to what follows; else that is a word of its own.
    at = end[(kind[start] == _SPACE) & more]
    longer = kind[at - 2] == _SPACE
    longer &= (at >= 2) & ~first[at - 1]
    blank = a[at - 1] == 32
    word[at[blank]] = False
    word[at[blank | longer] - 1] = True
    # Contractions: an apostrophe that begins a word and certain letters after it.
    at = np.flatnonzero((a[start] == 39) & (end == start + 1) & more & word[start])
    if len(at):
        s, nxt = start[at], at + 1
        letters = kind[end[at]] == _LETTER
        s, stop = s[letters], end[nxt[letters]]
        pad = np.append(a, [0, 0, 0])
        x, y = pad[s + 1], np.where(s + 2 < stop, pad[s + 2], 0)
        one = np.isin(x, [ord(c) for c in "stmd"])
        two = ((x == ord("r")) | (x == ord("v"))) & (y == ord("e")) | (x == ord("l")) & (y == ord("l"))
        k = np.where(one, 1, np.where(two, 2, 0))
        s, stop, k = s[k > 0], stop[k > 0], k[k > 0]
        word[s + 1] = False
        rest = s + 1 + k
        word[rest[rest < stop]] = True
    for i in np.unique(np.searchsorted(begin, np.flatnonzero(kind == _UNKNOWN), side="right") - 1):
        word[begin[i] + 1 : begin[i] + sizes[i]] = False
    start = np.flatnonzero(word[:-1])
    return whole, start, np.diff(np.append(np.searchsorted(start, begin), len(start)))


def word_hashes(whole: str, start: np.ndarray, seed: int = 0) -> np.ndarray:
    a = code_points(whole)
    up, down = powers(max(PAGE, 1 << (len(a) + 1).bit_length()))
    salt = np.uint64(2 * seed + 1)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix64(a.astype(np.uint64) + salt) * up[: len(a)])))
    return mix64((sums[np.append(start[1:], len(a))] - sums[start]) * down[start])


_PAGES = "page long, doc array<long>, h array<long>, size array<int>, wide boolean, at binary, hash array<long>, word array<string>"


def pages(df: DataFrame, seed: int = 0) -> DataFrame:
    """One row for each page of ``df`` (doc_id, h, text): its documents with the number of words of each, the number of the
    word at each position (in 2 bytes, or in 4 if ``wide``; all low bytes come first), and the distinct words."""

    def part(no: int, docs: pa.Array, hs: pa.Array, texts: list[str]) -> pa.RecordBatch:
        whole, start, size = words_of(texts)
        hashes = word_hashes(whole, start, seed)
        u, some, inverse, n = np.unique(hashes, return_index=True, return_inverse=True, return_counts=True)
        order = np.argsort(-n, kind="stable")  # frequent words get small numbers, which compress well
        rank = np.empty(len(u), np.uint32)
        rank[order] = np.arange(len(u), dtype=np.uint32)
        wide = len(u) > 1 << 16
        at = rank[inverse].astype("<u4" if wide else "<u2")
        planes = np.ascontiguousarray(at.view(np.uint8).reshape(len(at), -1).T).tobytes()
        i = some[order]
        ends = np.append(start[1:], len(whole))[i]
        one = lambda x, kind: pa.array([x], pa.list_(kind))
        columns = [
            pa.array([no], pa.int64()), pa.ListArray.from_arrays(pa.array([0, len(docs)], pa.int32()), docs), pa.ListArray.from_arrays(pa.array([0, len(hs)], pa.int32()), hs), one(size.astype(np.int32), pa.int32()),
            pa.array([wide]), pa.array([planes], pa.binary()), one(u[order].view(np.int64), pa.int64()), one([whole[x:y] for x, y in zip(start[i].tolist(), ends.tolist())], pa.string()),
        ]
        return pa.RecordBatch.from_arrays(columns, ["page", "doc", "h", "size", "wide", "at", "hash", "word"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        no = TaskContext.get().partitionId() << 32
        for b in batches:
            texts = b.column(2).to_pylist()
            lo, size = 0, 0
            for i, t in enumerate(texts):
                size += len(t)
                if size >= PAGE or i + 1 == len(texts) or size + len(texts[i + 1]) > 2 * PAGE:
                    yield part(no, b.column(0)[lo : i + 1], b.column(1)[lo : i + 1], texts[lo : i + 1])
                    lo, size, no = i + 1, 0, no + 1

    return df.select("doc_id", "h", "text").mapInArrow(run, _PAGES)


def encode_words(words: DataFrame, path: str) -> DataFrame:
    """(hash, word) -> (hash, ids); one row for each distinct word comes in."""
    name = _shipped(words.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(SparkFiles.get(name))
        for b in batches:
            ids = [enc.encode_ordinary(w) for w in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.list_(pa.int32()))], ["hash", "ids"])

    return words.select("hash", "word").mapInArrow(run, "hash long, ids array<int>")


def word_table(p: DataFrame, path: str) -> DataFrame | None:
    """(hash, ids) of all distinct words of the pages; None if two words share a hash."""
    w = p.select(F.explode(F.arrays_zip("hash", "word")).alias("z")).select("z.hash", "z.word")
    w = materialise(encode_words(w.groupBy("hash", "word").agg(F.lit(1).alias("one")), path), "words")
    n = w.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("hash").alias("d")).first()
    return w if n["n"] == n["d"] else None


class Encoded:
    """The pages of ``df`` and the table of their words."""

    def __init__(self, df: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = "byte_bpe_50k", folder: str | None = None):
        self.docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
        full = self.docs.where(F.length("text") > 0).withColumn("h", F.xxhash64("text"))
        seed, words = 0, None
        while words is None:
            self.pages = materialise(pages(full, seed), "pages")
            words = word_table(self.pages, rank_file(tokenizer, folder))
            seed += 1
        self.words = words

    def without_text(self) -> DataFrame:
        """(doc_id) of null and of empty texts, each once."""
        none = self.docs.where(F.coalesce(F.length("text"), F.lit(0)) == 0)
        return none.select("doc_id", F.col("text").isNull().alias("null")).distinct().select("doc_id")

    def _again(self) -> DataFrame:
        """(page, again): the places on their pages of rows that were there before."""
        rows = self.pages.select("page", F.posexplode(F.arrays_zip("doc", "h")).alias("i", "z")).select("page", "i", F.col("z.doc").alias("doc"), F.col("z.h").alias("h"))
        where = F.struct("page", "i")
        more = rows.groupBy(F.col("doc").alias("d"), F.col("h").alias("g")).agg(F.min(where).alias("first"), F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
        same = F.col("doc").eqNullSafe(F.col("d")) & (F.col("h") == F.col("g"))
        return rows.join(more, same).where(where != F.col("first")).groupBy("page").agg(F.collect_list("i").alias("again"))

    def _joined(self, value: str) -> DataFrame:
        """The pages with ``value`` of the words joined to their distinct words: a list of (k, value) for each page."""
        v = self.pages.select("page", F.posexplode("hash").alias("k", "hash")).join(self.words.select("hash", F.expr(value).alias("v")), "hash")
        v = v.groupBy("page").agg(F.collect_list(F.struct("k", "v")).alias("dictionary"))
        return self.pages.select("page", "doc", "h", "size", "wide", "at").join(v, "page").join(self._again(), "page", "left").select("doc", "h", "size", "wide", "at", "dictionary", "again")

    def ids(self) -> DataFrame:
        """(doc_id, ids) of all documents."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for r in range(len(b)):
                    doc, _, size, at, k, v, keep = _page(b, r)
                    length = np.diff(v.offsets.to_numpy())
                    begin = np.empty(len(k), np.int64)
                    begin[k] = v.offsets.to_numpy()[:-1] - v.offsets[0].as_py()
                    n = np.empty(len(k), np.int64)
                    n[k] = length
                    out = n[at]
                    to = np.cumsum(out)
                    flat = v.flatten().to_numpy()[np.repeat(begin[at] - (to - out), out) + np.arange(to[-1])]
                    offsets = np.concatenate(([0], to))[np.concatenate(([0], np.cumsum(size)))]
                    lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(flat, pa.int32()))
                    yield pa.RecordBatch.from_arrays([doc.take(keep), lists.take(keep)], ["doc_id", "ids"])

        out = self._joined("ids").mapInArrow(run, "doc_id long, ids array<int>")
        return out.unionByName(self.without_text().withColumn("ids", F.array().cast("array<int>")))

    def counts(self) -> DataFrame:
        """(doc_id, h, n_tokens) of all documents with a text; ``h`` is the hash of the text."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for r in range(len(b)):
                    doc, h, size, at, k, v, keep = _page(b, r)
                    n = np.empty(len(k), np.int64)
                    n[k] = v.to_numpy()
                    total = np.add.reduceat(n[at], np.cumsum(size) - size)
                    yield pa.RecordBatch.from_arrays([doc.take(keep), h.take(keep), pa.array(total).take(keep)], ["doc_id", "h", "n_tokens"])

        return self._joined("size(ids)").mapInArrow(run, "doc_id long, h long, n_tokens long")


def _page(b: pa.RecordBatch, r: int) -> tuple:
    """Documents, hashes, sizes, positions, dictionary (numbers, values) and the rows to keep of one page."""
    doc, h, size = (b.column(i)[r].values for i in range(3))
    raw = np.frombuffer(b.column(4)[r].as_buffer(), np.uint8).reshape(4 if b.column(3)[r].as_py() else 2, -1)
    at = np.zeros(raw.shape[1], np.uint32)
    for i, plane in enumerate(raw):
        at |= plane.astype(np.uint32) << np.uint32(8 * i)
    d = b.column(5)[r].values
    keep = np.ones(len(doc), bool)
    if b.column(6)[r].is_valid:
        keep[b.column(6)[r].values.to_numpy()] = False
    k, v = d.flatten()
    return doc, h, size.to_numpy(), at, k.to_numpy(), v, pa.array(np.flatnonzero(keep))


def encode(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = "byte_bpe_50k", folder: str | None = None) -> DataFrame:
    """(doc_id, ids array<int>), one row per document."""
    return Encoded(df, id_col, text_col, tokenizer, folder).ids()


def token_counts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = "byte_bpe_50k", folder: str | None = None) -> DataFrame:
    """(doc_id, n_tokens), one row per document: as ``encode``, but only lengths move."""
    e = Encoded(df, id_col, text_col, tokenizer, folder)
    return e.counts().select("doc_id", "n_tokens").unionByName(e.without_text().withColumn("n_tokens", F.lit(0).cast("long")))


def piece_table(spark, tokenizer: str = "byte_bpe_50k", folder: str | None = None) -> DataFrame:
    """(id, piece binary) of the tokenizer's vocabulary: fixed size, about 50,000 rows."""
    rows = []
    with open(rank_file(tokenizer, folder), "rb") as f:
        for a, b in map(bytes.split, f):
            rows.append((int(b), bytearray(base64.b64decode(a))))
    return spark.createDataFrame(rows, "id int, piece binary")


def decode(encoded: DataFrame, tokenizer: str = "byte_bpe_50k", folder: str | None = None) -> DataFrame:
    """(doc_id, text) from (doc_id, ids) by a join with the vocabulary; an empty list gives an empty text."""
    pieces = F.broadcast(piece_table(encoded.sparkSession, tokenizer, folder))
    p = encoded.select("doc_id", F.posexplode("ids").alias("pos", "id")).join(pieces, "id")
    g = p.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("pos", F.hex("piece").alias("piece")))).alias("w"))
    g = g.select("doc_id", F.decode(F.unhex(F.array_join(F.transform("w", lambda x: x["piece"]), "")), "UTF-8").alias("text"))
    return encoded.select("doc_id").join(g, "doc_id", "left").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
