"""Oversized texts cut into pieces at natural boundaries (recursive bisection).

A text longer than ``limit`` code points is cut at the strongest boundary near its middle; halves that still
exceed ``limit - overlap`` are cut again. Then each piece but the first is extended to the left by the last
``overlap`` code points of the one before, or by as many as a word start within them allows.

Boundaries, strongest first: paragraph (white space with two line feeds), line, sentence, clause, white space.
White space is space, tab, LF and CR; CR LF is never parted. A stretch without white space that fits a piece is
kept whole, with a shorter overlap; only a stretch longer than ``limit`` is cut inside ("forced").

Defined results: null and empty texts and texts of at most ``limit`` give no piece (``keep_short=True``: one piece
for every text that isn't null or empty). Replayed records, being equal, count once. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import code_points

LEVELS = ("forced", "space", "clause", "sentence", "line", "paragraph")
_FORCED, _SPACE, _CLAUSE, _SENTENCE, _LINE, _PARAGRAPH = range(6)
_END = np.array([ord(c) for c in ".!?…。"], dtype=np.uint32)
_PAUSE = np.array([ord(c) for c in ",;:)–—"], dtype=np.uint32)
_CLOSING = np.array([ord(c) for c in "\"'”’»)]"], dtype=np.uint32)


def boundaries(a: np.ndarray) -> list[np.ndarray]:
    """For each level the sorted cut positions of at least that level; a cut at p parts a[:p] from a[p:]."""
    n = len(a)
    ws = (a == 32) | (a == 9) | (a == 10) | (a == 13)
    after = np.flatnonzero(ws[:-1]) + 1 if n else np.zeros(0, np.int64)
    after = after[~((a[after - 1] == 13) & (a[after] == 10))] if len(after) else after
    starts = np.flatnonzero(ws & ~np.concatenate(([False], ws[:-1])))
    ends = np.flatnonzero(ws & ~np.concatenate((ws[1:], [False]))) + 1
    inner = (ends < n) & (starts > 0)
    starts, ends = starts[inner], ends[inner]
    feeds = np.concatenate(([0], np.cumsum(a == 10)))
    lines = feeds[ends] - feeds[starts]
    last = a[starts - 1]
    before = a[np.maximum(starts - 2, 0)]
    sentence = np.isin(last, _END) | (np.isin(last, _CLOSING) & np.isin(before, _END))
    level = np.where(lines >= 2, _PARAGRAPH, np.where(lines == 1, _LINE, np.where(sentence, _SENTENCE, np.where(np.isin(last, _PAUSE), _CLAUSE, _SPACE))))
    return [after, after, *(ends[level >= k] for k in range(_CLAUSE, _PARAGRAPH + 1))]


def _nearest(p: np.ndarray, lo: int, hi: int, mid: int) -> int | None:
    """The position of p in [lo, hi] that is nearest to mid."""
    i = int(np.searchsorted(p, mid))
    best = None
    for j in (i - 1, i):
        if 0 <= j < len(p) and lo <= p[j] <= hi and (best is None or abs(p[j] - mid) < abs(best - mid)):
            best = int(p[j])
    return best


def cut_positions(a: np.ndarray, limit: int, overlap: int) -> tuple[list[tuple[int, int]], np.ndarray]:
    """The cuts (position, level) in text order, and all natural positions."""
    by_level = boundaries(a)
    natural = by_level[_SPACE]
    cuts: list[tuple[int, int]] = []
    todo = [(0, len(a))]
    while todo:
        lo, hi = todo.pop()
        size = hi - lo
        if size <= limit - overlap or (lo == 0 and size <= limit):
            continue
        mid, reach = (lo + hi) // 2, size // 4
        for level in range(_PARAGRAPH, _FORCED, -1):
            if (at := _nearest(by_level[level], mid - reach, mid + reach, mid)) is not None:
                break
        else:
            level = _SPACE
            at = _nearest(natural, lo + 1, hi - 1, mid)
        if at is None:
            if size <= limit:
                continue
            level, at = _FORCED, mid
            while at > lo + 1 and (0x300 <= a[at] <= 0x36F or 0xFE00 <= a[at] <= 0xFE0F or a[at] == 0x200D or a[at - 1] == 0x200D):
                at -= 1
        cuts.append((at, level))
        todo += [(lo, at), (at, hi)]
    return sorted(cuts), natural


def split_text(text: str, limit: int = 2000, overlap: int = 200) -> list[tuple[int, int, int, str]]:
    """Pieces (start, end, overlap with the one before, level of the cut at its core's start) of one text."""
    if not 0 <= overlap < limit:
        raise ValueError("overlap must be at least 0 and less than limit")
    if not text:
        return []
    if len(text) <= limit:
        return [(0, len(text), 0, "start")]
    cuts, natural = cut_positions(code_points(text), limit, overlap)
    cores = [(0, "start"), *((p, LEVELS[k]) for p, k in cuts)]
    out: list[tuple[int, int, int, str]] = []
    for i, (at, level) in enumerate(cores):
        end = cores[i + 1][0] if i + 1 < len(cores) else len(text)
        start = at
        if i:
            start = max(at - min(overlap, limit - (end - at)), out[-1][0])
            j = int(np.searchsorted(natural, start))
            if j < len(natural) and natural[j] < at:
                start = int(natural[j])
        out.append((start, end, at - start, level))
    return out


_PIECES = "tbl string, record_key long, piece_no int, start_char long, end_char long, overlap_chars int, boundary string"


def split_records(df: DataFrame, limit: int = 2000, overlap: int = 200, with_text: bool = True, keep_short: bool = False) -> DataFrame:
    """Pieces of ``df`` (tbl, record_key, text): one row per piece, with ``piece_text`` if wanted.

    Only texts that must be cut leave the JVM, in one narrow map without a shuffle; the one shuffle at the end
    takes replayed records together.
    """
    if not 0 <= overlap < limit:
        raise ValueError("overlap must be at least 0 and less than limit")
    need = F.length("text") > (0 if keep_short else limit)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols: list[list] = [[] for _ in range(8)]
            for tbl, key, text in zip(*(b.column(k).to_pylist() for k in range(3))):
                for no, (start, end, shared, level) in enumerate(split_text(text, limit, overlap)):
                    for c, v in zip(cols, (tbl, key, no, start, end, shared, level, text[start:end] if with_text else None)):
                        c.append(v)
            types = [pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.string()]
            names = ["tbl", "record_key", "piece_no", "start_char", "end_char", "overlap_chars", "boundary", "piece_text"]
            k = 8 if with_text else 7
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols[:k], types)], names[:k])

    out = df.where(need).select("tbl", "record_key", "text").mapInArrow(run, _PIECES + (", piece_text string" if with_text else ""))
    return out.dropDuplicates(["tbl", "record_key", "piece_no"])


def oversized(df: DataFrame, limit: int = 2000, overlap: int = 200) -> DataFrame:
    """(tbl, record_key, kind): ``oversized`` for each text that was cut, ``forced`` too if a cut met no white space."""
    p = split_records(df, limit, overlap, with_text=False)
    return (
        p.groupBy("tbl", "record_key")
        .agg(F.max((F.col("boundary") == "forced").cast("int")).alias("f"))
        .select("tbl", "record_key", F.explode(F.when(F.col("f") == 1, F.array(F.lit("oversized"), F.lit("forced"))).otherwise(F.array(F.lit("oversized")))).alias("kind"))
    )
