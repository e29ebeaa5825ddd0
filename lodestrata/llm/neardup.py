r"""Records that are edited versions of one another, and their groups.

Two records of one table are linked if the triples of consecutive words that both have are at least ``share`` (0.70) of
the triples that at least one of them has.

Method: Order MinHash. The k-mers are the triples, labelled with their occurrence in the text. For each of ``TABLES``
hash functions the ``MINIMA`` labelled triples with the least hashes, in the order in which they stand in the text, make
a *sketch*. As the links count distinct triples, further occurrences of a triple take the upper sixteenth of the hashes:
they are sampled where a text has little else.

1. Records with the same text are one *class* (copies never meet each other). One pass over the distinct texts makes
   the sketches, a signature (the low byte of the least hash of ``WIDTH`` functions) and the sequence of distinct triples.
2. Classes that have a sketch in common meet in its bucket. There pairs are dropped whose numbers of triples or whose
   signatures are too far apart; a pair to be found is dropped by its signature with a probability of at most ``LOST``.
3. Candidates are verified by banded alignment: the longest chain of common triples that ascends in both texts, within
   the band of diagonals that ``share`` allows. It is a lower bound of what they share, so a chain that reaches
   ``share`` decides. For the rest (moved passages) the exact number of common triples is taken.

A pair at 0.70 has the same sketch in a table with a probability of about 0.34 if its order is kept, so it is missed by
all ``TABLES`` with one of 1 in ten million; passages moved far apart keep the order of fewer minima. What is measured stands in the README.

Scale: sketches are rows of 20 bytes; they are counted with partial aggregation, and only those that several classes
have move on. A bucket over ``BLOCK`` classes is compared in pairs of blocks, each in its own group, so no task holds
more than two blocks; nothing is collected, no bucket is cut, and of a bucket only pairs come out that pass step 2. The
comparisons of a bucket grow with the square of its classes (not of its copies), 64 bytes each. Triples move for
candidates only.

Defined results: null and empty texts and texts with less than three words are in no pair and in no group; replayed
records count once; a null key is ignored.
"""

from __future__ import annotations

import functools
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import CHUNK, DOCUMENT, code_points, letters, materialise, mix64, powers

SHARE = 0.7
TABLES = 40
MINIMA = 3
#: Bytes of a signature.
WIDTH = 64
#: A pair that is to be found is dropped by its signature with at most this probability.
LOST = 1e-4
BLOCK = 2048
#: Each copy is paired with so many records of its class and of each linked class.
SHOWN = 16
_A, _B, _C = (np.uint64(x) for x in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93))
_AT_ONCE = 1 << 19  # code points
_NEAR = 12  # labelled triples of a text that are looked at for its minima, on average


def triples(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all triples of consecutive words, and the text each lies in."""
    word, lower, _ = letters()
    a = code_points("\n".join(texts))
    starts_of = np.concatenate(([0], np.cumsum([len(t) + 1 for t in texts])[:-1])).astype(np.int64)
    up, down = powers(max(_AT_ONCE, 1 << (len(a) + 1).bit_length()))
    w = word[a]
    edge = np.flatnonzero(np.diff(np.concatenate(([False], w, [False])).view(np.int8)))
    start, end = edge[::2], edge[1::2]
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(np.where(w, lower[a] + np.uint32(1), 0).astype(np.uint64) * up[: len(a)])))
    words = mix64((sums[end] - sums[start]) * down[start])
    of = np.searchsorted(starts_of, start, side="right") - 1
    if len(words) < 3:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    t = mix64(words[:-2] * _A + words[1:-1] * _B + words[2:] * _C + np.uint64(1))
    same = of[:-2] == of[2:]
    return t[same], of[:-2][same]


def occurrences(t: np.ndarray, of: np.ndarray) -> np.ndarray:
    """How often each triple was in its text before; ``of`` ascends."""
    key = (of.astype(np.uint64) << np.uint64(44)) | (t >> np.uint64(20))
    order = np.argsort(key)
    same = np.flatnonzero(np.diff(key[order].view(np.int64)) == 0)
    nth = np.zeros(len(t), np.uint64)
    if len(same):
        at = np.unique(np.concatenate((same, same + 1)))
        x = np.sort(order[at])
        x = x[np.argsort(key[x], kind="stable")]
        k = key[x]
        first = np.maximum.accumulate(np.where(np.concatenate(([True], k[1:] != k[:-1])), np.arange(len(x)), 0))
        nth[x] = (np.arange(len(x)) - first).astype(np.uint64)
    return nth


@functools.cache
def _odd(n: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 1 << 63, n, np.uint64) * np.uint64(2) + np.uint64(1)


def sketches(t: np.ndarray, of: np.ndarray, nth: np.ndarray, tables: int = TABLES, minima: int = MINIMA) -> np.ndarray:
    """One row of ``tables`` sketches for each text that has triples, in the order of ``of``."""
    starts = np.flatnonzero(np.concatenate(([True], of[1:] != of[:-1])))
    size = np.diff(np.concatenate((starts, [len(t)])))
    place = np.repeat(np.arange(len(starts)), size)
    label = mix64(t + nth * _C)
    again = nth > 0
    firsts = np.bincount(place[~again], minlength=len(starts))
    top = np.uint64(15) << np.uint64(60)
    near = np.where(firsts <= _NEAR, np.uint64(2**64 - 1), (np.float64(2**63) * 2 * (_NEAR / np.maximum(firsts, _NEAR + 1))).astype(np.uint64))[place]
    out = np.empty((len(starts), tables), np.int64)
    for i, odd in enumerate(_odd(tables, 5)):
        h = label * odd
        h[again] = (h[again] >> np.uint64(4)) | top
        at = np.flatnonzero(h <= near)
        few = np.flatnonzero(np.bincount(place[at], minlength=len(starts)) < np.minimum(minima, size))
        if len(few):
            more = np.concatenate([np.arange(starts[j], starts[j] + size[j]) for j in few])
            at = np.union1d(at, more)
        p = place[at]
        by = np.lexsort((h[at], p))
        p = p[by]
        rank = np.arange(len(p)) - np.searchsorted(p, p)
        chosen = np.sort(at[by[rank < minima]])  # in text order
        p = place[chosen]
        j = np.arange(len(p)) - np.searchsorted(p, p)
        key = np.full(len(starts), i * int(_B) & (1 << 64) - 1, np.uint64)
        for m in range(minima):
            r = j == m
            key[p[r]] = mix64(key[p[r]] * _A + label[chosen[r]] + np.uint64(m))
        out[:, i] = key.view(np.int64)
    return out


def signatures(t: np.ndarray, of: np.ndarray, width: int = WIDTH) -> np.ndarray:
    """A row of ``width`` bytes for each text that has triples: the low bytes of least hashes."""
    starts = np.flatnonzero(np.concatenate(([True], of[1:] != of[:-1])))
    small = (t >> np.uint64(32)).astype(np.uint32)
    out = np.empty((len(starts), width), np.uint8)
    for i, odd in enumerate((_odd(width, 3) >> np.uint64(31)).astype(np.uint32) | np.uint32(1)):
        h = small * odd
        out[:, i] = np.minimum.reduceat(h ^ (h >> np.uint32(15)), starts) & np.uint32(255)
    return out


def _fixed(m: np.ndarray) -> pa.Array:
    offsets = np.arange(len(m) + 1, dtype=np.int32) * m.shape[1]
    return pa.Array.from_buffers(pa.binary(), len(m), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(m))])


def _lists(sizes: np.ndarray, values: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)), pa.array(values, kind))


def sketched(df: DataFrame, tables: int = TABLES) -> DataFrame:
    """(rid, tables, n, keys, signature, seq) of each row of ``df`` (rid, tables, text) that has triples: its sketches, and
    its distinct triples (32 bits of their hashes) in the order of their first occurrences."""

    def part(rid: pa.Array, bits: pa.Array, texts: list[str]) -> pa.RecordBatch | None:
        t, of = triples(texts)
        if not len(t):
            return None
        nth = occurrences(t, of)
        has = pa.array(np.unique(of))
        keys = sketches(t, of, nth, tables)
        first = nth == 0
        t, of = t[first], of[first]
        n = np.bincount(of, minlength=len(texts))[has.to_numpy()]
        seq = (t >> np.uint64(20)).astype(np.uint32).view(np.int32)
        columns = [rid.take(has), bits.take(has), pa.array(n.astype(np.int32)), _lists(np.full(len(n), tables), keys.ravel(), pa.int64()), _fixed(signatures(t, of)), _lists(n, seq, pa.int32())]
        return pa.RecordBatch.from_arrays(columns, ["rid", "tables", "n", "keys", "signature", "seq"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(2).to_pylist()
            lo, size = 0, 0
            for i, t in enumerate(texts):
                size += len(t) + 1
                if size >= _AT_ONCE or i + 1 == len(texts):
                    out = part(b.column(0)[lo : i + 1], b.column(1)[lo : i + 1], texts[lo : i + 1])
                    if out is not None:
                        yield out
                    lo, size = i + 1, 0

    return df.select("rid", "tables", "text").mapInArrow(run, "rid long, tables int, n int, keys array<long>, signature binary, seq array<int>")


@functools.cache
def least_equal(share: float = SHARE, width: int = WIDTH, lost: float = LOST) -> int:
    """How many bytes of two signatures are equal at least, but for a probability of ``lost``, if the texts share ``share``."""
    i = np.arange(width + 1)
    log = np.concatenate(([0.0], np.cumsum(np.log(np.arange(1, width + 1)))))
    p = np.exp(log[width] - log[i] - log[width - i] + i * np.log(share) + (width - i) * np.log1p(-share))
    return int(np.searchsorted(np.cumsum(p), lost, side="right"))


def met(rows: DataFrame, share: float = SHARE, lost: float = LOST) -> DataFrame:
    """(a, b), a < b: the pairs of classes that meet in a group of ``rows`` (g, half, rid, meta, signature), are in one
    table, and aren't too far apart in number of triples or in signature. ``half`` is -1 where all pairs of a group count,
    else only those of different halves do."""
    need = least_equal(share, lost=lost)

    def pairs(g, half, rid, meta, sig) -> pa.RecordBatch:
        bits, n = meta & 3, meta >> 2
        out: list[tuple[np.ndarray, np.ndarray]] = []
        at, d = np.arange(len(g)), 0
        while len(at):  # rows that are d places apart
            d += 1
            at = at[at + d < len(g)]
            at = at[g[at] == g[at + d]]
            i, j = at, at + d
            fits = ((bits[i] & bits[j]) != 0) & (np.minimum(n[i], n[j]) >= share * np.maximum(n[i], n[j]) - 1e-9) & ((half[i] < 0) | (half[i] != half[j]))
            i, j = i[fits], j[fits]
            close = (sig[i] == sig[j]).sum(axis=1) >= need
            out.append((rid[i[close]], rid[j[close]]))
        x, y = (np.concatenate([o[k] for o in out]) for k in (0, 1))
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_: list[tuple] = []  # rows of the group that isn't complete
        for b in batches:
            if not len(b):
                continue
            sig = b.column(4)
            lo, hi = (int(x) for x in np.frombuffer(sig.buffers()[1], np.int32)[[sig.offset, sig.offset + len(b)]])
            now = (*(b.column(i).to_numpy() for i in range(4)), np.frombuffer(sig.buffers()[2], np.uint8)[lo:hi].reshape(len(b), -1))
            if open_ and now[0][0] == now[0][-1] == open_[0][0][0]:
                open_.append(tuple(x.copy() for x in now))
                continue
            held = [*open_, now]
            now = tuple(np.concatenate(x) for x in zip(*held))
            other = np.flatnonzero(now[0] != now[0][-1])
            end = int(other[-1]) + 1 if len(other) else 0
            open_ = [tuple(x[end:].copy() for x in now)]
            if end:
                yield pairs(*(x[:end] for x in now))
        if open_:
            yield pairs(*(np.concatenate(x) for x in zip(*open_)))

    return rows.repartition("g").sortWithinPartitions("g").select("g", "half", "rid", "meta", "signature").mapInArrow(run, "a long, b long")


def candidates(classes: DataFrame, share: float = SHARE, block: int = BLOCK, lost: float = LOST) -> DataFrame:
    """(a, b): pairs of classes (rid, tables, n, keys, signature) that have a sketch in common and pass ``met``; with
    ``lost`` = 0 signatures drop none."""
    rows = classes.select("rid", F.explode("keys").alias("k"))
    df = rows.groupBy("k").agg(F.count(F.lit(1)).alias("df")).where(F.col("df") > 1)
    meta = F.shiftleft(F.col("n").cast("long"), 2).bitwiseOR(F.col("tables").cast("long")).alias("meta")
    rows = rows.join(df, "k").join(classes.select("rid", meta, "signature"), "rid")
    blocks = F.ceil(F.col("df") / block)
    mine = F.pmod(F.xxhash64("rid", "k"), blocks)
    every = F.transform(F.sequence(F.lit(0).cast("long"), blocks - 1), lambda o: F.struct(F.least(mine, o).alias("x"), F.greatest(mine, o).alias("y"), F.when(mine == o, -1).when(mine < o, 0).otherwise(1).alias("half")))
    x = rows.select("k", "rid", "meta", "signature", F.explode(every).alias("r"))
    return met(x.select(F.xxhash64("k", "r.x", "r.y").alias("g"), "r.half", "rid", "meta", "signature"), share, lost).distinct()


def _chain(y: list[int]) -> int:
    """Length of the longest strictly ascending subsequence."""
    ends: list[int] = []
    for v in y:
        i = bisect_left(ends, v)
        ends[i : i + 1] = [v]
    return len(ends)


def aligned_and_shared(va: np.ndarray, oa: np.ndarray, vb: np.ndarray, ob: np.ndarray, share: float = SHARE) -> tuple[np.ndarray, np.ndarray]:
    """For each pair of sequences without repetition the longest common chain within the band, and the common elements.

    Each diagonal is i - j of a common element. Texts that share ``share`` have at most 1 - share of their union
    on one side only, and no diagonal of their alignment can be farther from 0.
    """
    na, nb = np.diff(oa), np.diff(ob)
    of_a, of_b = np.repeat(np.arange(len(na)), na), np.repeat(np.arange(len(nb)), nb)
    ka = (of_a.astype(np.uint64) << np.uint64(32)) | va.view(np.uint32)
    kb = (of_b.astype(np.uint64) << np.uint64(32)) | vb.view(np.uint32)
    _, ia, ib = np.intersect1d(ka, kb, return_indices=True)
    order = np.argsort(ia)
    ia, ib = ia[order], ib[order]
    pair = of_a[ia]
    shared = np.bincount(pair, minlength=len(na))
    x, y = ia - oa[pair], ib - ob[pair]
    band = np.ceil((1 - share) * (na + nb - shared)).astype(np.int64)
    inside = np.abs(x - y) <= band[pair]
    pair, y = pair[inside], y[inside]
    aligned = np.bincount(pair, minlength=len(na))
    falls = np.unique(pair[1:][(pair[1:] == pair[:-1]) & (y[1:] < y[:-1])])
    lo, hi = np.searchsorted(pair, falls), np.searchsorted(pair, falls, side="right")
    for p, i, j in zip(falls, lo, hi):
        aligned[p] = _chain(y[i:j].tolist())
    return aligned, shared


def verified(pairs: DataFrame, classes: DataFrame, share: float = SHARE) -> DataFrame:
    """(a, b, na, nb, aligned, shared): the pairs that share ``share``, by their alignment or else by their common triples."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, len(b), 1024):
                c = b.slice(lo, 1024)
                (va, oa), (vb, ob) = ((x.flatten().to_numpy(), x.offsets.to_numpy().astype(np.int64)) for x in (c.column(4), c.column(5)))
                n = c.column(2).to_numpy() + c.column(3).to_numpy()
                aligned, shared = aligned_and_shared(va, oa - oa[0], vb, ob - ob[0], share)
                reaches = lambda k: (k > 0) & (k >= share * (n - k) - 1e-9)  # noqa: E731,B023
                keep = reaches(aligned)
                keep[~keep] = reaches(shared)[~keep]
                yield pa.RecordBatch.from_arrays([*(c.column(i) for i in range(4)), pa.array(aligned.astype(np.int32)), pa.array(shared.astype(np.int32))], ["a", "b", "na", "nb", "aligned", "shared"]).filter(pa.array(keep))

    s = classes.select("rid", "n", "seq")
    both = pairs.join(s.select(F.col("rid").alias("a"), F.col("n").alias("na"), F.col("seq").alias("sa")), "a")
    both = both.join(s.select(F.col("rid").alias("b"), F.col("n").alias("nb"), F.col("seq").alias("sb")), "b")
    return both.select("a", "b", "na", "nb", "sa", "sb").mapInArrow(run, "a long, b long, na int, nb int, aligned int, shared int")


class Similar:
    """Links between the records of ``df`` (tbl, record_key, text): classes of equal texts and verified pairs of them."""

    def __init__(self, df: DataFrame, share: float = SHARE, tables: tuple[str, ...] = (DOCUMENT, CHUNK), lost: float = LOST):
        r = df.where((F.length("text") > 0) & F.col("record_key").isNotNull()).select("tbl", F.col("record_key").cast("long").alias("record_key"), "text", F.xxhash64("text").alias("rid"))
        bit = F.lit(0)
        for i, name in enumerate(tables):
            bit = F.when(F.col("tbl") == name, 1 << i).otherwise(bit)
        texts = r.groupBy("rid").agg(F.bit_or(bit).alias("tables"), F.first("text").alias("text"))
        self.classes = materialise(sketched(texts), "sketches")
        self.members = r.select("tbl", "record_key", "rid").distinct()
        self.found = materialise(candidates(self.classes, share, lost=lost), "candidates")
        self.pairs = materialise(verified(self.found, self.classes, share), "pairs")

    def heads(self) -> DataFrame:
        """(tbl, rid, head): the least key of each class in each table, for classes whose text has triples."""
        m = self.members.groupBy("tbl", "rid").agg(F.min("record_key").alias("head"))
        return m.join(self.classes.select("rid"), "rid", "left_semi")

    def links(self, shown: int | None = SHOWN) -> DataFrame:
        """(tbl, key_a, key_b): each record with the first ``shown`` records of its class and of each linked class. Rows
        grow in proportion to records and links, however large a class is; all pairs come out for up to ``shown`` copies,
        and for any number of them if it is None."""
        m = self.members.join(self.classes.select("rid"), "rid", "left_semi")
        first = Window.partitionBy("tbl", "rid").orderBy("record_key")
        shown = m.withColumn("r", F.row_number().over(first)).where(F.lit(True) if shown is None else F.col("r") <= shown).select("tbl", F.col("rid").alias("other"), F.col("record_key").alias("x"))
        own = m.join(shown.withColumnRenamed("other", "rid"), ["tbl", "rid"]).where(F.col("record_key") != F.col("x")).select("tbl", "x", F.col("record_key").alias("y"))
        both = self.pairs.select(F.col("a").alias("rid"), F.col("b").alias("other")).unionByName(self.pairs.select(F.col("b").alias("rid"), F.col("a").alias("other")))
        far = both.join(shown, "other").join(m, ["tbl", "rid"]).select("tbl", "x", F.col("record_key").alias("y"))
        return own.unionByName(far).select("tbl", F.least("x", "y").alias("key_a"), F.greatest("x", "y").alias("key_b")).distinct()

    def groups(self, rounds: int = 40) -> DataFrame:
        """(tbl, record_key, group_key, n_links): groups of linked records with the least key as their name; records
        without link are left out. n_links counts links of the record's class to classes with other texts."""
        heads = materialise(self.heads(), "heads")
        h = heads.select("tbl", F.col("rid").alias("a"), F.col("head").alias("x")).join(self.pairs.select("a", "b"), "a").join(heads.select("tbl", F.col("rid").alias("b"), F.col("head").alias("y")), ["tbl", "b"])
        edges = materialise(h.select("tbl", F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct(), "edges")
        label = components(edges, rounds)
        degree = edges.select("tbl", F.col("x").alias("head")).unionByName(edges.select("tbl", F.col("y").alias("head"))).groupBy("tbl", "head").agg(F.count(F.lit(1)).alias("n_links"))
        m = self.members.join(heads, ["tbl", "rid"])
        size = m.groupBy("tbl", "head").agg(F.count(F.lit(1)).alias("copies"))
        h = size.join(label, ["tbl", "head"], "left").join(degree, ["tbl", "head"], "left").where((F.col("copies") > 1) | F.col("group_key").isNotNull())
        out = m.join(h, ["tbl", "head"])
        return out.select("tbl", "record_key", F.coalesce("group_key", "head").alias("group_key"), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"))


def components(edges: DataFrame, rounds: int = 40) -> DataFrame:
    """(tbl, head, group_key): connected components of edges (tbl, x, y), x < y, by alternating large and small stars.

    Each round is written to the shared folder; a star's centre is its least neighbour, so rows per key stay spread.
    """
    e = edges
    before = None
    for _ in range(rounds):
        both = e.unionByName(e.select("tbl", F.col("y").alias("x"), F.col("x").alias("y")))
        least = both.groupBy("tbl", "x").agg(F.least(F.min("y"), F.col("x")).alias("m"))
        large = both.join(least, ["tbl", "x"]).where(F.col("y") > F.col("x")).select("tbl", F.col("m").alias("x"), "y").where(F.col("x") < F.col("y")).distinct()
        low = large.groupBy("tbl", "y").agg(F.min("x").alias("m"))
        small = large.join(low, ["tbl", "y"]).select("tbl", F.col("m").alias("x"), F.when(F.col("x") == F.col("m"), F.col("y")).otherwise(F.col("x")).alias("y"))
        e = materialise(small.where(F.col("x") < F.col("y")).distinct(), "stars")
        now = e.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.xxhash64("tbl", "x", "y").cast("decimal(38,0)")), F.lit(0))).first()
        if now == before:
            break
        before = now
    label = e.select("tbl", F.col("y").alias("head"), F.col("x").alias("group_key"))
    return label.unionByName(e.select("tbl", F.col("x").alias("head"), F.col("x").alias("group_key")).distinct())
