r"""The k most similar vectors of a collection for every one of its vectors, by cross-polytope hashing.

Method: three rounds of random signs and a fast Hadamard transform rotate a unit vector; its hash is the nearest signed
axis. ``depth`` such hashes make the bucket of a table; each vector lies in its own bucket of every table and, for
``probes`` more, looks into those that differ in the hash whose second-best axis is nearest. A pair that meets counts for
the lists of both. In buckets cosines are estimated from four bits for each component, and pairs that are clearly too far
apart are left out; for the rest they are exact, and the k best of all tables are kept. Vectors whose list isn't full of
near ones are compared with all.

Scale:

* Exact copies of a vector are searched as one and expanded afterwards, with at most k + 1 members of a class as
  partners of each vector; a class of any size costs work in proportion to its size.
* ``depth`` follows the number of vectors, so a bucket keeps about 32 by chance. Of a row in a bucket 40 bytes move: the
  vector's number and its components in four bits each. Whole vectors move once to be made distinct, and once for the
  pairs that are left.
* A bucket with more than ``block`` vectors is compared in pairs of blocks, each in its own group, and of each look into
  a block the ``SPARE`` * k best come out. No task holds more than two blocks; such a bucket costs work in proportion to the
  square of its vectors.
* From the third hash on there are more tables and probes (``tables_for``), so that near pairs meet as they do at two.

Defined results: vectors that are null, of another length, all zero or not finite take no part, nor do those without
key. A key counts once; if it comes with several vectors, the one with the least hash counts. Ties at rank k go to the smaller key. Other
columns are not read. An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise

DIM = 64
MAX_DEPTH = 6
_BITS = 7  # of a hash: 64 axes, two signs
BLOCK = 8192
#: Groups of up to so many rows are compared row by row at once, larger ones as matrices.
SMALL = 64
#: How many times k of a large group come out for each look, as their order is estimated.
SPARE = 4
TABLES = 10
#: Four bits stand for components within this range. The cosine of a pair at 0.90 is estimated too low by more than
#: ``SLACK`` with a probability of less than 1 in 100,000.
RANGE = 0.32
SLACK = 0.06
TIMES = 1.8
#: Neighbours from this cosine on are left to the tables; lists that need farther ones are made by comparing with all.
SURE = 0.9
EXACT_BLOCK = 8192
EXACT_LOOKS = 65_536


def valid_vectors(batches: DataFrame, dim: int = DIM, keys: str = "chunk_keys", vectors: str = "embeddings") -> DataFrame:
    """(chunk_key, vid, vec) of each valid vector of each row; vid is the same for exact copies."""
    z = batches.select(F.explode(F.arrays_zip(F.col(keys).alias("k"), F.col(vectors).alias("v"))).alias("z")).select(F.col("z.k").cast("long").alias("chunk_key"), F.col("z.v").cast("array<float>").alias("vec"))
    fine = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vec", lambda x: x != 0)
    z = z.where(F.col("chunk_key").isNotNull() & F.col("vec").isNotNull()).where(F.size("vec") == dim).where(fine)
    return z.select("chunk_key", F.xxhash64("vec").alias("vid"), "vec")


class Vectors:
    """``members`` (chunk_key, vid), each key once, and ``classes`` (vid, vec), the distinct vectors that a key counts with."""

    def __init__(self, batches: DataFrame, dim: int = DIM):
        v = valid_vectors(batches, dim)
        self.members = materialise(v.groupBy("chunk_key").agg(F.min("vid").alias("vid")), "members")
        self.classes = materialise(v.join(self.members, ["chunk_key", "vid"], "left_semi").groupBy("vid").agg(F.first("vec").alias("vec")), "classes")


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of each row."""
    n = x.shape[1]
    h = 1
    while h < n:
        x = x.reshape(-1, n // (2 * h), 2, h)
        x = np.stack((x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]), axis=2).reshape(-1, n)
        h *= 2
    return x


def hashes(x: np.ndarray, signs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nearest signed axis of each row, the second nearest, and by how much it is farther."""
    for s in signs:
        x = hadamard(x * s)
    a = np.abs(x)
    rows = np.arange(len(x))
    best = a.argmax(axis=1)
    top = a[rows, best].copy()
    a[rows, best] = -1
    second = a.argmax(axis=1)
    code = lambda i: i * 2 + (x[rows, i] < 0)
    return code(best), code(second), (top - a[rows, second]) / np.maximum(top, 1e-30)


def unit_rows(v: pa.Array, dim: int) -> np.ndarray:
    m = v.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim).astype(np.float64)
    m /= np.abs(m).max(axis=1, keepdims=True)
    return (m / np.linalg.norm(m, axis=1, keepdims=True)).astype(np.float32)


def _packed(m: np.ndarray) -> pa.Array:
    m = np.ascontiguousarray(m)
    offsets = np.arange(len(m) + 1, dtype=np.int32) * m.itemsize * m.shape[1]
    return pa.Array.from_buffers(pa.binary(), len(m), [None, pa.py_buffer(offsets), pa.py_buffer(m)])


def _unpacked(b: pa.Array) -> np.ndarray:
    """The bytes of binary values of one length, a row for each; there is at least one."""
    offsets = np.frombuffer(b.buffers()[1], np.int32)[b.offset : b.offset + len(b) + 1]
    return np.frombuffer(b.buffers()[2], np.uint8)[offsets[0] : offsets[-1]].reshape(len(b), -1)


def depth_for(n: int) -> int:
    return min(MAX_DEPTH, max(2, math.ceil(math.log(max(n, 1) / 32) / math.log(2 * DIM)))) if n > 32 else 1


def tables_for(depth: int, tables: int, probes: int) -> tuple[int, int]:
    """Tables and probes at ``depth``: each hash beyond the second takes TIMES as many tables and one more probe."""
    more = max(0, depth - 2)
    return math.ceil(tables * TIMES**more), probes + more


def coded(vid: np.ndarray, unit: np.ndarray) -> np.ndarray:
    """The number of a vector (8 bytes) and its components, four bits each."""
    q = np.clip(np.rint(unit * (7.5 / RANGE) + 7.5), 0, 15).astype(np.uint8)
    return np.concatenate((np.ascontiguousarray(vid).view(np.uint8).reshape(-1, 8), q[:, ::2] | (q[:, 1::2] << 4)), axis=1)


def decoded(code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers, and unit vectors near those that were coded."""
    q = code[:, 8:]
    x = np.empty((len(q), 2 * q.shape[1]), np.float32)
    x[:, ::2], x[:, 1::2] = q & 15, q >> 4
    x -= np.float32(7.5)
    return np.ascontiguousarray(code[:, :8]).view(np.int64).ravel(), x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def signatures(classes: DataFrame, tables: int, probes: int, depth: int, dim: int = DIM, seed: int = 7) -> DataFrame:
    """(vid, code, keys): the buckets in which each vector lies, one for each table, then those into which it looks."""
    signs = np.random.default_rng(seed).choice(np.array([-1.0, 1.0], np.float32), (tables, depth, 3, dim))
    spread = np.random.default_rng(seed + 1).choice(np.array([-1.0, 1.0], np.float32), (3, dim))
    probes = min(probes, depth)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            vid = b.column(0).to_numpy()
            x = unit_rows(b.column(1), dim)
            own, looks = [], []
            shifts = _BITS * (depth - 1 - np.arange(depth, dtype=np.int64))
            rows = np.arange(len(x))
            for t in range(tables):
                best, second, gap = (np.stack(c, axis=1) for c in zip(*(hashes(x, signs[t, d]) for d in range(depth))))
                base = (best.astype(np.int64) << shifts).sum(axis=1) + (t << _BITS * depth)
                own.append(base)
                order = np.argsort(gap, axis=1)
                for p in range(probes):
                    d = order[:, p]
                    looks.append(base + ((second[rows, d] - best[rows, d]).astype(np.int64) << shifts[d]))
            y = x
            for s in spread:  # so that no component is much larger than the others
                y = hadamard(y * s) / np.float32(np.sqrt(dim))
            n = tables * (1 + probes)
            keys = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * n), pa.array(np.stack([*own, *looks], axis=1).ravel()))
            yield pa.RecordBatch.from_arrays([b.column(0), _packed(coded(vid, y)), keys], ["vid", "code", "keys"])

    return classes.select("vid", "vec").mapInArrow(run, "vid long, code binary, keys array<long>")


def placed(sig: DataFrame, tables: int, block: int) -> DataFrame:
    """(g, role, code): the rows of each group. Roles 0 and 1 lie in the bucket, 2 and 3 look into it; those of an odd role
    are of another block, and are compared with the other block only."""
    keys = sig.select(F.explode("keys").alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    hot = materialise(keys.where(F.col("n") > block), "hot-buckets")
    n_hot = hot.count()
    rows = sig.select("vid", "code", F.posexplode("keys").alias("at", "key"))
    look = F.when(F.col("at") >= tables, 2).otherwise(0)
    if not n_hot:
        return rows.select(F.col("key").alias("g"), look.alias("role"), "code")
    held = F.broadcast(hot) if n_hot <= 100_000 else hot  # 2 MB
    out = rows.join(held, "key", "left_anti").select(F.col("key").alias("g"), look.alias("role"), "code")
    rows = rows.join(held, "key").withColumn("blocks", F.ceil(F.col("n") / block))
    mine = F.pmod(F.xxhash64("vid"), F.col("blocks"))
    every = F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)
    parts = F.transform(every, lambda j: F.struct(F.least(mine, j).alias("x"), F.greatest(mine, j).alias("y"), (look + F.when(mine <= j, 0).otherwise(1)).alias("role")))
    hot_rows = rows.select("key", "code", F.explode(parts).alias("r"))
    return out.unionByName(hot_rows.select(F.xxhash64("key", "r.x", "r.y").alias("g"), "r.role", "code"))


def _k_best(s: np.ndarray, k: int, least: float, some: int = 1024) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of the k greatest of each row (more where they are equal) that are at least ``least``.

    Of wide rows the k-th greatest of the first columns leaves few of the others.
    """
    if s.shape[1] <= k:
        return np.nonzero(s >= least)
    some = max(some, k)
    cut = -np.partition(-s[:, :some], k - 1, axis=1)[:, k - 1]
    r, c = np.nonzero(s >= np.maximum(cut, least)[:, None])
    if s.shape[1] > some:
        order = np.lexsort((-s[r, c], r))
        r, c = r[order], c[order]
        keep = np.arange(len(r)) - np.searchsorted(r, r) < k
        r, c = r[keep], c[keep]
    return r, c


def _best(xi: np.ndarray, x: np.ndarray, yi: np.ndarray, y: np.ndarray, k: int, least: float) -> tuple[np.ndarray, np.ndarray]:
    """For each of x the k most similar of y, by their numbers."""
    out: list[tuple[np.ndarray, np.ndarray]] = []
    for lo in range(0, len(x), 1024):
        r, c = _k_best(x[lo : lo + 1024] @ y.T, k + 1, least)  # the vector itself may be among them
        other = xi[lo + r] != yi[c]
        out.append((xi[lo + r[other]], yi[c[other]]))
    return tuple(np.concatenate(o) for o in zip(*out))


def near_pairs(rows: DataFrame, k: int, least: float) -> DataFrame:
    """(a, b), a < b: pairs that meet in a group of ``rows`` (g, role, code) and whose estimated cosine may reach ``least``."""
    bound = least - SLACK

    def pairs(g: np.ndarray, role: np.ndarray, code: np.ndarray) -> pa.RecordBatch:
        vid, x = decoded(code)
        edges = np.flatnonzero(np.concatenate(([True], g[1:] != g[:-1], [True])))
        size = np.diff(edges)
        out: list[tuple[np.ndarray, np.ndarray]] = []
        at = np.flatnonzero(np.repeat(size <= SMALL, size) & (role < 2))
        d = 0
        while len(at):  # rows that are d places apart
            d += 1
            at = at[at + d < len(g)]
            at = at[g[at] == g[at + d]]
            for lo in range(0, len(at), 1 << 16):
                i = at[lo : lo + (1 << 16)]
                i = i[(vid[i] != vid[i + d]) & (np.einsum("ij,ij->i", x[i], x[i + d]) >= bound)]
                out.append((vid[i], vid[i + d]))
        for e in np.flatnonzero(size > SMALL):
            lo, hi = edges[e], edges[e + 1]
            cuts = [lo + int(c) for c in np.searchsorted(role[lo:hi], range(5))]
            here, there, look, look_there = ((vid[u:v], x[u:v]) for u, v in zip(cuts[:-1], cuts[1:]))
            if len(there[0]) or len(look_there[0]):
                met = [(here, there), (there, here), (look, there), (there, look), (look_there, here), (here, look_there)]
            else:
                met = [(here, here), (look, here), (here, look)]
            out += [_best(*u, *v, SPARE * k, bound) for u, v in met if len(u[0]) and len(v[0])]
        a, b = (np.concatenate([np.zeros(0, np.int64), *(o[n] for o in out)]) for n in (0, 1))
        both = np.unique(np.stack((np.minimum(a, b), np.maximum(a, b)), axis=1), axis=0) if len(a) else np.zeros((0, 2), np.int64)
        return pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_: list[tuple] = []  # rows of the group that isn't complete
        for b in batches:
            if not len(b):
                continue
            now = (b.column(0).to_numpy(), b.column(1).to_numpy(), _unpacked(b.column(2)))
            if open_ and now[0][0] == now[0][-1] == open_[0][0][0]:
                open_.append(tuple(x.copy() for x in now))
                continue
            now = tuple(np.concatenate(x) for x in zip(*open_, now))
            other = np.flatnonzero(now[0] != now[0][-1])
            end = int(other[-1]) + 1 if len(other) else 0
            open_ = [tuple(x[end:].copy() for x in now)]
            if end:
                yield pairs(*(x[:end] for x in now))
        if open_:
            yield pairs(*(np.concatenate(x) for x in zip(*open_)))

    streams = rows.repartition("g").sortWithinPartitions("g", "role").select("g", "role", "code")
    return streams.mapInArrow(run, "a long, b long").distinct()


def exact(pairs: DataFrame, classes: DataFrame, least: float, dim: int = DIM) -> DataFrame:
    """(a, b, sim) of the pairs with a cosine of at least ``least``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, y = (unit_rows(b.column(i), dim).astype(np.float64) for i in (2, 3))
            sim = np.einsum("ij,ij->i", x, y)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(sim)], ["a", "b", "sim"]).filter(pa.array(sim >= least - 1e-7))

    c = classes.select("vid", "vec")
    both = pairs.join(c.select(F.col("vid").alias("a"), F.col("vec").alias("x")), "a").join(c.select(F.col("vid").alias("b"), F.col("vec").alias("y")), "b")
    return both.select("a", "b", "x", "y").mapInArrow(run, "a long, b long, sim double")


def compared(rows: DataFrame, k: int, least: float, dim: int = DIM) -> DataFrame:
    """(a, b, sim): for each look into a bucket the k best of it with a cosine of at least ``least``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, ids, vecs = None, [], []  # the bucket that is open
        for b in batches:
            g, role, vid = (b.column(i).to_numpy() for i in range(3))
            x = _unpacked(b.column(3)).view(np.float32) if len(b) else np.zeros((0, dim), np.float32)
            out: tuple[list, list, list] = ([], [], [])
            edges = np.flatnonzero(np.concatenate(([True], g[1:] != g[:-1], [True]))) if len(g) else np.zeros(1, int)
            for lo, hi in zip(edges[:-1], edges[1:]):
                if g[lo] != here:
                    here, ids, vecs = g[lo], [], []
                mid = lo + int(np.searchsorted(role[lo:hi], 1))
                if mid > lo:
                    ids.append(vid[lo:mid]), vecs.append(x[lo:mid])
                if mid == hi or not ids or (len(ids) == 1 and len(ids[0]) == 1 and hi - mid == 1 and ids[0][0] == vid[mid]):
                    continue
                i, v = (ids[0], vecs[0]) if len(ids) == 1 else (np.concatenate(ids), np.concatenate(vecs))
                ids, vecs = [i], [v]
                for q in range(mid, hi, 1024):
                    qi = vid[q : min(q + 1024, hi)]
                    s = x[q : q + len(qi)] @ v.T
                    r, c = _k_best(s, k + 1, max(least - 1e-5, -1.5))  # the look itself may be among them
                    other = qi[r] != i[c]
                    r, c = r[other], c[other]
                    if len(r):
                        exact = np.einsum("ij,ij->i", x[q + r].astype(np.float64), v[c].astype(np.float64))
                        keep = exact >= least - 1e-7
                        out[0].append(qi[r][keep]), out[1].append(i[c][keep]), out[2].append(exact[keep])
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(o)) for o in out], ["a", "b", "sim"])

    streams = rows.repartition("g").sortWithinPartitions("g", "role")
    return streams.mapInArrow(run, "a long, b long, sim double")


def compared_with_all(asking: DataFrame, classes: DataFrame, k: int, least: float, dim: int = DIM) -> DataFrame:
    """(a, b, sim): exactly the k most similar of ``classes`` in each block of them, for each of ``asking`` (both vid, vec).

    Each block of vectors meets each part of the asking ones in its own group.
    """
    n, m = classes.count(), asking.count()
    blocks, parts = max(1, math.ceil(n / EXACT_BLOCK)), max(1, math.ceil(m / EXACT_LOOKS))

    def unit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), _packed(unit_rows(b.column(1), dim))], ["vid", "unit"])

    def spread(df: DataFrame, role: int, mine: int, others: int) -> DataFrame:
        rows = df.select("vid", "vec").mapInArrow(unit, "vid long, unit binary")
        x = rows.select("vid", "unit", F.pmod(F.xxhash64("vid"), F.lit(mine)).alias("m"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(others - 1).cast("long"))).alias("o"))
        blk, part = ("m", "o") if role == 0 else ("o", "m")
        return x.select(F.xxhash64(blk, part).alias("g"), F.lit(role).alias("role"), "vid", "unit")

    return compared(spread(classes, 0, blocks, parts).unionByName(spread(asking, 1, parts, blocks)), k, least, dim)


def nearest_classes(classes: DataFrame, k: int, least: float, tables: int, probes: int, block: int = BLOCK, dim: int = DIM) -> DataFrame:
    """(a, b, sim): the k most similar other distinct vectors of each.

    Tables show those with a cosine of at least ``SURE``. If ``least`` is below it, vectors with fewer than k of those are
    compared with all, so the work grows with their number times the number of vectors.
    """
    depth = depth_for(classes.count())
    tables, probes = tables_for(depth, tables, probes)
    sig = materialise(signatures(classes, tables, probes, depth, dim), "signatures")
    met = materialise(near_pairs(placed(sig, tables, block), k, max(least, SURE)), "met")
    half = exact(met, classes, max(least, SURE), dim)
    pairs = half.select("a", "b", F.explode(F.array(F.lit(True), F.lit(False))).alias("f"), "sim")
    pairs = pairs.select(F.when(F.col("f"), F.col("a")).otherwise(F.col("b")).alias("a"), F.when(F.col("f"), F.col("b")).otherwise(F.col("a")).alias("b"), "sim")
    if least < SURE:
        pairs = materialise(pairs, "near")
        full = pairs.groupBy("a").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= k).select(F.col("a").alias("vid"))
        weak = materialise(classes.join(full, "vid", "left_anti"), "weak")
        far = compared_with_all(weak, classes, k, least, dim)
        pairs = pairs.join(full.withColumnRenamed("vid", "a"), "a", "left_semi").select("a", "b", "sim").unionByName(far)
    w = Window.partitionBy("a").orderBy(F.desc("sim"), "b")
    return pairs.withColumn("r", F.row_number().over(w)).where(F.col("r") <= k).drop("r")


def expand(members: DataFrame, near: DataFrame, k: int) -> DataFrame:
    """(chunk_key, rank, neighbour, sim) from the neighbours of the distinct vectors: copies are each other's nearest."""
    w = Window.partitionBy("vid").orderBy("chunk_key")
    shown = members.withColumn("r", F.row_number().over(w)).where(F.col("r") <= k + 1)
    own = shown.where(F.col("r") == 2).select(F.col("vid").alias("a"), F.col("vid").alias("b"), F.lit(1.0).alias("sim"))
    cand = near.unionByName(own).join(shown.select(F.col("vid").alias("b"), F.col("chunk_key").alias("neighbour")), "b")
    w = Window.partitionBy("a").orderBy(F.desc("sim"), "neighbour")
    best = cand.withColumn("r", F.row_number().over(w)).where(F.col("r") <= k + 1)
    lists = best.groupBy("a").agg(F.array_sort(F.collect_list(F.struct("r", "neighbour", "sim"))).alias("l"))
    mine = members.join(lists.withColumnRenamed("a", "vid"), "vid")
    others = F.slice(F.filter("l", lambda x: x["neighbour"] != F.col("chunk_key")), 1, k)
    return mine.select("chunk_key", F.posexplode(others).alias("p", "x")).select("chunk_key", (F.col("p") + 1).alias("rank"), "x.neighbour", "x.sim")


def most_similar(batches: DataFrame, k: int = 10, least: float = -1.0, tables: int = TABLES, probes: int = 1, dim: int = DIM) -> DataFrame:
    """(chunk_key, rank, neighbour, sim) of every valid vector of ``batches`` (chunk_keys, embeddings)."""
    v = Vectors(batches, dim)
    return expand(v.members, nearest_classes(v.classes, k, least, tables, probes, dim=dim), k)


def similar_pairs(batches: DataFrame, k: int = 10, least: float = 0.9, tables: int = TABLES, probes: int = 1, dim: int = DIM) -> DataFrame:
    """(chunk_key_a, chunk_key_b): pairs with a cosine of at least ``least``, one among the k nearest of the other."""
    n = most_similar(batches, k, least, tables, probes, dim)
    return n.select(F.least("chunk_key", "neighbour").alias("chunk_key_a"), F.greatest("chunk_key", "neighbour").alias("chunk_key_b")).distinct()


def recall(batches: DataFrame, k: int = 10, least: float = 0.9, every: int = 100, tables: int = TABLES, probes: int = 1, dim: int = DIM) -> DataFrame:
    """(n_queries, n_true, n_found, recall, n_near, n_near_found, near_recall) of the neighbours with a cosine of at least
    ``least`` that are among the k nearest, for the vectors whose key is divisible by ``every``, against all vectors; near
    ones are those with a cosine of at least ``SURE``, which only the tables find."""
    v = Vectors(batches, dim)
    found = expand(v.members, nearest_classes(v.classes, k, least, tables, probes, dim=dim), k)
    asked = v.members.where(F.col("chunk_key") % every == 0)
    every_one = compared_with_all(v.classes.join(asked, "vid", "left_semi"), v.classes, k, least, dim)
    w = Window.partitionBy("a").orderBy(F.desc("sim"), "b")
    true = expand(v.members, every_one.withColumn("r", F.row_number().over(w)).where(F.col("r") <= k).drop("r"), k).where(F.col("chunk_key") % every == 0)
    hit = true.select("chunk_key", "neighbour", (F.col("sim") >= SURE).alias("near")).join(found.select("chunk_key", "neighbour", F.lit(1).alias("hit")), ["chunk_key", "neighbour"], "left")
    all_asked = asked.select("chunk_key").join(hit, "chunk_key", "left")
    n = all_asked.agg(F.count_distinct("chunk_key").alias("n_queries"), F.count("neighbour").alias("n_true"), F.count("hit").alias("n_found"), F.count_if("near").alias("n_near"), F.count_if(F.col("near") & F.col("hit").isNotNull()).alias("n_near_found"))
    share = lambda a, b: F.col(a) / F.greatest(b, F.lit(1))
    return n.select("n_queries", "n_true", "n_found", share("n_found", "n_true").alias("recall"), "n_near", "n_near_found", share("n_near_found", "n_near").alias("near_recall"))
