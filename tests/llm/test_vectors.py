import random

import numpy as np

from lodestrata.llm import queries, vectors

SCHEMA = "batch_id long, chunk_keys array<long>, embeddings array<array<float>>, vec int, sim string"


def clustered(n, seed=0, dim=64):
    rnd = np.random.default_rng(seed)
    out = []
    while len(out) < n:
        c = rnd.normal(size=dim)
        for _ in range(rnd.integers(1, 6)):
            out.append((c + rnd.normal(size=dim) * 0.2).astype(np.float32))
    return np.array(out[:n])


def batches(spark, vs, per=7):
    rows = [(i, list(range(i, min(i + per, len(vs)))), [v.tolist() for v in vs[i : i + per]], 1, "x") for i in range(0, len(vs), per)]
    return spark.createDataFrame(rows, SCHEMA)


def brute(vs, least=0.9, k=10):
    u = vs.astype(np.float64) / np.linalg.norm(vs.astype(np.float64), axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -2)
    pairs = set()
    for i in range(len(vs)):
        for j in sorted(range(len(vs)), key=lambda j: (-s[i, j], j))[:k]:
            if s[i, j] >= least:
                pairs.add((min(i, j), max(i, j)))
    return pairs


def test_pairs_against_brute_force(spark):
    vs = clustered(700)
    want = brute(vs)
    got = {tuple(r) for r in vectors.similar_pairs(batches(spark, vs)).collect()}
    assert got <= want and len(got) >= 0.97 * len(want)


def test_rotation_keeps_lengths():
    x = np.random.default_rng(1).normal(size=(5, 64))
    assert np.allclose(np.linalg.norm(vectors.hadamard(x), axis=1), 8 * np.linalg.norm(x, axis=1))
    h = np.array([[1.0]])
    while len(h) < 64:
        h = np.block([[h, h], [h, -h]])
    assert np.allclose(vectors.hadamard(x), x @ h)


def test_copies_and_bad_vectors(spark):
    v = [random.Random(4).gauss(0, 1) for _ in range(64)]
    inf, nan = float("inf"), float("nan")
    rows = [(1, list(range(40)), [v] * 40, 0, ""), (2, [0, 1], [v, v], 0, ""), (3, [50, 51, 52, 53, 54, None], [None, [], v[:63], [0.0] * 64, [inf] + v[1:], v], 0, ""), (4, None, None, None, None), (5, [60, 61], [[nan] * 64, [2 * x for x in v]], 0, ""), (6, [70], None, 0, "")]
    d = spark.createDataFrame(rows, SCHEMA)
    n = vectors.most_similar(d, k=10).collect()
    by = {}
    for r in n:
        by.setdefault(r.chunk_key, []).append((r.rank, r.neighbour, round(r.sim, 6)))
    assert set(by) == {*range(40), 61} and all(len(x) == 10 for x in by.values())
    assert sorted(by[0])[0] == (1, 1, 1.0) and sorted(by[39])[-1] == (10, 9, 1.0)
    assert vectors.similar_pairs(d.limit(0)).count() == 0


def test_large_buckets_are_parted_without_loss(spark):
    rnd = np.random.default_rng(9)
    c = rnd.normal(size=64)
    vs = np.array([c + rnd.normal(size=64) * 0.02 for _ in range(300)], np.float32)
    v = vectors.valid_vectors(batches(spark, vs)).cache()
    classes = v.select("vid", "vec")
    near = vectors.nearest_classes(classes, 5, 0.5, tables=2, probes=1, block=16)
    got = {(r.a, r.b) for r in near.collect()}
    ids = {r.chunk_key: r.vid for r in v.collect()}
    u = vs.astype(np.float64) / np.linalg.norm(vs.astype(np.float64), axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -2)
    want = {(ids[i], ids[int(j)]) for i in range(300) for j in np.argsort(-s[i])[:5]}
    assert len(got & want) >= 0.9 * len(want)


def test_recall_report(spark):
    r = vectors.recall(batches(spark, clustered(400, 3)), every=10).first()
    assert r.n_queries == 40 and r.recall >= 0.9


def test_estimates_of_cosines():
    rnd = np.random.default_rng(2)
    x, e = rnd.normal(size=(2, 20_000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    e -= (e * x).sum(axis=1, keepdims=True) * x
    e /= np.linalg.norm(e, axis=1, keepdims=True)
    both = np.concatenate((x, 0.9 * x + np.sqrt(1 - 0.9**2) * e)).astype(np.float32)
    vid, y = vectors.decoded(vectors.coded(np.arange(len(both)) - 9, both))
    assert vid.tolist() == list(range(-9, len(both) - 9))
    assert (y[:20_000] * y[20_000:]).sum(axis=1).min() > 0.9 - vectors.SLACK


def test_dense_group_of_different_vectors_loses_no_pair(spark):
    rnd = np.random.default_rng(12)
    axis = rnd.normal(size=64) * 3
    vs = np.array([axis + rnd.normal(size=64) for _ in range(300)], np.float32)
    v = vectors.valid_vectors(batches(spark, vs)).cache()
    ids = {r.chunk_key: r.vid for r in v.collect()}
    want = {(ids[i], ids[j]) for i, j in brute(vs, 0.9, 300)}
    near = vectors.nearest_classes(v.select("vid", "vec"), 300, 0.9, tables=10, probes=1, block=8)
    got = {(r.a, r.b) for r in near.collect()}
    assert len(want) > 1000 and sum(x in got or x[::-1] in got for x in want) >= 0.97 * len(want)


def test_lists_are_full_whatever_the_cosine(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(vectors, "EXACT_BLOCK", 64)
    monkeypatch.setattr(vectors, "EXACT_LOOKS", 50)
    vs = clustered(300, 8)
    batches(spark, vs).write.parquet(f"{tmp_path}/embedding_vector_batch.parquet")
    got = {(r.chunk_key, r.neighbour) for r in queries.p1_nearest(spark, str(tmp_path)).collect()}
    u = vs.astype(np.float64) / np.linalg.norm(vs.astype(np.float64), axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -2)
    want = {(i, int(j)) for i in range(300) for j in np.argsort(-s[i])[:10]}
    assert len(got) == 3000 and len(got & want) >= 0.99 * len(want)
    r = queries.p1_recall(spark, str(tmp_path)).first()
    assert (r.n_queries, r.n_true) == (3, 30) and r.recall >= 0.9
