import itertools
import math
import random
import re

import numpy as np

from lodestrata.llm import neardup
from lodestrata.llm.common import CHUNK, DOCUMENT

SCHEMA = "tbl string, record_key long, text string, rid long, n int"
WORD = re.compile(r"[^\W_]+")


def words(t):
    return WORD.findall((t or "").lower())


def triples(t):
    w = words(t)
    return {tuple(w[i : i + 3]) for i in range(len(w) - 2)}


def brute(rows, share=0.7):
    out = set()
    for i, a in enumerate(rows):
        for b in rows[i + 1 :]:
            x, y = triples(a[2]), triples(b[2])
            if a[0] == b[0] and a[1] != b[1] and x and y and len(x & y) >= share * len(x | y):
                out.add((a[0], min(a[1], b[1]), max(a[1], b[1])))
    return out


def corpus(seed=1, n=60):
    rnd = random.Random(seed)
    voc = [f"w{i}" for i in range(3000)] + ["Über", "naïve", "n42"]
    rows = []
    for k in range(n):
        base = rnd.choices(voc, k=rnd.choice([60, 150, 400]))
        rows.append((DOCUMENT, k * 10, " ".join(base)))
        edited = list(base)
        for _ in range(len(base) // 40):
            edited[rnd.randrange(len(edited))] = "changed"
        rows.append((DOCUMENT, k * 10 + 1, "> " + "\n> ".join(edited)))
        rows.append((CHUNK, k * 10 + 2, " ".join(base[: len(base) * 4 // 5])))
        rows.append((DOCUMENT, k * 10 + 3, " ".join(rnd.choices(voc, k=len(base) // 4) + base)))
        third = len(base) // 3
        rows.append((CHUNK, k * 10 + 4, " ".join(base[third:] + base[:third])))
        rows.append((CHUNK, k * 10 + 5, " ".join(base)))
    return rows


def test_triples_as_defined():
    ts = ["A-b_c  d", "one two", "", "Ünter42 x y z", "ß ẞ ﬁ x"]
    t, of = neardup.triples(ts)
    assert [int((of == i).sum()) for i in range(len(ts))] == [max(0, len(words(x)) - 2) for x in ts]
    a, _ = neardup.triples(["x y z"])
    b, _ = neardup.triples(["nothing else here X, Y! Z"])
    assert a[0] in b


def test_links_against_brute_force(spark):
    rows = corpus()
    d = spark.createDataFrame([(*r, 1, 2) for r in rows], SCHEMA)
    got = {tuple(r) for r in neardup.Similar(d).links().collect()}
    want = brute(rows)
    assert got <= want and len(got) >= 0.99 * len(want)


def test_edge_cases(spark):
    same = " ".join(f"v{i}" for i in range(80))
    rows = [(DOCUMENT, k, same) for k in range(20)] + [(DOCUMENT, 3, same), (CHUNK, 5, same), (DOCUMENT, 100, None), (DOCUMENT, 101, ""), (DOCUMENT, 102, "two words"), (DOCUMENT, None, same), (DOCUMENT, 103, same + " " + "long " * 200_000)]
    d = spark.createDataFrame([(*r, None, None) for r in rows], SCHEMA)
    s = neardup.Similar(d)
    links = {tuple(r) for r in s.links().collect()}
    assert all(t == DOCUMENT for t, _, _ in links) and {k for _, a, b in links for k in (a, b)} == {*range(20), 103}
    g = s.groups().collect()
    assert {r.record_key for r in g if r.tbl == DOCUMENT} == {*range(20), 103} and {r.group_key for r in g} == {0}
    assert s.links(None).where("tbl = 'document'").count() == 21 * 20 // 2 and s.links(2).where("key_b < 100").count() == 19 + 18
    assert neardup.Similar(d.limit(0)).links().count() == 0


def test_components(spark):
    e = spark.createDataFrame([("t", 1, 2), ("t", 2, 3), ("t", 7, 8), ("t", 3, 9), ("u", 1, 7)], "tbl string, x long, y long")
    got = {(r.tbl, r.head): r.group_key for r in neardup.components(e).collect()}
    assert got == {("t", 1): 1, ("t", 2): 1, ("t", 3): 1, ("t", 9): 1, ("t", 7): 7, ("t", 8): 7, ("u", 1): 1, ("u", 7): 1}


def test_large_family_of_edited_versions(spark):
    rnd = random.Random(5)
    base = [f"b{i}" for i in range(400)]
    rows = [(DOCUMENT, k, " ".join(w if rnd.random() > 0.03 else f"e{k}x{i}" for i, w in enumerate(base))) for k in range(200)]
    d = spark.createDataFrame([(*r, 1, 1) for r in rows], SCHEMA)
    got = {tuple(r) for r in neardup.Similar(d).links().collect()}
    want = brute(rows)
    assert got <= want and len(want) > 13_000 and len(got) >= 0.995 * len(want)


def test_blocks_of_a_bucket_give_the_same_pairs(spark):
    notice = " ".join(f"n{i}" for i in range(90))
    rows = [(DOCUMENT, k, notice + " " + " ".join(f"k{k}x{i}" for i in range(8))) for k in range(60)] + [(DOCUMENT, 99, notice)]
    s = neardup.Similar(spark.createDataFrame([(*r, 1, 1) for r in rows], SCHEMA))
    whole, parts, every = ({tuple(r) for r in neardup.candidates(s.classes, block=n, lost=p).collect()} for n, p in ((2048, 1e-4), (7, 1e-4), (2048, 0.0)))
    assert whole == parts == every and len(whole) == 61 * 60 // 2
    assert {tuple(r) for r in s.links().collect()} == brute(rows)


def test_repeated_passages_count_once(spark):
    base = [f"r{i}" for i in range(30)]
    rows = [(DOCUMENT, k, " ".join(base * n)) for k, n in enumerate((2, 3, 9, 40))] + [(DOCUMENT, 9, "a b c"), (DOCUMENT, 10, "a b c a b c"), (DOCUMENT, 11, "A, b; c!")]
    s = neardup.Similar(spark.createDataFrame([(*r, 1, 1) for r in rows], SCHEMA))
    assert {tuple(r) for r in s.links().collect()} == brute(rows)


def test_alignment_is_the_longest_chain():
    rnd = random.Random(3)

    def longest(x, y):
        m = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
        for i, j in itertools.product(range(len(x)), range(len(y))):
            m[i + 1][j + 1] = m[i][j] + 1 if x[i] == y[j] else max(m[i][j + 1], m[i + 1][j])
        return m[-1][-1]

    pairs = []
    for _ in range(40):
        a = rnd.sample(range(-1000, 1000), rnd.randint(1, 60))
        b = [x for x in a if rnd.random() > 0.1] + rnd.sample(range(2000, 3000), 3)
        if rnd.random() < 0.5:
            i, j = rnd.randrange(len(b)), rnd.randrange(len(b))
            b[i], b[j] = b[j], b[i]
        pairs.append((a, b))
    flat = lambda k: np.array([x for p in pairs for x in p[k]], np.int32)
    ends = lambda k: np.concatenate(([0], np.cumsum([len(p[k]) for p in pairs])))
    aligned, shared = neardup.aligned_and_shared(flat(0), ends(0), flat(1), ends(1))
    assert shared.tolist() == [len(set(a) & set(b)) for a, b in pairs]
    for (a, b), got, common in zip(pairs, aligned, shared):
        true = longest(a, b)
        assert got <= true and (got == true or true < 0.7 * (len(a) + len(b) - true)) and got <= common


def test_signatures_drop_few():
    need = neardup.least_equal()
    lost = sum(math.comb(64, i) * 0.7**i * 0.3 ** (64 - i) for i in range(need))
    assert lost <= 1e-4 < lost + math.comb(64, need) * 0.7**need * 0.3 ** (64 - need)
