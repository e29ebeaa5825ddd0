import random
import re

import pytest
from pyspark.sql import functions as F

from lodestrata.llm import splitting

SCHEMA = "tbl string, record_key long, text string, piece_no int, boundary string"


def texts():
    rnd = random.Random(2)
    words = ["a", "bb", "some", "longer", "wörd", "😀", "end.", "well,"]
    for n in (0, 1, 50, 400, 3000):
        yield "".join(rnd.choice(words) + rnd.choice([" ", " ", "  ", "\n", "\n\n", "\r\n", "\t"]) for _ in range(n))
    yield "x" * 2500
    yield "y" * 1999 + " " + "z" * 1990
    yield " " * 5000
    yield "p" * 1900 + " " + "q" * 1900 + " " + "r" * 3
    yield "a " * 10_000 + "b" * 2001 + " c"


@pytest.mark.parametrize("limit,overlap", [(2000, 200), (50, 10), (10, 0)])
def test_pieces_cover_and_overlap(limit, overlap):
    for t in texts():
        p = splitting.split_text(t, limit, overlap)
        if not t:
            assert p == []
            continue
        assert p[0][0] == 0 and p[-1][1] == len(t)
        for (s, e, shared, level), before in zip(p, [None, *p]):
            assert 0 < e - s <= limit
            if before:
                assert before[0] <= s <= before[1] and before[1] - s == shared <= overlap
                assert level == "forced" or t[before[1] - 1] in " \t\r\n"
        forced = any(x[3] == "forced" for x in p)
        assert forced == bool(re.search(rf"[^ \t\r\n]{{{limit + 1}}}", t)), t[:40]


def test_records(spark):
    rows = [("document", 1, "x y" * 900, 7, "z"), ("document", 1, "x y" * 900, 8, "z"), ("chunk", 1, "w" * 2001, None, None), ("chunk", 2, None, None, None), ("chunk", 3, "", 1, ""), ("chunk", None, "k " * 2000, 1, "")]
    d = spark.createDataFrame(rows, SCHEMA)
    got = sorted((r.tbl, r.record_key or 0, r.kind) for r in splitting.oversized(d).collect())
    assert got == [("chunk", 0, "oversized"), ("chunk", 1, "forced"), ("chunk", 1, "oversized"), ("document", 1, "oversized")]
    p = splitting.split_records(d)
    back = p.where("tbl = 'document'").orderBy("piece_no").collect()
    text = "".join(r.piece_text[r.overlap_chars :] for r in back)
    assert text == "x y" * 900
    assert splitting.split_records(d.limit(0)).count() == 0
    assert splitting.split_records(d, keep_short=True).where(F.col("record_key") == 3).count() == 0
    with pytest.raises(ValueError):
        splitting.split_records(d, 100, 100)
