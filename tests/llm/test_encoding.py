import random

import pytest
import regex
from tokenizers import Tokenizer

from lodestrata.llm import encoding

TEXTS = [None, "", " ", "Hello world", "the the  the\n\n\nend ", "<|endoftext|> is text", "naïve 😀 — 日本語  x y", "tab\tx\r\ny\x0b\x0cz\x85w", "x" * 50_000, "it's we'll 'tis I'D", "\U0001e4d0ࢗ new letters", "a\x00b", "ﬁne ½ Ⅷ ٣٤"]


@pytest.fixture(scope="module")
def truth():
    t = Tokenizer.from_file(encoding.TOKENIZERS + "/byte_bpe_50k.json")
    t.encode_special_tokens = True
    return {i: t.encode(x or "", add_special_tokens=False).ids for i, x in enumerate(TEXTS)}


def test_ids_counts_and_round_trip(spark, truth):
    d = spark.createDataFrame([(i, t, i, "n") for i, t in enumerate(TEXTS)] + [(3, TEXTS[3], 0, "replayed")], "doc_id long, text string, ids int, word string")
    e = encoding.encode(d).cache()
    assert {r.doc_id: r.ids for r in e.collect()} == truth and e.count() == len(TEXTS)
    assert {r.doc_id: r.n_tokens for r in encoding.token_counts(d).collect()} == {k: len(v) for k, v in truth.items()}
    assert {r.doc_id: r.text for r in encoding.decode(e).collect()} == {i: t or "" for i, t in enumerate(TEXTS)}


def test_rows_without_document_id(spark, truth):
    d = spark.createDataFrame([(None, TEXTS[3]), (None, TEXTS[3]), (7, TEXTS[3]), (7, None), (7, ""), (None, None), (None, None)], "doc_id long, text string")
    got = sorted(((r.doc_id or 0), r.ids) for r in encoding.encode(d).collect())
    assert got == [(0, []), (0, truth[3]), (7, []), (7, []), (7, truth[3])]


def test_empty_table(spark):
    d = spark.createDataFrame([], "doc_id long, text string")
    assert encoding.encode(d).count() == 0 and encoding.token_counts(d).count() == 0


def test_one_word_in_a_third_of_all_rows(spark, truth):
    d = spark.range(300).selectExpr("id as doc_id", "case when id % 3 = 0 then 'Hello world' else concat('w', id) end as text")
    assert encoding.encode(d).where("doc_id % 3 = 0").select("ids").distinct().collect()[0].ids == truth[3]


def test_words_are_those_of_the_pattern():
    rnd = random.Random(2)
    parts = [" ", "  ", "\n", "\r\n", "\t", "\xa0", "\u3000", "'", "'s", "'re", "'ll", "'LL", "'l", "'d", "don", "t", "x", "é", "日", "12", "½", "-", "!?", "_", "\x1c", "\u200b", "e\u0301", "😀"]
    texts = ["".join(rnd.choices(parts, k=rnd.randint(1, 12))) for _ in range(4000)]
    whole, start, size = encoding.words_of(texts)
    ends = [*start[1:], len(whole)]
    words = iter([whole[a:b] for a, b in zip(start, ends)])
    for t, n in zip(texts, size):
        assert [next(words) for _ in range(n)] == regex.findall(encoding.PATTERN, t)


def test_pages_and_shared_hashes(spark, truth, monkeypatch):
    """Small pages give the same ids, and so do words that share a hash with the first seed."""
    d = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)] * 2, "doc_id long, text string")
    monkeypatch.setattr(encoding, "PAGE", 7)
    assert sorted((r.doc_id, r.ids) for r in encoding.encode(d).collect()) == sorted(truth.items())
    seen = []
    table = encoding.word_table
    monkeypatch.setattr(encoding, "word_table", lambda p, path: seen.append(1) or (table(p, path) if len(seen) > 1 else None))
    assert sorted((r.doc_id, r.ids) for r in encoding.encode(d).collect()) == sorted(truth.items()) and len(seen) == 2
    w = spark.createDataFrame([([1, 1], ["a", "b"])], "hash array<long>, word array<string>")
    assert table(w, encoding.rank_file()) is None
