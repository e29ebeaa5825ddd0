import html
import json
import random

from lodestrata.llm import truncation

SCHEMA = "doc_id long, text string, source string, len int, form string"
SENTENCES = ["The carrier accepted the plan by registered mail", "A reviewer closed the file through the new portal", "The lab returned the sample for the northern region"]


def docs(spark, rows):
    return spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA)


def full(rnd, n):
    return " ".join(rnd.choice(SENTENCES) + "." for _ in range(n))


def corpus():
    rnd = random.Random(3)
    rows = [(i, full(rnd, rnd.randrange(2, 30)), "free") for i in range(200)]
    rows += [(1000 + i, ("ü" * (i % 2) + full(rnd, 40))[: 300 - i % 2], "bytes") for i in range(60)]
    rows += [(1500 + i, full(rnd, 2), "bytes") for i in range(60)]
    return rows


def test_limits_are_found_in_the_right_form(spark):
    got = {r.source: (r.form, r.cap) for r in truncation.storage_limits(docs(spark, corpus())).collect()}
    assert got == {"bytes": ("utf8", 300)}


def test_lengths():
    texts = ['a&<"\n\r\né😀\\', "\n", "\r", "\n\n'ü>\t", "x", "😀\r\n"]
    for t, row in zip(texts, truncation.stored_lengths(texts)):
        got = dict(zip(truncation.FORMS, row.tolist()))
        octets = len(t.encode()) - len(t)
        want = {"code_points": len(t), "utf8": len(t.encode()), "utf16": len(t.encode("utf-16-le")) // 2, "entities": len(html.escape(t)), "json": len(json.dumps(t, ensure_ascii=False)) - 2, "json_ascii": len(json.dumps(t)) - 2}
        want |= {"crlf": len(t.replace("\r\n", "\n").replace("\n", "\r\n")), "lf": len(t.replace("\r\n", "\n"))}
        assert got == want | {f"{k}_utf8": want[k] + octets for k in ("entities", "json", "crlf", "lf")}


def test_longer_texts_hide_no_limit(spark):
    rnd = random.Random(4)
    rows = corpus() + [(7000 + i, full(rnd, 60 + i), "bytes") for i in range(9)] + [(7100, full(rnd, 3000), "bytes")]
    got = {(r.source, r.form, r.cap) for r in truncation.storage_limits(docs(spark, rows)).collect()}
    assert got == {("bytes", "utf8", 300)}


def test_a_length_that_complete_texts_have_is_no_limit(spark):
    rnd = random.Random(6)
    rows = corpus() + [(8000 + i, full(rnd, 3)[:90] + f" number {i:04d} was sent. It was read by all.", "free") for i in range(50)]
    rows += [(8100, "Ask the carrier about", "free")] * 40  # copies are one text
    got = {(r.source, r.form, r.cap) for r in truncation.storage_limits(docs(spark, rows)).collect()}
    assert got == {("bytes", "utf8", 300)}


def test_word_pairs():
    two, of, ends = truncation.word_pairs(['He said "go on." Then (12) left!', "", "one", "GO ON"])
    assert of.tolist() == [0] * 6 + [3] and ends.tolist() == [False, False, True, False, False, True, False]
    assert two[2] == two[6]


def test_endings(spark):
    body = SENTENCES[0] + ". " + SENTENCES[1] + ". "
    cut = ["The carrier acc", "The carrier accepted the", "The carrier accepted the [...]", "The carrier acce�", "The lab\n--- connection closed ---", "The lab returned the sam <cut>"]
    whole = [SENTENCES[2] + ".", SENTENCES[2], SENTENCES[2] + "…", "- One item\n- Valve drawing", "https://a.example/x/1", "Site survey|34|1,00", "Kind regards,\nJana Moor", "\n\nJana Moor\nSenior Buyer", SENTENCES[2] + " 🙂", SENTENCES[2] + ".\n\nPage 3 of 3", "3 enclosures", "END"]
    rows = corpus() + [(5000 + i, body + ("\n\n" if x[0] in "-hSK3E\n" else "") + x, "free") for i, x in enumerate(whole)] + [(6000 + i, body + x, "free") for i, x in enumerate(cut)]
    got = {r.doc_id for r in truncation.truncated(docs(spark, rows)).collect()}
    assert {k for k in got if k >= 6000} == {6000 + i for i in range(len(cut))}
    assert not {k for k in got if 5000 <= k < 6000}
    assert {k for k in got if k < 1060} >= {r[0] for r in rows if 1000 <= r[0] < 1060 and not r[1].endswith(".") and len(r[1].encode()) >= 297}


def test_edge_cases(spark):
    d = docs(spark, [(1, None, None), (2, "", "a"), (3, "  \n", "a"), (4, "n/a", None), (None, "x", None), (5, "-", "a"), (6, "w " * 300_000 + "end.", "a"), (6, "w " * 300_000 + "end.", "a")])
    assert truncation.truncated(d).count() == 0
    assert truncation.truncated(d.limit(0)).count() == 0
    assert {r.source: r.n_texts for r in truncation.report(d).collect()}["a"] >= 3


def test_tails_that_stand_inside_sentences_mostly_are_no_ends(spark):
    docs = [(i, f"Number {chr(97 + i)} says we look at the plan again. Then {chr(97 + i)} read of the plan.") for i in range(4)]
    docs += [(10 + i, f"Today {chr(97 + i)} saw of the plan that was made with of the plan we had in mind.") for i in range(4)]
    docs += [(20 + i, f"It was kind of {chr(97 + i)} to send best wishes.") for i in range(4)]
    docs += [(30 + i, "The same text ends with rare words.") for i in range(4)]
    docs += [(50, "They all looked once more at the plan..."), (51, "They all looked once more at the…"), (52, "They all looked once more at the plan [...]")]
    docs += [(40, "My long report was about the rest of the plan"), (41, "We all send you and your house best wishes"), (42, "My long report was on a few rare words")]
    d = spark.createDataFrame([(i, "a", t) for i, t in docs], "doc_id long, source string, text string")
    assert {r.doc_id for r in truncation.truncated(d).collect()} == {40, 42, 51, 52}


def test_what_is_put_after_a_cut_proves_no_sentence_end(spark):
    who = ["carrier", "insurer", "courier", "lab", "board"]
    docs = [(10 + i, f"The {w} looked at the plan. Then the {w} went to the har" + ("..." if i % 2 else " [...]")) for i, w in enumerate(who)]
    docs += [(20, "Nobody of them all knew how to get to the har"), (21, "They all came in and went to the har (...)")]
    docs += [(30 + i, f"They filed it for {w} in folder 1234{i}. S. Moor read the report by the {w}.") for i, w in enumerate(who)]
    docs += [(40, "They filed it once more in folder 12"), (41, "They filed it once more in folder 54321"), (42, "They filed it once more in folder 98765. s")]
    docs += [(50 + i, f"When {w} asked, the tenant of {w} came with the tenant we know. It was the tenant that {w} met. " * 9 + f"So said {w} of the tenant.") for i, w in enumerate(who)]
    docs += [(60, "They all met once more after the tenant..."), (61, "They all looked once more at the plan...")]
    d = spark.createDataFrame([(i, "a", t) for i, t in docs], "doc_id long, source string, text string")
    assert {r.doc_id for r in truncation.truncated(d).collect()} == {10, 11, 12, 13, 14, 20, 21, 40, 42, 60}


def test_stops_of_word_pairs():
    _, _, ends = truncation.word_pairs(["to the har...", "to the har [...]", "to the har. (...)", "by S. Moor", "is 5. go on?"])
    assert ends.tolist() == [False] * 5 + [True, False, False, True, False, True]
