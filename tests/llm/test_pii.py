import pytest

from lodestrata.llm import pii

NAMES = {"jana": "f", "hugo": "f", "ines": "f", "kestander": "s", "moor": "s", "quillfeld": "s"}


@pytest.fixture(scope="module")
def a():
    return pii.automaton(NAMES)


def found(t, a):
    return [(t[s:e], k) for s, e, k in pii.find(t, a)]


@pytest.mark.parametrize(
    "text,want",
    [
        ("Write to j.kestander+x@solvane.example.org.", [("j.kestander+x@solvane.example.org", "email")]),
        ("at jk [at] a-b [dot] example [dot] com now", [("jk [at] a-b [dot] example [dot] com", "email")]),
        ("at jk (at) a.example", [("jk (at) a.example", "email")]),
        ("a @ b and x@y", []),
        ("Tel. +44 20 7946 0916", [("+44 20 7946 0916", "phone")]),
        ("M: (555) 555-0135\n172 Weir Lane, Coldmere ZZ2 4QX", [("(555) 555-0135", "phone"), ("172 Weir Lane, Coldmere ZZ2 4QX", "address")]),
        ("0049 (0)30 23125 509 or 900-004-365", [("0049 (0)30 23125 509", "phone"), ("900-004-365", "phone")]),
        ("Part 497-828-AX, host 192.0.2.17, ticket 4339-88-20540, 2024-03-11, 00414936 kWh", []),
        ("ID  number\n> QQ 36 88 91 C.", [("QQ 36 88 91 C", "identity")]),
        ("gave 974021652 as proof", [("974021652", "identity")]),
        ("el documento X-0018262-T.", [("X-0018262-T", "identity")]),
        ("(910-05-3741) as the payee", [("910-05-3741", "identity")]),
        ("die Nummer 00858368146.", [("00858368146", "identity")]),
        ("at Flat 12, 131 Quarry Bank, Port Wendle now", [("Flat 12, 131 Quarry Bank, Port Wendle", "address")]),
        ("57 bis, rue des Tanneries, 99417 Saint-Aubrin", [("57 bis, rue des Tanneries, 99417 Saint-Aubrin", "address")]),
        ("a Calle del Molino 117, 99142 Torrealba del Mar.", [("Calle del Molino 117, 99142 Torrealba del Mar", "address")]),
        ("bei Am Alten Speicher 149 und Werftstr. 107", [("Am Alten Speicher 149", "address"), ("Werftstr. 107", "address")]),
        ("Room 126, rack 920: the bank 12 is closed", []),
        ("Jana T. Kestander-Moor wrote; Ms van der Moor too", [("Jana T. Kestander-Moor", "name"), ("van der Moor", "name")]),
        ('To: "O\'Kestander, Hugo" and HUGO MOOR', [("O'Kestander, Hugo", "name"), ("HUGO MOOR", "name")]),
        ("machines and jana@x.example", [("jana@x.example", "email")]),
        ("Project Moor, Moor & Sons, Kestander Street", []),
        ("According to Ines, nobody came. J. K.", [("Ines", "name")]),
        ("Dear Ms Unbekanntova,", [("Unbekanntova", "name")]),
        ("Hugo Quillfeld\n555.555.0117", [("Hugo Quillfeld", "name"), ("555.555.0117", "phone")]),
    ],
)
def test_spans(text, want, a):
    assert found(text, a) == want


def test_redaction_keeps_the_rest(a):
    t = "İstanbul 😀: Jana Moor, jana@x.example\r\n+44 20 7946 0916."
    assert pii.redact(t, a) == "İstanbul 😀: [NAME], [EMAIL]\r\n[PHONE]."
    assert pii.redact(None, a) is None and pii.redact("", a) == ""


def test_frames(spark):
    docs = spark.createDataFrame([(t, 1) for t in ['From: "Moor, Jana" <j@x.example>\nTo: Hugo Kestander <h@x.example>\n\nx', "Von: Jana Moor\nAn: Hugo Kestander\n\ny", "Von: Halle 8 bis Tor 2 ist gesperrt.", None, ""]], "text_content string, kind int")
    lex = pii.lexicon(docs)
    assert lex == {"jana": "f", "hugo": "f", "moor": "s", "kestander": "s"}
    rows = [("document", 1, "Jana Moor", 1, "k"), ("document", 1, "Jana Moor", 2, "k"), ("chunk", 1, None, None, None), ("chunk", 2, "", 0, ""), ("chunk", None, "Hugo", 0, ""), ("chunk", 4, "word " * 300_000 + "Hugo", 0, "")]
    d = spark.createDataFrame(rows, "tbl string, record_key long, text string, start_char int, kind string")
    got = {(r.tbl, r.record_key, r.start_char, r.kind) for r in pii.spans(d, lex).collect()}
    assert got == {("document", 1, 0, "name"), ("chunk", None, 0, "name"), ("chunk", 4, 1_500_000, "name")}
    out = {(r.tbl, r.record_key): r.text for r in pii.redacted(d, lex).collect()}
    assert out["document", 1] == "[NAME]" and out["chunk", 1] is None and len(out) == 5
    assert pii.spans(d.limit(0), lex).count() == 0
    assert pii.spans(d, {}).count() == 0
    with pytest.raises(ValueError):
        pii.lexicon(docs, most=2)


def test_anchored_digits_are_those_of_a_whole_scan():
    import random

    rnd = random.Random(1)
    for _ in range(3000):
        t = "".join(rnd.choices(["1", "23", "4567", " ", "+", "(", ")", "-", ".", "x", "@", "\n> "], weights=[3, 3, 4, 3, 1, 1, 1, 2, 1, 1, 1, 1], k=rnd.randint(1, 25)))
        after, got = 0, []
        for p, c in enumerate(t):
            if c.isdigit() and p >= after and (m := pii._digits_at(t, p, after)):
                got.append(m.span())
                after = m.end()
        assert got == [m.span() for m in pii._DIGITS.finditer(t)]
