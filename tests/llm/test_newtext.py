from lodestrata.llm import newtext

SCHEMA = "artifact_id long, producer_expert string, text_content string, line string, sent long"
HEAD = "Subject: {s}\nFrom: {f}\nTo: x@y.example\nDate: {d}\n\n"


def mail(body, s="Re: Thing 12", f='"Kestander, Jana" <jana@a.example>', d="Mon, 3 Jun 2024 10:00 +0000"):
    return HEAD.format(s=s, f=f, d=d) + body


BODY = """Dear Ms Moor,

The plan is ready and the count is done.
> 60 is what they said
Von: Halle 8 bis Tor 2 ist gesperrt.
-- the second point is the price of 60 crates --
On Monday the planner wrote:
no access before noon.

Kind regards
Jana Kestander
Senior Buyer, Somewhere
jana@a.example

LEGAL NOTICE
This is private.

On Sat, 1 Jun 2024 09:00,
Owen Moor <o@b.example> wrote:
> Hello Jana,
>
> Please count.

My reply in place stands here.

> And again?
"""


def new(spark, rows):
    d = spark.createDataFrame([(*r, "l", 1) for r in rows], SCHEMA)
    out = {}
    for r in newtext.newly_written(d).collect():
        out.setdefault(r.artifact_id, []).append(r.line_no)
    return {k: sorted(v) for k, v in out.items()}


def test_lines_of_a_mail(spark):
    t = mail(BODY)
    lines = t.split("\n")
    got = [lines[i - 1] for i in new(spark, [(1, "EmailToSearchContextExpert", t)])[1]]
    assert got == ["Dear Ms Moor,", "The plan is ready and the count is done.", "Von: Halle 8 bis Tor 2 ist gesperrt.", "-- the second point is the price of 60 crates --", "On Monday the planner wrote:", "no access before noon.", "My reply in place stands here."]


def test_older_message_without_marks(spark):
    body = "Short answer here.\n\n-----Original Message-----\nFrom: Owen Moor\nSent: Mon\nTo: Jana\nSubject: Thing\n\nOld text stands here.\n"
    assert new(spark, [(1, "EmailToSearchContextExpert", mail(body).replace("\n", "\r\n"))]) == {1: [6]}


def test_indented_quotes(spark):
    body = "Am 01.06.2024 um 09:00 schrieb Owen Moor:\n    Hallo,\n    alter Text.\n\nNeuer Text darunter.\n"
    assert new(spark, [(1, "EmailToSearchContextExpert", mail(body))]) == {1: [10]}


def test_thread_keeps_the_first_author(spark):
    line = "This longer sentence was first written by Owen in June, see there.\n"
    a = mail("Hi,\n" + line, s="Thing 12", f="Owen Moor <o@b.example>", d="Sat, 1 Jun 2024 09:00 +0000")
    b = mail("Hello,\n" + line + "And this is mine.\n")
    assert new(spark, [(1, "EmailToSearchContextExpert", a), (2, "EmailToSearchContextExpert", b)]) == {1: [6, 7], 2: [6, 8]}


def test_edge_cases(spark):
    e = "EmailToSearchContextExpert"
    rows = [(1, e, None), (2, e, ""), (3, e, " \n\t\n"), (4, e, "no header at all"), (5, "Office", mail("x")), (6, e, mail("Once.\n")), (6, e, mail("Once.\n")), (7, None, mail("x")), (8, e, mail("y " * 400_000)), (9, e, "Subject: a\nFrom: b\n\n"), (10, e, "Subject: a\nFrom: b")]
    assert new(spark, rows) == {4: [1], 6: [6], 8: [6]}
    d = spark.createDataFrame([(*r, "l", 1) for r in rows], SCHEMA)
    assert {r.artifact_id for r in newtext.new_texts(d).collect() if r.new_text} == {4, 6, 8}
    assert newtext.newly_written(d.limit(0)).count() == 0


def test_reasons_of_lines(spark):
    e = "EmailToSearchContextExpert"
    text = "The first message says something that is long enough to be known again.\n"
    foot = "\nKind regards\nOwen Moor\n+44 20 7946 0000\n"
    owen, jana = "Owen Moor <o@b.example>", "Jana <jana@a.example>"
    rows = [
        (1, e, mail("Hi,\n" + text + foot, s="Thing 12", f=owen, d="Sat, 1 Jun 2024 09:00 +0000")),
        (2, e, mail("My answer.\n\n> Hi,\n> " + text + "> A line of a mail that is gone.\n", f=jana, d="Sun, 2 Jun 2024 09:00 +0000")),
        (3, e, mail("Again.\n" + foot + "\n-----Original Message-----\nFrom: Jana\nSent: Sunday\n\nMy answer.\n>> " + text, f=owen, d="Mon, 3 Jun 2024 09:00 +0000")),
        (4, e, mail("Other matter.\n" + foot, s="Another", f=owen, d="Tue, 4 Jun 2024 09:00 +0000")),
    ]
    d = spark.createDataFrame([(*r, "l", 1) for r in rows], SCHEMA)
    got = {(r.artifact_id, r.line_no): r.why for r in newtext.reasons(d).collect()}
    assert {k[1]: v for k, v in got.items() if k[0] == 2} == {1: "header", 2: "header", 3: "header", 4: "header", 6: "new", 8: "thread", 9: "thread", 10: "mark"}
    third = {rows[2][2].split("\n")[n - 1]: v for (i, n), v in got.items() if i == 3}
    assert third["Again."] == "new" and third["My answer."] == "thread" and third[">> " + text.strip()] == "thread" and third["From: Jana"] == "older" and third["Owen Moor"] == "sender"
    assert {v for k, v in got.items() if k[0] == 4 and k[1] > 8} == {"sender"}
    n = {r.why: r.n_lines for r in newtext.steps(d).collect()}
    assert sum(n.values()) == len(got) and n["new"] == 5


def test_a_line_that_many_mails_of_a_thread_share(spark):
    e = "EmailToSearchContextExpert"
    line = "This notice about the house is sent to everyone who works on the ground floor.\n"
    rows = [(i, e, mail(line + f"Number {i}.\n", s="Notice", f=f"P{i} <p{i}@a.example>", d=f"Sat, {1 + i // 24} Jun 2024 {i % 24:02d}:00 +0000")) for i in range(300)]
    got = new(spark, rows)
    assert sum(6 in v for v in got.values()) == 1 and 6 in got[0] and all(7 in v for v in got.values())
