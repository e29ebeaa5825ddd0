import itertools
import random

import pytest

from lodestrata.llm import mixing

D = "doc_id long, text string, source string, uses int, at long"
T = "source string, target_share double, max_repeats int, n_texts int"


def docs(spark, rows):
    return spark.createDataFrame([(*r, 1, 1) for r in rows], D)


def targets(spark, rows):
    return spark.createDataFrame([(*r, 1) for r in rows], T)


def test_flow_is_feasible_and_best():
    patterns = [(("a",), 100), (("a", "b"), 50), (("b",), 10)]
    total, flow = mixing.route(patterns, {"a": (0.5, 1), "b": (0.5, 2)})
    take = lambda s: sum(n for (i, t), n in flow.items() if t == s)
    assert abs(take("a") - take("b")) <= 1 and abs(take("a") + take("b") - total) <= 2
    assert total in (220, 221)  # a: 100 of its own and 10 shared; b: 2 * 10 and 90 shared, of 2 * 50 shared in all
    for i, (p, n) in enumerate(patterns):
        assert sum(flow.get((i, s), 0) for s in p) <= n * 2


def test_first_uses_come_before_repeats():
    total, flow = mixing.route([(("a",), 10), (("a",), 10)], {"a": (1.0, 3)}, total=20)
    assert total == 20 and sorted(flow.values()) == [10, 10]


def test_shares_and_caps(spark):
    rows = [(i, f"text number {i} of the large source with words", "big") for i in range(400)] + [(1000 + i, f"small {i} text", "small") for i in range(30)] + [(2000 + i, f"shared {i} text here", s) for i, s in itertools.product(range(20), ("big", "small"))] + [(1, "copy", "big"), (3000, None, "big"), (3001, "", "small"), (3002, "no source", None), (3003, "no target", "other")]
    t = targets(spark, [("big", 0.7, 1), ("small", 0.2, 3), ("empty", 0.1, 2), (None, 0.1, 1), ("zero", None, None)])
    m = mixing.Mixture(docs(spark, rows), t)
    rep = {r.source: r for r in m.report().collect()}
    assert abs(rep["big"].actual_share - 7 / 9) < 0.03 and abs(rep["small"].actual_share - 2 / 9) < 0.03
    assert rep["empty"].selected_tokens == 0 and rep["big"].most_uses <= 1 and rep["small"].most_uses <= 3
    sel = m.selection().collect()
    assert {r.source for r in sel} == {"big", "small"} and not {r.doc_id for r in sel} & {3000, 3001, 3002, 3003}
    assert sorted(map(tuple, sel)) == sorted(map(tuple, mixing.Mixture(docs(spark, rows), t).selection().collect()))


def test_empty(spark):
    t = targets(spark, [("a", 1.0, 1)])
    m = mixing.Mixture(docs(spark, []), t)
    assert m.selection().count() == 0 and m.report().first().selected_tokens == 0
    assert mixing.Mixture(docs(spark, [(1, "x", "a")]), t.limit(0)).selection().count() == 0
    assert pytest.approx(1.0) == mixing.Mixture(docs(spark, [(1, "x y z", "a")]), t).report().first().actual_share


def test_the_total_is_that_of_the_search(monkeypatch):
    rnd = random.Random(7)
    for _ in range(60):
        names = "abcde"[: rnd.randint(1, 5)]
        patterns = [(p, rnd.randint(1, 500)) for p in sorted({tuple(sorted(rnd.sample(names, rnd.randint(1, len(names))))) for _ in range(6)})]
        targets = {s: (rnd.random(), rnd.randint(1, 4)) for s in names}
        held = {s: v for s, v in targets.items() if any(s in p for p, _ in patterns)}
        got = mixing.greatest_total(patterns, held)
        monkeypatch.setattr(mixing, "MOST_SUMS", 0)
        assert got == mixing.route(patterns, targets)[0]
        monkeypatch.undo()


def test_windows_of_any_size_fill_the_quotas(spark, monkeypatch):
    monkeypatch.setattr(mixing, "WINDOW", 3)
    rows = [(i, f"one text of many with number {i}", "big") for i in range(200)]
    m = mixing.Mixture(docs(spark, rows), targets(spark, [("big", 1.0, 2)]))
    sel = m.selection().collect()
    assert len(sel) == 200 and {r.uses for r in sel} == {2}
