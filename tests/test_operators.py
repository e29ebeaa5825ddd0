import io
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from lodestrata.functions import text
from lodestrata.operators import chunking, context, evaluation, query, ranking, redaction, registry, stats, validation, vector
from lodestrata.sources import files, providers
from lodestrata.streaming import ingest


def one(spark, value, column, schema="x string"):
    return spark.createDataFrame([(value,)], schema).select(column).first()[0]


@pytest.mark.parametrize("n", [0, 1, 1999, 2000, 2001, 3800, 3801, 9000])
@pytest.mark.parametrize("target,overlap", [(2000, 200), (10, 0), (7, 6)])
def test_chunks_cover_the_text(spark, n, target, overlap):
    if n > 4000 and target < 100:
        n = 50
    t = "".join(random.Random(n).choice("ab é😀") for _ in range(n))
    got = chunking.chunk(spark.createDataFrame([(1, t)], "k int, text string"), "text", ("k",), target, overlap).orderBy("chunk_index").collect()
    want, at = [], 0
    while n and (not want or want[-1][1] < n):
        want.append((at, min(at + target, n)))
        at += target - overlap
    assert [(r.start_char, r.end_char) for r in got] == want
    assert all(t[r.start_char : r.end_char] == r.chunk_text for r in got)


def test_chunk_settings_are_checked(spark):
    for target, overlap in ((0, 0), (10, 10), (10, -1)):
        with pytest.raises(ValueError):
            chunking.check(target, overlap)


def test_chunks_of_null(spark):
    assert chunking.chunk(spark.createDataFrame([(1, None)], "k int, text string")).count() == 0


def test_tokens(spark):
    assert sorted(one(spark, "The Risk of_x, risk ab é12 n42", text.tokens("x"))) == ["n42", "of_x", "risk"]
    assert one(spark, None, text.tokens("x")) is None
    assert one(spark, " a\r\nb\t\tc \n\n\n\nd ", text.normalize("x")) == "a\nb c \n\nd"
    assert one(spark, "a.b/c.TXT", text.file_type("x")) == "txt" and one(spark, "a.b/c", text.file_type("x")) is None
    assert one(spark, "/x/Inbox/1.", text.is_maildir("x")) and not one(spark, "/x/inbox/1.txt", text.is_maildir("x"))


def test_shard_is_the_hash_modulo_64(spark):
    import hashlib

    for t in ("risk", "tion", "naïve"):
        want = int.from_bytes(hashlib.sha256(t.encode()).digest()[:8], "big") % 64
        assert one(spark, t, text.term_shard("x")) == want


def test_intent_bonus_of_the_known_trace(spark):
    words = "executive strategy risk born"
    assert round(one(spark, words, ranking.intent_bonus(text.token_bag("x"))), 6) == -2.29


def _ranked(spark, rows):
    return spark.createDataFrame(rows, "query_id long, chunk_key long, logical_path string, chunk_index int, rank int, score double, text string")


def brute_mmr(rows, weight=0.5, most=5, penalty=0.2, near=0.85):
    words = {r[1]: set(r[6].split()) for r in rows}
    jac = lambda a, b: len(words[a] & words[b]) / len(words[a] | words[b]) if words[a] and words[b] else 0.0
    top, chosen = max(r[5] for r in rows), [rows[0]]
    while len(chosen) < most:
        best = None
        for r in rows:
            if r in chosen:
                continue
            sim = max(jac(r[1], c[1]) for c in chosen)
            if sim >= near:
                continue
            v = weight * r[5] / top - (1 - weight) * sim - (penalty if any(c[2] == r[2] for c in chosen) else 0)
            if best is None or v > best[0]:
                best = (v, r)
        if best is None:
            break
        chosen.append(best[1])
    return [r[1] for r in chosen]


def test_mmr_is_greedy(spark):
    rnd = random.Random(5)
    for case in range(6):
        rows = [(1, k, f"p{rnd.randrange(4)}", k, k + 1, float(20 - k), " ".join(rnd.sample("abcdefgh", rnd.randrange(1, 6)))) for k in range(12)]
        got = [r.chunk_key for r in ranking.mmr(_ranked(spark, rows)).orderBy("rank").collect()]
        assert got == brute_mmr(rows), case


def test_score_gap_keeps_three(spark):
    rows = [(1, k, "p", k, k + 1, s, "t") for k, s in enumerate((10.0, 1.0, 0.9, 0.8))] + [(2, k, "p", k, k + 1, s, "t") for k, s in enumerate((10.0, 9.0, 3.6, 3.5, 3.4))]
    got = ranking.score_gap(_ranked(spark, rows)).groupBy("query_id").count().collect()
    assert {r.query_id: r["count"] for r in got} == {1: 3, 2: 4}


def test_context_stops_at_the_budget(spark):
    rows = [(1, 1, "a", 0, 1, 1.0, "x" * 100), (1, 2, "a", 1, 2, 1.0, "y"), (1, 3, "b", 0, 3, 1.0, " \n"), (1, 4, "c", 0, 4, 1.0, "z" * 500), (1, 5, "d", 0, 5, 1.0, "w")]
    x = context.judged(_ranked(spark, rows).withColumn("query_text", F.lit("q")), 400, 1)
    assert [r.verdict for r in x.orderBy("rank").collect()] == ["included", "source_cap", "empty_text", "max_context_chars", "beyond"]
    assert context.assemble(_ranked(spark, rows).withColumn("query_text", F.lit("q")), 400, 1).first().n_sources == 1


def test_answer_without_context(spark):
    x = spark.createDataFrame([(1, "q", "", [])], "query_id long, query_text string, context_text string, sources array<struct<logical_path:string,chunk_index:int,score:double>>")
    assert context.answer(x).first().answer_text == context.NOTHING


def test_spans_are_resolved_greedily(spark):
    rnd = random.Random(3)
    cases = [sorted({(a, a + rnd.randrange(1, 6), rnd.randrange(3)) for a in (rnd.randrange(20) for _ in range(rnd.randrange(9)))}) for _ in range(40)]
    rows = [(i, *x) for i, c in enumerate(cases) for x in rnd.sample(c, len(c))]
    got = redaction.resolve(spark.createDataFrame(rows, "artifact_id long, start_char int, end_char int, rule_order int")).collect()
    for i, c in enumerate(cases):
        want, at = [], 0
        for x in c:
            if x[0] >= at:
                want.append(x)
                at = x[1]
        assert sorted(tuple(r)[1:] for r in got if r.artifact_id == i) == want


def test_spans_of_texts_that_hold_the_mark(spark):
    mark = redaction._EDGE
    t = f"{mark}a@b.example {mark} c@d.example{mark}"
    d = spark.createDataFrame([(1, t), (2, "a@b.example"), (3, "😀 x@y.example"), (None, "a@b.example"), (4, mark)], "artifact_id long, text_content string")
    got = sorted((r.artifact_id, r.start_char, r.original) for r in redaction.span_rows(d, "identity_contact", True).collect())
    assert got == [(1, 2, "a@b.example"), (1, 17, "c@d.example"), (2, 0, "a@b.example"), (3, 2, "x@y.example")]


def test_all_rules_find_their_shape(spark):
    t = "account number: 12345678 routing no. 021000021 card number 4111 1111 1111 1111 paid $1,500.50 and 250 USD IBAN GB82WEST12345698765432 swift code: DEUTDEFF500 mail u@example.com phone: (415) 555-0134 SSN 123-45-6789 DOB: 01/31/1980"
    d = spark.createDataFrame([(1, t), (2, None), (3, "")], "artifact_id long, text_content string")
    for profile, rules in redaction.PROFILES.items():
        got = redaction.span_rows(d, profile, True).collect()
        assert {r.category for r in got} == {r.category for r in rules}
        assert all(t[r.start_char : r.end_char] == r.original for r in got)
    out = redaction.apply(d, redaction.plan(d, "identity_contact")).orderBy("artifact_id").collect()
    assert "[EMAIL]" in out[0].redacted_text and "u@example" not in out[0].redacted_text and out[1].redacted_text is None
    with pytest.raises(ValueError):
        redaction.check("identity_contact", "v1", "v1")


def test_percentiles_round_to_even(spark):
    d = spark.createDataFrame([(v,) for v in (4, 1, 3, 2)], "v int")
    assert {r.p: r.value for r in stats.percentiles(d, "v").collect()} == {0.0: 1, 0.5: 3, 0.95: 4, 1.0: 4}
    assert stats.percentiles(d.where("v > 9"), "v").count() == 0


def test_metrics_edge_cases(spark):
    r = spark.createDataFrame([(1, "a", 1, 2.0), (1, "a", 2, 1.0), (1, "b", 3, 0.5), (2, "c", 1, 1.0)], "query_id long, source string, rank int, score double")
    e = spark.createDataFrame([(1, "b"), (1, "b"), (3, "x")], "query_id long, source string")
    got = {x.query_id: x for x in evaluation.metrics(r, e, 10).collect()}
    assert (got[1].recall, got[1].reciprocal_rank, got[1].precision_at_k) == (1.0, 0.5, 0.1)
    assert got[2].n_expected == 0 and got[3].n_returned == 0 and got[3].recall == 0.0


def test_delta_and_upserts(spark):
    state = spark.createDataFrame([("a", "1"), ("b", "2")], "logical_path string, sha256 string")
    now = spark.createDataFrame([("a", "1"), ("b", "3"), ("c", "4")], "logical_path string, sha256 string")
    assert {r.logical_path: r.change for r in registry.delta(state, now).collect()} == {"a": "unchanged", "b": "changed", "c": "new"}


def test_validation(spark):
    x = spark.createDataFrame([(None, 2), ([], 2), ([1.0], 2), ([0.0, 0.0], 2), ([float("nan"), 1.0], 2), ([1.0, 2.0], 2)], "vector array<float>, embedding_dim int")
    assert [r.errors for r in validation.vectors(x).collect()] == [["empty_vector"], ["empty_vector", "dimension"], ["dimension"], ["zero_vector"], ["not_finite"], []]
    with pytest.raises(ValueError):
        validation.chunks(x)


def test_expansion_and_rewrite(spark):
    assert one(spark, "Risk of  delay", query.expand("x")) == ["Risk of  delay", "risk of delay risk_management hedging"]
    assert one(spark, "delay", query.expand("x")) == ["delay"]
    d = spark.createDataFrame([(1, "lease 2020", "lease 2021", "OK", ""), (2, "lease", "lease terms", "OK", ""), (3, "lease", None, None, None)], "query_id long, original_query string, rewritten_query string, rewrite_status string, rationale string")
    got = {r.query_id: r for r in query.check_rewrite(d).collect()}
    assert got[1].query_text == "lease 2020" and "added_numbers" in got[1].rejection_reasons
    assert got[2].added_terms == "terms" and not got[2].used_fallback and got[3].used_fallback


def test_top_k_against_brute_force(spark):
    rnd = random.Random(1)
    vs = [(i, [rnd.gauss(0, 1) for _ in range(8)]) for i in range(60)]
    v = spark.createDataFrame(vs, "chunk_key long, vector array<float>")
    q = spark.createDataFrame(vs[:3], "query_id long, vector array<float>")
    got = [(r.query_id, r.chunk_key) for r in vector.top_k(q, v, 5).orderBy("query_id", "rank").collect()]
    cos = lambda a, b: sum(x * y for x, y in zip(a, b)) / (sum(x * x for x in a) * sum(y * y for y in b)) ** 0.5
    want = [(i, k) for i, a in vs[:3] for k, _ in sorted(vs, key=lambda p: -cos(a, p[1]))[:5]]
    assert got == want


def test_files(spark, tmp_path):
    (tmp_path / "in" / "Inbox").mkdir(parents=True)
    z = io.BytesIO()
    with zipfile.ZipFile(z, "w") as f:
        f.writestr("x/a b.docx", b"one"), f.writestr("c.txt", b"two")
    (tmp_path / "in" / "ok.zip").write_bytes(z.getvalue())
    (tmp_path / "in" / "bad.zip").write_bytes(b"no archive")
    (tmp_path / "in" / "Inbox" / "1.").write_bytes(b"Subject: Hi\nFrom: a@b.example\nTo: c@d.example\nDate: now\n\nBody text\n")
    (tmp_path / "in" / "t.txt").write_bytes(b"left out")
    inv = files.inventory(spark, str(tmp_path / "in"), content=True)
    assert sorted(r.logical_path for r in inv.collect()) == ["Inbox/1.", "bad.zip", "ok.zip"]
    full, failed = files.expanded(inv)
    assert {r.logical_path for r in full.collect()} == {"Inbox/1.", "bad.zip", "ok.zip", "ok.zip::x/a b.docx"}
    assert [r.logical_path for r in failed.collect()] == ["bad.zip"]
    d = files.extract(inv.withColumn("artifact_id", F.xxhash64("logical_path")))
    got = {r.logical_path: r for r in d.collect()}
    assert got["Inbox/1."].text_content == "Subject: Hi\nFrom: a@b.example\nTo: c@d.example\nDate: now\n\nBody text"
    assert got["ok.zip"].status == "FAILED"


def test_ingestion_plan_skips_what_is_known(spark, tmp_path):
    from lodestrata.plans.ingestion import ingest as run

    (tmp_path / "maildir").mkdir()
    (tmp_path / "maildir" / "1.").write_bytes(b"Subject: A\n\n" + b"word " * 900)
    inv = files.inventory(spark, str(tmp_path), content=True)
    none = spark.createDataFrame([], "source_path string, source_hash string, artifact_type string")
    over = spark.createDataFrame([], "artifact_id long")
    plan, docs, chunks = run(inv, none, over)
    assert plan.first().action == "convert" and docs.first().status == "COMPLETE" and chunks.count() == 3
    known = inv.select(F.col("logical_path").alias("source_path"), F.col("sha256").alias("source_hash"), F.explode(F.array(F.lit(registry.DOCUMENT), F.lit(registry.CHUNKS))).alias("artifact_type"))
    assert run(inv, known, over)[0].first().action == "skip"


def test_providers(spark):
    e = providers.HashEmbedder(16)
    assert providers.healthy(e)
    c = spark.createDataFrame([(1, "alpha beta"), (2, "  "), (3, None), (4, " alpha beta ")], "chunk_key long, text string")
    got = {r.chunk_key: r for r in providers.embed(c, e, "m", 2).collect()}
    assert set(got) == {1, 4} and got[1].vector == got[4].vector and got[1].text_hash == got[4].text_hash


def test_stream_counts_a_replay_once(spark, tmp_path):
    schema = "artifact_id long, logical_path string, created_utc long, producer_expert string, text_content string"
    rows = [(1, "a", 1704067200, "e", "x" * 2500), (1, "a", 1704070800, "e", "x" * 2500), (2, "b", 1704067300, "e", "y")]
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "in"))
    s = ingest.read(spark, str(tmp_path / "in"), schema)
    ingest.write(ingest.chunks(ingest.current(s)), str(tmp_path / "out"), str(tmp_path / "cp"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 3


def test_artifacts_of_other_kinds(spark):
    common = "artifact_type string, schema_version string, created_utc long, producer_expert string, run_id string, status string"
    head = ("query_answer", "v1", 1, "e", "r", "OK")
    d = spark.createDataFrame([(*head, "q", "bm25", 5, "a", 2, ["x"]), (*head, "q", "bm25", 5, "a", 1, ["x"])], common + ", query_text string, ranker string, top_k int, answer_text string, source_count int, sources array<string>")
    assert [r.errors for r in validation.artifact(d, "query_answer").collect()] == [["source_count"], []]
    for bad, kind in ((d.drop("sources"), "query_answer"), (d, "query_context_x"), (d.withColumn("sources", F.lit("x")), "query_answer")):
        with pytest.raises(ValueError):
            validation.artifact(bad, kind)


def test_rewrite_service_may_fail(spark):
    def ask(q):
        if q == "b":
            raise OSError("down")
        return {"rewritten_query": q + " x"}

    q = spark.createDataFrame([(1, "a"), (2, "b")], "query_id long, query_text string")
    got = {r.query_id: r for r in providers.rewrites(q, ask).collect()}
    assert got[1].rewritten_query == "a x" and got[2].rewrite_status == "FALLBACK_ORIGINAL" and got[2].rewritten_query == "b"


def test_redacted_text_takes_the_place_of_the_original(spark):
    d = spark.createDataFrame([(1, "a"), (2, "b")], "artifact_id long, text_content string")
    r = spark.createDataFrame([(2, "[X]")], "artifact_id long, redacted_text string")
    assert {x.artifact_id: (x.origin, x.text_content) for x in registry.effective_texts(d, r).collect()} == {1: ("original", "a"), 2: ("override", "[X]")}
    assert evaluation.usable_ranker("hybrid", False)[0] == "bm25"


def test_command_line(spark, sf, tmp_path, capsys):
    import json

    from lodestrata.__main__ import main

    (tmp_path / "in" / "maildir").mkdir(parents=True)
    (tmp_path / "in" / "maildir" / "1.").write_bytes(b"Subject: Valve count\n\nThe valve count is done.\n")
    main(["ingest", "--source-root", str(tmp_path / "in"), "--out", str(tmp_path / "out")])
    assert json.loads(capsys.readouterr().out) == {"run_id": 1, "converted": 1, "failed": 0, "status": "SUCCESS"}
    main(["ingest", "--source-root", str(tmp_path / "in"), "--out", str(tmp_path / "again"), "--runs", str(tmp_path / "out" / "runs")])
    assert json.loads(capsys.readouterr().out)["run_id"] == 2 and spark.read.parquet(str(tmp_path / "again" / "runs")).count() == 2
    assert spark.read.parquet(str(tmp_path / "again" / "decisions")).first().decision_type == "convert"
    c = spark.read.parquet(f"{sf}/search_context_chunk.parquet").dropDuplicates(["chunk_key"])
    c.write.parquet(str(tmp_path / "chunks"))
    main(["query", "--query", "lease agreement risk", "--chunks", str(tmp_path / "chunks"), "--ranker", "bm25"])
    out = json.loads(capsys.readouterr().out)
    assert out["sources"] and "[SOURCE: " in out["context"] and len(out["expanded"]) == 2
    main(["query", "--query", "zzzzz", "--chunks", str(tmp_path / "chunks")])
    assert json.loads(capsys.readouterr().out)["answer"] == context.NOTHING
    main(["stats", "--documents", f"{sf}/search_context_document.parquet", "--chunks", f"{sf}/search_context_chunk.parquet", "--embeddings", f"{sf}/embedding_vector_batch.parquet"])
    assert json.loads(capsys.readouterr().out)["chunk_count"] > 0
