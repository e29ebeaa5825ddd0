import http.server
import json
import os
import random
import threading
import time

import numpy as np
import pytest

from lodestrata import shared
from lodestrata.functions import text
from lodestrata.operators import lexical, lifecycle, ranking, registry, stats, vector
from lodestrata.sources import files, providers

CHUNKS = "chunk_key long, logical_path string, source_path string, document_hash string, chunk_index int, chunk_id string, text string, tf int, shard string"


def chunk_table(spark, texts):
    return spark.createDataFrame([(i, f"p{i % 3}.pdf", f"/s/{i}", f"h{i}", 0, f"c{i}", t, 7, "x") for i, t in enumerate(texts)], CHUNKS)


def words(t):
    import re

    return [w for w in re.findall("[a-zA-Z0-9_]+", (t or "").lower()) if len(w) >= 3]


def wanted(query, texts):
    """Chunks with all of the rarest three, two or one terms of a query, by hand."""
    has = [set(words(t)) for t in texts]
    terms = {w for w in words(query) if w not in text.STOPWORDS}
    df = {w: sum(w in h for h in has) for w in terms}
    rare = sorted((w for w in terms if df[w]), key=lambda w: (df[w], w))[:3]
    for n in range(len(rare), 0, -1):
        found = {i for i, h in enumerate(has) if set(rare[:n]) <= h}
        if found:
            return found
    return set()


def test_candidates_against_brute_force(spark, tmp_path):
    rnd = random.Random(1)
    voc = [f"word{i}" for i in range(30)]
    texts = [" ".join(rnd.choices(voc, weights=range(1, 31), k=rnd.randint(0, 12))) + " common" for _ in range(150)] + [None, "", "The and", "Naïve word1x"]
    ix = lexical.build_index(chunk_table(spark, texts).unionByName(chunk_table(spark, texts)), f"{tmp_path}/ix")
    queries = [" ".join(rnd.sample(voc, rnd.randint(1, 5))) for _ in range(40)] + ["common", "absent", "the and", "", None, "word1 absent common"]
    q = spark.createDataFrame(list(enumerate(queries)), "query_id long, query_text string")
    got = {}
    found = lexical.candidates(q, ix)
    for r in found.collect():
        got.setdefault(r.query_id, set()).add(r.chunk_key)
    assert got == {i: w for i, t in enumerate(queries) if (w := wanted(t, texts))}
    for r in lexical.hydrate(found, q, ix).collect():
        bag = words(texts[r.chunk_key])
        assert dict(zip(r.matched_terms, r.tfs)) == {w: bag.count(w) for w in set(words(queries[r.query_id])) - set(text.STOPWORDS) if w in bag}
        assert r.dl == sum(w not in text.STOPWORDS for w in bag) and r.phrase == (queries[r.query_id].lower().strip() in texts[r.chunk_key].lower())
    n = {r.query_id: (r.candidate_count, r.filtered_out_by_file_type) for r in lexical.filter_counts(found, ix, ["PDF"]).collect()}
    assert n == {i: (len(v), 0) for i, v in got.items()}


def test_index_is_built_once_and_again_when_files_change(spark, tmp_path):
    at = f"{tmp_path}/chunks.parquet"
    chunk_table(spark, ["first text"]).write.parquet(at)
    a = lexical.index_of(spark, at)
    assert a.terms.count() == 2
    assert set(lexical.index_of(spark, at).terms.inputFiles()) == set(a.terms.inputFiles())
    time.sleep(0.01)
    chunk_table(spark, ["first text", "other words here"]).write.mode("overwrite").parquet(at)
    assert lexical.index_of(spark, at).terms.count() == 5


def test_empty_index(spark, tmp_path):
    ix = lexical.build_index(chunk_table(spark, ["x"]).limit(0), f"{tmp_path}/ix")
    q = spark.createDataFrame([(1, "word")], "query_id long, query_text string")
    assert lexical.candidates(q, ix).count() == 0 and lexical.hydrate(lexical.candidates(q, ix), q, ix).count() == 0
    assert lexical.index_stats(ix).first().asDict() == {"doc_count": 0, "chunk_count": 0, "term_count": 0, "posting_count": 0}


def test_vectors_in_blocks_against_brute_force(spark):
    rnd = np.random.default_rng(5)
    v, q = rnd.normal(size=(90, 8)), rnd.normal(size=(11, 8))
    v[50:60] = v[40:50]  # ties
    rows = [(i, x.tolist(), "n") for i, x in enumerate(v)] + [(900, [1.0], "n"), (901, None, "n"), (902, [0.0] * 8, "n"), (903, [float("nan")] * 8, "n")]
    vs = spark.createDataFrame(rows, "chunk_key long, vector array<double>, dim string")
    qs = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(q)] + [(99, [2.0]), (98, None)], "query_id long, vector array<double>")
    s = np.round((q / np.linalg.norm(q, axis=1, keepdims=True)) @ (v / np.linalg.norm(v, axis=1, keepdims=True)).T, 6)
    want = {(i, r + 1): int(j) for i in range(11) for r, j in enumerate(sorted(range(90), key=lambda j: (-s[i, j], j))[:7])} | {(99, 1): 900}
    for at_once, block in ((4096, 16_384), (3, 13)):
        got = {(r.query_id, r.rank): r.chunk_key for r in vector.top_k(qs, vs, 7, at_once, block).collect()}
        assert got == want
    assert vector.top_k(qs.limit(0), vs, 7).count() == 0 and vector.top_k(qs, vs.limit(0), 7).count() == 0


def test_fusion_scales_missing_scores_too(spark):
    cols = "query_id long, chunk_key long, logical_path string, chunk_index int, rank int, score double"
    lex = spark.createDataFrame([(1, 1, "a", 0, 1, 9.0), (1, 2, "b", 0, 2, 5.0), (2, 1, "a", 0, 1, 3.0)], cols)
    vec = spark.createDataFrame([(1, 1, "a", 0, 1, 0.9), (1, 3, "c", 0, 2, 0.7), (1, 4, "d", 0, 3, 0.5)], cols)
    got = {(r.query_id, r.chunk_key): (r.match_origin, r.fusion_score, r.rank) for r in ranking.fuse(lex, vec).collect()}
    assert got == {(1, 1): ("both", 1.0, 1), (1, 2): ("lexical_only", round(0.3 * (0 - 0.5) / 0.4, 6), 3), (1, 3): ("vector_only", round(0.3 * 0.5, 6), 2), (2, 1): ("lexical_only", 0.0, 1)}


def test_numbers_go_on_without_gaps(spark):
    df = spark.range(1000).selectExpr("id * 7 % 1000 as k", "'x' as number_of")
    got = {r.k: r.number for r in lifecycle.numbered(df, "k", after=50).collect()}
    assert got == {k: 51 + k for k in range(1000)}
    assert lifecycle.numbered(df.limit(0), "k").count() == 0


def test_runs_and_appends(spark):
    cols = "run_id long, started_utc long, finished_utc long, source_root string, status string, files_discovered long, files_eligible long, files_converted long, files_skipped long, files_failed long, notes string"
    none = spark.createDataFrame([], cols)
    runs, first = lifecycle.create_run(none, "/r", 5, 4, 100)
    runs, second = lifecycle.create_run(runs, "/r", 1, 1, 200)
    done = {r.run_id: r for r in lifecycle.finalize_run(runs, first, 3, 1, 300, "FAILED", "n").collect()}
    assert (first, second) == (1, 2) and done[1].status == "FAILED" and done[1].files_converted == 3 and done[2].status == "DISCOVERED" and done[2].finished_utc == 200
    a = spark.createDataFrame([(1, "x"), (2, None)], "k long, v string")
    again = lifecycle.append_once(a, a.unionByName(spark.createDataFrame([(3, "z")], "k long, v string")), ["k"])
    assert sorted(map(tuple, again.collect())) == [(1, "x"), (2, None), (3, "z")]


def test_approvals_and_commits(spark):
    plans = spark.createDataFrame([(1, "p", "PLANNED"), (2, "p", "FAILED"), (3, "p", "PLANNED")], "plan_id long, profile string, status string")
    had = spark.createDataFrame([(3, 30)], "plan_id long, approval_id long")
    ask = spark.createDataFrame([(1, 5), (1, 6), (2, 5), (3, 5), (4, 5), (None, 5)], "plan_id long, approved_utc long")
    got = sorted((r.plan_id or 0, r.approved_utc, r.status, r.approval_id) for r in lifecycle.approve(plans, had, ask).collect())
    assert got == [(0, 5, "plan_not_found", None), (1, 5, "RECORDED", 31), (1, 6, "already_approved", None), (2, 5, "plan_not_planned", None), (3, 5, "already_approved", None), (4, 5, "plan_not_found", None)]
    texts = spark.createDataFrame([(10, "new [X]"), (11, None), (12, "t")], "artifact_id long, redacted_text string")
    planned = spark.createDataFrame([(3, 10), (3, 11)], "plan_id long, artifact_id long")
    ask = spark.createDataFrame([(10, 3, 30, 1), (11, 3, 30, 1), (12, 3, 30, 1), (13, 1, 30, 1), (14, 3, None, 1)], "artifact_id long, plan_id long, approval_id long, created_utc long")
    c = {r.artifact_id: (r.status, r.error, r.redacted_artifact_id, r.artifact_path) for r in lifecycle.commit(texts, plans, had, planned, ask, 7).collect()}
    assert c == {10: ("COMPLETE", "", 8, "artifact_10.plan_3.p.redacted.json"), 11: ("FAILED", "no_text", None, None), 12: ("FAILED", "artifact_not_in_plan", None, None), 13: ("FAILED", "approval_of_other_plan", None, None), 14: ("FAILED", "approval_not_found", None, None)}
    assert lifecycle.commit(texts, plans, had, planned, ask.limit(0)).count() == 0


def test_truth_from_documents_on_disk(spark, tmp_path):
    at = f"file://{tmp_path}/context"
    doc = '{"artifact_type": "search_context_document", '
    files.put(spark, f"{at}/b.json", (doc + '"source_path": "/x", "document_hash": "h1"}').encode())
    files.put(spark, f"{at}/a.json", (doc + '"source": {"source_path": "/x", "source_hash": "h0"}}').encode())
    files.put(spark, f"{at}/c.json", b'{"artifact_type": "other", "source_path": "/y", "document_hash": "h"}')
    files.put(spark, f"{at}/d.json", b"no json")
    a = spark.createDataFrame([(1, "/x", "h1"), (2, "/x", "h9"), (3, "/y", "h"), (4, None, None)], "artifact_id long, logical_path string, sha256 string")
    over = spark.createDataFrame([], "artifact_id long, override_path string")
    reg = spark.createDataFrame([], "source_path string, source_hash string, artifact_type string, artifact_path string")
    got = {r.artifact_id: (r.origin, (r.truth_path or "").rpartition("/")[2]) for r in registry.active_truth(a, over, reg, files.documents_on_disk(spark, at)).collect()}
    assert got == {1: ("disk_exact", "b.json"), 2: ("disk_path", "a.json"), 3: ("none", ""), 4: ("none", "")}


def test_query_sets_of_both_kinds(spark, tmp_path):
    at = f"file://{tmp_path}/set"
    files.put(spark, f"{at}/a.json", b'{"dataset": "d", "ranker": "bm25", "queries": ["plain {x}", {"query": "q"}, {"query": "r", "expected_sources": ["s"]}, "{odd"]}')
    files.put(spark, f"{at}/b.json", b'{"dataset": "e", "queries": []}')
    got = [(r.dataset, r.ranker, r.top_k, r.query_no, r.query_text, list(r.expected_sources)) for r in files.query_set(spark, at).orderBy("query_no").collect()]
    assert got == [("d", "bm25", 10, 0, "plain {x}", []), ("d", "bm25", 10, 1, "q", []), ("d", "bm25", 10, 2, "r", ["s"]), ("d", "bm25", 10, 3, "{odd", [])]


def test_cast_with_default_and_days(spark):
    d = spark.createDataFrame([("7", -1), ("x", 86_399), (None, 86_400), ("1e400", None)], "a string, s long")
    assert [r[0] for r in d.select(text.cast_or("a", "bigint", -1)).collect()] == [7, -1, -1, -1]
    assert [r[0] and str(r[0]) for r in d.select(text.day("s")).collect()] == ["1969-12-31", "1970-01-01", "1970-01-02", None]


def test_shared_tables_are_deleted(spark):
    t = shared.materialise(spark.range(3), "mine")
    at = t.inputFiles()[0].removeprefix("file://")
    assert t.count() == 3 and os.path.exists(at)
    assert shared.clear(spark) >= 1 and not os.path.exists(at)


def test_a_cluster_needs_a_shared_folder():
    class Session:
        class conf:
            get = staticmethod(lambda *a: None)

        class sparkContext:
            master = "spark://host:7077"

    with pytest.raises(RuntimeError):
        shared.shared_dir(Session)


@pytest.fixture(scope="module")
def service():
    class Handler(http.server.BaseHTTPRequestHandler):
        def do_POST(self):
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            vec = lambda x: [float(len(x)), 1.0]
            if self.path == "/api/embed":
                out = {"embeddings": [vec(x) for x in body["input"]]}
            elif self.path == "/api/embeddings":
                out = {"embedding": vec(body["prompt"])}
            elif self.path == "/generic":
                out = {"error": "one at a time"} if isinstance(body["input"], list) else {"embeddings": [vec(body["input"])]}
            elif self.path == "/bad":
                out = {"embeddings": [["x"] for _ in body["input"]]}
            elif self.path == "/rewrite":
                asked = body["prompt"].rpartition("Request: ")[2]
                out = {"response": {"list": "[1]", "blank": " "}.get(asked, json.dumps({"rewritten_query": asked + " plan", "rewrite_status": "OK"}))}
            data = json.dumps(out).encode()
            self.send_response(200)
            self.end_headers()
            self.wfile.write(data)

        def log_message(self, *a):
            pass

    s = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{s.server_port}"
    s.shutdown()


def test_embedding_services_of_three_kinds(service):
    for path in ("/api/embed", "/api/embeddings", "/generic"):
        e = providers.HttpEmbedder(service + path, "m", 2)
        assert e(["a", "bcd"]) == [[1.0, 1.0], [3.0, 1.0]] and providers.healthy(e) and providers.query_vector(" ab ", e) == [2.0, 1.0]
    bad = providers.HttpEmbedder(service + "/bad", "m", 2)
    assert not providers.healthy(bad) and not providers.numeric([1, True]) and not providers.numeric([float("inf")]) and not providers.numeric([])
    with pytest.raises(ValueError):
        bad(["a"])
    with pytest.raises(ValueError):
        providers.query_vector("  ", bad)


def test_rewrite_service(spark, service):
    q = spark.createDataFrame([(1, "site"), (2, "list"), (3, "blank")], "query_id long, query_text string")
    got = {r.query_id: (r.rewritten_query, r.rewrite_status) for r in providers.rewrites(q, providers.HttpRewriter(service + "/rewrite", "m")).collect()}
    assert got == {1: ("site plan", "OK"), 2: ("list", "FALLBACK_ORIGINAL"), 3: ("blank", "FALLBACK_ORIGINAL")}


def test_weights_of_variants(spark):
    d = spark.createDataFrame([("original", "a b", "a b"), ("rewrite", "x", "a b"), ("expansion", "a b c", "a b"), ("expansion", "a c", "a b")], "k string, v string, q string")
    assert [r[0] for r in d.select(ranking.variant_weight(*(d[c] for c in "kvq"))).collect()] == [1.0, 1.0, 0.75, 0.9]


def test_a_plan_names_known_artifacts_only(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y")], "artifact_id long, sha256 string")
    plan = spark.createDataFrame([(1, "skip"), (3, "convert")], "artifact_id long, action string")
    assert registry.planned_artifacts(plan.where("artifact_id = 1"), a).first().sha256 == "x"
    with pytest.raises(ValueError):
        registry.planned_artifacts(plan, a)


def test_known_counts_are_not_counted_again(spark):
    got = {r.dataset: r.n_rows for r in stats.dataset_summary({"a": spark.range(3), "b": spark.range(4)}, {"a": 10}).collect()}
    assert got == {"a": 10, "b": 4}


def test_office_files():
    from lodestrata.sources import office, samples

    lines = ("Größe & <x> {y} \\z (a) – “q”", "", "tail\t2")
    for kind in ("docx", "odt", "rtf", "pdf"):
        got = office.office_text(kind, samples.MAKERS[kind](*lines))
        assert got.split() == " ".join(lines).split(), kind
    assert office.docx_text(samples.docx("a", "", "b 😀")) == "a\n\nb 😀" and office.rtf_text(samples.rtf("日本", "😀")) == "日本\n😀"
    for kind, bad in (("docx", b"no zip"), ("odt", samples.docx("x")), ("rtf", b"text"), ("pdf", b"text"), ("pdf", b"%PDF-1.4\n"), ("xls", b"")):
        with pytest.raises(Exception):
            office.office_text(kind, bad)
    bomb = samples._zip("word/document.xml", '<!DOCTYPE x [<!ENTITY a "b">]><x>&a;</x>')
    with pytest.raises(ValueError):
        office.docx_text(bomb)
