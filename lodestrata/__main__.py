"""Command line: python -m lodestrata query | ingest | stats."""

from __future__ import annotations

import argparse
import json
import time

from pyspark.sql import functions as F

from .operators import lexical, lifecycle, stats, vector
from .operators import query as q
from .plans import ingestion, retrieval
from .session import session, ship
from .sources import files


def _query(spark, a) -> None:
    queries = spark.createDataFrame([(1, a.query)], "query_id long, query_text string")
    s = retrieval.Settings(ranker=a.ranker, per_source=a.max_chunks_per_source, allowed=a.allowed_file_types)
    context = retrieval.contexts(queries, lexical.index_of(spark, a.chunks), s)
    answer = {r["query_id"]: r["answer_text"] for r in retrieval.context.answer(context).collect()}
    for r in context.collect():
        print(json.dumps({"query": a.query, "expanded": [v["variant_text"] for v in q.variants(queries).collect()], "sources": [x.asDict() for x in r["sources"]], "context": r["context_text"], "answer": answer[1]}, ensure_ascii=False))
    if not answer:
        print(json.dumps({"query": a.query, "sources": [], "context": "", "answer": retrieval.context.NOTHING}))


RUNS = "run_id long, started_utc long, finished_utc long, source_root string, status string, files_discovered long, files_eligible long, files_converted long, files_skipped long, files_failed long, notes string"


def _ingest(spark, a) -> None:
    began = int(time.time())
    inv, failed = files.expanded(files.inventory(spark, a.source_root, content=True))
    none = spark.createDataFrame([], "source_path string, source_hash string, artifact_type string")
    known = spark.read.parquet(a.registry) if a.registry else none
    plan, docs, chunks = ingestion.ingest(inv, known, spark.createDataFrame([], "artifact_id long"))
    for name, df in (("plan", plan), ("documents", docs), ("chunks", chunks), ("expansion_failures", failed)):
        df.write.mode("overwrite").parquet(f"{a.out}/{name}")
    done = spark.read.parquet(f"{a.out}/documents").groupBy("status").count().collect()
    counts = {r["status"]: r["count"] for r in done}
    good, bad = counts.get("COMPLETE", 0), counts.get("FAILED", 0)
    status = "SUCCESS" if not bad and spark.read.parquet(f"{a.out}/expansion_failures").isEmpty() else "FAILED"
    made = spark.read.parquet(f"{a.out}/plan")
    found, fit = made.count(), made.where("action = 'convert'").count()
    before = spark.read.parquet(a.runs) if a.runs else spark.createDataFrame([], RUNS)
    runs, run_id = lifecycle.create_run(before, a.source_root, found, fit, began)
    lifecycle.finalize_run(runs, run_id, good, bad, int(time.time()), status).write.mode("overwrite").parquet(f"{a.out}/runs")
    ids = inv.select(F.xxhash64("logical_path", "sha256").alias("artifact_id"), "sha256")
    lifecycle.decisions(made, ids, run_id, began).write.mode("overwrite").parquet(f"{a.out}/decisions")
    print(json.dumps({"run_id": run_id, "converted": good, "failed": bad, "status": status}))


def _stats(spark, a) -> None:
    v = vector.valid_vectors(spark.read.parquet(a.embeddings))
    row = stats.corpus(spark.read.parquet(a.documents), spark.read.parquet(a.chunks), v).first()
    print(json.dumps(row.asDict()))


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="lodestrata")
    p.add_argument("--master")
    sub = p.add_subparsers(dest="command", required=True)
    c = sub.add_parser("query", help="context and answer of one query over a table of chunks")
    c.add_argument("--query", required=True)
    c.add_argument("--chunks", required=True)
    c.add_argument("--ranker", choices=("overlap", "bm25"), default="overlap")
    c.add_argument("--max-chunks-per-source", type=int, default=1)
    c.add_argument("--allowed-file-types", nargs="*")
    c.set_defaults(run=_query)
    c = sub.add_parser("ingest", help="files below a folder to documents and chunks")
    c.add_argument("--source-root", required=True)
    c.add_argument("--out", required=True)
    c.add_argument("--registry")
    c.add_argument("--runs", help="table of earlier runs")
    c.set_defaults(run=_ingest)
    c = sub.add_parser("stats", help="counts of a corpus")
    for name in ("documents", "chunks", "embeddings"):
        c.add_argument(f"--{name}", required=True)
    c.set_defaults(run=_stats)
    a = p.parse_args(argv)
    a.run(ship(session(a.master)), a)


if __name__ == "__main__":
    main()
