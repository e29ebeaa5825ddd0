"""Files as tables: inventories, zip members, mails, extracted text, artifacts on disk."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Callable, Iterator
from email import policy
from email.parser import BytesParser

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from .office import office_text

#: Extensions that an inventory takes, and those it looks for in archives.
EXTENSIONS = ("docx", "doc", "rtf", "zip", "pdf", "")
MEMBERS = ("docx", "doc", "rtf")


def inventory(spark: SparkSession, root: str, extensions: tuple[str, ...] = EXTENSIONS, content: bool = False) -> DataFrame:
    """(physical_path, container_path, logical_path, source_type, size_bytes, modified_utc, sha256[, content]) of all files
    below ``root``. An empty extension stands for mail files whose names end with a full stop."""
    x = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    base = root.rstrip("/") + "/"
    logical = F.regexp_replace(F.regexp_replace("path", r"^file:/+", "/"), "^" + "".join("\\" + c if not c.isalnum() else c for c in base), "")
    x = x.withColumn("logical_path", logical)
    kind = T.file_type("logical_path")
    named = kind.isin(*[e for e in extensions if e])
    if "" in extensions:
        named = named | F.col("logical_path").endswith(".")
    x = x.where(F.coalesce(named, F.lit(False)))
    cols = [F.col("path").alias("physical_path"), F.lit(None).cast("string").alias("container_path"), "logical_path", F.coalesce(kind, F.lit("")).alias("source_type"), F.col("length").alias("size_bytes"), F.unix_timestamp("modificationTime").alias("modified_utc"), F.sha2("content", 256).alias("sha256")]
    return x.select(*cols, *(["content"] if content else []))


def fingerprints(inv: DataFrame) -> DataFrame:
    return inv.select("physical_path", F.col("sha256").alias("source_hash"), "size_bytes").dropDuplicates(["physical_path"])


_MEMBER = "physical_path string, container_path string, logical_path string, source_type string, size_bytes long, modified_utc long, sha256 string, content binary, expansion_status string, error_message string"


def expand_zips(inv: DataFrame) -> DataFrame:
    """Members of the archives of an inventory with content; an unreadable archive gives one row with status FAILED."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import hashlib
        import re

        for b in batches:
            rows = []
            for r in b.itertuples(index=False):
                try:
                    z = zipfile.ZipFile(io.BytesIO(r.content))
                    for m in z.infolist():
                        stem, dot, ext = m.filename.rpartition("/")[2].rpartition(".")
                        if m.is_dir() or not dot or ext.lower() not in MEMBERS:
                            continue
                        data = z.read(m)
                        name = f"{stem}__{hashlib.sha256(m.filename.encode()).hexdigest()[:12]}.{ext}"
                        rows.append(("/staging/" + re.sub(r"[^A-Za-z0-9._-]+", "_", name), r.physical_path, f"{r.logical_path}::{m.filename}", ext.lower(), len(data), r.modified_utc, hashlib.sha256(data).hexdigest(), data, "OK", None))
                except Exception as e:  # one bad archive doesn't end a run
                    rows.append((None, r.physical_path, r.logical_path, "zip", r.size_bytes, r.modified_utc, r.sha256, None, "FAILED", str(e)[:200]))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in _MEMBER.split(", ")])

    return inv.where(F.col("source_type") == "zip").mapInPandas(run, _MEMBER)


def expanded(inv: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Inventory with the members of its archives (the archives stay), and the archives that failed."""
    m = expand_zips(inv)
    ok = m.where(F.col("expansion_status") == "OK").drop("expansion_status", "error_message")
    return inv.unionByName(ok, allowMissingColumns=True), m.where(F.col("expansion_status") != "OK").select("container_path", "logical_path", "error_message")


def put(spark: SparkSession, path: str, data: bytes, modified: int | None = None) -> None:
    """Write one small file with the file system of its path; ``modified`` in epoch seconds."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    out = fs.create(p, True)
    out.write(bytearray(data))
    out.close()
    if modified is not None:
        fs.setTimes(p, modified * 1000, -1)


_QUERY_SET = "dataset string, ranker string, top_k int, queries array<string>"


def query_set(spark: SparkSession, path: str) -> DataFrame:
    """(dataset, ranker, top_k, query_no, query_text, expected_sources) of query sets in JSON. An entry is a text or an object
    with ``query`` and maybe ``expected_sources``; a set without ranker is hybrid with ten results."""
    f = spark.read.text(path, wholetext=True).select(F.from_json("value", _QUERY_SET).alias("s"))
    x = f.select(F.col("s.dataset").alias("dataset"), F.coalesce("s.ranker", F.lit("hybrid")).alias("ranker"), F.coalesce("s.top_k", F.lit(10)).alias("top_k"), F.posexplode("s.queries").alias("query_no", "entry"))
    o = F.from_json("entry", "query string, expected_sources array<string>")
    object_ = F.col("entry").startswith("{") & o["query"].isNotNull()
    none = F.array().cast("array<string>")
    return x.select("dataset", "ranker", "top_k", "query_no", F.when(object_, o["query"]).otherwise(F.col("entry")).alias("query_text"), F.when(object_, F.coalesce(o["expected_sources"], none)).otherwise(none).alias("expected_sources"))


def documents_on_disk(spark: SparkSession, path: str) -> DataFrame:
    """(source_path, source_hash, artifact_path) of documents in JSON; fields may stand at the top or below ``source``. Files
    that can't be read and other artifacts are left out."""
    schema = "artifact_type string, source_path string, document_hash string, source_hash string, source struct<source_path:string,source_hash:string>"
    x = spark.read.schema(schema).option("multiLine", True).json(path)
    filled = lambda *c: F.coalesce(*(F.nullif(F.col(y), F.lit("")) for y in c))
    x = x.where(F.col("artifact_type") == "search_context_document")
    return x.select(filled("source_path", "source.source_path").alias("source_path"), filled("document_hash", "source_hash", "source.source_hash").alias("source_hash"), F.col("_metadata.file_path").alias("artifact_path"))


def mail_text(subject: Column, sender: Column, to: Column, date: Column, body: Column) -> Column:
    e = lambda c: F.coalesce(c, F.lit(""))
    t = F.concat(F.lit("Subject: "), e(subject), F.lit("\nFrom: "), e(sender), F.lit("\nTo: "), e(to), F.lit("\nDate: "), e(date), F.lit("\n\n"), e(body))
    return F.regexp_replace(F.regexp_replace(t, r"^\s+", ""), r"\s+$", "")


def parse_mail(content: bytes) -> tuple[str, str, str, str, str]:
    m = BytesParser(policy=policy.default).parsebytes(content)
    parts = [p.get_content() for p in m.walk() if p.get_content_type() == "text/plain"] if m.is_multipart() else [m.get_content() if m.get_content_maintype() == "text" else ""]
    return tuple(str(m.get(h, "") or "") for h in ("subject", "from", "to", "date")) + ("\n".join(parts),)


def plain_text(kind: str, content: bytes) -> str:
    """Mails, texts, office files and PDF; what can't be read raises."""
    if kind in ("", "eml"):
        s, f, t, d, b = parse_mail(content)
        return f"Subject: {s}\nFrom: {f}\nTo: {t}\nDate: {d}\n\n{b}".strip()
    if kind in ("txt", "md", "csv"):
        return content.decode("utf-8", "replace")
    return office_text(kind, content)


def extract(inv: DataFrame, extractor: Callable[[str, bytes], str] = plain_text) -> DataFrame:
    """(artifact_id, logical_path, sha256, text_content, status, error_message) of an inventory with content."""
    schema = "artifact_id long, logical_path string, sha256 string, text_content string, status string, error_message string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for r in b.itertuples(index=False):
                try:
                    rows.append((r.artifact_id, r.logical_path, r.sha256, extractor(r.source_type, bytes(r.content)), "COMPLETE", None))
                except Exception as e:
                    rows.append((r.artifact_id, r.logical_path, r.sha256, None, "FAILED", str(e)[:200]))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in schema.split(", ")])

    return inv.select("artifact_id", "logical_path", "sha256", "source_type", "content").mapInPandas(run, schema)


def recent(spark: SparkSession, root: str, pattern: str = "*.json", n: int = 25) -> DataFrame:
    """(path, modified) of the latest files of a folder."""
    x = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(root)
    return x.select("path", F.col("modificationTime").alias("modified")).orderBy(F.desc("modified"), "path").limit(n)


def write_artifacts(df: DataFrame, path: str, checked: Callable[[DataFrame], DataFrame] | None = None) -> None:
    """JSON lines of a table; with ``checked`` (adds ``errors``) nothing is written if some row has errors."""
    if checked is not None:
        bad = checked(df).where(F.size("errors") > 0).select("errors").limit(1).collect()
        if bad:
            raise ValueError(f"artifacts have errors: {bad[0]['errors']}")
    df.write.mode("overwrite").json(path)


def collections(chunks: DataFrame) -> DataFrame:
    """(document_hash, chunks array): one row per collection, as artifacts on disk hold them; paths with equal content
    collapse to the last one."""
    last = chunks.groupBy("document_hash").agg(F.max("logical_path").alias("logical_path"))
    x = chunks.join(last, ["document_hash", "logical_path"])
    return x.groupBy("document_hash", "logical_path").agg(F.array_sort(F.collect_list(F.struct("chunk_index", "chunk_id", "text", "text_hash"))).alias("chunks"))


def scan_collections(spark: SparkSession, path: str) -> DataFrame:
    """Chunks of collections on disk."""
    schema = "document_hash string, logical_path string, chunks array<struct<chunk_index:int,chunk_id:string,text:string,text_hash:string>>"
    return spark.read.schema(schema).json(path).select("document_hash", "logical_path", F.inline("chunks"))


def manifest(run: DataFrame) -> DataFrame:
    """(run_id, manifest): each run as JSON with its fields by name."""
    return run.select("run_id", F.to_json(F.struct(*sorted(run.columns))).alias("manifest"))
