"""Records that runs append: runs, decisions, receipts, approvals and commits, with guards and numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..shared import materialise


def numbered(df: DataFrame, *order: str, name: str = "number", after: int = 0) -> DataFrame:
    """Adds ``after`` + 1, 2, ... in the order of ``order``, whose values are unique. Rows are ranged, and counted by range,
    so no task numbers them all."""
    x = materialise(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "ranges")
    n = x.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    n = n.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))  # a row for each range
    w = Window.partitionBy("_part").orderBy(*order)
    return x.join(F.broadcast(n), "_part").withColumn(name, F.lit(after).cast("long") + F.col("_before") + F.row_number().over(w)).drop("_part", "_before")


def _greatest(df: DataFrame, column: str) -> int:
    return df.agg(F.coalesce(F.max(column), F.lit(0)).cast("long")).first()[0]


def create_run(runs: DataFrame, source_root: str, discovered: int, eligible: int, now: int, notes: str = "") -> tuple[DataFrame, int]:
    """The runs with a new one, and its id: discovered, nothing converted yet."""
    run_id = _greatest(runs, "run_id") + 1
    known = {"run_id": run_id, "started_utc": now, "finished_utc": now, "source_root": source_root, "status": "DISCOVERED", "files_discovered": discovered, "files_eligible": eligible, "notes": notes}
    row = runs.sparkSession.range(1).select(*(F.lit(known.get(f.name, 0)).cast(f.dataType).alias(f.name) for f in runs.schema.fields))
    return runs.unionByName(row), run_id


def finalize_run(runs: DataFrame, run_id: int, converted: int, failed: int, now: int, status: str, notes: str = "") -> DataFrame:
    """The runs with the end of one of them; other runs are as they were."""
    new = {"finished_utc": now, "files_converted": converted, "files_failed": failed, "status": status, "notes": notes}
    this = F.col("run_id") == run_id
    return runs.select(*(F.when(this, F.lit(new[f.name]).cast(f.dataType)).otherwise(F.col(f.name)).alias(f.name) if f.name in new else F.col(f.name) for f in runs.schema.fields))


def append_once(existing: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """``existing`` and the rows of ``new`` whose keys it lacks, so an append that is repeated adds nothing."""
    return existing.unionByName(new.join(existing.select(*keys), keys, "left_anti"))


def decisions(plan: DataFrame, artifacts: DataFrame, run_id: int, now: int) -> DataFrame:
    """(run_id, artifact_id, decision_type, reason, source_hash, created_utc) of a conversion plan (artifact_id, action, reason)."""
    x = plan.join(artifacts.select("artifact_id", F.col("sha256").alias("source_hash")), "artifact_id")
    return x.select(F.lit(run_id).cast("long").alias("run_id"), "artifact_id", F.col("action").alias("decision_type"), "reason", "source_hash", F.lit(now).cast("long").alias("created_utc"))


def pdf_name(path: Column | str) -> Column:
    """Name of what a converter makes of a file: its stem and twelve digits of the hash of its whole path."""
    p = F.col(path) if isinstance(path, str) else path
    stem = F.regexp_replace(F.regexp_extract(p, r"([^/]*)$", 1), r"(?<=.)\.[^.]*$", "")
    return F.concat(stem, F.lit("__"), F.substring(F.sha2(p, 256), 1, 12), F.lit(".pdf"))


def receipts(done: DataFrame, run_id: int, converter: str, now: int) -> DataFrame:
    """(artifact_id, run_id, output_pdf_path, converter_used, conversion_status, error_message, created_utc) of conversions
    (artifact_id, logical_path, error_message): failed where there is an error."""
    failed = F.col("error_message").isNotNull()
    return done.select(
        "artifact_id", F.lit(run_id).cast("long").alias("run_id"), F.when(~failed, pdf_name("logical_path")).alias("output_pdf_path"), F.lit(converter).alias("converter_used"),
        F.when(failed, "FAILED").otherwise("SUCCESS").alias("conversion_status"), "error_message", F.lit(now).cast("long").alias("created_utc"),
    )


def approve(plans: DataFrame, approvals: DataFrame, requests: DataFrame) -> DataFrame:
    """(plan_id, status, approval_id, approved_utc) for each request (plan_id, approved_utc): a plan must be there and be
    PLANNED, and has one approval; of several requests the first in time, then none. Numbers go on from the greatest one."""
    p = plans.select("plan_id", F.col("status").alias("plan_status"))
    first = F.row_number().over(Window.partitionBy("plan_id").orderBy("approved_utc"))
    x = requests.withColumn("turn", first).join(p, "plan_id", "left").join(approvals.select("plan_id", F.lit(True).alias("had")).distinct(), "plan_id", "left")
    status = F.when(F.col("plan_status").isNull(), "plan_not_found").when(F.col("plan_status") != "PLANNED", "plan_not_planned").when(F.col("had").isNotNull() | (F.col("turn") > 1), "already_approved").otherwise("RECORDED")
    x = x.select("plan_id", "approved_utc", status.alias("status"))
    new = numbered(x.where(F.col("status") == "RECORDED").select("plan_id"), "plan_id", name="approval_id", after=_greatest(approvals, "approval_id"))
    x = x.join(new, "plan_id", "left")
    return x.select("plan_id", "status", F.when(F.col("status") == "RECORDED", F.col("approval_id")).alias("approval_id"), "approved_utc")


def commit(redacted: DataFrame, plans: DataFrame, approvals: DataFrame, planned: DataFrame, requests: DataFrame, after: int = 0) -> DataFrame:
    """(artifact_id, plan_id, status, error, redacted_artifact_id, artifact_path, artifact_hash, created_utc) for each request
    (artifact_id, plan_id, approval_id, created_utc), one for an artifact; a batch goes on where one fails.

    ``redacted`` (artifact_id, redacted_text), ``planned`` (plan_id, artifact_id). Committed artifacts are numbered after
    ``after``.
    """
    a = approvals.select("approval_id", F.col("plan_id").alias("approved_plan"))
    p = plans.select("plan_id", "profile", F.col("status").alias("plan_status"))
    s = planned.select("plan_id", "artifact_id", F.lit(True).alias("has")).distinct()
    x = requests.join(a, "approval_id", "left").join(p, "plan_id", "left").join(s, ["plan_id", "artifact_id"], "left").join(redacted.select("artifact_id", "redacted_text"), "artifact_id", "left")
    error = (
        F.when(F.col("approved_plan").isNull(), "approval_not_found").when(F.col("approved_plan") != F.col("plan_id"), "approval_of_other_plan")
        .when(~F.col("plan_status").eqNullSafe(F.lit("PLANNED")), "plan_not_planned").when(F.col("has").isNull(), "artifact_not_in_plan").when(F.col("redacted_text").isNull(), "no_text")
    )
    path = F.concat(F.lit("artifact_"), F.col("artifact_id").cast("string"), F.lit(".plan_"), F.col("plan_id").cast("string"), F.lit("."), "profile", F.lit(".redacted.json"))
    ok = error.isNull()
    x = materialise(x.select("artifact_id", "plan_id", error.alias("error"), F.when(ok, path).alias("artifact_path"), F.when(ok, F.sha2("redacted_text", 256)).alias("artifact_hash"), "created_utc"), "commits")
    n = numbered(x.where(F.col("error").isNull()).select("artifact_id"), "artifact_id", name="redacted_artifact_id", after=after)
    x = x.join(n, "artifact_id", "left")
    return x.select("artifact_id", "plan_id", F.when(F.col("error").isNull(), "COMPLETE").otherwise("FAILED").alias("status"), F.coalesce("error", F.lit("")).alias("error"), "redacted_artifact_id", "artifact_path", "artifact_hash", "created_utc")


def overrides_of(commits: DataFrame, profile: str) -> DataFrame:
    """What completed commits make the truth: rows for ``registry.override_upsert``."""
    return commits.where(F.col("status") == "COMPLETE").select("artifact_id", "redacted_artifact_id", F.lit(profile).alias("profile"), "created_utc")


def or_else(preferred: DataFrame, other: DataFrame) -> DataFrame:
    """``preferred``, or ``other`` where it has no row."""
    return other if preferred.isEmpty() else preferred


