"""Runs, artifacts and registries: what to convert, what changed, what counts as the truth of a source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

DOCUMENT, CHUNKS = "search_context_document", "search_context_chunks"


def latest_by(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The last row of each key (last writer wins)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_r", F.row_number().over(w)).where(F.col("_r") == 1).drop("_r")


def convertible(artifacts: DataFrame) -> DataFrame:
    return artifacts.where(F.lower("source_type").isin("docx", "doc", "rtf"))


def mode_filter(artifacts: DataFrame, mode: str) -> DataFrame:
    """What a mode converts: office files, with ``context`` also PDF and mail files without extension."""
    p = F.lower("logical_path")
    if mode == "context":
        return artifacts.where(p.rlike(r"\.(?:docx|doc|rtf|pdf)$") | T.is_maildir("logical_path"))
    return artifacts.where(p.rlike(r"\.(?:docx|doc|rtf|odt)$"))


def artifact_lookup(artifacts: DataFrame) -> DataFrame:
    """(logical_path, sha256, artifact_id): the latest id of each content of a path."""
    return artifacts.groupBy("logical_path", "sha256").agg(F.max("artifact_id").alias("artifact_id"))


def recent_runs(runs: DataFrame, limit: int = 10, statuses: tuple[str, ...] | None = None) -> DataFrame:
    x = runs if statuses is None else runs.where(F.col("status").isin(*statuses))
    return x.orderBy(F.desc("run_id")).limit(limit)


def artifacts_for_run(artifacts: DataFrame) -> DataFrame:
    """(run_id, artifact_id, logical_path): artifacts first or last seen in a run, as two equi-joinable halves."""
    a = artifacts.select(F.col("first_seen_run_id").alias("run_id"), "artifact_id", "logical_path")
    b = artifacts.where(~F.col("first_seen_run_id").eqNullSafe(F.col("last_seen_run_id"))).select(F.col("last_seen_run_id").alias("run_id"), "artifact_id", "logical_path")
    return a.unionByName(b).where(F.col("run_id").isNotNull())


def conversion_plan(artifacts: DataFrame, registry: DataFrame) -> DataFrame:
    """(artifact_id, action, reason): what was converted with the same path and hash is skipped."""
    done = registry.select(F.col("source_path").alias("logical_path"), F.col("source_hash").alias("sha256")).distinct().withColumn("hit", F.lit(True))
    x = artifacts.select("artifact_id", "logical_path", "sha256").join(done, ["logical_path", "sha256"], "left")
    skip = F.col("hit").isNotNull()
    reason = F.when(F.col("sha256").isNull(), "missing_source_hash").when(skip, "unchanged_already_converted").otherwise("new_or_changed")
    return x.select("artifact_id", F.when(skip, "skip").otherwise("convert").alias("action"), reason.alias("reason"))


def planned_artifacts(plan: DataFrame, artifacts: DataFrame) -> DataFrame:
    """The plan with its artifacts' rows; an error if the plan names one that isn't there."""
    gone = plan.select("artifact_id").join(artifacts.select("artifact_id"), "artifact_id", "left_anti").limit(1).collect()
    if gone:
        raise ValueError(f"the plan names artifact {gone[0]['artifact_id']}, which isn't in the inventory")
    return plan.join(artifacts, "artifact_id")


def context_plan(artifacts: DataFrame, registry: DataFrame, overrides: DataFrame) -> DataFrame:
    """(artifact_id, action, reason): an active override or both artifact types of the same hash mean skip."""
    have = registry.groupBy(F.col("source_path").alias("logical_path"), F.col("source_hash").alias("sha256")).agg(F.collect_set("artifact_type").alias("types"))
    x = artifacts.select("artifact_id", "logical_path", "sha256").join(have, ["logical_path", "sha256"], "left").join(overrides.select("artifact_id", F.lit(True).alias("override")), "artifact_id", "left")
    both = F.coalesce(F.array_contains("types", DOCUMENT) & F.array_contains("types", CHUNKS), F.lit(False))
    reason = F.when(F.col("override").isNotNull(), "redaction_override_active").when(both, "unchanged_already_contextualized").otherwise("new_or_changed_source")
    return x.select("artifact_id", F.when(reason == "new_or_changed_source", "convert").otherwise("skip").alias("action"), reason.alias("reason"))


def latest_state(artifacts: DataFrame) -> DataFrame:
    """(logical_path, sha256): active artifacts in the last run that saw their path."""
    a = artifacts.where(F.col("is_active") == 1)
    last = F.max("last_seen_run_id").over(Window.partitionBy("logical_path"))
    return a.withColumn("last", last).where(F.col("last_seen_run_id") == F.col("last")).groupBy("logical_path").agg(F.max(F.struct("artifact_id", "sha256"))["sha256"].alias("sha256"))


def delta(state: DataFrame, current: DataFrame) -> DataFrame:
    """(logical_path, change): new, changed or unchanged; what has gone isn't reported."""
    s = state.select("logical_path", F.col("sha256").alias("old"), F.lit(True).alias("known"))
    x = current.select("logical_path", "sha256").join(s, "logical_path", "left")
    change = F.when(F.col("known").isNull(), "new").when(F.col("old").eqNullSafe(F.col("sha256")), "unchanged").otherwise("changed")
    return x.select("logical_path", change.alias("change"))


def artifact_upsert(existing: DataFrame, seen: DataFrame, run_id: int) -> DataFrame:
    """Artifacts after a run: (logical_path, sha256) keep id and first run; what is seen again gets size and last run."""
    s = seen.select("logical_path", "sha256", F.col("size_bytes").alias("new_size")).dropDuplicates(["logical_path", "sha256"]).withColumn("seen", F.lit(True))
    x = existing.select("artifact_id", "logical_path", "sha256", "size_bytes", "first_seen_run_id", "last_seen_run_id").join(s, ["logical_path", "sha256"], "full_outer")
    now = F.col("seen").isNotNull()
    return x.select(
        "artifact_id", "logical_path", "sha256", F.coalesce("new_size", "size_bytes").alias("size_bytes"),
        F.coalesce("first_seen_run_id", F.lit(run_id).cast("long")).alias("first_seen_run_id"), F.when(now, F.lit(run_id).cast("long")).otherwise(F.col("last_seen_run_id")).alias("last_seen_run_id"),
    )


def registry_upsert(existing: DataFrame, new: DataFrame) -> DataFrame:
    """Rows by (source_path, artifact_type); a new one replaces the old. Both have (source_path, artifact_type, source_hash, run_id)."""
    x = existing.withColumn("o", F.lit(0)).unionByName(new.withColumn("o", F.lit(1)))
    return latest_by(x, ["source_path", "artifact_type"], [F.desc("o"), F.desc("run_id"), F.desc("source_hash")]).drop("o")


def override_upsert(existing: DataFrame, new: DataFrame) -> DataFrame:
    """One active truth for each source artifact; rows (artifact_id, redacted_artifact_id, profile, created_utc)."""
    return latest_by(existing.unionByName(new), ["artifact_id"], [F.desc("created_utc"), F.desc("redacted_artifact_id")])


def active_truth(artifacts: DataFrame, overrides: DataFrame, registry: DataFrame, on_disk: DataFrame | None = None) -> DataFrame:
    """(artifact_id, origin, truth_path): override, else registry by path and hash, else registry by path, else documents
    ``on_disk`` (source_path, source_hash, artifact_path) by path and hash, else by path (the first), else none."""
    sources = [("registry", registry.where(F.col("artifact_type") == DOCUMENT))] + ([("disk", on_disk)] if on_disk is not None else [])
    x = artifacts.select("artifact_id", "logical_path", "sha256").join(overrides.select("artifact_id", "override_path"), "artifact_id", "left")
    origin, paths = F.when(F.col("override_path").isNotNull(), "override"), ["override_path"]
    for name, r in sources:
        r = r.select(F.col("source_path").alias("logical_path"), F.col("source_hash").alias("sha256"), "artifact_path")
        for kind, keys in (("exact", ["logical_path", "sha256"]), ("path", ["logical_path"])):
            found = f"{name}_{kind}"
            x = x.join(r.groupBy(*keys).agg(F.min("artifact_path").alias(found)), keys, "left")
            origin, paths = origin.when(F.col(found).isNotNull(), found), [*paths, found]
    return x.select("artifact_id", origin.otherwise("none").alias("origin"), F.coalesce(*paths).alias("truth_path"))


def from_sources(df: DataFrame, part: str, column: str = "source_path") -> DataFrame:
    """Rows whose source path contains ``part``."""
    return df.where(F.col(column).contains(part))


def effective_texts(documents: DataFrame, redacted: DataFrame) -> DataFrame:
    """(artifact_id, origin, text_content): what is chunked and indexed, with redacted texts (artifact_id, redacted_text)
    in the place of the originals."""
    x = documents.select("artifact_id", "text_content").join(redacted.select("artifact_id", "redacted_text", F.lit(True).alias("has")), "artifact_id", "left")
    over = F.col("has").isNotNull()
    return x.select("artifact_id", F.when(over, "override").otherwise("original").alias("origin"), F.when(over, F.col("redacted_text")).otherwise(F.col("text_content")).alias("text_content"))


def candidate_runs(runs: DataFrame, artifacts: DataFrame, overrides: DataFrame, registry: DataFrame, limit: int = 50) -> DataFrame:
    """Latest runs that saw an artifact with a truth to redact. The OR-join is two equi-joins (``artifacts_for_run``)."""
    t = active_truth(artifacts, overrides, registry).where(F.col("origin") != "none").select("artifact_id")
    seen = artifacts_for_run(artifacts).join(t, "artifact_id", "left_semi").select("run_id").distinct()
    return runs.join(seen, "run_id", "left_semi").orderBy(F.desc("run_id")).limit(limit)


def candidate_artifacts(artifacts: DataFrame, overrides: DataFrame, registry: DataFrame) -> DataFrame:
    """(run_id, artifact_id, logical_path, truth_path) of artifacts with a truth, for every run that saw them."""
    t = active_truth(artifacts, overrides, registry).where(F.col("origin") != "none").select("artifact_id", "truth_path")
    return artifacts_for_run(artifacts).join(t, "artifact_id")


def run_counters(runs: DataFrame) -> DataFrame:
    """(run_id, status, converted, failed, skipped, consistent): success means no failure."""
    ok = F.col("files_failed") == 0
    return runs.select("run_id", "status", "files_converted", "files_failed", "files_skipped", F.when(F.col("finished_utc").isNull(), "RUNNING").when(ok, "SUCCESS").otherwise("FAILED").alias("derived_status"))


def batch_totals(batches: DataFrame) -> DataFrame:
    """(run_id, batches, written, skipped, failed, status) over embedding batches: PARTIAL if any isn't complete."""
    failed = F.count_if(~F.col("status").eqNullSafe(F.lit("COMPLETE")))
    return batches.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("batches"), F.coalesce(F.sum("written_count"), F.lit(0)).cast("long").alias("written"),
        F.coalesce(F.sum("skipped_valid_count"), F.lit(0)).cast("long").alias("skipped"), failed.alias("failed"), F.when(failed > 0, "PARTIAL").otherwise("COMPLETE").alias("status"),
    )
