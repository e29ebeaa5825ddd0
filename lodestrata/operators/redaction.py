"""Rule-based redaction: spans, resolution of overlaps, plans, application, provenance and guards."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    category: str
    rule_id: str
    pattern: str

    @property
    def replacement(self) -> str:
        return f"[{self.category}]"


_NUMBER = r"(?:\d{1,3}(?:,\d{3})+|\d{3,})(?:\.\d{2})?"
#: Profiles with their rules in order of precedence.
PROFILES: dict[str, tuple[Rule, ...]] = {
    "business_sensitive": (
        Rule("IBAN", "iban_v1", r"\b[A-Z]{2}\d{2}[A-Z0-9]{11,30}\b"),
        Rule("SWIFT_BIC", "swift_bic_v3", r"(?i)\b(?:swift|bic|swift/bic|bic/swift)\s*(?:code|no\.?|#)?\s*[:\-]?\s*([A-Z]{4}[A-Z]{2}[A-Z0-9]{2}(?:[A-Z0-9]{3})?)\b"),
        Rule("BANK_ACCOUNT", "bank_account_v2", r"(?i)\b(?:account|acct|a/c)\s*(?:number|no\.?|#)?\s*[:\-]?\s*\d{6,17}\b"),
        Rule("ROUTING_NUMBER", "routing_number_v2", r"(?i)\b(?:routing|aba)\s*(?:number|no\.?|#)?\s*[:\-]?\s*\d{9}\b"),
        Rule("CREDIT_CARD", "credit_card_v2", r"(?i)\b(?:card|credit card|cc)\s*(?:number|no\.?|#)?\s*[:\-]?\s*(?:\d[ -]?){13,19}\b"),
        Rule("CURRENCY_AMOUNT", "currency_amount_v2", rf"(?:\$\s?{_NUMBER}|(?:USD|EUR|GBP)\s?{_NUMBER}|{_NUMBER}\s?(?:USD|EUR|GBP))"),
    ),
    "identity_contact": (
        Rule("EMAIL", "email_v1", r"(?i)\b[a-z0-9._%+\-]+@[a-z0-9.\-]+\.[a-z]{2,}\b"),
        Rule("PHONE_NUMBER", "phone_number_v1", r"(?i)\b(?:phone|mobile|cell|tel|telephone)\s*(?:number|no\.?|#)?\s*[:\-]?\s*(?:\+?1[\s.\-]?)?(?:\(?\d{3}\)?[\s.\-]?)\d{3}[\s.\-]?\d{4}\b"),
        Rule("SSN", "ssn_v1", r"(?i)\b(?:ssn|social security number)\s*(?:number|no\.?|#)?\s*[:\-]?\s*\d{3}-\d{2}-\d{4}\b"),
        Rule("DATE_OF_BIRTH", "dob_v1", r"(?i)\b(?:dob|date of birth)\s*[:\-]?\s*(?:0?[1-9]|1[0-2])[/\-](?:0?[1-9]|[12][0-9]|3[01])[/\-](?:19|20)\d{2}\b"),
    ),
}


def version(profile: str) -> str:
    """Version and hash of a profile's rules, which requests must name."""
    return f"{profile}_v1"


def check(profile: str, ruleset_version: str, ruleset_hash: str) -> None:
    if profile not in PROFILES:
        raise ValueError(f"unknown profile {profile!r}")
    if (ruleset_version, ruleset_hash) != (version(profile), version(profile)):
        raise ValueError("rules have another version or hash")


#: Stands around matches while a text is cut at them; texts that hold it are cut in another way.
_EDGE = "\ue000\uf8ff"


def _cut(text: Column, pattern: str) -> Column:
    """A text as gap, match, gap, ..., gap; one pass of the pattern unless the text holds the mark."""
    found, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    both = F.flatten(F.transform(F.arrays_zip(gaps.alias("g"), found.alias("m")), lambda z: F.array_compact(F.array(z["g"], z["m"]))))
    return F.when(F.contains(text, F.lit(_EDGE)), both).otherwise(F.split(F.regexp_replace(text, pattern, f"{_EDGE}$0{_EDGE}"), _EDGE, -1))


def found(docs: DataFrame, profile: str) -> DataFrame:
    """(artifact_id, start_char, end_char, rule_order, category, rule_id, original): all matches of all rules of a profile.

    Matches and the lengths between them are rows, whose running sums are the places; no list grows within a text. An
    artifact_id counts once; without one a document takes no part.
    """
    rules = F.array(*(F.struct(F.lit(i).alias("rule_order"), F.lit(r.category).alias("category"), F.lit(r.rule_id).alias("rule_id"), _cut(F.col("text_content"), r.pattern).alias("parts")) for i, r in enumerate(PROFILES[profile])))
    x = docs.where((F.length("text_content") > 0) & F.col("artifact_id").isNotNull()).select("artifact_id", F.explode(rules).alias("r")).where(F.size("r.parts") > 1)
    x = x.select("artifact_id", "r.rule_order", "r.category", "r.rule_id", F.posexplode("r.parts").alias("at", "part"))
    match = F.col("at") % 2 == 1
    x = x.select("artifact_id", "rule_order", "category", "rule_id", "at", F.length("part").alias("size"), F.when(match, F.col("part")).alias("original"))
    upto = Window.partitionBy("artifact_id", "rule_order").orderBy("at")
    x = x.withColumn("end_char", F.sum("size").over(upto).cast("int")).where(F.col("original").isNotNull())
    return x.select("artifact_id", (F.col("end_char") - F.col("size")).alias("start_char"), "end_char", "rule_order", "category", "rule_id", "original")


def resolve(spans: DataFrame) -> DataFrame:
    """Spans of each artifact by (start, end, rule order), each taken if it starts where the last one taken has ended."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, at = None, 0
        for b in batches:
            keep = []
            for key, start, end in zip(*(b.column(c).to_pylist() for c in ("artifact_id", "start_char", "end_char"))):
                if key != here:
                    here, at = key, 0
                keep.append(start >= at)
                at = end if start >= at else at
            yield b.filter(pa.array(keep, pa.bool_()))

    order = ["artifact_id", "start_char", "end_char", "rule_order"]
    return spans.repartition("artifact_id").sortWithinPartitions(*order).mapInArrow(run, spans.schema)


def span_rows(docs: DataFrame, profile: str, resolved: bool) -> DataFrame:
    """(artifact_id, start_char, end_char, rule_order, category, rule_id, original)."""
    x = found(docs, profile)
    return resolve(x) if resolved else x


def plan(docs: DataFrame, profile: str) -> DataFrame:
    """(artifact_id, suggestion_no, category, original, replacement, rule_id): each once in an artifact, as first met."""
    x = span_rows(docs, profile, True)
    x = x.groupBy("artifact_id", "category", "original", "rule_id").agg(F.min("start_char").alias("start"))
    w = Window.partitionBy("artifact_id").orderBy("start", "category", "rule_id", "original")
    return x.select("artifact_id", F.row_number().over(w).alias("suggestion_no"), "category", "original", F.concat(F.lit("["), "category", F.lit("]")).alias("replacement"), "rule_id")


def category_counts(planned: DataFrame, profile: str) -> DataFrame:
    """(category, n_suggestions, n_artifacts) for each category of the profile, zero where there is none."""
    spark = planned.sparkSession
    all_of = spark.createDataFrame([(r.category,) for r in PROFILES[profile]], "category string")
    n = planned.groupBy("category").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("artifact_id").alias("a"))
    return all_of.join(n, "category", "left").select("category", F.coalesce("n", F.lit(0).cast("long")).alias("n_suggestions"), F.coalesce("a", F.lit(0).cast("long")).alias("n_artifacts"))


def apply(docs: DataFrame, planned: DataFrame) -> DataFrame:
    """(artifact_id, redacted_text, applied_count): suggestions of the artifact replaced in turn, wherever they occur.

    An artifact's suggestions are bounded by its text. To use those of a whole plan for every artifact, give each
    artifact all of them.
    """
    s = planned.groupBy("artifact_id").agg(F.array_sort(F.collect_list(F.struct("suggestion_no", "original", "replacement"))).alias("l"))
    x = docs.join(s, "artifact_id", "left")
    none = F.array().cast("array<struct<suggestion_no:int,original:string,replacement:string>>")
    start = F.struct(F.col("text_content").alias("t"), F.lit(0).alias("n"))
    done = F.aggregate(F.coalesce("l", none), start, lambda a, y: F.when(F.contains(a["t"], y["original"]), F.struct(F.replace(a["t"], y["original"], y["replacement"]).alias("t"), (a["n"] + 1).alias("n"))).otherwise(a))
    x = x.withColumn("done", done)
    return x.select("artifact_id", F.col("done.t").alias("redacted_text"), F.col("done.n").alias("applied_count"))


def provenance(docs: DataFrame, applied: DataFrame, overrides: DataFrame, profile: str, plan_id: int) -> DataFrame:
    """Redacted documents (without chunks, to be cut anew) with where they come from and what stood in their place before."""
    before = overrides.select("artifact_id", F.struct("redacted_artifact_id", "profile").alias("previous_override"))
    x = docs.select("artifact_id", "document_hash", "source_path").join(applied, "artifact_id").join(before, "artifact_id", "left")
    return x.select(
        "artifact_id", "source_path", F.col("document_hash").alias("source_hash"), F.sha2("redacted_text", 256).alias("redacted_hash"), "applied_count",
        F.lit(profile).alias("profile"), F.lit(plan_id).cast("long").alias("plan_id"), F.lit("REQUIRES_RECHUNK").alias("chunking_status"),
        F.col("previous_override.redacted_artifact_id").alias("previous_redacted_artifact_id"), F.col("previous_override.profile").alias("previous_profile"),
    )


def approval_gate(plans: DataFrame, requests: DataFrame) -> DataFrame:
    """(plan_id, allowed, reason): requests (plan_id, profile, ruleset_version, ruleset_hash, yes_commit) against plans
    (plan_id, run_id, profile, ruleset_version, ruleset_hash, status, created_utc)."""
    newer = plans.select("run_id", "profile", "created_utc").groupBy("run_id", "profile").agg(F.max("created_utc").alias("latest"))
    p = plans.join(newer, ["run_id", "profile"])
    p = p.select("plan_id", *(F.col(c).alias("p_" + c) for c in ("profile", "ruleset_version", "ruleset_hash", "status", "created_utc")), "latest")
    x = requests.join(p, "plan_id", "left")
    reason = (
        F.when(~F.coalesce("yes_commit", F.lit(False)), "yes_commit_missing")
        .when(F.col("p_status").isNull(), "plan_not_found")
        .when((F.col("profile") != F.col("p_profile")) | (F.col("ruleset_version") != F.col("p_ruleset_version")) | (F.col("ruleset_hash") != F.col("p_ruleset_hash")), "ruleset_mismatch")
        .when(F.col("p_status") != "PLANNED", "plan_not_planned")
        .when(F.col("p_created_utc") < F.col("latest"), "superseded")
    )
    return x.select("plan_id", reason.isNull().alias("allowed"), F.coalesce(reason, F.lit("approved")).alias("reason"))


def guards(plans: DataFrame, approvals: DataFrame, suggestions: DataFrame, requests: DataFrame) -> DataFrame:
    """(plan_id, artifact_id, ok, reason): whether a plan exists, is approved and has suggestions for the artifact."""
    x = requests.join(plans.select("plan_id", "status"), "plan_id", "left")
    x = x.join(approvals.select("plan_id", "approval_id"), "plan_id", "left")
    s = suggestions.select("plan_id", "artifact_id").distinct().withColumn("has", F.lit(True))
    x = x.join(s, ["plan_id", "artifact_id"], "left")
    reason = F.when(F.col("status").isNull(), "plan_not_found").when(F.col("status") != "PLANNED", "plan_not_planned").when(F.col("approval_id").isNull(), "not_approved").when(F.col("has").isNull(), "no_suggestions")
    return x.select("plan_id", "artifact_id", reason.isNull().alias("ok"), F.coalesce(reason, F.lit("ok")).alias("reason"))


def plan_history(plans: DataFrame, suggestions: DataFrame, approvals: DataFrame, redacted: DataFrame) -> DataFrame:
    """Plans of each artifact with counts. ``n_joined`` counts joined rows, as a report that multiplies suggestions by
    approvals and redactions does; ``n_suggestions`` counts suggestions."""
    x = plans.join(suggestions.select("plan_id", "artifact_id", "suggestion_id"), "plan_id")
    x = x.join(approvals.select("plan_id", "approval_id"), "plan_id", "left").join(redacted.select("plan_id", "artifact_id", "redacted_artifact_id"), ["plan_id", "artifact_id"], "left")
    return x.groupBy("artifact_id", "plan_id", "run_id", "profile", "status").agg(
        F.count("suggestion_id").alias("n_joined"), F.count_distinct("suggestion_id").alias("n_suggestions"), F.max("approval_id").alias("approval_id"), F.max("redacted_artifact_id").alias("redacted_artifact_id"),
    )
