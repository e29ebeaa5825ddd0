"""From files to documents and chunks: plan against the registry, extract, normalise, cut."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import chunking, registry
from ..sources import files


def ingest(inventory: DataFrame, known: DataFrame, overrides: DataFrame, extract=files.plain_text) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Plan, documents and chunks of an inventory with content; what the registry knows isn't read again.

    ``extract`` maps (source_type, content) to text and may fail: such files become documents with status FAILED.
    """
    a = inventory.withColumn("artifact_id", F.xxhash64("logical_path", "sha256"))
    plan = registry.context_plan(a.select("artifact_id", "logical_path", "sha256"), known, overrides)
    todo = a.join(plan.where(F.col("action") == "convert").select("artifact_id"), "artifact_id", "left_semi")
    d = files.extract(todo, extract)
    d = d.withColumn("text_content", T.normalize("text_content")).withColumn("metadata", F.struct(F.lit(None).cast("string").alias("chunking_status")))
    c = chunking.chunk(d.where(F.col("status") == "COMPLETE"), "text_content", ("artifact_id", "logical_path", "sha256"))
    return plan, d, c.withColumn("chunk_id", T.chunk_id("logical_path", "sha256", "chunk_index"))
