"""Tables in the folder that all executors share: they cut lineage and outlive executors."""

from __future__ import annotations

import os
import tempfile
import threading
import uuid

from pyspark.sql import DataFrame, SparkSession

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_made: dict[str, list[str]] = {}
_lock = threading.Lock()
_writing: dict[str, list] = {}


def shared_dir(spark: SparkSession) -> str:
    """Folder that all executors share: ``spark.checkpoint.dir``. Only a local session may do without, and gets its own."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        at = tempfile.mkdtemp(prefix="lodestrata-")
        spark.conf.set("spark.checkpoint.dir", at)
        spark.sparkContext.setCheckpointDir(at)
    return at


class _Cleaning:
    """While tables are written, Spark removes the shuffle files of finished queries; the last writer restores the setting."""

    def __init__(self, spark: SparkSession):
        self.conf, self.key = spark.conf, spark.sparkContext.applicationId

    def __enter__(self) -> None:
        with _lock:
            held = _writing.setdefault(self.key, [0, self.conf.get(_CLEANUP, None)])
            held[0] += 1
            self.conf.set(_CLEANUP, "true")

    def __exit__(self, *_: object) -> None:
        with _lock:
            held = _writing[self.key]
            held[0] -= 1
            if not held[0]:
                self.conf.unset(_CLEANUP) if held[1] is None else self.conf.set(_CLEANUP, held[1])
                del _writing[self.key]


#: For folders of the local file system (a mounted one, too): files without a process that sets permissions for each, during
#: which an executor's memory counts twice, and without checksum files beside them.
_PLAIN_FILES = {"fs.file.impl": "org.apache.hadoop.fs.RawLocalFileSystem", "fs.file.impl.disable.cache": "true"}


def _options(spark: SparkSession, at: str) -> dict[str, str]:
    path = spark._jvm.org.apache.hadoop.fs.Path(at)
    local = path.getFileSystem(spark._jsc.hadoopConfiguration()).getScheme() == "file"
    return {"compression": "zstd", **(_PLAIN_FILES if local else {})}


def write_table(df: DataFrame, at: str, partition_by: tuple[str, ...] = ()) -> DataFrame:
    """Write ``df`` as Parquet and read it back. The shuffle files of the write aren't needed afterwards."""
    spark = df.sparkSession
    with _Cleaning(spark):
        w = df.write.mode("overwrite").options(**_options(spark, at))
        (w.partitionBy(*partition_by) if partition_by else w).parquet(at)
    return spark.read.schema(df.schema).parquet(at)


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, keeps columns prunable, outlives executors."""
    spark = df.sparkSession
    at = os.path.join(shared_dir(spark), f"{label}-{uuid.uuid4().hex}")
    _made.setdefault(spark.sparkContext.applicationId, []).append(at)
    return write_table(df, at)


def clear(spark: SparkSession) -> int:
    """Delete the tables that ``materialise`` wrote for this application, once no DataFrame needs them; their number."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    made = _made.pop(spark.sparkContext.applicationId, [])
    for at in made:
        path = jvm.org.apache.hadoop.fs.Path(at)
        path.getFileSystem(conf).delete(path, True)
    return len(made)
