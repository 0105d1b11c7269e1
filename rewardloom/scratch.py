"""Written intermediate tables in the folder all executors share.

A table that several jobs read is written once and read back, which cuts its
lineage (a lost executor does not undo it), keeps column pruning and gives the
planner true sizes to decide on broadcasts. ``discard`` deletes a table that nothing reads any more.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

SETTING = "spark.checkpoint.dir"
#: Spark's setting to delete an execution's shuffle files when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

# The folder used where the session names none.
_WHERE_UNSET: list[str] = []


def use_where_unset(folder: str) -> None:
    """Name the folder for sessions without the setting, as tests and benches do."""
    _WHERE_UNSET[:] = [folder]


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``, else by ``use_where_unset``."""
    folder = spark.conf.get(SETTING, None) or next(iter(_WHERE_UNSET), None)
    if not folder:
        raise RuntimeError(f"set {SETTING} to a folder that all executors can reach")
    return folder.rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_folder(spark)}/rewardloom/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """``df`` written to the shared folder and read back. The shuffles that made it go when it is written."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    found = spark.read.schema(df.schema).parquet(path)
    found.written_to = path
    return found


def discard(*tables: DataFrame) -> None:
    """Delete what ``materialize`` wrote for these tables. Nothing may read them, or tables that depend on them, from then on."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.written_to)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)
