"""Session settings and shared scratch space."""

from __future__ import annotations

import re
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Rows of narrow (id, number) tables a broadcast may hold: some tens of megabytes.
BROADCAST_ROWS = 1_000_000

# Settings the operators rely on. AQE splits skewed join partitions and picks
# broadcast joins from measured sizes, so no operator hints an unmeasured side.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Shuffled rows of totals take ten times their compressed size in a task's hash maps and sorts:
    # partitions are put together to a quarter of the default size.
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16m",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # A feature frame has some 130 columns; the default of 100 turns code generation off.
    "spark.sql.codegen.maxFields": "400",
    # Lists of ids reach the row groups as values; above this Spark pushes their range only.
    "spark.sql.parquet.pushdown.inFilterThreshold": "500",
}

# A task that sums what it reads holds up to some twenty times the bytes of its piece of the files:
# pieces are no longer than this, whatever the size of the files.
MAX_READ_BYTES = 16 << 20

# Only a session builder can set this. Recording a call site per column
# expression costs seconds on wide plans.
BUILDER_SETTINGS = {"spark.python.sql.dataFrameDebugging.enabled": "false"}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings the operators depend on."""
    for name, value in SETTINGS.items():
        spark.conf.set(name, value)
    pieces = "spark.sql.files.maxPartitionBytes"
    given = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(pieces))
    spark.conf.set(pieces, f"{min(given, MAX_READ_BYTES)}b")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach: `spark.checkpoint.dir`, which the cluster sets.

    A local session that sets nothing gets a temporary folder, registered as the
    checkpoint folder. On a cluster that folder would exist once per machine and
    reads would miss files, so there the setting is required.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if not path:
        path = context.getCheckpointDir()
    if not path:
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="reelspark-")
        context.setCheckpointDir(path)
    elif context.getCheckpointDir() is None:
        context.setCheckpointDir(path)
    return path


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path under the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


_WRITTEN: list[str] = []


def materialize(
    df: DataFrame, name: str = "stage", partition_by: str | None = None, options: dict[str, str] | None = None
) -> DataFrame:
    """Cut the lineage by writing `df` to the shared folder and reading it back.

    A written table survives lost executors, and everything downstream sees one
    and the same evaluation of `df`. Used where a result feeds several plans.
    """
    path = scratch_path(df.sparkSession, name)
    _WRITTEN.append(path)
    writer = df.write.mode("overwrite").options(**(options or {}))
    (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)
    stored = df.sparkSession.read.schema(df.schema).parquet(path)
    stored._scratch_path = path
    return stored


def bucketed(df: DataFrame, name: str, column: str, buckets: int) -> DataFrame:
    """Write `df` to the shared folder in buckets of `column`, one file each, and read it back.

    Buckets need an entry in the session's catalog; it is dropped once the frame knows them.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    _WRITTEN.append(path)
    table = f"reelspark_{uuid.uuid4().hex}"
    writer = df.repartition(buckets, column).write.bucketBy(buckets, column).option("path", path)
    writer.format("parquet").saveAsTable(table)
    stored = spark.table(table)
    stored._scratch_path = path
    stored.schema  # resolves the table before its entry goes
    spark.sql(f"DROP TABLE {table}")
    return stored


def _delete(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def discard(stored: DataFrame) -> None:
    """Delete a table that `materialize` wrote and nothing reads any more."""
    path = getattr(stored, "_scratch_path", None)
    if path in _WRITTEN:
        _WRITTEN.remove(path)
        _delete(stored.sparkSession, path)


@contextmanager
def scratch(spark: SparkSession):
    """Tables written inside are deleted at the end; earlier ones stay."""
    before = set(_WRITTEN)
    try:
        yield
    finally:
        for path in [p for p in _WRITTEN if p not in before]:
            _WRITTEN.remove(path)
            _delete(spark, path)


def broadcast_if_small(stored: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast of a stored table only when its counted rows allow it.

    Beyond the limit the join is left to Spark's shuffle joins.
    """
    return F.broadcast(stored) if stored.count() <= max_rows else stored


def release(spark: SparkSession) -> None:
    """Delete the tables `materialize` wrote in this session; frames over them end here."""
    while _WRITTEN:
        _delete(spark, _WRITTEN.pop())
