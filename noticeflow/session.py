"""Session construction and the shared scratch folder."""

from __future__ import annotations

import atexit
import os
import re
import shutil
import tempfile
import uuid
from functools import wraps

from pyspark.sql import SparkSession


def get_spark(
    app: str = "noticeflow", master: str | None = None, shuffle_partitions: int | None = None, memory: str | None = None
):
    """Session with the settings the jobs rely on; cluster sizing stays with the caller."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    if memory:
        builder = builder.config("spark.driver.memory", memory)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark = (
        builder.config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        # Pages are wide: small Arrow batches keep Python workers within memory.
        .config("spark.sql.execution.arrow.maxRecordsPerBatch", "512")
        # Character tables are literals of the plan: keep its printed form short.
        .config("spark.sql.maxPlanStringLength", "262144")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    bounded_batches(spark)
    return spark


ARROW_BYTES = 4 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Arrow batches of bounded bytes: rows are texts of any length, and a worker holds several forms of a batch."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))


_FILES, _ROWS = "spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"
SENT_ROWS = "10MB"


def joins_by_rows(job):
    """A job whose joins send a side by the bytes of its rows, as shuffled, never by the size of its files.

    Keys of many rows take little room on disk, but the driver gathers the rows that are sent. The
    settings hold while ``job`` runs, so for what it writes; other plans of the session keep theirs.
    """

    @wraps(job)
    def run(*args, **kwargs):
        spark = SparkSession.active()
        before = {k: spark.conf.get(k, None) for k in (_FILES, _ROWS)}
        spark.conf.set(_FILES, "-1")
        spark.conf.set(_ROWS, SENT_ROWS)
        try:
            return job(*args, **kwargs)
        finally:
            for key, value in before.items():
                spark.conf.set(key, value) if value is not None else spark.conf.unset(key)

    return run


SPREAD_BYTES = 16 * 1024 * 1024


def spread(df):
    """Even out a small input before CPU-heavy tasks.

    The optimizer's size estimate decides: what is too small to fill the cluster by its own
    splits is shuffled once; large inputs keep their scan partitions and never move.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if size < SPREAD_BYTES * cores else df


def dealt(df, *keys):
    """Small rows that a later step multiplies, over a fixed number of tasks: by their size they would be gathered."""
    spark = df.sparkSession
    n = max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return df.repartition(n, *keys)


_local_root: str | None = None


def _shared_root(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; only a local master may go without (tests)."""
    global _local_root
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if root:
        return root.rstrip("/")
    master = spark.sparkContext.master
    if not re.match(r"local($|\[)", master):
        raise ValueError(f"set spark.checkpoint.dir to a folder that all executors of {master} share")
    if _local_root is None or not os.path.isdir(_local_root):
        _local_root = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        atexit.register(shutil.rmtree, _local_root, ignore_errors=True)
    return _local_root


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the cluster's shared folder."""
    return f"{_shared_root(spark)}/{name}-{uuid.uuid4().hex[:12]}"


_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialize(df, name: str):
    """Cut lineage through a written table in the shared folder.

    Shuffle files of the writing job are dropped when it ends: the table replaces them.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    before = spark.conf.get(_CLEAN, None)
    spark.conf.set(_CLEAN, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEAN, before) if before is not None else spark.conf.unset(_CLEAN)
    table = spark.read.schema(df.schema).parquet(path)
    table._scratch_path = path
    return table


def discard(*tables) -> None:
    """Delete written intermediates that no later plan reads."""
    for table in tables:
        path = table.sparkSession._jvm.org.apache.hadoop.fs.Path(table._scratch_path)
        path.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(path, True)
