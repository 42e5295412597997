"""Session defaults and the shared staging area.

Intermediate results that are read more than once are written as Parquet under
``spark.checkpoint.dir``. That cuts the lineage, survives the loss of any
executor, and keeps columnar pruning and statistics for the next read.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_LOCAL_ROOT: str | None = None
_SCOPES: list[list[str]] = []  # staged tables of the computations under way, innermost last


def build_session(app: str = "prismatch", master: str | None = None, cores: int | None = None) -> SparkSession:
    """A session with the settings the engine is tuned for (all can be overridden by spark-submit)."""
    for name in ("OPENBLAS_NUM_THREADS", "OMP_NUM_THREADS", "MKL_NUM_THREADS"):
        os.environ.setdefault(name, "1")
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "64KB")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.executorEnv.OPENBLAS_NUM_THREADS", "1")
        .config("spark.ui.enabled", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")  # no call-site capture per column
    )
    if master:
        builder = builder.master(master)
    if cores:
        builder = builder.config("spark.sql.shuffle.partitions", str(cores))
    return builder.getOrCreate()


def staging_root(spark: SparkSession) -> str:
    """Shared folder for staged tables: ``spark.checkpoint.dir`` when the cluster names one."""
    global _LOCAL_ROOT
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")
    if _LOCAL_ROOT is None:
        _LOCAL_ROOT = tempfile.mkdtemp(prefix="prismatch-", dir="/tmp")
    return _LOCAL_ROOT


def stage(df: DataFrame, label: str = "t") -> DataFrame:
    """Write ``df`` once to the staging area and read it back."""
    spark = df.sparkSession
    path = f"{staging_root(spark).rstrip('/')}/prismatch-{label}-{uuid.uuid4().hex}"
    df.write.mode("errorifexists").parquet(path)
    if _SCOPES:
        _SCOPES[-1].append(path)
    return spark.read.schema(df.schema).parquet(path)


def settled(spark: SparkSession, build: Callable[[], DataFrame], label: str = "t") -> DataFrame:
    """Stage what ``build`` returns, then remove every table that it staged on its way."""
    _SCOPES.append([])
    try:
        df = build()
        path = f"{staging_root(spark).rstrip('/')}/prismatch-{label}-{uuid.uuid4().hex}"
        df.write.mode("errorifexists").parquet(path)
    finally:
        for used in _SCOPES.pop():
            at = spark._jvm.org.apache.hadoop.fs.Path(used)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    if _SCOPES:
        _SCOPES[-1].append(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """Use all cores for heavy per-row work when the input has fewer splits than cores.

    Large inputs have more splits than cores and are left as they are.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
