"""Session creation and lineage cutting.

`get_spark` is only a convenience for tests, the bench and local runs; on a
cluster the caller owns the session and every operator just uses it.
"""
from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def get_spark(app: str = "quarry", cpus: int | str = "*", shuffle_partitions: int = 8,
              driver_memory: str = "12g") -> SparkSession:
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", driver_memory)
        .config("spark.sql.constraintPropagation.enabled", "false")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder the cluster names.

    The cluster's `spark.checkpoint.dir` wins.  Only in local mode, where
    driver and executors are one process, may it be unset.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf_dir = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not conf_dir and not sc.master.startswith("local[") and sc.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    if not conf_dir:  # one process, as in tests
        conf_dir = tempfile.mkdtemp(prefix="quarry-ckpt-")
    sc.setCheckpointDir(conf_dir)
    return sc.getCheckpointDir() or conf_dir


def materialize(df: DataFrame, eager: bool = True) -> DataFrame:
    """Cut lineage with a reliable checkpoint in the shared checkpoint folder.

    Survives executor loss (unlike localCheckpoint/persist), and keeps later
    stages from recomputing the wide joins behind `df`.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=eager)


def materialize_table(df: DataFrame, name: str) -> DataFrame:
    """Write `df` as parquet under the shared checkpoint folder and return a
    scan of it.

    Used for the record and score tables that many queries read: the write
    happens once, later queries prune columns and push filters into the
    parquet scan instead of re-deriving the wide plan, and the files live
    in the cluster's shared checkpoint folder, so losing an executor does
    not lose them.
    """
    spark = df.sparkSession
    base = ensure_checkpoint_dir(spark).rstrip("/")
    path = f"{base}/quarry-tables/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"
    df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def default_parallelism(spark: SparkSession) -> int:
    return int(os.environ.get("QUARRY_PARALLELISM", spark.sparkContext.defaultParallelism))


WIDE_PLAN_CONF = {
    # Constraint propagation re-derives constraints through every alias of a
    # projection; on the wide scoring plans (hundreds of derived columns and
    # one-row statistics cross-joined back) it dominated planning time
    # (~30 s) while adding nothing: the filters it infers are IsNotNull on
    # columns that are never null after the record's fill step.
    "spark.sql.constraintPropagation.enabled": "false",
}


def tune_for_wide_plans(spark: SparkSession) -> None:
    for k, v in WIDE_PLAN_CONF.items():
        if spark.conf.get(k, None) != v:
            spark.conf.set(k, v)
