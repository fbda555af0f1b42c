"""SparkSession construction and lineage cutting."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# Settings every job here relies on: AQE re-plans joins from runtime sizes
# (a join side becomes a broadcast only when its measured size is below the
# threshold), splits skewed shuffle partitions, and coalesces small ones.
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def get_spark(app: str = "panelforge", master: str | None = None,
              shuffle_partitions: int | None = None, extra: dict | None = None) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for k, v in DEFAULT_CONF.items():
        builder = builder.config(k, v)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for k, v in (extra or {}).items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Use the cluster's shared ``spark.checkpoint.dir``; only a single-process
    session without one gets a scratch folder, removed when the program ends (tests)."""
    sc = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if configured:
        sc.setCheckpointDir(configured)
        return configured
    current = sc.getCheckpointDir()
    if current:
        return current
    if not (sc.master == "local" or sc.master.startswith("local[")):
        raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
    scratch = tempfile.TemporaryDirectory(prefix="panelforge-ckpt-", ignore_cleanup_errors=True)
    _SCRATCH.append(scratch)
    sc.setCheckpointDir(scratch.name)
    return scratch.name


#: Scratch folders of single-process sessions, kept until the program ends.
_SCRATCH: list[tempfile.TemporaryDirectory] = []


@contextmanager
def setting(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    """A session setting that holds inside and is as it was afterwards."""
    before = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


@contextmanager
def no_constraint_propagation(spark: SparkSession) -> Iterator[None]:
    """Catalyst's constraint propagation blows up (time and heap) on plans with very
    many nullable columns; it is off inside and as it was afterwards."""
    with setting(spark, "spark.sql.constraintPropagation.enabled", "false"):
        yield


def materialize(df: DataFrame) -> DataFrame:
    """Store a stage as Parquet in the shared checkpoint folder and go on from the
    stored copy: a lost executor re-reads it instead of recomputing from raw, and
    later steps read only the columns they use."""
    path = f"{ensure_checkpoint_dir(df.sparkSession).rstrip('/')}/stage-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
