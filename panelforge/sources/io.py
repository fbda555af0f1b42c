"""Readers and writers: CSV inputs, format dispatch, stage tables, sinks.

Every write goes to a path the caller names (a shared store on a cluster);
stage tables are Parquet so a later job - or a retried one after a lost
executor - reads them instead of recomputing.
"""

from __future__ import annotations

import os
import re
from collections.abc import Callable
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.clean import attach_target, nan_to_null, sample_exact
from ..schema import N_LAGS


def raw_feature_schema(n: int = N_LAGS, codes_as: T.DataType = T.IntegerType()) -> T.StructType:
    """Explicit schema of the raw feature file: no inference pass."""
    fields = [T.StructField("ID", T.LongType()), T.StructField("DATE", T.IntegerType()),
              T.StructField("STOCK", T.IntegerType())]
    fields += [T.StructField(c, codes_as) for c in ("INDUSTRY", "INDUSTRY_GROUP", "SECTOR", "SUB_INDUSTRY")]
    fields += [T.StructField(f"RET_{k}", T.DoubleType()) for k in range(1, n + 1)]
    fields += [T.StructField(f"VOLUME_{k}", T.DoubleType()) for k in range(1, n + 1)]
    return T.StructType(fields)


TARGET_SCHEMA = T.StructType([T.StructField("ID", T.LongType()), T.StructField("RET", T.StringType())])


def read_csv(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    reader = spark.read.option("header", True).option("nanValue", "NaN").option("mode", "FAILFAST")
    if schema is not None:
        reader = reader.schema(schema)
    return nan_to_null(reader.csv(path))


def load_data(spark: SparkSession, x_train, y_train, x_test, sample_n: int | None = None, seed: int = 42):
    """Each input is a path or an already loaded DataFrame.  The target is
    attached by ``ID``; with ``sample_n`` both frames are sampled exactly."""
    def _get(x, schema):
        return x if isinstance(x, DataFrame) else read_csv(spark, str(x), schema)
    train = attach_target(_get(x_train, raw_feature_schema()), _get(y_train, TARGET_SCHEMA))
    test = _get(x_test, raw_feature_schema())
    if sample_n is not None:
        train, test = sample_exact(train, sample_n, seed), sample_exact(test, sample_n, seed)
    return train, test


_READERS = {".csv": "csv", ".parquet": "parquet", ".pq": "parquet", ".pkl": "parquet", ".pickle": "parquet"}


def read_any(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """Read by extension: csv or parquet (pickle paths are stored as Parquet)."""
    fmt = _READERS.get(os.path.splitext(path.rstrip("/"))[1].lower())
    if fmt is None:
        raise ValueError(f"unsupported file format: {path}")
    if fmt == "csv":
        return read_csv(spark, path, schema)
    return spark.read.parquet(path)


def write_any(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    fmt = _READERS.get(os.path.splitext(path.rstrip("/"))[1].lower())
    if fmt is None:
        raise ValueError(f"unsupported file format: {path}")
    if fmt == "csv":
        df.write.mode(mode).option("header", True).csv(path)
    else:
        df.write.mode(mode).parquet(path)


def stored(spark: SparkSession, path: str) -> bool:
    """Whether a table has been written to ``path`` as a whole."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.exists(jvm.org.apache.hadoop.fs.Path(path + "/_SUCCESS"))


def write_stage(df: DataFrame, path: str) -> DataFrame:
    """Store an intermediate table and continue from the stored copy."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)


def read_or_compute(spark: SparkSession, path: str, compute: Callable[[], DataFrame],
                    recompute: bool = False) -> DataFrame:
    """Read a stage's stored output if present (and not ``recompute``), else
    compute it, store it and read it back."""
    if not recompute and stored(spark, path):
        return spark.read.parquet(path)
    return write_stage(compute(), path)


def write_version(df: DataFrame, path: str, run_id: str, fmt: str = "parquet") -> None:
    """Versioned sink (metrics, chart data): one partition a run.  A run that is
    repeated replaces its own partition and leaves the others, so a retry leaves
    one copy."""
    if not re.fullmatch(r"[A-Za-z0-9._:-]+", run_id):
        raise ValueError(f"not a plain run id: {run_id!r}")
    (df.withColumn("run_id", F.lit(run_id)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("run_id").format(fmt).save(path))


def read_version(spark: SparkSession, path: str, run_id: str | None = None, fmt: str = "parquet",
                 schema: T.StructType | None = None) -> DataFrame:
    """One version of a sink, by default that of the greatest ``run_id``; only its
    partition is read.  JSON needs the ``schema`` that was written."""
    reader = spark.read.option("basePath", path)
    if schema is not None:
        reader = reader.schema(schema)
    if run_id is None:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        folders = [f.getPath().getName() for f in fs.listStatus(p)] if fs.exists(p) else []
        runs = [unquote(f.removeprefix("run_id=")) for f in folders if f.startswith("run_id=")]
        if not runs:
            raise ValueError(f"no version under {path}")
        run_id = max(runs)
    return reader.format(fmt).load(f"{path.rstrip('/')}/run_id={run_id.replace(':', '%3A')}").drop("run_id")


def write_submission(pred: DataFrame, path: str, key: str = "ID", target: str = "RET") -> None:
    pred.select(key, target).write.mode("overwrite").option("header", True).csv(path)
