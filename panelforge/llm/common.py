"""Helpers shared by the operators: table access, stored stages, Arrow maps and
white space as the public tokenizers define it."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import ensure_checkpoint_dir

#: Unicode White_Space, written out because Python's ``\s`` also takes U+001C..U+001F.
WS = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def store(df: DataFrame, name: str, codec: str = "snappy") -> DataFrame:
    """Write ``df`` once as Parquet under the shared checkpoint folder and read
    it back: the lineage is cut, a lost executor costs one re-read, and later
    steps prune columns."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/llm-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=codec)
    return spark.read.schema(df.schema).parquet(path)


def arrow_map(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str) -> DataFrame:
    """``mapInArrow`` with a function of one batch."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in bounded(batch):
                out = fn(part)
                if out is not None and out.num_rows:
                    yield out

    return df.mapInArrow(run, schema)


def bounded(batch: pa.RecordBatch, most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of ``batch`` of about ``most`` bytes, one row at least, so that what
    a function holds at once does not follow the batch size."""
    n = batch.num_rows
    if not n:
        return
    step = max(1, int(n * most / max(batch.nbytes, 1)))
    for i in range(0, n, step):
        yield batch.slice(i, step)


def crc_mod(column: str, m: int):
    """crc32 of the key as text, modulo ``m``; NULL for a NULL key."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % m


def sample_per_class(keyed: DataFrame, key: str, cls: str, most: int) -> DataFrame:
    """At most ``most`` keys of each class, those of the smallest hash.  Up to Spark's
    limit for it (1,000 by default) the row numbers are cut in every partition before
    the shuffle; beyond it a class's keys and hashes, nothing else, meet in one window."""
    w = Window.partitionBy(cls).orderBy(F.xxhash64(key), key)
    return keyed.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= most).drop("_rn")


class Memo(dict):
    """Memo of a pure function of a string in two generations of ``size`` entries:
    frequent strings move to the young one, the old one is dropped when that is
    full.  Strings over 64 characters are not kept.  Results do not depend on it."""

    def __init__(self, fn: Callable, size: int = 150_000):
        super().__init__()
        self.fn, self.size, self.old = fn, size, {}

    def __missing__(self, key: str):
        found = self.old.get(key)
        if found is None:
            found = self.fn(key)
            if len(key) > 64:
                return found
        if len(self) >= self.size:
            self.old = dict(self)
            self.clear()
        self[key] = found
        return found


def if_small(df: DataFrame, row_bytes: int, most: int = 16 << 20) -> DataFrame:
    """A stored table with a broadcast hint if its rows, counted, stay under ``most``
    bytes; beyond that the table itself, which joins by shuffle."""
    return F.broadcast(df) if df.count() * row_bytes <= most else df
