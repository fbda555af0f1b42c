"""Train/test splits and cross-validation folds, reproducible by seed.

Randomness is ``md5`` of the row key and the seed (the same function exists in
DuckDB, so every split can be checked there).  Fold ids are joined back from
small tables (one row per date, or per row in the stratified case).
"""

from __future__ import annotations

import math
from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.selection import nth_smallest, up_to
from ..session import materialize


def _hash(key: Column | str, seed: int) -> Column:
    k = F.col(key) if isinstance(key, str) else key
    return F.md5(F.concat(k.cast("string"), F.lit(f":{seed}")))


def _unit(key, seed: int) -> Column:
    """A number in [0, 1) from the first 15 hex digits of the md5."""
    return F.conv(F.substring(_hash(key, seed), 1, 15), 16, 10).cast("double") / float(16 ** 15)


def hash_split(df: DataFrame, test_size: float = 0.25, seed: int = 0, key: str = "ID",
               out: str = "split") -> DataFrame:
    """Random, not stratified, one pass: ``test`` when u(key, seed) < test_size."""
    return df.withColumn(out, F.when(_unit(key, seed) < test_size, F.lit("test")).otherwise(F.lit("train")))


def train_test_frames(df: DataFrame, test_size: float = 0.25, seed: int = 0, key: str = "ID",
                      target: str = "RET"):
    """X_train, X_test, y_train, y_test as four DataFrames (ids kept on y), with an
    exact test count (``exact_split``).  The split is stored once."""
    s = materialize(exact_split(df, test_size, seed, key, "__split"))
    tr, te = s.where(F.col("__split") == "train").drop("__split"), s.where(F.col("__split") == "test").drop("__split")
    return tr.drop(target), te.drop(target), tr.select(key, target), te.select(key, target)


def date_folds(df: DataFrame, n_splits: int = 4, seed: int = 0, date_col: str = "DATE",
               out: str = "fold") -> DataFrame:
    """K folds over distinct dates: no date is in two folds.  Dates are ranked
    by md5(date:seed) and dealt round-robin, so fold sizes differ by at most
    one date.  The date table has one row per date."""
    dates = df.select(date_col).distinct()
    ranked = dates.withColumn(
        out, ((F.row_number().over(Window.orderBy(_hash(date_col, seed), date_col)) - 1) % n_splits).cast("int"))
    return df.join(ranked, date_col, "left")


def stratified_folds(df: DataFrame, k: int = 10, seed: int = 0, label: str = "RET",
                     key: str = "ID", out: str = "fold") -> DataFrame:
    """Stratified k folds: within each class, rows ordered by md5(key:seed) are
    dealt round-robin.  Ranks are exact through per-class running counts over
    range buckets of the hash, not a window over a whole class."""
    h = _hash(key, seed)
    keyed = df.withColumn("__h", h)
    # range-bucket each class by the leading hex digits of the hash (uniform)
    b = F.conv(F.substring("__h", 1, 3), 16, 10).cast("int")
    keyed = keyed.withColumn("__b", b)
    counts = keyed.groupBy(label, "__b").agg(F.count(F.lit(1)).alias("__cnt"))
    offs = counts.withColumn("__off", F.coalesce(F.sum("__cnt").over(
        Window.partitionBy(label).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    rn = F.row_number().over(Window.partitionBy(label, "__b").orderBy("__h", key))
    # Null-safe on the label: rows without one are a class of their own.
    o = offs.select(F.col(label).alias("__l"), F.col("__b").alias("__ob"), "__off")
    return (keyed.join(o, F.col(label).eqNullSafe(F.col("__l")) & (F.col("__b") == F.col("__ob")))
            .withColumn(out, ((F.col("__off") + rn - 1) % k).cast("int"))
            .drop("__h", "__b", "__l", "__ob", "__off"))


def exact_split(df: DataFrame, test_size: float = 0.2, seed: int = 42, key: str = "ID",
                out: str = "split") -> DataFrame:
    """Random split with an exact test count, ``ceil(test_size * n)``: the rows of the
    smallest md5(key:seed), told apart by comparing with the last of them."""
    count = math.ceil(Decimal(str(test_size)) * df.count())
    last = nth_smallest(df, count, key, seed)
    return df.withColumn(out, F.when(up_to(last, key, seed), F.lit("test")).otherwise(F.lit("train")))
