"""Assemble, project, filter and clean panel frames.

Column-set decisions that depend on values (infinite values, all-NULL columns)
are one aggregate action over all candidate columns, then a ``select``.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.moments import correlations
from ..functions.selection import nth_smallest, up_to
from ..schema import ID_COLS, MOSTLY_MISSING, PRUNE_KEEP_PREFIXES, PRUNE_NAME_PATTERN, TARGET, ret_cols

NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, NUMERIC)]


def nan_to_null(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """NaN is the reference's missing marker; in Spark it becomes NULL once,
    at ingest, so medians, stddevs and correlations skip it."""
    cols = [f.name for f in df.schema.fields
            if isinstance(f.dataType, (T.FloatType, T.DoubleType)) and (cols is None or f.name in cols)]
    return df.withColumns({c: F.nanvl(F.col(c), F.lit(None).cast("double")) for c in cols}) if cols else df


def attach_target(x: DataFrame, y: DataFrame, key: str = "ID") -> DataFrame:
    """Features + target matched on the row key (never by position); a key that
    stands twice in the target would multiply rows and is an error."""
    assert_unique_key(y, key)
    return x.join(y, key, "inner")


def sample_exact(df: DataFrame, n: int | None, seed: int = 42, key: str = "ID") -> DataFrame:
    """Exactly ``n`` rows without replacement, reproducible: the ``n`` smallest
    ``md5(key:seed)``, taken with a filter up to the n-th one.  ``df`` is read a few
    times to find that, so store it."""
    if n is None:
        return df
    total = df.count()
    if n > total:
        raise ValueError(f"cannot take a sample of {n} rows from {total}")
    return df.where(up_to(nth_smallest(df, n, key, seed), key, seed))


def drop_all_missing(df: DataFrame, n_days: int = 5, prefix: str = "RET") -> DataFrame:
    """Drop rows whose ``RET_1..RET_n_days`` are all missing."""
    return df.dropna(how="all", subset=ret_cols(n_days) if prefix == "RET" else
                     [f"{prefix}_{k}" for k in range(1, n_days + 1)])


def drop_any_missing(df: DataFrame, subset: Sequence[str] | None = None) -> DataFrame:
    return df.dropna(how="any", subset=list(subset) if subset else None)


def label_encode(train: DataFrame, col: str = TARGET, others: Sequence[DataFrame] = ()):
    """Sorted distinct values of ``col`` (fitted on ``train``) -> 0..k-1.

    The code table has one row per class; it is joined back on the value.
    Returns the encoded train frame (and the encoded ``others`` if given)."""
    codes = train.select(col).where(F.col(col).isNotNull()).distinct()
    # one row per class: the unpartitioned window runs over the class list only
    codes = codes.withColumn("__code", F.dense_rank().over(Window.orderBy(col)) - 1)

    def enc(d):
        return d.join(codes, col, "left").withColumn(col, F.col("__code").cast("int")).drop("__code") \
            .select(*d.columns)

    out = enc(train)
    return (out, [enc(o) for o in others]) if others else out


def assert_unique_key(df: DataFrame, key: str = "ID") -> None:
    row = df.agg(F.count(F.lit(1)).alias("n"), F.count_distinct(key).alias("d")).first()
    if row["n"] != row["d"]:
        raise ValueError(f"{key} is not unique: {row['n']} rows, {row['d']} distinct")


def drop_id_cols(df: DataFrame, cols: Sequence[str] = ID_COLS) -> DataFrame:
    return df.drop(*cols)


def prune_names(columns: Sequence[str], pattern: str = PRUNE_NAME_PATTERN,
                keep_prefixes: Sequence[str] = PRUNE_KEEP_PREFIXES) -> list[str]:
    """Names removed by the name rule: pattern found and not a RET/VOLUME column."""
    rx = re.compile(pattern)
    return [c for c in columns if rx.search(str(c)) and not str(c).startswith(tuple(keep_prefixes))]


def prune_by_name(train: DataFrame, test: DataFrame | None = None, target: str = TARGET,
                  pattern: str = PRUNE_NAME_PATTERN):
    """Drop columns by the name rule, decided on ``train`` and applied to both.
    Returns (train, test, features)."""
    drop = prune_names(train.columns, pattern)
    train = train.drop(*drop)
    test = test.drop(*drop) if test is not None else None
    return train, test, [c for c in train.columns if c != target]


def inf_columns(*frames: DataFrame) -> list[str]:
    """Columns holding +inf or -inf in any frame: one aggregate per frame."""
    found: list[str] = []
    for df in frames:
        cols = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.FloatType, T.DoubleType))]
        if not cols:
            continue
        row = df.agg(*[F.max(F.abs(F.col(c)) == float("inf")).alias(f"c{i}") for i, c in enumerate(cols)]).first()
        found += [c for i, c in enumerate(cols) if row[f"c{i}"] and c not in found]
    return found


def filter_infinity(train: DataFrame, test: DataFrame, target: str = TARGET):
    """Drop every column holding +-inf in train or test; keep each frame's
    remaining columns in first-seen order, the target once."""
    bad = set(inf_columns(train, test))
    feats = [c for c in train.columns if c not in bad and c != target]
    feats += [c for c in test.columns if c not in bad and c != target and c not in feats]
    train_out = train.select(*[c for c in feats if c in train.columns],
                             *([target] if target in train.columns else []))
    test_out = test.select(*[c for c in feats if c in test.columns])
    return train_out, test_out, feats


def all_null_columns(df: DataFrame, cols: Sequence[str] | None = None) -> list[str]:
    cols = list(cols) if cols is not None else df.columns
    row = df.agg(*[F.count(c).alias(f"c{i}") for i, c in enumerate(cols)]).first()
    return [c for i, c in enumerate(cols) if row[f"c{i}"] == 0]


def dedup_columns(df: DataFrame) -> tuple[DataFrame, list[str]]:
    """Keep the first of repeated column names; returns the repeated names.
    A repeated name cannot be referenced in Spark, so columns are renamed by
    position first."""
    names = df.columns
    seen, keep, repeated = set(), [], []
    for i, c in enumerate(names):
        if c in seen:
            if c not in repeated:
                repeated.append(c)
        else:
            seen.add(c)
            keep.append(i)
    if not repeated:
        return df, []
    tmp = df.toDF(*[f"__c{i}" for i in range(len(names))])
    return tmp.select(*[F.col(f"__c{i}").alias(names[i]) for i in keep]), repeated


def fill_zero(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    return df.fillna(0, subset=list(cols) if cols else None)


def drop_mostly_missing(df: DataFrame, share: float = MOSTLY_MISSING, keep: Sequence[str] = ()) -> tuple[DataFrame, list[str]]:
    """Drop columns of which more than ``share`` is missing: one aggregate.  Returns
    (frame, dropped names)."""
    cols = [c for c in df.columns if c not in keep]
    row = df.agg(F.count(F.lit(1)).alias("n"), *[F.count(c).alias(f"c{i}") for i, c in enumerate(cols)]).first()
    gone = [c for i, c in enumerate(cols) if row["n"] and (row["n"] - row[f"c{i}"]) > share * row["n"]]
    return df.drop(*gone), gone


def drop_correlated(df: DataFrame, cols: Sequence[str], threshold: float = 0.95) -> tuple[DataFrame, list[str]]:
    """Of each pair of columns with an absolute correlation above ``threshold`` (rows where
    both are present) the later one goes, unless the earlier one has gone already.
    One scan; returns (frame, dropped names)."""
    cols = list(cols)
    close = correlations(df, cols).where(F.abs("corr") > threshold).select("a", "b").collect()  # pairs of columns
    gone: list[str] = []
    for i, j in sorted((r["a"], r["b"]) for r in close):
        if cols[i] not in gone and cols[j] not in gone:
            gone.append(cols[j])
    return df.drop(*gone), gone


def calendar_features(df: DataFrame, date_col: str, prefix: str = "") -> DataFrame:
    """Month, day of the month and day of the week (0 = Monday)."""
    d = F.col(date_col)
    return df.withColumns({f"{prefix}month": F.month(d), f"{prefix}day": F.dayofmonth(d), f"{prefix}dayofweek": F.weekday(d)})


def period_features(df: DataFrame, date_col: str, prefix: str = "") -> DataFrame:
    """Quarter, and whether the day ends its month (1 or 0)."""
    d = F.col(date_col)
    return df.withColumns({f"{prefix}quarter": F.quarter(d), f"{prefix}month_end": (F.to_date(d) == F.last_day(d)).cast("int")})
