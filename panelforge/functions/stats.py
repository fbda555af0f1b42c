"""Aggregates that stay distributed when one group holds a large share of rows.

``group_median``  exact, interpolated median per group.  Spark's ``median``
                  merges every distinct value of a group in one task; here values
                  are counted first and only the ranges that hold the middle
                  ranks are ordered.
``running_totals`` exact running sums over a global order, computed per range
                  bucket plus bucket offsets instead of one unpartitioned window.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize


def safe_div(num: Column, den: Column) -> Column:
    """``num / den`` with NULL for a zero divisor (ANSI mode raises otherwise)."""
    return num / F.nullif(den, F.lit(0))


#: Ranges that one hot group is cut into at most.
MOST_RANGES = 1024


def group_median(df: DataFrame, keys: Sequence[str], cols: Sequence[str],
                 names: Sequence[str] | None = None, per_range: int = 50_000,
                 extra_aggs: Sequence[Column] = ()) -> DataFrame:
    """One row per non-NULL key combination with the exact median of each column.

    Equal values of a group collapse into one row with a count (partial
    aggregation), so ties cost nothing; that table is stored.  A (group, column) of up to
    ``per_range`` distinct values is ordered by one window.  The values of a larger one
    are dealt into ranges of its own distribution, as many as its distinct values ask
    for; the counts per range tell which one or two hold the middle ranks, and only
    these are ordered.  No task gathers a hot group, wherever its values lie.
    ``extra_aggs`` (e.g. ``stddev_samp``) are grouped alongside.
    """
    keys, cols = list(keys), list(cols)
    names = list(names) if names is not None else [f"{c}_median" for c in cols]
    not_null_keys = F.lit(True)
    for k in keys:
        not_null_keys = not_null_keys & F.col(k).isNotNull()
    base = df.where(not_null_keys)
    entry = F.explode(F.array(*[F.struct(F.lit(i).alias("__c"), F.col(c).cast("double").alias("__v"))
                                for i, c in enumerate(cols)]))
    values = materialize(base.select(*keys, entry.alias("__e")).select(*keys, "__e.*").where(F.col("__v").isNotNull())
                         .groupBy(*keys, "__c", "__v").agg(F.count(F.lit(1)).alias("__n")))
    group = [*keys, "__c"]
    sizes = values.groupBy(*group).agg(F.count(F.lit(1)).alias("__d"), F.sum("__n").alias("__total"))
    most = sizes.agg(F.max("__d")).first()[0] or 0
    ranked = _middle_rows(values, group, sizes, most, per_range)

    def at(k: str) -> Column:
        return F.max(F.when((F.col("__end") - F.col("__n") <= F.col(k)) & (F.col("__end") > F.col(k)), F.col("__v")))

    found = ranked.groupBy(*group).agg(at("__k1").alias("__lo"), at("__k2").alias("__hi"))
    medians = found.groupBy(*keys).agg(*[
        F.max(F.when(F.col("__c") == i, F.col("__lo") + (F.col("__hi") - F.col("__lo")) * 0.5)).alias(nm)
        for i, nm in enumerate(names)])
    groups = base.groupBy(*keys).agg(*(extra_aggs or [F.count(F.lit(1)).alias("__rows")]))
    extra = [c for c in groups.columns if c not in keys and c != "__rows"]
    return groups.join(medians, keys, "left").select(*keys, *names, *extra)


def _middle_rows(values: DataFrame, group: list[str], sizes: DataFrame, most: int, per_range: int) -> DataFrame:
    """Counted values with their running count ``__end`` and the group's middle ranks
    ``__k1``, ``__k2``: all of a small group, the ranges with a middle rank of a hot one."""
    middle = {"__k1": F.floor((F.col("__total") - 1) / 2), "__k2": F.floor(F.col("__total") / 2)}
    if most <= per_range:
        within = Window.partitionBy(*group).orderBy("__v").rowsBetween(Window.unboundedPreceding, 0)
        whole = Window.partitionBy(*group)
        return (values.withColumn("__total", F.sum("__n").over(whole)).withColumn("__end", F.sum("__n").over(within))
                .withColumns(middle))
    ranges = min(MOST_RANGES, -(-most // per_range) + 1)
    probs = [i / ranges for i in range(1, ranges)]
    hot = sizes.where(F.col("__d") > per_range).select(*group)
    edges = values.join(hot, group, "left_semi").groupBy(*group).agg(F.percentile_approx("__v", probs, 10 * MOST_RANGES).alias("__edges"))
    ranged = values.join(edges, group, "left").withColumn(
        "__r", F.when(F.col("__edges").isNull(), 0).otherwise(F.size(F.filter("__edges", lambda e: e < F.col("__v"))))).drop("__edges")
    ranged = materialize(ranged)
    up_to = Window.partitionBy(*group).orderBy("__r")
    sums = (ranged.groupBy(*group, "__r").agg(F.sum("__n").alias("__s"))
            .withColumn("__before", F.sum("__s").over(up_to) - F.col("__s"))
            .withColumn("__total", F.sum("__s").over(Window.partitionBy(*group))).withColumns(middle))
    held = sums.where((F.col("__before") <= F.col("__k2")) & (F.col("__before") + F.col("__s") > F.col("__k1")))
    inside = Window.partitionBy(*group, "__r").orderBy("__v").rowsBetween(Window.unboundedPreceding, 0)
    return (ranged.join(held.drop("__s", "__total"), [*group, "__r"])
            .withColumn("__end", F.col("__before") + F.sum("__n").over(inside)))


def running_totals(df: DataFrame, order_col: str, sum_cols: Sequence[str],
                   descending: bool = False, n_buckets: int | None = None,
                   prefix: str = "cum_", totals: bool = False, by: Sequence[str] = (),
                   per_bucket: int = 50_000) -> DataFrame:
    """Exact inclusive running sums of ``sum_cols`` in the order of ``order_col``
    within each combination of ``by`` (distinct values expected, e.g. after grouping
    by score; the input is read more than once, so store it if it is dear).

    Rows are range-bucketed on sketch boundaries of their own combination, as many
    as its share of ``per_bucket`` rows a bucket; per-bucket totals give each bucket's
    offset through a window over the buckets, and the running sum inside a bucket is
    a window partitioned by bucket. No task sees more than one bucket's rows.
    ``totals=True`` also adds the totals as ``tot_{col}``.
    """
    sum_cols = list(sum_cols)
    keys = list(by) or ["__all"]
    key = F.col(order_col) if not descending else -F.col(order_col)
    keyed = df.withColumn("__key", key)
    keyed = keyed if by else keyed.withColumn("__all", F.lit(0))
    if n_buckets is None:
        n_buckets = max(1, -(-df.count() // per_bucket))
    if n_buckets > 1:
        probs = [i / n_buckets for i in range(1, n_buckets)]
        edges = keyed.groupBy(*keys).agg(F.percentile_approx(F.col("__key").cast("double"), probs, max(10000, 4 * n_buckets)).alias("__edges"))
        renamed = edges.select(*[F.col(k).alias(f"__e_{k}") for k in keys], "__edges")
        same = [F.col(k).eqNullSafe(F.col(f"__e_{k}")) for k in keys]
        # bucket = number of edges strictly below the key: ranges are contiguous and ordered
        keyed = keyed.join(renamed, same, "left").withColumn("__bucket", F.size(F.filter(
            "__edges", lambda e: e < F.col("__key").cast("double")))).drop("__edges", *[f"__e_{k}" for k in keys])
    else:
        keyed = keyed.withColumn("__bucket", F.lit(0))
    bucket_totals = keyed.groupBy(*keys, "__bucket").agg(*[F.sum(c).alias(f"__t_{c}") for c in sum_cols])
    wb = Window.partitionBy(*keys).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    wall = Window.partitionBy(*keys)
    offsets = bucket_totals.select(*[F.col(k).alias(f"__o_{k}") for k in keys], F.col("__bucket").alias("__ob"), *[
        F.coalesce(F.sum(f"__t_{c}").over(wb), F.lit(0)).alias(f"__off_{c}") for c in sum_cols],
        *[F.sum(f"__t_{c}").over(wall).alias(f"tot_{c}") for c in sum_cols])
    wi = Window.partitionBy(*keys, "__bucket").orderBy("__key").rowsBetween(Window.unboundedPreceding, 0)
    same = [F.col(k).eqNullSafe(F.col(f"__o_{k}")) for k in keys] + [F.col("__bucket") == F.col("__ob")]
    return keyed.join(offsets, same).select(
        *df.columns,
        *[(F.col(f"__off_{c}") + F.sum(c).over(wi)).alias(f"{prefix}{c}") for c in sum_cols],
        *([f"tot_{c}" for c in sum_cols] if totals else []),
    )
