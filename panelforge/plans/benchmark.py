"""The benchmark flow: sector x date mean feature, forest scored on date folds
with the per-date median rule, fold summary, averaged importances, and a fit
on all training rows with the submission for the test rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import groupstats, models, split
from ..operators.tuning import PARTITION_ROWS, in_parallel
from ..schema import BENCH_FEATURES, TARGET
from ..session import materialize
from ..sources.io import stored, write_stage


def date_cv(prepared: DataFrame, n_splits: int = 4, num_trees: int = 500, max_depth: int = 8,
            seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """Per date fold: fit a forest on the other folds, score the fold, turn P(1)
    into the per-date median decision, measure accuracy.  Returns (fold
    accuracies, fold importances).  The folded rows and the scored ones are stored;
    the folds are fitted side by side."""
    rows = prepared.select("DATE", "features", "label")
    parts = max(1, -(-rows.count() // PARTITION_ROWS))
    folded = materialize(split.date_folds(rows, n_splits, seed).repartition(parts, "fold", "DATE"))
    rest = [folded.where(F.col("fold") != k) for k in range(n_splits)]
    fitted = in_parallel([lambda r=r: models.random_forest(num_trees, max_depth, seed).fit(r) for r in rest])
    scored, imps = None, []
    for k, m in enumerate(fitted):
        s = models.score(m, folded.where(F.col("fold") == k)).select("fold", "DATE", "label", "proba")
        scored = s if scored is None else scored.unionByName(s)
        imps += [(k, f, v) for f, v in models.importances(m, BENCH_FEATURES)]
    ruled = groupstats.date_median_decision(materialize(scored), "proba", out="rule")  # a date lies in one fold
    acc = ruled.groupBy("fold").agg(F.count(F.lit(1)).alias("n_rows"),
                                    F.avg((F.col("rule") == F.col("label")).cast("double")).alias("accuracy"))
    return acc, prepared.sparkSession.createDataFrame(imps, "fold int, feature string, importance double")


def stored_date_cv(spark: SparkSession, prepared: Callable[[], DataFrame], folder: str) -> tuple[DataFrame, DataFrame]:
    """``date_cv`` with its two results kept in ``folder``: the forests are fitted once for both."""
    names = [f"{folder}/fold_accuracy", f"{folder}/fold_importance"]
    if not all(stored(spark, n) for n in names):
        for df, name in zip(date_cv(prepared()), names):
            write_stage(df.coalesce(1), name)
    return tuple(spark.read.parquet(n) for n in names)


def submission(train: DataFrame, test: DataFrame, num_trees: int = 500, max_depth: int = 8, seed: int = 0) -> DataFrame:
    """Fit on all prepared training rows, stored first, decide per date on the test rows."""
    final = models.random_forest(num_trees, max_depth, seed).fit(materialize(train.select("features", "label")))
    return groupstats.date_median_decision(models.score(final, test), "proba", out=TARGET).select("ID", TARGET)
