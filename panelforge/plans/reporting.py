"""The reporting flow: metrics of stored predictions.

Nothing here fits a model.  All metrics of all models, or of all folds, come from one
pass over one table of predictions that carries the model or the fold as a column.
"""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import metrics, tuning
from ..schema import MODEL_NAMES
from ..session import materialize
from .science import Science

CV_METRICS = ["accuracy", "precision", "recall"]


def fitted_scores(model: PipelineModel, df: DataFrame, name: str) -> DataFrame:
    return tuning.scores(model, df, name)


def fold_scores(out_of_fold: DataFrame) -> DataFrame:
    """(fold, confusion counts, metrics): every fold from one pass over its predictions."""
    return metrics.metrics_wide(out_of_fold, by=["fold"])


def cv_summary(out_of_fold: DataFrame, names: list[str] | None = None) -> DataFrame:
    """(metric, mean, std) over the folds; the std is that of the population."""
    wide = fold_scores(out_of_fold)
    long = wide.unpivot([], names or CV_METRICS, "metric", "score")
    return long.groupBy("metric").agg(F.avg("score").alias("mean"), F.stddev_pop("score").alias("std"))


def fit_report(flow: Science, folds: int = 10) -> DataFrame:
    """Fit-and-evaluate report of the base tree as (part, item, value): the confusion and
    accuracy on the rows it was fitted on, mean and std of the cross-validated scores,
    and the area under the ROC curve of the out-of-fold scores."""
    own = materialize(fitted_scores(flow.base_tree, flow.train, MODEL_NAMES[0]))
    cells = metrics.confusion(own).select(F.lit("confusion").alias("part"), F.format_string("label %d, predicted %d", "label", "pred").alias("item"),
                                          F.col("n").cast("double").alias("value"))
    accuracy = metrics.binary_metrics(own).select(F.lit("train").alias("part"), F.lit("accuracy").alias("item"), F.col("accuracy").alias("value"))
    held_out = flow.out_of_fold(k=folds)
    cv = cv_summary(held_out)
    cv = cv.select("metric", F.explode(F.create_map(F.lit("mean"), F.col("mean"), F.lit("std"), F.col("std"))).alias("what", "value"))
    cv = cv.select(F.lit("cross-validation").alias("part"), F.concat_ws(" ", "metric", "what").alias("item"), "value")
    roc = metrics.roc_area(held_out).select(F.lit("roc").alias("part"), F.lit("area").alias("item"), F.col("roc_area").alias("value"))
    return cells.unionByName(accuracy).unionByName(cv).unionByName(roc)
