"""Classification metrics as aggregates over a scores table (label, pred, proba).

Count-based metrics come from one pass of conditional sums.  Ranking metrics
(ROC AUC, ROC curve, average precision) group rows by score first, then take
exact running totals over the distinct scores (``running_totals``), so no
task holds more than one range bucket of scores.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.stats import running_totals
from ..schema import BENCHMARK_ACCURACY
from ..session import materialize

# Machine epsilon of float64, the clip used for log loss.
LOG_LOSS_EPS = 2.220446049250313e-16


def _ratio(num: Column, den: Column) -> Column:
    """num / den, 0 when the divisor is 0."""
    return F.coalesce(num / F.nullif(den, F.lit(0)), F.lit(0.0))


def _counts(scores: DataFrame, label: str, pred: str) -> DataFrame:
    y, p = F.col(label), F.col(pred)
    return scores.agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(((y == 1) & (p == 1)).cast("long")).alias("tp"),
        F.sum(((y == 0) & (p == 1)).cast("long")).alias("fp"),
        F.sum(((y == 1) & (p == 0)).cast("long")).alias("fn"),
        F.sum(((y == 0) & (p == 0)).cast("long")).alias("tn"),
    )


def confusion(scores: DataFrame, label: str = "label", pred: str = "pred") -> DataFrame:
    """The four cells (label, pred, n); a cell without rows counts 0."""
    c = _counts(scores, label, pred)
    cells = [F.struct(F.lit(y).cast("int").alias(label), F.lit(p).cast("int").alias(pred), F.coalesce(F.col(k), F.lit(0)).alias("n"))
             for y, p, k in ((0, 0, "tn"), (0, 1, "fp"), (1, 0, "fn"), (1, 1, "tp"))]
    return c.select(F.explode(F.array(*cells)).alias("cell")).select("cell.*")


def _binary_exprs():
    tp, fp, fn, tn, n = (F.col(c).cast("double") for c in ("tp", "fp", "fn", "tn", "n"))
    recall = _ratio(tp, tp + fn)
    spec = _ratio(tn, tn + fp)
    return {
        "accuracy": _ratio(tp + tn, n),
        "balanced_accuracy": (recall + spec) / 2,
        "precision": _ratio(tp, tp + fp),
        "recall": recall,
        "f1": _ratio(2 * tp, 2 * tp + fp + fn),
    }


def binary_metrics(scores: DataFrame, label: str = "label", pred: str = "pred") -> DataFrame:
    """accuracy, balanced accuracy, precision, recall, F1 for class 1."""
    return _counts(scores, label, pred).select(*[e.alias(k) for k, e in _binary_exprs().items()])


def class_metrics(scores: DataFrame, label: str = "label", pred: str = "pred") -> DataFrame:
    """Per-class precision / recall / F1 / support for classes present in the
    labels, plus macro and weighted averages (a classification report)."""
    c = _counts(scores, label, pred)
    tp, fp, fn, tn = (F.col(x).cast("double") for x in ("tp", "fp", "fn", "tn"))

    def row(cls, tp_, fp_, fn_, support):
        return F.struct(F.lit(cls).alias("class"), _ratio(tp_, tp_ + fp_).alias("precision"),
                        _ratio(tp_, tp_ + fn_).alias("recall"),
                        _ratio(2 * tp_, 2 * tp_ + fp_ + fn_).alias("f1"),
                        support.cast("long").alias("support"))

    per = c.select(F.explode(F.array(row("0", tn, fn, fp, tn + fp), row("1", tp, fp, fn, tp + fn))).alias("r")) \
        .select("r.*").where(F.col("support") > 0)
    avg = per.agg(
        F.avg("precision").alias("mp"), F.avg("recall").alias("mr"), F.avg("f1").alias("mf"),
        (F.sum(F.col("precision") * F.col("support")) / F.sum("support")).alias("wp"),
        (F.sum(F.col("recall") * F.col("support")) / F.sum("support")).alias("wr"),
        (F.sum(F.col("f1") * F.col("support")) / F.sum("support")).alias("wf"),
        F.sum("support").alias("s"))
    avgs = avg.select(F.explode(F.array(
        F.struct(F.lit("macro avg").alias("class"), F.col("mp").alias("precision"),
                 F.col("mr").alias("recall"), F.col("mf").alias("f1"), F.col("s").alias("support")),
        F.struct(F.lit("weighted avg").alias("class"), F.col("wp").alias("precision"),
                 F.col("wr").alias("recall"), F.col("wf").alias("f1"), F.col("s").alias("support")),
    )).alias("r")).select("r.*")
    return per.unionByName(avgs)


def _grouped(scores: DataFrame, label: str, proba: str) -> DataFrame:
    return materialize(scores.groupBy(F.col(proba).alias("score")).agg(
        F.sum((F.col(label) == 1).cast("long")).alias("pos"),
        F.sum((F.col(label) == 0).cast("long")).alias("neg")))


def roc_auc(scores: DataFrame, label: str = "label", proba: str = "proba") -> DataFrame:
    """Mann-Whitney AUC with ties counted half, over grouped scores; NULL if only one class is present."""
    g = running_totals(_grouped(scores, label, proba), "score", ["neg"])
    return g.agg(
        (F.sum(F.col("pos") * (F.col("cum_neg") - F.col("neg") + F.col("neg") / 2.0))
         / F.nullif(F.sum("pos").cast("double") * F.sum("neg"), F.lit(0.0))).alias("roc_auc"))


def roc_curve(scores: DataFrame, label: str = "label", proba: str = "proba") -> DataFrame:
    """The origin (threshold infinity) and one point per distinct score, thresholds
    descending: (threshold, fps, tps, fpr, tpr)."""
    g = running_totals(_grouped(scores, label, proba), "score", ["pos", "neg"],
                       descending=True, totals=True)
    points = g.select(
        F.col("score").cast("double").alias("threshold"), F.col("cum_neg").alias("fps"), F.col("cum_pos").alias("tps"),
        _ratio(F.col("cum_neg").cast("double"), F.col("tot_neg")).alias("fpr"),
        _ratio(F.col("cum_pos").cast("double"), F.col("tot_pos")).alias("tpr"))
    zero = [F.lit(0).cast("long").alias(c) for c in ("fps", "tps")] + [F.lit(0.0).alias(c) for c in ("fpr", "tpr")]
    return points.unionByName(scores.sparkSession.range(1).select(F.lit(float("inf")).alias("threshold"), *zero))


def roc_area(scores: DataFrame, label: str = "label", proba: str = "proba") -> DataFrame:
    """Area under the curve by trapezoids, a term for each distinct score."""
    g = running_totals(_grouped(scores, label, proba), "score", ["pos", "neg"], descending=True)
    height = F.col("cum_pos") - F.col("pos") / 2.0
    return g.agg((F.sum(F.col("neg") * height) / F.nullif(F.sum("pos").cast("double") * F.sum("neg"), F.lit(0.0))).alias("roc_area"))


def avg_precision(scores: DataFrame, label: str = "label", proba: str = "proba") -> DataFrame:
    """sum_n (R_n - R_{n-1}) P_n over descending distinct thresholds."""
    g = running_totals(_grouped(scores, label, proba), "score", ["pos", "neg"], descending=True)
    return g.agg(
        (F.sum(F.col("pos") * F.col("cum_pos") / (F.col("cum_pos") + F.col("cum_neg")))
         / F.nullif(F.sum("pos"), F.lit(0))).alias("avg_precision"))


def log_loss_brier(scores: DataFrame, label: str = "label", proba: str = "proba") -> DataFrame:
    p = F.least(F.greatest(F.col(proba), F.lit(LOG_LOSS_EPS)), F.lit(1 - LOG_LOSS_EPS))
    y = F.col(label).cast("double")
    return scores.agg(
        F.avg(-(y * F.log(p) + (1 - y) * F.log(1 - p))).alias("log_loss"),
        F.avg(F.pow(F.col(proba) - y, 2)).alias("brier_score"))


def score_stats(scores: DataFrame, label: str = "label", pred: str = "pred",
                proba: str = "proba") -> DataFrame:
    return scores.agg(
        F.avg(F.col(pred).cast("double")).alias("pred_pos_ratio"),
        F.avg(F.col(label).cast("double")).alias("true_pos_ratio"),
        F.stddev_pop(proba).alias("pred_std"))


def benchmark_compare(metrics: DataFrame, benchmark: float = BENCHMARK_ACCURACY,
                      accuracy: str = "accuracy") -> DataFrame:
    a = F.col(accuracy)
    return metrics.withColumns({
        "benchmark_accuracy": F.lit(benchmark),
        "accuracy_vs_benchmark": a - benchmark,
        "accuracy_pct_improvement": (a - benchmark) / benchmark * 100,
        "relative_improvement": a / benchmark - 1,
    })


def grouped_scores(scores: DataFrame, by: Sequence[str], label: str = "label", pred: str = "pred",
                   proba: str = "proba") -> DataFrame:
    """Rows counted by (``by``, score, label, pred): the one pass over the scores that all
    metrics below start from, stored."""
    return materialize(scores.groupBy(*by, F.col(proba).cast("double").alias("score"), F.col(label).cast("int").alias("y"), F.col(pred).cast("int").alias("p"))
                       .agg(F.count(F.lit(1)).alias("k")))


def _count_metrics(grouped: DataFrame, by: Sequence[str], benchmark: float) -> DataFrame:
    y, p, k, s = (F.col(c) for c in ("y", "p", "k", "score"))

    def total(condition: Column) -> Column:
        return F.coalesce(F.sum(F.when(condition, k)), F.lit(0))

    def mean(value: Column) -> Column:
        return F.sum(value * k) / F.nullif(F.sum(F.when(value.isNotNull(), k)), F.lit(0))

    clipped = F.least(F.greatest(s, F.lit(LOG_LOSS_EPS)), F.lit(1 - LOG_LOSS_EPS))
    t = y.cast("double")
    wide = grouped.groupBy(*by).agg(
        F.sum(k).alias("n"), total((y == 1) & (p == 1)).alias("tp"), total((y == 0) & (p == 1)).alias("fp"),
        total((y == 1) & (p == 0)).alias("fn"), total((y == 0) & (p == 0)).alias("tn"),
        mean(-(t * F.log(clipped) + (1 - t) * F.log(1 - clipped))).alias("log_loss"), mean(F.pow(s - t, 2)).alias("brier_score"),
        mean(p.cast("double")).alias("pred_pos_ratio"), mean(t).alias("true_pos_ratio"), mean(s).alias("_mean"))
    # The spread of the scores about their mean, not from squares: it may be tiny.
    means = wide.select(*[F.col(c).alias(f"_m_{c}") for c in by], "_mean")
    spread = grouped.join(means, [F.col(c).eqNullSafe(F.col(f"_m_{c}")) for c in by]).groupBy(*by).agg(
        F.sqrt(F.sum(F.pow(s - F.col("_mean"), 2) * k) / F.nullif(F.sum(F.when(s.isNotNull(), k)), F.lit(0))).alias("pred_std"))
    tp, fp, fn, tn = (F.col(c).cast("double") for c in ("tp", "fp", "fn", "tn"))
    parts = {"0": (tn, fn, fp, tn + fp), "1": (tp, fp, fn, tp + fn)}
    per_class = {}
    for cls, (hit, wrong, missed, support) in parts.items():
        for name, value in (("precision", _ratio(hit, hit + wrong)), ("recall", _ratio(hit, hit + missed)), ("f1", _ratio(2 * hit, 2 * hit + wrong + missed))):
            per_class[f"class_{cls}_{name}"] = F.when(support > 0, value)
    wide = _join_by(wide, spread, by).withColumns(_binary_exprs())
    return benchmark_compare(wide.withColumns(per_class), benchmark).drop("_mean")


def _join_by(a: DataFrame, b: DataFrame, by: Sequence[str]) -> DataFrame:
    """Joined on ``by``, NULL being a value like any other."""
    renamed = b.select(*[F.col(c).alias(f"_j_{c}") for c in by], *[c for c in b.columns if c not in by])
    return a.join(renamed, [F.col(c).eqNullSafe(F.col(f"_j_{c}")) for c in by], "left").drop(*[f"_j_{c}" for c in by])


def _rank_metrics(grouped: DataFrame, by: Sequence[str]) -> DataFrame:
    by_score = materialize(grouped.groupBy(*by, "score").agg(
        F.coalesce(F.sum(F.when(F.col("y") == 1, F.col("k"))), F.lit(0)).alias("pos"), F.coalesce(F.sum(F.when(F.col("y") == 0, F.col("k"))), F.lit(0)).alias("neg")))
    g = running_totals(by_score, "score", ["pos", "neg"], descending=True, totals=True, by=by)
    # A positive beats the negatives below it (half of the tied ones).
    below = F.col("tot_neg") - F.col("cum_neg") + F.col("neg") / 2.0
    return g.groupBy(*by).agg(
        (F.sum(F.col("pos") * below) / F.nullif(F.sum("pos").cast("double") * F.sum("neg"), F.lit(0.0))).alias("roc_auc"),
        (F.sum(F.col("pos") * F.col("cum_pos") / (F.col("cum_pos") + F.col("cum_neg"))) / F.nullif(F.sum("pos"), F.lit(0))).alias("avg_precision"))


def metrics_wide(scores: DataFrame, by: Sequence[str] = ("Model",), label: str = "label", pred: str = "pred",
                 proba: str = "proba", benchmark: float = BENCHMARK_ACCURACY) -> DataFrame:
    """All metrics and the four confusion counts, one row for each combination of ``by``
    (models, folds, ...), from one pass over the scores.  A metric of a class without
    rows is NULL, as are ``roc_auc`` and ``avg_precision`` without both classes."""
    by = list(by)
    grouped = grouped_scores(scores, by, label, pred, proba)
    return _join_by(_count_metrics(grouped, by, benchmark), _rank_metrics(grouped, by), by)


def metrics_long(scores: DataFrame, by: Sequence[str] = ("Model",), **names) -> DataFrame:
    """``metrics_wide`` as rows (*by, Statistic, value); classes without rows have none."""
    by = list(by)
    wide = metrics_wide(scores, by, **names)
    cols = [c for c in wide.columns if c not in (*by, "n", "tp", "fp", "fn", "tn")]
    long = wide.select(*by, *[F.col(c).cast("double") for c in cols]).unpivot(by, cols, "Statistic", "value")
    return long.where(~F.col("Statistic").startswith("class_") | F.col("value").isNotNull())


def metrics_map(long: DataFrame) -> DataFrame:
    """Flattened ``model.metric -> value`` map in one row."""
    return long.agg(F.map_from_entries(F.collect_list(F.struct(
        F.concat_ws(".", "Model", "Statistic"), F.col("value")))).alias("metrics"))
