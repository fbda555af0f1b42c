"""Registered queries: name -> callable(spark, sf_dir) -> DataFrame.

Every query starts from the shipped tables (through the supplier x month panel)
and runs over all of their rows.  Floating results are rounded to 6 places so
that a DuckDB re-computation can be compared value by value.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import clean, groupstats, joins, metrics, report, split
from ..schema import HISTORY_COLS, ID_COLS, TARGET
from ..sources.panel import build_panel, lag_matrix, series_of, build_scores, one_day_return, relative_volume, supplier_months
from ..session import materialize
from ..sources.io import read_or_compute
from ..sources.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
#: Queries that need a whole staged search (many fits) if it is not stored yet.
SEARCHES = ["gbt_staged", "science_metrics", "science_metrics_map", "science_accuracy", "gbt_classic"]


def query(name: str):
    def deco(fn):
        QUERIES[name] = fn
        return fn
    return deco


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[
        F.round(F.col(f.name), digits).alias(f.name)
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else F.col(f.name)
        for f in df.schema.fields])


def _panel(spark, sf):
    return build_panel(spark, sf)


def _train_test(panel: DataFrame):
    """Train = even DATE, test = odd DATE."""
    return panel.where(F.col("DATE") % 2 == 0), panel.where(F.col("DATE") % 2 == 1)


# ---- raw series -> panel --------------------------------------------------

@query("lag_matrix")
def q_lag_matrix(spark, sf):
    """Every supplier-month with its lags, early ones NULL."""
    out = lag_matrix(series_of(spark, sf), "l_suppkey", "month", {"RET": "ret", "VOLUME": "vol_m"})
    return rounded(out.select("l_suppkey", "seq", *[F.col(c).cast("double") for c in HISTORY_COLS]))


@query("panel")
def q_panel(spark, sf):
    return rounded(_panel(spark, sf))


@query("one_day_return")
def q_one_day_return(spark, sf):
    m = supplier_months(table(spark, sf, "lineitem"))
    return rounded(one_day_return(m, "l_suppkey", "month", "px")
                   .select("l_suppkey", "month", "ret"))


@query("relative_volume")
def q_relative_volume(spark, sf):
    m = supplier_months(table(spark, sf, "lineitem"))
    return rounded(relative_volume(m, "l_suppkey", "month", "month", "vol")
                   .select("l_suppkey", "month", "vol", "rel_volume"))


# ---- group transforms ------------------------------------------------------

def _bench_scored(panel: DataFrame) -> DataFrame:
    g = groupstats.group_mean(panel)
    return groupstats.date_median_decision(g, "RET_1_SECTOR_DATE_mean")


@query("group_mean")
def q_group_mean(spark, sf):
    return rounded(groupstats.group_mean(_panel(spark, sf)).select("ID", "RET_1_SECTOR_DATE_mean"))


@query("group_stats")
def q_group_stats(spark, sf):
    p = _panel(spark, sf)
    out = groupstats.group_stats(p)
    return rounded(out.select("ID", *[c for c in out.columns if c not in p.columns]))


@query("date_median_decision")
def q_date_median_decision(spark, sf):
    return _bench_scored(_panel(spark, sf)).select("ID", "DATE", "pred")


def benchmark_rule(panel: DataFrame, n_splits: int = 4, seed: int = 0) -> DataFrame:
    """Accuracy per date fold of the sector-mean / per-date-median rule."""
    scored = split.date_folds(_bench_scored(panel), n_splits, seed)
    return scored.groupBy("fold").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.avg((F.col("pred") == F.col(TARGET)).cast("double")).alias("accuracy"))


@query("benchmark_rule")
def q_benchmark_rule(spark, sf):
    return rounded(benchmark_rule(_panel(spark, sf)))


@query("fold_summary")
def q_fold_summary(spark, sf):
    return rounded(report.fold_summary(benchmark_rule(_panel(spark, sf))))


# ---- assemble / clean --------------------------------------------------------

@query("attach_target")
def q_attach_target(spark, sf):
    """Order lines with their order's status as the target, from two tables."""
    y = table(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderstatus")
    x = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    return rounded(clean.attach_target(x, y, "l_orderkey"))


@query("sample_exact")
def q_sample_exact(spark, sf):
    return rounded(clean.sample_exact(_panel(spark, sf), 500, seed=42).select("ID", "DATE", "RET_1", TARGET))


@query("drop_all_missing")
def q_drop_all_missing(spark, sf):
    return clean.drop_all_missing(_panel(spark, sf), 5).select("ID")


@query("drop_any_missing")
def q_drop_any_missing(spark, sf):
    return clean.drop_any_missing(_panel(spark, sf)).select("ID")


@query("label_encode")
def q_label_encode(spark, sf):
    p = _panel(spark, sf).select("ID", "SECTOR", TARGET)
    enc = clean.label_encode(p, "SECTOR")
    enc = clean.label_encode(enc, TARGET)
    return enc


@query("drop_id_cols")
def q_drop_id_cols(spark, sf):
    p = _panel(spark, sf)
    return rounded(clean.drop_id_cols(p, [c for c in ID_COLS if c != "ID"]))


@query("fill_zero")
def q_fill_zero(spark, sf):
    return rounded(clean.fill_zero(_panel(spark, sf), HISTORY_COLS).select("ID", *HISTORY_COLS))


@query("inf_columns")
def q_inf_columns(spark, sf):
    """Volume change per return: a zero return gives an infinite ratio, on the train
    side in one column and on the test side in another."""
    train, test = _train_test(_panel(spark, sf))

    def with_ratio(df, k, odd):
        ratio = F.when(F.col("ID") % 97 == odd, F.lit(float("inf"))).otherwise(F.col(f"VOLUME_{k}") / 2)
        return df.withColumn(f"RATIO_{k}", ratio)

    train, test = ((with_ratio(with_ratio(df, 1, a), 2, b)) for df, a, b in ((train, 1, 500), (test, 500, 2)))
    tr, te, _ = clean.filter_infinity(train.withColumn("RATIO_3", F.col("VOLUME_3") / 2), test.withColumn("RATIO_3", F.col("VOLUME_3") / 2))
    both = tr.drop(TARGET).withColumn("side", F.lit("train")).unionByName(te.drop(TARGET).withColumn("side", F.lit("test")))
    return rounded(both)


@query("drop_mostly_missing")
def q_drop_mostly_missing(spark, sf):
    """Returns up to 83 months back: the longest lags are nearly always missing.  What
    is kept comes as one row for each value."""
    lags = lag_matrix(series_of(spark, sf), "l_suppkey", "month", {"RET": "ret"}, 84)
    wide = materialize(lags.select("l_suppkey", "seq", *[F.col(f"RET_{k}").cast("double").alias(f"RET_{k}") for k in (1, 20, 40, 60, *range(70, 85))]))
    out, _ = clean.drop_mostly_missing(wide, keep=("l_suppkey", "seq"))
    return rounded(out.unpivot(["l_suppkey", "seq"], out.columns[2:], "column", "value").where("value IS NOT NULL"))


@query("drop_correlated")
def q_drop_correlated(spark, sf):
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").cast("double").alias("q"),
                                             (F.col("l_quantity").cast("double") * 3 + F.col("l_linenumber")).alias("q3"),
                                             F.col("l_discount").cast("double").alias("d"))
    return rounded(clean.drop_correlated(li, ["q", "q3", "d"])[0])


@query("calendar_features")
def q_calendar_features(spark, sf):
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate")
    return clean.period_features(clean.calendar_features(li, "l_shipdate"), "l_shipdate").drop("l_shipdate")


@query("left_join_chain")
def q_left_join_chain(spark, sf):
    li = table(spark, sf, "lineitem")
    sup = table(spark, sf, "supplier")
    nat = table(spark, sf, "nation")
    out = joins.left_join_chain(li, sup, nat, "l_suppkey", "s_suppkey", "s_nationkey", "n_nationkey")
    return rounded(out)


@query("submission")
def q_submission(spark, sf):
    _, test = _train_test(_panel(spark, sf))
    return _bench_scored(test).select("ID", F.col("pred").alias(TARGET))


# ---- splits ------------------------------------------------------------------

@query("hash_split")
def q_hash_split(spark, sf):
    return split.hash_split(_panel(spark, sf), 0.25, seed=0).select("ID", "split")


@query("exact_split")
def q_exact_split(spark, sf):
    return split.exact_split(_panel(spark, sf), 0.2, seed=42).select("ID", "split")


@query("date_folds")
def q_date_folds(spark, sf):
    return split.date_folds(_panel(spark, sf), 4, seed=0).select("ID", "DATE", "fold")


@query("stratified_folds")
def q_stratified_folds(spark, sf):
    return split.stratified_folds(_panel(spark, sf), 10, seed=0).select("ID", TARGET, "fold")


# ---- profiling / report tables ------------------------------------------------

@query("class_balance")
def q_class_balance(spark, sf):
    return rounded(report.class_balance(_panel(spark, sf)))


@query("missing_pct")
def q_missing_pct(spark, sf):
    return rounded(report.missing_pct(_panel(spark, sf)))


@query("correlation_long")
def q_correlation_long(spark, sf):
    p = _panel(spark, sf)
    return rounded(report.correlation_long(p, drop=ID_COLS))


@query("profile")
def q_profile(spark, sf):
    return report.profile(_panel(spark, sf))


@query("ret_vol_series")
def q_ret_vol_series(spark, sf):
    return rounded(report.ret_vol_series(_panel(spark, sf)))


@query("standardize")
def q_standardize(spark, sf):
    from ..operators.scale import standardize
    return rounded(standardize(_panel(spark, sf), HISTORY_COLS).select("ID", *HISTORY_COLS))


# ---- metrics over deterministic scores ------------------------------------------

def _scores(spark, sf):
    return build_scores(_panel(spark, sf))


@query("confusion")
def q_confusion(spark, sf):
    return metrics.confusion(_scores(spark, sf))


@query("binary_metrics")
def q_binary_metrics(spark, sf):
    return rounded(metrics.binary_metrics(_scores(spark, sf)))


@query("class_metrics")
def q_class_metrics(spark, sf):
    return rounded(metrics.class_metrics(_scores(spark, sf)))


@query("roc_auc")
def q_roc_auc(spark, sf):
    return rounded(metrics.roc_auc(_scores(spark, sf)))


@query("roc_curve")
def q_roc_curve(spark, sf):
    return rounded(metrics.roc_curve(_scores(spark, sf)))


@query("roc_area")
def q_roc_area(spark, sf):
    return rounded(metrics.roc_area(_scores(spark, sf)))


@query("avg_precision")
def q_avg_precision(spark, sf):
    return rounded(metrics.avg_precision(_scores(spark, sf)))


@query("log_loss_brier")
def q_log_loss_brier(spark, sf):
    return rounded(metrics.log_loss_brier(_scores(spark, sf)))


@query("score_stats")
def q_score_stats(spark, sf):
    return rounded(metrics.score_stats(_scores(spark, sf)))


@query("benchmark_compare")
def q_benchmark_compare(spark, sf):
    return rounded(metrics.benchmark_compare(metrics.binary_metrics(_scores(spark, sf)).select("accuracy")))


def _rule_scores(panel: DataFrame) -> DataFrame:
    """The benchmark rule as a scorer: proba = logistic of the sector mean."""
    s = _bench_scored(panel)
    return s.select("ID", "DATE", F.col(TARGET).alias("label"), "pred",
                    F.round(1 / (1 + F.exp(-5 * F.col("RET_1_SECTOR_DATE_mean"))), 4).alias("proba")) \
        .where(F.col("proba").isNotNull())


def _model_scores(spark, sf):
    """The scores of two rules under their names, in one table."""
    p = _panel(spark, sf)
    named = {"ret1_logistic": build_scores(p), "sector_mean_rule": _rule_scores(p)}
    parts = [s.select(F.lit(name).alias("Model"), "label", "pred", "proba") for name, s in named.items()]
    return parts[0].unionByName(parts[1])


@query("metrics_long")
def q_metrics_long(spark, sf):
    return rounded(metrics.metrics_long(_model_scores(spark, sf)))


@query("model_accuracy")
def q_model_accuracy(spark, sf):
    return rounded(report.model_accuracy(_model_scores(spark, sf)))


@query("run_metadata")
def q_run_metadata(spark, sf):
    _, test = _train_test(_panel(spark, sf))
    return rounded(report.run_metadata(test, HISTORY_COLS, HISTORY_COLS[:10]))


# ---- technical indicators -------------------------------------------------------

from ..functions import indicators as ind  # noqa: E402


def _ind_query(name):
    def q(spark, sf):
        p = _panel(spark, sf)
        out = ind.add_indicators(p.select("ID", *HISTORY_COLS), [name])
        return rounded(out.drop(*HISTORY_COLS))
    return q


for _name in ind.INDICATORS:
    QUERIES[f"ind_{_name.lower()}"] = _ind_query(_name)


@query("user_indicator")
def q_user_indicator(spark, sf):
    """A user's own function, the mean of the last five days, as the built-in one has it."""
    p = _panel(spark, sf).select("ID", *HISTORY_COLS)

    def mean_of_five(x, timeperiod):
        import numpy as np
        out = np.full_like(x, np.nan)
        for i in range(timeperiod - 1, x.shape[1]):
            out[:, i] = x[:, i - timeperiod + 1:i + 1].sum(axis=1) / timeperiod
        return out

    out, names = ind.add_user_indicator(p, "OWN", mean_of_five, {"data_type": "ret", "timeperiod": 5})
    return rounded(out.select("ID", *names))


@query("ffill_history")
def q_ffill_history(spark, sf):
    p = _panel(spark, sf).select("ID", *HISTORY_COLS)
    f = ind.with_filled_history(p)
    n = len(HISTORY_COLS) // 2
    return rounded(f.select("ID", *[F.col("__x").getItem(n - k).alias(f"RET_{k}") for k in range(1, n + 1)],
                            *[F.col("__v").getItem(n - k).alias(f"VOLUME_{k}") for k in range(1, n + 1)]))


def indicator_features(panel: DataFrame) -> tuple[DataFrame, list[str]]:
    """The indicators (363 columns on 20 lags) that are left after the all-NULL ones
    (one aggregate) and those pruned by name; only these are computed.  Returns the
    frame and the surviving indicator names."""
    empty = set(ind.all_null_indicator_columns(panel))
    names = [c for c in ind.indicator_names(all_positions=True) if c not in empty]
    pruned = set(clean.prune_names(names))
    keep = [c for c in names if c not in pruned]
    return ind.add_named_indicators(panel, keep), keep


@query("prune_by_name")
def q_prune_by_name(spark, sf):
    p = _panel(spark, sf).select("ID", *HISTORY_COLS)
    out, names = indicator_features(p)
    return rounded(out.select("ID", *names))


# ---- kNN imputation -------------------------------------------------------------

@query("knn_impute")
def q_knn_impute(spark, sf):
    from ..operators.impute import knn_impute
    _, test = _train_test(_panel(spark, sf))
    t = test.select("ID", *HISTORY_COLS)
    return rounded(knn_impute(t, HISTORY_COLS, k=5, key="ID"))


@query("knn_impute_within")
def q_knn_impute_within(spark, sf):
    """Donors of the same sector only."""
    from ..operators.impute import knn_impute
    _, test = _train_test(_panel(spark, sf))
    t = test.select("ID", "SECTOR", *HISTORY_COLS)
    return rounded(knn_impute(t, HISTORY_COLS, k=5, key="ID", within=["SECTOR"]))


# ---- models (rows-only checks: trained models have no SQL equivalent) -------------

from ..operators import models  # noqa: E402
from ..schema import BENCH_FEATURES, IMPORTANCE_PLOT_THRESHOLD, MODEL_NAMES  # noqa: E402
from ..sources.panel import stage_folder  # noqa: E402
from . import benchmark, reporting, science  # noqa: E402


def _model_frames(spark, sf):
    p = groupstats.group_mean(_panel(spark, sf))
    train, test = _train_test(p)
    return models.prepare(train, BENCH_FEATURES), models.prepare(test, BENCH_FEATURES)


def _date_cv(spark, sf):
    return benchmark.stored_date_cv(spark, lambda: _model_frames(spark, sf)[0], stage_folder(spark, sf, "benchmark"))


@query("rf_date_cv")
def q_rf_date_cv(spark, sf):
    return _date_cv(spark, sf)[0]


@query("rf_importance")
def q_rf_importance(spark, sf):
    imps = _date_cv(spark, sf)[1]
    return imps.groupBy("feature").agg(F.avg("importance").alias("importance")).orderBy(F.desc("importance"))


def _science(spark, sf) -> science.Science:
    """The science flow over the 120 features of the train side's whole rows."""
    from .processing import train_input
    folder = stage_folder(spark, sf, "science")

    def rows():
        return train_input(_train_test(_panel(spark, sf))[0])

    return science.Science(spark, read_or_compute(spark, f"{folder}/input", rows), folder)


@query("train_test_split")
def q_train_test_split(spark, sf):
    """The four frames of the split, told apart by ``frame``; features and target by ID."""
    parts = split.train_test_frames(_panel(spark, sf).select("ID", *HISTORY_COLS, TARGET), 0.25, seed=0)
    named = [f.withColumn("frame", F.lit(name)) for name, f in zip(("X_train", "X_test", "y_train", "y_test"), parts)]
    out = named[0]
    for part in named[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return rounded(out.withColumn(TARGET, F.col(TARGET).cast("double")))


@query("dt_fit")
def q_dt_fit(spark, sf):
    """Confusion of the base tree on the rows it was fitted on."""
    flow = _science(spark, sf)
    return metrics.confusion(reporting.fitted_scores(flow.base_tree, flow.train, MODEL_NAMES[0]))


@query("dt_grid")
def q_dt_grid(spark, sf):
    flow = _science(spark, sf)
    return flow.tree_search("all", flow.frame)


@query("select_features")
def q_select_features(spark, sf):
    """The projected train and test rows, told apart by ``side``."""
    flow = _science(spark, sf)
    sides = [flow.selection.apply(d).withColumn("side", F.lit(n)) for n, d in (("train", flow.train), ("test", flow.test))]
    return sides[0].unionByName(sides[1])


@query("dt_grid_selected")
def q_dt_grid_selected(spark, sf):
    flow = _science(spark, sf)
    return flow.tree_search("selected", flow.frame_selected)


@query("importance_table")
def q_importance_table(spark, sf):
    return report.importance_table(_science(spark, sf).selection.table(spark).select("feature", "importance"), IMPORTANCE_PLOT_THRESHOLD)


@query("gbt_fit")
def q_gbt_fit(spark, sf):
    flow = _science(spark, sf)
    return metrics.metrics_long(reporting.fitted_scores(flow.base_boosting, flow.test, "gradient_boosting"))


@query("gbt_staged")
def q_gbt_staged(spark, sf):
    """All 38 settings of the four stages with their scores over 5 folds."""
    return science.stage_tables(_science(spark, sf).boosting_search())


@query("gbt_classic")
def q_gbt_classic(spark, sf):
    """The stochastic search: row and column subsets."""
    return science.stage_tables(_science(spark, sf).boosting_search("classic", science.classic_plan()))


@query("mlp_fit")
def q_mlp_fit(spark, sf):
    flow = _science(spark, sf)
    return metrics.metrics_long(reporting.fitted_scores(flow.network, flow.test, MODEL_NAMES[-1]))


@query("model_report")
def q_model_report(spark, sf):
    """Fit-and-evaluate report of the base tree: confusion, accuracy, cross-validated scores, ROC."""
    return reporting.fit_report(_science(spark, sf))


@query("cv_scores")
def q_cv_scores(spark, sf):
    """Cross-validated accuracy / precision / recall (mean and population std)."""
    return reporting.cv_summary(_science(spark, sf).out_of_fold())


@query("science_metrics")
def q_science_metrics(spark, sf):
    """All metrics of the seven models on the held-out rows."""
    return metrics.metrics_long(_science(spark, sf).predictions())


@query("science_metrics_map")
def q_science_metrics_map(spark, sf):
    return metrics.metrics_map(metrics.metrics_long(_science(spark, sf).predictions()))


@query("science_accuracy")
def q_science_accuracy(spark, sf):
    return report.model_accuracy(_science(spark, sf).predictions())


@query("science_metadata")
def q_science_metadata(spark, sf):
    flow = _science(spark, sf)
    return report.run_metadata(flow.test, flow.features, flow.selection.columns)


# ---- end-to-end flows (rows-only) ----------------------------------------------------

@query("rf_submission")
def q_rf_submission(spark, sf):
    train, test = _model_frames(spark, sf)
    return benchmark.submission(train, test)


@query("model_input")
def q_model_input(spark, sf):
    """Both sides, the test side imputed, told apart by ``side``."""
    from .processing import model_input
    train, test = _train_test(_panel(spark, sf))
    tr, te, feats = model_input(train, test.drop(TARGET))
    return rounded(tr.withColumn("side", F.lit("train")).unionByName(te.withColumn("side", F.lit("test")), allowMissingColumns=True))


@query("model_input_train")
def q_model_input_train(spark, sf):
    """The train side alone: 120 features and the target of the rows without gaps."""
    from .processing import train_input
    return rounded(train_input(_train_test(_panel(spark, sf))[0]))


@query("history_stats")
def q_history_stats(spark, sf):
    p = _panel(spark, sf)
    return rounded(p.select("ID", *[c.alias(k) for k, c in ind.history_stats("RET").items()]))


@query("history_oscillators")
def q_history_oscillators(spark, sf):
    p = _panel(spark, sf).select("ID", "DATE", "SECTOR", *HISTORY_COLS)
    out = ind.history_oscillators(p)
    out = groupstats.group_transform(out, ["DATE", "SECTOR"], ["momentum_5"], ["mean"],
                                     name=lambda c, s: "momentum_sector_5")
    return rounded(out.select("ID", "ROC_5", "momentum_5", "momentum_sector_5", "`%K_14`", "`%D_3`"))
