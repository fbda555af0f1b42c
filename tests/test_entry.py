"""Driver contract and a sample of oracle comparisons on the smallest scale."""
import pytest

import __spark_entry__ as E
from oracle_harness import compare, duck

SF = "/root/testdata/sf0.001"


def test_entry_runs(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) == 4 and set(df.columns) == {"fold", "n_rows", "accuracy"}


def test_oracles_cover_queries():
    q, o = E.queries(), E.oracle_sql()
    assert set(o) <= set(q)
    assert len(o) >= 50


@pytest.mark.parametrize("name", ["lag_matrix", "group_stats", "benchmark_rule", "ind_ema", "ind_rsi",
                                  "roc_auc", "roc_curve", "roc_area", "confusion", "metrics_long", "knn_impute", "stratified_folds",
                                  "exact_split", "panel", "inf_columns", "attach_target", "sample_exact"])
def test_oracle_small(spark, name):
    assert compare(E.queries()[name](spark, SF), duck(SF, E.oracle_sql()[name])) == []


def test_model_input_has_120_features(spark):
    from panelforge.plans.processing import model_input
    from pyspark.sql import functions as F
    panel = E.queries()["panel"](spark, "/root/testdata/sf0.01")
    tr, te, feats = model_input(panel.where(F.col("DATE") % 2 == 0), panel.where(F.col("DATE") % 2 == 1).drop("RET"),
                                impute=False)
    assert len(feats) == 120 and "RET" in tr.columns and "RET" not in feats
    row = tr.agg(F.count(F.lit(1)).alias("n"), *[F.count(c).alias(c) for c in feats]).first()
    assert row["n"] > 1000 and all(row[c] == row["n"] for c in feats)  # rows with gaps are dropped
