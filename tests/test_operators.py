"""Group statistics, medians, running totals, cleaning, splits, kNN, I/O."""
import math
import os
import random
import tempfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelforge.functions.stats import group_median, running_totals
from panelforge.operators import clean, groupstats, split
from panelforge.operators.impute import knn_impute


def test_group_median_exact_with_hot_group(spark):
    rnd = random.Random(7)
    rows = [("hot", rnd.gauss(0, 1)) for _ in range(30001)] + \
           [(f"g{i % 40}", rnd.random()) for i in range(2000)] + [("single", 3.0), (None, 1.0), ("nulls", None)]
    df = spark.createDataFrame(rows, "k string, v double")
    got = {r["k"]: r["v_median"] for r in group_median(df, ["k"], ["v"]).collect()}
    for k in {r[0] for r in rows if r[0] is not None}:
        vals = [v for kk, v in rows if kk == k and v is not None]
        exp = float(np.median(vals)) if vals else None
        assert (got[k] is None and exp is None) or math.isclose(got[k], exp, rel_tol=1e-12), k
    assert None not in got


def test_group_transform_null_key_and_singleton(spark):
    df = spark.createDataFrame([(1, "a", 0, 1.0), (2, "a", 0, 3.0), (3, None, 0, 5.0), (4, "b", 0, 2.0),
                                (5, "a", 0, None)], "ID long, SECTOR string, DATE int, RET_1 double")
    out = {r["ID"]: r for r in groupstats.group_transform(df, ["SECTOR", "DATE"], ["RET_1"], ["median", "std", "mean"]).collect()}
    assert out[1]["RET_1_SECTOR_DATE_median"] == 2.0
    assert out[3]["RET_1_SECTOR_DATE_mean"] is None          # NULL key: no statistic
    assert out[4]["RET_1_SECTOR_DATE_std"] is None           # singleton: std NULL
    assert out[5]["RET_1_SECTOR_DATE_mean"] == 2.0           # NULL value in group skipped


def test_running_totals(spark):
    rows = [(float(i) / 7, i % 3, 1) for i in range(500)]
    df = spark.createDataFrame(rows, "s double, a int, b int")
    got = sorted((r["s"], r["cum_a"], r["cum_b"]) for r in running_totals(df, "s", ["a", "b"], n_buckets=8).collect())
    ca = cb = 0
    for (s, a, b), (gs, ga, gb) in zip(sorted(rows), got):
        ca, cb = ca + a, cb + b
        assert (s, ca, cb) == (gs, ga, gb)


def test_nan_becomes_null(spark):
    df = spark.createDataFrame([(1.0,), (float("nan"),)], "x double")
    assert clean.nan_to_null(df).where(F.col("x").isNull()).count() == 1


def test_inf_columns_and_dedup(spark):
    tr = spark.createDataFrame([(1, 1.0, float("inf"), 0.0, 1)], "ID long, a double, b double, c double, RET int")
    te = spark.createDataFrame([(2, 1.0, 0.0, float("-inf"))], "ID long, a double, b double, c double")
    assert set(clean.inf_columns(tr, te)) == {"b", "c"}
    trf, tef, feats = clean.filter_infinity(tr, te)
    assert trf.columns == ["ID", "a", "RET"] and tef.columns == ["ID", "a"]
    dup = spark.createDataFrame([(1, 2, 3)], "x int, y int, z int").toDF("x", "y", "x")
    out, rep = clean.dedup_columns(dup)
    assert out.columns == ["x", "y"] and rep == ["x"] and out.first()["x"] == 1


def test_sample_exact(spark):
    df = spark.range(100).withColumnRenamed("id", "ID")
    a = [r.ID for r in clean.sample_exact(df, 10).collect()]
    assert len(a) == 10 and a == [r.ID for r in clean.sample_exact(df, 10).collect()]
    with pytest.raises(ValueError):
        clean.sample_exact(df, 101)


def test_label_encode(spark):
    df = spark.createDataFrame([(1, "b"), (2, "a"), (3, "c"), (4, "a")], "ID long, y string")
    out = {r.ID: r.y for r in clean.label_encode(df, "y").collect()}
    assert out == {1: 1, 2: 0, 3: 2, 4: 0}


def test_date_folds_disjoint(spark):
    df = spark.createDataFrame([(i, i % 13) for i in range(400)], "ID long, DATE int")
    f = split.date_folds(df, 4, seed=0)
    assert f.groupBy("DATE").agg(F.countDistinct("fold").alias("n")).where("n > 1").count() == 0
    sizes = sorted(r["n"] for r in f.select("DATE", "fold").distinct().groupBy("fold").agg(F.count("*").alias("n")).collect())
    assert sizes[-1] - sizes[0] <= 1


def test_stratified_folds_balanced(spark):
    df = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(1000)], "ID long, RET int")
    f = split.stratified_folds(df, 10, seed=1)
    counts = f.groupBy("RET", "fold").count().collect()
    for cls in (0, 1):
        c = [r["count"] for r in counts if r["RET"] == cls]
        assert len(c) == 10 and max(c) - min(c) <= 1


def _knn_brute(x, k=5):
    n, d = x.shape
    out = x.copy()
    mask = ~np.isnan(x)
    means = np.nanmean(x, axis=0)
    for i in range(n):
        for j in range(d):
            if mask[i, j]:
                continue
            cands = []
            for r in range(n):
                if not mask[r, j]:
                    continue
                common = mask[i] & mask[r]
                if common.sum() == 0:
                    continue
                ss = 0.0
                for c in range(d):
                    if common[c]:
                        ss += (x[i, c] - x[r, c]) ** 2
                cands.append((ss * d / common.sum(), r, x[r, j]))
            cands.sort()
            out[i, j] = np.mean([v for _, _, v in cands[:k]]) if cands else means[j]
    return out


def test_knn_impute_brute_force(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(60, 4))
    x[rng.random((60, 4)) < 0.15] = np.nan
    x[7, :] = np.nan                                  # one row all missing -> column means
    rows = [(i, *[None if np.isnan(v) else float(v) for v in x[i]]) for i in range(60)]
    df = spark.createDataFrame(rows, "ID long, a double, b double, c double, d double")
    got = {r.ID: [r.a, r.b, r.c, r.d] for r in knn_impute(df, ["a", "b", "c", "d"], block_rows=16).collect()}
    exp = _knn_brute(x)
    for i in range(60):
        assert np.allclose(got[i], exp[i], rtol=1e-12, atol=1e-12), (i, got[i], exp[i])


def test_io_roundtrip(spark):
    from panelforge.sources import io
    d = tempfile.mkdtemp(prefix="pf-io-", dir="/tmp")
    p = os.path.join(d, "x.csv")
    with open(p, "w") as fh:
        fh.write("ID,v\n1,0.5\n2,NaN\n")
    df = io.read_any(spark, p, schema=None)
    assert df.count() == 2
    with pytest.raises(ValueError):
        io.read_any(spark, os.path.join(d, "x.xlsx"))
    calls = []

    def compute():
        calls.append(1)
        return spark.range(3)
    a = io.read_or_compute(spark, os.path.join(d, "stage.parquet"), compute)
    b = io.read_or_compute(spark, os.path.join(d, "stage.parquet"), compute)
    assert a.count() == b.count() == 3 and len(calls) == 1


def test_group_median_collapses_ties_of_a_hot_group(spark):
    df = spark.range(200000).selectExpr("'hot' AS k", "CAST(CASE WHEN id % 3 = 0 THEN 1 ELSE 2 END AS double) AS v").unionByName(
        spark.createDataFrame([("even", 1.0), ("even", 4.0), ("nulls", None)], "k string, v double"))
    got = {r["k"]: r["v_median"] for r in group_median(df, ["k"], ["v"]).collect()}
    assert got == {"hot": 2.0, "even": 2.5, "nulls": None}
    plan = group_median(df, ["k"], ["v"])._jdf.queryExecution().executedPlan().toString()
    assert "collect_list" not in plan


def test_null_label_is_a_class_of_its_own_in_folds(spark):
    df = spark.createDataFrame([(1, 1), (2, 0), (3, None), (4, None)], "ID long, RET int")
    assert sorted(r["fold"] for r in split.stratified_folds(df, 2).where("RET IS NULL").collect()) == [0, 1]


def test_exact_split_counts(spark):
    df = spark.range(100).withColumnRenamed("id", "ID")
    parts = split.exact_split(df, 0.2, seed=42)
    assert {r["split"]: r["count"] for r in parts.groupBy("split").count().collect()} == {"test": 20, "train": 80}
    assert sorted(r["ID"] for r in parts.where("split = 'test'").collect()) == sorted(r["ID"] for r in split.exact_split(df.repartition(7), 0.2, seed=42).where("split = 'test'").collect())


def test_metrics_of_one_class(spark):
    from panelforge.operators import metrics
    s = spark.createDataFrame([(1, 1, 0.7), (1, 0, 0.2)], "label int, pred int, proba double")
    assert metrics.roc_auc(s).first()["roc_auc"] is None and metrics.roc_area(s).first()["roc_area"] is None
    none = s.withColumn("label", F.lit(0))
    assert metrics.avg_precision(none).first()["avg_precision"] is None
    cells = {(r["label"], r["pred"]): r["n"] for r in metrics.confusion(s).collect()}
    assert cells == {(0, 0): 0, (0, 1): 0, (1, 0): 1, (1, 1): 1}
    first = metrics.roc_curve(s).orderBy(F.desc("threshold")).first()
    assert first["threshold"] == float("inf") and first["fpr"] == first["tpr"] == 0


def test_target_key_must_be_unique(spark):
    x = spark.createDataFrame([(1, 2.0)], "ID long, a double")
    with pytest.raises(ValueError):
        clean.attach_target(x, spark.createDataFrame([(1, 0), (1, 1)], "ID long, RET int"))


def test_knn_leaves_the_session_as_it_was_and_takes_any_key(spark):
    name = "spark.sql.constraintPropagation.enabled"
    before = spark.conf.get(name, None)
    df = spark.createDataFrame([("a", 1.0, 2.0), ("b", 1.1, 4.0), ("c", 1.05, None)], "ID string, x double, y double")
    got = {r["ID"]: r["y"] for r in knn_impute(df, ["x", "y"], k=2).collect()}
    assert got["c"] == 3.0 and spark.conf.get(name, None) == before


def test_indicator_reads_the_named_series_and_period(spark):
    from panelforge.functions import indicators as ind
    row = {f"RET_{k}": float(k) for k in range(1, 21)} | {f"VOLUME_{k}": float(100 * k) for k in range(1, 21)}
    df = spark.createDataFrame([row])
    out, names = ind.calculate_indicator(df, "SMA", [5], {"data_type": "vol", "timeperiod": 3})
    got = out.first()
    # positions run from the oldest day to the most recent one
    assert math.isclose(got["SMA_10_5"], (1100 + 1200 + 1300) / 3) and "SMA_3_5" in names
    with pytest.raises(ValueError):
        ind.calculate_indicator(df, "SMA", [5], {"data_type": "price"})
