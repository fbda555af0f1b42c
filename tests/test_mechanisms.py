"""Moments, selection by hash, medians of hot groups, kNN bounds, keyed totals, sinks, user indicators."""
import datetime
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelforge.functions import indicators as ind
from panelforge.functions import moments, selection, stats
from panelforge.operators import clean, impute, report
from panelforge.schema import HISTORY_COLS, N_LAGS
from panelforge.sources import io


def frame_of(spark, x):
    rows = [(i, *[None if np.isnan(v) else float(v) for v in row]) for i, row in enumerate(x)]
    return spark.createDataFrame(rows, ", ".join(["ID long", *[f"c{j} double" for j in range(x.shape[1])]]))


# ---- moments -------------------------------------------------------------------

def test_correlations_of_wide_tables_in_one_scan(spark):
    r = np.random.default_rng(1)
    x = r.normal(size=(700, 120)) @ r.normal(size=(120, 120)) + 1e6 * np.arange(120)
    x[r.random(x.shape) < 0.1] = np.nan
    x[:, 7] = 0.1      # does not vary
    x[:, 8] = np.nan   # nothing there
    df = frame_of(spark, x).repartition(6)
    plan = moments.pair_parts(df, df.columns[1:]).schema
    assert plan.names[:2] == ["a", "b"]
    got = {(q["a"], q["b"]): (q["n"], q["corr"]) for q in moments.correlations(df, df.columns[1:]).collect()}
    assert len(got) == 120 * 119 // 2
    for (a, b), (n, corr) in got.items():
        both = ~np.isnan(x[:, a]) & ~np.isnan(x[:, b])
        assert n == both.sum()
        if {a, b} & {7, 8}:
            assert corr is None
        else:
            assert corr == pytest.approx(np.corrcoef(x[both, a], x[both, b])[0, 1], abs=1e-9)


def test_correlations_of_few_rows(spark):
    df = frame_of(spark, np.array([[1.0, 2.0]]))
    assert [tuple(r) for r in report.correlation_long(df, ["c0", "c1"]).collect()] == [("c0", "c1", None)]
    assert [tuple(r) for r in report.correlation_long(df.limit(0), ["c0", "c1"]).collect()] == [("c0", "c1", None)]
    assert report.correlation_long(df, ["c0"]).count() == 0


def test_moments_merge_like_one_batch():
    x = np.random.default_rng(2).normal(size=(50, 4)) * 1e-3 + 1e5
    x[::7, 1] = np.nan
    whole, parts = moments.Moments(4), moments.Moments(4)
    whole.add(x)
    for i in range(0, 50, 9):
        parts.add(x[i:i + 9])
    assert np.allclose(whole.product, parts.product, rtol=1e-6) and (whole.n == parts.n).all()


# ---- selection --------------------------------------------------------------------

@pytest.mark.parametrize("n", [0, 1, 17, 4999, 5000])
def test_exactly_n_rows_of_the_smallest_hash(spark, monkeypatch, n):
    monkeypatch.setattr(selection, "FEW", 3)
    monkeypatch.setattr(selection, "DIGITS", 1)
    df = spark.range(5000, numPartitions=7).withColumnRenamed("id", "ID")
    got = clean.sample_exact(df, n, seed=9)
    import hashlib
    want = sorted(range(5000), key=lambda i: hashlib.md5(f"{i}:9".encode()).hexdigest())[:n]
    assert {r.ID for r in got.collect()} == set(want)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert not any(step in plan for step in ("Sort", "Exchange", "TakeOrdered"))


def test_repeated_key_cannot_be_sampled_apart(spark):
    df = spark.createDataFrame([(1,), (1,), (1,)], "ID long")
    assert clean.sample_exact(df, 3).count() == 3
    with pytest.raises(ValueError, match="not unique"):
        clean.sample_exact(df, 2)


# ---- medians -------------------------------------------------------------------------

def test_median_of_a_hot_group_in_a_narrow_range(spark):
    r = random.Random(3)
    # one date of 6,000 distinct values between 0.5 and 0.5001, others all over the line
    rows = [("hot", 0.5 + i / 6e7) for i in range(6000)] + [(f"d{i % 30}", r.gauss(0, 100)) for i in range(3000)] + [("even", 1.0), ("even", 2.0)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(5)
    for per_range in (200, 50_000):
        got = {q["k"]: q["v_median"] for q in stats.group_median(df, ["k"], ["v"], per_range=per_range).collect()}
        assert got == {k: pytest.approx(float(np.median([v for kk, v in rows if kk == k])), rel=1e-15) for k in {k for k, _ in rows}}


def test_ranges_of_a_hot_group_are_even(spark):
    df = spark.range(6000).select(F.lit("hot").alias("k"), F.lit(0).alias("__c"), (0.5 + F.col("id") / 6e7).alias("__v"), F.lit(1).alias("__n"))
    sizes = df.groupBy("k", "__c").agg(F.count(F.lit(1)).alias("__d"), F.sum("__n").alias("__total"))
    middle = stats._middle_rows(df, ["k", "__c"], sizes, 6000, 200)
    assert middle.count() <= 2 * 250  # one or two ranges of about 200 are ordered, not the group


# ---- kNN ---------------------------------------------------------------------------------

def brute(x, k, groups=None):
    out, means = x.copy(), np.nanmean(x, axis=0)
    for i, j in zip(*np.nonzero(np.isnan(x))):
        near = []
        for d in range(len(x)):
            both = ~np.isnan(x[i]) & ~np.isnan(x[d])
            if not np.isnan(x[d, j]) and both.any() and (groups is None or groups[i] == groups[d]):
                near.append((sum((x[i, c] - x[d, c]) ** 2 for c in range(x.shape[1]) if both[c]) * x.shape[1] / both.sum(), d))
        out[i, j] = np.mean([x[d, j] for _, d in sorted(near)[:k]]) if near else means[j]
    return out


def test_knn_skips_far_blocks_and_stays_exact(spark):
    r = np.random.default_rng(4)
    x = r.normal(size=(500, 5)) * 0.3 + np.repeat(r.normal(size=(20, 5)) * 50, 25, axis=0)
    x[r.random(x.shape) < 0.06] = np.nan
    x[3] = np.nan
    x[100:110] = x[100]  # ties
    out, work = impute.knn_impute_work(frame_of(spark, x).repartition(4), [f"c{j}" for j in range(5)], k=3, block_rows=16)
    got = {q["ID"]: [q[f"c{j}"] for j in range(5)] for q in out.collect()}
    want = brute(x, 3)
    assert all(np.allclose(got[i], want[i], rtol=1e-12, atol=1e-12) for i in range(500))
    assert work.compared < 0.5 * work.possible


def test_knn_many_chunks_and_few_donors(spark, monkeypatch):
    monkeypatch.setattr(impute, "CHUNK", 7)
    monkeypatch.setattr(impute, "DONORS", 11)
    r = np.random.default_rng(5)
    x = np.round(r.normal(size=(90, 3)), 1)
    x[r.random(x.shape) < 0.5] = np.nan
    got = {q["ID"]: [q[f"c{j}"] for j in range(3)] for q in impute.knn_impute(frame_of(spark, x), ["c0", "c1", "c2"], k=5, block_rows=8).collect()}
    want = brute(x, 5)
    assert all(np.allclose(got[i], want[i]) for i in range(90))


def test_knn_within(spark):
    r = np.random.default_rng(6)
    x = r.normal(size=(80, 3))
    x[r.random(x.shape) < 0.2] = np.nan
    df = frame_of(spark, x).withColumn("g", F.col("ID") % 3)
    got = {q["ID"]: [q[f"c{j}"] for j in range(3)] for q in impute.knn_impute(df, ["c0", "c1", "c2"], k=4, block_rows=10, within=["g"]).collect()}
    want = brute(x, 4, [i % 3 for i in range(80)])
    assert all(np.allclose(got[i], want[i]) for i in range(80))


# ---- keyed totals -----------------------------------------------------------------------

def test_running_totals_by_key(spark):
    r = random.Random(7)
    rows = [(k, float(s), r.randint(0, 5)) for k in ("a", "b", None) for s in range(200)]
    got = stats.running_totals(spark.createDataFrame(rows, "k string, s double, v long").repartition(5), "s", ["v"], by=["k"], per_bucket=40, totals=True, descending=True)
    found = {(q["k"], q["s"]): (q["cum_v"], q["tot_v"]) for q in got.collect()}
    for k in ("a", "b", None):
        total = 0
        for _, s, v in sorted((x for x in rows if x[0] == k), key=lambda x: -x[1]):
            total += v
            assert found[(k, s)][0] == total
        assert found[(k, 0.0)][1] == total


# ---- sinks -------------------------------------------------------------------------------------

def test_versions_are_replaced_not_doubled(spark, tmp_path):
    long = spark.createDataFrame([("m", "accuracy", 0.5)], "Model string, Statistic string, value double")
    for fmt in ("parquet", "json"):
        path = str(tmp_path / fmt)
        for run, value in (("r1", 0.5), ("r2", 0.6), ("r2", 0.7)):  # the second run is repeated
            io.write_version(long.withColumn("value", F.lit(value)), path, run, fmt)
        assert [r["value"] for r in io.read_version(spark, path, fmt=fmt, schema=long.schema).collect()] == [0.7]
        assert [tuple(r) for r in io.read_version(spark, path, "r1", fmt, long.schema).collect()] == [("m", "accuracy", 0.5)]
        timed = "2026-12-02T10:00:00"
        io.write_version(long, path, "z" + timed, fmt)
        assert io.read_version(spark, path, fmt=fmt, schema=long.schema).count() == 1
    with pytest.raises(ValueError):
        io.write_version(long, str(tmp_path / "x"), "a/b")
    with pytest.raises(ValueError):
        io.read_version(spark, str(tmp_path / "nothing"))


def test_load_data_write_any_and_submission(spark, tmp_path):
    x = spark.createDataFrame([(i, 3, 4, 1, 1, 1, 1, *[0.5] * 40) for i in range(20)], io.raw_feature_schema())
    x = x.withColumn("RET_2", F.when(F.col("ID") == 3, float("nan")).otherwise(F.col("RET_2")))
    y = spark.createDataFrame([(i, str(i % 2 == 0)) for i in range(20)], io.TARGET_SCHEMA)
    for ext in ("csv", "parquet", "pickle"):
        io.write_any(x, str(tmp_path / f"x.{ext}"))
    io.write_any(y, str(tmp_path / "y.csv"))
    assert io.read_any(spark, str(tmp_path / "x.pickle")).count() == 20
    train, test = io.load_data(spark, str(tmp_path / "x.csv"), str(tmp_path / "y.csv"), x, sample_n=7)
    assert train.count() == test.count() == 7 and train.columns == [*x.columns, "RET"]
    whole, _ = io.load_data(spark, x, y, str(tmp_path / "x.csv"))
    assert whole.count() == 20
    assert io.read_csv(spark, str(tmp_path / "x.csv"), io.raw_feature_schema()).where("RET_2 IS NULL").count() == 1
    with pytest.raises(ValueError):
        io.write_any(x, str(tmp_path / "x.xlsx"))
    io.write_submission(spark.createDataFrame([(1, 0, 0.5)], "ID long, RET int, proba double"), str(tmp_path / "s.csv"))
    back = io.read_csv(spark, str(tmp_path / "s.csv"))
    assert back.columns == ["ID", "RET"] and [tuple(r) for r in back.collect()] == [("1", "0")]


# ---- indicators, cleaning --------------------------------------------------------------------------

def panel(spark, n=30, seed=8):
    r = random.Random(seed)
    rows = [tuple(None if r.random() < 0.2 else r.gauss(0, 1) for _ in range(2 * N_LAGS)) for _ in range(n)]
    rows.append(tuple([None] * (2 * N_LAGS)))
    return spark.createDataFrame([(i, *x) for i, x in enumerate(rows)], "ID long, " + ", ".join(f"{c} double" for c in HISTORY_COLS))


def test_user_function_equals_its_built_in_twin(spark):
    df = panel(spark)

    def mom(x, days):
        out = np.full_like(x, np.nan)
        out[:, days:] = x[:, days:] - x[:, :-days]
        return out

    own, names = ind.add_user_indicator(df, "MOM", mom, {"data_type": "ret", "days": 5})
    built, built_names = ind.calculate_indicator(df, "MOM", ta_args={"data_type": "ret"})
    assert set(names) <= set(built_names) and "MOM_20_2" in names
    a, b = (sorted(map(tuple, d.select("ID", *names).collect())) for d in (own, built))
    assert all((x is None and y is None) or math.isclose(x, y, abs_tol=1e-12) for p, q in zip(a, b) for x, y in zip(p, q))

    def obv(x, v):
        out, have = np.full_like(x, np.nan), ~np.isnan(x) & ~np.isnan(v)
        for i in range(len(x)):
            last = None
            for p in np.flatnonzero(have[i]):
                out[i, p] = v[i, p] if last is None else out[i, last] + np.sign(x[i, p] - x[i, last]) * v[i, p]
                last = p
        return out

    own, names = ind.add_user_indicator(df, "OBV", obv, {"data_type": "both"}, periods=[2])
    a, b = (sorted(map(tuple, d.select("ID", *names).collect())) for d in (own, ind.add_indicators(df, ["OBV"], [2])))
    assert all((x is None and y is None) or math.isclose(x, y, abs_tol=1e-12) for p, q in zip(a, b) for x, y in zip(p, q))
    with pytest.raises(ValueError):
        ind.add_user_indicator(df, "X", mom, {"data_type": "price"})


def test_filled_history_is_the_fold(spark):
    got = panel(spark).select(ind.filled_history("RET").alias("a"), ind.ffill(ind.history("RET")).alias("b")).collect()
    assert all(r["a"] == r["b"] for r in got)


def test_calendar_has_month_day_and_weekday(spark):
    df = spark.createDataFrame([(datetime.date(2024, 2, 29),), (None,)], "d date")
    assert [tuple(r)[1:] for r in clean.calendar_features(df, "d").collect()] == [(2, 29, 3), (None, None, None)]


def test_calendar_query_has_quarter_and_month_end(spark):
    from panelforge.plans.catalog import QUERIES
    days = spark.createDataFrame([(datetime.date(2024, 2, 29),), (datetime.date(2023, 12, 30),), (None,)], "d date")
    assert [tuple(r)[1:] for r in clean.period_features(days, "d").collect()] == [(1, 1), (4, 0), (None, None)]
    assert {"month", "day", "dayofweek", "quarter", "month_end"} <= set(QUERIES["calendar_features"](spark, "/root/testdata/sf0.001").columns)


def test_mostly_missing_is_more_than_95_percent(spark):
    df = spark.range(100).selectExpr("id", "CASE WHEN id < 4 THEN 1 END AS a", "CASE WHEN id < 5 THEN 1 END AS b")
    assert clean.drop_mostly_missing(df, keep=["id"])[1] == ["a"]


def test_dimension_is_broadcast_only_while_small(spark):
    from panelforge.operators.joins import left_join_chain
    facts = spark.createDataFrame([(1, 10), (2, 20), (3, None)], "f long, k long")
    mid, dim = spark.createDataFrame([(10, 7), (20, 8)], "mk long, d long"), spark.createDataFrame([(7, "x")], "dk long, name string")
    for small in (10, 0):
        got = left_join_chain(facts, mid, dim, "k", "mk", "d", "dk", small)
        assert [tuple(r) for r in got.select("f", "name").collect()] == [(1, "x")]
        assert ("broadcast" in got._jdf.queryExecution().logical().toString()) == bool(small)


def test_wide_panel_rows_are_dealt_once(spark):
    """No exchange lies above the window of the lags: the joins come before it or share its key."""
    from panelforge.sources.panel import build_panel
    before = {n: spark.conf.get(n) for n in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        plan = build_panel(spark, "/root/testdata/sf0.001", materialize=False)._jdf.queryExecution().executedPlan().toString().splitlines()
    finally:
        for n, v in before.items():
            spark.conf.set(n, v)
    depth = [len(line) - len(line.lstrip(" :+-|")) for line in plan]
    at = next(i for i, line in enumerate(plan) if "Window" in line and "lag(vol_m" in line)
    above, left = [], depth[at]
    for i in range(at - 1, -1, -1):
        if depth[i] < left:
            above, left = [*above, plan[i]], depth[i]
    assert above and not [line for line in above if "Exchange" in line]


def test_knn_stores_no_row_for_each_pair_of_receiver_and_block(spark, monkeypatch):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 3))
    x[rng.random(x.shape) < 0.2] = np.nan
    sizes, keep = [], impute.materialize

    def counted(df):
        out = keep(df)
        sizes.append(out.count())
        return out

    monkeypatch.setattr(impute, "materialize", counted)
    _, work = impute.knn_impute_work(frame_of(spark, x), ["c0", "c1", "c2"], k=2, block_rows=4)
    assert work.compared > 0 and max(sizes) <= 2 * np.isnan(x).sum() + len(x)


def test_model_input_computes_the_features_of_a_row_once(spark, monkeypatch):
    """No filter on the features stands below the step that computes them."""
    from panelforge.plans import processing
    from panelforge.sources.panel import build_panel

    plans, store = [], processing.materialize

    def seen(df):
        plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return store(df)

    monkeypatch.setattr(processing, "materialize", seen)
    panel = build_panel(spark, "/root/testdata/sf0.01").where("DATE % 2 = 0")
    rows = processing.train_input(panel)
    assert rows.count() and rows.count() == rows.dropna().count()
    kinds = [[node.lower() for node in p.split("\n") if "filter" in node.lower()] for p in plans]
    assert len(plans) == 4 and kinds[0] and not kinds[2], kinds  # train statistics, test statistics, train features, test features
