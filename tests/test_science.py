"""Searches, stored models, column selection, the science and reporting flows."""
import duckdb
import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.classification import DecisionTreeClassifier, GBTClassifier
from pyspark.sql import functions as F

from panelforge.operators import metrics, models, split, tuning
from panelforge.plans import reporting, science
from panelforge.schema import CLASSIC_STAGES, GB_STAGES, HIST_STAGES, MODEL_NAMES, TREE_GRID
from panelforge.sources.io import stored


def dummy(spark, n=100, seed=42):
    """The model test frame of FIXTURES.md A3."""
    r = np.random.default_rng(seed)
    rows = [(i, *map(float, (r.uniform(100, 200), r.uniform(150, 250), r.uniform(50, 150), r.uniform(100, 200), r.uniform(1e6, 5e6)))) for i in range(n)]
    return spark.createDataFrame([(*x, int(x[1] + x[2] - x[3] + r.normal(0, 40) > 200)) for x in rows],
                                 "ID long, Open double, High double, Low double, Close double, Volume double, RET int")


@pytest.fixture(scope="module")
def flow(spark, tmp_path_factory):
    plan = science.staged({"n_estimators": {"maxIter": [2, 4]}, "tree_params": {"maxDepth": [2, 3], "minInstancesPerNode": [2, 5]},
                           "leaf_params": {"minInfoGain": [0.0, 0.02]}, "max_features": {"maxBins": [8, 16]}},
                          {"maxIter": 4, "stepSize": 0.1, "maxDepth": 2, "minInstancesPerNode": 2, "minInfoGain": 0.0, "maxBins": 16})
    return science.Science(spark, dummy(spark), str(tmp_path_factory.mktemp("flow")), test_size=0.2, seed=42, boost_folds=3, plan=plan, rounds=5, epochs=5)


def test_grids_are_whole():
    assert [len(s) for _, s in science.hist_plan().stages] == [6, 24, 5, 3] and [n for n, _ in science.hist_plan().stages] == GB_STAGES == list(CLASSIC_STAGES)
    assert len(tuning.grid(**TREE_GRID)) == 10 and HIST_STAGES["tree_params"]["maxDepth"] == list(range(5, 16, 2))


def test_split_is_80_20(flow):
    assert (flow.train.count(), flow.test.count()) == (80, 20)
    assert "RET" not in flow.features and flow.features == ["Open", "High", "Low", "Close", "Volume"]
    xs, xt, ys, yt = split.train_test_frames(flow.data, 0.2, seed=42)
    assert [d.count() for d in (xs, xt, ys, yt)] == [80, 20, 80, 20]
    assert "RET" not in xs.columns and "RET" not in xt.columns and ys.columns == ["ID", "RET"]
    assert {r.ID for r in xt.collect()} == {r.ID for r in yt.collect()} == {r.ID for r in flow.test.collect()}


def test_first_rounds_are_the_shorter_model(spark, flow):
    frame = flow.frame
    for extra in ({}, {"subsamplingRate": 0.7, "featureSubsetStrategy": "2"}):
        long = GBTClassifier(maxIter=9, maxDepth=3, seed=3, **extra).fit(frame)
        for rounds in (1, 4, 9):
            short = GBTClassifier(maxIter=rounds, maxDepth=3, seed=3, **extra).fit(frame)
            a, b = ([(r["ID"], r["prediction"], r["probability"].tolist()) for r in m.transform(frame).orderBy("ID").collect()]
                    for m in (tuning.first_rounds(long, rounds), short))
            assert a == b


def test_search_scores_each_setting_on_each_fold(flow):
    folds = tuning.folded(flow.frame, 3)
    make = lambda maxIter, maxDepth: GBTClassifier(maxIter=maxIter, maxDepth=maxDepth, seed=1)
    settings = tuning.grid(maxIter=[1, 3], maxDepth=[1, 2])
    found = tuning.search(make, settings, folds, 3)
    for s, scores in zip(settings, found.scores):
        for k in range(3):
            m = make(**s).fit(folds.where(F.col("fold") != k))
            got = m.transform(folds.where(F.col("fold") == k)).agg(F.avg((F.col("prediction") == F.col("label")).cast("double"))).first()[0]
            assert scores[k] == got
    assert found.best is max(settings, key=lambda s: sum(found.scores[settings.index(s)]))
    assert tuning.search(make, settings, folds, 3, parallelism=1).scores == found.scores


def test_shared_fits_score_like_separate_ones(flow):
    folds = tuning.folded(flow.frame, 2)
    fitted = []

    def make(**params):
        fitted.append(params)
        return GBTClassifier(seed=1, minInstancesPerNode=12, **params)

    settings = tuning.grid(maxDepth=[1, 3, 8, 12], maxIter=[2, 5])
    found = tuning.search(make, settings, folds, 2)
    assert len(fitted) < 8  # the deepest trees stop at their leaves' size
    for s, scores in zip(settings, found.scores):
        for k in range(2):
            m = GBTClassifier(seed=1, minInstancesPerNode=12, **s).fit(folds.where(F.col("fold") != k))
            assert scores[k] == m.transform(folds.where(F.col("fold") == k)).agg(F.avg((F.col("prediction") == F.col("label")).cast("double"))).first()[0]
    fitted.clear()
    again = tuning.search(make, settings[:2], folds, 2, known=lambda s: found.scores[settings.index(s)])
    assert again.scores == found.scores[:2] and not fitted


def test_trees_of_all_depths_share_a_fit(flow, monkeypatch):
    folds = tuning.folded(flow.frame, 2)
    settings = tuning.grid(maxDepth=[1, 2, 4, 6], impurity=["gini", "entropy"])
    want = [[science._tree(**s).fit(folds.where(F.col("fold") != k)).transform(folds.where(F.col("fold") == k))
             .agg(F.avg((F.col("prediction") == F.col("label")).cast("double"))).first()[0] for k in range(2)] for s in settings]
    fitted, fit = [], DecisionTreeClassifier.fit
    monkeypatch.setattr(DecisionTreeClassifier, "fit", lambda self, *rest: fitted.append(self.getMaxDepth()) or fit(self, *rest))
    assert tuning.search(science._tree, settings, folds, 2).scores == want and fitted == [6] * 4
    deep = fit(science._tree(6, "gini"), folds)
    for depth in (0, 1, 3):
        a, b = ([(r["ID"], r["prediction"], r["probability"].tolist()) for r in m.transform(folds).orderBy("ID").collect()]
                for m in (tuning.first_levels(deep, depth), fit(science._tree(depth, "gini"), folds)))
        assert a == b


def test_first_of_equal_settings_wins():
    assert tuning.Search([{"a": 1}, {"a": 2}, {"a": 3}], [[0.5], [0.6], [0.6]]).best == {"a": 2}


def test_tuned_tree_has_model_params_and_results(flow):
    table = flow.tree_search("all", flow.frame)
    assert table.count() == 10 and table.where("best").count() == 1
    best = science.best_of(table)
    assert set(best) == {"maxDepth", "impurity"} and isinstance(best["maxDepth"], int)
    model = flow.tuned_tree()
    assert model.stages[-1].getOrDefault("maxDepth") == best["maxDepth"] and model.stages[-1].getOrDefault("impurity") == best["impurity"]
    assert {r["pred"] for r in models.score(model, flow.data).select("pred").collect()} <= {0, 1}


def test_selection_projects_and_is_kept(spark, flow):
    chosen = flow.selection
    assert chosen.columns and chosen.columns == [c for c, v in chosen.importances if v >= 0.01]
    assert tuning.ColumnSelection.read(chosen.table(spark)) == chosen
    assert abs(sum(v for _, v in chosen.importances) - 1) < 1e-9
    assert chosen.apply(flow.test).columns == ["ID", "RET", *chosen.columns] and chosen.apply(flow.test).count() == 20
    con = duckdb.connect()
    want = con.execute(f"SELECT feature FROM '{flow.folder}/selection/*.parquet' WHERE importance >= 0.01 ORDER BY position").fetchall()
    assert [w[0] for w in want] == chosen.columns
    again = science.best_of(flow.tree_search("selected", flow.frame_selected))
    assert flow.tuned_tree("selected").stages[0].getInputCols() == chosen.columns and set(again) == {"maxDepth", "impurity"}


def test_staged_search_carries_the_best_and_keeps_winners(spark, flow):
    tables = flow.boosting_search()
    assert list(tables) == GB_STAGES and science.stage_tables(tables).count() == 10
    before = {}
    for stage, table in tables.items():
        tried = [r["params"] for r in table.collect()]
        assert all({k: str(v) for k, v in before.items()}.items() <= {k: v for k, v in t.items() if k not in dict(flow.plan.stages)[stage][0]}.items()
                   or set(before) & set(dict(flow.plan.stages)[stage][0]) for t in tried)
        before = science.best_of(table)
        winner = flow.boosting(stage)
        assert isinstance(winner, PipelineModel) and stored(spark, f"{flow.folder}/model_hist_{stage}/done")
        assert all(winner.stages[-1].getOrDefault(k) == v for k, v in before.items())
    assert set(before) == {"maxIter", "maxDepth", "minInstancesPerNode", "minInfoGain", "maxBins"}


def test_same_seed_same_winner(spark, flow, tmp_path):
    again = science.Science(spark, flow.data.repartition(5), str(tmp_path), test_size=0.2, seed=42, boost_folds=3, plan=flow.plan)
    for stage, table in again.boosting_search().items():
        assert [tuple(r) for r in table.collect()] == [tuple(r) for r in flow.boosting_search()[stage].collect()]


def test_stochastic_search(spark, flow):
    plan = science.staged({"n_estimators": {"maxIter": [2, 3]}, "max_features": {"featureSubsetStrategy": ["1", "2"]}},
                          {"maxIter": 3, "maxDepth": 2, "subsamplingRate": 0.8, "featureSubsetStrategy": "sqrt"})
    tables = flow.boosting_search("classic", plan)
    assert science.stage_tables(tables).count() == 4
    assert flow.boosting("max_features", "classic", plan).stages[-1].getOrDefault("subsamplingRate") == 0.8


def test_all_models_metrics_against_sql(spark, flow):
    predictions = flow.predictions()
    assert {r["Model"]: r["count"] for r in predictions.groupBy("Model").count().collect()} == {m: 20 for m in MODEL_NAMES}
    got = {(r["Model"], r["Statistic"]): r["value"] for r in metrics.metrics_long(predictions).collect()}
    assert len(got) == 7 * 22
    con = duckdb.connect()
    con.execute(f"CREATE VIEW p AS SELECT * FROM '{flow.folder}/predictions/*.parquet'")
    sql = """SELECT Model, avg(CAST(pred = label AS DOUBLE)) AS accuracy, sum(label * pred) / nullif(sum(pred), 0) AS precision, sum(label * pred) / sum(label) AS recall,
      avg((proba - label) * (proba - label)) AS brier_score, stddev_pop(proba) AS pred_std, avg(pred) AS pred_pos_ratio FROM p GROUP BY Model"""
    for row in con.execute(sql).fetchdf().to_dict("records"):
        for name, value in row.items():
            if name != "Model":
                assert got[(row["Model"], name)] == pytest.approx(0 if value != value else value, abs=1e-9), (row["Model"], name)
    auc = """SELECT a.Model, avg(CASE WHEN a.proba > b.proba THEN 1 WHEN a.proba = b.proba THEN 0.5 ELSE 0 END) AS auc
      FROM p a JOIN p b ON a.Model = b.Model AND a.label = 1 AND b.label = 0 GROUP BY a.Model"""
    for model, value in con.execute(auc).fetchall():
        assert got[(model, "roc_auc")] == pytest.approx(value, abs=1e-9)
    flat = metrics.metrics_map(metrics.metrics_long(predictions)).first()["metrics"]
    assert flat["neural_network.accuracy"] == got[("neural_network", "accuracy")] and len(flat) == 7 * 22


def test_models_are_fitted_side_by_side(spark, flow, tmp_path, monkeypatch):
    import shutil
    import threading
    import time
    flow.boosting_search()
    flow.tuned_tree()
    shutil.copytree(flow.folder, tmp_path / "flow", ignore=shutil.ignore_patterns("model_*", "predictions"))
    own = science.Science(spark, flow.data, str(tmp_path / "flow"), test_size=0.2, seed=42, boost_folds=3, plan=flow.plan, rounds=5, epochs=5)
    lock, now, fits, fit = threading.Lock(), [], [], tuning.pipeline

    def slow(estimator, *a):
        with lock:
            now.append(1)
            fits.append(len(now))
        time.sleep(2)
        try:
            return fit(estimator, *a)
        finally:
            with lock:
                now.pop()

    monkeypatch.setattr(tuning, "pipeline", slow)
    found = own.seven_models()
    won = {own.plan.whole(science.best_of(t)) for t in own.boosting_search().values()}
    assert list(found) == MODEL_NAMES and len(fits) == 3 + len(won) and max(fits) == 3 + len(won)


def test_metrics_read_the_scores_once(spark, flow):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    predictions = flow.predictions()
    metrics.metrics_wide(predictions.mapInArrow(count, predictions.schema)).collect()
    assert seen.value == predictions.count()


def test_fold_metrics_and_report(flow):
    oof = flow.out_of_fold(k=4)
    assert oof.count() == 80 and oof.select("ID").distinct().count() == 80
    con = duckdb.connect()
    sql = f"""SELECT fold, avg(CAST(pred = label AS DOUBLE)) a, coalesce(sum(label * pred) / nullif(sum(pred), 0), 0) p, sum(label * pred) / sum(label) r
      FROM '{flow.folder}/oof_base_tree/*.parquet' GROUP BY fold"""
    want = {f: v for f, *v in con.execute(sql).fetchall()}
    got = {r["fold"]: [r["accuracy"], r["precision"], r["recall"]] for r in reporting.fold_scores(oof).collect()}
    assert got.keys() == want.keys() and all(got[f] == pytest.approx(want[f]) for f in want)
    mean = {r["metric"]: (r["mean"], r["std"]) for r in reporting.cv_summary(oof).collect()}
    assert mean["accuracy"] == pytest.approx((np.mean([v[0] for v in want.values()]), np.std([v[0] for v in want.values()])))
    parts = {r["part"] for r in reporting.fit_report(flow, 4).collect()}
    assert parts == {"confusion", "train", "cross-validation", "roc"}


def test_out_of_fold_takes_any_model(flow):
    oof = flow.out_of_fold("gb", lambda: models.gradient_boosting(3), 3)
    assert oof.count() == 80 and {r["fold"] for r in oof.select("fold").distinct().collect()} == {0, 1, 2}


def test_no_rows_is_told(spark, tmp_path):
    with pytest.raises(ValueError, match="no training rows"):
        science.Science(spark, dummy(spark).limit(0), str(tmp_path)).base_tree
