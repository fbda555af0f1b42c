"""The science flow: split -> base tree -> tuned tree -> selected columns -> tree tuned
on these -> boosting -> staged boosting search -> network, and the predictions of all
seven models on the held-out rows.

Every stage is stored under one folder: frames and search results as Parquet, models
as ``PipelineModel``s.  A stage that is there is read, so a query pays only for the
stages nobody has run yet, a stopped search goes on after its last whole stage, and
all reports score the very same models.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import models, split, tuning
from ..operators.tuning import ColumnSelection, Search, Staged, grid
from ..schema import (CLASSIC_STAGES, CLASSIC_START, GB_STAGES, HIST_STAGES, HIST_START, IMPORTANCE_THRESHOLD,
                      MODEL_NAMES, TARGET, TREE_GRID)
from ..sources.io import read_or_compute


def staged(stages: dict[str, dict[str, list]], start: dict[str, object], seed: int = 10) -> Staged:
    """A staged search from {stage: {parameter: values}}, each stage over all combinations."""
    return Staged(tuple((name, tuple(grid(**values))) for name, values in stages.items()), tuple(start.items()), seed)


def hist_plan() -> Staged:
    """Rounds, depth x leaf size, regularisation, bins: 38 settings.  MLlib has no l2 term;
    the third stage tunes the least information gain of a split in its place."""
    return staged(HIST_STAGES, HIST_START)


def classic_plan() -> Staged:
    """Stochastic boosting (row and column subsets): rounds, depth, leaf size, columns a
    node looks at.  MLlib has no least size of a split node, so that axis is left out."""
    return staged(CLASSIC_STAGES, CLASSIC_START)


@dataclass
class Science:
    """The flow over ``data`` (ID, features, target; no missing values) with its stages in ``folder``."""
    spark: SparkSession
    data: DataFrame
    folder: str
    test_size: float = 0.25
    seed: int = 0
    tree_folds: int = 2
    boost_folds: int = 5
    threshold: float = IMPORTANCE_THRESHOLD
    plan: Staged | None = None
    rounds: int = 100
    epochs: int = 10

    # -- frames ---------------------------------------------------------------

    def _stored(self, name: str, compute) -> DataFrame:
        return read_or_compute(self.spark, f"{self.folder}/{name}", compute)

    @cached_property
    def rows(self) -> DataFrame:
        """All rows with their side of the exact split."""
        return self._stored("rows", lambda: split.exact_split(self.data, self.test_size, self.seed))

    @property
    def train(self) -> DataFrame:
        return self.rows.where("split = 'train'").drop("split")

    @property
    def test(self) -> DataFrame:
        return self.rows.where("split = 'test'").drop("split")

    @property
    def features(self) -> list[str]:
        return [c for c in self.rows.columns if c not in ("ID", TARGET, "split")]

    def _assembled(self, name: str, features: list[str]) -> DataFrame:
        frame = self._stored(f"frame_{name}", lambda: tuning.assembled(self.train, features))
        if frame.isEmpty():
            raise ValueError("no training rows: every row has a missing value")
        return frame

    @cached_property
    def frame(self) -> DataFrame:
        return self._assembled("all", self.features)

    @cached_property
    def frame_selected(self) -> DataFrame:
        return self._assembled("selected", self.selection.columns)

    def _folded(self, name: str, frame: DataFrame, k: int) -> DataFrame:
        return self._stored(f"folds_{name}_{k}", lambda: tuning.folded(frame, k, self.seed))

    # -- models ---------------------------------------------------------------

    def _model(self, name: str, estimator, frame: DataFrame, features: list[str]) -> PipelineModel:
        return tuning.keep_model(f"{self.folder}/model_{name}", lambda: tuning.pipeline(estimator(), frame, features), self.spark)

    def _search(self, name: str, run) -> DataFrame:
        """The table of a search: (setting, params, mean_score, std_score, fold_scores, best)."""
        return self._stored(f"search_{name}", lambda: run().table(self.spark).coalesce(1)).orderBy("setting")

    @cached_property
    def base_tree(self) -> PipelineModel:
        return self._model("base_tree", models.decision_tree, self.frame, self.features)

    def tree_search(self, name: str, frame: DataFrame) -> DataFrame:
        folds = self._folded(name, frame, self.tree_folds)
        return self._search(f"tree_{name}", lambda: tuning.search(_tree, grid(**TREE_GRID), folds, self.tree_folds))

    def tuned_tree(self, name: str = "all") -> PipelineModel:
        """The tree of the best setting, fitted on all training rows."""
        frame, features = (self.frame, self.features) if name == "all" else (self.frame_selected, self.selection.columns)
        best = best_of(self.tree_search(name, frame))
        return self._model(f"tree_{name}", lambda: _tree(**best), frame, features)

    @cached_property
    def selection(self) -> ColumnSelection:
        """The columns the tuned tree finds important, kept with what they were chosen by."""
        table = self._stored("selection", lambda: ColumnSelection.fit(self.tuned_tree(), self.threshold).table(self.spark).coalesce(1))
        return ColumnSelection.read(table)

    @cached_property
    def base_boosting(self) -> PipelineModel:
        return self._model("gb_base", lambda: models.gradient_boosting(self.rounds, min_leaf=20), self.frame_selected, self.selection.columns)

    def boosting_search(self, name: str = "hist", plan: Staged | None = None) -> dict[str, DataFrame]:
        """The table of each stage; a stage that is stored is read."""
        plan = plan or self.plan or hist_plan()
        folds = self._folded("selected", self.frame_selected, self.boost_folds)
        best, out, seen = {}, {}, {}
        for stage, settings in plan.stages:
            tried = [{**best, **s} for s in settings]
            out[stage] = self._search(f"{name}_{stage}", lambda: tuning.boosted_search(
                plan, tried, folds, self.boost_folds, known=lambda s: seen.get(plan.whole(s))))
            seen |= {plan.whole(dict(r["params"])): list(r["fold_scores"]) for r in out[stage].collect()}
            best = best_of(out[stage])
        return out

    def boosting(self, stage: str, name: str = "hist", plan: Staged | None = None) -> PipelineModel:
        """The winner of a stage, fitted on all training rows; settings that won before have their model."""
        plan = plan or self.plan or hist_plan()
        tables = self.boosting_search(name, plan)
        best = best_of(tables[stage])

        def fit() -> PipelineModel:
            for earlier in [s for s in tables if list(tables).index(s) < list(tables).index(stage)]:
                if plan.whole(best_of(tables[earlier])) == plan.whole(best):
                    return self.boosting(earlier, name, plan)
            return tuning.pipeline(plan.make(**best), self.frame_selected, self.selection.columns)

        return tuning.keep_model(f"{self.folder}/model_{name}_{stage}", fit, self.spark)

    @cached_property
    def network(self) -> PipelineModel:
        return self._model("network", lambda: models.mlp(len(self.features), max_iter=self.epochs), self.frame, self.features)

    # -- results ----------------------------------------------------------------

    def seven_models(self) -> dict[str, PipelineModel]:
        """All models; the fits, chains of short jobs, run side by side."""
        plan, tables = self.plan or hist_plan(), self.boosting_search()
        winners: dict[tuple, str] = {}
        for stage in reversed(GB_STAGES):
            winners[plan.whole(best_of(tables[stage]))] = stage  # the first stage that each won
        _ = self.frame  # stored before the fits that share it
        tuning.in_parallel([*(lambda s=s: self.boosting(s) for s in winners.values()), lambda: self.network, lambda: self.base_tree, self.tuned_tree])
        fixed = {MODEL_NAMES[0]: self.base_tree, MODEL_NAMES[1]: self.tuned_tree()}
        return fixed | {f"gb_{stage}": self.boosting(stage) for stage in GB_STAGES} | {MODEL_NAMES[-1]: self.network}

    def predictions(self) -> DataFrame:
        """(Model, ID, label, pred, proba) of all seven models on the held-out rows, stored."""
        def compute() -> DataFrame:
            out = None
            for name, model in self.seven_models().items():
                part = tuning.scores(model, self.test, name)
                out = part if out is None else out.unionByName(part)
            return out

        return self._stored("predictions", compute)

    def out_of_fold(self, name: str = "base_tree", make=models.decision_tree, k: int = 10) -> DataFrame:
        """(fold, ID, label, pred, proba) of a model kind over the training rows, stored."""
        return self._stored(f"oof_{name}", lambda: tuning.out_of_fold(make, self._folded("all", self.frame, k), k))


def _tree(maxDepth: int, impurity: str):
    return models.decision_tree(maxDepth, 1, impurity)


def best_of(table: DataFrame) -> dict[str, object]:
    """The best setting of a stored search, its values as numbers where they are."""
    params = table.where("best").first()["params"]

    def value(text: str):
        for kind in (int, float):
            try:
                return kind(text)
            except ValueError:
                pass
        return text

    # a number of columns is given to MLlib as text
    return {k: v if k == "featureSubsetStrategy" else value(v) for k, v in params.items()}


def stage_tables(tables: dict[str, DataFrame]) -> DataFrame:
    out = None
    for i, (stage, table) in enumerate(tables.items()):
        part = table.select(F.lit(i).alias("step"), F.lit(stage).alias("stage"), *table.columns)
        out = part if out is None else out.unionByName(part)
    return out.orderBy("step", "setting")


__all__ = ["Science", "Search", "hist_plan", "classic_plan", "best_of", "stage_tables"]
