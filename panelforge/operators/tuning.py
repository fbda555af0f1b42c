"""Cross-validated search, stored models and fitted column selection.

A search reads one stored frame with an assembled ``features`` vector, a
``label`` and a ``fold``.  Every (setting, fold) pair is a fit of its own on the
other folds; the fits are data-parallel jobs that run side by side from a bounded
pool of threads, so a small frame keeps the cluster busy and a large one shares it.
Settings that differ in the number of boosting rounds only share one fit a fold:
a boosted model of fewer rounds is the first trees of the longer one.  The staged search
of boosted trees has many short jobs a fit, so its models grow together (``boosting``).

Winners are refitted on the whole frame and kept as ``PipelineModel``s (assembler
and model), so scoring needs the plain columns only and another job can load them.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field, replace
from itertools import product

from pyspark import SparkContext, inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import DecisionTreeClassificationModel, DecisionTreeClassifier, GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import IMPORTANCE_THRESHOLD, TARGET
from ..session import materialize
from ..sources.io import stored
from . import boosting, models
from .split import stratified_folds

#: Rows of a partition of the frame that fits read.
PARTITION_ROWS = 20_000
PARALLELISM = 8

Settings = dict[str, object]


def assembled(df: DataFrame, features: Sequence[str], target: str = TARGET, key: str = "ID") -> DataFrame:
    """(key, features, label), stored in partitions of ``PARTITION_ROWS`` rows by key:
    the fits below read it many times."""
    vector = VectorAssembler(inputCols=list(features), outputCol="features", handleInvalid="error")
    rows = vector.transform(df).select(key, "features", F.col(target).cast("double").alias("label"))
    parts = max(1, -(-df.count() // PARTITION_ROWS))
    return materialize(rows.repartition(parts, key).sortWithinPartitions(key))


def folded(frame: DataFrame, k: int, seed: int = 0, key: str = "ID") -> DataFrame:
    """The assembled frame with a stratified ``fold``, stored."""
    parts = max(1, -(-frame.count() // PARTITION_ROWS))
    return materialize(stratified_folds(frame, k, seed, label="label", key=key).repartition(parts, key).sortWithinPartitions(key))


def in_parallel(jobs: Sequence[Callable[[], object]], parallelism: int = PARALLELISM) -> list:
    """The results of ``jobs`` in their order; a failing job fails the whole."""
    if not jobs:
        return []
    inherit = inheritable_thread_target(SparkSession.getActiveSession())
    with ThreadPoolExecutor(max_workers=max(1, min(parallelism, len(jobs)))) as pool:
        return [f.result() for f in [pool.submit(inherit(job)) for job in jobs]]


def first_rounds(model: GBTClassificationModel, rounds: int) -> GBTClassificationModel:
    """The boosted model as it was after ``rounds`` rounds."""
    if rounds >= model.getNumTrees:
        return model
    sc = SparkContext._active_spark_context
    ml = sc._jvm.org.apache.spark.ml
    trees = sc._gateway.new_array(ml.regression.DecisionTreeRegressionModel, rounds)
    weights = sc._gateway.new_array(sc._jvm.double, rounds)
    for i, (tree, weight) in enumerate(zip(list(model._java_obj.trees())[:rounds], model.treeWeights)):
        trees[i], weights[i] = tree, float(weight)
    return GBTClassificationModel(ml.classification.GBTClassificationModel(f"{model.uid}_{rounds}", trees, weights))


def first_levels(model: DecisionTreeClassificationModel, depth: int) -> DecisionTreeClassificationModel:
    """The tree as it is if it may grow ``depth`` levels only."""
    if depth >= model.depth:
        return model
    ml = SparkContext._active_spark_context._jvm.org.apache.spark.ml

    def upper(node, left: int):
        if not node.subtreeDepth():
            return node
        below = [upper(child, left - 1) for child in (node.leftChild(), node.rightChild())] if left else []
        # as in a fit, two leaves of one prediction are one
        if not left or not any(b.subtreeDepth() for b in below) and below[0].prediction() == below[1].prediction():
            return ml.tree.LeafNode(node.prediction(), node.impurity(), node.impurityStats())
        return ml.tree.InternalNode(node.prediction(), node.impurity(), node.gain(), *below, node.split(), node.impurityStats())

    return DecisionTreeClassificationModel(ml.classification.DecisionTreeClassificationModel(
        f"{model.uid}_{depth}", upper(model._java_obj.rootNode(), depth), model.numFeatures, model.numClasses))


@dataclass
class Search:
    """What a grid search found: a row for each setting in grid order (``settings``,
    ``scores`` by fold), and the best one, the first of equally good ones."""
    settings: list[Settings]
    scores: list[list[float]]
    best: Settings = field(init=False)

    def __post_init__(self):
        means = [sum(s) / len(s) for s in self.scores]
        self.best = self.settings[max(range(len(means)), key=lambda i: (means[i], -i))]

    def table(self, spark: SparkSession) -> DataFrame:
        """(setting, params, mean_score, std_score, fold_scores, best); the std is that of the population."""
        rows = []
        for i, (params, scores) in enumerate(zip(self.settings, self.scores)):
            mean = sum(scores) / len(scores)
            std = (sum((s - mean) ** 2 for s in scores) / len(scores)) ** 0.5
            rows.append((i, {k: str(v) for k, v in params.items()}, mean, std, list(scores), params is self.best))
        return spark.createDataFrame(rows, "setting int, params map<string,string>, mean_score double, std_score double, fold_scores array<double>, best boolean")


def grid(**values: Sequence) -> list[Settings]:
    """All combinations, the last name varying fastest."""
    return [dict(zip(values, combination)) for combination in product(*values.values())]


def search(make: Callable[..., object], settings: Sequence[Settings], frame: DataFrame, k: int,
           parallelism: int = PARALLELISM, known: Callable[[Settings], list[float] | None] = lambda s: None) -> Search:
    """Accuracy of ``make(**setting)`` on each of the ``k`` folds of ``frame``.

    Fits that must come out equal are done once: boosted models of fewer rounds are the
    first rounds of the longest one; a greater ``maxDepth`` changes nothing if no tree
    has grown as deep as a smaller one allows; a single tree of fewer levels is the upper
    levels of the deeper one; and ``known`` may return the scores of a
    setting that an earlier stage has tried."""
    scores: list[list[float]] = [list(known(s) or [0.0] * k) for s in settings]
    shared: dict[tuple, list[int]] = {}
    for i, s in enumerate(settings):
        if known(s) is None:
            rest = tuple(sorted((a, b) for a, b in s.items() if a not in ("maxIter", "maxDepth")))
            shared.setdefault(rest, []).append(i)

    def score(model, members: list[int], fold: int) -> None:
        """All members are prefixes of the model and scored in one pass."""
        held_out = frame.where(F.col("fold") == fold).select("features", "label")
        for i in members:
            part = first_levels(model, settings[i]["maxDepth"]) if isinstance(model, DecisionTreeClassificationModel) and "maxDepth" in settings[i] else first_rounds(model, settings[i]["maxIter"]) if isinstance(model, GBTClassificationModel) and "maxIter" in settings[i] else model
            held_out = part.copy({part.predictionCol: f"p{i}", part.rawPredictionCol: f"r{i}", part.probabilityCol: f"q{i}"}).transform(held_out)
        got = held_out.agg(*[F.avg((F.col(f"p{i}") == F.col("label")).cast("double")).alias(f"p{i}") for i in members]).first()
        for i in members:
            scores[i][fold] = float(got[f"p{i}"] or 0.0)

    def fit(members: list[int], fold: int) -> None:
        rest = frame.where(F.col("fold") != fold)
        left = sorted(members, key=lambda i: settings[i].get("maxDepth", 0))
        deepest = make(**settings[left[-1]])
        if isinstance(deepest, DecisionTreeClassifier):
            return score(deepest.fit(rest), left, fold)
        while left:
            depth = settings[left[0]].get("maxDepth")
            mine = [i for i in left if settings[i].get("maxDepth") == depth]
            longest = max(mine, key=lambda i: settings[i].get("maxIter", 0))
            model = make(**settings[longest]).fit(rest)
            if isinstance(model, GBTClassificationModel) and depth is not None and max(t.depth for t in model.trees) < depth:
                mine = [i for i in left if settings[i].get("maxIter", 0) <= settings[longest].get("maxIter", 0)]
            score(model, mine, fold)
            left = [i for i in left if i not in mine]

    in_parallel([lambda m=m, f=f: fit(m, f) for m in shared.values() for f in range(k)], parallelism)
    return Search(list(settings), scores)


# ---- staged boosting search ------------------------------------------------------

@dataclass(frozen=True)
class Staged:
    """Stages of a boosting search, each a name and the settings tried in order; a stage
    is searched with the best values of the earlier ones.  ``start`` holds the values
    before their stage."""
    stages: tuple[tuple[str, tuple[Settings, ...]], ...]
    start: tuple[tuple[str, object], ...]
    seed: int = 10

    def make(self, **params) -> GBTClassifier:
        return GBTClassifier(seed=self.seed, maxMemoryInMB=1024, **{**dict(self.start), **params})

    def whole(self, params: Settings) -> tuple:
        """A setting with the values that are not up to it, comparable."""
        return tuple(sorted((k, str(v)) for k, v in {**dict(self.start), **params}.items()))


def boosted_search(plan: Staged, settings: Sequence[Settings], frame: DataFrame, k: int,
                   known: Callable[[Settings], list[float] | None] = lambda s: None, key: str = "ID") -> Search:
    """As ``search`` with ``plan.make``, but all models grow side by side, a round in one pass.

    Settings that differ in the number of rounds only are one model a fold, scored as it grows;
    ``known`` may return the scores of a setting that an earlier stage has tried."""
    scores: list[list[float]] = [list(known(s) or [0.0] * k) for s in settings]
    shared: dict[boosting.Boosted, dict[int, list[int]]] = {}
    for i, s in enumerate(settings):
        if known(s) is None:
            for fold in range(k):
                m = boosting.Boosted.of(plan.make(**s), fold)
                shared.setdefault(replace(m, rounds=0), {}).setdefault(m.rounds, []).append(i)
    if shared:
        for (m, members), found in zip(shared.items(), boosting.accuracies(frame, list(shared), list(shared.values()), key)):
            for rounds, some in members.items():
                for i in some:
                    scores[i][m.fold] = found[rounds]
    return Search(list(settings), scores)


# ---- stored models -----------------------------------------------------------------

def keep_model(path: str, fit: Callable[[], PipelineModel], spark: SparkSession) -> PipelineModel:
    """The model stored at ``path``, fitted and stored first if there is none; always
    the re-read one, so a second run scores with the same model."""
    if not stored(spark, path + "/done"):
        fit().write().overwrite().save(path)
        spark.range(1).write.parquet(path + "/done")  # the parts of a model are written one by one
    return PipelineModel.load(path)


def pipeline(estimator, frame: DataFrame, features: Sequence[str]) -> PipelineModel:
    """``estimator`` fitted on the assembled ``frame``, as a pipeline over the plain columns."""
    vector = VectorAssembler(inputCols=list(features), outputCol="features", handleInvalid="error")
    fitted = estimator.fit(frame)
    return PipelineModel(stages=[vector, *(fitted.stages if isinstance(estimator, Pipeline) else [fitted])])


def scores(model: PipelineModel, df: DataFrame, name: str, target: str = TARGET, key: str = "ID") -> DataFrame:
    """(Model, key, label, pred, proba) of every row."""
    return models.score(model, df).select(F.lit(name).alias("Model"), key, F.col(target).cast("int").alias("label"), "pred", "proba")


# ---- column selection ----------------------------------------------------------------

@dataclass(frozen=True)
class ColumnSelection:
    """The columns whose importance in a fitted tree model reaches ``threshold``, with
    all importances they were chosen by."""
    importances: tuple[tuple[str, float], ...]
    threshold: float = IMPORTANCE_THRESHOLD

    @classmethod
    def fit(cls, model: PipelineModel, threshold: float = IMPORTANCE_THRESHOLD) -> ColumnSelection:
        names = model.stages[0].getInputCols()
        return cls(tuple(models.importances(model.stages[-1], names)), threshold)

    @property
    def columns(self) -> list[str]:
        return [c for c, v in self.importances if v >= self.threshold]

    def apply(self, df: DataFrame, keep: Sequence[str] = ("ID", TARGET)) -> DataFrame:
        """The chosen columns, and those of ``keep`` that are there."""
        return df.select(*[c for c in keep if c in df.columns and c not in self.columns], *self.columns)

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(i, c, v, self.threshold, v >= self.threshold) for i, (c, v) in enumerate(self.importances)],
                                     "position int, feature string, importance double, threshold double, selected boolean")

    @classmethod
    def read(cls, df: DataFrame) -> ColumnSelection:
        rows = df.orderBy("position").collect()  # a row for each column
        return cls(tuple((r["feature"], r["importance"]) for r in rows), rows[0]["threshold"] if rows else IMPORTANCE_THRESHOLD)


# ---- out-of-fold predictions -----------------------------------------------------------

def out_of_fold(make: Callable[[], object], frame: DataFrame, k: int = 10, parallelism: int = PARALLELISM, key: str = "ID") -> DataFrame:
    """(fold, key, label, pred, proba): each row scored by the model fitted without its fold."""
    def held_out(fold: int) -> DataFrame:
        model = make().fit(frame.where(F.col("fold") != fold))
        rows = models.score(model, frame.where(F.col("fold") == fold))
        return rows.select("fold", key, F.col("label").cast("int").alias("label"), "pred", "proba")

    parts = in_parallel([lambda f=f: held_out(f) for f in range(k)], parallelism)
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return materialize(out)
