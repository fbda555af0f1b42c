"""Model training, tuning and scoring with MLlib (data-parallel fits); forests of many
trees are grown by ``forest``.

Features are assembled into one vector column; ``prepare`` fills missing values
with 0 first (as the benchmark does).  Searches over settings and folds are in
``tuning``.  Model parity with other libraries' trees, boosting and
networks is not a goal: operators and metrics are.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline
from pyspark.ml.classification import DecisionTreeClassifier, GBTClassifier, MultilayerPerceptronClassifier
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import TARGET
from .forest import ForestClassifier


def prepare(df: DataFrame, features: Sequence[str], target: str = TARGET) -> DataFrame:
    """Fill missing features with 0 and add ``features`` vector and ``label``."""
    filled = df.fillna(0, subset=list(features))
    out = VectorAssembler(inputCols=list(features), outputCol="features").transform(filled)
    return out.withColumn("label", F.col(target).cast("double")) if target in df.columns else out


def score(model, df: DataFrame) -> DataFrame:
    """Class and P(class 1) for each row."""
    return model.transform(df).withColumn("proba", vector_to_array("probability")[1]) \
        .withColumn("pred", F.col("prediction").cast("int"))


def decision_tree(max_depth: int = 11, min_leaf: int = 50, impurity: str = "gini", seed: int = 0):
    return DecisionTreeClassifier(maxDepth=max_depth, minInstancesPerNode=min_leaf, impurity=impurity, seed=seed)


def random_forest(num_trees: int = 500, max_depth: int = 8, seed: int = 0) -> ForestClassifier:
    return ForestClassifier(num_trees, max_depth, seed)


def gradient_boosting(max_iter: int = 100, step: float = 0.1, max_bins: int = 255, seed: int = 10,
                      max_depth: int = 5, min_leaf: int = 1):
    return GBTClassifier(maxIter=max_iter, stepSize=step, maxBins=max_bins, seed=seed, maxDepth=max_depth,
                         minInstancesPerNode=min_leaf)


def mlp(n_features: int, layers: Sequence[int] = (50, 150, 50, 35), max_iter: int = 10, seed: int = 0,
        block_size: int = 32):
    """Standardise, then a feed-forward network F-50-150-50-35-2 (sigmoid hidden
    units in MLlib: an analogue of the reference's network, not an equal)."""
    scaler = StandardScaler(inputCol="features", outputCol="scaled", withMean=True, withStd=True)
    net = MultilayerPerceptronClassifier(featuresCol="scaled", layers=[n_features, *layers, 2],
                                         maxIter=max_iter, seed=seed, blockSize=block_size)
    return Pipeline(stages=[scaler, net])


def importances(model, features: Sequence[str]) -> list[tuple[str, float]]:
    imp = model.featureImportances.toArray()
    return [(f, float(v)) for f, v in zip(features, imp)]
