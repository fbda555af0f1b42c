"""Column names of the panel and fixed parameter values."""

from __future__ import annotations

N_LAGS = 20


def ret_cols(n: int = N_LAGS) -> list[str]:
    return [f"RET_{k}" for k in range(1, n + 1)]


def vol_cols(n: int = N_LAGS) -> list[str]:
    return [f"VOLUME_{k}" for k in range(1, n + 1)]


# Fixed values that must equal the reference's.
TARGET = "RET"
ID_COLS = ["ID", "STOCK", "DATE", "INDUSTRY", "INDUSTRY_GROUP", "SECTOR", "SUB_INDUSTRY"]
GROUP_LEVELS = ["INDUSTRY", "INDUSTRY_GROUP", "SECTOR", "SUB_INDUSTRY"]
GROUP_SHIFTS = [1, 2, 3, 4, 5]
GROUP_STATISTICS = ["median", "std"]
INDICATOR_PERIOD_LABELS = [2, 5, 14]
PRUNE_NAME_PATTERN = r"\D(?:([1-2]{1}[0-9])|([8-9]{1})\_)"
PRUNE_KEEP_PREFIXES = ("RET", "VOLUME")
BENCHMARK_ACCURACY = 0.5131
IMPORTANCE_THRESHOLD = 0.01
IMPORTANCE_PLOT_THRESHOLD = 0.05
KNN_NEIGHBORS = 5
MOSTLY_MISSING = 0.95
BENCH_FEATURES = [*ret_cols(5), *vol_cols(5), "RET_1_SECTOR_DATE_mean"]
GB_STAGES = ["n_estimators", "tree_params", "leaf_params", "max_features"]
MODEL_NAMES = ["base_decision_tree", "tuned_decision_tree", *[f"gb_{s}" for s in GB_STAGES], "neural_network"]
TREE_GRID = {"maxDepth": [2, 3, 4, 5, 6], "impurity": ["gini", "entropy"]}
# Grids of the staged searches.  The third stage of the first one tunes l2 in the
# reference (0, 0.1, 0.5, 1, 2); the least information gain stands in for it here.
HIST_START = {"maxIter": 100, "stepSize": 0.1, "maxDepth": 5, "minInstancesPerNode": 20, "minInfoGain": 0.0, "maxBins": 255}
HIST_STAGES = {
    "n_estimators": {"maxIter": [30, 40, 50, 60, 70, 80]},
    "tree_params": {"maxDepth": [5, 7, 9, 11, 13, 15], "minInstancesPerNode": [20, 30, 40, 50]},
    "leaf_params": {"minInfoGain": [0.0, 0.001, 0.005, 0.01, 0.02]},
    "max_features": {"maxBins": [128, 255, 512]},
}
CLASSIC_START = {"maxIter": 100, "stepSize": 0.1, "maxDepth": 8, "minInstancesPerNode": 50, "subsamplingRate": 0.8, "featureSubsetStrategy": "sqrt"}
CLASSIC_STAGES = {
    "n_estimators": {"maxIter": [30, 40, 50, 60, 70, 80]},
    "tree_params": {"maxDepth": [5, 7, 9, 11, 13, 15]},
    "leaf_params": {"minInstancesPerNode": [40, 50, 60]},
    "max_features": {"featureSubsetStrategy": ["7", "9", "11", "13", "15", "17", "19"]},
}
# End of fixed values.

HISTORY_COLS = ret_cols() + vol_cols()
