"""The data-processing flow, train and test kept apart (no leakage):

drop rows with all recent returns missing -> drop rows with any missing (train)
-> group statistics -> technical indicators -> drop id columns -> prune
indicator columns by name and all-NULL -> drop +-inf columns -> kNN-impute the
test rows.  Each value-dependent column decision is one aggregate action.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..functions import indicators as ind
from ..operators import clean, groupstats
from ..operators.impute import knn_impute
from ..schema import ID_COLS, TARGET
from ..session import materialize, no_constraint_propagation


def model_input(train: DataFrame, test: DataFrame, n_days: int = 5, impute: bool = True):
    """Returns (train features + target, test features, feature names)."""
    with no_constraint_propagation(train.sparkSession):
        train = clean.drop_any_missing(clean.drop_all_missing(train, n_days))
        train, test = materialize(groupstats.group_stats(train)), materialize(groupstats.group_stats(test))
        empty = ind.all_null_indicator_columns(train)   # decided on train, from series starts only
        names = [c for c in ind.indicator_names(all_positions=True) if c not in empty]
        names = [c for c in names if c not in set(clean.prune_names(names))]  # only these are computed
        train, test = ind.add_named_indicators(train, names), ind.add_named_indicators(test, names)
        keep_id = [c for c in ID_COLS if c != "ID"]
        train, test = clean.drop_id_cols(train, keep_id), clean.drop_id_cols(test, keep_id)
        train, test, _ = clean.prune_by_name(train, test, TARGET)
        # stored before the check for infinities and before rows with gaps are dropped: both
        # read the features, and a filter is moved below what computes them and repeats it
        train, test = materialize(train), materialize(test)
        # after the group statistics and indicators, train rows with gaps are dropped
        train = clean.drop_any_missing(train)
    train, test, feats = clean.filter_infinity(train, test, TARGET)
    feats = [f for f in feats if f != "ID"]
    if impute:
        test = knn_impute(test, feats, key="ID")
    return train, test, feats


def train_input(train: DataFrame) -> DataFrame:
    """The train side of ``model_input`` alone: key, features and target."""
    return model_input(train, train.drop(TARGET).limit(0), impute=False)[0]
