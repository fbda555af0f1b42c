"""Chained left equi-joins with key renames, then drop rows with any NULL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


#: Rows of a dimension up to which it is broadcast.
SMALL_DIMENSION = 10_000


def left_join_chain(facts: DataFrame, mid: DataFrame, dim: DataFrame,
                    fact_key: str, mid_key: str, mid_fk: str, dim_key: str,
                    small: int = SMALL_DIMENSION) -> DataFrame:
    """``facts LEFT JOIN mid ON fact_key LEFT JOIN dim ON mid_fk``, then dropna.

    The join keys are renamed so each join is a USING join (one key column in
    the output).  ``mid`` is joined as is: a hot key on the fact side is split
    by AQE's skew handling.  ``dim`` is broadcast if it has at most ``small`` rows,
    which is counted (no further than that); beyond it is joined like ``mid``.
    """
    mid = mid.withColumnRenamed(mid_key, fact_key)
    few = dim.limit(small + 1).count() <= small
    dim = dim.withColumnRenamed(dim_key, mid_fk)
    out = facts.join(mid, fact_key, "left").join(F.broadcast(dim) if few else dim, mid_fk, "left")
    return out.dropna()
