"""Standardisation: (x - mean) / population std, fitted once, applied as literals.

Fitting is one aggregate (2 numbers per column read on the driver); applying
is a projection, so no window over the whole table and no join are needed.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def fit_standardizer(df: DataFrame, cols: Sequence[str]) -> dict[str, tuple[float | None, float | None]]:
    row = df.agg(*[F.avg(c).alias(f"m{i}") for i, c in enumerate(cols)],
                 *[F.stddev_pop(c).alias(f"s{i}") for i, c in enumerate(cols)]).first()
    return {c: (row[f"m{i}"], row[f"s{i}"]) for i, c in enumerate(cols)}


def apply_standardizer(df: DataFrame, params: dict[str, tuple[float | None, float | None]]) -> DataFrame:
    """A zero or missing std leaves the centred value unscaled (divisor 1)."""
    out = {}
    for c, (m, s) in params.items():
        centred = F.col(c) - F.lit(m if m is not None else 0.0)
        out[c] = centred / F.lit(s) if s else centred
    return df.withColumns(out)


def standardize(df: DataFrame, cols: Sequence[str], fit_on: DataFrame | None = None) -> DataFrame:
    return apply_standardizer(df, fit_standardizer(fit_on if fit_on is not None else df, cols))
