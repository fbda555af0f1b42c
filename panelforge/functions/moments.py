"""Pairwise-complete moments of many columns from one scan.

A task goes over its batches once.  For each pair of columns it keeps, of the rows
where both are present, the count, both means, both sums of squares about the mean
and the sum of products about the means; batches are merged with the updating
formulas for combined samples (Chan, Golub, LeVeque), so no large sums of squares
are ever subtracted.  A task hands on one row for each pair; these are combined
across tasks by plain sums about the common mean.  The input is read once, however
many columns there are, and what is shuffled depends on tasks and columns only.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize

PARTS = "a int, b int, n long, ma double, mb double, va double, vb double, c double"
#: Rows of a batch that are taken at once: bounds the working memory at many columns.
ROWS = 4096


class Moments:
    """Moments of all pairs of ``width`` columns; [i, j] of ``mean`` and ``square`` are
    those of column i over the rows where j is present too."""

    def __init__(self, width: int):
        self.n, self.mean, self.square, self.product = (np.zeros((width, width)) for _ in range(4))

    def add(self, x: np.ndarray) -> None:
        """Rows of numbers, NaN where missing."""
        here = ~np.isnan(x)
        seen = here.sum(0)
        # About the batch's own means, so that the sums below stay small.
        about = np.where(seen > 0, np.nansum(np.where(here, x, 0), 0) / np.maximum(seen, 1), 0)
        d, m = np.where(here, x - about, 0), here.astype(float)
        n, total = m.T @ m, d.T @ m
        some = np.maximum(n, 1)
        mean = total / some
        square = (d * d).T @ m - total * mean
        product = d.T @ d - total * mean.T
        self.merge(n, about[:, None] + mean, np.maximum(square, 0), product)

    def merge(self, n: np.ndarray, mean: np.ndarray, square: np.ndarray, product: np.ndarray) -> None:
        both = self.n + n
        some = np.maximum(both, 1)
        off = np.where((self.n > 0) & (n > 0), mean - self.mean, 0)
        weight = self.n * n / some
        self.square += square + off * off * weight
        self.product += product + off * off.T * weight
        self.mean = np.where(self.n > 0, np.where(n > 0, (self.n * self.mean + n * mean) / some, self.mean), mean)
        self.n = both


def pair_parts(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """A row for each task and pair of columns a < b (by position), stored."""
    width = len(cols)
    a, b = np.triu_indices(width, 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = Moments(width)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                found.add(np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.slice(at, ROWS).columns]).astype(float))
        if len(a) and found.n.any():
            columns = [a.astype(np.int32), b.astype(np.int32), found.n[a, b].astype(np.int64), found.mean[a, b], found.mean[b, a],
                       found.square[a, b], found.square[b, a], found.product[a, b]]
            yield pa.record_batch([pa.array(c) for c in columns], names=[p.split()[0] for p in PARTS.split(", ")])

    return materialize(df.select(*[F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate(cols)]).mapInArrow(run, PARTS))


def correlations(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(a, b, n, corr) of every pair of columns by position, a < b; ``corr`` is NULL
    where it is not defined: fewer than two rows, or a column that does not vary."""
    parts = pair_parts(df, cols).where("n > 0")
    means = parts.groupBy("a", "b").agg(F.sum("n").alias("all"), (F.sum(F.col("n") * F.col("ma")) / F.sum("n")).alias("xa"),
                                        (F.sum(F.col("n") * F.col("mb")) / F.sum("n")).alias("xb"))
    da, db = F.col("ma") - F.col("xa"), F.col("mb") - F.col("xb")
    sums = parts.join(means, ["a", "b"]).groupBy("a", "b").agg(
        F.first("all").alias("n"), F.first("xa").alias("xa"), F.first("xb").alias("xb"),
        F.sum(F.col("va") + F.col("n") * da * da).alias("va"), F.sum(F.col("vb") + F.col("n") * db * db).alias("vb"), F.sum(F.col("c") + F.col("n") * da * db).alias("c"))

    def varies(square: str, mean: str):
        # more than the rounding of values that are all equal
        return F.col(square) > F.col("n") * F.pow(F.abs(F.col(mean)) * 1e-14, 2)

    corr = F.when((F.col("n") > 1) & varies("va", "xa") & varies("vb", "xb"), F.col("c") / (F.sqrt("va") * F.sqrt("vb")))
    width = len(cols)
    every = df.sparkSession.range(width * width).select((F.col("id") / width).cast("int").alias("a"), (F.col("id") % width).cast("int").alias("b")).where("a < b")
    found = sums.withColumn("r", F.nanvl(corr, F.lit(None).cast("double")))
    found = found.select("a", "b", "n", F.when(F.col("r").isNotNull(), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), "r"))).alias("corr"))
    return every.join(found, ["a", "b"], "left").select("a", "b", F.coalesce("n", F.lit(0)).alias("n"), "corr")
