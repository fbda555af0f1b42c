"""Exactly n rows of a table, chosen by a hash, without ordering them.

The n rows of the smallest hash are those up to a threshold.  The threshold is found
digit by digit: rows are counted by the leading digits of their hash, the running
count tells which group of digits the n-th row falls into, and only rows of that
group are counted by their next digits.  The rows are then taken with a filter on
one pair (hash, key): nothing is sorted, shuffled or merged in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Digits of the hash that are counted at a time: at most 16^4 counts reach the driver.
DIGITS = 4
#: A group of this many rows or fewer is looked at row by row.
FEW = 4096
HASH_DIGITS = 32


def seeded_hash(key: str, seed: int) -> Column:
    """md5 of the key and the seed, as 32 hex digits (DuckDB has the same function)."""
    return F.md5(F.concat(F.col(key).cast("string"), F.lit(f":{seed}")))


def nth_smallest(df: DataFrame, n: int, key: str, seed: int) -> tuple[str, object] | None:
    """(hash, key) of the n-th row by (hash, key); None when n is 0.  ``df`` must have
    n rows; it is read once for every ``DIGITS`` digits needed, so store it."""
    if n <= 0:
        return None
    rows, known, left = df.select(F.col(key).alias("k"), seeded_hash(key, seed).alias("h")), "", n
    while True:
        group = rows.where(F.col("h").startswith(known)) if known else rows
        digits = F.substring("h", len(known) + 1, DIGITS)
        counts = sorted((r["d"], r["c"]) for r in group.groupBy(digits.alias("d")).agg(F.count(F.lit(1)).alias("c")).collect())
        for d, c in counts:
            if left <= c:
                break
            left -= c
        else:
            raise ValueError(f"fewer than {n} rows")
        known += d
        if c <= FEW or len(known) >= HASH_DIGITS:
            # rows of equal hash have equal keys, so they are told apart by nothing here
            few = rows.where(F.col("h").startswith(known)).groupBy("h", "k").agg(F.count(F.lit(1)).alias("c")).orderBy("h", "k").collect()
            for r in few:
                if left <= r["c"]:
                    if left < r["c"]:
                        raise ValueError(f"key {r['k']!r} is not unique")
                    return r["h"], r["k"]
                left -= r["c"]


def up_to(threshold: tuple[str, object] | None, key: str, seed: int) -> Column:
    """Whether a row comes no later than the threshold row."""
    if threshold is None:
        return F.lit(False)
    h, k = seeded_hash(key, seed), F.col(key)
    return (h < threshold[0]) | ((h == threshold[0]) & (k <= F.lit(threshold[1])))
