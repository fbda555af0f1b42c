"""Exact k-nearest-neighbour imputation (fitted on the frame itself).

For a missing cell (row i, column j) the donors are the rows with column j
present.  The distance is the NaN-aware Euclidean distance over the columns
present in both rows, ``sqrt(C / n_common * sum(diff^2))``; the value is the
mean of column j over the k nearest donors (ties by donor key), or the column
mean when no donor shares a present column with row i.

Distribution: the rows are dealt into blocks of neighbours by a tree of median
splits, fitted on a bounded sample; only which block pairs are compared depends on
it, never the result.

1. Each receiver (row with a missing cell) is compared with its own block.  The k-th
   distance found there bounds what a donor elsewhere must beat.
2. The blocks' bounding boxes (a row for each block, at most ``MOST_BLOCKS``) give a
   least distance from a receiver to any donor of a block: the gaps to the box in
   columns that all donors of the block have, scaled by C over the receiver's present
   columns, of which n_common is never more.  Only blocks that can hold a nearer donor
   are looked at.
3. The receivers and the donors of a block are packed, at most ``CHUNK`` and ``DONORS``
   rows in a row of a stored table, so both tables grow with the input.  A Cartesian
   product meets each receiver pack with the donor packs it can reach: it reads the
   packs, it deals and writes no pairs.  Three masked matrix products give all distances
   of two packs; those that are within rounding of the k-th one are computed again term
   by term.  A task holds one receiver pack and its k best donors so far, and emits these.

No pair rows are stored and no task holds more than ``RIGHT_PACKS`` packs of donors.
The time still grows with receivers x donors where the boxes rule out little.

``within`` limits donors to rows sharing those keys (e.g. the same DATE):
cheaper, but a different result, so it is an explicit option; all packs of
the group meet then.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..schema import KNN_NEIGHBORS
from ..session import materialize, no_constraint_propagation, setting

#: Rows of the sample the splits are fitted on.
SAMPLE = 16_384
#: Blocks at most: their boxes go to every task (2 numbers a block and column).
MOST_BLOCKS = 8_192
#: Receivers of one chunk, and donors that are compared with it at once.
CHUNK, DONORS = 2_048, 4_096
#: Packs of receivers and of donors that one task of the product reads at most.
LEFT_PACKS, RIGHT_PACKS = 32, 128
#: Pairs of packs that go to Python at once.
PAIRS = 4


# ---- one chunk of receivers against one block of donors ---------------------------

def nearest(x: np.ndarray, y: np.ndarray, rid: np.ndarray, did: np.ndarray, k: int) -> pd.DataFrame:
    """The k nearest donors of every missing cell of ``x`` among ``y``, whose rows are in
    the order of their keys: (rid, col, did, d2, val)."""
    width = x.shape[1]
    here, there = ~np.isnan(x), ~np.isnan(y)
    x0, y0, mx, my = np.where(here, x, 0), np.where(there, y, 0), here.astype(float), there.astype(float)
    common = mx @ my.T
    with np.errstate(divide="ignore", invalid="ignore"):
        rough = np.where(common > 0, ((x0 * x0) @ my.T + mx @ (y0 * y0).T - 2 * (x0 @ y0.T)) * (width / common), np.inf)
    # What cancellation in the products can amount to.
    slack = 1e-12 * width * ((x0 * x0).sum(1) + (y0 * y0).sum(1).max(initial=0))
    found = []
    for j in range(width):
        rows, donors = np.flatnonzero(~here[:, j]), np.flatnonzero(there[:, j])
        if not len(rows) or not len(donors):
            continue
        some = rough[np.ix_(rows, donors)]
        last = np.partition(some, k - 1, axis=1)[:, k - 1] if len(donors) > k else np.full(len(rows), np.inf)
        r, d = np.nonzero((some <= (last + 2 * slack[rows])[:, None]) & np.isfinite(some))
        found.append((np.full(len(r), j), rows[r], donors[d]))
    if not found:
        return pd.DataFrame({"rid": rid[:0], "col": np.zeros(0, np.int32), "did": did[:0], "d2": np.zeros(0), "val": np.zeros(0)})
    j, r, d = (np.concatenate(c) for c in zip(*found))
    exact, both = np.zeros(len(r)), np.zeros(len(r))
    for c in range(width):  # column order fixes the summation order
        diff = x[r, c] - y[d, c]
        there_too = ~np.isnan(diff)
        exact += np.where(there_too, diff * diff, 0)
        both += there_too
    exact = exact * width / both
    order = np.lexsort((d, exact, j, r))
    j, r, d, exact = j[order], r[order], d[order], exact[order]
    first = np.flatnonzero(np.concatenate([[True], (r[1:] != r[:-1]) | (j[1:] != j[:-1])]))
    rank = np.arange(len(r)) - np.repeat(first, np.diff(np.append(first, len(r))))
    keep = rank < k
    j, r, d = j[keep], r[keep], d[keep]
    return pd.DataFrame({"rid": rid[r], "col": j.astype(np.int32), "did": did[d], "d2": exact[keep], "val": y[d, j]})


def _compare(cols: list[str], k: int, key: str):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rec, don = pdf[pdf["__role"] == 0], pdf[pdf["__role"] == 1].sort_values(key, kind="stable")
        x, y = (d[cols].to_numpy(dtype="float64", na_value=np.nan) for d in (rec, don))
        rid, did = rec[key].to_numpy(), don[key].to_numpy()
        parts = [nearest(x[i:i + CHUNK], y[a:a + DONORS], rid[i:i + CHUNK], did[a:a + DONORS], k)
                 for i in range(0, len(x), CHUNK) for a in range(0, len(y), DONORS)]
        return pd.concat(parts, ignore_index=True) if parts else nearest(x, y, rid, did, k)

    return run


def _best(found: pd.DataFrame, k: int) -> pd.DataFrame:
    """The k nearest donors of each cell."""
    found = found.sort_values(["rid", "col", "d2", "did"], kind="stable")
    return found[found.groupby(["rid", "col"]).cumcount() < k]


def _packed(df: DataFrame, cols: list[str], key: str, block: list[str], most: int, extra: Sequence[str] = ()) -> DataFrame:
    """Rows of ``df`` (key, block, cols, extra numbers) as (block, ids, x, extra): in order of
    the key, at most about ``most`` of a block in a row; stored."""
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    parts = df.groupBy(*block).agg(F.ceil(F.count(F.lit(1)) / most).cast("int").alias("__parts"))
    dealt = df.join(parts, block).withColumn("__part", F.pmod(F.xxhash64(key, F.lit(3)), F.col("__parts")).cast("int")).drop("__parts")

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(key, kind="stable")
        row = {b: [pdf[b].iloc[0]] for b in block} | {"ids": [pdf[key].to_numpy()]}
        row["x"] = [pdf[cols].to_numpy(dtype="float64", na_value=np.nan).tobytes()]
        return pd.DataFrame(row | {c: [pdf[c].to_numpy(dtype="float64").tobytes()] for c in extra})

    out = ", ".join([*(f"`{b}` {kinds[b]}" for b in block), f"ids array<{kinds[key]}>", "x binary", *(f"`{c}` binary" for c in extra)])
    return materialize(dealt.groupBy(*block, "__part").applyInPandas(pack, out))


def _met(left: DataFrame, right: DataFrame, meets: Column, width: int, k: int, kind: str) -> DataFrame:
    """Candidates of the packs of receivers ``left`` (pack, ids, x, bound) among those of
    donors ``right`` (d_ids, d_x), for pairs of packs that ``meets``; stored."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, best, wait, seen = None, [], 0, None

        def out() -> pa.RecordBatch:
            got = _best(pd.concat(best, ignore_index=True), k)
            return pa.record_batch([pa.array(got[c].to_numpy()) if c != "rid" and c != "did" else pa.array(got[c].tolist(), kinds[c]) for c in names], names=names)

        for batch in batches:
            at = {n: i for i, n in enumerate(batch.schema.names)}
            kinds = {"rid": batch.schema.field("ids").type.value_type, "did": batch.schema.field("d_ids").type.value_type}
            for i in range(batch.num_rows):
                one = lambda c: batch.column(at[c])[i]
                if one("pack").as_py() != now:
                    if best:
                        yield out()
                    now, best, wait = one("pack").as_py(), [], 0
                    seen = [np.frombuffer(one("x").as_py()).reshape(-1, width), np.array(one("ids").as_py()), np.frombuffer(one("bound").as_py())]
                y, did = np.frombuffer(one("d_x").as_py()).reshape(-1, width), np.array(one("d_ids").as_py())
                there = ~np.isnan(y)
                low, high = (f(np.where(there, y, fill), axis=0)[None, :] for f, fill in ((np.min, np.inf), (np.max, -np.inf)))
                near = least_distances(seen[0], low, high, there.all(axis=0)[None, :])[:, 0] <= seen[2]
                if not near.any():
                    continue
                x, rid, bound = (v[near] for v in seen)
                for a in range(0, len(y), DONORS):
                    found = nearest(x, y[a:a + DONORS], rid, did[a:a + DONORS], k)
                    if len(found):
                        limit = pd.Series(bound, index=rid)
                        best.append(found[found["d2"].to_numpy() <= limit.loc[found["rid"]].to_numpy()])
                        wait += len(best[-1])
                if wait > 1 << 18:
                    best, wait = [_best(pd.concat(best, ignore_index=True), k)], 0
        if best:
            yield out()

    names = ["rid", "col", "did", "d2", "val"]
    packs, cores = left.count(), left.sparkSession.sparkContext.defaultParallelism
    left = left.repartition(max(1, min(packs, 2 * cores), -(-packs // LEFT_PACKS)), "pack")
    right = right.repartition(max(1, -(-right.count() // RIGHT_PACKS)))
    with setting(left.sparkSession, "spark.sql.execution.arrow.maxRecordsPerBatch", str(PAIRS)), setting(left.sparkSession, "spark.sql.autoBroadcastJoinThreshold", "-1"):
        pairs = left.hint("shuffle_replicate_nl").join(right, meets).select("pack", "ids", "x", "bound", "d_ids", "d_x")
        return materialize(pairs.mapInArrow(run, f"rid {kind}, col int, did {kind}, d2 double, val double"))


# ---- blocks -------------------------------------------------------------------------

def splits(sample: np.ndarray, depth: int) -> list[tuple[int, float]]:
    """A tree of ``depth`` levels in heap order: each node halves its sample rows at the
    median of the column that varies most there; missing values count as the median."""
    out: list[tuple[int, float]] = []
    level = [sample]
    for _ in range(depth):
        below = []
        for rows in level:
            with np.errstate(invalid="ignore"):
                spread = np.array([np.nanvar(c) if (~np.isnan(c)).any() else 0.0 for c in rows.T]) if len(rows) else np.zeros(sample.shape[1])
            col = int(spread.argmax())
            at = float(np.nanmedian(rows[:, col])) if len(rows) and (~np.isnan(rows[:, col])).any() else 0.0
            out.append((col, at))
            right = np.where(np.isnan(rows[:, col]), at, rows[:, col]) > at
            below += [rows[~right], rows[right]]
        level = below
    return out


def block_of(x: np.ndarray, tree: list[tuple[int, float]], depth: int) -> np.ndarray:
    node = np.zeros(len(x), np.int64)
    col, at = np.array([c for c, _ in tree], np.int64), np.array([v for _, v in tree])
    for _ in range(depth):
        v = x[np.arange(len(x)), col[node]]
        node = 2 * node + 1 + (np.where(np.isnan(v), at[node], v) > at[node])
    return node - (2 ** depth - 1)


def _matrix(batch: pa.RecordBatch, names: Sequence[str]) -> np.ndarray:
    return np.column_stack([batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in names]).astype(float)


def _in_blocks(base: DataFrame, cols: list[str], key: str, rows: int, block_rows: int) -> tuple[DataFrame, int]:
    """``base`` with ``__block``, stored; and the number of blocks."""
    depth = max(0, math.ceil(math.log2(max(1, min(MOST_BLOCKS, rows / block_rows)))))
    if not depth:
        return base.withColumn("__block", F.lit(0)), 1
    share = min(1.0, SAMPLE / rows)
    picked = base.where(F.pmod(F.xxhash64(key, F.lit(1)), F.lit(1 << 30)) < int(share * (1 << 30))).select(*cols)
    tree = splits(picked.toPandas().to_numpy(dtype="float64", na_value=np.nan), depth)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = block_of(_matrix(batch, cols), tree, depth)
            yield pa.record_batch([*batch.columns, pa.array(at.astype(np.int32))], names=[*batch.schema.names, "__block"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema.fields)
    return base.mapInArrow(run, f"{kinds}, __block int"), 2 ** depth


def _boxes(base: DataFrame, cols: list[str]) -> tuple[np.ndarray, ...]:
    """(block, low, high, whole): bounding boxes, a row for each block; ``whole`` says
    in which columns no row of the block is missing."""
    found = base.groupBy("__block").agg(F.count(F.lit(1)).alias("n"), *[f(c).alias(f"{f.__name__}{i}") for i, c in enumerate(cols) for f in (F.min, F.max, F.count)]).toPandas()
    part = lambda name: found[[f"{name}{i}" for i in range(len(cols))]].to_numpy(dtype="float64", na_value=np.nan)
    return found["__block"].to_numpy(), part("min"), part("max"), part("count") == found["n"].to_numpy()[:, None]


def least_distances(x: np.ndarray, low: np.ndarray, high: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """For each row and box no more than the squared distance to any donor in the box."""
    here = ~np.isnan(x)
    out = np.zeros((len(x), len(low)))
    for c in range(x.shape[1]):
        rows, boxes = np.flatnonzero(here[:, c]), np.flatnonzero(whole[:, c])
        gap = np.maximum(np.maximum(low[boxes, c][None, :] - x[rows, c][:, None], x[rows, c][:, None] - high[boxes, c][None, :]), 0)
        out[np.ix_(rows, boxes)] += gap * gap
    # a hair less, so that rounding cannot lose a tie
    return out * (x.shape[1] / np.maximum(here.sum(1), 1))[:, None] * (1 - 1e-9)


# ---- the operator ---------------------------------------------------------------------

@dataclass(frozen=True)
class Work:
    """Receiver-donor pairs that were compared, and all there are."""
    compared: int
    possible: int


def knn_impute(df: DataFrame, cols: Sequence[str], k: int = KNN_NEIGHBORS, key: str = "ID",
               block_rows: int = 1024, within: Sequence[str] = ()) -> DataFrame:
    """Fill NULLs of ``cols`` with the mean of the k nearest donors' values."""
    return knn_impute_work(df, cols, k, key, block_rows, within)[0]


def knn_impute_work(df: DataFrame, cols: Sequence[str], k: int = KNN_NEIGHBORS, key: str = "ID",
                    block_rows: int = 1024, within: Sequence[str] = ()) -> tuple[DataFrame, Work]:
    """``knn_impute`` and the work it took."""
    with no_constraint_propagation(df.sparkSession):
        out, work = _imputed(materialize(df), list(cols), k, key, block_rows, list(within))
        return materialize(out), work


def _imputed(df: DataFrame, cols: list[str], k: int, key: str, block_rows: int, within: list[str]) -> tuple[DataFrame, Work]:
    kind = df.schema[key].dataType.simpleString()
    # one array predicate, not a 40-way OR: a long disjunction makes Catalyst's
    # constraint propagation through the union and joins explode
    values = F.array(*[F.col(c).cast("double") for c in cols])
    base = df.select(key, *within, F.size(F.filter(values, lambda v: v.isNull())).alias("__missing"), *[F.col(c).cast("double") for c in cols])
    total = base.agg(F.count(F.lit(1)).alias("d"), F.count_if(F.col("__missing") > 0).alias("r")).first()
    if within:
        sizes = base.groupBy(*within).agg(F.greatest(F.lit(1), F.ceil(F.count(F.lit(1)) / block_rows)).cast("int").alias("__blocks"))
        base = base.join(sizes, within).withColumn("__block", F.pmod(F.xxhash64(key), F.col("__blocks")).cast("int"))
        blocks = 0
    else:
        base, blocks = _in_blocks(base, cols, key, total["d"], block_rows)
    base = materialize(base)
    block = [*within, "__block"]
    receivers = base.where("__missing > 0")
    found_kind = f"rid {kind}, col int, did {kind}, d2 double, val double"
    rows = [key, *within, *cols]
    compare = _compare(cols, k, key)

    def compared(rec: DataFrame) -> tuple[DataFrame, int]:
        """Candidates of (receiver, __block) rows against those blocks, in chunks."""
        held = base.groupBy(*block).agg(F.count(F.lit(1)).alias("__d"))
        chunks = materialize(rec.groupBy(*block).agg(F.count(F.lit(1)).alias("__r")).join(held, block)
                             .withColumn("__chunks", F.ceil(F.col("__r") / CHUNK).cast("int")))
        pairs = chunks.agg(F.sum(F.col("__r") * F.col("__d"))).first()[0] or 0
        left = rec.join(chunks.select(*block, "__chunks"), block).select(
            *rows, "__block", F.lit(0).alias("__role"), F.pmod(F.xxhash64(key, F.lit(2)), F.col("__chunks")).cast("int").alias("__chunk"))
        right = base.join(chunks.select(*block, "__chunks"), block).select(
            *rows, "__block", F.lit(1).alias("__role"), F.explode(F.sequence(F.lit(0), F.col("__chunks") - 1)).alias("__chunk"))
        return left.unionByName(right).groupBy(*block, "__chunk").applyInPandas(compare, found_kind), int(pairs)

    home, at_home = compared(receivers.select(*rows, "__block"))
    home = materialize(home)
    elsewhere, away = None, 0
    if within or blocks > 1:
        cells = home.groupBy("rid", "col").agg(F.count(F.lit(1)).alias("n"), F.max("d2").alias("d2"))
        bound = cells.groupBy("rid").agg(F.count_if(F.col("n") >= k).alias("__cells"), F.max("d2").alias("__d2"))
        bounded = receivers.join(bound.withColumnRenamed("rid", key), key, "left").withColumn(
            "bound", F.when(F.col("__cells") == F.col("__missing"), F.col("__d2")).otherwise(float("inf")))
        several = F.col("__blocks") > 1 if within else F.lit(True)
        asking = bounded.where(several).select(*rows, "__block", "bound")
        donors = _packed(base.where(several).select(*rows, "__block"), cols, key, block, DONORS)
        if within:
            held = base.where(several).groupBy(*block).agg(F.count(F.lit(1)).alias("d"), F.count_if(F.col("__missing") > 0).alias("r"))
            whole = Window.partitionBy(*within)
            away = held.withColumn("all", F.sum("d").over(whole)).agg(F.sum(F.col("r") * (F.col("all") - F.col("d")))).first()[0] or 0
            packs = _packed(asking, cols, key, block, CHUNK, ["bound"])
            group = F.to_json(F.struct(*within))
            # an array, as an equal key would deal a whole group to one task
            packs, donors = packs.withColumn("reach", F.array(group)), donors.withColumn("d_group", group)
        else:
            names, low, high, whole = _boxes(base, cols)
            sizes = dict(base.groupBy("__block").agg(F.count(F.lit(1))).collect())
            held = np.array([sizes[b] for b in names])

            def reached(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                """The blocks that some receiver of a pack can reach, and the pairs of rows that makes."""
                for batch in batches:
                    reach, pairs = [], []
                    for x, bounds, own in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("x", "bound", "__block"))):
                        x, bounds = np.frombuffer(x).reshape(-1, len(cols)), np.frombuffer(bounds)
                        step, any_of, n = max(1, (1 << 21) // max(len(names), 1)), np.zeros(len(names), bool), 0
                        for a in range(0, len(x), step):
                            hit = (least_distances(x[a:a + step], low, high, whole) <= bounds[a:a + step, None]) & (names != own)[None, :]
                            any_of |= hit.any(axis=0)
                            n += int((hit @ held).sum())
                        reach.append([str(b) for b in names[any_of]])
                        pairs.append(n)
                    yield pa.record_batch([*batch.columns, pa.array(reach, pa.list_(pa.string())), pa.array(pairs, pa.int64())], names=[*batch.schema.names, "reach", "pairs"])

            packs = _packed(asking, cols, key, block, CHUNK, ["bound"])
            kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in packs.schema.fields)
            packs = materialize(packs.mapInArrow(reached, f"{kinds}, reach array<string>, pairs long"))
            away = packs.agg(F.sum("pairs")).first()[0] or 0
            donors = donors.withColumn("d_group", F.col("__block").cast("string"))
        left = materialize(packs.select(F.monotonically_increasing_id().alias("pack"), "ids", "x", "bound", "reach", F.col("__block").alias("l_block")).where(F.size("reach") > 0))
        right = donors.select(F.col("ids").alias("d_ids"), F.col("x").alias("d_x"), "d_group", F.col("__block").alias("d_block"))
        elsewhere = _met(left, right, F.array_contains("reach", F.col("d_group")) & (F.col("l_block") != F.col("d_block")), len(cols), k, kind)
    cand = home if elsewhere is None else home.unionByName(elsewhere)
    # the row number limit is applied per partition before the shuffle: k rows of each cell from each
    order = Window.partitionBy("rid", "col").orderBy("d2", "did")
    top = cand.withColumn("__r", F.row_number().over(order)).where(F.col("__r") <= k)
    listed = top.groupBy("rid", "col").agg(F.array_sort(F.collect_list(F.struct("d2", "did", "val"))).alias("top"))  # k at most
    best = listed.select("rid", "col", (F.aggregate(F.col("top"), F.lit(0.0), lambda a, t: a + t["val"]) / F.size("top")).alias("imp"))
    # the block stage is the expensive one: store it (lineage cut) before the join back
    imputed = materialize(best.groupBy("rid").agg(F.map_from_entries(F.collect_list(F.struct("col", "imp"))).alias("__imp")))
    means = df.agg(*[F.avg(c).alias(c) for c in cols]).first()  # one number per column
    out = df.join(imputed.withColumnRenamed("rid", key), key, "left")
    return out.select(*[
        F.coalesce(F.col(c).cast("double"), F.try_element_at("__imp", F.lit(cols.index(c))), F.lit(means[c]).cast("double")).alias(c) if c in cols else F.col(c)
        for c in df.columns]), Work(at_home + int(away), int(total["r"]) * int(total["d"]))
