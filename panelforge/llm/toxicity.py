"""Toxicity: a linear classifier over character n-grams scaled by naive Bayes
log-count ratios.

N-grams of 3 to 5 characters of the lower-cased text are hashed to 2**18
features; a feature is present or not.  Each is scaled by the log ratio of its
smoothed share in toxic and in other labelled texts, then a logistic regression
over the scaled features is fitted.  Both fits use a bounded sample of labelled
rows; every text is scored whole, in blocks that overlap by one n-gram.

A NULL or empty text scores by the intercept and its padding alone.  Equal texts score
equally; of features equally telling the ones of smaller hash are kept; an empty table
gives no row; other columns are ignored.  Without labels of both classes the one there
is decides.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_map, crc_mod, sample_per_class, store, table

BITS = 18
SIZES = (3, 4, 5)
#: Bounds of the labelled sample: texts of either class, and features kept for the regression.
SAMPLE_DOCS = 4000
FEATURES = 1 << 15
BLOCK = 1 << 19  # characters looked at at once
MULTIPLIER = np.uint32(0x9E3779B1)


def features(text: str) -> np.ndarray:
    """The distinct features of a text, in no order.  Blocks overlap by one n-gram,
    so a text of any length is covered with bounded memory."""
    text = f" {text.lower()} "
    found = []
    for at in range(0, max(1, len(text) - SIZES[-1] + 1), BLOCK):
        c = np.frombuffer(text[at:at + BLOCK + SIZES[-1] - 1].encode("utf-32-le", "surrogatepass"), np.uint32)
        idx, h = [], c * MULTIPLIER
        for n in range(2, SIZES[-1] + 1):
            h = (h[:-1] ^ (h[:-1] >> np.uint32(15))) * MULTIPLIER + c[n - 1:]
            if n in SIZES and len(h):
                idx.append((h * np.uint32(0x85EBCA6B + 2 * n)) >> np.uint32(32 - BITS))
        found.append(np.concatenate(idx) if idx else np.zeros(0, np.uint32))
    idx = np.concatenate(found) if len(found) > 1 else found[0]
    # Each feature once, without sorting: the last position written wins.
    mark = _MARK
    order = np.arange(len(idx), dtype=np.int32)
    mark[idx] = order
    return idx[mark[idx] == order]


_MARK = np.zeros(1 << BITS, np.int32)


class Model:
    """Weights of the scaled features (zero where a feature was not kept) and the intercept."""

    def __init__(self, weights: np.ndarray, bias: float):
        self.weights, self.bias = weights.astype(np.float32), float(bias)

    def margin(self, text: str) -> float:
        return float(self.weights[features(text)].sum(dtype=np.float64)) + self.bias


ROWS = 256  # rows of the sample that the regression goes over at once


def regress(rows: list[np.ndarray], scale: np.ndarray, y: np.ndarray, l2: float, steps: int = 150) -> tuple[np.ndarray, float]:
    """Logistic regression by accelerated gradient descent over sparse rows of
    present features, with class weights that count both classes alike.  The rows are
    taken in blocks, so that beside the features themselves little is held."""
    blocks = [(i, np.concatenate(rows[i:i + ROWS]), np.repeat(np.arange(len(rows[i:i + ROWS]), dtype=np.int32), [len(r) for r in rows[i:i + ROWS]]))
              for i in range(0, len(rows), ROWS)]
    weight = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y == 0).sum()))

    def by_row(values: np.ndarray) -> np.ndarray:
        """The sum of ``values`` over each row's features."""
        out = np.zeros(len(rows))
        for i, at, of in blocks:
            part = out[i:i + ROWS]
            part[:] = np.bincount(of, weights=values[at], minlength=len(part))
        return out

    def by_feature(values: np.ndarray) -> np.ndarray:
        """The sum of ``values`` over the rows that hold each feature."""
        out = np.zeros(len(scale))
        for i, at, of in blocks:
            out += np.bincount(at, weights=values[i:i + ROWS][of], minlength=len(scale))
        return out

    rate = 1 / (0.25 * float((weight * (by_row(scale * scale) + 1)).sum()) + l2)
    w, b = np.zeros(len(scale)), 0.0
    v, c, t = w.copy(), b, 1.0
    for _ in range(steps):
        z = by_row(scale * v) + c
        r = weight * (1 / (1 + np.exp(-np.clip(z, -60, 60))) - y)
        w2 = v - rate * (scale * by_feature(r) + l2 * v)
        b2 = c - rate * float(r.sum())
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, c = w2 + (t - 1) / t2 * (w2 - w), b2 + (t - 1) / t2 * (b2 - b)
        w, b, t = w2, b2, t2
    return w, b


def train(learn: DataFrame, docs_per_class: int = SAMPLE_DOCS, l2: float = 1e-4) -> Model:
    """Fit on ``learn`` (text, y): at most ``docs_per_class`` rows of each class are expected.
    With one class only, the intercept decides alone."""
    learn = store(learn, "toxicity-sample")

    def count(batches):
        n = np.zeros((2, 1 << BITS), np.int32)
        docs = np.zeros(2, np.int64)
        for batch in batches:
            for text, y in zip(batch.column(0), batch.column(1).to_pylist()):
                n[y, features(text.as_py() or "")] += 1
                docs[y] += 1
        for y in (0, 1):
            yield pa.record_batch([pa.array([y], pa.int32()), pa.array([int(docs[y])], pa.int64()), pa.array([n[y].tobytes()], pa.binary())], names=["y", "docs", "n"])

    n, docs = np.zeros((2, 1 << BITS)), np.zeros(2)
    for r in learn.coalesce(8).mapInArrow(count, "y int, docs long, n binary").collect():  # 8 tasks x 2 vectors of fixed size
        n[r["y"]] += np.frombuffer(r["n"], np.int32)
        docs[r["y"]] += r["docs"]
    if not docs.all():
        return Model(np.zeros(1 << BITS), 4.0 if docs[1] else -4.0)
    ratio = np.log((n[1] + 1) / (docs[1] + 2)) - np.log((n[0] + 1) / (docs[0] + 2))
    worth = np.where(n.sum(0) >= 3, np.abs(ratio) * np.sqrt((n / docs[:, None]).sum(0)), 0)
    kept = np.argsort(-worth, kind="stable")[:FEATURES]
    kept = kept[worth[kept] > 0]
    number = np.full(1 << BITS, -1, np.int32)
    number[kept] = np.arange(len(kept))

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = []
        for text in batch.column(0):
            at = number[features(text.as_py() or "")]
            found.append(at[at >= 0].astype("<u2").tobytes())
        return pa.record_batch([batch.column(1), pa.array(found, pa.binary())], names=["y", "at"])

    got = arrow_map(learn, rows, "y int, at binary").toArrow()
    at = [np.frombuffer(b.as_py(), "<u2") for b in got.column(1)]
    w, b = regress(at, ratio[kept], got.column(0).to_numpy().astype(float), l2)
    weights = np.zeros(1 << BITS)
    weights[kept] = w * ratio[kept]
    return Model(weights, b)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """Score (0 to 1) of each row of ``docs`` (key, text); a NULL text counts as empty."""
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        z = np.array([model.margin(t.as_py() or "") for t in batch.column(1)])
        return pa.record_batch([batch.column(0), pa.array(1 / (1 + np.exp(-np.clip(z, -60, 60))))], names=["key", "score"])

    return arrow_map(docs.select("key", "text"), run, "key long, score double")


def keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("key"), F.col("text").cast("string").alias("text"))


def train_on_labels(docs: DataFrame, labels: DataFrame, docs_per_class: int = SAMPLE_DOCS) -> Model:
    """Labels come only from rows whose crc32 remainder by 5 is not 0.  A document
    labelled twice counts as toxic if one label says so; NULL labels are ignored."""
    known = labels.where((crc_mod("doc_id", 5) != 0) & F.col("toxic").isin(0, 1))
    known = known.groupBy(F.col("doc_id").cast("long").alias("key")).agg(F.max("toxic").cast("int").alias("y"))
    ids = sample_per_class(known, "key", "y", docs_per_class)
    return train(keyed(docs).join(F.broadcast(ids), "key").select("text", "y"), docs_per_class)  # bounded: 2 x docs_per_class keys


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract 1 over the whole ``documents`` table."""
    docs = table(spark, sf_dir, "documents")
    out = score(keyed(docs), train_on_labels(docs, table(spark, sf_dir, "labels")))
    return out.select(F.col("key").alias("doc_id"), F.coalesce(crc_mod("key", 5) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
