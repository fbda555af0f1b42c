"""Embedding whitening on MLlib's distributed BlockMatrix.

1. One scan counts the usable vectors by length.  Every usable vector of the most
   common length becomes integers x = floor(1024 c) + 100000, stored with the task
   that read it and its place there, from which rows get a dense index.
2. The exact sums S (one number a dimension) are added up in each task.
3. The centred rows x - S/n are indexed and dealt into a BlockMatrix of ``ENTRIES``
   numbers a block, all d columns wide.  Its transpose times itself is the scatter
   matrix; the middle dimension is split by block, so a task multiplies one pair of
   blocks and the d x d products are added up.
4. The scatter matrix, d x d whatever the number of rows, is decomposed on the driver.
   The BlockMatrix times the whitening matrix (d x 8) projects the rows, which meet
   their ids again by index.

Only S, the scatter matrix, a number for each task and the index of each block reach
the driver.

Rows whose vector is NULL, empty or holds a NULL or non-finite entry are dropped, and
so are vectors of another length than the most common one (of equally common ones the
greater).  Entries beyond 2^40 count as 2^40.  Repeated rows count each; a NULL id is
kept as NULL.  Tied eigenvalues are ordered as the decomposition gives them.  A
component without variance (one row, equal rows, fewer rows than dimensions) has
whitened 0.0 and explained 0.0 and no part in identity_error.  A deviation beyond a
long is NULL.  An empty table gives no row; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.mllib.common import callMLlibFunc
from pyspark.mllib.linalg import Matrices
from pyspark.mllib.linalg.distributed import BlockMatrix, IndexedRowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded, if_small, store, table

SCALE, SHIFT, MOST = 1024, 100000, float(1 << 40)
COMPONENTS = 8
#: Numbers in a block of rows: 4 MB as doubles.
ENTRIES = 1 << 19
OUT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def usable(vectors: DataFrame, vector: str) -> DataFrame:
    """Rows whose vector is there and holds finite numbers only."""
    finite = F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v.cast("double")) < float("inf")))
    return vectors.where(F.col(vector).isNotNull() & (F.size(vector) > 0)).where(finite)


def integer_rows(vectors: DataFrame, key: str, vector: str, d: int) -> DataFrame:
    """(vec_id, x, place) of the usable vectors of length ``d``; ``place`` holds the
    number of the task in its upper bits and the row's place there in the lower 33."""
    def whole(c):
        return F.floor(F.greatest(F.least(c.cast("double"), F.lit(MOST)), F.lit(-MOST)) * SCALE).cast("long") + SHIFT

    named = usable(vectors, vector).where(F.size(vector) == d)
    return named.select(F.col(key).cast("long").alias("vec_id"), F.transform(vector, whole).alias("x"), F.monotonically_increasing_id().alias("place"))


def matrix_of(batch: pa.RecordBatch, column: int, d: int) -> np.ndarray:
    return batch.column(column).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, d)


def sums(rows: DataFrame, d: int) -> tuple[int, list[int]]:
    """The number of rows and their exact sum in each dimension."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, [0] * d
        for batch in (b for whole in batches for b in bounded(whole)):
            x = matrix_of(batch, 0, d)
            high, low = (x >> 32).sum(0), (x & 0xFFFFFFFF).sum(0)  # added apart, so that no sum overflows
            n, total = n + len(x), [t + (int(h) << 32) + int(v) for t, h, v in zip(total, high, low)]
        if n:
            yield pa.record_batch([pa.array([n], pa.int64()), pa.array([[str(t) for t in total]])], names=["n", "s"])

    parts = rows.select("x").mapInArrow(run, "n long, s array<string>")
    added = parts.select("n", F.posexplode("s").alias("i", "s")).groupBy("i").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s"))
    found = added.orderBy("i").collect()  # d rows
    return int(found[0]["n"]), [int(r["s"]) for r in found]


def indexed(rows: DataFrame) -> DataFrame:
    """The rows with a dense ``index`` from 0; the count of each task passes through the driver."""
    part = F.shiftright("place", 33).cast("int")
    first, bases = 0, []
    for r in rows.groupBy(part.alias("part")).count().orderBy("part").collect():
        bases.append((r["part"], first))
        first += r["count"]
    base = rows.sparkSession.createDataFrame(bases, "part int, first long")
    return rows.withColumn("part", part).join(if_small(base, 16), "part").withColumn("index", F.col("first") + F.col("place").bitwiseAND((1 << 33) - 1))


def centred_matrix(rows: DataFrame, n: int, s: list[int]) -> BlockMatrix:
    """The centred rows x - S/n as a BlockMatrix; the whole part of S/n goes first, exactly."""
    d = len(s)
    middle = F.array(*[F.lit(t // n) for t in s])
    rest = F.array(*[F.lit(float((t - n * (t // n)) / n)) for t in s])
    centred = F.transform("x", lambda v, i: (v - middle[i]).cast("double") - rest[i])
    vectors = MLUtils.convertVectorColumnsFromML(rows.select("index", array_to_vector(centred).alias("vector")), "vector")
    return IndexedRowMatrix(vectors, n, d).toBlockMatrix(max(1, ENTRIES // d), d)


def exact_deviation(x: np.ndarray, n: int, s: list[int]) -> list[int | None]:
    """sum over dimensions of (n x - S)^2, in exact integers; None beyond a long."""
    middle = [t // n for t in s]
    rest = [t - n * m for t, m in zip(s, middle)]
    near = x - np.array(middle, np.int64)
    rough = ((n * near.astype(np.float64) - np.array(rest, np.float64)) ** 2).sum(1)
    if rough.max(initial=0) < 2.0 ** 62:  # then each n * near - rest fits as well
        off = n * near - np.array(rest, np.int64)
        return (off * off).sum(1).tolist()
    out = [sum((n * int(a) - r) ** 2 for a, r in zip(row, rest)) for row in near]
    return [v if v < 1 << 63 else None for v in out]


def scatter(matrix: BlockMatrix) -> np.ndarray:
    """The transpose times the matrix, with the middle dimension split by block."""
    left = matrix.transpose()
    splits = matrix.numRowBlocks
    product = left._java_matrix_wrapper.call("multiply", matrix._java_matrix_wrapper._java_model, splits)
    return BlockMatrix(product, left.rowsPerBlock, matrix.colsPerBlock).toLocalMatrix().toArray()


def whitening(scattered: np.ndarray, n: int, most: int = COMPONENTS) -> tuple[np.ndarray, np.ndarray]:
    """The whitening matrix (d x components) and each component's share of the variance."""
    covariance = scattered / n
    values, vectors = np.linalg.eigh((covariance + covariance.T) / 2)
    values, vectors = values[::-1][:most], vectors[:, ::-1][:, :most]
    real = values > max(float(values.max(initial=0)) * len(scattered) * np.finfo(float).eps, 0)
    trace = float(np.trace(covariance))
    return np.where(real, vectors / np.sqrt(np.where(real, values, 1)), 0), np.where(real, values / (trace or 1), 0)


def whiten(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """A row for each usable vector and component: see the module's docstring."""
    spark = vectors.sparkSession
    lengths = usable(vectors, vector).groupBy(F.size(vector).alias("d")).count()
    common = lengths.orderBy(F.desc("count"), F.desc("d")).first()
    if common is None:
        return spark.createDataFrame([], OUT)
    d = common["d"]
    rows = store(integer_rows(vectors, key, vector, d), "rows")
    n, s = sums(rows, d)
    numbered = indexed(rows)
    matrix = centred_matrix(numbered, n, s)
    w, explained = whitening(scatter(matrix), n)
    k = w.shape[1]
    small = spark.sparkContext.parallelize([((0, 0), Matrices.dense(d, k, w.ravel(order="F").tolist()))], 1)
    projected = matrix.multiply(BlockMatrix(small, d, k, d, k)).toIndexedRowMatrix()
    whitened = callMLlibFunc("getIndexedRows", projected._java_matrix_wrapper._java_model).toDF("index", "w")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b for whole in batches for b in bounded(whole)):
            yield pa.record_batch([*batch.columns[:2], pa.array(exact_deviation(matrix_of(batch, 2, d), n, s), pa.int64())], names=["index", "vec_id", "deviation"])

    deviations = numbered.select("index", "vec_id", "x").mapInArrow(run, "index long, vec_id long, deviation long")
    result = store(deviations.join(whitened.select("index", vector_to_array("w").alias("w")), "index").drop("index"), "whitened")
    real = [i for i in range(k) if explained[i] > 0]
    entries = [F.abs(F.covar_pop(F.col("w")[i], F.col("w")[j]) - float(i == j)) for i in real for j in real if j <= i]
    error = result.agg(F.greatest(F.lit(0.0), F.lit(0.0), *entries)).first()[0]
    shares = F.array(*[F.lit(float(v)) for v in explained])
    return result.select("vec_id", "deviation", F.posexplode("w").alias("c", "whitened")).select(
        "vec_id", (F.col("c") + 1).alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened",
        F.element_at(shares, F.col("c") + 1).alias("explained"), F.lit(float(error)).alias("identity_error"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract 12 over the whole ``embeddings`` table."""
    return whiten(table(spark, sf_dir, "embeddings"))
