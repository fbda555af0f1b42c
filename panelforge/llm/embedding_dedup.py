"""Near-duplicate embeddings by a forest of random-projection trees.

Vectors are compared within a label.  For each label a forest is fitted on a
bounded sample: a node projects on its own random direction, cuts in the middle
half of the sample where fewest lie, and sends what is near the cut both ways.
Every vector is then sent to its leaves and compared there with all others of
the leaf; a leaf above the block size is compared block by block, each pair of
blocks in its own task, so no leaf is cut short.  A pair that meets in several
leaves is counted in the first one only.  Equal vectors are one class and carry
their number.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import store, table
from .components import components

COSINE = 0.93
TREES = 8
LEAF = 256  # vectors that a leaf should hold
SPILL = 0.2  # distance from the cut within which a unit vector goes both ways; linked ones are at most 0.374 apart
SAMPLE = 4096  # vectors of a label on which its forest is fitted
DEEPEST = 7  # levels: the sample leaves 32 vectors for the last cut
BLOCK = 512
KEYS = ["label", "dim"]


def unit(raw: list[bytes], dim: int) -> np.ndarray:
    """Rows of length 1 in double precision."""
    x = np.stack([np.frombuffer(r, "<f4" if len(r) == 4 * dim else "<f8").astype(np.float64) for r in raw])
    x /= np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def packed(vectors: pa.Array) -> list[bytes]:
    """Components as bytes, in single precision where that is exact."""
    out = []
    for v in vectors:
        x = v.values.to_numpy(zero_copy_only=False)
        y = x.astype("<f4")
        out.append(y.tobytes() if np.array_equal(y, x) else x.astype("<f8").tobytes())
    return out


def direction(tree: int, node: int, dim: int) -> np.ndarray:
    return np.random.default_rng((7, tree, node, dim)).standard_normal(dim)


def cut(p: np.ndarray) -> float:
    """Where to split: in the middle half, with the fewest points within the spill.
    If most would go both ways, infinity: all go left."""
    if not len(p):
        return 0.0
    at = np.quantile(p, np.linspace(0.25, 0.75, 21))
    p = np.sort(p)
    near = np.searchsorted(p, at + SPILL, side="right") - np.searchsorted(p, at - SPILL)
    return float(at[near.argmin()]) if near.min() <= 0.5 * len(p) else np.inf


def fit(x: np.ndarray, depth: int) -> np.ndarray:
    """The cut of every node of every tree, nodes in heap order."""
    cuts = np.zeros((TREES, (1 << depth) - 1))
    for t in range(TREES):
        inside = [np.arange(len(x))]
        for node in range(cuts.shape[1]):
            at = inside[node]
            p = x[at] @ direction(t, node, x.shape[1])
            cuts[t, node] = cut(p)
            inside += sides(at, p, cuts[t, node])
    return cuts


def sides(at: np.ndarray, p: np.ndarray, where: float) -> list[np.ndarray]:
    return [at[p <= where + SPILL], at[p >= where - SPILL]]


def leaves(x: np.ndarray, cuts: np.ndarray) -> list[list[np.ndarray]]:
    """For each tree, for each leaf, the rows that fall into it."""
    out = []
    for t in range(len(cuts)):
        inside = [np.arange(len(x))]
        for node in range(cuts.shape[1]):
            at = inside[node]
            p = x[at] @ direction(t, node, x.shape[1])
            inside += sides(at, p, cuts[t, node])
        out.append(inside[cuts.shape[1]:])
    return out


def _fit(t: pa.Table) -> pa.Table:
    dim, n = t.column("dim")[0].as_py(), t.column("n")[0].as_py()
    depth = int(min(DEEPEST, max(0, np.ceil(np.log2(max(n, 1) / LEAF)))))
    cuts = fit(unit(packed(t.column("embedding").combine_chunks()), dim), depth)
    return pa.table([t.column("label")[:1], t.column("dim")[:1], pa.array([depth], pa.int32()), pa.array([cuts.tobytes()], pa.binary())], names=["label", "dim", "depth", "cuts"])


MEMBER = "label long, dim int, node long, mult long, x binary, mask binary, tree int, leaf int"


def _assign(rows: pa.Table, forest: pa.Table) -> pa.Table:
    names = [f.split()[0] for f in MEMBER.split(", ")]
    if not rows.num_rows:
        return pa.table([pa.array([], k) for k in (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int32(), pa.int32())], names=names)
    dim, depth = rows.column("dim")[0].as_py(), forest.column("depth")[0].as_py()
    raw = packed(rows.column("embedding").combine_chunks())
    cuts = np.frombuffer(forest.column("cuts")[0].as_py()).reshape(TREES, (1 << depth) - 1)
    found = leaves(unit(raw, dim), cuts)
    mask = np.zeros((len(raw), TREES, max(1, (1 << depth) // 64)), np.uint64)
    at, tree, leaf = [], [], []
    for t, of_tree in enumerate(found):
        for i, inside in enumerate(of_tree):
            mask[inside, t, i // 64] |= np.uint64(1) << np.uint64(i % 64)
            at.append(inside)
            tree.append(np.full(len(inside), t, np.int32))
            leaf.append(np.full(len(inside), i, np.int32))
    at = pa.array(np.concatenate(at))
    base = [*(rows.column(c).combine_chunks() for c in names[:4]), pa.array(raw, pa.binary()), pa.array([m.tobytes() for m in mask], pa.binary())]
    return pa.table([*(c.take(at) for c in base), pa.array(np.concatenate(tree)), pa.array(np.concatenate(leaf))], names=names)


FOUND = "node long, links long, root long"


def _compare(t: pa.Table) -> pa.Table:
    """Links of one leaf, or of one pair of its blocks, that are first met here, and a
    root to which each linked vector is connected."""
    dim, tree, leaf, lo, hi = (t.column(c)[0].as_py() for c in ("dim", "tree", "leaf", "lo", "hi"))
    block = t.column("block").to_numpy()
    order = np.argsort(block, kind="stable")
    block, node, mult = block[order], t.column("node").to_numpy()[order], t.column("mult").to_numpy()[order]
    x = unit(t.column("x").to_pylist(), dim)[order]
    mask = np.stack([np.frombuffer(m, np.uint64) for m in t.column("mask").to_pylist()])[order].reshape(len(order), TREES, -1)
    links, root = np.zeros(len(node), np.int64), np.arange(len(node))
    edge = int((block == lo).sum())
    left, right = (np.arange(len(node)), np.arange(len(node))) if lo == hi else (np.arange(edge), np.arange(edge, len(node)))

    def top(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    before = ~np.uint64(0) >> np.uint64(64 - leaf % 64) if leaf % 64 else np.uint64(0)
    for at in range(0, len(left), BLOCK):
        i, j = np.nonzero(x[left[at:at + BLOCK]] @ x[right].T >= COSINE)
        i, j = left[at + i], right[j]
        i, j = (i[i < j], j[i < j]) if lo == hi else (i, j)
        for a in range(0, len(i), 1 << 18):
            p, q = i[a:a + (1 << 18)], j[a:a + (1 << 18)]
            both = mask[p, :tree + 1] & mask[q, :tree + 1]
            met = both[:, :tree].any((1, 2)) | both[:, tree, :leaf // 64].any(1) | (both[:, tree, leaf // 64] & before).astype(bool)
            np.add.at(links, p[~met], mult[q[~met]])
            np.add.at(links, q[~met], mult[p[~met]])
        # One link from each vector to its first partner and a pass over the rest connects them.
        for p, q in zip(i.tolist(), j.tolist()):
            if root[p] != root[q] and (u := top(p)) != (v := top(q)):
                root[max(u, v)] = min(u, v)
    of = np.array([top(k) for k in range(len(node))], np.int64)
    linked = (links > 0) | (of != np.arange(len(node))) | (np.bincount(of, minlength=len(node)) > 1)
    return pa.table([pa.array(node[linked]), pa.array(links[linked]), pa.array(node[of[linked]])], names=["node", "links", "root"])


def near_duplicates(vectors: DataFrame) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row of ``vectors`` (vec_id, embedding, label).

    A NULL label, a NULL, empty or zero vector and one with a NULL or non-finite
    component link with nothing: no links, own component, kept.  Vectors of unlike
    length do not link.  Repeated rows link with each other like any equal vectors."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("embedding"))
    fine = F.col("label").isNotNull() & F.col("embedding").isNotNull() & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0)
    rows = rows.withColumn("node", F.when(F.coalesce(fine, F.lit(False)), F.xxhash64("label", "embedding")))
    known = rows.where("node IS NOT NULL")
    classes = store(known.groupBy("node", "label", "embedding").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("mult")).withColumn("dim", F.size("embedding")), "vectors")
    n = classes.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n"))
    pick = classes.select("node", *KEYS).withColumn("r", F.row_number().over(Window.partitionBy(*KEYS).orderBy(F.xxhash64("node"), "node"))).where(F.col("r") <= SAMPLE).drop("r")
    fitted = classes.select("node", *KEYS, "embedding").join(pick, ["node", *KEYS], "left_semi").join(n, KEYS).groupBy(*KEYS).applyInArrow(_fit, "label long, dim int, depth int, cuts binary")
    forest = store(fitted.join(n, KEYS).withColumn("salts", F.ceil(F.col("n") / 1024).cast("int")), "forest")
    salted = classes.join(forest.select(*KEYS, "salts"), KEYS).withColumn("salt", F.pmod(F.xxhash64("node", F.lit(1)), F.col("salts")).cast("int"))
    each = forest.select(*KEYS, "depth", "cuts", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    by = [*KEYS, "salt"]
    member = salted.select(*by, "node", "mult", "embedding").groupBy(*by).cogroup(each.groupBy(*by)).applyInArrow(_assign, MEMBER)
    member = store(member, "leaves")
    place = [*KEYS, "tree", "leaf"]
    large = member.groupBy(*place).agg(F.count(F.lit(1)).alias("c")).where(F.col("c") > BLOCK).withColumn("blocks", F.ceil(F.col("c") / (BLOCK // 2)).cast("int")).drop("c")
    spread = member.join(large, place, "left").withColumn("blocks", F.coalesce("blocks", F.lit(1))).withColumn("block", F.pmod(F.xxhash64("node", F.lit(2)), F.col("blocks")).cast("int"))
    spread = spread.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("lo", F.least("block", "other")).withColumn("hi", F.greatest("block", "other"))
    found = store(spread.select(*place, "lo", "hi", "block", "node", "mult", "x", "mask").groupBy(*place, "lo", "hi").applyInArrow(_compare, FOUND), "found")
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    groups = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    named = classes.select("node", "rep", "mult").join(groups, "node", "left").join(links, "node", "left")
    least = named.where("component IS NOT NULL").groupBy("component").agg(F.min("rep").alias("least"))
    named = named.join(least, "component", "left").select("node", F.coalesce("least", "rep").alias("least"), (F.coalesce("links", F.lit(0)) + F.col("mult") - 1).alias("n_links"))
    out = rows.select("vec_id", "node").join(named, "node", "left")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("least", "vec_id").alias("component_id")).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def op4_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))


OP4_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE label IS NOT NULL AND len(embedding) > 0
    AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x)))
    AND list_bool_or(list_transform(embedding, lambda x: x <> 0))),
link AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
reach AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM reach r JOIN link l ON l.a = r.b),
least AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept
FROM embeddings JOIN least ON least.a = vec_id LEFT JOIN (SELECT a, count(*) AS n FROM link GROUP BY a) c ON c.a = vec_id
"""
