"""Packing of tokenized documents into fixed windows by non-negative least squares.

A document's ids are cut every ``window`` ids; whole windows are sequences of
their own and the remainders are packed.  Only the histogram of remainder
lengths, ``window`` numbers whatever the corpus, reaches the driver:

1. lengths fall into classes; all shallow combinations of two or three classes
   whose lengths can fill the window are the columns, the class counts the right
   hand side, of a non-negative least squares problem for the repeat counts;
2. the counts are rounded down and each combination is realised with lengths of
   its classes, the last one by best fit to the room that is left;
3. what remains is packed greedily, longest first with best fit.

The plan is a list of (lengths, repeats), bounded by the number of lengths and
combinations.  Each piece finds its sequence and offset from its rank among the
pieces of its length, counted in buckets so that no length meets in one task.
"""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window
from tokenizers import Tokenizer

from .bpe_automaton import byte_symbols
from .common import arrow_map, store, table

WINDOW = 2048
END_ID = 1
CLASSES = 64
#: The pre-split of the public byte-level vocabularies (fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


class ByteTokenizer:
    """Byte-level BPE of a tokenizer file.  Ids of this kind of vocabulary are in
    merge order, so they serve as ranks and the faster of the two public
    libraries gives the same ids; special tokens are cut out first."""

    def __init__(self, path: str):
        self.exact = Tokenizer.from_file(path)
        self.special = {t.content: i for i, t in self.exact.get_added_tokens_decoder().items()}
        self.cut = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")")
        raw = {s: b for b, s in enumerate(byte_symbols())}
        vocab = self.exact.get_vocab(with_added_tokens=False)
        self.fast = tiktoken.Encoding("own", pat_str=PATTERN, special_tokens={}, mergeable_ranks={
            bytes([raw[s] for s in token]): i for token, i in vocab.items()})

    def plain(self, text: str) -> bytes:
        try:
            ids = self.fast.encode_ordinary(text)
        except Exception:  # its regular expressions give up on extremely long runs of white space
            ids = self.exact.encode(text, add_special_tokens=False).ids
        return array("I", ids).tobytes()

    def encode(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        if not any(s in text for s in self.special):
            return self.plain(text)
        return b"".join(array("I", [self.special[x]]).tobytes() if x in self.special else self.plain(x) for x in self.cut.split(text))


@lru_cache(maxsize=2)
def tokenizer(path: str) -> ByteTokenizer:
    return ByteTokenizer(path)


def pieces_of(docs: DataFrame, path: str, window: int = WINDOW) -> DataFrame:
    """The pieces of every document: its ids and the end id, cut at multiples of
    ``window``.  An empty or NULL text is one piece of the end id alone."""
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        tok, end = tokenizer(path), np.array([END_ID], "<u4").tobytes()
        rows: list[tuple] = []
        for key, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            ids = tok.encode(text.as_py() or "") + end
            total = len(ids) // 4
            rows += [(key, a, min(window, total - a), zlib.crc32(ids[4 * a:4 * (a + window)]), total) for a in range(0, total, window)]
        return pa.record_batch([pa.array(c, pa.int64()) for c in zip(*rows)], names=[c.split()[0] for c in PIECES.split(", ")])

    return arrow_map(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), run, PIECES)


def nnls(a: np.ndarray, b: np.ndarray, steps: int = 400) -> np.ndarray:
    """Lawson and Hanson's active set method for min |a x - b|, x >= 0."""
    n = a.shape[1]
    x, free = np.zeros(n), np.zeros(n, bool)
    tol = 1e-8 * max(1.0, float(np.abs(a.T @ b).max(initial=0)))
    for _ in range(steps):
        w = a.T @ (b - a @ x)
        w[free] = -np.inf
        j = int(np.argmax(w))
        if w[j] <= tol:
            break
        free[j] = True
        while True:
            at = np.flatnonzero(free)
            z = np.linalg.lstsq(a[:, at], b, rcond=None)[0]
            if z.min(initial=1) > 0:
                x[:] = 0
                x[at] = z
                break
            bad = z <= 0
            alpha = np.min(x[at][bad] / np.maximum(x[at][bad] - z[bad], 1e-300))
            x[at] = np.maximum(x[at] + alpha * (z - x[at]), 0)
            free[at[x[at] <= 1e-12]] = False
            x[~free] = 0
            if not free.any():
                break
    return x


def combinations(window: int, classes: int) -> list[tuple[int, ...]]:
    """Pairs and triples of classes whose mid lengths fill the window to within a class."""
    width = window // classes
    mid = [int((c + 0.5) * width) for c in range(classes)]
    out = [(i, j) for i in range(classes) for j in range(i + 1) if window - width < mid[i] + mid[j] <= window]
    return out + [(i, j, k) for i in range(classes) for j in range(i + 1) for k in range(j + 1) if window - width < mid[i] + mid[j] + mid[k] <= window]


def plan(histogram: dict[int, int], window: int = WINDOW, classes: int = CLASSES) -> list[tuple[tuple[int, ...], int]]:
    """(lengths, repeats) patterns that use up the histogram.  A pattern's lengths sum to ``window`` at most."""
    left = np.zeros(window + 1, np.int64)
    for length, n in histogram.items():
        left[length] = n
    out: list[tuple[tuple[int, ...], int]] = []

    def fits(low: int, room: int) -> int:
        """The largest length left in low..room, or 0."""
        some = np.flatnonzero(left[low:room + 1]) if room >= low else ()
        return low + int(some[-1]) if len(some) else 0

    def emit(lengths: list[int], most: int) -> int:
        values, times = np.unique(lengths, return_counts=True)
        n = int(min(most, (left[values] // times).min()))
        if n:
            left[values] -= n * times
            out.append((tuple(lengths), n))
        return n

    if left[window]:
        emit([window], int(left[window]))
    width = window // classes
    index = np.minimum(np.arange(window + 1) // width, classes - 1)
    have = np.bincount(index, weights=left, minlength=classes)
    combos = [c for c in combinations(window, classes) if all(have[i] for i in c)]
    if combos:
        a = np.zeros((classes, len(combos)))
        for j, c in enumerate(combos):
            for i in c:
                a[i, j] += 1
        repeats = np.floor(nnls(a, have) + 1e-9).astype(int)
        for j in np.flatnonzero(repeats):
            due = int(repeats[j])
            while due:
                lengths, room = [], window
                for c in combos[j][:-1]:
                    low, high = max(1, c * width), min((c + 1) * width - 1, room)
                    part = left[low:high + 1].copy()
                    for x in lengths:
                        if low <= x <= high:
                            part[x - low] -= 1
                    if high < low or part.max() <= 0:
                        break
                    lengths.append(low + int(part.argmax()))
                    room -= lengths[-1]
                # The last member fills the room: its class first, then any length below.
                last = fits(max(1, room - 2 * width), room) if len(lengths) == len(combos[j]) - 1 else 0
                if not last or not (n := emit([*lengths, last], due)):
                    break
                due -= n
    while (first := fits(1, window)):
        lengths, room, spare = [first], window - first, left.copy()
        left[first] -= 1
        while (nxt := fits(1, room)):
            lengths.append(nxt)
            room -= nxt
            left[nxt] -= 1
        left[:] = spare
        emit(lengths, int(left[first]))
    return out


def slots(patterns: list[tuple[tuple[int, ...], int]]) -> dict[int, list[tuple[int, int, int, int]]]:
    """For each length its (first rank, members in a pattern, first sequence, first offset) in rank order."""
    out: dict[int, list[tuple[int, int, int, int]]] = {}
    used: dict[int, int] = {}
    base = 0
    for lengths, repeats in patterns:
        offset = 0
        for length in sorted(set(lengths), reverse=True):
            times = lengths.count(length)
            out.setdefault(length, []).append((used.get(length, 0), times, base, offset))
            used[length] = used.get(length, 0) + times * repeats
            offset += times * length
        base += repeats
    return out


def pack(pieces: DataFrame, window: int = WINDOW, per_bucket: int = 2000) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to stored pieces with a ``length`` of 1 to
    ``window``.  Equal pieces of one document are told apart by their order only,
    so either may take either place."""
    hist = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    at = slots(plan(hist, window))
    buckets = max(1, sum(hist.values()) // per_bucket)
    keyed = pieces.withColumn("_b", F.pmod(F.xxhash64("doc_id", "start"), F.lit(buckets)))
    counts = keyed.groupBy("length", "_b").agg(F.count(F.lit(1)).alias("_n"))
    before = counts.withColumn("_before", F.sum("_n").over(Window.partitionBy("length").orderBy("_b")) - F.col("_n")).drop("_n")
    local = F.row_number().over(Window.partitionBy("length", "_b").orderBy("doc_id", "start", "ids_crc32")) - 1
    ranked = keyed.withColumn("_local", local).join(before, ["length", "_b"])
    names = [c for c in pieces.columns]
    table_at = {k: np.array(v, np.int64) for k, v in at.items()}

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            seq, off = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            for v in np.unique(length):
                rows, of = np.flatnonzero(length == v), table_at[int(v)]
                r = rank[rows]
                slot = of[np.searchsorted(of[:, 0], r, side="right") - 1]
                rep, k = np.divmod(r - slot[:, 0], slot[:, 1])
                seq[rows], off[rows] = slot[:, 2] + rep, slot[:, 3] + k * v
            yield pa.record_batch([*batch.columns[2:], pa.array(seq), pa.array(off)], names=[*names, "sequence_id", "offset"])

    src = ranked.select(F.col("length").alias("_length"), (F.col("_before") + F.col("_local")).cast("long").alias("_rank"), *names)
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pieces.schema.fields)
    return src.mapInArrow(place, f"{kinds}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, path: str, window: int = WINDOW) -> DataFrame:
    """Pieces of all documents with their places.  Every id lies in exactly one
    piece; repeated rows are packed once each; an empty table gives no row."""
    return pack(store(pieces_of(docs, path, window), "pieces"), window)


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
