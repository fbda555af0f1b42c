"""Best-fit decreasing packing of tokenized documents into fixed windows.

A document is its ids and an end id; one longer than the window is cut into whole
windows behind a first piece that may be shorter.  Best-fit decreasing takes the
pieces longest first and puts each into the open sequence with the least room that
still holds it.  Which piece of a length goes where does not matter, so the packing
is decided on the histogram of lengths, ``window`` numbers whatever the corpus:

* ``OpenBins`` is a segment tree over the remaining capacities 0..window, whose
  leaves hold the open bins of that capacity; the tightest bin for a length is found
  by one descent.  Bins that were filled alike are one entry with a repeat count, and
  a length is placed into all of them in one step, with the same outcome as piece
  after piece.
* The pieces find their places on the executors: a piece's rank among those of its
  length is its rank within the task that cut it plus the count of earlier tasks, so
  no piece is shuffled for it and a length that a third of all pieces share meets
  in no task.

NULL and empty texts are one piece of the end id alone.  Repeated rows are packed
once each.  Pieces of equal length are told apart by the task and order in which
they were cut only, so equal rows may swap places.  A very long text gives as many
pieces as it needs.  An empty table gives no row; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import bounded, if_small, store, table
from .packing import tokenizer

WINDOW = 2048
END_ID = 0
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, _part int, _pos long"


def cut(total: int, window: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: the remainder first, then whole windows."""
    first = total % window or window
    return [(0, first)] + [(a, window) for a in range(first, total, window)]


def pieces_of(docs: DataFrame, path: str, window: int = WINDOW) -> DataFrame:
    """The pieces of every document, each with the task that cut it (``_part``) and its
    rank there among the pieces of its length (``_pos``).  To be stored before use:
    the two columns name one run of the task."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok, end = tokenizer(path), np.array([END_ID], "<u4").tobytes()
        part, seen = TaskContext.get().partitionId(), [0] * (window + 1)
        for batch in (b for whole in batches for b in bounded(whole)):
            rows: list[tuple] = []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = tok.encode(text.as_py() or "") + end
                for i, (a, n) in enumerate(cut(len(ids) // 4, window)):
                    rows.append((key, i, a, n, zlib.crc32(ids[4 * a:4 * (a + n)]), part, seen[n]))
                    seen[n] += 1
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
            yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=[c.split()[0] for c in PIECES.split(", ")])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, PIECES)


class OpenBins:
    """Segment tree over the remaining capacities 0..window: a node says whether a bin
    of one of its capacities is open, a leaf holds the bins of one capacity."""

    def __init__(self, window: int):
        self.size = 1 << window.bit_length()
        self.some = [False] * (2 * self.size)
        self.bins: list[list] = [[] for _ in range(window + 1)]

    def _mark(self, room: int) -> None:
        at, here = room + self.size, bool(self.bins[room])
        while at and self.some[at] != here:
            self.some[at] = here
            at >>= 1
            here = self.some[2 * at] or self.some[2 * at + 1]

    def push(self, room: int, entry) -> None:
        self.bins[room].append(entry)
        self._mark(room)

    def pop(self, room: int):
        entry = self.bins[room].pop()
        self._mark(room)
        return entry

    def tightest(self, length: int) -> int | None:
        """The least capacity of an open bin that is ``length`` or more."""
        at = length + self.size
        while not self.some[at]:
            while at & 1:  # a right child: the next leaves hang under an ancestor's right neighbour
                at >>= 1
            if not at:
                return None
            at += 1
        while at < self.size:
            at = 2 * at if self.some[2 * at] else 2 * at + 1
        return at - self.size


def best_fit(histogram: dict[int, int], window: int = WINDOW) -> list[tuple[tuple[tuple[int, int], ...], int]]:
    """(fillings, bins) entries: so many bins hold, in this order, ``times`` pieces of
    each (length, times).  Equal to best-fit decreasing piece after piece."""
    bins = OpenBins(window)
    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            room = bins.tightest(length)
            fill, many = bins.pop(room) if room is not None else ((), -(-left // (window // length)))
            room = window if room is None else room
            # A bin that has taken one piece is the tightest for the next as long as it
            # holds it, so the bins are filled up one after the other.
            times = room // length
            full, rest = divmod(left, times) if left < many * times else (many, 0)
            if full:
                bins.push(room - times * length, (fill + ((length, times),), full))
            if rest:
                bins.push(room - rest * length, (fill + ((length, rest),), 1))
            if many > full + bool(rest):
                bins.push(room, (fill, many - full - bool(rest)))
            left -= full * times + rest
    return [entry for leaf in bins.bins for entry in leaf]


def places(packing: list[tuple[tuple[tuple[int, int], ...], int]]) -> dict[int, np.ndarray]:
    """For each length its rows (first rank, pieces in a bin, first sequence, first offset) by rank."""
    out: dict[int, list[tuple[int, int, int, int]]] = {}
    used: dict[int, int] = {}
    sequence = 0
    for fill, many in packing:
        offset = 0
        for length, times in fill:
            out.setdefault(length, []).append((used.get(length, 0), times, sequence, offset))
            used[length] = used.get(length, 0) + times * many
            offset += times * length
        sequence += many
    return {k: np.array(v, np.int64) for k, v in out.items()}


def pack(pieces: DataFrame, window: int = WINDOW) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to the stored ``pieces_of``."""
    counts = store(pieces.groupBy("_part", "length").agg(F.count(F.lit(1)).alias("_n")), "lengths")
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("_n").alias("n")).collect()}
    at = places(best_fit(histogram, window))
    earlier = Window.partitionBy("length").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    base = store(counts.select("_part", "length", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_base")), "bases")
    names = [c for c in pieces.columns if not c.startswith("_")]
    ranked = pieces.join(if_small(base, 64), ["_part", "length"]).select(
        F.col("length").alias("_length"), (F.col("_base") + F.col("_pos")).cast("long").alias("_rank"), *names)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            for v in np.unique(length):
                rows, slots = np.flatnonzero(length == v), at[int(v)]
                slot = slots[np.searchsorted(slots[:, 0], rank[rows], side="right") - 1]
                bin_, k = np.divmod(rank[rows] - slot[:, 0], slot[:, 1])
                sequence[rows], offset[rows] = slot[:, 2] + bin_, slot[:, 3] + k * v
            yield pa.record_batch([*batch.columns[2:], pa.array(sequence), pa.array(offset)], names=[*names, "sequence_id", "offset"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pieces.schema.fields if f.name in names)
    return ranked.mapInArrow(place, f"{kinds}, sequence_id long, offset long")


def pack_best_fit(docs: DataFrame, path: str, window: int = WINDOW) -> DataFrame:
    """The pieces of all documents with their places in sequences of ``window`` ids at most."""
    return pack(store(pieces_of(docs, path, window), "pieces"), window)


def op11_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract 11 over the whole ``documents`` table."""
    import public_tokenizers

    return pack_best_fit(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
