"""Language identification by segmentation-marginalised unigrams.

Each language has a probability for every piece of a fixed public vocabulary.
A word's probability is the sum over all ways to cut it into pieces, by the
forward algorithm; a text's is the product over its words.  The piece
probabilities are fitted by expectation maximisation over the same lattices
(forward-backward) on the words of a bounded sample of labelled texts.
"""

from __future__ import annotations

from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import arrow_map, crc_mod, sample_per_class, table

#: Bounds of the labelled sample: texts and distinct words for each language.
SAMPLE_DOCS = 600
SAMPLE_WORDS = 10_000
LONGEST_WORD = 32  # longer runs of letters are scored in stretches of this length
FLOOR = 1e-9  # probability of a letter outside the vocabulary
SMOOTHING = 0.05
LETTERS = regex.compile(r"\p{L}{1,%d}" % LONGEST_WORD).findall
HEAD = "▁"
MULTIPLIER = np.uint64(0x100000001B3)
MEMO = 100_000  # entries of a worker's memo; results do not depend on it
LETTERS_AT_ONCE = 1 << 20  # characters of the texts whose words are counted at once, one text at least
SCHEMA = "key long, lang_pred string, score double"


@lru_cache(maxsize=2)
def vocabulary(path: str) -> dict[str, int]:
    """Pieces of letters of a sentencepiece file, with or without the word mark, by a dense number."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = (sp.id_to_piece(i) for i in range(sp.get_piece_size()))
    kept = sorted({p.lower() for p in pieces if p.replace(HEAD, "", 1).isalpha() or p == HEAD})
    return {p: i for i, p in enumerate(kept)}


class Lattice:
    """All cuts of a list of words of at most ``LONGEST_WORD`` letters, as blocks of
    edges (start, length, words, pieces).  A piece is found by the rolling hash of
    its letters; a letter that is no piece has an edge to the extra last piece."""

    def __init__(self, vocab: dict[str, int]):
        self.unknown, self.longest = len(vocab), max(map(len, vocab))
        codes, lens = self.codes(list(vocab))
        self.hashes = []
        for n in range(1, self.longest + 1):
            at = np.flatnonzero(lens == n)
            h = np.zeros(len(at), np.uint64)
            for i in range(n):
                h = h * MULTIPLIER + codes[at, i]
            order = np.argsort(h)
            self.hashes.append((h[order], at[order]))
        self.seen = np.zeros(1 << 20, bool)
        for h, _ in self.hashes:
            self.seen[self.slot(h)] = True

    @staticmethod
    def slot(h: np.ndarray) -> np.ndarray:
        return (h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(44)

    @staticmethod
    def codes(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Code points of the words, one row each, and their lengths."""
        lens = np.array([len(w) for w in words], np.int64)
        out = np.zeros((len(words), int(lens.max(initial=0))), np.uint64)
        out[np.arange(out.shape[1]) < lens[:, None]] = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
        return out, lens

    def blocks(self, words: list[str]) -> tuple[list[tuple], np.ndarray]:
        codes, lens = self.codes([HEAD + w for w in words])
        width, out = codes.shape[1], []
        h = np.zeros_like(codes)
        for n in range(1, min(self.longest, width) + 1):
            h = h[:, :width - n + 1] * MULTIPLIER + codes[:, n - 1:]
            inside = np.arange(n, width + 1) <= lens[:, None]
            row, at = np.nonzero(inside & (self.seen[self.slot(h)] if n > 1 else True))
            known, numbers = self.hashes[n - 1]
            mine = h[row, at]
            place = np.minimum(np.searchsorted(known, mine), max(len(known) - 1, 0))
            hit = known[place] == mine if len(known) else np.zeros(len(mine), bool)
            piece = np.where(hit, numbers[place] if len(known) else 0, self.unknown)
            if n > 1:
                row, at, piece = row[hit], at[hit], piece[hit]
            order = np.argsort(at, kind="stable")
            row, at, piece = row[order], at[order], piece[order]
            cut = np.searchsorted(at, np.arange(width + 1))
            out += [(i, n, row[cut[i]:cut[i + 1]], piece[cut[i]:cut[i + 1]]) for i in range(width) if cut[i + 1] > cut[i]]
        return sorted(out, key=lambda x: x[:2]), lens


def forward(blocks: list[tuple], lens: np.ndarray, probs: np.ndarray) -> np.ndarray:
    """alpha[position, word, language]: the summed probability of all cuts up to a position."""
    alpha = np.zeros((int(lens.max(initial=0)) + 1, len(lens), probs.shape[1]))
    alpha[0] = 1
    for i, n, row, piece in blocks:
        alpha[i + n, row] += alpha[i, row] * probs[piece]
    return alpha


def fit(words: list[str], counts: np.ndarray, vocab: dict[str, int], rounds: int = 4) -> np.ndarray:
    """Piece probabilities [piece, language] from word counts [word, language]."""
    size, langs = len(vocab) + 1, counts.shape[1]
    probs = np.full((size, langs), 1.0 / size)
    blocks, lens = Lattice(vocab).blocks(words)
    pieces = np.concatenate([b[3] for b in blocks]) if blocks else np.zeros(0, np.int64)
    rows = np.arange(len(words))
    for _ in range(rounds):
        alpha = forward(blocks, lens, probs)
        beta = np.zeros_like(alpha)
        beta[lens, rows] = counts / np.maximum(alpha[lens, rows], 1e-280)
        flows = [None] * len(blocks)
        for b in range(len(blocks) - 1, -1, -1):  # by falling start: all that leaves its end is known
            i, n, row, piece = blocks[b]
            flow = beta[i + n, row] * probs[piece]
            flows[b] = flow * alpha[i, row]
            beta[i, row] += flow
        flow = np.concatenate(flows) if flows else np.zeros((0, langs))
        expected = np.stack([np.bincount(pieces, weights=flow[:, k], minlength=size) for k in range(langs)], 1)
        probs = (expected + SMOOTHING) / (expected + SMOOTHING).sum(0)
        probs[-1] = FLOOR
    return probs


class Scorer:
    """Log probabilities of what stands between spaces, by language, behind a memo."""

    def __init__(self, langs: list[str], probs: np.ndarray, path: str):
        self.langs, self.probs, self.lattice = langs, probs, Lattice(vocabulary(path))
        self.row: dict[str, int] = {}  # row 0: no letter
        self.logs = np.zeros((1, len(langs)))

    def words(self, words: list[str]) -> np.ndarray:
        """The forward algorithm over many words, those of like length together."""
        out = np.zeros((len(words), len(self.langs)))
        order = sorted(range(len(words)), key=lambda i: len(words[i]))
        for at in range(0, len(order), 8192):
            some = order[at:at + 8192]
            blocks, lens = self.lattice.blocks([words[i] for i in some])
            out[some] = np.log(np.maximum(forward(blocks, lens, self.probs)[lens, np.arange(len(some))], 1e-300))
        return out

    def learn(self, chunks: set[str]) -> None:
        if len(self.row) > MEMO:
            self.row, self.logs = {}, self.logs[:1]
        chunks -= self.row.keys()
        parts = [(c, LETTERS(c)) for c in chunks]
        distinct = sorted({w for _, ws in parts for w in ws})
        logs, at = self.words(distinct), {w: i for i, w in enumerate(distinct)}
        of = np.repeat(np.arange(len(parts)), [len(ws) for _, ws in parts])
        each = logs[[at[w] for _, ws in parts for w in ws]] if len(of) else np.zeros((0, len(self.langs)))
        total = np.stack([np.bincount(of, weights=each[:, k], minlength=len(parts)) for k in range(len(self.langs))], 1)
        first = len(self.logs)
        self.logs = np.concatenate([self.logs, total])
        self.row.update((c, first + i if ws else 0) for i, (c, ws) in enumerate(parts))

    def texts(self, texts: list[str | None]) -> list[tuple[str, float]]:
        if not self.langs:
            return [("und", 0.0)] * len(texts)
        out, first, size = [], 0, 0
        for i, t in enumerate(texts):
            if i > first and size + len(t or "") > LETTERS_AT_ONCE:
                out += self.some(texts[first:i])
                first, size = i, 0
            size += len(t or "")
        return out + self.some(texts[first:])

    def some(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """The counts of words of all ``texts`` are held together."""
        counted = [Counter((t or "").lower().split(" ")) for t in texts]
        self.learn(set().union(*counted))
        out = []
        for chunks in counted:
            rows = [self.row[c] for c in chunks]
            if not any(rows):
                out.append(("und", 0.0))
                continue
            total = np.array(list(chunks.values()), float) @ self.logs[rows]
            best = int(total.argmax())
            out.append((self.langs[best], float(1 / np.exp(np.maximum(total - total[best], -700)).sum())))
        return out


class Model:
    """Languages in order, piece probabilities and the vocabulary file."""

    def __init__(self, langs: list[str], probs: np.ndarray, path: str):
        self.langs, self.probs, self.path = langs, probs, path


_SCORERS: dict[bytes, Scorer] = {}


def scorer(model: Model) -> Scorer:
    """One scorer for each model in a worker, so its memo lasts over batches."""
    key = model.probs.tobytes()[:4096] + "\0".join(model.langs).encode()
    if key not in _SCORERS:
        _SCORERS.clear()
        _SCORERS[key] = Scorer(model.langs, model.probs, model.path)
    return _SCORERS[key]


def train(learn: DataFrame, path: str, docs_per_lang: int = SAMPLE_DOCS, words_per_lang: int = SAMPLE_WORDS) -> Model:
    """Fit on ``learn`` (key, text, lang; rows without a language are ignored).  At
    most ``docs_per_lang`` texts of each language, those of the smallest key hash,
    and their ``words_per_lang`` commonest words are used."""
    rows = learn.where(F.col("lang").isNotNull() & F.col("key").isNotNull())
    ids = sample_per_class(rows.select("key", "lang").distinct(), "key", "lang", docs_per_lang)
    texts = rows.join(F.broadcast(ids), ["key", "lang"]).select("lang", "text")  # bounded: docs_per_lang keys a language

    def words(batch: pa.RecordBatch) -> pa.RecordBatch:
        n: Counter = Counter()
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            n.update((lang, w) for w in LETTERS((text or "").lower()))
        return pa.record_batch([pa.array([k[0] for k in n], pa.string()), pa.array([k[1] for k in n], pa.string()), pa.array(list(n.values()), pa.int64())], names=["lang", "word", "n"])

    counted = arrow_map(texts, words, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    w = Window.partitionBy("lang").orderBy(F.desc("n"), "word")
    got = counted.withColumn("r", F.row_number().over(w)).where(F.col("r") <= words_per_lang).select("lang", "word", "n").collect()
    langs = sorted({r["lang"] for r in got})
    known = sorted({r["word"] for r in got})
    at, of = {x: i for i, x in enumerate(known)}, {x: i for i, x in enumerate(langs)}
    counts = np.zeros((len(known), len(langs)))
    for r in got:
        counts[at[r["word"]], of[r["lang"]]] += r["n"]
    vocab = vocabulary(path)
    return Model(langs, fit(known, counts, vocab) if langs else np.zeros((len(vocab) + 1, 0)), path)


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """Language and score (posterior under equal priors) of each row of ``docs``
    (key, text).  A NULL text or one without letters is ``und`` with score 0, as is
    every text if nothing was learned; repeated rows are scored one by one."""
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        s = scorer(model)
        rows = s.texts(batch.column(1).to_pylist())
        return pa.record_batch([batch.column(0), pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.float64())], names=["key", "lang_pred", "score"])

    return arrow_map(docs.select("key", "text"), run, SCHEMA)


def keyed(docs: DataFrame, *more: str) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("key"), F.col("text").cast("string").alias("text"), *more)


def train_on_documents(docs: DataFrame, path: str) -> Model:
    return train(keyed(docs.where(crc_mod("doc_id", 4) != 2), "lang"), path)


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents")
    out = predict(keyed(docs), train_on_documents(docs, public_tokenizers.path("piece_bpe_32k.model")))
    return out.select(F.col("key").alias("doc_id"), F.coalesce(crc_mod("key", 4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")
