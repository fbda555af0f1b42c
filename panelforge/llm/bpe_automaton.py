"""BPE encoding and decoding through a tokenization automaton.

The merges are compiled, in rank order, into a deterministic automaton over
tokens.  It starts with one arc for each base symbol from every state to the
state of that symbol.  The gadget of merge k = (u, v) -> w does two things: it
adds an arc labelled w, and it removes the arc v after u for every state whose
token still ended in a live u when merge k was due and every token that still
began with a live v.  A state is the last token read, and an arc x -> y is
missing exactly if some gadget removed it.

The arcs that a gadget removes are kept in factored form: for each token, the
symbols on its right (left) edge with the ranks at which each was born and
consumed.  ``Automaton.step`` intersects two such edges through the merge table.
A word is encoded by the one path of arcs that spells it, found by table look-ups
alone; decoding emits the labels of the arcs.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WS, Memo, arrow_map, table

NEVER = 1 << 60
SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def byte_symbols() -> list[str]:
    """The printable symbol of each byte in byte-level vocabularies: printable
    Latin-1 characters stand for themselves, the others for U+0100 and up."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    out, n = [""] * 256, 0
    for b in range(256):
        if b in own:
            out[b] = chr(b)
        else:
            out[b] = chr(256 + n)
            n += 1
    return out


class Automaton:
    """Tokenization automaton of a merge list.  ``end`` marks the last symbol of a word."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], end: str = ""):
        self.vocab, self.end = vocab, end
        self.label = {i: t for t, i in vocab.items()}
        self.rank: dict[tuple[int, int], int] = {}
        built: dict[int, tuple[int, int, int]] = {}
        for k, (a, b) in enumerate(merges):
            u, v, w = vocab[a], vocab[b], vocab[a + b]
            self.rank[u, v] = k
            built.setdefault(w, (k, u, v))
        # An arc label is a base symbol or a token that some gadget adds.
        base = {s + e for s in byte_symbols() for e in ("", end)}
        self.built = built
        self.arcs: dict = {}  # arc labels as a tree of symbols: "in" and "end" lead to the token within and at the end of a word
        for t, i in vocab.items():
            if i in built or t in base:
                whole = bool(end) and t.endswith(end) and t != end
                node = self.arcs
                for c in t[:-len(end)] if whole else t:
                    node = node.setdefault(c, {})
                for place in (("end",) if whole else ("in",) if end else ("in", "end")):
                    node[place] = i
        self._right: dict[int, list[tuple[int, int, int]]] = {}
        self._left: dict[int, list[tuple[int, int, int]]] = {}
        self._steps: dict[int, bool] = {}

    def _edge(self, token: int, side: int, memo: dict) -> list[tuple[int, int, int]]:
        """(symbol, born, consumed) from the whole token down to its outermost base symbol."""
        found = memo.get(token)
        if found is None:
            found, at, until = [], token, NEVER
            while at is not None:
                k, *parts = self.built.get(at, (-1, None, None))
                found.append((at, k, until))
                at, until = parts[side], k
            memo[token] = found
        return found

    def step(self, x: int, y: int) -> bool:
        """Whether the arc y leaves state x."""
        key = x << 32 | y
        known = self._steps.get(key)
        if known is None:
            known = True
            for u, born_u, dies_u in self._edge(x, 1, self._right):
                for v, born_v, dies_v in self._edge(y, 0, self._left):
                    k = self.rank.get((u, v))
                    # Equal ranks are the same pair twice; the left one is merged first.
                    if k is not None and (due := max(k, born_u, born_v)) < dies_u and due <= dies_v:
                        known = False
            if len(self._steps) > 2_000_000:
                self._steps.clear()
            self._steps[key] = known
        return known

    def leaving(self, word: str, i: int) -> list[tuple[int, int]]:
        """(end, token) of the labels that match ``word`` at ``i``, longest last."""
        node, n, found = self.arcs, len(word), []
        while i < n:
            node = node.get(word[i])
            if node is None:
                break
            i += 1
            t = node.get("in" if i < n else "end")
            if t is not None:
                found.append((i, t))
        return found

    def encode(self, word: str) -> list[int]:
        """Token ids of one pre-split word given in symbols: the labels of the one
        path that spells it.  Longer arcs are tried first; as each prefix has one
        path, a position that leads nowhere is never entered again."""
        n, steps, path, back, dead = len(word), self._steps, [], [], set()
        i, state, found = 0, -1, self.leaving(word, 0)
        while i < n:
            while found:
                j, t = found.pop()
                if j in dead:
                    continue
                if state < 0 or (known := steps.get(state << 32 | t)) or known is None and self.step(state, t):
                    path.append(t)
                    back.append((i, state, found))
                    i, state, found = j, t, self.leaving(word, j)
                    break
            else:
                if not back:
                    raise ValueError(f"{word!r} holds a symbol that is not in the vocabulary")
                dead.add(i)
                path.pop()
                i, state, found = back.pop()
        return path

    def labels(self, ids: list[int]) -> list[str]:
        return [self.label[i] for i in ids]


class WordTokenizer:
    """The normalizer, pre-split and special tokens of a tokenizer file around its automaton."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        merges = [tuple(m if isinstance(m, list) else m.split(" ")) for m in model["merges"]]
        self.automaton = Automaton(model["vocab"], merges, model.get("end_of_word_suffix") or "")
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")")
        self.split = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^" + WS + r"\p{L}\p{N}]+").findall
        self.symbols = byte_symbols()
        self.chunks = Memo(self.chunk, 250_000)

    @staticmethod
    def normal(text: str) -> str:
        """NFC, then lower case letter by letter (no final sigma).  White space only
        separates words, so runs of it need no folding."""
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        return text.lower()

    def word(self, word: str) -> tuple[int, str, str]:
        """Number of ids, the ids and the labels, each joined by spaces."""
        ids = self.automaton.encode("".join([self.symbols[b] for b in word.encode()]))
        return len(ids), " ".join(map(str, ids)), " ".join(self.automaton.labels(ids))

    def chunk(self, chunk: str) -> tuple[int, str, str]:
        """The same for what stands between two spaces; no word crosses one."""
        if chunk.isalpha():
            return self.word(chunk)
        words = [self.chunks[w] if w != chunk else self.word(w) for w in self.split(chunk)]
        counts, ids, labels = zip(*words) if words else ((), (), ())
        return sum(counts), " ".join(ids), " ".join(labels)

    def text(self, text: str) -> tuple[int, str, str]:
        words: list[tuple[int, str, str]] = []
        for part in self.cut.split(text) if "<|" in text else [text]:
            if part in self.special:
                words.append((1, str(self.special[part]), part))
            else:
                words += map(self.chunks.__getitem__, self.normal(part).split(" "))
        words = [w for w in words if w[0]]
        if not words:
            return 0, "", ""
        counts, ids, labels = zip(*words)
        return sum(counts), " ".join(ids), " ".join(labels)


@lru_cache(maxsize=2)
def tokenizer(path: str) -> WordTokenizer:
    return WordTokenizer(path)


def encode_decode(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: the ids (array of int) and the decoded text.  A NULL
    text counts as empty and has no ids; repeated rows each keep their row; other
    columns, whatever their names, are left out."""
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        tok = tokenizer(path)
        rows = [tok.text(t or "") for t in batch.column(1).to_pylist()]
        return pa.record_batch([batch.column(0), pa.array([[int(x) for x in ids.split()] for _, ids, _ in rows], pa.list_(pa.int32())),
                                pa.array([d for *_, d in rows], pa.string())], names=["key", "ids", "decoded"])

    src = docs.select(F.col(key).cast("long").alias("key"), F.col(text).cast("string").alias("text"))
    return arrow_map(src, run, "key long, ids array<int>, decoded string").withColumnRenamed("key", key)


def digests(docs: DataFrame, path: str) -> DataFrame:
    """Per document the number of ids and the digests of its ids and of its decoded
    text.  They are taken where the text is encoded, so ids never leave the task."""
    def sha(x: str) -> str:
        return hashlib.sha256(x.encode("utf-8", "surrogatepass")).hexdigest()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        tok = tokenizer(path)
        n, a, b = [], [], []
        for t in batch.column(1):
            count, ids, decoded = tok.text(t.as_py() or "")
            n.append(count)
            a.append(sha(ids))
            b.append(sha(decoded))
        return pa.record_batch([batch.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())],
                               names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return arrow_map(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), run, SCHEMA)


def op10_bpe_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return digests(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
