"""What a worker holds at once does not follow the size of a batch."""
import tracemalloc

import numpy as np
import public_tokenizers

from panelforge.llm import langid, ngram_join


def test_language_scorer_counts_few_texts_at_once(monkeypatch):
    path = public_tokenizers.path("piece_bpe_32k.model")
    r = np.random.default_rng(2)
    size = len(langid.vocabulary(path)) + 1
    probs = r.random((size, 3))
    words = ["".join(w) for w in r.choice(list("abcdefghij"), (3_000, 6))]
    texts = [" ".join(r.choice(words, 300)) for _ in range(60)] + [None, "", "1 2", " ".join(words)]
    whole = langid.Scorer(["a", "b", "c"], probs / probs.sum(0), path).texts(texts)
    held, learn = [], langid.Scorer.learn
    monkeypatch.setattr(langid.Scorer, "learn", lambda self, chunks: held.append(len(chunks)) or learn(self, chunks))
    monkeypatch.setattr(langid, "LETTERS_AT_ONCE", 5_000, raising=False)
    got = langid.Scorer(["a", "b", "c"], probs / probs.sum(0), path).texts(texts)
    assert got == whole and sorted(held)[-1] <= 3_000 and sorted(held)[-2] <= 800


def test_shingles_hash_few_texts_at_once():
    r = np.random.default_rng(4)
    texts = [" ".join(r.choice(["ab", "Cd", "efg", "h"], 400)) for _ in range(3_000)] + [None, "", "one two", " x "]
    tracemalloc.start()
    whole = ngram_join.shingles(texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 90 << 20
    for i in (0, 1, 1_500, 2_999, 3_000, 3_001, 3_002, 3_003):
        assert (whole[i] == ngram_join.shingles(texts[i:i + 1])[0]).all() and len(whole[i]) == len(ngram_join.shingles(texts[i:i + 1])[0])
