"""Best-fit packing, embedding whitening and source divergence against brute force."""
import bisect
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import pytest
from conftest import write
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from panelforge.llm import bestfit, divergence, whitening

SF = "/root/testdata/sf0.001"


# ---- 11 best-fit decreasing --------------------------------------------------

def rooms_piece_by_piece(lengths, window):
    rooms = []
    for n in sorted(lengths, reverse=True):
        i = bisect.bisect_left(rooms, n)
        left = (rooms.pop(i) if i < len(rooms) else window) - n
        bisect.insort(rooms, left)
    return rooms


def test_best_fit_equals_piece_by_piece():
    r = random.Random(5)
    for t in range(1500):
        window = r.choice([4, 16, 33, 64, 100])
        lengths = [r.randint(1, window) if t % 3 else r.choice([1, 2, window // 2, window]) for _ in range(r.randint(0, 80))]
        packing = bestfit.best_fit(Counter(lengths), window)
        assert sorted(window - sum(a * b for a, b in fill) for fill, many in packing for _ in range(many)) == rooms_piece_by_piece(lengths, window)
        used = Counter()
        for fill, many in packing:
            for length, times in fill:
                used[length] += times * many
        assert used == Counter(lengths)


def test_segment_tree_finds_the_tightest():
    r = random.Random(6)
    bins, held = bestfit.OpenBins(50), []
    for _ in range(2000):
        if held and r.random() < 0.5:
            room = held.pop(r.randrange(len(held)))
            bins.pop(room)
        else:
            room = r.randint(0, 50)
            held.append(room)
            bins.push(room, room)
        length = r.randint(1, 50)
        assert bins.tightest(length) == min((x for x in held if x >= length), default=None)


def test_places_of_a_large_histogram_are_whole():
    histogram = {n: int(10**9 / n**1.3) for n in range(1, 2049)}
    packing = bestfit.best_fit(histogram)
    assert sum(many for _, many in packing) <= 1.01 * sum(n * k for n, k in histogram.items()) / 2048
    at = bestfit.places(packing)
    assert all((np.diff(v[:, 0]) > 0).all() and v[0, 0] == 0 for v in at.values())


def check_pieces(rows, texts):
    lib = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    want = Counter()
    for key, text in texts:
        ids = [*lib.encode(text, add_special_tokens=False).ids, 0]
        first = len(ids) % 2048 or 2048
        starts = [0, *range(first, len(ids), 2048)]
        for i, (a, b) in enumerate(zip(starts, [*starts[1:], len(ids)])):
            want[(key, i, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes()))] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == want
    sequences = defaultdict(list)
    for r in rows:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in sequences.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= 2048
    assert len(sequences) == len(rooms_piece_by_piece([r["length"] for r in rows], 2048))


def test_op11_rows(spark, awkward, empty, tmp_path):
    texts = [(r["doc_id"], r["text"] or "") for r in awkward.collect()]
    check_pieces(bestfit.op11_best_fit(spark, write(awkward.repartition(5), tmp_path / "a", "documents")).collect(), texts)
    assert bestfit.op11_best_fit(spark, write(empty, tmp_path / "b", "documents")).count() == 0


def test_op11_shipped_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    check_pieces(bestfit.op11_best_fit(spark, SF).collect(), [(r["doc_id"], r["text"] or "") for r in docs.collect()])


# ---- 12 whitening --------------------------------------------------------------

KINDS = "vec_id long, embedding array<float>, label int, n long, w string, index int"


def vectors(spark, rows):
    return spark.createDataFrame([(k, v, 0, 7, "x", 3) for k, v in rows], KINDS)


def brute(rows):
    kept = [(k, v) for k, v in rows if v and all(c is not None and np.isfinite(c) for c in v)]
    x = np.floor(1024 * np.array([v for _, v in kept], np.float32).astype(float)).astype(np.int64) + 100000
    n, s = len(x), x.sum(0)
    off = n * x - s
    y = off / n
    cov = y.T @ y / n
    e, vec = np.linalg.eigh(cov)
    order = np.argsort(-e)
    return [k for k, _ in kept], n, (off.astype(object) ** 2).sum(1), y @ vec[:, order] / np.sqrt(np.maximum(e[order], 1e-300)), e[order] / np.trace(cov)


def check_whitened(got, rows, components):
    ids, n, deviation, white, explained = brute(rows)
    assert len(got) == len(ids) * components and {r["n"] for r in got} == {n}
    by_id = defaultdict(dict)
    for r in got:
        by_id[r["vec_id"]][r["component"]] = r
    for i, key in enumerate(ids):
        for c in range(components):
            r = by_id[key][c + 1]
            assert r["deviation"] == deviation[i] and r["explained"] == pytest.approx(explained[c], rel=1e-9)
            sign = np.sign(sum(by_id[k][c + 1]["whitened"] * white[j, c] for j, k in enumerate(ids)))
            assert r["whitened"] == pytest.approx(sign * white[i, c], abs=1e-7)
    assert len({r["identity_error"] for r in got}) == 1 and got[0]["identity_error"] < 1e-9


def test_whitening_against_numpy(spark):
    rng = np.random.default_rng(2)
    rows = [(i, (rng.normal(size=11) * np.arange(1, 12) / 20 + 0.3).astype(np.float32).tolist()) for i in range(300)]
    rows += [(1000, None), (1001, []), (1002, [float("nan")] * 11), (1003, [0.1] * 10 + [float("inf")]), (1004, [0.1] * 10 + [None]), (1005, [0.5] * 4)]
    usable = [(k, v) for k, v in rows if k < 1000]
    check_whitened(whitening.whiten(vectors(spark, rows).repartition(7)).collect(), usable, 8)


def test_whitening_takes_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(whitening, "ENTRIES", 64)
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=5).astype(np.float32).tolist()) for i in range(200)]
    check_whitened(whitening.whiten(vectors(spark, rows).repartition(3)).collect(), rows, 5)


def test_whitening_without_variance(spark):
    one = whitening.whiten(vectors(spark, [(4, [0.25, -0.5])])).collect()
    assert [(r["vec_id"], r["component"], r["n"], r["deviation"], r["whitened"], r["explained"], r["identity_error"]) for r in one] == [(4, 1, 1, 0, 0.0, 0.0, 0.0), (4, 2, 1, 0, 0.0, 0.0, 0.0)]
    flat = whitening.whiten(vectors(spark, [(i, [float(i), 2.0 * i, 1.0]) for i in range(6)] + [(2, [2.0, 4.0, 1.0])])).collect()
    assert {r["whitened"] for r in flat if r["component"] > 1} == {0.0} and len(flat) == 21
    assert sum(r["whitened"] ** 2 for r in flat if r["component"] == 1) / 7 == pytest.approx(1)


def test_whitening_empty_and_extreme(spark, tmp_path):
    assert whitening.op12_whitening(spark, write(vectors(spark, []), tmp_path / "a", "embeddings")).count() == 0
    assert whitening.whiten(vectors(spark, [(1, None)])).count() == 0
    far = whitening.whiten(vectors(spark, [(None, [3e38, 0.0]), (2, [-3e38, 1.0])])).collect()
    assert len(far) == 4 and {r["deviation"] for r in far} == {None}  # beyond a long


def test_deviation_is_exact_beyond_floats():
    x = np.array([[10**9 + 7, 3], [5, 10**9]], np.int64)
    s = [int(v) for v in x.sum(0)]
    assert whitening.exact_deviation(x, 2, s) == [sum((2 * int(a) - b) ** 2 for a, b in zip(row, s)) for row in x]


# ---- 13 source divergence ---------------------------------------------------------

def divergence_by_hand(docs, least=3, top=200):
    counts, seen, groups = defaultdict(Counter), defaultdict(Counter), set()
    for lang, source, text in docs:
        lang, source, text = lang or "", source or "", text or ""
        terms = [re.sub("[A-Z]", lambda m: m.group().lower(), t) for t in re.findall("[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text)]
        groups.add((lang, source))
        counts[(lang, source)].update(terms)
        seen[lang].update(set(terms))
    out = set()
    for lang in {g[0] for g in groups}:
        kept = sorted(t for t, n in seen[lang].items() if n >= least)
        sources = sorted(s for g, s in groups if g == lang)
        whole = Counter()
        for s in sources:
            whole.update(counts[(lang, s)])

        def shares(c):
            total = sum(c[t] for t in kept)
            return {t: 1 + 10**9 * (c[t] + 1) // (total + len(kept)) for t in kept}

        q, p = shares(whole), {s: shares(counts[(lang, s)]) for s in sources}
        f = lambda a, b: (a - b) ** 2 // b
        rank = lambda items: sorted(items, key=lambda x: (-x[1], x[0].encode()))
        for s in sources:
            pairs = rank([(o, sum(f(p[s][t], p[o][t]) for t in kept)) for o in sources if o != s])
            terms = rank([(t, f(p[s][t], q[t])) for t in kept if counts[(lang, s)][t] and p[s][t] > q[t]])[:top]
            out |= {(lang, s, "pair", item, v, i + 1) for i, (item, v) in enumerate(pairs)}
            out |= {(lang, s, "term", item, v, i + 1) for i, (item, v) in enumerate(terms)}
    return out


def made_documents(seed, n):
    r = random.Random(seed)
    words = ["the", "The", "ÉTÉ", "été", "x", "straße", "漢字", "İ", "a1b", "don't", "\x7f", "z\x00q", " ", "end."]
    rows = []
    for _ in range(n):
        lang, source = r.choice(["en", "fr", None, ""]), r.choice(["s0", "s0", "s0", "s1", "S1", "é", None])
        rows.append((lang, source, r.choice([None, "", "12 34", " ".join(r.choice(words + ["w%d" % r.randint(0, 30)]).replace("%", "") for _ in range(r.randint(0, 40)))])))
    return rows


@pytest.mark.parametrize("pairs", [1 << 20, 7])
def test_divergence_by_hand(spark, monkeypatch, pairs):
    monkeypatch.setattr(divergence, "PAIRS", pairs)
    docs = made_documents(4, 150)
    df = spark.createDataFrame([(*d, i, 1, "t", 0.5) for i, d in enumerate(docs)], "lang string, source string, text string, doc_id long, n long, term string, p double")
    got = divergence.divergence(df.repartition(6)).collect()
    assert {tuple(r) for r in got} == divergence_by_hand(docs) and len(got) == len({tuple(r) for r in got})


def test_divergence_top_and_ties(spark):
    docs = [("en", s, " ".join(f"{a}{b}" for a in "abcdefghij" for b in "klmnopqrstuvwxyz" if (a < "f") == (s == "a"))) for s in "ab" for _ in range(3)]
    df = spark.createDataFrame(docs, "lang string, source string, text string")
    got = {tuple(r) for r in divergence.divergence(df, top=5).collect()}
    assert got == divergence_by_hand(docs, top=5) and sum(r[2] == "term" for r in got) == 10


def test_term_counts_of_long_texts(monkeypatch):
    text = ("Ab cdé-" * 5000 + "x" * 3000 + " tail").encode()
    whole = divergence.term_counts(text)
    monkeypatch.setattr(divergence, "SLICE", 100)
    assert divergence.term_counts(text) == whole
    assert {k.decode(): v for k, v in whole.items()} == Counter(re.findall("[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text.decode().lower()))


def test_divergence_flushes_and_awkward_rows(spark, monkeypatch, awkward, empty, tmp_path):
    assert divergence.op13_divergence(spark, write(empty, tmp_path / "a", "documents")).count() == 0
    docs = [(r["lang"], r["source"], r["text"]) for r in awkward.collect()]
    got = {tuple(r) for r in divergence.op13_divergence(spark, write(awkward, tmp_path / "b", "documents")).collect()}
    assert got == divergence_by_hand(docs)
    lone = spark.createDataFrame([("en", "s", None)], "lang string, source string, text string")
    assert divergence.divergence(lone).count() == 0


def test_shares_are_exact_in_decimals(spark):
    big = [(9 * 10**12, 9 * 10**13, 10**7), (0, 0, 0), (0, 3, 10**9), (5, 5, 1)]
    df = spark.createDataFrame(big, "n long, total long, v long")
    got = [r[0] for r in df.select(divergence.share(F.col("n"), F.col("total"), F.col("v"))).collect()]
    assert got == [1 + 10**9 * (n + 1) // (t + v) if t + v else 1 for n, t, v in big]
