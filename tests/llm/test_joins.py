"""Operators on pairs, and the pipeline, against brute force."""
import random
import re

import numpy as np
import pytest
from conftest import long_text, write

from panelforge.llm import catalog, embedding_dedup, ngram_join
from panelforge.llm.components import components


def root_of(links, nodes):
    best = {k: k for k in nodes}

    def top(k):
        while best[k] != k:
            k = best[k]
        return k

    for a, b in links:
        x, y = sorted((top(a), top(b)))
        best[y] = x
    return {k: top(k) for k in nodes}


def test_components(spark):
    r = random.Random(4)
    edges = [(r.randint(0, 300), r.randint(0, 300)) for _ in range(180)] + [(i, i + 1) for i in range(1000, 1060)] + [(2000, 2000 + i) for i in range(1, 200)]
    nodes = {x for e in edges for x in e if e[0] != e[1]}
    got = {x["node"]: x["component"] for x in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: v for k, v in root_of(edges, nodes).items()}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# ---- 3 n-gram join -----------------------------------------------------------------

def shingle_sets(texts):
    out = []
    for t in texts:
        w = re.findall(rb"[^\x20\x09-\x0d]+", (t or "").encode().lower())
        out.append({b" ".join(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    return out


def brute_join(rows):
    sets = shingle_sets([t for _, t in rows])
    links = [(rows[i][0], rows[j][0]) for i in range(len(rows)) for j in range(i) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])]
    root = root_of(links, [k for k, _ in rows])
    return {k: (len(s), root[k]) for (k, _), s in zip(rows, sets)}


def family(seed, n, words, edits):
    """Near copies of one text, some nearer than the threshold and some not."""
    r = random.Random(seed)
    base = long_text(seed, words).split()
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(r.randint(0, edits)):
            w[r.randrange(len(w))] = f"w{r.random():.6f}"
        out.append(" ".join(w))
    return out


def test_join_equals_brute_force(spark, monkeypatch):
    r = random.Random(6)
    shared = long_text(77, 60)
    texts = family(1, 60, 120, 9) + family(2, 40, 40, 4) + family(3, 30, 12, 2) + [long_text(100 + i, 30) + " " + shared for i in range(25)] + [shared + " " + long_text(200 + i, r.randint(1, 25)) for i in range(40)]
    texts += [long_text(300 + i, 50) for i in range(20)] + ["a b", "a b", "A  B", "a c", "", None, "one", "ONE\n"] + texts[:5]
    r.shuffle(texts)
    rows = [(7 * i - 500, t) for i, t in enumerate(texts)]
    want = brute_join(rows)
    assert len({v for _, v in want.values()}) < len(rows) - 60
    got = {x["key"]: (x["n_shingles"], x["component_id"]) for x in ngram_join.join_components(spark.createDataFrame(rows, "key long, text string")).collect()}
    assert got == want


def test_join_without_proposals_is_still_whole(spark, monkeypatch):
    """All links come from the token-group matrix when no min-hash proposes any."""
    monkeypatch.setattr(ngram_join, "proposed", lambda sets: sets.selectExpr("id AS a", "id AS b", "0L AS agree").where("false"))
    rows = list(enumerate(family(4, 25, 60, 6) + [long_text(i, 30) for i in range(8)]))
    got = {x["key"]: (x["n_shingles"], x["component_id"]) for x in ngram_join.join_components(spark.createDataFrame(rows, "key long, text string")).collect()}
    assert got == brute_join(rows)


def test_op3_awkward(spark, awkward, empty, tmp_path):
    rows = ngram_join.op3_ngram_join(spark, write(awkward, tmp_path / "a", "documents")).collect()
    assert len(rows) == awkward.count()
    known = [(r["doc_id"], r["text"]) for r in awkward.where("doc_id < 900").dropDuplicates(["doc_id"]).collect()]
    want = brute_join(known)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows if r["doc_id"] is not None and r["doc_id"] < 900} == want
    assert [r["component_id"] for r in rows if r["doc_id"] is None] == [None] and {r["component_id"] for r in rows if r["doc_id"] == 900} == {900}
    assert ngram_join.op3_ngram_join(spark, write(empty, tmp_path / "b", "documents")).count() == 0


def test_shingles_ignore_only_ascii_case_and_space():
    a, b, c, d = ngram_join.shingles(["A b C d E", "a b\tc\x0bd e", "É b c d e", "é b c d e"])
    assert (a == b).all() and (c != d).all()
    assert not (ngram_join.shingles(["a b"])[0] == ngram_join.shingles(["ab"])[0]).any()
    assert len(ngram_join.shingles(["a\x1cb c d e f"])[0]) == 1 and ngram_join.shingles([]) == []


# ---- 4 embeddings --------------------------------------------------------------------

def brute_vectors(rows):
    def fine(v, label):
        return label is not None and v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)

    at = [i for i, (_, v, label) in enumerate(rows) if fine(v, label)]
    unit = {i: np.array(rows[i][1], float) / np.abs(rows[i][1]).max() for i in at}
    links = [(i, j) for i in at for j in at if j < i and rows[i][2] == rows[j][2] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] / np.linalg.norm(unit[i]) / np.linalg.norm(unit[j]) >= 0.93]
    n = [0] * len(rows)
    for i, j in links:
        n[i] += 1
        n[j] += 1
    root = root_of([(rows[i][0], rows[j][0]) for i, j in links], [k for k, *_ in rows])
    return {k: (n[i], root[k], root[k] == k) for i, (k, *_) in enumerate(rows)}


def check_vectors(spark, rows, folder):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").selectExpr("*", "1 AS node", "'x' AS dim", "2 AS mult")
    got = embedding_dedup.op4_embedding_dedup(spark, write(df, folder, "embeddings")).collect()
    assert len(got) == len(rows)
    return {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in got}


def test_forest_recall(spark, tmp_path, monkeypatch):
    """Deep trees on vectors near the threshold: recall of links over 0.9, none wrong."""
    monkeypatch.setattr(embedding_dedup, "LEAF", 16)
    r = np.random.default_rng(3)
    centres = r.standard_normal((60, 32))
    rows = [(i, (centres[i % 60] + r.standard_normal(32) * r.choice([0.05, 0.2, 0.3])).tolist(), i % 2) for i in range(900)]
    got, want = check_vectors(spark, rows, tmp_path), brute_vectors(rows)
    assert all(got[k][0] <= want[k][0] for k in want)
    assert sum(v[0] for v in got.values()) >= 0.9 * sum(v[0] for v in want.values()) > 0


def test_hot_vectors_and_blocks(spark, tmp_path):
    """Equal vectors, a dense cluster beyond the block size, and unfit vectors."""
    r = np.random.default_rng(5)
    base = r.standard_normal(16)
    rows = [(i, (base + 0.02 * r.standard_normal(16)).tolist(), 1) for i in range(700)] + [(1000 + i, base.tolist(), 1) for i in range(50)] + [(2000 + i, r.standard_normal(16).tolist(), 1 + i % 2) for i in range(60)]
    rows += [(3000, None, 1), (3001, [0.0] * 16, 1), (3002, [1.0, None], 1), (3003, [float("nan")] * 16, 1), (3004, base.tolist(), None), (3005, base.tolist(), 2), (3006, [], 1), (3007, [float("inf")] * 16, 1), (3008, base[:8].tolist(), 1), (3009, (base * 1e-200).tolist(), 1)]
    assert check_vectors(spark, rows, tmp_path / "a") == brute_vectors(rows)
    assert check_vectors(spark, [], tmp_path / "b") == {}


def test_given_vectors(spark):
    sf = "/root/testdata/sf0.01"
    rows = [(r["vec_id"], list(r["embedding"]), r["label"]) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    assert {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in embedding_dedup.op4_embedding_dedup(spark, sf).collect()} == brute_vectors(rows)


# ---- pipeline ----------------------------------------------------------------------

def test_pipeline_equals_its_parts(spark, tmp_path):
    """Every stage by brute force on what the stage before kept."""
    import public_tokenizers as P

    import corpus_pipeline
    from panelforge.llm import langid, secrets, toxicity
    from panelforge.llm.common import store
    from panelforge.llm.toxicity import keyed

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    docs = docs.unionByName(spark.createDataFrame([(100000, "12345 !!", "en", "s", 8), (100001, None, None, None, None)], docs.schema))
    stages = dict(corpus_pipeline.STAGES)
    rows = lambda df: sorted(map(tuple, df.collect()), key=str)

    one = store(stages["language_id"](spark, docs, sf), "t")
    assert one.columns == docs.columns and one.where("doc_id >= 100000").count() == 0
    scores = langid.predict(langid.keyed(docs), langid.train_on_documents(docs, P.path("piece_bpe_32k.model"))).where("lang_pred <> 'und' AND score >= 0.5")
    assert sorted(r[0] for r in rows(one)) == sorted(r["key"] for r in scores.collect())

    two = store(stages["toxicity"](spark, one, sf), "t")
    model = toxicity.train_on_labels(one, spark.read.parquet(f"{sf}/labels.parquet"))
    assert sorted(r[0] for r in rows(two)) == sorted(r["key"] for r in toxicity.score(keyed(one), model).where("score < 0.5").collect())

    three = store(stages["ngram_join"](spark, two, sf), "t")
    want = brute_join([(r["doc_id"], r["text"]) for r in two.collect()])
    assert sorted(r[0] for r in rows(three)) == sorted(k for k, (_, c) in want.items() if k == c)

    four = store(stages["secret_scan"](spark, three, sf), "t")
    assert four.columns == docs.columns
    assert {r["doc_id"]: r["text"] for r in four.collect()} == {r["doc_id"]: secrets.redacted(r["text"]) for r in three.collect()}
    assert four.where("text IS NOT NULL AND n_chars <> char_length(text)").count() == three.where("text IS NOT NULL AND n_chars <> char_length(text)").count()

    five = stages["packing"](spark, four, sf)
    assert {r["doc_id"] for r in five.select("doc_id").collect()} == {r["doc_id"] for r in four.select("doc_id").collect()}


def test_rows_that_share_a_doc_id_are_not_linked_by_it(spark):
    """The near copy under a repeated id goes, whatever the order; the unique texts stay."""
    import corpus_pipeline

    base, other, third = long_text(41, 80), long_text(42, 50), long_text(43, 50)
    rows = [(3, base, "s"), (7, base + " tail", "s"), (7, other, "s"), (7, other, "t"), (7, third, "s"), (9, third + " end", "s"), (9, None, "s"), (9, long_text(44, 30), "s"),
            (2, base.upper() + " x", "s"), (2, base.upper(), "s"), (None, base, "s"), (None, base, "s"), (11, "", "s"), (12, None, "s")]
    want = {(7, other), (7, third), (9, None), (9, long_text(44, 30)), (None, base), (11, ""), (12, None)}
    seen = set()
    for order in (rows, rows[::-1], rows[5:] + rows[:5]):
        docs = spark.createDataFrame(order, "doc_id long, text string, key string").repartition(3, "text")
        got = corpus_pipeline.near_duplicates(spark, docs, "").collect()
        seen.add(frozenset(map(tuple, got)))
        texts = [(r["doc_id"], r["text"]) for r in got]
        assert want <= set(texts) and len(texts) == len(want) + 2 and texts.count((None, base)) == 2
        assert [t for k, t in texts if k == 2] in ([base.upper()], [base.upper() + " x"]) and not any(k == 3 for k, _ in texts)
    assert len(seen) == 1


def test_pipeline_takes_awkward_rows(spark, awkward, empty, tmp_path):
    import corpus_pipeline

    labels = spark.createDataFrame([(3, 1), (5, 0)], "doc_id long, toxic int")
    for name, docs in (("a", awkward), ("b", empty)):
        folder = write(docs, tmp_path / name, "documents")
        write(labels, tmp_path / name, "labels")
        out = corpus_pipeline.run(spark, folder)
        assert "sequence_id" in out.columns and (out.count() > 0) == (name == "a")


@pytest.mark.parametrize("n", range(1, 11))
def test_each_operator_has_a_query(n):
    assert sum(k.startswith(f"op{n}_") for k in catalog.QUERIES) == 1


def test_near_duplicates_leave_a_column_named_like_the_helper(spark):
    import corpus_pipeline

    text = "one two three four five six seven"
    rows = [(1, text, "x", "m"), (1, text, "x", "m"), (1, "other words of the same key stand here", "y", "m"), (2, text, "z", "m"), (None, text, "w", "m")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _row string, _row_ string")
    got = corpus_pipeline.near_duplicates(spark, docs, "")
    assert got.columns == docs.columns
    assert sorted((r["doc_id"] or 0, r["_row"], r["_row_"]) for r in got.collect()) == [(0, "w", "m"), (1, "x", "m"), (1, "y", "m")]
