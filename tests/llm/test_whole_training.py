"""What operators learn comes from all rows."""
from collections import Counter

import pytest

from panelforge.llm import licenses


def test_op5_background_holds_every_line(spark):
    """More lines than the 2,000 that used to be learned from; equal ones are counted."""
    lines = [f"the door of house {i} is kept in part {i % 7}" for i in range(5000)] + ["above the notice"] * 700 + ["", "  "]
    lines += [f"a copyright lawyer of town {i}" for i in range(2500)] + ["a copyright lawyer of town 1", "Licensed under the MIT License."]
    docs = spark.createDataFrame([(i, "\n".join(lines[i::50])) for i in range(50)] + [(50, None)], "key long, text string")
    some = licenses.background(docs)
    n = {r["kind"]: r["n"] for r in some.groupBy("kind").agg({"n": "sum"}).withColumnRenamed("sum(n)", "n").collect()}
    assert n[licenses.PLAIN] == 5700 and n[licenses.GATED] == 2502
    fitted = some.where("kind = -1 AND fitted").agg({"n": "sum"}).first()[0]
    assert sum(v for k, v in n.items() if k >= 0) == fitted  # each surrounds one template
    assert 0 < fitted < 5700
    notice = [r["n"] for r in some.where("kind = -1").collect() if r["some"] == sorted(["above", "the", "notice", "above the", "the notice", "above the notice"])]
    assert notice == [700]
    assert licenses.unlike(some).count() == 2500  # distinct, without the notice


def test_op5_known_grams_equal_plain_loops(spark):
    rows = [(["a", None, "b", "c", "d", "b", "c"],), ([],), ([None],), (["x"],), (["x", "y"],)]
    df = spark.createDataFrame(rows, "w array<string>").select("w", licenses.known_grams("w").alias("g"))
    for r in df.collect():
        w = r["w"]
        want = {" ".join(w[i:i + k]) for k in (1, 2, 3) for i in range(len(w) - k + 1) if None not in w[i:i + k]}
        assert r["g"] == sorted(want)


def test_op5_allowed_equals_sorting():
    values = [0.0] * 5000 + [0.9, 0.8, 0.8, 0.7, 0.6, 0.6]
    counted = [(v, n) for v, n in Counter(values).items()]
    for share in (0.0, 0.0002, 0.0005, 0.001, 0.01):
        got = licenses.allowed(counted, share)
        assert sum(v > got for v in values) <= share * len(values)
        assert all(sum(v > x for v in values) > share * len(values) for x in set(values) if x < got)
    assert licenses.allowed([], 0.001) == 0.0 == pytest.approx(0)


def test_store_compresses_as_asked(spark):
    from panelforge.llm.common import store

    stored = store(spark.range(100), "codec", "zstd")
    assert stored.count() == 100 and all(".zstd." in f for f in stored.inputFiles())
