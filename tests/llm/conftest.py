import os
import random

import pytest

#: Columns that the operators must ignore although they use these names themselves.
CLASH = {"key": "x", "n": 1, "sig": "y", "score": 0.1, "spans": "z", "token": 5, "label": "w"}


def long_text(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join("".join(r.choice("etaoinshr") for _ in range(r.randint(2, 7))) for _ in range(n))


@pytest.fixture(scope="session")
def awkward(spark):
    """Nulls, empty, blank and very long texts, ties, repeated rows, clashing names."""
    base = long_text(1, 60)
    texts = [None, "", " \n\t ", "a", "one two three", base, base, base + " tail", base.upper(), long_text(2, 30000), "x" * 50000,
             "Ünïcödé ſ İ ΣΑΣ 漢字 \U0001f600 'll <|endoftext|>  two", "1234 !!", None, long_text(3, 40)]
    rows = [(i, t, ["en", "fr", None][i % 3], None if i == 4 else "s", len(t or "")) for i, t in enumerate(texts)]
    rows += [rows[5], (5, base, "en", "s", len(base)), (None, "no key at all here", "en", "s", 5), (900, "second text of a key", "en", "s", 3), (900, long_text(4, 20), "en", "s", 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    from pyspark.sql import functions as F
    for name, v in CLASH.items():
        df = df.withColumn(name, F.lit(v))
    return df


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")


def write(df, folder, name):
    path = os.path.join(str(folder), f"{name}.parquet")
    df.write.parquet(path)
    return str(folder)
