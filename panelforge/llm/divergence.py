"""Divergence of sources within a language, from smoothed term shares.

Tokenizing is one pass of ``bytes.translate``: its table lowers A-Z and turns every
other ASCII byte into a space (bytes of other code points stay), ``bytes.split`` cuts
the terms and a ``Counter`` for each document counts them.  A task adds up the
counters of its documents by (lang, source) and hands on (lang, source, term, count,
documents) rows; Spark adds these up.  Everything after that runs on the sparse
counts, in exact integers:

* a share is p = 1 + floor(10^9 (count + 1) / (N + V)), in decimals;
* the sum over all kept terms of f(p, q) = floor((p - q)^2 / q) for a pair of sources
  is  V f(p0, q0)  for terms that neither holds (p0, q0: the shares of a count of 0),
  plus  f(p, q0) - f(p0, q0)  for each term of the one and  f(p0, q) - f(p0, q0)  for
  each of the other, taken from how often each share occurs in a source, plus
  f(p, q) - f(p, q0) - f(p0, q) + f(p0, q0)  for each term that both hold.  Only the
  last one looks at a term's sources together, in numpy, added up by pair in each task.

A NULL text, lang or source counts as ''.  A document without terms still makes its
group.  Repeated rows count each, also as documents.  A very long text is counted in
slices cut at spaces.  Ties are ranked by item in UTF-8 order.  An empty table gives
no row; other columns, doc_id too, are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import bounded, if_small, store, table

LEAST_DOCUMENTS = 3
TOP = 200
UNIT = 1_000_000_000
#: Letters lowered, every other ASCII byte a space, bytes of longer code points kept.
TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
SLICE = 4 << 20
#: Entries that a task's counters hold before they are handed on, and pairs compared at once.
ENTRIES = 200_000
PAIRS = 1 << 20
COUNTS = "lang string, source string, term string, n long, docs long"


def term_counts(text: bytes) -> Counter:
    """The terms of one UTF-8 text and their counts."""
    low = text.translate(TABLE)
    if len(low) <= SLICE:
        return Counter(low.split())
    out, at = Counter(), 0
    while at < len(low):
        end = low.find(b" ", at + SLICE)
        end = len(low) if end < 0 else end
        out.update(low[at:end].split())
        at = end
    return out


def source_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs) rows to be added up.  Each group has a row of the
    empty term with counts 0, which stands for the group itself."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], dict[bytes, list[int]]] = {}
        entries = 0

        def flush() -> Iterator[pa.RecordBatch]:
            for (lang, source), terms in held.items():
                n = len(terms)
                columns = [pa.array([lang] * n, pa.string()), pa.array([source] * n, pa.string()), pa.array([t.decode() for t in terms], pa.string()),
                           *(pa.array([v[i] for v in terms.values()], pa.int64()) for i in (0, 1))]
                yield pa.record_batch(columns, names=[c.split()[0] for c in COUNTS.split(", ")])
            held.clear()

        for batch in (b for whole in batches for b in bounded(whole)):
            texts = batch.column(2).cast(pa.binary())
            for lang, source, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), texts):
                terms = held.setdefault((lang, source), {b"": [0, 0]})
                before = len(terms)
                for term, n in term_counts(text.as_py()).items():
                    have = terms.get(term)
                    if have is None:
                        terms[term] = [n, 1]
                    else:
                        have[0] += n
                        have[1] += 1
                entries += len(terms) - before
                if entries > ENTRIES:
                    yield from flush()
                    entries = 0
        yield from flush()

    whole = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")]
    return docs.select(*whole).mapInArrow(run, COUNTS)


def share(count: Column, total: Column, kept: Column) -> Column:
    """1 + floor(10^9 (count + 1) / (total + kept)), exact; 1 without kept terms."""
    above = F.lit(UNIT).cast("decimal(10,0)") * (count + 1).cast("decimal(19,0)")
    below = (total + kept).cast("decimal(19,0)")
    # The remainder is exact in decimals, so the division leaves none.
    exact = F.call_function("div", above, F.when(below > 0, below))
    return F.lit(1).cast("long") + F.coalesce(exact, F.lit(0)).cast("long")


def distance(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / q) of shares (at most 10^9 + 1, so the square fits a long)."""
    return F.call_function("div", (p - q) * (p - q), q)


def shares_of(docs: DataFrame, least: int = LEAST_DOCUMENTS) -> tuple[DataFrame, DataFrame]:
    """(groups, shares): every (lang, source) with its index, N, V and zero share; every
    kept term that a group holds with the group's share and the language's."""
    counts = store(source_counts(docs).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")), "terms")
    kept = counts.where("term <> ''").groupBy("lang", "term").agg(F.sum("n").alias("lang_n"), F.sum("docs").alias("docs")).where(F.col("docs") >= least).drop("docs")
    kept = store(kept, "kept")
    langs = store(kept.groupBy("lang").agg(F.sum("lang_n").alias("lang_total"), F.count(F.lit(1)).alias("v")), "langs")
    held = store(counts.join(kept, ["lang", "term"]).select("lang", "source", "term", "n", "lang_n"), "held")
    totals = held.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    zero = F.lit(0).cast("long")
    groups = counts.where("term = ''").select("lang", "source").join(totals, ["lang", "source"], "left").join(langs, "lang", "left")
    groups = groups.select("lang", "source", (F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1).cast("long").alias("at"),
                           F.coalesce("total", zero).alias("total"), F.coalesce("v", zero).alias("v"), F.coalesce("lang_total", zero).alias("lang_total"))
    groups = store(groups.withColumn("p0", share(F.lit(0), F.col("total"), F.col("v"))), "groups")
    with_p = held.join(if_small(groups, 200), ["lang", "source"]).select(
        "lang", "source", "term", "at", "p0", share(F.col("n"), F.col("total"), F.col("v")).alias("p"), share(F.col("lang_n"), F.col("lang_total"), F.col("v")).alias("q"))
    return groups, store(with_p, "shares")


def common_terms(shares: DataFrame) -> DataFrame:
    """(lang, a, b, value): what the terms that both sources hold add to the pair."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def f(p, q):
            return (p - q) * (p - q) // q

        for batch in batches:
            size = batch.column(1).value_lengths().to_numpy().astype(np.int64)
            at, p, p0 = (c.to_numpy() for c in batch.column(1).flatten().flatten())
            first = np.concatenate([[0], np.cumsum(size)])[:-1]
            langs = batch.column(0).to_pylist()
            names = {lang: i for i, lang in enumerate(dict.fromkeys(langs))}
            lang = np.repeat([names[x] for x in langs], size)
            # Each held (term, source) meets the sources of its term; so many of them at once.
            partners, start = np.repeat(size, size), np.repeat(first, size)
            ends = np.cumsum(partners)
            i = 0
            while i < len(at):
                j = max(i + 1, int(np.searchsorted(ends, ends[i] - partners[i] + PAIRS, side="right")))
                left = np.repeat(np.arange(i, j), partners[i:j])
                before = np.repeat(ends[i:j] - partners[i:j] - (ends[i] - partners[i]), partners[i:j])
                right = np.repeat(start[i:j], partners[i:j]) + np.arange(len(left)) - before
                other = left != right
                left, right = left[other], right[other]
                i = j
                if not len(left):
                    continue
                value = f(p[left], p[right]) - f(p[left], p0[right]) - f(p0[left], p[right]) + f(p0[left], p0[right])
                order = np.lexsort((at[right], at[left], lang[left]))
                a, b, of = at[left][order], at[right][order], lang[left][order]
                new = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1]) | (of[1:] != of[:-1])]))
                known = list(names)
                yield pa.record_batch([pa.array([known[x] for x in of[new]], pa.string()), pa.array(a[new]), pa.array(b[new]),
                                       pa.array(np.add.reduceat(value[order], new))], names=["lang", "a", "b", "value"])

    by_term = shares.groupBy("lang", "term").agg(F.collect_list(F.struct("at", "p", "p0")).alias("held")).where(F.size("held") > 1)
    return by_term.select("lang", "held").mapInArrow(run, "lang string, a long, b long, value long")


def source_pairs(groups: DataFrame, shares: DataFrame) -> DataFrame:
    """(lang, source, item, value) of every two sources of a language."""
    small = if_small(groups.select("lang", F.col("at").alias("b"), F.col("source").alias("item"), F.col("p0").alias("q0")), 100)
    every = groups.select("lang", "source", F.col("at").alias("a"), "p0", "v").join(small, "lang").where("a <> b")
    often = store(shares.groupBy("lang", F.col("at").alias("a"), "p0", "p").agg(F.count(F.lit(1)).alias("n")), "often")
    one = often.join(small.drop("item"), "lang").where("a <> b")
    p, p0, q0 = F.col("p"), F.col("p0"), F.col("q0")
    as_left = one.select("lang", "a", "b", (F.col("n") * (distance(p, q0) - distance(p0, q0))).alias("value"))
    as_right = one.select("lang", F.col("b").alias("a"), F.col("a").alias("b"), (F.col("n") * (distance(q0, p) - distance(q0, p0))).alias("value"))
    base = every.select("lang", "a", "b", (F.col("v") * distance(p0, q0)).alias("value"))
    # Decimals: the parts may be greater than their sum, which fits a long.
    parts = [x.groupBy("lang", "a", "b").agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("value")) for x in (as_left, as_right, common_terms(shares), base)]
    total = parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3]).groupBy("lang", "a", "b").agg(F.sum("value").cast("long").alias("value"))
    return every.select("lang", "source", "item", "a", "b").join(total, ["lang", "a", "b"]).select("lang", "source", "item", "value")


def divergence(docs: DataFrame, least: int = LEAST_DOCUMENTS, top: int = TOP) -> DataFrame:
    """The ``pair`` and ``term`` parts of all groups; see the module's docstring."""
    groups, shares = shares_of(docs, least)
    ranked = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = source_pairs(groups, shares).withColumn("rank", F.row_number().over(ranked)).withColumn("part", F.lit("pair"))
    terms = shares.where("p > q").select("lang", "source", F.col("term").alias("item"), distance(F.col("p"), F.col("q")).alias("value"))
    terms = terms.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= top).withColumn("part", F.lit("term"))
    return pairs.unionByName(terms).select("lang", "source", "part", "item", "value", "rank")


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract 13 over the whole ``documents`` table."""
    return divergence(table(spark, sf_dir, "documents"))


#: Dense: each group by each kept term.  Written from the definition, not from the code above.
OP13_SQL = r"""
WITH docs AS (SELECT row_number() OVER () AS d, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
words AS (SELECT d, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM docs),
vocabulary AS (SELECT lang, term, count(*) AS n FROM words GROUP BY lang, term HAVING count(DISTINCT d) >= 3),
langs AS (SELECT lang, count(*) AS v, sum(n) AS total FROM vocabulary GROUP BY lang),
sources AS (SELECT DISTINCT lang, source FROM docs),
counted AS (SELECT w.lang, w.source, w.term, count(*) AS n FROM words w JOIN vocabulary k ON w.lang = k.lang AND w.term = k.term GROUP BY ALL),
totals AS (SELECT lang, source, sum(n) AS total FROM counted GROUP BY ALL),
shares AS (SELECT s.lang, s.source, k.term, coalesce(c.n, 0) AS n,
    1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 1)) // (coalesce(t.total, 0)::HUGEINT + l.v) AS p,
    1 + (1000000000::HUGEINT * (k.n + 1)) // (l.total::HUGEINT + l.v) AS q
  FROM sources s JOIN vocabulary k ON s.lang = k.lang JOIN langs l ON l.lang = s.lang
  LEFT JOIN totals t ON t.lang = s.lang AND t.source = s.source
  LEFT JOIN counted c ON c.lang = s.lang AND c.source = s.source AND c.term = k.term),
sums AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS value
  FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, b.source AS item, coalesce(s.value, 0)::BIGINT AS value
  FROM sources a JOIN sources b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
terms AS (SELECT lang, source, term AS item, (((p - q) * (p - q)) // q)::BIGINT AS value FROM shares WHERE n > 0 AND p > q),
ranked AS (SELECT lang, source, 'pair' AS part, item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS rank FROM pairs
  UNION ALL SELECT lang, source, 'term', item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) FROM terms)
SELECT lang, source, part, item, value, rank::INTEGER AS rank FROM ranked WHERE part = 'pair' OR rank <= 200
"""
