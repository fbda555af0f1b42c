"""Document fingerprints from closed syncmers, in DataFrame operations only.

A text is read as letters of a large alphabet: pieces that begin at certain letters
and digits (``CUTS``), at each letter of a script without cases, and after what stands
between words.  Where a piece begins depends on the characters there alone, so
inserting or dropping a character changes the pieces around it and no other, also
within an unbroken run.  (Only stretches of over 64 letters without a cut, or of over 4
characters that are neither letters nor digits, are cut by length from their start.)

Of all stretches of ``K`` pieces those are kept whose least inner stretch of ``S``
pieces, by hash, is the first or the last: an anchor, whatever stands around it.  The
fingerprint holds all anchors, each hash at its first place.  Two fingerprints are alike
by the anchors that both hold in the same order: the longest run of common anchors
whose places rise in both texts, twice, over the numbers of anchors of both.

Texts are dealt once, by ranges of their keys, so that the next document lies beside its
own or, at the end of a range, is sent along.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import store, table

#: Letters and digits at which a piece begins.
CUTS = "aoAOàáâäãòóôöõÀÁÂÄÒÓÔÖаоАОαοΑΟ05"
PIECE = (rf"\p{{Lo}}[^\p{{L}}\p{{N}}]{{0,4}}|[{CUTS}]?[\p{{L}}\p{{N}}&&[^\p{{Lo}}{CUTS}]]{{1,64}}[^\p{{L}}\p{{N}}]{{0,4}}"
         rf"|[{CUTS}][^\p{{L}}\p{{N}}]{{0,4}}|[^\p{{L}}\p{{N}}]{{1,4}}")
S = 2
INNER = 4  # inner stretches in a stretch
K = S + INNER - 1
SKETCH = 64
SHARE = 1  # one in so many hashes of a text of over ``SKETCH`` is kept: all
PLACE = (1 << 32) - 1  # an entry is a hash of 31 bits and a place of 32
RANGE = 256  # keys of a range, about
TASK_RANGES = 8  # ranges of a task, about
MOST_RANGES = 16_384  # their first keys stand in the plan


def with_anchors(df: DataFrame, text: str, out: str) -> DataFrame:
    """Adds ``out``: array of (pos, hash) of the anchors of column ``text`` in order,
    ``pos`` counting pieces from 0.  In a text of fewer than ``K`` pieces each piece is
    an anchor; an empty one has none."""
    p, s = f"_{out}_p", f"_{out}_s"
    df = df.withColumn(p, F.transform(F.regexp_extract_all(F.col(text), F.lit(PIECE), F.lit(0)), lambda x: F.xxhash64(x)))
    # Each column is read several times below, so it stands in a projection of its own.
    df = df.withColumn(s, F.when(F.size(p) >= K, F.zip_with(F.slice(p, 1, F.size(p) - 1), F.slice(p, 2, F.size(p) - 1), lambda a, b: F.xxhash64(a, b))).otherwise(F.array().cast("array<bigint>")))
    # The least of the inner stretches is the first or the last if no one between is less.
    at = lambda i: F.get(F.col(s), i)
    between = lambda i: F.least(*[at(i + j) for j in range(1, INNER - 1)])
    kept = F.filter(F.when(F.size(p) >= K, F.sequence(F.lit(0), F.size(p) - K)).otherwise(F.array().cast("array<int>")), lambda i: F.least(at(i), at(i + (INNER - 1))) <= between(i))
    df = df.withColumn(f"_{out}_k", kept)
    hashed = F.transform(F.col(f"_{out}_k"), lambda i: F.struct(i.alias("pos"), F.xxhash64(F.slice(F.col(p), i + 1, K)).alias("hash")))
    single = F.transform(F.col(p), lambda h, i: F.struct(i.alias("pos"), h.alias("hash")))
    df = df.withColumn(out, F.when(F.size(p) >= K, hashed).otherwise(single))
    return df.drop(*[c for c in df.columns if c.startswith(f"_{out}_")])


def sketch(df: DataFrame, anchors: str, out: str) -> DataFrame:
    """Adds ``out``: the entries of all anchors by hash, ascending, each hash at its first
    place; and ``{out}_whole``: that these are all."""
    every = f"_{out}_all"
    entry = F.transform(F.col(anchors), lambda a: F.shiftleft(a["hash"].bitwiseAND(F.lit((1 << 31) - 1)), 32).bitwiseOR(a["pos"].cast("long")))
    df = df.withColumn(every, F.sort_array(entry))
    first = F.filter(F.col(every), lambda x, i: (i == 0) | (F.shiftright(x, 32) != F.shiftright(F.get(F.col(every), i - 1), 32)))
    return df.withColumn(out, first).withColumn(f"{out}_whole", F.lit(True)).drop(every)


def as_text(fingerprint: str) -> Column:
    return F.array_join(F.transform(F.col(fingerprint), lambda x: F.lpad(F.lower(F.hex(x)), 16, "0")), "")


def rising(places: Column) -> Column:
    """The length of the longest rising run (gaps allowed) of an array of (number, length):
    stretches of ``length`` numbers that rise by one, apart from each other."""
    def let(value: Column, then) -> Column:
        """``then(value)``, evaluated once."""
        return F.get(F.transform(F.array(value), then), F.lit(0))

    def step(ends: Column, v: Column) -> Column:
        # (last stretch, length) of the runs that no other beats, both rising
        def longer(lower: Column) -> Column:
            length = F.coalesce(F.get(lower, F.size(lower) - 1)["length"], F.lit(0)) + v["length"]
            return let(length, lambda n: F.concat(lower, F.array(F.struct(v["number"].alias("number"), n.alias("length"))), F.filter(ends, lambda e: (e["number"] > v["number"]) & (e["length"] > n))))

        return let(F.filter(ends, lambda e: e["number"] < v["number"]), longer)

    ends = F.aggregate(places, F.array().cast("array<struct<number:bigint,length:int>>"), step)
    return F.coalesce(F.get(ends, F.size(ends) - 1)["length"], F.lit(0))


def with_likeness(df: DataFrame, a: str, b: str, out: str) -> DataFrame:
    """Adds ``out``, the likeness of two fingerprints: see the module's docstring.  Two texts
    without anchors are alike."""
    met, turns, starts = (f"_{out}_{c}" for c in "mts")
    # Entries of both by hash, told apart by the last bit: those of a common hash are neighbours.
    df = df.withColumn(met, F.sort_array(F.concat(F.transform(a, lambda e: F.shiftleft(e, 1)), F.transform(b, lambda e: F.shiftleft(e, 1).bitwiseOR(F.lit(1).cast("long"))))))
    place = lambda e: F.shiftright(e, 1).bitwiseAND(F.lit(PLACE))

    def common(e: Column, after: Column) -> Column:
        one, two = F.when(e.bitwiseAND(F.lit(1).cast("long")) == 0, e).otherwise(after), F.when(e.bitwiseAND(F.lit(1).cast("long")) == 0, after).otherwise(e)
        return F.when(F.shiftright(e, 33) == F.shiftright(after, 33), F.shiftleft(place(one), 32).bitwiseOR(place(two)))

    rest = F.slice(F.col(met), F.lit(2), F.greatest(F.size(met) - 1, F.lit(0)))
    df = df.withColumn(met, F.sort_array(F.filter(F.zip_with(F.col(met), rest, common), lambda p: p.isNotNull())))  # place in a, place in b
    # The number in a of each common anchor, in the order of b.
    numbered = F.transform(F.col(met), lambda p, i: F.shiftleft(p.bitwiseAND(F.lit(PLACE)), 32).bitwiseOR(i.cast("long")))
    df = df.withColumn(turns, F.transform(F.sort_array(numbered), lambda e: e.bitwiseAND(F.lit(PLACE))))
    # Stretches that both texts share without a gap count as one.
    begins = F.filter(F.sequence(F.lit(0), F.size(turns) - 1), lambda i: (i == 0) | (F.get(F.col(turns), i) != F.get(F.col(turns), i - 1) + 1))
    df = df.withColumn(starts, F.when(F.size(turns) > 0, begins).otherwise(F.array().cast("array<int>")))
    stretches = F.transform(F.col(starts), lambda i, k: F.struct(F.get(F.col(turns), i).alias("number"), (F.coalesce(F.get(F.col(starts), k + 1), F.size(turns)) - i).alias("length")))
    total = F.size(a) + F.size(b)
    df = df.withColumn(starts, stretches)
    df = df.withColumn(out, F.when(total == 0, F.lit(1.0)).otherwise(2.0 * rising(F.col(starts)) / total))
    return df.drop(met, turns, starts)


def shared_places(df: DataFrame, a: str, b: str, out: str) -> DataFrame:
    """Adds ``out``: (pos_a, pos_b) of each anchor of column ``a`` with the same hash as
    one of column ``b`` (its first place there), for positional matching."""
    where = f"_{out}_at"
    first = F.map_from_entries(F.array_distinct(F.transform(F.col(b), lambda x: F.struct(x["hash"], F.get(F.filter(F.col(b), lambda y: y["hash"] == x["hash"]), F.lit(0))["pos"]))))
    both = F.transform(F.filter(F.col(a), lambda x: F.map_contains_key(F.col(where), x["hash"])), lambda x: F.struct(x["pos"].alias("pos_a"), F.element_at(F.col(where), x["hash"]).alias("pos_b")))
    return df.withColumn(where, first).withColumn(out, both).drop(where)


def ranges(keys: DataFrame) -> list[tuple[int, int]]:
    """First keys of the ranges of ``keys`` (doc_id, tie; distinct), ascending: the least of
    all, and by hash one in ``RANGE``, or fewer if there are too many for a plan."""
    n = keys.count()
    if not n:
        return []
    one_in = max(RANGE, -(-n // MOST_RANGES))
    at = F.struct("doc_id", "tie")
    found = keys.where(F.pmod(F.xxhash64("tie", "doc_id"), F.lit(one_in)) == 0).select(at.alias("at")).union(keys.agg(F.min(at).alias("at")))
    return sorted({(r["at"]["doc_id"], r["at"]["tie"]) for r in found.collect()})


def in_ranges(rows: DataFrame, firsts: list[tuple[int, int]]) -> DataFrame:
    """``rows`` (doc_id, tie, ...) with ``part``, the number of their range, and ``after``: a
    range also holds the first row of the next one, the last range that of the first."""
    lists = [F.split(F.lit(",".join(str(f[i]) for f in firsts)), ",").cast("array<bigint>") for i in (0, 1)]
    key, steps = F.struct("doc_id", "tie"), [1 << i for i in reversed(range(len(firsts).bit_length()))]

    def step(at: Column, d: Column) -> Column:
        return F.when((at + d <= len(firsts)) & (F.struct(*[F.get(v, at + d - 1) for v in lists]) <= key), at + d).otherwise(at)

    found = rows.withColumn("part", F.aggregate(F.array(*[F.lit(d) for d in steps]), F.lit(0), step))
    own, before = F.struct("part", F.lit(False).alias("after")), F.struct(F.when(F.col("part") == 1, len(firsts)).otherwise(F.col("part") - 1).alias("part"), F.lit(True).alias("after"))
    is_first = (F.get(lists[0], F.col("part") - 1) == F.col("doc_id")) & (F.get(lists[1], F.col("part") - 1) == F.col("tie"))
    return found.withColumn("at", F.explode(F.when(is_first, F.array(own, before)).otherwise(F.array(own)))).select(*rows.columns, "at.part", "at.after")


def fingerprints(docs: DataFrame) -> DataFrame:
    """Per row of ``docs`` (doc_id, text) its fingerprint and that of its edited text,
    with their likeness and that to the next document's.

    A NULL text is empty.  Rows that share a doc_id follow each other by text hash;
    equal rows have the same next document.  A NULL doc_id comes first.  A single
    document is its own next one."""
    low = F.lit(-(1 << 63))  # stands for a NULL key; ``tie`` tells it from the number itself
    key, text = F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit(""))
    base = docs.select(F.coalesce(key, low).alias("doc_id"), F.xxhash64(key.isNull(), text).alias("tie"), text.alias("text"))
    keys = store(base.groupBy("doc_id", "tie").agg(F.count(F.lit(1)).alias("rows")), "keys")
    firsts, repeated = ranges(keys), keys.where("rows > 1")
    one = base
    if not repeated.isEmpty():  # of equal rows one goes on, before any is dealt
        mine = ["doc_id", "tie"]
        one = base.join(repeated, mine, "left_anti").union(base.join(repeated, mine, "left_semi").dropDuplicates(mine))
    tasks = max(1, min(len(firsts), 2 * docs.sparkSession.sparkContext.defaultParallelism), len(firsts) // TASK_RANGES)
    dealt = in_ranges(one, firsts).repartition(tasks, "part").sortWithinPartitions("part", "after", "doc_id", "tie")
    size = F.char_length("text").cast("long")
    dealt = dealt.withColumn("n_chars", size).withColumn("nameless", (F.col("doc_id") == low) & (F.col("tie") == F.xxhash64(F.lit(True), F.col("text"))))
    dealt = sketch(with_anchors(dealt, "text", "a"), "a", "fa").withColumn("n_anchors", F.size("a").cast("long")).drop("a", "fa_whole")
    order = Window.partitionBy("part").orderBy("after", "doc_id", "tie")
    both = dealt.withColumn("next", F.lead(F.struct("text", "fa")).over(order)).where(~F.col("after"))
    q = F.floor(F.col("n_chars") / 4).cast("int")
    both = both.withColumn("q", q).withColumn("edited", F.expr("concat(substring(text, 1, cast(n_chars as int) - q), substring(next.text, 1, q))"))
    both = both.withColumn("fn", F.col("next.fa")).withColumn("edited_sha256", F.sha2(F.col("edited").cast("binary"), 256)).drop("next", "text", "part", "after", "q")
    both = sketch(with_anchors(both, "edited", "e").drop("edited"), "e", "fe").drop("e", "fe_whole")
    both = with_likeness(with_likeness(both, "fa", "fe", "near_edited"), "fa", "fn", "near_next")
    out = both.select("doc_id", "tie", "nameless", "n_chars", "edited_sha256", as_text("fa").alias("fingerprint"), as_text("fe").alias("edited_fingerprint"), "near_edited", "near_next", "n_anchors")
    if one is not base:
        times = F.coalesce(F.col("rows"), F.lit(1)).cast("int")
        out = out.join(repeated, ["doc_id", "tie"], "left").withColumn("turn", F.explode(F.sequence(F.lit(1), times)))
    return out.select(F.when(~F.col("nameless"), F.col("doc_id")).alias("doc_id"), "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "n_anchors")


def op2_syncmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract 2 over the whole ``documents`` table."""
    return fingerprints(table(spark, sf_dir, "documents"))
