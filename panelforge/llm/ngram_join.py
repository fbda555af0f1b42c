"""Similarity join on word n-gram sets through a token-group matrix.

Texts become sets of hashed shingles (tokens); two texts link if the Jaccard
similarity of their sets reaches a threshold.  Equal sets are one class and are
compared once.  The links are found in steps that each drop only what cannot link:

1. *Everything else as one group.*  A set that links with another lacks at most a
   fixed share of its tokens there.  A fixed fraction of the token space is
   counted: a set too many of whose counted tokens occur nowhere else is done.
2. *Components of similar sets.*  Sets that agree in one of several min-hashes are
   compared with the smallest set of that agreement; links make components.
3. *Token-group matrix.*  What is left is cut into groups of similar sets, whatever
   their component, and the union of the tokens of each group is stored as rows
   (token, group).  A set's overlap with a group's union bounds its overlap with
   each member.  Only (set, group) pairs whose bound can reach the threshold, looked
   up through the rarest tokens first, are opened, and there the set is compared
   with the members exactly.

Sets of one component need no comparison with each other: they are connected.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import bounded, if_small, store, table
from .components import components

WORDS = 5
PERCENT = 75
HASHES = 8  # min-hashes that propose groups
GROUP = 256  # sets in a group of the matrix
COUNTED = 0.3  # fraction of the token space counted in step 1
BYTES_AT_ONCE = 1 << 19  # of texts that are hashed together, one text at least: some 50 bytes are held for each

P = np.uint64(0x9E3779B97F4A7C15)
P_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
SEEDS = np.random.default_rng(5).integers(1, 1 << 63, 64, dtype=np.uint64) | np.uint64(1)
LIMIT = np.uint64(int(COUNTED * 2**64))
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def shingles(texts: list[str | None], words: int = WORDS) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text.  Bytes of A-Z are lowered and
    words are runs of anything but ASCII white space; a text of fewer words has
    its whole sequence as one shingle, one without words has none."""
    out, some, size = [], [], 0
    for t in texts:
        raw = (t or "").encode("utf-8", "surrogatepass").lower()
        if some and size + len(raw) > BYTES_AT_ONCE:
            out += _shingles(some, words)
            some, size = [], 0
        some.append(raw)
        size += len(raw)
    return out + _shingles(some, words)


def _shingles(raw: list[bytes], words: int) -> list[np.ndarray]:
    buf = np.frombuffer(b" ".join([*raw, b""]), np.uint8)
    if not len(buf):
        return [np.zeros(0, np.uint64) for _ in raw]
    gap = SPACE[buf]
    # Prefix sums of a polynomial give the hash of any stretch, whatever its place.
    power = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(len(buf), P)]))
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * power[:-1])])
    start = np.flatnonzero(~gap & np.concatenate([[True], gap[:-1]]))
    end = np.flatnonzero(gap & np.concatenate([[False], ~gap[:-1]]))
    back = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(len(buf), P_INVERSE)]))
    word = mix((total[end] - total[start]) * back[start] + (end - start).astype(np.uint64))
    lens = np.array([len(r) + 1 for r in raw])
    first = np.searchsorted(start, np.concatenate([[0], np.cumsum(lens)]))
    run = np.zeros(max(0, len(word) - words + 1), np.uint64)
    for k in range(words):
        run += word[k:k + len(run)] * SEEDS[k]
    run = mix(run)
    out = []
    for a, b in zip(first[:-1], first[1:]):
        if b - a >= words:
            out.append(np.unique(run[a:b - words + 1]))
        elif b > a:
            out.append(mix((word[a:b] * SEEDS[8:8 + b - a]).sum(keepdims=True) + SEEDS[b - a]))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def signature(tokens: np.ndarray) -> str | None:
    """128 bits that tell sets apart; None for an empty set."""
    if not len(tokens):
        return None
    a, b = mix(tokens * SEEDS[20]).sum(), mix(tokens * SEEDS[21] + SEEDS[22]).sum()
    return f"{int(a):016x}{int(b):016x}"


def alike(a: np.ndarray, b: np.ndarray, percent: int = PERCENT) -> bool:
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    if 100 * len(small) < percent * len(large):
        return False
    at = np.minimum(np.searchsorted(large, small), max(len(large) - 1, 0))
    both = int((large[at] == small).sum()) if len(large) else 0
    return 100 * both >= percent * (len(a) + len(b) - both)


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    for batch in batches:
        for part in bounded(batch, 4 << 20):
            yield part, shingles(part.column(1).to_pylist())


def profile(docs: DataFrame) -> DataFrame:
    """(key, n, counted, sig) of each row of ``docs`` (key, text)."""
    def run(batches):
        for part, sets in _texts(batches):
            yield pa.record_batch([part.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array([int(np.searchsorted(s, LIMIT)) for s in sets], pa.int64()),
                                   pa.array([signature(s) for s in sets], pa.string())], names=["key", "n", "counted", "sig"])

    return docs.select("key", "text").mapInArrow(run, "key long, n long, counted long, sig string")


def shared_tokens(docs: DataFrame) -> DataFrame:
    """(key, hits): how many of the counted tokens of a row occur in another row too.

    A token that occurs several times in one batch is known to be shared: its rows
    are counted on the spot and one row tells the others, so a token of a third of
    all texts is sent once for each batch.  The receiving side reads the tokens in
    order and holds one row back."""
    def send(batches):
        for part, sets in _texts(batches):
            keys = part.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            sets = [s[:np.searchsorted(s, LIMIT)] for s in sets]
            token, of = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(s) for s in sets])
            order = np.argsort(token)
            token, of = token[order], of[order]
            again = np.concatenate([[False], token[1:] == token[:-1]]) if len(token) else np.zeros(0, bool)
            many = again | np.concatenate([again[1:], [False]]) if len(token) else again
            told = token[many & ~again]
            local = np.bincount(of[many], minlength=len(sets))
            rows = np.flatnonzero(local)
            out = [(token[~many], keys[of[~many]], np.zeros((~many).sum(), np.int32)), (told, np.zeros(len(told), np.int64), np.full(len(told), -1, np.int32)),
                   (mix(keys[rows].astype(np.uint64)), keys[rows], local[rows].astype(np.int32))]
            token, key, hits = (np.concatenate(c) for c in zip(*out))
            yield pa.record_batch([pa.array(token.view(np.int64)), pa.array(key), pa.array(hits, pa.int32())], names=["token", "key", "hits"])

    def receive(batches):
        last, shared, held = None, False, None
        for batch in batches:
            token, key, hits = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            known = hits > 0
            found, times = [key[known]], [hits[known].astype(np.int64)]
            token, key, told = token[~known], key[~known], hits[~known] < 0
            if len(token):
                first = np.concatenate([[True], token[1:] != token[:-1]])
                run = np.cumsum(first) - 1
                size = np.bincount(run)
                is_shared = (size > 1) | (np.bincount(run, weights=told) > 0)
                if token[0] == last:
                    if held is not None:
                        found.append(np.array([held]))
                        times.append(np.ones(1, np.int64))
                    is_shared[0] = True
                emit = is_shared[run] & ~told
                last, shared = token[-1], bool(is_shared[-1])
                held = None if shared else int(key[-1])
                found.append(key[emit])
                times.append(np.ones(emit.sum(), np.int64))
            keys, at = np.unique(np.concatenate(found), return_inverse=True)
            yield pa.record_batch([pa.array(keys.astype(np.int64)), pa.array(np.bincount(at, weights=np.concatenate(times), minlength=len(keys)).astype(np.int64))], names=["key", "hits"])

    rows = docs.where("key IS NOT NULL").select("key", "text").mapInArrow(send, "token long, key long, hits int")
    parts = docs.sparkSession.conf.get("spark.sql.shuffle.partitions")
    got = rows.repartition(int(parts), "token").sortWithinPartitions("token").mapInArrow(receive, "key long, hits long")
    return got.groupBy("key").agg(F.sum("hits").alias("hits"))


def sets_of(docs: DataFrame) -> DataFrame:
    """(sig, n, counted, tokens, mins): the sorted tokens as bytes, and the min-hashes."""
    def run(batches):
        for part, sets in _texts(batches):
            mins = [[int(mix(s * SEEDS[32 + k] + SEEDS[48 + k]).min().view(np.int64)) for k in range(HASHES)] if len(s) else [] for s in sets]
            yield pa.record_batch([pa.array([signature(s) for s in sets], pa.string()), pa.array([len(s) for s in sets], pa.int64()), pa.array([int(np.searchsorted(s, LIMIT)) for s in sets], pa.int64()),
                                   pa.array([s.tobytes() for s in sets], pa.binary()), pa.array(mins, pa.list_(pa.int64()))], names=["sig", "n", "counted", "tokens", "mins"])

    return docs.select("key", "text").mapInArrow(run, "sig string, n long, counted long, tokens binary, mins array<long>")


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) of set numbers whose sets link.  ``b`` should be the side with
    few different sets: the others travel to it once."""
    def run(batches):
        for batch in batches:
            for part in bounded(batch):
                sides = [[np.frombuffer(x.as_py(), np.uint64) for x in part.column(i)] for i in (2, 3)]
                yield part.select([0, 1]).filter(pa.array([alike(x, y) for x, y in zip(*sides)], pa.bool_()))

    pairs = store(pairs.select("a", "b").distinct(), "pairs")
    some = store(pairs.select("b").distinct(), "pairs-b")
    one = sets.select(F.col("id").alias("a"), F.col("tokens").alias("x")).join(if_small(pairs, 24), "a")
    two = sets.select(F.col("id").alias("b"), F.col("tokens").alias("y")).join(if_small(some, 16), "b", "left_semi")
    return store(one.join(two, "b").select("a", "b", "x", "y").mapInArrow(run, "a long, b long"), "verified")


def near_sizes(n: str, m: str):
    return (100 * F.col(n) >= PERCENT * F.col(m)) & (100 * F.col(m) >= PERCENT * F.col(n))


def proposed(sets: DataFrame) -> DataFrame:
    """(a, b, agree): each set with the least set of its agreement in a min-hash, and in how many."""
    keys = sets.select("id", "n", F.posexplode("mins").alias("k", "m"))
    least = keys.groupBy("k", "m").agg(F.min(F.struct("id", "n")).alias("l"), F.count(F.lit(1)).alias("c")).where("c > 1")
    met = keys.join(least, ["k", "m"]).select(F.col("id").alias("a"), F.col("l.id").alias("b"), "n", F.col("l.n").alias("n2"))
    return met.where("a <> b").where(near_sizes("n", "n2")).groupBy("a", "b").agg(F.count(F.lit(1)).alias("agree"))


def grouped(sets: DataFrame) -> DataFrame:
    """Components from the links found through min-hashes.  Each set is first
    compared with the proposal that it agrees with most, then with those that are
    still in another group."""
    met = store(proposed(sets), "proposed")
    first = Window.partitionBy("a").orderBy(F.desc("agree"), "b")
    best = met.withColumn("r", F.row_number().over(first))
    links = verified(best.where("r = 1"), sets)
    groups = store(components(links), "groups")
    named = if_small(groups, 24)
    for side in ("a", "b"):
        best = best.join(named.select(F.col("node").alias(side), F.col("component").alias(f"of_{side}")), side, "left")
    apart = F.coalesce("of_a", "a") != F.coalesce("of_b", "b")
    return merged(groups, verified(best.where((F.col("r") > 1) & (F.col("agree") > HASHES // 4) & apart), sets))


def merged(groups: DataFrame, links: DataFrame) -> DataFrame:
    """Components after more links: the old ones stand in as stars."""
    if not links.limit(1).count():
        return groups
    stars = groups.select(F.col("node").alias("a"), F.col("component").alias("b"))
    return store(components(stars.unionByName(links)), "groups")


def needed(n: str, counted: str):
    """How many counted tokens of a set of ``n`` occur in any set that links with it."""
    return F.col(counted) - F.floor(F.col(n) * (100 - PERCENT) / 100)


def token_rows(sets: DataFrame, counted: bool) -> DataFrame:
    """(id, grp, need, token) for each token, or each counted one, of each row of ``sets`` (id, grp, need, tokens)."""
    def run(batches):
        for batch in batches:
            for part in bounded(batch, 2 << 20):
                tokens = [np.frombuffer(x.as_py(), np.uint64) for x in part.column(3)]
                tokens = [t[:np.searchsorted(t, LIMIT)] for t in tokens] if counted else tokens
                at = pa.array(np.repeat(np.arange(part.num_rows), [len(t) for t in tokens]))
                yield pa.record_batch([*(c.take(at) for c in part.columns[:3]), pa.array(np.concatenate(tokens).view(np.int64))], names=["id", "grp", "need", "token"])

    return sets.select("id", "grp", "need", "tokens").mapInArrow(run, "id long, grp long, need long, token long")


def covered(spread: DataFrame, counted: bool) -> tuple[DataFrame, DataFrame]:
    """Rows (id, grp, token) of the tokens that occur in two groups at least, and the
    sets (id) enough of whose tokens do."""
    need = needed("n", "counted") if counted else F.ceil(F.col("n") * PERCENT / 100)
    spread = spread.withColumn("need", need.cast("long"))
    rows = token_rows(spread, counted)
    cross = store(rows.groupBy("token").agg(F.min("grp").alias("lo"), F.max("grp").alias("hi")).where("lo <> hi").select("token"), "cross")
    rows = store(rows.join(if_small(cross, 16), "token"), "matrix")
    held = rows.where("need > 0").groupBy("id", "need").agg(F.count(F.lit(1)).alias("hits")).where("hits >= need").select("id")
    return rows, store(held.unionByName(spread.where("need <= 0").select("id")), "covered")


def _open(queries: pa.Table, members: pa.Table) -> pa.Table:
    """Links between queries and the members of one group; one for each query and
    component that it meets."""
    found: list[tuple[int, int]] = []
    if queries.num_rows and members.num_rows:
        sets = [np.frombuffer(x.as_py(), np.uint64) for x in members.column("tokens2")]
        sizes = np.array([len(x) for x in sets])
        token, of = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
        order = np.argsort(token, kind="stable")
        token, of = token[order], of[order]
        first = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
        union, last = token[first], np.concatenate([first[1:], [len(token)]])
        ids, grps = members.column("id2").to_numpy(), members.column("grp2").to_numpy()
        for a, grp, raw in zip(queries.column("id").to_pylist(), queries.column("grp").to_pylist(), queries.column("tokens")):
            q = np.frombuffer(raw.as_py(), np.uint64)
            at = np.minimum(np.searchsorted(union, q), len(union) - 1)
            at = at[union[at] == q]
            if 100 * len(at) < PERCENT * len(q):  # the bound: no member can link
                continue
            count = last[at] - first[at]
            where = np.repeat(first[at] - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())
            both = np.bincount(of[where], minlength=len(sets))
            hit = np.flatnonzero((100 * both >= PERCENT * (len(q) + sizes - both)) & (grps != grp))  # in either order of rank
            _, one = np.unique(grps[hit], return_index=True)
            found += [(a, int(ids[i])) for i in hit[one]]
    return pa.table([pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.int64())], names=["a", "b"])


def opened(sets: DataFrame, components_: DataFrame) -> DataFrame | None:
    """The links (a, b) between sets of different components, through the token-group
    matrix; None if there can be none.

    Only tokens that occur in two components at least matter.  Sets too few of whose
    tokens do are dropped together with their tokens, first by the counted tokens and
    then by all, until few more go.  The sets left are put in order of their
    min-hashes and cut into groups of ``GROUP``; the matrix holds the union of each
    group.  A set looks up its rarest tokens, so many that a group with a partner must
    show at least some of them; each group that does is opened with the set."""
    spread = sets.join(if_small(components_, 24), F.col("id") == F.col("node"), "left").select("id", "n", "counted", F.coalesce("component", "id").alias("grp"), "tokens", "mins")
    counted, before = True, None
    while True:
        rows, held = covered(spread, counted)
        now = held.count()
        if not now:
            return None
        spread = spread.join(if_small(held, 16), "id", "left_semi")
        if not counted and before is not None and now > 0.9 * before:
            break
        before, counted = (now if not counted else None), False
    by = [F.get("mins", F.lit(k)) for k in range(2)]
    near = spread.select("id", "n", "grp", "tokens", by[0].alias("m0"), by[1].alias("m1")).repartitionByRange("m0", "m1", "id").sortWithinPartitions("m0", "m1", "id")
    members = store(near.withColumn("block", F.floor(F.monotonically_increasing_id() / GROUP)).drop("m0", "m1"), "groups")
    # Of two components the smaller one asks: a set of a large one meets only still larger ones.
    sizes = store(members.groupBy("grp").agg(F.count(F.lit(1)).alias("size")), "sizes")
    place = store(members.join(if_small(sizes, 24), "grp").select("id", "n", "block", F.struct("size", "grp").alias("rank")), "places")
    rows = store(rows.join(if_small(place, 48), "id").select("id", "n", "block", "rank", "token"), "matrix")
    matrix = store(rows.groupBy("token", "block").agg(F.max("rank").alias("top")), "unions")
    weight = matrix.groupBy("token").agg(F.count(F.lit(1)).alias("g"), F.max("top").alias("highest"))
    mine = Window.partitionBy("id")
    some = F.greatest(F.lit(1), F.floor(F.col("n") / 10))
    # Tokens that no other component holds would come first in a set's order and meet
    # nothing; of those left, a partner lacks have - 75 % of n at most.
    ranked = rows.join(weight, "token").withColumn("have", F.count(F.lit(1)).over(mine)).withColumn("r", F.row_number().over(mine.orderBy("g", "token")))
    prefix = ranked.where((F.col("r") <= F.col("have") - F.ceil(F.col("n") * PERCENT / 100) + some) & (F.col("highest") > F.col("rank"))).select("id", "n", "rank", "token")
    span = place.groupBy("block").agg(F.min("n").alias("lo"), F.max("n").alias("hi"))
    met = prefix.join(matrix, "token").where("top > rank").groupBy("id", "n", "block").agg(F.count(F.lit(1)).alias("hits")).where(F.col("hits") >= some)
    met = met.join(if_small(store(span, "spans"), 32), "block").where((100 * F.col("n") >= PERCENT * F.col("lo")) & (100 * F.col("hi") >= PERCENT * F.col("n")))
    met = store(met.select("id", "block"), "met")
    salts = store(met.groupBy("block").agg(F.ceil(F.count(F.lit(1)) / 512).cast("int").alias("salts")), "salts")
    asked = met.join(if_small(salts, 16), "block").select("id", "block", F.pmod(F.xxhash64("id"), F.col("salts")).cast("int").alias("salt"))
    asked = store(asked, "asked")
    queries = members.select("id", "grp", "tokens").join(if_small(asked, 32), "id").select("block", "salt", "id", "grp", "tokens")
    held = members.select("block", "id", "grp", "tokens").join(if_small(salts, 16), "block").select("block", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), "id", "grp", "tokens").select(*[F.col(c).alias(f"{c}2") for c in ("block", "salt", "id", "grp", "tokens")])
    return queries.groupBy("block", "salt").cogroup(held.groupBy("block2", "salt2")).applyInArrow(_open, "a long, b long")


def join_components(docs: DataFrame) -> DataFrame:
    """(key, n_shingles, component_id) of each row of ``docs`` (key long, text).

    ``component_id`` is the smallest key among the rows connected by links, the row
    itself included.  A NULL or empty text has no shingle and its own key; a NULL
    key has a NULL component and takes no part."""
    known = store(profile(docs), "profile")
    classes = known.where("sig IS NOT NULL AND key IS NOT NULL").groupBy("sig").agg(F.min("key").alias("rep"), F.max("n").alias("n"), F.max("counted").alias("counted"))
    hits = shared_tokens(docs)
    alive = classes.join(hits, F.col("rep") == F.col("key"), "left").where(F.coalesce("hits", F.lit(0)) >= needed("n", "counted")).select("sig", F.col("rep").alias("key"))
    alive = store(alive, "alive")
    texts = docs.join(if_small(alive.select("key").distinct(), 16), "key", "left_semi")
    # A key that stands on several texts gives sets of other classes too; they are left to their own.
    sets = sets_of(texts).join(if_small(alive.select("sig", F.col("key").alias("rep")), 64), "sig")
    if texts.select("key").count() > alive.count():  # only repeated keys can give a set twice
        sets = sets.dropDuplicates(["sig"])
    sets = store(sets.withColumn("id", F.monotonically_increasing_id()), "sets")
    groups = grouped(sets)
    more = opened(sets, groups)
    if more is not None:
        groups = merged(groups, store(more, "opened"))
    named = store(sets.select("id", "sig", "rep").join(if_small(groups, 24), F.col("node") == F.col("id")).select("sig", "component", "rep"), "named")
    least = named.groupBy("component").agg(F.min("rep").alias("least"))
    named = store(named.join(least, "component").select("sig", "least"), "least")
    out = known.join(classes.select("sig", "rep"), "sig", "left").join(if_small(named, 64), "sig", "left")
    return out.select("key", F.col("n").alias("n_shingles"), F.when(F.col("key").isNotNull(), F.coalesce("least", "rep", "key")).alias("component_id"))


def keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("key"), F.col("text").cast("string").alias("text"))


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join_components(keyed(table(spark, sf_dir, "documents"))).withColumnRenamed("key", "doc_id")


OP3_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w
  FROM documents),
shingle AS (
  SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END) AS s
  FROM words),
size AS (SELECT doc_id, count(*) AS n FROM shingle GROUP BY doc_id),
link AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM shingle a JOIN shingle b ON a.s = b.s AND a.doc_id <> b.doc_id
  JOIN size x ON x.doc_id = a.doc_id JOIN size y ON y.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id, x.n, y.n HAVING 100 * count(*) >= 75 * (x.n + y.n - count(*))),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM reach r JOIN link l ON l.a = r.b),
least AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a)
SELECT d.doc_id, coalesce(z.n, 0) AS n_shingles, l.component_id
FROM documents d LEFT JOIN size z USING (doc_id) JOIN least l ON l.a = d.doc_id
"""
