"""Corpus pipeline: language ID, toxicity, near-duplicate removal, secret redaction, packing.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and
returns a DataFrame with the columns of ``docs``, the last one the packed pieces.
``run`` writes each result as Parquet and reads it again as the next stage's input.

Rows pass through a stage whole: columns that a stage does not know are kept, a
NULL text counts as empty, and an empty table stays empty.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelforge.llm import langid, ngram_join, packing, secrets, toxicity
from panelforge.llm.common import bounded, if_small, store, table

LEAST_LANGUAGE_SCORE = 0.5


def rows_where(docs: DataFrame, keep: Callable[[list[str | None]], list[bool]]) -> DataFrame:
    """The rows whose texts ``keep`` accepts; no row is moved."""
    at = docs.columns.index("text")

    def run(batches):
        for batch in batches:
            for part in bounded(batch):
                yield part.filter(pa.array(keep(part.column(at).to_pylist()), pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language (no letters) or with a doubtful one go."""
    import public_tokenizers

    model = langid.train_on_documents(docs, public_tokenizers.path("piece_bpe_32k.model"))
    if not model.langs:  # nothing to learn from, nothing to reject by
        return docs

    def keep(texts):
        return [lang != "und" and score >= LEAST_LANGUAGE_SCORE for lang, score in langid.scorer(model).texts(texts)]

    return rows_where(docs, keep)


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.5 or more go."""
    model = toxicity.train_on_labels(docs, table(spark, sf_dir, "labels"))
    return rows_where(docs, lambda texts: [model.margin(t or "") < 0 for t in texts])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked texts the row with the smallest doc_id stays, of several
    with that doc_id the one of the least hash, and of rows of one doc_id and text one.
    Rows that share a doc_id only are not linked.  Rows without a doc_id stay."""
    key = F.col("doc_id").cast("long")
    if not docs.where(key.isNotNull()).groupBy(key).count().where("count > 1").limit(1).count():
        joined = store(ngram_join.join_components(ngram_join.keyed(docs)), "components")
        gone = store(joined.where("key <> component_id").select(F.col("key").alias("doc_id")), "dropped")
        return docs.join(if_small(gone, 16), "doc_id", "left_anti").select(*docs.columns)
    # A doc_id stands on several rows: each (doc_id, text) is joined under a key of its own.
    # The key is a hash of both; two different rows of one hash (2^-64 a pair) would be one.
    text, own = F.coalesce(F.col("text").cast("string"), F.lit("")), "_row"
    while own in docs.columns:
        own += "_"
    marked = docs.withColumn(own, F.when(key.isNotNull(), F.xxhash64(key, text)))
    named = marked.where(F.col(own).isNotNull()).select(F.col(own).alias("key"), text.alias("text"), key.alias("doc_id"))
    joined = ngram_join.join_components(named.select("key", "text")).select("key", "component_id").distinct()
    counted = named.groupBy("key").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("n"))
    joined = store(joined.join(counted, "key"), "components")
    first = joined.groupBy("component_id").agg(F.min(F.struct("doc_id", "key")).alias("least")).select(F.col("least.key").alias("key"))
    gone = store(joined.join(first, "key", "left_anti").select(F.col("key").alias(own)), "dropped")
    again = store(joined.where("n > 1").select(F.col("key").alias(own)), "repeated")
    kept = marked.join(if_small(gone, 16), own, "left_anti")
    whole = F.struct(*docs.columns)
    one = kept.join(if_small(again, 16), own, "left_semi").groupBy(own).agg(F.min_by(whole, F.xxhash64(*docs.columns)).alias("r")).select("r.*")
    return kept.join(if_small(again, 16), own, "left_anti").select(*docs.columns).unionByName(one)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark; ``n_chars`` follows where a text has changed."""
    at, size = docs.columns.index("text"), docs.columns.index("n_chars") if "n_chars" in docs.columns else None

    def run(batches):
        for batch in batches:
            for part in bounded(batch):
                old = part.column(at)
                new = pa.array([None if t is None else secrets.redacted(t) for t in old.to_pylist()], old.type)
                columns = list(part.columns)
                columns[at] = new
                if size is not None:
                    changed = pc.fill_null(pc.not_equal(old, new), False)
                    columns[size] = pc.if_else(changed, pc.utf8_length(new).cast(columns[size].type), columns[size])
                yield pa.record_batch(columns, schema=part.schema)

    return docs.mapInArrow(run, docs.schema)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("language_id", language_id), ("toxicity", toxic), ("ngram_join", near_duplicates), ("secret_scan", redact_secrets), ("packing", pack)]
#: The first stages are trained models, which SQL cannot express; tests/llm holds a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = store(stage(spark, docs, sf_dir), name)
    return docs
