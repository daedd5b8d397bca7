"""The corpus pipeline: each stage calls one operator on all that the stage before has kept.

Stages take and return the columns of ``documents``, whatever further columns there are; the last one returns token ids. Rows are
told apart by id and text: rows that agree in both are one document, and what is decided for it holds for each of them. Null texts
are empty texts, null ids are an id, and empty tables give empty tables. ``tests/llm`` holds every stage against brute force.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.llm import bpe, linededup, mixing, simhash, toxicity
from foliospark.llm.common import column
from foliospark.operators.shared import materialise

TOXIC_SCORE, SHINGLE, MAX_BITS = 0.7, 4, 4
VOCABULARY = "byte_bpe_multi_50k.tiktoken"


def _key() -> Column:
    """What tells documents apart; known ids come before a null one."""
    return F.struct(F.col("doc_id").isNull().alias("unnamed"), F.col("doc_id").alias("id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("h"))


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(_key().alias("_key"), "text", "source")


def _with(docs: DataFrame, decided: DataFrame, how: str, *more: Column) -> DataFrame:
    """``docs`` joined with decisions by ``_key``; only its own columns come back."""
    rows = docs.select(*[column(c) for c in docs.columns], _key().alias("_doc"))
    own = decided.withColumnRenamed("_key", "_other")
    same = [F.col(f"_doc.{p}").eqNullSafe(F.col(f"_other.{p}")) for p in ("unnamed", "id", "h")]
    return rows.join(own, same[0] & same[1] & same[2], how).select(*[column(c) for c in docs.columns], *more)


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score ``TOXIC_SCORE`` or more go."""
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.score(docs, model, name="_score").where(F.col("_score") < TOXIC_SCORE).drop("_score")


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that many documents share stay in one of them; ``n_chars`` follows the text."""
    done = linededup.apply(linededup.build(docs), docs)
    length = F.length(F.coalesce("text", F.lit(""))).cast("long").alias("n_chars")
    return done.select(*[length if c == "n_chars" else column(c) for c in docs.columns])


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of documents whose fingerprints link, the one with the smallest id stays, once."""
    found = simhash.near_duplicates(_keyed(docs), id_col="_key", shingle=SHINGLE, max_bits=MAX_BITS)
    stays = found.where(F.col("id") == F.col("component_id")).select(F.col("id").alias("_key")).distinct()
    return _with(docs, stays, "left_semi").dropDuplicates(["doc_id", "text"])


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes its words, rounded up or down by a hash so that sums stay near the targets."""
    taken = mixing.taken(mixing.mix(_keyed(docs), id_col="_key")).groupBy(F.col("id").alias("_key"))
    share = taken.agg(F.try_divide(F.sum("taken"), F.sum("size")).alias("_share")).where("_share > 0")
    share = share.select("_key", F.floor(F.col("_share") + F.pmod(F.xxhash64(F.lit("copies"), "_key"), F.lit(1 << 30)) / float(1 << 30)).cast("int").alias("_copies"))
    copies = share.where("_copies > 0")
    return _with(docs, copies, "inner", F.explode(F.sequence(F.lit(1), F.col("_copies"))).alias("_copy")).drop("_copy")


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, and a digest of what they decode to."""
    done = bpe.encode(docs, public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN, forms=("n_tokens", "tokens", "decoded_sha256"))
    return done.withColumnRenamed("id", "doc_id")


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
STAGES: list[tuple[str, Stage]] = [
    ("toxicity", reject_toxic),
    ("line_dedup", drop_lines),
    ("simhash_near_dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("byte_bpe", encode_tokens),
]

#: Learned dictionaries, fingerprint components and merges are beyond SQL; tests hold the run against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
