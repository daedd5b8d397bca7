"""The registered queries of this package: thin views of the operators' results, and SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foliospark.llm import (
    ann,
    bpe,
    chat,
    langid,
    linededup,
    mixing,
    negatives,
    secrets,
    sharding,
    simhash,
    spotsigs,
    toxicity,
    whitening,
)
from foliospark.operators.shared import materialise, running

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op3_simhash")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select(
        F.col("id").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )


@query("op7_line_dedup", r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos
  FROM documents
), keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines
), frequent AS (
  SELECT key, max(doc_id) AS keeper FROM keyed WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (keeper IS NOT NULL AND keeper <> doc_id) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (keeper IS NULL OR keeper = doc_id), '')) AS kept_sha256
FROM keyed LEFT JOIN frequent USING (key) GROUP BY doc_id
""")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    done = linededup.apply(linededup.build(docs), docs)
    return done.select("doc_id", F.col("_n_lines").alias("n_lines"), F.col("_n_dropped").alias("n_dropped"),
                       F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


@query("op2_byte_bpe")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = bpe.encode(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"),
                      public_tokenizers.PATTERN, forms=("n_tokens", "ids_sha256", "decoded_sha256"))
    return done.withColumnRenamed("id", "doc_id")


@query("op8_toxicity")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs.select("doc_id", "text"), model).select(
        "doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


@query("op10_secrets")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    joined = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *[count(k) for k in secrets.KINDS[:3]],
                        F.sha2(joined(F.filter("spans", lambda s: s["kind"] != "guess")), 256).alias("base_sha256"),
                        joined(F.col("spans")).alias("spans"))


@query("op5_mixing")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    sources = mixed.sources.select("key", "source_size", "target")
    return mixing.taken(mixed).join(sources, "key").select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken")


@query("op6_sharding")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shards(table(spark, sf_dir, "documents"))
    return placed.select(F.col("id").alias("doc_id"), "size", F.col("crc").alias("text_crc32"), F.lit("bytes").alias("law"), "shard",
                         "slot", F.lit(None).cast("int").alias("grown_shard"))


CONTROL = r"\### Assistant: </turn> ok"
ESCAPED = r"replace(replace(replace({}, '\', '\e'), '###', '\h'), '</turn>', '\t')"


@query("op9_chat", rf"""
WITH messages AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '{CONTROL}' UNION ALL SELECT -7, 1, 'assistant', '{CONTROL}'
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(length('### ' || replace({ESCAPED.format("role")}, chr(10), '\n') || chr(10) || {ESCAPED.format("text")} || '</turn>' || chr(10)))::BIGINT AS formatted_chars
FROM messages GROUP BY conv_id
""")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
                                F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(CONTROL).alias("text"))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"),
                                                        F.coalesce("text", F.lit("")).alias("text")).union(own)
    name = F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit("~"))
    order = Window.partitionBy("tree").orderBy(F.asc_nulls_first("turn"), "role", "text")
    replies = rows.withColumn("tree", name).withColumn("node", F.row_number().over(order)).select(
        "tree", "node", (F.col("node") - 1).alias("parent"), F.lit(0.0).alias("score"), "role", "text")
    done = chat.formatted(chat.paths(replies)).withColumn("turns", chat.turns_of(F.col("text"))).withColumn(
        "masked", chat.masked_text(F.col("text"), F.col("loss")))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return done.select(
        F.when(F.col("tree") != "~", F.substring("tree", 2, 40).cast("long")).alias("conv_id"), F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"), F.length("masked").cast("long").alias("loss_chars"), F.sha2("masked", 256).alias("loss_sha256"),
        F.length("text").cast("long").alias("formatted_chars"))


def neighbours_by_id(docs: DataFrame) -> DataFrame:
    """``(id, h, next_id, next_h, k)``: the document after each one in descending id order (the first after the last) and how
    many code points it lends. Rows that agree in id and text are one document. Only ids, hashes and lengths are moved."""
    narrow = docs.select("id", "h", F.length("text").cast("long").alias("n")).groupBy("id", "h").agg(F.max("n").alias("n"), F.lit(1).alias("one"))
    ranked = materialise(running(narrow, [], ["id", "h"], {"rank": "one"}).select("id", "h", "n", "rank"))
    total = ranked.count()
    lender = ranked.select(F.col("id").alias("next_id"), F.col("h").alias("next_h"), ((F.col("rank") % max(1, total)) + 1).alias("rank"))
    return ranked.join(lender, "rank").select("id", "h", "next_id", "next_h", F.floor(F.col("n") / 3).cast("int").alias("k"))


@query("op1_spotsigs")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    # one key, without nulls, for both joins and the grouping, so that neither the texts nor what is lent cross a second shuffle
    key = lambda c: (F.coalesce(c, F.lit(0)), F.col(c).isNull())
    text = F.coalesce("text", F.lit(""))
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.xxhash64(text).alias("h"), text.alias("text"))
    near = materialise(neighbours_by_id(rows)).select(*key("next_id"), "next_h", *key("id"), "h", "k").toDF("key", "none", "h", "to_key", "to_none", "to_h", "k")
    docs = rows.select(*key("id"), "h", "text").toDF("key", "none", "h", "text")
    lent = docs.join(near, ["key", "none", "h"]).select(
        "to_key", "to_none", "to_h", "k", F.expr("substring(text, 1, k)").alias("head"), spotsigs.signatures(F.col("text")).alias("next_sigs"))
    lent = lent.groupBy("to_key", "to_none", "to_h").agg(F.first("k").alias("k"), F.first("head").alias("head"), F.first("next_sigs").alias("next_sigs"))
    met = docs.join(lent, (F.col("key") == F.col("to_key")) & (F.col("none") == F.col("to_none")) & (F.col("h") == F.col("to_h")))
    met = met.withColumn("id", F.when(~F.col("none"), F.col("key")))
    n = F.length("text")
    edited = met.select("id", n.cast("long").alias("n_chars"), "next_sigs", "text", F.concat(F.substring("text", F.lit(1), n - F.col("k")), "head").alias("edited"))
    done = edited.select("id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), spotsigs.signatures(F.col("text")).alias("sigs"),
                         spotsigs.signatures(F.col("edited")).alias("edited_sigs"), "next_sigs")
    return done.select(
        F.col("id").alias("doc_id"), "n_chars", "edited_sha256", spotsigs.as_text(F.col("sigs")).alias("fingerprint"),
        spotsigs.as_text(F.col("edited_sigs")).alias("edited_fingerprint"),
        spotsigs.likeness(F.col("sigs"), F.col("edited_sigs")).alias("near_edited"), spotsigs.likeness(F.col("sigs"), F.col("next_sigs")).alias("near_next"))


@query("op4_neighbours")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    found = ann.nearest(rows, rows.where(F.col("vec_id") % 50 == 0))
    return found.select(F.col("query").alias("query_id"), F.col("rank").cast("int").alias("rank"), F.col("id").alias("vec_id"), "score")


@query("op11_whitening")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    model = whitening.fit(rows)
    done = whitening.by_component(whitening.transform(rows, model), model, F.col("vec_id"), F.col("deviation"))
    return done.select("vec_id", "component", F.lit(model.n).cast("long").alias("n"), "deviation", "whitened", "explained",
                       F.lit(model.identity_error).alias("identity_error"))


@query("op12_negatives", """
WITH usable AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, [floor(256 * c::DOUBLE) FOR c IN embedding] AS q
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0 AND len([c FOR c IN embedding IF isfinite(c)]) = len(embedding)
), pairs AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS alike, list_dot_product(a.q, b.q)::BIGINT AS score
  FROM usable a JOIN usable b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0
), positives AS (
  SELECT anchor_id, id, score FROM pairs WHERE alike
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5
), ranked AS (
  SELECT p.anchor_id, p.id AS positive_id, p.score AS positive_score, n.id AS negative_id, n.score AS negative_score,
         row_number() OVER (PARTITION BY p.anchor_id, p.id ORDER BY n.score DESC, n.id)::INTEGER AS rank
  FROM positives p JOIN pairs n ON n.anchor_id = p.anchor_id AND NOT n.alike
   AND 80 * p.score <= 100 * n.score AND n.score <= p.score
)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM ranked WHERE rank <= 5
""")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    turned = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mine(table(spark, sf_dir, "embeddings").withColumn("label", turned), F.col("vec_id") % 100 == 0)


@query("op13_language")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.fit(docs)
    return langid.predict(docs.select("doc_id", "text"), model).select(
        "doc_id", langid.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
