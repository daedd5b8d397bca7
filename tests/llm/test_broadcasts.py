"""Exploded tables are joined by a shuffle, however small Spark takes them for."""

from pyspark.sql import functions as F

from foliospark.llm import ann, mixing, simhash
from foliospark.operators.shared import materialise


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_exploded_keys_of_fingerprints_are_not_broadcast(spark):
    rows = spark.range(200).select(F.col("id").alias("node"), F.xxhash64("id").alias("fp"), F.col("id").alias("grp"))
    nodes = materialise(rows)
    for links in (simhash._leaders(nodes, 4), simhash._across(nodes, 4)):
        assert "Join" in _plan(links)
        assert "Broadcast" not in _plan(links)


def test_links_are_found_by_the_shuffled_joins(spark):
    fps = spark.createDataFrame([(0, 0, 0), (1, 0b1111, 1), (2, -1, 2)], "node long, fp long, grp long")
    assert [(r.a, r.b) for r in simhash._across(fps, 4).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).collect()] == [(0, 1)]


def test_pieces_of_documents_are_not_broadcast(spark):
    docs = spark.createDataFrame([(i, "a b c d e " * 40, "x") for i in range(20)], "doc_id long, text string, source string")
    mixed = mixing.mix(docs)
    taken = mixing.taken(mixed)
    joins = [x for x in _plan(taken).split("\n") if "BroadcastHashJoin" in x and "block#" in x]
    assert not joins
    assert taken.count() == 20 and taken.agg(F.sum("taken")).first()[0] > 0


def test_blocks_of_queries_are_not_broadcast(spark):
    rows = spark.range(60).select("id", F.transform(F.sequence(F.lit(1), F.lit(8)), lambda i: F.sin(F.col("id") * i + 1)).alias("v"))
    found = ann._search(rows, rows.where("id < 5"), 8, 3, 60, 2, 1.0, 42)
    assert "Join" in _plan(found)
    assert "Broadcast" not in _plan(found)
    assert found.groupBy("query").count().where("count = 3").count() == 5
