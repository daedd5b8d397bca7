from pyspark.sql import functions as F

from foliospark.operators import triples as E
from foliospark.operators.shared import side_by_side
from foliospark.plans.catalogue import graphs as G


def test_words_of_dealt_documents_are_not_dealt_again(spark, tmp_path):
    """Before, the token rows crossed the shuffle, many times the size of the texts."""
    rows = [(i, " ".join(f"w{i * j % 17}{'x' * (j % 4)}" for j in range(30)) + "\nsome other words of another line here now", "en", "s") for i in range(40)]
    rows += [(3, rows[3][1], "en", "s"), (77, "", "en", "s"), (78, None, "en", "s")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    tokens = G._tokens(spark, str(tmp_path))
    placed, dealt = E.verb_arguments(tokens, placed=True), E.verb_arguments(tokens)
    exchanges = [d._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") for d in (placed, dealt)]
    assert exchanges == [1, 2]
    assert sorted(map(str, placed.collect())) == sorted(map(str, dealt.collect()))


def test_partitions_follow_the_characters(spark):
    docs = spark.range(100).select(F.col("id").alias("doc_id"), F.repeat(F.lit("a"), 1000).alias("text"))
    assert side_by_side(docs, "text", 2_000).rdd.getNumPartitions() == 50
    assert side_by_side(docs.where("false"), "text").rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
