import math

import pytest
from pyspark.sql import functions as F

from foliospark.config import PipelineConfig
from foliospark.operators import sampling as S


def docs(spark, n=500):
    hot = F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 7))
    return spark.range(n).select(F.col("id").alias("doc_id"), hot.alias("label"))


def test_shuffle_does_not_depend_on_partitioning(spark):
    a = [r[0] for r in S.shuffle(docs(spark).repartition(3)).select("doc_id").collect()]
    b = [r[0] for r in S.shuffle(docs(spark).repartition(11)).select("doc_id").collect()]
    assert a == b and sorted(a) == list(range(500)) and a != sorted(a)


def test_split_follows_the_shuffled_order(spark):
    order = [r[0] for r in S.shuffle(docs(spark)).select("doc_id").collect()]
    rows = {r["doc_id"]: (r["position"], r["split"]) for r in S.split_first_n(docs(spark), 120, 80).collect()}
    assert rows == {d: (i, "cluster" if i < 120 else "class") for i, d in enumerate(order[:200])}
    assert S.split_first_n(docs(spark), 400, 400).where("split = 'class'").count() == 100


def test_stratified_quota(spark):
    split = S.stratified_split(docs(spark), "label", 0.2)
    assert split.count() == 500 and split.select("doc_id").distinct().count() == 500
    total = {r["label"]: r["n"] for r in docs(spark).groupBy("label").agg(F.count("*").alias("n")).collect()}
    val = {r["label"]: r["n"] for r in split.where("split = 'val'").groupBy("label").agg(F.count("*").alias("n")).collect()}
    assert sum(val.values()) == math.ceil(0.2 * 500)
    assert all(abs(val[k] - 0.2 * n) < 1 for k, n in total.items())


def test_rare_and_encode(spark):
    df = spark.createDataFrame([(1, 5), (2, 5), (3, -1), (4, 9), (5, 9)], "doc_id long, c int")
    assert sorted(r["doc_id"] for r in S.drop_rare(df, "c").collect()) == [1, 2, 4, 5]
    assert S.rare_count(df, "c").first()[0] == 1
    assert {r["c"]: r["c_enc"] for r in S.label_encode(df, "c").collect()} == {-1: 0, 5: 1, 9: 2}


def test_representations_and_modes(spark):
    df = spark.createDataFrame([(1, "c")], "doc_id long, clean string")
    row = S.with_representations(df).first()
    assert row["triples_str"] == "(unk, unk, unk)" and row["graph_text"] == ""
    listed = df.withColumn("triples", F.array(F.struct(F.lit("a").alias("s"), F.lit("r").alias("r"), F.lit("b").alias("o"))))
    assert S.with_representations(listed).first()["abstract_triples"] == "c a r b"
    with pytest.raises(ValueError):
        S.with_representations(df.drop("clean"))
    with pytest.raises(ValueError):
        S.select_text(df, "nonsense")
    with pytest.raises(ValueError):
        S.select_text(df, "hybrid")
    with pytest.raises(ValueError):
        PipelineConfig(cluster_mode="nonsense")
    two = PipelineConfig(cluster_mode="hybrid", class_mode="abstract")
    assert (two.cluster_mode, two.class_mode) == ("hybrid", "abstract")
