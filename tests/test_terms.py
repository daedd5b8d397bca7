"""A search goes over the words once and keeps their counts, and trains in few tasks however many files there are."""

import numpy as np
from pyspark.ml import Pipeline
from pyspark.ml.feature import IDF, HashingTF
from pyspark.sql import functions as F

from foliospark.functions import text as T
from foliospark.operators import classify as K
from foliospark.operators import embed as E

TEXTS = ["", " \t", "A b  a", "naïve İstanbul\x85x y ", "x y z\n\nz", "one two\x1cthree"]


def test_counts_stand_for_the_texts(spark):
    texts = spark.createDataFrame([(i, t, float(i % 2)) for i, t in enumerate(TEXTS)], "doc_id long, text string, y double")
    kept = K.with_terms(texts)
    assert kept.columns == ["doc_id", "y", "tf", "few"]
    got, same = ({r.doc_id: (r.label, r.features.toArray(), r.dense.toArray()) for r in K.with_features(rows, K.fit_features(rows)).collect()} for rows in (kept, texts))
    tokens = texts.withColumn("tokens", T.word_list(F.lower("text")))
    stages = [HashingTF(numFeatures=K.FEATURES, inputCol="tokens", outputCol="tf"), IDF(inputCol="tf", outputCol="features")]
    for r in Pipeline(stages=stages).fit(tokens).transform(tokens).collect():
        assert got[r.doc_id][0] == r.y and np.array_equal(got[r.doc_id][1], r.features.toArray())
    assert all(np.array_equal(got[i][j], same[i][j]) for i in got for j in (1, 2))


def test_words_need_no_cleaning_first(spark):
    texts = spark.createDataFrame([(t,) for t in [*TEXTS, None]], "text string")
    assert all(r.a == r.b for r in texts.select(E._words(F.col("text")).alias("a"), T.word_list(T.clean_text(F.col("text"))).alias("b")).collect())


def test_training_parts_follow_rows_and_not_files(spark, monkeypatch):
    seen, cores = [], spark.sparkContext.defaultParallelism
    monkeypatch.setattr(K, "run_trial", lambda train, val, t, *more: seen.append((train.rdd.getNumPartitions(), train.count())) or {"trial_id": t.trial_id, "state": "FAIL"})
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        texts = spark.createDataFrame([(i, "a b c", float(i % 2)) for i in range(200)], "doc_id long, clean string, y double").repartition(40)
        K.search(texts, "abstract", "y", n_trials=1)
        monkeypatch.setattr(K, "TASK_ROWS", 16)
        K.search(texts, "abstract", "y", n_trials=1)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    assert seen == [(cores, 160), (13, 160)]
