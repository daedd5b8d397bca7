"""Character trigrams are counted in tasks, in the slots and with the weights that Spark ML's stages give; words are not written for one pass."""

import numpy as np
from pyspark.ml import Pipeline
from pyspark.ml.feature import IDF, HashingTF, NGram, Normalizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from foliospark.functions import text as T
from foliospark.operators import embed as E

TEXTS = ["", "a", "ab", "abc", "A b\t c", "abcabcabc " * 30, "naïve 中文字 \U0001f600\U0001f601\U0001f602 x", "ÄÖÜß éé​\x00\x7f", "aaaa", "".join(map(chr, range(0x390, 0x3d0)))]


def test_trigrams_are_those_of_the_ml_stages(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, clean string").repartition(3)
    got = {r.doc_id: r.embedding for r in E.fit_encoder(docs, "char_hash", "abstract").transform(docs).collect()}
    tokens = docs.select("doc_id", F.split(T.clean_text(F.col("clean")), "").alias("tokens"))
    stages = [NGram(n=3, inputCol="tokens", outputCol="grams"), HashingTF(numFeatures=E.HASH_DIM, inputCol="grams", outputCol="tf"),
              IDF(inputCol="tf", outputCol="vector"), Normalizer(p=2.0, inputCol="vector", outputCol="unit")]
    want = Pipeline(stages=stages).fit(tokens).transform(tokens).select("doc_id", vector_to_array("unit").cast("array<float>").alias("e")).collect()
    assert len(got) == len(TEXTS) and all(np.allclose(got[r.doc_id], r.e, atol=1e-7) for r in want) and any(got[6])


def test_words_counted_in_one_pass_are_not_written(spark, monkeypatch):
    written = []
    monkeypatch.setattr(E, "materialise", lambda df: written.append(df) or df)
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, clean string")
    for name in ("tfidf_hash", "char_hash"):
        E.fit_encoder(docs, name, "abstract")
    assert not written
