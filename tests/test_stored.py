import pytest
from pyspark.sql import functions as F

from foliospark.operators import classify as K
from foliospark.operators import embed as E
from foliospark.operators import stored as S


def test_digest_follows_rows_and_not_their_order(spark):
    rows = [(1, "a", None), (2, None, "a"), (3, "", "b"), (3, "", "b")]
    df = spark.createDataFrame(rows, "doc_id long, text string, other string")
    same = S.content_digest(df)
    assert S.content_digest(df.repartition(3).select("other", "text", "doc_id")) == same
    for changed in (df.limit(3), df.distinct(), df.withColumn("text", F.coalesce("text", F.lit(""))), df.withColumnRenamed("other", "o"),
                    df.selectExpr("doc_id", "other AS text", "text AS other"), df.withColumn("doc_id", F.col("doc_id").cast("int"))):
        assert S.content_digest(changed) != same
    assert S.content_digest(df.limit(0)) == S.content_digest(df.where("false")) != same


def test_encodings_outlive_a_session(spark, tmp_path):
    df = spark.createDataFrame([(i, f"word{i} common words") for i in range(8)], "doc_id long, clean string")
    made = []

    def vectors(session_store, rows):
        def make():
            made.append(1)
            return E.fit_encoder(rows, "tfidf_hash", "abstract").transform(rows)
        got = session_store.get(("vectors", S.content_digest(rows), "tfidf_hash", E.FORM), make)
        return {r["doc_id"]: list(r["embedding"]) for r in got.collect()}

    first = vectors(E.EmbeddingStore(str(tmp_path)), df)
    assert vectors(E.EmbeddingStore(str(tmp_path)), df.repartition(3)) == first and len(made) == 1
    other = df.withColumn("clean", F.when(F.col("doc_id") == 3, "another text").otherwise(F.col("clean")))
    assert vectors(E.EmbeddingStore(str(tmp_path)), other) != first and len(made) == 2


def test_a_half_written_entry_is_none(spark, tmp_path):
    key, df = ("a", 1), spark.createDataFrame([(1, "x")], "doc_id long, text string")
    df.write.parquet(f"{S._folder(str(tmp_path), key)}/rows-killed")
    assert S.lookup(spark, str(tmp_path), key) is None
    assert S.keep(str(tmp_path), key, df.limit(1)).count() == 1
    assert [tuple(r) for r in S.lookup(spark, str(tmp_path), key).collect()] == [(1, "x")]
    assert S.lookup(spark, str(tmp_path), ("a", 2)) is None


def test_a_search_goes_on_where_it_was_killed(spark, tmp_path, monkeypatch):
    words = ("model image data", "protein cell gene", "theorem algebra proof")
    df = spark.createDataFrame([(i, f"{words[i % 3]} t{i % 7}", i % 3) for i in range(45)], "doc_id long, clean string, y_label int")
    fitted, fit = [], K.run_trial

    def quick(train, val, t, *rest):
        if len(fitted) == limit:
            raise RuntimeError("killed")
        fitted.append(t.trial_id)
        return fit(train, val, K.Trial(t.trial_id, "naive_bayes", 1.0), *rest)

    monkeypatch.setattr(K, "run_trial", quick)
    table = lambda rows: [tuple(r) for r in rows.orderBy("trial_id").collect()]
    go = lambda journal, n=5: K.search(df, "abstract", "y_label", n, parallelism=1, journal=journal)
    limit = 3
    with pytest.raises(RuntimeError):
        go(str(tmp_path))
    assert fitted == [0, 1, 2]
    limit = 99
    resumed = table(go(str(tmp_path)))
    assert fitted == [0, 1, 2, 3, 4] and len(resumed) == 5
    assert table(go(None)) == resumed
    fitted.clear()
    assert table(go(str(tmp_path))) == resumed and fitted == []
    assert table(go(str(tmp_path), 6))[:5] == resumed and fitted == [5]
