import numpy as np
from pyspark.sql import functions as F

from foliospark.config import PipelineConfig
from foliospark.operators import classify as K
from foliospark.operators import embed as E
from foliospark.plans.end_to_end import run

TOPICS = {
    "cs": "The neural model improves image accuracy. The training data produces better language features.",
    "bio": "The protein cell impacts gene expression. Blood samples show disease markers in patients.",
    "math": "The smooth theorem uses algebra proofs. Prime numbers have infinite group structure.",
}


def records(spark, n=90):
    rng = np.random.default_rng(1)
    rows = []
    for i in range(n):
        topic = list(TOPICS)[i % 3]
        words = TOPICS[topic].split()
        body = " ".join(rng.choice(words, 12))
        rows.append((i, f"{TOPICS[topic]} {body}", f"{topic}.X other.Y"))
    return spark.createDataFrame(rows, "doc_id long, abstract string, categories string")


def test_whole_run(spark):
    cfg = PipelineConfig(n_clustering=50, n_classifier=40, n_trials=3, encoders=("tfidf_hash",), min_cluster_sizes=(5,), max_k=3)
    out = run(records(spark), cfg)
    assert out.best["ari"] > 0.3
    assert out.clustered.count() == 50 and out.assigned.count() == 40  # all others
    assert {r["algorithm"] for r in out.comparison.collect()} == {"KMeans", "GMM", "HDBSCAN"}
    done = K.completed(out.trials)
    assert done.count() >= 2 and 0 <= out.best_trial["value"] <= 1
    assert out.mix.count() >= 2 and out.dropped >= 0


def test_hybrid_joins_unit_vectors(spark):
    df = records(spark, 12).select("doc_id", F.lower("abstract").alias("clean"), F.lit("a b").alias("triples"), F.lit("x y z").alias("graph_text"))
    fitted = E.fit_encoder(df, "tfidf_hash", "hybrid")
    assert list(fitted.views) == ["abstract", "triples", "graph_text"]
    row = fitted.transform(df).first()["embedding"]
    assert len(row) == 3 * E.HASH_DIM and abs(sum(v * v for v in row) - 1) < 1e-4
    assert list(E.fit_encoder(df.drop("graph_text"), "tfidf_hash", "hybrid").views) == ["abstract", "triples"]


def test_user_encoder_and_store(spark):
    texts = spark.createDataFrame([(1, "aa"), (2, "b"), (3, None)], "doc_id long, text string")

    def make():
        return lambda batch: np.array([[len(t), 1.0] for t in batch])

    got = {r["doc_id"]: r["embedding"] for r in E.encode_with(texts, make, batch=2).collect()}
    assert np.allclose(got[1], np.array([2, 1]) / np.sqrt(5), atol=1e-6) and np.allclose(got[3], [0, 1])
    store, made = E.EmbeddingStore(), []

    def build():
        made.append(1)
        return texts

    assert store.get(("a", 1), build) is store.get(("a", 1), build) and len(made) == 1
    store.release()


def test_draws_are_seeded_and_in_range():
    a, b = K.draw_trials(24), K.draw_trials(24)
    assert a == b and len(a) == 24
    for t in a:
        lo, hi = K.RATES[t.model_name]
        assert lo <= t.lr <= hi and t.batch in (None, *K.BATCHES) and (t.epochs is None or 1 <= t.epochs <= 8)
        assert (t.batch is not None, t.epochs is not None) == ("batch" in K.DRAWS[t.model_name], "epochs" in K.DRAWS[t.model_name])
    assert {t.model_name for t in K.draw_trials(200)} == set(K.RATES)


def test_failed_trials_are_filtered(spark):
    trials = K.trial_table(spark, [
        {"trial_id": 0, "state": "COMPLETE", "value": .5, "acc": .5}, {"trial_id": 1, "state": "FAIL"}, {"trial_id": 2, "state": "COMPLETE", "value": .5, "acc": .5}])
    assert K.best_trial(trials).first()["trial_id"] == 0
    assert K.completed(trials).count() == 2
    assert {r["key"] for r in K.trial_log(trials).where("trial_id = 1").collect()} == set()


def test_token_ids(spark):
    texts = spark.createDataFrame([(1, "a a b"), (2, "c a"), (3, "")], "doc_id long, text string")
    assert {r["word"]: r["token_id"] for r in K.vocabulary(texts).collect()} == {"a": 2, "b": 3, "c": 4}
    vocab = K.vocabulary(spark.createDataFrame([(1, "a a b b c")], "doc_id long, text string"), 2)
    assert {r["word"]: r["token_id"] for r in vocab.collect()} == {"a": 2, "b": 3}
    got = {r["doc_id"]: r for r in K.encode_ids(texts, vocab, 4).collect()}
    assert got[1]["input_ids"] == [2, 2, 3, 0] and got[1]["attention_mask"] == [1, 1, 1, 0]
    assert got[2]["input_ids"] == [1, 2, 0, 0] and got[3]["input_ids"] == [0, 0, 0, 0]
