"""Classifiers on cluster labels and a seeded hyperparameter search."""

from __future__ import annotations

import math
import random
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import (
    LinearSVC, LogisticRegression, MultilayerPerceptronClassifier, NaiveBayes, OneVsRest, RandomForestClassifier,
)
from pyspark.ml.feature import IDF, HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.functions import text as T
from foliospark.operators import metrics as M
from foliospark.operators.sampling import select_text, stratified_split
from foliospark.operators.shared import running, small_batches
from foliospark.operators.stored import content_digest, keep, lookup

FEATURES = 1 << 18
#: Trees and the perceptron weigh every slot, so they see words hashed into fewer.
DENSE_FEATURES = 1024
DENSE = ("random_forest", "perceptron")
MAX_TOKENS = 128
#: Rows that a training task has at least. In each step of a fit a task sends on a gradient of ``FEATURES`` slots for each class, and
#: the driver gets the square root of their number, so small tasks would move far more than they learn from.
TASK_ROWS = 250_000
# Sizes and passes of the search. In this engine a size acts as hidden units of the perceptron and as depth of
# a tree (its binary logarithm), passes as iterations or trees; a model draws only what acts on it.
BATCHES = (8, 16, 32)
EPOCHS = (1, 8)
DRAWS = {"logistic": ("epochs",), "naive_bayes": (), "random_forest": ("batch", "epochs"), "perceptron": ("batch", "epochs"), "linear_svc": ("epochs",)}
# Per model the range of its step size or regularisation, drawn log-uniformly.
RATES = {
    "logistic": (1e-4, 1e-1),
    "naive_bayes": (1e-2, 1e1),
    "random_forest": (1e-4, 1e-2),
    "perceptron": (1e-3, 1e-1),
    "linear_svc": (1e-4, 1e-1),
}
METRICS = (
    "acc", "f1_macro", "f1_weighted", "precision_macro", "precision_weighted", "recall_macro", "recall_weighted",
    "kappa", "mcc", "top3_acc", "roc_auc_macro_ovr",
)
TRIAL_SCHEMA = (
    "trial_id int, state string, value double, model_name string, lr double, batch int, epochs int, "
    + ", ".join(f"{m} double" for m in METRICS) + ", error string"
)


@dataclass(frozen=True)
class Trial:
    trial_id: int
    model_name: str
    lr: float
    batch: int | None = None
    epochs: int | None = None


def draw_trials(n: int, seed: int = 42) -> list[Trial]:
    rng = random.Random(seed)
    trials = []
    for i in range(n):
        name = rng.choice(sorted(RATES))
        lo, hi = RATES[name]
        rate = math.exp(rng.uniform(math.log(lo), math.log(hi)))
        batch, epochs = rng.choice(BATCHES), rng.randint(*EPOCHS)
        acts = DRAWS[name]
        trials.append(Trial(i, name, rate, batch if "batch" in acts else None, epochs if "epochs" in acts else None))
    return trials


def estimator(t: Trial, num_labels: int, seed: int = 42):
    """The Spark ML classifier of a trial."""
    columns = {"featuresCol": "dense" if t.model_name in DENSE else "features", "labelCol": "label"}
    if t.model_name == "logistic":
        return LogisticRegression(regParam=t.lr, maxIter=10 * t.epochs, family="multinomial", **columns)
    if t.model_name == "naive_bayes":
        return NaiveBayes(smoothing=t.lr, **columns)
    if t.model_name == "random_forest":
        return RandomForestClassifier(minInfoGain=t.lr, numTrees=5 * t.epochs, maxDepth=t.batch.bit_length() + 2, seed=seed, **columns)
    if t.model_name == "perceptron":
        return MultilayerPerceptronClassifier(layers=[DENSE_FEATURES, t.batch, num_labels], stepSize=t.lr, maxIter=10 * t.epochs, solver="gd", seed=seed, **columns)
    if t.model_name == "linear_svc":
        svc = LinearSVC(regParam=t.lr, maxIter=10 * t.epochs, tol=1e-3)
        return OneVsRest(classifier=svc, parallelism=4, **columns)
    raise ValueError(f"Unknown model: {t.model_name!r}")


def with_terms(texts: DataFrame) -> DataFrame:
    """The counts of all hashed words of ``text``, in a wide sparse and a narrow form, in its place."""
    words = T.word_list(F.lower("text"))
    tokens = texts.select(*[c for c in texts.columns if c != "text"], words.alias("tokens"))
    for slots, name in ((FEATURES, "tf"), (DENSE_FEATURES, "few")):
        tokens = HashingTF(numFeatures=slots, inputCol="tokens", outputCol=name).transform(tokens)
    return tokens.drop("tokens")


def _terms(rows: DataFrame) -> DataFrame:
    """Texts or rows that have their counts already: who keeps the counts goes over the words once."""
    return rows if "tf" in rows.columns else with_terms(rows)


def fit_features(texts: DataFrame) -> PipelineModel:
    """TF-IDF of hashed words in both forms; fitted on training texts only."""
    return Pipeline(stages=[IDF(inputCol="tf", outputCol="features"), IDF(inputCol="few", outputCol="dense")]).fit(_terms(texts))


def with_features(texts: DataFrame, model: PipelineModel) -> DataFrame:
    return model.transform(_terms(texts)).select("doc_id", F.col("y").alias("label"), "features", "dense")


def gathered(train: DataFrame, rows: int) -> DataFrame:
    """Training rows in as many parts as there are cores, or as ``TASK_ROWS`` each make, whatever number of files they come from."""
    return train.coalesce(max(train.sparkSession.sparkContext.defaultParallelism, -(-rows // TASK_ROWS)))


def train_eval(train: DataFrame, val: DataFrame, t: Trial, num_labels: int, seed: int = 42) -> DataFrame:
    """Fit on ``train`` and return ``doc_id, y, scores`` of ``val`` (raw scores, one per class)."""
    model = estimator(t, num_labels, seed).fit(train)
    out = model.transform(val)
    return out.select("doc_id", F.col("label").cast("int").alias("y"), vector_to_array("rawPrediction").alias("scores"))


def run_trial(train: DataFrame, val: DataFrame, t: Trial, num_labels: int, seed: int = 42) -> dict:
    """One row of the trial table; a failed fit has state FAIL and no values."""
    row = {"trial_id": t.trial_id, "model_name": t.model_name, "lr": t.lr, "batch": t.batch, "epochs": t.epochs, "state": "FAIL"}
    try:
        scored = train_eval(train, val, t, num_labels, seed).persist()
        try:
            found = M.evaluate_predictions(scored, num_labels).first().asDict()
        finally:
            scored.unpersist()
        row |= found | {"value": found["acc"], "state": "COMPLETE"}
    except Exception as e:
        row["error"] = str(e)[:300]
    return row


def trial_table(spark: SparkSession, rows: list[dict]) -> DataFrame:
    names = [part.split()[0] for part in TRIAL_SCHEMA.split(", ")]
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], TRIAL_SCHEMA)


def search(df: DataFrame, mode: str, label: str, n_trials: int = 24, fraction: float = 0.2, seed: int = 42, parallelism: int = 4,
           journal: str | None = None) -> DataFrame:
    """The trial table of a seeded search; split and features are made once and shared by all trials.

    With a ``journal``, a folder that all executors share, each completed trial is written as it ends, and a search over the
    same rows finds it there: it fits only trials that are missing or failed. More trials go on from the earlier ones.
    """
    spark, trials = df.sparkSession, draw_trials(n_trials, seed)
    texts = select_text(df, mode, F.col(label).cast("double").alias("y"))
    about = ("trial", content_digest(texts), fraction, seed, FEATURES, DENSE_FEATURES) if journal else ()
    held = {t.trial_id: lookup(spark, journal, (*about, t)) for t in trials} if journal else {}
    rows = [found.first().asDict() for found in held.values() if found is not None]
    ended = {r["trial_id"] for r in rows}
    missing = [t for t in trials if t.trial_id not in ended]

    def record(t: Trial, row: dict) -> dict:
        if journal and row["state"] == "COMPLETE":
            keep(journal, (*about, t), trial_table(spark, [row]).coalesce(1))
        return row

    if missing:
        with small_batches(spark):
            rows += _fitted_trials(texts, missing, fraction, seed, parallelism, record)
    return trial_table(spark, sorted(rows, key=lambda r: r["trial_id"]))


def _fitted_trials(texts: DataFrame, trials: list[Trial], fraction: float, seed: int, parallelism: int,
                   record: Callable[[Trial, dict], dict]) -> list[dict]:
    marked = with_terms(stratified_split(texts, "y", fraction, "doc_id", seed)).persist()
    num_labels, rows = marked.agg(F.countDistinct("y"), F.count("*")).first()
    model = fit_features(marked.where("split = 'train'"))
    train = gathered(with_features(marked.where("split = 'train'"), model), rows).persist()
    val = with_features(marked.where("split = 'val'"), model).persist()
    with ThreadPoolExecutor(parallelism) as pool:
        rows = list(pool.map(lambda t: record(t, run_trial(train, val, t, num_labels, seed)), trials))
    for kept in (train, val, marked):
        kept.unpersist()
    return rows


def completed(trials: DataFrame) -> DataFrame:
    return trials.where("state = 'COMPLETE'")


def best_trial(trials: DataFrame) -> DataFrame:
    return completed(trials).orderBy(F.desc("value"), "trial_id").limit(1)


def trial_log(trials: DataFrame, params: tuple[str, ...] = ("model_name", "lr", "batch", "epochs"), metrics: tuple[str, ...] = METRICS) -> DataFrame:
    """Long table ``trial_id, kind, key, value`` of parameters and non-null metrics."""

    def pair(kind: str, c: str) -> Column:
        return F.struct(F.lit(kind).alias("kind"), F.lit(c).alias("key"), F.col(c).cast("string").alias("value"))

    entries = F.array(*[pair("param", p) for p in params], *[pair("metric", m) for m in metrics])
    return trials.select("trial_id", F.explode(entries).alias("e")).select("trial_id", "e.*").where("value is not null")


def vocabulary(texts: DataFrame, min_count: int = 1) -> DataFrame:
    """``word, token_id`` by falling frequency, from 2; 0 is padding and 1 an unknown word.

    All words have an id unless the caller asks for a least count.
    """
    words = texts.select(F.explode_outer(T.word_list(F.lower("text"))).alias("word")).where("word is not null")
    counts = words.groupBy("word").agg((-F.count("*")).alias("falling"), F.lit(1).alias("one")).where(F.col("falling") <= -min_count)
    return running(counts, [], ["falling", "word"], {"rank": "one"}).select("word", (F.col("rank") + 1).cast("int").alias("token_id"))


def encode_ids(texts: DataFrame, vocab: DataFrame, max_len: int = MAX_TOKENS) -> DataFrame:
    """``doc_id, input_ids, attention_mask``: the first ``max_len`` words as ids, padded to that length."""
    words = F.slice(T.word_list(F.lower("text")), 1, max_len)
    placed = texts.select("doc_id", F.posexplode_outer(words).alias("place", "word"))
    known = placed.join(vocab, "word", "left")
    token = F.when(F.col("word").isNotNull(), F.struct("place", F.coalesce("token_id", F.lit(1)).alias("id")))
    ids = known.groupBy("doc_id").agg(F.transform(F.sort_array(F.collect_list(token)), lambda x: x["id"]).alias("ids"))
    missing = F.lit(max_len) - F.size("ids")
    return ids.select(
        "doc_id", F.concat("ids", F.array_repeat(F.lit(0), missing)).alias("input_ids"),
        F.concat(F.array_repeat(F.lit(1), F.size("ids")), F.array_repeat(F.lit(0), missing)).alias("attention_mask"),
    )
