"""Clustering and classification metrics, selection and trial tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliospark.functions.vectors import argmax
from foliospark.operators import classify as K
from foliospark.operators import cluster as C
from foliospark.operators import metrics as M
from foliospark.operators.embed import mean_vectors
from foliospark.operators.sampling import label_encode
from foliospark.plans.catalogue.registry import query, r6, table
from foliospark.plans.catalogue.vectors import CENTROIDS, embeddings

# ---- agreement of two groupings --------------------------------------------------------------



def _agreement(i="") -> str:
    """ARI and NMI of the columns a and b of view ``p{i}``, as view ``agreement{i}``."""
    pairs = "sum(n * (n - 1) / 2)"
    return f"""
c{i} AS (SELECT a, b, count(*)::DOUBLE AS n FROM p{i} GROUP BY 1, 2),
ra{i} AS (SELECT a, sum(n) AS na FROM c{i} GROUP BY 1), rb{i} AS (SELECT b, sum(n) AS nb FROM c{i} GROUP BY 1),
s{i} AS (SELECT (SELECT sum(n) FROM c{i}) AS t, (SELECT {pairs} FROM c{i}) AS ij, (SELECT sum(na * (na - 1) / 2) FROM ra{i}) AS i,
  (SELECT sum(nb * (nb - 1) / 2) FROM rb{i}) AS j, (SELECT -sum(na / t0 * ln(na / t0)) FROM ra{i}, (SELECT sum(n) AS t0 FROM c{i})) AS ha,
  (SELECT -sum(nb / t0 * ln(nb / t0)) FROM rb{i}, (SELECT sum(n) AS t0 FROM c{i})) AS hb,
  (SELECT sum(n / t0 * ln(n * t0 / (na * nb))) FROM c{i} JOIN ra{i} USING (a) JOIN rb{i} USING (b), (SELECT sum(n) AS t0 FROM c{i})) AS mi),
agreement{i} AS (SELECT (ij - i * j / (t * (t - 1) / 2)) / ((i + j) / 2 - i * j / (t * (t - 1) / 2)) AS ari, 2 * mi / (ha + hb) AS nmi FROM s{i})"""


@query("adjusted_rand", f"WITH p AS (SELECT lang AS a, source AS b FROM documents), {_agreement()} SELECT round(ari, 6) AS ari FROM agreement")
def _(spark, sf_dir):
    return M.partition_agreement(table(spark, sf_dir, "documents"), "lang", "source").select(r6(F.col("ari")).alias("ari"))


@query("normalised_mutual_information", f"""
WITH p AS (SELECT o_orderpriority AS a, o_custkey AS b FROM orders), {_agreement()} SELECT round(nmi, 6) AS nmi FROM agreement""")
def _(spark, sf_dir):
    return M.partition_agreement(table(spark, sf_dir, "orders"), "o_orderpriority", "o_custkey").select(r6(F.col("nmi")).alias("nmi"))


@query("silhouette_exact", """
WITH n AS (SELECT label, count(*) AS size FROM embeddings GROUP BY 1),
d AS (SELECT x.vec_id, x.label AS own, y.label AS other, sum(list_distance(x.embedding::DOUBLE[], y.embedding::DOUBLE[])) AS total
  FROM embeddings x, embeddings y WHERE x.vec_id <> y.vec_id GROUP BY 1, 2, 3),
m AS (SELECT vec_id, max(CASE WHEN own = other THEN total / (size - 1) END) AS a, min(CASE WHEN own <> other THEN total / size END) AS b
  FROM d JOIN n ON other = n.label GROUP BY 1)
SELECT round(avg((b - a) / greatest(a, b)), 6) AS silhouette FROM m""")
def _(spark, sf_dir):
    return M.silhouette_exact(embeddings(spark, sf_dir), "label").select(r6(F.col("silhouette")).alias("silhouette"))


@query("silhouette_squared", """
WITH n AS (SELECT label, count(*) AS size FROM embeddings GROUP BY 1),
d AS (SELECT x.vec_id, x.label AS own, y.label AS other, sum(pow(list_distance(x.embedding::DOUBLE[], y.embedding::DOUBLE[]), 2)) AS total
  FROM embeddings x, embeddings y WHERE x.vec_id <> y.vec_id GROUP BY 1, 2, 3),
m AS (SELECT vec_id, max(CASE WHEN own = other THEN total / (size - 1) END) AS a, min(CASE WHEN own <> other THEN total / size END) AS b
  FROM d JOIN n ON other = n.label GROUP BY 1)
SELECT round(avg((b - a) / greatest(a, b)), 6) AS silhouette FROM m""")
def _(spark, sf_dir):
    return M.silhouette_squared(embeddings(spark, sf_dir), "label").select(r6(F.col("silhouette")).alias("silhouette"))


def _noisy(spark, sf_dir):
    """Labels with a noise bucket: odd labels count as noise."""
    e = embeddings(spark, sf_dir)
    return e.select("doc_id", F.when(F.col("label") % 2 == 1, -1).otherwise((F.col("label") / 2).cast("int")).alias("cluster_id"))


@query("noise_and_clusters", """
SELECT count(*) FILTER (label % 2 = 1) AS noise, round(count(*) FILTER (label % 2 = 1) / count(*), 6) AS noise_frac,
       count(DISTINCT CASE WHEN label % 2 = 1 THEN -1 ELSE label // 2 END) AS clusters FROM embeddings""")
def _(spark, sf_dir):
    return M.noise_and_clusters(_noisy(spark, sf_dir), "cluster_id").select("noise", r6(F.col("noise_frac")).alias("noise_frac"), "clusters")


@query("relabel_noise", """
SELECT vec_id AS doc_id, (CASE WHEN label % 2 = 1 THEN (SELECT count(DISTINCT label) FROM embeddings WHERE label % 2 = 0)
  ELSE label // 2 END)::INT AS cluster_id FROM embeddings""")
def _(spark, sf_dir):
    labels = _noisy(spark, sf_dir)
    n = labels.where("cluster_id >= 0").agg(F.countDistinct("cluster_id")).first()[0]
    return C.relabel_noise(labels, n)


# ---- predictions: each vector scored by its distance to the mean vector of every label --------


def predictions(spark, sf_dir):
    e = embeddings(spark, sf_dir)
    centres = mean_vectors(e, "label").orderBy("label").collect()  # one row per label

    def score(centre):
        pairs = F.zip_with("embedding", F.lit(centre), lambda x, c: (x.cast("double") - c) * (x.cast("double") - c))
        return F.round(-F.aggregate(pairs, F.lit(0.0), lambda s, x: s + x), 9)

    return e.select("doc_id", F.col("label").alias("y"), F.array(*[score(r["centroid"]) for r in centres]).alias("scores"))


_PREDICTIONS = f"""{CENTROIDS},
sc AS (SELECT vec_id, y, cluster, round(-d, 9) AS s FROM ds),
pr AS (SELECT vec_id, y, list(s ORDER BY cluster) AS scores FROM sc GROUP BY 1, 2),
p AS (SELECT vec_id, y, scores, list_position(scores, list_max(scores)) - 1 AS z FROM pr),
cell AS (SELECT y, z, count(*)::DOUBLE AS n FROM p GROUP BY 1, 2),
cls AS (SELECT label, coalesce(sum(sup), 0) AS sup, coalesce(sum(pre), 0) AS pre, coalesce(sum(hit), 0) AS hit FROM (
  SELECT y AS label, n AS sup, 0 AS pre, CASE WHEN y = z THEN n ELSE 0 END AS hit FROM cell
  UNION ALL SELECT z AS label, 0, n, 0 FROM cell) GROUP BY 1),
m AS (SELECT sup, pre, hit, CASE WHEN pre > 0 THEN hit / pre ELSE 0 END AS p, CASE WHEN sup > 0 THEN hit / sup ELSE 0 END AS r,
  2 * hit / (sup + pre) AS f FROM cls)"""


@query("argmax", f"WITH {_PREDICTIONS} SELECT vec_id AS doc_id, z::INT AS y_pred FROM p")
def _(spark, sf_dir):
    return predictions(spark, sf_dir).select("doc_id", argmax(F.col("scores")).alias("y_pred"))


@query("confusion_matrix", f"WITH {_PREDICTIONS} SELECT y, z::INT AS y_pred, n::BIGINT AS n FROM cell")
def _(spark, sf_dir):
    return M.confusion(M.with_prediction(predictions(spark, sf_dir)))


@query("label_metrics", f"""
WITH {_PREDICTIONS}, t AS (SELECT sum(sup) AS s, sum(hit) AS c, sum(sup * pre) AS pt, sum(pre * pre) AS pp, sum(sup * sup) AS tt,
  avg(f) AS fm, sum(f * sup) / sum(sup) AS fw, avg(p) AS pm, sum(p * sup) / sum(sup) AS pw, avg(r) AS rm, sum(r * sup) / sum(sup) AS rw FROM m)
SELECT round(c / s, 6) AS acc, round(fm, 6) AS f1_macro, round(fw, 6) AS f1_weighted, round(pm, 6) AS precision_macro, round(pw, 6) AS precision_weighted,
  round(rm, 6) AS recall_macro, round(rw, 6) AS recall_weighted, round((c / s - pt / (s * s)) / (1 - pt / (s * s)), 6) AS kappa,
  round((c * s - pt) / (sqrt(s * s - pp) * sqrt(s * s - tt)), 6) AS mcc FROM t""")
def _(spark, sf_dir):
    found = M.label_metrics(M.with_prediction(predictions(spark, sf_dir)))
    return found.select(*[r6(F.col(c)).alias(c) for c in found.columns])


@query("label_metrics_unequal", """
WITH p AS (SELECT quality AS y, CASE WHEN n_chars > 1000 THEN 1 ELSE 0 END AS z FROM labels JOIN documents USING (doc_id)),
q AS (SELECT count(*)::DOUBLE AS s, count(*) FILTER (y = z)::DOUBLE AS c, count(*) FILTER (y = 1)::DOUBLE AS y1, count(*) FILTER (z = 1)::DOUBLE AS z1,
  count(*) FILTER (y = 1 AND z = 1)::DOUBLE AS h1, count(*) FILTER (y = 0 AND z = 0)::DOUBLE AS h0 FROM p),
k AS (SELECT *, s - y1 AS y0, s - z1 AS z0 FROM q)
SELECT round(c / s, 6) AS acc, round((2 * h1 / (y1 + z1) + 2 * h0 / (y0 + z0)) / 2, 6) AS f1_macro,
  round((2 * h1 / (y1 + z1) * y1 + 2 * h0 / (y0 + z0) * y0) / s, 6) AS f1_weighted FROM k""")
def _(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", (F.col("n_chars") > 1000).cast("int").alias("y_pred"))
    both = table(spark, sf_dir, "labels").join(docs, "doc_id").select(F.col("quality").alias("y"), "y_pred")
    return M.label_metrics(both).select(*[r6(F.col(c)).alias(c) for c in ("acc", "f1_macro", "f1_weighted")])


@query("top3_accuracy", f"""
WITH {_PREDICTIONS}, a AS (SELECT t.vec_id, count(*) FILTER (o.s > t.s OR (o.s = t.s AND o.cluster > t.cluster)) AS ahead
  FROM sc t JOIN sc o ON t.vec_id = o.vec_id WHERE t.cluster = t.y GROUP BY 1)
SELECT round(avg(CASE WHEN ahead < 3 THEN 1.0 ELSE 0.0 END), 6) AS top3_acc FROM a""")
def _(spark, sf_dir):
    found = M.top_k_accuracy(predictions(spark, sf_dir), 10)
    return found.select(r6(F.col("top3_acc")).alias("top3_acc"))


@query("roc_auc_macro", f"""
WITH {_PREDICTIONS}, r AS (SELECT y, cluster, rank() OVER (PARTITION BY cluster ORDER BY s) +
  (count(*) OVER (PARTITION BY cluster, s) - 1) / 2.0 AS r FROM sc),
a AS (SELECT cluster, (sum(CASE WHEN y = cluster THEN r ELSE 0 END) - count(*) FILTER (y = cluster) * (count(*) FILTER (y = cluster) + 1) / 2.0)
  / (count(*) FILTER (y = cluster)::DOUBLE * count(*) FILTER (y <> cluster)) AS auc FROM r GROUP BY 1)
SELECT round(avg(auc), 6) AS roc_auc_macro_ovr FROM a""")
def _(spark, sf_dir):
    return M.roc_auc_macro(predictions(spark, sf_dir), 10).select(r6(F.col("roc_auc_macro_ovr")).alias("roc_auc_macro_ovr"))


# ---- selection: groupings of the documents as candidate clusterings, the language as truth ----

_CANDIDATES = (
    ("words", "KMeans", "CASE WHEN instr(text, ' the ') > 0 THEN 1 WHEN instr(text, ' der ') > 0 THEN 2 WHEN instr(text, ' le ') > 0 THEN 3 ELSE 0 END", 4, 0.1),
    ("length", "KMeans", "n_chars % 7", 7, None),
    ("words", "GMM", "CASE WHEN instr(text, ' of ') > 0 THEN 1 WHEN instr(text, ' und ') > 0 THEN 2 ELSE n_chars % 2 END", 3, None),
    ("words", "HDBSCAN", "CASE WHEN instr(text, ' and ') > 0 THEN 1 WHEN instr(text, ' la ') > 0 THEN 2 ELSE 0 END", None, None),
)


def results(spark, sf_dir):
    """Scored candidates, one row each; agreement is computed over all documents."""
    docs = table(spark, sf_dir, "documents")
    out = None
    for embedding, algorithm, expr, k, sil in _CANDIDATES:
        found = M.partition_agreement(docs.withColumn("g", F.expr(expr)), "lang", "g")
        row = found.select(
            F.lit(embedding).alias("embedding"), F.lit(algorithm).alias("algorithm"), F.lit(k).cast("int").alias("k"),
            F.lit(10).cast("long").alias("noise"), "ari", "nmi", F.lit(sil).cast("double").alias("silhouette"), F.lit(None).cast("double").alias("composite"),
        )
        out = row if out is None else out.unionByName(row)
    return out


def _results_sql():
    parts, rows = [], []
    for i, (embedding, algorithm, expr, k, sil) in enumerate(_CANDIDATES):
        parts.append(f"p{i} AS (SELECT lang AS a, {expr} AS b FROM documents), {_agreement(i)}")
        rows.append(f"SELECT '{embedding}' AS embedding, '{algorithm}' AS algorithm, {k or 'NULL'}::INT AS k, 10::BIGINT AS noise, ari, nmi, "
                    f"{sil if sil is not None else 'NULL'}::DOUBLE AS silhouette FROM agreement{i}")
    return ", ".join(parts) + ", results AS (" + " UNION ALL ".join(rows) + ")"


_SCORED = _results_sql() + """, scored AS (SELECT *, nmi + 0.5 * ari + CASE WHEN algorithm = 'HDBSCAN' THEN -0.5 * noise / (SELECT count(*) FROM documents)
  ELSE 0.5 * coalesce(silhouette, 0) END AS score FROM results WHERE ari > 0 AND nmi > 0)"""


@query("positive_score_filter", f"WITH {_results_sql()} SELECT embedding, algorithm, round(ari, 6) AS ari, round(nmi, 6) AS nmi FROM results WHERE ari > 0 AND nmi > 0")
def _(spark, sf_dir):
    return C.scored_pipelines(results(spark, sf_dir), 1).select("embedding", "algorithm", r6(F.col("ari")).alias("ari"), r6(F.col("nmi")).alias("nmi"))


@query("composite_score", f"WITH {_SCORED} SELECT embedding, algorithm, round(score, 6) AS score FROM scored")
def _(spark, sf_dir):
    n = table(spark, sf_dir, "documents").count()
    return C.scored_pipelines(results(spark, sf_dir), n).select("embedding", "algorithm", r6(F.col("score")).alias("score"))


@query("best_clustering", f"""
WITH {_SCORED} SELECT embedding, algorithm, k, round(score, 6) AS score FROM scored ORDER BY score DESC, algorithm, embedding LIMIT 1""")
def _(spark, sf_dir):
    n = table(spark, sf_dir, "documents").count()
    return C.best_pipeline(results(spark, sf_dir), n).select("embedding", "algorithm", "k", r6(F.col("score")).alias("score"))


@query("best_clustering_forced_k", f"""
WITH {_SCORED} SELECT embedding, algorithm, k, round(score, 6) AS score FROM scored WHERE algorithm <> 'HDBSCAN'
ORDER BY score DESC, algorithm, embedding LIMIT 1""")
def _(spark, sf_dir):
    n = table(spark, sf_dir, "documents").count()
    return C.best_pipeline(results(spark, sf_dir), n, force_k=7).select("embedding", "algorithm", "k", r6(F.col("score")).alias("score"))


@query("best_k", """
WITH e AS (SELECT 'KMeans' AS algorithm, (user_id % 20 + 1) * 2 AS k, value FROM events UNION ALL SELECT 'GMM', (user_id % 15 + 1) * 2, value FROM events),
s AS (SELECT algorithm, k, round(avg(value), 6) + 0.5 * round(min(value), 6) + 0.5 * round(stddev_pop(value), 6) AS score FROM e GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY algorithm ORDER BY score DESC, k) AS place FROM s)
SELECT algorithm, k::INT AS k, round(score, 5) AS score FROM r WHERE place = 1""")
def _(spark, sf_dir):
    """Sweep rows whose three parts are statistics of the events."""
    events = table(spark, sf_dir, "events")
    ways = F.explode(F.array(
        F.struct(F.lit("KMeans").alias("algorithm"), ((F.col("user_id") % 20 + 1) * 2).cast("int").alias("k")),
        F.struct(F.lit("GMM").alias("algorithm"), ((F.col("user_id") % 15 + 1) * 2).cast("int").alias("k")),
    ))
    rows = events.select("value", ways.alias("w")).groupBy("w.algorithm", "w.k").agg(
        r6(F.avg("value")).alias("nmi"), r6(F.min("value")).alias("ari"), r6(F.stddev_pop("value")).alias("silhouette"))
    return C.best_k(rows).withColumn("score", F.round("score", 5))


# ---- trials: cut-offs on the document length that predict the quality label -------------------


def trials(spark, sf_dir):
    docs = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents"), "doc_id")
    cuts = docs.withColumn("epochs", F.explode(F.sequence(F.lit(1), F.lit(8))))
    hit = ((F.col("n_chars") > F.col("epochs") * 200) == (F.col("quality") == 1)).cast("double")
    toxic = F.avg(F.when(F.col("toxic") == 1, hit))
    rows = cuts.groupBy("epochs").agg(r6(F.avg(hit)).alias("acc"), r6(toxic).alias("kappa"))
    return rows.select(
        (F.col("epochs") - 1).alias("trial_id"), F.when(F.col("epochs") == 5, "FAIL").otherwise("COMPLETE").alias("state"),
        F.col("acc").alias("value"), F.lit("length").alias("model_name"), "epochs", "acc",
        F.when(F.col("epochs") % 2 == 0, F.col("kappa")).alias("kappa"),
    )


_TRIALS = """
x AS (SELECT epochs::INT AS epochs, ((n_chars > epochs * 200) = (quality = 1))::INT AS hit, toxic FROM labels JOIN documents USING (doc_id), range(1, 9) r(epochs)),
t AS (SELECT epochs - 1 AS trial_id, CASE WHEN epochs = 5 THEN 'FAIL' ELSE 'COMPLETE' END AS state, 'length' AS model_name, epochs,
  round(avg(hit), 6) AS acc, CASE WHEN epochs % 2 = 0 THEN round(avg(hit) FILTER (toxic = 1), 6) END AS kappa FROM x GROUP BY epochs)"""


@query("best_trial", f"""
WITH {_TRIALS} SELECT trial_id, acc AS value, epochs FROM t WHERE state = 'COMPLETE' ORDER BY acc DESC, trial_id LIMIT 1""")
def _(spark, sf_dir):
    return K.best_trial(trials(spark, sf_dir)).select("trial_id", "value", "epochs")


@query("trial_summary", f"WITH {_TRIALS} SELECT trial_id, acc AS value, model_name, epochs, kappa FROM t WHERE state = 'COMPLETE'")
def _(spark, sf_dir):
    return K.completed(trials(spark, sf_dir)).select("trial_id", "value", "model_name", "epochs", "kappa")


@query("trial_log", f"""
WITH {_TRIALS}
SELECT trial_id, 'param' AS kind, 'model_name' AS key, model_name AS value FROM t
UNION ALL SELECT trial_id, 'param', 'epochs', epochs::VARCHAR FROM t
UNION ALL SELECT trial_id, 'metric', 'acc', acc::VARCHAR FROM t
UNION ALL SELECT trial_id, 'metric', 'kappa', kappa::VARCHAR FROM t WHERE kappa IS NOT NULL""")
def _(spark, sf_dir):
    return K.trial_log(trials(spark, sf_dir), ("model_name", "epochs"), ("acc", "kappa"))
