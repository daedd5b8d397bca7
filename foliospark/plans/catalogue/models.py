"""Model fits over whole tables; checked by rows and properties, as no SQL can fit them."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from foliospark.config import PipelineConfig
from foliospark.functions import text as T
from foliospark.operators import classify as K
from foliospark.operators import cluster as C
from foliospark.operators import embed as E
from foliospark.operators import mixture
from foliospark.operators import profile as P
from foliospark.operators import subspace, subwords
from foliospark.operators.density import fit_density
from foliospark.operators.sampling import label_encode, with_representations
from foliospark.operators.shared import materialise, scratch_path, small_batches, spread
from foliospark.operators.sweep import fit_all
from foliospark.plans.catalogue.registry import clean_papers, query, r6, sql_clean, sql_words, table
from foliospark.plans.catalogue.vectors import embeddings


def _encoder(name):
    @query(f"encoder_{name}")
    def _(spark, sf_dir):
        docs = spread(clean_papers(spark, sf_dir))
        return E.fit_encoder(docs, name, "abstract").transform(docs)


for _name in E.ENCODERS:
    _encoder(_name)


def _clustered(spark, sf_dir, algorithm, k=8):
    e = embeddings(spark, sf_dir)
    rows = C.prepared(e)
    return C.FITS[algorithm](rows, k).transform(rows)


@query("kmeans")
def _(spark, sf_dir):
    return _clustered(spark, sf_dir, "KMeans").select("doc_id", "cluster_id")


_START = ((0.1, 0.0, -0.1, 0.05), (-0.1, 0.05, 0.1, 0.0))


@query("mixture_step", f"""
WITH x AS (SELECT embedding[1]::DOUBLE AS a, embedding[2]::DOUBLE AS b, embedding[3]::DOUBLE AS c, embedding[4]::DOUBLE AS d FROM embeddings),
l AS (SELECT *, {' , '.join(f"-0.5 * ((a - ({m[0]}))**2 + (b - ({m[1]}))**2 + (c - ({m[2]}))**2 + (d - ({m[3]}))**2) / 0.02 AS l{i}" for i, m in enumerate(_START))} FROM x),
r AS (SELECT a, b, c, d, 1 / (1 + exp(l1 - l0)) AS r0 FROM l),
p AS (SELECT 0 AS component, r0 AS r, a, b, c, d FROM r UNION ALL SELECT 1, 1 - r0, a, b, c, d FROM r),
m AS (SELECT component, sum(r) AS n, sum(r * a) / sum(r) AS ma, sum(r * b) / sum(r) AS mb, sum(r * a * a) / sum(r) AS aa, sum(r * a * b) / sum(r) AS ab FROM p GROUP BY 1)
SELECT component, round(n / (SELECT sum(n) FROM m), 6) AS weight, round(ma, 6) AS mean_a, round(mb, 6) AS mean_b,
       round(aa - ma * ma + 1e-5, 6) AS var_a, round(ab - ma * mb, 6) AS cov_ab FROM m""")
def _(spark, sf_dir):
    """One step of a mixture of two components over four dimensions, from fixed parameters."""
    rows = embeddings(spark, sf_dir).select(F.slice("embedding", 1, 4).alias("embedding"))
    start = mixture.Mixture(np.array([0.5, 0.5]), np.array(_START), np.stack([0.02 * np.eye(4)] * 2))
    model, _ = mixture.em_step(rows, start)
    found = [(j, float(model.weights[j]), *map(float, model.means[j][:2]), float(model.covariances[j][0, 0]), float(model.covariances[j][0, 1])) for j in range(2)]
    out = spark.createDataFrame(found, "component int, weight double, mean_a double, mean_b double, var_a double, cov_ab double")
    return out.select("component", *[(F.round(c, 6) + 0.0).alias(c) for c in out.columns[1:]])


@query("kmeans_fixed_point", "SELECT count(*) AS fitted, 0::BIGINT AS moved FROM embeddings")
def _(spark, sf_dir):
    """A fit has come to rest: every row is in the cluster whose mean is nearest to it."""
    labelled = _clustered(spark, sf_dir, "KMeans").select("doc_id", "embedding", F.col("cluster_id").alias("fitted_id")).persist()
    again = C.assign_nearest(labelled, E.mean_vectors(labelled, "fitted_id"), "fitted_id")
    found = again.agg(F.count("*").alias("fitted"), F.count_if(F.col("fitted_id") != F.col("cluster_id")).alias("moved"))
    return found


@query("sweep_fixed_points", """
SELECT k, count(*) AS fitted, 0::BIGINT AS moved FROM embeddings, (SELECT unnest([2, 3, 5])::INTEGER AS k) GROUP BY k""")
def _(spark, sf_dir):
    """All k of a shared sweep have come to rest: every row is in the cluster whose mean is nearest to it."""
    rows = C.prepared(embeddings(spark, sf_dir))
    found = None
    for k, centres in fit_all(rows, [2, 3, 5]).items():
        labelled = centres.transform(rows.select("doc_id", "embedding")).withColumnRenamed("prediction", "fitted_id")
        again = C.assign_nearest(labelled, E.mean_vectors(labelled, "fitted_id"), "fitted_id")
        one = again.agg(F.count("*").alias("fitted"), F.count_if(F.col("fitted_id") != F.col("cluster_id")).alias("moved")).select(F.lit(k).alias("k"), "fitted", "moved")
        found = one if found is None else found.unionByName(one)
    return found


@query("density_label_properties", """
SELECT count(*) AS labelled, true AS ids_contiguous, true AS clusters_large_enough FROM embeddings""")
def _(spark, sf_dir):
    """Every vector has a label, ids count from 0 without a gap, and no cluster is under the minimum size."""
    labels = fit_density(embeddings(spark, sf_dir), (5,))[5].labels()
    sizes = labels.groupBy("cluster_id").agg(F.count("*").alias("n"))
    real = F.col("cluster_id") >= 0
    return sizes.agg(
        F.sum("n").alias("labelled"),
        (F.coalesce(F.max(F.when(real, F.col("cluster_id"))), F.lit(-1)) + 1 == F.count_if(real)).alias("ids_contiguous"),
        (F.coalesce(F.min(F.when(real, F.col("n"))), F.lit(5)) >= 5).alias("clusters_large_enough"),
    )


@query("classifier_validation_rows", """
WITH d AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY md5(concat('42:', doc_id)), doc_id) AS rn FROM documents),
sizes AS (SELECT lang, count(*) AS n, row_number() OVER (ORDER BY lang) - 1 AS y FROM documents GROUP BY lang),
shares AS (SELECT lang, y, n * w / t AS share, w FROM
  (SELECT lang, n, y, sum(n) OVER () AS t, ceil(round(0.2::DOUBLE * sum(n) OVER (), 9)) AS w FROM sizes)),
ranked AS (SELECT lang, y, floor(share) AS base, w - sum(floor(share)) OVER () AS missing,
  row_number() OVER (ORDER BY round(share - floor(share), 9) DESC, y) AS place FROM shares),
quota AS (SELECT lang, y, base + (CASE WHEN place <= missing THEN 1 ELSE 0 END) AS q FROM ranked)
SELECT doc_id, y::INT AS y, 4::INT AS n_scores FROM d JOIN quota USING (lang) WHERE rn <= q""")
def _(spark, sf_dir):
    """The rows a fitted classifier is judged on, with their label and as many scores as classes."""
    return _scored_validation(spark, sf_dir, "naive_bayes").select("doc_id", "y", F.size("scores").alias("n_scores"))


@query("gaussian_mixture")
def _(spark, sf_dir):
    return _clustered(spark, sf_dir, "GMM").select("doc_id", "cluster_id")


@query("cluster_mix_kmeans")
def _(spark, sf_dir):
    """Flagship: category mix per KMeans cluster of hashed TF-IDF vectors."""
    docs = spread(clean_papers(spark, sf_dir)).withColumn("top_category", T.top_category(F.col("categories")))
    vectors = E.fit_encoder(docs, "tfidf_hash", "abstract").transform(docs).join(docs.select("doc_id", "top_category"), "doc_id")
    with small_batches(spark):
        rows = C.prepared(vectors).persist()
        return P.cluster_mix(C.fit_kmeans(rows, 8).transform(rows))


@query("compare_grid", """
SELECT algorithm, true AS has_score, true AS positive_agreement FROM (SELECT unnest(['GMM', 'HDBSCAN', 'KMeans']) AS algorithm)
WHERE (SELECT count(*) FROM embeddings) > 0""")
def _(spark, sf_dir):
    """The encoder by clusterer grid over vectors and the same vectors moved apart by label, so that every algorithm has a result."""
    rows = embeddings(spark, sf_dir)
    apart = rows.withColumn("embedding", F.concat(F.transform("embedding", lambda x: x / 4), F.array(*[F.when(F.col("label") == i, 1.0).otherwise(0.0).cast("float") for i in range(10)])))
    cfg = PipelineConfig(max_k=10, k_step=4, min_cluster_sizes=(5,))
    found = C.compare({"apart": apart}, "label", cfg)
    score = F.when(F.col("algorithm") == "HDBSCAN", F.col("composite")).otherwise(F.col("silhouette"))
    return found.groupBy("algorithm").agg(F.min(score.isNotNull()).alias("has_score"), F.min((F.col("nmi") > 0) & (F.col("ari") > 0)).alias("positive_agreement"))


@query("hybrid_vectors", f"""
WITH c AS (SELECT doc_id, {sql_clean('text')} AS clean FROM documents)
SELECT doc_id, 1536 AS width, CASE WHEN clean = '' THEN 0 ELSE 1 END::DOUBLE AS squared_length FROM c""")
def _(spark, sf_dir):
    """Hybrid mode encodes its parts apart and joins the unit vectors; triples that all documents share and an empty graph weigh nothing."""
    docs = with_representations(spread(clean_papers(spark, sf_dir)))
    vectors = E.fit_encoder(docs, "tfidf_hash", "hybrid").transform(docs)
    squared = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x)
    return vectors.select("doc_id", F.size("embedding").alias("width"), F.round(squared, 3).alias("squared_length"))


@query("k_sweep")
def _(spark, sf_dir):
    found = C.k_sweep(embeddings(spark, sf_dir), [2, 4, 6, 8, 10], "label")
    return found.select("algorithm", "k", "clusters", "ari", "nmi", "silhouette", "silhouette_kind", "error")


@query("density_clusters")
def _(spark, sf_dir):
    model = fit_density(embeddings(spark, sf_dir), (5,))[5]
    return model.labels()


@query("density_size_sweep")
def _(spark, sf_dir):
    e = embeddings(spark, sf_dir)
    rows, _ = C.density_rows(e, "label", PipelineConfig().min_cluster_sizes)
    return C.result_rows(spark, rows).select("algorithm", "min_cluster_size", "clusters", "noise", "noise_frac", "ari", "nmi", "composite")


@query("density_assign")
def _(spark, sf_dir):
    """Fit on the vectors and place their mirror images."""
    e = embeddings(spark, sf_dir)
    model = fit_density(e, (5,))[5]
    return model.assign(e.select("doc_id", F.reverse("embedding").alias("embedding")))


@query("fit_and_assign")
def _(spark, sf_dir):
    e = embeddings(spark, sf_dir)
    fitted = C.fit_final(e, {"algorithm": "KMeans", "k": 6})
    return fitted.transform(e.select("doc_id", F.reverse("embedding").alias("embedding"))).select("doc_id", "cluster_id")


def _labelled(spark, sf_dir):
    docs = spread(clean_papers(spark, sf_dir)).withColumn("lang", T.top_category(F.col("categories")))
    return label_encode(docs, "lang")


def _scored_validation(spark, sf_dir, model_name):
    docs = _labelled(spark, sf_dir)
    texts = docs.select("doc_id", F.col("clean").alias("text"), F.col("lang_enc").cast("double").alias("y"))
    with small_batches(spark):
        marked = K.with_terms(K.stratified_split(texts, "y")).persist()
        model = K.fit_features(marked.where("split = 'train'"))
        train, val = (K.with_features(marked.where(f"split = '{s}'"), model) for s in ("train", "val"))
        return K.train_eval(K.gathered(train, marked.count()).persist(), val, K.Trial(0, model_name, 0.01, 16, 2), 4)


@query("train_and_score")
def _(spark, sf_dir):
    return _scored_validation(spark, sf_dir, "logistic")


def _classifier(model_name):
    @query(f"classifier_{model_name}", f"""
    SELECT '{model_name}' AS model_name, (
      SELECT sum(least(n, greatest(1, ceil(n * 0.2))))::BIGINT > 0 FROM (SELECT lang, count(*) AS n FROM documents GROUP BY lang)) AS has_rows,
      (SELECT count(DISTINCT lang) FROM documents) AS n_scores, true AS scores_are_finite, true AS better_than_the_largest_class""")
    def _(spark, sf_dir):
        """Every validation row has a finite score for each class, and the largest one is right more often than the commonest label."""
        out = _scored_validation(spark, sf_dir, model_name)
        best = F.array_position("scores", F.array_max("scores")) - 1
        counts = out.groupBy("y").agg(F.count("*").alias("n"), F.count_if(best == F.col("y")).alias("right"),
                                      F.min(F.size("scores")).alias("width"), F.min(F.forall("scores", lambda x: ~F.isnan(x))).alias("fine"))
        return counts.agg(F.sum("n").alias("rows"), F.sum("right").alias("right"), F.max("n").alias("most"), F.min("width").alias("width"), F.min("fine").alias("fine")).select(
            F.lit(model_name).alias("model_name"), (F.col("rows") > 0).alias("has_rows"), F.col("width").cast("long").alias("n_scores"),
            F.col("fine").alias("scores_are_finite"), (F.col("right") > F.col("most")).alias("better_than_the_largest_class"))


for _name in sorted(K.RATES):
    _classifier(_name)


@query("resumed_search", "SELECT 2::BIGINT AS trials, 2::BIGINT AS kept, 2::BIGINT AS completed FROM documents HAVING count(*) > 0")
def _(spark, sf_dir):
    """A search that goes on from a journal gives the values of the trials that it does not fit again.

    The seed is one whose first two draws are naive Bayes, the quickest model to fit.
    """
    rows, journal = _labelled(spark, sf_dir), scratch_path(spark)
    first = K.search(rows, "abstract", "lang_enc", n_trials=2, seed=45, journal=journal)
    again = K.search(rows, "abstract", "lang_enc", n_trials=2, seed=45, journal=journal).withColumnsRenamed({"value": "again", "state": "then"})
    return first.join(again.select("trial_id", "again", "then"), "trial_id").agg(
        F.count("*").alias("trials"), F.count_if(F.col("value") == F.col("again")).alias("kept"), F.count_if(F.col("then") == "COMPLETE").alias("completed"))


@query("hyperparameter_search")
def _(spark, sf_dir):
    return K.search(_labelled(spark, sf_dir), "abstract", "lang_enc", n_trials=6)


@query("encode_ids", f"""
WITH w AS (SELECT doc_id, {sql_words('lower(text)')} AS ws FROM documents),
x AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS place FROM w),
n AS (SELECT word, count(*) AS n FROM x GROUP BY 1),
v AS (SELECT word, row_number() OVER (ORDER BY n DESC, word) + 1 AS token_id FROM n),
i AS (SELECT doc_id, list(coalesce(token_id, 1) ORDER BY place) AS ids FROM x LEFT JOIN v USING (word) WHERE place <= 128 GROUP BY 1),
a AS (SELECT d.doc_id, coalesce(ids, []) AS ids FROM documents d LEFT JOIN i ON d.doc_id = i.doc_id)
SELECT doc_id, array_to_string(list_transform(range(0, 128), lambda k: CASE WHEN k < len(ids) THEN ids[k + 1]::INT ELSE 0 END), ',') AS input_ids,
  array_to_string(list_transform(range(0, 128), lambda k: CASE WHEN k < len(ids) THEN 1 ELSE 0 END), ',') AS attention_mask FROM a""")
def _(spark, sf_dir):
    texts = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    ids = K.encode_ids(texts, K.vocabulary(texts))
    return ids.select("doc_id", F.array_join("input_ids", ",").alias("input_ids"), F.array_join("attention_mask", ",").alias("attention_mask"))


@query("tfidf_slots", f"""
WITH w AS (SELECT doc_id, unnest({sql_words(sql_clean('text'))}) AS word FROM documents),
c AS (SELECT doc_id, (('0x' || substr(md5(word), 1, 8))::BIGINT % 262144)::INTEGER AS slot, count(*) AS tf FROM w GROUP BY ALL),
i AS (SELECT slot, ln(((SELECT count(*) FROM documents) + 1.0) / (count(*) + 1)) AS idf FROM c GROUP BY slot)
SELECT doc_id, slot, tf, round(tf * idf, 6) AS weight FROM c JOIN i USING (slot) WHERE tf * idf <> 0""")
def _(spark, sf_dir):
    """The weights that the wide encoder decomposes."""
    docs = spread(clean_papers(spark, sf_dir))
    counted = materialise(subspace.counts(docs.select("doc_id", T.word_list(F.col("clean")).alias("tokens"))))
    weights = subspace.weighted(counted, subspace.document_shares(counted, docs.count())).where("doc_id is not null")
    return weights.select("doc_id", "slot", "tf", r6(F.col("weight")).alias("weight"))


#: A small fixed vocabulary: the outer pieces, letters, and common syllables at the start of a word and inside it.
SYLLABLES = ("the", "and", "ing", "tion", "ent", "er", "on", "an", "re", "de", "la", "que", "ción", "mente", "der", "ein", "und", "sch", "keit", "lich")
PIECES = ("[PAD]", "[UNK]", "[CLS]", "[SEP]", *map(chr, range(97, 123)), *(f"##{chr(i)}" for i in range(97, 123)), *SYLLABLES, *(f"##{s}" for s in SYLLABLES), ".", ",")


@query("subword_ids", r"""
WITH RECURSIVE pieces AS (SELECT unnest(range(len(p))) AS id, unnest(p) AS piece FROM (SELECT [%s] AS p)),
w AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{M}\p{N}]+|[^\p{L}\p{M}\p{N}\s\p{Z}]')[1:126] AS ws FROM documents),
x AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS place FROM w),
walk AS (
  SELECT DISTINCT word, 0 AS pos, CAST([] AS BIGINT[]) AS ids FROM x
  UNION ALL
  SELECT word, pos + size, list_append(ids, id) FROM (
    SELECT k.word, k.pos, k.ids, p.id, length(p.piece) - CASE WHEN k.pos > 0 THEN 2 ELSE 0 END AS size,
           row_number() OVER (PARTITION BY k.word, k.pos ORDER BY length(p.piece) DESC) AS r
    FROM walk k JOIN pieces p ON (k.pos = 0 AND p.piece NOT LIKE '##_%%' AND starts_with(k.word, p.piece))
      OR (k.pos > 0 AND p.piece LIKE '##_%%' AND substr(k.word, k.pos + 1, length(p.piece) - 2) = substr(p.piece, 3))
    WHERE k.pos < length(k.word)
  ) WHERE r = 1
),
cut AS (SELECT word, ids FROM walk WHERE pos = length(word) AND length(word) <= 100),
i AS (SELECT doc_id, flatten(list(coalesce(ids, [1]) ORDER BY place))[1:126] AS ids FROM x LEFT JOIN cut USING (word) GROUP BY 1),
a AS (SELECT d.doc_id, list_concat([2], coalesce(ids, []), [3]) AS ids FROM documents d LEFT JOIN i ON d.doc_id = i.doc_id)
SELECT doc_id, array_to_string(list_transform(range(0, 128), lambda k: CASE WHEN k < len(ids) THEN ids[k + 1]::INT ELSE 0 END), ',') AS input_ids,
  len(ids)::INTEGER AS n_ids FROM a""" % ", ".join(f"'{p}'" for p in PIECES))
def _(spark, sf_dir):
    vocab = spark.createDataFrame(list(zip(PIECES, range(len(PIECES)))), "piece string, token_id int")
    ids = subwords.subword_ids(spread(table(spark, sf_dir, "documents").select("doc_id", "text")), vocab)
    return ids.select("doc_id", F.array_join("input_ids", ",").alias("input_ids"), F.aggregate("attention_mask", F.lit(0), lambda a, b: a + b).alias("n_ids"))
