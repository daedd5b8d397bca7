"""Vector operations: normalisation, concatenation, pooling, centroids."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliospark.functions import vectors as V
from foliospark.operators import cluster as C
from foliospark.operators import embed as E
from foliospark.functions import text as T
from foliospark.operators.shared import spread
from foliospark.plans.catalogue.registry import query, sql_clean, sql_words, table


def embeddings(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding", "label")


def entries(df, key, vec):
    """One row per vector entry."""
    return df.select(key, F.posexplode(vec).alias("i", "x")).select(key, "i", (F.round(F.col("x").cast("double"), 5) + 0.0).alias("value"))


def _entries_sql(key, vec, source):
    return (f", r AS (SELECT {key}, {vec} AS v FROM {source}), u AS (SELECT {key}, unnest(v)::DOUBLE AS x, generate_subscripts(v, 1) - 1 AS i FROM r) "
            f"SELECT {key}, i::INT AS i, round(x, 5) + 0.0 AS value FROM u")


_SQUARE = "list_sum(list_transform({0}, lambda q: q::DOUBLE * q::DOUBLE))"


@query("l2_normalise", f"""
WITH s AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE * (1 + label) * (CASE WHEN vec_id % 50 = 0 THEN 0 ELSE 1 END)) AS v FROM embeddings),
n AS (SELECT vec_id, v, sqrt({_SQUARE.format('v')}) AS n FROM s),
d AS (SELECT vec_id AS doc_id, v, n FROM n) {_entries_sql('doc_id', 'list_transform(v, lambda x: CASE WHEN n > 0 THEN x / n ELSE 0.0 END)', 'd')}""")
def _(spark, sf_dir):
    factor = F.when(F.col("doc_id") % 50 == 0, 0.0).otherwise(1.0 + F.col("label"))
    scaled = embeddings(spark, sf_dir).select("doc_id", F.transform("embedding", lambda x: x.cast("double") * factor).alias("v"))
    return entries(scaled, "doc_id", V.l2_normalise(F.col("v")))


@query("concat_views", f"""
WITH s AS (SELECT vec_id, list_concat(embedding, list_reverse(embedding)) AS v FROM embeddings),
n AS (SELECT vec_id, v, sqrt({_SQUARE.format('v')}) AS n FROM s),
d AS (SELECT vec_id AS doc_id, v, n FROM n) {_entries_sql('doc_id', 'list_transform(v, lambda x: x::DOUBLE / n)', 'd')}""")
def _(spark, sf_dir):
    e = embeddings(spark, sf_dir)
    return entries(e, "doc_id", V.concat_views(F.col("embedding"), F.reverse("embedding")))


@query("precomputed_encoder", f"""
WITH n AS (SELECT vec_id, embedding AS v, sqrt({_SQUARE.format('embedding')}) AS n FROM embeddings),
d AS (SELECT vec_id AS doc_id, v, n FROM n) {_entries_sql('doc_id', 'list_transform(v, lambda x: (x::DOUBLE / n)::FLOAT)', 'd')}""")
def _(spark, sf_dir):
    return entries(E.precomputed(table(spark, sf_dir, "embeddings"), "vec_id", "embedding"), "doc_id", F.col("embedding"))


def word_vectors(spark, sf_dir):
    """The words of ``benchmark``, hashed onto the rows of ``embeddings``."""
    words = table(spark, sf_dir, "benchmark").select(F.explode_outer(T.word_list(T.clean_text(F.col("text")))).alias("word")).where("word is not null").distinct()
    e = table(spark, sf_dir, "embeddings")
    slot = F.conv(F.substring(F.md5("word"), 1, 6), 16, 10).cast("long") % max(1, e.count())
    return words.withColumn("vec_id", slot).join(e, "vec_id").select("word", "embedding")


@query("mean_pool", f"""
WITH bw AS (SELECT DISTINCT unnest({sql_words(sql_clean('text'))}) AS word FROM benchmark),
wv AS (SELECT word, embedding FROM bw JOIN embeddings ON vec_id = ('0x' || md5(word)[1:6])::BIGINT % (SELECT count(*) FROM embeddings)),
dw AS (SELECT doc_id, unnest({sql_words(sql_clean('text'))}[1:256]) AS word FROM documents),
x AS (SELECT doc_id, unnest(embedding) AS e, generate_subscripts(embedding, 1) AS i FROM dw JOIN wv USING (word)),
a AS (SELECT doc_id, i, avg(e::DOUBLE) AS e FROM x GROUP BY 1, 2),
w AS (SELECT max(len(embedding)) AS n FROM embeddings),
g AS (SELECT doc_id, unnest(range(1, n + 1)) AS i FROM documents, w)
SELECT g.doc_id, (g.i - 1)::INT AS i, round(coalesce(e, 0), 5) + 0.0 AS value FROM g LEFT JOIN a ON g.doc_id = a.doc_id AND g.i = a.i""")
def _(spark, sf_dir):
    docs = spread(table(spark, sf_dir, "documents")).select("doc_id", T.word_list(T.clean_text(F.col("text"))).alias("tokens"))
    return entries(E.mean_pool(docs, word_vectors(spark, sf_dir)), "doc_id", F.col("embedding"))


CENTROIDS = """
xs AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings),
ms AS (SELECT label, i, avg(x) AS c FROM xs GROUP BY 1, 2),
cs AS (SELECT label AS cluster, list(c ORDER BY i) AS c FROM ms GROUP BY 1),
ds AS (SELECT vec_id, e.label AS y, cluster,
  list_sum(list_transform(list_zip(embedding, c), lambda p: (p[1]::DOUBLE - p[2]) * (p[1]::DOUBLE - p[2]))) AS d FROM embeddings e, cs)"""


@query("mean_vectors", f"WITH {CENTROIDS}, d AS (SELECT cluster AS label, c FROM cs) {_entries_sql('label', 'c', 'd')}")
def _(spark, sf_dir):
    return entries(E.mean_vectors(embeddings(spark, sf_dir), "label"), "label", F.col("centroid"))


@query("assign_nearest", f"WITH {CENTROIDS} SELECT vec_id AS doc_id, arg_min(cluster, d)::INT AS cluster_id FROM ds GROUP BY vec_id")
def _(spark, sf_dir):
    e = embeddings(spark, sf_dir)
    return C.assign_nearest(e, E.mean_vectors(e, "label"), "label").select("doc_id", "cluster_id")
