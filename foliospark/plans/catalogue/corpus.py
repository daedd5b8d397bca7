"""Sources, sampling, text functions and the corpus profile over ``documents``."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliospark.functions import text as T
from foliospark.operators import profile as P
from foliospark.operators import sampling as S
from foliospark.operators.shared import hash_key, scratch_path
from foliospark.plans.catalogue.registry import PAPERS, clean_papers, papers, query, r6, sql_clean, sql_words, table
from foliospark.sources.jsonl import profile_scan, read_jsonl
from foliospark.sources.sinks import append_results, write_csv, write_json

# ---- sources and sinks -----------------------------------------------------------------------


def _json_lines(spark, sf_dir):
    """The papers as JSON lines in ``doc_id`` order, on scratch storage."""
    path = scratch_path(spark)
    record = F.to_json(F.struct("abstract", "categories"))
    papers(spark, sf_dir).orderBy("doc_id").select(record.alias("value")).write.text(path)
    return path


@query("read_jsonl", f"WITH {PAPERS} SELECT row_number() OVER (ORDER BY doc_id) - 1 AS doc_id, abstract, categories FROM papers")
def _(spark, sf_dir):
    return read_jsonl(spark, _json_lines(spark, sf_dir)).select("doc_id", "abstract", "categories")


@query("read_jsonl_limit", f"""
WITH {PAPERS} SELECT row_number() OVER (ORDER BY doc_id) - 1 AS doc_id, abstract, categories FROM papers
QUALIFY row_number() OVER (ORDER BY doc_id) <= 300""")
def _(spark, sf_dir):
    """The scan with its line limit, which is the feature."""
    return read_jsonl(spark, _json_lines(spark, sf_dir), 300).select("doc_id", "abstract", "categories")


@query("profile_scan_lengths", f"""
WITH {PAPERS}
SELECT row_number() OVER (ORDER BY doc_id) - 1 AS row_index, length(abstract) AS abstract_length_chars,
       len({sql_words('abstract')})::INT AS abstract_length_tokens
FROM papers""")
def _(spark, sf_dir):
    scan = profile_scan(spark, _json_lines(spark, sf_dir))
    return scan.where("abstract_length_chars is not null").select(
        "row_index", F.col("abstract_length_chars").cast("long").alias("abstract_length_chars"), "abstract_length_tokens"
    )


@query("lengths_csv", f"""
WITH {PAPERS} SELECT doc_id, length(abstract) AS abstract_length_chars, len({sql_words('abstract')})::BIGINT AS abstract_length_tokens
FROM papers""")
def _(spark, sf_dir):
    path = scratch_path(spark)
    a = F.col("abstract")
    write_csv(papers(spark, sf_dir).select(
        "doc_id", T.char_count(a).alias("abstract_length_chars"), T.token_count(a).alias("abstract_length_tokens")), path)
    return spark.read.option("header", True).schema("doc_id long, abstract_length_chars long, abstract_length_tokens long").csv(path)


@query("length_stats_json", """
SELECT count(*) AS "count", min(n_chars) AS "min", max(n_chars) AS "max", round(avg(n_chars), 6) AS mean,
       median(n_chars)::DOUBLE AS median, round(quantile_cont(n_chars, 0.95), 6) AS p95
FROM documents""")
def _(spark, sf_dir):
    path = scratch_path(spark)
    write_json(P.length_record(P.length_frequencies(papers(spark, sf_dir), T.char_count(F.col("abstract")))), path)
    back = spark.read.schema(
        "count long, min long, max long, mean double, median double, std double, percentiles map<string,double>"
    ).json(path)
    return back.select("count", "min", "max", r6(F.col("mean")).alias("mean"), "median", r6(F.col("percentiles")["95"]).alias("p95"))


@query("append_results", """
SELECT lang, count(*) AS n FROM documents GROUP BY lang
UNION ALL SELECT source AS lang, count(*) AS n FROM documents GROUP BY source""")
def _(spark, sf_dir):
    path = scratch_path(spark)
    docs = table(spark, sf_dir, "documents")
    append_results(docs.groupBy("lang").agg(F.count("*").alias("n")), path)
    append_results(docs.groupBy(F.col("source").alias("lang")).agg(F.count("*").alias("n")), path)
    return spark.read.schema("lang string, n long").parquet(path)


# ---- sampling and splitting ------------------------------------------------------------------


@query("shuffle", "SELECT doc_id, md5(concat('42:', doc_id)) AS sort_key FROM documents ORDER BY sort_key, doc_id")
def _(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id")
    return S.shuffle(docs).withColumn("sort_key", hash_key("doc_id", 42))


@query("split_first_n", """
WITH k AS (SELECT doc_id, row_number() OVER (ORDER BY md5(concat('42:', doc_id)), doc_id) - 1 AS position FROM documents)
SELECT doc_id, position, CASE WHEN position < 600 THEN 'cluster' ELSE 'class' END AS split FROM k WHERE position < 900""")
def _(spark, sf_dir):
    return S.split_first_n(table(spark, sf_dir, "documents").select("doc_id"), 600, 300)


@query("select_text_abstract", f"SELECT doc_id, {sql_clean('text')} AS text FROM documents")
def _(spark, sf_dir):
    return S.select_text(clean_papers(spark, sf_dir), "abstract")


@query("select_text_triples", """
WITH w AS (SELECT doc_id, list_filter(string_split(replace(text, chr(10), ' '), ' '), lambda x: x <> '') AS ws FROM documents)
SELECT doc_id, array_to_string(list_transform(range(0, len(ws) // 3), lambda i: concat(ws[3 * i + 1], ' ', ws[3 * i + 2], ' ', ws[3 * i + 3])), ' ; ') AS text FROM w""")
def _(spark, sf_dir):
    """Triples given as a list, each from three words of the text."""
    words = F.filter(F.split(F.translate("abstract", "\n", " "), " "), lambda w: w != "")
    rows = papers(spark, sf_dir).select("doc_id", words.alias("w"), F.lit("").alias("clean"))
    places = F.filter(F.sequence(F.lit(0), F.size("w")), lambda i: 3 * i + 2 < F.size("w"))
    triples = F.transform(places, lambda i: F.struct(F.get("w", 3 * i).alias("s"), F.get("w", 3 * i + 1).alias("r"), F.get("w", 3 * i + 2).alias("o")))
    return S.select_text(rows.withColumn("triples", triples), "triples")


@query("split_sample", """
WITH k AS (SELECT doc_id, row_number() OVER (ORDER BY md5(concat('42:', doc_id)), doc_id) AS place FROM documents)
SELECT doc_id, CASE WHEN place <= 600 THEN 'cluster' ELSE 'class' END AS split FROM k""")
def _(spark, sf_dir):
    return S.split_sample(table(spark, sf_dir, "documents").select("doc_id"), 600)


@query("text_representations", f"""
WITH c AS (SELECT doc_id, {sql_clean('text')} AS clean FROM documents)
SELECT doc_id, concat(clean, ' ', '(unk, unk, unk)') AS abstract_triples,
       concat('ABSTRACT: ', clean, ' [SEP] TRIPLES: (unk, unk, unk) [SEP] GRAPH: ') AS hybrid, '' AS graph_text
FROM c""")
def _(spark, sf_dir):
    return S.with_representations(clean_papers(spark, sf_dir)).select("doc_id", "abstract_triples", "hybrid", "graph_text")


@query("drop_rare", """
SELECT doc_id, n_chars FROM documents WHERE n_chars IN (SELECT n_chars FROM documents GROUP BY n_chars HAVING count(*) >= 2)""")
def _(spark, sf_dir):
    return S.drop_rare(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "n_chars").select("doc_id", "n_chars")


@query("rare_count", """
SELECT coalesce(sum(c), 0)::BIGINT AS dropped FROM (SELECT count(*) AS c FROM documents GROUP BY n_chars HAVING count(*) < 2)""")
def _(spark, sf_dir):
    return S.rare_count(table(spark, sf_dir, "documents"), "n_chars")


@query("label_encode", """
SELECT doc_id, source, (dense_rank() OVER (ORDER BY source) - 1)::INT AS source_enc FROM documents""")
def _(spark, sf_dir):
    return S.label_encode(table(spark, sf_dir, "documents").select("doc_id", "source"), "source").select(
        "doc_id", "source", "source_enc"
    )


def _stratified_sql(label: str) -> str:
    return f"""
WITH docs AS (SELECT doc_id, {label} AS lang FROM documents),
d AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY md5(concat('42:', doc_id)), doc_id) AS rn FROM docs),
sizes AS (SELECT lang, count(*) AS n FROM docs GROUP BY lang),
shares AS (SELECT lang, n * w / t AS share, w FROM
  (SELECT lang, n, sum(n) OVER () AS t, ceil(round(0.2::DOUBLE * sum(n) OVER (), 9)) AS w FROM sizes)),
ranked AS (SELECT lang, floor(share) AS base, w - sum(floor(share)) OVER () AS missing,
  row_number() OVER (ORDER BY round(share - floor(share), 9) DESC, lang NULLS FIRST) AS place FROM shares),
quota AS (SELECT lang, base + (CASE WHEN place <= missing THEN 1 ELSE 0 END) AS q FROM ranked)
SELECT doc_id, d.lang, CASE WHEN rn <= q THEN 'val' ELSE 'train' END AS split FROM d JOIN quota ON d.lang IS NOT DISTINCT FROM quota.lang"""


@query("stratified_split", _stratified_sql("lang"))
def _(spark, sf_dir):
    return S.stratified_split(table(spark, sf_dir, "documents").select("doc_id", "lang"), "lang")


@query("stratified_split_null_label", _stratified_sql("nullif(lang, 'fr')"))
def _(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.nullif("lang", F.lit("fr")).alias("lang"))
    return S.stratified_split(docs, "lang")


# ---- text functions --------------------------------------------------------------------------


def _scalar(name, expr, sql_expr):
    @query(name, f"WITH {PAPERS} SELECT doc_id, {sql_expr} AS value FROM papers")
    def _(spark, sf_dir):
        return papers(spark, sf_dir).select("doc_id", expr().alias("value"))


_scalar("clean_text", lambda: T.clean_text(F.col("abstract")), sql_clean("abstract"))
_scalar("top_category", lambda: T.top_category(F.col("categories")), "split_part(split_part(categories, ' ', 1), '.', 1)")
_scalar("char_count", lambda: T.char_count(F.col("abstract")), "length(abstract)::INT")
_scalar("token_count", lambda: T.token_count(F.col("abstract")), f"len({sql_words('abstract')})::INT")
_scalar("newlines_to_spaces", lambda: T.newlines_to_spaces(F.col("abstract")), "replace(abstract, chr(10), ' ')")
_scalar("is_not_blank", lambda: T.is_not_blank(F.col("abstract")), f"{sql_clean('abstract')} <> ''")


@query("category_tokens", f"""
WITH {PAPERS}, t AS (SELECT unnest(string_split(categories, ' ')) AS subcategory FROM papers)
SELECT subcategory, split_part(subcategory, '.', 1) AS top_category FROM t""")
def _(spark, sf_dir):
    return P.category_tokens(papers(spark, sf_dir))


# ---- profile ---------------------------------------------------------------------------------

_TOKENS = f"{PAPERS}, t AS (SELECT unnest(string_split(categories, ' ')) AS subcategory FROM papers)"


@query("subcategory_counts", f"""WITH {_TOKENS} SELECT subcategory, count(*) AS "count" FROM t GROUP BY 1""")
def _(spark, sf_dir):
    return P.category_counts(papers(spark, sf_dir))


@query("top_category_counts", f"""
WITH {_TOKENS} SELECT split_part(subcategory, '.', 1) AS top_category, count(*) AS "count" FROM t GROUP BY 1""")
def _(spark, sf_dir):
    return P.category_counts(papers(spark, sf_dir), "top_category")


@query("distinct_categories", f"""
WITH {_TOKENS} SELECT count(DISTINCT subcategory) AS unique_subcategories,
       count(DISTINCT split_part(subcategory, '.', 1)) AS unique_top_categories FROM t""")
def _(spark, sf_dir):
    return P.distinct_categories(papers(spark, sf_dir))


# Fixed values in the SQL below: the names of the report's counters.
@query("quality_counters", """
SELECT count(*) AS total_lines_seen, count(*) AS json_rows_parsed, count(*) AS have_abstract,
       count(*) AS have_categories, 0::BIGINT AS json_parse_error, 0::BIGINT AS abstract_missing_or_empty,
       0::BIGINT AS categories_missing_or_empty FROM documents""")
def _(spark, sf_dir):
    return P.quality_counters(profile_scan(spark, _json_lines(spark, sf_dir), numbered=False))


def _props_lines(spark, sf_dir):
    """Lines of mixed quality out of ``events``: some not JSON, some without one of the fields."""
    e = table(spark, sf_dir, "events")
    kind = F.col("event_type")
    line = (
        F.when((kind == "error") & (F.col("event_id") % 3 == 0), F.concat(F.to_json(F.struct("props", kind.alias("categories"))), F.lit(" trailing")))
        .when(kind == "error", F.concat(F.lit("error "), "props"))
        .when((kind == "purchase") & (F.col("event_id") % 2 == 0),
              F.concat(F.lit('{"abstract":"NaN is text","score":NaN,"low":-Infinity,"categories":"'), kind, F.lit('"}')))
        .when(kind == "click", F.to_json(F.struct(F.lit(" ").alias("abstract"), kind.alias("categories"))))
        .when(kind == "view", F.to_json(F.struct(F.col("value").alias("abstract"))))
        .otherwise(F.to_json(F.struct(F.col("props").alias("abstract"), kind.alias("categories"))))
    )
    path = scratch_path(spark)
    e.orderBy("event_id").select(line.alias("value")).write.text(path)
    return path


@query("quality_counters_mixed", """
WITH c AS (SELECT count(*) AS n, count(*) FILTER (event_type = 'error') AS bad, count(*) FILTER (event_type = 'click') AS blank,
                  count(*) FILTER (event_type = 'view') AS lacking FROM events)
SELECT n AS total_lines_seen, n - bad AS json_rows_parsed, n - bad - blank - lacking AS have_abstract,
       n - bad - lacking AS have_categories, bad AS json_parse_error, blank + lacking AS abstract_missing_or_empty,
       lacking AS categories_missing_or_empty FROM c""")
def _(spark, sf_dir):
    return P.quality_counters(profile_scan(spark, _props_lines(spark, sf_dir), numbered=False))


@query("read_jsonl_mixed", """
SELECT row_number() OVER (ORDER BY event_id) - 1 AS at, event_type,
       CASE WHEN event_type = 'click' THEN ' ' WHEN event_type = 'purchase' AND event_id % 2 = 0 THEN 'NaN is text' ELSE props END AS abstract
FROM events QUALIFY event_type NOT IN ('error', 'view')""")
def _(spark, sf_dir):
    """Lines of mixed quality: text behind the object, bare non-finite numbers, missing fields."""
    return read_jsonl(spark, _props_lines(spark, sf_dir)).select(
        F.col("doc_id").alias("at"), F.col("categories").alias("event_type"), "abstract")


@query("dataset_summary", f"""
WITH {_TOKENS}, d AS (SELECT count(DISTINCT subcategory) AS unique_subcategories,
  count(DISTINCT split_part(subcategory, '.', 1)) AS unique_top_categories FROM t)
SELECT (SELECT count(*) FROM documents) AS total_lines_seen, (SELECT count(*) FROM documents) AS json_rows_parsed,
       0::INT AS missing_kinds, unique_subcategories, unique_top_categories FROM d""")
def _(spark, sf_dir):
    return P.dataset_summary(profile_scan(spark, _json_lines(spark, sf_dir), numbered=False)).select(
        "total_lines_seen", "json_rows_parsed", F.size("missing_fields").alias("missing_kinds"),
        "unique_subcategories", "unique_top_categories",
    )


def _lengths(spark, sf_dir):
    return P.length_frequencies(papers(spark, sf_dir), T.char_count(F.col("abstract")))


@query("length_stats", """
SELECT count(*) AS "count", min(n_chars) AS "min", max(n_chars) AS "max", round(avg(n_chars), 6) AS mean,
       median(n_chars)::DOUBLE AS median, round(stddev_pop(n_chars), 6) AS std,
       round(quantile_cont(n_chars, 0.05), 6) AS p5, round(quantile_cont(n_chars, 0.25), 6) AS p25,
       round(quantile_cont(n_chars, 0.5), 6) AS p50, round(quantile_cont(n_chars, 0.75), 6) AS p75,
       round(quantile_cont(n_chars, 0.95), 6) AS p95
FROM documents""")
def _(spark, sf_dir):
    stats = P.length_stats(_lengths(spark, sf_dir))
    return stats.select("count", "min", "max", *[r6(F.col(c)).alias(c) for c in ("mean", "median", "std", "p5", "p25", "p50", "p75", "p95")])


_BINS = """
b AS (SELECT min(n_chars)::DOUBLE AS lo, max(n_chars)::DOUBLE AS hi FROM documents),
h AS (SELECT least(floor((n_chars - lo) / ((hi - lo) / 100))::INT + 1, 100) AS bin, count(*) AS n, lo, hi
      FROM documents, b GROUP BY ALL),
hist AS (SELECT bin, lo + (bin - 1) * (hi - lo) / 100 AS bin_lo, lo + bin * (hi - lo) / 100 AS bin_hi, n FROM h)"""


@query("length_histogram", f"WITH {_BINS} SELECT bin, round(bin_lo, 6) AS bin_lo, round(bin_hi, 6) AS bin_hi, n::BIGINT AS n FROM hist")
def _(spark, sf_dir):
    h = P.histogram(_lengths(spark, sf_dir))
    return h.select("bin", r6(F.col("bin_lo")).alias("bin_lo"), r6(F.col("bin_hi")).alias("bin_hi"), "n")


@query("length_density", f"""
WITH {_BINS}, c AS (SELECT (bin_lo + bin_hi) / 2 AS c, n::DOUBLE AS n FROM hist),
m AS (SELECT sum(n) AS t, sum(c * n) / sum(n) AS mu, min(c) AS lo, max(c) AS hi FROM c),
s AS (SELECT t, lo, hi, pow(t, -0.2) * sqrt((SELECT sum(c * c * n) FROM c) / (t - 1) - t * mu * mu / (t - 1)) AS h FROM m),
g AS (SELECT i::INT AS i, lo + i * (hi - lo) / 199 AS x, t, h FROM s, range(200) r(i))
SELECT i, round(x, 6) AS x, round(1e6 * sum(n * exp(-0.5 * ((x - c) / h) * ((x - c) / h))) / (t * h * sqrt(2 * pi())), 6) AS density_e6
FROM g, c GROUP BY i, x, t, h""")
def _(spark, sf_dir):
    d = P.density(P.histogram(_lengths(spark, sf_dir)))
    return d.select("i", r6(F.col("x")).alias("x"), r6(F.col("density") * 1e6).alias("density_e6"))


@query("top_subcategories", f"""
WITH {_TOKENS} SELECT subcategory, count(*) AS "count" FROM t GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 40""")
def _(spark, sf_dir):
    return P.top_n(P.category_counts(papers(spark, sf_dir)), "subcategory")


@query("head_categories", f"""
WITH {PAPERS} SELECT split_part(categories, '.', 1) AS top_category, count(*) AS "count" FROM papers GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5""")
def _(spark, sf_dir):
    first = papers(spark, sf_dir).select(T.top_category(F.col("categories")).alias("top_category"))
    return P.top_n(first.groupBy("top_category").count(), "top_category", 5)


def _grouped(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(F.col("source").alias("cluster_id"), F.col("lang").alias("top_category"))


@query("cluster_mix", """
WITH c AS (SELECT source AS cluster_id, lang AS top_category, count(*) AS n FROM documents GROUP BY 1, 2),
r AS (SELECT *, sum(n) OVER (PARTITION BY cluster_id)::BIGINT AS size,
             row_number() OVER (PARTITION BY cluster_id ORDER BY n DESC, top_category) AS place FROM c)
SELECT cluster_id, size, place::INT AS place, top_category, n FROM r WHERE place <= 10""")
def _(spark, sf_dir):
    return P.cluster_mix(_grouped(spark, sf_dir))


@query("cluster_purity", """
WITH c AS (SELECT source AS cluster_id, lang, count(*) AS n FROM documents GROUP BY 1, 2),
p AS (SELECT cluster_id, n, n / sum(n) OVER (PARTITION BY cluster_id) AS p FROM c)
SELECT cluster_id, sum(n)::BIGINT AS size, round(max(p), 6) AS purity, round(-sum(p * ln(p)), 6) AS entropy FROM p GROUP BY 1""")
def _(spark, sf_dir):
    p = P.cluster_purity(_grouped(spark, sf_dir))
    return p.select("cluster_id", "size", r6(F.col("purity")).alias("purity"), r6(F.col("entropy")).alias("entropy"))


@query("cluster_sizes", "SELECT source AS cluster_id, count(*) AS size FROM documents GROUP BY 1")
def _(spark, sf_dir):
    return P.cluster_sizes(_grouped(spark, sf_dir))
