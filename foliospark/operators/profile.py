"""Corpus profile: quality counters, category frequencies, length statistics, cluster mix."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliospark.functions import text as T

PERCENTILES = (5, 25, 50, 75, 95)


def category_tokens(df: DataFrame, col: str = "categories") -> DataFrame:
    """One row per category token, with the token and its top level."""
    # explode() would add a size filter below the projection and split every string twice
    words = df.select(F.explode_outer(T.word_list(F.col(col))).alias("subcategory")).where("subcategory is not null")
    return words.withColumn("top_category", T.before_dot(F.col("subcategory")))


def category_counts(df: DataFrame, level: str = "subcategory", col: str = "categories") -> DataFrame:
    return category_tokens(df, col).groupBy(level).count()


def top_n(counts: DataFrame, name: str, n: int = 40) -> DataFrame:
    """Most frequent names; ties by name."""
    return counts.orderBy(F.desc("count"), name).limit(n)


def quality_counters(scan: DataFrame) -> DataFrame:
    """Counters over the rows of ``profile_scan``, in one pass."""
    # The names of the report's counters.
    parsed = F.col("parsed")
    no_abstract = parsed & F.col("abstract_length_chars").isNull()
    no_categories = parsed & F.col("categories").isNull()
    return scan.agg(
        F.count("*").alias("total_lines_seen"),
        F.count_if(parsed).alias("json_rows_parsed"),
        F.count("abstract_length_chars").alias("have_abstract"),
        F.count("categories").alias("have_categories"),
        F.count_if(~parsed).alias("json_parse_error"),
        F.count_if(no_abstract).alias("abstract_missing_or_empty"),
        F.count_if(no_categories).alias("categories_missing_or_empty"),
    )


def distinct_categories(df: DataFrame, col: str = "categories", approximate: bool = False) -> DataFrame:
    """Distinct counts from the frequency table; ``approximate`` uses sketches instead."""
    if approximate:
        return category_tokens(df, col).agg(
            F.approx_count_distinct("subcategory").alias("unique_subcategories"),
            F.approx_count_distinct("top_category").alias("unique_top_categories"),
        )
    names = category_tokens(df, col).distinct()
    return names.agg(
        F.count("*").alias("unique_subcategories"), F.countDistinct("top_category").alias("unique_top_categories")
    )


def dataset_summary(scan: DataFrame) -> DataFrame:
    """The summary record: counters, a map of the non-zero missing-field counts, distinct counts."""
    names = ["json_parse_error", "abstract_missing_or_empty", "categories_missing_or_empty"]
    pairs = F.create_map(*[x for n in names for x in (F.lit(n), F.col(n))])
    counters = quality_counters(scan).select(
        "total_lines_seen", "json_rows_parsed", "have_abstract", "have_categories",
        F.map_filter(pairs, lambda _, n: n > 0).alias("missing_fields"),
    )
    # two one-row frames side by side
    return counters.withColumn("_k", F.lit(1)).join(
        distinct_categories(scan).withColumn("_k", F.lit(1)), "_k"
    ).drop("_k")


def length_frequencies(df: DataFrame, length: Column) -> DataFrame:
    """Distinct lengths with their frequency: the small table all length statistics start from."""
    return df.select(length.cast("long").alias("length")).where("length is not null").groupBy("length").agg(
        F.count("*").alias("n")
    )


def length_stats(freq: DataFrame) -> DataFrame:
    """Count, min, max, mean, median, population deviation and exact percentiles."""
    x, n = F.col("length"), F.col("n")
    total = F.sum(n)
    mean = F.sum(x * n) / total
    std = F.sqrt(F.greatest(F.sum(x.cast("double") * x * n) / total - mean * mean, F.lit(0.0)))
    points = [F.percentile(x, F.lit(p / 100), n).alias(f"p{p}") for p in PERCENTILES]
    return freq.agg(
        total.alias("count"), F.min(x).alias("min"), F.max(x).alias("max"), mean.alias("mean"),
        F.percentile(x, F.lit(0.5), n).alias("median"), std.alias("std"), *points,
    )


def length_record(freq: DataFrame) -> DataFrame:
    """:func:`length_stats` with the percentiles as one nested map, for the JSON sink."""
    stats = length_stats(freq)
    percentiles = F.create_map(*[x for p in PERCENTILES for x in (F.lit(str(p)), F.col(f"p{p}"))])
    return stats.select("count", "min", "max", "mean", "median", "std", percentiles.alias("percentiles"))


def histogram(freq: DataFrame, bins: int = 100) -> DataFrame:
    """Equal-width bins from min to max; the last bin includes the maximum.

    Where all values are equal, the range is widened by a half to both sides, as numpy does.
    """
    edges = freq.agg(
        F.min("length").cast("double").alias("_lo"), F.max("length").cast("double").alias("_hi")
    ).select(
        F.when(F.col("_lo") < F.col("_hi"), F.col("_lo")).otherwise(F.col("_lo") - 0.5).alias("lo"),
        F.when(F.col("_lo") < F.col("_hi"), F.col("_hi")).otherwise(F.col("_hi") + 0.5).alias("hi"),
    )
    keyed = freq.withColumn("_k", F.lit(1)).join(F.broadcast(edges.withColumn("_k", F.lit(1))), "_k")
    place = F.least(F.width_bucket(F.col("length").cast("double"), "lo", "hi", F.lit(bins)), F.lit(bins))
    width = (F.col("hi") - F.col("lo")) / bins
    counted = keyed.withColumn("bin", place.cast("int")).groupBy("bin", "lo", "hi").agg(F.sum("n").alias("n"))
    return counted.select(
        "bin", (F.col("lo") + (F.col("bin") - 1) * width).alias("bin_lo"), (F.col("lo") + F.col("bin") * width).alias("bin_hi"), "n"
    )


def density(hist: DataFrame, points: int = 200) -> DataFrame:
    """Gaussian kernel density on an even grid, from the (at most 100) bin centres and counts.

    Bandwidth by Scott's rule with the sample deviation of the binned values.
    """
    centre = (F.col("bin_lo") + F.col("bin_hi")) / 2
    binned = hist.select(centre.alias("c"), F.col("n").cast("double").alias("n"))
    total = F.sum("n")
    mean = F.sum(F.col("c") * F.col("n")) / total
    var = (F.sum(F.col("c") * F.col("c") * F.col("n")) - total * mean * mean) / (total - 1)
    # the bins travel as one array of at most 100 structs on a single row
    frame = binned.agg(
        total.alias("t"), F.pow(total, F.lit(-0.2)).alias("scott"), F.sqrt(var).alias("sd"),
        F.min("c").alias("lo"), F.max("c").alias("hi"), F.sort_array(F.collect_list(F.struct("c", "n"))).alias("bins"),
    ).withColumn("h", F.col("scott") * F.col("sd"))
    grid = frame.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(points - 1)))).withColumn(
        "x", F.col("lo") + F.col("i") * (F.col("hi") - F.col("lo")) / (points - 1)
    )
    kernel = F.aggregate(
        "bins", F.lit(0.0),
        lambda acc, b: acc + b["n"] * F.exp(-0.5 * F.pow((F.col("x") - b["c"]) / F.col("h"), F.lit(2.0))),
    )
    return grid.select("i", "x", (kernel / (F.col("t") * F.col("h") * F.sqrt(2 * F.pi()))).alias("density"))


def cluster_mix(df: DataFrame, cluster: str = "cluster_id", category: str = "top_category", n: int = 10) -> DataFrame:
    """Size and the ``n`` most frequent categories of each cluster."""
    counts = df.groupBy(cluster, category).agg(F.count("*").alias("n"))
    own = Window.partitionBy(cluster)
    place = F.row_number().over(own.orderBy(F.desc("n"), category))
    ranked = counts.withColumn("size", F.sum("n").over(own)).withColumn("place", place)
    return ranked.where(F.col("place") <= n).select(cluster, "size", "place", category, "n")


def cluster_purity(df: DataFrame, cluster: str = "cluster_id", category: str = "top_category") -> DataFrame:
    """Share of the largest category and the entropy (natural log) of each cluster."""
    n = F.col("n").cast("double")
    total = F.sum(n)
    return df.groupBy(cluster, category).agg(F.count("*").alias("n")).groupBy(cluster).agg(
        F.sum("n").alias("size"), (F.max(n) / total).alias("purity"),
        (F.ln(total) - F.sum(n * F.ln(n)) / total).alias("entropy"),
    )


def cluster_sizes(df: DataFrame, cluster: str = "cluster_id") -> DataFrame:
    return df.groupBy(cluster).agg(F.count("*").alias("size"))
