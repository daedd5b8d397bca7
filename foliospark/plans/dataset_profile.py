"""Profile a JSON-lines dump and write the report tables."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from foliospark.operators import profile as P
from foliospark.operators.shared import materialise
from foliospark.sources.jsonl import profile_scan
from foliospark.sources.sinks import write_csv, write_json


def profile_dataset(spark: SparkSession, json_path: str, out_dir: str, limit: int | None = None) -> dict[str, str]:
    """One scan of the dump, kept as a narrow table (no abstracts), and all outputs from that.

    Lengths, category counts (most frequent first), the summary, length statistics and the data
    behind the three charts.
    """
    scan = materialise(profile_scan(spark, json_path, limit))
    paths = {name: f"{out_dir}/{name}" for name in (
        "abstract_lengths", "subcategories_counts", "top_categories_counts", "dataset_summary",
        "abstract_length_stats", "top_subcategories", "top_categories", "abstract_length_hist", "abstract_length_density",
    )}
    lengths = scan.where("abstract_length_chars is not null")
    write_csv(lengths.select("row_index", "abstract_length_chars", "abstract_length_tokens"), paths["abstract_lengths"])
    for level, full, top in (
        ("subcategory", "subcategories_counts", "top_subcategories"), ("top_category", "top_categories_counts", "top_categories"),
    ):
        counts = materialise(P.category_counts(scan, level))
        write_csv(counts.orderBy(F.desc("count"), level), paths[full])
        write_csv(P.top_n(counts, level), paths[top])
    write_json(P.dataset_summary(scan), paths["dataset_summary"])
    freq = materialise(P.length_frequencies(scan, F.col("abstract_length_chars")))
    if freq.limit(1).count():
        write_json(P.length_record(freq), paths["abstract_length_stats"])
        bins = P.histogram(freq)
        write_csv(bins, paths["abstract_length_hist"])
        write_csv(P.density(bins), paths["abstract_length_density"])
    return paths
