"""Registration and the shared input views."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.functions import text as T

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` in the shape of paper records."""
    return table(spark, sf_dir, "documents").select(
        "doc_id", F.col("text").alias("abstract"),
        F.concat("lang", F.lit("."), "source", F.lit(" src."), "source").alias("categories"),
    )


def r6(c: Column) -> Column:
    return F.round(c.cast("double"), 6)


def clean_papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return papers(spark, sf_dir).withColumn("clean", T.clean_text(F.col("abstract")))


# the same views in SQL
PAPERS = """
papers AS (
  SELECT doc_id, text AS abstract, concat(lang, '.', source, ' src.', source) AS categories FROM documents
)"""
WS = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"


def sql_clean(c: str) -> str:
    return f"trim(regexp_replace(lower({c}), '{WS}', ' ', 'g'), ' ')"


def sql_words(c: str) -> str:
    return f"list_filter(string_split(regexp_replace({c}, '{WS}', ' ', 'g'), ' '), lambda w: w <> '')"
