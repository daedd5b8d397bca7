"""Writers for profiles and result tables. Each call writes one directory of part files."""

from __future__ import annotations

from pyspark.sql import DataFrame


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def append_results(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)
