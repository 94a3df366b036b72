"""Readers of a folder with one parquet per table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from voltloom.session import prepare


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The table's lazy scan: columns and filters are pushed into it by the plan that uses it."""
    return prepare(spark).read.parquet(f"{folder}/{name}.parquet")
