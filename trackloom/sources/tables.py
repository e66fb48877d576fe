"""Tables by name from a folder of Parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """``folder/name.parquet`` (a file or a folder of files). Times without a zone are read as UTC timestamps by the caller."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


class Tables:
    """``Tables(spark, folder).tracks`` reads the table ``tracks`` lazily."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self._spark, self._folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return table(self._spark, self._folder, name)
