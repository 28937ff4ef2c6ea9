"""Small fixed tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def literal_rows(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A local relation; for tables fixed in code, such as published baselines."""
    return spark.createDataFrame(rows, schema)
