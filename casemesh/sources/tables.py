"""Table access. Every operator takes DataFrames; only queries read files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def views(spark: SparkSession, sf_dir: str, *names: str) -> None:
    """Registers tables as temporary views, for plans that are written in SQL."""
    for name in names:
        load(spark, sf_dir, name).createOrReplaceTempView(name)
