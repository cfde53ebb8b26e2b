"""Parquet tables: stages between jobs, dimensions, demographic facts, geometry."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Stage:
    """Named intermediate tables in one shared folder."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def write(self, df: DataFrame, name: str, partition_by: Sequence[str] = ()) -> DataFrame:
        """Write and read back, so later steps start from files and not from the plan before."""
        df.write.mode("overwrite").partitionBy(*partition_by).parquet(self.path(name))
        return self.read(name)

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(self.path(name))


def load(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def dimension(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Distinct rows of a lookup."""
    return df.select(*cols).distinct()


def demographics(df: DataFrame, level: str, year: int, cols: dict[str, str]) -> DataFrame:
    """One level and year of a demographic table partitioned by (level, year), columns renamed."""
    picked = df.filter((F.col("level") == level) & (F.col("year") == year))
    return picked.select(*[F.col(old).alias(new) for new, old in cols.items()])


def without_geometry(df: DataFrame, geometry: str = "rings") -> DataFrame:
    return df.drop(geometry)
