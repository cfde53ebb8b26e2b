"""Small literal tables: rules, corrections, coefficients."""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def small_frame(spark: SparkSession, rows: Sequence[tuple], schema: T.StructType | str) -> DataFrame:
    """A DataFrame of driver rows as a local relation.

    Going through Arrow keeps the rows in the plan with a known size: no Python
    task reads them back, and Spark broadcasts them only while they are small.
    """
    if isinstance(schema, str):
        schema = T.StructType.fromDDL(schema)
    columns = {f.name: pa.array([r[i] for r in rows]) for i, f in enumerate(schema)}
    return spark.createDataFrame(pa.table(columns), schema=schema)
