"""Small tables from Python rows."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema


def small_table(spark: SparkSession, rows: list[tuple], schema: T.StructType) -> DataFrame:
    """A settings table as a local relation. Unlike a frame made from an RDD its size is known to
    the optimizer, which is what lets it decide on a broadcast."""
    names = schema.fieldNames()
    data = pa.Table.from_pylist([dict(zip(names, row)) for row in rows],
                                schema=to_arrow_schema(schema))
    return spark.createDataFrame(data, schema)
