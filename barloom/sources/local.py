"""Small driver-side rows as DataFrames."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema


def local_frame(spark: SparkSession, rows: list[tuple], schema: str | T.StructType) -> DataFrame:
    """Rows through Arrow: a local relation in the plan, so that what joins to an empty one is planned away."""
    kinds = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    loose = T.StructType([T.StructField(f.name, f.dataType, True) for f in kinds])
    table = pa.Table.from_pylist([dict(zip(loose.names, r)) for r in rows], schema=to_arrow_schema(loose))
    return spark.createDataFrame(table, loose)


#: Rows of names up to which a frame is broadcast, about 200 bytes each.
BROADCAST_ROWS = 100_000


def hinted(frame: DataFrame, rows: int, limit: int = BROADCAST_ROWS) -> DataFrame:
    """The frame, to be broadcast if it has so few rows, else to be joined as Spark finds best."""
    return frame.hint("broadcast") if rows <= limit else frame
