"""Checks of records and of prices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Bad rows shown in an issue.
SHOWN = 10


def bad_prices(o: Column, h: Column, low: Column, c: Column) -> Column:
    """A zero price, a high below another price or a low above one; equal prices are sound."""
    return (o == 0) | (h == 0) | (low == 0) | (c == 0) | (h < F.greatest(o, low, c)) | (low > F.least(o, h, c))


def bad_price_summary(rows: DataFrame, in_scope: Column, *keys: str, prices=("open", "high", "low", "close"), shown: int = SHOWN, show: tuple[str, ...] = ()) -> DataFrame:
    """Per key and blocking (in scope or not): count, distinct days and the first rows of bad prices."""
    bad = rows.where(bad_prices(*(F.col(p) for p in prices))).withColumn("blocking", in_scope)
    # Places are cut before rows are gathered, so no group collects more than it shows.
    placed = bad.withColumn("place", F.row_number().over(W.partitionBy(*keys, "blocking").orderBy("rec")))
    row = F.struct(F.col("rec").alias("record"), "day", *show, *[F.col(p) for p in prices])
    return placed.groupBy(*keys, "blocking").agg(
        F.count("*").alias("count"),
        F.array_sort(F.collect_set("day")).alias("days"),
        F.array_sort(F.collect_list(F.when(F.col("place") <= shown, row))).alias("rows"),
    )


def first_bad(rows: DataFrame, n: int, *keys: str, prices=("open", "high", "low", "close")) -> DataFrame:
    """The first n bad rows of each key in record order, with their place."""
    bad = rows.where(bad_prices(*(F.col(p) for p in prices)))
    return bad.withColumn("place", F.row_number().over(W.partitionBy(*keys).orderBy("rec"))).where(F.col("place") <= n)


def time_order(records: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """key, breaks, disordered: values that are not positive or not above the one before."""
    step = F.col(value) - F.lag(value).over(W.partitionBy(key).orderBy(order))
    flagged = records.select(key, ((F.col(value) <= 0) | F.coalesce(step <= 0, F.lit(False))).alias("breaks"))
    return flagged.groupBy(key).agg(F.count_if("breaks").alias("breaks"), F.bool_or("breaks").alias("disordered"))
