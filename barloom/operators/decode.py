"""Records to bars."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.functions.clock import compact_day, market_clock
from barloom.operators.scope import bucket_of

#: An amount's high word up to which the 64-bit value can be computed in longs without overflow.
_HIGH = 2**21


def amount_inexact(low: Column, high: Column) -> Column:
    return (high > _HIGH) | ((high == _HIGH) & (low > 0))


def amount_of(low: Column, high: Column) -> Column:
    """Double of the joint word; null where it is not exact."""
    return F.when(~amount_inexact(low, high), (low + high * F.lit(2**32)).cast("double"))


def with_days(records: DataFrame) -> DataFrame:
    """Adds clock and day of each record."""
    timed = records.withColumn("clock", market_clock(F.col("w0")))
    return timed.withColumn("day", compact_day(F.col("clock")))


def to_bars(records: DataFrame, *keep: str) -> DataFrame:
    """Bar columns, partition columns and columns to keep of records that have clock, day, code, market, period and kind."""
    price = lambda k: (F.col(k) / 1000).cast("double")
    return records.select(
        F.col("day").alias("trade_date"), "code", F.col("market").alias("exchange"),
        F.date_format("clock", "yyyy-MM-dd HH:mm:ss").alias("datetime"), F.date_format("clock", "HH:mm").alias("minute"),
        (F.col("w0") * 1000).alias("timestamp"),
        price("w1").alias("open"), price("w2").alias("high"), price("w3").alias("low"), price("w4").alias("close"),
        F.col("w6").alias("volume"), amount_of(F.col("w8"), F.col("w9")).alias("amount"),
        "kind", "period", bucket_of(F.col("day"), F.col("period")).alias("bucket"), "market", *keep,
    )
