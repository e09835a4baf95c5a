"""Date, code and partition scopes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def in_days(day: Column, start: str | None, end: str | None) -> Column:
    """Both ends included; an open end is no condition. Days are YYYYMMDD texts."""
    out = F.lit(True)
    if start:
        out = out & (day >= start)
    if end:
        out = out & (day <= end)
    return out


def select_days(rows: DataFrame, start: str | None, end: str | None, also: DataFrame | None = None, on: tuple[str, ...] = ()) -> DataFrame:
    """Rows of the days, and rows that match `also` on the given columns whatever their day."""
    inside = rows.where(in_days(F.col("day"), start, end))
    if also is None:
        return inside
    outside = rows.where(~in_days(F.col("day"), start, end)).join(also.select(*on).distinct(), list(on), "left_semi")
    return inside.unionByName(outside)


def in_request(rows: DataFrame, periods: tuple[str, ...], codes: tuple[str, ...] = ()) -> DataFrame:
    out = rows.where(F.col("period").isin(*periods))
    return out.where(F.col("code").isin(*codes)) if codes else out


def partition_overlaps(day: Column, period: Column, start: str, end: str) -> Column:
    """Whether a day's output partition, a month of daily or a day of minute bars, overlaps the days."""
    month = F.substring(day, 1, 6).between(start[:6], end[:6])
    return F.when(period == "1d", month).otherwise(day.between(start, end))


def bucket_of(day: Column, period: Column) -> Column:
    return F.when(period == "1d", F.substring(day, 1, 6)).otherwise(day)


def partition_of(kind: Column, period: Column, day: Column, market: Column) -> Column:
    """Relative directory of the output partition that holds a day."""
    return F.concat(F.lit("data/kind="), kind, F.lit("/period="), period, F.lit("/bucket="), bucket_of(day, period), F.lit("/market="), market)
