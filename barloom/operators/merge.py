"""Upserts of whole days and comparisons of tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def replace_days(existing: DataFrame, incoming: DataFrame, keys: tuple[str, ...] = ("code", "trade_date")) -> DataFrame:
    """Existing rows of other keys, and all incoming rows."""
    replaced = incoming.select(*keys).distinct()
    return existing.join(replaced, list(keys), "left_anti").select(*existing.columns).unionByName(incoming)


def removed_records(existing: DataFrame, incoming: DataFrame, keys=("code", "trade_date"), record=("code", "timestamp")) -> DataFrame:
    """Rows of replaced keys whose record is not among the incoming ones; a sound merge has none."""
    replaced = existing.join(incoming.select(*keys).distinct(), list(keys), "left_semi")
    return replaced.join(incoming.select(*record).distinct(), list(record), "left_anti")


def same_keys(existing: DataFrame, incoming: DataFrame, keys=("code", "trade_date")) -> DataFrame:
    """Existing rows whose key occurs among the incoming rows."""
    return existing.join(incoming.select(*keys).distinct(), list(keys), "left_semi").select(*existing.columns)


def differing(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows that are in one table more often than in the other, with the side; empty for equal bags."""
    columns = left.columns
    one = left.exceptAll(right.select(*columns)).withColumn("side", F.lit("left"))
    return one.unionByName(right.select(*columns).exceptAll(left).withColumn("side", F.lit("right")))


def newest(base: DataFrame, later: list[DataFrame], keys: tuple[str, ...], broadcast: bool = False) -> DataFrame:
    """The newest row of each key, of a base and later parts in order, each with one row a key.

    Later parts are taken to be small: only they are grouped, and the base stays where it is if they may be broadcast.
    """
    if not later:
        return base
    fresh = later[0]
    if len(later) > 1:
        stacked = fresh.withColumn("_part", F.lit(0))
        for k, part in enumerate(later[1:], 1):
            stacked = stacked.unionByName(part.withColumn("_part", F.lit(k)))
        fresh = stacked.groupBy(*keys).agg(F.max_by(F.struct(*base.columns), "_part").alias("_row")).select("_row.*")
    replaced = fresh.select(*keys)
    return base.join(F.broadcast(replaced) if broadcast else replaced, list(keys), "left_anti").select(*base.columns).unionByName(fresh.select(*base.columns))
