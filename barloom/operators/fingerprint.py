"""Days of a source: inventory, groups, hashes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from barloom.functions.digest import group_digests, group_hashes
from barloom.operators.decode import to_bars


def day_inventory(rows: DataFrame, *keys: str) -> DataFrame:
    """Distinct days of each key over all rows, whatever the requested scope."""
    return rows.select(*keys, "day").distinct()


def day_groups(rows: DataFrame, *keys: str) -> DataFrame:
    """First record and number of records of each day."""
    return rows.groupBy(*keys, "day").agg(F.min("rec").alias("first_rec"), F.count("*").alias("rows"))


def running_offsets(groups: DataFrame, *keys: str) -> DataFrame:
    """Adds the rows of all earlier days of the key."""
    before = W.partitionBy(*keys).orderBy("day").rowsBetween(W.unboundedPreceding, -1)
    return groups.withColumn("offset", F.coalesce(F.sum("rows").over(before), F.lit(0)))


def raw_hashes(records: DataFrame, *keys: str) -> DataFrame:
    """SHA-256 of each day's record bytes in record order."""
    return group_hashes(records, "rec", *keys, "day")


def fingerprints(records: DataFrame) -> DataFrame:
    """Per source and day: raw_hash, digest, rows and, of daily sources, preclose_raw, the words of the previous close, in one pass.

    Records have days and their source's columns; those of a source are in time order.
    """
    keys = ("source", "code", "market", "period", "kind", "trade_date")
    audited = records.withColumn("audit", F.when(F.col("period") == "1d", F.col("w13")))
    return group_digests(to_bars(audited, "source", "raw", "audit"), *keys, raw=True).withColumnsRenamed({"trade_date": "day", "audit": "preclose_raw"})
