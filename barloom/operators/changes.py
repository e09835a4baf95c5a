"""Comparison of what is there with what state remembers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def missing_sources(known: DataFrame, listed: DataFrame, key: str = "source") -> DataFrame:
    """Remembered sources that the listing no longer has."""
    return known.join(listed.select(key).distinct(), key, "left_anti")


def classify_days(now: DataFrame, cached: DataFrame, keys: tuple[str, ...], same: tuple[str, ...]) -> DataFrame:
    """keys and change (new, revised, reused, removed): equal `same` columns, null-safe, are reused."""
    a = now.select(*keys, *[F.col(c).alias(f"_now_{c}") for c in same], F.lit(True).alias("_now"))
    b = cached.select(*keys, *[F.col(c).alias(f"_was_{c}") for c in same], F.lit(True).alias("_was"))
    equal = F.lit(True)
    for c in same:
        equal = equal & F.col(f"_now_{c}").eqNullSafe(F.col(f"_was_{c}"))
    change = F.when(F.col("_was").isNull(), "new").when(F.col("_now").isNull(), "removed").when(equal, "reused").otherwise("revised")
    return a.join(b, list(keys), "full").select(*keys, change.alias("change"))


def removed_days(cached: DataFrame, inventory: DataFrame, *keys: str) -> DataFrame:
    """Cached days that the file's whole inventory lacks."""
    return cached.join(inventory.select(*keys, "day"), [*keys, "day"], "left_anti")


def change_counts(classified: DataFrame) -> DataFrame:
    return classified.groupBy("change").agg(F.count("*").alias("days"))


def shrunk(now: DataFrame, known: DataFrame, key: str = "source") -> DataFrame:
    """Sources that are smaller than remembered."""
    return now.join(known.select(key, F.col("size").alias("was")), key).where(F.col("size") < F.col("was"))


def relevant_partitions(partitions: DataFrame, days: DataFrame, condition: Column) -> DataFrame:
    """Partitions with a day that meets the condition."""
    return partitions.join(days.where(condition).select("partition").distinct(), "partition", "left_semi")


def covering(requests: DataFrame, receipts: DataFrame, key: str = "source") -> DataFrame:
    """Requests with receipts of the same source whose interval contains theirs."""
    r = receipts.select(F.col(key), F.col("start").alias("receipt_start"), F.col("end").alias("receipt_end"))
    return requests.join(r, key).where((F.col("receipt_start") <= F.col("start")) & (F.col("receipt_end") >= F.col("end")))


def first_around(receipts: DataFrame, start: str, end: str, key: str = "source", carry: tuple[str, ...] = ()) -> DataFrame:
    """key and the first receipt of each key around one interval, by start and then end, with columns that it carries."""
    around = receipts.where((F.col("start") <= start) & (F.col("end") >= end))
    least = F.min(F.struct(F.col("start").alias("receipt_start"), F.col("end").alias("receipt_end"), *carry)).alias("_first")
    return around.groupBy(key).agg(least).select(key, "_first.*")


def first_covering(requests: DataFrame, receipts: DataFrame, key: str = "source", carry: tuple[str, ...] = ()) -> DataFrame:
    """key, start, end of requests that a receipt of their key contains, with the receipt that begins first (of equal ones, the one that ends first) and columns that it carries.

    That receipt is the least (start, end) of those that end no earlier than the request does, so it is a running
    minimum over ends, not a join of intervals. A key's ends are taken month by month, with the least of all later months
    carried in, so that a key with very many receipts is not one task's. Both have YYYYMMDD texts.
    """
    month = F.substring("end", 1, 6).alias("month")
    held = receipts.select(key, month, F.col("end").alias("at"), F.struct("start", "end", *carry).alias("receipt"))
    asked = requests.select(key, month, F.col("end").alias("at"), F.lit(None).cast(held.schema["receipt"].dataType).alias("receipt"), "start")
    # A receipt that ends on the request's day comes before it.
    inside = W.partitionBy(key, "month").orderBy(F.col("at").desc(), F.col("receipt").isNull()).rowsBetween(W.unboundedPreceding, 0)
    rows = held.withColumn("start", F.lit(None).cast("string")).unionByName(asked)
    best = rows.withColumn("inside", F.min("receipt").over(inside)).where("start IS NOT NULL")
    months = rows.groupBy(key, "month").agg(F.min("receipt").alias("least"))
    later = F.min("least").over(W.partitionBy(key).orderBy(F.col("month").desc()).rowsBetween(W.unboundedPreceding, -1))
    carried = months.select(key, "month", later.alias("later"))
    found = best.join(carried, [key, "month"]).withColumn("receipt", F.least("inside", "later"))
    found = found.where(F.col("receipt.start") <= F.col("start"))
    receipt = [F.col("receipt.start").alias("receipt_start"), F.col("receipt.end").alias("receipt_end"), *[F.col(f"receipt.{c}").alias(c) for c in carry]]
    return found.select(key, "start", F.col("at").alias("end"), *receipt)


def corroborated(manifest: DataFrame, cached: DataFrame, keys: tuple[str, ...], same: tuple[str, ...], on: str = "source") -> DataFrame:
    """on, valid: whether the manifest's days and the cached days are the same set with equal columns."""
    classified = classify_days(manifest, cached, (on, *keys), same)
    return classified.groupBy(on).agg(F.bool_and(F.col("change") == "reused").alias("valid"))


def completeness(cached: DataFrame, inventory: DataFrame, key: str = "source") -> DataFrame:
    """key, cached_days, source_days, complete."""
    a = cached.groupBy(key).agg(F.count("*").alias("cached_days"))
    b = inventory.groupBy(key).agg(F.count("*").alias("source_days"))
    return b.join(a, key, "left").select(
        key, F.coalesce("cached_days", F.lit(0)).alias("cached_days"), "source_days",
        (F.coalesce("cached_days", F.lit(0)) == F.col("source_days")).alias("complete"),
    )
