"""Reductions that reports show."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def issue_counts(issues: DataFrame, key: str = "category") -> DataFrame:
    return issues.groupBy(key).agg(F.count("*").alias("n"))


def top_reasons(issues: DataFrame, n: int = 3, key: str = "reason") -> DataFrame:
    """The n most common reasons with their counts and the number of all reasons."""
    counts = issues.groupBy(key).agg(F.count("*").alias("n"))
    total = counts.agg(F.count("*").alias("reasons"))
    return counts.orderBy(F.desc("n"), key).limit(n).join(F.broadcast(total))


def shown(issues: DataFrame, cap: int, *order: str) -> DataFrame:
    """The first rows up to the cap, and whether there are more."""
    head = issues.orderBy(*order).limit(cap + 1)
    more = head.agg((F.count("*") > cap).alias("more"))
    return head.orderBy(*order).limit(cap).join(F.broadcast(more))


def brief(rows: DataFrame, key: str, value: str, n: int = 2) -> DataFrame:
    """key, head (first n distinct values in order), total."""
    values = F.array_sort(F.collect_set(value))
    return rows.groupBy(key).agg(F.array_join(F.slice(values, 1, n), ",").alias("head"), F.size(values).cast("long").alias("total"))
