"""From failed sources and days to blocked partitions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

GROUP = ("period", "market", "kind")


def blocked_by_source(days: DataFrame, failed: DataFrame) -> DataFrame:
    """partition, code: all partitions that hold a day of a failed source."""
    return days.join(failed.select("source").distinct(), "source", "left_semi").select("partition", "code").distinct()


def blocked_by_day(bad_days: DataFrame) -> DataFrame:
    """partition, code of the very days that are bad."""
    return bad_days.select("partition", "code").distinct()


def groups_without_history(failed: DataFrame, days: DataFrame, group: tuple[str, ...] = GROUP) -> DataFrame:
    """group, code of failed sources that have no cached day: where they belong is unknown, so all of the group is blocked."""
    return failed.join(days.select("source").distinct(), "source", "left_anti").select(*group, "code").distinct()


def blocked_in_groups(rows: DataFrame, groups: DataFrame, group: tuple[str, ...] = GROUP) -> DataFrame:
    return rows.join(groups.select(*group).distinct(), list(group), "left_semi")


def blocking_codes(blocked: DataFrame, *keys: str) -> DataFrame:
    """keys, codes: sorted codes that block each key."""
    return blocked.groupBy(*keys).agg(F.array_sort(F.collect_set("code")).alias("codes"))


def affected_sources(pending: DataFrame, days: DataFrame) -> DataFrame:
    """partition, source: every source with a pending or a cached day in a partition that has pending days."""
    touched = pending.select("partition").distinct()
    return pending.select("partition", "source").unionByName(days.join(touched, "partition", "left_semi").select("partition", "source")).distinct()
