"""The market clock: UTC seconds plus a fixed offset, whatever the session's time zone."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from barloom.schema import CLOCK_OFFSET


def market_clock(seconds: Column) -> Column:
    """Local wall clock as a timestamp without zone."""
    return F.make_timestamp_ntz(*[F.lit(x) for x in (1970, 1, 1, 0, 0, 0)]) + F.make_dt_interval(secs=seconds + CLOCK_OFFSET)


def compact_day(clock: Column) -> Column:
    return F.date_format(clock, "yyyyMMdd")
