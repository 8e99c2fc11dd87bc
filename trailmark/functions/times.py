"""Epoch milliseconds, timestamps and day buckets. None of these depends on the session time zone."""

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY_MS = 86_400_000
HOUR_MS = 3_600_000


def to_millis(ts: Column) -> Column:
    return F.unix_millis(ts)


def day_of(ts: Column) -> Column:
    """UTC calendar day."""
    return F.date_from_unix_date(F.floor(F.unix_millis(ts) / DAY_MS).cast("int"))


def slice_of(ts: Column, width_ms: int) -> Column:
    """Number of the fixed-width time slice that holds `ts`."""
    return F.floor(F.unix_millis(ts) / width_ms)
