"""Ordered work on keys of any size.

A plain window over a session or a visitor puts all its rows into one task, and one visitor may own a third of a table.
Everything here cuts a key into fixed time slices, works inside (key, slice) groups, and carries what crosses a slice
border through a summary of one row per (key, slice). The summary of a key has as many rows as the key has slices, so
no group grows with the number of events. `order[0]` is always the timestamp that defines the slices.
"""

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trailmark.functions.times import HOUR_MS, slice_of

SLICE = "_slice"


def sliced(df: DataFrame, ts: str = "ts", width_ms: int = HOUR_MS) -> DataFrame:
    return df.withColumn(SLICE, slice_of(F.col(ts), width_ms))


def with_previous(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], values: Sequence[str], width_ms: int = HOUR_MS
) -> DataFrame:
    """Adds `prev_<value>`: the value of the preceding row of the same key, null on the first row.

    Inside a slice that is a plain lag. The first row of a slice follows the last row of the slice before, so first
    and last rows alone, at most two per slice, are compared along the key. Both parts read the same shuffle.
    """
    keys = list(keys)
    inside = Window.partitionBy(*keys, SLICE).orderBy(*order)
    along = Window.partitionBy(*keys).orderBy(*order)
    packed = F.struct(*values)
    rows = (
        sliced(df, order[0], width_ms)
        .withColumn("_prev", F.lag(packed).over(inside))
        .withColumn("_is_last", F.lead(F.lit(1)).over(inside).isNull())
        .withColumn("_is_first", F.col("_prev").isNull())
    )
    inner = rows.filter(~F.col("_is_first"))
    border = rows.filter(F.col("_is_first") | F.col("_is_last")).withColumn("_prev", F.lag(packed).over(along))
    whole = inner.unionByName(border.filter("_is_first"))
    return whole.withColumns({f"prev_{value}": F.col("_prev")[value] for value in values}).drop(
        SLICE, "_prev", "_is_first", "_is_last"
    )


def with_running_total(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], value: Column, name: str, width_ms: int = HOUR_MS
) -> DataFrame:
    """Adds the running sum of `value` over the rows of each key, the current row included."""
    keys = list(keys)
    rows = sliced(df.withColumn("_value", value), order[0], width_ms)
    inside = Window.partitionBy(*keys, SLICE).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*keys).orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy(*keys, SLICE).agg(F.sum("_value").alias("_sum"))
    offsets = sums.select(*keys, SLICE, F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_offset"))
    joined = rows.withColumn("_inside", F.sum("_value").over(inside)).join(offsets, [*keys, SLICE])
    return joined.withColumn(name, F.col("_inside") + F.col("_offset")).drop(SLICE, "_value", "_inside", "_offset")


def attach_per_key(
    df: DataFrame, per_key: DataFrame, keys: Sequence[str], ts: str = "ts", width_ms: int = HOUR_MS
) -> DataFrame:
    """Inner join with a table of one row per key, spread over the slices the key really covers.

    The small side is first multiplied to (key, slice); the rows then join on both, so a hot key is worked on by as
    many tasks as it has slices.
    """
    keys = list(keys)
    rows = sliced(df, ts, width_ms)
    spread = rows.select(*keys, SLICE).distinct().join(per_key, keys)
    return rows.join(spread, [*keys, SLICE]).drop(SLICE)


def with_key_value(
    df: DataFrame,
    keys: Sequence[str],
    name: str,
    partial: Column,
    merge: Callable[[str], Column],
    ts: str = "ts",
    width_ms: int = HOUR_MS,
) -> DataFrame:
    """Adds an aggregate over all rows of each key, such as its first time.

    `partial` is taken per slice and `merge` combines the slices of a key, as in `F.min("ts")` and `F.min`. The rows
    are joined per slice, so a hot key is worked on by as many tasks as it has slices.
    """
    keys = list(keys)
    rows = sliced(df, ts, width_ms)
    summary = rows.groupBy(*keys, SLICE).agg(partial.alias("_partial"))
    whole = summary.select(*keys, SLICE, merge("_partial").over(Window.partitionBy(*keys)).alias(name))
    return rows.join(whole, [*keys, SLICE]).drop(SLICE)


def with_neighbours(
    df: DataFrame,
    keys: Sequence[str],
    measures: dict[str, Column],
    before_ms: int,
    after_ms: int,
    ts: str = "ts",
    width_ms: int = HOUR_MS,
) -> DataFrame:
    """Adds aggregates over the rows of the same key from `before_ms` before to `after_ms` after each row.

    A row is copied into the neighbouring slices its time reaches. With slices at least as wide as the reach there is
    at most one copy on either side, and the copies leave again right after the window.
    """
    width_ms = max(width_ms, before_ms, after_ms)
    ms = F.unix_millis(F.col(ts))
    reached = F.sequence(F.floor((ms - after_ms) / width_ms), F.floor((ms + before_ms) / width_ms))
    copies = df.withColumn("_ms", ms).withColumn(SLICE, F.explode(reached))
    frame = Window.partitionBy(*keys, SLICE).orderBy("_ms").rangeBetween(-before_ms, after_ms)
    for name, measure in measures.items():
        copies = copies.withColumn(name, measure.over(frame))
    return copies.filter(F.col(SLICE) == F.floor(F.col("_ms") / width_ms)).drop(SLICE, "_ms")
