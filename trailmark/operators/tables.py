"""Stored tables: de-duplication, scoped reads, retention, deliveries and delivery statistics."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trailmark import schemas as S
from trailmark.functions.times import DAY_MS, HOUR_MS, day_of
from trailmark.operators.slices import with_previous, with_running_total


def dedup_latest(df: DataFrame, keys: Sequence[str] = S.EVENT_KEYS, version: str = "ingested_at") -> DataFrame:
    """One row per key, the one with the highest version.

    Equal versions are settled by the other columns, so the result does not depend on arrival order. The maximum is
    folded per task first: any number of copies of a row leaves each task as one row.
    """
    rest = [name for name in df.columns if name not in {*keys, version}]
    best = df.groupBy(*keys).agg(F.max(F.struct(version, *rest)).alias("_best"))
    return best.select(*keys, "_best.*").select(*df.columns)


def union_deliveries(*deliveries: DataFrame) -> DataFrame:
    """Deliveries appended to each other; `dedup_latest` collapses what came twice."""
    whole = deliveries[0]
    for delivery in deliveries[1:]:
        whole = whole.unionByName(delivery)
    return whole


def latest_by_key(df: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The last state per key, as a compacted log keeps it."""
    rest = [name for name in df.columns if name not in {*key, *order}]
    last = df.groupBy(*key).agg(F.max(F.struct(*order, *rest)).alias("_last"))
    return last.select(*key, "_last.*").select(*df.columns)


def for_tenant(df: DataFrame, tenant_id: str | None) -> DataFrame:
    """Rows of one tenant. Without a tenant there are none."""
    return df.filter(F.lit(False)) if tenant_id is None else df.filter(F.col("tenant_id") == tenant_id)


def lookup(df: DataFrame, tenant_id: str | None, **equals) -> DataFrame:
    """A tenant's rows whose columns equal the given values."""
    df = for_tenant(df, tenant_id)
    for name, value in equals.items():
        df = df.filter(F.col(name) == value)
    return df


def session_events(events: DataFrame, tenant_id: str, session_id: str) -> DataFrame:
    """All events of one session in order. The filter is on key columns, so it may run before de-duplication."""
    own = lookup(events, tenant_id, session_id=session_id)
    return dedup_latest(own).orderBy("ts", "event_id")


def session_chunks(manifest: DataFrame, tenant_id: str, session_id: str) -> DataFrame:
    own = lookup(manifest, tenant_id, session_id=session_id)
    return dedup_latest(own, S.CHUNK_KEYS).orderBy("chunk_seq")


def events_layout(df: DataFrame, ts: str = "ts") -> DataFrame:
    """Adds the day the rows are partitioned by."""
    return df.withColumn("event_date", day_of(F.col(ts)))


def expire(df: DataFrame, ts: str, days: int, now: Column, day: str | None = None) -> DataFrame:
    """Rows still inside the retention period; `day` names a partition column, so whole days are skipped unread."""
    oldest = F.timestamp_millis(F.unix_millis(now) - days * DAY_MS)
    kept = df.filter(F.col(ts) >= oldest)
    return kept.filter(F.col(day) >= day_of(oldest)) if day else kept


def expire_by_tenant(df: DataFrame, tenant: DataFrame, ts: str, days: str, now: Column) -> DataFrame:
    """The same with the number of days taken from each row's tenant; rows of unknown tenants go."""
    horizon = tenant.select(F.col("id").alias("tenant_id"), (F.unix_millis(now) - F.col(days) * DAY_MS).alias("_oldest_ms"))
    return df.join(horizon, "tenant_id").filter(F.unix_millis(F.col(ts)) >= F.col("_oldest_ms")).drop("_oldest_ms")


def offset_runs(records: DataFrame, by: Sequence[str] = (), width: int = 1_000_000) -> DataFrame:
    """Runs of consecutive offsets per topic and partition (and `by`), each with the timestamp of its first record.

    A gap between two runs is a hole in the log. Offsets are cut into blocks of `width` and runs are found per block.
    Only runs that touch a block border, at most two per block, are then compared along the whole partition.
    """
    partition = [*by, "topic", "partition"]
    inside = Window.partitionBy(*partition, "_block").orderBy("offset")
    unique = records.groupBy(*partition, "offset").agg(F.min("timestamp").alias("first_timestamp"))
    runs = (
        unique.withColumn("_block", F.floor(F.col("offset") / width))
        .withColumn("_island", F.col("offset") - F.row_number().over(inside))
        .groupBy(*partition, "_block", "_island")
        .agg(
            F.min("offset").alias("first_offset"),
            F.max("offset").alias("last_offset"),
            F.min_by("first_timestamp", "offset").alias("first_timestamp"),
        )
    )
    at_border = (F.col("first_offset") % width == 0) | ((F.col("last_offset") + 1) % width == 0)
    along = Window.partitionBy(*partition).orderBy("first_offset")
    follows = F.coalesce(F.col("first_offset") == F.lag("last_offset").over(along) + 1, F.lit(False))
    columns = [*partition, "first_offset", "last_offset", "first_timestamp"]
    stitched = (
        runs.filter(at_border)
        .withColumn("_starts", (~follows).cast("int"))
        .withColumn("_run", F.sum("_starts").over(along))
        .groupBy(*partition, "_run")
        .agg(
            F.min_by("first_timestamp", "first_offset").alias("first_timestamp"),
            F.min("first_offset").alias("first_offset"),
            F.max("last_offset").alias("last_offset"),
        )
    )
    return runs.filter(~at_border).select(*columns).unionByName(stitched.select(*columns))


def batch_token(records: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """One token per topic (and `by`) for the records of one write; the same records give the same in any order.

    Meant for micro-batches: the list of runs is as short as a batch has partitions and gaps. To compare whole logs,
    compare their `offset_runs`.
    """
    run = F.format_string(
        "%d:%d-%d@%d;", F.col("partition"), F.col("first_offset"), F.col("last_offset"), F.unix_millis("first_timestamp")
    )
    ordered = F.array_sort(F.collect_list(F.struct("partition", "first_offset", run.alias("text"))))
    text = F.array_join(F.transform(ordered, lambda r: r["text"]), "")
    digest = F.substring(F.sha2(text, 256), 1, 32)
    listed = offset_runs(records, by).groupBy(*by, "topic").agg(digest.alias("_digest"))
    return listed.select(*by, "topic", F.concat_ws(":", "topic", "_digest").alias("token"))


def percentiles(df: DataFrame, value: Column, shares: dict[str, float], width: int = 1000) -> DataFrame:
    """One row with the exact nearest-rank percentiles of an integer, and its count `n` and maximum `most`.

    A histogram with cells of `width` tells which cell each percentile lies in, and the values inside that cell which it
    is. Values are counted per task first; the cells depend on the range of the values, not on the number of rows.
    """
    fine = df.select(value.alias("_value")).filter("_value IS NOT NULL").groupBy("_value").agg(F.count("*").alias("_n"))
    fine = fine.withColumn("_cell", F.floor(F.col("_value") / width))
    cells = fine.groupBy("_cell").agg(F.sum("_n").alias("_size"), F.max("_value").alias("_most"))
    upto = Window.orderBy("_cell").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = Window.partitionBy()
    cells = cells.select(
        "_cell",
        (F.sum("_size").over(upto) - F.col("_size")).alias("_before"),
        "_size",
        F.sum("_size").over(whole).alias("n"),
        F.max("_most").over(whole).alias("most"),
    )
    asked = F.array(*[F.struct(F.lit(name).alias("name"), F.ceil(F.col("n") * share).alias("rank")) for name, share in shares.items()])
    asked = cells.select("*", F.inline(asked)).filter("rank > _before AND rank <= _before + _size")
    hits = asked.select("_cell", "name", "n", "most", (F.col("rank") - F.col("_before")).alias("_rest"))
    along = Window.partitionBy("name").orderBy("_value").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inside = fine.join(hits, "_cell").withColumn("_upto", F.sum("_n").over(along)).filter("_upto >= _rest")
    return inside.agg(
        F.max("n").alias("n"),
        F.max("most").alias("most"),
        *[F.min(F.when(F.col("name") == name, F.col("_value"))).alias(name) for name in shares],
    )


def lag_report(events: DataFrame, ts: str = "ts", written: str = "ingested_at") -> DataFrame:
    """How long events take to become queryable: median, 95th percentile and maximum in ms, and rows per second.

    The rate is taken between the first and the last tenth of the rows by write time.
    """
    lag = F.unix_millis(F.col(written)) - F.unix_millis(F.col(ts))
    lags = percentiles(events, lag, {"p50_ms": 0.5, "p95_ms": 0.95})
    times = percentiles(events, F.floor(F.unix_millis(F.col(written)) / 1000), {"_t10": 0.1, "_t90": 0.9})
    both = lags.unionByName(times.select("_t10", "_t90"), allowMissingColumns=True)  # one row each
    both = both.agg(*[F.max(name).alias(name) for name in ("n", "p50_ms", "p95_ms", "most", "_t10", "_t90")])
    rate = F.when(F.col("_t90") > F.col("_t10"), F.col("n") * 0.8 / (F.col("_t90") - F.col("_t10")))
    return both.select(F.coalesce("n", F.lit(0)).alias("n"), "p50_ms", "p95_ms", F.col("most").alias("max_ms"), rate.alias("rows_per_second"))


def session_profile(events: DataFrame) -> DataFrame:
    """Rows, duplicates and event counts by type of every session.

    Duplicates are counted in two steps, first per event id, so that no distinct set of a whole session is ever held.
    """
    copies = events.groupBy("tenant_id", "session_id", "event_id").agg(
        F.count("*").alias("_n"),
        *[F.count_if(F.col("event_type") == kind).alias(f"_{kind}") for kind in S.EVENT_TYPES],
    )
    kinds = [F.sum(f"_{kind}").alias(kind.lower()) for kind in S.EVENT_TYPES]
    return copies.groupBy("tenant_id", "session_id").agg(
        F.sum("_n").alias("n_rows"), (F.sum("_n") - F.count("*")).alias("duplicates"), *kinds
    )


def ordered_rows(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], where: Column, name: str, width_ms: int = HOUR_MS
) -> DataFrame:
    """The matching rows of each key with their 1-based position.

    The row form of collecting and sorting values per key: nothing is gathered into one array, however long the key.
    """
    return with_running_total(df.filter(where), keys, order, F.lit(1), name, width_ms)


def changes(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, width_ms: int = HOUR_MS
) -> DataFrame:
    """Rows whose value differs from the row before; the first row of a key always counts."""
    marked = with_previous(df, keys, order, [value, order[0]], width_ms)
    first = F.col(f"prev_{order[0]}").isNull()
    return marked.filter(first | ~F.col(value).eqNullSafe(F.col(f"prev_{value}"))).drop(
        f"prev_{value}", f"prev_{order[0]}"
    )
