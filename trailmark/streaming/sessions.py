"""Streaming session tracker, the closing job, and the fully stateful session lifecycle."""

import collections
import sys
import threading
import time
from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark import cloudpickle
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from trailmark import schemas as S
from trailmark.functions.times import HOUR_MS
from trailmark.operators import sessions as sessions_ops
from trailmark.operators.ingest import classify_telemetry, decode_envelope, refused_sessions, reject_unknown_refs, split_poison, to_event_rows
from trailmark.session import staged
from trailmark.sources.daytable import DayTable
from trailmark.sources.snapshots import Snapshot
from trailmark.sources.writers import PARQUET, write_dead_letters, write_lifecycle
from trailmark.streaming.counters import Counters

UPDATES_DDL = (
    "id string, tenant_id string, site_id string, anonymous_id string, first_ts timestamp, last_ts timestamp, "
    "last_received timestamp, entry_at timestamp, entry_url string, platform string, browser string, home_day date, "
    "batch_id bigint"
)
OWNERS_DDL = "id string, tenant_id string, home_day date"
# What the tracker looks at of an event.
TRACKED = [
    "event_id", "tenant_id", "site_id", "session_id", "anonymous_id", "ts", "ingested_at", "event_type", "url", "user_agent"
]
STATE_STORE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "256",
}
OPEN, NO_DAY = "open", "unknown"  # parts beside those named by a day
FOLDERS_PER_DAY = 8  # a day in more folders than that is rewritten as one


def session_table(spark: SparkSession, path: str) -> DayTable:
    """Stored sessions: those still open (or to be recomputed) as one part, closed ones by their home day."""
    return DayTable(spark, path, S.STORED_SESSION, "started_at")


def run_session_stream(
    records: DataFrame,
    sites: DataFrame,
    updates_path: str,
    dead_path: str,
    checkpoint: str,
    sessions_path: str | None = None,
    counters_path: str | None = None,
    **trigger,
) -> StreamingQuery:
    """Folds each batch into one update per session and appends the updates.

    Invalid records are skipped, the events job dead-letters them. Records the session store refuses are dead-lettered
    here as they came.

    A session id belongs to the tenant of its first record, in the order of the log, that names a known site. Who that is
    lies in the state of the stream, one small row per session id, and a batch looks up and updates the rows of its own
    sessions only: what it costs does not grow with the batches before. The day of that first event is the session's home
    day, under which it will be stored. A new stream that continues a stored session table takes its owners over once.
    Counters: `sessions_upserted`, and `records_skipped` for refused records.
    """
    spark = records.sparkSession
    good, _ = split_poison(classify_telemetry(decode_envelope(records, "telemetry")))
    carried = [name for name in ("topic", "partition", "offset", "timestamp", "key", "value") if name in records.columns]
    rows = to_event_rows(good.withColumn("_record", F.struct(*carried)), ["_record"]).select("_record", *TRACKED)
    order = [F.col("_record")[name].alias(name) for name in ("timestamp", "partition", "offset") if name in carried]
    # A table, so the planner knows whether they are few.
    listed = f"{checkpoint.rstrip('/')}-sites"
    sites.select("tenant_id", "id").distinct().write.mode("overwrite").parquet(listed)
    sites = spark.read.schema("tenant_id string, id string").parquet(listed)
    known = sites.select("tenant_id", F.col("id").alias("site_id"))
    claim = F.struct(*order, "tenant_id", F.to_date("ts").alias("home_day"))
    claims = rows.join(known, ["tenant_id", "site_id"], "left_semi").select(F.col("session_id").alias("id"), claim.alias("claim"))
    if sessions_path is not None:
        first = {"timestamp": F.lit(0).cast("timestamp"), "partition": F.lit(-1), "offset": F.lit(-1).cast("bigint")}
        order = [first[name].alias(name) for name in first if name in carried]
        stored = F.struct(*order, "tenant_id", "home_day")
        claims = claims.unionByName(stored_owners(spark, sessions_path, checkpoint).select("id", stored.alias("claim")))
    claims = claims.groupBy("id").agg(F.min("claim").alias("claim"))
    owners = claims.select(F.col("id").alias("session_id"), F.col("claim.tenant_id").alias("_owner"), F.col("claim.home_day").alias("_home"))

    def work(batch: DataFrame, batch_id: int) -> None:
        # The state has been updated by the time the batch is there; to read it twice would do that again.
        with staged(batch, f"{checkpoint.rstrip('/')}-batch") as batch:
            store(batch, batch_id)

    def store(batch: DataFrame, batch_id: int) -> None:
        counters = Counters(counters_path, "sessions", batch_id)
        held = batch.filter("_owner IS NOT NULL").select(F.col("session_id").alias("id"), F.col("_owner").alias("tenant_id"), "_home")
        events = batch.filter("_owner IS NULL").drop("_owner", "_home")
        unwanted = refused_sessions(events, sites, held).persist()
        try:
            unwanted.count()  # from here on the planner knows their number, most often none
            checked = reject_unknown_refs(events, sites, held, unwanted)
            home = held.select("id", F.col("_home").alias("home_day"))
            updates = sessions_ops.session_updates(checked.filter("reason IS NULL")).join(home, "id")
            (
                counters.observe(updates, sessions_upserted=F.count(F.lit(1)))
                .withColumn("batch_id", F.lit(batch_id).cast("bigint"))
                .write.mode("overwrite")
                .options(**PARQUET)
                .partitionBy("batch_id")
                .parquet(updates_path)
            )
            refused = checked.filter("reason IS NOT NULL").select("_record.*", "reason")
            refused = counters.observe(refused, records_skipped=F.count(F.lit(1)))
            write_dead_letters(refused, dead_path, batch_id, "sessions")
            counters.store(batch.sparkSession)
        finally:
            unwanted.unpersist()

    both = rows.unionByName(owners, allowMissingColumns=True)
    writer = both.writeStream.outputMode("update").foreachBatch(work).option("checkpointLocation", checkpoint)
    with state_on_disk(spark):
        return writer.queryName("sessions").trigger(**(trigger or {"availableNow": True})).start()


@contextmanager
def state_on_disk(spark: SparkSession) -> Iterator[None]:
    """Queries started inside keep their state in RocksDB, with one bound on its memory for each executor.

    The store that Spark has by default holds all state on the heap, which grows with the number of session ids. A query
    that goes on from a checkpoint keeps the store it was begun with.
    """
    before = {name: spark.conf.get(name, None) for name in STATE_STORE}
    try:
        for name, value in STATE_STORE.items():
            spark.conf.set(name, value)
        yield
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def stored_owners(spark: SparkSession, sessions_path: str, checkpoint: str) -> DataFrame:
    """Owners of the sessions stored when the stream first started, as a stream that is read once."""
    seed = Snapshot(spark, f"{checkpoint.rstrip('/')}-owners", StructType.fromDDL(OWNERS_DDL))
    if seed.version() is None:
        seed.write(session_table(spark, sessions_path).read().select("id", "tenant_id", "home_day"), 0)
    return spark.readStream.schema(OWNERS_DDL).parquet(f"{seed.path}/data/0")


def read_updates(spark: SparkSession, updates_path: str, after_batch: int = -1) -> DataFrame:
    """Session updates of the batches behind `after_batch`; the batch is a folder, so older ones are not read."""
    try:
        return spark.read.schema(UPDATES_DDL).parquet(updates_path).filter(F.col("batch_id") > after_batch)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], UPDATES_DDL)


def current_sessions(base: DataFrame, updates: DataFrame) -> DataFrame:
    """The session table as of now: the last written version with all later updates folded in."""
    return sessions_ops.upsert_sessions(base, sessions_ops.fold_updates(updates.drop("batch_id")))


def run_closer(
    spark: SparkSession,
    sessions_path: str,
    updates_path: str,
    lifecycle_path: str,
    events: DataFrame,
    now: Column,
    idle_ms: int = S.SESSION_IDLE_MS,
    counters_path: str | None = None,
) -> dict[str, int]:
    """One closing pass over everything due: folds updates in, closes and recomputes, publishes, commits.

    A pass reads the open sessions, and of the closed ones only the days that are home to a session with a new update; it
    writes the sessions still open, appends those it closes to their home days, and rewrites only days in which a closed
    session has changed (and days that have come to lie in many folders). All else is kept as it is.

    Lifecycle records are written before the new version is committed. A pass that dies in between is repeated from the
    same version and overwrites its own records. Returns the `version` written and the counters of the pass: rows read and
    written, `sessions_upserted`, `closed`, `recomputed` and `deferred`.
    """
    table = session_table(spark, sessions_path)
    last = table.version()
    entries = [] if last is None else table.entries(last)
    version, last_batch = (0, -1) if last is None else (last + 1, table.mark(entries))
    counters = Counters(counters_path, "closer", version)
    updates = read_updates(spark, updates_path, last_batch)
    newest = updates.agg(F.max("batch_id")).first()[0]
    newest = last_batch if newest is None else newest
    updates = sessions_ops.fold_updates(updates.filter(F.col("batch_id") <= newest).drop("batch_id")).persist()
    still_open = table.read([entry for entry in entries if entry["part"] == OPEN])
    elsewhere = updates.join(still_open.select("id"), "id", "left_anti").persist()

    def entries_of(days: set[str]):
        return [entry for entry in entries if entry["part"] in days]

    # Days as far as the table has them: few lines, whatever the number of sessions.
    day = F.coalesce(F.col("home_day").cast("string"), F.lit(NO_DAY))
    asked = {row[0] for row in elsewhere.select(day).distinct().collect()}
    found = table.read(entries_of(asked)).join(elsewhere.select("id"), "id", "left_semi").persist()
    touched = {row[0] for row in found.select(day).distinct().collect()}
    folders = collections.Counter(entry["part"] for entry in entries if entry["part"] != OPEN)
    rewritten = touched | {day for day, number in folders.items() if number >= FOLDERS_PER_DAY}
    sessions = sessions_ops.upsert_sessions(still_open.unionByName(found), updates).persist()
    held = [updates, elsewhere, found, sessions]
    try:
        claims = sessions_ops.claim_sessions(sessions, now, idle_ms, None)
        oldest = claims.agg(F.min("started_at")).first()[0]
        if oldest is not None and "event_date" in events.columns:
            # no claimed session has older events, so older day partitions are not read
            events = events.filter(F.col("event_date") >= F.date_sub(F.lit(oldest).cast("date"), 1))
        decisions = sessions_ops.decide_closings(sessions, events, now, idle_ms).persist()
        held.append(decisions)
        write_lifecycle(sessions_ops.lifecycle_records(decisions, now), lifecycle_path, version)
        done = {row["action"]: row["count"] for row in decisions.groupBy("action").count().collect()}
        unchanged = table.read(entries_of(rewritten)).join(found.select("id"), "id", "left_anti")
        rows = sessions_ops.apply_closings(sessions, decisions).unionByName(unchanged)
        waits = F.col("ended_at").isNull() | F.col("needs_recompute")
        part = F.when(waits, F.lit(OPEN)).otherwise(day)
        keep = [entry for entry in entries if entry["part"] != OPEN and entry["part"] not in rewritten]
        written = table.write(rows, part, keep, version, newest)
        counters.add(
            closed=done.get("CLOSED", 0),
            recomputed=done.get("UPDATED", 0),
            deferred=done.get("DEFERRED", 0),
            sessions_upserted=updates.count(),
            rows_read=sum(entry["rows"] for entry in entries_of({OPEN} | asked | rewritten)),
            rows_written=written,
        )
        counters.store(spark)
    finally:
        for df in held:
            df.unpersist()
    return {"version": version, **counters.known}


def list_stored_sessions(
    table: DayTable, tenant_id: str | None, *, limit: int = 50, started_to: Column | None = None, after=None, **filters
) -> DataFrame:
    """One page of a tenant's stored sessions, newest first, as `sessions.list_sessions` gives it.

    Parts are read from the latest start on, twice as many each time, until the page is full of sessions that started after
    everything in the parts not read. Parts that lie behind the cursor or the end of the time range are not read at all.
    """
    spark = table.spark
    bounds = [value for value in (started_to, after[0] if after else None) if value is not None]
    ends = spark.range(1).select(*[value.cast("timestamp").alias(f"b{i}") for i, value in enumerate(bounds)]).first() if bounds else ()
    left = [entry for entry in table.entries() if entry["rows"] and all(entry["low"] <= end for end in ends)]
    left.sort(key=lambda entry: entry["high"], reverse=True)
    taken, step = [], 2
    while True:
        taken, left, step = taken + left[:step], left[step:], 2 * step
        page = sessions_ops.list_sessions(table.read(taken), tenant_id, limit=limit, started_to=started_to, after=after, **filters)
        if not left:
            return page
        newest = max(entry["high"] for entry in left)
        if page.filter(F.col("started_at") > F.lit(newest)).count() >= limit:
            return page


LIFECYCLE_DDL = (
    "tenant_id string, session_id string, type string, started_at timestamp, ended_at timestamp, "
    "duration_ms bigint, page_count bigint, error_count bigint"
)
_STATE_DDL = "first_ms bigint, last_ms bigint, last_received_ms bigint, pages bigint, errors bigint, page string, closed boolean"


# The processor travels with the query, so executors need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


class SessionLifecycle(StatefulProcessor):
    """State of one session: times, page changes, errors, and whether it has been closed.

    A session is reported as OPEN when first seen and as CLOSED when it has been idle for `idle_ms`, each once. An event
    that comes after that is reported as UPDATED and does not close the session again. A closed session is remembered for
    `keep_ms` after its last event; then its state and timers are gone. State that for any reason misses its timer has a
    time to live. There is one timer at a time, and the state is a handful of numbers however long the session; its rows
    come in bounded pieces.
    """

    def __init__(self, idle_ms: int, keep_ms: int):
        self.idle_ms, self.keep_ms = idle_ms, keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("session", _STATE_DDL, ttlDurationMs=2 * (self.idle_ms + self.keep_ms) + HOUR_MS)

    def set_timer(self, at: int) -> None:
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(at)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        known = self.state.get()
        first, last, received, pages, errors, page, closed = known or (None, None, None, 0, 0, None, False)
        for piece in rows:
            piece = piece.sort_values(["ts_ms", "event_id"])
            low, high = int(piece["ts_ms"].iloc[0]), int(piece["ts_ms"].iloc[-1])
            first = low if first is None else min(first, low)
            last = high if last is None else max(last, high)
            newest = int(piece["received_ms"].max())
            received = newest if received is None else max(received, newest)
            errors += int(piece["is_error"].sum())
            for url in piece.loc[piece["is_page"], "page"]:
                pages += url != page
                page = url
        self.state.update((first, last, received, pages, errors, page, closed))
        now = timerValues.getCurrentProcessingTimeInMs()
        self.set_timer(now + (self.keep_ms if closed else self.idle_ms))
        if closed or not known:
            yield self._record(key, "UPDATED" if closed else "OPEN", first, last, pages, errors)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        known = self.state.get()
        if known is None or known[-1]:
            self.state.clear()
            return
        first, last, _, pages, errors, *_ = known
        self.state.update((*known[:-1], True))
        self.set_timer(timerValues.getCurrentProcessingTimeInMs() + self.keep_ms)
        yield self._record(key, "CLOSED", first, last, pages, errors)

    def close(self) -> None:
        pass

    @staticmethod
    def _record(key, kind, first, last, pages, errors) -> pd.DataFrame:
        tenant, session = key
        return pd.DataFrame(
            {
                "tenant_id": [tenant],
                "session_id": [session],
                "type": [kind],
                "started_at": [pd.Timestamp(first, unit="ms", tz="UTC")],
                "ended_at": [pd.Timestamp(last, unit="ms", tz="UTC")],
                "duration_ms": [max(0, last - first)],
                "page_count": [pages],
                "error_count": [errors],
            }
        )


def session_lifecycle_stream(
    events: DataFrame, idle_ms: int = S.SESSION_IDLE_MS, keep_ms: int = S.MAX_EVENT_AGE_MS
) -> DataFrame:
    """Lifecycle records straight from an event stream, without stored tables.

    A closed session is remembered for `keep_ms`, by default as long as events may be late.

    Counters follow arrival order inside a session; the stored-table job (`run_closer`) recounts exactly. Needs the
    RocksDB state store (`spark.sql.streaming.stateStore.providerClass`) and update output mode. Sessions are the unit
    of state, so feed it de-duplicated events (`stream_dedup`).
    """
    from trailmark.functions.json import prop
    from trailmark.functions.web import cut_fragment

    is_page = (F.col("event_type") == "NAVIGATION") & (prop(F.col("props"), "trigger") != "replaceState")
    narrow = events.select(
        "tenant_id",
        "session_id",
        "event_id",
        F.unix_millis("ts").alias("ts_ms"),
        F.unix_millis("ingested_at").alias("received_ms"),
        F.col("event_type").isin(S.ERROR_TYPES).alias("is_error"),
        is_page.alias("is_page"),
        cut_fragment(F.col("url")).alias("page"),
    )
    return narrow.groupBy("tenant_id", "session_id").transformWithStateInPandas(
        statefulProcessor=SessionLifecycle(idle_ms, keep_ms),
        outputStructType=LIFECYCLE_DDL,
        outputMode="Update",
        timeMode="ProcessingTime",
    )


def run_until_idle(writer, work, tick: str = "2 seconds", patience_s: float = 600.0) -> None:
    """Runs a query with processing-time timers until its source is read and its state is gone, then stops it.

    `work` is its `foreachBatch`. Such a query has always another batch to run, for its timers, and never ends by itself
    under `availableNow`. A batch without rows and without state after one with rows says that all is done. The batch that
    follows it holds at its end, when its tasks are over, and is stopped there: however long batches take against `tick`,
    there may be no pause between two of them, and no task is interrupted.

    Raises an error if for `patience_s` no batch has had rows or changed the number of rows of state. A batch may run as
    long as it needs.
    """
    started, done = [], threading.Event()

    def held(batch: DataFrame, batch_id: int) -> None:
        work(batch, batch_id)
        if started and is_drained(started[0].recentProgress):
            done.set()
            while started[0].isActive:
                time.sleep(0.05)

    query = writer.foreachBatch(held).trigger(processingTime=tick).start()
    started.append(query)
    seen, left, still, moved = None, 0, False, time.monotonic()
    try:
        while query.isActive and not done.is_set():
            busy, last = query.status["isTriggerActive"], query.lastProgress
            if last is not None and last["batchId"] != seen:
                still = not last["numInputRows"] and state_rows(last) == left
                seen, left, moved = last["batchId"], state_rows(last), moved if still else time.monotonic()
            if (still or not busy) and time.monotonic() - moved > patience_s:
                break
            query.awaitTermination(0.2)
    finally:
        query.stop()
    if not done.is_set():
        raise query.exception() or TimeoutError("the stream was not done in time")


def is_drained(batches) -> bool:
    """If rows have come and the last micro-batch had none and left no state."""
    return any(batch["numInputRows"] for batch in batches) and not batches[-1]["numInputRows"] and not state_rows(batches[-1])


def state_rows(progress) -> int:
    """Rows of state that a micro-batch left behind."""
    return sum(operator["numRowsTotal"] for operator in progress["stateOperators"])
