import json
import os
import threading
import time
from contextlib import contextmanager

import pytest
from helpers import T0, at, events, moment
from pyspark.sql import functions as F
from test_ingest import ID, chunk, envelope

from trailmark import schemas as S
from trailmark.operators.ingest import classify_telemetry, decode_envelope, to_event_rows
from trailmark.operators.tables import dedup_latest, latest_by_key
from trailmark.sources.readers import read_replay, read_table, read_telemetry
from trailmark.sources.daytable import DayTable
from trailmark.sources.snapshots import Snapshot
from trailmark.sources.writers import compact_events, lifecycle_messages, write_events
from trailmark.streaming import sessions as jobs
from trailmark.streaming.counters import pipeline_totals, read_counters
from trailmark.streaming.events import pipeline_report, run_events_stream, run_replay_stream
from trailmark.streaming.sessions import (
    current_sessions,
    list_stored_sessions,
    read_updates,
    run_closer,
    run_session_stream,
    session_table,
    state_rows,
)


def put(spark, path, values, first=0):
    rows = [("topic", 0, first + i, at(T0), ID.format(3), value) for i, value in enumerate(values)]
    spark.createDataFrame(rows, S.RAW_RECORD).coalesce(1).write.mode("append").parquet(path)


def numbered(n, **changes):
    return envelope(clientEventId=f"0a1b2c3d-0000-7000-8000-{n:012d}", ts=T0 + n * 1000, **changes)


@pytest.fixture
def paths(tmp_path):
    return lambda name: str(tmp_path / name)


def run_events(spark, paths):
    stream = read_telemetry(spark, paths("log"), streaming=True, maxFilesPerTrigger="1")
    query = run_events_stream(stream, paths("events"), paths("dead"), paths("state"))
    query.awaitTermination()
    return query


def test_restart_reads_only_what_is_new(spark, paths):
    put(spark, paths("log"), [numbered(i) for i in range(5)] + ["{broken", numbered(9, type="GAZE")])
    run_events(spark, paths)
    put(spark, paths("log"), [numbered(i) for i in range(3, 8)], first=7)
    query = run_events(spark, paths)
    raw = spark.read.parquet(paths("events"))
    assert raw.count() == 10 and dedup_latest(raw.drop("batch_id", "event_date")).count() == 8
    dead = {(r["reason"], r["offset"], r["consumer"]) for r in spark.read.parquet(paths("dead")).collect()}
    assert dead == {("deserialization", 5, "events"), ("bad_type", 6, "events")}
    assert sum(line["rows"] for line in pipeline_report(query)) == 5
    batch = to_event_rows(classify_telemetry(decode_envelope(read_telemetry(spark, paths("log")), "telemetry")).filter("reason is null"))
    assert {r["event_id"] for r in batch.collect()} == {r["event_id"] for r in raw.collect()}


def test_a_repeated_batch_overwrites_itself(spark, paths):
    rows = events(spark, [("s", f"{i}", i * 40_000_000, "CLICK") for i in range(6)])
    write_events(rows, paths("events"), 0)
    write_events(rows, paths("events"), 0)
    assert spark.read.parquet(paths("events")).count() == 6
    write_events(rows, paths("events"), 1)
    assert spark.read.parquet(paths("events")).count() == 12
    compact_events(spark, paths("events"), paths("compact"))
    assert spark.read.parquet(paths("compact")).count() == 6


def test_replay_payload_and_manifest_agree(spark, paths):
    good = [chunk(chunkSeq=i) for i in range(3)]
    put(spark, paths("log"), good + [chunk(chunkSeq=-1), "{"])
    stream = read_replay(spark, paths("log"), streaming=True)
    run_replay_stream(stream, paths("payloads"), paths("manifest"), paths("dead"), paths("state")).awaitTermination()
    manifest, payloads = spark.read.parquet(paths("manifest")), spark.read.parquet(paths("payloads"))
    assert {r["object_key"] for r in manifest.collect()} == {r["object_key"] for r in payloads.collect()}
    assert {r["chunk_seq"] for r in manifest.collect()} == {0, 1, 2}
    assert json.loads(payloads.first()["payload"])[1]["type"] == 2
    assert {r["reason"] for r in spark.read.parquet(paths("dead")).collect()} == {"invalid_chunk", "deserialization"}


SITE = "id string, tenant_id string"


def track(spark, paths, sites, name="updates", **more):
    stream = read_telemetry(spark, paths("log"), streaming=True)
    query = run_session_stream(stream, sites, paths(name), paths("dead2"), paths(f"state of {name}"), **more)
    query.awaitTermination()
    return query


def test_tracker_and_closer(spark, paths):
    sites = spark.createDataFrame([(ID.format(2), ID.format(1))], SITE)
    counters = paths("counters")

    def close(ms, idle=600_000):
        stored = dedup_latest(spark.read.parquet(paths("events")).drop("batch_id"), ["event_date", *S.EVENT_KEYS])
        return run_closer(spark, paths("sessions"), paths("updates"), paths("lifecycle"), stored, moment(ms), idle, counters)

    put(spark, paths("log"), [numbered(i) for i in range(3)] + [numbered(7, siteId=ID.format(8), sessionId=ID.format(9)), "{broken"])
    run_events(spark, paths)
    track(spark, paths, sites, counters_path=counters)
    assert close(T0 + 3_600_000)["version"] == 0
    put(spark, paths("log"), [numbered(60, type="EXCEPTION", receivedAt="2025-06-15T16:30:00.000Z")])
    run_events(spark, paths)
    track(spark, paths, sites, counters_path=counters)
    table = session_table(spark, paths("sessions"))
    live = current_sessions(table.read(), read_updates(spark, paths("updates"), 0)).collect()
    assert [r["needs_recompute"] for r in live] == [True]
    assert close(T0 + 3_700_000, idle=36_000_000)["version"] == 1
    rows = table.read().collect()
    assert [(r["duration_ms"], r["error_count"], r["needs_recompute"]) for r in rows] == [(60_000, 1, False)]
    lifecycle = spark.read.parquet(paths("lifecycle"))
    assert [r["type"] for r in lifecycle.orderBy("batch_id").collect()] == ["CLOSED", "UPDATED"]
    last = latest_by_key(lifecycle, ["sessionId"], ["publishedAt"]).collect()
    assert [r["errorCount"] for r in last] == [1]
    message = lifecycle_messages(lifecycle.drop("batch_id")).first()
    assert message["key"] == ID.format(3) and json.loads(message["value"])["schemaVersion"] == 1
    dead = spark.read.parquet(paths("dead2")).collect()
    assert [(r["key"], r["reason"], r["consumer"]) for r in dead] == [(ID.format(3), "store_rejected", "sessions")]
    assert json.loads(dead[0]["value"])["sessionId"] == ID.format(9) and dead[0]["topic"]
    totals = {(r["job"], r["name"]): r["value"] for r in pipeline_totals(read_counters(spark, counters)).collect()}
    assert totals["sessions", "sessions_upserted"] == 2 and totals["sessions", "records_skipped"] == 1
    assert (totals["closer", "closed"], totals["closer", "recomputed"], totals["closer", "deferred"]) == (1, 1, 0)


def uid(n):
    return f"0a1b2c3d-0000-7000-9000-{n:012d}"


def test_owner_lookup_follows_the_batch(spark, paths):
    """Who came first keeps an id; state touched by a batch is that of its own sessions, whatever came before."""
    sites = spark.createDataFrame([(uid(n + 20), uid(n)) for n in (1, 4)], SITE)
    own = {"tenantId": uid(1), "siteId": uid(21)}
    for batch in range(4):
        put(spark, paths("log"), [numbered(10 * batch + i, sessionId=uid(100 + 10 * batch + i), **own) for i in range(4)], 10 * batch)
        query = track(spark, paths, sites)
        progress = [line for line in query.recentProgress if line["numInputRows"]][-1]
        assert sum(operator["numRowsUpdated"] for operator in progress["stateOperators"]) == 4
        assert state_rows(progress) == 4 * (batch + 1)
    # Another tenant uses the ids of the first batch, with an earlier time of receipt.
    other = {"tenantId": uid(4), "siteId": uid(24), "receivedAt": "2025-06-15T10:00:00.000Z"}
    put(spark, paths("log"), [numbered(90 + i, sessionId=uid(100 + i), **other) for i in range(4)], 90)
    track(spark, paths, sites)
    owners = {(r["id"], r["tenant_id"]) for r in read_updates(spark, paths("updates")).collect()}
    assert len(owners) == 16 and {tenant for _, tenant in owners} == {uid(1)}
    assert spark.read.parquet(paths("dead2")).count() == 4
    # A stream that starts anew beside the stored sessions takes their owners over, also against the order of the log.
    stored = spark.createDataFrame([(uid(100), uid(4))], "id string, tenant_id string")
    table = session_table(spark, paths("sessions"))
    blank = [F.lit(None).cast(field.dataType).alias(field.name) for field in S.STORED_SESSION if field.name not in stored.columns]
    table.write(stored.select("*", *blank).withColumn("home_day", F.lit("2025-06-01").cast("date")), F.lit("open"), [], 0, -1)
    track(spark, paths, sites, "updates2", sessions_path=paths("sessions"))
    first = {r["id"]: (r["tenant_id"], str(r["home_day"])) for r in read_updates(spark, paths("updates2")).collect()}
    assert first[uid(100)] == (uid(4), "2025-06-01") and first[uid(101)][0] == uid(1)


def test_jobs_hold_no_batch_in_memory(spark, paths, monkeypatch):
    """A batch lies in a table while it is worked on, and owners in a state store on disk, however many there are."""
    from trailmark.streaming import events as event_jobs

    staged, seen = jobs.staged, []

    @contextmanager
    def watched(df, path):
        with staged(df, path) as rows:
            assert not rows.storageLevel.useMemory and rows.inputFiles()
            seen.append((path, rows.count(), [c for c in rows.columns if c == "value" or c == "_record"]))
            yield rows
        assert not os.path.exists(path.removeprefix("file:"))

    for module in (jobs, event_jobs):
        monkeypatch.setattr(module, "staged", watched)
    before = {name: spark.conf.get(name, None) for name in jobs.STATE_STORE}
    put(spark, paths("log"), [numbered(i) for i in range(3)] + [numbered(7, siteId=ID.format(8), sessionId=ID.format(9)), "{broken"])
    track(spark, paths, spark.createDataFrame([(ID.format(2), ID.format(1))], SITE))
    run_events(spark, paths)
    assert {name: spark.conf.get(name, None) for name in jobs.STATE_STORE} == before
    tracker, stored = seen
    assert tracker[1:] == (5, ["_record"]) and stored[1:] == (5, ["value"])  # four events and one owner; five records
    kept = [name for _, _, names in os.walk(tracker[0].removesuffix("-batch") + "/state") for name in names]
    assert any(name.endswith(".zip") for name in kept) and not any(name.endswith(".delta") for name in kept)
    dead = {r["reason"]: r["value"] for r in spark.read.parquet(paths("dead")).collect()}
    assert dead == {"deserialization": "{broken"}
    late = spark.read.parquet(paths("dead2")).collect()
    assert [(r["reason"], json.loads(r["value"])["sessionId"]) for r in late] == [("store_rejected", ID.format(9))]


DAYS = 60


def stored_history(spark, path, closed_per_day=100, still_open=100):
    """Closed sessions of many days, and a hundredth as many open ones, in a stored table."""
    day = 86_400_000
    rows = spark.range(DAYS * closed_per_day + still_open).withColumn("open", F.col("id") >= DAYS * closed_per_day)
    began = F.when(F.col("open"), F.lit(T0)).otherwise(T0 - (DAYS - F.floor(F.col("id") / closed_per_day)) * day)
    rows = rows.withColumn("at", F.timestamp_millis(began + F.col("id") % 50 * 1000))
    values = {
        "id": F.concat(F.lit("s"), "id"),
        "tenant_id": F.lit("t1"),
        "site_id": F.lit("s1"),
        "anonymous_id": F.lit("a"),
        "started_at": F.col("at"),
        "last_active_at": F.col("at"),
        "ended_at": F.when(~F.col("open"), F.col("at")),
        "duration_ms": F.lit(0),
        "page_count": F.lit(1),
        "error_count": F.lit(0),
        "needs_recompute": F.lit(False),
        "version": F.lit(1),
        "home_day": F.to_date("at"),
    }
    fields = [values.get(field.name, F.lit(None)).cast(field.dataType).alias(field.name) for field in S.STORED_SESSION]
    table = session_table(spark, path)
    part = F.when(F.col("ended_at").isNull(), F.lit("open")).otherwise(F.col("home_day").cast("string"))
    table.write(rows.select(*fields), part, [], 0, -1)
    return table


def update_of(spark, path, batch, ids, ms, home_ms):
    rows = [(name, "t1", "s1", "a", at(ms), at(ms), at(ms), None, None, None, None, at(home_ms).date(), batch) for name in ids]
    spark.createDataFrame(rows, jobs.UPDATES_DDL).write.mode("append").partitionBy("batch_id").parquet(path)


def test_a_pass_costs_what_is_due(spark, paths):
    table = stored_history(spark, paths("sessions"))
    total = table.read().count()
    none = events(spark, [("none", "1", 0, "CLICK")])
    day = 86_400_000
    # Open sessions go on, and one closed session of an old day has a late event.
    update_of(spark, paths("updates"), 0, ["s6000", "s6001", "new"], T0 + 1000, T0)
    update_of(spark, paths("updates"), 1, ["s4207"], T0 - 17 * day, T0 - 18 * day)

    def close(ms):
        return run_closer(spark, paths("sessions"), paths("updates"), paths("lifecycle"), none, moment(ms), 600_000)

    before = {(e["part"], e["folder"]) for e in table.entries()}
    done = close(T0 + 2000)
    assert done["rows_read"] < 0.05 * total and done["rows_written"] < 0.05 * total
    assert (done["version"], done["closed"], done["recomputed"], done["sessions_upserted"]) == (1, 0, 1, 4)
    after = {(e["part"], e["folder"]) for e in table.entries()}
    touched = str(at(T0 - 18 * day).date())
    assert before - after == {("open", 0), (touched, 0)} and after - before == {("open", 1), (touched, 1)}
    rows = table.read()
    assert rows.count() == total + 1 and rows.select("id").distinct().count() == total + 1
    late = rows.filter("id = 's4207'").first()
    assert late["ended_at"] == late["started_at"] and not late["needs_recompute"] and late["version"] == 3
    # All open ones are closed by the next pass and appended to their day; nothing else is written again.
    done = close(T0 + 3 * day)
    assert done["closed"] == 101 and done["rows_written"] == 101 and done["rows_read"] == 101
    assert table.read().filter("ended_at IS NULL").count() == 0
    assert not [name for name in table._names("data/0") if name in ("part=open", f"part={touched}")]
    kept = {(e["part"], e["folder"]) for version in (1, 2) for e in table.entries(version)}
    found = {(part[5:], int(folder)) for folder in table._names("data") if folder.isdigit() for part in table._names(f"data/{folder}") if part.startswith("part=")}
    assert found == kept


def test_a_pass_that_dies_changes_nothing(spark, paths, monkeypatch):
    table = stored_history(spark, paths("sessions"), 3, 4)
    update_of(spark, paths("updates"), 0, ["s17", "s180"], T0 + 1000, T0 - 55 * 86_400_000)
    none = events(spark, [("none", "1", 0, "CLICK")])
    before = sorted(map(str, table.read().collect()))

    def close():
        return run_closer(spark, paths("sessions"), paths("updates"), paths("lifecycle"), none, moment(T0 + 86_400_000), 600_000)

    def die(self, df, version):
        raise OSError("lost")

    with monkeypatch.context() as patch:
        patch.setattr(Snapshot, "write", die)
        with pytest.raises(OSError):
            close()
    assert sorted(map(str, table.read().collect())) == before
    assert close()["version"] == 1
    once = spark.read.parquet(paths("lifecycle")).count()
    assert table.read().filter("ended_at IS NULL").count() == 0 and once == 5
    assert table.read().count() == len(before)


def test_days_in_many_folders_become_one(spark, paths):
    rows = stored_history(spark, paths("a"), 1, 0).read().limit(10)
    table = DayTable(spark, paths("b"), S.STORED_SESSION, "started_at")
    for version in range(jobs.FOLDERS_PER_DAY):
        table.write(rows, F.lit("2025-01-01"), table.entries(), version, -1)
    assert len(table.entries()) == jobs.FOLDERS_PER_DAY and table.read().count() == 10 * jobs.FOLDERS_PER_DAY
    none = events(spark, [("none", "1", 0, "CLICK")])
    run_closer(spark, paths("b"), paths("updates"), paths("lifecycle"), none, moment(T0), 600_000)
    assert table.read().count() == 10 * jobs.FOLDERS_PER_DAY
    assert {e["folder"] for e in table.entries()} == {jobs.FOLDERS_PER_DAY}


def test_list_reads_the_newest_days_only(spark, paths):
    table = stored_history(spark, paths("sessions"), 20, 10)
    page = list_stored_sessions(table, "t1", limit=50, is_open=False)
    whole = jobs.sessions_ops.list_sessions(table.read(), "t1", limit=50, is_open=False)
    assert [r["id"] for r in page.collect()] == [r["id"] for r in whole.collect()]
    assert len(page.inputFiles()) < 10 < len(table.read().inputFiles())
    last = page.collect()[-1]
    cursor = (F.lit(last["started_at"]), last["id"])
    following = list_stored_sessions(table, "t1", limit=50, is_open=False, after=cursor)
    whole = jobs.sessions_ops.list_sessions(table.read(), "t1", limit=100, is_open=False)
    assert [r["id"] for r in following.collect()] == [r["id"] for r in whole.collect()][50:]
    assert list_stored_sessions(table, None).count() == 0
    assert list_stored_sessions(table, "t1", limit=10**6).count() == table.read().count()


def test_snapshot_shows_only_committed_versions(spark, paths):
    table = Snapshot(spark, paths("t"), S.END_USER)
    assert table.version() is None and table.read().count() == 0
    row = [("t", "s", "a", at(T0), at(T0), 0)]
    table.write(spark.createDataFrame(row, S.END_USER), 0)
    spark.createDataFrame(row * 3, S.END_USER).write.parquet(paths("t") + "/data/1")
    assert table.version() == 0 and table.read().count() == 1
    table.write(spark.createDataFrame(row * 2, S.END_USER), 1)
    assert table.read().count() == 2


def test_text_source(spark, paths):
    spark.createDataFrame([(envelope(),), ("{broken",)], "value string").write.text(paths("lines"))
    assert {r["topic"] for r in read_telemetry(spark, paths("lines"), fmt="text").collect()} == {"telemetry.events.v1"}
    write_events(events(spark, [("s", "1", 0, "CLICK")]), paths("e"), 0)
    assert read_table(spark, paths("e")).count() == 1


def test_lifecycle_reports_once_and_forgets(spark, paths):
    from trailmark.streaming.sessions import session_lifecycle_stream

    provider = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider)
    spark.conf.set(provider, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    source = events(spark, [("s", "1", 0, "NAVIGATION", {"url": "a"}), ("s", "2", 900, "EXCEPTION")])
    source.coalesce(1).write.parquet(paths("log"))
    seen = []

    def keep(batch, batch_id):
        seen.extend((r["session_id"], r["type"], r["duration_ms"], r["page_count"], r["error_count"]) for r in batch.collect())

    def wait(query, done):
        for _ in range(240):
            if query.exception() or done():
                break
            query.awaitTermination(0.5)
        assert query.exception() is None

    def add(*rows):
        events(spark, list(rows)).coalesce(1).write.mode("append").parquet(paths("log"))

    try:
        # Closed after half a second, remembered for six.
        stream = session_lifecycle_stream(spark.readStream.schema(source.schema).parquet(paths("log")), 500, 6000)
        writer = stream.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", paths("state"))
        query = writer.trigger(processingTime="1 second").start()
        try:
            wait(query, lambda: "CLOSED" in [s[1] for s in seen])
            add(("s", "3", 5000, "EXCEPTION"), ("other", "4", 0, "CLICK"))
            wait(query, lambda: seen.count(("other", "CLOSED", 0, 0, 0)))
            wait(query, lambda: query.lastProgress and not query.lastProgress["numInputRows"] and not state_rows(query.lastProgress))
            assert state_rows(query.lastProgress) == 0
        finally:
            query.stop()
    finally:
        spark.conf.set(provider, before)
    assert [s[1:] for s in seen if s[0] == "s"] == [("OPEN", 900, 1, 1), ("CLOSED", 900, 1, 1), ("UPDATED", 5000, 1, 2)]
    assert [s[1] for s in seen if s[0] == "other"] == ["OPEN", "CLOSED"]


def test_idle_run_ends_though_batches_take_longer_than_a_tick(spark, paths):
    """There is never a pause between two batches, and all of them take far longer together than the patience."""
    rows = spark.createDataFrame([("s", 1), ("s", 2)], "id string, n int")
    rows.coalesce(1).write.parquet(paths("log"))
    counts = spark.readStream.schema(rows.schema).parquet(paths("log")).groupBy("id").count()
    ended = []

    class Endless:
        """A query with timers: a batch follows a batch, and the state is gone after the fourth."""

        isActive, stopped = True, False
        recentProgress: list = []
        lastProgress = property(lambda self: self.recentProgress[-1] if self.recentProgress else None)
        status = {"isTriggerActive": True}

        def run(self):
            for number in range(30):
                if not self.isActive:
                    return
                self.work(counts, number)
                ended.append(number)
                left = {"numRowsTotal": max(0, 3 - number)}
                self.recentProgress = [*self.recentProgress, {"batchId": number, "numInputRows": 2 * (number == 0), "stateOperators": [left]}]

        def foreachBatch(self, work):
            self.work = work
            return self

        def trigger(self, processingTime):
            return self

        def start(self):
            self.thread = threading.Thread(target=self.run)
            self.thread.start()
            return self

        def stop(self):
            self.isActive = False
            self.thread.join()

        def awaitTermination(self, timeout):
            self.thread.join(timeout)

        def exception(self):
            return None

    seen = []
    query = Endless()
    jobs.run_until_idle(query, lambda batch, number: (time.sleep(0.6), seen.append(number)), patience_s=1.0)
    assert seen == ended == [0, 1, 2, 3, 4] and not query.thread.is_alive()
    stuck = Endless()
    stuck.run = lambda: [stuck.work(counts, n) or setattr(stuck, "recentProgress", [*stuck.recentProgress, {"batchId": n, "numInputRows": 2 * (n == 0), "stateOperators": [{"numRowsTotal": 1}]}]) for n in range(30) if stuck.isActive]
    with pytest.raises(TimeoutError):
        jobs.run_until_idle(stuck, lambda batch, number: time.sleep(0.3), patience_s=1.0)


def test_idle_run_of_a_stream(spark, paths):
    """With a tick that is shorter than any batch, the stream still ends, and its checkpoint can be gone on with."""
    from trailmark.streaming.sessions import session_lifecycle_stream

    provider = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider)
    spark.conf.set(provider, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        for ids in (["a", "b"], ["c"]):
            seen = []
            source = events(spark, [(s, s + str(n), n, "CLICK") for s in ids for n in (0, 900)])
            source.coalesce(1).write.mode("append").parquet(paths("log"))
            stream = session_lifecycle_stream(spark.readStream.schema(source.schema).parquet(paths("log")), 300, 300)
            writer = stream.writeStream.outputMode("update").option("checkpointLocation", paths("state"))
            jobs.run_until_idle(writer, lambda batch, number: seen.extend((r["session_id"], r["type"]) for r in batch.collect()), "1 millisecond", 100)
            assert sorted(seen) == [(s, kind) for s in ids for kind in ("CLOSED", "OPEN")]
    finally:
        spark.conf.set(provider, before)
