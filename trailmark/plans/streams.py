"""Streaming queries: the given tables as streams, run until they are read, results read back."""

from pyspark.sql import functions as F

from trailmark.functions.times import DAY_MS
from trailmark import schemas as S
from trailmark.operators import ingest
from trailmark.operators.sessions import fold_updates
from trailmark.operators.tables import dedup_latest
from trailmark.plans import fixtures as fx
from trailmark.plans import replay as replay_plans
from trailmark.plans.catalog import query
from trailmark.plans.ingest import DAY_ONE, REASON_SQL, number_of, telemetry_records, uuid
from trailmark.plans.sessions import known, ms
from trailmark.session import work_folder
from trailmark.sources.readers import REPLAY_TOPIC, read_replay, read_telemetry
from trailmark.streaming.counters import pipeline_totals, read_counters
from trailmark.streaming.events import run_events_stream, run_replay_stream, stream_dedup
from trailmark.streaming.sessions import (
    read_updates,
    run_closer,
    run_session_stream,
    run_until_idle,
    session_lifecycle_stream,
    session_table,
)

STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def log_of(df, name: str) -> str:
    """Writes records as files a stream can follow."""
    path = work_folder(df.sparkSession, name)
    df.write.parquet(path)
    return path


@query(
    f"""SELECT reason, count(*) AS n, CAST(sum(event_id) AS BIGINT) AS ids FROM (SELECT event_id, {REASON_SQL} AS reason FROM events) GROUP BY ALL"""
)
def events_stream(spark, folder):
    """Raw records through the events job; stored rows and dead letters counted by reason."""
    log = log_of(telemetry_records(spark, folder), "telemetry")
    events, dead, state = (work_folder(spark, name) for name in ("events", "dead", "state"))
    run_events_stream(read_telemetry(spark, log, streaming=True), events, dead, state).awaitTermination()
    stored = spark.read.parquet(events).select(F.lit("ok").alias("reason"), number_of(F.col("event_id")).alias("id"))
    refused = spark.read.parquet(dead).select("reason", F.col("offset").alias("id"))
    return stored.unionByName(refused).groupBy("reason").agg(F.count("*").alias("n"), F.sum("id").alias("ids"))


def chunk_records(spark, folder):
    """Chunks as raw records with four kinds of defects."""
    kind = (F.col("conv_id") + F.col("turn")) % 9

    def unless(number, value):
        return F.when(kind != number, value)

    envelope = F.struct(
        F.lit(1).alias("schemaVersion"),
        uuid(1, F.col("conv_id") % 4).alias("tenantId"),
        uuid(2, F.col("conv_id") % 8).alias("siteId"),
        unless(1, uuid(4, F.col("conv_id"))).alias("sessionId"),
        F.when(kind == 2, F.lit(-1)).otherwise(F.col("chunk_seq")).alias("chunkSeq"),
        unless(3, fx.iso_utc("ingested_at")).alias("receivedAt"),
        F.when(kind == 4, F.lit("AAAA")).alias("payload"),
        unless(4, F.parse_json("events")).alias("events"),
    )
    return replay_plans.chunks(spark, folder).select(
        F.lit(REPLAY_TOPIC).alias("topic"),
        (F.col("conv_id") % 6).cast("int").alias("partition"),
        (F.col("conv_id") * 100 + F.col("turn")).alias("offset"),
        F.col("ingested_at").alias("timestamp"),
        uuid(4, F.col("conv_id")).alias("key"),
        F.to_json(envelope).alias("value"),
    )


CHUNK_REASON_SQL = """CASE (conv_id + turn) % 9 WHEN 1 THEN 'missing_session' WHEN 2 THEN 'invalid_chunk' WHEN 3 THEN 'missing_ts'
    WHEN 4 THEN 'unsupported_payload' ELSE 'ok' END"""


@query(f"SELECT conv_id * 100 + turn AS \"offset\", {CHUNK_REASON_SQL} AS reason FROM conversations")
def classify_replay(spark, folder):
    classified = ingest.classify_replay(ingest.decode_envelope(chunk_records(spark, folder), "replay"))
    return classified.select("offset", F.coalesce("reason", F.lit("ok")).alias("reason"))


@query(
    """SELECT conv_id, turn, CASE WHEN (conv_id + turn) % 7 IN (1, 2, 3) THEN 'invalid' ELSE '' END AS rejection FROM conversations"""
)
def replay_envelopes(spark, folder):
    """Chunks as request bodies: without session, with a negative number, in an old form without events."""
    kind = (F.col("conv_id") + F.col("turn")) % 7
    body = F.struct(
        F.when(kind != 1, uuid(4, F.col("conv_id"))).alias("sessionId"),
        F.when(kind == 2, F.lit(-1)).otherwise(F.col("chunk_seq")).alias("chunkSeq"),
        F.when(kind == 3, F.lit("AAAA")).alias("payload"),
        F.when(kind != 3, F.parse_json("events")).alias("events"),
    )
    bodies = replay_plans.chunks(spark, folder).withColumns({"body": F.to_json(body), "received_at": F.col("ingested_at")})
    judged = ingest.replay_envelopes(bodies.select("conv_id", "turn", "tenant_id", "site_id", "received_at", "body"))
    return judged.select("conv_id", "turn", F.coalesce("rejection", F.lit("")).alias("rejection"))


@query(
    """SELECT CASE (conv_id + turn) % 9 WHEN 1 THEN 'missing_session' WHEN 2 THEN 'invalid_chunk' WHEN 3 THEN 'missing_ts'
    WHEN 4 THEN 'unsupported_payload' ELSE 'ok' END AS reason, count(*) AS n,
  CAST(sum(CASE WHEN (conv_id + turn) % 9 IN (1, 2, 3, 4) THEN 0 ELSE 1 + turn % 3 + CASE WHEN turn = 0 THEN 2 ELSE 0 END END) AS BIGINT) AS events
  FROM conversations GROUP BY ALL"""
)
def replay_stream(spark, folder):
    """Raw chunks through the replay job; manifest rows that have their payload, and dead letters by reason."""
    log = log_of(chunk_records(spark, folder), "replay")
    payloads, manifest, dead, state = (work_folder(spark, name) for name in ("payloads", "manifest", "dead", "state"))
    run_replay_stream(read_replay(spark, log, streaming=True), payloads, manifest, dead, state).awaitTermination()
    stored = spark.read.parquet(manifest).join(spark.read.parquet(payloads).select("object_key"), "object_key", "left_semi")
    good = stored.select(F.lit("ok").alias("reason"), F.col("event_count").cast("bigint").alias("events"))
    refused = spark.read.parquet(dead).select("reason", F.lit(0).cast("bigint").alias("events"))
    return good.unionByName(refused).groupBy("reason").agg(F.count("*").alias("n"), F.sum("events").alias("events"))


WIRE_SQL = fx.on_base(f", wire AS (SELECT *, CAST(user_id * 100 + ts_ms // {DAY_MS} - {DAY_ONE} AS BIGINT) AS visit FROM base)")


def tracked(spark, folder, counters=None):
    """All events as raw records through the tracker job; returns the log and the folder of its updates."""
    log = log_of(telemetry_records(spark, folder, defects=False), "telemetry")
    updates, dead, state = (work_folder(spark, name) for name in ("updates", "dead", "state"))
    rows = fx.base_events(spark, folder)
    sites = rows.select(
        uuid(2, F.col("site_id").cast("bigint")).alias("id"), uuid(1, F.col("tenant_id").cast("bigint")).alias("tenant_id")
    ).distinct()
    stream = read_telemetry(spark, log, streaming=True)
    run_session_stream(stream, sites, updates, dead, state, counters_path=counters).awaitTermination()
    return log, updates


@query(
    WIRE_SQL
    + """ SELECT visit AS id, min(ts_ms) AS first_ms, max(ts_ms) AS last_ms, max(ingested_ms) AS last_received_ms,
  coalesce(first(url ORDER BY ts_ms, event_id) FILTER (event_type = 'NAVIGATION'), '') AS entry_url FROM wire GROUP BY visit"""
)
def session_stream(spark, folder):
    """Raw records through the tracker job; its updates folded to one row per session."""
    _, updates = tracked(spark, folder)
    folded = fold_updates(read_updates(spark, updates).drop("batch_id"))
    return folded.select(
        number_of(F.col("id")).alias("id"),
        ms("first_ts", "first_ms"),
        ms("last_ts", "last_ms"),
        ms("last_received", "last_received_ms"),
        known("entry_url"),
    )


def closed(spark, folder, counters=None):
    """Tracker, events job and two closing passes one after the other, each through its stored tables."""
    log, updates = tracked(spark, folder, counters)
    events, dead, state = (work_folder(spark, name) for name in ("events", "dead", "state"))
    run_events_stream(read_telemetry(spark, log, streaming=True), events, dead, state, counters).awaitTermination()
    sessions, lifecycle = work_folder(spark, "sessions"), work_folder(spark, "lifecycle")
    stored = dedup_latest(spark.read.parquet(events).drop("batch_id"), ["event_date", *S.EVENT_KEYS])
    for now_ms in (fx.NOW_MS - 4 * DAY_MS, fx.NOW_MS):
        run_closer(spark, sessions, updates, lifecycle, stored, fx.now(now_ms), fx.GAP_MS, counters)
    return sessions, lifecycle


@query(
    WIRE_SQL
    + f""" SELECT visit AS id, 'CLOSED' AS type, max(ts_ms) - min(ts_ms) AS duration_ms,
  count(*) FILTER (event_type = 'EXCEPTION') AS error_count FROM wire GROUP BY visit HAVING max(ingested_ms) < {fx.NOW_MS - fx.GAP_MS}"""
)
def closer_job(spark, folder):
    """What the closing passes publish; the second one closes what the first one left open."""
    _, lifecycle = closed(spark, folder)
    return spark.read.parquet(lifecycle).select(
        number_of(F.col("sessionId")).alias("id"),
        "type",
        F.col("durationMs").alias("duration_ms"),
        F.col("errorCount").alias("error_count"),
    )


@query(
    WIRE_SQL
    + f""" SELECT visit AS id, min(ts_ms) AS started_ms, CASE WHEN max(ingested_ms) < {fx.NOW_MS - fx.GAP_MS} THEN max(ts_ms) ELSE -1 END AS ended_ms,
  CASE WHEN max(ingested_ms) < {fx.NOW_MS - fx.GAP_MS} THEN 'closed' ELSE 'open' END AS part FROM wire GROUP BY visit"""
)
def stored_sessions(spark, folder):
    """The stored session table after both passes, with the part each session lies in."""
    table = session_table(spark, closed(spark, folder)[0])
    part = F.when(table.part() == "open", F.lit("open")).otherwise(F.lit("closed"))
    rows = table.read().select(number_of(F.col("id")).alias("id"), ms("started_at", "started_ms"), ms("ended_at", "ended_ms"), part.alias("part"))
    return rows.withColumn("ended_ms", F.coalesce("ended_ms", F.lit(-1).cast("bigint")))


@query(
    WIRE_SQL
    + f""", visits AS (SELECT visit, max(ingested_ms) AS received FROM wire GROUP BY ALL),
  chunks AS (SELECT conv_id, turn, (conv_id + turn) % 9 IN (1, 2, 3, 4) AS bad FROM conversations)
  SELECT 'events' AS job, 'rows' AS name, count(*) AS value, true AS as_stored FROM base
  UNION ALL SELECT 'events', 'dead_letters', 0, true UNION ALL SELECT 'events', 'batches', 1, true
  UNION ALL SELECT 'sessions', 'sessions_upserted', count(*), true FROM visits
  UNION ALL SELECT 'sessions', 'records_skipped', 0, true UNION ALL SELECT 'sessions', 'batches', 1, true
  UNION ALL SELECT 'closer', 'sessions_upserted', count(*), true FROM visits
  UNION ALL SELECT 'closer', 'closed', count(*), true FROM visits WHERE received < {fx.NOW_MS - fx.GAP_MS}
  UNION ALL SELECT 'closer', 'recomputed', 0, true UNION ALL SELECT 'closer', 'deferred', 0, true UNION ALL SELECT 'closer', 'batches', 2, true
  UNION ALL SELECT 'replay', 'chunks', count(*) FILTER (NOT bad), true FROM chunks
  UNION ALL SELECT 'replay', 'dead_letters', count(*) FILTER (bad), true FROM chunks
  UNION ALL SELECT 'replay', 'bytes', -1, true UNION ALL SELECT 'replay', 'batches', 1, true"""
)
def pipeline_counters(spark, folder):
    """Counters of all jobs, and whether the stored tables say the same; sizes of chunks are compared with the tables only."""
    counters, log = work_folder(spark, "counters"), log_of(chunk_records(spark, folder), "replay")
    sessions, lifecycle = closed(spark, folder, counters)
    payloads, manifest, dead, state = (work_folder(spark, name) for name in ("payloads", "manifest", "dead", "state"))
    stream = read_replay(spark, log, streaming=True)
    run_replay_stream(stream, payloads, manifest, dead, state, counters).awaitTermination()
    stored = session_table(spark, sessions).read().agg(F.count("*").alias("value")).select(
        F.explode(F.array(F.lit("closer"), F.lit("sessions"))).alias("job"), F.lit("sessions_upserted").alias("name"), "value"
    )
    kinds = {"CLOSED": "closed", "UPDATED": "recomputed"}
    published = spark.read.parquet(lifecycle)
    for kind, name in kinds.items():
        line = published.filter(F.col("type") == kind).agg(F.count("*").alias("value"))
        stored = stored.unionByName(line.select(F.lit("closer").alias("job"), F.lit(name).alias("name"), "value"))
    chunks = spark.read.parquet(manifest).agg(F.count("*").alias("chunks"), F.sum("payload_bytes").alias("bytes"))
    chunks = chunks.unpivot([], ["chunks", "bytes"], "name", "value").withColumn("job", F.lit("replay"))
    refused = spark.read.parquet(dead).agg(F.count("*").alias("value"))
    refused = refused.select(F.lit("replay").alias("job"), F.lit("dead_letters").alias("name"), "value")
    stored = stored.unionByName(chunks).unionByName(refused).withColumnRenamed("value", "stored")
    totals = pipeline_totals(read_counters(spark, counters)).filter("name NOT IN ('rows_read', 'rows_written')")
    known = totals.join(stored, ["job", "name"], "left")
    value = F.when(F.col("name") == "bytes", F.lit(-1)).otherwise(F.col("value")).cast("bigint")
    return known.select("job", "name", value.alias("value"), F.coalesce(F.col("value") == F.col("stored"), F.lit(True)).alias("as_stored"))


@query(
    fx.on_events(
        fx.stats_sql("ev")
        + """ SELECT tenant_id, session_id, type, first_ms AS started_ms, last_ms AS ended_ms, duration_ms, page_count, error_count
  FROM stats CROSS JOIN (SELECT unnest(['OPEN', 'CLOSED']) AS type)"""
    )
)
def lifecycle_stream(spark, folder):
    """Stored events through the stateful lifecycle until its state is empty: every session opens once and closes once."""
    columns = ["tenant_id", "session_id", "event_id", "ts", "ingested_at", "event_type", "url", "props"]
    rows = fx.events(spark, folder).select(*columns)
    log, out, state = log_of(rows, "events"), work_folder(spark, "lifecycle"), work_folder(spark, "state")
    before = spark.conf.get(STATE_STORE)
    spark.conf.set(STATE_STORE, ROCKSDB)
    try:
        stream = session_lifecycle_stream(spark.readStream.schema(rows.schema).parquet(log), 500, 500)

        def keep(batch, batch_id):
            batch.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite").option(
                "partitionOverwriteMode", "dynamic"
            ).partitionBy("batch_id").parquet(out)

        writer = stream.writeStream.outputMode("update").option("checkpointLocation", state)
        run_until_idle(writer, keep)
    finally:
        spark.conf.set(STATE_STORE, before)
    return spark.read.parquet(out).select(
        "tenant_id",
        "session_id",
        "type",
        ms("started_at", "started_ms"),
        ms("ended_at", "ended_ms"),
        "duration_ms",
        "page_count",
        "error_count",
    )


@query(fx.on_base(" SELECT event_id, tenant_id FROM base"))
def dedup_stream(spark, folder):
    """Redelivered events through the streaming de-duplication."""
    rows = fx.redelivered(fx.base_events(spark, folder)).select(
        "tenant_id", F.col("anonymous_id").alias("session_id"), "event_id", "ingested_at"
    )
    log, out, state = log_of(rows, "events"), work_folder(spark, "unique"), work_folder(spark, "state")
    unique = stream_dedup(spark.readStream.schema(rows.schema).parquet(log), "2 hours")
    writer = unique.writeStream.format("parquet").option("path", out).option("checkpointLocation", state)
    writer.trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(rows.schema).parquet(out).select("event_id", "tenant_id")
