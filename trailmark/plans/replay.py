"""Replay queries: conversations stand in for recorded sessions, one turn per chunk."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from trailmark import schemas as S
from trailmark.operators import replay as ops
from trailmark.operators import tables
from trailmark.plans import fixtures as fx
from trailmark.plans.catalog import query
from trailmark.plans.sessions import ms



def recorded(fewer: Column | None = None):
    """Recorded events of a turn as JSON text: Meta and snapshot first in turn 0, then 1 to 3 increments."""
    base = F.col("conv_id") * 60_000 + F.col("turn") * 1000 + fx.NOW_MS

    def event(kind: int, offset: Column | int, data: Column) -> Column:
        return F.struct(F.lit(kind).alias("type"), (base + offset).alias("timestamp"), data.alias("data"))

    snapshot_type = F.when(F.col("conv_id") % 4 == 3, F.lit(3)).otherwise(F.lit(2))
    head = F.array(
        event(4, 0, F.lit("")),
        F.struct(snapshot_type.alias("type"), (base + 1).alias("timestamp"), F.col("text").alias("data")),
    )
    count = 1 + F.col("turn") % 3 - (fewer if fewer is not None else F.lit(0))
    steps = F.transform(F.sequence(F.lit(1), count.cast("int")), lambda i: event(3, i * 100, F.col("text")))
    steps = F.when(count > 0, steps).otherwise(F.slice(head, 1, 0))
    return F.to_json(F.when(F.col("turn") == 0, F.concat(head, steps)).otherwise(steps))


def chunks(spark, folder, fewer: Column | None = None):
    return fx.table(spark, folder, "conversations").select(
        (F.col("conv_id") % 4).cast("string").alias("tenant_id"),
        (F.col("conv_id") % 8).cast("string").alias("site_id"),
        F.col("conv_id").cast("string").alias("session_id"),
        F.col("turn").cast("int").alias("chunk_seq"),
        F.timestamp_millis(F.col("conv_id") * 60_000 + F.col("turn") * 1000 + fx.NOW_MS + 5000).alias("ingested_at"),
        recorded(fewer).alias("events"),
        "conv_id",
        "turn",
    )


CHUNKS_SQL = f"""WITH c AS (
  SELECT conv_id, turn, CAST(conv_id % 4 AS VARCHAR) AS tenant_id, CAST(conv_id AS VARCHAR) AS session_id, turn AS chunk_seq,
    'tenants/' || (conv_id % 4) || '/sessions/' || conv_id || '/' || lpad(CAST(turn AS VARCHAR), 6, '0') || '.json.zst' AS object_key,
    conv_id * 60000 + turn * 1000 + {fx.NOW_MS} AS base_ms, 1 + turn % 3 + CASE WHEN turn = 0 THEN 2 ELSE 0 END AS event_count
  FROM conversations)"""


@query(
    CHUNKS_SQL
    + """ SELECT tenant_id, session_id, chunk_seq, object_key, event_count, base_ms + CASE WHEN turn = 0 THEN 0 ELSE 100 END AS first_ms,
  base_ms + (1 + turn % 3) * 100 AS last_ms, turn = 0 AND conv_id % 4 <> 3 AS has_full_snapshot FROM c"""
)
def chunk_manifest(spark, folder):
    return ops.chunk_manifest(chunks(spark, folder)).select(
        "tenant_id",
        "session_id",
        F.col("chunk_seq").cast("bigint").alias("chunk_seq"),
        "object_key",
        F.col("event_count").cast("bigint").alias("event_count"),
        ms("first_ts", "first_ms"),
        ms("last_ts", "last_ms"),
        "has_full_snapshot",
    )


@query(CHUNKS_SQL + " SELECT chunk_seq, event_count FROM c WHERE tenant_id = '1' AND session_id = '1'")
def session_chunks(spark, folder):
    manifest = ops.chunk_manifest(chunks(spark, folder))
    later = manifest.withColumn("ingested_at", F.expr("ingested_at + INTERVAL 60 SECONDS"))
    found = tables.session_chunks(tables.union_deliveries(manifest, later), "1", "1")
    return found.select(F.col("chunk_seq").cast("bigint").alias("chunk_seq"), F.col("event_count").cast("bigint").alias("event_count"))


@query(
    CHUNKS_SQL
    + """, kept AS (SELECT * FROM c WHERE (conv_id * 7 + turn) % 5 <> 0),
  s AS (SELECT *, coalesce(lag(chunk_seq) OVER (PARTITION BY tenant_id, session_id ORDER BY chunk_seq) + 1, 0) AS expected FROM kept)
  SELECT tenant_id, session_id, expected AS missing_from, chunk_seq - 1 AS missing_to FROM s WHERE chunk_seq > expected"""
)
def chunk_gaps(spark, folder):
    kept = ops.chunk_manifest(chunks(spark, folder).filter("(conv_id * 7 + turn) % 5 <> 0"))
    return ops.chunk_gaps(kept)


INTEGRITY_SQL = (
    CHUNKS_SQL
    + """, m AS (SELECT * FROM c WHERE (conv_id + turn) % 11 <> 0), p AS (SELECT * FROM c WHERE (conv_id + turn) % 7 <> 0)"""
)


def integrity_sides(spark, folder):
    manifest = ops.chunk_manifest(chunks(spark, folder).filter("(conv_id + turn) % 11 <> 0"))
    fewer = F.when((F.col("conv_id") + F.col("turn")) % 5 == 0, F.lit(1)).otherwise(F.lit(0))
    stored = chunks(spark, folder, fewer).filter("(conv_id + turn) % 7 <> 0")
    keys = ops.W.object_key(F.col("tenant_id"), F.col("session_id"), F.col("chunk_seq"))
    return manifest, stored.select(keys.alias("object_key"), F.col("events").alias("payload"))


@query(
    INTEGRITY_SQL
    + """ SELECT object_key, CASE WHEN p.turn IS NULL THEN 'missing_payload' WHEN m.turn IS NULL THEN 'orphan_payload'
    WHEN (p.conv_id + p.turn) % 5 = 0 THEN 'count_mismatch' WHEN m.turn = 0 AND m.conv_id % 4 = 3 THEN 'no_full_snapshot' ELSE 'ok' END AS verdict
  FROM m FULL JOIN p USING (object_key)"""
)
def replay_integrity(spark, folder):
    return ops.replay_integrity(*integrity_sides(spark, folder))


@query(
    INTEGRITY_SQL
    + """ SELECT object_key, 'manifest' AS side FROM m ANTI JOIN p USING (object_key)
  UNION ALL SELECT object_key, 'payloads' AS side FROM p ANTI JOIN m USING (object_key)"""
)
def key_differences(spark, folder):
    listed, stored = ops.key_differences(*integrity_sides(spark, folder))
    return listed.withColumn("side", F.lit("manifest")).unionByName(stored.withColumn("side", F.lit("payloads")))


@query(INTEGRITY_SQL + " SELECT object_key, p.turn IS NOT NULL AS found FROM m LEFT JOIN p USING (object_key)")
def chunk_payloads(spark, folder):
    found = ops.chunk_payloads(*integrity_sides(spark, folder))
    return found.select("object_key", F.col("payload").isNotNull().alias("found"))


MAX_BYTES, FLUSH_MS = 600, S.REPLAY_FLUSH_MS


@query(
    f"""WITH RECURSIVE e AS (
  SELECT conv_id, turn, length(text) AS bytes, turn % 3 = 0 AS meta, conv_id * 1000 + turn * 700 AS ts FROM conversations
), g AS (
  SELECT *, ts // {FLUSH_MS} AS tick, sum(CAST(meta AS INT)) OVER (PARTITION BY conv_id ORDER BY turn) AS run FROM e
), n AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id, tick, run ORDER BY turn) AS i FROM g
), w AS (
  SELECT conv_id, tick, run, i, turn, bytes, bytes AS total, 0 AS part FROM n WHERE i = 1
  UNION ALL
  SELECT n.conv_id, n.tick, n.run, n.i, n.turn, n.bytes, CASE WHEN w.total >= {MAX_BYTES} THEN n.bytes ELSE w.total + n.bytes END,
    CASE WHEN w.total >= {MAX_BYTES} THEN w.part + 1 ELSE w.part END
  FROM w JOIN n ON n.conv_id = w.conv_id AND n.tick = w.tick AND n.run = w.run AND n.i = w.i + 1
), chunk AS (
  SELECT conv_id, count(*) AS event_count, CAST(sum(bytes) AS BIGINT) AS bytes, min(turn) AS first_seq, max(turn) AS last_seq
  FROM w GROUP BY conv_id, tick, run, part
)
SELECT CAST(conv_id AS VARCHAR) AS session_id, row_number() OVER (PARTITION BY conv_id ORDER BY first_seq) - 1 AS chunk_seq,
  event_count, bytes, first_seq, last_seq, first_seq % 3 = 0 AS starts_with_snapshot FROM chunk"""
)
def rechunk_replay(spark, folder):
    """Turns as recorded events of 700 ms each, every third a Meta event, cut at 600 characters and every 5 s."""
    rows = fx.table(spark, folder, "conversations").select(
        (F.col("conv_id") % 4).cast("string").alias("tenant_id"),
        F.col("conv_id").cast("string").alias("session_id"),
        F.timestamp_millis(F.col("conv_id") * 1000 + F.col("turn") * 700).alias("ts"),
        F.col("turn").alias("seq"),
        F.when(F.col("turn") % 3 == 0, F.lit(4)).otherwise(F.lit(3)).alias("type"),
        F.col("text").alias("event"),
    )
    cut = ops.rechunk_replay(rows, MAX_BYTES, flush_ms=FLUSH_MS)
    return cut.select("session_id", "chunk_seq", "event_count", "bytes", "first_seq", "last_seq", "starts_with_snapshot")


@query(
    CHUNKS_SQL
    + """ SELECT tenant_id, CAST(sum(event_count) AS BIGINT) AS events, CAST(count(*) FILTER (turn = 0) AS BIGINT) AS metas FROM c GROUP BY ALL"""
)
def explode_replay(spark, folder):
    rows = ops.explode_replay(chunks(spark, folder))
    return rows.groupBy("tenant_id").agg(F.count("*").alias("events"), F.count_if(F.col("type") == 4).alias("metas"))
