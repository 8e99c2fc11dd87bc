"""Stored-table queries."""

from pyspark.sql import functions as F

from trailmark.functions.times import DAY_MS
from trailmark.operators import tables as ops
from trailmark.plans import fixtures as fx
from trailmark.plans.catalog import query
from trailmark.plans.sessions import ms
from trailmark.session import work_folder
from trailmark.sources.writers import compact_events, write_events


@query(
    fx.on_base(
        " SELECT event_id, tenant_id, user_id, event_type, ingested_ms + CASE WHEN event_no % 10 = 0 THEN 60000 ELSE 0 END AS ingested_ms FROM base"
    )
)
def dedup_latest(spark, folder):
    """Every tenth event comes again, a minute later."""
    once = fx.base_events(spark, folder).select("event_no", "event_id", "tenant_id", "user_id", "ts", "ingested_at", "event_type")
    again = once.filter("event_no % 10 = 0").withColumn("ingested_at", F.expr("ingested_at + INTERVAL 60 SECONDS"))
    latest = ops.dedup_latest(ops.union_deliveries(once, again), ["tenant_id", "user_id", "ts", "event_id"])
    return latest.select("event_id", "tenant_id", "user_id", "event_type", ms("ingested_at", "ingested_ms"))


@query(
    fx.on_base(
        """ SELECT user_id, event_id, event_type, ts_ms FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts_ms DESC, event_id DESC) AS n FROM base) WHERE n = 1"""
    )
)
def latest_by_key(spark, folder):
    states = fx.base_events(spark, folder).select("user_id", "ts", "event_id", "event_type")
    return ops.latest_by_key(states, ["user_id"], ["ts", "event_id"]).select(
        "user_id", "event_id", "event_type", ms("ts", "ts_ms")
    )


@query(fx.on_base(" SELECT event_id, site_id FROM base WHERE tenant_id = '2'"))
def for_tenant(spark, folder):
    return ops.for_tenant(fx.base_events(spark, folder), "2").select("event_id", "site_id")


@query(fx.on_events(" SELECT event_id, ts_ms, event_type FROM ev WHERE tenant_id = '3' AND session_id = '7-2'"))
def session_events(spark, folder):
    found = ops.session_events(fx.redelivered(fx.events(spark, folder)), "3", "7-2")
    return found.select("event_id", ms("ts", "ts_ms"), "event_type")


@query(fx.on_events(fx.SESSIONS_SQL + " SELECT id, first_ms AS started_ms FROM sess WHERE tenant_id = '1' AND site_id = '5' AND anonymous_id = 'u13'"))
def lookup(spark, folder):
    found = ops.lookup(fx.sessions(spark, folder), "1", site_id="5", anonymous_id="u13")
    return found.select("id", ms("started_at", "started_ms"))


@query(fx.on_base(f" SELECT event_id, ts_ms FROM base WHERE ts_ms >= {fx.NOW_MS - 7 * DAY_MS}"))
def expire(spark, folder):
    rows = ops.events_layout(fx.base_events(spark, folder))
    return ops.expire(rows, "ts", 7, fx.now(), "event_date").select("event_id", ms("ts", "ts_ms"))


@query(
    fx.on_base(
        f" SELECT event_id, ts_ms FROM base WHERE tenant_id <> '3' AND ts_ms >= {fx.NOW_MS} - (CAST(tenant_id AS BIGINT) + 1) * 4 * {DAY_MS}"
    )
)
def expire_by_tenant(spark, folder):
    """Tenants keep 4, 8 and 12 days; the fourth does not exist any more."""
    rows = fx.base_events(spark, folder)
    known = rows.select(F.col("tenant_id").alias("id")).distinct().filter("id <> '3'")
    tenants = known.withColumn("event_retention_days", (F.col("id").cast("int") + 1) * 4)
    return ops.expire_by_tenant(rows, tenants, "ts", "event_retention_days", fx.now()).select("event_id", ms("ts", "ts_ms"))


def log_records(spark, folder):
    """Events as log records, 5,000 consecutive ones per partition in turn, with holes."""
    rows = fx.base_events(spark, folder).filter("event_no % 97 <> 0")
    return rows.select(
        F.lit("telemetry").alias("topic"),
        (F.floor(F.col("event_no") / 5000) % 6).cast("int").alias("partition"),
        F.col("event_no").alias("offset"),
        F.col("ingested_at").alias("timestamp"),
        F.floor(F.col("event_no") / 2000).alias("batch"),
    )


LOG_SQL = fx.on_base(
    """, log AS (SELECT 'telemetry' AS topic, event_no // 5000 % 6 AS part, event_no, ingested_ms, event_no // 2000 AS batch
  FROM base WHERE event_no % 97 <> 0)"""
)


@query(
    LOG_SQL
    + """, isl AS (SELECT *, event_no - row_number() OVER (PARTITION BY part ORDER BY event_no) AS island FROM log)
  SELECT part, min(event_no) AS first_offset, max(event_no) AS last_offset, arg_min(ingested_ms, event_no) AS first_ms
  FROM isl GROUP BY part, island"""
)
def offset_runs(spark, folder):
    runs = ops.offset_runs(log_records(spark, folder), width=1000)
    return runs.select(
        F.col("partition").cast("bigint").alias("part"), "first_offset", "last_offset", ms("first_timestamp", "first_ms")
    )


@query(
    LOG_SQL
    + """, isl AS (SELECT *, event_no - row_number() OVER (PARTITION BY batch, part ORDER BY event_no) AS island FROM log),
  runs AS (SELECT batch, part, min(event_no) AS a, max(event_no) AS z, arg_min(ingested_ms, event_no) AS t FROM isl GROUP BY batch, part, island)
  SELECT batch, 'telemetry:' || substr(sha256(string_agg(part || ':' || a || '-' || z || '@' || t || ';', '' ORDER BY part, a)), 1, 32) AS token
  FROM runs GROUP BY batch"""
)
def batch_token(spark, folder):
    """One token per batch of 2,000 records."""
    return ops.batch_token(log_records(spark, folder), ["batch"]).select("batch", "token")


@query(
    fx.on_base(
        """, q AS (SELECT count(*) AS n, quantile_disc(ingested_ms - ts_ms, 0.5) AS p50_ms, quantile_disc(ingested_ms - ts_ms, 0.95) AS p95_ms,
  max(ingested_ms - ts_ms) AS max_ms, quantile_disc(ingested_ms // 1000, 0.1) AS a, quantile_disc(ingested_ms // 1000, 0.9) AS z FROM base)
  SELECT n, p50_ms, p95_ms, max_ms, round(n * 0.8 / (z - a), 6) AS rows_per_second FROM q"""
    )
)
def lag_report(spark, folder):
    report = ops.lag_report(fx.base_events(spark, folder))
    return report.withColumn("rows_per_second", F.round("rows_per_second", 6))


@query(
    fx.on_events(
        """ SELECT tenant_id, session_id, CAST(sum(c) AS BIGINT) AS n_rows, CAST(sum(c - 1) AS BIGINT) AS duplicates,
  CAST(coalesce(sum(c) FILTER (event_type = 'CLICK'), 0) AS BIGINT) AS click,
  CAST(coalesce(sum(c) FILTER (event_type = 'NAVIGATION'), 0) AS BIGINT) AS navigation
  FROM (SELECT *, CASE WHEN event_no % 10 = 0 THEN 2 ELSE 1 END AS c FROM ev) GROUP BY ALL"""
    )
)
def session_profile(spark, folder):
    profile = ops.session_profile(fx.redelivered(fx.events(spark, folder)))
    return profile.select("tenant_id", "session_id", "n_rows", "duplicates", "click", "navigation")


@query(
    fx.on_events(
        f""" SELECT CAST(ts_ms // {DAY_MS} AS BIGINT) AS day, count(*) AS n, count(DISTINCT session_id) AS sessions FROM ev GROUP BY ALL"""
    )
)
def compact_days(spark, folder):
    """Events written in two deliveries, one of them twice, then rewritten day by day without duplicates."""
    path, target = work_folder(spark, "events"), work_folder(spark, "compacted")
    rows = fx.events(spark, folder).select(*ops.S.EVENT_KEYS, "event_no", "ingested_at", "event_type", "url", "path", "props")
    write_events(rows, path, 0)
    again = rows.filter("event_no % 10 = 0").withColumn("ingested_at", F.expr("ingested_at + INTERVAL 60 SECONDS"))
    for _ in range(2):
        write_events(again, path, 1)
    compact_events(spark, path, target)
    stored = spark.read.parquet(target)
    per_session = stored.groupBy("event_date", "session_id").agg(F.count("*").alias("_n"))
    day = F.unix_date("event_date").cast("bigint").alias("day")
    return per_session.groupBy(day).agg(F.sum("_n").alias("n"), F.count("*").alias("sessions"))
