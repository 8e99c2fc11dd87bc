"""Product-analytics queries."""

from pyspark.sql import functions as F

from trailmark.functions.times import DAY_MS
from trailmark.operators import insights as ops
from trailmark.operators.signals import mark_signals
from trailmark.plans import fixtures as fx
from trailmark.plans.catalog import query
from trailmark.plans.signals import RAGE_SQL, WITHIN
from trailmark.session import written


def insight_rows(spark, folder):
    """Embeddings as insights; the label is the tenant, and every thirteenth has no vector."""
    return fx.table(spark, folder, "embeddings").select(
        F.col("vec_id").alias("id"),
        F.col("label").cast("string").alias("tenant_id"),
        F.when(F.col("vec_id") % 13 != 5, F.col("embedding")).alias("embedding"),
    )


@query(
    """WITH q AS (SELECT CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE vec_id = 0)
  SELECT vec_id AS id, round(1 - list_cosine_similarity(CAST(embedding AS DOUBLE[]), q.v), 6) AS distance FROM embeddings, q
  WHERE label = 3 AND vec_id % 13 <> 5 ORDER BY 1 - list_cosine_similarity(CAST(embedding AS DOUBLE[]), q.v), vec_id LIMIT 10"""
)
def nearest_insights(spark, folder):
    """The ten insights of one tenant closest to the first vector of the table."""
    first = fx.table(spark, folder, "embeddings").filter("vec_id = 0").select("embedding").first()
    near = ops.nearest_insights(insight_rows(spark, folder), list(first["embedding"]), "3", 10)
    return near.select("id", F.round("distance", 6).alias("distance"))


@query(
    """SELECT vec_id, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST(list_reverse(embedding) AS DOUBLE[])), 6) AS similarity FROM embeddings"""
)
def cosine_similarity(spark, folder):
    """Every vector against itself in reverse."""
    from trailmark.functions.vectors import cosine_similarity as similarity

    rows = fx.table(spark, folder, "embeddings")
    value = similarity(F.col("embedding"), F.reverse("embedding"))
    return rows.select("vec_id", F.round(value, 6).alias("similarity"))


@query(
    fx.on_events(
        RAGE_SQL
        + """, m AS (SELECT tenant_id, session_id, event_id, event_type, ts_ms FROM ev WHERE event_type IN ('NAVIGATION', 'CLICK', 'EXCEPTION')
  UNION ALL SELECT tenant_id, session_id, event_id, 'RAGE_CLICK', ts_ms FROM rage),
  s AS (SELECT tenant_id, session_id, min(ts_ms) AS start_ms FROM ev GROUP BY ALL)
  SELECT session_id, event_id, event_type, ts_ms - start_ms AS offset_ms FROM m JOIN s USING (tenant_id, session_id)"""
    )
)
def timeline(spark, folder):
    needed = ["tenant_id", "session_id", "ts", "event_id", "event_type", "target_selector"]
    events = written(fx.events(spark, folder).select(*needed), "events")
    marked = mark_signals(events, 2, WITHIN, 2, 2 * WITHIN, DAY_MS, 4 * WITHIN)
    return ops.timeline(marked, ["rage_click"], DAY_MS).select("session_id", "event_id", "event_type", "offset_ms")


@query(
    fx.on_events(
        """, s AS (SELECT tenant_id, session_id, min(ts_ms) AS start_ms FROM ev GROUP BY ALL),
  l AS (SELECT tenant_id, session_id, path, event_type, target_selector, count(*) AS n, min(ts_ms) AS f, max(ts_ms) AS z,
    arg_min(CASE WHEN error_message <> '' THEN error_message ELSE target_text END, (ts_ms, event_id)) AS t FROM ev GROUP BY ALL)
  SELECT session_id, path, event_type, target_selector, n, f - start_ms AS first_offset_ms, z - start_ms AS last_offset_ms,
    regexp_replace(t, 'u[0-9]+@example.com', '[email]') AS text FROM l JOIN s USING (tenant_id, session_id)"""
    )
)
def session_summaries(spark, folder):
    return ops.session_summaries(fx.events(spark, folder), DAY_MS).drop("tenant_id")


@query(
    fx.on_base(
        f""", c AS (SELECT path, ts_ms // {DAY_MS} AS w, count(*) AS n FROM base WHERE event_type = 'EXCEPTION' GROUP BY ALL),
  b AS (SELECT *, least(3, w - min(w) OVER (PARTITION BY path)) AS spans,
    sum(n) OVER (PARTITION BY path ORDER BY w RANGE BETWEEN 3 PRECEDING AND 1 PRECEDING) AS s FROM c)
  SELECT path, w * {DAY_MS} AS window_start_ms, n, round(coalesce(s, 0) / spans, 6) AS baseline FROM b
  WHERE spans > 0 AND coalesce(s, 0) > 0 AND n >= coalesce(s, 0) / spans * 1.2"""
    )
)
def signal_alerts(spark, folder):
    """Days on which a page has a fifth more errors than in the three days before."""
    errors = fx.base_events(spark, folder).filter("event_type = 'EXCEPTION'")
    alerts = ops.signal_alerts(errors, DAY_MS, 1.2, 3)
    return alerts.withColumn("baseline", F.round("baseline", 6))


FUNNEL_SQL = f""", f1 AS (SELECT tenant_id, session_id, min(ts_ms) AS t1 FROM ev WHERE event_type = 'NAVIGATION' GROUP BY ALL),
  f2 AS (SELECT f1.*, (SELECT min(ts_ms) FROM ev WHERE ev.session_id = f1.session_id AND ev.tenant_id = f1.tenant_id
    AND event_type = 'CLICK' AND ts_ms > t1 AND ts_ms <= t1 + {DAY_MS}) AS t2 FROM f1),
  f3 AS (SELECT f2.*, (SELECT min(ts_ms) FROM ev WHERE ev.session_id = f2.session_id AND ev.tenant_id = f2.tenant_id
    AND event_type = 'CUSTOM' AND ts_ms > t2 AND ts_ms <= t1 + {DAY_MS}) AS t3 FROM f2)"""


def steps():
    return [F.col("event_type") == kind for kind in ("NAVIGATION", "CLICK", "CUSTOM")]


@query(
    fx.on_events(
        FUNNEL_SQL
        + """, c AS (SELECT count(t1) AS a, count(t2) AS b, count(t3) AS c FROM f3)
  SELECT 1 AS step, 'view' AS name, a AS sessions, 1.0::DOUBLE AS conversion, a - b AS dropped FROM c
  UNION ALL SELECT 2, 'click', b, round(b / a, 6), b - c FROM c UNION ALL SELECT 3, 'buy', c, round(c / b, 6), 0 FROM c"""
    )
)
def funnel(spark, folder):
    return ops.funnel(fx.events(spark, folder), steps(), DAY_MS, ["view", "click", "buy"], DAY_MS)


@query(fx.on_events(FUNNEL_SQL + " SELECT tenant_id, session_id FROM f3 WHERE t2 IS NOT NULL AND t3 IS NULL"))
def funnel_dropoffs(spark, folder):
    return ops.funnel_dropoffs(ops.funnel_progress(fx.events(spark, folder), steps(), DAY_MS, DAY_MS), 2)


@query(
    fx.on_base(
        """, c AS (SELECT path, target_selector, count(*) AS clicks FROM base WHERE event_type = 'CLICK' GROUP BY ALL)
  SELECT path, target_selector, clicks, round(clicks / sum(clicks) OVER (PARTITION BY path), 6) AS share FROM c"""
    )
)
def click_map(spark, folder):
    return ops.click_map(fx.base_events(spark, folder))


@query(
    fx.on_base(
        """, calls AS (SELECT event_no, CASE WHEN k % 50 = 0 THEN 0 ELSE 200 + k * 3 END AS status, CAST(floor(value * 10) AS BIGINT) AS ms,
    k FROM base WHERE event_type = 'CUSTOM')
  SELECT event_no AS event_id, CASE WHEN status = 0 OR status >= 400 THEN 'failed' ELSE 'slow' END AS issue, 'POST' AS http_method,
    'https://api.example/cart?k=' || k AS http_url, status AS http_status, ms AS http_duration_ms FROM calls
  WHERE status = 0 OR status >= 400 OR ms > 800"""
    )
)
def network_issues(spark, folder):
    """Purchases sent as network calls, read out of their records: status from the number, duration from the value."""
    from trailmark.operators import ingest
    from trailmark.plans.ingest import number_of, uuid

    status = F.when(F.col("k") % 50 == 0, F.lit(0)).otherwise(200 + F.col("k") * 3)
    call = F.struct(
        F.lit("POST").alias("method"),
        F.concat(F.lit("https://api.example/cart?k="), F.col("k").cast("string")).alias("url"),
        status.alias("status"),
        F.floor(F.col("value") * 10).alias("durationMs"),
    )
    event = F.struct(
        uuid(3, F.col("event_no")).alias("clientEventId"), F.lit("NETWORK").alias("type"), F.unix_millis("ts").alias("ts"), call.alias("props")
    )
    envelope = F.struct(
        F.lit(1).alias("schemaVersion"),
        uuid(1, F.col("tenant_id").cast("bigint")).alias("tenantId"),
        uuid(2, F.col("site_id").cast("bigint")).alias("siteId"),
        uuid(4, F.col("user_id")).alias("sessionId"),
        fx.iso_utc("ingested_at").alias("receivedAt"),
        event.alias("event"),
    )
    records = fx.base_events(spark, folder).filter("event_type = 'CUSTOM'").select(F.to_json(envelope).alias("value"))
    good, _ = ingest.split_poison(ingest.classify_telemetry(ingest.decode_envelope(records, "telemetry")))
    issues = ops.network_issues(ingest.to_event_rows(good), 800)
    return issues.select(number_of(F.col("event_id")).alias("event_id"), "issue", "http_method", "http_url", "http_status", "http_duration_ms")


@query(
    fx.on_events(
        " SELECT event_name, count(*) AS n, count(DISTINCT tenant_id || '/' || session_id) AS sessions FROM ev WHERE event_type = 'CUSTOM' GROUP BY ALL"
    )
)
def custom_events(spark, folder):
    return ops.custom_events(fx.events(spark, folder))
