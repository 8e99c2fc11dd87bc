"""Frustration-signal queries. The events are hours apart, so ranges that are a second by default are longer here."""

from pyspark.sql import functions as F

from trailmark.functions.times import DAY_MS, HOUR_MS
from trailmark.operators import signals as ops
from trailmark.plans import fixtures as fx
from trailmark.plans.catalog import query
from trailmark.plans.sessions import ms

WITHIN = 6 * HOUR_MS

RAGE_SQL = f""", clicks AS (
  SELECT *, count(*) OVER (PARTITION BY tenant_id, session_id, target_selector ORDER BY ts_ms RANGE BETWEEN {4 * WITHIN} PRECEDING AND CURRENT ROW) AS clicks
  FROM ev WHERE event_type = 'CLICK'
), rage AS (SELECT * FROM clicks WHERE clicks >= 2)"""

AFTER_SQL = f""", after_click AS (
  SELECT *, min(CASE WHEN event_type = 'EXCEPTION' THEN ts_ms END) OVER w AS error_ms,
    count(*) FILTER (event_type = 'NAVIGATION') OVER w AS navs
  FROM ev WINDOW w AS (PARTITION BY tenant_id, session_id ORDER BY ts_ms RANGE BETWEEN CURRENT ROW AND {WITHIN} FOLLOWING)
), error_clicks AS (SELECT * FROM after_click WHERE event_type = 'CLICK' AND error_ms IS NOT NULL),
dead AS (SELECT * FROM after_click WHERE event_type = 'CLICK' AND navs = 0)"""

BURST_SQL = f""", errs AS (
  SELECT *, count(*) OVER (PARTITION BY tenant_id, session_id ORDER BY ts_ms RANGE BETWEEN {2 * WITHIN} PRECEDING AND CURRENT ROW) AS errors
  FROM ev WHERE event_type = 'EXCEPTION'
), bursts AS (SELECT * FROM errs WHERE errors >= 2)"""



def rage(events):
    return ops.rage_clicks(events, 2, 4 * WITHIN, DAY_MS)


@query(fx.on_events(RAGE_SQL + " SELECT event_id, session_id, target_selector, clicks FROM rage"))
def rage_clicks(spark, folder):
    return rage(fx.events(spark, folder)).select("event_id", "session_id", "target_selector", "clicks")


@query(fx.on_events(AFTER_SQL + " SELECT event_id, session_id, error_ms FROM error_clicks"))
def error_clicks(spark, folder):
    found = ops.error_clicks(fx.events(spark, folder), WITHIN, DAY_MS)
    return found.select("event_id", "session_id", ms("error_ts", "error_ms"))


@query(fx.on_events(AFTER_SQL + " SELECT event_id, session_id FROM dead"))
def dead_clicks(spark, folder):
    return ops.dead_clicks(fx.events(spark, folder), WITHIN, DAY_MS).select("event_id", "session_id")


@query(fx.on_events(BURST_SQL + " SELECT event_id, session_id, errors FROM bursts"))
def error_bursts(spark, folder):
    return ops.error_bursts(fx.events(spark, folder), 2, 2 * WITHIN, DAY_MS).select("event_id", "session_id", "errors")


@query(
    fx.on_events(
        f""", v AS (SELECT *, lead(ts_ms) OVER (PARTITION BY tenant_id, session_id ORDER BY ts_ms, event_id) AS next_ms FROM ev WHERE event_type = 'NAVIGATION'),
  stays AS (SELECT tenant_id, session_id, path, CAST(sum(next_ms - ts_ms) AS BIGINT) AS stay_ms FROM v WHERE next_ms IS NOT NULL GROUP BY ALL),
  rep AS (SELECT tenant_id, session_id, path, target_selector, count(*) AS repeats FROM ev WHERE event_type = 'CLICK' GROUP BY ALL)
  SELECT session_id, path, target_selector, stay_ms, repeats FROM stays JOIN rep USING (tenant_id, session_id, path) WHERE stay_ms >= {HOUR_MS}"""
    )
)
def stuck_pages(spark, folder):
    found = ops.stuck_pages(fx.events(spark, folder), HOUR_MS, 1)
    return found.select("session_id", "path", "target_selector", "stay_ms", "repeats")


COUNTS_SQL = (
    RAGE_SQL
    + AFTER_SQL
    + BURST_SQL
    + """, tally AS (
  SELECT tenant_id, session_id, 'event' AS s FROM ev UNION ALL SELECT tenant_id, session_id, 'rage' FROM rage
  UNION ALL SELECT tenant_id, session_id, 'dead' FROM dead UNION ALL SELECT tenant_id, session_id, 'eclick' FROM error_clicks
  UNION ALL SELECT tenant_id, session_id, 'burst' FROM bursts UNION ALL SELECT tenant_id, session_id, 'error' FROM ev WHERE event_type = 'EXCEPTION'
), counts AS (
  SELECT tenant_id, session_id, count(*) FILTER (s = 'rage') AS rage_click_count, count(*) FILTER (s = 'dead') AS dead_click_count,
    count(*) FILTER (s = 'eclick') AS error_click_count, count(*) FILTER (s = 'burst') AS error_burst_count,
    count(*) FILTER (s = 'error') AS error_count FROM tally GROUP BY ALL
), scored AS (
  SELECT *, CAST(least(100, CASE WHEN rage_click_count >= CAST(split_part(session_id, '-', 1) AS BIGINT) % 8 % 3 THEN rage_click_count ELSE 0 END * 20
    + dead_click_count * 5 + error_click_count * 15 + error_burst_count * 10 + error_count * 4) AS INTEGER) AS friction_score FROM counts
)"""
)


GATE_SQL = """, cut AS (
  SELECT *, row_number() OVER (ORDER BY friction_score DESC, md5(tenant_id || '/' || session_id), tenant_id, session_id) AS place,
    count(*) OVER () AS total FROM scored
)"""


def counts(spark, folder):
    """Counts with the ranges of the single queries above."""
    return ops.signal_counts(fx.events(spark, folder), 2, WITHIN, 2, 2 * WITHIN, DAY_MS, 4 * WITHIN)


@query(fx.on_events(COUNTS_SQL + " SELECT * FROM counts"))
def signal_counts(spark, folder):
    return counts(spark, folder)


def scores(spark, folder):
    """Site n wants n % 3 rage clicks before they count."""
    signals = counts(spark, folder)
    site = (F.substring_index("session_id", "-", 1).cast("bigint") % 8).cast("string")
    sites = fx.base_events(spark, folder).select(F.col("site_id").alias("id")).distinct()
    wanted = F.create_map(F.lit("rage_click"), (F.col("id").cast("int") % 3).cast("double"))
    return ops.friction_scores(signals.withColumn("site_id", site), sites.withColumn("signal_thresholds", wanted))


@query(fx.on_events(COUNTS_SQL + " SELECT tenant_id, session_id, friction_score FROM scored"))
def friction_scores(spark, folder):
    return scores(spark, folder).select("tenant_id", "session_id", "friction_score")


@query(
    fx.on_events(
        COUNTS_SQL
        + GATE_SQL
        + " SELECT tenant_id, session_id, friction_score FROM cut WHERE friction_score >= 10 AND place <= floor(total * 0.05)"
    )
)
def gate_sessions(spark, folder):
    return ops.gate_sessions(scores(spark, folder).select("tenant_id", "session_id", "friction_score"), 10)


@query(
    fx.on_events(
        COUNTS_SQL.replace("), scored AS (", "), plain AS (")
        + ", scored AS (SELECT * REPLACE (CASE WHEN friction_score >= 4 THEN 100 ELSE 0 END AS friction_score) FROM plain)"
        + GATE_SQL
        + " SELECT tenant_id, session_id, friction_score FROM cut WHERE friction_score >= 50 AND place <= floor(total * 0.05)"
    )
)
def gate_ties(spark, folder):
    """All scores but the lowest become 100, so more sessions share the highest one than may pass."""
    raised = F.when(F.col("friction_score") >= 4, 100).otherwise(0)
    rows = scores(spark, folder).withColumn("friction_score", raised)
    return ops.gate_sessions(rows.select("tenant_id", "session_id", "friction_score"), 50)
