"""Session queries."""

from pyspark.sql import functions as F

from trailmark.functions.times import DAY_MS, to_millis
from trailmark.operators import sessions as ops
from trailmark.operators import tables
from trailmark.plans import fixtures as fx
from trailmark.plans.catalog import query
from trailmark.session import work_folder
from trailmark.session import written


def ms(column: str, alias: str):
    return F.coalesce(to_millis(F.col(column)), F.lit(-1)).cast("bigint").alias(alias)


def known(column: str, alias: str | None = None):
    return F.coalesce(column, F.lit("")).alias(alias or column)


@query(fx.on_events(fx.stats_sql("ev") + " SELECT * FROM stats"))
def session_stats(spark, folder):
    needed = ["tenant_id", "session_id", "ts", "event_id", "ingested_at", "event_type", "url", "props"]
    stored = tables.dedup_latest(fx.redelivered(fx.events(spark, folder)).select(*needed))
    stats = ops.session_stats(stored, DAY_MS)
    return stats.select(
        "tenant_id", "session_id", ms("first_ts", "first_ms"), ms("last_ts", "last_ms"), "duration_ms", "page_count", "error_count"
    )


@query(fx.on_events(" SELECT event_id, tenant_id, session_id, ts_ms FROM ev"))
def sessionize(spark, folder):
    return fx.events(spark, folder).select("event_id", "tenant_id", "session_id", ms("ts", "ts_ms"))


@query(
    fx.on_events(
        fx.updates_sql("ev", "upd")
        + """ SELECT id, tenant_id, site_id, anonymous_id, first_ms, last_ms, last_received_ms,
        coalesce(entry_ms, -1) AS entry_ms, coalesce(entry_url, '') AS entry_url, coalesce(platform, '') AS platform,
        coalesce(browser, '') AS browser FROM upd_ua"""
    )
)
def session_updates(spark, folder):
    return ops.session_updates(fx.events(spark, folder)).select(
        "id",
        "tenant_id",
        "site_id",
        "anonymous_id",
        ms("first_ts", "first_ms"),
        ms("last_ts", "last_ms"),
        ms("last_received", "last_received_ms"),
        ms("entry_at", "entry_ms"),
        known("entry_url"),
        known("platform"),
        known("browser"),
    )


@query(
    fx.on_events(
        ", halves AS (SELECT *, event_no % 2 AS half FROM ev), ev0 AS (SELECT * FROM halves WHERE half = 0), "
        "ev1 AS (SELECT * FROM halves WHERE half = 1)"
        + fx.updates_sql("ev0", "a")
        + fx.updates_sql("ev1", "b")
        + """, o AS (SELECT *, CAST(split_part(id, '-', 1) AS BIGINT) % 3 = 0 AS closed FROM a_ua), j AS (
  SELECT o.id IS NOT NULL AS known, b.id IS NOT NULL AS fresh, o.closed AND b.id IS NOT NULL AS c,
    coalesce(o.id, b.id) AS id, coalesce(o.tenant_id, b.tenant_id) AS tenant_id,
    least(o.first_ms, b.first_ms) AS started_ms, greatest(o.last_received_ms, b.last_received_ms) AS last_active_ms,
    o.last_ms AS o_last, b.last_ms AS b_last, o.closed AS closed,
    coalesce(b.entry_ms IS NOT NULL AND (o.entry_ms IS NULL OR b.entry_ms < o.entry_ms), false) AS earlier,
    o.entry_ms AS o_entry, b.entry_ms AS b_entry, o.entry_url AS o_url, b.entry_url AS b_url,
    coalesce(o.platform, b.platform) AS platform, coalesce(o.browser, b.browser) AS browser,
    coalesce(b.first_ms < o.first_ms, false) OR coalesce(b.last_received_ms > o.last_received_ms, false)
      OR (o.platform IS NULL AND b.platform IS NOT NULL) OR (o.browser IS NULL AND b.browser IS NOT NULL) AS moved
  FROM o FULL JOIN b_ua AS b ON o.id = b.id
), r AS (SELECT *, known AND fresh AND (moved OR earlier) AS changed FROM j)
SELECT id, tenant_id, started_ms, last_active_ms,
  CASE WHEN known AND closed THEN CASE WHEN changed THEN greatest(o_last, b_last) ELSE o_last END ELSE -1 END AS ended_ms,
  coalesce(CASE WHEN earlier THEN b_entry ELSE o_entry END, -1) AS entry_ms,
  coalesce(CASE WHEN earlier THEN b_url ELSE o_url END, '') AS entry_url,
  coalesce(platform, '') AS platform, coalesce(browser, '') AS browser,
  coalesce(changed AND closed, false) AS needs_recompute, CAST(coalesce(changed, false) AS BIGINT) AS version FROM r"""
    )
)
def upsert_sessions(spark, folder):
    """The even events make the table, some sessions are closed, then the odd events arrive."""
    events = fx.events(spark, folder)
    first = ops.session_updates(events.filter("event_no % 2 = 0"))
    second = ops.session_updates(events.filter("event_no % 2 = 1"))
    table = ops.upsert_sessions(fx.no_sessions(spark), first).join(first.select("id", "last_ts"), "id")
    closed = F.substring_index("id", "-", 1).cast("bigint") % 3 == 0
    table = table.withColumn("ended_at", F.when(closed, F.col("last_ts"))).drop("last_ts")
    return ops.upsert_sessions(table, second).select(
        "id",
        "tenant_id",
        ms("started_at", "started_ms"),
        ms("last_active_at", "last_active_ms"),
        ms("ended_at", "ended_ms"),
        ms("entry_at", "entry_ms"),
        known("entry_url"),
        known("platform"),
        known("browser"),
        "needs_recompute",
        "version",
    )


@query(
    fx.on_events(
        """, s AS (SELECT site_id, anonymous_id, tenant_id, event_no % 2 AS half, min(ts_ms) AS f, max(ts_ms) AS l
  FROM ev GROUP BY ALL), o AS (SELECT * FROM s WHERE half = 0), n AS (SELECT * FROM s WHERE half = 1)
SELECT coalesce(o.tenant_id, n.tenant_id) AS tenant_id, site_id, anonymous_id, least(o.f, n.f) AS first_seen_ms,
  greatest(o.l, n.l) AS last_seen_ms,
  CAST(coalesce(n.f < o.f OR n.l > o.l, false) AS BIGINT) AS version
FROM o FULL JOIN n USING (site_id, anonymous_id)"""
    )
)
def upsert_end_users(spark, folder):
    events = fx.events(spark, folder)
    halves = [ops.end_user_updates(ops.session_updates(events.filter(f"event_no % 2 = {half}"))) for half in (0, 1)]
    table = halves[0].withColumn("version", F.lit(0).cast("bigint"))
    return ops.upsert_end_users(table, halves[1]).select(
        "tenant_id", "site_id", "anonymous_id", ms("first_seen_at", "first_seen_ms"), ms("last_seen_at", "last_seen_ms"), "version"
    )


@query(
    fx.on_events(
        fx.SESSIONS_SQL
        + f""" SELECT id, tenant_id, CASE WHEN closed THEN 'RECOMPUTE' ELSE 'CLOSE' END AS kind, last_received_ms AS last_active_ms
  FROM sess WHERE (NOT closed AND last_received_ms < {fx.NOW_MS - fx.GAP_MS}) OR flagged"""
    )
)
def claim_sessions(spark, folder):
    claims = ops.claim_sessions(fx.sessions(spark, folder), fx.now(), fx.GAP_MS)
    return claims.select("id", "tenant_id", "kind", ms("last_active_at", "last_active_ms"))


SECOND_MS = fx.NOW_MS + 20 * DAY_MS


@query(
    fx.on_events(
        f""", known AS (SELECT * FROM ev WHERE event_no % 10 <> 0), late AS (SELECT * FROM ev WHERE event_no % 10 = 0),
  stored AS (SELECT * FROM known WHERE user_id % 11 <> 0)"""
        + fx.updates_sql("known", "k")
        + fx.updates_sql("late", "l")
        + fx.stats_sql("stored", "s1")
        + fx.stats_sql("ev", "s2")
        + f""", t1 AS (
  SELECT k.*, s.first_ms AS s_first, s.last_ms AS s_last, s.duration_ms, s.page_count, s.error_count,
    k.last_received_ms < {fx.NOW_MS - fx.GAP_MS} AND NOT (s.first_ms IS NULL AND k.last_received_ms > {fx.NOW_MS - 2 * fx.GAP_MS}) AS closed
  FROM k_ua AS k LEFT JOIN s1 AS s ON s.session_id = k.id AND s.tenant_id = k.tenant_id
), one AS (
  SELECT 1 AS pass, 'CLOSED' AS type, tenant_id, id AS session_id, least(first_ms, coalesce(s_first, first_ms)) AS started_ms,
    coalesce(s_last, first_ms) AS ended_ms, coalesce(duration_ms, 0) AS duration_ms, coalesce(page_count, 0) AS page_count,
    coalesce(error_count, 0) AS error_count FROM t1 WHERE closed
), t2 AS (
  SELECT coalesce(o.id, n.id) AS id, coalesce(o.tenant_id, n.tenant_id) AS tenant_id, coalesce(o.closed, false) AS closed,
    least(o.first_ms, n.first_ms) AS started_ms, greatest(o.last_received_ms, n.last_received_ms) AS active_ms,
    o.id IS NOT NULL AND n.id IS NOT NULL AND (
      n.first_ms < o.first_ms OR n.last_received_ms > o.last_received_ms
      OR coalesce(n.entry_ms IS NOT NULL AND (o.entry_ms IS NULL OR n.entry_ms < o.entry_ms), false)
      OR (o.platform IS NULL AND n.platform IS NOT NULL) OR (o.browser IS NULL AND n.browser IS NOT NULL)) AS changed
  FROM t1 AS o FULL JOIN l_ua AS n ON o.id = n.id
), two AS (
  SELECT 2 AS pass, CASE WHEN closed THEN 'UPDATED' ELSE 'CLOSED' END AS type, t2.tenant_id, id AS session_id,
    least(started_ms, s.first_ms) AS started_ms, s.last_ms AS ended_ms, s.duration_ms, s.page_count, s.error_count
  FROM t2 JOIN s2 AS s ON s.session_id = t2.id AND s.tenant_id = t2.tenant_id
  WHERE (closed AND changed) OR (NOT closed AND active_ms < {SECOND_MS - fx.GAP_MS})
) SELECT * FROM one UNION ALL SELECT * FROM two"""
    )
)
def close_sessions(spark, folder):
    """Two passes. Before the first, a tenth of the events has not arrived and some users' events are not stored yet."""
    events = written(fx.events(spark, folder), "events")
    on_time, late = events.filter("event_no % 10 <> 0"), events.filter("event_no % 10 = 0")
    table = ops.upsert_sessions(fx.no_sessions(spark), ops.session_updates(on_time))
    stored = on_time.filter("user_id % 11 <> 0")
    table, first = ops.close_sessions(written(table, "sessions"), stored, fx.now(), fx.GAP_MS, width_ms=DAY_MS)
    table = ops.upsert_sessions(written(table, "sessions"), ops.session_updates(late))
    _, second = ops.close_sessions(table, events, fx.now(SECOND_MS), fx.GAP_MS, width_ms=DAY_MS)
    both = first.withColumn("pass", F.lit(1)).unionByName(second.withColumn("pass", F.lit(2)))
    return both.select(
        "pass",
        "type",
        F.col("tenantId").alias("tenant_id"),
        F.col("sessionId").alias("session_id"),
        ms("startedAt", "started_ms"),
        ms("endedAt", "ended_ms"),
        F.col("durationMs").alias("duration_ms"),
        F.col("pageCount").alias("page_count"),
        F.col("errorCount").alias("error_count"),
    )


@query(
    fx.on_events(
        fx.SESSIONS_SQL
        + """, users AS (SELECT DISTINCT site_id, anonymous_id FROM ev WHERE user_id % 5 <> 0)
  SELECT s.id, u.anonymous_id IS NOT NULL AS attached FROM sess s LEFT JOIN users u USING (site_id, anonymous_id)"""
    )
)
def attach_end_users(spark, folder):
    users = fx.base_events(spark, folder).filter("user_id % 5 <> 0").select("site_id", "anonymous_id").distinct()
    bare = fx.sessions(spark, folder).withColumn("end_user_id", F.lit(None).cast("string"))
    joined = ops.attach_end_users(bare, users)
    return joined.select("id", F.col("end_user_id").isNotNull().alias("attached"))


@query(
    fx.on_events(
        fx.SESSIONS_SQL
        + """, who AS (SELECT DISTINCT site_id, anonymous_id, 'member-' || user_id AS member FROM ev WHERE event_type = 'IDENTIFY' AND k % 2 = 0)
  SELECT s.id, coalesce(w.member, '') AS member,
    CAST(w.member IS NOT NULL AS BIGINT) AS version FROM sess s LEFT JOIN who w USING (site_id, anonymous_id)"""
    )
)
def link_sessions(spark, folder):
    """Every even sign-up identifies its visitor."""
    signups = fx.base_events(spark, folder).filter("event_type = 'IDENTIFY' AND k % 2 = 0")
    member = F.concat(F.lit("member-"), F.col("user_id").cast("string"))
    identities = signups.select("site_id", "anonymous_id", member.alias("end_user_id"), F.col("ts").alias("identified_at"))
    bare = fx.sessions(spark, folder).withColumn("end_user_id", F.lit(None).cast("string"))
    linked = ops.link_sessions(bare, identities)
    return linked.select("id", known("end_user_id", "member"), "version")


@query(
    fx.on_events(
        fx.updates_sql("ev", "upd")
        + """, claims AS (
    SELECT id, tenant_id, last_received_ms FROM upd
    UNION ALL SELECT id, 'other', last_received_ms + CASE WHEN CAST(split_part(id, '-', 1) AS BIGINT) % 2 = 0 THEN -1 ELSE 1 END FROM upd
  ) SELECT id, first(tenant_id ORDER BY last_received_ms, tenant_id) AS tenant_id, CAST(0 AS BIGINT) AS version FROM claims GROUP BY id"""
    )
)
def session_owners(spark, folder):
    """Every session is claimed by a second tenant as well, sometimes before its own; then again by the one that lost."""
    updates = ops.session_updates(fx.events(spark, folder))
    shift = F.when(F.substring_index("id", "-", 1).cast("bigint") % 2 == 0, -1).otherwise(1)
    later = F.timestamp_millis(F.unix_millis("last_received") + shift)
    foreign = updates.withColumns({"tenant_id": F.lit("other"), "last_received": later})
    table = written(ops.upsert_sessions(fx.no_sessions(spark), updates.unionByName(foreign)), "sessions")
    owners = table.select("id", F.col("tenant_id").alias("owner"))
    losers = updates.unionByName(foreign).join(owners, "id").filter("tenant_id <> owner").drop("owner")
    return ops.upsert_sessions(table, losers).select("id", "tenant_id", "version")


@query(
    fx.on_events(
        """, nav AS (SELECT *, lag(url) OVER (PARTITION BY tenant_id, session_id ORDER BY ts_ms, event_id) AS prev
  FROM ev WHERE event_type = 'NAVIGATION') SELECT event_id, session_id, url FROM nav WHERE prev IS DISTINCT FROM url"""
    )
)
def distinct_navigations(spark, folder):
    return ops.distinct_navigations(fx.events(spark, folder), DAY_MS).select("event_id", "session_id", "url")


@query(
    fx.on_events(
        """ SELECT tenant_id, session_id, split_part(url, '#', 1) AS page,
  row_number() OVER (PARTITION BY tenant_id, session_id ORDER BY ts_ms, event_id) AS position
  FROM ev WHERE event_type = 'NAVIGATION' AND NOT replaced"""
    )
)
def navigation_trail(spark, folder):
    return ops.navigation_trail(fx.events(spark, folder), DAY_MS)


@query(
    fx.on_events(
        f""", ranked AS (SELECT *, row_number() OVER (PARTITION BY tenant_id, session_id,
    event_type IN ('EXCEPTION', 'CONSOLE_ERROR'), ts_ms // {DAY_MS} ORDER BY ts_ms, event_id) AS n FROM ev)
  SELECT event_id, session_id, event_type FROM ranked WHERE event_type NOT IN ('EXCEPTION', 'CONSOLE_ERROR') OR n <= 2"""
    )
)
def cap_errors(spark, folder):
    """At most two errors per session and day; the default is thirty per minute."""
    return ops.cap_errors(fx.events(spark, folder), 2, DAY_MS).select("event_id", "session_id", "event_type")


@query(
    fx.on_events(
        fx.SESSIONS_SQL
        + f""" SELECT id, first_ms AS started_ms FROM sess
  WHERE tenant_id = '1' AND first_ms < {fx.NOW_MS} AND contains(coalesce(entry_url, ''), '/p/') AND closed
    AND (first_ms < {fx.NOW_MS - 2 * DAY_MS} OR (first_ms = {fx.NOW_MS - 2 * DAY_MS} AND id > '5-1'))
  ORDER BY first_ms DESC, id LIMIT 50"""
    )
)
def list_sessions(spark, folder):
    """Second page of a tenant's closed sessions that were entered on one page before the given day, of the stored table."""
    from trailmark.streaming.sessions import list_stored_sessions

    cursor = (fx.now(fx.NOW_MS - 2 * DAY_MS), "5-1")
    table = stored(spark, folder)
    page = list_stored_sessions(table, "1", started_to=fx.now(), url_contains="/p/", is_open=False, after=cursor)
    return page.select("id", ms("started_at", "started_ms"))


STORED: dict[tuple[str, str], str] = {}


def stored(spark, folder):
    """The session table as the closing job stores it. It is stored once for each application, then only read."""
    from trailmark.streaming.sessions import OPEN, session_table

    key = spark.sparkContext.applicationId, folder
    if key not in STORED:
        table = session_table(spark, work_folder(spark, "sessions"))
        rows = fx.sessions(spark, folder).withColumn("home_day", F.to_date("started_at"))
        waits = F.col("ended_at").isNull() | F.col("needs_recompute")
        table.write(rows, F.when(waits, F.lit(OPEN)).otherwise(F.col("home_day").cast("string")), [], 0, -1)
        STORED[key] = table.path
    return session_table(spark, STORED[key])


@query(
    fx.on_events(
        """, own AS (SELECT * FROM ev WHERE tenant_id = '2' AND session_id = '14-5'),
  edge AS (SELECT ts_ms AS edge_ms, event_id AS edge_id FROM own ORDER BY ts_ms, event_id LIMIT 1)
  SELECT event_id, ts_ms, event_type FROM own, edge WHERE ts_ms > edge_ms OR (ts_ms = edge_ms AND event_id > edge_id) ORDER BY ts_ms, event_id LIMIT 100"""
    )
)
def events_page(spark, folder):
    """The page behind the first event of a session."""
    events = fx.redelivered(fx.events(spark, folder))
    first = ops.events_page(events, "2", "14-5", limit=1).first()
    cursor = None if first is None else (F.lit(first["ts"]), first["event_id"])
    page = ops.events_page(events, "2", "14-5", cursor)
    return page.select("event_id", ms("ts", "ts_ms"), "event_type")


@query(
    fx.on_base(
        """ SELECT coalesce(platform, '') AS platform, CASE WHEN k % 6 = 5 THEN '' ELSE browser END AS browser, count(*) AS n
  FROM base GROUP BY ALL"""
    )
)
def user_agents(spark, folder):
    from trailmark.functions import web

    agents = fx.base_events(spark, folder).groupBy("user_agent").agg(F.count("*").alias("_n"))
    parsed = agents.select(
        F.coalesce(web.platform_of(F.col("user_agent")), F.lit("")).alias("platform"),
        F.coalesce(web.browser_of(F.col("user_agent")), F.lit("")).alias("browser"),
        "_n",
    )
    return parsed.groupBy("platform", "browser").agg(F.sum("_n").alias("n"))
