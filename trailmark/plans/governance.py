"""Constraint, erasure and review queries."""

from pyspark.sql import functions as F

from trailmark.functions.times import DAY_MS
from trailmark.operators import governance as ops
from trailmark.operators import insights
from trailmark.operators.sessions import end_user_id
from trailmark.plans import fixtures as fx
from trailmark.plans.catalog import query
from trailmark.plans.ingest import redacted_sql
from trailmark.plans.sessions import ms
from trailmark.session import written


@query(
    """SELECT event_id AS "key", 'value_0_100' AS rule FROM events WHERE NOT value BETWEEN 0 AND 100
  UNION ALL SELECT event_id, 'type_known' FROM events WHERE event_type NOT IN ('click', 'view', 'error', 'purchase')
  UNION ALL SELECT doc_id, 'quality_required' FROM labels WHERE quality <> 1"""
)
def check_constraints(spark, folder):
    events = fx.table(spark, folder, "events")
    rules = {
        "value_0_100": F.col("value").between(0, 100),
        "type_known": F.col("event_type").isin("click", "view", "error", "purchase"),
    }
    labels = ops.check_constraints(fx.table(spark, folder, "labels"), "doc_id", {"quality_required": F.col("quality") == 1})
    return ops.check_constraints(events, "event_id", rules).unionByName(labels)


def erasure_requests(sessions):
    """A visitor in twenty asks for everything to go, another one for the first session."""
    user = F.substring_index("id", "-", 1).cast("bigint")
    by_user = sessions.filter(user % 20 == 2).select("tenant_id", F.lit("END_USER").alias("subject_type"), F.col("end_user_id").alias("subject_id"))
    first = sessions.filter((user % 20 == 1) & F.col("id").endswith("-1") & (F.regexp_count("id", F.lit("-")) == 1))
    by_session = first.select("tenant_id", F.lit("SESSION").alias("subject_type"), F.col("id").alias("subject_id"))
    done = sessions.filter(user % 20 == 3).select("tenant_id", F.lit("END_USER").alias("subject_type"), F.col("end_user_id").alias("subject_id"))
    pending = by_user.unionByName(by_session).distinct().withColumn("status", F.lit("PENDING"))
    return pending.unionByName(done.distinct().withColumn("status", F.lit("COMPLETED")))


@query(
    fx.on_events(
        """, gone AS (SELECT *, user_id % 20 = 2 OR (user_id % 20 = 1 AND session_id = user_id || '-1') AS erased FROM ev)
  SELECT 'events' AS "table", count(*) FILTER (erased) AS erased, count(*) FILTER (NOT erased) AS kept FROM gone
  UNION ALL SELECT 'sessions', count(DISTINCT session_id) FILTER (erased), count(DISTINCT session_id) FILTER (NOT erased) FROM gone
  UNION ALL SELECT 'end_users', count(DISTINCT user_id) FILTER (user_id % 20 = 2), count(DISTINCT user_id) FILTER (user_id % 20 <> 2) FROM ev"""
    )
)
def erase(spark, folder):
    sessions = written(fx.sessions(spark, folder), "sessions")
    events = written(fx.events(spark, folder).select("tenant_id", "session_id", "event_id"), "events")
    users = fx.base_events(spark, folder).select("tenant_id", "site_id", "anonymous_id").distinct()
    users = users.withColumn("id", end_user_id(F.col("site_id"), F.col("anonymous_id")))
    kept, progress = ops.erase({"sessions": sessions, "events": events, "end_users": users}, erasure_requests(sessions))
    counts = None
    for name, table in kept.items():
        line = table.agg(F.count("*").alias("kept")).select(F.lit(name).alias("table"), "kept")
        counts = line if counts is None else counts.unionByName(line)
    return progress.join(counts, "table").select("table", "erased", "kept")


@query(
    fx.on_events(
        """, gone AS (SELECT *, user_id % 20 = 2 OR (user_id % 20 = 1 AND session_id = user_id || '-1') AS erased FROM ev),
  asked AS (SELECT DISTINCT 'END_USER' AS subject_type, CAST(user_id AS VARCHAR) AS subject, user_id % 20 = 2 AS new FROM ev WHERE user_id % 20 IN (2, 3)
    UNION ALL SELECT DISTINCT 'SESSION', session_id, true FROM ev WHERE user_id % 20 = 1 AND session_id = user_id || '-1')
  SELECT 'events' AS store, event_id AS id, '' AS status FROM gone WHERE NOT erased
  UNION ALL SELECT DISTINCT 'sessions', session_id, '' FROM gone WHERE NOT erased
  UNION ALL SELECT DISTINCT 'end_users', anonymous_id, '' FROM ev WHERE user_id % 20 <> 2
  UNION ALL SELECT 'requests ' || subject_type, CASE WHEN subject_type = 'SESSION' THEN subject ELSE '' END,
    CASE WHEN new THEN 'COMPLETED end_users, events, sessions' ELSE 'COMPLETED ' END FROM asked"""
    )
)
def erasure_job(spark, folder):
    """The erasure job over stored tables: what is left in each of them, and the requests with their progress."""
    from trailmark.session import work_folder
    from trailmark.sources.daytable import DayTable
    from trailmark.sources.erasure import REQUEST, Store, run_erasure
    from trailmark.sources.snapshots import Snapshot

    sessions = written(fx.sessions(spark, folder), "sessions")
    events = fx.events(spark, folder).select("tenant_id", "session_id", "event_id", "ts")
    users = fx.base_events(spark, folder).groupBy("tenant_id", "site_id", "anonymous_id").agg(F.min("ts").alias("first_seen_at"))
    users = users.withColumn("id", end_user_id(F.col("site_id"), F.col("anonymous_id")))

    def stored(rows, name, bounds):
        table = DayTable(spark, work_folder(spark, name), rows.schema, bounds)
        table.write(rows, F.to_date(bounds).cast("string"), [], 0, -1)
        return table

    stores = {
        "events": Store(stored(events, "events", "ts"), "session_id", dated=True),
        "end_users": Store(stored(users, "end_users", "first_seen_at"), "id", "END_USER"),
        "sessions": Store(stored(sessions, "sessions", "started_at"), "id", dated=True),
    }
    path = work_folder(spark, "requests")
    asked = erasure_requests(sessions).withColumn("id", F.concat_ws("/", "tenant_id", "subject_type", "subject_id"))
    asked = asked.withColumns({"completed_at": F.lit(None).cast("timestamp"), "progress": F.create_map().cast("map<string,string>")})
    Snapshot(spark, path, REQUEST).write(asked, 0)
    done = run_erasure(spark, path, stores, fx.now())
    ids = {"events": "event_id", "end_users": "anonymous_id", "sessions": "id"}
    rows = None
    for name, column in ids.items():
        part = stores[name].table.read().select(F.lit(name).alias("store"), F.col(column).alias("id"), F.lit("").alias("status"))
        rows = part if rows is None else rows.unionByName(part)
    steps = F.concat_ws(" ", "status", F.array_join(F.array_sort(F.map_keys("progress")), ", "))
    subject = F.when(F.col("subject_type") == "SESSION", F.col("subject_id")).otherwise(F.lit(""))
    return rows.unionByName(done.select(F.concat(F.lit("requests "), "subject_type").alias("store"), subject.alias("id"), steps.alias("status")))


def review_events(spark, folder):
    """Three status changes per label; some of them are not allowed or do not follow each other."""
    verdict = (
        F.when(F.col("toxic") == 1, F.lit("REVIEW_REQUIRED"))
        .when(F.col("quality") == 1, F.lit("AI_ANALYZED"))
        .otherwise(F.lit("FAILED"))
    )
    final = (
        F.when(F.col("toxic") == 1, F.when(F.col("doc_id") % 2 == 0, F.lit("HUMAN_APPROVED")).otherwise(F.lit("HUMAN_REJECTED")))
        .when(F.col("doc_id") % 3 == 0, F.lit("PROCESSING"))
        .otherwise(F.lit("HUMAN_APPROVED"))
    )
    last_from = F.when(F.col("doc_id") % 5 == 0, F.lit("REVIEW_REQUIRED")).otherwise(verdict)
    steps = F.array(
        F.struct(F.lit(0).alias("n"), F.lit("PENDING").alias("from_status"), F.lit("PROCESSING").alias("to_status")),
        F.struct(F.lit(1).alias("n"), F.lit("PROCESSING").alias("from_status"), verdict.alias("to_status")),
        F.struct(F.lit(2).alias("n"), last_from.alias("from_status"), final.alias("to_status")),
    )
    rows = fx.table(spark, folder, "labels").select("doc_id", F.inline(steps))
    return rows.select(
        (F.col("doc_id") % 4).cast("string").alias("tenant_id"),
        F.col("doc_id").cast("string").alias("session_id"),
        (F.col("doc_id") * 10 + F.col("n")).alias("id"),
        "from_status",
        "to_status",
        F.timestamp_millis(fx.NOW_MS + F.col("doc_id") * 600_000 + F.col("n") * 3_600_000).alias("created_at"),
    )


REVIEW_SQL = f"""WITH v AS (
  SELECT doc_id, CASE WHEN toxic = 1 THEN 'REVIEW_REQUIRED' WHEN quality = 1 THEN 'AI_ANALYZED' ELSE 'FAILED' END AS verdict,
    CASE WHEN toxic = 1 THEN CASE WHEN doc_id % 2 = 0 THEN 'HUMAN_APPROVED' ELSE 'HUMAN_REJECTED' END
      WHEN doc_id % 3 = 0 THEN 'PROCESSING' ELSE 'HUMAN_APPROVED' END AS final FROM labels
), r AS (
  SELECT doc_id, 0 AS n, 'PENDING' AS f, 'PROCESSING' AS t FROM v
  UNION ALL SELECT doc_id, 1, 'PROCESSING', verdict FROM v
  UNION ALL SELECT doc_id, 2, CASE WHEN doc_id % 5 = 0 THEN 'REVIEW_REQUIRED' ELSE verdict END, final FROM v
), h AS (
  SELECT *, doc_id * 10 + n AS id, {fx.NOW_MS} + doc_id * 600000 + n * 3600000 AS created_ms,
    lag(t) OVER (PARTITION BY doc_id ORDER BY n) AS prev FROM r
)"""


@query(
    REVIEW_SQL
    + """ SELECT id, f AS from_status, t AS to_status, fault FROM (
  SELECT *, CASE WHEN f || '>' || t NOT IN ('PENDING>PROCESSING', 'PROCESSING>AI_ANALYZED', 'PROCESSING>REVIEW_REQUIRED', 'PROCESSING>FAILED',
    'FAILED>PROCESSING', 'AI_ANALYZED>HUMAN_APPROVED', 'REVIEW_REQUIRED>HUMAN_APPROVED', 'REVIEW_REQUIRED>HUMAN_REJECTED') THEN 'illegal'
    WHEN prev <> f THEN 'broken_chain' END AS fault FROM h) WHERE fault IS NOT NULL"""
)
def illegal_transitions(spark, folder):
    return ops.illegal_transitions(review_events(spark, folder)).select("id", "from_status", "to_status", "fault")


@query(REVIEW_SQL + " SELECT id, f AS from_status, t AS to_status, created_ms FROM h WHERE doc_id = 7 AND doc_id % 4 = 3 ORDER BY created_ms")
def review_history(spark, folder):
    trail = ops.review_history(review_events(spark, folder), "3", "7")
    return trail.select("id", "from_status", "to_status", ms("created_at", "created_ms"))


@query(
    REVIEW_SQL
    + f" SELECT CAST(doc_id AS VARCHAR) AS id, {fx.NOW_MS + 400 * DAY_MS} - created_ms AS age_ms FROM h WHERE doc_id % 4 = 1 AND n = 1 AND t = 'REVIEW_REQUIRED'"
)
def review_queue(spark, folder):
    analysed = review_events(spark, folder).filter("id % 10 = 1").select(
        "tenant_id", F.col("session_id").alias("id"), F.col("to_status").alias("analysis_status"), F.col("created_at").alias("flagged_at")
    )
    return insights.review_queue(analysed, "1", fx.now(fx.NOW_MS + 400 * DAY_MS)).select("id", "age_ms")


@query(
    REVIEW_SQL
    + f""" SELECT created_ms // {DAY_MS} * {DAY_MS} AS period_start_ms, t AS to_status, count(*) AS n FROM h
  WHERE doc_id % 4 = 2 AND t IN ('HUMAN_APPROVED', 'HUMAN_REJECTED') GROUP BY ALL"""
)
def review_throughput(spark, folder):
    return insights.review_throughput(review_events(spark, folder), "2")


@query(
    f"""SELECT doc_id, sha256(source || '@example.com') AS email, {redacted_sql('text')} AS note, lang FROM documents"""
)
def redact_traits(spark, folder):
    """Documents as notes of visitors with an address."""
    traits = F.create_map(
        F.lit("email"), F.concat("source", F.lit("@example.com")), F.lit("note"), F.col("text"), F.lit("lang"), F.col("lang")
    )
    users = fx.table(spark, folder, "documents").select("doc_id", traits.alias("traits"))
    clean = ops.redact_traits(users)
    return clean.select("doc_id", *[F.col("traits")[name].alias(name) for name in ("email", "note", "lang")])


@query(
    fx.on_events(
        fx.stats_sql("ev")
        + """ SELECT tenant_id, session_id, CASE WHEN error_count >= 3 THEN 'many_errors' WHEN duration_ms > 86400000 THEN 'long' ELSE '' END AS guardrail_rule,
  CASE WHEN error_count >= 3 OR duration_ms > 86400000 THEN 'REVIEW_REQUIRED' ELSE 'AI_ANALYZED' END AS analysis_status FROM stats"""
    )
)
def apply_guardrails(spark, folder):
    from trailmark.operators.sessions import session_stats

    analysed = session_stats(fx.events(spark, folder), DAY_MS).withColumn("analysis_status", F.lit("AI_ANALYZED"))
    rules = {"many_errors": F.col("error_count") >= 3, "long": F.col("duration_ms") > DAY_MS}
    judged = insights.apply_guardrails(analysed, rules)
    return judged.select("tenant_id", "session_id", F.coalesce("guardrail_rule", F.lit("")).alias("guardrail_rule"), "analysis_status")
