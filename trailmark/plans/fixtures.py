"""The given tables in the shape of ours, as Spark expressions and as the same SQL."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trailmark import schemas as S
from trailmark.functions.times import DAY_MS
from trailmark.operators.sessions import session_updates, sessionize, upsert_sessions

GAP_MS = 12 * 3_600_000  # visits in the given events are far apart, so the queries use a longer gap than the default
NOW_MS = 1_705_708_800_000  # 2024-01-20T00:00:00Z


def now(ms: int = NOW_MS) -> Column:
    return F.timestamp_millis(F.lit(ms))


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def epoch_ms(column: str) -> Column:
    """Milliseconds of a timestamp without time zone, read as UTC whatever the session's zone is."""
    return F.expr(
        f"unix_date(CAST({column} AS DATE)) * {DAY_MS}L + hour({column}) * 3600000L + minute({column}) * 60000L "
        f"+ CAST(floor(extract(SECOND FROM {column}) * 1000) AS BIGINT)"
    )


def iso_utc(column: str) -> Column:
    """`2024-01-20T00:00:00.000Z`."""
    wall_clock = f"timestampadd(MICROSECOND, unix_micros({column}), TIMESTAMP_NTZ'1970-01-01 00:00:00')"
    text = F.rpad(F.expr(f"CAST({wall_clock} AS STRING)"), 19, "0")
    millis = F.lpad(F.pmod(F.unix_millis(F.col(column)), F.lit(1000)).cast("string"), 3, "0")
    return F.concat(F.substring(F.replace(text, F.lit(" "), F.lit("T")), 1, 19), F.lit("."), millis, F.lit("Z"))


# User agents by k % 6, the major version is 100 + k; the last one is blank.
USER_AGENTS = [
    ("Mozilla/5.0 (Windows NT 10.0) Chrome/", ".1 Safari/500"),
    ("Mozilla/5.0 (Windows NT 10.0; rv:99) Firefox/", ".2"),
    ("Mozilla/5.0 (Linux; Android 11; Phone) Chrome/", ".3 Mobile Safari/500"),
    ("Mozilla/5.0 (iPad; CPU OS 15_0) Version/", ".4 Mobile/1A Safari/600"),
    ("Mozilla/5.0 (Windows NT 11.0) HeadlessChrome/", ".6 Safari/500"),
]
PLATFORMS = ["desktop", "desktop", "mobile", "tablet", None]
BROWSERS = ["Chrome", "Firefox", "Chrome", "Safari", "HeadlessChrome"]


def user_agent(k: Column) -> Column:
    chosen = F.lit("")
    for i, (before, after) in enumerate(USER_AGENTS):
        chosen = F.when(k % 6 == i, F.concat(F.lit(before), (k + 100).cast("string"), F.lit(after))).otherwise(chosen)
    return chosen


def base_events(spark: SparkSession, folder: str) -> DataFrame:
    """One row per given event, without sessions."""
    kinds = {"click": "CLICK", "view": "NAVIGATION", "error": "EXCEPTION", "signup": "IDENTIFY", "purchase": "CUSTOM"}
    kind = F.coalesce(*[F.when(F.col("event_type") == given, F.lit(ours)) for given, ours in kinds.items()])
    rows = table(spark, folder, "events").select(
        F.col("event_id").alias("event_no"),
        "user_id",
        "value",
        epoch_ms("ts").alias("ts_ms"),
        kind.alias("event_type"),
        F.get_json_object("props", "$.k").cast("bigint").alias("k"),
        F.col("props").alias("given_props"),
    )
    k, no, user = F.col("k"), F.col("event_no"), F.col("user_id")
    empty, text = F.lit(""), lambda c: c.cast("string")
    path = F.concat(F.lit("/p/"), text(k % 10))
    is_view, is_click = F.col("event_type") == "NAVIGATION", F.col("event_type") == "CLICK"
    is_error, is_custom = F.col("event_type") == "EXCEPTION", F.col("event_type") == "CUSTOM"
    return rows.select(
        "event_no",
        "user_id",
        "k",
        "value",
        text(no).alias("event_id"),
        text(user % 4).alias("tenant_id"),
        text(user % 8).alias("site_id"),
        F.concat(F.lit("u"), text(user)).alias("anonymous_id"),
        F.timestamp_millis("ts_ms").alias("ts"),
        F.timestamp_millis(F.col("ts_ms") + (no % 120) * 1000).alias("ingested_at"),
        "event_type",
        F.when(is_custom, F.concat(F.lit("buy_"), text(k % 5))).otherwise(empty).alias("event_name"),
        F.concat(F.lit("https://shop.example"), path, F.lit("?k="), text(k), F.lit("#s"), text(k % 3)).alias("url"),
        path.alias("path"),
        F.when(is_click, F.concat(F.lit("button#b"), text(k % 5))).otherwise(empty).alias("target_selector"),
        F.when(is_click, F.concat(F.lit("Buy "), text(k))).otherwise(empty).alias("target_text"),
        F.when(is_error, F.concat(F.lit("failed for u"), text(user), F.lit("@example.com"))).otherwise(empty).alias("error_message"),
        F.when(is_view & (k % 7 == 0), F.lit('{"trigger":"replaceState"}')).otherwise(F.col("given_props")).alias("props"),
        user_agent(k).alias("user_agent"),
    )


def events(spark: SparkSession, folder: str) -> DataFrame:
    """Events with sessions `{user}-{n}`."""
    numbered = sessionize(base_events(spark, folder), ["tenant_id", "user_id"], GAP_MS, DAY_MS)
    return numbered.withColumn("session_id", F.concat_ws("-", F.col("user_id").cast("string"), F.col("session_no").cast("string")))


def redelivered(df: DataFrame) -> DataFrame:
    """The same rows, every tenth delivered again 60 s later."""
    delays = F.when(F.col("event_no") % 10 == 0, F.array(F.lit(0), F.lit(60_000))).otherwise(F.array(F.lit(0)))
    twice = df.withColumn("_delay", F.explode(delays))
    later = F.timestamp_millis(F.unix_millis("ingested_at") + F.col("_delay"))
    return twice.withColumn("ingested_at", later).drop("_delay")


def no_sessions(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], S.USER_SESSION)


def sessions(spark: SparkSession, folder: str) -> DataFrame:
    """The session table after all events; sessions of every third user are closed, half of those flagged."""
    updates = session_updates(events(spark, folder))
    rows = upsert_sessions(no_sessions(spark), updates)
    user = F.substring_index("id", "-", 1).cast("bigint")
    last = updates.select("id", F.col("last_ts").alias("_last"))
    closed = rows.join(last, "id").withColumn("ended_at", F.when(user % 3 == 0, F.col("_last")))
    return closed.withColumn("needs_recompute", user % 6 == 0).select(*rows.columns)


def _case(values: list[str | None], otherwise: str) -> str:
    whens = " ".join(
        f"WHEN {i} THEN {'NULL' if v is None else chr(39) + v + chr(39)}" for i, v in enumerate(values)
    )
    return f"CASE k % 6 {whens} ELSE {otherwise} END"


BASE_SQL = f"""base AS (
  SELECT *, epoch_us(ts) // 1000 AS ts_ms, epoch_us(ts) // 1000 + (event_no % 120) * 1000 AS ingested_ms,
    {_case(PLATFORMS, 'NULL')} AS platform,
    {_case(BROWSERS, 'NULL')} || ' ' || (100 + k) AS browser
  FROM (
    SELECT event_id AS event_no, CAST(event_id AS VARCHAR) AS event_id, user_id, value, ts, k,
      CAST(user_id % 4 AS VARCHAR) AS tenant_id, CAST(user_id % 8 AS VARCHAR) AS site_id,
      'u' || user_id AS anonymous_id, '/p/' || (k % 10) AS path,
      'https://shop.example/p/' || (k % 10) || '?k=' || k || '#s' || (k % 3) AS url, event_type,
      CASE WHEN event_type = 'CUSTOM' THEN 'buy_' || (k % 5) ELSE '' END AS event_name,
      CASE WHEN event_type = 'CLICK' THEN 'button#b' || (k % 5) ELSE '' END AS target_selector,
      CASE WHEN event_type = 'CLICK' THEN 'Buy ' || k ELSE '' END AS target_text,
      CASE WHEN event_type = 'EXCEPTION' THEN 'failed for u' || user_id || '@example.com' ELSE '' END AS error_message,
      event_type = 'NAVIGATION' AND k % 7 = 0 AS replaced, props
    FROM (
      SELECT event_id, user_id, value, ts, props, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k,
        CASE event_type WHEN 'click' THEN 'CLICK' WHEN 'view' THEN 'NAVIGATION' WHEN 'error' THEN 'EXCEPTION'
          WHEN 'signup' THEN 'IDENTIFY' WHEN 'purchase' THEN 'CUSTOM' END AS event_type
      FROM events)))"""

EV_SQL = f"""{BASE_SQL}, marked AS (
  SELECT *, CASE WHEN ts_ms - lag(ts_ms) OVER w <= {GAP_MS} THEN 0 ELSE 1 END AS is_new
  FROM base WINDOW w AS (PARTITION BY tenant_id, user_id ORDER BY ts_ms, event_id)
), ev AS (
  SELECT *, user_id || '-' || CAST(sum(is_new) OVER w AS BIGINT) AS session_id
  FROM marked WINDOW w AS (PARTITION BY tenant_id, user_id ORDER BY ts_ms, event_id ROWS UNBOUNDED PRECEDING)
)"""


def on_base(sql: str) -> str:
    return f"WITH {BASE_SQL}{sql}"


def on_events(sql: str) -> str:
    return f"WITH {EV_SQL}{sql}"


def stats_sql(source: str, name: str = "stats") -> str:
    """CTEs that compute the counters of every session in `source`."""
    return f""", {name}_nav AS (
  SELECT tenant_id, session_id, split_part(url, '#', 1) AS page,
    lag(split_part(url, '#', 1)) OVER (PARTITION BY tenant_id, session_id ORDER BY ts_ms, event_id) AS prev
  FROM {source} WHERE event_type = 'NAVIGATION' AND NOT replaced
), {name}_pages AS (
  SELECT tenant_id, session_id, count(*) AS pages FROM {name}_nav WHERE page IS DISTINCT FROM prev GROUP BY ALL
), {name} AS (
  SELECT tenant_id, session_id, first_ms, last_ms, greatest(0, last_ms - first_ms) AS duration_ms,
    coalesce(pages, 0) AS page_count, error_count
  FROM (SELECT tenant_id, session_id, min(ts_ms) AS first_ms, max(ts_ms) AS last_ms,
      count(*) FILTER (event_type IN ('EXCEPTION', 'CONSOLE_ERROR')) AS error_count FROM {source} GROUP BY ALL)
  LEFT JOIN {name}_pages USING (tenant_id, session_id)
)"""


def updates_sql(source: str, name: str) -> str:
    """CTE with one update row per session of `source`."""
    return f""", {name} AS (
  SELECT session_id AS id, tenant_id, first(site_id ORDER BY ingested_ms, event_id) AS site_id,
    first(anonymous_id ORDER BY ingested_ms, event_id) AS anonymous_id,
    min(ts_ms) AS first_ms, max(ts_ms) AS last_ms, max(ingested_ms) AS last_received_ms,
    first(ts_ms ORDER BY ts_ms, event_id) FILTER (event_type = 'NAVIGATION') AS entry_ms,
    first(url ORDER BY ts_ms, event_id) FILTER (event_type = 'NAVIGATION') AS entry_url,
    first(k ORDER BY ingested_ms, event_id) FILTER (k % 6 <> 5) AS ua_k
  FROM {source} GROUP BY session_id, tenant_id
), {name}_ua AS (
  SELECT * EXCLUDE (k), {_case(PLATFORMS, 'NULL')} AS platform, {_case(BROWSERS, 'NULL')} || ' ' || (100 + k) AS browser
  FROM (SELECT *, ua_k AS k FROM {name})
)"""


SESSIONS_SQL = updates_sql("ev", "upd") + """, sess AS (
  SELECT *, CAST(split_part(id, '-', 1) AS BIGINT) AS user_id,
    CAST(split_part(id, '-', 1) AS BIGINT) % 3 = 0 AS closed, CAST(split_part(id, '-', 1) AS BIGINT) % 6 = 0 AS flagged
  FROM upd_ua
)"""
