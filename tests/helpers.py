from datetime import datetime, timezone

from pyspark.sql import functions as F

T0 = 1_750_000_000_000


def at(ms: int) -> datetime:
    return datetime.fromtimestamp(ms / 1000, tz=timezone.utc).replace(tzinfo=None)


def moment(ms: int):
    return F.timestamp_millis(F.lit(ms))


def apply(spark, function, values, kind="string"):
    """Results of a column function over literal values, in order."""
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in rows.orderBy("i").select(function(F.col("v"))).collect()]


EVENT_DDL = (
    "tenant_id string, site_id string, session_id string, anonymous_id string, event_id string, ts timestamp, "
    "ingested_at timestamp, event_type string, url string, path string, target_selector string, target_text string, "
    "error_message string, event_name string, props string, user_agent string"
)


def events(spark, rows):
    """Rows of `(session, event_id, ms after T0, type)` and optional keywords as an events table."""
    out = []
    for session, event_id, ms, kind, *rest in rows:
        more = rest[0] if rest else {}
        out.append(
            (
                more.get("tenant", "t1"),
                "s1",
                session,
                more.get("anonymous", "anon"),
                event_id,
                at(T0 + ms),
                at(T0 + more.get("received", ms)),
                kind,
                more.get("url", ""),
                more.get("path", ""),
                more.get("selector", ""),
                "",
                more.get("error", ""),
                more.get("name", ""),
                more.get("props", "{}"),
                more.get("ua"),
            )
        )
    df = spark.createDataFrame(out, EVENT_DDL)
    return df
