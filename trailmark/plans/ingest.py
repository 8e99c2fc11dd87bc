"""Ingest queries: envelopes, bodies, redaction, site keys."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from trailmark import schemas as S
from trailmark.functions import text as X
from trailmark.functions import web as W
from trailmark.functions.times import DAY_MS, HOUR_MS
from trailmark.operators import governance, ingest
from trailmark.plans import fixtures as fx
from trailmark.plans.catalog import query
from trailmark.plans.sessions import ms
from trailmark.sources.readers import TELEMETRY_TOPIC


def uuid(kind: int, number: Column) -> Column:
    return F.concat(F.lit(f"{kind:08d}-0000-4000-8000-"), F.lpad(number.cast("string"), 12, "0"))


def number_of(uuid_column: Column) -> Column:
    return F.substring(uuid_column, 25, 12).cast("bigint")


DAY_ONE = 19_723  # 2024-01-01


def visit() -> Column:
    return F.expr(f"user_id * 100 + floor(unix_millis(ts) / {DAY_MS}) - {DAY_ONE}")


def wire_event(event_type: Column, ts: Column, event_id: Column) -> Column:
    return F.struct(
        event_id.alias("clientEventId"),
        event_type.alias("type"),
        ts.alias("ts"),
        F.col("url"),
        F.col("path"),
        F.col("target_selector").alias("targetSelector"),
        F.col("target_text").alias("targetText"),
        F.col("error_message").alias("errorMessage"),
        F.col("event_name").alias("eventName"),
        F.parse_json("props").alias("props"),
    )


def telemetry_records(spark, folder, defects: bool = True):
    """Given events as raw records. Twelve of thirteen have one defect each, and half of the rest a doubled key."""
    rows = fx.base_events(spark, folder)
    kind = F.col("event_no") % 13 if defects else F.lit(0)

    def unless(number: int, value: Column) -> Column:
        return F.when(kind != number, value)

    event = wire_event(
        F.when(kind == 9, F.lit("GAZE")).otherwise(unless(7, F.col("event_type"))),
        unless(8, F.unix_millis("ts")),
        unless(6, uuid(3, F.col("event_no"))),
    )
    envelope = F.struct(
        F.when(kind == 1, F.lit(2)).otherwise(F.lit(1)).alias("schemaVersion"),
        unless(2, uuid(1, F.col("tenant_id").cast("bigint"))).alias("tenantId"),
        unless(3, uuid(2, F.col("site_id").cast("bigint"))).alias("siteId"),
        unless(4, uuid(4, visit())).alias("sessionId"),
        F.col("anonymous_id").alias("anonymousId"),
        F.lit("0.1.0").alias("sdkVersion"),
        unless(12, fx.iso_utc("ingested_at")).alias("receivedAt"),
        unless(5, event).alias("event"),
        F.col("user_agent").alias("userAgent"),
    )
    text = F.to_json(envelope)
    doubled = F.regexp_replace(text, r'"props":\{', r'"props":{"x":1,"x":2,')
    value = (
        F.when(kind == 10, F.substring(text, F.lit(1), F.length(text) - 1))
        .when(kind == 11, F.concat(text, F.lit(" trailing")))
        .when((kind == 0) & (F.col("event_no") % 2 == 1) & F.lit(defects), doubled)
        .otherwise(text)
    )
    return rows.select(
        F.lit(TELEMETRY_TOPIC).alias("topic"),
        (F.col("user_id") % 6).cast("int").alias("partition"),
        F.col("event_no").alias("offset"),
        F.col("ingested_at").alias("timestamp"),
        uuid(4, visit()).alias("key"),
        value.alias("value"),
    )


REASON_SQL = """CASE event_id % 13 WHEN 0 THEN CASE WHEN event_id % 2 = 1 THEN 'store_rejected' ELSE 'ok' END
  WHEN 1 THEN 'unsupported_schema_version' WHEN 2 THEN 'missing_tenant' WHEN 3 THEN 'missing_site' WHEN 4 THEN 'missing_session'
  WHEN 5 THEN 'missing_event' WHEN 6 THEN 'missing_event_id' WHEN 7 THEN 'missing_type' WHEN 9 THEN 'bad_type'
  WHEN 10 THEN 'deserialization' WHEN 11 THEN 'deserialization' ELSE 'missing_ts' END"""


@query(f"SELECT event_id AS \"offset\", {REASON_SQL} AS reason FROM events")
def classify_telemetry(spark, folder):
    classified = ingest.classify_telemetry(ingest.decode_envelope(telemetry_records(spark, folder), "telemetry"))
    return classified.select("offset", F.coalesce("reason", F.lit("ok")).alias("reason"))


@query(
    f"""SELECT '{TELEMETRY_TOPIC}' AS topic, reason, count(*) AS n FROM (SELECT {REASON_SQL} AS reason FROM events)
  WHERE reason <> 'ok' GROUP BY ALL"""
)
def dead_letter_report(spark, folder):
    classified = ingest.classify_telemetry(ingest.decode_envelope(telemetry_records(spark, folder), "telemetry"))
    return ingest.dead_letter_report(ingest.split_poison(classified)[1])


@query(
    fx.on_base(
        f""" SELECT event_no AS event_id, user_id % 4 AS tenant_id, user_id % 8 AS site_id,
  user_id * 100 + ts_ms // {DAY_MS} - {DAY_ONE} AS session_id, anonymous_id, ts_ms, ingested_ms, event_type, event_name, url, path,
  '' AS page_title, target_selector, target_text, error_message, '' AS error_stack,
  CASE WHEN replaced THEN 'replaceState' ELSE '' END AS "trigger" FROM base"""
    )
)
def event_rows(spark, folder):
    good = ingest.decode_envelope(telemetry_records(spark, folder, defects=False), "telemetry")
    rows = ingest.to_event_rows(ingest.split_poison(ingest.classify_telemetry(good))[0])
    from trailmark.functions.json import prop

    return rows.select(
        *[number_of(F.col(name)).alias(name) for name in ("event_id", "tenant_id", "site_id", "session_id")],
        "anonymous_id",
        ms("ts", "ts_ms"),
        ms("ingested_at", "ingested_ms"),
        "event_type",
        "event_name",
        "url",
        "path",
        "page_title",
        "target_selector",
        "target_text",
        "error_message",
        "error_stack",
        prop(F.col("props"), "trigger").alias("trigger"),
    )


BLOCK = 500  # events of one user within this many event numbers share a body, so no body grows with the data
MAX_AGE_MS, MAX_SKEW_MS, MAX_EVENTS = 6 * HOUR_MS, HOUR_MS // 12, 8


def event_bodies(spark, folder):
    """Given events as request bodies, some of them broken. `batch_no % 11` says how."""
    rows = fx.base_events(spark, folder).withColumn("block", F.floor(F.col("event_no") / BLOCK))
    kind = (F.col("user_id") + F.col("block")) % 11
    unknown = F.col("k") % 10 == 9
    event = wire_event(
        F.when(unknown, F.lit("GAZE")).otherwise(F.col("event_type")),
        F.when((kind != 4) | unknown, F.unix_millis("ts")),
        uuid(3, F.col("event_no")),
    )
    grouped = rows.groupBy("user_id", "block").agg(
        F.collect_list(event).alias("events"),
        F.timestamp_millis(F.unix_millis(F.max("ts")) - HOUR_MS).alias("received_at"),
    )
    session = F.when(kind == 1, F.lit(None)).when(kind == 2, F.lit("not-a-uuid")).otherwise(uuid(4, F.col("user_id")))
    body = F.to_json(
        F.struct(
            F.concat(F.lit("key-"), (F.col("user_id") % 8).cast("string")).alias("siteKey"),
            session.alias("sessionId"),
            F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("anonymousId"),
            F.lit("0.1.0").alias("sdkVersion"),
            F.when(kind == 3, F.array()).otherwise(F.col("events")).alias("events"),
        )
    )
    # What is wrong in an event of unknown type does not matter.
    body = F.regexp_replace(body, '"type":"GAZE","ts":[0-9]+', '"type":"GAZE","ts":"soon"')
    broken = F.regexp_replace(body, r'"props":\{[^}]*\}', '"props":[1]')
    return grouped.select(
        "user_id",
        "block",
        "received_at",
        F.when(kind == 5, broken).when(kind == 6, F.concat(body, F.lit("}"))).otherwise(body).alias("body"),
        (F.col("user_id") % 4).cast("string").alias("tenant_id"),
        (F.col("user_id") % 8).cast("string").alias("site_id"),
        F.lit("probe/1.0").alias("user_agent"),
    )


BODIES_SQL = f"""WITH {fx.BASE_SQL}, b AS (
  SELECT *, event_no // {BLOCK} AS block, (user_id + event_no // {BLOCK}) % 11 AS kind, k % 10 = 9 AS unknown FROM base
), body AS (
  SELECT user_id, block, any_value(kind) AS kind, max(ts_ms) - {HOUR_MS} AS received_ms, count(*) AS total, count(*) FILTER (NOT unknown) AS known
  FROM b GROUP BY user_id, block
), judged AS (
  SELECT *, CASE WHEN kind IN (1, 2, 3, 6) THEN 'invalid' WHEN total > {MAX_EVENTS} THEN 'too_large'
    WHEN kind IN (4, 5) AND known > 0 THEN 'invalid' ELSE '' END AS rejection FROM body
), ok AS (
  SELECT b.*, received_ms, ts_ms BETWEEN received_ms - {MAX_AGE_MS} AND received_ms + {MAX_SKEW_MS} AS inside
  FROM judged JOIN b USING (user_id, block) WHERE rejection = ''
)"""


def accepted_bodies(spark, folder):
    parsed = ingest.validate_batches(ingest.parse_batches(event_bodies(spark, folder)), MAX_EVENTS)
    return ingest.within_time_window(ingest.drop_unknown_types(parsed), MAX_AGE_MS, MAX_SKEW_MS)


@query(BODIES_SQL + " SELECT user_id, block, rejection FROM judged")
def validate_batches(spark, folder):
    parsed = ingest.validate_batches(ingest.parse_batches(event_bodies(spark, folder)), MAX_EVENTS)
    return parsed.select("user_id", "block", F.coalesce("rejection", F.lit("")).alias("rejection"))


@query(
    BODIES_SQL
    + """ SELECT 'accepted' AS outcome, '' AS reason, (SELECT count(*) FROM ok WHERE NOT unknown AND inside) AS n
  UNION ALL SELECT 'dropped', 'unknown_type', (SELECT count(*) FROM ok WHERE unknown)
  UNION ALL SELECT 'dropped', 'ts_out_of_window', (SELECT count(*) FROM ok WHERE NOT unknown AND NOT inside)
  UNION ALL SELECT 'rejected', 'invalid', (SELECT count(*) FROM judged WHERE rejection = 'invalid')
  UNION ALL SELECT 'rejected', 'too_large', (SELECT count(*) FROM judged WHERE rejection = 'too_large')"""
)
def ingest_report(spark, folder):
    return ingest.ingest_report(accepted_bodies(spark, folder))


@query(
    BODIES_SQL
    + """ SELECT event_no AS event_id, tenant_id, site_id, user_id AS session_id, anonymous_id, received_ms, event_type, ts_ms,
  replace(error_message, 'u' || user_id || '@example.com', '[email]') AS error_message FROM ok WHERE NOT unknown AND inside"""
)
def explode_batches(spark, folder):
    """Accepted bodies as cleaned events, one row each."""
    accepted = accepted_bodies(spark, folder).filter("rejection IS NULL")
    rows = ingest.sanitize_events(ingest.explode_batches(accepted))
    return rows.select(
        number_of(F.col("event.clientEventId")).alias("event_id"),
        "tenant_id",
        "site_id",
        number_of(F.col("session_id")).alias("session_id"),
        "anonymous_id",
        ms("received_at", "received_ms"),
        F.col("event.type").alias("event_type"),
        F.col("event.ts").alias("ts_ms"),
        F.col("event.errorMessage").alias("error_message"),
    )


@query(
    f"""SELECT event_id, epoch_us(ts) // 1000 AS ts_ms FROM events
  WHERE epoch_us(ts) // 1000 BETWEEN {fx.NOW_MS - S.MAX_EVENT_AGE_MS} AND {fx.NOW_MS + S.MAX_CLOCK_SKEW_MS}"""
)
def within_time_window(spark, folder):
    rows = fx.table(spark, folder, "events").select("event_id", fx.epoch_ms("ts").alias("ts_ms"))
    return rows.filter(ingest.in_window(F.col("ts_ms"), fx.now()))


@query("SELECT doc_id, substring(text, 1, 512) AS text, length(substring(text, 1, 512)) AS n FROM documents")
def truncate_fields(spark, folder):
    documents = fx.table(spark, folder, "documents").select("doc_id", "text")
    return ingest.truncate_fields(documents, {"text": 512}).withColumn("n", F.length("text").cast("bigint"))


EMAIL_SQL = f"regexp_replace(text, '{X.EMAIL_PATTERN}', '[email]', 'g')"
# DuckDB's patterns have no look-around: the characters around a match are captured and put back.
# Two passes find neighbours that share the character between them.
CARD_SQL = r"regexp_replace({}, '(^|[^\w-])(?:\d[ -]?){{12,18}}\d($|[^\w-])', '\1[card]\2', 'g')"
PHONE_SQL = (
    r"regexp_replace(regexp_replace({}, '(^|[^\w+])\+\d(?:[ ().-]{{0,2}}\d){{7,14}}($|\W)', '\1[phone]\2', 'g'), "
    r"'(^|[^\w-])(?:\(\d{{3}}\) ?|\d{{3}}[.-])\d{{3}}[.-]\d{{4}}($|[^\w-])', '\1[phone]\2', 'g')"
)


def redacted_sql(text: str) -> str:
    cards = CARD_SQL.format(CARD_SQL.format(EMAIL_SQL.replace("(text,", f"({text},")))
    return PHONE_SQL.format(PHONE_SQL.format(cards))


@query(f"SELECT doc_id, {EMAIL_SQL} AS text FROM documents")
def redact_email(spark, folder):
    documents = fx.table(spark, folder, "documents")
    return documents.select("doc_id", X.redact_email(F.col("text")).alias("text"))


@query(f"SELECT doc_id, {redacted_sql('text')} AS text FROM documents")
def redact_text(spark, folder):
    documents = fx.table(spark, folder, "documents")
    return documents.select("doc_id", X.redact_text(F.col("text")).alias("text"))


def _encoded_sql(text: str) -> str:
    """Form encoding: a space is `+`, `*` stays, `~` does not."""
    return f"replace(replace(replace(url_encode({text}), '%20', '+'), '%2A', '*'), '~', '%7E')"


@query(
    f"""SELECT doc_id, 'https://shop.example/' || lang || '?q=' || {_encoded_sql(redacted_sql('text'))} || '&page=1#' || source AS url
  FROM documents UNION ALL SELECT page_id AS doc_id, url FROM pages"""
)
def redact_url(spark, folder):
    """Page addresses, and addresses with a whole document as a query value."""
    query_value = F.url_encode("text")
    made = F.concat(
        F.lit("https://shop.example/"), F.col("lang"), F.lit("?q="), query_value, F.lit("&page=1#"), F.col("source")
    )
    documents = fx.table(spark, folder, "documents").select("doc_id", made.alias("url"))
    pages = fx.table(spark, folder, "pages").select(F.col("page_id").alias("doc_id"), "url")
    return documents.unionByName(pages).select("doc_id", X.redact_url(F.col("url")).alias("url"))




@query("SELECT page_id, split_part(url, '#', 1) AS url FROM pages")
def cut_fragment(spark, folder):
    return fx.table(spark, folder, "pages").select("page_id", W.cut_fragment(F.col("url")).alias("url"))


@query(
    r"""SELECT page_id, origin, CASE page_id % 6 WHEN 0 THEN true WHEN 1 THEN true WHEN 5 THEN starts_with(origin, 'https:')
  ELSE false END AS allowed FROM (SELECT page_id, regexp_extract(url, '^[a-z]+://[^/]+') || CASE page_id % 6 WHEN 1 THEN ':8080'
  WHEN 4 THEN ':123456' ELSE '' END AS origin FROM pages)"""
)
def origin_allowed(spark, folder):
    """Each page's origin against its own allow-list: exact, any port, star, another host, a bad port, other scheme."""
    kind = F.col("page_id") % 6
    base = F.regexp_extract("url", "^[a-z]+://[^/]+", 0)
    origin = F.concat(base, F.when(kind == 1, F.lit(":8080")).when(kind == 4, F.lit(":123456")).otherwise(F.lit("")))
    allowed = (
        F.when(kind == 0, F.array(F.concat(F.upper(base), F.lit("/"))))
        .when(kind.isin(1, 4), F.array(F.lit("https://other.example"), F.concat(base, F.lit(":*"))))
        .when(kind == 2, F.array(F.lit("*")))
        .when(kind == 3, F.array(F.lit("https://other.example")))
        .otherwise(F.array(F.regexp_replace(base, "^http:", "https:")))
    )
    pages = fx.table(spark, folder, "pages").select("page_id", origin.alias("origin"), allowed.alias("entries"))
    return pages.select("page_id", "origin", W.origin_allowed(F.col("origin"), F.col("entries")).alias("allowed"))


def dimensions(spark, folder):
    """Nations as sites with one key each, their regions as tenants; some revoked, inactive or deleted."""
    nation = fx.table(spark, folder, "nation")
    number = F.col("n_nationkey")
    deleted = F.when(number % 11 == 10, fx.now())
    site = nation.select(
        number.cast("string").alias("id"),
        F.col("n_regionkey").cast("string").alias("tenant_id"),
        F.array(F.concat(F.lit("https://n"), number.cast("string"), F.lit(".example"))).alias("allowed_origins"),
        (number % 5 / 4.0).alias("sampling_rate"),
        (number % 7 != 0).alias("is_active"),
        deleted.alias("deleted_at"),
    )
    key = nation.select(
        F.sha2(F.concat(F.lit("key-"), number.cast("string")), 256).alias("key_hash"),
        F.col("n_regionkey").cast("string").alias("tenant_id"),
        number.cast("string").alias("site_id"),
        F.when(number % 5 == 4, fx.now()).alias("revoked_at"),
        F.lit(True).alias("is_active"),
        F.lit(None).cast("timestamp").alias("deleted_at"),
    )
    region = fx.table(spark, folder, "region")
    tenant = region.select(
        F.col("r_regionkey").cast("string").alias("id"),
        (F.col("r_regionkey") != 3).alias("is_active"),
        F.lit(None).cast("timestamp").alias("deleted_at"),
    )
    return key, site, tenant


def key_requests(spark, folder):
    """Customers as requests with the key of their nation; some without a key, with a wrong one, or from elsewhere."""
    number = F.col("c_custkey")
    key = (
        F.when(number % 17 == 0, F.lit(" "))
        .when(number % 10 == 1, F.lit("key-unknown"))
        .otherwise(F.concat(F.lit("key-"), F.col("c_nationkey").cast("string")))
    )
    host = F.when(number % 3 == 0, F.lit("other")).otherwise(F.concat(F.lit("n"), F.col("c_nationkey").cast("string")))
    return fx.table(spark, folder, "customer").select(
        "c_custkey", key.alias("site_key"), F.concat(F.lit("https://"), host, F.lit(".example")).alias("origin")
    )


KEYS_SQL = """WITH r AS (
  SELECT c_custkey, CASE WHEN c_custkey % 17 = 0 THEN ' ' WHEN c_custkey % 10 = 1 THEN 'key-unknown' ELSE 'key-' || c_nationkey END AS site_key,
    c_custkey % 3 = 0 AS elsewhere FROM customer
), keys AS (
  SELECT 'key-' || n_nationkey AS site_key, CAST(n_regionkey AS VARCHAR) AS tenant_id, CAST(n_nationkey AS VARCHAR) AS site_id
  FROM nation WHERE n_nationkey % 5 <> 4 AND n_nationkey % 7 <> 0 AND n_nationkey % 11 <> 10 AND n_regionkey <> 3
) """


@query(KEYS_SQL + "SELECT c_custkey, sha256(site_key) AS key_hash, tenant_id, site_id FROM r JOIN keys USING (site_key)")
def resolve_sites(spark, folder):
    resolved = ingest.resolve_sites(key_requests(spark, folder), *dimensions(spark, folder))
    return resolved.select("c_custkey", "key_hash", "tenant_id", "site_id")


@query(
    KEYS_SQL
    + """SELECT c_custkey, CASE WHEN trim(site_key) = '' THEN 'missing_key' WHEN site_id IS NULL THEN 'unknown_key'
  WHEN elsewhere THEN 'origin_not_allowed' ELSE '' END AS rejection FROM r LEFT JOIN keys USING (site_key)"""
)
def authorize(spark, folder):
    judged = ingest.authorize(key_requests(spark, folder), *dimensions(spark, folder))
    return judged.select("c_custkey", F.coalesce("rejection", F.lit("")).alias("rejection"))


@query(
    fx.on_base(
        """, e AS (SELECT *, CAST(event_no // 3 AS VARCHAR) AS sid FROM base),
  owner AS (SELECT sid, arg_min(tenant_id, (ingested_ms, tenant_id)) AS owner FROM e GROUP BY sid),
  per AS (
    SELECT tenant_id, sid, bool_or(c.c_custkey IS NULL) AS lost,
      coalesce(arg_min(event_no, (ts_ms, event_id)) FILTER (event_type = 'NAVIGATION') % 50 = 0, false) AS nul
    FROM e LEFT JOIN (SELECT * FROM customer WHERE c_custkey % 7 <> 0) c ON c.c_custkey = e.user_id GROUP BY tenant_id, sid
  ) SELECT event_id, CASE WHEN lost OR nul OR owner <> tenant_id THEN 'store_rejected' ELSE '' END AS reason
  FROM e JOIN owner USING (sid) JOIN per USING (tenant_id, sid)"""
    )
)
def reject_unknown_refs(spark, folder):
    """Every customer is a site, a seventh of them is missing; three consecutive events share a session id."""
    rows = fx.base_events(spark, folder).withColumns(
        {
            "session_id": F.floor(F.col("event_no") / 3).cast("string"),
            "site_id": F.col("user_id").cast("string"),
            "url": F.when(F.col("event_no") % 50 == 0, F.concat("url", F.lit("\x00"))).otherwise(F.col("url")),
        }
    )
    sites = (
        fx.table(spark, folder, "customer")
        .filter("c_custkey % 7 <> 0")
        .select(F.col("c_custkey").cast("string").alias("id"), (F.col("c_custkey") % 4).cast("string").alias("tenant_id"))
    )
    checked = ingest.reject_unknown_refs(rows, sites)
    return checked.select("event_id", F.coalesce("reason", F.lit("")).alias("reason"))


@query(
    fx.on_events(
        """ SELECT event_id, session_id FROM ev
  WHERE CAST('0x' || substr(md5(session_id), 1, 8) AS BIGINT) < (user_id % 8) / 7.0 * 4294967296"""
    )
)
def sample_sessions(spark, folder):
    events = fx.events(spark, folder)
    sites = events.select(F.col("site_id").alias("id")).distinct().withColumn("sampling_rate", F.col("id").cast("int") / 7.0)
    return governance.sample_sessions(events, sites).select("event_id", "session_id")


@query(
    """SELECT key_hash, window_start_ms, count(*) AS n FROM (
    SELECT sha256('key-' || (user_id % 8)) AS key_hash, epoch_us(ts) // 3600000000 * 3600000 AS window_start_ms FROM events)
  GROUP BY ALL HAVING count(*) > 3"""
)
def rate_exceedance(spark, folder):
    """Site keys with more than three events in an hour; the live limit is per second."""
    key = F.sha2(F.concat(F.lit("key-"), F.col("site_id")), 256)
    requests = fx.base_events(spark, folder).select(key.alias("key_hash"), "ts")
    return ingest.rate_exceedance(requests, 3, HOUR_MS)


RATE = {"burst": 5, "refill": 4, "period_ms": DAY_MS}


@query(
    f"""WITH RECURSIVE steps AS (
    SELECT user_id % 8 AS site, epoch_us(ts) // 1000 * 4 // {DAY_MS} AS step, count(*) AS n FROM events GROUP BY ALL
  ), numbered AS (SELECT *, row_number() OVER (PARTITION BY site ORDER BY step) AS i FROM steps
  ), bucket AS (
    SELECT site, step, i, n, least(n, 5) AS accepted, 5 - least(n, 5) AS level FROM numbered WHERE i = 1
    UNION ALL
    SELECT s.site, s.step, s.i, s.n, least(s.n, least(5, level + s.step - b.step)),
      least(5, level + s.step - b.step) - least(s.n, least(5, level + s.step - b.step))
    FROM bucket b JOIN numbered s ON s.site = b.site AND s.i = b.i + 1
  )
  SELECT sha256('key-' || site) AS key_hash, step // 4 * {DAY_MS} AS window_start_ms, CAST(sum(n) AS BIGINT) AS n,
    CAST(sum(accepted) AS BIGINT) AS accepted, CAST(sum(n - accepted) AS BIGINT) AS refused FROM bucket GROUP BY ALL HAVING sum(n) > sum(accepted)"""
)
def rate_audit(spark, folder):
    """A bucket of five for each site key, refilled four times a day; the live one holds 100 and gets 50 a second."""
    key = F.sha2(F.concat(F.lit("key-"), F.col("site_id")), 256)
    requests = fx.base_events(spark, folder).select(key.alias("key_hash"), "ts")
    return ingest.rate_audit(requests, **RATE)


@query(
    """SELECT doc_id, CASE doc_id % 8 WHEN 0 THEN 'smsOtp' WHEN 1 THEN 'saved.cvc' WHEN 2 THEN 'CVN3digits' WHEN 3 THEN 'adoption'
    WHEN 4 THEN 'OTPSent' WHEN 5 THEN 'cvcard' WHEN 6 THEN 'street' ELSE 'visa CVV' END || '_' || source AS name,
  doc_id % 8 IN (0, 1, 2, 4, 7) AS sensitive FROM documents"""
)
def sensitive_fields(spark, folder):
    """One field name per document, made from its source."""
    names = ["smsOtp", "saved.cvc", "CVN3digits", "adoption", "OTPSent", "cvcard", "street", "visa CVV"]
    chosen = F.element_at(F.array(*[F.lit(name) for name in names]), (F.col("doc_id") % 8 + 1).cast("int"))
    documents = fx.table(spark, folder, "documents")
    fields = documents.select("doc_id", F.concat(chosen, F.lit("_"), F.col("source")).alias("name"))
    return governance.sensitive_fields(fields)


@query(
    r"""SELECT doc_id, repeat('*', length(lang)) AS lang, CASE WHEN source = '' THEN '' ELSE '******' END AS source,
  regexp_replace(text, '\S', '*', 'g') AS text, n_chars, '******' AS "smsOtp", '******' AS cvv_back, '******' AS cvn FROM documents"""
)
def mask_columns(spark, folder):
    """Columns with sensitive names are masked as such whatever the rules say, and also without one."""
    documents = fx.table(spark, folder, "documents").select(
        "doc_id", "lang", "source", "text", "n_chars", *[F.col("source").alias(name) for name in ("smsOtp", "cvv_back", "cvn")]
    )
    rules = {"lang": "mask", "source": "sensitive", "text": "mask_text", "n_chars": "unmask", "smsOtp": "unmask", "cvv_back": "mask"}
    return governance.mask_columns(documents, rules)


SECRETS = {"mail host": "@mail1.example.com", "area code": "+1 (743)", "masked run": "* * *", "absent": "correct horse battery"}


@query(
    """SELECT * FROM ("""
    + " UNION ALL ".join(
        f"SELECT '{table}' AS \"table\", '{name}' AS secret, count(*) FILTER (contains(text, '{value}')) AS rows_with_secret, "
        f"count(*) FILTER (contains(text, repeat('*', {len(value)}))) AS rows_masked FROM {table}"
        for table in ("documents", "conversations")
        for name, value in SECRETS.items()
    )
    + ")"
)
def leak_scan(spark, folder):
    tables = {name: (fx.table(spark, folder, name), ["text"]) for name in ("documents", "conversations")}
    secrets = spark.createDataFrame(list(SECRETS.items()), "name string, secret string")
    return governance.leak_scan(tables, secrets)
