"""From request bodies and raw records to validated envelopes and event rows."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trailmark import schemas as S
from trailmark.functions import json as J
from trailmark.functions import text as X
from trailmark.functions import web as W
from trailmark.operators.once import with_once

# An instant on the wire has a time and a zone.
INSTANT = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d{1,9})?(Z|[+-]\d{2}:\d{2})$"
SPREAD = 16  # tasks that the events of one session are dealt over in a join
PERMISSIVE = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": S.CORRUPT}


def decode_envelope(df: DataFrame, kind: str, value: str = "value") -> DataFrame:
    """Adds `envelope`, and `well_formed` for values that are one JSON object of the right shape.

    `kind` is `telemetry` or `replay`. Unknown fields are ignored; the raw value stays for the dead letters.
    """
    schema = {"telemetry": S.TELEMETRY_ENVELOPE, "replay": S.REPLAY_ENVELOPE}[kind]
    text = F.col(value).cast("string")
    decoded = with_once(
        df, {"envelope": F.from_json(text, schema, PERMISSIVE), "_single": J.is_single_object(text)}
    )
    e = F.col("envelope")
    received = F.when(e["receivedAt"].rlike(INSTANT), F.try_to_timestamp(e["receivedAt"]))
    ids = ["tenantId", "siteId", "sessionId"] + (["event.clientEventId"] if kind == "telemetry" else [])
    bad_id = F.lit(False)
    for name in ids:
        field = F.col(f"envelope.{name}")
        bad_id = bad_id | (field.isNotNull() & ~W.is_uuid(field))
    bad_instant = e["receivedAt"].isNotNull() & received.isNull()
    shaped = F.col("_single") & e[S.CORRUPT].isNull() & ~bad_id & ~bad_instant
    added = {"received_at": received, "well_formed": F.coalesce(shaped, F.lit(False))}
    return with_once(decoded, added).drop("_single")


def _common_reasons(e: Column) -> list[tuple[Column, str]]:
    version = F.coalesce(e["schemaVersion"], F.lit(0))
    return [
        (version != S.SCHEMA_VERSION, "unsupported_schema_version"),
        (e["tenantId"].isNull(), "missing_tenant"),
        (e["siteId"].isNull(), "missing_site"),
        (e["sessionId"].isNull(), "missing_session"),
    ]


def _first_reason(tests: list[tuple[Column, str]]) -> Column:
    reason = F.lit(None).cast("string")
    for test, code in reversed(tests):
        reason = F.when(test, F.lit(code)).otherwise(reason)
    return reason


def classify_telemetry(decoded: DataFrame) -> DataFrame:
    """Adds `reason`: why a telemetry record is poison, or null when it is good."""
    e = F.col("envelope")
    event = e["event"]
    tests = [
        (~F.col("well_formed"), "deserialization"),
        (event["type"].isNotNull() & ~event["type"].isin(S.EVENT_TYPES), "bad_type"),
        *_common_reasons(e),
        (event.isNull(), "missing_event"),
        (event["clientEventId"].isNull(), "missing_event_id"),
        (event["type"].isNull(), "missing_type"),
        (event["ts"].isNull() | F.col("received_at").isNull(), "missing_ts"),
        (J.is_object(event["props"]) & ~J.is_storable_object(event["props"]), "store_rejected"),
    ]
    return with_once(decoded, {"reason": _first_reason(tests)})


def classify_replay(decoded: DataFrame) -> DataFrame:
    """The same for replay chunks; also adds the decoded `chunk_events`."""
    decoded = with_once(decoded, {"chunk_events": J.replay_events(F.col("envelope.events"))})
    e = F.col("envelope")
    valid = J.all_have_timestamps(F.col("chunk_events"))
    seq = F.coalesce(e["chunkSeq"], F.lit(0))
    tests = [
        (~F.col("well_formed"), "deserialization"),
        *_common_reasons(e),
        (F.col("received_at").isNull(), "missing_ts"),
        (e["events"].isNull() & e["payload"].isNotNull(), "unsupported_payload"),
        ((seq < 0) | e["payload"].isNotNull() | ~valid, "invalid_chunk"),
    ]
    return with_once(decoded, {"reason": _first_reason(tests)})


def split_poison(classified: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Good rows and poison rows; together they are the input, and no row is in both."""
    return classified.filter("reason IS NULL"), classified.filter("reason IS NOT NULL")


def to_event_rows(envelopes: DataFrame, carried: Sequence[str] = ()) -> DataFrame:
    """Good telemetry records as rows of the `events` table. Columns named in `carried` go along."""
    e = F.col("envelope")
    event = e["event"]

    def text(field: Column) -> Column:
        return F.coalesce(field, F.lit(""))

    return envelopes.select(
        *carried,
        F.lower(event["clientEventId"]).alias("event_id"),
        F.lower(e["tenantId"]).alias("tenant_id"),
        F.lower(e["siteId"]).alias("site_id"),
        F.lower(e["sessionId"]).alias("session_id"),
        text(e["anonymousId"]).alias("anonymous_id"),
        F.lit(None).cast("string").alias("end_user_id"),
        F.timestamp_millis(event["ts"]).alias("ts"),
        F.col("received_at").alias("ingested_at"),
        event["type"].alias("event_type"),
        text(event["eventName"]).alias("event_name"),
        text(event["url"]).alias("url"),
        text(event["path"]).alias("path"),
        text(event["title"]).alias("page_title"),
        text(event["targetSelector"]).alias("target_selector"),
        text(event["targetText"]).alias("target_text"),
        text(event["errorMessage"]).alias("error_message"),
        text(event["errorStack"]).alias("error_stack"),
        *network_columns(event["type"], event["props"]),
        F.when(J.is_object(event["props"]), event["props"]).otherwise(F.lit("{}")).alias("props"),
        e["userAgent"].alias("user_agent"),
    )


def network_columns(event_type: Column, props: Column) -> list[Column]:
    """Method, redacted URL, status and duration of network calls, out of `props` (`method`, `url`, `status`, `durationMs`).

    Other events, and values that are missing or do not fit the stored types, have an empty text or zero.
    """
    is_call = event_type == "NETWORK"

    def number(path: str, most: int) -> Column:
        value = F.get_json_object(props, f"$.{path}").try_cast("double")
        return F.when(is_call & value.between(0, most), F.floor(value)).otherwise(F.lit(0))

    return [
        F.when(is_call, F.substring(J.prop(props, "method"), 1, S.MAX_METHOD_LENGTH)).otherwise(F.lit("")).alias("http_method"),
        F.when(is_call, X.redact_url(J.prop(props, "url"))).otherwise(F.lit("")).alias("http_url"),
        number("status", 2**16 - 1).cast("int").alias("http_status"),
        number("durationMs", 2**32 - 1).cast("bigint").alias("http_duration_ms"),
    ]


def parse_batches(bodies: DataFrame, body: str = "body") -> DataFrame:
    """Adds `batch`, the decoded events body, `unknown_events` and `well_formed`.

    Events of unknown type are counted and left out before anything else in them is looked at, so that nothing in them
    can spoil the body.
    """
    text = F.col(body).cast("string")
    whole = {"_whole": F.from_json(text, S.RAW_EVENT_BATCH, PERMISSIVE), "_single": J.is_single_object(text)}
    parsed = with_once(bodies, whole)
    raw = F.col("_whole.events")
    kept = F.filter(F.transform(raw, lambda event: F.coalesce(event, F.lit("null"))), lambda event: ~_unknown(event))
    events = F.from_json(F.concat(F.lit('{"events":['), F.array_join(kept, ","), F.lit("]}")), S.EVENT_LIST, PERMISSIVE)
    parsed = with_once(parsed, {"_events": events, "unknown_events": F.size(raw) - F.size(kept)})
    shaped = F.col("_single") & F.col(f"_whole.{S.CORRUPT}").isNull()
    shaped = shaped & (raw.isNull() | F.col(f"_events.{S.CORRUPT}").isNull())
    batch = F.struct(*[F.when(raw.isNotNull(), F.col("_events.events")).alias(n) if n == "events" else F.col(f"_whole.{n}").alias(n) for n in S.EVENT_BATCH_FIELDS])
    parsed = parsed.withColumns({"batch": batch, "well_formed": F.coalesce(shaped, F.lit(False))})
    return parsed.drop("_single", "_whole", "_events")


def _unknown(event: Column) -> Column:
    """If the text of an event names a type, but none of ours. A number is no type, and spoils the body."""
    kind = F.get_json_object(event, "$.type")
    return F.coalesce(~kind.isin(S.EVENT_TYPES) & ~kind.rlike(r"^-?[0-9.]+$"), F.lit(False))


def validate_batches(parsed: DataFrame, max_events: int = S.MAX_EVENTS_PER_BATCH) -> DataFrame:
    """Adds `rejection`: `invalid`, `too_large` or null. Events of unknown type count, but are not checked.

    A body that cannot be bound, such as one with a malformed id, is invalid whatever its size.
    """
    batch = F.col("batch")
    events = batch["events"]
    total = F.size(events) + F.col("unknown_events")

    def unbound(event: Column) -> Column:
        return (event["clientEventId"].isNotNull() & ~W.is_uuid(event["clientEventId"])) | event["type"].rlike(r"^-?[0-9.]+$")

    def lacking(event: Column) -> Column:
        return (
            event.isNull()
            | event["clientEventId"].isNull()
            | event["type"].isNull()
            | event["ts"].isNull()
            | (event["props"].isNotNull() & ~J.is_object(event["props"]))
        )

    empty = (
        ~F.col("well_formed")
        | batch["sessionId"].isNull()
        | ~W.is_uuid(batch["sessionId"])
        | F.coalesce(total <= 0, F.lit(True))
    )
    rejection = (
        F.when(F.coalesce(empty, F.lit(True)), F.lit("invalid"))
        .when(F.exists(events, lambda event: F.coalesce(unbound(event), F.lit(False))), F.lit("invalid"))
        .when(total > max_events, F.lit("too_large"))
        .when(F.exists(events, lambda event: F.coalesce(lacking(event), F.lit(True))), F.lit("invalid"))
    )
    return with_once(parsed, {"rejection": rejection})


def drop_unknown_types(batches: DataFrame) -> DataFrame:
    """Counts the events of unknown type, which parsing has left out, in `dropped_unknown_type`."""
    return batches.withColumnRenamed("unknown_events", "dropped_unknown_type")


def in_window(
    ts_ms: Column, received_at: Column, max_age_ms: int = S.MAX_EVENT_AGE_MS, max_skew_ms: int = S.MAX_CLOCK_SKEW_MS
) -> Column:
    received = F.unix_millis(received_at)
    return ts_ms.between(received - max_age_ms, received + max_skew_ms)


def within_time_window(
    batches: DataFrame, max_age_ms: int = S.MAX_EVENT_AGE_MS, max_skew_ms: int = S.MAX_CLOCK_SKEW_MS
) -> DataFrame:
    """Keeps events whose client time lies in the accepted window around `received_at`; counts the rest."""
    kept = F.filter("batch.events", lambda e: in_window(e["ts"], F.col("received_at"), max_age_ms, max_skew_ms))
    narrowed = F.col("batch").withField("events", kept)
    return with_once(batches, {"dropped_out_of_window": F.size("batch.events") - F.size(kept), "batch": narrowed})


def truncate_fields(df: DataFrame, limits: dict[str, int]) -> DataFrame:
    return df.withColumns({name: X.truncate(F.col(name), limit) for name, limit in limits.items()})


def sanitize_event(event: Column, limits: dict[str, int] = S.FIELD_LIMITS) -> Column:
    """Redacts first, truncates second: a cut can then never leave half an address behind."""
    cleaned = {
        "url": X.redact_url(event["url"]),
        "targetText": X.redact_text(event["targetText"]),
        "errorMessage": X.redact_text(event["errorMessage"]),
        "errorStack": X.redact_text(event["errorStack"]),
    }
    fields = []
    for name in S.EVENT.fieldNames():
        field = cleaned.get(name, event[name])
        fields.append((X.truncate(field, limits[name]) if name in limits else field).alias(name))
    return F.struct(*fields)


def sanitize_events(df: DataFrame) -> DataFrame:
    """Cleans the `event` struct of exploded batches."""
    return with_once(df, {"event": sanitize_event(F.col("event"))})


def explode_batches(batches: DataFrame) -> DataFrame:
    """One row per event of every batch, stamped with what belongs to the request.

    Wants `tenant_id`, `site_id` (from `resolve_sites`), `received_at` and `user_agent` next to `batch`.
    """
    b = F.col("batch")
    return batches.select(
        F.col("tenant_id"),
        F.col("site_id"),
        b["sessionId"].alias("session_id"),
        X.truncate(F.coalesce(b["anonymousId"], F.lit("")), S.FIELD_LIMITS["anonymousId"]).alias("anonymous_id"),
        X.truncate(b["sdkVersion"], S.FIELD_LIMITS["sdkVersion"]).alias("sdk_version"),
        X.truncate(F.col("user_agent"), S.FIELD_LIMITS["userAgent"]).alias("user_agent"),
        F.col("received_at"),
        F.explode("batch.events").alias("event"),
    )


def accept_batches(bodies: DataFrame) -> DataFrame:
    """Validated, window-filtered, cleaned events of all accepted bodies, one row each."""
    accepted = validate_batches(parse_batches(bodies)).filter("rejection IS NULL")
    return sanitize_events(explode_batches(within_time_window(drop_unknown_types(accepted))))


def replay_envelopes(bodies: DataFrame, body: str = "body") -> DataFrame:
    """Replay bodies as chunks, with `rejection` = `invalid` for those without a raw event array."""
    text = F.col(body).cast("string")
    parsed = with_once(
        bodies, {"batch": F.from_json(text, S.REPLAY_BATCH, PERMISSIVE), "_single": J.is_single_object(text)}
    )
    batch = F.col("batch")
    valid = (
        F.col("_single")
        & batch[S.CORRUPT].isNull()
        & batch["sessionId"].isNotNull()
        & W.is_uuid(batch["sessionId"])
        & (batch["chunkSeq"] >= 0)
        & batch["events"].rlike(r"^\s*\[")
    )
    carried = [name for name in bodies.columns if name not in {"tenant_id", "site_id", "received_at", body}]
    return parsed.select(
        *carried,
        "tenant_id",
        "site_id",
        batch["sessionId"].alias("session_id"),
        batch["chunkSeq"].alias("chunk_seq"),
        "received_at",
        batch["events"].alias("events"),
        F.when(~F.coalesce(valid, F.lit(False)), F.lit("invalid")).alias("rejection"),
    )


def live(df: DataFrame) -> DataFrame:
    """Configuration rows in force: active and not soft-deleted."""
    return df.filter("is_active AND deleted_at IS NULL")


def keys_in_force(site_key: DataFrame, site: DataFrame, tenant: DataFrame) -> DataFrame:
    """Live, unrevoked keys whose site (of the same tenant) and tenant are live, with the site's settings."""
    keys = live(site_key).filter("revoked_at IS NULL").select("key_hash", "tenant_id", "site_id")
    sites = live(site).select(F.col("id").alias("site_id"), "tenant_id", "allowed_origins", "sampling_rate")
    tenants = live(tenant).select(F.col("id").alias("tenant_id"))
    return keys.join(sites, ["site_id", "tenant_id"]).join(tenants, "tenant_id")


def resolve_sites(requests: DataFrame, site_key: DataFrame, site: DataFrame, tenant: DataFrame) -> DataFrame:
    """Adds `tenant_id`, `site_id`, `allowed_origins` and `sampling_rate` to requests whose key is in force.

    The others drop out; `authorize` reports them.
    """
    resolved = keys_in_force(site_key, site, tenant)
    return requests.withColumn("key_hash", W.key_hash(F.col("site_key"))).join(resolved, "key_hash")


def authorize(requests: DataFrame, site_key: DataFrame, site: DataFrame, tenant: DataFrame) -> DataFrame:
    """Every request with `rejection`: `missing_key`, `unknown_key`, `origin_not_allowed` or null."""
    resolved = keys_in_force(site_key, site, tenant)
    key = F.col("site_key")
    rejection = (
        F.when(key.isNull() | (F.trim(key) == ""), F.lit("missing_key"))
        .when((F.length(key) > S.MAX_SITE_KEY_LENGTH) | F.col("site_id").isNull(), F.lit("unknown_key"))
        .when(~W.origin_allowed(F.col("origin"), F.col("allowed_origins")), F.lit("origin_not_allowed"))
    )
    return (
        requests.withColumn("key_hash", W.key_hash(key)).join(resolved, "key_hash", "left").withColumn("rejection", rejection)
    )


def refused_sessions(df: DataFrame, site: DataFrame, sessions: DataFrame | None = None) -> DataFrame:
    """`tenant_id` and `session_id` of the sessions that `reject_unknown_refs` refuses, each once.

    What is looked at of an event are a few short columns, folded per session before anything is shuffled; sessions meet
    their owners as one row each.
    """
    known = site.select("tenant_id", F.col("id").alias("site_id"), F.lit(True).alias("_known")).distinct()
    looked_at = ["tenant_id", "site_id", "session_id", "anonymous_id", "event_id", "event_type", "url", "ts", "ingested_at"]
    rows = df.filter(F.col("session_id").isNotNull()).select(*looked_at).join(known, ["tenant_id", "site_id"], "left")
    timed = F.col("ts").isNotNull()  # others are dropped, and say no more than when the session came
    # What a session stores: the anonymous id received first, and the url of its earliest navigation.
    entered = timed & (F.col("event_type") == "NAVIGATION") & (F.col("url") != "")
    per_session = rows.groupBy("tenant_id", "session_id").agg(
        F.min(F.struct("ingested_at", "tenant_id")).alias("_arrival"),
        F.min(F.when(timed, F.struct("ingested_at", "event_id", "anonymous_id"))).getField("anonymous_id").alias("_anonymous"),
        F.min(F.when(entered, F.struct("ts", "event_id", "url"))).getField("url").alias("_entry"),
        F.max(F.when(timed, F.col("_known").isNull())).alias("_lost"),
    )
    # One row for each tenant that uses a session id.
    owner = F.min("_arrival").over(Window.partitionBy("session_id")).getField("tenant_id")
    per_session = per_session.withColumn("_owner", owner)
    if sessions is not None:
        held = sessions.select(F.col("id").alias("session_id"), F.col("tenant_id").alias("_held"))
        per_session = per_session.join(held, "session_id", "left").withColumn("_owner", F.coalesce("_held", "_owner"))
    stored = F.concat_ws(" ", "_anonymous", "_entry")
    refused = F.col("_lost") | (F.col("_owner") != F.col("tenant_id")) | stored.contains("\x00")
    return per_session.filter(F.col("tenant_id").isNotNull() & refused).select("tenant_id", "session_id").distinct()


def reject_unknown_refs(
    df: DataFrame, site: DataFrame, sessions: DataFrame | None = None, refused: DataFrame | None = None
) -> DataFrame:
    """Adds `reason` = `store_rejected` to events of sessions the session store would refuse.

    Refused are, with all their events of this batch: sessions of an unknown (tenant, site); sessions whose id belongs to
    another tenant (the known owner, else the one received first); sessions whose anonymous id or entry page, the values
    that are stored, hold a NUL character. Events without a tenant, a session or a time are dropped.

    `refused` is what `refused_sessions` gives for the same arguments, for callers that have it at hand. Events are moved
    once at most, and not at all where the refused sessions are measured to be few. A session is dealt over `SPREAD` tasks.
    """
    refused = refused_sessions(df, site, sessions) if refused is None else refused
    spread = F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1)))
    marks = refused.select("tenant_id", "session_id", spread.alias("_share"), F.lit("store_rejected").alias("reason"))
    keys = ["tenant_id", "session_id"]
    rows = df.filter(" AND ".join(f"{name} IS NOT NULL" for name in [*keys, "ts"]))
    rows = rows.withColumn("_share", F.pmod(F.hash("event_id"), F.lit(SPREAD)))
    return rows.join(marks, [*keys, "_share"], "left").select(*df.columns, "reason")


def ingest_report(validated: DataFrame) -> DataFrame:
    """Accepted, dropped and rejected events and bodies of validated batches.

    Wants `rejection`, `dropped_unknown_type`, `dropped_out_of_window` and `batch` (the kept events). One pass; the
    counts are folded per task before anything is shuffled.
    """
    taken = F.col("rejection").isNull()
    totals = validated.agg(
        F.sum(F.when(taken, F.size("batch.events"))).alias("accepted"),
        F.sum(F.when(taken, F.col("dropped_unknown_type"))).alias("unknown_type"),
        F.sum(F.when(taken, F.col("dropped_out_of_window"))).alias("ts_out_of_window"),
        F.count_if(F.col("rejection") == "invalid").alias("invalid"),
        F.count_if(F.col("rejection") == "too_large").alias("too_large"),
    )
    rows = [
        ("accepted", "", "accepted"),
        ("dropped", "unknown_type", "unknown_type"),
        ("dropped", "ts_out_of_window", "ts_out_of_window"),
        ("rejected", "invalid", "invalid"),
        ("rejected", "too_large", "too_large"),
    ]
    entries = F.array(
        *[
            F.struct(
                F.lit(outcome).alias("outcome"),
                F.lit(reason).alias("reason"),
                F.coalesce(F.col(column), F.lit(0)).cast("bigint").alias("n"),
            )
            for outcome, reason, column in rows
        ]
    )
    return totals.select(F.inline(entries))


def dead_letter_report(dead_letters: DataFrame) -> DataFrame:
    return dead_letters.groupBy("topic", "reason").agg(F.count("*").alias("n"))


def rate_exceedance(
    requests: DataFrame, limit: int = S.RATE_PER_SECOND, window_ms: int = 1000, key: str = "key_hash", ts: str = "ts"
) -> DataFrame:
    """Keys and time windows with more requests than the limit."""
    start = F.floor(F.unix_millis(F.col(ts)) / window_ms) * window_ms
    counts = requests.groupBy(F.col(key), start.alias("window_start_ms")).agg(F.count("*").alias("n"))
    return counts.filter(F.col("n") > limit)


PERIODS = 4096  # periods of a rate that are looked at as one list


def _change(shift: Column, low: Column, high: Column, at: Column) -> Column:
    """What happens to a level: `shift` is added, then it is kept between `low` and `high`. `at` is where time stands."""
    parts = {"shift": shift, "low": low, "high": high, "at": at}
    return F.struct(*[F.coalesce(value.cast("bigint"), F.lit(0).cast("bigint")).alias(name) for name, value in parts.items()])


def _level(change: Column, before: Column) -> Column:
    return F.least(change["high"], F.greatest(change["low"], before + change["shift"]))


def rate_audit(
    requests: DataFrame,
    burst: int = S.RATE_BURST,
    refill: int = S.RATE_PER_SECOND,
    period_ms: int = 1000,
    key: str = "key_hash",
    ts: str = "ts",
) -> DataFrame:
    """Periods in which a token bucket would have refused requests of a key: `n` requests, `accepted` and `refused`.

    A bucket holds `burst` tokens and starts full. It gets `refill` tokens in each period, one at a time at equal steps of
    the clock, and loses one for each request it accepts; a request that finds it empty is refused and costs nothing.

    What a stretch of time does to a bucket's level is to add a number and then keep the result between a floor and a
    ceiling, and so do two stretches together. So each period of a key is three numbers, made where its requests are; a
    run of periods is three numbers again; and the runs of a key, one line each, give every run the level it begins with.
    A hot key is spread over its periods and runs, and no list is longer than a run (`PERIODS`) or the runs of one key.
    """
    cap, none = F.lit(burst), F.lit(0)

    def wait(change: Column, tokens: Column, at: Column) -> Column:
        return _change(change["shift"] + tokens, F.least(cap, change["low"] + tokens), F.least(cap, change["high"] + tokens), at)

    def take(change: Column, n: Column) -> Column:
        low, high = (F.greatest(none, change[name] - n) for name in ("low", "high"))
        return _change(change["shift"] - n, low, high, change["at"])

    def follow(first: Column, then: Column, at: Column) -> Column:
        return _change(first["shift"] + then["shift"], _level(then, first["low"]), _level(then, first["high"]), at)

    # Periods: how many requests at which token step, and what that does to the level.
    step = F.floor(F.unix_millis(F.col(ts)) * refill / period_ms)
    steps = requests.groupBy(F.col(key), step.alias("step")).agg(F.count("*").alias("n"))
    period = F.floor(F.col("step") / refill)
    periods = steps.groupBy(key, period.alias("period")).agg(F.array_sort(F.collect_list(F.struct("step", "n"))).alias("steps"))
    start = F.col("period") * refill
    change = F.aggregate(
        "steps",
        _change(none, none, cap, start),
        lambda state, one: take(wait(state, one["step"] - state["at"], one["step"]), one["n"]),
        lambda state: wait(state, start + refill - state["at"], start + refill),
    )
    # Runs of periods, and the level each begins with.
    run = F.floor(F.col("period") / PERIODS)
    of_run = F.struct("period", "change", "steps")
    runs = periods.withColumn("change", change).groupBy(key, run.alias("run")).agg(F.array_sort(F.collect_list(of_run)).alias("periods"))
    begin = F.col("run") * PERIODS
    change = F.aggregate(
        "periods",
        _change(none, none, cap, begin),
        lambda state, one: follow(wait(state, (one["period"] - state["at"]) * refill, none), one["change"], one["period"] + 1),
        lambda state: wait(state, (begin + PERIODS - state["at"]) * refill, none),
    )
    runs = runs.withColumn("change", change)
    lines = runs.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("run", "change"))).alias("runs"))
    numbers = F.transform("runs", lambda one: one["run"])
    levels = _levels("runs", "run", burst, PERIODS * refill)
    begun = lines.select(key, F.explode(F.arrays_zip(numbers.alias("run"), levels.alias("level"))).alias("b")).select(key, "b.run", "b.level")
    # The same inside each run, then inside each period.
    opened = runs.drop("change").join(begun, [key, "run"])
    levels = _levels("periods", "period", burst, refill, F.col("level"), begin)
    inside = opened.select(key, F.explode(F.arrays_zip(F.col("periods").alias("one"), levels.alias("level"))).alias("p"))
    total = F.aggregate("steps", F.lit(0).cast("bigint"), lambda n, one: n + one["n"])
    inside = inside.select(key, "p.one.period", "p.one.steps", "p.level").withColumn("n", total)
    first = F.struct("level", F.lit(0).cast("bigint").alias("accepted"), (F.col("period") * refill).alias("at"))

    def serve(state: Column, one: Column) -> Column:
        there = F.least(F.lit(burst).cast("bigint"), state["level"] + one["step"] - state["at"])
        taken = F.least(one["n"], there)
        return F.struct((there - taken).alias("level"), (state["accepted"] + taken).alias("accepted"), one["step"].alias("at"))

    accepted = F.aggregate("steps", first, serve, lambda state: state["accepted"])
    judged = inside.withColumn("accepted", accepted).filter("n > accepted")
    return judged.select(key, (F.col("period") * period_ms).alias("window_start_ms"), "n", "accepted", (F.col("n") - F.col("accepted")).alias("refused"))


def _levels(list_: str, number: str, burst: int, width: int, level: Column | None = None, at: Column | None = None) -> Column:
    """The level at the beginning of each stretch of a list, in order; between stretches that are not there it only fills."""
    full = F.lit(burst).cast("bigint")
    at = F.element_at(list_, 1)[number] if at is None else at
    none = F.array().cast("array<bigint>")
    first = F.struct((full if level is None else level).alias("level"), at.cast("bigint").alias("at"), none.alias("out"))

    def go(state: Column, one: Column) -> Column:
        here = F.least(full, state["level"] + (one[number] - state["at"]) * width)
        after = _level(one["change"], here)
        return F.struct(after.alias("level"), (one[number] + 1).alias("at"), F.concat(state["out"], F.array(here)).alias("out"))

    return F.aggregate(list_, first, go, lambda state: state["out"])
