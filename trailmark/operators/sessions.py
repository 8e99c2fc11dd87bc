"""Sessions: cutting visits, merging updates, counters, closing idle sessions."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trailmark import schemas as S
from trailmark.functions import web as W
from trailmark.functions.json import prop
from trailmark.functions.times import HOUR_MS
from trailmark.operators.slices import SLICE, sliced
from trailmark.operators.tables import changes, for_tenant, ordered_rows

SESSION_KEYS = ["tenant_id", "session_id"]
ORDER = ["ts", "event_id"]


def sessionize(
    events: DataFrame, keys: Sequence[str], gap_ms: int = S.SESSION_IDLE_MS, width_ms: int = HOUR_MS
) -> DataFrame:
    """Adds `session_no`, counting the visits of each key. A gap longer than `gap_ms` starts a new visit.

    Gaps inside a time slice are found there; each slice then passes its first and last time and its number of visits
    on, so a key is never ordered as a whole.
    """
    keys = list(keys)
    gap = F.unix_millis("ts") - F.unix_millis(F.lag("ts").over(Window.partitionBy(*keys, SLICE).orderBy(*ORDER)))
    rows = sliced(events, "ts", width_ms).withColumn("_new", F.coalesce((gap > gap_ms).cast("long"), F.lit(0)))
    inside = Window.partitionBy(*keys, SLICE).orderBy(*ORDER).rowsBetween(Window.unboundedPreceding, 0)
    summary = rows.groupBy(*keys, SLICE).agg(
        F.min("ts").alias("_head"), F.max("ts").alias("_tail"), F.sum("_new").alias("_inner")
    )
    along = Window.partitionBy(*keys).orderBy(SLICE)
    pause = F.unix_millis("_head") - F.unix_millis(F.lag("_tail").over(along))
    opened = F.when(pause <= gap_ms, F.lit(0)).otherwise(F.lit(1))
    upto = along.rowsBetween(Window.unboundedPreceding, 0)
    base = (
        summary.withColumn("_opens", opened)
        .withColumn("_base", F.sum(F.col("_opens") + F.col("_inner")).over(upto) - F.col("_inner"))
        .select(*keys, SLICE, "_base")
    )
    numbered = rows.withColumn("_local", F.sum("_new").over(inside)).join(base, [*keys, SLICE])
    return numbered.withColumn("session_no", F.col("_base") + F.col("_local")).drop(SLICE, "_new", "_local", "_base")


def session_updates(events: DataFrame) -> DataFrame:
    """What a set of events says about each session and visitor: only minima, maxima and first-known values.

    "First" is the earliest by `(ingested_at, event_id)`, the entry page the earliest navigation by `(ts, event_id)`.
    """
    user_agent = F.col("user_agent") if "user_agent" in events.columns else F.lit(None).cast("string")
    navigation = (F.col("event_type") == "NAVIGATION") & F.col("url").isNotNull() & (F.col("url") != "")
    arrival = F.struct("ingested_at", "event_id")
    grouped = events.groupBy(*SESSION_KEYS).agg(
        F.min(F.struct("ingested_at", "event_id", "site_id", "anonymous_id")).alias("_first"),
        F.min("ts").alias("first_ts"),
        F.max("ts").alias("last_ts"),
        F.max("ingested_at").alias("last_received"),
        F.min(F.when(navigation, F.struct("ts", "event_id", "url"))).alias("_entry"),
        F.min_by(user_agent, F.when(F.trim(user_agent) != "", arrival)).alias("_ua"),
    )
    return grouped.select(
        F.col("session_id").alias("id"),
        "tenant_id",
        F.col("_first.site_id").alias("site_id"),
        F.col("_first.anonymous_id").alias("anonymous_id"),
        "first_ts",
        "last_ts",
        "last_received",
        F.col("_entry.ts").alias("entry_at"),
        F.col("_entry.url").alias("entry_url"),
        W.platform_of(F.col("_ua")).alias("platform"),
        W.browser_of(F.col("_ua")).alias("browser"),
    )


def end_user_updates(updates: DataFrame) -> DataFrame:
    """First and last sight of each visitor; sessions without an anonymous id have none."""
    named = updates.filter(F.trim("anonymous_id") != "")
    return named.groupBy("tenant_id", "site_id", "anonymous_id").agg(
        F.min("first_ts").alias("first_seen_at"), F.max("last_ts").alias("last_seen_at")
    )


def upsert_end_users(current: DataFrame, updates: DataFrame) -> DataFrame:
    """Visitors after the updates; `version` rises only where first or last sight moved."""
    keys = ["site_id", "anonymous_id"]
    old, new = current.alias("o"), updates.alias("n")
    exists = F.col("o.version").isNotNull()
    moved = (F.col("n.first_seen_at") < F.col("o.first_seen_at")) | (F.col("n.last_seen_at") > F.col("o.last_seen_at"))
    version = F.when(~exists, F.lit(0)).otherwise(F.col("o.version") + F.coalesce(moved, F.lit(False)).cast("int"))
    return old.join(new, keys, "full_outer").select(
        F.coalesce("o.tenant_id", "n.tenant_id").alias("tenant_id"),
        *keys,
        F.least("o.first_seen_at", "n.first_seen_at").alias("first_seen_at"),
        F.greatest("o.last_seen_at", "n.last_seen_at").alias("last_seen_at"),
        version.cast("bigint").alias("version"),
    )


def end_user_id(site_id: Column, anonymous_id: Column) -> Column:
    """A stable id for a visitor, derived from what identifies it."""
    digest = F.md5(F.concat_ws("/", site_id, anonymous_id))
    parts = [F.substring(digest, start, length) for start, length in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat_ws("-", *parts)


def attach_end_users(sessions: DataFrame, end_users: DataFrame) -> DataFrame:
    """Fills `end_user_id` from the visitor with the same site and anonymous id; blank ids find nobody."""
    known = end_users.select(
        "site_id", "anonymous_id", end_user_id(F.col("site_id"), F.col("anonymous_id")).alias("_user")
    ).filter(F.trim("anonymous_id") != "")
    named = F.trim("anonymous_id") != ""
    joined = sessions.filter(named).join(known, ["site_id", "anonymous_id"], "left")
    attached = joined.withColumn("end_user_id", F.coalesce("end_user_id", "_user")).select(*sessions.columns)
    # sessions without an anonymous id share one key and find nobody, so they do not take part in the join
    return attached.unionByName(sessions.filter(~F.coalesce(named, F.lit(False))))


def fold_updates(updates: DataFrame) -> DataFrame:
    """Several updates of the same sessions as one. Any order and any repetition give the same."""
    first = F.min(F.struct("last_received", "site_id", "anonymous_id"))

    def earliest(column: str) -> Column:
        return F.min_by(column, F.when(F.col(column).isNotNull(), F.struct("last_received", "first_ts")))

    # The day a session is kept under is the same in all its updates.
    home = ["home_day"] if "home_day" in updates.columns else []
    folded = updates.groupBy("tenant_id", "id").agg(
        *[F.min(name).alias(name) for name in home],
        first.alias("_first"),
        F.min("first_ts").alias("first_ts"),
        F.max("last_ts").alias("last_ts"),
        F.max("last_received").alias("last_received"),
        F.min(F.when(F.col("entry_at").isNotNull(), F.struct("entry_at", "entry_url"))).alias("_entry"),
        earliest("platform").alias("platform"),
        earliest("browser").alias("browser"),
    )
    return folded.select(
        "id",
        "tenant_id",
        "_first.site_id",
        "_first.anonymous_id",
        "first_ts",
        "last_ts",
        "last_received",
        F.col("_entry.entry_at").alias("entry_at"),
        F.col("_entry.entry_url").alias("entry_url"),
        "platform",
        "browser",
        *home,
    )


def owned(current: DataFrame, updates: DataFrame) -> DataFrame:
    """The updates of the tenant that owns the session, so at most one for each session id."""
    firsts = updates.groupBy("id").agg(F.min(F.struct("last_received", "tenant_id")).getField("tenant_id").alias("_first"))
    held = current.select("id", F.col("tenant_id").alias("_held"))
    owners = firsts.join(held, "id", "left").select("id", F.coalesce("_held", "_first").alias("tenant_id"))
    return updates.join(owners, ["id", "tenant_id"])


def upsert_sessions(current: DataFrame, updates: DataFrame) -> DataFrame:
    """Session rows after the updates (one per session, see `fold_updates`).

    Times only widen, unknown values are filled, an earlier entry page wins. A closed session that changes is extended
    and flagged for recomputation. A row that would not change keeps its version, so applying an update twice is the
    same as once. A session id has one owner: the tenant that holds it, else the one received first. Updates of other
    tenants are ignored; `reject_unknown_refs` reports those.
    """
    old, new = current.alias("o"), owned(current, updates).alias("n")
    home = ["home_day"] if "home_day" in current.columns and "home_day" in updates.columns else []
    known = F.col("o.id").isNotNull()
    same = F.col("n.id").isNotNull()
    user = F.when(
        F.trim("n.anonymous_id") != "", end_user_id(F.col("n.site_id"), F.col("n.anonymous_id"))
    )
    earlier_entry = F.col("n.entry_at").isNotNull() & (
        F.col("o.entry_at").isNull() | (F.col("n.entry_at") < F.col("o.entry_at"))
    )

    def fills(column: str, value: Column) -> Column:
        return F.col(f"o.{column}").isNull() & value.isNotNull()

    changed = (
        known
        & same
        & (
            F.coalesce(F.col("n.first_ts") < F.col("o.started_at"), F.lit(False))
            | F.coalesce(F.col("n.last_received") > F.col("o.last_active_at"), F.lit(False))
            | earlier_entry
            | fills("platform", F.col("n.platform"))
            | fills("browser", F.col("n.browser"))
            | fills("end_user_id", user)
        )
    )
    late = changed & F.col("o.ended_at").isNotNull()

    def merged(column: str, fresh: Column, otherwise: Column) -> Column:
        return F.when(changed | ~known, fresh).otherwise(otherwise).alias(column)

    return (
        old.join(new, F.col("o.id") == F.col("n.id"), "full_outer")
        .filter(known | same)
        .select(
            F.coalesce("o.id", "n.id").alias("id"),
            F.coalesce("o.tenant_id", "n.tenant_id").alias("tenant_id"),
            F.coalesce("o.site_id", "n.site_id").alias("site_id"),
            merged("end_user_id", F.coalesce(F.col("o.end_user_id"), user), F.col("o.end_user_id")),
            F.when(known, F.col("o.anonymous_id")).otherwise(F.coalesce("n.anonymous_id", F.lit(""))).alias("anonymous_id"),
            merged("started_at", F.least("o.started_at", "n.first_ts"), F.col("o.started_at")),
            merged("last_active_at", F.greatest("o.last_active_at", "n.last_received"), F.col("o.last_active_at")),
            F.when(late, F.greatest("o.ended_at", "n.last_ts")).otherwise(F.col("o.ended_at")).alias("ended_at"),
            F.col("o.duration_ms").alias("duration_ms"),
            F.coalesce("o.page_count", F.lit(0)).cast("bigint").alias("page_count"),
            F.coalesce("o.error_count", F.lit(0)).cast("bigint").alias("error_count"),
            merged("platform", F.coalesce("o.platform", "n.platform"), F.col("o.platform")),
            merged("browser", F.coalesce("o.browser", "n.browser"), F.col("o.browser")),
            F.when(earlier_entry & same, F.col("n.entry_url")).otherwise(F.col("o.entry_url")).alias("entry_url"),
            F.when(earlier_entry & same, F.col("n.entry_at")).otherwise(F.col("o.entry_at")).alias("entry_at"),
            (F.coalesce("o.needs_recompute", F.lit(False)) | late).alias("needs_recompute"),
            F.when(known, F.col("o.version") + changed.cast("int")).otherwise(F.lit(0)).cast("bigint").alias("version"),
            *[F.coalesce(f"o.{name}", f"n.{name}").alias(name) for name in home],
        )
    )


def distinct_navigations(events: DataFrame, width_ms: int = HOUR_MS) -> DataFrame:
    """Navigations whose full URL differs from the navigation before."""
    return changes(events.filter("event_type = 'NAVIGATION'"), SESSION_KEYS, ORDER, "url", width_ms)


def navigation_trail(events: DataFrame, width_ms: int = HOUR_MS) -> DataFrame:
    """The ordered pages of each session as rows with a position."""
    counted = (F.col("event_type") == "NAVIGATION") & (prop(F.col("props"), "trigger") != "replaceState")
    rows = ordered_rows(events, SESSION_KEYS, ORDER, counted, "position", width_ms)
    return rows.select(*SESSION_KEYS, "position", W.cut_fragment(F.col("url")).alias("page"))


def session_stats(events: DataFrame, width_ms: int = HOUR_MS) -> DataFrame:
    """Counters of every session that has events: first and last time, duration, pages, errors.

    Wants de-duplicated events. A page is a navigation, `replaceState` aside, whose URL up to `#` differs from the one
    before. One row per (session, slice) carries the sums, the pages counted inside and the first and last page; the
    slices of a session are then compared with each other. Two shuffles, no join, and no session is one group.
    """
    counted = (F.col("event_type") == "NAVIGATION") & (prop(F.col("props"), "trigger") != "replaceState")
    inside = Window.partitionBy(*SESSION_KEYS, SLICE).orderBy(*ORDER)
    rows = sliced(
        events.select(
            *SESSION_KEYS,
            *ORDER,
            F.col("event_type").isin(S.ERROR_TYPES).alias("_error"),
            F.when(counted, W.cut_fragment(F.col("url"))).alias("_page"),
        ),
        "ts",
        width_ms,
    ).withColumn("_before", F.last("_page", True).over(inside.rowsBetween(Window.unboundedPreceding, -1)))
    visit = F.when(F.col("_page").isNotNull(), F.struct(*ORDER, "_page"))
    slices = rows.groupBy(*SESSION_KEYS, SLICE).agg(
        F.min("ts").alias("first_ts"),
        F.max("ts").alias("last_ts"),
        F.count_if("_error").alias("_errors"),
        F.count_if(F.col("_page") != F.col("_before")).alias("_inner"),
        F.min(visit).getField("_page").alias("_head"),
        F.max(visit).getField("_page").alias("_tail"),
    )
    along = Window.partitionBy(*SESSION_KEYS).orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
    opens = F.col("_head").isNotNull() & ~F.col("_head").eqNullSafe(F.last("_tail", True).over(along))
    totals = slices.withColumn("_pages", F.col("_inner") + opens.cast("int")).groupBy(*SESSION_KEYS).agg(
        F.min("first_ts").alias("first_ts"),
        F.max("last_ts").alias("last_ts"),
        F.sum("_pages").alias("page_count"),
        F.sum("_errors").alias("error_count"),
    )
    length = F.unix_millis("last_ts") - F.unix_millis("first_ts")
    return totals.select(
        *SESSION_KEYS,
        "first_ts",
        "last_ts",
        F.greatest(F.lit(0), length).cast("bigint").alias("duration_ms"),
        "page_count",
        "error_count",
    )


def cap_errors(events: DataFrame, n: int = S.MAX_ERRORS_PER_MINUTE, period_ms: int = 60_000) -> DataFrame:
    """At most the first `n` error events of a session per aligned period; everything else passes.

    The rank limit is applied inside every task before the shuffle, so a flood does not travel.
    """
    is_error = F.col("event_type").isin(S.ERROR_TYPES)
    period = F.floor(F.unix_millis("ts") / period_ms)
    order = Window.partitionBy(*SESSION_KEYS, "_period").orderBy(*ORDER)
    errors = events.filter(is_error).withColumn("_period", period).withColumn("_rank", F.row_number().over(order))
    return events.filter(~is_error).unionByName(errors.filter(F.col("_rank") <= n).drop("_period", "_rank"))


def claim_sessions(
    sessions: DataFrame, now: Column, idle_ms: int = S.SESSION_IDLE_MS, limit: int | None = None
) -> DataFrame:
    """Sessions to work on: open and idle for longer than `idle_ms` (`CLOSE`), or flagged (`RECOMPUTE`).

    All of them, unless a limit is asked for; those idle longest then come first.
    """
    idle = F.unix_millis("last_active_at") < F.unix_millis(now) - idle_ms
    due = (F.col("ended_at").isNull() & idle) | F.col("needs_recompute")
    kind = F.when(F.col("ended_at").isNull(), F.lit("CLOSE")).otherwise(F.lit("RECOMPUTE"))
    claims = sessions.filter(due).withColumn("kind", kind)
    return claims if limit is None else claims.orderBy("last_active_at", "id").limit(limit)


def join_stats(
    claims: DataFrame, stats: DataFrame, now: Column, idle_ms: int = S.SESSION_IDLE_MS
) -> DataFrame:
    """Claims with their counters and an `action`: `CLOSED`, `UPDATED` or `DEFERRED`.

    A claim without stored events is deferred until it has been idle for twice the timeout, then gets zero counters.
    """
    counters = stats.select(
        "tenant_id",
        F.col("session_id").alias("id"),
        "first_ts",
        "last_ts",
        F.col("duration_ms").alias("_duration"),
        F.col("page_count").alias("_pages"),
        F.col("error_count").alias("_errors"),
    )
    joined = claims.join(counters, ["tenant_id", "id"], "left")
    missing = F.col("first_ts").isNull()
    recent = F.unix_millis("last_active_at") > F.unix_millis(now) - 2 * idle_ms
    action = (
        F.when(F.col("kind") == "RECOMPUTE", F.lit("UPDATED"))
        .when(missing & recent, F.lit("DEFERRED"))
        .otherwise(F.lit("CLOSED"))
    )
    return joined.select(
        *claims.columns,
        action.alias("action"),
        missing.alias("without_events"),
        F.coalesce("first_ts", "started_at").alias("first_ts"),
        F.coalesce("last_ts", "started_at").alias("last_ts"),
        F.coalesce("_duration", F.lit(0)).cast("bigint").alias("new_duration_ms"),
        F.coalesce("_pages", F.lit(0)).cast("bigint").alias("new_page_count"),
        F.coalesce("_errors", F.lit(0)).cast("bigint").alias("new_error_count"),
    )


def decide_closings(
    sessions: DataFrame,
    events: DataFrame,
    now: Column,
    idle_ms: int = S.SESSION_IDLE_MS,
    limit: int | None = None,
    width_ms: int = HOUR_MS,
) -> DataFrame:
    """Claims joined with counters of their own events only; events of other sessions are dropped before any work."""
    claims = claim_sessions(sessions, now, idle_ms, limit)
    ids = claims.select("tenant_id", F.col("id").alias("session_id"))
    stats = session_stats(events.join(ids, SESSION_KEYS, "left_semi"), width_ms)
    return join_stats(claims, stats, now, idle_ms)


def apply_closings(sessions: DataFrame, decisions: DataFrame) -> DataFrame:
    done = decisions.filter("action <> 'DEFERRED'").select(
        "tenant_id", "id", "first_ts", "last_ts", "new_duration_ms", "new_page_count", "new_error_count"
    )
    joined = sessions.join(done, ["tenant_id", "id"], "left")
    closed = F.col("last_ts").isNotNull()

    def replaced(column: str, value: Column) -> Column:
        return F.when(closed, value).otherwise(F.col(column))

    return joined.withColumns(
        {
            "started_at": F.least("started_at", "first_ts"),
            "ended_at": replaced("ended_at", F.col("last_ts")),
            "duration_ms": replaced("duration_ms", F.col("new_duration_ms")),
            "page_count": replaced("page_count", F.col("new_page_count")),
            "error_count": replaced("error_count", F.col("new_error_count")),
            "needs_recompute": replaced("needs_recompute", F.lit(False)),
            "version": F.col("version") + closed.cast("int"),
        }
    ).select(*sessions.columns)


def lifecycle_records(decisions: DataFrame, now: Column) -> DataFrame:
    """What is published about the sessions just closed or updated."""
    return decisions.filter("action <> 'DEFERRED'").select(
        F.lit(S.SCHEMA_VERSION).alias("schemaVersion"),
        F.col("action").alias("type"),
        F.col("tenant_id").alias("tenantId"),
        F.col("site_id").alias("siteId"),
        F.col("id").alias("sessionId"),
        F.least("started_at", "first_ts").alias("startedAt"),
        F.col("last_ts").alias("endedAt"),
        F.col("new_duration_ms").alias("durationMs"),
        F.col("new_page_count").alias("pageCount"),
        F.col("new_error_count").alias("errorCount"),
        now.alias("publishedAt"),
    )


def close_sessions(
    sessions: DataFrame,
    events: DataFrame,
    now: Column,
    idle_ms: int = S.SESSION_IDLE_MS,
    limit: int | None = None,
    width_ms: int = HOUR_MS,
) -> tuple[DataFrame, DataFrame]:
    """All sessions after one closing pass, and the lifecycle records of that pass."""
    decisions = decide_closings(sessions, events, now, idle_ms, limit, width_ms)
    return apply_closings(sessions, decisions), lifecycle_records(decisions, now)


def link_sessions(sessions: DataFrame, identities: DataFrame) -> DataFrame:
    """Attaches the sessions of an identified visitor to the user; rows already attached to it keep their version.

    Of several identities of a visitor the latest by `identified_at` counts, if there is that column, else the greatest.
    Sessions without an anonymous id belong to nobody and do not take part in the join.
    """
    order = ["identified_at"] if "identified_at" in identities.columns else []
    who = identities.filter(F.trim("anonymous_id") != "").groupBy("site_id", "anonymous_id")
    who = who.agg(F.max(F.struct(*order, "end_user_id")).getField("end_user_id").alias("_user"))
    named = F.coalesce(F.trim("anonymous_id") != "", F.lit(False))
    joined = sessions.filter(named).join(who, ["site_id", "anonymous_id"], "left")
    joined = joined.unionByName(sessions.filter(~named), allowMissingColumns=True)
    moves = F.col("_user").isNotNull() & ~F.col("end_user_id").eqNullSafe(F.col("_user"))
    return joined.withColumns(
        {
            "end_user_id": F.when(moves, F.col("_user")).otherwise(F.col("end_user_id")),
            "version": F.col("version") + moves.cast("int"),
        }
    ).select(*sessions.columns)


def list_sessions(
    sessions: DataFrame,
    tenant_id: str | None,
    *,
    started_from: Column | None = None,
    started_to: Column | None = None,
    url_contains: str | None = None,
    has_error: bool | None = None,
    min_duration_ms: int | None = None,
    max_duration_ms: int | None = None,
    is_open: bool | None = None,
    after: tuple[Column, str] | None = None,
    limit: int | None = 50,
) -> DataFrame:
    """One page of a tenant's sessions, newest first; `after` is `(started_at, id)` of the last row of the page before."""
    sessions, tests = for_tenant(sessions, tenant_id), []
    if started_from is not None:
        tests.append(F.col("started_at") >= started_from)
    if started_to is not None:
        tests.append(F.col("started_at") < started_to)
    if url_contains is not None:
        tests.append(F.col("entry_url").contains(url_contains))
    if has_error is not None:
        tests.append((F.col("error_count") > 0) == F.lit(has_error))
    if min_duration_ms is not None:
        tests.append(F.col("duration_ms") >= min_duration_ms)
    if max_duration_ms is not None:
        tests.append(F.col("duration_ms") <= max_duration_ms)
    if is_open is not None:
        tests.append(F.col("ended_at").isNull() == F.lit(is_open))
    if after is not None:
        started, last_id = after
        tests.append((F.col("started_at") < started) | ((F.col("started_at") == started) & (F.col("id") > last_id)))
    for test in tests:
        sessions = sessions.filter(test)
    ordered = sessions.orderBy(F.desc("started_at"), "id")
    return ordered if limit is None else ordered.limit(limit)


def events_page(
    events: DataFrame, tenant_id: str, session_id: str, after: tuple[Column, str] | None = None, limit: int = 100
) -> DataFrame:
    """Events of one session behind a cursor `(ts, event_id)`, in order."""
    from trailmark.operators.tables import session_events

    page = session_events(events, tenant_id, session_id)
    if after is not None:
        ts, event_id = after
        page = page.filter((F.col("ts") > ts) | ((F.col("ts") == ts) & (F.col("event_id") > event_id)))
    return page.limit(limit)
