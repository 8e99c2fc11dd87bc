"""Product analytics on stored events, and reads on analysed sessions."""

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trailmark import schemas as S
from trailmark.functions import text as X
from trailmark.functions.times import DAY_MS, HOUR_MS
from trailmark.functions.vectors import cosine_distance_to
from trailmark.operators.slices import SLICE, sliced, with_key_value
from trailmark.operators.tables import for_tenant

SESSION_KEYS = ["tenant_id", "session_id"]


def nearest_insights(
    insights: DataFrame, query: Sequence[float], tenant_id: str, k: int, key: str = "id", embedding: str = "embedding"
) -> DataFrame:
    """The `k` insights of a tenant closest to a vector by cosine distance; insights without a vector do not count.

    Exact: one pass over the tenant's rows, and every task keeps only its own best `k`.
    """
    own = for_tenant(insights, tenant_id).filter(F.col(embedding).isNotNull())
    ranked = own.withColumn("distance", cosine_distance_to(F.col(embedding), list(query)))
    return ranked.filter("distance IS NOT NULL").orderBy("distance", key).limit(k)


def timeline(events: DataFrame, signals: Sequence[str] = (), width_ms: int = HOUR_MS) -> DataFrame:
    """Pages, clicks and errors of each session with their offset from its start.

    `signals` names flags that the events carry (`signals.mark_signals`); an event that is one has a row of that type more.
    """
    kinds = ["NAVIGATION", "CLICK", *S.ERROR_TYPES, "RAGE_CLICK", "DEAD_CLICK", "ERROR_CLICK"]
    marks = [F.when(F.col(name), F.lit(name.upper())) for name in signals]
    types = F.array_compact(F.array(F.when(F.col("event_type").isin(kinds), F.col("event_type")), *marks))
    rows = events.select(*SESSION_KEYS, "ts", "event_id", types.alias("_types"))
    begun = with_key_value(rows, SESSION_KEYS, "_start", F.min("ts"), F.min, width_ms=width_ms)
    offset = F.unix_millis("ts") - F.unix_millis("_start")
    return begun.select(*SESSION_KEYS, "event_id", F.explode("_types").alias("event_type"), offset.alias("offset_ms"))


def session_summaries(events: DataFrame, width_ms: int = HOUR_MS) -> DataFrame:
    """A compact, redacted account of each session, one line per page, kind of event and element.

    Each line has a count, the first and last offset from the start of the session, and one redacted text. A session
    of any length folds to as many lines as it has distinct steps, and no list of its events is built.
    """
    detail = F.coalesce(F.nullif("error_message", F.lit("")), F.nullif("target_text", F.lit("")), F.lit(""))
    lines = events.groupBy(*SESSION_KEYS, "path", "event_type", "target_selector").agg(
        F.count("*").alias("n"),
        F.min("ts").alias("_first"),
        F.max("ts").alias("_last"),
        F.min(F.struct("ts", "event_id", detail.alias("text"))).getField("text").alias("_text"),
    )
    joined = with_key_value(lines, SESSION_KEYS, "_start", F.min("_first"), F.min, "_first", width_ms)
    start = F.unix_millis("_start")
    return joined.select(
        *SESSION_KEYS,
        "path",
        "event_type",
        "target_selector",
        "n",
        (F.unix_millis("_first") - start).alias("first_offset_ms"),
        (F.unix_millis("_last") - start).alias("last_offset_ms"),
        X.redact_text(F.col("_text")).alias("text"),
    )


def apply_guardrails(sessions: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
    """Adds `guardrail_rule`, the first rule that holds, and forces `analysis_status` to `REVIEW_REQUIRED` there."""
    fired = F.coalesce(*[F.when(rule, F.lit(name)) for name, rule in rules.items()])
    return sessions.withColumn("guardrail_rule", fired).withColumn(
        "analysis_status",
        F.when(F.col("guardrail_rule").isNotNull(), F.lit("REVIEW_REQUIRED")).otherwise(F.col("analysis_status")),
    )


def signal_alerts(
    signals: DataFrame, window_ms: int, factor: float, baseline_windows: int = 7, by: Sequence[str] = ("path",)
) -> DataFrame:
    """Time windows in which a page has at least `factor` times its usual number of signals.

    Usual is the mean of the `baseline_windows` windows before, those without signals counted as zero; a window
    without any earlier window of its page has no baseline and raises no alert. Signals are counted per page and
    window first, so the ordered part sees one row per window.
    """
    by = list(by)
    number = F.floor(F.unix_millis("ts") / window_ms)
    counts = signals.groupBy(*by, number.alias("_w")).agg(F.count("*").alias("n"))
    before = Window.partitionBy(*by).orderBy("_w").rangeBetween(-baseline_windows, -1)
    since = Window.partitionBy(*by)
    spans = F.least(F.lit(baseline_windows), F.col("_w") - F.min("_w").over(since))
    scored = counts.withColumn("_spans", spans).withColumn(
        "baseline", F.when(F.col("_spans") > 0, F.coalesce(F.sum("n").over(before), F.lit(0)) / F.col("_spans"))
    )
    return scored.filter((F.col("baseline") > 0) & (F.col("n") >= F.col("baseline") * factor)).select(
        *by, (F.col("_w") * window_ms).alias("window_start_ms"), "n", "baseline"
    )


def funnel_progress(
    events: DataFrame, steps: Sequence[Column], within_ms: int | None = None, width_ms: int = HOUR_MS
) -> DataFrame:
    """When each session reached each step: `t1 ... tk`, null from the first step it missed.

    A step counts at the earliest matching event strictly after the step before it and, with `within_ms`, no later
    than that after the first.

    Events are read once and dealt by (session, slice). What a slice does is said by one chain of times for each step it may
    be entered at: the earliest match of that step, the earliest match of the next one after that, and so on. Chains are
    frames over one order of the slice. The slices of a session are then gone along, each continuing from the step
    reached before it. Two shuffles, and a hot session is spread over its slices.
    """
    k = len(steps)
    matches = [F.coalesce(step, F.lit(False)).alias(f"_m{i}") for i, step in enumerate(steps)]
    rows = sliced(events.select(*SESSION_KEYS, "ts", *matches), "ts", width_ms)
    rows = rows.filter(F.exists(F.array(*[f"_m{i}" for i in range(k)]), lambda hit: hit))
    rows = rows.withColumn("_at", F.unix_millis("ts")).withColumn("_back", -F.col("_at")).drop("ts")
    # Backwards in time a frame that begins with the slice grows row by row; equal times are not after each other.
    later = Window.partitionBy(*SESSION_KEYS, SLICE).orderBy("_back").rangeBetween(Window.unboundedPreceding, -1)

    def chain(step: int) -> Column:
        rest = [F.col(f"_next{step + 1}")] if step + 1 < k else []
        return F.when(F.col(f"_m{step}"), F.struct(F.col("_at").alias("t"), *[r.alias("rest") for r in rest]))

    for step in reversed(range(1, k)):
        rows = rows.withColumn(f"_next{step}", F.min(chain(step)).over(later))
    slices = rows.groupBy(*SESSION_KEYS, SLICE).agg(*[F.min(chain(step)).alias(f"_from{step}") for step in range(k)])

    def times(step: int) -> Column:
        """The chain entered at a step as a list of times."""
        path, out = F.col(f"_from{step}"), []
        for _ in range(step, k):
            out.append(path["t"])
            path = path["rest"] if len(out) < k - step else path
        return F.array_compact(F.array(*out))

    entered = F.array(*[times(step) for step in range(k)])
    along = slices.groupBy(*SESSION_KEYS).agg(F.array_sort(F.collect_list(F.struct(F.col(SLICE), entered.alias("entered")))).alias("_slices"))
    none = F.array().cast("array<bigint>")
    reached = F.aggregate("_slices", none, lambda done, part: F.concat(done, F.coalesce(F.get(part["entered"], F.size(done)), none)))
    along = along.withColumn("_reached", reached)
    if within_ms is not None:
        # The earliest match is beyond the limit only if all are; steps behind it are as late.
        along = along.withColumn("_reached", F.filter("_reached", lambda t: t <= F.get("_reached", F.lit(0)) + within_ms))
    found = along.filter(F.size("_reached") > 0)
    return found.select(*SESSION_KEYS, *[F.get("_reached", F.lit(i)).alias(f"t{i + 1}") for i in range(k)])


def funnel(
    events: DataFrame,
    steps: Sequence[Column],
    within_ms: int | None = None,
    names: Sequence[str] | None = None,
    width_ms: int = HOUR_MS,
) -> DataFrame:
    """Sessions per step, with conversion from the step before and drop-off after it."""
    names = list(names or [f"step {i}" for i in range(1, len(steps) + 1)])
    progress = funnel_progress(events, steps, within_ms, width_ms)
    counts = progress.agg(*[F.count(f"t{i}").alias(f"c{i}") for i in range(1, len(steps) + 1)])
    rows = []
    for i, name in enumerate(names, start=1):
        here = F.col(f"c{i}")
        previous = F.col(f"c{max(1, i - 1)}")
        rows.append(
            F.struct(
                F.lit(i).alias("step"),
                F.lit(name).alias("name"),
                here.alias("sessions"),
                F.round(F.when(previous > 0, here / previous).otherwise(F.lit(0.0)), 6).alias("conversion"),
                (here - F.col(f"c{i + 1}") if i < len(names) else F.lit(0).cast("bigint")).alias("dropped"),
            )
        )
    return counts.select(F.inline(F.array(*rows)))


def funnel_dropoffs(progress: DataFrame, step: int) -> DataFrame:
    """Sessions that reached `step` but not the next one."""
    return progress.filter(F.col(f"t{step}").isNotNull() & F.col(f"t{step + 1}").isNull()).select(*SESSION_KEYS)


def click_map(events: DataFrame) -> DataFrame:
    """Clicks per page and element, and their share of the page's clicks."""
    clicks = events.filter("event_type = 'CLICK'")
    cells = clicks.groupBy("path", "target_selector").agg(F.count("*").alias("clicks"))
    pages = cells.groupBy(F.col("path").alias("_path")).agg(F.sum("clicks").alias("_all"))
    joined = cells.join(pages, F.col("path").eqNullSafe(F.col("_path")))
    return joined.select("path", "target_selector", "clicks", F.round(F.col("clicks") / F.col("_all"), 6).alias("share"))


def network_issues(events: DataFrame, slow_ms: int) -> DataFrame:
    """Failed and slow network calls."""
    calls = events.filter("event_type = 'NETWORK'")
    failed = (F.col("http_status") >= 400) | (F.col("http_status") == 0)
    kind = F.when(failed, F.lit("failed")).when(F.col("http_duration_ms") > slow_ms, F.lit("slow"))
    return calls.withColumn("issue", kind).filter("issue IS NOT NULL")


def custom_events(events: DataFrame) -> DataFrame:
    """Occurrences and sessions per custom event name.

    Sessions are counted in two steps, so that no distinct set of session ids is held anywhere.
    """
    per_session = (
        events.filter("event_type = 'CUSTOM'").groupBy("event_name", *SESSION_KEYS).agg(F.count("*").alias("_n"))
    )
    return per_session.groupBy("event_name").agg(F.sum("_n").alias("n"), F.count("*").alias("sessions"))


def review_queue(sessions: DataFrame, tenant_id: str | None, now: Column, flagged_at: str = "flagged_at") -> DataFrame:
    """A tenant's sessions waiting for a reviewer, oldest first, with their age."""
    waiting = for_tenant(sessions, tenant_id).filter("analysis_status = 'REVIEW_REQUIRED'")
    age = F.unix_millis(now) - F.unix_millis(flagged_at)
    return waiting.withColumn("age_ms", age).orderBy(flagged_at, "id")


def review_throughput(review_events: DataFrame, tenant_id: str | None, period_ms: int = DAY_MS) -> DataFrame:
    """A tenant's human decisions per period and outcome."""
    decided = for_tenant(review_events, tenant_id).filter(F.col("to_status").isin("HUMAN_APPROVED", "HUMAN_REJECTED"))
    start = F.floor(F.unix_millis("created_at") / period_ms) * period_ms
    return decided.groupBy(start.alias("period_start_ms"), "to_status").agg(F.count("*").alias("n"))
