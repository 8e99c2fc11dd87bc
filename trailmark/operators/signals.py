"""Frustration signals of sessions."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trailmark import schemas as S
from trailmark.functions.times import HOUR_MS
from trailmark.operators.slices import SLICE, with_neighbours, with_previous

SESSION_KEYS = ["tenant_id", "session_id"]
IS_CLICK = "event_type = 'CLICK'"


def rage_clicks(events: DataFrame, n: int = 3, within_ms: int = 1000, width_ms: int = HOUR_MS) -> DataFrame:
    """Clicks that are at least the n-th on the same element within `within_ms`."""
    clicks = events.filter(IS_CLICK)
    keys = [*SESSION_KEYS, "target_selector"]
    counted = with_neighbours(clicks, keys, {"clicks": F.count("*")}, within_ms, 0, width_ms=width_ms)
    return counted.filter(F.col("clicks") >= n)


def error_clicks(events: DataFrame, within_ms: int = 1000, width_ms: int = HOUR_MS) -> DataFrame:
    """Clicks with an error at most `within_ms` later; `error_ts` is the first such error."""
    relevant = events.filter(F.expr(IS_CLICK) | F.col("event_type").isin(S.ERROR_TYPES))
    first_error = F.min(F.when(F.col("event_type").isin(S.ERROR_TYPES), F.col("ts")))
    marked = with_neighbours(relevant, SESSION_KEYS, {"error_ts": first_error}, 0, within_ms, width_ms=width_ms)
    return marked.filter(F.expr(IS_CLICK) & F.col("error_ts").isNotNull())


def dead_clicks(events: DataFrame, within_ms: int = 1000, width_ms: int = HOUR_MS) -> DataFrame:
    """Clicks without a navigation or page mutation within `within_ms` after them.

    A mutation is a row of type `MUTATION`, which callers may add from replay events.
    """
    effects = ["NAVIGATION", "MUTATION"]
    relevant = events.filter(F.expr(IS_CLICK) | F.col("event_type").isin(effects))
    count = F.count_if(F.col("event_type").isin(effects))
    marked = with_neighbours(relevant, SESSION_KEYS, {"_effects": count}, 0, within_ms, width_ms=width_ms)
    return marked.filter(F.expr(IS_CLICK) & (F.col("_effects") == 0)).drop("_effects")


def error_bursts(events: DataFrame, n: int = 5, within_ms: int = 10_000, width_ms: int = HOUR_MS) -> DataFrame:
    """Errors that are at least the n-th of their session within `within_ms`."""
    errors = events.filter(F.col("event_type").isin(S.ERROR_TYPES))
    counted = with_neighbours(errors, SESSION_KEYS, {"errors": F.count("*")}, within_ms, 0, width_ms=width_ms)
    return counted.filter(F.col("errors") >= n)


def page_stays(events: DataFrame, width_ms: int = HOUR_MS) -> DataFrame:
    """Every navigation with the time until the next one of its session (`dwell_ms`, null for the last)."""
    views = events.filter("event_type = 'NAVIGATION'")
    marked = with_previous(views, SESSION_KEYS, ["ts", "event_id"], ["event_id", "ts", "path"], width_ms)
    ended = marked.filter("prev_event_id IS NOT NULL").select(
        *SESSION_KEYS,
        F.col("prev_path").alias("path"),
        F.col("prev_ts").alias("entered_at"),
        (F.unix_millis("ts") - F.unix_millis("prev_ts")).alias("dwell_ms"),
    )
    return ended


def stuck_pages(events: DataFrame, min_stay_ms: int, min_repeats: int) -> DataFrame:
    """Pages of a session with a long total stay and an element clicked again and again."""
    stays = page_stays(events).groupBy(*SESSION_KEYS, "path").agg(F.sum("dwell_ms").alias("stay_ms"))
    repeats = (
        events.filter(IS_CLICK)
        .groupBy(*SESSION_KEYS, "path", "target_selector")
        .agg(F.count("*").alias("repeats"))
        .filter(F.col("repeats") >= min_repeats)
    )
    return stays.filter(F.col("stay_ms") >= min_stay_ms).join(repeats, [*SESSION_KEYS, "path"])


SIGNALS = ["rage_click", "dead_click", "error_click", "error_burst"]


def mark_signals(
    events: DataFrame,
    rage_n: int = 3,
    within_ms: int = 1000,
    burst_n: int = 5,
    burst_ms: int = 10_000,
    width_ms: int = HOUR_MS,
    rage_ms: int | None = None,
) -> DataFrame:
    """Every event with a flag for each signal (`SIGNALS`) it is, by the rules of the functions above.

    Rows are copied into the slices their time reaches once, for the widest reach, and all frames are taken over that one
    shuffle: those of a session and those of an element in it.
    """
    is_error = F.col("event_type").isin(S.ERROR_TYPES)
    is_click, is_effect = F.expr(IS_CLICK), F.col("event_type").isin("NAVIGATION", "MUTATION")
    ms = F.unix_millis("ts")
    rage_ms = within_ms if rage_ms is None else rage_ms
    before, after = max(rage_ms, burst_ms), within_ms
    width_ms = max(width_ms, before, after)
    reached = F.sequence(F.floor((ms - after) / width_ms), F.floor((ms + before) / width_ms))
    copies = events.withColumn("_ms", ms).withColumn(SLICE, F.explode(reached))
    # Elements of clicks only: other rows share one empty element and must not make a group of their own.
    element = F.when(is_click, F.col("target_selector"))
    of_session = Window.partitionBy(*SESSION_KEYS, SLICE).orderBy("_ms")
    of_element = Window.partitionBy(*SESSION_KEYS, SLICE, "_element").orderBy("_ms")
    marked = copies.withColumn("_element", element).withColumns(
        {
            "_errors": F.count_if(is_error).over(of_session.rangeBetween(-burst_ms, 0)),
            "_error_after": F.count_if(is_error).over(of_session.rangeBetween(0, within_ms)),
            "_effect_after": F.count_if(is_effect).over(of_session.rangeBetween(0, within_ms)),
            "_clicks": F.count_if(is_click).over(of_element.rangeBetween(-rage_ms, 0)),
        }
    )
    flags = {
        "rage_click": is_click & (F.col("_clicks") >= rage_n),
        "dead_click": is_click & (F.col("_effect_after") == 0),
        "error_click": is_click & (F.col("_error_after") > 0),
        "error_burst": is_error & (F.col("_errors") >= burst_n),
    }
    own = marked.filter(F.col(SLICE) == F.floor(F.col("_ms") / width_ms)).withColumns(flags)
    return own.drop(SLICE, "_ms", "_element", "_errors", "_error_after", "_effect_after", "_clicks")


def signal_counts(
    events: DataFrame,
    rage_n: int = 3,
    within_ms: int = 1000,
    burst_n: int = 5,
    burst_ms: int = 10_000,
    width_ms: int = HOUR_MS,
    rage_ms: int | None = None,
) -> DataFrame:
    """Signals per session: rage, dead and error clicks, bursts and errors, zero where there are none."""
    needed = events.select(*SESSION_KEYS, "ts", "event_type", "target_selector")
    marked = mark_signals(needed, rage_n, within_ms, burst_n, burst_ms, width_ms, rage_ms)
    flags = {**{name: F.col(name) for name in SIGNALS}, "error": F.col("event_type").isin(S.ERROR_TYPES)}
    return marked.groupBy(*SESSION_KEYS).agg(*[F.count_if(flag).alias(f"{name}_count") for name, flag in flags.items()])


# Our weights of the friction score; the sum of weight * count is cut at 100.
FRICTION_WEIGHTS = {"rage_click": 20, "dead_click": 5, "error_click": 15, "error_burst": 10, "error": 4}


def friction_scores(signals: DataFrame, sites: DataFrame | None = None, weights: dict[str, int] | None = None) -> DataFrame:
    """Adds `friction_score` from 0 to 100.

    A site may set a threshold per signal in `signal_thresholds`; smaller counts of that signal then score nothing.
    """
    weights = weights or FRICTION_WEIGHTS
    if sites is not None:
        thresholds = sites.select(F.col("id").alias("site_id"), "signal_thresholds")
        signals = signals.join(thresholds, "site_id", "left")
    total = F.lit(0)
    for name, weight in weights.items():
        count = F.col(f"{name}_count")
        if sites is not None:
            needed = F.coalesce(F.try_element_at("signal_thresholds", F.lit(name)), F.lit(0.0))
            count = F.when(count >= needed, count).otherwise(F.lit(0))
        total = total + count * weight
    scored = signals.withColumn("friction_score", F.least(F.lit(100), total).cast("int"))
    return scored.drop("signal_thresholds") if sites is not None else scored


def gate_sessions(scores: DataFrame, threshold: int, max_share: float = 0.05) -> DataFrame:
    """Sessions to analyse: those with the highest scores at or above the threshold, at most `max_share` of all.

    Sessions of equal score go by a digest of tenant and session, so a score that many share passes in part. The cut is
    found in a histogram of scores (at most 101 values), and in the score it falls into, in a histogram of the first
    digits of the digest; only the few sessions with the same digits are ranked one by one.
    """
    digest = F.md5(F.concat_ws("/", *SESSION_KEYS))
    rows = scores.withColumn("_digest", digest).withColumn("_digits", F.substring("_digest", 1, 3))
    cells = rows.groupBy("friction_score", "_digits").agg(F.count("*").alias("_n"))  # 101 * 4096 rows at most
    by_score = cells.groupBy("friction_score").agg(F.sum("_n").alias("_n"))
    downwards = Window.orderBy(F.desc("friction_score")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    room = F.floor(F.sum("_n").over(Window.partitionBy()) * F.lit(max_share)) - F.sum("_n").over(downwards) + F.col("_n")
    by_score = by_score.select("friction_score", room.alias("_room")).filter((F.col("_room") > 0) & (F.col("friction_score") >= threshold))
    within = Window.partitionBy("friction_score").orderBy("_digits").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cells = cells.join(by_score, "friction_score")
    cells = cells.withColumn("_left", F.col("_room") - F.sum("_n").over(within) + F.col("_n")).filter("_left > 0")
    joined = rows.join(cells.select("friction_score", "_digits", "_n", "_left"), ["friction_score", "_digits"])
    whole = joined.filter("_n <= _left")
    rank = F.row_number().over(Window.partitionBy("friction_score", "_digits").orderBy("_digest", *SESSION_KEYS))
    part = joined.filter("_n > _left").withColumn("_rank", rank).filter("_rank <= _left").drop("_rank")
    return whole.unionByName(part).select(*scores.columns)
