"""Replay chunks: manifest, continuity, integrity, payload lookup and re-chunking."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trailmark import schemas as S
from trailmark.functions import json as J
from trailmark.functions import web as W
from trailmark.functions.times import HOUR_MS
from trailmark.operators.once import with_once
from trailmark.operators.slices import with_previous, with_running_total
from trailmark.session import written

SESSION_KEYS = ["tenant_id", "session_id"]
RUN_KEYS = [*SESSION_KEYS, "run", "tick"]


def chunk_rows(good: DataFrame) -> DataFrame:
    """Good replay records (after `classify_replay`) as flat chunks with the raw `events` text."""
    e = F.col("envelope")
    return good.select(
        F.lower(e["tenantId"]).alias("tenant_id"),
        F.lower(e["siteId"]).alias("site_id"),
        F.lower(e["sessionId"]).alias("session_id"),
        F.coalesce(e["chunkSeq"], F.lit(0)).alias("chunk_seq"),
        F.col("received_at").alias("ingested_at"),
        e["events"].alias("events"),
    )


def chunk_manifest(chunks: DataFrame) -> DataFrame:
    """One manifest row per chunk, computed inside the row: counts, time range, full snapshot, size and key."""
    events = F.col("_events")
    times = F.transform(events, lambda e: e["timestamp"].cast("bigint"))
    return with_once(chunks, {"_events": J.replay_events(F.col("events"))}).select(
        "tenant_id",
        "site_id",
        "session_id",
        "chunk_seq",
        W.object_key(F.col("tenant_id"), F.col("session_id"), F.col("chunk_seq")).alias("object_key"),
        F.octet_length("events").cast("bigint").alias("payload_bytes"),
        F.size(events).alias("event_count"),
        F.timestamp_millis(F.array_min(times)).alias("first_ts"),
        F.timestamp_millis(F.array_max(times)).alias("last_ts"),
        F.exists(events, lambda e: e["type"].eqNullSafe(F.lit(S.REPLAY_FULL_SNAPSHOT))).alias("has_full_snapshot"),
        "ingested_at",
    )


def chunk_payloads(manifest: DataFrame, payloads: DataFrame) -> DataFrame:
    """Manifest rows with the payload stored under their key, null when there is none."""
    return manifest.join(payloads.select("object_key", "payload"), "object_key", "left")


def chunk_gaps(manifest: DataFrame) -> DataFrame:
    """Holes in the chunk numbers of each session, the missing start included.

    `chunk_seq` values are unique after de-duplication; each is compared with its predecessor inside its block of
    numbers or, at the start of a block, with the last of the block before.
    """
    keys = ["tenant_id", "session_id"]
    unique = manifest.select(*keys, "chunk_seq").distinct()
    position = F.timestamp_millis(F.col("chunk_seq").cast("bigint") * 1000)
    marked = with_previous(unique.withColumn("_at", position), keys, ["_at"], ["chunk_seq"])
    expected = F.coalesce(F.col("prev_chunk_seq") + 1, F.lit(0))
    return marked.filter(F.col("chunk_seq") > expected).select(
        *keys, expected.cast("bigint").alias("missing_from"), (F.col("chunk_seq") - 1).cast("bigint").alias("missing_to")
    )


def replay_integrity(manifest: DataFrame, payloads: DataFrame) -> DataFrame:
    """Manifest and payloads against each other, one `verdict` per key.

    `missing_payload`, `orphan_payload`, `count_mismatch`, `no_full_snapshot` (first chunk), or `ok`.
    """
    stored = payloads.select(
        "object_key", F.size(J.replay_events(F.col("payload"))).alias("_stored"), F.lit(True).alias("_has_payload")
    )
    listed = manifest.select("object_key", "chunk_seq", "event_count", "has_full_snapshot", F.lit(True).alias("_listed"))
    verdict = (
        F.when(F.col("_has_payload").isNull(), F.lit("missing_payload"))
        .when(F.col("_listed").isNull(), F.lit("orphan_payload"))
        .when(~F.col("event_count").eqNullSafe(F.col("_stored")), F.lit("count_mismatch"))
        .when((F.col("chunk_seq") == 0) & ~F.col("has_full_snapshot"), F.lit("no_full_snapshot"))
        .otherwise(F.lit("ok"))
    )
    return listed.join(stored, "object_key", "full_outer").select("object_key", verdict.alias("verdict"))


def key_differences(manifest: DataFrame, payloads: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Keys only in the manifest, and keys only among the payloads."""
    listed, stored = manifest.select("object_key"), payloads.select("object_key")
    return listed.exceptAll(stored), stored.exceptAll(listed)


def explode_replay(chunks: DataFrame) -> DataFrame:
    """Recorded events of chunks, one row each, in recording order, with their raw text."""
    raw = F.posexplode(F.from_json("events", "array<string>"))
    rows = chunks.select("tenant_id", "session_id", "chunk_seq", raw.alias("pos", "event"))
    head = F.from_json("event", "struct<type:int,timestamp:double>")
    return with_once(rows, {"_head": head}).select(
        "tenant_id",
        "session_id",
        "chunk_seq",
        "pos",
        F.col("_head.type").alias("type"),
        F.timestamp_millis(F.col("_head.timestamp").cast("bigint")).alias("ts"),
        "event",
    )


def chunk_starts(sized: DataFrame, max_bytes: int) -> DataFrame:
    """The offsets at which chunks begin, of rows (tenant_id, session_id, run, tick, start): `start` is an event's byte offset.

    A chunk that begins at an offset ends with the event that brings it to `max_bytes`, so the next one begins at the
    first event at or behind that distance. That is one pointer for each event, found inside cells of `max_bytes`: it leads
    into the next cell, or to the first event behind where that one has none. From the start of a run the pointers are
    followed by doubling them: each round adds the starts as far ahead as all the rounds before, so a run of n chunks
    takes log n rounds, and a run without a second chunk none.
    """
    run = RUN_KEYS
    nodes = sized.select(*run, "start").distinct().withColumn("cell", F.floor(F.col("start") / max_bytes))
    nodes = written(nodes, "nodes")
    axis = F.array(
        F.struct(F.col("cell").alias("of"), F.col("start").alias("x"), F.lit(True).alias("there")),
        F.struct((F.col("cell") + 1).alias("of"), (F.col("start") + max_bytes).alias("x"), F.lit(False).alias("there")),
    )
    dealt = nodes.select(*run, "start", "cell", F.inline(axis)).withColumn("back", -F.col("x"))
    ahead = Window.partitionBy(*run, "of").orderBy("back").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    near = dealt.withColumn("near", F.min(F.when(F.col("there"), F.col("x"))).over(ahead)).filter("NOT there")
    # The first event behind the next cell, for cells that hold none far enough ahead. A run has one line per cell.
    along = Window.partitionBy(*run).orderBy("cell")
    cells = nodes.groupBy(*run, "cell").agg(F.min("start").alias("first")).withColumns(
        {"c1": F.lead("cell").over(along), "f1": F.lead("first").over(along), "f2": F.lead("first", 2).over(along)}
    )
    beyond = F.when(F.col("c1") == F.col("cell") + 1, F.col("f2")).otherwise(F.col("f1"))
    cells = cells.select(*run, "cell", beyond.alias("beyond"))
    pointers = near.join(cells, [*run, "cell"]).select(*run, "start", F.coalesce("near", "beyond").alias("next"))
    pointers = written(pointers.filter("next IS NOT NULL"), "pointers")
    starts = nodes.filter("start = 0").select(*run, "start")
    while pointers.take(1):
        found = starts.join(pointers, [*run, "start"]).select(*run, F.col("next").alias("start"))
        starts = written(starts.unionByName(found), "starts")
        then = pointers.select(*run, F.col("start").alias("next"), F.col("next").alias("after"))
        pointers = written(pointers.join(then, [*run, "next"]).select(*run, "start", F.col("after").alias("next")), "pointers")
    return starts


def rechunk_replay(
    events: DataFrame,
    max_bytes: int = S.REPLAY_CHUNK_BYTES,
    width_ms: int = HOUR_MS,
    flush_ms: int | None = None,
) -> DataFrame:
    """Cuts recorded events into chunks anew and numbers the chunks of each session.

    A chunk ends before a Meta event, when its text reaches `max_bytes`, and at every flush tick of `flush_ms` (without it
    there are no ticks). Wants `tenant_id, session_id, ts, seq, type, event`, where `(ts, seq)` orders the events of a
    session; an event without text has no size. The byte counter starts again in every (session, Meta run, tick). The work
    is on sizes and offsets; the texts are read once to measure them.
    """
    is_meta = F.coalesce((F.col("type") == S.REPLAY_META).cast("long"), F.lit(0))
    sized = events.select(*SESSION_KEYS, "ts", "seq", F.length("event").cast("bigint").alias("bytes"), is_meta.alias("is_meta"))
    order = ["ts", "seq"]
    runs = with_running_total(sized, SESSION_KEYS, order, F.col("is_meta"), "run", width_ms)
    runs = runs.withColumn("tick", F.lit(0) if flush_ms is None else F.floor(F.unix_millis("ts") / flush_ms))
    size = F.coalesce("bytes", F.lit(0))
    ends = with_running_total(runs, RUN_KEYS, order, size, "end", width_ms)
    # Events can come twice, so each has a number of its own from here on.
    placed = ends.select("*", (F.col("end") - size).alias("start"), F.monotonically_increasing_id().alias("event_no"))
    placed = written(placed, "offsets")
    # Events without text begin where the one behind them does; the first of them is the one that begins the chunk.
    starts = chunk_starts(placed, max_bytes).withColumn("begins", F.lit(1))
    first = placed.groupBy(*RUN_KEYS, "start").agg(F.min(F.struct(*order, "event_no")).alias("first"))
    begins = first.join(starts, [*RUN_KEYS, "start"]).select("first.event_no", "begins")
    marked = placed.join(begins, "event_no", "left")
    along = [*order, "run", "start", "event_no"]
    chunks = with_running_total(marked, SESSION_KEYS, along, F.coalesce("begins", F.lit(0)), "_number", width_ms)
    return chunks.groupBy(*SESSION_KEYS, (F.col("_number") - 1).alias("chunk_seq")).agg(
        F.count("*").alias("event_count"),
        F.sum("bytes").alias("bytes"),
        F.min("ts").alias("first_ts"),
        F.max("ts").alias("last_ts"),
        F.min_by("seq", F.struct(*order)).alias("first_seq"),
        F.max_by("seq", F.struct(*order)).alias("last_seq"),
        (F.min_by("is_meta", F.struct(*along)) == 1).alias("starts_with_snapshot"),
    )
