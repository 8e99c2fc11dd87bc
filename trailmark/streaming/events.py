"""Streaming jobs that store events and replay chunks."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from trailmark import schemas as S
from trailmark.operators.ingest import (
    classify_replay,
    classify_telemetry,
    decode_envelope,
    split_poison,
    to_event_rows,
)
from trailmark.operators.replay import chunk_rows
from trailmark.session import staged
from trailmark.sources.writers import write_dead_letters, write_events, write_replay
from trailmark.streaming.counters import Counters


def _start(stream: DataFrame, work, checkpoint: str, name: str, trigger: dict) -> StreamingQuery:
    writer = stream.writeStream.foreachBatch(work).option("checkpointLocation", checkpoint).queryName(name)
    return writer.trigger(**trigger).start()


def without_text(classified: DataFrame) -> DataFrame:
    """Good records without their raw text, which their envelope holds already; poison ones as they came."""
    return classified.withColumn("value", F.when(F.col("reason").isNotNull(), F.col("value")))


def run_events_stream(
    records: DataFrame, events_path: str, dead_path: str, checkpoint: str, counters_path: str | None = None, **trigger
) -> StreamingQuery:
    """Decodes, classifies, stores good events and dead-letters the rest, then commits the batch.

    A failed write fails the query, which resumes from its checkpoint: an outage never turns records into dead
    letters. Counters: `rows` stored and `dead_letters`.
    """

    def work(batch: DataFrame, batch_id: int) -> None:
        counters = Counters(counters_path, "events", batch_id)
        classified = classify_telemetry(decode_envelope(batch, "telemetry"))
        good, bad = F.count_if(F.col("reason").isNull()), F.count_if(F.col("reason").isNotNull())
        classified = counters.observe(classified, rows=good, dead_letters=bad)
        with staged(without_text(classified), f"{checkpoint.rstrip('/')}-batch") as classified:
            good, poison = split_poison(classified)
            write_events(to_event_rows(good), events_path, batch_id)
            write_dead_letters(poison, dead_path, batch_id, "events")
            counters.store(batch.sparkSession)

    return _start(records, work, checkpoint, "events", trigger or {"availableNow": True})


def run_replay_stream(
    records: DataFrame,
    payload_path: str,
    manifest_path: str,
    dead_path: str,
    checkpoint: str,
    counters_path: str | None = None,
    **trigger,
) -> StreamingQuery:
    """The same for replay chunks: payloads, then the manifest, then dead letters. Counters: `chunks` and their `bytes`."""

    def work(batch: DataFrame, batch_id: int) -> None:
        counters = Counters(counters_path, "replay", batch_id)
        classified = classify_replay(decode_envelope(batch, "replay"))
        taken = F.col("reason").isNull()
        counts = {"chunks": F.count_if(taken), "dead_letters": F.count_if(~taken)}
        counts["bytes"] = F.sum(F.when(taken, F.octet_length("envelope.events")))
        classified = counters.observe(classified, **counts)
        with staged(without_text(classified), f"{checkpoint.rstrip('/')}-batch") as classified:
            good, poison = split_poison(classified)
            write_replay(chunk_rows(good), payload_path, manifest_path, batch_id)
            write_dead_letters(poison, dead_path, batch_id, "replay")
            counters.store(batch.sparkSession)

    return _start(records, work, checkpoint, "replay", trigger or {"availableNow": True})


def stream_dedup(records: DataFrame, horizon: str = "1 hour", arrival: str = "ingested_at") -> DataFrame:
    """Drops events seen before within `horizon` of arrival time.

    Saves storage for quick redeliveries; what comes later is still collapsed on read by `dedup_latest`.
    """
    return records.withWatermark(arrival, horizon).dropDuplicatesWithinWatermark(["tenant_id", "session_id", "event_id"])


def pipeline_report(query: StreamingQuery) -> list[dict]:
    """One line per micro-batch of a query: rows read, rates, durations and observed counters."""
    lines = []
    for progress in query.recentProgress:
        lines.append(
            {
                "batch_id": progress["batchId"],
                "rows": progress["numInputRows"],
                "rows_per_second": progress.get("processedRowsPerSecond"),
                "duration_ms": dict(progress["durationMs"]),
                "observed": {name: row.asDict() for name, row in dict(progress.get("observedMetrics") or {}).items()},
            }
        )
    return lines
