"""Tables out. Every write of a stream is keyed by its batch and overwrites its own folders, so a retry changes nothing."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trailmark import schemas as S
from trailmark.functions.times import day_of
from trailmark.functions.web import object_key
from trailmark.operators.replay import chunk_manifest
from trailmark.operators.tables import dedup_latest, events_layout

PARQUET = {"compression": "zstd", "partitionOverwriteMode": "dynamic"}


def write_events(df: DataFrame, path: str, batch_id: int, rows_per_file: int = 5_000_000) -> None:
    """Appends event rows by day and batch, sorted by tenant, session and time.

    Ranges over the sort key give every task an even share, a hot session included, and narrow row-group statistics to
    skip by; the bloom filter serves look-ups by page.
    """
    (
        events_layout(df)
        .withColumn("batch_id", F.lit(batch_id).cast("bigint"))
        .repartitionByRange("event_date", *S.EVENT_KEYS)
        .sortWithinPartitions("event_date", *S.EVENT_KEYS)
        .write.mode("overwrite")
        .options(**PARQUET)
        .option("maxRecordsPerFile", rows_per_file)
        .option("parquet.bloom.filter.enabled#path", "true")
        .partitionBy("event_date", "batch_id")
        .parquet(path)
    )


def write_dead_letters(poison: DataFrame, path: str, batch_id: int, consumer: str) -> None:
    """Poison records as received, with the reason and the consumer that refused them."""
    kept = [name for name in S.RAW_RECORD.fieldNames() if name in poison.columns]
    (
        poison.select(*kept, "reason", F.lit(consumer).alias("consumer"))
        .withColumn("batch_id", F.lit(batch_id).cast("bigint"))
        .write.mode("overwrite")
        .options(**PARQUET)
        .partitionBy("consumer", "batch_id", "reason")
        .parquet(path)
    )


def write_replay(chunks: DataFrame, payload_path: str, manifest_path: str, batch_id: int) -> None:
    """Payloads first, manifest second: a manifest row never names a payload that is not there."""
    stored = chunks.withColumn("batch_id", F.lit(batch_id).cast("bigint"))
    manifest = chunk_manifest(chunks).withColumn("batch_id", F.lit(batch_id).cast("bigint"))
    key = object_key(F.col("tenant_id"), F.col("session_id"), F.col("chunk_seq"))
    (
        stored.select(key.alias("object_key"), F.col("events").alias("payload"), "ingested_at", "batch_id")
        .write.mode("overwrite")
        .options(**PARQUET)
        .partitionBy("batch_id")
        .parquet(payload_path)
    )
    (
        manifest.withColumn("chunk_date", day_of(F.col("first_ts")))
        .write.mode("overwrite")
        .options(**PARQUET)
        .partitionBy("chunk_date", "batch_id")
        .parquet(manifest_path)
    )


def write_lifecycle(records: DataFrame, path: str, batch_id: int) -> None:
    """Lifecycle records as an append-only change table; `latest_by_key` gives the compacted view."""
    (
        records.withColumn("batch_id", F.lit(batch_id).cast("bigint"))
        .write.mode("overwrite")
        .options(**PARQUET)
        .partitionBy("batch_id")
        .parquet(path)
    )


def lifecycle_messages(records: DataFrame) -> DataFrame:
    """The same records as `key, value` messages for a log sink."""
    return records.select(F.col("sessionId").alias("key"), F.to_json(F.struct("*")).alias("value"))


def compact_events(spark: SparkSession, path: str, target: str, dates: list[str] | None = None) -> None:
    """Rewrites days of an event table (all by default), de-duplicated and sorted, into `target`.

    The source is left alone; readers move to the new folder when it is complete. Days that `target` already holds
    are replaced, so a repeated run gives the same.
    """
    days = spark.read.parquet(path)
    if dates is not None:
        days = days.filter(F.col("event_date").isin([F.to_date(F.lit(date)) for date in dates]))
    write_events(dedup_latest(days.drop("batch_id", "event_date")), target, 0)
