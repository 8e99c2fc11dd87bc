"""Record streams in, as batch or streaming DataFrames of `schemas.RAW_RECORD`."""

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trailmark import schemas as S

# Topic names of the two record streams.
TELEMETRY_TOPIC = "telemetry.events.v1"
REPLAY_TOPIC = "replay.chunks.v1"
# End of fixed values.


def _read(spark: SparkSession, fmt: str, options: Mapping[str, str], streaming: bool, path: str | None, topic: str):
    reader = spark.readStream if streaming else spark.read
    if fmt == "kafka":
        loaded = reader.format("kafka").option("subscribe", topic).options(**options).load()
        return loaded.select(
            "topic", "partition", "offset", "timestamp", F.col("key").cast("string"), F.col("value").cast("string")
        )
    if fmt == "text":
        lines = reader.format("text").options(**options).load(path)
        unknown = F.lit(None)
        return lines.select(
            F.lit(topic).alias("topic"),
            unknown.cast("int").alias("partition"),
            unknown.cast("bigint").alias("offset"),
            F.col("_metadata.file_modification_time").alias("timestamp"),
            unknown.cast("string").alias("key"),
            "value",
        )
    return reader.format(fmt).schema(S.RAW_RECORD).options(**options).load(path)


def read_telemetry(
    spark: SparkSession, path: str | None = None, fmt: str = "parquet", streaming: bool = False, **options: str
) -> DataFrame:
    """Telemetry records. `fmt` is `kafka`, `text` (one envelope per line), `parquet` or `json` (whole records).

    Limit the size of micro-batches with `maxOffsetsPerTrigger` (kafka) or `maxFilesPerTrigger` (files).
    """
    return _read(spark, fmt, options, streaming, path, TELEMETRY_TOPIC)


def read_replay(
    spark: SparkSession, path: str | None = None, fmt: str = "parquet", streaming: bool = False, **options: str
) -> DataFrame:
    """Replay-chunk records, as `read_telemetry`."""
    return _read(spark, fmt, options, streaming, path, REPLAY_TOPIC)


def read_table(spark: SparkSession, path: str, schema=None) -> DataFrame:
    """A written table; with a schema also one that has no files yet."""
    if schema is None:
        return spark.read.parquet(path)
    return spark.read.schema(schema).option("ignoreMissingFiles", "true").parquet(path)
