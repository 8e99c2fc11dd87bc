"""Session settings and the shared working folder."""

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# Suited to any deployment; sizes and master come from the cluster.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.parquet.compression.codec": "zstd",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    # Batches of whole texts for Python; long documents make large batches.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
}


def session(app: str = "trailmark", **extra: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    for key, value in {**SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def work_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder for checkpoints and written tables.

    On a cluster it lies in the shared folder named by ``spark.checkpoint.dir``, which must be set there. In local mode a
    temporary folder stands in for it where it is unset.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        shared = tempfile.mkdtemp(prefix="trailmark-")
    return f"{shared.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """The same rows read back from a table in the working folder.

    Cuts the lineage between the passes of a job: what follows reads a finished table, on whatever executors are left.
    """
    path = work_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def staged(df: DataFrame, path: str) -> Iterator[DataFrame]:
    """The same rows read back from a table at `path`, which is gone afterwards.

    For rows that several passes read, such as those of a micro-batch of any size: each pass reads the columns it needs, and
    nothing is held in memory. Whatever an earlier attempt has left at `path` is overwritten.
    """
    spark = df.sparkSession
    try:
        df.write.mode("overwrite").option("compression", "zstd").parquet(path)
        yield spark.read.schema(df.schema).parquet(path)
    finally:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
