"""Counters of the jobs: what each micro-batch or pass has done, as rows of a small table.

A counter is an observed metric of the rows a job handles anyway, so it costs no pass of its own. The counters of a batch
are written under the job and the batch, and a repeated batch overwrites them.
"""

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

COUNTERS_DDL = "name string, value bigint, job string, batch_id bigint"


class Counters:
    """Collects the counters of one batch of one job. Without a path they are counted and dropped."""

    def __init__(self, path: str | None, job: str, batch_id: int):
        self.path, self.job, self.batch_id = path, job, batch_id
        self.seen: list[Observation] = []
        self.known: dict[str, int] = {"batches": 1}

    def observe(self, df: DataFrame, **values: Column) -> DataFrame:
        """The same rows, with aggregates over them that can be read once they have been written or cached."""
        if self.path is None:
            return df
        self.seen.append(Observation())
        return df.observe(self.seen[-1], *[value.alias(name) for name, value in values.items()])

    def add(self, **values: int) -> None:
        self.known |= values

    def store(self, spark: SparkSession) -> None:
        """To be called when the observed rows have been written."""
        if self.path is None:
            return
        for observation in self.seen:
            self.known |= {name: value or 0 for name, value in observation.get.items()}
        rows = [(name, int(value), self.job, self.batch_id) for name, value in self.known.items()]
        lines = spark.createDataFrame(rows, COUNTERS_DDL).coalesce(1)
        lines.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("job", "batch_id").parquet(self.path)


def read_counters(spark: SparkSession, path: str) -> DataFrame:
    """Rows (name, value, job, batch_id)."""
    try:
        return spark.read.schema(COUNTERS_DDL).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], COUNTERS_DDL)


def pipeline_totals(counters: DataFrame) -> DataFrame:
    """Each counter of each job over all its batches."""
    return counters.groupBy("job", "name").agg(F.sum("value").alias("value"))
