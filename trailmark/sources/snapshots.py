"""A table that is rewritten as a whole, version by version.

Spark cannot overwrite the files it reads, so each version is a folder of its own. A line in the small `commits` table
names it once it is complete; readers take the newest committed version and never see a half-written one. There must be
one writer per table.
"""

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


class Snapshot:
    def __init__(self, spark: SparkSession, path: str, schema: StructType):
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema

    def version(self) -> int | None:
        """Newest committed version, or None before the first commit."""
        try:
            commits = self.spark.read.schema("version bigint").parquet(f"{self.path}/commits")
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return None
        return commits.agg(F.max("version")).first()[0]

    def read(self, version: int | None = None) -> DataFrame:
        version = self.version() if version is None else version
        if version is None:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/data/{version}")

    def write(self, df: DataFrame, version: int) -> None:
        """Writes and commits a version. Writing a version again replaces it, so a retried job is harmless."""
        df.select(*self.schema.fieldNames()).write.mode("overwrite").option("compression", "zstd").parquet(
            f"{self.path}/data/{version}"
        )
        line = self.spark.range(1).select(F.lit(version).cast("bigint").alias("version"))
        line.coalesce(1).write.mode("append").parquet(f"{self.path}/commits")
