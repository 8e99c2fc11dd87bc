"""A table that is rewritten part by part.

Rows live in parts, such as one per day. A version of the table is a short list of entries (part, folder): what it is made
of. A new version writes the parts that changed into a folder of its own, lists these beside the entries it keeps, and is
committed as a whole by that list. So the cost of a version follows what changes, a reader never sees half of one, and a
writer that dies before the commit has changed nothing: its folder is written again by the next attempt. There must be one
writer per table.

Entries carry the number of rows and the least and greatest value of one timestamp column, by which readers skip parts.
The newest two versions can be read; folders that neither of them lists are removed after a commit.
"""

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from trailmark import schemas as S
from trailmark.sources.snapshots import Snapshot

ENTRY = S._struct("part:string, folder:bigint, rows:bigint, low:timestamp, high:timestamp, mark:bigint")


class DayTable:
    def __init__(self, spark: SparkSession, path: str, schema: StructType, bounds: str):
        self.spark, self.path, self.schema, self.bounds = spark, path.rstrip("/"), schema, bounds
        self.lists = Snapshot(spark, f"{self.path}/entries", ENTRY)

    def version(self) -> int | None:
        return self.lists.version()

    def entries(self, version: int | None = None) -> list[Row]:
        """What a version, by default the newest, is made of: a few lines for each part."""
        return self.lists.read(version).collect()

    def read(self, entries: Iterable[Row] | None = None) -> DataFrame:
        """The rows of some entries, by default those of the newest version."""
        entries = self.entries() if entries is None else entries
        paths = [f"{self.path}/data/{entry['folder']}/part={entry['part']}" for entry in entries if entry["rows"]]
        if not paths:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*paths)

    def part(self) -> Column:
        """The part a row of `read` lies in."""
        return F.regexp_extract(F.col("_metadata.file_path"), "/part=([^/]+)/", 1)

    def write(self, rows: DataFrame, part: Column, keep: Iterable[Row], version: int, mark: int) -> int:
        """Writes parts and commits them beside the entries kept; returns the number of rows written.

        `mark` is a number that is committed with the version, such as how far its source has been read.
        """
        folder = f"{self.path}/data/{version}"
        dealt = rows.select(*self.schema.fieldNames(), part.alias("part"))
        dealt = dealt.repartitionByRange("part", self.bounds).sortWithinPartitions("part", self.bounds)
        dealt.write.mode("overwrite").option("compression", "zstd").partitionBy("part").parquet(folder)
        with_part = StructType([*self.schema.fields, StructField("part", StringType())])
        sums = self.spark.read.schema(with_part).parquet(folder).groupBy("part").agg(
            F.count("*").alias("rows"), F.min(self.bounds).alias("low"), F.max(self.bounds).alias("high")
        )
        new = [(line["part"], version, line["rows"], line["low"], line["high"], mark) for line in sums.collect()]
        kept = [(entry["part"], entry["folder"], entry["rows"], entry["low"], entry["high"], mark) for entry in keep]
        none = [] if new or kept else [("", version, 0, None, None, mark)]
        self.lists.write(self.spark.createDataFrame(new + kept + none, ENTRY).coalesce(1), version)
        self.remove_superseded(version)
        return sum(line[2] for line in new)

    def mark(self, entries: list[Row]) -> int | None:
        return max((entry["mark"] for entry in entries), default=None)

    def remove_superseded(self, version: int, also: int = 1) -> None:
        """Removes the folders of older versions that neither this one nor the `also` before it list."""
        listed: dict[int, set[str]] = {}
        for number in range(version, version - also - 1, -1):
            for entry in self.entries(number) if number >= 0 else []:
                listed.setdefault(entry["folder"], set()).add(f"part={entry['part']}")
        for name in self._names("data"):
            if name.isdigit() and int(name) < version:
                if int(name) not in listed:
                    self._remove(f"data/{name}")
                else:
                    for part in self._names(f"data/{name}"):
                        if part.startswith("part=") and part not in listed[int(name)]:
                            self._remove(f"data/{name}/{part}")
        for name in self._names("entries/data"):
            if name.isdigit() and int(name) < version - also:
                self._remove(f"entries/data/{name}")

    def _files(self, below: str):
        hadoop = self.spark._jvm.org.apache.hadoop.fs
        path = hadoop.Path(f"{self.path}/{below}")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def _names(self, below: str) -> list[str]:
        files, path = self._files(below)
        return [status.getPath().getName() for status in files.listStatus(path)] if files.exists(path) else []

    def _remove(self, below: str) -> None:
        files, path = self._files(below)
        files.delete(path, True)
