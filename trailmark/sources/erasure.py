"""Erasure as a job that writes: it removes sessions and visitors from stored tables, store by store, and can be resumed."""

from collections.abc import Mapping
from dataclasses import dataclass
from datetime import timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trailmark import schemas as S
from trailmark.operators.governance import erasure_sessions
from trailmark.session import written
from trailmark.sources.daytable import DayTable
from trailmark.sources.snapshots import Snapshot

REQUEST = T.StructType(
    [
        *S._struct("id:string, tenant_id:string, subject_type:string, subject_id:string, status:string").fields,
        T.StructField("completed_at", T.TimestampType()),
        T.StructField("progress", T.MapType(T.StringType(), T.StringType())),
    ]
)
PENDING, IN_PROGRESS, COMPLETED, DONE = "PENDING", "IN_PROGRESS", "COMPLETED", "DONE"
TARGETS_DDL = "kind string, tenant_id string, id string, first_day date, last_day date"


@dataclass(frozen=True)
class Store:
    """A stored table, the column that names the session or visitor, and which of the two it names.

    With `dated`, rows of a session lie in parts whose time range meets the session's own days (or those beside them), so
    other parts are not read.
    """

    table: DayTable
    column: str
    kind: str = "SESSION"
    dated: bool = False


def erasure_targets(sessions: DataFrame, requests: DataFrame) -> DataFrame:
    """What open requests cover: sessions with the days they reach over, and visitors."""
    doomed = erasure_sessions(sessions, requests)
    begin = F.date_sub(F.to_date("started_at"), 1)
    end = F.date_add(F.to_date(F.greatest("last_active_at", "ended_at", "started_at")), 1)
    days = sessions.select("tenant_id", "id", begin.alias("first_day"), end.alias("last_day"))
    of_sessions = doomed.join(days, ["tenant_id", "id"], "left").withColumn("kind", F.lit("SESSION"))
    users = requests.filter((F.col("status") != COMPLETED) & (F.col("subject_type") == "END_USER")).select(
        F.lit("END_USER").alias("kind"), "tenant_id", F.col("subject_id").alias("id")
    )
    return of_sessions.unionByName(users.distinct(), allowMissingColumns=True).select("kind", "tenant_id", "id", "first_day", "last_day")


def erase_from(store: Store, targets: DataFrame) -> int:
    """Rewrites the parts of a table that hold targets, without them; returns the number of rows that went.

    A second run finds no targets and writes nothing. Old folders of the rewritten parts are removed at once.
    """
    table, keys = store.table, ["tenant_id", store.column]
    version = table.version()
    if version is None:
        return 0
    entries, own = table.entries(version), targets.filter(F.col("kind") == store.kind)
    asked = [entry for entry in entries if entry["rows"]]
    if store.dated and not own.filter("first_day IS NULL").take(1):
        each_day = F.explode(F.sequence("first_day", "last_day")).alias("day")
        days = {row[0] for row in own.select(each_day).distinct().collect()}  # a few thousand at most
        asked = [entry for entry in asked if _touches(entry, days)]
    ids = own.select("tenant_id", F.col("id").alias(store.column)).distinct()
    hits = table.read(asked).withColumn("_part", table.part()).join(ids, keys, "left_semi") if asked else None
    parts = {row["_part"]: row["count"] for row in hits.groupBy("_part").count().collect()} if asked else {}
    if parts:
        rows = table.read([entry for entry in entries if entry["part"] in parts]).withColumn("_part", table.part())
        keep = [entry for entry in entries if entry["part"] not in parts]
        table.write(rows.join(ids, keys, "left_anti"), F.col("_part"), keep, version + 1, table.mark(entries))
    table.remove_superseded(table.version(), also=0)
    return sum(parts.values())


def _touches(entry, days: set) -> bool:
    if entry["low"] is None:
        return True
    first, last = entry["low"].date(), entry["high"].date()
    return any(first + timedelta(n) in days for n in range((last - first).days + 1))


def run_erasure(spark: SparkSession, requests_path: str, stores: Mapping[str, Store], now: Column, sessions: str = "sessions") -> DataFrame:
    """Works through all open requests; returns the requests afterwards.

    The states of a request: PENDING, IN_PROGRESS with one line of progress for each store that is done, COMPLETED once
    all are. What is to go is found once, from the table of sessions, and written down before the requests are taken on,
    so a run that dies at any point is resumed with the same targets: stores that are done are passed over, and the one it
    died in is worked through again. Requests that come in meanwhile wait for the next run.
    """
    table = Snapshot(spark, requests_path, REQUEST)
    taken = F.col("status") == IN_PROGRESS

    def commit(rows: DataFrame) -> None:
        table.write(written(rows, "requests"), (table.version() or 0) + 1)

    if not table.read().filter(taken).take(1):
        waiting = table.read().filter(F.col("status") == PENDING)
        if not waiting.take(1):
            return table.read()
        started = (table.version() or 0) + 1
        known = stores[sessions].table.read()
        erasure_targets(known, waiting).write.mode("overwrite").parquet(f"{requests_path}/targets")
        begun = F.when(F.col("status") == PENDING, F.lit(IN_PROGRESS)).otherwise(F.col("status"))
        none = F.create_map().cast("map<string,string>")
        progress = F.when(F.col("status") == PENDING, none).otherwise(F.col("progress"))
        table.write(written(table.read().withColumns({"progress": progress, "status": begun}), "requests"), started)
    targets = spark.read.schema(TARGETS_DDL).parquet(f"{requests_path}/targets")
    for name, store in stores.items():
        # All requests taken on have the same progress.
        if table.read().filter(taken & (F.try_element_at("progress", F.lit(name)) == DONE)).take(1):
            continue
        erase_from(store, targets)
        line = F.map_concat("progress", F.create_map(F.lit(name), F.lit(DONE)))
        commit(table.read().withColumn("progress", F.when(taken, line).otherwise(F.col("progress"))))
    done = {"completed_at": F.when(taken, now).otherwise(F.col("completed_at")), "status": F.when(taken, F.lit(COMPLETED)).otherwise(F.col("status"))}
    commit(table.read().withColumns(done))
    return table.read()
