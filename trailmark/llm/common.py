"""What the operators of this package share."""

import sys
from collections.abc import Callable, Iterator
from types import ModuleType

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Texts of a batch that are Python objects at the same time.
SLICE = 256


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def once_per_worker(key: str, make: Callable):
    """What `make` returns, made once in each Python worker and kept over tasks.

    Functions of this package are pickled by value, so their module globals live for one task only.
    """
    kept = sys.modules.setdefault("_trailmark_worker", ModuleType("_trailmark_worker")).__dict__
    if key not in kept:
        kept[key] = make()
    return kept[key]


def values(column: pa.Array, kind: pa.DataType, step: int = SLICE) -> Iterator:
    """Values of an Arrow column one by one, with few of them as Python objects at a time."""
    for start in range(0, len(column), step):
        yield from column.slice(start, step).cast(kind).to_pylist()


def utf8(column: pa.Array) -> Iterator[bytes | None]:
    return values(column, pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary())


def strings(column: pa.Array) -> Iterator[str | None]:
    return values(column, column.type)


def lower_ascii(text):
    """A-Z to a-z only, as a column."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
