"""Token ids in Parquet files that can be read selectively.

One row per document: `part`, `doc_id`, `local_start` (ids of the documents before it in its part), `n_tokens`, and
`tokens`, a list of ids. Rows ascend by document id over all files. The list column is dictionary-encoded: a vocabulary
fits in a dictionary page, and an id then takes as many bits as the number of distinct ids in the row group needs. The
ascending columns are delta-encoded. Row groups and pages are small and pages have their index, so a filter on `doc_id`
reads a few pages, and a read of the other columns never touches the ids.

Null texts count as empty and have the end id only. Null document ids come first; rows with equal ids are ordered by
their texts.
"""

import zlib

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trailmark.llm.common import SLICE, once_per_worker, strings
from trailmark.llm.vocab import LowerWords

SCHEMA = "part int, doc_id bigint, local_start bigint, n_tokens bigint, tokens array<int>"
LAYOUT = {
    "compression": "zstd",
    "parquet.block.size": 16 << 20,
    "parquet.page.size": 64 << 10,
    "parquet.page.row.count.limit": 512,
    "parquet.writer.version": "v2",
    "parquet.enable.dictionary": "true",
    "parquet.dictionary.page.size": 1 << 20,
    **{f"parquet.enable.dictionary#{name}": "false" for name in ("doc_id", "local_start", "n_tokens")},
}


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end: int, text: str = "text", id: str = "doc_id") -> None:
    """Encodes all texts, each followed by the end id, and writes them to a new folder."""

    def encode(batches):
        import numpy as np

        words = once_per_worker(f"words {tokenizer}", lambda: LowerWords(tokenizer))
        part, start, last = TaskContext.get().partitionId(), 0, np.array([end], "<u4").tobytes()
        for whole in batches:
            for at in range(0, len(whole), SLICE):
                batch = whole.slice(at, SLICE)
                ids = [words.encode(value or "") + last for value in strings(batch.column("text"))]
                sizes = np.array([len(x) // 4 for x in ids], np.int64)
                ends = np.cumsum(sizes)
                lists = pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int32()), pa.array(np.frombuffer(b"".join(ids), "<i4")))
                columns = [pa.array(np.full(len(ids), part, np.int32)), batch.column("doc_id"), pa.array(start + ends - sizes), pa.array(sizes), lists]
                yield pa.RecordBatch.from_arrays(columns, ["part", "doc_id", "local_start", "n_tokens", "tokens"])
                start += int(sizes.sum())

    ordered = docs.select(F.col(id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    ordered = ordered.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    ordered.mapInArrow(encode, SCHEMA).write.options(**LAYOUT).parquet(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """The rows of such a folder, with `start`: the ids of all documents before."""
    rows = spark.read.schema(SCHEMA).parquet(path)
    # One row per part: what all parts before it hold.
    sizes = rows.groupBy("part").agg(F.sum("n_tokens").alias("size"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("part", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("offset"))
    return rows.join(F.broadcast(offsets), "part").withColumn("start", F.col("offset") + F.col("local_start")).drop("offset")


def ids_crc32(tokens: Column) -> Column:
    """CRC-32 of a list of ids as little-endian unsigned 32-bit integers."""

    @F.arrow_udf("bigint")
    def crc(lists: pa.Array) -> pa.Array:
        import numpy as np

        flat = lists.flatten().to_numpy(zero_copy_only=False).astype("<u4")
        ends = np.cumsum(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
        starts = np.append(0, ends[:-1])
        return pa.array([zlib.crc32(flat[a:b]) for a, b in zip(starts, ends, strict=True)], pa.int64())

    return crc(tokens)


