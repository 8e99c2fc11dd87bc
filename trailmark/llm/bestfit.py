"""Best-fit packing of documents into sequences, planned on the histogram of lengths.

A document longer than a window is cut into pieces of one window each, of which the first may be shorter; all others stay
whole. How many sequences there are and what they hold depends on the lengths alone, and a histogram of lengths has at
most `window` bins however many documents there are. So the plan is made over counts:

* Lengths are taken from the longest to the shortest. Sequences of equal free space are one group.
* All pieces of a length go to the group with the least free space that holds one, as many to each of its sequences as
  fit there, then to the next group; what is left opens new sequences. This is what best-fit does with the pieces one by
  one, in descending order: a sequence it has just filled further has less free space than before, so it is the next choice.
* A group is split where the pieces end inside it. That happens twice for a length at most, and a group that receives
  pieces loses over half of its space, so there are at most about 3 x window groups and 30 x window entries in the plan.

An entry of the plan gives the pieces of one length from one rank to another their sequences and offset. A piece has its
rank among those of its length from counts per part of the written pieces, and looks up the entry that holds its rank. Only
the histogram and the plan pass through the driver, both bounded by the window.

Null texts count as empty; an empty text has the end id only. Repeated rows and rows without id are packed each. An empty
table gives no rows. Other columns of the input are not looked at.
"""

import zlib

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trailmark.llm.common import once_per_worker, strings
from trailmark.llm.vocab import SpacedWords
from trailmark.session import written

WINDOW = 1024
END = 2

PIECES = "part int, local_rank bigint, doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"
PLACES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint"


def borders(size: int, window: int) -> list[int]:
    """Where the pieces of a document begin and, last, end: the odd piece comes first."""
    first = size % window or min(size, window)
    return [0, *range(first, size + 1, window)] if size else [0]


def cut(docs: DataFrame, tokenizer: str, text: str, id: str, window: int, end: int) -> DataFrame:
    """The pieces of all documents. `local_rank` counts equal lengths within a part."""

    def pieces(batches):
        words = once_per_worker(f"words {tokenizer}", lambda: SpacedWords(tokenizer))
        part, seen = TaskContext.get().partitionId(), [0] * (window + 1)
        last = end.to_bytes(4, "little")
        for batch in batches:
            rows = []
            for number, value in zip(batch.column("doc_id").to_pylist(), strings(batch.column("text")), strict=True):
                ids = words.encode(value or "") + last
                at = borders(len(ids) // 4, window)
                for piece, (start, stop) in enumerate(zip(at, at[1:], strict=False)):
                    length = stop - start
                    rows.append((part, seen[length], number, piece, start, length, zlib.crc32(ids[4 * start : 4 * stop])))
                    seen[length] += 1
            columns = list(zip(*rows, strict=True)) or [()] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    long, short = pa.int64(), pa.int32()
    kinds = [short, long, long, short, long, long, long]
    names = [field.split()[0] for field in PIECES.split(", ")]
    return docs.select(F.col(id).cast("bigint").alias("doc_id"), F.col(text).alias("text")).mapInArrow(pieces, PIECES)


def plan(counts, window: int) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Entries (length, first rank, first sequence, pieces in each sequence, offset), and the number of sequences.

    The entry of a length holds its ranks from the first one to that of the next entry. The pieces of a sequence lie at
    the offset, one behind the other.
    """
    groups: dict[int, list[tuple[int, int]]] = {}  # free space to (first sequence, number of sequences)
    entries, sequences = [], 0
    for length in range(window, 0, -1):
        left, rank = int(counts[length]), 0
        for space in sorted(free for free in groups if free >= length):
            fit = space // length
            while left and groups.get(space):
                first, number = groups[space].pop()
                used = min(number, -(-left // fit))
                whole = min(used, left // fit)  # the last one may take fewer than fit
                entries.append((length, rank, first, fit, window - space))
                if whole:
                    groups.setdefault(space - fit * length, []).append((first, whole))
                if whole < used:
                    groups.setdefault(space - (left - whole * fit) * length, []).append((first + whole, 1))
                if used < number:
                    groups[space].append((first + used, number - used))
                taken = min(left, used * fit)
                rank, left = rank + taken, left - taken
        if left:
            fit = window // length
            entries.append((length, rank, sequences, fit, 0))
            whole, rest = divmod(left, fit)
            if whole:
                groups.setdefault(window - fit * length, []).append((sequences, whole))
            if rest:
                groups.setdefault(window - rest * length, []).append((sequences + whole, 1))
            sequences += whole + bool(rest)
    return entries, sequences


def pack(docs: DataFrame, tokenizer: str, text: str = "text", id: str = "doc_id", window: int = WINDOW, end: int = END) -> DataFrame:
    """One row per piece: where it comes from, and its sequence and offset there."""
    import numpy as np

    pieces = written(cut(docs, tokenizer, text, id, window, end), "pieces")
    sizes = pieces.groupBy("part", "length").agg(F.count("*").alias("n"))
    counts = np.zeros(window + 1, np.int64)
    for row in sizes.groupBy("length").agg(F.sum("n").alias("n")).collect():
        counts[row["length"]] = row["n"]
    of_length: dict[int, list] = {}
    for length, *entry in plan(counts, window)[0]:
        of_length.setdefault(length, []).append(entry)
    shared = docs.sparkSession.sparkContext.broadcast({length: np.array(rows, np.int64).T for length, rows in of_length.items()})

    def place(batches):
        for batch in batches:
            length, rank = (batch.column(name).to_numpy() for name in ("length", "rank"))
            sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for one in np.unique(length):
                first, start, fit, at = shared.value[int(one)]
                here = np.flatnonzero(length == one)
                entry = np.searchsorted(first, rank[here], "right") - 1
                nth = rank[here] - first[entry]
                sequence[here] = start[entry] + nth // fit[entry]
                offset[here] = at[entry] + nth % fit[entry] * one
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence), pa.array(offset)], names)

    names = [field.split()[0] for field in PLACES.split(", ")]
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    ranks = sizes.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    ranked = pieces.join(ranks, ["part", "length"])
    return ranked.select(*names[:5], (F.col("local_rank") + F.col("before")).alias("rank")).mapInArrow(place, PLACES)
