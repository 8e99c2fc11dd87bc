"""Packing of documents into sequences by a histogram of lengths and non-negative least squares.

A document is cut into full windows and one tail. Full windows are sequences of their own. Tails are packed by length
alone, on their histogram, which has at most `WINDOW` - 1 bins however many documents there are:

1. Combinations of at most three lengths that fill a window exactly are enumerated (one length if it is a power of two,
   which needs no padding).
2. Non-negative least squares finds how often to repeat each so that together they use up the histogram.
3. The counts are rounded, within what is left of each length.
4. What remains is packed greedily: the longest first, then always the longest that fits. Such a pattern is repeated
   until one of its lengths is used up, so there are at most as many patterns as lengths.

The patterns become ranges: the k-th to l-th tail of a length go to given sequences at a given offset. Each tail has
its rank among the tails of its length from counts per part, and looks its place up. Nothing but the histogram and the
list of patterns passes through the driver.

Null texts count as empty; an empty text has the end id only. Repeated rows and rows without id are packed each.
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
END = 0
TRIPLES = 2048  # combinations of three lengths, the most frequent first
ROUNDS = 400

PIECES = "part int, doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, local_rank bigint"
PLACES = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"


def cut(docs: DataFrame, tokenizer: str, text: str, id: str, window: int) -> DataFrame:
    """The pieces of all documents: full windows and tails. `local_rank` counts equal lengths within a part."""

    def pieces(batches):
        words = once_per_worker(f"words {tokenizer}", lambda: SpacedWords(tokenizer))
        part, seen = TaskContext.get().partitionId(), [0] * (window + 1)
        last = END.to_bytes(4, "little")
        for batch in batches:
            rows = []
            for number, value in zip(batch.column("doc_id").to_pylist(), strings(batch.column("text")), strict=True):
                ids = words.encode(value or "") + last
                size = len(ids) // 4
                for start in range(0, size, window):
                    length = min(window, size - start)
                    crc = zlib.crc32(ids[4 * start : 4 * (start + length)])
                    rows.append((part, number, start, length, crc, size, seen[length]))
                    seen[length] += 1
            columns = list(zip(*rows, strict=True)) or [()] * 7
            kinds = [pa.int32(), *[pa.int64()] * 6]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    names = [field.split()[0] for field in PIECES.split(", ")]
    return docs.select(F.col(id).cast("bigint").alias("doc_id"), F.col(text).alias("text")).mapInArrow(pieces, PIECES)


def combinations(counts, window: int) -> list[tuple[int, ...]]:
    """Combinations of up to three lengths that need no padding, of lengths that occur."""
    import numpy as np

    there = np.flatnonzero(counts)
    out = [(int(a),) for a in there if a & (a - 1) == 0]
    out += [(int(a), window - int(a)) for a in there if 2 * a <= window and counts[window - a]]
    a, b = (side.ravel() for side in np.meshgrid(there, there, indexing="ij"))
    c = window - a - b
    fits = (a <= b) & (b <= c)
    a, b, c = a[fits], b[fits], c[fits]
    common = np.minimum(np.minimum(counts[a], counts[b]), counts[c])
    best = np.lexsort((b, a, -common))[:TRIPLES]
    return out + [(int(a[i]), int(b[i]), int(c[i])) for i in best if common[i]]


def repeats(counts, choices: list[tuple[int, ...]]):
    """Non-negative x with the least squared difference between the lengths in x repeats and the histogram.

    Accelerated projected gradient; the matrix has at most three entries in a column.
    """
    import numpy as np

    rows = np.array([length for choice in choices for length in choice])
    columns = np.array([place for place, choice in enumerate(choices) for _ in choice])
    used = lambda x: np.bincount(rows, x[columns], len(counts))
    back = lambda y: np.bincount(columns, y[rows], len(choices))
    step = 1.0 / max(1e-9, np.bincount(columns, np.bincount(rows, minlength=len(counts))[rows]).max())
    x = ahead = np.zeros(len(choices))
    speed = 1.0
    for _ in range(ROUNDS):
        following = np.maximum(0.0, ahead - step * back(used(ahead) - counts))
        quicker = (1 + (1 + 4 * speed * speed) ** 0.5) / 2
        ahead = following + (speed - 1) / quicker * (following - x)
        x, speed = following, quicker
    return x


def patterns(counts, window: int = WINDOW) -> list[tuple[tuple[int, ...], int]]:
    """Lengths of a sequence, longest first, and how many sequences look so. Uses up the histogram exactly."""
    import numpy as np

    left, out = counts.copy(), []

    def take(choice: tuple[int, ...], wanted: int) -> None:
        times = min([wanted, *(int(left[length]) // choice.count(length) for length in choice)])
        if times > 0:
            for length in choice:
                left[length] -= times
            out.append((tuple(sorted(choice, reverse=True)), times))

    choices = combinations(counts, window)
    if choices:
        x = repeats(counts, choices)
        for place in np.argsort(-x, kind="stable"):
            take(choices[place], int(round(x[place])))
    while left.any():
        free, choice, still = window, [], left.copy()
        while free and still[: free + 1].any():
            length = int(np.flatnonzero(still[: free + 1])[-1])
            times = min(int(still[length]), free // length)
            choice += [length] * times
            still[length] -= times
            free -= length * times
        take(tuple(choice), int(left.sum()))
    return out


def slots(found: list[tuple[tuple[int, ...], int]]):
    """Per length, four arrays: first rank, first sequence and offset of each range of ranks; and the number of sequences."""
    import numpy as np

    rows, next_rank, sequences = {}, {}, 0
    for lengths, times in found:
        offset = 0
        for length in lengths:
            rank = next_rank.get(length, 0)
            rows.setdefault(length, []).append((rank, sequences, offset))
            next_rank[length] = rank + times
            offset += length
        sequences += times
    return {length: np.array(of_length, np.int64).T for length, of_length in rows.items()}, sequences


def pack(docs: DataFrame, tokenizer: str, text: str = "text", id: str = "doc_id", window: int = WINDOW) -> DataFrame:
    """One row per piece: where it comes from, and its sequence and offset there."""
    import numpy as np

    pieces = written(cut(docs, tokenizer, text, id, window), "pieces")
    sizes = pieces.where(F.col("length") < window).groupBy("part", "length").agg(F.count("*").alias("n"))
    counts = np.zeros(window + 1, np.int64)
    for row in sizes.groupBy("length").agg(F.sum("n").alias("n")).collect():
        counts[row["length"]] = row["n"]
    places, sequences = slots(patterns(counts, window))
    shared = docs.sparkSession.sparkContext.broadcast(places)
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    ranks = sizes.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))

    def place(batches):
        for batch in batches:
            length, rank = (batch.column(name).to_numpy() for name in ("length", "rank"))
            sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for one in np.unique(length):
                first, number, at = shared.value[int(one)]
                here = np.flatnonzero(length == one)
                slot = np.searchsorted(first, rank[here], "right") - 1
                sequence[here] = number[slot] + rank[here] - first[slot]
                offset[here] = at[slot]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence), pa.array(offset)], names)

    names = [field.split()[0] for field in PLACES.split(", ")]
    kept = names[:5]
    tails = pieces.where(F.col("length") < window).join(ranks, ["part", "length"])
    tails = tails.select(*kept, (F.col("local_rank") + F.col("before")).alias("rank")).mapInArrow(place, PLACES)
    whole = pieces.where(F.col("length") == window)
    number = sequences + F.col("part").cast("bigint") * (1 << 33) + F.col("local_rank")
    return tails.unionByName(whole.select(*kept, number.alias("sequence_id"), F.lit(0).cast("bigint").alias("offset")))
