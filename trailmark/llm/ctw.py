"""Language-model scoring by context-tree weighting over bytes.

A byte is eight binary choices. Every context of up to `DEPTH` preceding bytes, and every choice within a byte, has a
Krichevsky-Trofimov estimate. Context-tree weighting mixes the estimates of all depths: the weight of a context against
all longer ones is the posterior odds of its own code length against theirs, half and half at first. Learning from a
whole corpus makes this exact in closed form: the block probability depends on counts only, and the weights on sums of
logarithms from the leaves up. A prediction starts at the empty context and ends at the longest one that was seen.

A text is its bytes with A-Z in lower case, between a beginning of its own and an end byte, so that the probabilities of
all texts sum to one. The score is its log10 probability; `bits_per_byte` is the code length.

How it is spread:

1. Texts are dealt into blocks of `BLOCK` bytes where they are read, in an order of their own, so that they are dealt alike
   each time. A block reports each of its strings of DEPTH + 1 bytes once, with its count in training texts.
2. Strings are sharded by the three bytes before the last, with all of their context tree below that; the number of shards
   follows the bytes of text. Where there are more than `FAN` blocks, the reports of `FAN` of them at a time are summed
   per shard, level by level, so that a shard reads as many reports however much text there is.
3. Shards work bottom up; the tree above, of contexts of up to two bytes, is grouped sums.
4. Shards come down again and answer each report with the log-probability of its own strings, and so do sums of reports
   for those they are made of.
5. A block is scored with the answers. No task sees more of the model than its texts use, and nothing is broadcast. Strings
   and words of a very long text are held piece by piece.

Word counts for the comparison with a unigram model go the same way, with 64-bit hashes of words for strings.

Null texts count as empty: they are an end byte. Null ids are hashed as empty strings. Repeated rows are scored each, and
learned from each. Texts are taken whole; invalid UTF-8 cannot occur in a string column.
"""

import re
import zlib

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailmark.llm.common import utf8
from trailmark.session import written

DEPTH = 5  # bytes of context
TOP = 3  # bytes of context that name a shard
START, END = 0xFE, 0xFF  # never part of UTF-8
BLOCK = 12 << 20
PIECE = 2 << 20  # bytes of text whose strings and words are held one by one
FOLDS, HELD_OUT = 7, 2
WORD_END = b"\xff"
LEAST_SHARDS, MOST_SHARDS = 64, 1 << 14
SHARD_BYTES = 8 << 20  # bytes of text for each shard
FAN = 64
WHITE = re.compile(rb"[\x20\x09-\x0D]")

STRINGS, WORDS, TOTALS = 0, 1, 2
PACKED = "kind int, block bigint, shard int, keys binary, values binary"
SCORES = (
    "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, "
    "score double, n_bytes bigint, bits_per_byte double"
)
SCORES_SCHEMA = pa.schema(
    [
        (field.split()[0], {"bigint": pa.int64(), "boolean": pa.bool_(), "double": pa.float64()}[field.split()[1]])
        for field in SCORES.split(", ")
    ]
)


def is_held_out(doc_id) -> bool:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % FOLDS == HELD_OUT


def stretches(texts: list[bytes]):
    """Lists of parts (number of the text, bytes before, bytes, whether it ends there) of about PIECE bytes together."""
    held, size = [], 0
    for number, text in enumerate(texts):
        for start in range(0, max(1, len(text)), PIECE):
            part = text[start : start + PIECE]
            if held and size + len(part) > PIECE:
                yield held
                held, size = [], 0
            before = (bytes([START]) * DEPTH + text[max(0, start - DEPTH) : start])[-DEPTH:]
            held.append((number, before, part, start + PIECE >= len(text)))
            size += len(part)
    if held:
        yield held


def strings_of(parts):
    """Every byte of the parts and of the ends of texts with the DEPTH bytes before it, latest first, as one number."""
    import numpy as np

    line = np.frombuffer(b"".join(x for _, before, part, last in parts for x in (before, part, bytes([END]) * last)), np.uint8)
    sizes = np.array([len(part) + last for _, _, part, last in parts], np.int64)
    ends = np.cumsum(sizes + DEPTH)
    real = np.ones(len(line), bool)
    for shift in range(DEPTH):
        real[ends - sizes - DEPTH + shift] = False
    at = np.flatnonzero(real)
    keys = np.zeros(len(at), np.uint64)
    for shift in (*range(1, DEPTH + 1), 0):
        keys = (keys << np.uint64(8)) | line[at - shift]
    return keys, sizes


def words_of(texts: list[bytes]):
    """Lists of parts (number of the text, its words there) of about PIECE bytes together; an end is a word."""
    held, size = [], 0
    for number, text in enumerate(texts):
        start = 0
        while start <= len(text):
            cut = WHITE.search(text, start + PIECE) if start + PIECE < len(text) else None
            end = cut.start() if cut else len(text)
            if held and size + end - start > PIECE:
                yield held
                held, size = [], 0
            words = text[start:end].split()
            held.append((number, words if cut else [*words, WORD_END]))
            size += end - start
            start = end if cut else len(text) + 1
    if held:
        yield held


def packed_keys(keys) -> bytes:
    """Ascending numbers as differences, byte plane by byte plane: the high planes are almost all zero."""
    import numpy as np

    steps = np.diff(keys, prepend=np.uint64(0)).astype("<u8")
    return steps.view(np.uint8).reshape(-1, 8).T.tobytes()


def unpacked_keys(data: bytes):
    import numpy as np

    return np.cumsum(np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(8, -1).T).view("<u8").ravel(), dtype=np.uint64)


def packed_counts(counts) -> bytes:
    import numpy as np

    return counts.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def unpacked_counts(data: bytes):
    import numpy as np

    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(4, -1).T).view("<u4").ravel().astype(np.int64)


def shard_of(keys, kind: int, shards: int):
    import numpy as np

    if kind == STRINGS:
        keys = (keys >> np.uint64(8 * (DEPTH + 1 - TOP))) * np.uint64(0x9E3779B97F4A7C15)
    return ((keys >> np.uint64(32)) % np.uint64(shards)).astype(np.int32)


def hashes(words) -> list[int]:
    import xxhash

    return [xxhash.xxh64_intdigest(word) for word in words]


def dealt(batches):
    """The batches (doc_id, text) cut into slices of about BLOCK bytes: (block, slice)."""
    part, number, size = TaskContext.get().partitionId(), 0, 0
    for batch in batches:
        lengths = pa.compute.fill_null(pa.compute.binary_length(batch.column("text")), 0).to_pylist()
        start = 0
        for at, length in enumerate(lengths):
            if size and size + length > BLOCK:
                if at > start:
                    yield (part << 24) + number, batch.slice(start, at - start)
                number, size, start = number + 1, 0, at
            size += length
        if len(batch) > start:
            yield (part << 24) + number, batch.slice(start)


def with_blocks(docs: DataFrame) -> DataFrame:
    def add(batches):
        for block, rows in dealt(batches):
            yield pa.RecordBatch.from_arrays([pa.array([block] * len(rows), pa.int64()), *rows.columns], ["block", "doc_id", "text"])

    return docs.mapInArrow(add, "block bigint, doc_id bigint, text string")


def pack(kind: int, block: int, keys, values, shards: int):
    """A record batch with one row for each shard."""
    import numpy as np

    shard = shard_of(keys, kind, shards)
    order = np.lexsort((keys, shard))
    keys, values, shard = keys[order], values[order], shard[order]
    used, starts = np.unique(shard, return_index=True)
    ends = [*starts[1:], len(keys)]
    rows = [(kind, block, int(s), packed_keys(keys[a:b]), packed_counts(values[a:b])) for s, a, b in zip(used, starts, ends, strict=True)]
    columns = list(zip(*rows, strict=True)) or [()] * 5
    kinds = [pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["kind", "block", "shard", "keys", "values"])


def gather(docs: DataFrame, shards: int) -> DataFrame:
    """What every block has to ask: its strings and words, with their counts in its training texts."""

    def ask(batches):
        from collections import Counter

        import numpy as np
        import pandas as pd

        def close(block, texts, train):
            found = []
            for parts in stretches(texts):
                keys, sizes = strings_of(parts)
                codes, used = pd.factorize(keys)
                learned = np.repeat(np.array([train[number] for number, *_ in parts]), sizes)
                found.append((used, np.bincount(codes[learned], minlength=len(used))))
            used, inverse = np.unique(np.concatenate([keys for keys, _ in found]), return_inverse=True)
            counts = np.bincount(inverse, np.concatenate([counts for _, counts in found]), len(used)).astype(np.int64)
            yield pack(STRINGS, block, used, counts, shards)
            words, known = Counter(), Counter()
            for parts in words_of(texts):
                for number, own in parts:
                    (known if train[number] else words).update(own)
            words = list(dict.fromkeys([*known, *words]))
            counts = np.array([known[word] for word in words], np.int64)
            yield pack(WORDS, block, np.array(hashes(words), np.uint64), counts, shards)

        held, texts, train = None, [], []
        for block, rows in dealt(batches):
            if held is not None and block != held:
                yield from close(held, texts, train)
                texts, train = [], []
            held = block
            texts += [(data or b"").lower() for data in utf8(rows.column("text"))]
            train += [not is_held_out(number) for number in rows.column("doc_id").to_pylist()]
        if texts:
            yield from close(held, texts, train)

    return docs.mapInArrow(ask, PACKED)


def log_gamma(x):
    """For x of at least 1/2, by Stirling's series six steps higher; numbers, arrays and columns alike."""
    log = F.log if isinstance(x, Column) else _numpy().log
    y = x + 6
    below = x * (x + 1) * (x + 2) * (x + 3) * (x + 4) * (x + 5)
    series = 1 / (12 * y) - 1 / (360 * y * y * y) + 1 / (1260 * y * y * y * y * y)
    return (y - 0.5) * log(y) - y + 0.9189385332046727 + series - log(below)


def _numpy():
    import numpy

    return numpy


LOG_PI, LOG_2 = 1.1447298858494002, 0.6931471805599453


def log_block(zeros, ones):
    """Logarithm of the Krichevsky-Trofimov probability of a block with so many zeros and ones."""
    return log_gamma(zeros + 0.5) + log_gamma(ones + 0.5) - log_gamma(zeros + ones + 1.0) - LOG_PI


class Subtrees:
    """Contexts of TOP to DEPTH bytes of sorted distinct strings, for each of the eight choices of a byte."""

    def __init__(self, keys, counts):
        import numpy as np

        self.keys, self.inverse, tables = {DEPTH: keys}, {}, {DEPTH: counts.astype(float)}
        for depth in range(DEPTH - 1, TOP - 1, -1):
            longer = self.keys[depth + 1]
            shorter = ((longer >> np.uint64(16)) << np.uint64(8)) | (longer & np.uint64(255))
            self.keys[depth], self.inverse[depth] = np.unique(shorter, return_inverse=True)
            tables[depth] = np.bincount(self.inverse[depth], tables[depth + 1], len(self.keys[depth]))
        self.node, self.first, self.parent = {}, {}, {}
        self.n, self.n1, self.own, self.log = {}, {}, {}, {}
        for choice in range(8):
            for depth in range(DEPTH, TOP - 1, -1):
                name = self.keys[depth] >> np.uint64(8 - choice)
                new = np.append(True, name[1:] != name[:-1]) if len(name) else np.zeros(0, bool)
                at = depth, choice
                self.node[at], self.first[at] = np.cumsum(new) - 1, np.flatnonzero(new)
                size = len(self.first[at])
                ones = (self.keys[depth] >> np.uint64(7 - choice)) & np.uint64(1)
                self.n[at] = np.bincount(self.node[at], tables[depth], size)
                self.n1[at] = np.bincount(self.node[at], tables[depth] * ones, size)
                self.own[at] = log_block(self.n[at] - self.n1[at], self.n1[at])
                if depth == DEPTH:
                    self.log[at] = self.own[at]
                else:
                    below = depth + 1, choice
                    self.parent[below] = self.node[at][self.inverse[depth][self.first[below]]]
                    longer = np.bincount(self.parent[below], self.log[below], size)
                    self.log[at] = np.logaddexp(self.own[at], longer) - LOG_2

    def roots(self):
        """Arrays (context, place in a byte, zeros, ones, log-probability) of the contexts of TOP bytes."""
        import numpy as np

        out = []
        for choice in range(8):
            at = TOP, choice
            name = self.keys[TOP][self.first[at]] >> np.uint64(8 - choice)
            place = (name & np.uint64((1 << choice) - 1)) | np.uint64(1 << choice)
            out.append((name >> np.uint64(choice), place, self.n[at] - self.n1[at], self.n1[at], self.log[at]))
        return [np.concatenate(column) for column in zip(*out, strict=True)]

    def predict(self, above):
        """log10 probabilities of the last byte of each string, given (mixed, left, best) above each root."""
        import numpy as np

        total = np.zeros(len(self.keys[DEPTH]))
        for choice in range(8):
            mixed, left, best = above[choice]
            for depth in range(TOP, DEPTH + 1):
                at = depth, choice
                if depth > TOP:
                    mixed, left, best = (x[self.parent[at]] for x in (mixed, left, best))
                one = (self.n1[at] + 0.5) / (self.n[at] + 1)
                seen = self.n[at] > 0
                best = np.where(seen, mixed + left * one, best)
                weight = np.exp(self.own[at] - LOG_2 - self.log[at]) if depth < DEPTH else 1.0
                mixed = mixed + np.where(seen, left * weight * one, 0.0)
                left = left * np.where(seen, 1 - weight, 1.0)
            chance = best[self.node[DEPTH, choice]]
            ones = ((self.keys[DEPTH] >> np.uint64(7 - choice)) & np.uint64(1)).astype(bool)
            total += np.log10(np.where(ones, chance, 1 - chance))
        return total


def merged(rows: pa.Table):
    """Distinct keys of packed rows, ascending, their summed values, and for each row where its keys are."""
    import numpy as np

    keys = [unpacked_keys(data) for data in rows.column("keys").to_pylist()]
    values = np.concatenate([unpacked_counts(data) for data in rows.column("values").to_pylist()])
    used, inverse = np.unique(np.concatenate(keys), return_inverse=True)
    sums = np.bincount(inverse, values, len(used)).astype(np.int64)
    return used, sums, np.split(inverse, np.cumsum([len(part) for part in keys])[:-1])


def shard_roots(rows: pa.Table) -> pa.Table:
    used, sums, _ = merged(rows)
    context, place, zeros, ones, log = Subtrees(used, sums).roots()
    names = ["context", "place", "zeros", "ones", "log"]
    return pa.table([pa.array(context.astype("int64")), pa.array(place.astype("int32")), pa.array(zeros), pa.array(ones), pa.array(log)], names)


def answers(rows: pa.Table, places, values) -> pa.Table:
    """Packed rows for the blocks: their keys as they came, with a value for each."""
    packed = [values[place].tobytes() for place in places]
    return rows.select(["kind", "block", "shard", "keys"]).append_column("values", pa.array(packed, pa.binary()))


def shard_answers(rows: pa.Table, above: pa.Table) -> pa.Table:
    import numpy as np

    used, sums, places = merged(rows)
    tree = Subtrees(used, sums)
    context, place = above.column("context").to_numpy().astype(np.uint64), above.column("place").to_numpy().astype(np.uint64)
    order = np.lexsort((place, context))
    name = ((context << np.uint64(8)) | place)[order]
    state = [above.column(column).to_numpy()[order] for column in ("mixed", "left", "best")]
    found = []
    for choice in range(8):
        wanted = tree.keys[TOP][tree.first[TOP, choice]] >> np.uint64(8 - choice)
        bits = (wanted & np.uint64((1 << choice) - 1)) | np.uint64(1 << choice)
        at = np.searchsorted(name, ((wanted >> np.uint64(choice)) << np.uint64(8)) | bits)
        found.append([column[at] for column in state])
    return answers(rows, places, tree.predict(found).astype(np.float32))


def shard_words(rows: pa.Table) -> pa.Table:
    import numpy as np

    _, sums, places = merged(rows)
    totals = np.array([(sums > 0).sum(), sums.sum()], np.int64).tobytes()
    total = pa.table([pa.array([TOTALS], pa.int32()), pa.array([-1], pa.int64()), rows.column("shard").slice(0, 1), pa.array([b""]), pa.array([totals])], ["kind", "block", "shard", "keys", "values"])
    return pa.concat_tables([answers(rows, places, sums), total])


def predicted(level: DataFrame, above: DataFrame | None) -> DataFrame:
    """Adds (mixed, left, best): estimates of the contexts so far, what weight is left, and the best guess yet."""
    one = (F.col("ones") + 0.5) / (F.col("zeros") + F.col("ones") + 1)
    weight = F.exp(F.col("own") - LOG_2 - F.col("log"))
    if above is None:
        return level.select("context", "place", (weight * one).alias("mixed"), (1 - weight).alias("left"), one.alias("best"))
    seen = F.col("zeros") + F.col("ones") > 0
    above = above.withColumnRenamed("context", "shorter")
    level = level.withColumn("shorter", F.shiftright("context", 8)).join(above, ["shorter", "place"])
    mixed = F.when(seen, F.col("mixed") + F.col("left") * weight * one).otherwise(F.col("mixed"))
    left = F.when(seen, F.col("left") * (1 - weight)).otherwise(F.col("left"))
    best = F.when(seen, F.col("mixed") + F.col("left") * one).otherwise(F.col("best"))
    return level.select("context", "place", mixed.alias("mixed"), left.alias("left"), best.alias("best"))


def above_roots(roots: DataFrame) -> DataFrame:
    """Rows (context, place, mixed, left, best): what the contexts shorter than TOP bytes leave to each root."""
    levels, below = [], roots
    for depth in range(TOP - 1, -1, -1):
        level = below.groupBy(F.shiftright("context", 8).alias("context"), "place")
        level = level.agg(F.sum("zeros").alias("zeros"), F.sum("ones").alias("ones"), F.sum("log").alias("longer"))
        level = level.withColumn("own", log_block(F.col("zeros"), F.col("ones")))
        larger = F.greatest("own", "longer")
        level = level.withColumn("log", larger + F.log(F.exp(F.col("own") - larger) + F.exp(F.col("longer") - larger)) - LOG_2)
        below = written(level.drop("longer"), f"depth-{depth}")
        levels.append(below)
    state = None
    for level in reversed(levels):
        state = predicted(level, state)
    state = state.withColumnRenamed("context", "shorter")
    named = roots.select("context", "place", F.shiftright("context", 8).alias("shorter"))
    return named.join(state, ["shorter", "place"]).drop("shorter")


def score_block(texts: pa.Table, model: pa.Table, total: int, distinct: int) -> pa.Table:
    import numpy as np
    import pandas as pd

    def answered(kind: int, dtype):
        mine = model.filter(pa.compute.equal(model.column("kind"), kind))
        keys = np.concatenate([unpacked_keys(data) for data in mine.column("keys").to_pylist()])
        values = np.concatenate([np.frombuffer(data, dtype) for data in mine.column("values").to_pylist()])
        order = np.argsort(keys, kind="stable")
        return keys[order], values[order]

    def look_up(known, wanted):
        keys, values = known
        at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
        if (keys[at] != wanted).any():
            raise RuntimeError("a block asks for what it did not report")
        return values[at]

    if not len(texts):
        return pa.Table.from_batches([], SCORES_SCHEMA)
    numbers = texts.column("doc_id").to_pylist()
    data = [(value or b"").lower() for chunk in texts.column("text").chunks for value in utf8(chunk)]
    of_strings, of_words = answered(STRINGS, np.float32), answered(WORDS, np.int64)
    scores, bases = np.zeros(len(data)), [0.0] * len(data)
    tokens, knowns = [0] * len(data), [0] * len(data)
    for parts in stretches(data):
        keys, sizes = strings_of(parts)
        codes, used = pd.factorize(keys)
        logs = look_up(of_strings, used).astype(np.float64)[codes]
        np.add.at(scores, [number for number, *_ in parts], np.add.reduceat(logs, np.cumsum(sizes) - sizes))
        del keys, codes, logs
    for parts in words_of(data):
        distinct_words = list(dict.fromkeys(word for _, words in parts for word in words))
        counts = look_up(of_words, np.array(hashes(distinct_words), np.uint64))
        base = dict(zip(distinct_words, np.log10((counts + 1) / (total + distinct + 1)).tolist(), strict=True))
        known = dict(zip(distinct_words, (counts > 0).tolist(), strict=True))
        for number, words in parts:
            tokens[number] += len(words)
            bases[number] += sum(map(base.__getitem__, words))
            knowns[number] += sum(map(known.__getitem__, words))
    sizes = np.array([len(text) + 1 for text in data])
    rows = {
        "doc_id": pa.array(numbers, pa.int64()),
        "held_out": pa.array([is_held_out(number) for number in numbers], pa.bool_()),
        "n_tokens": pa.array(tokens, pa.int64()),
        "n_known": pa.array(knowns, pa.int64()),
        "train_tokens": pa.array([total] * len(data), pa.int64()),
        "base_score": pa.array(bases, pa.float64()),
        "score": pa.array(scores),
        "n_bytes": pa.array(sizes - 1),
        "bits_per_byte": pa.array(-scores * np.log2(10) / np.maximum(1, sizes - 1)),
    }
    return pa.table(rows)


def summed(rows: pa.Table) -> pa.Table:
    """Reports of one shard as one, under the number of their group."""
    used, sums, _ = merged(rows)
    columns = [rows.column("kind").slice(0, 1), rows.column("sum").slice(0, 1), rows.column("shard").slice(0, 1), pa.array([packed_keys(used)]), pa.array([packed_counts(sums)])]
    return pa.table(columns, ["kind", "block", "shard", "keys", "values"])


def passed_on(rows: pa.Table, sums: pa.Table) -> pa.Table:
    """The answers to a sum of reports as answers to these reports."""
    import numpy as np

    dtype = np.float32 if rows.column("kind")[0].as_py() == STRINGS else np.int64
    known, values = unpacked_keys(sums.column("keys")[0].as_py()), np.frombuffer(sums.column("values")[0].as_py(), dtype)
    places = [np.searchsorted(known, unpacked_keys(data)) for data in rows.column("keys").to_pylist()]
    return answers(rows, places, values)


def levels_of(asked: DataFrame) -> list[DataFrame]:
    """The reports, their sums, the sums of these and so on; but for the last, with the number `sum` of what they go into."""
    levels = []
    blocks = asked.select("block").distinct().count()
    while blocks > FAN:
        blocks = -(-blocks // FAN)
        asked = asked.withColumn("sum", F.pmod(F.xxhash64("block"), F.lit(blocks)))
        levels.append(asked)
        asked = written(asked.groupBy("kind", "shard", "sum").applyInArrow(summed, PACKED), "sums")
    return [*levels, asked]


def score(docs: DataFrame, text: str = "text", id: str = "doc_id") -> DataFrame:
    """Rows of SCORES, one for each document, by a model of the documents that are not held out."""
    docs = docs.select(F.col(id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    # Rows that come out of a shuffle come in any order; blocks have to be the same both times.
    docs = docs.sortWithinPartitions("doc_id", F.xxhash64("text"), "text")
    shards = min(MOST_SHARDS, max(LEAST_SHARDS, size // SHARD_BYTES))
    *below, asked = levels_of(written(gather(docs, shards), "asked"))
    strings, words = asked.where(F.col("kind") == STRINGS), asked.where(F.col("kind") == WORDS)
    roots = strings.groupBy("shard").applyInArrow(shard_roots, "context bigint, place int, zeros double, ones double, log double")
    roots = written(roots, "roots")
    above = above_roots(roots)
    above = above.withColumn("shard", shard_column(F.col("context"), shards))
    of_strings = strings.groupBy("shard").cogroup(above.groupBy("shard")).applyInArrow(shard_answers, PACKED)
    of_words = words.groupBy("shard").applyInArrow(shard_words, PACKED)
    model = written(of_strings.unionByName(of_words), "answers")

    # One row for each shard.
    totals = [row["values"] for row in model.where(F.col("kind") == TOTALS).select("values").collect()]
    distinct, total = (sum(int.from_bytes(data[8 * i : 8 * i + 8], "little") for data in totals) for i in range(2))
    model = model.where("block >= 0")
    for level in reversed(below):
        sums = model.withColumnRenamed("block", "sum").groupBy("kind", "shard", "sum")
        model = written(level.groupBy("kind", "shard", "sum").cogroup(sums).applyInArrow(passed_on, PACKED), "answers")
    blocks = with_blocks(docs).groupBy("block").cogroup(model.groupBy("block"))
    return blocks.applyInArrow(lambda texts, own: score_block(texts, own, total, distinct), SCORES)


def shard_column(context: Column, shards: int) -> Column:
    @F.arrow_udf("int")
    def of_contexts(contexts: pa.Array) -> pa.Array:
        import numpy as np

        keys = contexts.to_numpy(zero_copy_only=False).astype(np.uint64) << np.uint64(8 * (DEPTH + 1 - TOP))
        return pa.array(shard_of(keys, STRINGS, shards))

    return of_contexts(context)
