"""Token counts without token ids: pieces are counted once per distinct pre-token and summed over frequencies.

A SentencePiece BPE model writes spaces as a mark in front of a word, and none of its pieces has that mark behind
another character. So a text falls apart in front of every word into pre-tokens that are encoded alone: a word with the
spaces before it. The first word gets one more space, which the model adds itself.

1. Pre-tokens of all texts are counted, first per task, then per distinct pre-token, and the table is written.
2. Each distinct pre-token is given to the model once.
3. A histogram of the frequencies tells which are the most frequent `FREQUENT` pre-tokens. These alone are handed to
   the tasks (at most `FREQUENT` short strings, whatever the input). All others are joined by shuffle to the
   frequencies per document. The sums are exact either way.

Null texts count as empty and have no tokens. Repeated rows, and rows without id, are counted each for itself.
"""

from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailmark.llm.common import once_per_worker, strings, utf8
from trailmark.session import written

FREQUENT = 1 << 18
SHORT = 32  # characters of a pre-token that may be handed to all tasks
HELD = 300_000  # distinct pre-tokens a task holds before it passes its counts on
STEPS = 16  # steps of the frequency histogram in a doubling


def model(path: str):
    def load():
        import sentencepiece

        return sentencepiece.SentencePieceProcessor(model_file=path)

    return once_per_worker(f"pieces {path}", load)


def pretokens(text: str) -> list[str]:
    """The pre-tokens of a text, each without the one space that the model puts in front of any text.

    What is left of a single space at the end is an empty string.
    """
    if not text:
        return []
    parts = text.replace("▁", " ").split(" ")
    if "" not in parts:
        return parts
    out, spaces = [], 0
    for part in parts:
        if part:
            out.append(" " * spaces + part)
            spaces = 0
        else:
            spaces += 1
    if spaces:
        out.append(" " * (spaces - 1))
    return out


def count_pretokens(docs: DataFrame, text: str) -> DataFrame:
    """Rows (pretoken, n) of the whole table."""

    def count(batches):
        held = Counter()
        for batch in batches:
            for value in strings(batch.column(0)):
                held.update(pretokens(value or ""))
                if len(held) > HELD:
                    yield rows(held)
                    held.clear()
        yield rows(held)

    def rows(held):
        return pa.RecordBatch.from_arrays(
            [pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], ["pretoken", "n"]
        )

    counted = docs.select(F.col(text).alias("text")).mapInArrow(count, "pretoken string, n bigint")
    return counted.groupBy("pretoken").agg(F.sum("n").alias("n"))


def count_pieces(table: DataFrame, path: str) -> DataFrame:
    """The table of distinct pre-tokens with the number of pieces of each."""

    def count(batches):
        for batch in batches:
            words = batch.column("pretoken").to_pylist()
            pieces = [len(ids) for ids in model(path).encode(words, num_threads=1)]
            if "" in words:  # a single space at the end of a text, which cannot be encoded alone
                pieces[words.index("")] = len(model(path).encode("\n ")) - len(model(path).encode("\n"))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(pieces, pa.int64())], [*batch.schema.names, "pieces"])

    return table.mapInArrow(count, "pretoken string, n bigint, pieces bigint")


def least_frequent(table: DataFrame, frequent: int) -> int:
    """The smallest n such that at most `frequent` short pre-tokens occur n times or more."""
    step = F.floor(F.log2("n") * STEPS).alias("step")
    steps = table.where(F.length("pretoken") <= SHORT).groupBy(step).agg(F.count("*").alias("size"), F.min("n").alias("n"))
    total, least = 0, None
    for row in sorted(steps.collect(), key=lambda row: -row["step"]):  # at most 64 * STEPS rows
        total += row["size"]
        if total > frequent:
            break
        least = row["n"]
    return least if least is not None else 1 << 62


def count_tokens(docs: DataFrame, path: str, text: str = "text", id: str = "doc_id", frequent: int = FREQUENT) -> DataFrame:
    """Rows (doc_id, n_bytes, n_tokens): one for each row of `docs`."""
    table = written(count_pieces(count_pretokens(docs, text), path), "pretokens")
    least = least_frequent(table, frequent)
    is_known = (F.length("pretoken") <= SHORT) & (F.col("n") >= least)
    known = {row["pretoken"]: row["pieces"] for row in table.where(is_known).select("pretoken", "pieces").collect()}
    shared = docs.sparkSession.sparkContext.broadcast(known)

    @F.arrow_udf("struct<n_bytes bigint, known bigint, rest array<struct<pretoken string, n bigint>>>")
    def split(texts: pa.Array) -> pa.Array:
        pieces = shared.value
        sizes, sums, words, times, offsets = [], [], [], [], [0]
        for data, value in zip(utf8(texts), strings(texts), strict=True):
            sizes.append(len(data or b""))
            total = 0
            for word, n in Counter(pretokens(value or "")).items():
                of_word = pieces.get(word)
                if of_word is None:
                    words.append(word)
                    times.append(n)
                else:
                    total += n * of_word
            sums.append(total)
            offsets.append(len(words))
        rest = pa.StructArray.from_arrays([pa.array(words, pa.string()), pa.array(times, pa.int64())], ["pretoken", "n"])
        columns = [pa.array(sizes, pa.int64()), pa.array(sums, pa.int64()), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), rest)]
        return pa.StructArray.from_arrays(columns, ["n_bytes", "known", "rest"])

    # Written, so that the row numbers stay what they are.
    per_row = docs.select(F.col(id).alias("doc_id"), split(F.col(text)).alias("counts")).select(
        F.monotonically_increasing_id().alias("row"), "doc_id", "counts.*"
    )
    per_row = written(per_row, "frequencies")
    rest = per_row.select("row", F.inline("rest")).join(table.select("pretoken", "pieces"), "pretoken")
    sums = rest.select("row", (F.col("n") * F.col("pieces")).alias("tokens"))
    base = per_row.select("row", "doc_id", "n_bytes", F.col("known").alias("tokens"))
    return (
        base.unionByName(sums, allowMissingColumns=True)
        .groupBy("row")
        .agg(F.max("doc_id").alias("doc_id"), F.max("n_bytes").alias("n_bytes"), F.sum("tokens").alias("n_tokens"))
        .drop("row")
    )
