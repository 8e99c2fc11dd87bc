"""Quality rules by compression: texts that shrink too well are repetitive, texts that hardly shrink are noise.

A text is compressed with Zstandard as a whole and in fixed chunks of `CHUNK` bytes. A short text has little to refer
back to, so every ratio is judged by the limits for its own length. The text fails if the ratio of the whole is outside
its band, or if chunks with more than `CHUNK_SHARE` of the bytes are outside theirs.

Null texts count as empty. An empty text has the ratio 1 and no chunk, and is judged by the word rules alone (it fails
them). Texts of any length are taken whole.
"""

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailmark.llm.common import once_per_worker, utf8

CHUNK = 2048
CHUNK_SHARE = 0.25
LEVEL = 3

# Up to so many bytes: lowest and highest ratio of compressed to plain size. Running prose lies well inside.
BANDS = (
    (256, 0.38, 1.10),
    (512, 0.36, 0.92),
    (1024, 0.34, 0.84),
    (2048, 0.32, 0.78),
    (4096, 0.30, 0.74),
    (16384, 0.27, 0.72),
    (65536, 0.24, 0.70),
    (float("inf"), 0.20, 0.70),
)

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
SYMBOLS = b"#*$%&|<>"
SPACES = b" \t\n\v\f\r"

FIELDS = {
    "n_words": "bigint",
    "word_chars": "bigint",
    "n_symbols": "bigint",
    "n_dup_lines": "bigint",
    "n_repeat_words": "bigint",
    "base_failed": "boolean",
    "ratio": "double",
    "n_chunks": "bigint",
    "n_chunks_outside": "bigint",
    "kept": "boolean",
}
ARROW = {"bigint": pa.int64(), "boolean": pa.bool_(), "double": pa.float64()}
VERDICT = f"struct<{', '.join(f'{name} {kind}' for name, kind in FIELDS.items())}>"


def repeated_words(words: list[bytes], width: int = 3) -> int:
    """Number of words that lie in windows of `width` words found twice or more."""
    import numpy as np

    windows = len(words) - width + 1
    if windows < 2:
        return 0
    ids = {word: place for place, word in enumerate(dict.fromkeys(words))}
    at = np.fromiter(map(ids.__getitem__, words), np.int64, len(words))
    key = at[:windows]
    for shift in range(1, width):
        key = key * len(ids) + at[shift : shift + windows]
        if len(ids) ** width >= 2**63:  # keep keys small: number the windows seen so far
            key = np.unique(key, return_inverse=True)[1]
    ordered = np.sort(key)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(twice):
        return 0
    inside = np.zeros(len(words), bool)
    found = np.isin(key, twice)
    for shift in range(width):
        inside[shift : shift + windows] |= found
    return int(inside.sum())


def outside(ratio: float, size: int) -> bool:
    low, high = next((low, high) for most, low, high in BANDS if size <= most)
    return not low <= ratio <= high


def judge(data: bytes, compress) -> tuple:
    """All values of FIELDS for one text, in their order."""
    words = data.split()
    solid = data.translate(None, SPACES)
    symbols = len(data) - len(data.translate(None, SYMBOLS))
    lines = [line for line in data.split(b"\n") if line.strip()]
    repeats = repeated_words(words)
    failed = len(words) < MIN_WORDS or 100 * repeats > MAX_REPEAT_PERCENT * len(words)
    ratio = len(compress(data)) / len(data) if data else 1.0
    chunks, bad, bad_bytes = 0, 0, 0
    for start in range(0, len(data), CHUNK):
        chunk = data[start : start + CHUNK]
        chunks += 1
        if outside(len(compress(chunk)) / len(chunk), len(chunk)):
            bad += 1
            bad_bytes += len(chunk)
    kept = not failed and not outside(ratio, len(data)) and bad_bytes <= CHUNK_SHARE * len(data)
    return (
        len(words),
        len(solid.decode("utf-8", "replace")),
        symbols,
        len(lines) - len(set(lines)),
        repeats,
        failed,
        ratio,
        chunks,
        bad,
        kept,
    )


def compression_verdict(text: Column) -> Column:
    """A struct of word counts, ratios and the verdict `kept` for every text."""

    @F.arrow_udf(VERDICT)
    def verdict(texts: pa.Array) -> pa.Array:
        import zstandard

        compress = once_per_worker("zstd", lambda: zstandard.ZstdCompressor(level=LEVEL)).compress
        rows = [judge(data or b"", compress) for data in utf8(texts)]
        columns = list(zip(*rows, strict=True)) or [()] * len(FIELDS)
        arrays = [pa.array(column, ARROW[kind]) for column, kind in zip(columns, FIELDS.values(), strict=True)]
        return pa.StructArray.from_arrays(arrays, list(FIELDS))

    return verdict(text)


def judge_documents(docs: DataFrame, text: str = "text") -> DataFrame:
    """The documents with one more column `compression`, the struct of `compression_verdict`.

    All other columns stay as they are, also where a document is repeated or its id is null. A column of that name is
    replaced.
    """
    return docs.withColumn("compression", compression_verdict(F.col(text)))


def keep_documents(docs: DataFrame, text: str = "text") -> DataFrame:
    """The documents that pass, with the columns they came with."""
    return docs.where(compression_verdict(F.col(text)).getField("kept"))
