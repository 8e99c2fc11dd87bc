"""Operators on texts one by one, against the libraries and plain Python."""

import hashlib
import struct
import zlib

import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from trailmark.llm import bpe, compression, packing, tokencount, tokenfile
from trailmark.session import work_folder

FOLDER = "/root/testdata/sf0.001"
WORDS, BYTES, PIECES = (public_tokenizers.path(n) for n in ("word_bpe_49k.json", "byte_bpe_50k.json", "piece_bpe_32k.model"))
ODD = [
    None,
    "",
    " ",
    "\n\n \t",
    "a",
    "Two  spaces,   three.",
    " leading and trailing ",
    "line\nline\nline\n\nend \n x",
    "<|endoftext|> in <|startoftext|>text<|endoftext|>",
    "don't they'll 'S \x1c\x1f x\x85y\xa0z w",
    "İSTANBUL İ. Straße é é Σίσυφος ½ 123 4",
    "日本語のテキスト 😀😀 한국어",
    "x" * 3000,
    "ababab " * 4000,
    "▁mark ▁▁ marks",
    "the cat sat on the mat " * 10,
]


@pytest.fixture(scope="module")
def docs(spark):
    """Odd and given texts, rows without id, rows twice, and columns named like those the operators make."""
    texts = ODD + [row["text"] for row in spark.read.parquet(f"{FOLDER}/documents.parquet").limit(60).collect()]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, "no id at all"), (3, "\n\n \t"), (3, "\n\n \t")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    for name in ("row", "length", "n", "part", "tokens", "node", "key", "pretoken"):
        df = df.withColumn(name, F.lit("other"))
    return df


def pairs(df, *names):
    return sorted((tuple(row[n] for n in names) for row in df.collect()), key=repr)


def texts_of(docs):
    return [(row["doc_id"], row["text"] or "") for row in docs.select("doc_id", "text").collect()]


def test_bpe(docs):
    library, want = Tokenizer.from_file(WORDS), []
    for number, text in texts_of(docs):
        ids = library.encode(text, add_special_tokens=False).ids
        data = struct.pack(f"<{len(ids)}I", *ids)
        plain = library.decode(ids, skip_special_tokens=False).encode()
        want.append((number, len(ids), hashlib.sha256(data).hexdigest(), hashlib.sha256(plain).hexdigest()))
    got = bpe.digests(docs, WORDS).select("doc_id", "digests.*")
    assert pairs(got, "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == sorted(want, key=repr)
    both = bpe.encode_decode(docs, WORDS).select("text", "encoded.*").collect()
    for row in both:
        ids = library.encode(row["text"] or "", add_special_tokens=False).ids
        assert row["ids"] == ids and row["decoded"] == library.decode(ids, skip_special_tokens=False)


def test_bpe_of_random_words():
    import random

    draw, tool, library = random.Random(5), bpe.Codec(WORDS), Tokenizer.from_file(WORDS)
    for _ in range(3000):
        word = "".join(draw.choice("aeinorst'.0é|<>́Σİ") for _ in range(draw.randint(1, 24)))
        ids = library.encode(word, add_special_tokens=False).ids
        assert tool.encode(word) == struct.pack(f"<{len(ids)}I", *ids), word


def test_every_token_is_reachable():
    assert all(map(bpe.Codec(WORDS).words.reachable, range(49406)))


def rules(text):
    """The word rules in plain Python."""
    data = text.encode()
    words = data.split()
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    inside = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(3)} if len(words) < 400 else None
    lines = [line for line in data.split(b"\n") if line.split()]
    seen, repeated = set(), 0
    for line in lines:
        repeated += line in seen
        seen.add(line)
    symbols = sum(text.count(c) for c in "#*$%&|<>")
    return len(words), sum(len(w.decode()) for w in words), symbols, repeated, None if inside is None else len(inside)


def test_compression(docs):
    got = compression.judge_documents(docs).select("text", "compression.*").collect()
    assert len(got) == docs.count()
    for row in got:
        *plain, repeats = rules(row["text"] or "")
        assert [row[n] for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines")] == plain
        if repeats is not None:
            assert row["n_repeat_words"] == repeats
        assert row["base_failed"] == (row["n_words"] < 50 or 100 * row["n_repeat_words"] > 50 * row["n_words"])
        assert not (row["kept"] and row["base_failed"])


def test_compression_bands(spark):
    import random

    draw = random.Random(1)
    letters = "abcdefghijklmnopqrstuvwxyz"
    lexicon = ["".join(draw.choice(letters) for _ in range(draw.randint(2, 9))) for _ in range(3000)]
    prose = " ".join(draw.choice(lexicon) for _ in range(400))
    noise = " ".join("".join(chr(draw.randint(33, 126)) for _ in range(9)) for _ in range(400))
    wide = " ".join(chr(0x4E00 + draw.randint(0, 20000)) for _ in range(400))
    varied = " ".join(f"the same words over and over {draw.choice('abcd')}" for _ in range(200))
    half = prose + " " + " ".join(["x y z w v"] * 600)
    rows = [("prose", prose), ("noise", noise), ("varied", varied), ("half", half), ("wide", wide)]
    df = spark.createDataFrame(rows, "name string, text string")
    kept = {row["name"] for row in compression.keep_documents(df).collect()}
    assert "prose" in kept and not kept & {"noise", "varied", "half"}
    assert compression.keep_documents(df).columns == df.columns


def test_token_counts(docs):
    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    want = sorted(((n, len(t.encode()), len(library.encode(t))) for n, t in texts_of(docs)), key=repr)
    assert pairs(tokencount.count_tokens(docs, PIECES), "doc_id", "n_bytes", "n_tokens") == want
    # With almost no pre-token handed out, all others go through the join.
    assert pairs(tokencount.count_tokens(docs, PIECES, frequent=5), "doc_id", "n_bytes", "n_tokens") == want


def test_no_piece_crosses_a_space():
    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    pieces = [library.id_to_piece(i) for i in range(library.get_piece_size())]
    assert not [p for p in pieces if "▁" in p.lstrip("▁")]


def test_token_file(spark, docs):
    library, path = Tokenizer.from_file(WORDS), work_folder(spark, "test-tokens")
    tokenfile.write_tokens(docs, path, WORDS, end=2)
    rows = tokenfile.read_tokens(spark, path).withColumn("crc", tokenfile.ids_crc32(F.col("tokens"))).collect()
    want = sorted(texts_of(docs), key=lambda row: (row[0] is not None, row[0] or 0, row[1]))
    rows.sort(key=lambda row: row["start"])
    at = 0
    assert [row["doc_id"] for row in rows] == [number for number, _ in want]
    for row, (_, text) in zip(rows, want, strict=True):
        ids = [*library.encode(text, add_special_tokens=False).ids, 2]
        if row["doc_id"] != 3:  # texts of equal ids are ordered, but null and empty ones are not told apart here
            assert row["tokens"] == ids
        assert row["start"] == at and row["n_tokens"] == len(row["tokens"])
        assert row["crc"] == zlib.crc32(struct.pack(f"<{len(row['tokens'])}I", *row["tokens"]))
        at += row["n_tokens"]


def test_token_file_layout(spark):
    import glob

    import pyarrow.parquet as pq

    path = work_folder(spark, "test-layout")
    tokenfile.write_tokens(spark.read.parquet(f"{FOLDER}/documents.parquet"), path, WORDS, end=2)
    file = pq.ParquetFile(max(glob.glob(f"{path.removeprefix('file:')}/*.parquet"), key=lambda name: len(open(name, "rb").read())))
    group = file.metadata.row_group(0)
    columns = {group.column(i).path_in_schema: group.column(i) for i in range(group.num_columns)}
    assert "DELTA_BINARY_PACKED" in columns["doc_id"].encodings
    assert "RLE_DICTIONARY" in columns["tokens.list.element"].encodings
    assert all(column.has_column_index and column.has_offset_index for column in columns.values())
    plan = tokenfile.read_tokens(spark, path).where("doc_id = 7").select("doc_id", "start")._jdf.queryExecution().toString()
    assert "tokens:array" not in plan.split("== Physical Plan ==")[1] and "EqualTo(doc_id,7)" in plan


def packed(spark, docs, window=1024):
    rows = packing.pack(docs, BYTES, window=window).collect()
    by_sequence, by_document = {}, {}
    for row in rows:
        by_sequence.setdefault(row["sequence_id"], []).append(row)
        by_document.setdefault((row["doc_id"], row["doc_tokens"]), []).append(row)
    for members in by_sequence.values():
        at = 0
        for row in sorted(members, key=lambda row: row["offset"]):
            assert row["offset"] == at and row["length"] > 0
            at += row["length"]
        assert at <= window
    return rows, by_sequence, by_document


def test_packing(spark, docs):
    from collections import Counter

    library, want = Tokenizer.from_file(BYTES), Counter()
    for number, text in texts_of(docs):
        ids = [*library.encode(text, add_special_tokens=False).ids, 0]
        for at in range(0, len(ids), 1024):
            piece = ids[at : at + 1024]
            want[number, at, len(piece), zlib.crc32(struct.pack(f"<{len(piece)}I", *piece)), len(ids)] += 1
    rows, _, _ = packed(spark, docs)
    assert Counter((r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in rows) == want


def test_packing_leaves_little_padding(spark):
    _, by_sequence, _ = packed(spark, spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))
    sizes = [sum(row["length"] for row in members) for members in by_sequence.values()]
    padding = sum(0 if size & (size - 1) == 0 else 1024 - size for size in sizes)
    assert padding < 0.01 * sum(sizes)


def test_patterns_use_up_the_histogram():
    import numpy as np

    for seed in range(4):
        counts = np.random.default_rng(seed).integers(0, 40, 65)
        counts[[0, 64]] = 0
        counts[37] = 5000 * (seed == 3)
        used = np.zeros(65, int)
        for lengths, times in packing.patterns(counts, 64):
            assert sum(lengths) <= 64
            for length in lengths:
                used[length] += times
        assert (used == counts).all()
    assert packing.patterns(np.zeros(65, int), 64) == []


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id bigint, text string")
    assert bpe.digests(none, WORDS).count() == 0
    assert compression.judge_documents(none).count() == 0
    assert tokencount.count_tokens(none, PIECES).count() == 0
    assert packing.pack(none, BYTES).count() == 0
    path = work_folder(spark, "test-none")
    tokenfile.write_tokens(none, path, WORDS, end=2)
    assert tokenfile.read_tokens(spark, path).count() == 0
