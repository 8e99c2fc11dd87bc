"""Exact byte-pair encoding in linear time by backtracking, and decoding by an offset table.

Merging pairs in the order of their ranks is the definition of the encoding. The same ids come out left to right: take
the longest token that matches at a position, go on behind it, and step back to a shorter token when nothing fits. Two
neighbours fit if merging their texts together would leave the border between them alone. This depends on the two
tokens only: along the right edge of the first and the left edge of the second, no merge over the border may be due
while both of its parts exist. The encoding is the one sequence in which all neighbours fit.

Matches come from an Aho-Corasick automaton over the vocabulary; shorter tokens at the same place from a table of the
longest proper prefix of each token; answers about pairs are kept in a table with a bounded number of entries. A border
from which nothing fits is closed and never tried again, so each token at each place is tried once.

The tokenizer file is the public JSON form: a vocabulary, merges in order of rank, an end-of-word suffix or none.
Normalizing and cutting into words are the library's own, on one distinct word at a time. Null texts count as empty;
empty texts have no ids; special tokens written in a text are found as the library finds them.
"""

import hashlib
import json
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailmark.llm.common import once_per_worker, strings
from trailmark.llm.vocab import Recent, is_latin, simpler_words, split_words

PAIRS = 2_000_000  # answers about pairs kept at a time
ENCODED = "struct<ids array<int>, decoded string>"
DIGESTS = "struct<n_tokens bigint, ids_sha256 string, decoded_sha256 string>"


def byte_alphabet() -> dict[str, int]:
    """The printable stand-ins of byte-level vocabularies: visible Latin-1 for itself, the rest from U+0100 on."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [byte for byte in range(256) if byte not in set(visible)]
    return {chr(byte): byte for byte in visible} | {chr(256 + place): byte for place, byte in enumerate(hidden)}


class Backtracking:
    """Encoder of single words, given as strings of symbols: a byte, or 256 plus a byte at the end of a word."""

    def __init__(self, spec: dict):
        import ahocorasick

        model = spec["model"]
        self.suffix = model.get("end_of_word_suffix") or ""
        self.alphabet = byte_alphabet()
        self.symbols = {}
        specials = {token["content"] for token in spec["added_tokens"]}
        ids = {name: number for name, number in model["vocab"].items() if name not in specials}
        self.length = {}
        by_text = {}
        for name, number in ids.items():
            text = self.symbols_of(name)
            if text is not None and text not in by_text:
                by_text[text] = number
                self.length[number] = len(text)
        self.rank, self.merged, self.parts, self.edges = {}, {}, {}, ({}, {})
        for rank, pair in enumerate(model["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            whole = ids[left + right]
            self.merged.setdefault(ids[left], {}).setdefault(ids[right], rank)
            if whole not in self.parts:
                self.parts[whole], self.rank[whole] = (ids[left], ids[right]), rank
        # A token that merging its own text would not give never appears.
        live = {text: number for text, number in by_text.items() if self.reachable(number)}
        self.matches = ahocorasick.Automaton()
        for text, number in live.items():
            self.matches.add_word(text, (len(text), number))
        self.matches.make_automaton()
        self.shorter = {}
        for text, number in live.items():
            cut = next((cut for cut in range(len(text) - 1, 0, -1) if text[:cut] in live), 0)
            self.shorter[number] = live[text[:cut]] if cut else None
        self.fits = {}

    def symbols_of(self, name: str, word: bool = False) -> str | None:
        """A vocabulary entry, or with `word` a whole word in the byte alphabet, in symbols."""
        end = word and bool(self.suffix)
        if not word and self.suffix and name.endswith(self.suffix) and name != self.suffix:
            name, end = name[: -len(self.suffix)], True
        try:
            codes = [self.alphabet[c] for c in name]
        except KeyError:
            return None
        if end and codes:
            codes[-1] += 256
        return "".join(map(chr, codes)) or None

    def edge(self, token: int, side: int) -> tuple[tuple[int, float], ...]:
        """The tokens inside a token along one edge, largest first, each with the rank at which it is merged away."""
        known = self.edges[side].get(token)
        if known is None:
            known = ()
            if token in self.parts:
                inner = self.parts[token][side]
                known = ((inner, self.rank[token]), *self.edge(inner, side))
            self.edges[side][token] = known
        return known

    def crossed(self, left: int, right: int, last: float) -> bool:
        """If a merge over the border comes before rank `last` while both its parts exist. Of equal merges the left is first."""
        merged, right_edge = self.merged, ((right, last), *self.edge(right, 0))
        for a, a_until in ((left, last), *self.edge(left, 1)):
            after = merged.get(a)
            if after:
                for b, b_until in right_edge:
                    rank = after.get(b)
                    if rank is not None and rank < last and rank < a_until and rank <= b_until:
                        return True
        return False

    def reachable(self, token: int) -> bool:
        while token in self.parts:
            left, right = self.parts[token]
            if self.crossed(left, right, self.rank[token]) or not self.reachable(right):
                return False
            token = left
        return True

    def compatible(self, left: int, right: int) -> bool:
        answer = self.fits.get((left, right))
        if answer is None:
            if len(self.fits) >= PAIRS:
                self.fits.clear()
            answer = self.fits[left, right] = not self.crossed(left, right, float("inf"))
        return answer

    def encode(self, text: str) -> list[int]:
        if not text:
            return []
        longest = [(0, None)] * len(text)
        for end, (size, number) in self.matches.iter(text):
            start = end + 1 - size
            if size > longest[start][0]:
                longest[start] = (size, number)
        out, closed, at, token = [], bytearray(len(text) + 1), 0, longest[0][1]
        while True:
            while token is not None:
                end = at + self.length[token]
                if not closed[end] and (not out or self.compatible(out[-1], token)):
                    break
                token = self.shorter[token]
            if token is None:
                if not out:
                    raise ValueError("no sequence of tokens fits")
                closed[at] = 1
                token = out.pop()
                at -= self.length[token]
                continue
            out.append(token)
            at = end
            if at == len(text):
                return out
            token = longest[at][1]


class Codec:
    """Encodes and decodes whole texts with a tokenizer file."""

    def __init__(self, path: str):
        import numpy as np
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        self.words = Backtracking(spec)
        library = Tokenizer.from_file(path)
        self.normalizer, self.cutter = library.normalizer, library.pre_tokenizer
        kinds = [step["type"] for step in (spec["normalizer"] or {}).get("normalizers", [])]
        self.lower = "Lowercase" in kinds and "NFC" in kinds and bool(self.words.suffix)
        specials = {token["content"]: token["id"] for token in spec["added_tokens"]}
        self.specials = {name: np.array([number], "<u4").tobytes() for name, number in specials.items()}
        self.pattern = re.compile("(" + "|".join(map(re.escape, specials)) + ")") if specials else None
        self.recent = Recent(self.encode_word)
        # Tokens one after another, each with the space that decoding puts between them, and where each begins.
        names = {number: name for name, number in (spec["model"]["vocab"] | specials).items()}
        entries = [(names.get(number, "") + " ").encode() for number in range(max(names) + 1)]
        self.starts = np.cumsum([0, *map(len, entries)])
        self.entries = np.frombuffer(b"".join(entries), np.uint8)

    def encode_word(self, word: str) -> bytes:
        """Ids of a run without white space, as little-endian 32-bit integers.

        Latin words with or without a mark behind them need no normalizing: the mark is a piece of its own, and lower
        case is all that changes.
        """
        import numpy as np

        simpler = simpler_words(word) if self.lower else None
        if simpler:
            return b"".join(self.recent[part] for part in simpler)
        if self.lower and is_latin(word):
            data = word.lower().encode()
            return np.array(self.words.encode(data[:-1].decode("latin-1") + chr(256 + data[-1])), "<u4").tobytes()
        out = []
        for part in self.pattern.split(word) if self.pattern and "<|" in word else [word]:
            if part in self.specials:
                out.append(self.specials[part])
                continue
            plain = self.normalizer.normalize_str(part) if self.normalizer else part
            for piece, _ in self.cutter.pre_tokenize_str(plain):
                ids = self.words.encode(self.words.symbols_of(piece, word=True) or "")
                out.append(np.array(ids, "<u4").tobytes())
        return b"".join(out)

    def encode(self, text: str) -> bytes:
        return b"".join(map(self.recent.__getitem__, split_words(text)))

    def decode(self, ids: bytes) -> bytes:
        """The text of the ids in UTF-8: every token looked up by its offset, all at once."""
        import numpy as np

        numbers = np.frombuffer(ids, "<u4").astype(np.int64)
        if not len(numbers):
            return b""
        begin, size = self.starts[numbers], self.starts[numbers + 1] - self.starts[numbers]
        ends = np.cumsum(size)
        places = np.arange(ends[-1]) + np.repeat(begin - (ends - size), size)
        return self.entries[places].tobytes()[:-1]


def codec(path: str) -> Codec:
    return once_per_worker(f"codec {path}", lambda: Codec(path))


def encode_decode(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """The documents with one more column `encoded`: the ids of the text and the text decoded from them."""

    @F.arrow_udf(ENCODED)
    def encoded(texts: pa.Array) -> pa.Array:
        import numpy as np

        tool = codec(path)
        ids = [tool.encode(value or "") for value in strings(texts)]
        flat = pa.array(np.frombuffer(b"".join(ids), "<i4"))
        offsets = pa.array(np.cumsum([0, *(len(x) // 4 for x in ids)]), pa.int32())
        decoded = pa.array([tool.decode(x) for x in ids], pa.binary()).cast(pa.string())
        return pa.StructArray.from_arrays([pa.ListArray.from_arrays(offsets, flat), decoded], ["ids", "decoded"])

    return docs.withColumn("encoded", encoded(F.col(text)))


def digests(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """The documents with one more column `digests`: the number of ids, and SHA-256 of ids and of the decoded text.

    Ids and decoded texts stay in the worker, for they are larger than the texts.
    """

    @F.arrow_udf(DIGESTS)
    def digest(texts: pa.Array) -> pa.Array:
        tool = codec(path)
        counts, of_ids, of_texts = [], [], []
        for value in strings(texts):
            ids = tool.encode(value or "")
            counts.append(len(ids) // 4)
            of_ids.append(hashlib.sha256(ids).hexdigest())
            of_texts.append(hashlib.sha256(tool.decode(ids)).hexdigest())
        columns = [pa.array(counts, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_texts, pa.string())]
        return pa.StructArray.from_arrays(columns, ["n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.withColumn("digests", digest(F.col(text)))
