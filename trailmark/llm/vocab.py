"""Encoding by tokenizer libraries, one distinct word at a time.

Texts repeat their words, and no tokenizer here looks across the borders at which `split_spaces` and `split_words` cut.
So every worker keeps the ids of recent words and asks the library for new ones only. The memory is bounded: two
generations of at most `RECENT` words of at most `LONGEST` characters; anything else is encoded each time it comes.
"""

import re
from collections.abc import Callable

RECENT = 500_000
MARKS = ".,;:!?|"
LATIN_END = "\u0250"  # letters below are composed and have a lower case of their own
LONGEST = 48

# Characters that str.split() takes for white space and the tokenizers do not.
SEPARATORS = "\x1c\x1d\x1e\x1f"
UNICODE_SPACE = "\t\n\v\f\r \x85\xa0  -     　"
_WORD = re.compile(f"[^{UNICODE_SPACE}]+")

# The published pattern of the byte-level vocabulary.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

# White space beside a space, or white space other than space and line feed, needs the pattern itself.
_ODD = ("  ", "\n ", " \n")
_SPACE = re.compile(f"[{UNICODE_SPACE}]+")
LONG_SPACE = 100_000  # the pattern engine keeps a frame for each space of a run, which ends above 700,000
_RARE_SPACE = re.compile("[\t\v\f\r\x1c-\x1f\x85\xa0  -     　]")


class Recent(dict):
    """Word to value, made where missing, forgetting what was not asked for lately."""

    def __init__(self, make: Callable, limit: int = RECENT):
        self.make, self.limit, self.older = make, limit, {}

    def __missing__(self, word):
        value = self.older.get(word)
        if value is None:
            value = self.make(word)
        if len(word) <= LONGEST:
            if len(self) >= self.limit:
                self.older = dict(self)
                self.clear()
            self[word] = value
        return value


def split_words(text: str) -> list[str]:
    """Runs without white space, as the Unicode property White_Space has it."""
    if any(mark in text for mark in SEPARATORS):
        return _WORD.findall(text)
    return text.split()


def split_spaces(text: str) -> list[str] | None:
    """The text cut at its spaces, or None where a space stands beside other white space or space is of a rare kind.

    If not None, every space is a single one between words, and a byte-level pre-tokenizer begins a new piece at each.
    """
    if any(pair in text for pair in _ODD) or text.startswith(" ") or text.endswith(" ") or _RARE_SPACE.search(text):
        return None
    return text.split(" ")


def has_long_space(text: str) -> bool:
    return len(text) >= LONG_SPACE and any(run.end() - run.start() >= LONG_SPACE for run in _SPACE.finditer(text))


def simpler_words(word: str) -> tuple[str, ...] | None:
    """Words to encode instead of this one, for vocabularies of lower-case words cut into letters, digits and marks.

    A mark behind a letter or digit is a piece of its own, and of a Latin word only the lower case counts. None if the
    word is as simple as it gets.
    """
    if len(word) > 1 and word[-1] in MARKS and word[-2].lower().isalnum():
        return word[:-1], word[-1]
    if word.isascii() and word.isalpha() and not word.islower():
        return (word.lower(),)
    return None


def is_latin(word: str) -> bool:
    return word.isalpha() and max(word) < LATIN_END and "İ" not in word


def lowered(text: str) -> str:
    """The text in lower case where that is the same letter by letter, so that fewer words are different."""
    if "<|" in text:
        return text
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return text
    return text.lower()


class LowerWords:
    """Ids of texts in such a vocabulary, by the tokenizers library, as little-endian 32-bit integers."""

    def __init__(self, path: str):
        import numpy as np
        from tokenizers import Tokenizer

        from trailmark.llm.bpe import byte_alphabet

        library = Tokenizer.from_file(path)
        library.no_truncation()
        library.no_padding()
        model = library.model
        letters = {byte: letter for letter, byte in byte_alphabet().items()}

        def make(word: str) -> bytes:
            simpler = simpler_words(word)
            if simpler:
                return b"".join(self.recent[part] for part in simpler)
            if is_latin(word):  # normalizing and cutting would change its case only
                piece = "".join(map(letters.__getitem__, word.lower().encode()))
                return np.array([token.id for token in model.tokenize(piece)], "<u4").tobytes()
            return np.array(library.encode(word, add_special_tokens=False).ids, "<u4").tobytes()

        self.recent = Recent(make)

    def encode(self, text: str) -> bytes:
        return b"".join(map(self.recent.__getitem__, split_words(lowered(text))))


class SpacedWords:
    """Ids of texts in the byte-level vocabulary whose pieces begin with their space, as such integers.

    The ranks are those of the tokenizer file, used by the faster of the two libraries that read this vocabulary.
    Special tokens written in a text are found first, as its own library does. Texts with a very long run of white
    space go to that library, which does not walk through such a run with a pattern engine that backtracks.
    """

    def __init__(self, path: str):
        import json

        import numpy as np
        import tiktoken

        from trailmark.llm.bpe import byte_alphabet

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        alphabet = byte_alphabet()
        specials = {token["content"]: token["id"] for token in spec["added_tokens"]}
        ranks = {bytes(map(alphabet.__getitem__, name)): number for name, number in spec["model"]["vocab"].items() if name not in specials}
        coder = tiktoken.Encoding("words", pat_str=PIECES, mergeable_ranks=ranks, special_tokens={})
        self.specials = {name: np.array([number], "<u4").tobytes() for name, number in specials.items()}
        self.pattern = re.compile("(" + "|".join(map(re.escape, specials)) + ")")
        self.whole = lambda text: np.array(coder.encode_ordinary(text), "<u4").tobytes()
        self.library = None
        self.path = path
        # Smaller, for a worker may hold these beside the words of other stages.
        self.bare = Recent(lambda word: self.make("", word), RECENT // 5)
        self.after_space = Recent(lambda word: self.make(" ", word), RECENT // 2)
        self.line = self.whole("\n")

    def make(self, space: str, word: str) -> bytes:
        own = self.after_space if space else self.bare
        if "\n" in word:
            first, *rest = word.split("\n")
            if first and all(rest):
                return own[first] + b"".join(self.line + self.bare[part] for part in rest)
        elif len(word) > 1 and word[-1] in MARKS and word[-2].isalnum():
            return own[word[:-1]] + self.bare[word[-1]]
        return self.whole(space + word)

    def by_library(self, text: str) -> bytes:
        import numpy as np
        from tokenizers import Tokenizer

        if self.library is None:
            self.library = Tokenizer.from_file(self.path)
            self.library.no_truncation()
            self.library.no_padding()
        return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def encode(self, text: str) -> bytes:
        if has_long_space(text):
            return self.by_library(text)
        if "<|" in text:
            parts = self.pattern.split(text)
            return b"".join(self.specials[part] if part in self.specials else self.plain(part) for part in parts)
        return self.plain(text)

    def plain(self, text: str) -> bytes:
        words = split_spaces(text)
        if words is None or not text:
            return self.whole(text)
        return self.bare[words[0]] + b"".join(map(self.after_space.__getitem__, words[1:]))
