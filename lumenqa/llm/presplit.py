"""The words that a word-BPE tokenizer file splits texts into, and a two-generation cache of what becomes of them.

ASCII and Latin texts are lower-cased and split here; a text with other characters, or not in composed form,
goes through the file's own normaliser and pre-tokenizer in the tokenizers library. Special tokens written out in a
text are tokens, as the library has it.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator
from functools import cache

from tokenizers import Tokenizer

ASCII = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\t-\r a-z0-9]+")


def latin_pattern() -> re.Pattern:
    """The same for characters below U+0250 in lower case: letters, numbers and white space by their Unicode categories."""
    known = sorted({c for i in range(0x250) for c in chr(i).lower()})
    kinds = {k: "".join(re.escape(c) for c in known if unicodedata.category(c)[0] == k) for k in "LN"}
    space = "\\t-\\r \x85\xa0"
    return re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{kinds['L']}]+|[{kinds['N']}]|[^{space}{kinds['L']}{kinds['N']}]+")


LATIN = latin_pattern()
BEYOND = re.compile("[^\x00-ɏ]")


@cache
def byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte in byte-level vocabularies: itself if printable, else 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in printable]
    return {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(rest)}


@cache
def letter_bytes() -> dict[str, int]:
    return {c: b for b, c in byte_letters().items()}


class Splitter:
    """Pre-splits texts as the tokenizer at ``path`` does."""

    def __init__(self, path: str):
        self.library = Tokenizer.from_file(path)
        added = self.library.get_added_tokens_decoder()
        self.special = {t.content: i for i, t in added.items()}
        self.marks = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None

    def words(self, text: str) -> list[str]:
        """The words of a stretch without special tokens."""
        if text.isascii():
            return ASCII.findall(text.lower())
        if not BEYOND.search(text) and unicodedata.is_normalized("NFC", text):
            return LATIN.findall(text.lower())
        pieces = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(text))
        back = letter_bytes()
        return [bytes(back[c] for c in piece).decode("utf-8", "surrogateescape") for piece, _ in pieces]

    def stretches(self, text: str) -> Iterator[tuple[str | None, list[str]]]:
        """(special token, words after it) in order; the first has no special token."""
        if self.marks is None or "<" not in text:
            yield None, self.words(text)
            return
        parts = self.marks.split(text)
        yield None, self.words(parts[0]) if parts[0] else []
        for mark, rest in zip(parts[1::2], parts[2::2], strict=True):
            yield mark, self.words(rest) if rest else []


class Cache(dict):
    """Entries by word, made on demand; of two generations the older goes when the younger is full."""

    def __init__(self, make: Callable[[str], object], limit: int = 120_000):
        super().__init__()
        self.make, self.limit, self.older = make, limit, {}

    def __missing__(self, word: str):
        found = self.older.get(word)
        if found is None:
            found = self.make(word)
        if len(self) >= self.limit:
            self.older = dict(self)
            self.clear()
        self[word] = found
        return found
