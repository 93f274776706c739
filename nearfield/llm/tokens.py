"""Token ids as little-endian bytes, by the tokenizers library."""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from nearfield.llm.recent import Recent, held

END_ID = 2
#: Words of a generation of a cache of encoded words. It bounds a worker's memory only.
CACHE_ENTRIES = 250_000


#: Letters, then ASCII marks: under a byte-level tokenizer's word pattern the letters are one piece, with a blank before them or not, and the marks another.
_PLAIN = re.compile("([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]+)([!#$%&()*+,./:;<=>?@\\[\\]^_`{|}~-]*)")


_OTHER_SPACE, _DOUBLE = re.compile(r"[^\S \n]"), ("  ", "\n\n", " \n", "\n ")


def _byte_letters() -> dict[int, str]:
    """The printable letter that byte-level vocabularies write for each byte."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + k) for k, b in enumerate(rest)}


class _Words(Recent):
    """Ids of a word, with what stands before it; a miss is encoded by the tokenizer."""

    def __init__(self, tokenizer, before: str, marks: dict[str, bytes]):
        super().__init__(CACHE_ENTRIES)
        self.tokenizer, self.before, self.marks, self.letters = tokenizer, before, marks, _byte_letters()

    def make(self, word: str) -> bytes:
        if (plain := _PLAIN.fullmatch(word)) is None:
            return _bytes(self.tokenizer.encode(self.before + word, add_special_tokens=False).ids)
        if plain[2]:
            if plain[2] not in self.marks:
                if len(self.marks) > 10_000:
                    self.marks.clear()
                self.marks[plain[2]] = _bytes(self.tokenizer.encode(plain[2], add_special_tokens=False).ids)
            return self[plain[1]] + self.marks[plain[2]]
        piece = (self.before + word).encode().decode("latin-1").translate(self.letters)
        return _bytes([token.id for token in self.tokenizer.model.tokenize(piece)])


def _bytes(ids: list[int]) -> bytes:
    return array("I", ids).tobytes()


class _Lengths(_Words):
    """The number of a word's ids."""

    def make(self, word: str) -> int:
        if (plain := _PLAIN.fullmatch(word)) is None or not plain[2]:
            return len(super().make(word)) // 4
        if plain[2] not in self.marks:
            if len(self.marks) > 10_000:
                self.marks.clear()
            self.marks[plain[2]] = self.tokenizer.encode(plain[2], add_special_tokens=False).ids
        return self[plain[1]] + len(self.marks[plain[2]])


class Encoder:
    """Encodes whole texts to the ids that ``Tokenizer.encode(text, add_special_tokens=False)`` gives.

    A byte-level tokenizer with its own word pattern never joins what a single blank or line feed
    separates, so a text in which these never stand beside other white space is encoded word by
    word from a cache. Any other text, one that spells a special token, and any text under another
    kind of tokenizer is encoded as one piece.
    """

    def __init__(self, path: str, counts: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        kind = repr(self.tokenizer.pre_tokenizer)
        self.by_word = kind.startswith("ByteLevel(") and "add_prefix_space=False" in kind and "use_regex=True" in kind and self.tokenizer.normalizer is None
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        marks: dict[str, bytes] = {}
        words = _Lengths if counts else _Words
        self.first, self.rest = words(self.tokenizer, "", marks), words(self.tokenizer, " ", marks)
        self.feed = self._encode("\n")
        self.vocabulary = self.tokenizer.get_vocab_size()

    def _encode(self, text: str) -> bytes:
        return _bytes(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def _whole(self, text: str) -> bool:
        return not self.by_word or bool(_OTHER_SPACE.search(text)) or any(x in text for x in _DOUBLE) or text[-1] in " \n" or any(x in text for x in self.added)

    def count(self, text: str) -> int:
        """The number of ids, by an encoder that was made with ``counts``."""
        if not text:
            return 0
        if self._whole(text):
            return len(self._encode(text)) // 4
        n, rest, lines = 0, self.rest.__getitem__, text.split("\n")
        for line in lines:
            head, *words = line.split(" ")
            n += (self.first[head] if head else 0) + sum(map(rest, words))
        return n + (len(lines) - 1) * (len(self.feed) // 4)

    def encode(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        if self._whole(text):
            return self._encode(text)
        lines, rest = [], self.rest.__getitem__
        for line in text.split("\n"):
            head, *words = line.split(" ")
            lines.append((self.first[head] if head else b"") + b"".join(map(rest, words)))
        return self.feed.join(lines)


def token_counts(path: str, end: int = 1) -> Callable[[Column], Column]:
    """A function of a text column: its tokens and ``end`` more for the ids that end a document; a null text counts as empty."""

    @F.pandas_udf("long")
    def count(texts: pd.Series) -> pd.Series:
        code = held(f"counter {path}", lambda: Encoder(path, counts=True))
        return pd.Series([code.count(t) + end if t else end for t in texts], dtype="int64")

    return lambda text: count(text.cast("string"))


def encoder(path: str) -> Encoder:
    """One encoder for each file and Python worker, so that its cache serves all tasks of the worker."""
    return held(f"encoder {path}", lambda: Encoder(path))


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")
