"""Encoders of the public vocabularies that keep what they know of recent words, within a fixed bound.

The library's own encode() is the source of every entry; texts are cut only at
white space, where these vocabularies never join, so that a text's ids are those
of its pieces one after the other.
"""

from __future__ import annotations

import re
import struct
from functools import lru_cache

#: Entries of each of two generations that a worker keeps: memory stays bounded whatever the number of different words.
MAX_ENTRIES = 250_000
#: White space as Unicode has it (str.split() would also cut at U+001C to U+001F).
SPACE = "\t-\r \x85\xa0  -     　"
_MORE_SPACE = re.compile("[\x1c-\x1f]")
_WORD = re.compile(f"[^{SPACE}]+")


@lru_cache(maxsize=4)
def tokenizer(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def words(text: str) -> list[str]:
    return _WORD.findall(text) if _MORE_SPACE.search(text) else text.split()


class Known(dict):
    """word -> what `learn` says of it. When full, it becomes the older generation, from which words in use come back."""

    def __init__(self, learn, most: int = MAX_ENTRIES):
        super().__init__()
        self.learn, self.most = learn, most
        self.older: dict = {}

    def __missing__(self, word):
        if (out := self.older.get(word)) is None:
            out = self.learn(word)
            if len(word) > 64:
                return out
        if len(self) >= self.most:
            self.older = dict(self)
            self.clear()
        self[word] = out
        return out


#: Behind a letter or digit these always begin a piece of their own; no special token ends with one.
_TAIL = ".,;:!?%$#&*"


_NUMBERS = [struct.Struct(f"<{n}I") for n in range(33)]


class WordIds(Known):
    """For a lower-case vocabulary that drops white space: the ids of a word as little-endian unsigned 32-bit integers.

    What stands before trailing punctuation, in lower case, is an entry of its own, which all its forms use. Plain
    letters, which make one piece, go to the model directly; everything else goes through the library's encode().
    """

    def __init__(self, path: str):
        super().__init__(self._learn)
        self.tokenizer = tokenizer(path)
        self.model = self.tokenizer.model
        self.alphabet = {b: shown for c in range(0x80, 0x130) if chr(c).isalpha() for b, shown in zip(chr(c).encode(), self.tokenizer.pre_tokenizer.pre_tokenize_str(chr(c))[0][0], strict=True)}

    def _learn(self, word: str) -> bytes:
        core = word.rstrip(_TAIL)
        if len(core) < len(word) and core and core[-1].isalnum():
            return self[self._lower(core)] + self[word[len(core) :]]
        low = self._lower(word)
        return self._ids(word) if low == word else self[low]

    @staticmethod
    def _lower(word: str) -> str:
        return word.lower() if word.isascii() and "|" not in word else word  # special tokens keep their case

    def _ids(self, word: str) -> bytes:
        if word.isalpha() and (word.isascii() or max(word) < "\u0130"):
            low = word.lower()
            shown = low if low.isascii() else low.encode().decode("latin-1").translate(self.alphabet)
            ids = [t.id for t in self.model.tokenize(shown)]
        else:
            ids = self.tokenizer.encode(word, add_special_tokens=False).ids
        return _NUMBERS[len(ids)].pack(*ids) if len(ids) < len(_NUMBERS) else struct.pack(f"<{len(ids)}I", *ids)


@lru_cache(maxsize=4)
def word_ids(path: str) -> WordIds:
    return WordIds(path)
