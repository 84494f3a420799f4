"""Token counts at every prefix of a text, by dynamic programming.

Byte-level BPE has one property that makes this possible: a row of tokens is the
encoding of its text exactly if each two neighbours encode to themselves. So the
last token at a prefix is the only vocabulary entry that ends there and is
compatible with the last token of the prefix before it, and its count is one more
than that prefix's. A word's table is computed once per worker while it is
remembered; a document's is that of its words one after the other, stored as the
change at each code point. Counting, truncating to a budget and asking what a
prefix costs then read the table and encode nothing again.

Prefixes end between code points. What pre-tokenisation would do differently at
the end of a prefix (a run of white space, a contraction, a special token that is
not yet complete) is in the table.

Defined results: null and empty text have no bytes, no tokens and an empty table;
repeated rows repeat; an empty table gives an empty result.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate
from operator import sub

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import texts
from .packing import vocabulary
from .words import SPACE, Known, tokenizer

LIMIT = 512
#: What a worker remembers of words here costs more to learn anew.
MAX_ENTRIES = 400_000
_UNIT = re.compile(f"[{SPACE}]*[^{SPACE}]+|[{SPACE}]+")
#: The pre-tokenizer's own pattern, a fixed value of this vocabulary.
_PRE_TOKEN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
#: Contractions of more than one letter in that pattern.
_CONTRACTIONS = frozenset(("'re", "'ve", "'ll"))
#: Behind a letter or digit these always begin a pre-token.
_TAIL = ".,;:!?%$#&*|"
_LEADING = re.compile(f"[{SPACE}]*")


def _upper_bytes(tokenizer) -> dict[int, str]:
    """The byte alphabet's letters of the bytes in U+0080 to U+024F, as the pre-tokenizer shows them."""
    return {b: shown for c in range(0x80, 0x250) for b, shown in zip(chr(c).encode(), "".join(p for p, _ in tokenizer.pre_tokenizer.pre_tokenize_str(chr(c))), strict=True)}


class PrefixTables:
    """Token counts at the prefixes of words for one vocabulary."""

    def __init__(self, path: str):
        self.tokenizer = tokenizer(path)
        self.vocabulary = self.tokenizer.get_vocab(with_added_tokens=False)
        self.ends = {t[k:]: False for t in self.vocabulary for k in range(len(t))} | dict.fromkeys(self.vocabulary, True)
        self.alphabet = {b: self.tokenizer.pre_tokenizer.pre_tokenize_str(chr(b))[0][0] for b in range(128)} | _upper_bytes(self.tokenizer)
        self.special = sorted((t.content for t in self.tokenizer.get_added_tokens_decoder().values()), key=len, reverse=True)
        self.at_special = re.compile("|".join(map(re.escape, self.special))) if self.special else None
        self.stable = Known(self._stable, MAX_ENTRIES)
        self.words = Known(self._word, MAX_ENTRIES)
        self.units = Known(self._unit, MAX_ENTRIES)

    def _stable(self, tokens: str | tuple[str, str]) -> bool:
        """Whether one token, or two neighbours, encode to themselves."""
        want = [tokens] if isinstance(tokens, str) else list(tokens)
        return [t.value for t in self.tokenizer.model.tokenize("".join(want))] == want

    def _word(self, word: str) -> list[int] | bytes:
        """Counts at prefixes of 0, 1, ... characters of a pre-token in the byte alphabet: the dynamic programme."""
        last: list[str] = [""] * (len(word) + 1)
        count = [0] * (len(word) + 1)
        ends, stable = self.ends, self.stable
        for i in range(1, len(word) + 1):
            for k in range(i - 1, -1, -1):
                t = word[k:i]
                whole = ends.get(t)
                if whole is None:
                    raise ValueError(f"no token ends at {i} of {word!r}")
                if whole and stable[(last[k], t) if k else t]:
                    last[i], count[i] = t, count[k] + 1
                    break
            else:
                raise ValueError(f"no token ends at {i} of {word!r}")
        return bytes(count) if len(count) < 256 else count  # small integers in either case

    def pieces(self, s: str) -> list[str]:
        """The pre-tokens of a text in the byte alphabet."""
        if s.isascii() and s.isprintable():
            return [p.replace(" ", self.alphabet[32]) for p in _PRE_TOKEN.findall(s)]
        if max(s, default="") < "\u0250":  # letters that all versions of Unicode class alike
            return [p.encode().decode("latin-1").translate(self.alphabet) for p in _PRE_TOKEN.findall(s)]
        return [p for p, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(s)]

    def _count(self, text: str) -> int:
        return sum(self.words[p][-1] for p in self.pieces(text))

    @staticmethod
    def _at_characters(s: str, table: list[int] | bytes) -> list[int]:
        """Of counts at the prefixes of 0, 1, ... bytes those at the prefixes of 1, 2, ... characters."""
        if s.isascii():
            return list(table[1:])
        return [table[e] for e in accumulate(len(ch.encode("utf-8", "surrogatepass")) for ch in s)]

    def _unit(self, unit: str) -> bytes:
        """Changes of the count at each code point of a run of white space and the characters behind it."""
        core = unit.rstrip(_TAIL)
        if len(core) < len(unit) and core and core[-1].isalnum() and "'" not in core:
            return self.units[core] + self.units[unit[len(core) :]]  # pre-tokens part here
        if unit.isascii() and (unit[1:] if unit[0] == " " else unit).isalpha():
            counts = self.words[unit.replace(" ", self.alphabet[32])]
            return struct.pack(f"<{len(unit)}h", *map(sub, counts[1:], counts))
        k = _LEADING.match(unit).end()
        space, rest = unit[:k], unit[k:]
        counts = self._at_characters(space, self.words[self.pieces(space)[0]]) if space else []  # a text that ends in white space: one pre-token
        if rest:
            glued = space.endswith(" ")
            head, body = (space[:-1], " " + rest) if glued else (space, rest)
            # All but the last of a run of white space is one pre-token.
            before = (self._count(head) if glued else self._count(head[:-1]) + self._count(head[-1:])) if head else 0
            table, total = [0], 0
            for p in self.pieces(body):
                c = self.words[p]
                if p in _CONTRACTIONS:  # not complete, it is an apostrophe and a letter
                    c = [0, self.words[p[0]][-1], self.words[p[0]][-1] + self.words[p[1]][-1], c[-1]]
                table += [total + x for x in c[1:]]
                total += c[-1]
            counts = [*counts, *(before + x for x in self._at_characters(body, table)[glued:])]
        return struct.pack(f"<{len(counts)}h", *map(sub, counts, [0, *counts]))

    def text(self, text: str) -> bytes:
        """Changes of the count at each code point of a text."""
        if self.at_special is None or not self.at_special.search(text):
            return b"".join(map(self.units.__getitem__, _UNIT.findall(text)))
        out, at = [], 0
        for m in self.at_special.finditer(text):
            units = _UNIT.findall(text[at : m.start()])
            out += map(self.units.__getitem__, units)
            # While the special token is incomplete, its characters go on with the unit before them.
            last = units[-1] if units else ""
            grown = np.frombuffer(self.units[last + m[0][:-1]], "<i2")[len(last) :]
            whole = int(np.frombuffer(self.units[last], "<i2").sum()) if last else 0
            grown_from = int(np.frombuffer(self.units[last + m[0][:-1]], "<i2")[: len(last)].sum())
            steps = grown.astype(np.int64)
            if len(steps):
                steps[0] += grown_from - whole
            out.append(np.append(steps, 1 - int(steps.sum())).astype("<i2").tobytes())
            at = m.end()
        out += map(self.units.__getitem__, _UNIT.findall(text[at:]))
        return b"".join(out)


@lru_cache(maxsize=4)
def tables(path: str) -> PrefixTables:
    return PrefixTables(path)


def token_prefixes(docs: DataFrame, tokenizer_name: str = "byte_bpe_50k.json") -> DataFrame:
    """doc_id, n_bytes, n_tokens and prefixes (zlib of little-endian 16-bit changes of the count at each code point)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = tables(vocabulary(tokenizer_name))
        for batch in batches:
            n_bytes, n_tokens, stored = [], [], []
            for text in batch.column(1):
                t = text.as_py() or ""
                changes = known.text(t)
                n_bytes.append(len(t.encode("utf-8", "surrogatepass")))
                n_tokens.append(int(np.frombuffer(changes, "<i2").sum(dtype=np.int64)))
                stored.append(zlib.compress(changes, 1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_bytes, pa.int64()), pa.array(n_tokens, pa.int64()), pa.array(stored, pa.binary())], names=["doc_id", "n_bytes", "n_tokens", "prefixes"])

    return texts(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, prefixes binary")


def counts_at_prefixes(stored: bytes) -> np.ndarray:
    """Token counts of the prefixes of 0, 1, ... code points."""
    return np.concatenate([[0], np.cumsum(np.frombuffer(zlib.decompress(stored), "<i2"), dtype=np.int64)])


def prefix_tokens(prefixes: Column, n_chars: Column) -> Column:
    """Tokens of the prefix of n_chars code points (of the whole text, if that is shorter)."""

    def run(p: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series([int(c[max(0, min(k, len(c) - 1))]) for c, k in ((counts_at_prefixes(x), k) for x, k in zip(p, n, strict=True))], dtype="int64")

    return F.pandas_udf(run, "long")(prefixes, n_chars)


def chars_within(prefixes: Column, budget: Column) -> Column:
    """Code points of the longest prefix with at most `budget` tokens."""

    def run(p: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series([int(np.flatnonzero(counts_at_prefixes(x) <= max(0, k))[-1]) for x, k in zip(p, n, strict=True)], dtype="int64")

    return F.pandas_udf(run, "long")(prefixes, budget)


def op7_token_counts(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return token_prefixes(docs).select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > LIMIT).alias("over_limit"))
