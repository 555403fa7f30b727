"""Byte-level BPE encoding of whole texts with a public vocabulary.

The merges are not replayed.  A sequence of tokens is the result of the merges
exactly if every two adjacent tokens would stay apart when their bytes are merged
alone.  So a piece is encoded by taking the longest vocabulary entry at each
place, stepping back to the next shorter one where the neighbour does not fit,
and remembering dead places: linear in the length of the piece.

The vocabulary is a file of bounded size; the driver reads it once and broadcasts
its bytes, so executors need no access to the path.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A vocabulary file may not be larger, as it is broadcast.
MAX_VOCABULARY_BYTES = 16 << 20

#: Where the public vocabularies lie; a parameter of all functions here.
TOKENIZER_DIR = os.environ.get("SPINDRIFT_TOKENIZERS", "/opt/tokenizers")

#: Fixed value: the pattern that splits text before the merges, as published with the vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: Pieces remembered by a worker; beyond it, the memory is emptied and filled anew.
MEMORY = 200_000


class Encoder:
    """Encodes texts to ids; built once in each Python worker from the lines of a rank file."""

    def __init__(self, lines: bytes) -> None:
        import ahocorasick
        import regex

        self.ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines.splitlines() if x)}
        self.words = {i: w for w, i in self.ranks.items()}
        self.split_text = regex.compile(PATTERN).findall
        self.trie = ahocorasick.Automaton()
        for word, i in self.ranks.items():
            self.trie.add_word(word.decode("latin-1"), (len(word), i))
        self.trie.make_automaton()
        self.shorter = {i: self._shorter(w) for w, i in self.ranks.items()}
        self.parts: dict[int, tuple[int, int] | None] = {}
        self.joined: dict[tuple[int, int], int] | None = None
        self.fits: dict[tuple[int, int], bool] = {}
        self.seen: dict[str, list[int]] = {}
        self._learn_merges()

    def _shorter(self, word: bytes) -> int:
        """Id of the longest vocabulary entry that is a proper prefix, -1 for none."""
        for n in range(len(word) - 1, 0, -1):
            if (i := self.ranks.get(word[:n])) is not None:
                return i
        return -1

    def _learn_merges(self) -> None:
        """The two entries from which each entry was merged, in the order of the ranks.

        The right pair is the one split of an entry into two older entries that
        stays apart under the merges older than the entry.
        """
        self.joined = {}
        for i in sorted(self.words):
            word = self.words[i]
            self.parts[i] = None
            for n in range(1, len(word)):
                a, b = self.ranks.get(word[:n], i), self.ranks.get(word[n:], i)
                if a < i and b < i and self._apart(a, b):
                    self.parts[i] = (a, b)
                    self.joined[a, b] = i
                    break
        self.fits.clear()

    def _apart(self, left: int, right: int) -> bool:
        """Whether two adjacent entries stay as they are when their bytes are merged."""
        key = (left, right)
        known = self.fits.get(key)
        if known is not None:
            return known
        # Undo the younger of the two merges beside the border until both are single
        # bytes; at each step a merge across the border that is older than the one
        # undone last would have come first.
        a, b, oldest = left, right, 1 << 60
        result = True
        while True:
            across = self.joined.get((a, b))
            if across is not None and across < oldest:
                result = False
                break
            pa, pb = self.parts[a], self.parts[b]
            if pa is None and pb is None:
                break
            if pb is None or (pa is not None and a > b):
                # A merge on the left wins against one across of the same age or younger.
                oldest, a = a, pa[1]
            else:
                oldest, b = b + 1, pb[0]
        if len(self.fits) > 4_000_000:
            self.fits.clear()
        self.fits[key] = result
        return result

    def encode_piece(self, data: bytes) -> list[int]:
        whole = self.ranks.get(data)
        if whole is not None:
            return [whole]
        n = len(data)
        longest: list[tuple[int, int]] = [(0, -1)] * n
        for end, (size, i) in self.trie.iter(data.decode("latin-1")):
            start = end - size + 1
            if size > longest[start][0]:
                longest[start] = (size, i)
        alive = bytearray(b"\x01") * (n + 1)
        out: list[int] = []
        at, token = 0, longest[0][1]
        while True:
            end = at + len(self.words[token])
            if alive[end] and (not out or self._apart(out[-1], token)):
                out.append(token)
                if end == n:
                    return out
                at, token = end, longest[end][1]
            elif self.shorter[token] >= 0:
                token = self.shorter[token]
            else:
                alive[at] = 0
                token = out.pop()
                at -= len(self.words[token])
                # The place behind this token is dead now, so its shorter prefixes follow.

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        seen, out = self.seen, []
        for piece in self.split_text(text):
            ids = seen.get(piece)
            if ids is None:
                ids = self.encode_piece(piece.encode("utf-8"))
                if len(piece) <= 64:
                    if len(seen) >= MEMORY:
                        seen.clear()
                    seen[piece] = ids
            out += ids
        return out


_ENCODERS: dict[str, Encoder] = {}


def _encoder(name: str, lines: bytes) -> Encoder:
    """The worker's encoder of a vocabulary; Python workers are used again for later tasks."""
    if name not in _ENCODERS:
        _ENCODERS[name] = Encoder(lines)
    return _ENCODERS[name]


def vocabulary(spark: SparkSession, name: str, folder: str = TOKENIZER_DIR):
    """A rank file as a broadcast; its size is checked."""
    path = os.path.join(folder, f"{name}.tiktoken")
    if os.path.getsize(path) > MAX_VOCABULARY_BYTES:
        raise ValueError(f"{path} is too large to be broadcast")
    with open(path, "rb") as f:
        return spark.sparkContext.broadcast(f.read())


def encode_ids(df: DataFrame, text: str, out: str = "ids", name: str = "byte_bpe_50k", folder: str = TOKENIZER_DIR) -> DataFrame:
    """``df`` with the list of token ids of ``text``.

    A null or empty text gives an empty list; strings of special tokens are
    ordinary text; texts of any length are encoded whole.  No row is moved: the
    work is one narrow stage over Arrow batches.  A column called ``out`` is
    replaced.
    """
    lines = vocabulary(df.sparkSession, name, folder)

    @F.pandas_udf("array<int>")
    def ids(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoder = _encoder(name, lines.value)
        for texts in batches:
            yield texts.map(encoder.encode, na_action=None)

    return df.withColumn(out, ids(F.col(text)))


def count_tokens(df: DataFrame, text: str, out: str = "n_tokens", name: str = "byte_bpe_50k", folder: str = TOKENIZER_DIR) -> DataFrame:
    """``df`` with the number of tokens of ``text``; 0 for null and empty texts."""
    lines = vocabulary(df.sparkSession, name, folder)

    @F.pandas_udf("int")
    def size(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoder = _encoder(name, lines.value)
        for texts in batches:
            yield texts.map(lambda t: len(encoder.encode(t))).astype("int32")

    # A filter on the size would else encode every text a second time.
    return df.withColumn(out, size.asNondeterministic()(F.col(text)))
