"""Token ids of whole texts by a public byte-level BPE vocabulary.

Prefix dynamic programming: for every prefix of a piece's bytes there is exactly one token that can
be the last of its encoding. It is stored, so the encoding of any prefix is read off by walking
back; bytes appended later extend the table exactly, and after an edit only the pieces that the
edit touches are encoded again. A token may follow another only if the merges of their joined bytes
give these two tokens back.

Defined results: a null or empty text gives an empty list; strings that spell special tokens are
ordinary text; texts are encoded whole, however long.
"""

from __future__ import annotations

import base64
import functools
import importlib.util
import os
from collections.abc import Iterator

import pandas as pd
import pyspark.sql.functions as F
import regex
from pyspark.sql import Column
from pyspark.sql.types import ArrayType, IntegerType, LongType

#: Where the vocabulary files lie, on every machine.
FOLDER = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k"
#: Characters of distinct pieces whose ids a worker remembers; beyond it the memory starts afresh.
REMEMBERED = 4_000_000


@functools.lru_cache(maxsize=2)
def load(folder: str = FOLDER, vocabulary: str = VOCABULARY) -> "PrefixEncoder":
    spec = importlib.util.spec_from_file_location("_vocabularies", os.path.join(folder, "__init__.py"))
    module = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(module)
    with open(os.path.join(folder, f"{vocabulary}.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return PrefixEncoder(ranks, module.PATTERN)


class PrefixTable:
    """The unique last token of every prefix of one piece; grows by appending bytes."""

    def __init__(self, encoder: "PrefixEncoder", data: bytes = b""):
        self.encoder, self.data, self.last = encoder, b"", [b""]
        self.append(data)

    def append(self, more: bytes) -> "PrefixTable":
        ranks, follows, longest = self.encoder.ranks, self.encoder.follows, self.encoder.longest
        start = len(self.data)
        self.data += more
        data, last = self.data, self.last
        for end in range(start + 1, len(data) + 1):
            for begin in range(max(0, end - longest), end):
                token = data[begin:end]
                if token in ranks and follows(last[begin], token):
                    last.append(token)
                    break
        return self

    def ids(self, end: int | None = None) -> list[int]:
        """The encoding of the first `end` bytes."""
        end = len(self.data) if end is None else end
        out = []
        while end:
            token = self.last[end]
            out.append(self.encoder.ranks[token])
            end -= len(token)
        return out[::-1]


class PrefixEncoder:
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.longest = ranks, max(map(len, ranks))
        self.pieces = regex.compile(pattern)
        self.follows = functools.lru_cache(maxsize=1_000_000)(self._follows)
        self._known: dict[str, list[int]] = {}
        self._held = 0

    def _merged(self, data: bytes) -> list[bytes]:
        """The merges of a short text, lowest rank first, leftmost of equals."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            ranked = [(self.ranks.get(a + b, 1 << 31), i) for i, (a, b) in enumerate(zip(parts, parts[1:]))]
            rank, i = min(ranked)
            if rank == 1 << 31:
                break
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def _follows(self, before: bytes, token: bytes) -> bool:
        return self._merged(before + token) == ([before, token] if before else [token])

    def piece(self, piece: str) -> list[int]:
        ids = self._known.get(piece)
        if ids is None:
            self._held += len(piece)
            if self._held > REMEMBERED:
                self._known.clear()
                self._held = len(piece)
            data = piece.encode()
            one = self.ranks.get(data)
            ids = [one] if one is not None and self._merged(data) == [data] else PrefixTable(self, data).ids()
            if len(piece) <= REMEMBERED:
                self._known[piece] = ids
        return ids

    def encode(self, text: str | None) -> list[int]:
        out: list[int] = []
        for p in self.pieces.findall(text or ""):
            out += self.piece(p)
        return out

    def edited(self, text: str, ids: list[int], begin: int, end: int, new: str) -> tuple[str, list[int]]:
        """The text with [begin, end) replaced and its ids; only pieces from the edit's surroundings are encoded.

        Pieces before the edit stand unless they could reach into it, so encoding starts one piece
        early (and skips back over white space, whose split looks ahead); it stops at the first
        piece boundary past the edit from which old and new pieces run alike.
        """
        changed = text[:begin] + new + text[end:]
        shift = len(new) - (end - begin)
        old = [(m.start(), m.group()) for m in self.pieces.finditer(text)]
        k = max(0, sum(s < begin for s, _ in old) - 1)
        while k and (old[k][1].isspace() or old[k - 1][1].isspace()):
            k -= 1
        k = max(0, k - 1)
        at = old[k][0] if old else 0
        kept = sum(len(self.piece(p)) for _, p in old[:k])
        out = ids[:kept]
        starts = {s: i for i, (s, _) in enumerate(old)}
        # the rest of the old ids from each old piece on
        tails = [len(ids)]
        for _, p in reversed(old):
            tails.append(tails[-1] - len(self.piece(p)))
        tails = tails[::-1]
        for m in self.pieces.finditer(changed, at):
            i = starts.get(m.start() - shift)
            if m.start() >= begin + len(new) + 1 and i is not None and old[i][1] == m.group() and not m.group().isspace():
                return changed, out + ids[tails[i] :]
            out += self.piece(m.group())
        return changed, out


def token_ids(text: Column, folder: str = FOLDER, vocabulary: str = VOCABULARY) -> Column:
    """The ids of each text as a list of int, without special tokens."""

    @F.pandas_udf(ArrayType(IntegerType()))
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoder = load(folder, vocabulary)
        for texts in batches:
            yield pd.Series([encoder.encode(t) for t in texts], dtype=object)

    return encode(text)


def token_counts(text: Column, folder: str = FOLDER, vocabulary: str = VOCABULARY) -> Column:
    """The number of tokens of each text; the ids stay in the worker."""

    @F.pandas_udf(LongType())
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoder = load(folder, vocabulary)
        for texts in batches:
            yield pd.Series([len(encoder.encode(t)) for t in texts], dtype="int64")

    return count(text)
