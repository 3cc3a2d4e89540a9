"""Tokens as language models count them, and cuts of texts at the ends of tokens.

A ``Tokenizer`` tells where the tokens of a text end; counting, cutting and windows
follow from that, so other vocabularies need no more. ``RankedPairs`` merges pairs of bytes by
the ranks of a vocabulary file. The functions here make pandas UDFs of a tokenizer: texts
come in Arrow batches, and a worker remembers the pieces it has merged. Where no tokenizer
is given, operators count white-space tokens as expressions of Spark's own (``text.words``).
"""

from __future__ import annotations

import base64
from heapq import heapify, heappop, heappush
from itertools import accumulate, chain
from typing import Protocol

import pandas as pd
from pyspark.sql import Column
from pyspark.sql.functions import pandas_udf

from ..sources import store

#: Pieces whose tokens a worker remembers.
KNOWN_PIECES = 100_000
#: Longest piece that is remembered.
SHORT = 64


class Tokenizer(Protocol):
    def ends(self, text: str) -> list[int]:
        """Where each token ends, in UTF-8 bytes from the start of the text; the last one is the text's end."""


class RankedPairs:
    """Byte pairs merged by rank: ``path`` has a token in base64 and its rank in each line, ``pattern`` splits texts into pieces.

    A piece starts as single bytes; the pair of neighbours whose joined bytes have the least rank is joined, the first one
    of equal ranks, until no pair has a rank. A piece that is a token itself is one at once.
    """

    def __init__(self, path: str, pattern: str):
        self.path, self.pattern = path, pattern
        self._loaded: tuple | None = None

    def __getstate__(self) -> dict:
        return {"path": self.path, "pattern": self.pattern, "_loaded": None}

    def loaded(self) -> tuple:
        """Splitter, ranks and the sizes of the tokens of known pieces; of each worker and vocabulary once."""
        if self._loaded is None:
            key = (self.path, self.pattern)
            if key not in _LOADED:
                import regex

                with open(self.path, "rb") as f:
                    ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
                _LOADED[key] = (regex.compile(self.pattern).findall, ranks, Known(ranks))
            self._loaded = _LOADED[key]
        return self._loaded

    def sizes(self, piece: str) -> tuple[int, ...]:
        """Bytes of each token of a piece."""
        return self.loaded()[2][piece]

    def ends(self, text: str) -> list[int]:
        split, _, known = self.loaded()
        return list(accumulate(chain.from_iterable(map(known.__getitem__, split(text)))))

    def count(self, text: str) -> int:
        """How many tokens a text has."""
        split, _, known = self.loaded()
        return sum(map(len, map(known.__getitem__, split(text))))

    def ids(self, text: str) -> list[int]:
        """Ranks of the tokens, which are their ids."""
        raw, ranks, start, out = text.encode("utf-8", "surrogatepass"), self.loaded()[1], 0, []
        for end in self.ends(text):
            out.append(ranks[raw[start:end]])
            start = end
        return out


class Known(dict):
    """Sizes of the tokens of pieces; short pieces are remembered."""

    def __init__(self, ranks: dict[bytes, int]):
        super().__init__()
        self.ranks = ranks

    def __missing__(self, piece: str) -> tuple[int, ...]:
        raw = piece.encode("utf-8", "surrogatepass")
        found = (len(raw),) if raw in self.ranks else tuple(merged_sizes(raw, self.ranks))
        if len(piece) <= SHORT:
            if len(self) >= KNOWN_PIECES:
                self.clear()
            self[piece] = found
        return found


#: Loaded vocabularies of this process; a worker serves many tasks.
_LOADED: dict[tuple[str, str], tuple] = {}


def merged_sizes(raw: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Sizes of the symbols that are left of ``raw`` when no two neighbours have a rank together."""
    n = len(raw)
    after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
    pairs = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(raw[i : i + 2])) is not None]
    heapify(pairs)
    while pairs:
        _, i, stop = heappop(pairs)
        if not alive[i] or (j := after[i]) >= n or after[j] != stop:
            continue  # one of the two has grown or has been joined
        alive[j] = False
        after[i] = stop
        if stop < n:
            before[stop] = i
            if (r := ranks.get(raw[i : after[stop]])) is not None:
                heappush(pairs, (r, i, after[stop]))
        if (h := before[i]) >= 0 and (r := ranks.get(raw[h:stop])) is not None:
            heappush(pairs, (r, h, stop))
    return [after[i] - i for i in range(n) if alive[i]]


def part(raw: bytes, ends: list[int], first: int, count: int) -> str:
    """Text of ``count`` tokens from ``first`` on; a character that is cut is shown as U+FFFD."""
    stop = min(first + count, len(ends))
    return raw[ends[first - 1] if first else 0 : ends[stop - 1] if stop else 0].decode("utf-8", "replace")


def cut(tokenizer: Tokenizer, text: str, limit: int) -> str:
    """The first ``limit`` tokens of a longer text."""
    ends = tokenizer.ends(text)
    return text if len(ends) <= limit else part(text.encode("utf-8", "surrogatepass"), ends, 0, limit)


def count(tokenizer: Tokenizer, text: Column) -> Column:
    """Tokens of a text; none of a null one."""
    store.small_batches()
    tokens_of = getattr(tokenizer, "count", None) or (lambda t: len(tokenizer.ends(t)))

    @pandas_udf("int")
    def counted(texts: pd.Series) -> pd.Series:
        return pd.Series([tokens_of(t) if t else 0 for t in texts], dtype="int32")

    return counted(text)


def trim(tokenizer: Tokenizer, text: Column, limit: Column) -> Column:
    store.small_batches()

    @pandas_udf("string")
    def trimmed(texts: pd.Series, limits: pd.Series) -> pd.Series:
        return pd.Series([t if t is None else cut(tokenizer, t, int(n)) for t, n in zip(texts, limits, strict=True)], dtype=object)

    return trimmed(text, limit)


def windows(tokenizer: Tokenizer, text: Column, size: int, overlap: int) -> Column:
    """Overlapping windows of a text: an array of start, n and text."""
    store.small_batches()

    @pandas_udf("array<struct<start:int,n:int,text:string>>")
    def cut_up(texts: pd.Series) -> pd.Series:
        out = []
        for t in texts:
            raw, ends = (t or "").encode("utf-8", "surrogatepass"), tokenizer.ends(t or "")
            out.append([{"start": i, "n": min(size, len(ends) - i), "text": part(raw, ends, i, size)} for i in range(0, len(ends), size - overlap)])
        return pd.Series(out, dtype=object)

    return cut_up(text)


def page(tokenizer: Tokenizer, path: Column, text: Column, limit: int, size: int, overlap: int, shown: int, truncated: str) -> Column:
    """A page as it is read: whole up to ``limit`` tokens, else its first windows under a head that counts them, cut to ``limit``."""
    store.small_batches()

    @pandas_udf("string")
    def read(paths: pd.Series, texts: pd.Series) -> pd.Series:
        out = []
        for p, t in zip(paths, texts, strict=True):
            if t is None:
                out.append(None)
                continue
            raw, ends = t.encode("utf-8", "surrogatepass"), tokenizer.ends(t)
            starts = range(0, len(ends), size - overlap)
            if len(ends) <= limit:
                out.append(t)
            elif len(starts) == 1:
                out.append(part(raw, ends, 0, limit))
            else:
                head = f"[Large page: {p} \u2014 {len(starts)} sections, showing first {min(shown, len(starts))} most relevant sections]\n\n"
                whole = head + cut(tokenizer, "\n\n---\n\n".join(part(raw, ends, i, size) for i in starts[:shown]), limit)
                kept = cut(tokenizer, whole, limit)
                out.append(whole if kept == whole else kept + truncated)
        return pd.Series(out, dtype=object)

    return read(path, text)
