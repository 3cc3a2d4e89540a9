"""SentencePiece encoding and decoding of merge-type (BPE) vocabularies.

A text starts as single characters. An agenda holds the adjacent symbol pairs that form
a piece, ordered by score and then from the left; the best pair is merged and its new
neighbours enter the agenda. Symbols that are no piece become byte pieces. Short words
are merged many at a time: each has a row of pair ranks for its agenda, and a round
takes the best pair of every row.

No piece holds a space mark after another character (``Vocabulary`` checks that), so no
merge crosses from a word into the next one: a text falls apart into words, each led by
its space marks, that are encoded alone and remembered by the Python worker. The same
holds at line ends where no piece holds one.

Every Arrow batch is checked against the sentencepiece library: the words that are new
to the worker are encoded by the library too, in one call, and so are, as a whole, the
texts with unusual spacing; the ids of every text are decoded by the library, and our
decoding must be the same. A difference fails the job.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from hashlib import sha256
from heapq import heapify, heappop, heappush
from itertools import chain, compress, islice
from operator import not_

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, tidied

SPACE = "▁"
#: A word with its space marks.
WORD = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+$")
#: Words that a worker remembers before it sets them aside; those that come again are taken over.
CACHE_WORDS = 400_000
#: Longest word that is merged together with others.
SHORT = 48
#: The earliest, and so most frequent, words that a worker keeps between tasks.
KEPT_WORDS = 150_000
PLACE = (1 << 40) - 1
NO_RANK = 1 << 30


def slots(key: np.ndarray) -> np.ndarray:
    """Places of pair keys in a table of 2**20."""
    return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(44)).astype(np.int64)


class Vocabulary:
    """Pieces and scores of a model file, read with the library's own accessors."""

    def __init__(self, model: str):
        import sentencepiece

        self.library = sp = sentencepiece.SentencePieceProcessor(model_file=model)
        n = sp.get_piece_size()
        pieces = [sp.id_to_piece(i) for i in range(n)]
        if any(sp.is_unused(i) for i in range(n)):
            raise ValueError("vocabularies with unused pieces are not handled")
        self.ids = {p: i for i, p in enumerate(pieces) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i))}
        order = {x: k for k, x in enumerate(sorted({sp.get_score(i) for i in self.ids.values()}, reverse=True))}
        self.rank = {p: order[sp.get_score(i)] for p, i in self.ids.items()}
        self.bytes = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.eos = sp.eos_id()
        self.by_word = all(SPACE not in p.lstrip(SPACE) for p in self.ids)
        self.surface = {i: p.replace(SPACE, " ") for p, i in self.ids.items()} | {i: "" for i in range(n) if sp.is_control(i)}
        self.table = self.pair_table()
        self.lines_apart = all("\n" not in p for p in self.ids) and self.bytes[10] != sp.unk_id()
        self.single = {p for p in self.ids if len(p) == 1}
        self.digits = [str(i) for i in range(n)]
        #: Ids, as 4-byte numbers, of words met before.
        self.known: dict[str, bytes] = {}
        self.aside: dict[str, bytes] = {}

    def merge(self, word: str) -> list[int]:
        """Ids of a string by the agenda of adjacent pairs."""
        rank = self.rank
        symbols: list[str] = list(word)
        n = len(symbols)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        # an entry is the score's rank and the left place in one number
        agenda = [r << 40 | i for i in range(n - 1) if (r := rank.get(symbols[i] + symbols[i + 1])) is not None]
        heapify(agenda)
        while agenda:
            entry = heappop(agenda)
            left = entry & PLACE
            right = after[left]
            if not symbols[left] or right >= n or rank.get(pair := symbols[left] + symbols[right]) != entry >> 40:
                continue  # one of the symbols has been merged away or has grown
            symbols[left], symbols[right] = pair, ""
            after[left] = far = after[right]
            if far < n:
                before[far] = left
                if (r := rank.get(pair + symbols[far])) is not None:
                    heappush(agenda, r << 40 | left)
            near = before[left]
            if near >= 0 and (r := rank.get(symbols[near] + pair)) is not None:
                heappush(agenda, r << 40 | near)
        ids = self.ids
        out: list[int] = []
        for s in filter(None, symbols):
            i = ids.get(s)
            if i is None:
                out += [self.bytes[b] for b in s.encode()]
            else:
                out.append(i)
        return out

    def pair_table(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Open-addressed table of symbol pairs: keys, ranks and merged ids. Built once a worker."""
        ids, n = self.ids, 1 << 20
        keys, ranks, merged = np.full(n, -1, np.int64), np.full(n, NO_RANK, np.int32), np.zeros(n, np.int32)
        entries = {}
        for piece, i in ids.items():
            for k in range(1, len(piece)):
                left, right = ids.get(piece[:k]), ids.get(piece[k:])
                if left is not None and right is not None:
                    entries[left << 20 | right] = (self.rank[piece], i)
        if len(entries) > n // 2:
            raise ValueError("the vocabulary has too many pairs for its table")
        key = np.fromiter(entries, np.int64, len(entries))
        value = np.array(list(entries.values()), np.int32).reshape(-1, 2)
        at = slots(key)
        while len(key):
            _, first = np.unique(at, return_index=True)  # of keys that meet, one takes the slot
            taken = np.zeros(len(key), bool)
            taken[first] = keys[at[first]] < 0
            keys[at[taken]], ranks[at[taken]], merged[at[taken]] = key[taken], value[taken, 0], value[taken, 1]
            key, value, at = key[~taken], value[~taken], (at[~taken] + 1) % n
        return keys, ranks, merged

    def look_up(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and merged id of each pair; no rank where the pair is no piece."""
        keys, ranks, merged = self.table
        key = left.astype(np.int64) << 20 | right
        key[(left < 0) | (right < 0)] = -2
        at = slots(key)
        todo = np.flatnonzero((keys[at] != key) & (keys[at] >= 0))
        while len(todo):
            at[todo] = (at[todo] + 1) % len(keys)
            todo = todo[(keys[at[todo]] != key[todo]) & (keys[at[todo]] >= 0)]
        hit = keys[at] == key
        return np.where(hit, ranks[at], NO_RANK), merged[at]

    def merge_many(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """``merge`` of words of one length, a round of merges at a time: ids in a row, and how many of each word."""
        length, count = len(words[0]), len(words)
        codes = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
        chars, inverse = np.unique(codes, return_inverse=True)
        symbols = np.array([self.ids[chr(c)] for c in chars], np.int32)[inverse].reshape(count, length)
        done = np.full((count, length), -1, np.int32)
        rows = np.arange(count)  # words that still have pairs to merge
        ranks, merged = (x.reshape(count, length - 1) for x in self.look_up(symbols[:, :-1].ravel(), symbols[:, 1:].ravel()))
        while length > 1 and len(rows):
            best = ranks.argmin(1)
            more = ranks[np.arange(len(rows)), best] < NO_RANK
            if not more.all():
                done[rows[~more], :length] = symbols[~more]
                rows, symbols, ranks, merged, best = rows[more], symbols[more], ranks[more], merged[more], best[more]
            here, length = np.arange(len(rows)), length - 1
            symbols[here, best] = merged[here, best]
            col = np.arange(length)
            symbols = symbols[here[:, None], col + (col > best[:, None])]
            if length == 1:
                break
            col = col[:-1]
            move = here[:, None], col + (col >= best[:, None])
            ranks, merged = ranks[move], merged[move]
            for side in (best - 1, best):  # the pairs that the new symbol is in
                ok = (side >= 0) & (side < length - 1)
                r, c = here[ok], side[ok]
                ranks[r, c], merged[r, c] = self.look_up(symbols[r, c], symbols[r, c + 1])
        done[rows, :length] = symbols
        used = done >= 0
        return done[used], used.sum(1)

    def merge_all(self, words: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """The words in another order, their ids in a row, and how many of each: short words many at a
        time, long ones and those with characters that are no piece by the agenda alone."""
        by_length: dict[int, list[str]] = {}
        alone = []
        single = self.single
        for w in words:
            if 2 <= len(w) <= SHORT and single.issuperset(w):
                by_length.setdefault(len(w), []).append(w)
            else:
                alone.append(w)
        ids = [self.merge(w) for w in alone]
        found = [(np.array([i for x in ids for i in x], np.int32), np.array([len(x) for x in ids], np.int64))]
        found += [self.merge_many(group) for group in by_length.values()]
        flat, count = (np.concatenate(x) for x in zip(*found, strict=True))
        return [*alone, *chain.from_iterable(by_length.values())], flat, count

    def word_ids(self, words: list[str]) -> list[list[int]]:
        """Ids of words with their marks."""
        order, flat, count = self.merge_all([*set(words)])
        ends = np.cumsum(count)
        ids = {w: flat[e - n : e].tolist() for w, e, n in zip(order, ends.tolist(), count.tolist(), strict=True)}
        return [ids[w] for w in words]

    def learn(self, words: list[str]) -> None:
        """Remember words without marks, after the library has given the same ids for all of them in a row.

        A word that starts with a line end has no space mark.
        """
        for lead in ("", "\n"):
            kind = [w for w in words if (w[0] == "\n") == bool(lead)]
            if not kind:
                continue
            order, flat, count = self.merge_all([w[1:] for w in kind] if lead else [SPACE + w for w in kind])
            if lead:
                order = [lead + w for w in order]
                at = np.cumsum(count) - count
                flat, count = np.insert(flat, at, self.bytes[10]), count + 1
                theirs = self.library.encode("".join(order))[1:]
            else:
                order = [w[1:] for w in order]
                theirs = self.library.encode(" ".join(order))
            if not np.array_equal(flat, theirs):
                raise ValueError(f"our ids differ from the library's for one of the words {order[:3]!r} ...")
            raw, ends = flat.astype(np.uint32).tobytes(), (4 * np.cumsum(count)).tolist()
            self.known.update(zip(order, map(raw.__getitem__, map(slice, [0, *ends[:-1]], ends)), strict=True))

    def forget(self) -> None:
        """Keep only the words that were met first; the worker's memory is another stage's next."""
        first = chain(self.aside.items(), self.known.items())
        self.known, self.aside = dict(islice(first, KEPT_WORDS)), {}

    def encoded_odd(self, text: str) -> list[int]:
        """Ids of a text with runs of spaces or marks of its own; the library must give the same."""
        marked = (SPACE + text).replace(" ", SPACE)
        ids = [i for found in self.word_ids(WORD.findall(marked) if self.by_word else [marked]) for i in found]
        if ids != self.library.encode(text):
            raise ValueError(f"our ids differ from the library's for a text that starts {text[:60]!r}")
        return ids

    def encoded(self, texts: list[str]) -> list[tuple[str, list[int]]]:
        """For each text its decimal ids joined by one space, with the end id, and the ids."""
        if self.lines_apart:
            split = [t.replace("\n", " \n").split(" ") if self.by_word and SPACE not in t else [""] for t in texts]
        else:
            split = [t.split(" ") if self.by_word and SPACE not in t else [""] for t in texts]
        split = [None if "" in words else words for words in split]
        known = self.known
        found = [[*map(known.get, words)] if words else [] for words in split]
        fresh: set[str] = set()
        for words, raw in zip(split, found, strict=True):
            if None in raw:
                fresh.update(compress(words, map(not_, raw)))
        if fresh:
            again = {w: self.aside[w] for w in fresh if w in self.aside}
            known.update(again)
            self.learn([w for w in fresh if w not in again])
        digits, out = self.digits, []
        for text, words, raw in zip(texts, split, found, strict=True):
            if words:
                ids = array("I", b"".join(map(known.__getitem__, words) if None in raw else raw)).tolist()
            else:
                ids = self.encoded_odd(text) if text else []
            ids.append(self.eos)
            out.append((" ".join(map(digits.__getitem__, ids)), ids))
        if len(self.known) > CACHE_WORDS:
            self.known, self.aside = {}, self.known
        return out

    def decoded(self, ids: list[int]) -> str:
        """Text of ids: marks become spaces, the first one goes, runs of byte pieces are UTF-8."""
        try:
            text = "".join(map(self.surface.__getitem__, ids))
        except KeyError:  # byte pieces have no surface of their own
            text = self.decoded_bytes(ids)
        return text[1:] if text.startswith(" ") else text

    def decoded_bytes(self, ids: list[int]) -> str:
        low, high = self.bytes[0], self.bytes[255]
        surface, out, raw = self.surface, [], bytearray()
        for i in ids:
            if low <= i <= high:
                raw.append(i - low)
                continue
            if raw:
                out.append(raw.decode("utf-8", "replace"))
                raw.clear()
            out.append(surface.get(i, ""))
        out.append(raw.decode("utf-8", "replace"))
        return "".join(out)


#: Vocabularies by model file; a worker serves many tasks.
VOCABULARIES: dict[str, Vocabulary] = {}


def vocabulary_of(model: str) -> Vocabulary:
    if model not in VOCABULARIES:
        VOCABULARIES[model] = Vocabulary(model)
    return VOCABULARIES[model]


def encode_texts(
    docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False, piece_chars: int = 1 << 21, keep_words: bool = True
) -> DataFrame:
    """Encode each whole text with an end id, and decode the ids again.

    Columns: doc_id, n_tokens, ids_sha256, decoded_sha256, and ids and decoded with
    ``keep_ids``. A null text is empty and has the end id alone. Rows are independent:
    null ids, ties and repeated rows need no rule. ``model`` is a path that executors have.
    ``keep_words``: workers keep the vocabulary and some words for their next task; without,
    their memory is free for other stages.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = vocabulary_of(model)
        for batch in batches:
            ids, texts = batch.column(0), [t or "" for t in batch.column(1).to_pylist()]
            lo = 0
            while lo < len(texts):
                hi, size = lo, 0
                while hi < len(texts) and (hi == lo or size + len(texts[hi]) <= piece_chars):
                    size += len(texts[hi])
                    hi += 1
                yield checked(vocabulary, ids[lo:hi], texts[lo:hi])
                lo = hi
        vocabulary.forget()
        if not keep_words:
            VOCABULARIES.clear()

    def checked(vocabulary: Vocabulary, ids: pa.Array, texts: list[str]) -> pa.RecordBatch:
        found = vocabulary.encoded(texts)
        theirs = vocabulary.library.decode([i for _, i in found])
        rows = []
        for text, (joined, own_ids), their_text in zip(texts, found, theirs, strict=True):
            ours = vocabulary.decoded(own_ids)
            if ours != their_text:
                raise ValueError(f"our decoding differs from the library's for a text that starts {text[:60]!r}")
            rows.append((len(own_ids), sha256(joined.encode()).hexdigest(), sha256(ours.encode()).hexdigest(), own_ids, ours))
        kinds = [pa.int64(), pa.string(), pa.string()] + [pa.list_(pa.int32()), pa.string()] * keep_ids
        cols = [pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)]
        return pa.record_batch([ids, *cols], names)

    small_batches(docs)
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] + ["ids", "decoded"] * keep_ids
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * keep_ids
    chosen = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return chosen.mapInArrow(tidied(work), schema)
