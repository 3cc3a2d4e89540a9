"""BPE encoding and decoding with word ends, as a streaming transducer of bounded lookahead.

A word starts as one symbol a byte, the last one with the mark of a word's end; the pair of
adjacent symbols that stands first in the merge list is merged, from the left, until no pair
is in it.

Lookahead. Merges happen in the order of their ranks, and bytes after a place p can change
something before p only by a chain of merges of rising ranks: the first takes the symbol y1
that ends at p, which the next would have had at its right edge, so y1 is the left end of
that one's right symbol; it takes y2 to the left of y1 instead, or misses it, and so on. Edges more than
the sum of the lengths of y1, y2, ... before p are settled, whatever follows. ``Merges``
computes the largest such sum over all chains of the list, and a ``Word`` emits its tokens once
they are settled: it holds that many bytes and a block, however long the word is.

Texts fall apart at white space; the chunks between are normalised, split and merged once, many
at a time, and remembered by the worker. Chunks that are long, or hold a special token, go
through ``LongChunk``, which normalises, splits and merges them as they come.

Decoding is a state machine from bytes to text: it takes the bytes of tokens as they come and
gives out whole characters, holding the at most three bytes of an unfinished one.
"""

from __future__ import annotations

import json
import re
import unicodedata
from array import array
from collections.abc import Iterator
from hashlib import sha256
from heapq import heapify, heappop, heappush
from itertools import compress, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, tidied

#: Bytes that a word gathers besides its lookahead before it is merged again.
BLOCK = 4096
#: Longest word that is merged together with others, and longest chunk that is remembered.
SHORT, LONG = 48, 256
#: Chunks that a worker remembers before it sets them aside, and those it keeps between tasks.
CACHE_CHUNKS, KEPT_CHUNKS = 400_000, 150_000
#: Tokens that are decoded at once.
DECODED_AT_ONCE = 1 << 16
NO_RANK = 1 << 30
PLACE = (1 << 40) - 1

# The normaliser and the splitter that a vocabulary file must name.
NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
CONTRACTIONS = ("'s", "'t", "'re", "'ve", "'m", "'ll", "'d")

#: Characters beyond ASCII are coded by their class: a letter, a digit, white space, another.
LETTER, DIGIT, BLANK, OTHER = "\x80", "\x81", "\x82", "\x83"
WORDS = re.compile("|".join(CONTRACTIONS) + "|[a-zA-Z\x80]+|[0-9\x81]|[^a-zA-Z\x80 0-9\x81\t-\r\x82]+")
LETTERS = re.compile("[a-zA-Z\x80]*")
SYMBOLS = re.compile("[^a-zA-Z\x80 0-9\x81\t-\r\x82]*")
#: Old scripts are normalised alike by all versions of the tables; others as the library has them.
RARE = re.compile("[^\0-ԯ　-ヿ一-鿿가-힣]")


def byte_letters() -> list[str]:
    """The character that stands for each byte in byte-level vocabularies: printable ones for
    themselves, the others, in order, for the characters from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(hidden)) for b in range(256)]


class Merges:
    """A merge list over symbol ids, its pairs in a table, and its sufficient lookahead in bytes."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], suffix: str):
        letters = byte_letters()
        self.inner = np.array([vocab[c] for c in letters], np.int32)
        self.final = np.array([vocab[c + suffix] for c in letters], np.int32)
        self.pairs = {(vocab[a] << 20 | vocab[b]): (r << 20 | vocab[a + b]) for r, (a, b) in enumerate(merges)}
        self.lookahead = self.sufficient_lookahead(merges)
        self.table = self.pair_table()

    @staticmethod
    def sufficient_lookahead(merges: list[tuple[str, str]]) -> int:
        """The longest sum of left symbols over chains of merges of rising ranks, each of which has the
        left symbol of the one before at the left end of its right symbol, without the last one's own."""
        parts: dict[str, tuple[str, str]] = {}
        reach: dict[str, int] = {}  # symbol: longest sum of a chain that ends with it on the left, itself included
        longest = 0
        for left, right in merges:
            if left + right in parts:
                raise ValueError("a symbol is made by two merges: there is no bound on the lookahead")
            chain, s = 0, right
            while True:
                chain = max(chain, reach.get(s, 0))
                if s not in parts:
                    break
                s = parts[s][0]
            parts[left + right] = (left, right)
            longest = max(longest, chain)
            reach[left] = max(reach.get(left, 0), chain + len(left))
        made = {s: r for r, s in enumerate(parts)}
        if any(made.get(s, -1) >= r for r, pair in enumerate(merges) for s in pair):
            raise ValueError("a merge comes before one that makes its parts: merges are not in the order of ranks")
        return longest

    def pair_table(self) -> tuple[np.ndarray, np.ndarray]:
        """Pair keys and their values in a table with open addresses, four slots for each pair."""
        bits = max(10, (4 * len(self.pairs)).bit_length())
        self.shift = np.uint64(64 - bits)
        keys, values = np.full(1 << bits, -1, np.int64), np.zeros(1 << bits, np.int64)
        key = np.fromiter(self.pairs, np.int64, len(self.pairs))
        value = np.fromiter(self.pairs.values(), np.int64, len(key))
        at = self.slots(key)
        while len(key):
            _, first = np.unique(at, return_index=True)  # of keys that meet, one takes the slot
            won = np.zeros(len(key), bool)
            won[first] = keys[at[first]] < 0
            keys[at[won]], values[at[won]] = key[won], value[won]
            key, value, at = key[~won], value[~won], (at[~won] + 1) % len(keys)
        return keys, values

    def slots(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def look_up(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """rank << 20 | merged id of each pair; NO_RANK << 20 where it is not in the list."""
        keys, values = self.table
        key = left.astype(np.int64) << 20 | right
        at = self.slots(key)
        found = keys[at]
        todo = np.flatnonzero((found != key) & (found >= 0))
        while len(todo):
            at[todo] = (at[todo] + 1) % len(keys)
            found[todo] = keys[at[todo]]
            todo = todo[(found[todo] != key[todo]) & (found[todo] >= 0)]
        return np.where(found == key, values[at], NO_RANK << 20)

    def merge(self, symbols: list[int]) -> tuple[list[int], list[int]]:
        """Merged ids, and the place in ``symbols`` where each ends, by an agenda of ranks."""
        pairs, n = self.pairs, len(symbols)
        symbols = [*symbols]
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        agenda = [(v >> 20) << 40 | i for i in range(n - 1) if (v := pairs.get(symbols[i] << 20 | symbols[i + 1])) is not None]
        heapify(agenda)
        while agenda:
            entry = heappop(agenda)
            left = entry & PLACE
            if symbols[left] < 0 or (right := after[left]) >= n:
                continue
            value = pairs.get(symbols[left] << 20 | symbols[right])
            if value is None or value >> 20 != entry >> 40:
                continue  # one of the two has been merged away or has grown
            symbols[left], symbols[right] = value & 0xFFFFF, -1
            after[left] = far = after[right]
            if far < n:
                before[far] = left
                if (v := pairs.get(symbols[left] << 20 | symbols[far])) is not None:
                    heappush(agenda, (v >> 20) << 40 | left)
            near = before[left]
            if near >= 0 and (v := pairs.get(symbols[near] << 20 | symbols[left])) is not None:
                heappush(agenda, (v >> 20) << 40 | near)
        kept = [i for i in range(n) if symbols[i] >= 0]
        return [symbols[i] for i in kept], [after[i] for i in kept]

    def merge_many(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids, in a row, of whole words of one length, a round of merges at a time, and how many of each."""
        length, count = len(words[0]), len(words)
        raw = np.frombuffer(b"".join(words), np.uint8).reshape(count, length)
        symbols = self.inner[raw]
        symbols[:, -1] = self.final[raw[:, -1]]
        done = np.full((count, length), -1, np.int32)
        rows = np.arange(count)  # words that still have pairs to merge
        values = self.look_up(symbols[:, :-1].ravel(), symbols[:, 1:].ravel()).reshape(count, length - 1)
        while length > 1 and len(rows):
            best = values.argmin(1)
            here = np.arange(len(rows))
            value = values[here, best]
            more = value >> 20 < NO_RANK
            if not more.all():
                done[rows[~more], :length] = symbols[~more]
                rows, symbols, values, best, value = rows[more], symbols[more], values[more], best[more], value[more]
                here = here[: len(rows)]
            length -= 1
            symbols[here, best] = value & 0xFFFFF
            col = np.arange(length)
            symbols = symbols[here[:, None], col + (col > best[:, None])]
            if length == 1:
                break
            col = col[:-1]
            values = values[here[:, None], col + (col >= best[:, None])]
            for side in (best - 1, best):  # the pairs that the new symbol is in
                ok = (side >= 0) & (side < length - 1)
                r, c = here[ok], side[ok]
                values[r, c] = self.look_up(symbols[r, c], symbols[r, c + 1])
        done[rows, :length] = symbols
        used = done >= 0
        return done[used], used.sum(1)


class Word:
    """Tokens of one word whose bytes come in parts; each is given out once nothing that follows can change it."""

    def __init__(self, merges: Merges):
        self.merges, self.held = merges, bytearray()

    def feed(self, raw: bytes) -> list[int]:
        out: list[int] = []
        room = self.merges.lookahead + BLOCK
        for lo in range(0, len(raw), BLOCK):
            self.held += raw[lo : lo + BLOCK]
            if len(self.held) > room:
                out += self.settled()
        return out

    def settled(self) -> list[int]:
        known = len(self.held) - 1  # the last byte may be the word's last
        ids, ends = self.merges.merge(self.merges.inner[np.frombuffer(self.held, np.uint8)[:known]].tolist())
        count = int(np.searchsorted(ends, known - self.merges.lookahead))
        if count:
            del self.held[: ends[count - 1]]
        return ids[:count]

    def close(self) -> list[int]:
        if not self.held:
            return []
        raw = np.frombuffer(bytes(self.held), np.uint8)
        self.held.clear()
        return self.merges.merge([*self.merges.inner[raw[:-1]].tolist(), int(self.merges.final[raw[-1]])])[0]


class TextMachine:
    """UTF-8 to text as bytes come in; what is not UTF-8 becomes U+FFFD."""

    def __init__(self) -> None:
        self.held = b""

    def push(self, raw: bytes) -> str:
        raw = self.held + raw
        whole = len(raw)
        for back in range(1, min(3, whole) + 1):  # an unfinished character starts in the last three bytes
            lead = raw[-back]
            if lead & 0xC0 != 0x80:
                need = 2 if 0xC2 <= lead < 0xE0 else 3 if 0xE0 <= lead < 0xF0 else 4 if 0xF0 <= lead < 0xF5 else 1
                if need > back and len(raw[-back:].decode("utf-8", "replace")) == 1:
                    whole -= back
                break
        self.held = raw[whole:]
        return raw[:whole].decode("utf-8", "replace")

    def close(self) -> str:
        raw, self.held = self.held, b""
        return raw.decode("utf-8", "replace")


class Decoder:
    """Text of ids that come in parts. A file without a decoder has the symbols themselves, with blanks
    between; one with a byte-level decoder has the bytes that the symbols stand for."""

    def __init__(self, file: dict):
        symbols = file["model"]["vocab"] | {t["content"]: t["id"] for t in file["added_tokens"]}
        kind = file.get("decoder")
        if kind is not None and kind["type"] != "ByteLevel":
            raise ValueError(f"decoders of type {kind['type']} are not handled")
        self.between = b" " if kind is None else b""
        of_letter = {c: b for b, c in enumerate(byte_letters())}
        self.raw: dict[int, bytes] = {}
        for s, i in symbols.items():
            plain = kind is None or not all(c in of_letter for c in s)
            self.raw[i] = s.encode() if plain else bytes(of_letter[c] for c in s)

    def parts(self, ids: array) -> Iterator[str]:
        machine, between = TextMachine(), b""
        for lo in range(0, len(ids), DECODED_AT_ONCE):
            yield machine.push(between + self.between.join(map(self.raw.__getitem__, ids[lo : lo + DECODED_AT_ONCE])))
            between = self.between
        yield machine.close()

    def decoded(self, ids: array) -> str:
        return "".join(self.parts(ids))


class Encoder:
    """Encoding by a vocabulary file of the tokenizers library: lower case, words end with a mark, white space is dropped.

    Merges are made here; the library gives the file's tables of characters: classes of
    characters beyond ASCII, each asked for once, and the normal form of rare scripts.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        model = file["model"]
        pre = file["pre_tokenizer"]["pretokenizers"] if file["pre_tokenizer"]["type"] == "Sequence" else []
        plain_model = not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "fuse_unk", "byte_fallback", "ignore_merges"))
        plain_added = not any(t[k] for t in file["added_tokens"] for k in ("single_word", "lstrip", "rstrip", "normalized"))
        if file["normalizer"] != {"type": "Sequence", "normalizers": NORMALIZERS} or not plain_model or not plain_added or not model["end_of_word_suffix"]:
            raise ValueError("this file's normaliser, model or added tokens are of another kind")
        if [p["type"] for p in pre] != ["Split", "ByteLevel"] or pre[0]["pattern"] != {"Regex": SPLIT} or not pre[0]["invert"] or pre[1]["use_regex"] or pre[1]["add_prefix_space"]:
            raise ValueError("this file's splitter is of another kind")
        from tokenizers import Regex, normalizers, pre_tokenizers

        self.normal = normalizers.Sequence([normalizers.NFC(), normalizers.Lowercase()])
        self.split = pre_tokenizers.Split(Regex(SPLIT), "removed", invert=True)
        self.merges = Merges(model["vocab"], [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]], model["end_of_word_suffix"])
        self.special = {t["content"]: t["id"] for t in file["added_tokens"]}
        self.specials = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) or "(?!)")
        self.special_reach = max(map(len, self.special), default=0)
        self.decoder = Decoder(file)
        self.digits = [str(i) for i in range(1 + max([*model["vocab"].values(), *self.special.values()]))]
        self.classes: dict[int, str] = {}
        self.aside: dict[str, bytes] = {}
        #: Ids, as 4-byte numbers, of chunks met before.
        self.known: dict[str, bytes] = {"": b""}

    def normalised(self, text: str) -> str:
        """Composed and in lower case, character by character: the last sigma of a word is as any other."""
        if text.isascii():
            return text.lower()
        if RARE.search(text):
            return self.normal.normalize_str(text)
        return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()

    def coded(self, text: str) -> str:
        """``text`` with every character beyond ASCII replaced by its class."""
        if text.isascii():
            return text
        for c in set(text):
            if c > "\x7f" and ord(c) not in self.classes:
                parts = tuple(p for p, _ in self.split.pre_tokenize_str(f"a{c}{c}!"))
                kinds = {(f"a{c}{c}", "!"): LETTER, ("a", c, c, "!"): DIGIT, ("a", "!"): BLANK}
                self.classes[ord(c)] = kinds.get(parts, OTHER)
        return text.translate(self.classes)

    def words(self, text: str) -> list[str]:
        """Words of a normalised text."""
        if text.isascii():
            return WORDS.findall(text)
        return [text[m.start() : m.end()] for m in WORDS.finditer(self.coded(text))]

    def merged(self, words: list[bytes]) -> dict[bytes, bytes]:
        """Ids of different words: short ones many at a time, longer ones through a ``Word`` each."""
        by_length: dict[int, list[bytes]] = {}
        out = {}
        for w in words:
            if len(w) <= SHORT:
                by_length.setdefault(len(w), []).append(w)
            else:
                stream = Word(self.merges)
                out[w] = array("I", [*stream.feed(w), *stream.close()]).tobytes()
        for group in by_length.values():
            flat, count = self.merges.merge_many(group)
            raw, ends = flat.astype(np.uint32).tobytes(), (4 * np.cumsum(count)).tolist()
            out.update(zip(group, map(raw.__getitem__, map(slice, [0, *ends[:-1]], ends)), strict=True))
        return out

    def learn(self, chunks: list[str]) -> dict[str, bytes]:
        """Ids of different chunks without white space of the plain kinds."""
        out, plain = {}, {True: [], False: []}
        for c in chunks:
            if len(c) > LONG or self.specials.search(c):
                stream = LongChunk(self)
                out[c] = stream.feed(c) + stream.close()
            else:
                plain[c.isascii()].append(c)
        for group in filter(None, plain.values()):
            words = [[w.encode() for w in self.words(part)] for part in self.normalised("\n".join(group)).split("\n")]
            ids = self.merged([*{w for ws in words for w in ws}])
            out.update((c, b"".join(map(ids.__getitem__, ws))) for c, ws in zip(group, words, strict=True))
        return out

    def encoded(self, texts: list[str]) -> list[bytes]:
        """Ids of each text, as 4-byte numbers."""
        known = self.known
        split = [t.replace("\n", " ").split(" ") for t in texts]
        found = [[*map(known.get, chunks)] for chunks in split]
        fresh: set[str] = set()
        for chunks, ids in zip(split, found, strict=True):
            if None in ids:
                fresh.update(compress(chunks, [i is None for i in ids]))
        long = {}
        if fresh:
            known.update((c, self.aside[c]) for c in fresh if c in self.aside)
            for c, ids in self.learn([c for c in fresh if c not in known]).items():
                (long if len(c) > LONG else known)[c] = ids
        out = []
        for chunks, ids in zip(split, found, strict=True):
            if None in ids:
                ids = [known[c] if c in known else long[c] for c in chunks]
            out.append(b"".join(ids))
        if len(known) > CACHE_CHUNKS:
            self.known, self.aside = {"": b""}, known
        return out

    def forget(self) -> None:
        """Keep only the chunks that were met first; the worker's memory is another stage's next."""
        first = {**self.aside, **self.known}
        self.known, self.aside = dict(islice(first.items(), KEPT_CHUNKS)) | {"": b""}, {}


class LongChunk:
    """Ids of a text whose characters come in parts, without a chunk to look up: normal form, split and
    merges with what each needs to see of the text that follows, and no more."""

    def __init__(self, encoder: Encoder):
        self.encoder, self.word = encoder, Word(encoder.merges)
        self.raw, self.normal = "", ""  # not normalised yet; normalised, and not dealt to words yet
        self.run: re.Pattern | None = None  # what goes on the open word

    def feed(self, text: str, last: bool = False) -> bytes:
        out: list[int] = []
        reach = self.encoder.special_reach
        for lo in range(0, max(len(text), 1), BLOCK):
            self.raw += text[lo : lo + BLOCK]
            final = last and lo + BLOCK >= len(text)
            while m := self.encoder.specials.search(self.raw):
                if not final and m.start() > len(self.raw) - reach:
                    break  # a longer one may start here
                out += self.deal(self.raw[: m.start()], True)
                out.append(self.encoder.special[m.group()])
                self.raw = self.raw[m.end() :]
            cut = len(self.raw) if final else self.whole(len(self.raw) - reach)
            if cut > 0 or final:
                out += self.deal(self.raw[:cut], final)
                self.raw = self.raw[cut:]
        return array("I", out).tobytes()

    def close(self) -> bytes:
        return self.feed("", last=True)

    def whole(self, cut: int) -> int:
        """The last place up to ``cut`` before a character that joins with none before it."""
        while cut > 0:
            c = self.raw[cut]
            joins = unicodedata.category(c)[0] in "MC" or "ᅠ" <= c <= "ᇿ" or "\U00016d40" <= c <= "\U00016d7f"
            if c.isascii() or not (joins or unicodedata.combining(c)):
                break
            cut -= 1
        return max(cut, 0)

    def deal(self, raw: str, last: bool) -> list[int]:
        """Tokens of more of the text up to a place where characters are whole; ``last``: words end there."""
        text = self.normal + self.encoder.normalised(raw)
        coded, at, out = self.encoder.coded(text), 0, []
        self.normal = ""
        if self.run is not None:
            at = self.run.match(coded).end()
            out += self.word.feed(text[:at].encode())
            if at < len(text):
                out += self.end()
        for m in WORDS.finditer(coded, at) if at < len(text) else ():
            if not last and coded[m.start()] == "'" and m.start() >= len(text) - 2 and m.group() not in CONTRACTIONS:
                self.normal = text[m.start() :]  # may be a contraction
                break
            out += self.word.feed(text[m.start() : m.end()].encode())
            if m.end() == len(text) and m.group() not in CONTRACTIONS and m.group() not in "0123456789\x81":
                self.run = LETTERS if LETTERS.match(m.group()).end() else SYMBOLS
            else:
                out += self.end()
        return out + self.end() if last else out

    def end(self) -> list[int]:
        self.run = None
        return self.word.close()


class TextStream:
    """Ids, as 4-byte numbers, of a text that comes in parts of any length: chunks are looked up or learned, long ones are streamed."""

    def __init__(self, encoder: Encoder):
        self.encoder, self.held = encoder, ""
        self.long: LongChunk | None = None

    def feed(self, text: str) -> bytes:
        text, out = self.held + text, b""
        self.held = ""
        if self.long is not None:
            ends = [i for i in (text.find(" "), text.find("\n")) if i >= 0]
            if not ends:
                return self.long.feed(text)
            out = self.long.feed(text[: min(ends)]) + self.long.close()
            self.long, text = None, text[min(ends) :]
        cut = max(text.rfind(" "), text.rfind("\n")) + 1
        out += self.encoder.encoded([text[:cut]])[0]
        if len(text) - cut <= LONG:
            self.held = text[cut:]
        else:
            self.long = LongChunk(self.encoder)
            out += self.long.feed(text[cut:])
        return out

    def close(self) -> bytes:
        text, self.held = self.held, ""
        if self.long is not None:
            long, self.long = self.long, None
            return long.close()
        return self.encoder.encoded([text])[0]


#: Encoders by vocabulary file; a worker serves many tasks.
ENCODERS: dict[str, Encoder] = {}


def encoder_of(path: str) -> Encoder:
    if path not in ENCODERS:
        ENCODERS[path] = Encoder(path)
    return ENCODERS[path]


def encode_texts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False, piece_chars: int = 1 << 20) -> DataFrame:
    """Encode each whole text, and decode the ids again.

    Columns: doc_id, n_tokens, ids_sha256, decoded_sha256, and ids and decoded with
    ``keep_ids``. A null text is empty and has no ids. Rows are independent: null ids, ties and repeated
    rows need no rule, and other columns of ``docs`` are not read. ``path`` is a vocabulary file that executors have. Texts
    of more than ``piece_chars`` characters are streamed by so many.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(path)
        for batch in batches:
            ids, texts = batch.column(0), [t or "" for t in batch.column(1).to_pylist()]
            lo = 0
            while lo < len(texts):
                hi, size = lo, 0
                while hi < len(texts) and (hi == lo or size + len(texts[hi]) <= piece_chars):
                    size += len(texts[hi])
                    hi += 1
                yield digested(encoder, ids[lo:hi], texts[lo:hi])
                lo = hi
        encoder.forget()

    def streamed(encoder: Encoder, text: str) -> bytes:
        stream = TextStream(encoder)
        return b"".join([*(stream.feed(text[lo : lo + piece_chars]) for lo in range(0, len(text), piece_chars)), stream.close()])

    def digested(encoder: Encoder, ids: pa.Array, texts: list[str]) -> pa.RecordBatch:
        found = encoder.encoded(texts) if len(texts) > 1 or len(texts[0]) <= piece_chars else [streamed(encoder, texts[0])]
        rows = []
        for raw in found:
            tokens = array("I", raw)
            named, decoded = sha256(), sha256()
            for lo in range(0, len(tokens), DECODED_AT_ONCE):
                named.update((" " * bool(lo) + " ".join(map(encoder.digits.__getitem__, tokens[lo : lo + DECODED_AT_ONCE]))).encode())
            for part in encoder.decoder.parts(tokens):
                decoded.update(part.encode())
            row = (len(tokens), named.hexdigest(), decoded.hexdigest())
            rows.append((*row, tokens.tolist(), encoder.decoder.decoded(tokens)) if keep_ids else row)
        kinds = [pa.int64(), pa.string(), pa.string()] + [pa.list_(pa.int32()), pa.string()] * keep_ids
        return pa.record_batch([ids, *(pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds))], names)

    small_batches(docs)
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] + ["ids", "decoded"] * keep_ids
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * keep_ids
    chosen = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return chosen.mapInArrow(tidied(work), schema)
