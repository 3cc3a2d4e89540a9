"""The streaming BPE transducer against the tokenizers library, and its lookahead against whole words."""

from __future__ import annotations

import json
import random
from array import array
from hashlib import sha256

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from foliospark.llm import bpe_stream, queries

from .test_llm import awkward, frame  # noqa: F401

PATH = public_tokenizers.path("word_bpe_49k.json")
PARTS = ["a", "b", "the", "ing", "'", "'s", "'re", "'v", "'l", "e", "\n", " ", "\t", "é", "é", "́", "Σ", "ς", "İ", "ß", "1", "٣", "½", "汉字", "が", "한", "!", "...",
    "<|endoftext|>", "<|startoftext|>", "<|end", " ", "​", "😀", "👍🏽", "\x1c", "\x85", "﻿", "Z", "Ǆ", "ﬁ", "ᾼ", "क्ष", "া", "Ᲊ", "Ƛ", "\U00010d50", "\0", "_", "don't", "WE'LL", "Å"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def fed(stream, text, rng):
    out, i = b"", 0
    while i < len(text):
        j = i + rng.randrange(1, 12)
        out += stream.feed(text[i:j])
        i = j
    return array("I", out + stream.close()).tolist()


def test_odd_texts_whole_and_in_parts(library):
    rng, encoder = random.Random(2), bpe_stream.Encoder(PATH)
    for k in range(1500):
        text = "".join(rng.choice(PARTS) for _ in range(rng.randrange(0, 40)))
        if k % 3 == 0:
            text = text.replace(" ", "").replace("\n", "")
        theirs = library.encode(text, add_special_tokens=False).ids
        assert array("I", encoder.encoded([text])[0]).tolist() == theirs
        assert fed(bpe_stream.TextStream(encoder), text, rng) == theirs
        assert fed(bpe_stream.LongChunk(encoder), text, rng) == theirs
        assert encoder.decoder.decoded(array("I", theirs)) == library.decode(theirs, skip_special_tokens=False)


def test_long_words_in_constant_memory(library, monkeypatch):
    monkeypatch.setattr(bpe_stream, "BLOCK", 64)
    rng, encoder = random.Random(3), bpe_stream.Encoder(PATH)
    for letters in ("ab", "a", "theinganr", "abcdefghijklmnopqrstuvwxyz", "éèabc", "=-"):
        text = "".join(rng.choice(letters) for _ in range(5000))
        stream, out, held = bpe_stream.LongChunk(encoder), b"", 0
        for i in range(0, len(text), 50):
            out += stream.feed(text[i : i + 50])
            held = max(held, len(stream.word.held) + len(stream.raw))
        assert array("I", out + stream.close()).tolist() == library.encode(text, add_special_tokens=False).ids
        assert held <= encoder.merges.lookahead + 4 * 64


def proper_merges(rng, letters, count):
    symbols = [*letters, *(c + "$" for c in letters)]
    merges = []
    for _ in range(count):
        a, b = rng.choice([s for s in symbols if not s.endswith("$")]), rng.choice(symbols)
        if a + b not in symbols and len(a + b) < 9:
            symbols.append(a + b)
            merges.append((a, b))
    return symbols, merges


def test_lookahead_of_random_merge_lists(monkeypatch):
    """Tokens that are given out early are those of the whole word, for lists whose symbols have two or three letters."""
    monkeypatch.setattr(bpe_stream, "BLOCK", 1)
    letters, early = bpe_stream.byte_letters(), 0
    for seed in range(60):
        rng = random.Random(seed)
        symbols, merges = proper_merges(rng, "ab" if seed % 2 else "abc", 25)
        vocab = {s: i for i, s in enumerate(dict.fromkeys([*letters, *(c + "$" for c in letters), *symbols]))}
        m = bpe_stream.Merges(vocab, merges, "$")
        for _ in range(20):
            raw = bytes(rng.choice(b"ab" if seed % 2 else b"abc") for _ in range(rng.randrange(2, 150)))
            word, out = bpe_stream.Word(m), []
            for i in range(len(raw)):
                out += word.feed(raw[i : i + 1])
            early += len(out)
            flat, _ = m.merge_many([raw])
            assert out + word.close() == flat.tolist()
    assert early > 10_000


def test_lists_without_a_bound_are_refused():
    letters = bpe_stream.byte_letters()
    for merges in ([("a", "b"), ("ab", "c"), ("b", "c"), ("a", "bc")], [("ab", "c"), ("a", "b")]):
        vocab = {s: i for i, s in enumerate(dict.fromkeys([*letters, *(c + "$" for c in letters), "ab", "bc", "abc"]))}
        with pytest.raises(ValueError):
            bpe_stream.Merges(vocab, merges, "$")


def test_byte_machine_takes_any_cut(monkeypatch):
    monkeypatch.setattr(bpe_stream, "DECODED_AT_ONCE", 3)
    rng = random.Random(4)
    for _ in range(500):
        raw = bytes(rng.choice([65, 0xC3, 0xA9, 0xE2, 0x82, 0xAC, 0xF0, 0x9F, 0x98, 0x80, 0xFF, 0xED, 0xA0]) for _ in range(rng.randrange(30)))
        machine, out, i = bpe_stream.TextMachine(), "", 0
        while i < len(raw):
            j = i + rng.randrange(1, 4)
            out += machine.push(raw[i:j])
            assert len(machine.held) <= 3
            i = j
        assert out + machine.close() == raw.decode("utf-8", "replace")
    path = public_tokenizers.path("byte_bpe_50k.json")  # has a byte-level decoder
    other, decoder = Tokenizer.from_file(path), bpe_stream.Decoder(json.load(open(path)))
    for _ in range(300):
        ids = [rng.randrange(50257) for _ in range(rng.randrange(20))]
        assert decoder.decoded(array("I", ids)) == other.decode(ids, skip_special_tokens=False)


def results(library, rows):
    out = []
    for d, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        out.append((repr(d), len(ids), sha256(" ".join(map(str, ids)).encode()).hexdigest(), sha256(decoded.encode()).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("piece", [1 << 20, 300])
def test_operator(spark, awkward, library, piece):  # noqa: F811
    got = bpe_stream.encode_texts(frame(spark, awkward), PATH, piece_chars=piece, keep_ids=True).collect()
    assert sorted((repr(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got) == results(library, awkward)
    assert all(len(r.ids) == r.n_tokens and sha256(r.decoded.encode()).hexdigest() == r.decoded_sha256 for r in got)
    assert bpe_stream.encode_texts(frame(spark, awkward).limit(0), PATH).count() == 0


def test_query(spark, sf_dir, library):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    got = queries.op13_bpe_stream(spark, sf_dir)
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert sorted((repr(r[0]), *r[1:]) for r in got.collect()) == results(library, rows)
