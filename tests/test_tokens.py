"""Model tokens against the tiktoken library, and the operators that count them against plain loops."""

from __future__ import annotations

import base64
import random

import public_tokenizers
import pytest
import tiktoken

from foliospark.functions import tokens
from foliospark.operators import pages
from foliospark.plans import registry

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")
PARTS = ["a", "the", " the", "ing", "'s", "'RE", "'ve", "don't", "\n", "\n\n", "  ", " ", "\t", "é", "é", "汉字", " 汉", "がぎ", "한국어", "👍🏽", "👨‍👩‍👧", "!", "...", " --", "1", "1234567", "٣", "½", " ", "​", "\x00", "\x1c", "\x85", "<|endoftext|>", "aaaaaaaa", "zqxjk", "İ", "ﬁ", "Ωmega", "क्षि"]


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def own():
    return tokens.RankedPairs(PATH, public_tokenizers.PATTERN)


def test_ids_are_the_librarys(library, own):
    rng = random.Random(6)
    for k in range(3000):
        text = "".join(rng.choice(PARTS) for _ in range(rng.randrange(25)))
        if k % 50 == 0:
            text = "".join(rng.choice("abcdeé ") for _ in range(3000)).replace(" ", "" if k % 100 else " ")
        ids = library.encode_ordinary(text)
        assert own.ids(text) == ids
        ends = own.ends(text)
        assert [b - a for a, b in zip([0, *ends], ends)] == [len(library.decode_single_token_bytes(i)) for i in ids]


def test_cuts_are_the_librarys(library, own):
    rng = random.Random(7)
    for _ in range(300):
        text = "".join(rng.choice(PARTS) for _ in range(rng.randrange(40)))
        n = rng.randrange(30)
        ids = library.encode_ordinary(text)
        assert tokens.cut(own, text, n) == (text if len(ids) <= n else library.decode(ids[:n]))


def plain_page(library, path, text, limit, size, overlap):
    ids = library.encode_ordinary(text)
    if len(ids) <= limit:
        return text
    chunks = [library.decode(ids[i : i + size]) for i in range(0, len(ids), size - overlap)]
    trim = lambda t: t if len(library.encode_ordinary(t)) <= limit else library.decode(library.encode_ordinary(t)[:limit])
    if len(chunks) == 1:
        return trim(text)
    head = f"[Large page: {path} — {len(chunks)} sections, showing first {min(3, len(chunks))} most relevant sections]\n\n"
    whole = head + trim("\n\n---\n\n".join(chunks[:3]))
    return trim(whole) + pages.TRUNCATED if len(library.encode_ordinary(whole)) > limit else whole


def test_pages_windows_and_budgets(spark, library, own, monkeypatch):
    monkeypatch.setattr(pages, "WINDOW", 25)
    monkeypatch.setattr(pages, "OVERLAP", 5)
    rng = random.Random(8)
    texts = ["".join(rng.choice(PARTS) for _ in range(k)) for k in (0, 3, 10, 20, 40, 200)]
    rows = spark.createDataFrame([(k, f"p{k}.md", t) for k, t in enumerate(texts)] + [(9, "null.md", None)], "doc_id int, path string, content string")
    wanted = spark.createDataFrame([(f"p{k}",) for k in range(6)] + [("none",), ("null",)], "path string")
    for limit in (10, 30, 100):
        got = {r.path: r.page for r in pages.read_page(rows, wanted, limit, own).collect()}
        assert got == {f"p{k}": plain_page(library, f"p{k}.md", t, limit, 25, 5) for k, t in enumerate(texts)} | {"none": "[Page not found: none]", "null": "[Page not found: null]"}
    got = sorted(tuple(r) for r in pages.token_windows(rows.select("doc_id", rows["content"].alias("text")), own, 12, 4).collect())
    plain = []
    for k, t in enumerate(texts):
        ids = library.encode_ordinary(t)
        plain += [(k, w, i, len(ids[i : i + 12]), library.decode(ids[i : i + 12])) for w, i in enumerate(range(0, len(ids), 8))]
    assert got == sorted(plain)
    pages_ = [("s", k, t) for k, t in enumerate(texts)] + [("t", 0, "short")]
    got = {r.source: r.text for r in pages.read_raw(spark.createDataFrame(pages_, "source string, ord long, text string"), 60, own).collect()}
    left, parts = 60, []
    for t in texts:
        if left <= 0:
            break
        ids = library.encode_ordinary(t)
        parts.append(t if len(ids) <= left else library.decode(ids[:left]))
        left -= min(left, len(ids))
    assert got == {"s": "\n\n".join([*parts, pages.CUT_OFF]), "t": "short"}


def test_queries(spark, sf_dir, library):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    assert {r.doc_id: r.n for r in registry.QUERIES["q_model_tokens"](spark, sf_dir).collect()} == {d: len(library.encode_ordinary(t)) for d, t in texts.items()}
    got = {r.path: r.page for r in registry.QUERIES["q_model_pages"](spark, sf_dir).collect()}
    long = [d for d, t in texts.items() if len(library.encode_ordinary(t)) > 4000]
    assert len(got) == len(texts) and long
    for d in long:
        path = next(p for p in got if p.endswith(f"/doc-{d}.md"))
        assert got[path] == plain_page(library, path, texts[d], 4000, 2500, 400)
