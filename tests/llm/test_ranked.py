"""Ranked lexical search against a plain version and DuckDB."""

from __future__ import annotations

import collections
import math
import random
import re

import duckdb
import numpy as np
import pytest

from foliospark.llm import queries, ranked

from .test_llm import awkward, frame, prose  # noqa: F401

TERM = re.compile(ranked.TERM)


def terms(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def plain(docs, items, top=50):
    bags = [(d, collections.Counter(terms(t))) for d, t in docs]
    bags = [(d, b, sum(b.values())) for d, b in bags if b]
    n, length, df = len(bags), sum(x for *_, x in bags), collections.Counter(t for _, b, _ in bags for t in b)
    w = {t: math.floor(1000 * math.log((2 * n + 2) / (2 * k + 1))) for t, k in df.items()}
    out = []
    for item, text in items:
        found = []
        for d, b, size in bags:
            m = 100 - 50 + (50 * size * n) // length
            score = sum(w[t] * (1_000_000_000 * b[t] // (1000 * b[t] + 20 * m)) for t in set(terms(text)) if t in b)
            if score > 0:
                found.append((-score, d is None, d or 0, d))
        out += [(item, r + 1, f[3], -f[0]) for r, f in enumerate(sorted(found)[:top])]
    return sorted(map(repr, out))


def got(df):
    assert df.columns == ["item_id", "rank", "doc_id", "score"]
    return sorted(repr(tuple(r)) for r in df.collect())


def asked(spark, items):
    return spark.createDataFrame([(i, t, "x", 1, b"v", 2) for i, t in items], "item_id string, text string, item string, m long, vector binary, rank int")


def word_items(rows, seed=3):
    rng = random.Random(seed)
    words = [w for _, t in rows if t for w in t.split()]
    items = [(f"i{k}", " ".join(rng.choice(words) for _ in range(rng.randrange(1, 30)))) for k in range(12)]
    return items + [("none", None), ("empty", ""), ("marks", "!? -- \0"), ("same", items[0][1]), ("same", items[1][1]), (None, "One TWO é two"), ("long", "a" * 5000 + " " + "é" * 300), ("absent", "zzzzzzzzqq")]


@pytest.mark.parametrize(("top", "item_bytes"), [(50, 8 << 20), (2, 500)])
def test_search(spark, awkward, top, item_bytes):  # noqa: F811
    rows = awkward + [(d, t) for d, t in awkward if d != 11] + [(200 + i, awkward[0][1]) for i in range(70)] + [(None, awkward[5][1])] * 3
    items = word_items(awkward)
    assert got(ranked.search(frame(spark, rows), asked(spark, items), top, item_bytes)) == plain(rows, items, top)


def test_empty_tables(spark, awkward):  # noqa: F811
    items = word_items(awkward)
    assert ranked.search(frame(spark, awkward).limit(0), asked(spark, items)).count() == 0
    assert ranked.search(frame(spark, awkward), asked(spark, items).limit(0)).count() == 0
    assert ranked.search(frame(spark, [(1, None), (2, "")]), asked(spark, items)).count() == 0


def test_words_with_one_hash_are_told_apart(monkeypatch):
    """Terms are found by hash and compared by bytes: with one hash for all, only equal ones stay."""
    monkeypatch.setattr(ranked, "span_hashes", lambda buf, start, end: np.full(len(start), 7, np.uint64))
    for term in (b"abc", b"abcdefgh", b"abcdefghi", b"x" * 40):
        others = [term + b"x", term[:-1], term[:-1] + b"_", b"q" + term[1:], term]
        buf = np.frombuffer(b" ".join(others), np.uint8)
        ends = np.cumsum([len(o) + 1 for o in others]) - 1
        start = ends - [len(o) for o in others]
        at, number = ranked.Terms([term]).found(buf, start, ends, np.full(len(others), 7, np.uint64))
        assert at.tolist() == [4] and number.tolist() == [0]


def test_long_texts_in_windows(spark, awkward, monkeypatch):  # noqa: F811
    rng = random.Random(8)
    text = prose(rng, 3000).replace(" ", "") + " " + prose(rng, 3000)
    buf = np.frombuffer(text.encode(), np.uint8)
    monkeypatch.setattr(ranked, "WINDOW_BYTES", 64)
    cuts = list(ranked.windows(buf))
    assert cuts[0][0] == 0 and cuts[-1][1] == len(buf) and all(a[1] == b[0] for a, b in zip(cuts, cuts[1:]))
    assert [w for a, b in cuts for w in terms(text.encode()[a:b].decode())] == terms(text)


def test_many_long_texts(spark):
    rng = random.Random(9)
    text = prose(rng, 500_000)  # beyond a window of its own
    rows = [(1, text), (2, text[: 1 << 20]), (3, "the end"), (4, text[-(1 << 20) :])]
    items = [("a", text[:300]), ("b", "the end")]
    assert len(text.encode()) > 2 * ranked.WINDOW_BYTES
    assert got(ranked.search(frame(spark, rows), asked(spark, items))) == plain(rows, items)


def test_sums_beyond_doubles(spark):
    """Weights whose sums a double does not hold are added as integers."""
    big = 10**10 + 1
    bag = lambda *terms: np.array([x for t in terms for x in (t, 2)], "<u4").tobytes()
    classes = spark.createDataFrame([(50, bag(0), [3, 4]), (50, bag(0, 1), [5])], "m long, vector binary, members array<long>")
    out = ranked.scored(classes, (np.array([0, 1, 2]), np.array([0, 0])), np.array([big, 3]), 1, 2).collect()
    each = 2 * 10**9 // (2000 + 1000)
    assert max((r.score, r.doc_id) for r in out) == ((big + 3) * each, 5)
    assert {r.score for r in out if r.doc_id in (3, 4)} <= {big * each}


def test_hot_class_leaves_its_tasks_small(spark):
    """The plan cuts a class before its exchange: a window's group limit stands on both sides."""
    docs = frame(spark, [(i, "the same text") for i in range(400)] + [(i, "other the text") for i in range(1000, 1005)])
    found = ranked.search(docs, asked(spark, [("a", "same text")]))
    assert [r.doc_id for r in found.orderBy("rank").collect()] == list(range(50))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") >= 3


def test_query(spark, sf_dir):
    read = lambda name, *cols: [tuple(r) for r in spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*cols).collect()]
    found = queries.op12_ranked(spark, sf_dir)
    rows = got(found)
    assert rows == plain(read("documents", "doc_id", "text"), read("benchmark", "item_id", "text")) and len(rows) > 500
    duck = duckdb.connect()
    for t in ("documents", "benchmark"):
        duck.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    sql = duck.sql(f"SELECT item_id, rank, doc_id, score FROM ({queries.ORACLES['op12_ranked']}) q").fetchall()
    assert sorted(map(repr, sql)) == rows
    assert dict(found.dtypes)["rank"] == "int"
