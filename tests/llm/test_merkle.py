"""The Merkle manifest against a plain tree and DuckDB."""

from __future__ import annotations

import random
import zlib
from hashlib import sha256

import duckdb
import pytest

from foliospark.llm import merkle, queries

from .test_llm import CLASH, awkward  # noqa: F401

SCHEMA = "doc_id long, source string, lang string, n_chars int, text string, idx int, k string, leaf string, total int, path string, digest string, row int"


def H(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def plain_leaf(row):
    return H(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def plain_tree(leaves, now):
    """Top, and for each leaf its siblings' text and the fold of what it is now."""
    level, own, proofs, folds = leaves, list(range(len(leaves))), [""] * len(leaves), list(now)
    while len(level) > 1:
        for i, at in enumerate(own):
            first = at - at % 8
            before, after = "".join(level[first:at]), "".join(level[at + 1 : first + 8])
            proofs[i] += before + after
            folds[i] = H(before, folds[i], after)
        level, own = [H(*level[j : j + 8]) for j in range(0, len(level), 8)], [at // 8 for at in own]
    return level[0], proofs, folds


def plain(rows):
    """rows: doc_id, source, lang, n_chars, text."""
    by_lang = {}
    for r in rows:
        by_lang.setdefault(r[2], []).append(r)
    langs, tops, parts = sorted(by_lang, key=lambda x: (x is not None, (x or "").encode())), [], []
    for lang in langs:
        group = sorted(by_lang[lang], key=lambda r: (r[0] is not None, r[0] or 0, plain_leaf(r)))
        now = [r[:4] + (r[4] and "".join(c.lower() if "A" <= c <= "Z" else c for c in r[4]),) if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0 else r for r in group]
        top, proofs, folds = plain_tree([plain_leaf(r) for r in group], [plain_leaf(r) for r in now])
        tops.append(top)
        parts.append((group, proofs, folds))
    root, up, _ = plain_tree(tops, tops)
    out = []
    for i, (group, proofs, folds) in enumerate(parts):
        for r, proof, fold in zip(group, proofs, folds):
            final = plain_tree(tops, [fold if j == i else t for j, t in enumerate(tops)])[2][i]
            out.append((repr(r[0]), plain_leaf(r), tops[i], root, H(proof + up[i]), final, final == root))
    return sorted(out)


def got(df):
    cols = ["leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    return sorted((repr(r["doc_id"]), *(r[c] for c in cols)) for r in df.collect())


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "k", "l", 2, "p", "d", 3) for r in rows], SCHEMA)


def rows_of(awkward, langs, seed=1):
    rng = random.Random(seed)
    return [(d, rng.choice(["s1", None, ""]), rng.choice(langs), rng.choice([None, 5]), t) for d, t in awkward]


def test_places_of_nodes():
    """The closed form is the place where the builder writes the node, for every size up to three levels and odd last runs."""
    for n in [*range(1, 80), 511, 512, 513, 600]:
        for levels in {merkle.height(n), merkle.height(n) + 1}:
            leaves = [H(str(i)) for i in range(n)]
            log = merkle.appended(leaves, levels)
            level = leaves
            for k in range(levels + 1):
                assert [log[merkle.position(k, min((j + 1) * 8**k, n))] for j in range(len(level))] == level
                level = [H(*level[j : j + 8]) for j in range(0, len(level), 8)]


@pytest.mark.parametrize(("levels", "langs"), [(4, ["en", None, "", "é", "z"]), (2, ["en"]), (1, ["en", None, "", "é", "z"]), (1, [f"l{i}" for i in range(12)])])
def test_manifest(spark, awkward, levels, langs):  # noqa: F811
    """With builders of 8 and 64 leaves a tree has several rounds."""
    rows = rows_of(awkward, langs) * 3 + [(7, None, None, None, None), (0, "a", "lone", 1, "ABC")]
    rows += [(i, "s", langs[0], 3, f"Text {i}") for i in range(200)]
    assert got(merkle.manifest(frame(spark, rows), changed=merkle.lowered, levels=levels)) == plain(rows)


def test_lone_leaf_and_empty_table(spark):
    one = [(3, "s", None, 1, "abc")]
    assert got(merkle.manifest(frame(spark, one), changed=merkle.lowered)) == plain(one)
    assert merkle.manifest(frame(spark, one).limit(0)).count() == 0
    row = merkle.manifest(frame(spark, one)).first()
    assert row.root == row.leaf == row.folded_root and row.proof_sha256 == H("") and row.verified


def test_hot_group_over_many_tasks(spark, monkeypatch):
    from foliospark.llm import common

    monkeypatch.setattr(common, "TASK_ROWS", 100)
    rows = [(i % 7 and i, "s", "en" if i % 9 else None, i, f"T{i}") for i in range(900)]
    assert got(merkle.manifest(frame(spark, rows), changed=merkle.lowered)) == plain(rows)


def test_query(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "lang", "n_chars", "text").collect()]
    found = queries.op11_merkle(spark, sf_dir)
    result = got(found)
    assert result == plain(rows) and {r[-1] for r in result} == {True, False}
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    cols = sorted(found.columns)
    sql = duck.sql(f"SELECT {', '.join(cols)} FROM ({queries.ORACLES['op11_merkle']}) q").fetchall()
    assert sorted(map(repr, sql)) == sorted(repr(tuple(r)) for r in found.select(*cols).collect())
