"""The corpus pipeline against plain versions of its stages, and on awkward rows."""

from __future__ import annotations

import os
from hashlib import sha256

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from foliospark.llm import common, line_dedup, mixing, ngram_join, quality, queries, sp_codec

from . import brute
from .test_llm import awkward, frame, prose  # noqa: F401

STAGES = dict(corpus_pipeline.STAGES)


@pytest.fixture(scope="module")
def sf_dir():
    return "/root/testdata/sf0.001"


def texts(df):
    return sorted((repr(r.doc_id), r.text) for r in df.collect())


def kept_by_lines(rows):
    """Texts without repeated lines; rows that lose every byte are left out, a null text becomes empty."""
    out = []
    cut = brute.line_cuts(rows, line_dedup.SHINGLE, line_dedup.SIMILARITY)
    for (doc_id, text), spans in zip(rows, cut):
        raw, gone = (text or "").encode(), set()
        for a, b in spans:
            gone.update(range(a, min(b, len(raw))))
        kept = bytes(c for i, c in enumerate(raw) if i not in gone)
        if kept or not gone:
            out.append((doc_id, kept.decode()))
    return out


def one_of_each(rows):
    """Of each group of linked rows the one with the least doc_id, null last; rows with an empty set all stay."""
    groups = brute.groups(rows)
    best: dict = {}
    for i, (d, t) in enumerate(rows):
        if brute.shingles(t):
            k = (d is None, d or 0)
            best[groups[i]] = min(best.get(groups[i], (k, i)), (k, i))
    return [r for i, r in enumerate(rows) if not brute.shingles(r[1]) or best[groups[i]][1] == i]


def test_stages_are_those_that_are_wanted(spark, sf_dir):
    assert list(STAGES) == ["quality", "line_dedup", "ngram_join", "mixing", "sentencepiece"]
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in list(STAGES.items())[:-1]:
        assert stage(spark, docs, sf_dir).columns == docs.columns, name


def test_quality_stage(spark, sf_dir, awkward):
    """The rows that the classifier accepts, as they are."""
    docs = frame(spark, awkward)
    labels = common.table(spark, sf_dir, "labels")
    # fit on the rows themselves: scores by hand from the model
    model = quality.fit(quality.statistics(docs), labels)
    xs = [f"x{i}" for i in range(len(quality.FEATURES))]
    scores = [r.s for r in quality.statistics(docs).select(*(c.alias(x) for c, x in zip(model.features(), xs))).withColumn("s", model.score(xs)).collect()]
    accepted = [row for row, s in zip(awkward, scores) if s >= 0.7]
    got = STAGES["quality"](spark, docs, sf_dir)
    assert got.columns == docs.columns
    assert sorted(map(repr, (tuple(r) for r in got.collect()))) == sorted(map(repr, (tuple(r) for r in frame(spark, accepted).collect())))


def test_quality_stage_on_given_tables(spark):
    """Of the held-out rows with labels nearly all good ones stay and nearly all others go."""
    d = "/root/testdata/sf0.01"
    docs, labels = common.table(spark, d, "documents"), common.table(spark, d, "labels")
    kept = STAGES["quality"](spark, docs, d).select("doc_id", F.lit(1).alias("kept"))
    rows = docs.join(labels, "doc_id").where(quality.held_out()).join(kept, "doc_id", "left").select("quality", F.coalesce("kept", F.lit(0)).alias("kept")).collect()
    for q in (0, 1):
        mine = [r.kept == q for r in rows if r.quality == q]
        assert mine and sum(mine) >= 0.95 * len(mine)


def test_line_stage(spark, sf_dir, awkward):
    got = STAGES["line_dedup"](spark, frame(spark, awkward), sf_dir)
    assert texts(got) == sorted((repr(d), t) for d, t in kept_by_lines(awkward))
    assert got.where("n_chars <> length(text)").count() == 0


def test_join_stage(spark, sf_dir, awkward):
    got = STAGES["ngram_join"](spark, frame(spark, awkward), sf_dir)
    plain = one_of_each(awkward)
    mine = [(repr(r.doc_id), r.text or "") for r in got.collect()]
    assert sorted(mine) == sorted((repr(d), t or "") for d, t in plain)


def test_mixing_stage(spark, sf_dir, awkward):
    """Eighty of a hundred words at most, no document twice, whole documents as they are."""
    docs = frame(spark, awkward)
    got = STAGES["mixing"](spark, docs, sf_dir)
    left = [(repr(d), t or "") for d, t in awkward]
    for r in got.collect():
        left.remove((repr(r.doc_id), r.text or ""))
    words = lambda t: len(brute.WORD.findall(t or ""))
    total = sum(words(t) for _, t in awkward)
    taken = sum(words(r.text) for r in got.collect())
    most = max(words(t) for _, t in awkward)
    assert 0.8 * total - most - 1 <= taken <= 0.8 * total


def test_token_stage(spark, sf_dir, awkward):
    library = sp_codec.Vocabulary(queries.tokenizer_path()).library
    got = sorted((repr(r.doc_id), r.n_tokens, r.decoded_sha256) for r in STAGES["sentencepiece"](spark, frame(spark, awkward), sf_dir).collect())
    ids = [library.encode(t or "", add_eos=True) for _, t in awkward]
    assert got == sorted((repr(d), len(i), sha256(library.decode(i).encode()).hexdigest()) for (d, _), i in zip(awkward, ids))


@pytest.mark.parametrize("name", list(STAGES))
@pytest.mark.parametrize("rows", [[], [(None, None)], [(1, "")], [(7, "one two three four five six"), (7, "one two three four five six")]])
def test_stages_on_hardly_any_rows(spark, sf_dir, name, rows):
    got = STAGES[name](spark, frame(spark, rows), sf_dir)
    assert got.count() <= len(rows)


def test_run_is_its_stages_one_after_the_other(spark, sf_dir):
    """``run`` against plain versions where there are any, and the operators' results for the learnt and seeded stages."""
    docs = common.table(spark, sf_dir, "documents")
    good = STAGES["quality"](spark, docs, sf_dir).orderBy("doc_id").collect()
    lines = kept_by_lines([(r.doc_id, r.text) for r in good])
    joined = one_of_each(lines)
    by_id = {r.doc_id: r for r in good}
    rows = [(d, t, by_id[d].lang, by_id[d].source, len(t)) for d, t in joined]
    mixed = mixing.mixed(spark.createDataFrame(rows, docs.schema), percent=80, max_epochs=1, as_documents=True).collect()
    library = sp_codec.Vocabulary(queries.tokenizer_path()).library
    plain = []
    for r in mixed:
        ids = library.encode(r.text, add_eos=True)
        plain.append((r.doc_id, len(ids), sha256(" ".join(map(str, ids)).encode()).hexdigest(), sha256(library.decode(ids).encode()).hexdigest()))
    folder = common.shared_dir(spark).removeprefix("file://")
    before = set(os.listdir(folder))
    got = sorted((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in corpus_pipeline.run(spark, sf_dir).collect())
    assert got == sorted(plain) and len(got) > 20
    assert len(set(os.listdir(folder)) - before) == 1  # the last stage's input; the tables of the others are deleted
    assert ngram_join.one_of_each_group(spark.createDataFrame(rows, docs.schema)).count() == len(rows)  # nothing is left to join
