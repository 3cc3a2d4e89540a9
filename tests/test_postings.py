"""Stored postings against the scan: the same rows, from the folders of the query's terms alone."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from foliospark.functions import text as T
from foliospark.operators import postings, search


@pytest.mark.parametrize("size", [256, 4])
def test_rows_of_the_scan(spark, tmp_path, monkeypatch, size):
    monkeypatch.setattr(postings, "RANGE_NOTES", size)
    rng = random.Random(3)
    words = ["the", "of", *(f"w{i}" for i in range(60)), "É", "rare"]
    rows = [(f"p{i:03d}", " ".join(rng.choices(words, [40, 20, *(1,) * 60, 1, 0.05], k=rng.randrange(0, 40)))) for i in range(150)] + [("same1", "w1 w1 w2"), ("same0", "w1 w1 w2"), ("null", None)]
    notes = spark.createDataFrame(rows, "path string, t string").withColumn("tokens", T.tokens(F.col("t")))
    postings.blocks(notes).write.partitionBy("bucket").parquet(f"file://{tmp_path}/p")
    table = spark.read.parquet(f"file://{tmp_path}/p")
    asked = ["the", "w1 w2 THE w1", "rare é", "nothing here", "", None, "w3 w4 w5 w6 w7 of the rare", "w1 w1"]
    got = postings.search(table, spark.createDataFrame(list(enumerate(asked)), "qid int, query string"), 5).collect()
    found = {q: [(r["path"], r["score_micro"]) for r in sorted((r for r in got if r.qid == q), key=lambda r: r["rank"])] for q in range(len(asked))}
    for q, text in enumerate(asked):
        plain = [(r.path, r.score_micro) for r in search.catalog_search(notes, text or "", 5).collect()] if (text or "").strip() else []
        assert found[q] == plain
    table = table.withColumn("file", F.input_file_name())
    folders = lambda df: {r[0].split("bucket=")[1].split("/")[0] for r in df.select("file").distinct().collect()}
    one = postings.read(table, postings.wanted(spark.createDataFrame([(1, "w1")], "qid int, query string")))
    assert len(folders(one)) == 1 < len(folders(table))


def test_ranges_that_cannot_matter_are_not_scored(spark):
    """A note with a far better score than all others leaves only its range, and what is as good by its sum, to be read."""
    rows = [(f"p{i:04d}", "common filler words here " * 5) for i in range(600)] + [("best", "common rare")]
    notes = spark.createDataFrame(rows, "path string, t string").withColumn("tokens", T.tokens(F.col("t")))
    table = postings.blocks(notes)
    found = postings.search(table, spark.createDataFrame([(1, "rare common")], "qid int, query string"), 1).collect()
    assert [r.path for r in found] == ["best"]
    assert [r[0] for r in table.select("range").distinct().orderBy("range").collect()] == [0, 1, 2]


def test_no_notes(spark):
    none = spark.createDataFrame([], "path string, tokens array<string>")
    assert postings.search(postings.blocks(none), spark.createDataFrame([(1, "a")], "qid int, query string")).count() == 0
