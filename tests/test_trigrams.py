"""The trigram index against the scan."""

from __future__ import annotations

import random

import pytest
from foliospark.operators import search, trigrams

PATTERNS = ["rare word", "RARE", "qqq|needle", "(?:nee|hay)dle", "ne+dle", "a.c", "\\bthe\\b", "[xyz]{3}", "É word", "é word", "(ab)?needle(stack)?", "x*", "(", "\\Qrare word\\E", "(?x)ra re", "nee\\w+e", "(needle)\\1", "\\p{L}edle",
    "(?=needle)need", "needle$", "^the", "kelvin", "ſtack", "needle(?!s)", "(?-i)needle", "(?i:NEEDLE)", "NEE(DL)E", "a{2}b", "nee(?>dle)", "n(ee|oo)dle", "missing text"]


@pytest.mark.parametrize("size", [64, 1])
def test_hits_of_the_scan(spark, tmp_path, monkeypatch, size):
    monkeypatch.setattr(trigrams, "RANGE_NOTES", size)
    rng = random.Random(2)
    words = ["the", "of", "abc", "xyz", "zzz", "NEEDLE", "needles", "needleneedle", "noodle", "rare word", "É word", "É", "Kelvin", "stack", "aab", "haydle", "neeeedle"]
    rows = [(f"p{i:03d}", " ".join(rng.choices(words, [60, 60, *(1,) * 15], k=rng.randrange(0, 25)))) for i in range(300)] + [("null", None), ("empty", ""), ("two", "ab")]
    notes = spark.createDataFrame(rows, "path string, content string")
    trigrams.contents(notes).write.partitionBy("shelf").parquet(f"file://{tmp_path}/c")
    stored = spark.read.parquet(f"file://{tmp_path}/c")
    trigrams.grams(stored).write.partitionBy("bucket").parquet(f"file://{tmp_path}/g")
    index = spark.read.parquet(f"file://{tmp_path}/g")
    for p in PATTERNS:
        plain = sorted(r.path for r in search.content_matches(notes, p).select("path").collect())
        assert sorted(r.path for r in trigrams.matches(stored, index, p).select("path").collect()) == plain, p


def test_only_shelves_that_can_match_are_read(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(trigrams, "RANGE_NOTES", 1)
    rows = [(f"p{i:04d}", f"common text {i} " * 40) for i in range(700)] + [("odd", "an unusual phrase")]
    trigrams.contents(spark.createDataFrame(rows, "path string, content string")).write.partitionBy("shelf").parquet(f"file://{tmp_path}/c")
    stored = spark.read.parquet(f"file://{tmp_path}/c")
    trigrams.grams(stored).write.partitionBy("bucket").parquet(f"file://{tmp_path}/g")
    index = spark.read.parquet(f"file://{tmp_path}/g")
    (shelf,) = [r.shelf for r in stored.where("path = 'odd'").collect()]
    others = [f for f in (tmp_path / "c").glob("shelf=*/*.parquet") if f.parent.name != f"shelf={shelf}"]
    assert len(others) >= 10
    for f in others:  # what is read cannot be these
        f.write_bytes(b"broken")
    assert [r.path for r in trigrams.matches(stored, index, "unusual phrase").collect()] == ["odd"]
    with pytest.raises(Exception, match="FAILED_READ_FILE"):
        trigrams.matches(stored, index, "u.u").collect()


@pytest.mark.parametrize(
    ("pattern", "grams"),
    [("abcd", ["abc", "bcd"]), ("ABC.def", ["abc", "def"]), ("(abc|defg)x", ["abc", "def", "efg"]), ("(abc|d)x", []), ("abc?", []), ("(abc)+", ["abc"]), ("a(bc)d", ["abc", "bcd"]), ("[abc]def", ["def"]), ("\\Qabc\\E", []), ("(?iu)abc", []), ("(", [])],
)
def test_conditions(pattern, grams):
    assert trigrams.listed(trigrams.needed(pattern)) == grams
