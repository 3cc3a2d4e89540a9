"""Nested properties against a YAML library, where there is one, and in notes."""

from __future__ import annotations

import json
import random

import pytest
from pyspark.sql import functions as F

from foliospark.functions import nested
from foliospark.operators import catalog

BLOCKS = [
    "a: |\n  one\n   two\n\n  three\n\nb: x", "a: >\n  one\n  two\n\n  three\n   ind\n  back\nb: 1", "m:\n  k: v\n  l:\n    - 1\n    - x: y\n      z: 'it''s'\n  e: \"q\\n\"", "l:\n- a: 1\n  b: 2\n- c",
    "a: |-\n  x\nb: >+\n  y\n\nc: [a, \"b, c\"]", "a: |2\n   x\n  y", "just text", "- a\n- b", "a: b # c\nd:\n  - - 1\n    - 2\n  - 3", "a: one\n  two\n  three\nb:\n\n  c: d", "a:\n  text of\n  two lines",
    "a: >\n  x\n\n\n  y\n\n   z\n\n  w\n", "a: |\n\n  x\nb: ~", "a: >-\n   a\n   b\n\n     c\n     d\n   e", "a:\n  b:\n    c: |\n      deep\n     \n      er\n  d: 1", "a: |\nb: x", "a: 1\n b: 2", "a:\n  - b: |\n      x\n    c: y\n  -\n    z: 1\n  - >\n    f\n    g",
]


def plain(yaml, text):
    """What the library reads, with scalars as the text that they are."""

    class Loader(yaml.SafeLoader):
        yaml_implicit_resolvers = {k: [r for r in v if r[0] == "tag:yaml.org,2002:null"] for k, v in yaml.SafeLoader.yaml_implicit_resolvers.items()}

    try:
        found = yaml.load(text, Loader)
    except yaml.YAMLError:
        return None
    return found if isinstance(found, dict) else None


def own(text):
    found = nested.mapping(text)
    return None if found is None else {k: None if v is None else json.loads(v) for k, v in found.items()}


@pytest.mark.parametrize("text", BLOCKS)
def test_as_the_library_reads(text):
    assert own(text) == plain(pytest.importorskip("yaml"), text)


def written(rng, depth, indent):
    """A random mapping or list as text."""
    pad, out = " " * indent, []
    for k in range(rng.randrange(1, 4)):
        kind = rng.randrange(6 if depth else 4)
        key = f"k{k}"
        if kind == 0:
            out.append(f"{pad}{key}: plain text {k}")
        elif kind == 1:
            out.append(f"{pad}{key}: " + rng.choice(["'it''s'", '"a \\"b\\" \\u00e9"', "[x, 'y, z', \"w\"]", "~", "x # note"]))
        elif kind in (2, 3):
            lines = [rng.choice(["one two", "three", "", "  more", "- x", "k: v", "# no comment"]) for _ in range(rng.randrange(1, 5))]
            lines[0] = "first"
            out.append(f"{pad}{key}: " + rng.choice("|>") + rng.choice(["", "-", "+"]))
            out += [f"{pad}   {x}" if x else "" for x in lines]
        elif kind == 4:
            out += [f"{pad}{key}:", *written(rng, depth - 1, indent + rng.randrange(1, 4))]
        else:
            step = rng.randrange(0, 3)
            out.append(f"{pad}{key}:")
            for _ in range(rng.randrange(1, 4)):
                if rng.random() < 0.4 and depth > 1:
                    inner = written(rng, depth - 1, indent + step + 2)
                    out += [f"{pad}{' ' * step}- {inner[0].strip()}", *inner[1:]]
                else:
                    out.append(f"{pad}{' ' * step}- item {rng.randrange(9)}")
    return out


def test_random_blocks():
    yaml, rng, met = pytest.importorskip("yaml"), random.Random(5), 0
    for _ in range(1500):
        text = "\n".join(written(rng, 3, 0)) + rng.choice(["", "\n", "\n\n"])
        whole = plain(yaml, text)
        if whole is not None:
            assert own(text) == whole, text
            met += 1
    assert met > 1000


def test_notes_with_nested_properties(spark):
    note = "## Wiki-note\n\n### Properties\ntitle: \"A\"\nsummary: |\n  line one\n  line two\nkeywords:\n  - x\n  - 'y z'\nmore:\n  deep: 1\n\n## Content\nbody"
    other = "## Wiki-note\n\n### Properties\nsummary: >-\n  folded\n  text\n  x: y\ntype: concept\n"
    bad = "### Properties\nsummary: |\nno key\n"
    rows = spark.createDataFrame([("concepts/a.md", note), ("concepts/b.md", other), ("concepts/c.md", bad), ("concepts/d.md", "### Properties\nsummary: one\n  two\n")], "path string, markdown string")
    got = {r.path[9]: r for r in catalog.parse(rows).collect()}
    assert (got["a"].title, got["a"].summary, got["a"].keywords, got["a"].body) == ("A", "line one\nline two\n", ["x", "y z"], "## Content\nbody")
    assert (got["b"].summary, got["b"].type) == ("folded text x: y", "concept")
    assert got["c"].summary == "No summary provided." and got["d"].summary == "one two"
    assert [r[0] for r in rows.orderBy("path").select(nested.is_nested(F.expr("substring_index(markdown, '## Content', 1)"))).collect()] == [True, True, True, False]
