"""Regular expressions over stored contents through an index of three-character substrings.

Notes are dealt to shelves of 64 ranges each by a hash of their paths. The index has, for each trigram
and shelf, a number whose bits are the ranges in which a note has it, letters folded. A pattern
gives a condition on trigrams that every match fulfils; the ranges that fulfil it come
from the bits, only their shelves are read, and the pattern itself decides. Patterns without a trigram, and those
of a syntax that Python does not share with Java, scan.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .search import usable

#: Notes of a range; a shelf has 64 ranges.
RANGE_NOTES, RANGES = 64, 64
BUCKETS = 64
#: Trigrams of a pattern that are asked for, and shelves whose folders are named in the plan; more are joined.
MOST_GRAMS, MOST_SHELVES = 48, 4096


def folded(text: str) -> str:
    """A text whose letters that a pattern takes for one, whatever the case, are one; character by character."""
    return text.replace("\u0130", "i").replace("\u0131", "i").casefold()


def contents(notes: DataFrame) -> DataFrame:
    """shelf, range (0 to 63), path, content of notes (path, content), to be written by ``shelf``."""
    shelves = max(1, -(-notes.count() // (RANGE_NOTES * RANGES)))
    key = F.pmod(F.xxhash64("path"), F.lit(shelves * RANGES))
    rows = notes.select((key / RANGES).cast("int").alias("shelf"), (key % RANGES).cast("int").alias("range"), "path", "content")
    return rows.repartition("shelf", F.pmod("range", F.lit(4))).sortWithinPartitions("shelf", "range")


def bucket(gram: Column) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(BUCKETS)).cast("int")


def grams(stored: DataFrame) -> DataFrame:
    """bucket, gram, shelf, mask of the stored contents, to be written by ``bucket``. The masks of a task are merged before they are exchanged."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: dict[tuple[int, int], set[str]] = {}
            for shelf, range_, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                text = folded(text.as_py() or "")
                found.setdefault((shelf, range_), set()).update(map("".join, zip(text, text[1:], text[2:])))
            for (shelf, range_), own in found.items():
                mask = 1 << range_ if range_ < 63 else -(1 << 63)
                yield pa.record_batch([pa.array(list(own), pa.string()), pa.array([shelf] * len(own), pa.int32()), pa.array([mask] * len(own), pa.int64())], ["gram", "shelf", "mask"])

    rows = stored.select("shelf", "range", "content").mapInArrow(work, "gram string, shelf int, mask long")
    merged = rows.groupBy("gram", "shelf").agg(F.bit_or("mask").alias("mask"))
    return merged.select(bucket(F.col("gram")).alias("bucket"), "gram", "shelf", "mask").repartition("bucket").sortWithinPartitions("bucket", "gram")


#: Conditions: a trigram, ("and", conditions), ("or", conditions), or None where nothing is known.
Condition = str | tuple | None


def both(parts: list[Condition]) -> Condition:
    parts = [p for p in parts if p is not None]
    return None if not parts else parts[0] if len(parts) == 1 else ("and", parts)


def run_of(text: str) -> Condition:
    text = folded(text)
    return both(list(dict.fromkeys(text[i : i + 3] for i in range(len(text) - 2))))


def needed(pattern: str) -> Condition:
    """What trigrams a text with a match of ``pattern``, whatever the case, has."""
    from re import _parser as parser

    if re.search(r"\(\?[a-zA-Z-]*[uxdUL]", pattern) or "\\Q" in pattern:
        return None  # flags that change what letters are alike or what is a letter of the pattern
    try:
        tree = parser.parse(pattern)
    except (re.error, OverflowError, RecursionError):
        return None

    def of(items) -> Condition:
        parts, run = [], ""

        def cut() -> None:
            nonlocal run
            parts.append(run_of(run))
            run = ""

        for op, arg in items:
            name = str(op)
            if name == "LITERAL":
                run += chr(arg)
            elif name == "SUBPATTERN":
                inner = list(arg[3])
                if all(str(o) == "LITERAL" for o, _ in inner) and not arg[1] and not arg[2]:
                    run += "".join(chr(a) for _, a in inner)
                else:
                    cut()
                    parts.append(of(inner))
            elif name == "BRANCH":
                cut()
                ways = [of(w) for w in arg[1]]
                parts.append(None if None in ways else ("or", ways))
            elif name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT"):
                cut()
                if arg[0] > 0:
                    parts.append(of(arg[2]))
            elif name == "ATOMIC_GROUP":
                cut()
                parts.append(of(arg))
            else:  # classes, places, looks around, references
                cut()
        cut()
        return both(parts)

    return of(tree)


def listed(condition: Condition) -> list[str]:
    if condition is None:
        return []
    return [condition] if isinstance(condition, str) else list(dict.fromkeys(g for c in condition[1] for g in listed(c)))


def masked(condition: Condition, known: dict[str, Column]) -> Column | None:
    """The ranges that fulfil a condition, as far as its trigrams are known."""
    if isinstance(condition, str):
        return known.get(condition)
    parts = [masked(c, known) for c in condition[1]]
    if condition[0] == "or":
        return None if any(p is None for p in parts) else reduce(lambda a, b: a.bitwiseOR(b), parts)
    parts = [p for p in parts if p is not None]
    return reduce(lambda a, b: a.bitwiseAND(b), parts) if parts else None


def matches(stored: DataFrame, index: DataFrame, pattern: str) -> DataFrame:
    """path and content of the notes whose content holds the pattern, whatever the case; a bad pattern matches nothing.

    ``stored`` and ``index``: the tables of ``contents`` and ``grams``.
    """
    whole = f"(?iu){pattern}"
    if not usable(stored.sparkSession, whole):
        return stored.select("path", "content").where(F.lit(False))
    condition = needed(pattern)
    asked = listed(condition)[:MOST_GRAMS]
    rows = stored
    if asked:
        folders = sorted({r[0] for r in index.sparkSession.createDataFrame([(g,) for g in asked], "gram string").select(bucket(F.col("gram"))).collect()})
        own = index.where(F.col("bucket").isin(folders) & F.col("gram").isin(asked))
        masks = own.groupBy("shelf").agg(*(F.coalesce(F.bit_or(F.when(F.col("gram") == g, F.col("mask"))), F.lit(0).cast("long")).alias(f"g{i}") for i, g in enumerate(asked)))
        mask = masked(condition, {g: F.col(f"g{i}") for i, g in enumerate(asked)})
        if mask is not None:
            found = masks.select("shelf", mask.alias("mask")).where("mask <> 0")
            shelves = [r[0] for r in found.select("shelf").limit(MOST_SHELVES + 1).collect()]
            if len(shelves) <= MOST_SHELVES:
                rows = rows.where(F.col("shelf").isin(shelves))
            rows = rows.join(found, "shelf").where(F.expr("(shiftrightunsigned(mask, range) & 1L) = 1L"))
    return rows.where(F.col("content").rlike(whole)).select("path", "content")
