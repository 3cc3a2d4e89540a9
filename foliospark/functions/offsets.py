"""From places in a collapsed text to places in the text itself.

Markers are looked for in collapsed texts (``text.collapsed``: white space runs are one blank,
outer ones go, lower case); what is cut out is the text as it stands. The map between the two is one
pass over a text's characters, so it is made in Arrow batches, once for all parts of a text. Markers are found there too: in Spark's
strings a place is reached by counting characters, which for the many markers of a long text is most of the work.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..sources import store

WHITE = " \t\n\v\f\r"
_WHITE = np.zeros(33, bool)
_WHITE[[ord(c) for c in WHITE]] = True
#: The one character whose lower case has two.
_DOUBLED = 0x130


def offset_map(text: str) -> np.ndarray:
    """For each character of the collapsed text its place in ``text``; a blank has the place where its run starts."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    white = _WHITE[np.minimum(codes, 32)] & (codes <= 32)
    inked = np.flatnonzero(~white)
    if not len(inked):
        return inked
    keep = ~white
    keep[1:] |= ~white[:-1]
    keep[: inked[0]] = False
    keep[inked[-1] + 1 :] = False
    at = np.flatnonzero(keep)
    return np.repeat(at, 1 + (codes[at] == _DOUBLED))


def raw_part(text: str, at: np.ndarray, start: int, stop: int) -> str:
    """The part of ``text`` from collapsed place ``start`` to before ``stop``, without outer white space."""
    stop = min(stop, len(at))
    return text[at[start] : at[stop - 1] + 1].strip(WHITE) if start < stop else ""


def located(norm: str, mark: str, start: int = 0) -> int:
    """``text.locate_in`` of one marker in one text."""
    if mark and (at := norm.find(mark, start)) >= 0:
        return at
    long = [w for w in mark.split(" ") if len(w) > 2]
    for n in (20, 12, 8, 5, 3):
        if len(long) >= n and (at := norm.find(" ".join(long[:n]), start)) >= 0:
            return at
    for word in reversed(long):
        if (at := norm.find(word, start)) >= 0:
            return max(at - 50, 0)
    return -1


def cut(text: str, norm: str, marks: list[dict], least: int) -> list[dict]:
    """ord, title, place, chunk of a text's sections; one whose start is not found, or that is short, is left out."""
    at, out = offset_map(text), []
    for m in marks:
        place = located(norm, m["start"])
        if place < 0:
            continue
        stop = -1 if m["end"] is None else located(norm, m["end"], place + m["n"])
        chunk = raw_part(text, at, place, max(stop, place) if stop >= 0 else len(norm))
        if len(chunk) > least:
            out.append({"ord": m["ord"], "title": m["title"], "place": place, "chunk": chunk})
    return out


def raw_parts(text: Column, norm: Column, marks: Column, ordinal: str, least: int) -> Column:
    """An array of ord (of type ``ordinal``), title, place, chunk: parts of a text as they stand, of more than ``least`` characters; null where there is none.

    ``norm`` is the collapsed text; ``marks``: an array of ord, title, start and end (collapsed markers, a null end is that of the text)
    and n, the characters behind the start's place from which the end is looked for.
    """

    def work(texts: pa.Array, norms: pa.Array, marks: pa.Array) -> pa.Array:
        own = pa.struct([("ord", marks.type.value_type.field("ord").type), ("title", pa.string()), ("place", pa.int32()), ("chunk", pa.string())])
        rows = ((t.as_py(), n.as_py(), m.as_py()) for t, n, m in zip(texts, norms, marks, strict=True))
        return pa.array([cut(t, n, m, least) or None if t and m else None for t, n, m in rows], pa.list_(own))

    store.small_batches()
    return F.arrow_udf(work, f"array<struct<ord:{ordinal},title:string,place:int,chunk:string>>").asNondeterministic()(text, norm, marks)
