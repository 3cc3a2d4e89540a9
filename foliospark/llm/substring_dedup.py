"""Substring dedup: content-defined chunks, deduplicated by digest.

A gear rolling hash runs over the bytes of a text; a chunk ends where the hash is the
largest within REACH bytes on either side (and the next byte starts a character). Only
those bytes decide, so an insertion moves no cut further away than that, chunks have
more than REACH bytes, and a repeated passage of a few hundred bytes holds whole chunks
that are equal in every text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import GOLD, buffers, cut_spans, materialise, mix, pieces, text_bytes, tidied, with_text_hash, writers

REACH = 32
#: Longer chunks (periodic text has no single largest hash) are cut at this stride.
LONGEST = 1024
LAST = (1 << 63) - 1


def gear_values() -> np.ndarray:
    with np.errstate(over="ignore"):
        return (mix(np.arange(1000, 1256, dtype=np.uint64) * GOLD) >> np.uint64(32)).astype(np.uint32)


def chunk_ends(buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Ends of all chunks of the texts in ``buf``, in order. Texts do not touch each other."""
    n, rows = len(buf), len(offsets) - 1
    if n == 0:
        return np.zeros(0, np.int64)
    # texts are laid out with room between them, where the hash is zero
    gap = REACH + 1
    row = np.repeat(np.arange(rows), np.diff(offsets))
    place = np.arange(n) + (row + 1) * gap
    gear = np.zeros(n + (rows + 1) * gap + 1, np.uint32)
    gear[place] = gear_values()[buf]
    for k in (1, 2, 4, 8, 16):
        gear[k:] += gear[:-k] << np.uint32(k)
    follows = np.zeros(n, bool)
    follows[:-1] = (buf[1:] & 0xC0) == 0x80
    value = np.zeros_like(gear)
    value[place[~follows]] = gear[place[~follows]]
    ahead = value.copy()  # largest of the next REACH values, from each place on
    for k in (1, 2, 4, 8, 16):
        ahead[:-k] = np.maximum(ahead[:-k], ahead[k:])
    at = place
    cut = (value[at] > ahead[at - REACH]) & (value[at] >= ahead[at + 1])
    last = np.zeros(n, bool)
    last[offsets[1:][np.diff(offsets) > 0] - 1] = True
    ends = np.flatnonzero(cut | last) + 1
    size = np.diff(np.r_[0, ends])
    if (size > LONGEST).any():
        more = [np.arange(e - s + LONGEST, e, LONGEST) for e, s in zip(ends[size > LONGEST], size[size > LONGEST], strict=True)]
        extra = np.concatenate(more)
        for _ in range(3):  # back to the start of a character
            extra -= (buf[extra] & 0xC0) == 0x80
        ends = np.union1d(ends, extra)
    return ends


def chunks(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, start, end, d1, d2 (a 128-bit digest) of each chunk of each text."""

    def work(batches):
        import xxhash

        digest = xxhash.xxh3_128_digest
        for batch in batches:
            buf, offsets = buffers(batch.column(0))
            ids, hashes = batch.column(1), batch.column(2)
            for lo, hi in pieces(offsets):
                part, at = buf[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
                ends = chunk_ends(part, at)
                starts = np.r_[0, ends[:-1]].astype(np.int64) if len(ends) else ends
                raw = part.tobytes()
                digests = b"".join([digest(raw[s:e]) for s, e in zip(starts.tolist(), ends.tolist(), strict=True)])
                d = np.frombuffer(digests, "<i8").reshape(-1, 2)
                row = np.searchsorted(at, starts, "right") - 1
                base = at[row]
                take = pa.array(row + lo)
                yield pa.record_batch(
                    [ids.take(take), hashes.take(take), pa.array((starts - base).astype(np.int32)), pa.array((ends - base).astype(np.int32)), pa.array(d[:, 0].copy()), pa.array(d[:, 1].copy())],
                    ["doc_id", "text_hash", "start", "end", "d1", "d2"],
                )

    return docs.select("text", "doc_id", "text_hash").mapInArrow(tidied(work), "doc_id long, text_hash long, start int, end int, d1 long, d2 long")


def repeated_chunks(docs: DataFrame) -> DataFrame:
    """Chunks whose digest occurs earlier: in a smaller doc_id, or further left in the same one.

    The least place of each digest is a partially aggregated minimum; chunks are joined
    with the digests that occur more than once. Those are stored first, so that the join
    stands alone between its exchanges and Spark can split a hot digest.
    """
    found = chunks(docs)
    order = F.coalesce("doc_id", F.lit(LAST))
    first = (
        found.groupBy("d1", "d2")
        .agg(F.min(F.struct(order.alias("o"), F.col("start").alias("s"))).alias("first"), F.count("*").alias("n"))
        .where("n > 1")
        .select(F.col("d1").alias("f1"), F.col("d2").alias("f2"), "first")
    )
    first = materialise(first, "first-chunks", writers(docs.sparkSession, text_bytes=text_bytes(docs)))
    later = F.struct(order.alias("o"), F.col("start").alias("s")) > F.col("first")
    return found.join(first, (F.col("d1") == F.col("f1")) & (F.col("d2") == F.col("f2"))).where(later).select("doc_id", "text_hash", "start", "end")


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_text: bool = False) -> DataFrame:
    """Remove every chunk that occurs earlier in the corpus; the first occurrence stays.

    Columns: doc_id, n_bytes, n_removed, n_spans, kept_sha256 (and kept). One row for each
    input row. A null text is empty and loses nothing. Rows with the same doc_id and text
    are one document and lose the same; a null doc_id comes after all others, and null
    ids lose nothing to each other at the same place. An empty table gives an empty result.
    """
    docs = with_text_hash(docs, id_col, text_col)
    return cut_spans(docs, repeated_chunks(docs), keep_text)
