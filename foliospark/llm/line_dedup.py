"""Line dedup: fuzzy lines by MinHash.

A line is a set of shingles of SHINGLE characters; a line with fewer characters is its own
one shingle, so only equal lines are like it, and they meet by their hash. The signature of
a longer one has the least values of ``BANDS * ROWS`` hash functions; lines whose signatures
agree in a band are candidates, compared by the exact Jaccard similarity of their shingle
sets. Distributed union-find joins equal and similar lines, and the first line of each
component stays.

Recall of one pair at similarity s is ``1 - (1 - s**ROWS)**BANDS``: 0.985 at 0.8, 0.998
at 0.85. All lines with one band key are compared with each other: up to FEW as pairs. The
lines of a hot key, which has more, are compared with one of them first and then in blocks
(see ``blocks``), whose tasks find links that connect what all similar pairs connect.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks
from .common import GOLD, SPACES, bucket_count, buffers, cut_spans, materialise, mix, pack_rows, packed_texts, pieces, runs, same_document, span_hashes, text_bytes, tidied, unpack_rows, unpacked, with_text_hash, words8, writers
from .components import components

SHINGLE = 8
BANDS, ROWS = 8, 4
SIMILARITY = 0.8
LAST = (1 << 63) - 1
BAND = np.dtype([("key", "<u8"), ("h", "<u8"), ("size", "<i4"), ("kind", "u1")])
#: Kinds of band rows: of a key with few lines in this task, the first FEW of a key with more, and the others.
COLD, FIRST, OTHER = 0, 1, 2
FEW = 6
#: Lines and bytes of a block of a hot key, on average.
BLOCK_LINES, BLOCK_BYTES = 512, 1 << 19
#: Band rows that a task holds before it deals them out.
HELD = 1 << 19
#: Bytes of text whose signatures are made at once, eight bytes and more for each.
PIECE = 1 << 16


def line_places(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, start and end (without the line end) of each line but blank ones, which have white space alone."""
    n = len(buf)
    breaks = np.flatnonzero(buf == 10)
    starts = np.union1d(np.r_[breaks + 1, offsets[:-1]], [])
    starts = starts[starts < n].astype(np.int64)
    row = np.searchsorted(offsets, starts, "right") - 1
    nxt = np.searchsorted(breaks, starts)
    ends = np.minimum(np.r_[breaks, n][nxt], offsets[row + 1])
    inked = np.r_[0, np.cumsum(~SPACES[buf], dtype=np.int64)]
    keep = inked[ends] > inked[starts]
    return row[keep], starts[keep], ends[keep]


def line_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    import xxhash

    raw, digest = buf.tobytes(), xxhash.xxh3_64_intdigest
    return np.array([digest(raw[s:e]) for s, e in zip(starts.tolist(), ends.tolist(), strict=True)], np.uint64)


def shingles(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The order in which lines are taken, a 64-bit value for each of their shingles, and how many each line has.

    Eight characters of a byte each are one number; wider ones have a hash of their bytes.
    Lines with wide characters come last: only they are searched for where characters start.
    """
    high = np.r_[0, np.cumsum(buf >= 0x80)]
    wide = high[ends] > high[starts]
    order = np.argsort(wide, kind="stable")
    plain = order[: len(order) - int(wide.sum())]
    s, count = starts[plain], np.maximum(ends[plain] - starts[plain] - SHINGLE + 1, 0)
    values = words8(buf)[np.repeat(s - np.cumsum(count) + count, count) + np.arange(count.sum())]
    if len(plain) == len(order):
        return order, values, count
    s, size = starts[order[len(plain) :]], (ends - starts)[order[len(plain) :]]
    to = np.cumsum(size)
    own = buf[np.repeat(s - to + size, size) + np.arange(to[-1])]
    first = np.flatnonzero((own & 0xC0) != 0x80)
    lo, hi = np.searchsorted(first, to - size), np.searchsorted(first, to)
    more = np.maximum(hi - lo - SHINGLE + 1, 0)
    at = np.repeat(lo - np.cumsum(more) + more, more) + np.arange(more.sum())
    s, e = first[at], np.minimum(np.r_[first, len(own)][at + SHINGLE], np.repeat(to, more))
    found = words8(own)[s]
    far = np.flatnonzero(e - s > SHINGLE)
    found[far] = span_hashes(own, s[far], e[far])
    return order, np.r_[values, found], np.r_[count, more]


def band_keys(values: np.ndarray, count: np.ndarray) -> np.ndarray:
    """One 64-bit key for each line (of one shingle at least) and band."""
    first = np.cumsum(count) - count
    x = (mix(values) >> np.uint64(32)).astype(np.uint32)
    factors = (mix(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64) * GOLD) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
    keys = np.zeros((BANDS, len(count)), np.uint64)
    values = np.empty_like(x)
    for k in range(BANDS * ROWS):
        np.multiply(x, factors[k], out=values)
        keys[k // ROWS] = mix(keys[k // ROWS] * GOLD + np.minimum.reduceat(values, first) + np.uint64(k // ROWS + 1))
    return keys


def lines(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, start, end, h (as signed long) of each line that is not blank."""

    def work(batches):
        for batch in batches:
            buf, offsets = buffers(batch.column(0))
            for lo, hi in pieces(offsets):
                part, at = buf[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
                row, s, e = line_places(part, at)
                take = pa.array(row + lo)
                h = line_hashes(part, s, e).view(np.int64)
                yield pa.record_batch([batch.column(1).take(take), batch.column(2).take(take), pa.array((s - at[row]).astype(np.int32)), pa.array((e - at[row]).astype(np.int32)), pa.array(h)], ["doc_id", "text_hash", "start", "end", "h"])

    return docs.select("text", "doc_id", "text_hash").mapInArrow(tidied(work), "doc_id long, text_hash long, start int, end int, h long")


def candidates(docs: DataFrame, total: int) -> DataFrame:
    """Lines that share a band key, as a, b, size: a pair of line hashes with size 0, or the key
    (as signed long), the hash and the bytes of a line, for each line of a hot key. ``total``: the bytes of all texts."""
    buckets = bucket_count(docs.sparkSession, total)

    def flush(held):
        keys, hs, sizes = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.lexsort((hs, keys))
        order = order[runs(keys[order], hs[order])]
        out = np.zeros(len(order), BAND)
        out["key"], out["h"], out["size"] = keys[order], hs[order], sizes[order]
        start = runs(out["key"])
        count = np.diff(np.r_[start, len(out)])
        out["kind"] = np.where(np.repeat(count, count) > FEW, FIRST, COLD)
        # a bucket gets few lines of a hot key from each task; the others, known as hot, travel by their own hash
        other = np.arange(len(out)) - np.repeat(start, count) >= FEW
        out["kind"][other] = OTHER
        yield from pack_rows(np.where(other, mix(out["h"] ^ out["key"]), out["key"]), out, buckets)

    def work(batches):
        held, size = [], 0
        for batch in batches:
            buf, offsets = buffers(batch.column(0))
            for lo, hi in pieces(offsets, PIECE):
                part, at = buf[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
                _, s, e = line_places(part, at)
                long = e - s >= SHINGLE
                s, e = s[long], e[long]
                h, first = np.unique(line_hashes(part, s, e), return_index=True)
                s, e = s[first], e[first]
                order, values, count = shingles(part, s, e)
                order = order[count > 0]
                if not len(order):
                    continue
                keys = band_keys(values, count[count > 0])
                held.append((keys.ravel(), np.tile(h[order], BANDS), np.tile((e - s)[order].astype(np.int32), BANDS)))
                size += keys.size
                if size > HELD:
                    yield from flush(held)
                    held, size = [], 0
        if held:
            yield from flush(held)

    def resolve(payload: pa.Table) -> pa.Table:
        rows = unpack_rows(payload["payload"], BAND)
        other = rows[rows["kind"] == OTHER]
        rows = rows[rows["kind"] != OTHER]
        rows = rows[np.lexsort((rows["h"], rows["key"]))]
        start = runs(rows["key"])
        told = np.maximum.reduceat(rows["kind"], start) == FIRST if len(rows) else np.zeros(0, bool)
        told = np.repeat(told, np.diff(np.r_[start, len(rows)]))
        once = runs(rows["key"], rows["h"])
        rows, told = rows[once], told[once]
        start = runs(rows["key"])
        count = np.diff(np.r_[start, len(rows)])
        hot = told | (np.repeat(count, count) > FEW)
        place = np.arange(len(rows)) - np.repeat(start, count)
        a, b = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)]
        for back in range(1, FEW):
            at = np.flatnonzero((place >= back) & ~hot)
            a.append(rows["h"][at])
            b.append(rows["h"][at - back])
        a, b = np.concatenate(a), np.concatenate(b)
        order = np.lexsort((b, a))
        order = order[runs(a[order], b[order])]
        hot = np.concatenate([rows[hot], other])
        size = np.r_[np.zeros(len(order), np.int32), hot["size"]]
        a, b = np.r_[a[order], hot["key"]], np.r_[b[order], hot["h"]]
        return pa.table([pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), pa.array(size)], ["a", "b", "size"])

    dealt = docs.select("text").mapInArrow(tidied(work), "bucket int, payload binary")
    return dealt.groupBy("bucket").applyInArrow(resolve, "a long, b long, size int").distinct()


def line_texts(docs: DataFrame, found: DataFrame, wanted: DataFrame) -> DataFrame:
    """h and the bytes of one line of each wanted hash; the place of a line is aggregated before the join, partially before its exchange."""
    place = found.groupBy("h").agg(F.min(F.struct("doc_id", "text_hash", "start", "end")).alias("p")).join(wanted, "h", "left_semi")
    of_doc = place.groupBy(F.col("p.doc_id").alias("doc_id"), F.col("p.text_hash").alias("text_hash")).agg(F.collect_list(F.struct("h", F.col("p.start").alias("s"), F.col("p.end").alias("e"))).alias("places"))
    packed = packed_texts(docs.select("doc_id", "text", "text_hash"))
    joined = packed.join(of_doc, same_document(packed, of_doc)).select("z", "places")

    def work(batches):
        for batch in batches:
            hs, out = [], []
            for text, places in zip(unpacked(batch.column(0)), batch.column(1).to_pylist(), strict=True):
                for p in places:
                    hs.append(p["h"])
                    out.append(text[p["s"] : p["e"]])
            yield pa.record_batch([pa.array(hs, pa.int64()), pa.array(out, pa.binary())], ["h", "line"])

    # equal rows of the input give the same line more than once
    return joined.mapInArrow(tidied(work), "h long, line binary").dropDuplicates(["h"])


def shingle_sets(lines: list[bytes]) -> list[np.ndarray]:
    """The values of the distinct shingles of each line, sorted."""
    to = np.cumsum([len(x) for x in lines])
    order, values, count = shingles(np.frombuffer(b"".join(lines), np.uint8), np.r_[0, to[:-1]], to)
    found = np.split(values, np.cumsum(count)[:-1])
    out: list[np.ndarray] = [values[:0]] * len(lines)
    for i, v in zip(order.tolist(), found, strict=True):
        v.sort()
        out[i] = v[runs(v)]
    return out


def alike(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether the Jaccard similarity of two sorted sets is SIMILARITY or more; sizes too far apart rule it out."""
    if len(a) > len(b):
        a, b = b, a
    if len(a) < SIMILARITY * len(b):
        return False
    both = np.count_nonzero(b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a)
    return bool(both / (len(a) + len(b) - both) >= SIMILARITY)


def group_links(sets: list[np.ndarray], left: int = 0) -> list[tuple[int, int]]:
    """Links, by places, that connect what all similar pairs connect: of the first ``left`` sets with the others, or of all."""
    n = np.array([len(s) for s in sets])
    _, inverse, df = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(sets)), n)[np.argsort(inverse, kind="stable")]
    first = np.cumsum(df) - df
    tokens = np.split(inverse, np.cumsum(n)[:-1])
    root = list(range(len(sets)))
    links = []

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    def link(i: int) -> None:
        t = tokens[i][df[tokens[i]] > 1]
        if len(t) / n[i] < SIMILARITY:
            return
        size = df[t]
        at = np.repeat(first[t] - np.cumsum(size) + size, size) + np.arange(size.sum())
        both = np.bincount(owner[at], minlength=len(sets))
        hit = np.flatnonzero(both / (n + n[i] - both) >= SIMILARITY)
        if left:
            hit = hit[hit >= left] if i < left else hit[hit < left]
        for j in hit.tolist():
            a, b = find(i), find(j)
            if a != b:
                root[a] = b
                links.append((i, j))

    # the set that shares most comes first; sets joined with it need no look of their own
    weight = np.array([df[t].mean() for t in tokens])
    order = np.argsort(-weight, kind="stable").tolist()
    centre, passed = order[0], False
    link(centre)
    for i in order[1:]:
        if left and i >= left:
            continue
        if find(i) == find(centre):
            passed = True
        else:
            link(i)
    if left and passed:  # a set passed over was not compared with the other side's sets that are not joined
        for j in order[1:]:
            if j >= left and find(j) != find(centre):
                link(j)
    return links


def hot_links(members: DataFrame, texts: DataFrame) -> DataFrame:
    """Edges a, b: they connect what all similar pairs of lines of one hot key connect. ``members``: key, h, size."""
    each = members.groupBy("key").agg(F.count("*").alias("n"), F.bit_xor("h").alias("x"), F.bit_xor(F.xxhash64("h")).alias("y"))
    # keys with the same lines are one
    keys = each.groupBy("n", "x", "y").agg(F.min("key").alias("key")).where("n > 1")
    rows = writers(members.sparkSession, rows=members.count())
    own = materialise(members.join(materialise(keys.select("key"), "hot-keys", rows), "key").select(F.col("key").alias("g"), F.col("h").alias("item"), F.col("size").cast("long").alias("size")), "hot-lines", rows)

    def similar(x: bytes, y: bytes) -> bool:
        return alike(*shingle_sets([x, y]))

    edges, placed = blocks.placed(own, texts.select(F.col("h").alias("item"), F.col("line").alias("value")), similar, BLOCK_LINES, BLOCK_BYTES)
    pools = max(1, (own.agg(F.sum("size")).first()[0] or 0) // BLOCK_BYTES)
    # keys of one block share a task's call; a pair of blocks has its own
    pool = F.when(F.col("i") < 0, F.pmod(F.xxhash64("g"), F.lit(pools))).otherwise(F.xxhash64("g", "i", "j"))

    def join(group: pa.Table) -> pa.Table:
        key, i, j, side, h = (group[c].to_numpy() for c in ("g", "i", "j", "side", "item"))
        text = group["line"]
        a, b = [], []
        order = np.lexsort((h, side, j, i, key))
        start = runs(key[order], i[order], j[order])
        for lo, hi in zip(start.tolist(), [*start[1:].tolist(), len(order)], strict=True):
            at = order[lo:hi]
            left = int((side[at] == 0).sum())
            if len(at) < 2 or left == len(at):
                continue
            for x, y in group_links(shingle_sets([text[k].as_py() for k in at.tolist()]), left):
                a.append(h[at[x]])
                b.append(h[at[y]])
        return pa.table([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    rows = placed.withColumn("pool", pool).join(texts.withColumnRenamed("h", "item"), "item")
    found = rows.select("pool", "g", "i", "j", "side", "item", "line").groupBy("pool").applyInArrow(join, "a long, b long")
    return edges.union(found)


def similar_lines(docs: DataFrame, found: DataFrame, total: int) -> DataFrame:
    """Edges a, b between hashes of different lines with a similarity of SIMILARITY or more. ``total``: the bytes of all texts."""
    parts = writers(docs.sparkSession, text_bytes=total)
    met = materialise(candidates(docs, total), "line-pairs", parts)
    pairs = met.where("size = 0").select("a", "b")
    members = met.where("size > 0").select(F.col("a").alias("key"), F.col("b").alias("h"), "size")
    nodes = pairs.select(F.col("a").alias("h")).union(pairs.select("b")).union(members.select("h")).distinct()
    texts = materialise(line_texts(docs, found, nodes), "line-texts", parts)
    both = pairs.join(texts.select(F.col("h").alias("a"), F.col("line").alias("x")), "a").join(texts.select(F.col("h").alias("b"), F.col("line").alias("y")), "b")

    def verify(batches):
        known: dict[int, np.ndarray] = {}  # pairs come sorted by b, so its set is used again
        for batch in batches:
            for lo in range(0, len(batch), 500):
                a, b, x, y = (batch.column(k).slice(lo, 500).to_pylist() for k in range(4))
                new = {h: line for h, line in zip(a + b, x + y, strict=True) if h not in known}
                if len(known) + len(new) > 4000:
                    known, new = {}, dict(zip(a + b, x + y, strict=True))
                if new:
                    known |= zip(new, shingle_sets([*new.values()]), strict=True)
                same = [alike(known[i], known[j]) for i, j in zip(a, b, strict=True)]
                yield pa.record_batch([c.slice(lo, 500) for c in batch.columns[:2]], ["a", "b"]).filter(pa.array(same, pa.bool_()))

    return both.select("a", "b", "x", "y").mapInArrow(tidied(verify), "a long, b long").union(hot_links(members, texts))


def repeated_lines(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, start, end (with the line end) of each line that is not the first of its component."""
    found = materialise(lines(docs), "lines")  # narrow beside the texts, and read twice
    total = text_bytes(docs)
    parts = writers(docs.sparkSession, text_bytes=total)
    root = components(similar_lines(docs, found, total), parts).withColumnRenamed("node", "h")
    group = found.join(root, "h", "left").withColumn("g", F.coalesce("root", "h"))
    order = F.coalesce("doc_id", F.lit(LAST))
    first = group.groupBy("g").agg(F.min(F.struct(order.alias("o"), F.col("start").alias("s"))).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    # stored, so that the join stands alone between its exchanges and a hot group can be split
    first = materialise(first, "first-lines", parts)
    later = F.struct(order.alias("o"), F.col("start").alias("s")) > F.col("first")
    return group.join(first, "g").where(later).select("doc_id", "text_hash", "start", (F.col("end") + 1).alias("end"))


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_text: bool = False, rest: bool = False) -> DataFrame:
    """Keep the first line (by doc_id, then place) of each component of equal or similar lines.

    Columns: doc_id, n_bytes, n_removed, n_spans, kept_sha256 (and kept; with ``rest`` a
    struct of the other columns). One row for each input row. Lines end at a line feed,
    which goes with a removed line. A null text is empty. Lines of fewer than SHINGLE
    characters are like equal lines only; blank ones (white space alone, or nothing) stay, however long.
    Rows with the same doc_id and text are one document; a null doc_id comes last, and of
    lines at the same place of null ids all stay. An empty table gives an empty result.
    """
    docs = with_text_hash(docs, id_col, text_col, rest)
    return cut_spans(docs, repeated_lines(docs), keep_text)


def without_repeated_lines(docs: DataFrame) -> DataFrame:
    """``docs`` (all its columns) with repeated lines taken out of ``text`` and ``n_chars``, if there,
    counted again. A document that loses every byte goes; a null text becomes empty."""
    cut = dedup(docs, keep_text=True, rest=True).where("n_removed = 0 or octet_length(kept) > 0")
    text = F.col("kept").cast("string")
    new = {"text": text, "n_chars": F.length(text).cast("long")}
    return cut.select(*(new.get(c, F.col("rest")[c]).alias(c) for c in docs.columns))
