"""Suffix-array dedup of exact substrings by prefix-free parsing.

Wanted: every byte covered by a string of LENGTH bytes that also starts in a document
with a smaller doc_id. A corpus-wide suffix array would show it as runs of suffixes that
agree in LENGTH bytes; prefix-free parsing gets those runs from a dictionary instead.

Parse. A hash of GRAM bytes, made at every place for itself, sets triggers: the least hash of any LENGTH-byte
string. Each string has exactly one, which only its own bytes decide. The strings with
one trigger form a phrase; phrases overlap by LENGTH - 1 bytes, so every string lies in
one phrase, none crosses a phrase's end, and LENGTH bytes are all that order suffixes.

Dictionary. Equal phrases (trigger and whole content) meet in buckets by trigger; each
is kept once, with its least document, and all later occurrences are removed whole. Only
dictionary phrases that share a trigger with another one, of another document, can hold
equal strings besides.

Suffix order. Those phrases' suffixes are sorted by their LENGTH bytes within the bucket
of their trigger; buckets go by hash, so there is no order across them. In a run
of equal suffixes all but those of the least document are removed.

Hot phrases are combined before the exchange: a task sends only the least document of
each. A trigger with very many different phrases (next to a passage that many documents
share) sends its suffixes one by one, dealt by their own content and combined likewise.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import GOLD, bucket_count, buffers, digests, materialise, mix, pieces, runs, spans_of, text_bytes, tidied, unpacked, with_text_hash, words8

LENGTH = 50
GRAM = 16
SPAN = LENGTH - GRAM + 1  # grams of one string
LAST = (1 << 63) - 1
TURN, BACK = np.uint64(31), np.uint64(33)
LOW, HIGH = np.uint64(0xFFFFFFFF), np.uint64(0xFFFFFFFF00000000)
#: Phrases that a task holds before it deals them out, and different ones of a trigger that make it hot.
HELD, HOT = 1 << 20, 32
#: Bytes of text that are parsed at once, eight bytes and more for each.
PIECE = 1 << 16

REMOVED, SHARED, SCATTERED = 1, 2, 3
#: A phrase: trigger hash, content hash, document, place, number of strings less one, and whether its trigger is hot.
PHRASE = [("trigger", "<u4"), ("low", "<u4"), ("high", "<u2"), ("doc", "<i8"), ("tag", "<u4"), ("at", "<u4"), ("more", "u1"), ("hot", "u1")]
#: Strings of a document that start at ``at`` .. ``at + more``.
PART = [("doc", "<i8"), ("tag", "<u4"), ("at", "<u4"), ("more", "u1")]


def squeeze(rows: dict[str, np.ndarray], kinds: list, extra: bytes = b"") -> bytes:
    """Columns one after the other, documents as differences, compressed."""
    import zstandard

    body = [np.uint32(len(rows["doc"])).tobytes()]
    for name, kind in kinds:
        col = rows[name]
        body.append((np.diff(col, prepend=col.dtype.type(0)) if name == "doc" else col).astype(kind).tobytes())
    return zstandard.ZstdCompressor(level=1).compress(b"".join(body) + extra)


def expand(payload: pa.ChunkedArray, kinds: list) -> tuple[dict[str, np.ndarray], list[bytes]]:
    import zstandard

    undo = zstandard.ZstdDecompressor().decompress
    cols: dict[str, list] = {name: [] for name, _ in kinds}
    extra = []
    for p in payload:
        raw = undo(p.as_py())
        n, at = int(np.frombuffer(raw, np.uint32, 1)[0]), 4
        for name, kind in kinds:
            col = np.frombuffer(raw, kind, n, at)
            cols[name].append(np.cumsum(col) if name == "doc" else col)
            at += n * np.dtype(kind).itemsize
        extra.append(raw[at:])
    return {name: np.concatenate(c) if c else np.zeros(0, dict(kinds)[name]) for name, c in cols.items()}, extra


def take(rows: dict[str, np.ndarray], index: np.ndarray) -> dict[str, np.ndarray]:
    return {k: v[index] for k, v in rows.items()}


def deal(kind: int, key: np.ndarray, rows: dict[str, np.ndarray], kinds: list, buckets: int):
    """One (kind, bucket, payload) row for each bucket that ``key`` sends rows to."""
    if not len(key):
        return
    bucket = (key >> np.uint64(16)) % np.uint64(buckets)
    order = np.lexsort((rows["at"], rows["doc"], bucket))
    bucket, rows = bucket[order], take(rows, order)
    edge = np.r_[runs(bucket), len(bucket)]
    out = [squeeze({k: v[a:b] for k, v in rows.items()}, kinds) for a, b in zip(edge[:-1], edge[1:], strict=True)]
    yield pa.record_batch([pa.array(np.full(len(out), kind, np.int32)), pa.array(bucket[edge[:-1]].astype(np.int32)), pa.array(out, pa.binary())], ["kind", "bucket", "payload"])


def document_key(doc: np.ndarray, tag: np.ndarray) -> np.ndarray:
    return mix(doc.astype(np.uint64) * GOLD + tag.astype(np.uint64))


def gram_hashes(g: np.ndarray, n: int) -> np.ndarray:
    turned = g[8 : n + 8]
    return mix(g[:n] * GOLD + (turned << TURN | turned >> BACK))


def string_hashes(g: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Of the LENGTH bytes from each place on."""
    x = g[at]
    for o in (8, 16, 24, 32, 40, LENGTH - 8):
        x = mix(x * GOLD + g[at + o])
    return x


def parse(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """First and last string, trigger hash and content hash of each phrase of the texts in ``buf``."""
    n = len(buf)
    size = np.diff(offsets)
    valid = np.flatnonzero(np.arange(n) + LENGTH <= np.repeat(offsets[1:], size))
    if not len(valid):
        none = np.zeros(0, np.int64)
        return none, none, none.astype(np.uint64), none.astype(np.uint64)
    g = words8(buf, 72)
    h = gram_hashes(g, n)
    # hash above, place below: the least is the leftmost of the least hashes
    least = (h & HIGH) | np.arange(n, dtype=np.uint64)
    reach = 1
    while 2 * reach <= SPAN:
        least[:-reach] = np.minimum(least[:-reach], least[reach:])
        reach *= 2
    if SPAN > reach:
        least[: -(SPAN - reach)] = np.minimum(least[: -(SPAN - reach)], least[SPAN - reach :])
    trigger = (least[valid] & LOW).astype(np.int64)
    first = runs(trigger)
    s, e, t = valid[first], valid[np.r_[first[1:] - 1, len(valid) - 1]], trigger[first]
    content = mix(string_hashes(g, s) * GOLD + string_hashes(g, e) + (e - s).astype(np.uint64) * np.uint64(131) + (t - s).astype(np.uint64))
    return s, e, h[t], content


def phrases(docs: DataFrame, buckets: int) -> DataFrame:
    """The parse, dealt by trigger; phrases that a task knows to be repeated go straight to their document."""

    def flush(held):
        trigger, content, doc, tag, at, more = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.lexsort((doc, content, trigger))
        trigger, content = trigger[order], content[order]
        rows = {"doc": doc[order], "tag": tag[order], "at": at[order], "more": more[order]}
        phrase = runs(trigger, content)
        length = np.diff(np.r_[phrase, len(order)])
        least = np.repeat(rows["doc"][phrase], length)
        later = rows["doc"] > least
        gone = take(rows, np.flatnonzero(later))
        yield from deal(REMOVED, document_key(gone["doc"], gone["tag"]), gone, PART, buckets)
        # a trigger with very many different phrases is hot: they go on as they are, one stands for it
        group = runs(trigger[phrase])
        many = np.repeat(np.diff(np.r_[group, len(phrase)]) > HOT, np.diff(np.r_[group, len(phrase)]))
        hot = np.repeat(many, length)
        wide = take(rows, np.flatnonzero(hot & ~later))
        yield from deal(SCATTERED, document_key(wide["doc"], wide["tag"]), wide, PART, buckets)
        head = np.zeros(len(order), bool)
        head[phrase[group]] = True
        keep = np.flatnonzero(~later & (~hot | head))
        rows = take(rows, keep)
        trigger, content = trigger[keep], content[keep]
        rows |= {"trigger": (trigger & LOW).astype(np.uint32), "low": (content & LOW).astype(np.uint32), "high": (content >> np.uint64(48)).astype(np.uint16), "hot": hot[keep].astype(np.uint8)}
        yield from deal(0, mix(trigger), rows, PHRASE, buckets)

    def work(batches):
        held, size = [], 0
        for batch in batches:
            buf, offsets = buffers(batch.column(0))
            docs_, tags = batch.column(1).to_numpy(), batch.column(2).to_numpy().astype(np.uint32)
            for lo, hi in pieces(offsets, PIECE):
                part, at = buf[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
                s, e, trigger, content = parse(part, at)
                if not len(s):
                    continue
                row = np.searchsorted(at, s, "right") - 1
                held.append((trigger, content, docs_[lo + row], tags[lo + row], (s - at[row]).astype(np.uint32), (e - s).astype(np.uint8)))
                size += len(s)
                if size > HELD:
                    yield from flush(held)
                    held, size = [], 0
        if held:
            yield from flush(held)

    return docs.select("text", "ord", "tag").mapInArrow(tidied(work), "kind int, bucket int, payload binary")


def dictionary(dealt: DataFrame, buckets: int) -> DataFrame:
    """(kind, bucket, payload) by document: phrases to remove, and dictionary phrases whose suffixes must be sorted."""

    def resolve(group: pa.Table) -> pa.Table:
        if group["kind"][0].as_py():
            return group.select(["kind", "bucket", "payload"])
        rows, _ = expand(group["payload"], PHRASE)
        order = np.lexsort((rows["doc"], rows["low"], rows["high"], rows["trigger"]))
        rows = take(rows, order)
        phrase = runs(rows["trigger"], rows["high"], rows["low"])
        length = np.diff(np.r_[phrase, len(order)])
        later = rows["doc"] > np.repeat(rows["doc"][phrase], length)
        group_at = runs(rows["trigger"])
        span = np.diff(np.r_[group_at, len(order)])
        least, most = (np.repeat(f.reduceat(rows["doc"][phrase], np.searchsorted(phrase, group_at)), span) for f in (np.minimum, np.maximum))
        hot = np.repeat(np.maximum.reduceat(rows["hot"], group_at) > 0, span)
        # hot phrases have gone ahead; of others, equal strings of different documents need different phrases
        open_ = ~later & (rows["hot"] == 0)
        shared = np.flatnonzero(open_ & ~hot & (least != most))
        scattered = np.flatnonzero(open_ & hot)
        out = []
        # a phrase that is hot in its task may still be a later one here: its strings are sorted anyway
        for kind, index in ((REMOVED, np.flatnonzero(later & (rows["hot"] == 0))), (SHARED, shared), (SCATTERED, scattered)):
            part = take(rows, index)
            out += deal(kind, document_key(part["doc"], part["tag"]), part, PART, buckets)
        return pa.Table.from_batches(out, schema=SCHEMA)

    return dealt.groupBy("kind", "bucket").applyInArrow(resolve, "kind int, bucket int, payload binary")


SCHEMA = pa.schema([("kind", pa.int32()), ("bucket", pa.int32()), ("payload", pa.binary())])


def by_document(table: pa.Table) -> dict[tuple[int, int], tuple[np.ndarray, np.ndarray]]:
    """For each document the first strings and the numbers of strings less one."""
    rows, _ = expand(table["payload"], PART)
    if not len(rows["doc"]):
        return {}
    order = np.lexsort((rows["at"], rows["tag"], rows["doc"]))
    rows = take(rows, order)
    at = runs(rows["doc"], rows["tag"])
    return {(int(rows["doc"][a]), int(rows["tag"][a])): (rows["at"][a:b].astype(np.int64), rows["more"][a:b].astype(np.int64)) for a, b in zip(at, np.r_[at[1:], len(order)], strict=True)}


def suffixes(texts: DataFrame, parts: DataFrame, buckets: int) -> DataFrame:
    """Dictionary phrases with their bytes, dealt by trigger; scattered ones string by string, by content."""

    def send(doc, tag, at, more, raw, key):
        rows = {"doc": doc, "tag": tag, "at": at.astype(np.uint32), "more": more.astype(np.uint8)}
        bucket = (key >> np.uint64(16)) % np.uint64(buckets)
        order = np.lexsort((at, doc, bucket))
        bucket, rows = bucket[order], take(rows, order)
        edge = np.r_[runs(bucket), len(bucket)] if len(bucket) else np.zeros(0, np.int64)
        out = [squeeze({k: v[a:b] for k, v in rows.items()}, PART, b"".join(raw[i] for i in order[a:b])) for a, b in zip(edge[:-1], edge[1:], strict=True)]
        return pa.record_batch([pa.array(np.zeros(len(out), np.int32)), pa.array(bucket[edge[:-1]].astype(np.int32)), pa.array(out, pa.binary())], schema=SCHEMA)

    def work(left: pa.Table, right: pa.Table) -> pa.Table:
        kinds = right["kind"].to_numpy()
        found = {k: by_document(right.filter(pa.array(kinds == k))) for k in (SHARED, SCATTERED)}
        out, seen = [], set()
        whole, single = [], []
        for doc, tag, text in zip(left["ord"].to_pylist(), left["tag"].to_pylist(), unpacked(left["z"]), strict=True):
            if (doc, tag) in seen:
                continue  # an equal row
            seen.add((doc, tag))
            for k, (first, more) in ((k, f[doc, tag]) for k, f in found.items() if (doc, tag) in f):
                if k == SHARED:
                    whole += [(doc, tag, a, m, text[a : a + m + LENGTH]) for a, m in zip(first.tolist(), more.tolist(), strict=True)]
                else:
                    single += [(doc, tag, a, 0, text[a : a + LENGTH]) for s, m in zip(first.tolist(), more.tolist(), strict=True) for a in range(s, s + m + 1)]
        if whole:
            doc, tag, at, more = (np.array(x, np.int64) for x in list(zip(*whole, strict=True))[:4])
            raw = [w[4] for w in whole]
            g = words8(np.frombuffer(b"".join(r[:LENGTH] for r in raw), np.uint8), 72)
            start = np.arange(len(raw)) * LENGTH
            h = gram_hashes(g, len(raw) * LENGTH)[start[:, None] + np.arange(SPAN)]
            best = h[np.arange(len(h)), (h >> np.uint64(32)).argmin(1)]
            out.append(send(doc, tag, at, more, raw, mix(best)))
        if single:
            doc, tag, at, more = (np.array(x, np.int64) for x in list(zip(*single, strict=True))[:4])
            raw = [w[4] for w in single]
            g = words8(np.frombuffer(b"".join(raw), np.uint8), 72)
            key = string_hashes(g, np.arange(len(raw)) * LENGTH)
            # the least document here stands for a string; the others lose it whatever comes
            order = np.lexsort((at, doc, key))
            string = runs(key[order])
            least = np.repeat(doc[order][string], np.diff(np.r_[string, len(order)]))
            later = order[doc[order] > least]
            keep = order[doc[order] == least]
            part = {"doc": doc[later], "tag": tag[later].astype(np.uint32), "at": at[later].astype(np.uint32), "more": more[later].astype(np.uint8)}
            out += deal(REMOVED, document_key(part["doc"], part["tag"]), part, PART, buckets)
            out.append(send(doc[keep], tag[keep], at[keep], more[keep], [raw[i] for i in keep], key[keep]))
        return pa.Table.from_batches(out, schema=SCHEMA)

    return texts.groupBy("bucket").cogroup(parts.groupBy("bucket")).applyInArrow(work, "kind int, bucket int, payload binary")


def suffix_order(buf: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places sorted by the LENGTH bytes from each on, and where runs of equal ones start."""
    g = words8(buf, 72).byteswap()  # big-endian numbers are in the order of their bytes
    keys = [g[at + o] for o in (0, 8, 16, 24, 32, 40, LENGTH - 8)]
    order = np.lexsort(keys[::-1])
    return order, runs(*(k[order] for k in keys))


def sorted_runs(dealt: DataFrame, buckets: int) -> DataFrame:
    """Strings to remove, by document: all of a run of equal suffixes but the least document's."""

    def resolve(group: pa.Table) -> pa.Table:
        if group["kind"][0].as_py():
            return group.select(["kind", "bucket", "payload"])
        rows, extra = expand(group["payload"], PART)
        size = rows["more"].astype(np.int64) + LENGTH
        start = np.r_[0, np.cumsum(size)[:-1]]
        count = rows["more"].astype(np.int64) + 1
        phrase = np.repeat(np.arange(len(count)), count)
        step = np.arange(count.sum()) - np.repeat(np.r_[0, np.cumsum(count)[:-1]], count)
        order, run = suffix_order(np.frombuffer(b"".join(extra), np.uint8), start[phrase] + step)
        doc = rows["doc"][phrase][order]
        least = np.repeat(np.minimum.reduceat(doc, run), np.diff(np.r_[run, len(order)]))
        gone = np.sort(order[doc > least])
        # strings in a row become one part again
        if len(gone):
            p, s = phrase[gone], step[gone]
            first = np.r_[True, (p[1:] != p[:-1]) | (s[1:] != s[:-1] + 1)]
            head = np.flatnonzero(first)
            more = np.diff(np.r_[head, len(gone)]) - 1
            p, s = p[head], s[head]
        else:
            p = s = more = np.zeros(0, np.int64)
        part = {"doc": rows["doc"][p], "tag": rows["tag"][p], "at": (rows["at"][p] + s).astype(np.uint32), "more": more.astype(np.uint8)}
        return pa.Table.from_batches([*deal(REMOVED, document_key(part["doc"], part["tag"]), part, PART, buckets)], schema=SCHEMA)

    return dealt.groupBy("kind", "bucket").applyInArrow(resolve, "kind int, bucket int, payload binary")


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_text: bool = False) -> DataFrame:
    """Remove each byte covered by a 50-byte string that also starts in a document with a smaller doc_id.

    Columns: doc_id, n_bytes, n_removed, n_spans, kept_sha256 (and kept, binary). One row
    for each input row. A null text is empty; texts under 50 bytes lose nothing. A null
    doc_id is larger than all others. Rows with the same doc_id do not count against each
    other: equal ones get equal results, and different texts of one doc_id each their
    own. An empty table gives an empty result.
    """
    docs = with_text_hash(docs, id_col, text_col)
    # tags tell texts of one doc_id apart; without such ids (or null ones) they stay zero
    clash = docs.where("doc_id is not null").groupBy("doc_id").agg(F.min("text_hash").alias("a"), F.max("text_hash").alias("b")).where("a <> b").limit(1).count() > 0
    own = F.col("doc_id").isNull() | F.lit(clash)
    docs = docs.withColumn("ord", F.coalesce("doc_id", F.lit(LAST))).withColumn("tag", F.when(own, F.pmod("text_hash", F.lit(1 << 32))).otherwise(F.lit(0)))
    buckets = bucket_count(docs.sparkSession, text_bytes(docs))

    def pack(batches):
        import zstandard

        small = zstandard.ZstdCompressor(level=3).compress
        for batch in batches:
            buf, at = buffers(batch.column(0))
            raw = buf.tobytes()
            z = pa.array([small(raw[at[i] : at[i + 1]]) for i in range(len(batch))], pa.binary())
            key = document_key(batch.column(1).to_numpy(), batch.column(2).to_numpy())
            bucket = ((key >> np.uint64(16)) % np.uint64(buckets)).astype(np.int32)
            yield pa.record_batch([pa.array(bucket), *batch.columns[1:], z], ["bucket", "ord", "tag", "doc_id", "z"])

    def cut(left: pa.Table, right: pa.Table) -> pa.Table:
        from hashlib import sha256

        found = by_document(right)
        out = []
        for doc, tag, doc_id, text in zip(left["ord"].to_pylist(), left["tag"].to_pylist(), left["doc_id"].to_pylist(), unpacked(left["z"]), strict=True):
            kept, removed, spans = text, 0, 0
            if (doc, tag) in found:
                first, more = found[doc, tag]
                a, b = spans_of(first, first + more + LENGTH)
                kept = b"".join(text[i:j] for i, j in zip(np.r_[0, b].tolist(), np.r_[a, len(text)].tolist(), strict=True))
                removed, spans = len(text) - len(kept), len(a)
            out.append((doc_id, len(text), removed, spans, sha256(kept).hexdigest(), kept if keep_text else None))
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string()] + [pa.binary()] * keep_text
        return pa.table([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"] + ["kept"] * keep_text)

    first = materialise(dictionary(phrases(docs, buckets), buckets), "phrases")
    texts = docs.select("text", "ord", "tag", "doc_id").mapInArrow(tidied(pack), "bucket int, ord long, tag long, doc_id long, z binary")
    open_ = first.where(F.col("kind") != REMOVED)
    later = sorted_runs(suffixes(texts, open_, buckets), buckets)
    gone = first.where(F.col("kind") == REMOVED).union(later)
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * keep_text
    result = texts.groupBy("bucket").cogroup(gone.groupBy("bucket")).applyInArrow(cut, schema)
    return result if keep_text else digests(result)


def oracle() -> str:
    """``dedup`` in DuckDB's SQL, for tables of different ids: bytes as pairs of hexadecimal digits."""
    return f"""
WITH docs AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
strings AS (SELECT doc_id, i, substring(h, 2 * i + 1, {2 * LENGTH}) AS g FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2 - {LENGTH - 1})) AS i FROM docs)),
least AS (SELECT g, min(doc_id) AS d FROM strings GROUP BY g HAVING count(*) > 1),
gone AS (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS p FROM strings JOIN least USING (g) WHERE d < doc_id),
marks AS (SELECT *, sum(CASE WHEN p IS NULL OR i > p + {LENGTH} THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM gone),
spans AS (SELECT doc_id, run, min(i) AS a, max(i) + {LENGTH} AS b FROM marks GROUP BY doc_id, run),
cuts AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before FROM spans),
kept AS (SELECT doc_id, sum(b - a) AS removed, count(*) AS spans, max(b) AS last, string_agg(substring(h, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) AS head FROM cuts JOIN docs USING (doc_id) GROUP BY doc_id)
SELECT doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(spans, 0) AS BIGINT) AS n_spans,
  sha256(unhex(CASE WHEN removed IS NULL THEN h ELSE head || substring(h, 2 * last + 1) END)) AS kept_sha256 FROM docs LEFT JOIN kept USING (doc_id)
"""
