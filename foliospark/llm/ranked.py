"""Ranked lexical search of a set of items over all documents, by bag deduplication.

Only terms of the items can add to a score, and beside them only a document's length norm m
counts. So documents are restricted to the items' vocabulary, and those with the same vector
of term counts and the same m are one class: the aggregation deals them by a hash of both and
compares the vectors themselves. A class is scored once; its members, by ascending
doc_id, share the score.

Texts are read once for each block of items, whose terms go to all tasks; a block has ITEM_BYTES
of item texts, so what is sent does not grow with the corpus, and more items make more blocks. Of a
class only its ``top`` least ids can be in a result, so no more leave the tasks that read them: a
class of a third of all documents is no hot key. Each task keeps the best ``top`` of each item
from the classes it scores, and those meet in one window for each item.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.window import Window

from .common import buffers, materialise, pieces, shared_dir, small_batches, span_hashes, tidied, word_spans, words8

TOP = 50
#: Bytes of item texts that are sent to all tasks at once.
ITEM_BYTES = 8 << 20
#: Bytes of one text that are searched for terms at once, if it can be cut there.
WINDOW_BYTES = 1 << 20
#: Scores of classes and items that a task has at once.
SCORES = 1 << 22
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
TERM_BYTES = re.compile(rb"[0-9A-Za-z\x80-\xff]+")

#: Bytes that end a term, and each byte with A-Z lower-cased.
OUTSIDE = np.ones(256, bool)
OUTSIDE[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


class Terms:
    """The items' vocabulary: terms in order, and a table that finds them by hash and compares their bytes."""

    def __init__(self, terms: list[bytes]):
        self.count = len(terms)
        size = np.array([len(t) for t in terms], np.int64)
        buf = np.frombuffer(b"".join(terms), np.uint8)
        ends = np.cumsum(size)
        hashes = span_hashes(buf, ends - size, ends) if len(buf) else np.zeros(0, np.uint64)
        self.order = np.argsort(hashes)
        self.hashes, self.size = hashes[self.order], size
        self.steps = -(-int(size.max(initial=0)) // 8)
        self.eights = np.zeros((self.count, self.steps), np.uint64)
        for i, t in enumerate(terms):
            self.eights[i, : -(-len(t) // 8)] = np.frombuffer(t.ljust(-(-len(t) // 8) * 8, b"\0"), "<u8")
        self.seen = np.zeros(1 << 16, bool)  # the low bits of all hashes: most other words go here
        self.seen[(self.hashes & np.uint64(0xFFFF)).astype(np.int64)] = True

    def found(self, buf: np.ndarray, start: np.ndarray, end: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the words of ``buf``, in lower case, are terms, and of these the terms' numbers."""
        at = np.flatnonzero(self.seen[(hashes & np.uint64(0xFFFF)).astype(np.int64)])
        place = np.searchsorted(self.hashes, hashes[at])
        place[place == self.count] = 0
        hit = self.hashes[place] == hashes[at] if self.count else np.zeros(0, bool)
        at, term = at[hit], self.order[place[hit]]
        size = end[at] - start[at]
        same = size == self.size[term]
        eights = words8(buf, 8 * self.steps + 8)
        for k in range(self.steps):
            check = np.flatnonzero(same & (size > 8 * k))
            if not len(check):
                break
            left = np.minimum(size[check] - 8 * k, 8).astype(np.uint64)
            mask = np.uint64(0xFFFFFFFFFFFFFFFF) >> (np.uint64(64) - np.uint64(8) * left)
            same[check] = eights[start[at[check]] + 8 * k] & mask == self.eights[term[check], k]
        return at[same], term[same]


def windows(buf: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of a text that no term crosses, of WINDOW_BYTES if there is a place to cut."""
    lo, n = 0, len(buf)
    while lo < n:
        hi = lo + WINDOW_BYTES
        while hi < n:
            cut = np.flatnonzero(OUTSIDE[buf[hi : hi + WINDOW_BYTES]])
            if len(cut):
                hi += int(cut[0])
                break
            hi += WINDOW_BYTES
        hi = min(hi, n)
        yield lo, hi
        lo = hi


def vectors(docs: DataFrame, terms: Terms, id_col: str, text_col: str) -> DataFrame:
    """doc_id, n (terms of the whole text) and vector (term number and count, 4 bytes each, by number) of each document."""

    def count(buf: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        row, start, end, hashes = word_spans(buf, at, lower=True, outside=OUTSIDE)
        which, term = terms.found(LOWER[buf], start, end, hashes)
        key, times = np.unique(row[which] * terms.count + term, return_counts=True)
        return np.bincount(row, minlength=len(at) - 1), key, times

    def counted(buf: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if len(at) > 2 or len(buf) <= WINDOW_BYTES:
            return count(buf, at)
        parts = [count(buf[lo:hi], np.array([0, hi - lo])) for lo, hi in windows(buf)]  # one long text
        key, back = np.unique(np.concatenate([k for _, k, _ in parts]), return_inverse=True)
        times = np.bincount(back, np.concatenate([t for *_, t in parts]), len(key)).astype(np.int64)
        return sum(n for n, *_ in parts), key, times

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, at = buffers(batch.column(1))
            total, packed = [np.zeros(0, np.int64)], []
            for lo, hi in pieces(at):
                n, key, times = counted(buf[at[lo] : at[hi]], at[lo : hi + 1] - at[lo])
                total.append(n)
                both = np.empty(2 * len(key), "<u4")
                both[::2], both[1::2] = key % max(terms.count, 1), times
                raw = both.tobytes()
                cut = 8 * np.searchsorted(key, np.arange(hi - lo + 1) * terms.count)
                packed += [raw[a:b] for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]
            yield pa.record_batch([batch.column(0), pa.array(np.concatenate(total).astype(np.int64)), pa.array(packed, pa.binary())], ["doc_id", "n", "vector"])

    small_batches(docs)
    chosen = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return chosen.mapInArrow(tidied(work), "doc_id long, n long, vector binary")


def holders(found: DataFrame, terms: int) -> np.ndarray:
    """Documents that hold each term; a task sums its own, and as many numbers as there are terms reach the driver."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(terms, np.int64)
        for batch in batches:
            held += np.bincount(buffers(batch.column(0))[0].view("<u4")[::2], minlength=terms)
        at = np.flatnonzero(held)
        yield pa.record_batch([pa.array(at, pa.int64()), pa.array(held[at])], ["term", "held"])

    out = np.zeros(terms, np.int64)
    for term, held in found.select("vector").mapInArrow(tidied(work), "term long, held long").groupBy("term").agg(F.sum("held")).collect():
        out[term] = held
    return out


def best_of(score: np.ndarray, doc: np.ndarray, null: np.ndarray, item: np.ndarray, top: int) -> np.ndarray:
    """Places of each item's best ``top``: largest score, then least id, null ids last; by item and rank."""
    order = np.lexsort((doc, null, -score, item))
    first = np.searchsorted(item[order], item[order], "left")
    return order[np.arange(len(order)) - first < top]


def scored(classes: DataFrame, of_term: tuple[np.ndarray, np.ndarray], weights: np.ndarray, items: int, top: int) -> DataFrame:
    """item, score, doc_id of the best ``top`` of each item in each task. ``classes``: m, vector, members (their least ids).

    ``of_term``: where each term's items start in the second array, which holds them.
    """
    first, holding = of_term
    longest = int(np.bincount(holding, minlength=1).max(initial=0))
    exact = int(weights.max(initial=0)) * 10**6 * longest < 1 << 53  # sums in doubles are exact then

    def sums(vectors: pa.Array, m: np.ndarray) -> np.ndarray:
        raw, at = buffers(vectors)
        pairs = raw.view("<u4").astype(np.int64)
        term, tf = pairs[::2], pairs[1::2]
        row = np.repeat(np.arange(len(m)), np.diff(at) // 8)
        adds = weights[term] * ((1_000_000_000 * tf) // (1000 * tf + 20 * m[row]))
        times = first[term + 1] - first[term]
        ends = np.cumsum(times)
        item = holding[np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - times - first[term], times)]
        cell, adds = np.repeat(row, times) * items + item, np.repeat(adds, times)
        if exact:
            return np.bincount(cell, adds, len(m) * items).astype(np.int64).reshape(len(m), items)
        out = np.zeros(len(m) * items, np.int64)
        np.add.at(out, cell, adds)
        return out.reshape(len(m), items)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = [np.zeros(0, np.int64)] * 3 + [np.zeros(0, bool)]  # item, score, doc, null
        least = np.zeros(items, np.int64)
        for batch in batches:
            rows = max(1, SCORES // items)
            for part in (batch.slice(lo, rows) for lo in range(0, len(batch), rows)):
                score = sums(part.column(1), part.column(0).to_numpy())
                row, item = np.nonzero((score > 0) & (score >= least))
                members = part.column(2)
                size = members.value_lengths().to_numpy()
                ends, times = np.cumsum(size), size[row]
                each = np.arange(times.sum()) + np.repeat((ends - size)[row] - (np.cumsum(times) - times), times)
                ids = members.flatten()
                doc, null = ids.fill_null(0).to_numpy()[each], ids.is_null().to_numpy(zero_copy_only=False)[each]
                new = np.repeat(item, times), np.repeat(score[row, item], times), doc, null
                kept = [np.concatenate(x) for x in zip(kept, new, strict=True)]
                best = best_of(kept[1], kept[2], kept[3], kept[0], top)
                kept = [x[best] for x in kept]
                full = np.flatnonzero(np.r_[kept[0][1:] != kept[0][:-1], True])[: len(kept[0])]
                held = np.diff(np.r_[-1, full])
                done = full[held == top]
                least[kept[0][done]] = kept[1][done]
        yield pa.record_batch([pa.array(kept[0], pa.int64()), pa.array(kept[1], pa.int64()), pa.array(kept[2], pa.int64(), mask=kept[3])], ["item", "score", "doc_id"])

    return classes.select("m", "vector", "members").mapInArrow(tidied(work), "item long, score long, doc_id long")


def search(docs: DataFrame, items: DataFrame, top: int = TOP, item_bytes: int = ITEM_BYTES, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """Each item's ``top`` highest-scoring documents with a score above 0: item_id, rank, doc_id, score.

    Terms are runs of digits, letters and characters beyond ASCII, with A-Z lower-cased; a null or empty
    text has none, so such items have no rows and such documents are in none. Equal scores go by ascending doc_id, null
    ids last. Every row of ``items`` is an item, and every row of ``docs`` a document, whatever rows repeat;
    rows with equal id and score have ranks of their own. Other columns are not read.
    """
    spark = docs.sparkSession
    shared_dir(spark)
    text = F.coalesce(F.col(f"`{item_text}`").cast("string"), F.lit(""))
    asked = items.select(F.col(f"`{item_col}`").alias("item_id"), text.alias("text"))
    blocks = max(1, -(-(asked.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // item_bytes))
    kind = asked.schema["item_id"].dataType
    results = []
    for block in range(blocks):
        mine = asked.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block) if blocks > 1 else asked
        results.append(searched(docs, [tuple(r) for r in mine.collect()], kind, top, id_col, text_col))
    out = results[0]
    for more in results[1:]:
        out = out.union(more)
    return out


def searched(docs: DataFrame, items: list[tuple], kind, top: int, id_col: str, text_col: str) -> DataFrame:
    spark = docs.sparkSession
    of_item = [{t.lower() for t in TERM_BYTES.findall(text.encode())} for _, text in items]
    listed = sorted({t for terms in of_item for t in terms})
    number = {t: i for i, t in enumerate(listed)}
    found = materialise(vectors(docs, Terms(listed), id_col, text_col), "ranked-vectors")
    documents, length = found.where("n > 0").agg(F.count("*"), F.sum("n")).first()
    held = holders(found, len(listed))
    weights = np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * int(df) + 1))) for df in held], np.int64)
    holds: list[list[int]] = [[] for _ in listed]
    for i, terms in enumerate(of_item):
        for t in terms:
            holds[number[t]].append(i)
    first = np.cumsum([0, *map(len, holds)])
    holding = np.array([i for x in holds for i in x], np.int64)

    m = F.expr(f"50L + (50L * n * {documents}L) div {length or 1}L")
    bags = found.where(F.octet_length("vector") > 0).select("doc_id", m.alias("m"), "vector")
    bags = bags.select("doc_id", "m", "vector", F.xxhash64("vector", "m").alias("h"))
    within = Window.partitionBy("h", "m", "vector").orderBy(F.col("doc_id").asc_nulls_last())
    members = bags.withColumn("place", F.row_number().over(within)).where(F.col("place") <= top)
    ids = F.sort_array(F.collect_list(F.struct("place", "doc_id")))["doc_id"]
    classes = members.groupBy("h", "m", "vector").agg(ids.alias("members"))
    best = scored(classes, (first, holding), weights, max(1, len(items)), top)
    by_item = Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    ranked = best.withColumn("rank", F.row_number().over(by_item)).where(F.col("rank") <= top)
    arrow = pa.table([pa.array(range(len(items)), pa.int64()), pa.array([i for i, _ in items], to_arrow_type(kind))], ["item", "item_id"])
    names = spark.createDataFrame(arrow)
    return ranked.join(names, "item").select("item_id", "rank", "doc_id", "score")


def oracle(top: int = TOP) -> str:
    lower = f"regexp_extract_all(translate(text, '{UPPER}', '{UPPER.lower()}'), '{TERM}')"
    return f"""WITH rows AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, {lower} AS terms FROM documents WHERE text IS NOT NULL),
        tf AS MATERIALIZED (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(terms) AS term FROM rows) GROUP BY r, term),
        docs AS MATERIALIZED (SELECT r, doc_id, CAST(len(terms) AS BIGINT) AS n FROM rows WHERE len(terms) > 0),
        totals AS (SELECT CAST(count(*) AS BIGINT) AS N_, CAST(sum(n) AS BIGINT) AS L_ FROM docs),
        m AS MATERIALIZED (SELECT r, doc_id, 50 + (50 * n * N_) // L_ AS m FROM docs CROSS JOIN totals),
        asked AS MATERIALIZED (SELECT i, item_id, unnest(list_distinct(terms)) AS term FROM (SELECT row_number() OVER () AS i, item_id, {lower} AS terms FROM benchmark WHERE text IS NOT NULL)),
        w AS MATERIALIZED (SELECT term, CAST(floor(1000 * ln(CAST(2 * any_value(N_) + 2 AS DOUBLE) / (2 * count(*) + 1))) AS BIGINT) AS w FROM tf CROSS JOIN totals GROUP BY term),
        scores AS (SELECT i, any_value(item_id) AS item_id, r, any_value(doc_id) AS doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m))) AS BIGINT) AS score
            FROM asked JOIN tf USING (term) JOIN w USING (term) JOIN m USING (r) GROUP BY i, r)
        SELECT item_id, rank, doc_id, score FROM
            (SELECT item_id, CAST(row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id ASC NULLS LAST) AS INTEGER) AS rank, doc_id, score FROM scores WHERE score > 0)
        WHERE rank <= {top}"""
