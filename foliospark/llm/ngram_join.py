"""N-gram Jaccard join: exact self-join of word-shingle sets by prefix trees.

Sets are ordered by one global order (their 64-bit shingle hashes). Equal sets are one
class and are linked as such. For different sets:

1. Prune. Two sets with a Jaccard similarity of 0.8 share a known least number of the
   first 30 % of their shingles. All those prefixes meet, packed, in buckets by shingle;
   a class that shares too few of its own with any other class can have no partner.
2. Group. The order changes so that the most frequent shingles (a bounded number of
   them) come last and a passage in many documents brings no group about. For the
   classes left, the least class of each shingle of a 30 % prefix leads a group, and a
   class joins the groups of its shingles' leaders. Linked sets share a tenth of the
   smaller one's size at least in these prefixes, so a class leaves the groups that only a
   few of its shingles (4 % of its size together) are for: any two linked classes are
   still together in at least one group. In a large group all classes are compared with
   one of them, and only those that it is not linked with meet all others, in blocks (see
   ``blocks``).
3. Join. A task stores its sets in a radix tree, most common shingle first, and sends
   sets down it level by level; sets with a common path share the partial overlap, and a
   subtree goes once the lengths that remain cannot give the overlap that is needed. A
   set of the component of the most central set need not be sent: every pair of
   different components has a set outside it.

Links then go through distributed union-find.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import blocks
from .common import GOLD, bucket_count, buffers, materialise, mix, pack_rows, packed_texts, pieces, runs, same_document, shuffle_parts, text_bytes, tidied, unpack_rows, unpacked, with_text_hash, word_spans, writers
from .components import components

WORDS = 5
PREFIX = np.dtype([("token", "<u4"), ("cls", "<u8")])
MEMBER = np.dtype([("doc_id", "<i8"), ("text_hash", "<i8"), ("null", "<i4"), ("n", "<i4"), ("cls", "<u8")])
#: Prefix shingles that a task holds before it deals them out.
HELD = 1 << 20
#: Most shingles that the common order puts last, as a list that every task gets.
MOST_FREQUENT = 50_000
#: Least and most sets of a block.
LEAST_BLOCK, MOST_BLOCK = 128, 4096


def shingle_sets(buf: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """For each text the sorted set of its shingle hashes: five words each, or all words of a shorter text."""
    rows = len(offsets) - 1
    row, _, _, h = word_spans(buf, offsets, lower=True)
    count = np.bincount(row, minlength=rows)
    start = np.r_[0, np.cumsum(count)]
    grams = h.copy()
    last = len(h) - WORDS + 1
    for k in range(1, WORDS):
        if last > 0:
            grams[:last] = mix(grams[:last] * GOLD + h[k : k + last])
    out = []
    for r in range(rows):
        a, b = start[r], start[r + 1]
        if b - a >= WORDS:
            out.append(np.unique(grams[a : b - WORDS + 1]))
        elif b > a:
            whole = np.uint64(b - a)
            with np.errstate(over="ignore"):
                for w in h[a:b]:
                    whole = mix(np.array([whole * GOLD + w]))[0]
            out.append(np.array([whole], np.uint64))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def prefix_length(n: np.ndarray | int, share: np.ndarray | int):
    """Shingles of a set of n among which it has ``share`` in common with any linked set."""
    return n - (4 * n + 4) // 5 + share


def class_of(s: np.ndarray) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(s.tobytes())


def prefixes(docs: DataFrame, total: int) -> DataFrame:
    """Rows of two kinds. Members: doc_id, text_hash, cls, n of each text. Shares: cls and in ``n``
    how many shingles of its 30 % prefix other classes have in theirs (in parts, one a bucket).
    ``total``: the bytes of all texts."""
    buckets = bucket_count(docs.sparkSession, total)

    def flush(members, sets):
        rows = np.array(members, MEMBER)
        for b in pack_rows(mix(rows["cls"]), rows, buckets):
            yield pa.record_batch([pa.array(np.zeros(len(b), np.int32)), *b.columns], ["kind", "bucket", "payload"])
        cls = np.fromiter(sets, np.uint64, len(sets))
        tokens = np.concatenate(list(sets.values())) if sets else np.zeros(0, np.uint64)
        rows = np.zeros(len(tokens), PREFIX)
        rows["token"], rows["cls"] = tokens & np.uint64(0xFFFFFFFF), np.repeat(cls, [len(s) for s in sets.values()])
        for b in pack_rows(mix(tokens), rows, buckets):
            yield pa.record_batch([pa.array(np.ones(len(b), np.int32)), *b.columns], ["kind", "bucket", "payload"])

    def work(batches):
        members, sets, size = [], {}, 0
        for batch in batches:
            buf, offsets = buffers(batch.column(0))
            ids, hashes = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            for lo, hi in pieces(offsets):
                found = shingle_sets(buf[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                for k, s in enumerate(found, lo):
                    cls = class_of(s)
                    members.append((ids[k] or 0, hashes[k], ids[k] is None, len(s), cls))
                    if cls not in sets and len(s):
                        sets[cls] = s[: prefix_length(len(s), -(-len(s) // 10))]
                        size += len(sets[cls])
                if size > HELD:
                    yield from flush(members, sets)
                    members, sets, size = [], {}, 0
        if members:
            yield from flush(members, sets)

    def resolve(group: pa.Table) -> pa.Table:
        if group["kind"][0].as_py() == 0:
            m = unpack_rows(group["payload"], MEMBER)
            ids = pa.array(m["doc_id"], mask=m["null"] == 1)
            return pa.table([ids, pa.array(m["text_hash"]), pa.array(m["cls"].view(np.int64)), pa.array(m["n"].astype(np.int64)), pa.array(np.ones(len(m), bool))], names)
        r = unpack_rows(group["payload"], PREFIX)
        r = r[np.lexsort((r["cls"], r["token"]))]
        token = runs(r["token"])
        many = np.repeat(np.minimum.reduceat(r["cls"], token) != np.maximum.reduceat(r["cls"], token), np.diff(np.r_[token, len(r)])) if len(r) else np.zeros(0, bool)
        cls, n = np.unique(r["cls"][many], return_counts=True)
        none = pa.nulls(len(cls), pa.int64())
        return pa.table([none, none, pa.array(cls.view(np.int64)), pa.array(n), pa.array(np.zeros(len(cls), bool))], names)

    names = ["doc_id", "text_hash", "cls", "n", "member"]
    dealt = docs.select("text", "doc_id", "text_hash").mapInArrow(tidied(work), "kind int, bucket int, payload binary")
    return dealt.groupBy("kind", "bucket").applyInArrow(resolve, "doc_id long, text_hash long, cls long, n long, member boolean")


def sets_of(docs: DataFrame, members: DataFrame, wanted: DataFrame) -> DataFrame:
    """cls and its whole set (binary) for each wanted class."""
    place = members.join(wanted, "cls", "left_semi").groupBy("cls").agg(F.min(F.struct("doc_id", "text_hash")).alias("p"))
    place = place.select("cls", F.col("p.doc_id").alias("doc_id"), F.col("p.text_hash").alias("text_hash"))
    packed = packed_texts(docs)
    joined = packed.join(place, same_document(packed, place)).select("z", "cls")

    def work(batches):
        for batch in batches:
            cls = batch.column(1)
            texts = [*unpacked(batch.column(0))]
            offsets = np.cumsum([0, *map(len, texts)])
            buf = np.frombuffer(b"".join(texts), np.uint8)
            for lo, hi in pieces(offsets):
                sets = shingle_sets(buf[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                yield pa.record_batch([cls[lo:hi], pa.array([s.tobytes() for s in sets], pa.binary())], ["cls", "set"])

    # equal rows of the input give a class more than once
    return joined.mapInArrow(tidied(work), "cls long, set binary").dropDuplicates(["cls"])


def frequent(sets: DataFrame) -> np.ndarray:
    """Sorted shingles that at least one in MOST_FREQUENT of all occurrences is, so at most MOST_FREQUENT."""

    def tokens(batches):
        for batch in batches:
            buf, _ = buffers(batch.column(0))
            yield pa.record_batch([pa.array(np.frombuffer(buf.tobytes(), np.int64))], ["token"])

    total = sets.agg(F.sum(F.octet_length("set"))).first()[0] or 0
    least = max(16, total // 8 // MOST_FREQUENT)
    many = sets.select("set").mapInArrow(tidied(tokens), "token long").groupBy("token").count().where(F.col("count") >= least)
    return np.sort(np.array([r[0] for r in many.select("token").collect()], np.int64))


def groups(sets: DataFrame) -> DataFrame:
    """cls, leader: the groups that each class belongs to."""
    last = frequent(sets)

    def tokens(batches):
        for batch in batches:
            for cls, raw in zip(batch.column(0), batch.column(1), strict=True):
                s = np.frombuffer(raw.as_py(), np.int64)
                n = len(s)
                if len(last):
                    at = np.minimum(np.searchsorted(last, s), len(last) - 1)
                    s = s[np.argsort(last[at] == s, kind="stable")]
                s = s[: prefix_length(n, -(-n // 10))]
                yield pa.record_batch([pa.array(s), pa.array(np.full(len(s), cls.as_py())), pa.array(np.full(len(s), n, np.int32))], ["token", "cls", "n"])

    found = sets.select("cls", "set").mapInArrow(tidied(tokens), "token long, cls long, n int")
    leader = found.groupBy("token").agg(F.min("cls").alias("leader"), F.max("cls").alias("most")).where("leader < most").select("token", "leader")
    shared = found.join(leader, "token").groupBy("cls", "n", "leader").agg(F.count("*").alias("c"))
    mine = W.partitionBy("cls")
    shared = shared.withColumn("upto", F.sum("c").over(mine.orderBy("c", "leader"))).withColumn("all", F.sum("c").over(mine))
    return shared.where("upto > 4 * n div 100 and 100 * all >= 8 * n").select("cls", "leader")


class Tree:
    """Radix tree over token sequences (lists of ranks in one order) with whole set sizes ``n``."""

    def __init__(self, seqs: list[np.ndarray], n: np.ndarray):
        order = sorted(range(len(seqs)), key=lambda i: seqs[i].tolist())
        parent, lo, hi, src = [-1], [0], [0], [order[0]]
        node_of = np.zeros(len(seqs), np.int64)
        stack, before = [0], None
        for i in order:
            s, shared = seqs[i], 0
            if before is not None:
                m = min(len(s), len(before))
                differ = np.flatnonzero(s[:m] != before[:m])
                shared = int(differ[0]) if len(differ) else m
            last = -1
            while hi[stack[-1]] > shared:
                last = stack.pop()
            if hi[stack[-1]] < shared:  # the node above which we are is cut in two
                parent.append(stack[-1])
                lo.append(hi[stack[-1]])
                hi.append(shared)
                src.append(src[last])
                stack.append(len(parent) - 1)
                parent[last], lo[last] = stack[-1], shared
            if len(s) > shared:
                parent.append(stack[-1])
                lo.append(shared)
                hi.append(len(s))
                src.append(i)
                stack.append(len(parent) - 1)
            node_of[i] = stack[-1]
            before = s
        self.n, self.node_of = n, node_of
        self.parent, count = np.array(parent), len(parent)
        self.runs = [seqs[s][a:b] for s, a, b in zip(src, lo, hi, strict=True)]
        depth = np.zeros(count, np.int64)
        todo = np.flatnonzero(self.parent >= 0)
        self.levels = [np.array([0])]
        above = np.zeros(count, bool)
        above[0] = True
        while len(todo):
            here = todo[above[self.parent[todo]]]
            todo = todo[~above[self.parent[todo]]]
            above[here] = True
            depth[here] = len(self.levels)
            self.levels.append(here)
        # of each subtree: the least and the largest set, and the most tokens below the node's end
        self.least, self.most, self.below = np.full(count, 1 << 60), np.zeros(count, np.int64), np.zeros(count, np.int64)
        np.minimum.at(self.least, node_of, n)
        np.maximum.at(self.most, node_of, n)
        size = np.array([len(r) for r in self.runs])
        for level in self.levels[:0:-1]:
            up = self.parent[level]
            np.minimum.at(self.least, up, self.least[level])
            np.maximum.at(self.most, up, self.most[level])
            np.maximum.at(self.below, up, self.below[level] + size[level])
        self.size = size
        self.last = np.array([int(r[-1]) if len(r) else -1 for r in self.runs])
        self.start = np.r_[0, np.cumsum(size)[:-1]]
        self.tokens = np.concatenate(self.runs) if count else np.zeros(0, np.int64)

    def overlaps(self, seq: np.ndarray, n: int, vocabulary: int) -> np.ndarray:
        """Of each stored set, its overlap with a set of size n; -1 where the bounds rule a link out."""
        has = np.zeros(vocabulary + 1, np.int64)
        has[seq] = 1
        left = len(seq) - np.cumsum(has)  # tokens of the set after each rank
        over = np.full(len(self.parent), -1)
        over[0] = 0
        for level in self.levels[1:]:
            live = level[over[self.parent[level]] >= 0]
            live = live[(5 * self.most[live] >= 4 * n) & (4 * self.least[live] <= 5 * n)]
            if not len(live):
                continue
            size = self.size[live]
            first = np.r_[0, np.cumsum(size)[:-1]]
            at = np.repeat(self.start[live] - first, size) + np.arange(size.sum())
            found = over[self.parent[live]] + np.add.reduceat(has[self.tokens[at]], first)
            reach = found + np.minimum(left[self.last[live]], self.below[live])
            smallest = np.maximum(self.least[live], -(-4 * n // 5))
            over[live] = np.where(9 * reach >= 4 * (n + smallest), found, -1)
        return over[self.node_of]


def links_in(sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Links that connect all linked sets of a group, by places."""
    n = np.array([len(s) for s in sets])
    tokens, inverse, df = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    # most common first; tokens of one set alone are in no path
    rank = np.full(len(tokens), -1)
    common = np.flatnonzero(df > 1)
    common = common[np.argsort(-df[common], kind="stable")]
    rank[common] = np.arange(len(common))
    ranks = np.split(rank[inverse], np.cumsum(n)[:-1])
    seqs = [np.sort(r[r >= 0]) for r in ranks]
    tree = Tree(seqs, n)
    root = list(range(len(sets)))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    weight = np.array([df[common[s]].sum() if len(s) else 0 for s in seqs]) / n
    centre = int(weight.argmax())
    links = []
    for i in [centre, *np.argsort(-weight, kind="stable").tolist()]:
        if i != centre and find(i) == find(centre):
            continue
        if 5 * len(seqs[i]) < 4 * n[i]:
            continue
        over = tree.overlaps(seqs[i], int(n[i]), len(common))
        hit = np.flatnonzero((over > 0) & (5 * over >= 4 * (n + n[i] - over)))
        for j in hit.tolist():
            a, b = find(i), find(j)
            if a != b:
                root[a] = b
                links.append((i, j))
    return links


def class_links(docs: DataFrame, members: DataFrame, shares: DataFrame, total_bytes: int) -> DataFrame:
    """Edges a, b between classes: they connect just what the links of all pairs connect."""
    size = members.select("cls", F.col("n").alias("size")).distinct()
    shared = shares.groupBy("cls").agg(F.sum("n").alias("shared"))
    # a share of ceil(n / 10) on both sides: of the smaller set's, 8 % of this one's size at least
    left = shared.join(size, "cls").where("100 * shared >= 8 * size").select("cls")
    sets = materialise(sets_of(docs.select("doc_id", "text", "text_hash"), members, left), "sets")
    spark = docs.sparkSession
    found = materialise(groups(sets), "groups", writers(spark, text_bytes=total_bytes))
    total = found.count()
    block = min(MOST_BLOCK, max(LEAST_BLOCK, total // (4 * shuffle_parts(spark))))
    members = found.select(F.col("leader").alias("g"), F.col("cls").alias("item"), F.lit(0).cast("long").alias("size"))

    def linked(x: bytes, y: bytes) -> bool:
        a, b = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
        if 5 * min(len(a), len(b)) < 4 * max(len(a), len(b)):
            return False
        both = len(np.intersect1d(a, b, assume_unique=True))
        return 5 * both >= 4 * (len(a) + len(b) - both)

    edges, placed = blocks.placed(members, sets.select(F.col("cls").alias("item"), F.col("set").alias("value")), linked, block)

    def join(group: pa.Table) -> pa.Table:
        order = np.unique(group["item"].to_numpy(), return_index=True)[1]  # an item may be on both sides
        cls = group["item"].to_numpy()[order]
        links = links_in([np.frombuffer(group["set"][k].as_py(), np.uint64) for k in order.tolist()])
        a, b = (pa.array(cls[[x[k] for x in links]] if links else np.zeros(0, np.int64)) for k in (0, 1))
        return pa.table([a, b], ["a", "b"])

    rows = placed.join(sets.withColumnRenamed("cls", "item"), "item").select("g", "i", "j", "item", "set")
    return edges.union(rows.groupBy("g", "i", "j").applyInArrow(join, "a long, b long"))


def linked_groups(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, n and the group ``g`` of each row of ``with_text_hash``."""
    total = text_bytes(docs)
    parts = writers(docs.sparkSession, text_bytes=total)
    both = materialise(prefixes(docs, total), "prefixes", parts)
    members = both.where("member").drop("member")
    root = components(class_links(docs, members, both.where("not member").select("cls", "n"), total), parts)
    return members.join(root.withColumnRenamed("node", "cls"), "cls", "left").select("doc_id", "text_hash", "n", F.coalesce("root", "cls").alias("g"))


def linked_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text_hash, n_shingles, component_id of each row.

    Links are pairs with 100 * intersection >= 80 * union. A null or empty text, or one
    without words, has an empty set and is linked with nothing, other empty sets included.
    Rows with equal sets are linked, repeated rows among them. component_id is the least
    doc_id of the component; null ids do not count unless there is no other. An empty
    table gives an empty result. Other columns of ``docs`` play no part.
    """
    docs = with_text_hash(docs, id_col, text_col)
    group = linked_groups(docs)
    parts = writers(docs.sparkSession, rows=docs.count())
    group = materialise(group, "linked", parts)
    # stored, so that the join stands alone between its exchanges and a hot group can be split
    least = materialise(group.where("n > 0").groupBy("g").agg(F.min("doc_id").alias("least")), "least", parts)
    own = F.when(F.col("n") > 0, F.col("least")).otherwise(F.col("doc_id"))
    return group.join(least, "g", "left").select("doc_id", "text_hash", F.col("n").alias("n_shingles"), own.alias("component_id"))


def one_of_each_group(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` (all its columns) with the least doc_id of their group of linked ones.

    A null doc_id comes last; of rows equal in doc_id and text one stays. Rows with an empty
    set are linked with nothing and all stay.
    """
    rows = with_text_hash(docs, rest=True)
    group = materialise(linked_groups(rows.select("doc_id", "text", "text_hash")), "linked", writers(docs.sparkSession, rows=rows.count()))
    first = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")
    keep = group.where("n > 0").groupBy("g").agg(F.min(first).alias("f")).select(F.col("f.doc_id").alias("doc_id"), F.col("f.text_hash").alias("text_hash"), F.lit(True).alias("once"))
    keep = keep.union(group.where("n = 0").select("doc_id", "text_hash", F.lit(False)).distinct())
    found = rows.join(keep, same_document(rows, keep)).select(rows["doc_id"], rows["text_hash"], "text", "rest", "once")
    turn = F.row_number().over(W.partitionBy("doc_id", "text_hash").orderBy(F.lit(0)))
    kept = found.withColumn("turn", turn).where("turn = 1 or not once")
    return kept.select(*((F.col("text") if c == "text" else F.col("rest")[c]).alias(c) for c in docs.columns))


def oracle() -> str:
    """``linked_documents`` in DuckDB's SQL, for tables of different ids."""
    capitals = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return f"""
WITH RECURSIVE words AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{capitals}', '{capitals.lower()}'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
sets AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {WORDS} THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - {WORDS - 2}), lambda i: array_to_string(w[i:i + {WORDS - 1}], ' '))) END AS g FROM words),
sizes AS (SELECT doc_id, CAST(len(g) AS BIGINT) AS n FROM sets), grams AS (SELECT doc_id, unnest(g) AS g FROM sets),
pairs AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM grams a JOIN grams b USING (g) WHERE a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT x, y FROM pairs JOIN sizes a ON a.doc_id = x JOIN sizes b ON b.doc_id = y WHERE 100 * c >= 80 * (a.n + b.n - c)),
ways AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach AS (SELECT doc_id, doc_id AS other FROM sizes UNION SELECT reach.doc_id, ways.y FROM reach JOIN ways ON ways.x = reach.other)
SELECT doc_id, any_value(n) AS n_shingles, min(other) AS component_id FROM reach JOIN sizes USING (doc_id) GROUP BY doc_id
"""
