"""The training-data operators against plain versions, and on awkward rows."""

from __future__ import annotations

import math
import random
import zlib
from hashlib import sha256

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from foliospark.llm import ann, blocks, common, components, line_dedup, mixing, ngram_join, quality, queries, sharding, sp_codec, substring_dedup, suffix_dedup, tiff

from . import brute

#: Names that the operators use themselves.
CLASH = "lang string, source string, n_chars long, start int, h long, cls long, z binary, rest string, kept string, row string, bucket int, ord long, tag long, epoch int, tokens long, shard int, score double, digest string, once boolean, turn int, n int, g long"
SCHEMA = f"doc_id long, text string, {CLASH}"


def frame(spark, rows):
    extra = (None, "src1", 1, 2, 3, 4, b"z", "r", "k", "w", 5, 6, 7, 8, 9, 10, 0.5, "d", True, 1, 2, 3)
    return spark.createDataFrame([(d, t, *extra) for d, t in rows], SCHEMA)


def prose(rng, words):
    return " ".join("".join(rng.choice(["th", "an", "er", "in", "é", "on", "st"]) for _ in range(rng.randrange(1, 4))) for _ in range(words))


@pytest.fixture(scope="module")
def awkward():
    """Nulls, empty and long texts, equal rows, one id with two texts, near copies and shared passages."""
    rng = random.Random(5)
    passage, base = prose(rng, 60), prose(rng, 200)
    long = prose(rng, 20_000)
    edited = base.split()
    edited[50], edited[120] = "edited", "Words"
    rows = [
        (1, base), (2, " ".join(edited)), (3, base), (3, base), (4, None), (5, ""), (None, base), (None, None), (None, base + " tail"),
        (6, prose(rng, 30) + "\n" + passage + "\n" + prose(rng, 30)), (7, passage + "\n" + prose(rng, 40)), (8, prose(rng, 25) + " " + passage),
        (9, "a" * 5000), (10, "a" * 3000 + "b"), (11, long), (12, long[:60_000] + " changed " + long[60_000:]), (13, "one two"), (14, "ONE two"), (15, "\n \t"),
        (16, base.upper()), (16, passage), (17, "é" * 300), (18, (passage + "\n") * 3), (19, "x" * 49), (20, "x" * 50), (21, "x" * 50), (-5, passage[:200]),
    ]
    return rows + [(100 + i, " ".join(base.split()[: 150 + 10 * i]) + " " + prose(rng, 20)) for i in range(4)]


def keyed(rows, results):
    return sorted((repr(d), (t or "").encode(), r) for (d, t), r in zip(rows, results))


def collected(df, docs, cols):
    """Results next to the texts that they are of: by position of equal (doc_id, n_bytes) is not enough, so by multiset."""
    return sorted((repr(r["doc_id"]), *(r[c] for c in cols)) for r in df.collect())


def expected(rows, results):
    return sorted((repr(d), *r) for (d, _), r in zip(rows, results))


CUT = ["n_bytes", "n_removed", "n_spans", "kept_sha256"]


def test_substring_dedup(spark, awkward):
    plain = brute.substring(awkward, substring_dedup.gear_values(), substring_dedup.REACH, substring_dedup.LONGEST)
    assert collected(substring_dedup.dedup(frame(spark, awkward)), awkward, CUT) == expected(awkward, plain)


def test_chunks_resist_insertions():
    rng = random.Random(1)
    text = prose(rng, 400).encode()
    moved = b"new bytes " + text
    a, b = ({x[s:e] for s, e in brute.gear_chunks(x, substring_dedup.gear_values(), 32, 1024)} for x in (text, moved))
    assert len(a - b) <= 2


@pytest.mark.parametrize("hot", [32, 1])
def test_suffix_dedup(spark, awkward, hot, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    assert collected(suffix_dedup.dedup(frame(spark, awkward)), awkward, CUT) == expected(awkward, brute.suffix(awkward))


def test_suffix_dedup_in_small_flushes(spark, awkward, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "HELD", 100)
    assert collected(suffix_dedup.dedup(frame(spark, awkward)), awkward, CUT) == expected(awkward, brute.suffix(awkward))


def test_line_dedup(spark, awkward):
    plain = brute.fuzzy_lines(awkward, line_dedup.SHINGLE, line_dedup.SIMILARITY)
    assert collected(line_dedup.dedup(frame(spark, awkward)), awkward, CUT) == expected(awkward, plain)


def test_line_recall(spark):
    rng = random.Random(3)
    rows, pairs = [], 0
    for i in range(150):
        line = prose(rng, 40)
        words = line.split()
        words[rng.randrange(40)] = "changed"
        rows += [(2 * i, line), (2 * i + 1, " ".join(words))]
    plain = brute.fuzzy_lines(rows, line_dedup.SHINGLE, line_dedup.SIMILARITY)
    pairs = sum(1 for r in plain if r[1])
    got = line_dedup.dedup(frame(spark, rows)).where("n_removed > 0").count()
    assert pairs > 100 and got >= 0.95 * pairs


@pytest.mark.parametrize("lines", [512, 70, 20])
def test_line_dedup_of_a_large_family(spark, lines, monkeypatch):
    """A base line with hundreds of copies that each have their own edit: each is like the base, not like the others."""
    monkeypatch.setattr(line_dedup, "BLOCK_LINES", lines)
    rng = random.Random(11)
    base = bytes(rng.choice(b"abcdefghijklmnopqrstuvwxyz") for _ in range(300)).decode()
    rows = [(1000, base)]
    for i in range(300):
        line, at = list(base), 9 + (i % 140) * 2
        for k in range(0, 24, 8):  # three edits at different places: about 24 of 293 shingles
            line[(at + 91 * k // 8) % 300] = chr(65 + (i + k) % 26)
        rows.append((i, "".join(line)))
    plain = brute.fuzzy_lines(rows, line_dedup.SHINGLE, line_dedup.SIMILARITY)
    assert sum(1 for r in plain if r[1]) == 300
    got = line_dedup.dedup(frame(spark, rows).repartition(3))
    assert collected(got, rows, CUT) == expected(rows, plain)


@pytest.mark.parametrize("letters,lines", [("abcdefghijklmnopqrstuvwxyz", 512), ("abcdefghijklmnopqrstuvwxyz", 30), ("абвгдежзиклмнопрстуф", 512), ("日本語文字列行書化物語", 50)])
def test_line_dedup_inside_a_template(spark, letters, lines, monkeypatch):
    """Pairs of near-duplicates among lines of one template: recall as of lines alone, whatever the partitions and blocks."""
    monkeypatch.setattr(line_dedup, "BLOCK_LINES", lines)
    rng = random.Random(4)
    word = lambda: "".join(rng.choice(letters) for _ in range(8))
    frame_ = [word() for _ in range(40)]
    rows = []
    for i in range(200):
        base = list(frame_)
        for k in (3, 15, 27):
            base[k] = word()
        other = list(base)
        other[39] = word()
        other[33] = word()
        rows += [(2 * i, " ".join(base)), (2 * i + 1, " ".join(other))]
    grams = [{t[k : k + 8] for k in range(len(t) - 7)} for _, t in rows]
    share = lambda a, b: len(grams[a] & grams[b]) / len(grams[a] | grams[b])
    assert 0.8 < share(0, 1) and share(0, 2) < 0.8
    plain = brute.fuzzy_lines(rows, line_dedup.SHINGLE, line_dedup.SIMILARITY)
    found = [sorted(r.doc_id for r in line_dedup.dedup(frame(spark, rows).repartition(n)).where("n_removed > 0").collect()) for n in (1, 7)]
    assert found[0] == found[1] and len(found[0]) >= 0.95 * sum(1 for r in plain if r[1])
    assert sum(1 for r in plain if r[1]) >= 200


def test_line_dedup_of_short_lines(spark):
    """Short lines go where they are repeated, similar ones from a shingle's length on; blank lines stay."""
    texts = ["Read more\nShare\n\n  \nab\nhome page 12", "ac\nShare\nRead more\n\n  \nhome page 123", "Share\n\nNew\nab", "Share\nab \n\t\n\t"]
    got = line_dedup.dedup(frame(spark, list(enumerate(texts))), keep_text=True).orderBy("doc_id").collect()
    assert [r.kept.decode() for r in got] == [texts[0], "ac\n\n  \n", "\nNew\n", "ab \n\t\n\t"]


@pytest.mark.parametrize("left", [0, 40])
def test_line_links_connect_what_all_pairs_do(left):
    rng = np.random.default_rng(6)
    families = [rng.integers(0, 10**6, 60) for _ in range(4)]
    for _ in range(20):
        sets = []
        for _ in range(90):
            s = families[rng.integers(4)].copy()
            s[rng.choice(60, rng.integers(0, 12), replace=False)] = rng.integers(0, 10**6)
            sets.append(np.unique(s))
        both = lambda i, j: left == 0 or (i < left) != (j < left)
        pairs = [(i, j) for i in range(90) for j in range(i) if both(i, j) and line_dedup.alike(sets[i], sets[j])]
        links = line_dedup.group_links(sets, left)
        assert all(both(i, j) and line_dedup.alike(sets[i], sets[j]) for i, j in links)
        assert brute.components(range(90), links) == brute.components(range(90), pairs)


def test_ngram_join(spark, awkward):
    got = ngram_join.linked_documents(frame(spark, awkward))
    assert collected(got, awkward, ["n_shingles", "component_id"]) == expected(awkward, brute.jaccard_groups(awkward)) or sorted(map(repr, collected(got, awkward, ["n_shingles", "component_id"]))) == sorted(map(repr, expected(awkward, brute.jaccard_groups(awkward))))


@pytest.mark.parametrize("block", [4, 16, 128])
def test_ngram_join_of_a_large_family(spark, block, monkeypatch):
    """Copies of one text with edits: many links to the first one, few among the others; split in blocks."""
    monkeypatch.setattr(ngram_join, "LEAST_BLOCK", block)
    monkeypatch.setattr(ngram_join, "MOST_BLOCK", block)
    monkeypatch.setattr(ngram_join, "MOST_FREQUENT", 50)
    rng = random.Random(9)
    base = prose(rng, 120).split()
    rows = [(1000, " ".join(base))]
    for i in range(60):
        w = list(base)
        for _ in range(rng.randrange(1, 6)):
            w[rng.randrange(len(w))] = f"w{rng.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    rows += [(2000 + i, prose(rng, 80) + " " + " ".join(base[:15])) for i in range(20)]
    got = collected(ngram_join.linked_documents(frame(spark, rows)), rows, ["n_shingles", "component_id"])
    assert got == expected(rows, brute.jaccard_groups(rows))


@pytest.mark.parametrize("block,stars", [(3, 8), (7, 8), (7, 1), (1000, 8)])
def test_blocks_cover_all_pairs_but_a_stars(spark, block, stars, monkeypatch):
    """Every linked pair of a group meets in a block, or both are linked with the centre."""
    monkeypatch.setattr(blocks, "STAR_BLOCKS", stars)
    rng = random.Random(block)
    value = {i: rng.randrange(40) for i in range(90)}
    linked = lambda a, b: abs(a[0] - b[0]) <= 2
    rows = [(g, i, 1) for g in range(4) for i in value if rng.random() < (0.02, 0.3, 0.6, 1)[g]]
    members = spark.createDataFrame(rows, "g long, item long, size long")
    values = spark.createDataFrame([(i, bytes([v])) for i, v in value.items()], "item long, value binary")
    edges, placed = blocks.placed(members, values, linked, block)
    star = {(r.a, r.b) for r in edges.collect()}
    met: dict = {}
    for r in placed.collect():
        met.setdefault((r.g, r.i, r.j), ([], []))[r.side].append(r.item)
    assert all(len(x) <= 6 * block and len(y) <= 6 * block for x, y in met.values())
    together = {(g, a, b) for (g, i, _), (x, y) in met.items() for a in (y if i < 0 else x) for b in y}
    for g in range(4):
        items = [i for h, i, _ in rows if h == g]
        for a in items:
            for b in items:
                if a < b and linked([value[a]], [value[b]]):
                    centre = min(items)
                    joined = all(x == centre or (x, centre) in star for x in (a, b))
                    assert joined or (g, a, b) in together or (g, b, a) in together


def test_tree_overlaps():
    rng = np.random.default_rng(4)
    sets = [np.unique(rng.integers(0, 60, rng.integers(5, 50))) for _ in range(40)]
    n = np.array([len(s) for s in sets])
    tree = ngram_join.Tree(sets, n)
    for i, s in enumerate(sets):
        over = tree.overlaps(s, len(s), 60)
        for j, o in enumerate(sets):
            both = len(np.intersect1d(s, o))
            if 5 * both >= 4 * (len(s) + len(o) - both):
                assert over[j] == both, (i, j)
            else:
                assert over[j] in (both, -1)


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(1000 + i, 1001 + i) for i in range(60)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    plain = brute.components({x for e in edges for x in e}, edges)
    assert all(got.get(n, n) == r for n, r in plain.items())
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("rows", [0, 1, 39, 1003])
def test_sharding(spark, rows):
    df = spark.range(rows, numPartitions=3).select(F.when(F.col("id") % 5 > 0, F.col("id")).alias("doc_id"), F.lit("same").alias("shard"), F.lit(None).cast("string").alias("text"))
    got = sharding.shard_rows(df, 40, seed=3).collect()
    assert len(got) == rows
    slots: dict[int, list[int]] = {}
    for r in got:
        slots.setdefault(r.shard, []).append(r.slot)
    sizes = [len(slots.get(s, [])) for s in range(40)]
    assert max(sizes) - min(sizes) <= 1
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert sorted(map(repr, (r.doc_id for r in got))) == sorted(map(repr, (r.doc_id for r in df.collect())))


def test_sharding_folds_blocks_and_stores_input(spark):
    df = spark.range(500, numPartitions=9)
    got = sharding.shard_rows(df, 7, seed=1, max_blocks=2, stable_input=False)
    assert got.groupBy("shard").count().agg(F.min("count"), F.max("count")).first()[:] == (71, 72)


def test_sharding_of_clashing_names(spark, tmp_path):
    df = spark.range(100, numPartitions=4).select("id", *(F.col("id").alias(c) for c in ("__at", "__part", "__rows", "__row", "__shard", "a.b", "shard", "slot")))
    got = sharding.shard_rows(df, 7, seed=2)
    assert got.columns == ["id", "__at", "__part", "__rows", "__row", "__shard", "a.b", "shard", "slot"]
    rows = got.collect()
    assert sorted(r.id for r in rows) == list(range(100)) and all(r["a.b"] == r["__at"] == r["__row"] == r.id for r in rows)
    assert [len([r for r in rows if r.shard == s]) for s in range(7)] == [15, 15, 14, 14, 14, 14, 14]
    # written, each shard is a folder with its rows in slot order inside each file
    sharding.write_shards(got.select("id", "shard", "slot"), f"file://{tmp_path}/shards")
    back = spark.read.parquet(f"file://{tmp_path}/shards")
    assert sorted((r.id, r.shard, r.slot) for r in back.collect()) == sorted((r.id, r.shard, r.slot) for r in rows)
    for file in tmp_path.glob("shards/shard=*/*.parquet"):
        slots = [r.slot for r in spark.read.parquet(f"file://{file}").collect()]
        assert slots == sorted(slots)


def test_words8():
    rng = np.random.default_rng(2)
    for n in (0, 1, 7, 8, 9, 63, 200):
        for pad in (64, 72):
            raw = rng.integers(0, 256, n, dtype=np.uint8)
            plain = [int.from_bytes((raw.tobytes() + bytes(pad))[i : i + 8], "little") for i in range(n + pad - 8)]
            assert common.words8(raw, pad).tolist() == plain


def test_hypergeometric_law():
    rng = random.Random(1)
    for good, bad, draws in [(300, 700, 200), (5, 5, 5), (40, 2000, 900), (10**10, 10**11, 10**9)]:
        xs = [sharding.hypergeometric(rng, good, bad, draws) for _ in range(4000)]
        n = good + bad
        mean, var = draws * good / n, draws * good / n * (bad / n) * (n - draws) / (n - 1)
        assert abs(sum(xs) / len(xs) - mean) < 5 * math.sqrt(var / len(xs))
        assert 0.85 < sum((x - mean) ** 2 for x in xs) / len(xs) / var < 1.15


def test_communication_matrix():
    m = sharding.communication_matrix([10, 0, 25, 7], [14, 14, 14], 5)
    assert [sum(r) for r in m] == [10, 0, 25, 7] and [sum(c) for c in zip(*m)] == [14, 14, 14]


def test_sentencepiece(spark, awkward):
    model = queries.tokenizer_path()
    rows = awkward + [(200 + i, t) for i, t in enumerate(["  two  spaces ", "▁mark", "日本語 text", "\U0001f600 <s> </s> <0xFC>", "tab\tand\nline\n\n", " lead", "\x00nul", "w" * 300])]
    got = sorted((repr(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in sp_codec.encode_texts(frame(spark, rows), model).collect())
    sp = sp_codec.Vocabulary(model).library

    def one(text):
        ids = sp.encode(text or "", add_eos=True)
        return len(ids), sha256(" ".join(map(str, ids)).encode()).hexdigest(), sha256(sp.decode(ids).encode()).hexdigest()

    assert got == sorted((repr(d), *one(t)) for d, t in rows)


def test_agenda_alone_is_the_library():
    v = sp_codec.Vocabulary(queries.tokenizer_path())
    rng = random.Random(7)
    for _ in range(300):
        word = "▁" + "".join(rng.choice("abcdefgé日tion.,\n") for _ in range(rng.randrange(1, 60)))
        assert v.merge(word) == v.library.encode(word[1:]) == v.word_ids([word])[0]


def test_sentencepiece_cache_turns_over(monkeypatch):
    monkeypatch.setattr(sp_codec, "CACHE_WORDS", 5)
    v = sp_codec.Vocabulary(queries.tokenizer_path())
    texts = ["a b c d e f g", "h i j a b", "k a", "", "x  y"]
    assert [ids for _, ids in v.encoded(texts)] == v.library.encode(texts, add_eos=True)


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, v string, part int, rank int, score float")


def test_search_of_few_and_bad_vectors(spark):
    x = [(0, [1.0, 0.0]), (50, [0.0, 0.0]), (100, [1.0, 1.0]), (150, None), (7, [1.0, float("nan")]), (8, [2.0, 0.0]), (9, [2.0, 0.0]), (3, [None, 1.0]), (4, [1.0]), (None, [1.0, 0.0]), (8, [2.0, 0.0])]
    got = ann.search(vectors(spark, [(i, v, "v", 1, 1, 0.5) for i, v in x]), F.col("vec_id") % 50 == 0).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.rank, r.vec_id) for r in got] == [(0, 1, 8), (0, 2, 9), (0, 3, 100), (100, 1, 0), (100, 2, 8), (100, 3, 9)]
    assert got[0].score == 1.0
    assert ann.search(vectors(spark, []), F.col("vec_id") % 50 == 0).count() == 0


def test_search_recall_and_ties(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(3000, 16)).astype(np.float32)
    x[100:900] = x[100]  # one vector for a third of all rows
    got: dict = {}
    df = vectors(spark, [(i, [float(a) for a in v], "v", 1, 1, 0.5) for i, v in enumerate(x)])
    for r in ann.search(df, F.col("vec_id") % 50 == 0, sample_rows=2000, block_rows=256, block_queries=16).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    d = x.astype(float)
    u = d / np.linalg.norm(d, axis=1)[:, None]
    hit = 0
    for q in range(0, 3000, 50):
        s = u @ u[q]
        s[q] = -9
        best = np.lexsort((np.arange(3000), -np.round(s, 12)))[:5]
        mine = [v for _, v, _ in sorted(got[q])]
        hit += len(set(best.tolist()) & set(mine))
        assert [r for r, _, _ in sorted(got[q])] == [1, 2, 3, 4, 5] and q not in mine
    assert hit / 300 >= 0.9
    assert [v for _, v, _ in sorted(got[100])] == [101, 102, 103, 104, 105]


def test_search_recall_on_given_vectors(spark):
    """Against brute force over all rows, and with more partitions than the smallest number."""
    d = "/root/testdata/sf0.1"
    rows = spark.read.parquet(f"{d}/embeddings.parquet").collect()
    ids, x = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], np.float64)
    u = x / np.linalg.norm(x, axis=1)[:, None]
    asked = np.flatnonzero(ids % 50 == 0)
    best = {}
    for q in asked:
        s = u @ u[q]
        s[q] = -9
        best[ids[q]] = set(ids[np.lexsort((ids, -s))[:5]].tolist())
    for parts in (None, 24):
        got: dict = {}
        found = queries.op7_ann(spark, d) if parts is None else ann.search(spark.read.parquet(f"{d}/embeddings.parquet"), F.col("vec_id") % 50 == 0, parts=parts)
        for r in found.collect():
            got.setdefault(r.query_id, set()).add(r.vec_id)
        assert set(got) == set(best) and all(len(v) == 5 for v in got.values())
        assert sum(len(best[q] & got[q]) for q in best) >= 0.9 * 5 * len(best)


def test_quality_held_out(spark):
    d = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{d}/labels.parquet")
    rows = queries.op8_quality(spark, d)
    assert rows.count() == 1000
    for r in rows.select("doc_id", "held_out").limit(200).collect():
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
    found = rows.where("held_out").join(labels, "doc_id").agg(F.avg((F.col("predicted") == F.col("quality")).cast("int"))).first()[0]
    assert found >= 0.97


def test_quality_scores_plainly(spark, awkward):
    """The scores are those of numpy's log-densities."""
    docs = frame(spark, awkward)
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(30)] + [(1, None, None), (None, 1, 0), (2, 0, 0), (3, 7, 0)], "doc_id long, quality int, toxic int")
    stats = quality.statistics(docs)
    model = quality.fit(stats, labels)
    xs = [f"x{i}" for i in range(len(quality.FEATURES))]
    rows = stats.select(*(c.alias(x) for c, x in zip(model.features(), xs))).withColumn("s", model.score(xs)).collect()
    assert len(rows) == len(awkward)
    for r in rows:
        v = np.array([r[x] for x in xs])
        dens = [-0.5 * (((model.inverse[c] @ (v - model.means[c])) ** 2).sum() + model.log_det[c]) for c in (0, 1)]
        z = (dens[1] - dens[0] + model.log_prior) / len(xs)
        assert r.s == pytest.approx(1 / (1 + math.exp(-max(-500, min(500, z)))), abs=1e-9)


def test_quality_carries_clashing_names(spark):
    docs = frame(spark, [(1, "one two"), (None, None), (3, "")]).withColumn("words", F.lit("w")).withColumn("capitals", F.lit(None).cast("string"))
    got = quality.classify(docs, spark.createDataFrame([], "doc_id long, quality int"), carry=["words", "capitals", "n", "score"])
    assert got.columns == ["doc_id", "words", "capitals", "n", "score", "held_out", "score", "predicted"]
    assert [tuple(r)[1:5] for r in got.collect()] == [("w", None, 2, 0.5)] * 3


def test_quality_without_labels(spark, awkward):
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert quality.classify(frame(spark, awkward), none).where("score between 0 and 1").count() == len(awkward)
    assert quality.classify(frame(spark, []), none).count() == 0


def test_counts(spark):
    r = quality.statistics(frame(spark, [(1, "Aa é 1 !| #, Aa aa x\nx"), (2, None)])).orderBy("doc_id").collect()
    assert [r[0][c] for c in quality.COUNTS] == [2, 8, 1, 8, 1, 1, 1, 1, 9, 2, 0]
    assert sum(r[1][c] for c in quality.COUNTS) == 0


@pytest.mark.parametrize("name,sf", [("op9_mixing", "sf0.001"), ("op9_mixing", "sf0.01"), ("op4_suffix_dedup", "sf0.01"), ("op5_ngram_join", "sf0.01")])
def test_queries_are_their_sql(spark, name, sf):
    d = f"/root/testdata/{sf}"
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{d}/documents.parquet'")
    found = c.sql(queries.ORACLES[name])
    assert sorted(map(tuple, queries.QUERIES[name](spark, d).select(*found.columns).collect())) == sorted(found.fetchall())


def test_mixing_redistributes(spark):
    """A source that is short gives its share to its siblings first."""
    text = "w " * 10
    rows = [(i, text, "en", "src0") for i in range(2)] + [(i, text, "en", "src4") for i in range(10, 40)] + [(i, text, "en", "src1") for i in range(50, 80)] + [(90, None, None, None), (91, "", "fr", "src0")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = mixing.mixed(df, percent=50, max_epochs=1)
    by = {r["source"]: r["n"] for r in got.groupBy("source").agg(F.sum("tokens").alias("n")).collect()}
    # 310 tokens: domain0 (weight 4) and domain1 (3); src0 has 20 only, so src4 takes the rest of domain0's 177
    assert by == {"src0": 20, "src4": 150, "src1": 130}
    assert mixing.mixed(df.limit(0)).count() == 0


def test_mixing_awkward(spark, awkward):
    docs = frame(spark, awkward)
    whole = mixing.mixed(docs, percent=100, max_epochs=1, as_documents=True)
    assert whole.columns == docs.columns
    words = sum(len(brute.WORD.findall(t or "")) for _, t in awkward)
    assert whole.agg(F.sum(F.regexp_count("text", F.lit(mixing.WORD)))).first()[0] == words
    twice = mixing.mixed(docs, percent=200, max_epochs=2)
    assert twice.agg(F.sum("tokens")).first()[0] == 2 * words


@pytest.mark.parametrize("compression", [tiff.NONE, tiff.LZW, tiff.DEFLATE, tiff.PACKBITS])
@pytest.mark.parametrize("predictor", [1, 2])
@pytest.mark.parametrize("tiled", [False, True])
def test_tiff_round_trip(compression, predictor, tiled):
    rng = random.Random(3)
    for size in (1, 70, 1100 if compression != tiff.LZW else 140):
        for make in (lambda: rng.randrange(256), lambda: rng.choice(b"aab "), lambda: 32):
            payload = bytes(make() for _ in range(192 * size))
            found = list(tiff.decode_pages(tiff.encode(payload, compression, predictor, tiled)))
            assert b"".join(p.samples for p in found) == payload
            assert [p.number for p in found] == list(range(-(-size // tiff.PAGE_ROWS)))


def test_tiff_layouts_at_every_size():
    """Long payloads meet LZW as short ones do, in strips and in tiles, and come back whole."""
    rng = random.Random(8)
    met = set()
    for k in range(40):
        text = prose(rng, 2000 + k).encode()
        met.add(tiff.layout_for(tiff.payload_of(text))[::2])
        row = tiff.describe(text)
        assert row[:3] == (len(text), len(tiff.payload_of(text)), sha256(tiff.payload_of(text)).hexdigest())
    assert {(code, tiled) for code in (tiff.DEFLATE, tiff.PACKBITS, tiff.LZW) for tiled in (False, True)} == met  # nothing is stored as it is


def test_tiff_of_other_writers():
    """Big-endian, values in the entry, one strip, PackBits with a no-op."""
    import struct

    data = b"\x80\xfe\x07\x00\x09"  # no-op, three sevens, one nine
    tags = [(256, 3, 2), (257, 3, 2), (258, 3, 8), (259, 3, 32773), (262, 3, 1), (273, 4, 8), (277, 3, 1), (278, 3, 2), (279, 4, len(data))]
    ifd = struct.pack(">H", len(tags)) + b"".join(struct.pack(">HHL", t, k, 1) + (struct.pack(">HH", v, 0) if k == 3 else struct.pack(">L", v)) for t, k, v in tags) + struct.pack(">L", 0)
    (page,) = tiff.decode_pages(struct.pack(">2sHL", b"MM", 42, 8 + len(data)) + data + ifd)
    assert page.samples == b"\x07\x07\x07\x09"


def tiff_file(order, fields, blocks):
    """A file of one directory by hand: ``fields`` tag: (type, values); the blocks' places and sizes come under tags 273 and 279."""
    import struct

    out = struct.pack(order + "2sHL", b"II" if order == "<" else b"MM", 42, 0)
    places = []
    for b in blocks:
        places.append(len(out))
        out += b + b"\0" * (len(b) & 1)
    fields = fields | {273: (4, places), 279: (4, [len(b) for b in blocks])}
    entries = b""
    for tag, (kind, values) in sorted(fields.items()):
        body = struct.pack(f"{order}{len(values)}{'H' if kind == 3 else 'L'}", *values)
        if len(body) > 4:
            body, at = struct.pack(order + "L", len(out)), body
            out += at
        entries += struct.pack(order + "HHL", tag, kind, len(values)) + body.ljust(4, b"\0")
    return out[:4] + struct.pack(order + "L", len(out)) + out[8:] + struct.pack(order + "H", len(fields)) + entries + struct.pack(order + "L", 0)


def nine_bits(codes):
    bits = "".join(f"{c:09b}" for c in codes)
    bits += "0" * (-len(bits) % 8)
    return bytes(int(bits[i : i + 8], 2) for i in range(0, len(bits), 8))


def test_lzw_by_hand():
    """Codes written bit by bit: the specification's example, a string that needs its own end, a clear in between, no end code."""
    example = nine_bits([256, 7, 258, 8, 8, 258, 6, 6, 257])
    grey = {256: (3, [9]), 257: (3, [1]), 258: (3, [8]), 259: (3, [5]), 262: (3, [1]), 277: (3, [1]), 278: (3, [1])}
    (page,) = tiff.decode_pages(tiff_file(">", grey, [example]))
    assert page.samples == bytes([7, 7, 7, 8, 8, 7, 7, 6, 6]) and tiff.lzw(page.samples) == example
    twice = nine_bits([256, 65, 258, 259, 256, 66, 66, 258])
    (page,) = tiff.decode_pages(tiff_file("<", grey | {256: (3, [10])}, [twice]))
    assert page.samples == b"AAAAAABBBB"
    with pytest.raises(tiff.TiffError):
        tiff.unlzw(nine_bits([256, 65, 300]), 9)
    with pytest.raises(tiff.TiffError):
        tiff.unlzw(nine_bits([256, 258]), 9)


def test_lzw_of_all_lengths():
    """Against a plain decoder that takes code after code; tables fill up and are cleared."""
    rng = random.Random(12)

    def plain(data):
        bits, at, width, table, last, out = "".join(f"{b:08b}" for b in data), 0, 9, {}, None, b""
        while True:
            code, at = int(bits[at : at + width], 2), at + width
            if code == 257:
                return out
            if code == 256:
                table, width, last = {i: bytes([i]) for i in range(256)}, 9, None
                continue
            word = table.get(code) or last + last[:1]
            out += word
            if last is not None:
                table[len(table) + 2] = last + word[:1]
            last = word
            width = min(12, max(9, (len(table) + 2 + 1).bit_length()))

    for n in (0, 1, 2, 3, 255, 256, 257, 5000, 20_000):
        for letters in (1, 3, 256):
            data = bytes(rng.randrange(letters) for _ in range(n))
            packed = tiff.lzw(data)
            assert plain(packed) == data == tiff.unlzw(packed, n)


def test_colours_and_wide_samples(spark):
    """Three channels together and apart, sixteen bits, white as zero, bits the other way round, in strips with and without predictor."""
    rng = np.random.default_rng(5)
    turned = bytes(int(f"{b:08b}"[::-1], 2) for b in range(256))
    for order, channels, bits, apart, predictor, code, flip in ((o, c, b, a, p, z, f) for o in "<>" for c in (1, 3) for b in (8, 16) for a in (1, 2) for p in (1, 2) for z in (1, 5, 8, 32773) for f in (1, 2)):
        if predictor == 2 and code not in (5, 8):
            continue
        image = rng.integers(0, 1 << bits, (5, 7, channels)).astype(f"<u{bits // 8}")
        blocks = []
        for plane in range(channels) if apart == 2 else [slice(None)]:
            for y in range(0, 5, 2):
                part = image[y : y + 2, :, plane].reshape(min(2, 5 - y), 7, -1)
                if predictor == 2:
                    part = np.diff(part, axis=1, prepend=np.zeros_like(part[:, :1]))
                raw = part.astype(f"{order}u{bits // 8}").tobytes()
                row = len(raw) // len(part)
                raw = {1: lambda r: r, 5: tiff.lzw, 8: zlib.compress, 32773: lambda r: tiff.packbits(r, row)}[code](raw)
                blocks.append(raw.translate(turned) if flip == 2 else raw)
        fields = {256: (3, [7]), 257: (3, [5]), 258: (3, [bits] * channels), 259: (3, [code]), 262: (3, [2 if channels == 3 else 1]), 266: (3, [flip]), 277: (3, [channels]), 278: (3, [2]), 284: (3, [apart]), 317: (3, [predictor])}
        (page,) = tiff.decode_pages(tiff_file(order, fields, blocks))
        assert (page.channels, page.bits, page.samples) == (channels, bits, image.tobytes())
        if channels == 1:
            (page,) = tiff.decode_pages(tiff_file(order, fields | {262: (3, [0])}, blocks))
            assert page.samples == (~image).tobytes()
    row = tiff.pages(spark.createDataFrame([(1, bytearray(tiff_file(order, fields, blocks)))], "id long, media binary")).first()
    assert (row.channels, row.bits, row.error) == (channels, bits, None)


def test_pages_report_errors(spark):
    good = tiff.encode(tiff.payload_of(b"abc"))
    rows = [(1, good), (2, b"no tiff"), (3, None), (4, good[:40]), (1, good), (5, b"")]
    got = tiff.pages(spark.createDataFrame(rows, "id long, media binary")).collect()
    assert sorted((r.id, r.error is None) for r in got) == [(1, True), (1, True), (2, False), (4, False), (5, False)]


def patched(data: bytes, tag: int, **new) -> bytes:
    """``data`` (one page, little-endian) with other values in the entry of ``tag``."""
    import struct

    out = bytearray(data)
    (at,) = struct.unpack_from("<L", out, 4)
    (n,) = struct.unpack_from("<H", out, at)
    for k in range(n):
        where = at + 2 + 12 * k
        if struct.unpack_from("<H", out, where)[0] == tag:
            if "count" in new:
                struct.pack_into("<L", out, where + 4, new["count"])
            if "value" in new:
                struct.pack_into("<L", out, where + 8, new["value"])
    return bytes(out)


def test_broken_files_are_error_rows(spark):
    """One bad file is a row, not the job's end: empty fields, huge sides, bombs, missing parts."""
    good = {c: tiff.encode(tiff.payload_of(b"abc" * 400), c) for c in (tiff.NONE, tiff.DEFLATE, tiff.LZW, tiff.PACKBITS)}
    tiles = tiff.encode(tiff.payload_of(b"abc" * 400), tiff.DEFLATE, 1, True)
    bomb = zlib.compress(bytes(1 << 26), 9)
    rows = [good[tiff.DEFLATE], *(patched(good[tiff.DEFLATE], t, count=0) for t in (256, 257, 258, 259, 273, 277, 278, 279, 317)), patched(good[tiff.DEFLATE], 256, value=1 << 30), patched(good[tiff.DEFLATE], 257, value=(1 << 32) - 1)]
    rows += [patched(good[tiff.DEFLATE], 278, value=0), patched(good[tiff.DEFLATE], 317, value=3), patched(good[tiff.DEFLATE], 259, value=7), patched(good[tiff.DEFLATE], 256, count=(1 << 32) - 1)]
    rows += [patched(tiles, 322, value=0), patched(tiles, 322, value=60000), patched(tiles, 323, value=1), good[tiff.LZW][:30], *(g[:-9] for g in good.values())]
    big = tiff.encode(bytes(192 * 32), tiff.DEFLATE)
    rows.append(patched(patched(big + bomb, 273, value=len(big)), 279, value=len(bomb)))
    got = {r.id: r for r in tiff.pages(spark.createDataFrame(list(enumerate(rows)), "id long, media binary")).collect()}
    assert len(got) == len(rows)
    assert got[0].error is None and got[len(rows) - 1].samples == bytes(192 * 32)  # the bomb is read as far as its strip goes
    ignored = {i for i, t in enumerate((256, 257, 258, 259, 273, 277, 278, 279, 317), 1) if t in (277, 278, 317)}  # fields with a default
    assert all((got[i].error is None) == (i in ignored) for i in range(1, len(rows) - 1)), [(i, got[i].error) for i in got]


def test_stored_form_and_feature(spark, awkward):
    """media_sha256, media_bytes and feature are those of the stored file and of what it holds."""
    names = {tiff.NONE: "none", tiff.LZW: "lzw", tiff.DEFLATE: "deflate", tiff.PACKBITS: "packbits"}
    for r in tiff.store_texts(frame(spark, awkward), keep_media=True).collect():
        assert (r.media_bytes, r.media_sha256) == (len(r.media), sha256(r.media).hexdigest())
        raw = b"".join(p.samples for p in tiff.decode_pages(r.media))
        assert sha256(raw).hexdigest() == r.payload_sha256
        code, predictor, tiled = tiff.layout_for(raw)
        counts = [raw.count(bytes((i,))) for i in range(256)]
        rows = len(raw) // 192
        assert r.feature == f"192x{rows} pages={-(-rows // 1024)} {names[code]} predictor={predictor} {'tiles' if tiled else 'strips'} levels={sum(c > 0 for c in counts)} mode={counts.index(max(counts))} sum={sum(raw)}"


def test_store_texts(spark, awkward):
    got = collected(tiff.store_texts(frame(spark, awkward)), awkward, ["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32"])

    def one(text):
        p = tiff.payload_of((text or "").encode())
        return len((text or "").encode()), len(p), sha256(p).hexdigest(), zlib.crc32(p[-16:])

    assert got == sorted((repr(d), *one(t)) for d, t in awkward)


@pytest.mark.parametrize("run", [substring_dedup.dedup, suffix_dedup.dedup, line_dedup.dedup, ngram_join.linked_documents, tiff.store_texts, lambda d: sp_codec.encode_texts(d, queries.tokenizer_path())])
def test_empty_tables(spark, run):
    assert run(frame(spark, [])).count() == 0
    assert run(frame(spark, [(None, None)])).count() == 1


def test_op2_digests(spark, sf_dir):
    got = {r.doc_id: r for r in queries.op2_sharding(spark, sf_dir).collect()}
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    assert len(got) == len(docs)
    for d in docs:
        raw = d.text.encode()
        assert (got[d.doc_id].size, got[d.doc_id].text_crc32, got[d.doc_id].law) == (len(raw) + 16, zlib.crc32(raw), "rows")


@pytest.mark.parametrize("name,plain", [("op1_substring_dedup", lambda r: brute.substring(r, substring_dedup.gear_values(), substring_dedup.REACH, substring_dedup.LONGEST)), ("op4_suffix_dedup", brute.suffix)])
def test_queries_on_given_tables(spark, sf_dir, name, plain):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    assert collected(queries.QUERIES[name](spark, sf_dir), rows, CUT) == expected(rows, plain(rows))


def test_op5_on_given_tables(spark):
    d = "/root/testdata/sf0.01"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{d}/documents.parquet").collect()]
    assert collected(queries.op5_ngram_join(spark, d), rows, ["n_shingles", "component_id"]) == expected(rows, brute.jaccard_groups(rows))


def test_operators_beside_each_other(spark):
    """Union-finds and line dedups in several threads of one session: each has tables of its own."""
    from concurrent.futures import ThreadPoolExecutor

    def one(k):
        edges = spark.createDataFrame([(k * 100 + i, k * 100 + i + 1) for i in range(12)], "a long, b long")
        rows = [(i, f"line {k} of the text\nand another one {i % 2} of {k}") for i in range(4)]
        return {r.root for r in components.components(edges).collect()}, collected(line_dedup.dedup(frame(spark, rows)), rows, CUT) == expected(rows, brute.fuzzy_lines(rows, line_dedup.SHINGLE, line_dedup.SIMILARITY))

    with ThreadPoolExecutor(4) as pool:
        assert list(pool.map(one, range(4))) == [({k * 100}, True) for k in range(4)]


def test_tables_are_those_of_their_block(spark):
    df = spark.range(3)
    with common.stored_tables() as outer:
        _, first = common.stored(df, "t")
        with common.stored_tables() as inner:
            _, second = common.stored(df, "t")
            _, third = common.stored(df, "t")
            common.forget(spark, [second])
            assert inner == [third]
        assert outer == [first, third]


def test_blank_lines_stay_whatever_their_length(spark):
    rows = [(1, " " * n + "\n" + "\t" * n + "\n" + " " * n) for n in (1, 7, 8, 9, 40)] * 2
    assert all(r.n_removed == 0 for r in line_dedup.dedup(frame(spark, rows)).collect())


def test_sharding_stays_in_the_jvm(spark):
    """No Python, pandas, Arrow or RDD on the way: the lookup tables are literals."""
    plan = sharding.shard_rows(spark.range(50).withColumn("text", F.lit("x")), 4)._jdf.queryExecution().executedPlan().toString()
    assert not any(name in plan for name in ("ExistingRDD", "Python", "Arrow", "Pandas"))
