"""What travels between tasks grows with the input, not with pairs of its rows; and rows that only larger tables have."""

from __future__ import annotations

import random
import weakref
from types import SimpleNamespace

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from foliospark.functions import offsets
from foliospark.functions import text as T
from foliospark.operators import catalog, consolidate, pages, postings, search, sections, tools, trigrams
from foliospark.plans import flow, registry
from foliospark.sources import adapters, store
from pyspark.sql import functions as F


def shuffled(spark, df) -> tuple[list, int, int]:
    """The rows of ``df``, and how many records and bytes its jobs exchanged."""
    store = spark.sparkContext._jsc.sc().statusStore()

    def stages() -> dict:
        found = store.stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
        return {(s.stageId(), s.attemptId()): s for s in (found.apply(i) for i in range(found.size()))}

    before = set(stages())
    rows = df.collect()
    own = [s for k, s in stages().items() if k not in before]
    return rows, sum(s.shuffleWriteRecords() for s in own), sum(s.shuffleWriteBytes() for s in own)


def entry(path: str, title: str, links: list[str]) -> tuple:
    return (path, title, "concept", "said", ["s"], [], links, [], "2024-01-31", "text")


NOTE = "path string, title string, type string, summary string, sources array<string>, keywords array<string>, links array<string>, sections array<string>, last_updated string, content string"


def test_searches_by_table_function_exchange_no_scored_pairs(spark):
    notes = spark.createDataFrame([entry(f"c/{i}.md", f"common word{i % 7} t{i}", []) for i in range(600)], NOTE)
    found = catalog.entries(notes)
    tools.register(spark, found, postings.blocks(found).localCheckpoint(), notes.select("path", "content"), name="growth")
    asked = spark.createDataFrame([(q, f"common word{q % 7} q{q}") for q in range(50)], "qid int, text string")
    rows, records, _ = shuffled(spark, spark.sql("SELECT qid, s.path, s.score_micro FROM {asked}, LATERAL search_wiki(text) s", asked=asked))
    assert len(rows) == 500
    assert records < 50 * 600 / 2  # each question matches each note


def test_backlinks_exchange_no_pairs(spark):
    """A thousand pages of one name, and a thousand that link to it: two million pairs of eight bytes."""
    linked = spark.range(2000).select(F.col("id").alias("page_id"), F.when(F.col("id") < 1000, "a").otherwise("b").alias("name"), F.when(F.col("id") % 2 == 0, F.array(F.lit("a"))).otherwise(F.array(F.lit("a b"), F.lit("x"))).alias("links"))
    every = [i for i in range(2000) if i % 2 == 0]
    rows, _, size = shuffled(spark, catalog.backlinks(linked))
    assert {r.page_id: r.backlinks for r in rows} == {i: [s for s in every if s != i] for i in range(1000)}
    assert size < 200_000
    rows, _, size = shuffled(spark, catalog.backlinks_within(linked))
    got = {r.page_id: r.backlinks for r in rows}
    assert len(got) == 2000 and all(got[i] == [s for s in range(2000) if s != i] for i in range(1000)) and got[1001] == [i for i in range(2000) if i % 2 and i != 1001]
    assert size < 400_000


def test_entries_and_updates_exchange_no_lists(spark, tmp_path):
    notes = spark.createDataFrame([entry(f"c/{i:04d}.md", "a", ["a"]) for i in range(1000)], NOTE)
    rows, _, size = shuffled(spark, catalog.entries(notes))
    assert all(len(r.backlinks) == 999 and r.path not in r.backlinks for r in rows) and size < 1_000_000
    catalog.save(catalog.entries(notes), f"file://{tmp_path}/c")
    changed = spark.createDataFrame([entry("c/0007.md", "a", [])], NOTE)
    rows, _, size = shuffled(spark, catalog.updated(catalog.load(spark, f"file://{tmp_path}/c"), changed))
    assert len(rows) == 1000 and all("c/0007.md" not in r.backlinks for r in rows) and size < 1_000_000


def test_related_pages_of_a_common_name(spark):
    """Eight sources behind the links, whatever their number; one of them is the page itself, some are links already."""
    linked = spark.createDataFrame([(i, "a", ["1", "3", "raw/x", "a"]) for i in range(200)], "page_id long, name string, links array<string>")
    rows, _, size = shuffled(spark, catalog.related(linked))
    for r in rows:
        plain = ["1", "3", "a"] + [str(i) for i in range(200) if i != r.page_id and i not in (1, 3)]
        assert r.related == plain[:8]
    assert len(rows) == 200 and size < 15_000


def test_an_empty_text_has_no_section(spark, tmp_path):
    docs = spark.createDataFrame([(1, ""), (2, None), (3, "one line")], "doc_id long, text string")
    docs.write.parquet(f"file://{tmp_path}/documents.parquet")
    assert [tuple(r) for r in registry.QUERIES["q_sectionize_offline"](spark, f"file://{tmp_path}").collect()] == [(3, 1, "one line", "one-line", "one line", "END_OF_DOC")]
    assert [r.doc_id for r in sections.analysed(docs).collect()] == [3]


def test_a_page_of_two_sections_as_the_sql_reads_it(spark):
    n = spark.createDataFrame([("a.md", " ".join(f"w{i}" for i in range(4100)))], "path string, content string")
    head = lambda **k: pages.read_page(n, n.select("path"), **k).first().page.split("]")[0] + "]"
    assert head() == "[Large page: a.md \u2014 2 sections, showing first 2 most relevant sections]"
    assert head(named=3) == "[Large page: a.md \u2014 2 sections, showing first 3 most relevant sections]"


@pytest.mark.parametrize(("lang", "found"), [("en", 1), ("fr", 0)])
def test_a_page_by_its_path_is_whole_or_no_row(spark, tmp_path, lang, found):
    text = " ".join(f"w{i}" for i in range(5000))
    spark.createDataFrame([(1, text, lang, "s", len(text)), (2, "the other", "en", "s", 9)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"file://{tmp_path}/documents.parquet")
    assert [r.text for r in registry.QUERIES["q_page_by_path"](spark, f"file://{tmp_path}").collect()] == [text] * found


def test_patterns_take_letters_beyond_ascii_whatever_the_case(spark):
    notes = spark.createDataFrame([("a", "x CI\u00d3N\u00d1 y"), ("b", "x ci\u00f3n\u00f1 y"), ("c", "nothing")], "path string, content string")
    stored = trigrams.contents(notes)
    for p in ("ci\u00f3n\u00f1\\s", "CI\u00d3N\u00d1"):
        assert sorted(r.path for r in trigrams.matches(stored, trigrams.grams(stored), p).collect()) == ["a", "b"]
        assert sorted(r.path for r in search.content_matches(notes, p).collect()) == ["a", "b"]


def test_names_that_capitals_do_not_give_back_are_linked(spark, tmp_path):
    html = lambda name, *to: f"<title>{name} x</title>" + "".join(f'<a href="/{t}">' for t in to)
    rows = [(1, "u", html("ie\u00df")), (3, "u", html("other", "ie\u00df", "caf\u00e9")), (5, "u", html("caf\u00e9"))]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"file://{tmp_path}/pages.parquet")
    got = {r.path: r.related for r in registry.QUERIES["q_related_scan"](spark, f"file://{tmp_path}").collect()}
    assert got["ie\u00df.md"] == "other.md" and got["caf\u00e9.md"] == "other.md"
    assert "CAF\u00c9" in adapters.page_notes(spark, f"file://{tmp_path}").where("path = 'other.md'").first().content


def test_many_searches_exchange_no_single_postings(spark):
    notes = spark.createDataFrame([entry(f"c/{i}.md", f"common word{i % 7} t{i}", []) for i in range(600)], NOTE)
    table = postings.blocks(catalog.entries(notes)).localCheckpoint()
    asked = spark.createDataFrame([(q, f"common word{q % 7} q{q}") for q in range(50)], "qid int, query string")
    rows, records, _ = shuffled(spark, postings.search(table, asked))
    assert len(rows) == 500
    assert records < 50 * 600 / 2


def letters(path: str):
    """A tokenizer of single characters; each call leaves a line in a file."""

    class Letters:  # inside, so that it travels by value
        def ends(self, text: str) -> list[int]:
            with open(path, "a") as f:
                f.write("call\n")
            return list(range(1, len(text) + 1))

    return Letters()


def test_a_raw_read_counts_each_page_once(spark, tmp_path):
    calls = tmp_path / "calls"
    rows = spark.createDataFrame([("s", i, "abcdefghij") for i in range(40)], "source string, ord int, text string")
    assert pages.read_raw(rows, 25, letters(str(calls))).first().text == f"abcdefghij\n\nabcdefghij\n\nabcde\n\n{pages.CUT_OFF}"
    assert len(calls.read_text().split()) <= 40 + 3


@pytest.mark.parametrize("use", ["pages", "sections", "clusters"])
def test_batches_of_texts_are_small(spark, use):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, "10000")
    try:
        rows = spark.createDataFrame([(1, "text")], "doc_id int, text string")
        if use == "pages":
            pages.counted(F.col("text"), letters("none"))
        elif use == "sections":
            sections.analysed(rows)
        else:
            consolidate.merged(rows.select(F.lit(1).alias("cluster"), F.lit(1).alias("ord"), F.lit("t").alias("title"), F.lit("k").alias("type"), F.lit("s").alias("summary"), F.array(F.lit("k")).alias("keywords"), F.col("text").alias("content")))
        assert int(spark.conf.get(name)) <= 256
    finally:
        spark.conf.set(name, before)


def test_chunks_are_made_once_for_their_batches(spark, tmp_path):
    """A chunk is cut out of its text for its size and its batch at once; each making leaves a line in a file."""
    path = str(tmp_path / "made")

    @F.udf("string")
    def made(i):
        with open(path, "a") as f:
            f.write("made\n")
        return "word " * (i + 20)

    chunks = spark.range(40).select((F.col("id") % 2).alias("source_id"), F.col("id").cast("int").alias("ord"), F.lit("T").alias("title"), made.asNondeterministic()("id").alias("text"))
    rows = sections.batch_texts(chunks, 1000).collect()
    assert sum(r.chunks for r in rows) == 40
    with open(path) as f:
        assert len(f.read().split()) == 40


def test_markers_are_found_as_spark_finds_them(spark):
    """Whole markers, their first long words, their last one, none; from all kinds of places, and in characters of all widths."""
    rng = random.Random(7)
    words = ["ab", "abc", "caf\u00e9", "\u6c49\u5b57\u6c49", "\U0001f600x\U0001f600", "na", "delta", "q"]
    rows = []
    for _ in range(400):
        text = [rng.choice(words) for _ in range(rng.randrange(60))]
        a = rng.randrange(len(text) + 1)
        mark = text[a : a + rng.randrange(25)]
        if rng.random() < 0.5:
            mark.insert(rng.randrange(len(mark) + 1), rng.choice(["lost", "gone", "x"]))
        rows.append((" ".join(text), " ".join(mark), rng.randrange(120) if rng.random() < 0.5 else 0))
    got = spark.createDataFrame(rows, "norm string, mark string, start int").select("*", T.locate_in(F.col("norm"), F.col("mark"), F.col("start")).alias("place")).collect()
    assert [offsets.located(r.norm, r.mark, r.start) for r in got] == [r.place for r in got]
    assert sum(r.place < 0 for r in got) > 20 and sum(r.place > 0 for r in got) > 100


def test_parts_of_texts_travel_in_small_batches(spark):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, "10000")
    try:
        sections.marker_slices(spark.createDataFrame([(1, "text")], "doc_id int, text string"), "a", "b")
        assert int(spark.conf.get(name)) <= 256
    finally:
        spark.conf.set(name, before)


def test_the_flow_exchanges_no_text_until_notes_meet(spark):
    """Texts of random letters: a note of a document with others goes to them, and each goes to its path; nothing else moves."""
    rng = random.Random(3)

    def text(n):
        return " ".join("".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=9)) for _ in range(n // 10))

    docs = [(i, text(6_000)) for i in range(40)] + [(i, "\n".join(f"{k} Head {text(20)}\n{text(8_000)}" for k in range(1, 5))) for i in range(40, 46)] + [(i, text(30_000)) for i in range(46, 52)]
    size = sum(len(t) for _, t in docs)
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(4).localCheckpoint()
    rows, _, moved = shuffled(spark, SimpleNamespace(collect=lambda: flow.ingested(frame, "2024-01-31", 5_000, 2).notes.collect()))
    assert {r.source for r in rows} == {str(i) for i, _ in docs} and sum(r.members for r in rows) > 40 + 12 * 3
    assert moved < 3 * size


def test_a_rows_chunks_are_packed_as_a_sources(spark):
    rng = random.Random(5)
    rows = [(i, k, f"T{k}", rng.choice("xy\u6c49") * rng.choice([1, 90, 400, 1000, 1001, 1500])) for i in range(30) for k in range(rng.randrange(9))]
    chunks = spark.createDataFrame(rows, "source_id int, ord int, title string, text string")
    plain = sorted((r.source_id, r.batch, r.rendered) for r in sections.batch_texts(chunks, 1000, -1).collect())
    listed = chunks.groupBy("source_id").agg(F.array_sort(F.collect_list(F.struct("ord", "title", F.col("text").alias("chunk")))).alias("parts"))
    texts = listed.select("source_id", F.posexplode(sections.batched(F.col("parts"), 1000)).alias("batch", "rendered"))
    assert sorted((r.source_id, r.batch, r.rendered) for r in texts.collect()) == plain and len(plain) > 50


def test_notes_travel_once_to_their_cluster(spark):
    rng = random.Random(6)
    rows = [(i // 2 if i < 40 else i, i, "t", "concept", "s", ["k"], "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=5_000))) for i in range(100)]
    notes = spark.createDataFrame(rows, "cluster int, ord int, title string, type string, summary string, keywords array<string>, content string").repartition(4).localCheckpoint()
    got, _, moved = shuffled(spark, consolidate.merged(notes))
    assert sorted((r.cluster, r.members) for r in got) == [(i, 2) for i in range(20)] + [(i, 1) for i in range(40, 100)]
    assert {r.cluster: r.content for r in got}[3] == rows[6][6] + "\n\n" + rows[7][6]
    assert moved < 1.2 * 100 * 5_000


def test_short_sources_beside_a_long_one_are_packed_as_the_loop_does(spark, monkeypatch):
    rng = random.Random(8)
    monkeypatch.setattr(sections, "PACK_BLOCK", 3)
    rows = [(f"s{i}", k, "x" * rng.randrange(1, 900)) for i in range(25) for k in range(rng.randrange(1, 4))] + [("long", k, "x" * rng.randrange(1, 4000)) for k in range(60)]
    plain, batch, total, before = {}, 0, 0, None
    for source, k, t in rows:
        batch, total = (0, 0) if source != before else (batch + 1, 0) if total + len(t) > 1000 else (batch, total)
        plain[source, k], total, before = batch, total + len(t), source
    got = sections.packed(spark.createDataFrame(rows, "source_id string, ord int, text string"), 1000, 0).collect()
    assert {(r.source_id, r.ord): r.batch for r in got} == plain and len(got) == len(rows)


def test_batches_of_paged_and_other_documents_are_those_of_their_chunks(spark):
    pages_ = [(d, p, f"Doc {d} Page {p}. " + f"Text{d}x{p} " * 150) for d in (1, 2) for p in range(1, 8)]
    docs = [(d, "\n\n".join(t for e, _, t in pages_ if e == d) + " " * 8000) for d in (1, 2)] + [(3, "short text"), (4, "".join(f"Part {i} of\nthe LONG one.  " for i in range(800)))]
    toc = [(1, 0, 1, "One", 1), (1, 1, 1, "Two", 4), (2, 0, 1, "Uno", 90), (2, 1, 1, "Due", 95)]  # the pages of the second one are not there
    given = (
        spark.createDataFrame(docs, "doc_id long, text string"), sections.by_stride,
        spark.createDataFrame(toc, "doc_id long, ord int, level int, title string, page int"), spark.createDataFrame(pages_, "doc_id long, page_no int, text string"),
    )
    parts = flow.chunks(*given).localCheckpoint()
    assert {r.source_id: r.why for r in parts.where("ord = -1").collect()} == {2: "no section found", 3: "short"}
    texts = sections.batch_texts(parts.where("ord >= 0"), 6000, -1).select("source_id", "batch", "rendered")
    plain = texts.union(parts.where("ord = -1").select("source_id", F.lit(0), "text"))
    rows = flow.batches(given[0], 6000, *given[1:])
    assert sorted(map(tuple, rows.select("source_id", "batch", "rendered").collect())) == sorted(map(tuple, plain.collect()))
    notes = flow.ingested(given[0], "2024-01-31", 6000, 2, toc=given[2], pages=given[3]).notes
    assert {r.source for r in notes.collect()} == {"1", "2", "3", "4"}


def row_groups(folder) -> list:
    """Row groups of the Parquet files below a folder."""
    files = [pq.ParquetFile(f).metadata for f in folder.rglob("*.parquet")]
    return [m.row_group(i) for m in files for i in range(m.num_row_groups)]


def common_name(spark) -> list:
    """Notes of which the first have no backlinks, and a thousand the same thousand."""
    return spark.createDataFrame([entry(f"a/{i:04d}.md", f"0{i}", []) for i in range(400)] + [entry(f"c/{i:04d}.md", "a", ["a"]) for i in range(1000)], NOTE)


def test_a_stored_catalog_is_read_in_few_long_rows(spark, tmp_path, monkeypatch):
    """A million backlinks: a reader's batch is part of a row group, so none of these holds many of them."""
    monkeypatch.setattr(catalog, "GROUP_BYTES", 1 << 16, raising=False)
    catalog.save(catalog.entries(common_name(spark)), f"file://{tmp_path}/c")
    found = {r.path: r.backlinks for r in catalog.load(spark, f"file://{tmp_path}/c").collect()}
    every = [f"c/{i:04d}.md" for i in range(1000)]
    assert len(found) == 1400 and all(found[p] == [q for q in every if q != p] for p in every)
    assert max(c.num_values for g in row_groups(tmp_path) for c in map(g.column, range(g.num_columns))) < 150_000


@pytest.mark.parametrize("linked_by", [catalog.backlinks, catalog.backlinks_within])
def test_writers_look_at_long_rows_in_time(spark, tmp_path, linked_by):
    """Rows of 8,000 characters behind short ones, in groups of 100,000 bytes."""
    names = [*store.CHECKED_ROWS, "parquet.block.size"]
    try:
        for name in names:
            spark.conf.unset(name)
        linked = common_name(spark).select(F.concat(F.lit("some folder/"), "path").alias("page_id"), F.col("title").alias("name"), "links")
        rows = linked_by(linked, lambda b: F.array_join(b, ","))
        spark.conf.set("parquet.block.size", "100000")
        rows.write.option("compression", "none").parquet(f"file://{tmp_path}/out")
        groups = row_groups(tmp_path)
        assert sum(g.num_rows for g in groups) == 1000 and max(g.num_rows for g in groups) <= 24
    finally:
        for name in names:
            spark.conf.unset(name)


def test_an_updated_catalog_is_read_in_few_long_rows(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(catalog, "GROUP_BYTES", 1 << 16, raising=False)
    path, notes = f"file://{tmp_path}/c", common_name(spark)
    catalog.save(catalog.entries(notes.where("title <> 'a'")), path)
    catalog.save(catalog.updated(catalog.load(spark, path), notes.where("title = 'a'")), path)
    assert {len(r.backlinks) for r in catalog.load(spark, path).collect()} == {0, 999}
    assert max(c.num_values for g in row_groups(tmp_path) for c in map(g.column, range(g.num_columns))) < 150_000


CLUSTERED = "cluster int, ord int, title string, type string, summary string, keywords array<string>, content string"


def test_notes_of_a_large_cluster_are_not_held(spark):
    """The offline merger takes notes as they come: of four thousand two are there at once at most, beside the contents."""

    class Note(dict):
        pass

    there, most = weakref.WeakSet(), 0

    def notes():
        nonlocal most
        for i in range(4000):
            note = Note(ord=i, title=f"t{i}", type="k", summary=None, keywords=[f"k{i % 9}"], content=f"text {i % 50}")
            there.add(note)
            most = max(most, len(there))
            yield note

    Note.__hash__ = object.__hash__
    out = consolidate.MergedNotes(["cluster", "title", "type", "summary", "keywords", "content", "members"], pa.int32())
    consolidate.first_and_all_of(7, notes(), out)
    row = out.batch().to_pylist()[0]
    assert row["content"] == "\n\n".join(f"text {i}" for i in range(50)) and row["keywords"] == [f"k{i}" for i in range(6)]
    assert (row["title"], row["members"]) == ("t0", 4000) and most <= 3


def test_notes_merged_as_they_come_are_those_merged_at_once(spark):
    """Clusters of one note and of many, of equal, empty and wide contents, over several batches; the plain merger is called through the protocol."""
    rng = random.Random(11)
    words = ["", "a", "caf\u00e9", "\U0001f600", "a\n\na", "x" * 3000]
    rows = [(rng.choice([0, 0, *range(1, 400)]), i, rng.choice("tuv"), "concept", rng.choice(["s", None]), rng.sample("abcdefgh", rng.randrange(9)), rng.choice(words) + rng.choice(["", str(i % 7)])) for i in range(3000)]
    notes = spark.createDataFrame(rows, CLUSTERED).repartition(3).localCheckpoint()
    plain = {tuple(r[:4]) + (tuple(r.keywords), r.content, r.members) for r in consolidate.merged(notes, lambda text, own: consolidate.first_and_all(text, own)).collect()}
    got = consolidate.merged(notes).collect()
    assert {tuple(r[:4]) + (tuple(r.keywords), r.content, r.members) for r in got} == plain and len(got) == len({r[0] for r in rows}) == len(plain)
    none = spark.createDataFrame([(1, 1, "t", "k", "s", ["a"], None), (2, 1, "t", "k", "s", None, None), (2, 2, "t", "k", "s", ["b"], "x"), (None, 1, "t", "k", "s", ["a"] * 9, "y")], CLUSTERED)
    assert {(r.cluster, tuple(r.keywords), r.content, r.members) for r in consolidate.merged(none).collect()} == {(1, ("a",), None, 1), (2, ("b",), "x", 2), (None, ("a",) * 9, "y", 1)}


def test_a_merger_reads_a_cluster_as_it_is_rendered(spark):
    rng = random.Random(12)
    rows = [(i % 5, rng.randrange(4), rng.choice(["t", "u", None]), "k", "s", rng.choice([["a", "b"], [], ["a", None], None]), rng.choice(["x", "y", None])) for i in range(60)]
    notes = spark.createDataFrame(rows, CLUSTERED)
    got = consolidate.merged(notes, lambda text, own: (text, "", "", [], "")).collect()
    assert {r.cluster: r.title for r in got} == {r.cluster: r.text for r in consolidate.cluster_texts(notes).collect()}
