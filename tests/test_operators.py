"""DataFrame operators against DuckDB and by round trip."""

import os

import duckdb
import pandas as pd
import pytest

from pyspark.sql import Window
from pyspark.sql import functions as F

from leafmill.functions import assemble
from leafmill.operators import bitmap, documents, render
from leafmill.plans.queries import ORACLES, QUERIES
from leafmill.sources import read_files, shared_checkpoints, write_files
from leafmill.streaming import stream_page_text

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.execute(f"create view {f.removesuffix('.parquet')} as select * from read_parquet('{SF}/{f}')")
    return c


def rows_of(frame):
    frame = frame[sorted(frame.columns)].astype(object)
    return list(frame.columns), sorted(repr([None if pd.isna(x) else int(x) if isinstance(x, float) and x == int(x) else x for x in r]) for r in frame.values.tolist())


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_equals_oracle(spark, con, name):
    assert rows_of(QUERIES[name](spark, SF).toPandas()) == rows_of(con.execute(ORACLES[name]).df())


@pytest.fixture
def files(spark):
    return documents.create(spark.createDataFrame([(1, "one\ntwo"), (2, ""), (3, None)], "doc_id long, text string"))


def test_pages_and_text(spark, files):
    rows = {(r.doc_id, r.page_no): r.text for r in documents.pdf_page_text(files).collect()}
    assert rows == {(1, 1): "one", (1, 2): "two", (2, 1): "", (3, 1): ""}
    assert {r.doc_id: r.text for r in documents.document_text(documents.pdf_page_text(files)).collect()} == {1: "one\ntwo", 2: "", 3: ""}
    page = documents.pdf_pages(files).where("doc_id = 1").orderBy("page_no").collect()
    assert [list(p.mediabox) for p in page] == [[0, 0, 612, 792]] * 2


def test_bad_files_do_not_fail(spark):
    bad = spark.createDataFrame([(1, bytearray(b"nothing")), (2, None)], "doc_id long, content binary")
    assert [r.error for r in documents.pdf_documents(bad).orderBy("doc_id").collect()] == ["no objects", "no objects"]
    assert documents.pdf_page_text(bad).count() == 0
    assert documents.page_counts(documents.pdf_pages(bad), bad).where("n_pages = 0").count() == 2


def test_xref_and_decoding(spark, files):
    xref = documents.pdf_xref(files.union(files))
    assert documents.newest(xref).groupBy("doc_id", "obj").count().where("count > 1").count() == 0
    objects = documents.pdf_objects(files).where("stream is not null and doc_id = 1")
    out = objects.select(documents.decoded(objects["stream"], objects["filters"]).alias("d")).collect()
    assert all(b"Tj" in bytes(r.d) for r in out)
    assert len(out) == 2


def test_reachable_on_a_cycle(spark):
    shared_checkpoints(spark)
    refs = spark.createDataFrame([(1, 1, 2), (1, 2, 3), (1, 3, 1), (1, 9, 1), (2, 1, 5)], "doc_id long, src_obj long, dst_obj long")
    start = spark.createDataFrame([(1, 1)], "doc_id long, obj long")
    assert {r.obj for r in documents.reachable(refs, start).collect()} == {1, 2, 3}


def test_bitmaps(spark):
    pixels = spark.createDataFrame([(0, c, bool(b)) for c, b in enumerate([1, 1, 1, 0, 0])] + [(1, c, c % 2 == 0) for c in range(8)], "line long, col long, bit boolean")
    packed = bitmap.pack(pixels)
    assert {(r.line, r.place): r.byte for r in packed.collect()} == {(0, 0): 0b11100000, (1, 0): 0b10101010}
    back = bitmap.unpack(packed.where("line = 0"), 5)
    assert sorted((r.col, r.bit) for r in back.collect()) == [(0, True), (1, True), (2, True), (3, False), (4, False)]


def test_wrapping_and_cells():
    assert render.wrap_text("aa bb cc", 2510) == ["aa bb", "cc"]
    assert render.wrap_text("aaaaaa", 1200) == ["aa", "aa", "aa"]
    assert render.wrap_text("", 100) == [""]
    c = render.Canvas()
    c.add_page()
    for i in range(60):
        c.cell(0, 10, f"row {i} of {{nb}}", link="https://example.com" if i == 0 else "")
    from leafmill.functions.objects import File
    from leafmill.functions.text import page_text

    f = File(c.output({"Title": "t"}))
    texts = [page_text(f, p, i) for _, p, i in f.pages()]
    assert len(texts) == 3
    assert texts[0].startswith("row 0 of 3")
    assert next(f.pages())[1]["Annots"][0]["A"]["URI"] == b"https://example.com"


def test_files_and_stream_equal_batch(spark, files, tmp_path):
    from pyspark.sql import functions as F

    named = files.withColumn("name", F.concat("doc_id", F.lit(".pdf")))
    assert write_files(named, f"file://{tmp_path}/in", "name").count() == 3
    batch = documents.pdf_page_text(read_files(spark, f"{tmp_path}/in"))
    q = stream_page_text(spark, f"{tmp_path}/in").writeStream.format("memory").queryName("pages").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(map(tuple, spark.sql("select * from pages").collect())) == sorted(map(tuple, batch.collect()))
    assert batch.count() == 4


#: Spaces at both ends, empty lines, escapes, and what looks like an operator.
ODD = [" lead", "trail ", "a\n b \nc", "", "\n", "a\n\nb", "\t tab\t", "a\r\nb", "back\\nslash \\101 \\\\ (x) ) (", "x\\", "\x0bv\x0c", "(a) Tj (b) Tj T*", "p1\np2\np3\np4\np5 \n p6\n ", "[(a)] TJ /F2 9 Tf Td", " ", "é \n ü", "plain\nlines"]
TEXT_QUERIES = [
    "appended_pages", "doc_text_concat", "doc_text_empty", "last_pages_text", "merge_page_order", "page_subset_text", "page_tree_walk", "pages_and_chars", "split_pages", "updated_pages", "unicode_roundtrip",
    "bad_files_text", "one_page_text", "page_range_text", "text_operators",
]


@pytest.fixture(scope="module")
def odd(tmp_path_factory):
    path = tmp_path_factory.mktemp("odd")
    texts = [(i, t) for i, t in enumerate(t for t in ODD for _ in range(3))]
    pd.DataFrame(texts, columns=["doc_id", "text"]).to_parquet(path / "documents.parquet")
    c = duckdb.connect()
    c.execute(f"create view documents as select * from read_parquet('{path}/documents.parquet')")
    return str(path), c


@pytest.mark.parametrize("name", TEXT_QUERIES)
def test_texts_come_back_as_they_are(spark, odd, name):
    assert rows_of(QUERIES[name](spark, odd[0]).toPandas()) == rows_of(odd[1].execute(ORACLES[name]).df())


def updated_files(spark):
    sound = assemble.text_document([[f"line {i}"] for i in range(9)])
    twice = assemble.updated(assemble.updated(sound, {5: {"A": 1}, 7: {"A": 1}, 8: {"A": 1}}), {7: {"A": 2}, 40: {"A": 2}})
    return spark.createDataFrame([(1, sound), (2, twice), (3, b""), (4, sound[: sound.rindex(b"xref\n0")])], "doc_id long, content binary")


def test_newest_entries_within_the_scan(spark):
    """the entries that count are those that the join of all of them gives."""
    files = updated_files(spark)
    within = documents.pdf_xref(files, newest_only=True)
    assert sorted(within.collect()) == sorted(documents.newest(documents.pdf_xref(files)).collect())
    assert within.where("doc_id = 2 and obj = 7").first().section_no == 0


def test_runs_of_sections_within_the_scan(spark):
    """the runs are those that a window over all entries gives."""
    files = updated_files(spark)
    w = Window.partitionBy("doc_id", "section_no").orderBy("obj")
    runs = documents.pdf_xref(files).withColumn("run", F.col("obj") - F.row_number().over(w))
    runs = runs.groupBy("doc_id", "section_no", "run").agg(F.min("obj").alias("first"), F.count("*").alias("n")).drop("run")
    assert sorted(documents.pdf_xref_runs(files).collect()) == sorted(runs.collect())
    assert [tuple(r)[2:] for r in documents.pdf_xref_runs(files).where("doc_id = 2 and section_no = 1").collect()] == [(5, 1), (7, 2)]


def test_operators_are_numbered_within_the_scan(spark):
    """over all streams of a page, in the order of streams and places."""
    w = Window.partitionBy("doc_id", "page_no").orderBy("stream_no", "pos")
    pages = [(b"BT /F1 9 Tf (a) Tj (b) Tj ET", {}), (b"BT ET", {}), (b"BT (c) Tj ET", {})]
    files = spark.createDataFrame([(1, assemble.tree_document(pages, {})), (2, b"")], "doc_id long, content binary")
    for exact in (False, True):
        ops = documents.pdf_text_ops(files, exact=exact).withColumn("n", F.row_number().over(w)).collect()
        assert [(r.page_no, r.op_no) for r in ops] == [(1, 1), (1, 2), (3, 1)] and all(r.n == r.op_no for r in ops)


@pytest.mark.parametrize("name", ["xref_newest_wins", "xref_subsections", "active_font"])
def test_rows_of_files_are_not_sorted(spark, name):
    """what a file alone tells is told in its scan, so rows are not dealt out and sorted for it."""
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "Sort" not in plan


def test_objects_are_cut_down_before_they_are_sorted(spark):
    """groups of dictionary_entries sort what counts of each object, not whole values and streams."""
    plan = QUERIES["dictionary_entries"](spark, SF)._jdf.queryExecution().sparkPlan().toString()
    groups = [line for line in plan.splitlines() if "Aggregate" in line]
    assert groups and not any("value#" in line or "stream#" in line for line in groups)
