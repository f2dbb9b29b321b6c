import uuid

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from paperloom.functions import text as tx
from paperloom.functions.geometry import Box
from paperloom.operators import attributes as at
from paperloom.operators import blocks as bk
from paperloom.operators import chunking as ch
from paperloom.operators import layout as ly
from paperloom.operators import maintenance as mt
from paperloom.operators import markdown as md
from paperloom.operators import noise as nz
from paperloom.plans import adapters as ad
from paperloom.plans import queries as bound
from paperloom.sources import files as src
from paperloom.sources import sinks
from paperloom.streaming import ingest
from tests.conftest import SF


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'string' if isinstance(v, (str, type(None))) else 'double'}" for k, v in values.items())).select(column).first()[0]


@pytest.mark.parametrize(("text", "number"), [("29", 29.0), ("1,234.5", 1234.5), ("約33%", 33.0), ("地下5層", 5.0), ("採用順打工法配置3層水平鋼支撐", None), ("", None), (None, None), ("1e3", 1000.0), ("abcd", None)])
def test_to_number(spark, text, number):
    assert one(spark, tx.to_number("t"), t=text) == number


def test_white_space_is_unicode(spark):
    assert one(spark, tx.norm("t"), t="A　b\u00a0C\n") == "abc"
    assert one(spark, tx.utrim("t"), t="　\n x y \u00a0") == "x y"


@pytest.mark.parametrize("name", ["abc|1|2|3", "中文|1|0|0", ""])
def test_uuid5(spark, name):
    assert one(spark, tx.uuid5("t"), t=name) == str(uuid.uuid5(uuid.NAMESPACE_DNS, name))


@pytest.mark.parametrize(("key", "project"), [("a/b/c.md", "b"), ("a/c.md", "a"), ("c.md", "unclassified"), ("a\\b\\c.md", "b")])
def test_project(spark, key, project):
    assert one(spark, tx.project_of("k"), k=key) == project


def test_literal_delimiters(spark):
    rows = spark.createDataFrame([("a.|b.|",)], "t string")
    assert rows.select(tx.split_trimmed("t", ".|")).first()[0] == ["a", "b"]


def test_empty_strings_are_missing(spark):
    assert one(spark, tx.first_filled("a", "b"), a="", b="x") == "x"


@pytest.mark.parametrize(("text", "y0", "noise"), [("3", 95.0, True), (" 3 / 52 ", 95.0, True), ("第3頁", 0.0, True), ("- 3 -", 95.0, True), ("Page 3", 95.0, True), ("3 words", 95.0, False), ("3", 50.0, False), ("12345", 95.0, False)])
def test_page_numbers(spark, text, y0, noise):
    assert one(spark, nz.is_page_number(F.col("t"), F.col("y"), F.col("y") + 4, 100.0), t=text, y=y0) is noise


def test_ghosts_compare_with_what_was_kept(spark):
    rows = spark.createDataFrame([(1, 0, k, "t", 0.0, y) for k, y in enumerate((0.0, 2.5, 5.0))], "doc_id int, page int, span_no int, text string, x0 double, y0 double")
    assert sorted(r.y0 for r in nz.without_ghosts(rows).collect()) == [0.0, 5.0]


@given(st.text("abc", max_size=12), st.text("abc", max_size=12))
def test_indel_ratio(a, b):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
    assert nz.indel_ratio(a, b) == pytest.approx(200.0 * table[-1][-1] / (len(a) + len(b)) if a or b else 100.0)


def test_gap(spark):
    box = lambda *c: Box(*(F.lit(float(x)) for x in c))
    row = spark.range(1).select(box(0, 0, 1, 1).gap(box(4, 5, 6, 6)), box(0, 0, 1, 1).gap(box(0.5, 0.5, 2, 2)), box(0, 0, 1, 1).gap(box(3, 0, 4, 1))).first()
    assert tuple(row) == (5.0, 0.0, 2.0)


def test_breadcrumb(spark):
    lines = ["### a", "x", "##### c", "y", "#### b", "##### d", "### e", "####### no"]
    rows = spark.createDataFrame([(1, 0, k, t) for k, t in enumerate(lines)], "doc_id int, page_pos int, line_no int, text string")
    got = [r[0] for r in ch.with_heading_path(rows, ["doc_id", "page_pos"], ["line_no"]).orderBy("line_no").select(ch.heading_path()).collect()]
    assert got == ["a", "a", "a > c", "a > c", "a > b", "a > b > d", "e", "e"]


def test_lone_headings_become_text(spark):
    lines = ["### a", "#### b", "#### c", "#### d", "text"]
    rows = spark.createDataFrame([(1, 0, 1, k, t) for k, t in enumerate(lines)], "doc_id int, page_pos int, page_num int, line_no int, text string")
    got = [tuple(r) for r in ch.demoted(ch.sections(rows)).orderBy("section_idx").select(ch.heading_path(), "body").collect()]
    assert got == [("a", "b\nc"), ("a > d", "text")]


def test_names_resolve_in_order_and_once(spark):
    known = spark.createDataFrame([("alpha one", 0), ("alpha two", 1)], "project string, pos int")
    mentions = spark.createDataFrame([(1, ["Alpha", "alphaTwo", "alpha"])], "group_id int, names array<string>")
    assert [r.project for r in at.greedily_resolved(mentions, known).orderBy("idx").collect()] == ["alpha one", "alpha two", None]


def test_lookup_of_an_unknown_attribute_is_empty(spark):
    table = spark.createDataFrame([("P1", "size", "3", 3.0)], "project string, attr string, value string, number double")
    assert at.looked_up(table, ["P1"], ["weight"]).count() == 0
    assert at.looked_up(table, ["P1"], []).count() == 1


def test_upsert_twice_is_once(spark):
    base, delta = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string"), spark.createDataFrame([(2, "c"), (3, "d")], "k int, v string")
    once = mt.upserted(base, delta, "k")
    assert sorted(map(tuple, mt.upserted(once, delta, "k").collect())) == sorted(map(tuple, once.collect())) == [(1, "a"), (2, "c"), (3, "d")]


def test_heading_levels(spark):
    rows = spark.createDataFrame([(1, k, h) for k, h in enumerate((30.0, 29.5, 20.0, 12.0, 11.8, 12.1, 8.0))], "doc_id int, pos int, height double")
    assert [r.level for r in ly.heading_levels(rows).orderBy("pos").collect()] == [1, 1, 2, 3, 3, 3, 4]


def test_dehyphenation(spark):
    rows = spark.createDataFrame([(1, 0, 0, "exam-"), (1, 0, 1, "ple of Anti-"), (1, 0, 2, "Art")], "doc_id int, page int, line_no int, text string")
    assert ly.dehyphenated(rows).first().text == "example of Anti- Art"


def test_descendants_stop_at_removed_blocks(spark):
    rows = spark.createDataFrame([(1, "p", None, "page", False), (1, "g", "p", "group", True), (1, "a", "g", "text", False), (1, "b", "p", "text", False)], "doc_id int, block_id string, parent_id string, kind string, removed boolean")
    assert sorted(map(tuple, ly.descendants(rows, ("text",)).filter("ancestor = 'p'").collect())) == [(1, "b", "p")]


def test_code_indentation(spark):
    rows = spark.createDataFrame([(1, 0, 0, "if x:", 0.0, 50.0), (1, 0, 1, "yy", 40.0, 60.0)], "doc_id int, page int, line_no int, text string, x0 double, x1 double")
    assert ly.code_lines(rows).first().text == "if x:\n    yy"


def test_page_ranges(spark):
    assert one(spark, F.array_join(src.page_numbers("t"), ","), t="0, 5-7,6") == "0,5,6,7"


def test_readers(spark, tmp_path):
    folder = tmp_path / "a" / "b"
    folder.mkdir(parents=True)
    (folder / "x.md").write_text("---\ntitle: 'T: x'\n---\n## body\n", encoding="utf-8")
    (tmp_path / "t.csv").write_bytes("﻿name\tvalue\n建案\t3\n\t\n".encode())
    row = src.markdown(spark, str(tmp_path)).first()
    assert (row.stem, row.text, row.front_matter) == ("x", "## body\n", {"title": "T: x"})
    assert [tuple(r) for r in src.delimited(spark, str(tmp_path / "t.csv")).collect()] == [("建案", "3")]
    assert [r.file_key for r in src.inventory(spark, str(tmp_path), "*.md").collect()] == ["a/b/x.md"]


def test_cp950_table(spark, tmp_path):
    (tmp_path / "t.csv").write_bytes("名稱,值\n建案,3\n".encode("cp950"))
    assert [tuple(r) for r in src.delimited(spark, str(tmp_path / "t.csv")).collect()] == [("建案", "3")]


def test_sidecar_defaults(spark):
    rows = spark.createDataFrame([('{"review_status": "done"}',), ("broken",)], "json string")
    assert sorted(r.review_status for r in src.sidecars(rows).collect()) == ["ingested", "unprocessed"]


def test_stream_keeps_the_newest_row_of_a_key(spark, tmp_path):
    for k in range(3):
        spark.createDataFrame([(k, f"t{k}", k), (0, f"v{k}", 10 - k), (0, "old", -1), (None, "n", k)], "doc_id long, text string, at int").coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    stream = ingest.document_stream(spark, f"{tmp_path}/in/*", "doc_id long, text string, at int", 1)
    query = ingest.upsert_stream(stream, lambda b: b.withColumn("n", F.length("text")), "doc_id", ["at"], f"{tmp_path}/table", f"{tmp_path}/check", 4)
    query.awaitTermination(120)
    assert sorted((r.doc_id or -1, r.text) for r in ingest.current_table(spark, f"{tmp_path}/table").collect()) == [(-1, "n"), (-1, "v0"), (1, "t1"), (2, "t2")]
    assert len({p.parent.name for p in (tmp_path / "table").glob("bucket=*/version=*")}) == len(list((tmp_path / "table").glob("bucket=*/version=*")))


def test_bullets(spark):
    lines = {"■ a": "a", "  - ● b": "  b", "* **• c**": "c", "- plain": "- plain", "**bold**": "**bold**", "●. d": "d", "• ": None, " - ** ": None, "": "", "   ": "   ", "\t◆◆ 、e": "\te", "- ** ● x** y": "x** y"}
    rows = spark.createDataFrame([(k,) for k in lines], "t string")
    assert {r.t: r.out for r in rows.select("t", md.without_bullet("t").alias("out")).collect()} == lines


def test_deep_trees(spark):
    rows = spark.createDataFrame([(1, str(k), str(k - 1) if k else None, "text" if k == 30 else "group", False) for k in range(31)], "doc_id int, block_id string, parent_id string, kind string, removed boolean")
    assert {r.ancestor for r in ly.descendants(rows, ("text",)).collect()} == {str(k) for k in range(30)}


def test_fuzzy_queries_against_brute_force(spark):
    """What SQL cannot say: Indel ratios of near lines and running edges, and the best cut of heading heights."""
    from itertools import combinations, groupby

    def ratio(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            before = 0
            for j, y in enumerate(b):
                before, row[j + 1] = row[j + 1], before + 1 if x == y else max(row[j + 1], row[j])
        return 200.0 * row[-1] / (len(a) + len(b)) if a or b else 100.0

    found = bound.QUERIES["near_copy_indel"](spark, SF).collect()
    small = [r for r in found if len(r.a) * len(r.b) < 10**4]
    assert found and all(r.ratio == round(ratio(r.a, r.b), 6) > 90 for r in small)

    edges = [tuple(r) for r in nz.edge_blocks(ad.lines(spark, SF)).select("doc_id", "page", "edge", "text").collect()]
    common = {(r.doc_id, r.edge): set() for r in nz.common_edges(nz.edge_blocks(ad.lines(spark, SF))).collect()}
    for r in nz.common_edges(nz.edge_blocks(ad.lines(spark, SF))).collect():
        common[r.doc_id, r.edge].add(r.text)
    want = {(d, p, e) for d, p, e, t in edges if any(t == c or ratio(t, c) > 90 for c in common.get((d, e), ()))}
    assert {tuple(r) for r in nz.ignored_edges(nz.edge_blocks(ad.lines(spark, SF))).select("doc_id", "page", "edge").collect()} == want

    rows = [(1, k, h) for k, h in enumerate((30.0, 29.0, 21.5, 20.0, 12.0, 11.8, 12.1, 8.0, 7.5, 30.0))] + [(2, k, float(h)) for k, h in enumerate((5, 9, 9, 14))]
    got = {(r.doc_id, r.pos): r.level for r in ly.heading_levels(spark.createDataFrame(rows, "doc_id int, pos int, height double")).collect()}
    for doc in (1, 2):
        heights = sorted((h for d, _, h in rows if d == doc), reverse=True)
        spread = lambda own: sum((x - sum(own) / len(own)) ** 2 for x in own) if own else 1e9
        distinct = sorted(set(heights), reverse=True)
        k = min(4, len(distinct))
        best = min((sum(spread([x for x in heights if a >= x > b]) for a, b in zip((1e9, *cut), (*cut, -1.0), strict=True)), cut) for cut in combinations(distinct[1:], k - 1))
        level = lambda h, cut=best[1]: 1 + sum(h <= c for c in cut)
        assert {p: got[doc, p] for d, p, _ in rows if d == doc} == {p: level(h) for d, p, h in rows if d == doc}


def test_html_cells_place_spans(spark):
    page = "<p>x</p><table><tr><th rowspan=2>a</th><th colspan='2'>b &amp; <b>c</b></th></tr><tr><td>d</td><td>e<br>f</td></tr><tr><td colspan=9>g</td></tr></table><table><tr><td>no</td></tr></table>"
    got = [tuple(r)[1:] for r in bk.html_cells(spark.createDataFrame([(1, page), (2, "no table"), (3, None)], "table_id int, html string")).orderBy("row_id", "col_id").collect()]
    assert got == [(0, 0, 2, 1, True, "a"), (0, 1, 1, 2, True, "b & c"), (1, 1, 1, 1, False, "d"), (1, 2, 1, 1, False, "e\nf"), (2, 0, 1, 9, False, "g")]


def test_tables_are_swapped_in_whole(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    sinks.swapped_in(spark.range(3), path)
    sinks.swapped_in(spark.read.parquet(path).filter("id > 0"), path)
    assert sorted(r.id for r in spark.read.parquet(path).collect()) == [1, 2] and [p.name for p in tmp_path.iterdir()] == ["t"]
    assert sinks.ensure_table(spark.range(1).withColumn("k", F.lit("a")), f"{path}2", ["k"]) and not sinks.ensure_table(spark.range(1), f"{path}2", [])
    sinks.save_matrix(spark.createDataFrame([(1, ["a", 'b"c']), (2, [" ", None]), (3, ["d"])], "row_no int, cells array<string>"), f"{path}3")
    text = b"".join(p.read_bytes() for p in sorted((tmp_path / "t3").glob("part-*")))
    assert text.decode() == '\ufeffa,"b""c"\r\nd,\r\n'


def test_typed_delimiters():
    assert tx.delimiter_meant(r"\n\n") == "\n\n" and tx.delimiter_meant(r"a\tb\x") == "a\tb\\x" and tx.delimiter_meant("") == ""


def test_trackers_refuse_shared_keys(spark):
    rows = spark.createDataFrame([("a/x.md",), ("b/x.md",)], "file_key string")
    with pytest.raises(ValueError):
        mt.tracker_entries(rows, F.lit("x"))
    assert mt.tracker_entries(rows, F.lit("x"), forced=True).first().file_key == "a/x.md"


def test_names_without_a_match(spark):
    table = spark.createDataFrame([("Unit price",), ("size",)], "attr string")
    assert at.unmatched_attributes(table, ["price", "colour", "colour", "SIZE"]) == ["colour"]


def test_windowed_stream(spark, tmp_path):
    events = spark.readStream.schema("event_id long, ts timestamp, user_id long, event_type string, value double, props string").parquet("/root/testdata/sf0.001/events.parquet*")
    query = ingest.windowed_counts(events, "ts", "event_type", "1 day").writeStream.outputMode("complete").format("memory").queryName("counts").start()
    query.processAllAvailable()
    query.stop()
    assert spark.sql("SELECT sum(n) FROM counts").first()[0] == spark.read.parquet("/root/testdata/sf0.001/events.parquet").count()


@pytest.mark.parametrize(("page", "markdown"), [
    ("<h2> A </h2><p>x <b>y</b> <i>z</i></p><ul><li>1</li><li>2</li></ul>", "## A\n\nx **y** *z*\n\n- 1\n- 2"),
    ("costs $5 &amp; <math>a$b</math> or <math display='block'>c^2</math>", "costs \\$5 & $a$b$ or \n\n$$c^2$$"),
    ("<table><tr><th colspan=2>a|b</th></tr><tr><td>c</td><td>d</td></tr></table>after", "| a\\|b |  |\n| --- | --- |\n| c | d |\n\nafter"),
    ("<div class='page' data-page-id='3'><p>p</p></div><a href='u'>l</a><hr>", "{3}" + "-" * 48 + "\n\np\n\n[l](u)\n\n---"),
    ("<script>x</script>&lt;kept&gt;", "<kept>"), ("", ""),
])
def test_html_markdown(page, markdown):
    assert src.markdown_of(page) == markdown


def test_every_page_becomes_markdown(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    got = {r.page_id: r.markdown for r in bound.QUERIES["html_markdown"](spark, SF).collect()}
    assert got == {r.page_id: src.markdown_of(r.html or "") for r in pages.collect()}


def test_readers_by_content(spark):
    rows = [("a.docx", b"PK\x03\x04", "docx"), ("a.bin", b"PK\x03\x04", "pdf"), ("a.ppt", b"\xd0\xcf\x11\xe0", "pptx"), ("a", b" \n<!DOCTYPE HTML>", "html"), ("a.pdf", b"\xef\xbb\xbf<html lang=x>", "html"), ("a.png", b"%PDF-1", "pdf"), ("a.epub", b"", "epub")]
    table = spark.createDataFrame(rows, "path string, head binary, want string")
    assert [r.path for r in table.filter(src.reader_of("path", F.col("head")) != F.col("want")).collect()] == []


def test_last_good_table(spark):
    last = spark.range(2)
    assert src.loaded_or_last(lambda: spark.read.parquet("/tmp/there/is/no/such/folder"), last)[0] is last
    assert src.loaded_or_last(lambda: spark.range(0), last)[0].count() == 0


def test_heading_levels_across_batches(spark):
    """Documents that reach over Arrow batches keep one grouping; no group of Pandas rows is made for each document."""
    rows = [(d if d else None, p, float((p * 7 + (d or 0) % 3) % 11)) for d in range(40) for p in range(1 + d * 3 % 17)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        frame = ly.heading_levels(spark.createDataFrame(rows, "doc_id int, pos int, height double"))
        got = {(r.doc_id, r.pos): r.level for r in frame.collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(got) == len(rows) and "FlatMapGroups" not in frame._jdf.queryExecution().executedPlan().toString()
    for d in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == d]
        alone = {(r.doc_id, r.pos): r.level for r in ly.heading_levels(spark.createDataFrame(own, "doc_id int, pos int, height double")).collect()} if d in (None, 5, 38) else {}
        assert alone.items() <= got.items()


def test_matrix_rows_say_what_they_lack(spark):
    rows = spark.createDataFrame([(1, ["a", "b", "c"]), (2, [" ", None]), (3, ["d"])], "row_no int, cells array<string>")
    assert sorted((r.row_no, r.cells, r.blanks) for r in sinks.matrix_rows(rows).collect()) == [(1, ["a", "b", "c"], 0), (3, ["d"], 2)]
    assert sorted((r.row_no, r.cells) for r in sinks.matrix(rows).collect()) == [(1, ["a", "b", "c"]), (3, ["d", "", ""])]
