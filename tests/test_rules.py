"""Worked examples of rules whose SQL could repeat a fault."""

import random

import pytest
from pyspark.sql import functions as F

from paperloom.functions import text as tx
from paperloom.operators import blocks as bk
from paperloom.operators import layout as ly
from paperloom.operators import shares
from paperloom.plans import queries
from tests.conftest import SF


def one(spark, text, column):
    return spark.createDataFrame([(text,)], "t string").select(column.alias("x")).first().x


@pytest.mark.parametrize(
    ("text", "bad"),
    [
        (None, True), ("", True), ("name" + " " * 40 + "value", False), ("a\tb" + "\n" * 9, False), ("a b c d", False), (" \n \n", True), ("\n\n\n", True),
        (" a ", False), ("-- ## -- a", True), ("ok " + "�" * 6, True), ("letters and more letters here " + "�" * 7, True), ("letters and more letters here " + "�" * 6, False),
        ("word " * 60 + "�" * 8, False), ("中文 字", False), ("　 ", True), ("\r\r\r", True),
    ],
)
def test_text_quality(spark, text, bad):
    """Runs of white space count once; letters and digits are held against what is neither blank nor line break."""
    assert one(spark, text, tx.quality_issue("t")) is bad


@pytest.mark.parametrize(
    ("text", "paths", "rest"),
    [
        ("![a](img (1).png)", ["img (1).png"], ""),
        ("x\n  ![a](p/q.png)  \ny", ["p/q.png"], "x\ny"),
        ("see ![a](b (c).jpg) \nend", ["b (c).jpg"], "see \nend"),
        ("![a](b.jpg) tail", [], "tail"),
        ("in line ![a](b.jpg) tail", [], "in line ![a](b.jpg) tail"),
        ("![a]](b.jpg)", [], "![a]](b.jpg)"),
        ("a\n\n![x](1.png)\n\n\nb", ["1.png"], "a\n\nb"),
        ("![x]()", [], "![x]()"),
    ],
)
def test_image_references(spark, text, paths, rest):
    assert one(spark, text, tx.image_paths("t")) == paths
    assert one(spark, text, tx.strip_image_refs("t")) == rest


def test_places_of_image_references(spark):
    text = "😀 ![a](b (c).jpg) \n![](d.png)"
    got = one(spark, text, tx.image_places("t"))
    assert [(r.path, text[r["at"] : r["at"] + r["size"]]) for r in got] == [("b (c).jpg", "![a](b (c).jpg) "), ("d.png", "![](d.png)")]



def test_flat_tables_are_read_as_by_the_parser(monkeypatch):
    """Tables without spans over rows are cut into cells by a pattern; the parser gives the same cells."""
    rng = random.Random(3)
    pages = ["<table><tbody></tbody></table>", "<table><tbody><tr></tr><tr><td>a</td></tr></tbody></table>", "<table><tbody><tr><td>a</th></tr></tbody></table>", "no table"]
    for _ in range(300):
        cell = lambda: (lambda t, n: f"<t{t}{n}>{rng.choice(['', ' a ', 'x' * 5, '1\n2', 'b>c', 'ü'])}</t{t}>")(rng.choice("dh"), rng.choice(["", "", ' colspan="0"', ' colspan="2"', ' colspan="3"']))
        pages.append("<table><tbody>" + "".join("<tr>" + "".join(cell() for _ in range(rng.randrange(5))) + "</tr>" for _ in range(rng.randrange(5))) + "</tbody></table>")
    flat = [bk.flat_cells(page) for page in pages]
    assert flat[2] is None and flat[3] is None and sum(cells is not None for cells in flat) == len(pages) - 2
    assert all(bk.flat_cells(p) is None for p in ('<table><tbody><tr><td rowspan="2">a</td></tr></tbody></table>', "<table><tbody><tr><td>a&amp;b</td></tr></tbody></table>"))
    monkeypatch.setattr(bk, "flat_cells", lambda page: None)
    assert all(cells is None or cells == bk.placed_cells(page) for page, cells in zip(pages, flat, strict=True))


def test_raw_text_is_the_same_of_rows_and_of_arrays(spark):
    rng = random.Random(4)
    rows = [(1, k % 3, k % 2, line, span, rng.choice(["a", " b", "", None])) for k in range(6) for line in (1, 2, None) for span in rng.sample(range(9), 4)]
    spans = spark.createDataFrame(rows, "doc_id long, page int, block_no int, line_no int, span_no int, text string")
    arrays = spans.groupBy("doc_id", "page", "block_no", "line_no").agg(F.collect_list(F.struct("span_no", "text")).alias("spans"))
    want = {}
    for d, p, b, line, _, t in sorted(rows, key=lambda r: (r[:3], r[3] is not None, r[3] or 0, r[4])):
        want.setdefault((d, p, b), {}).setdefault(line, []).append(t or "")
    want = {k: "".join("".join(v) + "\n" for v in lines.values()) for k, lines in want.items()}
    for given in (spans, arrays):
        assert {(r.doc_id, r.page, r.block_no): r.text for r in ly.raw_text(given).collect()} == want


def test_cells_come_in_shares(spark, monkeypatch):
    monkeypatch.setattr(shares, "ROWS", 500)
    assert queries._cells(spark, SF).rdd.getNumPartitions() >= 12
