"""Spatial joins in tiles: a page's boxes are dealt out to a grid of cells, and only boxes of a cell are compared.

Sides are ``doc_id, page`` and boxes ``a_id, a_x0..a_y1`` and ``b_id, b_x0..b_y1`` (see ``layout.side``). A page with few boxes is
one cell. Boxes with a null corner meet nothing and are nearest to nothing.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperloom.functions.geometry import Box

PAGE = ["doc_id", "page"]
#: Boxes that a cell has on average, and most cells along a side of a page.
IN_CELL, MOST = 16, 64


def corners(box: Box) -> list[Column]:
    return [box.x0.alias("x0"), box.y0.alias("y0"), box.x1.alias("x1"), box.y1.alias("y1")]


def measured(each: Callable[[Column], Column]) -> list[Column]:
    """A page's cells along a side and its corners; ``each`` makes an aggregate of a page of its argument."""
    n = F.least(F.lit(MOST), F.greatest(F.lit(1), F.ceil(F.sqrt(each(F.count("*")) / IN_CELL)).cast("int")))
    near, far = (lambda c: each(F.min(F.least(f"{c}0", f"{c}1")))), (lambda c: each(F.max(F.greatest(f"{c}0", f"{c}1"))))
    return [n.alias("g_n"), near("x").alias("g_x"), near("y").alias("g_y"), far("x").alias("far_x"), far("y").alias("far_y")]


def sized(pages: DataFrame) -> DataFrame:
    size = lambda near, far: F.greatest((F.col(far) - F.col(near)) / F.col("g_n"), F.lit(1e-9))
    return pages.withColumn("g_w", size("g_x", "far_x")).withColumn("g_h", size("g_y", "far_y")).drop("far_x", "far_y")


def grid(a: DataFrame, b: DataFrame) -> DataFrame:
    """``doc_id, page, g_n, g_x, g_y, g_w, g_h``: each page's cells along a side, corner, and size of cells."""
    boxes = a.select(*PAGE, *corners(Box.of("a_"))).unionAll(b.select(*PAGE, *corners(Box.of("b_"))))
    return sized(boxes.groupBy(*PAGE).agg(*measured(lambda c: c)))


def on_grid(a: DataFrame, b: DataFrame) -> DataFrame:
    """``doc_id, page, a, b, x0..y1`` with the grid of their page: the rows of both sides, each in its own column, the other
    null. One window over the pages tells the grid, so no side is joined to it."""
    own = lambda rows: F.struct(*(c for c in rows.columns if c not in PAGE))
    kind = lambda rows: rows.select(own(rows).alias("own")).schema["own"].dataType
    left = a.select(*PAGE, own(a).alias("a"), F.lit(None).cast(kind(b)).alias("b"), *corners(Box.of("a_")))
    right = b.select(*PAGE, F.lit(None).cast(kind(a)).alias("a"), own(b).alias("b"), *corners(Box.of("b_")))
    page = Window.partitionBy(*PAGE)
    return sized(left.unionAll(right).select("*", *measured(lambda c: c.over(page))))


def beside(dealt: DataFrame) -> DataFrame:
    """The rows ``a`` of each cell with ``others``, the ``b`` of the cell."""
    in_cell = Window.partitionBy(*PAGE, "cell_x", "cell_y")
    return dealt.withColumn("others", F.collect_list("b").over(in_cell)).filter("a IS NOT NULL").drop("b")


def cell(c: Column, start: str, size: str) -> Column:
    return F.least(F.col("g_n") - 1, F.greatest(F.lit(0), F.floor((c - F.col(start)) / F.col(size)).cast("int")))


def spread(rows: DataFrame, x: tuple[Column, Column], y: tuple[Column, Column]) -> DataFrame:
    """Rows once for each cell from the first to the last in both directions."""
    across = rows.withColumn("cell_x", F.explode(F.sequence(*x)))
    return across.withColumn("cell_y", F.explode(F.sequence(*y)))


def meeting_pairs(a: DataFrame, b: DataFrame) -> DataFrame:
    """The pairs of boxes of a page that overlap, each once: in the cell where their common part begins."""
    a, b = (rows.dropna(subset=PAGE) for rows in (a, b))
    dealt = spread(on_grid(a, b), (cell(F.col("x0"), "g_x", "g_w"), cell(F.col("x1"), "g_x", "g_w")), (cell(F.col("y0"), "g_y", "g_h"), cell(F.col("y1"), "g_y", "g_h")))
    cells = ["cell_x", "cell_y", "g_x", "g_y", "g_w", "g_h", "g_n"]
    pairs = beside(dealt).select(*PAGE, *cells, "a.*", F.inline("others")).filter(Box.of("a_").meets(Box.of("b_")))
    here = (F.col("cell_x") == cell(F.greatest("a_x0", "b_x0"), "g_x", "g_w")) & (F.col("cell_y") == cell(F.greatest("a_y0", "b_y0"), "g_y", "g_h"))
    return pairs.filter(here).drop(*cells)


def nearest(a: DataFrame, b: DataFrame, far: Callable[[Box, Box], Column], least: Callable[[Column, Column], Column], point: Callable[[Box], tuple[Column, Column]] = lambda box: box.center) -> DataFrame:
    """``doc_id, page, a_id, b_id, far``: for each box of ``a`` the ``b`` with the least ``far``, of equal ones the first; null
    where there is none.

    ``far`` grows with the distance of the boxes' ``point``, and ``least(width, height)`` is the least it can be for points that
    are that far apart in one direction. A box is first held against those of its own and the neighbouring cells; if what
    it finds is nearer than anything else can be, that is it. The others, which have nothing around them, are held
    against all boxes of their page. The numbers ``a_id`` are unique in a page.
    """
    b = b.dropna(subset=[*PAGE, *(f"b_{c}" for c in ("x0", "y0", "x1", "y1"))])
    rows = on_grid(a, b)
    x, y = point(Box.of())
    at_x, at_y, last = cell(x, "g_x", "g_w"), cell(y, "g_y", "g_h"), F.col("g_n") - 1
    own = F.col("a").isNotNull()
    reach = lambda at: (F.when(own, F.greatest(F.lit(0), at - 1)).otherwise(at), F.when(own, F.least(last, at + 1)).otherwise(at))
    whole = (at_x <= 1) & (at_x >= last - 1) & (at_y <= 1) & (at_y >= last - 1)
    bound = F.when(~whole, least(F.col("g_w"), F.col("g_h")) * (1 - 1e-9))
    told = reduce(Column.__and__, [F.col(c).isNotNull() for c in (*PAGE, "x0", "y0", "x1", "y1")])
    of = lambda one, p: Box(*(one[f"{p}{c}"] for c in ("x0", "y0", "x1", "y1")))
    held = lambda other: F.struct(far(of(F.col("a"), "a_"), of(other, "b_")).alias("far"), other["b_id"].alias("b_id"))

    def found(rows: DataFrame) -> DataFrame:
        around = beside(spread(rows.withColumn("bound", F.when(told, bound)), reach(at_x), reach(at_y)))
        best = around.select(*PAGE, "a", "bound", F.when(told, F.array_min(F.transform("others", held))).alias("best"))
        return best.groupBy(*PAGE, F.col("a.a_id").alias("a_id")).agg(F.min("best").alias("best"), F.min("bound").alias("bound"), F.first("a").alias("a"))

    settled = F.col("bound").isNull() | F.coalesce(F.col("best.far") < F.col("bound"), F.lit(False))
    # A box of a page of two cells by two has all of it around it.
    rest = found(rows.filter(F.col("g_n") > 2)).filter(~settled).drop("best")
    others = b.select(*PAGE, F.struct(*(c for c in b.columns if c not in PAGE)).alias("b"))
    rest = rest.join(others, PAGE, "left").groupBy(*PAGE, "a_id").agg(F.min(F.when(F.col("b").isNotNull(), held(F.col("b")))).alias("best"))
    every = found(rows).filter(settled).select(*PAGE, "a_id", "best").unionByName(rest)
    return every.select(*PAGE, "a_id", F.col("best.b_id").alias("b_id"), F.col("best.far").alias("far"))
