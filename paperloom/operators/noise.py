"""Template noise in paged text: repeated blocks, running headers, page numbers, ghosts, banned regions."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paperloom.functions.geometry import Box
from paperloom.functions.text import no_space, utrim, without_numbers_at_ends
from paperloom.sources.scratch import written

#: What a page number looks like once white space is gone.
PAGE_NUMBERS = [r"^\d{1,4}$", r"^\d{1,4}[/／]\d{1,4}$", r"^第?\d{1,4}[頁页]$", r"^[-–—]\d{1,4}[-–—]$", r"^[Pp](?:age)?\.?\d{1,4}$"]


def is_page_number(text: Column, y0: Column, y1: Column, page_height: Column | float, margin: float = 0.08) -> Column:
    """True for a short text at the top or bottom of a page that looks like a page number."""
    s = utrim(text)
    in_band = (y1 <= page_height * margin) | (y0 >= page_height * (1 - margin))
    looks = F.lit(False)
    for pattern in PAGE_NUMBERS:
        looks = looks | no_space(s).rlike(pattern)
    return (s != "") & (F.length(s) <= 16) & in_band & looks


def repeated_on_next_page(blocks: DataFrame, page_width: float, page_height: float, tolerance: float = 0.02, least: int = 2) -> DataFrame:
    """Blocks whose text stood on the page before at nearly the same place: the blocks with ``norm_text``.

    Of several blocks with a text the last one on the page before counts.
    """
    own = blocks.withColumn("norm_text", no_space("text")).filter(F.length("norm_text") >= least)
    last = own.groupBy("doc_id", "page", "norm_text").agg(F.max_by(F.struct("x0", "y0"), "block_no").alias("before"))
    last = last.select("doc_id", (F.col("page") + 1).alias("page"), "norm_text", "before")
    near = (F.abs(F.col("x0") - F.col("before.x0")) / page_width <= tolerance) & (F.abs(F.col("y0") - F.col("before.y0")) / page_height <= tolerance)
    return own.join(last, ["doc_id", "page", "norm_text"]).filter(near).drop("before")


def frequent_images(images: DataFrame, pages: DataFrame, share: float = 0.5) -> DataFrame:
    """``doc_id, hash``: images on more than ``share`` of a document's pages, each page counted once."""
    seen = images.groupBy("doc_id", "hash").agg(F.countDistinct("page").alias("n"))
    n_pages = pages.groupBy("doc_id").agg(F.countDistinct("page").alias("n_pages"))
    return seen.join(n_pages, "doc_id").filter(F.col("n") / F.col("n_pages") > share).select("doc_id", "hash")


def without_ghosts(spans: DataFrame, tolerance: float = 3.0) -> DataFrame:
    """Spans without repeats: a text within ``tolerance`` of the last kept place of the same text is dropped.

    The comparison is with what was kept, so it is a fold over each text's places in order.
    """
    ordered = F.array_sort(F.collect_list(F.struct("span_no", "x0", "y0")))
    kept = F.aggregate(
        "places",
        F.array().cast("array<struct<span_no:int,x0:double,y0:double>>"),
        lambda acc, p: F.when((F.size(acc) > 0) & (F.abs(F.element_at(acc, -1)["x0"] - p["x0"]) <= tolerance) & (F.abs(F.element_at(acc, -1)["y0"] - p["y0"]) <= tolerance), acc).otherwise(F.concat(acc, F.array(p))),
    )
    return spans.groupBy("doc_id", "page", "text").agg(ordered.alias("places")).select("doc_id", "page", "text", F.explode(kept).alias("p")).select("doc_id", "page", "text", "p.*")


def edge_blocks(blocks: DataFrame) -> DataFrame:
    """``doc_id, page, edge, text``: the first and the last text block of each page, without changing numbers."""
    both = blocks.groupBy("doc_id", "page").agg(F.min_by("text", "block_no").alias("first"), F.max_by("text", "block_no").alias("last"))
    return both.unpivot(["doc_id", "page"], ["first", "last"], "edge", "text").withColumn("text", without_numbers_at_ends("text"))


def common_edges(edges: DataFrame, share: float = 0.2, streak: int = 3, least: int = 3) -> DataFrame:
    """``doc_id, edge, text``: texts at an edge on ``share`` of the pages or ``streak`` in a row, and more than ``least`` times."""
    w = Window.partitionBy("doc_id", "edge").orderBy("page")
    island = F.row_number().over(w) - F.row_number().over(Window.partitionBy("doc_id", "edge", "text").orderBy("page"))
    runs = edges.withColumn("island", island).groupBy("doc_id", "edge", "text", "island").agg(F.count("*").alias("run"))
    counts = runs.groupBy("doc_id", "edge", "text").agg(F.sum("run").alias("n"), F.max("run").alias("streak"))
    pages = counts.groupBy("doc_id", "edge").agg(F.sum("n").alias("n_pages"))
    return counts.join(pages, ["doc_id", "edge"]).filter((F.col("n_pages") >= least) & (F.col("n") > least) & ((F.col("n") >= F.col("n_pages") * share) | (F.col("streak") >= streak))).select("doc_id", "edge", "text", "n", "streak")


def indel_ratio(a: str, b: str) -> float:
    """100 times twice the longest common subsequence over both lengths."""
    if not a and not b:
        return 100.0
    codes: dict[str, int] = {}
    for k, c in enumerate(a):
        codes[c] = codes.get(c, 0) | 1 << k
    full = (1 << len(a)) - 1
    state = full
    for c in b:  # bits of a that are not yet matched
        hit = state & codes.get(c, 0)
        state = (state + hit | state - hit) & full
    return 200.0 * (len(a) - state.bit_count()) / (len(a) + len(b))


@F.pandas_udf(T.DoubleType())
def fuzzy_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([indel_ratio(x or "", y or "") for x, y in zip(a, b, strict=True)], dtype="float64")


#: Characters of a run in the fuzzy join.
RUN = 3
#: Characters of a group's texts up to which one task compares them.
IN_TASK = 1 << 20


def runs_gone(least_ratio: float) -> float:
    """The share of a text's runs that can be gone in a near one, by its length; a ratio at which near texts need not share any is refused."""
    loss = 1 - least_ratio / 100
    gone = max(RUN / (1 + loss), (RUN - 1) / (1 - loss)) * 2 * loss
    unsure = (RUN - 1) / (1 - gone) if gone < 1 else float("inf")  # shorter texts may share no run
    if unsure * 2 * loss / (1 - loss) >= 1:
        raise ValueError(f"at a ratio of {least_ratio} near texts need not share any run of characters")
    return gone + 1e-9


def fuzzy_pairs(left: DataFrame, right: DataFrame, on: list[str], least_ratio: float = 90.0) -> DataFrame:
    """``*on, a, b, ratio``: the pairs of ``left(*on, a)`` and ``right(*on, b)``, both distinct, with equal ``on`` and a ratio over ``least_ratio``.

    Texts are so close that few of a text's runs of three characters can be gone: a ratio over 90 leaves at most a tenth of
    both lengths to insert or delete, and each deletion takes three runs, each insertion breaks two. So two texts are equal
    or share one of the rarest runs of both, as many as could be gone and one more, and only those that do are compared. No
    pair is lost; a ratio at which too few runs are sure to stay is refused.

    The texts of a group with equal ``on`` meet in one task, whole, and their runs stay there. Only the runs of groups with
    more than ``IN_TASK`` characters are shuffled. Both sides are read twice: write what is dear to compute.
    """
    gone = runs_gone(least_ratio)
    a, b = left.select(*on, F.col("a").alias("text"), F.lit(1).alias("side")), right.select(*on, F.col("b").alias("text"), F.lit(2).alias("side"))
    both = a.unionAll(b).dropna(subset=[*on, "text"])
    large = both.groupBy(*on).agg(F.sum(F.length("text").cast("long")).alias("n")).filter(F.col("n") > IN_TASK).select(*on)
    kinds = ", ".join(f"`{c}` {left.schema[c].dataType.simpleString()}" for c in on)
    near = lambda rows: rows.repartition(*on).sortWithinPartitions(*on).mapInArrow(near_in_groups(on, least_ratio, gone), f"{kinds}, a string, b string, ratio double")
    if large.isEmpty():
        return near(both)
    apart = [rows.join(large, on, "left_semi") for rows in (left, right)]
    return near(both.join(large, on, "left_anti")).unionByName(fuzzy_pairs_by_runs(*apart, on, least_ratio))


def near_in_groups(on: list[str], least_ratio: float, gone: float):
    """A function over rows ``*on, text, side`` sorted by ``on``: the near pairs of texts of side 1 and side 2 of each group."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, sides, kinds = None, {}, []

        def out(found: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*found, strict=True)) or [()] * (len(on) + 3)
            arrays = [pa.array(c, kind) for c, kind in zip(columns, [*kinds, pa.string(), pa.string(), pa.float64()], strict=True)]
            return pa.RecordBatch.from_arrays(arrays, names=[*on, "a", "b", "ratio"])

        for part in parts:
            kinds, found = part.schema.types[: len(on)], []
            for *own, text, side in zip(*(c.to_pylist() for c in part.columns), strict=True):
                if own != key:
                    for pair in near_texts(sides, least_ratio, gone):
                        found.append((*key, *pair))
                        if len(found) >= 10_000:
                            yield out(found)
                            found = []
                    key, sides = own, {}
                sides[text] = sides.get(text, 0) | side
            yield out(found)
        if sides:
            yield out([(*key, *pair) for pair in near_texts(sides, least_ratio, gone)])

    return run


def runs_of(text: str) -> list[str]:
    """A text's runs; the same run a second time is another one, with its number."""
    runs = [text[i : i + RUN] for i in range(len(text) - RUN + 1)]
    if len(set(runs)) == len(runs):
        return runs
    seen: Counter = Counter()
    for k, run in enumerate(runs):
        if seen[run]:
            runs[k] = f"{run}{seen[run]}"
        seen[run] += 1
    return runs


def near_texts(sides: dict[str, int], least_ratio: float, gone: float) -> Iterator[tuple[str, str, float]]:
    """``a, b, ratio`` of a group's texts, whose sides are bits.

    Texts without another one of nearly their length are left out at once; of the likely pairs, those that share as many
    runs as must stay are compared.
    """
    alike = lambda n, m: 200.0 * min(n, m) > least_ratio * (n + m)
    yield from ((t, t, 100.0) for t, side in sides.items() if side == 3)
    texts = sorted(sides, key=len)
    after = [alike(len(t), len(u)) for t, u in zip(texts, texts[1:], strict=False)]
    texts = [t for t, up, down in zip(texts, [False, *after], [*after, False], strict=False) if up or down]
    runs = [runs_of(t) for t in texts]
    spread: Counter = Counter()
    for own in runs:
        spread.update(own)
    holders: dict[str, list[int]] = {}
    for k, (text, own) in enumerate(zip(texts, runs, strict=True)):
        first = int(len(text) * gone) + 1
        counts = [spread[r] for r in own]
        if counts.count(1) >= first:  # its rarest runs are its own
            continue
        likely = set()
        for n, run in sorted(zip(counts, own, strict=True))[:first]:
            if n > 1:
                others = holders.setdefault(run, [])
                likely.update(others)
                others.append(k)
        own = set(own)
        for j in likely:
            other = texts[j]
            if not alike(len(text), len(other)) or len(own.intersection(runs[j])) < max(len(own) - int(len(text) * gone), len(runs[j]) - int(len(other) * gone)):
                continue
            ways = (sides[text] & 1 and sides[other] & 2, sides[other] & 1 and sides[text] & 2)
            if any(ways):
                ratio = indel_ratio(text, other)
                if ratio > least_ratio:
                    yield from ((x, y, ratio) for way, x, y in ((ways[0], text, other), (ways[1], other, text)) if way)


def fuzzy_pairs_by_runs(left: DataFrame, right: DataFrame, on: list[str], least_ratio: float = 90.0) -> DataFrame:
    """``fuzzy_pairs`` where a group's texts are too many for a task: the rarest runs of all texts are shuffled and joined."""
    gone = runs_gone(least_ratio)
    kinds = ", ".join(f"`{c}` {left.schema[c].dataType.simpleString()}" for c in on)

    def keyed(rows: DataFrame, name: str) -> DataFrame:
        return rows.filter(F.col(name).isNotNull()).select(*on, F.md5(name).alias("key"), F.length(name).alias("size"), F.col(name).alias("text"))

    def runs(rows: DataFrame) -> DataFrame:
        return rows.mapInArrow(counted_runs, f"{kinds}, key string, size int, gram string, nth int")

    a, b = keyed(left, "a"), keyed(right, "b")
    own, other = runs(a), runs(b)
    spread = own.select("gram", "nth").unionAll(other.select("gram", "nth")).groupBy("gram", "nth").agg(F.count("*").alias("n"))

    def rarest(rows: DataFrame, side: str) -> DataFrame:
        kept = F.slice("all", F.lit(1), F.floor(F.col("size") * F.lit(gone)).cast("int") + 1)
        by_rarity = rows.join(spread, ["gram", "nth"]).groupBy(*on, "key", "size").agg(F.array_sort(F.collect_list(F.struct("n", "gram", "nth"))).alias("all"))
        return by_rarity.select(*on, F.col("key").alias(f"key_{side}"), F.col("size").alias(f"size_{side}"), F.explode(kept).alias("of")).select(*on, f"key_{side}", f"size_{side}", "of.gram", "of.nth")

    likely = (200.0 * F.least("size_a", "size_b") / (F.col("size_a") + F.col("size_b")) > least_ratio) & (F.col("key_a") != F.col("key_b"))
    pairs = rarest(own, "a").join(rarest(other, "b"), [*on, "gram", "nth"]).filter(likely).select(*on, "key_a", "key_b").distinct()
    texts = [rows.select(*on, F.col("key").alias(f"key_{side}"), F.col("text").alias(side)) for rows, side in ((a, "a"), (b, "b"))]
    near = pairs.join(texts[0], [*on, "key_a"]).join(texts[1], [*on, "key_b"]).select(*on, "a", "b").withColumn("ratio", fuzzy_ratio("a", "b"))
    same = left.withColumn("b", F.col("a")).join(right, [*on, "b"]).select(*on, "a", "b", F.lit(100.0).alias("ratio"))
    return near.filter(F.col("ratio") > least_ratio).unionByName(same)


def counted_runs(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The runs of ``RUN`` characters of the last column, one row each in its place; the same run a second time is another one."""
    for part in parts:
        rows, runs, nth = [], [], []

        def out(part=part, rows=rows, runs=runs, nth=nth) -> pa.RecordBatch:
            at = pa.array(rows, pa.int64())
            batch = pa.RecordBatch.from_arrays([*(c.take(at) for c in part.columns[:-1]), pa.array(runs, pa.string()), pa.array(nth, pa.int32())], names=[*part.schema.names[:-1], "gram", "nth"])
            rows.clear(), runs.clear(), nth.clear()
            return batch

        for k, text in enumerate(part.column(part.num_columns - 1).to_pylist()):
            seen: Counter = Counter()
            for i in range(len(text) - RUN + 1):
                run = text[i : i + RUN]
                rows.append(k)
                runs.append(run)
                nth.append(seen[run])
                seen[run] += 1
            if len(rows) > 50_000:
                yield out()
        yield out()


def ignored_edges(edges: DataFrame, least_ratio: float = 90.0) -> DataFrame:
    """Edge blocks that are like a common text of their document and edge: ``doc_id, page, edge``."""
    edges = written(edges, "edges")
    common = written(common_edges(edges).select("doc_id", "edge", F.col("text").alias("b")), "common-edges")
    where = common.select("doc_id", "edge").distinct()
    texts = edges.select("doc_id", "edge", F.col("text").alias("a")).join(where, ["doc_id", "edge"], "left_semi").distinct()
    like = fuzzy_pairs(texts, common, ["doc_id", "edge"], least_ratio).select("doc_id", "edge", F.col("a").alias("text")).distinct()
    return edges.join(like, ["doc_id", "edge", "text"], "left_semi").select("doc_id", "page", "edge").distinct()


def without_banned(spans: DataFrame, banned: DataFrame, tolerance: float = 5.0, least: int = 3) -> DataFrame:
    """Spans that no banned region hides.

    ``banned(doc_id, norm_text, b_x0..b_y1)``. A span goes where its text is banned at that height, or where its text
    is part of a banned text whose box holds the span.
    """
    rows = spans.withColumn("norm_text", no_space("text"))
    same = banned.select("doc_id", "norm_text", "b_y0")
    rest = rows.join(same, (rows.doc_id == same.doc_id) & (rows.norm_text == same.norm_text) & (F.abs(rows.y0 - F.col("b_y0")) <= tolerance), "left_anti")
    other = banned.withColumnRenamed("doc_id", "b_doc").withColumnRenamed("norm_text", "b_text")
    inside = (F.col("doc_id") == F.col("b_doc")) & (F.length("norm_text") >= least) & F.contains(F.col("b_text"), F.col("norm_text")) & (F.col("b_text") != F.col("norm_text")) & Box.of("b_").contains(Box.of(), tolerance)
    return rest.join(other, inside, "left_anti").drop("norm_text")


def title_of(spans: DataFrame, close: float = 0.1, small: float = 0.0, instead: str | None = None) -> DataFrame:
    """``doc_id, page, title``: the text in the largest font; on inner pages none if several share it, on page 0 the topmost.

    Pages whose largest font is under ``small`` get ``instead``, as going on from the page before; without it, no row.
    """
    top = F.max("size").over(Window.partitionBy("doc_id", "page"))
    largest = spans.withColumn("top", top).filter(F.col("top") - F.col("size") < close)
    if instead is None:
        largest = largest.filter(F.col("top") >= small)
    best = largest.groupBy("doc_id", "page").agg(F.max("top").alias("top"), F.count("*").alias("n"), F.min_by("text", F.struct("y0", "span_no")).alias("text"))
    title = F.when((F.col("page") == 0) | (F.col("n") == 1), F.col("text"))
    return best.select("doc_id", "page", F.when(F.col("top") < small, F.lit(instead)).otherwise(title).alias("title"))


def main_title(titles: DataFrame, files: DataFrame, pages: int = 3) -> DataFrame:
    """``doc_id, title``: over the first pages the title in the largest font, the earliest of equal ones, else the stem."""
    best = titles.filter((F.col("page") < pages) & F.col("title").isNotNull()).groupBy("doc_id").agg(F.min_by("title", F.struct(-F.col("size"), F.col("page"))).alias("title"))
    return files.join(best, "doc_id", "left").select("doc_id", F.coalesce("title", "stem").alias("title"))


def usual_size(spans: DataFrame) -> DataFrame:
    """``doc_id, size``: the smallest font size that occurs at least twice, else the smallest."""
    counts = spans.groupBy("doc_id", "size").agg(F.count("*").alias("n"))
    return counts.groupBy("doc_id").agg(F.coalesce(F.min(F.when(F.col("n") >= 2, F.col("size"))), F.min("size")).alias("size"))


def nearest_rank(rows: DataFrame, by: str, value: str, percent: int, low: float, high: float) -> DataFrame:
    """``by, threshold``: the value at place ``n * percent / 100`` in order, kept within bounds. No interpolation.

    The place is found by rank, so no group is collected.
    """
    w = Window.partitionBy(by)
    at = F.least(F.count("*").over(w) - 1, F.floor(F.count("*").over(w) * percent / 100))
    found = rows.withColumn("at", at).withColumn("place", F.row_number().over(w.orderBy(value)) - 1).filter("place = at")
    return found.select(by, F.least(F.lit(float(high)), F.greatest(F.lit(float(low)), F.col(value))).alias("threshold"))


def page_route(signals: DataFrame, drawings: int = 200, chars: int = 20, cover: float = 0.6) -> DataFrame:
    """Pages with ``route``: slow for many drawings or for nearly no text under a large image, else fast."""
    slow = (F.col("drawings") > drawings) | ((F.col("chars") < chars) & (F.col("max_image_cover") >= cover))
    return signals.withColumn("route", F.when(F.coalesce(slow, F.lit(False)), "slow").otherwise("fast"))


def page_score(signals: DataFrame, weights: tuple[float, float, float, float] = (0.4, 0.3, 0.2, 0.1)) -> DataFrame:
    """Pages with a weighted ``score`` of drawings, images, sparse text and font variety, each kept in 0 to 1."""
    parts = (F.col("drawings") / 200.0, F.col("images") / 5.0, 1.0 - F.col("chars") / 500.0, F.col("font_sizes") / 8.0)
    one = [F.greatest(F.lit(0.0), F.least(F.lit(1.0), p)) * w for p, w in zip(parts, weights, strict=True)]
    return signals.withColumn("score", one[0] + one[1] + one[2] + one[3])


#: A list item's mark, which makes a line no title; numbers of sections like 1.1 are none.
ITEM = r"^(?:[-*•●■◆▪]|\d{1,2}[.)、])\s"


def title_candidates(spans: DataFrame, page_width: Column | float, least: int = 2, wide: float = 0.95, long: int = 30) -> DataFrame:
    """Spans that can be a page's title: not too short, no bare number, no page number, no list item, and not both wide
    and long as body text is. ``text`` is trimmed and ``size`` rounded to tenths."""
    rows = spans.withColumn("text", utrim("text")).withColumn("size", F.bround("size", 1))
    bare = no_space("text")
    number = F.lit(False)
    for pattern in PAGE_NUMBERS:
        number = number | bare.rlike(pattern)
    width = page_width if isinstance(page_width, Column) else F.lit(float(page_width))
    body = (width > 0) & ((F.col("x1") - F.col("x0")) / width >= wide) & (F.length("text") >= long)
    return rows.filter((F.length("text") >= least) & ~F.col("text").rlike(r"^\p{Nd}+$") & ~number & ~F.col("text").rlike(ITEM) & ~body)


def looks_scanned(pages: DataFrame, images: DataFrame, chars: int = 20, cover: float = 0.8) -> DataFrame:
    """Pages ``doc_id, page, scanned``: hardly any text and an image over ``cover`` of the page's area.

    ``pages(doc_id, page, text, width, height)``, ``images(doc_id, page, x0, y0, x1, y1)``.
    """
    largest = images.groupBy("doc_id", "page").agg(F.max(Box.of().area).alias("_a"))
    rows = pages.join(largest, ["doc_id", "page"], "left")
    few = F.length(utrim(F.coalesce("text", F.lit("")))) < chars
    large = F.coalesce(F.col("_a") >= F.greatest(F.lit(1.0), F.col("width") * F.col("height")) * cover, F.lit(False))
    return rows.select("doc_id", "page", (few & large).alias("scanned"))


def usable_pages(spans: DataFrame, issue: Column) -> DataFrame:
    """``doc_id, page, usable``: a page has spans with text, and its spans as lines pass the gate ``issue`` on column ``text``."""
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("span_no", "text"))), lambda x: F.concat(F.lit(" "), x["text"], F.lit("\n"))), "")
    rows = spans.groupBy("doc_id", "page").agg(text.alias("text"))
    return rows.select("doc_id", "page", ((utrim("text") != "") & ~issue).alias("usable"))


def image_decisions(images: DataFrame, page_area: Column | float, tiny: float = 5.0, small: float = 0.01, background: float = 0.9) -> DataFrame:
    """Images with ``decision``, the first that holds: tiny, off the page, banned, small, background, repeated, kept.

    ``images(doc_id, page, seq, hash, banned, x0..y1)``; the first image of a document with a hash is no repeat.
    """
    area = Box.of().area / (page_area if isinstance(page_area, Column) else F.lit(float(page_area)))
    again = F.row_number().over(Window.partitionBy("doc_id", "hash").orderBy("page", "seq")) > 1
    thin = (Box.of().width <= tiny) | (Box.of().height <= tiny)
    off = (F.col("x1") <= 0) | (F.col("y1") <= 0)
    return images.withColumn("decision", F.when(thin, "tiny").when(off, "off_page").when(F.coalesce("banned", F.lit(False)), "banned").when(area < small, "small").when(area >= background, "background").when(again, "repeated").otherwise("kept"))


def drawn_pages(signals: DataFrame, paths: int = 1000) -> DataFrame:
    """Pages with more than so many drawn paths."""
    return signals.filter(F.col("drawings") > paths)
