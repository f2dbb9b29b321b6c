"""From Markdown lines to sections, chunks and their payload."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperloom.functions.text import image_paths, project_of, split_trimmed, stem_of, strip_image_refs, utrim, uuid5

LEVELS = (3, 4, 5, 6)
HEADING = r"^(#{3,6})\s+(.+?)\s*$"
#: Fixed value: the separator of the heading path.
PATH = " > "


def split_pages(docs: DataFrame, text: str = "text", anchor: str = r"(?m)^## 第 (\d+) 頁[ \t]*\n") -> DataFrame:
    """``doc_id, page_pos, page_num, md`` from whole documents with page anchors; without any, one page 1."""
    numbers = F.regexp_extract_all(F.col(text), F.lit(anchor), F.lit(1))
    bodies = F.split(F.col(text), anchor, -1)
    pages = F.when(F.size(numbers) == 0, F.array(F.struct(F.lit("1").alias("page_num"), F.col(text).alias("md")))).otherwise(F.transform(numbers, lambda n, i: F.struct(n.alias("page_num"), F.get(bodies, i + 1).alias("md"))))
    return docs.select("doc_id", F.posexplode(pages).alias("page_pos", "p")).select("doc_id", "page_pos", F.col("p.page_num").cast("int").alias("page_num"), F.regexp_replace("p.md", r"\n---\s*\n?$", "").alias("md"))


def lines_of(pages: DataFrame) -> DataFrame:
    return pages.select("doc_id", "page_pos", "page_num", F.posexplode(F.split("md", "\n", -1)).alias("line_no", "text"))


def with_heading_path(lines: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """Lines with ``level, title`` and the headings in force, ``h3`` to ``h6``.

    A heading of a level ends those of that level and below. A level's heading is in force while it came after the last
    heading of a lower number; three window functions per level, no state kept by hand.
    """
    w = Window.partitionBy(*by).orderBy(*order)
    so_far = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    level = F.length(F.regexp_extract("text", HEADING, 1))
    rows = lines.withColumn("level", F.when(level > 0, level)).withColumn("title", F.when(level > 0, utrim(F.regexp_extract("text", HEADING, 2)))).withColumn("at", F.row_number().over(w))
    last = [F.max(F.when(F.col("level") == n, F.struct("at", "title"))).over(so_far).alias(f"_l{n}") for n in LEVELS]
    cut = [F.max(F.when(F.col("level") < n, F.col("at"))).over(so_far).alias(f"_c{n}") for n in LEVELS]
    rows = rows.select("*", *last, *cut)  # one window operator for all levels
    for n in LEVELS:
        rows = rows.withColumn(f"h{n}", F.when(F.col(f"_l{n}.at") > F.coalesce(F.col(f"_c{n}"), F.lit(-1)), F.col(f"_l{n}.title")))
    return rows.drop("at", *(f"_{k}{n}" for n in LEVELS for k in "lc"))


def sections(lines: DataFrame) -> DataFrame:
    """``doc_id, page_pos, page_num, section_idx, h3..h6, body, image_paths``: what stands between headings.

    Lines before the first heading are a section only if something is left of them; a heading's section stays even if
    it is empty. The body has no image references.
    """
    rows = with_heading_path(lines, ["doc_id", "page_pos"], ["line_no"])
    w = Window.partitionBy("doc_id", "page_pos").orderBy("line_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("part", F.count("level").over(w))
    ordered = F.array_sort(F.collect_list(F.when(F.col("level").isNull(), F.struct("line_no", "text"))))
    raw = F.array_join(F.transform(ordered, lambda x: x["text"]), "\n")
    # within a part the heading path is the same on every line
    out = rows.groupBy("doc_id", "page_pos", "page_num", "part").agg(raw.alias("raw"), *(F.max(f"h{n}").alias(f"h{n}") for n in LEVELS))
    out = out.withColumn("image_paths", image_paths("raw")).withColumn("body", utrim(strip_image_refs("raw")))
    out = out.filter((F.col("part") > 0) | (F.col("body") != "") | (F.size("image_paths") > 0))
    place = F.row_number().over(Window.partitionBy("doc_id", "page_pos").orderBy("part")) - 1
    return out.withColumn("section_idx", place).drop("part", "raw")


def depth() -> Column:
    """The level of the deepest heading, 0 without one."""
    return F.greatest(*(F.when(F.col(f"h{n}").isNotNull(), F.lit(n)).otherwise(0) for n in LEVELS))


def demoted(secs: DataFrame) -> DataFrame:
    """Empty leaf headings become text: the deepest heading of an empty section that no other section of its page goes
    on from leaves the path and is the body; then neighbours with the same path merge.

    A page without headings stays as it is. Sections of a page meet in one window, which a page's size bounds.
    """
    page = Window.partitionBy("doc_id", "page_pos")
    path = F.array(*(F.col(f"h{n}") for n in LEVELS))
    rows = secs.withColumn("path", path).withColumn("depth", depth())
    rows = rows.withColumn("others", F.collect_list(F.struct("depth", "path")).over(page))
    goes_on = F.exists("others", lambda o: (o["depth"] > F.col("depth")) & F.forall(F.sequence(F.lit(0), F.lit(len(LEVELS) - 1)), lambda i: F.get(F.col("path"), i).isNull() | F.get(F.col("path"), i).eqNullSafe(F.get(o["path"], i))))
    lone = (F.col("depth") > 0) & (F.col("body") == "") & ~goes_on
    rows = rows.withColumn("lone", lone).withColumn("body", F.when(F.col("lone"), F.get("path", F.col("depth") - LEVELS[0])).otherwise(F.col("body")))
    for n in LEVELS:
        rows = rows.withColumn(f"h{n}", F.when(~(F.col("lone") & (F.col("depth") == n)), F.col(f"h{n}")))
    order = page.orderBy("section_idx")
    now = F.struct(*(F.col(f"h{n}") for n in LEVELS))
    starts = F.coalesce(~F.lag(now).over(order).eqNullSafe(now), F.lit(True)) | (F.row_number().over(order) == 1)
    rows = rows.withColumn("start", starts.cast("int")).withColumn("island", F.sum("start").over(order))
    bodies = F.array_sort(F.collect_list(F.when(F.col("body") != "", F.struct("section_idx", "body"))))
    images = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("section_idx", "image_paths"))), lambda x: x["image_paths"]))
    merged = rows.groupBy("doc_id", "page_pos", "page_num", "island").agg(F.array_join(F.transform(bodies, lambda x: x["body"]), "\n").alias("body"), images.alias("image_paths"), *(F.first(f"h{n}").alias(f"h{n}") for n in LEVELS))
    return merged.withColumn("section_idx", F.row_number().over(page.orderBy("island")) - 1).drop("island")


def heading_path() -> Column:
    return F.concat_ws(PATH, *(F.col(f"h{n}") for n in LEVELS))


def chunks(secs: DataFrame, delimiter: str | None = None) -> DataFrame:
    """``doc_id, page_pos, page_num, section_idx, chunk_idx, h3..h6, text, image_paths``: sections cut at a delimiter.

    Indices are given before empty sections fall away, so they stay stable when text is added.
    """
    return secs.select("doc_id", "page_pos", "page_num", "section_idx", *(f"h{n}" for n in LEVELS), "image_paths", F.posexplode(split_trimmed("body", delimiter)).alias("chunk_idx", "text"))


def with_ids(parts: DataFrame, files: DataFrame) -> DataFrame:
    """Chunks with ids, links to their neighbours, their file, and the text that is embedded.

    ``files(doc_id, file_key, file_hash)``. Ids are version-5 UUIDs of hash, page, section and chunk:
    copies of a file share ids, so an order by id needs the file's key behind it, and ``maintenance.upload_plan`` keeps files
    without a hash from sharing theirs.
    """
    rows = parts.join(files.select("doc_id", "file_key", "file_hash"), "doc_id")
    own = F.when(F.coalesce("file_hash", F.lit("")) == "", "NOHASH").otherwise(F.col("file_hash"))
    w = Window.partitionBy("doc_id").orderBy("page_pos", "section_idx", "chunk_idx")
    rows = rows.withColumn("chunk_id", uuid5(F.concat_ws("|", own, "page_num", "section_idx", "chunk_idx"))).withColumn("section_id", uuid5(F.concat_ws("|", own, "page_num", "section_idx", F.lit("idx"))))
    rows = rows.withColumn("chunk_idx_global", F.row_number().over(w) - 1).withColumn("prev_chunk_id", F.lag("chunk_id").over(w)).withColumn("next_chunk_id", F.lead("chunk_id").over(w))
    place = F.concat_ws(" | ", project_of("file_key"), stem_of("file_key"), F.concat(F.lit("P"), F.col("page_num")), F.nullif(heading_path(), F.lit("")))
    return rows.withColumn("text_with_prefix", F.concat(F.lit("["), place, F.lit("] "), F.col("text")))


def payload(rows: DataFrame, strategy: str = "heading+token-v2", labels: Column | None = None) -> DataFrame:
    """The nested record of a chunk as it is stored with its vectors."""
    levels = [F.when(F.col(f"h{n}").isNotNull(), F.struct(F.lit(str(n)).alias("key"), F.col(f"h{n}").alias("value"))) for n in LEVELS]
    headings = F.map_from_entries(F.filter(F.array(*levels), lambda x: x.isNotNull()))
    flat = F.filter(F.array(*(F.col(f"h{n}") for n in LEVELS)), lambda x: x.isNotNull())
    source = F.struct(project_of("file_key").alias("project_name"), F.split("file_key", "/")[0].alias("doc_type"), "file_key", stem_of("file_key").alias("file_name"), "file_hash")
    location = F.struct(F.col("page_num").alias("page"), headings.alias("headings"), flat.alias("breadcrumb"), F.try_element_at(flat, F.lit(-1)).alias("current_header"), "section_idx", "chunk_idx", "chunk_idx_global")
    content = F.struct("text", "text_with_prefix", F.length("text").alias("token_count"), F.length("text").alias("char_count"))
    visuals = F.struct((F.size("image_paths") > 0).alias("has_image"), F.size("image_paths").alias("image_count"), F.col("image_paths").alias("images"))
    chunking = F.struct(F.lit(strategy).alias("strategy"), F.col("section_id").alias("parent_section_id"), "prev_chunk_id", "next_chunk_id")
    own = labels if labels is not None else F.array().cast("array<string>")
    return rows.select(F.col("chunk_id").alias("id"), F.struct(F.struct(source.alias("source"), location.alias("location")).alias("metadata"), content.alias("content"), visuals.alias("visuals"), F.array_sort(F.array_distinct(own)).alias("labels"), chunking.alias("chunking")).alias("payload"))
