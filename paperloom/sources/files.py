"""Readers: file inventories, Markdown, attribute tables of unknown encoding, sidecars, HTML pages, page ranges."""

from __future__ import annotations

import csv
import io
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException, PySparkRuntimeError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.functions.text import file_name, stem_of
from paperloom.sources.html_tree import markdown_of

#: Fixed value: the encodings that are tried in order.
ENCODINGS = ("utf-8-sig", "utf-8", "cp950", "big5")
STATES = {"pending": "unprocessed", "done": "ingested"}


def inventory(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """``path, file_key, stem, size, mtime`` of every file under a folder. Contents are not read."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).option("ignoreMissingFiles", True).load(root)
    key = F.regexp_replace(F.regexp_replace("path", r"^[a-z]+:/*", "/"), "^" + re.escape("/" + root.split("://")[-1].strip("/")) + "/", "")
    return rows.select("path", key.alias("file_key"), stem_of("path").alias("stem"), F.col("length").alias("size"), F.col("modificationTime").alias("mtime"))


def markdown(spark: SparkSession, root: str) -> DataFrame:
    """``path, stem, text, front_matter`` of Markdown files; the front matter is a map of ``key: value`` lines."""
    rows = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.md").text(root, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))
    head = F.regexp_extract("text", r"(?s)\A---\n(.*?)\n---\n", 1)
    pairs = F.filter(F.transform(F.split(head, "\n"), lambda line: F.struct(F.trim(F.substring_index(line, ":", 1)).alias("key"), F.regexp_replace(F.trim(F.regexp_replace(line, r"^[^:]*:", "")), "^[\"']|[\"']$", "").alias("value"))), lambda x: x["key"] != "")
    return rows.select("path", stem_of("path").alias("stem"), F.regexp_replace("text", r"(?s)\A---\n.*?\n---\n", "").alias("text"), F.map_from_entries(F.array_distinct(pairs)).alias("front_matter"))


def decoded(content: bytes) -> str:
    for name in ENCODINGS:
        try:
            return content.decode(name)
        except UnicodeDecodeError:
            continue
    return content.decode("utf-8", "replace")


def delimiter_of(line: str) -> str:
    return "\t" if line.count("\t") > line.count(",") else ","


def delimited(spark: SparkSession, path: str) -> DataFrame:
    """A table file of unknown encoding and delimiter, all columns as text, blank rows left out.

    One read of the file's first line settles both, then Spark reads the file.
    """
    first = spark.read.format("binaryFile").load(path).select(F.substring("content", 1, 65536).alias("head")).first()
    head = bytes(first["head"]) if first else b""
    encoding = next((e for e in ENCODINGS if _decodes(head.rpartition(b"\n")[0] or head, e)), "utf-8")
    sep = delimiter_of(head.decode(encoding, "replace").split("\n", 1)[0])
    if encoding.startswith("utf-8"):
        rows = spark.read.option("header", True).option("sep", sep).option("multiLine", True).csv(path)
    else:
        names = next(csv.reader(io.StringIO(head.decode(encoding, "replace")), delimiter=sep))
        rows = spark.read.format("binaryFile").load(path).select("content").mapInArrow(_legacy_rows(sep), "cells array<string>")
        rows = rows.select(*(F.get("cells", F.lit(k)).alias(n) for k, n in enumerate(names)))
    rows = rows.toDF(*(c.lstrip("﻿").strip() for c in rows.columns))
    return rows.filter(F.trim(F.concat_ws("", *(F.col(f"`{c}`") for c in rows.columns))) != "")


def _legacy_rows(sep: str):
    """Rows of files in encodings that Spark's reader does not take, without the header; such files are small."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for content in part.column(0).to_pylist():
                rows = list(csv.reader(io.StringIO(decoded(content)), delimiter=sep))[1:]
                yield pa.RecordBatch.from_arrays([pa.array(rows, pa.list_(pa.string()))], names=["cells"])

    return run


def _decodes(content: bytes, encoding: str) -> bool:
    try:
        content.decode(encoding)
    except UnicodeDecodeError:
        return False
    return True


def sidecars(rows: DataFrame, text: str = "json") -> DataFrame:
    """Review records with defaults for what is missing or broken, and old states under their new names."""
    r = F.from_json(F.col(text), "file_hash string, review_status string, reviewer string, doc_type string, delim string", {"mode": "PERMISSIVE"})
    status = F.coalesce(F.nullif("r.review_status", F.lit("")), F.lit("unprocessed"))
    renamed = F.create_map(*[F.lit(x) for kv in STATES.items() for x in kv])
    return rows.withColumn("r", r).select(*rows.columns, F.coalesce("r.file_hash", F.lit("")).alias("file_hash"), F.coalesce(F.element_at(renamed, status), status).alias("review_status"), F.coalesce("r.reviewer", F.lit("")).alias("reviewer"), F.coalesce("r.doc_type", F.lit("")).alias("doc_type"), F.coalesce("r.delim", F.lit("")).alias("delim"))


def page_numbers(text: Column | str) -> Column:
    """``"0,5-10"`` as sorted distinct numbers."""
    text = F.col(text) if isinstance(text, str) else text
    pieces = F.filter(F.split(F.replace(text, F.lit(" "), F.lit("")), ","), lambda x: x.rlike(r"^\d+(-\d+)?$"))
    return F.array_sort(F.array_distinct(F.flatten(F.transform(pieces, lambda x: F.sequence(F.substring_index(x, "-", 1).cast("int"), F.substring_index(x, "-", -1).cast("int"))))))


def reader_of(path: Column | str, head: Column) -> Column:
    """Which reader a file needs: by its first bytes, else by its extension, else pdf. Office files and books are all zip
    archives, so their extension tells them apart; one of the old binary format goes to the reader of its kind."""
    hexed = F.hex(F.substring(head, 1, 4))
    start = F.lower(F.ltrim(F.decode(F.regexp_replace(F.decode(F.substring(head, 1, 256), "ISO-8859-1"), "^\u00ef\u00bb\u00bf", "").cast("binary"), "UTF-8"), F.lit(" \t\r\n")))
    ext = F.lower(F.regexp_extract(file_name(path), r"\.([^.]+)$", 1))
    zipped = F.when(ext.isin("docx", "xlsx", "pptx", "epub"), ext)
    old = F.when(ext.isin("doc", "xls", "ppt"), F.concat(ext, F.lit("x")))
    by_magic = F.when(hexed.startswith("25504446"), "pdf").when(hexed.startswith("89504E47") | hexed.startswith("FFD8FF") | hexed.startswith("47494638"), "image").when(hexed == "504B0304", zipped).when(hexed == "D0CF11E0", old)
    by_magic = F.coalesce(by_magic, F.when(start.startswith("<!doctype html") | start.startswith("<html"), "html"))
    by_ext = F.when(ext.isin("png", "jpg", "jpeg", "gif", "tif", "tiff", "bmp", "webp"), "image").when(ext.isin("docx", "xlsx", "pptx", "epub"), ext).when(ext.isin("html", "htm"), "html")
    return F.coalesce(by_magic, by_ext, F.lit("pdf"))


def html_text(c: Column | str) -> Column:
    """Text of an HTML page without scripts, styles and tags, entities of the five basic kinds resolved."""
    c = F.col(c) if isinstance(c, str) else c
    text = F.regexp_replace(c, r"(?is)<(script|style)\b.*?</\1\s*>", "")
    text = F.regexp_replace(text, r"(?i)<br\s*/?>|</(?:p|div|li|h[1-6]|tr|nav|footer)\s*>", "\n")
    text = F.regexp_replace(text, r"(?s)<[^>]*>", "")
    for entity, plain in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(plain))
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"[ \t]+", " "), r"\s*\n\s*", "\n"))


def html_links(c: Column | str) -> Column:
    return F.regexp_extract_all(F.col(c) if isinstance(c, str) else c, F.lit(r"(?i)<a\b[^>]*\bhref=[\"']([^\"']*)[\"']"), F.lit(1))


def html_markdown(pages: DataFrame, key: str, text: str) -> DataFrame:
    """``key, markdown``: pages as Markdown (see ``html_tree``), in Arrow batches; a null page is empty."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([markdown_of(page or "") for page in part.column(1).to_pylist()], pa.string())], names=[key, "markdown"])

    return pages.select(key, text).mapInArrow(run, f"{key} {pages.schema[key].dataType.simpleString()}, markdown string")


def loaded_or_last(load, last: DataFrame | None) -> tuple[DataFrame | None, str | None]:
    """What ``load`` returns, or the last good table and the error where it fails; an empty table is no failure."""
    try:
        rows = load()
        rows.isEmpty()
    except (AnalysisException, PySparkRuntimeError, OSError) as error:
        return last, str(error)
    return rows, None
