"""Bound queries of edits, replaced blocks, formatted spans and rows that fail."""

from __future__ import annotations

from pyspark.sql import functions as F

from paperloom.operators import edits as ed
from paperloom.operators import maintenance as mt
from paperloom.operators import positions as ps
from paperloom.operators import recognition as rc
from paperloom.operators import spans as sp
from paperloom.operators.shares import shared_out
from paperloom.plans import adapters as ad
from paperloom.plans.queries import query
from paperloom.sources import quarantine as qu


def edit_log(s, d):
    """Events as edits: a user is a file; two in five are undos, now and then all are undone or saved."""
    n = F.col("event_id")
    action = F.when(n % 61 == 7, "undo_all").when(n % 53 == 11, "save").when(n % 5 < 2, "undo").otherwise("delete")
    return ad.table(s, d, "events").select(F.col("user_id").alias("file_key"), n.alias("entry_id"), action.alias("action"), F.concat("event_type", F.lit("/"), (n % 7).cast("string")).alias("path"))


#: A fold over each file's entries, with the stack as a list.
_FOLDED = """WITH RECURSIVE l AS (
  SELECT user_id AS file_key, event_id AS entry_id, CASE WHEN event_id % 61 = 7 THEN 'undo_all' WHEN event_id % 53 = 11 THEN 'save' WHEN event_id % 5 < 2 THEN 'undo' ELSE 'delete' END AS action,
         event_type || '/' || (event_id % 7) AS path, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events
), f AS (
  SELECT file_key, 0::BIGINT AS k, []::BIGINT[] AS stack, NULL::BIGINT AS entry_id, []::BIGINT[] AS back, []::BIGINT[] AS gone FROM (SELECT DISTINCT file_key FROM l)
  UNION ALL
  SELECT l.file_key, l.k, CASE action WHEN 'delete' THEN list_append(stack, l.entry_id) WHEN 'undo' THEN stack[:-2] ELSE [] END, l.entry_id,
         CASE action WHEN 'undo' THEN stack[-1:] WHEN 'undo_all' THEN stack ELSE [] END, CASE action WHEN 'save' THEN stack ELSE [] END
  FROM f JOIN l ON l.file_key = f.file_key AND l.k = f.k + 1
), back AS (SELECT file_key, unnest(back) AS entry_id, entry_id AS undone_by FROM f
), gone AS (SELECT file_key, unnest(gone) AS entry_id FROM f
), m AS (
  SELECT l.file_key, l.entry_id, path, undone_by, CASE WHEN undone_by IS NOT NULL THEN 'restored' WHEN gone.entry_id IS NOT NULL THEN 'saved' ELSE 'deleted' END AS state
  FROM l LEFT JOIN back USING (file_key, entry_id) LEFT JOIN gone USING (file_key, entry_id) WHERE action = 'delete'
)"""


@query("image_undo", f"{_FOLDED} SELECT * FROM m")
def image_undo(s, d):
    return ed.matched_edits(edit_log(s, d))


@query("image_trash", f"{_FOLDED} SELECT file_key, path, arg_max(state, entry_id) <> 'restored' AS trashed FROM m GROUP BY 1, 2")
def image_trash(s, d):
    return ed.image_states(edit_log(s, d))


def _structure(s, d):
    """An order is a document: its lines are blocks under block 0; some were replaced, some of these again, and the top as well."""
    rows = ad.table(s, d, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").cast("long").alias("n"))
    lines = shared_out(rows, "doc_id").distinct()
    structure = lines.select("doc_id", F.lit(0).cast("long").alias("parent_id"), F.col("n").alias("pos"), F.col("n").alias("block_id"))
    top = lines.select("doc_id").distinct().select("doc_id", F.lit(None).cast("long").alias("parent_id"), F.lit(0).cast("long").alias("pos"), F.lit(0).cast("long").alias("block_id"))
    step = lambda when, seq, old, new: F.when(F.expr(when), F.struct((F.col("n") + seq).alias("seq"), (F.col("n") + old).alias("old_id"), (F.col("n") + new).alias("new_id")))
    steps = F.array(step("(doc_id + n) % 2 = 0", 100, 0, 100), step("(doc_id + n) % 4 = 0", 200, 100, 200), step("(doc_id + n) % 8 = 0", 300, 200, 300), step("n = 1 AND doc_id % 3 = 0", 0, -1, 999))
    replaced = lines.select("doc_id", F.inline(F.filter(steps, lambda x: x.isNotNull())))
    return structure.unionByName(top), replaced


_CHAIN = "CASE WHEN (doc_id + n) % 8 = 0 THEN n + 300 WHEN (doc_id + n) % 4 = 0 THEN n + 200 WHEN (doc_id + n) % 2 = 0 THEN n + 100 ELSE n END"
_TOP = "CASE WHEN doc_id % 3 = 0 AND one THEN 1000 ELSE 0 END"


@query("block_replaced", f"WITH l AS (SELECT doc_id, n, bool_or(n = 1) OVER (PARTITION BY doc_id) AS one FROM (SELECT DISTINCT l_orderkey AS doc_id, l_linenumber::BIGINT AS n FROM lineitem)) SELECT doc_id, {_TOP} AS parent_id, n AS pos, {_CHAIN} AS block_id FROM l UNION ALL SELECT DISTINCT doc_id, NULL, 0, {_TOP} FROM l")
def block_replaced(s, d):
    structure, replaced = _structure(s, d)
    return ed.replaced_structure(structure, replaced)


@query("block_tombstones", "WITH l AS (SELECT DISTINCT l_orderkey AS doc_id, l_linenumber::BIGINT AS n FROM lineitem) SELECT doc_id, n AS block_id, (doc_id + n) % 2 = 0 AS removed FROM l")
def block_tombstones(s, d):
    structure, replaced = _structure(s, d)
    return ed.tombstoned(structure.filter("parent_id = 0").select("doc_id", "block_id", F.lit(False).alias("removed")), replaced).select("doc_id", "block_id", "removed")


#: Words of a share, about: what a task holds and sorts.
WORDS = 250_000


def tagged_words(s, d):
    """The words of each document as characters, with tags and line breaks at fixed distances."""
    docs = shared_out(ad.table(s, d, "documents").select("doc_id", "text"), "doc_id", size=WORDS, each=F.length("text") - F.length(F.replace("text", F.lit(" "))) + 1)
    words = docs.select("doc_id", F.posexplode(F.split("text", " ", -1)).alias("k", "w"))
    k = F.col("k")
    tag = F.when(k % 7 == 3, "<b>").when(k % 11 == 5, "</b>").when(k % 13 == 4, "<i>").when(k % 17 == 2, "</i>").when(k % 31 == 8, "<math display='inline'>").when(k % 37 == 9, "</math>").when(k % 41 < 2, "<br>")
    x, y = (k % 50).cast("double"), F.floor(k / 50).cast("double")
    return words.select("doc_id", k.alias("pos"), F.coalesce(tag, F.col("w")).alias("text"), x.alias("x0"), y.alias("y0"), (x + 1).alias("x1"), (y + 1).alias("y1"))


@query("spans_formatted")
def spans_formatted(s, d):
    return sp.formatted_spans(tagged_words(s, d), ["doc_id"])


def _by_heading(row: dict) -> str:
    return "slow" if row["html"].index("<h1") < 200 else "fast"


@query("pages_routed", "SELECT page_id, CASE WHEN place BETWEEN 1 AND 200 THEN 'slow' ELSE 'fast' END AS route, place = 0 AS route_fallback FROM (SELECT page_id, instr(html, '<h1') AS place FROM pages)")
def pages_routed(s, d):
    """Pages without a heading raise an error in their route, and go the fast way with a mark."""
    return qu.routed(ad.table(s, d, "pages").select("page_id", "html"), _by_heading).select("page_id", "route", "route_fallback")


def _pages(s, d):
    return ad.lines(s, d).select("doc_id", "page").distinct()


_PAGES = f"{ad.LINES}, pg AS (SELECT DISTINCT doc_id, page FROM lines), nr AS (SELECT *, row_number() OVER (ORDER BY doc_id, page) - 1 AS k FROM pg)"


@query("pages_to_recognise", f"WITH {_PAGES} SELECT doc_id, count(*) AS n_pages, count(*) FILTER (k % 3 = 1 OR k % 5 = 0) AS n_bad, count(*) FILTER (k % 3 = 1 OR k % 5 = 0) >= count(*) * 0.5 AS recognise FROM nr GROUP BY 1")
def pages_to_recognise(s, d):
    """Labels without keys, made in the order of the pages, are scattered back by position."""
    told = ps.numbered(_pages(s, d), "doc_id", "page", name="k").select("k", F.when((F.col("k") % 3 == 1) | (F.col("k") % 5 == 0), "bad").otherwise("good").alias("label"))
    return ps.pages_to_recognise(_pages(s, d), told, ["k"])


@query("tables_page_text", f"WITH {ad.LINES}, tb AS (SELECT doc_id, page, line_no FROM lines WHERE line_no % 4 < 2), pt AS (SELECT doc_id, page, string_agg(text, chr(10) ORDER BY line_no) AS page_text FROM lines GROUP BY 1, 2) SELECT doc_id, page, line_no, md5(page_text) AS page_text FROM tb JOIN pt USING (doc_id, page)")
def tables_page_text(s, d):
    """Each page with tables is read once, and what comes back in order of pages goes to its tables by position."""
    lines = ad.lines(s, d)
    tables = lines.filter("line_no % 4 < 2").select("doc_id", "page", "line_no")
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "text"))), lambda x: x["text"]), "\n")
    texts = lines.groupBy("doc_id", "page").agg(body.alias("t")).join(tables.select("doc_id", "page").distinct(), ["doc_id", "page"])
    answers = ps.numbered(texts, "doc_id", "page", name="k").select("k", F.md5("t").alias("page_text"))
    return ps.gathered_per_page(tables, answers, ["k"]).select("doc_id", "page", "line_no", "page_text")


_ACTIONS = "CASE event_id % 7 WHEN 0 THEN 'encode' WHEN 1 THEN 'save' WHEN 2 THEN 'ingest' WHEN 3 THEN 'discard' WHEN 4 THEN 'open' ELSE 'edit' END"


@query("review_states", f"""WITH RECURSIVE l AS (SELECT user_id AS file_key, {_ACTIONS} AS action, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events
), f AS (
  SELECT file_key, 0::BIGINT AS k, 'unprocessed' AS status, NULL::VARCHAR AS prior, false AS dirty FROM (SELECT DISTINCT file_key FROM l)
  UNION ALL
  SELECT l.file_key, l.k, CASE WHEN action = 'encode' THEN 'encoded' WHEN action = 'ingest' THEN 'ingested' WHEN action IN ('edit', 'save') THEN 'processing' WHEN action = 'discard' AND prior IS NOT NULL AND NOT dirty THEN prior ELSE status END,
         CASE WHEN action IN ('encode', 'ingest') THEN NULL WHEN action IN ('edit', 'save') AND status IN ('encoded', 'ingested') THEN status WHEN action = 'discard' AND NOT dirty THEN NULL ELSE prior END,
         CASE WHEN action IN ('encode', 'ingest') THEN false WHEN action = 'save' THEN true WHEN action = 'edit' AND status IN ('encoded', 'ingested') THEN false WHEN action = 'discard' AND prior IS NOT NULL THEN dirty ELSE dirty END
  FROM f JOIN l ON l.file_key = f.file_key AND l.k = f.k + 1
) SELECT file_key, arg_max(status, k) AS status FROM f GROUP BY 1""")
def review_states(s, d):
    """Events as what happens to files: a user is a file."""
    names = {0: "encode", 1: "save", 2: "ingest", 3: "discard", 4: "open"}
    action = F.lit("edit")
    for k, name in names.items():
        action = F.when(F.col("event_id") % 7 == k, name).otherwise(action)
    return mt.review_states(ad.table(s, d, "events").select(F.col("user_id").alias("file_key"), F.col("event_id").alias("entry_id"), action.alias("action")))


@query("lines_merged")
def lines_merged(s, d):
    """Lines of an order as pieces of formulas: wide ones of a row overlap."""
    lines = ad.boxes(s, d)[0].withColumn("block_no", F.lit(0)).withColumn("y0", F.floor(F.col("line_no") / 3) * 36.0)
    return rc.merged_lines(lines.withColumn("y1", F.col("y0") + 10.0))


@query("read_by_mode", f"WITH {ad.LINES}, b AS (SELECT doc_id, page, block_no, count(*) AS n, max(line_no) % 3 AS m FROM lines GROUP BY 1, 2, 3) SELECT b.doc_id, b.page, b.block_no, CASE WHEN m = 1 OR n > 2 THEN l.line_no END AS line_no FROM b JOIN lines l ON l.doc_id = b.doc_id AND l.page = b.page AND l.block_no = b.block_no WHERE (m = 1 OR n > 2) OR l.line_no = (SELECT min(line_no) FROM lines k WHERE k.doc_id = b.doc_id AND k.page = b.page AND k.block_no = b.block_no)")
def read_by_mode(s, d):
    """Blocks of every third kind, and those of more than two lines, are read line by line."""
    lines = ad.lines(s, d).select("doc_id", "page", "block_no", "line_no")
    blocks = lines.groupBy("doc_id", "page", "block_no").agg((F.max("line_no") % 3).alias("m"))
    blocks = blocks.select("doc_id", "page", "block_no", F.when(F.col("m") == 1, "Table").otherwise("Text").alias("kind"), F.lit(1.0).alias("height"), F.lit(100.0).alias("page_height"))
    none = lines.select("doc_id", "page").distinct().withColumn("share", F.lit(0.0))
    return rc.read_by_mode(blocks, lines, none, most_lines=2)


@query("table_row_batches", "WITH c AS (SELECT l_suppkey AS table_id, l_orderkey AS row_id, dense_rank() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey) AS k FROM lineitem), n AS (SELECT *, max(k) OVER (PARTITION BY table_id) AS n FROM c) SELECT table_id, batch, count(*) AS n_cells, min(row_id) AS first_row FROM (SELECT *, ((k - 1) // 60)::INT AS batch FROM n WHERE n <= 175) GROUP BY 1, 2")
def table_row_batches(s, d):
    """A supplier's orders as the rows of a table."""
    cells = ad.table(s, d, "lineitem").select(F.col("l_suppkey").alias("table_id"), F.col("l_orderkey").alias("row_id"))
    return rc.row_batches(cells).groupBy("table_id", "batch").agg(F.count("*").alias("n_cells"), F.min("row_id").alias("first_row"))
