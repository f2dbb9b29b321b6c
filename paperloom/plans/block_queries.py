"""Bound queries of the block operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from paperloom.operators import blocks as bk
from paperloom.operators import noise as nz
from paperloom.plans import adapters as ad
from paperloom.plans.queries import _CELLS, _KINDS, _cells, _kinds, query


@query("block_relabel", f"WITH {_KINDS} SELECT doc_id, pos, CASE WHEN kind = 'caption' AND x0 / 40 <= 0.5 THEN 'text' ELSE kind END AS kind FROM k")
def block_relabel(s, d):
    rules = s.sql("SELECT * FROM VALUES ('caption', 'text', 0.5D), ('nothing', 'list', 1.0D) AS t(old, new, most)")
    return bk.relabelled(_kinds(s, d).withColumn("confidence", F.col("x0") / 40), rules).select("doc_id", "pos", "kind")


@query("block_kind_counts", f"WITH {_KINDS} SELECT doc_id, kind, count(*) AS n, row_number() OVER (PARTITION BY doc_id ORDER BY count(*) DESC, kind) AS place FROM k GROUP BY 1, 2")
def block_kind_counts(s, d):
    return bk.kind_counts(_kinds(s, d)).drop("page")


@query("table_html", f"WITH {_CELLS}, r AS (SELECT table_id, row_id, '<tr>' || string_agg('<td' || CASE WHEN colspan > 1 THEN ' colspan=\"' || colspan || '\"' ELSE '' END || '>' || text || '</td>', '' ORDER BY col_id) || '</tr>' AS row FROM cl GROUP BY 1, 2) SELECT table_id, '<table><tbody>' || string_agg(row, '' ORDER BY row_id) || '</tbody></table>' AS html FROM r GROUP BY 1")
def table_html(s, d):
    return bk.html_tables(_cells(s, d).withColumn("is_header", F.lit(False)))


_DIRTY = """dirty AS (SELECT doc_id, line_no, CASE line_no % 6 WHEN 0 THEN text || ' . . . .' WHEN 1 THEN '\\mathbf{1,5}\\quad' || text WHEN 2 THEN ' . '
  WHEN 3 THEN '\\text{' || replace(text, '}', '') || '}' WHEN 4 THEN '\\mathsf{' || replace(text, '}', '') || '}' ELSE text END AS raw FROM lines)"""


def _cleaned(cell: str) -> str:
    for pattern, to in bk.CELL_RULES:
        cell = f"regexp_replace({cell}, '{pattern}', '{to.replace('$', chr(92))}', 'g')"
    return cell


@query("table_clean_cells", f"WITH {ad.LINES}, {_DIRTY} SELECT doc_id, line_no, CASE WHEN trim(raw) NOT IN ('', '.') THEN {_cleaned('trim(raw)')} END AS cell FROM dirty")
def table_clean_cells(s, d):
    n, text = F.col("line_no") % 6, F.replace("text", F.lit("}"), F.lit(""))
    raw = F.when(n == 0, F.concat("text", F.lit(" . . . ."))).when(n == 1, F.concat(F.lit("\\mathbf{1,5}\\quad"), "text")).when(n == 2, " . ").when(n == 3, F.concat(F.lit("\\text{"), text, F.lit("}"))).when(n == 4, F.concat(F.lit("\\mathsf{"), text, F.lit("}"))).otherwise(F.col("text"))
    return ad.lines(s, d).select("doc_id", "line_no", bk.clean_cell(raw).alias("cell"))


@query("html_merged_tags", "SELECT doc_id, '<b>a' || doc_id || ' c</b> <i>d</i>' AS html FROM documents")
def html_merged_tags(s, d):
    text = F.concat(F.lit("<b>a</b><b>"), F.col("doc_id").cast("string"), F.lit("</b>  <b>c</b> <i>d</i>"))
    return ad.table(s, d, "documents").select("doc_id", bk.merged_tags(text, "b").alias("html"))


@query("block_line_height", f"WITH {ad.LINES}, p AS (SELECT doc_id, page, count(*) AS n FROM lines GROUP BY 1, 2) SELECT doc_id, page, round(100.0 / n, 6) AS height FROM p")
def block_line_height(s, d):
    lines = ad.lines(s, d).withColumn("block_no", F.lit(0))
    blocks = lines.select("doc_id", "page", "block_no").distinct().withColumn("y0", F.lit(0.0)).withColumn("y1", F.lit(100.0))
    return bk.line_height(blocks, lines).select("doc_id", "page", F.round("height", 6).alias("height"))


@query("table_joined", f"WITH {_CELLS}, i AS (SELECT *, table_id // 4 AS island FROM cl), h AS (SELECT island, table_id, coalesce(sum(max(row_id) + 1) OVER (PARTITION BY island ORDER BY table_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS shift, first_value(table_id) OVER (PARTITION BY island ORDER BY table_id) AS f FROM i GROUP BY 1, 2) SELECT f AS table_id, (row_id + shift)::BIGINT AS row_id, col_id, text FROM i JOIN h USING (island, table_id)")
def table_joined(s, d):
    return bk.joined_tables(_cells(s, d).withColumn("island", F.floor(F.col("table_id") / 4)))


@query("page_notes", f"WITH {ad.LINES}, p AS (SELECT doc_id, page, arg_min(text, line_no) AS note FROM lines GROUP BY 1, 2) SELECT doc_id, string_agg('Page ' || (page + 1) || chr(10) || note, chr(10) || chr(10) ORDER BY page) AS notes FROM p GROUP BY 1")
def page_notes(s, d):
    return bk.notes(ad.lines(s, d).groupBy("doc_id", "page").agg(F.min_by("text", "line_no").alias("note")))


@query("block_widened_selection", f"WITH {_KINDS}, p AS (SELECT *, count(*) FILTER (kind = 'table') OVER w / nullif(count(*) FILTER (kind IN ('table', 'text')) OVER w, 0) AS part FROM k WINDOW w AS (PARTITION BY doc_id)) SELECT doc_id, pos, kind FROM p WHERE kind = 'table' OR (kind = 'text' AND part >= 0.5)")
def block_widened_selection(s, d):
    return bk.widened_selection(_kinds(s, d), "table", ("text",), 0.5).select("doc_id", "pos", "kind")


@query("block_accepted_rewrite", "SELECT doc_id, CASE WHEN doc_id % 3 = 2 OR length(new) < 0.6 * length(text) OR new = '' THEN text ELSE new END AS text FROM (SELECT *, trim(CASE WHEN doc_id % 3 = 1 THEN left(text, length(text) // 2) ELSE 'new ' || trim(text) END) AS new FROM documents)")
def block_accepted_rewrite(s, d):
    n = F.col("doc_id")
    new = F.when(n % 3 == 2, F.lit("No corrections needed.")).when(n % 3 == 1, F.expr("left(text, length(text) div 2)")).otherwise(F.concat(F.lit("new "), F.trim("text")))
    return ad.table(s, d, "documents").select("doc_id", bk.accepted_rewrite("text", new).alias("text"))


@query("block_reordered", f"WITH {_KINDS} SELECT doc_id, pos AS block_no, CASE WHEN doc_id % 2 = 0 THEN row_number() OVER (PARTITION BY doc_id ORDER BY pos DESC) - 1 ELSE row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 END AS place FROM k")
def block_reordered(s, d):
    rows = _kinds(s, d).select("doc_id", "page", F.col("pos").alias("block_no"))
    back = rows.groupBy("doc_id", "page").agg(F.sort_array(F.collect_list("block_no"), asc=False).alias("block_nos"))
    orders = back.withColumn("block_nos", F.when(F.col("doc_id") % 2 == 0, F.col("block_nos")).otherwise(F.array_append("block_nos", F.lit(99))))
    return bk.reordered(rows, orders).select("doc_id", "block_no", "place")


@query("block_superscripts", f"WITH {ad.LINES} SELECT doc_id, line_no, line_no % 5 = 0 AND line_no % 2 = 0 AS superscript FROM lines")
def block_superscripts(s, d):
    rows = ad.lines(s, d).withColumn("block_no", F.lit(0)).withColumn("span_no", F.col("line_no")).withColumn("text", F.when(F.col("line_no") % 2 == 0, "12) x").otherwise("word"))
    return bk.superscripts(rows).select("doc_id", "line_no", "superscript")


@query("noise_frequent_images", f"WITH {ad.LINES}, g AS (SELECT doc_id, page, length(text) % 6 AS hash FROM lines) SELECT doc_id, hash FROM (SELECT doc_id, hash, count(DISTINCT page) AS n FROM g GROUP BY 1, 2) JOIN (SELECT doc_id, count(DISTINCT page) AS p FROM g GROUP BY 1) USING (doc_id) WHERE n / p > 0.5")
def noise_frequent_images(s, d):
    rows = ad.lines(s, d).select("doc_id", "page", (F.length("text") % 6).alias("hash"))
    return nz.frequent_images(rows, rows)
