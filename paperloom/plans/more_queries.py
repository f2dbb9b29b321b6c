"""Bound queries of the Markdown, layout and routing operators, with SQL where it can say the same."""

from __future__ import annotations

from pyspark.sql import functions as F

from paperloom.functions import text as tx
from paperloom.functions.geometry import Box
from paperloom.operators import chunking as ch
from paperloom.operators import inventory as inv
from paperloom.operators import layout as ly
from paperloom.operators import markdown as md
from paperloom.operators import retrieval as rt
from paperloom.plans import adapters as ad
from paperloom.plans.queries import _KINDS, _kinds, _PAIRS, _questions, query
from paperloom.sources import files as src
from paperloom.sources import sinks

_GLYPHS = md.BULLETS
_BULLETED = f"bl AS (SELECT doc_id, line_no, ['■ ', '- ** ● ', '• ', ''][line_no % 4 + 1] || text || ['', '**', '', ''][line_no % 4 + 1] AS t FROM lines UNION ALL SELECT doc_id, -1, '- ****' FROM documents)"


@query("md_bullets", f"WITH {ad.LINES}, {_BULLETED} SELECT doc_id, line_no, CASE WHEN trim(t) <> '' AND regexp_replace(t, '[\\s*+.、,\\-{_GLYPHS}]', '', 'g') = '' THEN NULL WHEN line_no % 4 = 1 THEN regexp_replace(regexp_replace(t, '^([ \\t]*)(?:[-*+][ \\t]+)?(\\*\\*)?[ \\t]*[{_GLYPHS}]+[ \\t]*[.、,]?[ \\t]*', '\\1'), '[ \\t]*\\*\\*[ \\t]*$', '') ELSE regexp_replace(t, '^([ \\t]*)(?:[-*+][ \\t]+)?(\\*\\*)?[ \\t]*[{_GLYPHS}]+[ \\t]*[.、,]?[ \\t]*', '\\1') END AS text FROM bl")
def md_bullets(s, d):
    n = F.col("line_no")
    own = F.concat(F.when(n % 4 == 0, "■ ").when(n % 4 == 1, "- ** ● ").when(n % 4 == 2, "• ").otherwise(""), "text", F.when(n % 4 == 1, "**").otherwise(""))
    rows = ad.lines(s, d).select("doc_id", "line_no", own.alias("t")).unionByName(ad.table(s, d, "documents").select("doc_id", F.lit(-1).alias("line_no"), F.lit("- ****").alias("t")))
    return rows.select("doc_id", "line_no", md.without_bullet("t").alias("text"))


_HEADED = "hd AS (SELECT doc_id, line_no, CASE line_no % 9 WHEN 0 THEN '# a' WHEN 1 THEN '### b' WHEN 3 THEN '```' WHEN 4 THEN '## c' WHEN 6 THEN '| # d' WHEN 7 THEN '##### e' ELSE text END AS text FROM lines)"


@query("md_flat_headings", f"WITH {ad.LINES}, {_HEADED}, f AS (SELECT *, coalesce(sum(CASE WHEN text = '```' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) % 2 = 1 AS inside FROM hd) SELECT doc_id, line_no, CASE WHEN inside OR text LIKE '|%' OR text = '```' THEN text WHEN line_no % 9 IN (0, 4) THEN '### ' || substr(text, instr(text, ' ') + 1) WHEN line_no % 9 IN (1, 7) THEN '#### ' || substr(text, instr(text, ' ') + 1) ELSE text END AS text FROM f")
def md_flat_headings(s, d):
    n = F.col("line_no")
    text = F.when(n % 9 == 0, "# a").when(n % 9 == 1, "### b").when(n % 9 == 3, "```").when(n % 9 == 4, "## c").when(n % 9 == 6, "| # d").when(n % 9 == 7, "##### e").otherwise(F.col("text"))
    return md.flat_headings(ad.lines(s, d).select("doc_id", "line_no", text.alias("text")))


@query("md_title_backfill", "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'own' ELSE 'Title ' || doc_id END AS title, CASE WHEN doc_id % 3 = 0 THEN 'x' || chr(10) || '## **Title ' || doc_id || '**' || chr(10) || '## again' || chr(10) ELSE 'x' || chr(10) || '## again' || chr(10) END AS body FROM documents")
def md_title_backfill(s, d):
    pages = ad.table(s, d, "documents").select("doc_id", F.when(F.col("doc_id") % 3 == 0, "own").otherwise("").alias("title"), F.concat(F.lit("x\n## **Title "), F.col("doc_id").cast("string"), F.lit("**\n## again\n")).alias("body"))
    return md.filled_titles(pages)


@query("md_without_texts", "SELECT doc_id, replace(replace(replace(text, 'the ', ''), 'of', ''), 'e', '') AS text FROM documents")
def md_without_texts(s, d):
    return ad.table(s, d, "documents").select("doc_id", md.without_texts("text", F.array(F.lit("e"), F.lit("the "), F.lit("of"))).alias("text"))


@query("md_image_label", f"WITH {ad.MARKDOWN} SELECT doc_id, page_pos, section_idx, coalesce(h5, h4, h3, CASE WHEN len(ls) = 1 THEN ls[1] ELSE 'image' END) AS label FROM (SELECT *, list_filter(list_transform(string_split(body, chr(10)), lambda x: trim(x)), lambda x: x <> '' AND x NOT LIKE '#%') AS ls FROM sections)")
def md_image_label(s, d):
    return ch.sections(ad.markdown(s, d)).select("doc_id", "page_pos", "section_idx", md.image_label().alias("label"))


@query("md_page_groups", "SELECT doc_id, p // 3 AS part, string_agg('page ' || p, chr(10) || chr(10) ORDER BY p) AS text FROM (SELECT doc_id, unnest(range(0, 5)) AS p FROM documents) GROUP BY 1, 2")
def md_page_groups(s, d):
    pages = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(4)), lambda p: F.concat(F.lit("{"), p.cast("string"), F.lit("}" + "-" * 48 + "\n\npage "), p.cast("string"))), "")
    return md.page_groups(ad.table(s, d, "documents").select("doc_id", F.concat(F.lit("before"), pages).alias("text")), "text")


@query("md_first_heading", "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'H ' || doc_id ELSE 'doc' || doc_id END AS title FROM documents")
def md_first_heading(s, d):
    text = F.concat(F.lit("## no\n"), F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("#  H "), F.col("doc_id").cast("string"), F.lit(" \n"))).otherwise(""), F.lit("x"))
    return ad.files(s, d).select("doc_id", md.first_heading(text, F.col("stem")).alias("title"))


@query("image_edit_state", "SELECT event_type || '/' || user_id AS path, arg_max(CASE WHEN event_id % 3 = 0 THEN 'delete' ELSE 'undo' END, event_id) = 'delete' AS trashed FROM events GROUP BY 1")
def image_edit_state(s, d):
    log = ad.table(s, d, "events").select(F.col("event_id").alias("entry_id"), F.concat("event_type", F.lit("/"), "user_id").alias("path"), F.when(F.col("event_id") % 3 == 0, "delete").otherwise("undo").alias("action"))
    return md.image_edits(log)


@query("title_subtitle", f"WITH {ad.LINES}, t AS (SELECT doc_id, max(size) AS ts, 0.0 AS ty FROM lines WHERE page = 0 GROUP BY 1), r AS (SELECT l.*, ts, ty, max(l.size) OVER (PARTITION BY l.doc_id) AS second FROM lines l JOIN t USING (doc_id) WHERE page = 0 AND l.size < ts - 0.1) SELECT doc_id, arg_min(text, line_no) AS subtitle FROM r WHERE abs(size - second) < 0.1 AND y0 - ty BETWEEN 0 AND second * 5 GROUP BY 1")
def title_subtitle(s, d):
    lines = ad.lines(s, d).withColumn("span_no", F.col("line_no"))
    titles = lines.filter("page = 0").groupBy("doc_id").agg(F.max("size").alias("size")).withColumn("y1", F.lit(0.0))
    return ly.subtitles(lines, titles)


@query("layout_orphans", f"WITH {ad.BOXES}, o AS (SELECT * FROM bl WHERE block_no % 3 = 0), k AS (SELECT * FROM bl WHERE block_no % 3 <> 0), a AS (SELECT o.doc_id, o.block_no, arg_min(k.block_no, round(abs(o.x0 + o.x1 - k.x0 - k.x1) / 2 + abs(o.y0 + o.y1 - k.y0 - k.y1) / 2 * 5, 6) * 1000 + k.block_no) AS anchor FROM o LEFT JOIN k USING (doc_id) GROUP BY 1, 2), e AS (SELECT doc_id, block_no, block_no AS anchor, 0 AS late FROM k UNION ALL SELECT doc_id, block_no, anchor, 1 FROM a) SELECT doc_id, block_no, row_number() OVER (PARTITION BY doc_id ORDER BY anchor NULLS LAST, late, block_no) - 1 AS place FROM e")
def layout_orphans(s, d):
    blocks = ad.boxes(s, d)[1]
    return ly.placed_orphans(blocks.filter("block_no % 3 <> 0"), blocks.filter("block_no % 3 = 0")).select("doc_id", "block_no", "place")


@query("layout_fitted_cells", f"WITH {ad.BOXES} SELECT doc_id, b.block_no AS cell_no, least(b.x0, l.x0) AS x0, least(b.y0, l.y0) AS y0, greatest(b.x1, l.x1) AS x1, greatest(b.y1, l.y1) AS y1 FROM bl b JOIN li l USING (doc_id) WHERE l.line_no = b.block_no")
def layout_fitted_cells(s, d):
    lines, blocks = ad.boxes(s, d, dealt=True)
    return ly.fitted_cells(blocks.withColumnRenamed("block_no", "cell_no"), lines.withColumnRenamed("line_no", "cell_no")).drop("page")


@query("table_dollars", "SELECT table_id, row_id, 0 AS col_id, 'a' || row_id AS text FROM r UNION ALL SELECT table_id, row_id, 1, CASE WHEN two THEN '$' ELSE '' END || q FROM r WHERE two UNION ALL SELECT table_id, row_id, unnest([1, 2]), unnest(['$', q::VARCHAR]) FROM r WHERE NOT two".replace("FROM r", "FROM (SELECT *, count(*) OVER (PARTITION BY table_id) > 1 AS two FROM (SELECT l_orderkey AS table_id, l_linenumber AS row_id, max(l_quantity)::INT AS q FROM lineitem GROUP BY ALL))"))
def table_dollars(s, d):
    rows = ad.table(s, d, "lineitem").groupBy(F.col("l_orderkey").alias("table_id"), F.col("l_linenumber").alias("row_id")).agg(F.max("l_quantity").cast("int").cast("string").alias("q"))
    cells = F.array(F.concat(F.lit("a"), "row_id"), F.lit("$"), F.col("q"))
    return ly.merged_dollar_columns(rows.select("table_id", "row_id", F.posexplode(cells).alias("col_id", "text")).withColumn("colspan", F.lit(1)))


_RUNS = f"""WITH {_KINDS}, t AS (
  SELECT doc_id, pos // 2 AS page, pos, x0, x0 + 40 AS x1, y0, y1, pos AS n_cols, count(*) OVER (PARTITION BY doc_id, pos // 2) = 1 AS alone FROM k WHERE kind = 'table'
), p AS (
  SELECT *, lag(page) OVER w AS p_page, lag(x0) OVER w AS p_x0, lag(x1) OVER w AS p_x1, lag(y0) OVER w AS p_y0, lag(y1) OVER w AS p_y1, lag(n_cols) OVER w AS p_cols, lag(alone) OVER w AS p_alone
  FROM t WINDOW w AS (PARTITION BY doc_id ORDER BY page, pos)
), s AS (
  SELECT *, coalesce((p_page = page - 1 AND greatest(y1 - y0, p_y1 - p_y0) / 20 > 0.6 AND (alone OR p_alone))
    OR (p_page = page AND (p_y1 - p_y0) / (y1 - y0) BETWEEN 0.75 AND 1.25 AND abs(x0 - p_x1) < 20 AND abs(y0 - p_y0) < 20)
    OR (p_page = page AND abs(y0 - p_y1) < 20 AND abs(x0 - p_x0) < 20 AND abs(n_cols - p_cols) < 2), false) AS same FROM p
) SELECT doc_id, page, pos, sum(CASE WHEN same THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY page, pos)::BIGINT AS island FROM s"""


@query("table_runs", _RUNS)
def table_runs(s, d):
    rows = _kinds(s, d).filter("kind = 'table'").withColumn("x1", F.col("x0") + 40).withColumn("n_cols", F.col("pos")).withColumn("page", F.floor(F.col("pos") / 2))
    return ly.table_runs(rows, 20.0).select("doc_id", "page", "pos", "island")


@query("list_nesting", f"WITH {_KINDS}, li AS (SELECT doc_id, pos, x0 FROM k WHERE kind = 'list') SELECT i.doc_id, 0 AS group_no, i.pos, (SELECT count(*) FROM li j WHERE j.doc_id = i.doc_id AND j.pos < i.pos AND NOT EXISTS (SELECT 1 FROM li b WHERE b.doc_id = i.doc_id AND b.pos > j.pos AND b.pos <= i.pos AND b.x0 <= j.x0 + 1.0))::INT AS level FROM li i")
def list_nesting(s, d):
    return ly.nested_lists(_kinds(s, d).filter("kind = 'list'").select("doc_id", F.lit(0).alias("group_no"), "pos", F.col("x0").cast("double").alias("x0")), 100.0)


@query("order_by_offset", f"WITH {_KINDS}, o AS (SELECT doc_id, pos, CASE WHEN kind <> 'table' THEN 1000.0 - pos * 10 + q % 5 END AS off FROM k), g AS (SELECT *, last_value(off IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b, first_value(off IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS a FROM (SELECT doc_id, pos, off FROM o)) SELECT doc_id, pos, row_number() OVER (PARTITION BY doc_id ORDER BY coalesce(off, b, a - 0.5, 0.0), off IS NULL, pos) - 1 AS place FROM g".replace("kind <> 'table' THEN 1000.0 - pos * 10 + q % 5", "kind <> 'table' THEN 1000.0 - pos * 10 + x0 / 10"))
def order_by_offset(s, d):
    rows = _kinds(s, d).withColumn("offset", F.when(F.col("kind") != "table", 1000.0 - F.col("pos") * 10 + F.col("x0") / 10))
    return ly.ordered_by_offset(rows).select("doc_id", "pos", "place")


@query("footnotes_last", f"WITH {_KINDS} SELECT doc_id, pos, row_number() OVER (PARTITION BY doc_id ORDER BY CASE kind WHEN 'table' THEN 0 WHEN 'caption' THEN 2 ELSE 1 END, pos) - 1 AS place FROM k")
def footnotes_last(s, d):
    rows = _kinds(s, d).withColumn("kind", F.when(F.col("kind") == "table", "header").when(F.col("kind") == "caption", "footnote").otherwise(F.col("kind")))
    return ly.footnotes_last(rows).select("doc_id", "pos", "place")


@query("page_toc", f"WITH {ad.MARKDOWN} SELECT doc_id, page_pos AS page, line_no AS pos, title FROM marked WHERE level IS NOT NULL")
def page_toc(s, d):
    rows = ch.with_heading_path(ad.markdown(s, d), ["doc_id", "page_pos"], ["line_no"])
    blocks = rows.select("doc_id", F.col("page_pos").alias("page"), F.col("line_no").alias("pos"), F.when(F.col("level").isNotNull(), "heading").otherwise("text").alias("kind"), F.coalesce("title", "text").alias("text"), F.lit(0.0).alias("y0"))
    return ly.table_of_contents(blocks).drop("y0")


@query("dehyphenation", f"WITH {ad.LINES}, h AS (SELECT *, CASE WHEN line_no % 3 = 0 THEN 'ab-' WHEN line_no % 3 = 1 THEN 'cd' ELSE 'Ef-' END AS t FROM lines), j AS (SELECT *, CASE WHEN t LIKE '%-' AND regexp_matches(lead(t) OVER (PARTITION BY doc_id, page ORDER BY line_no), '^\\s?\\p{{Ll}}') THEN left(t, length(t) - 1) ELSE t || ' ' END AS piece FROM h) SELECT doc_id, page, trim(string_agg(piece, '' ORDER BY line_no)) AS text FROM j GROUP BY 1, 2")
def dehyphenation(s, d):
    n = F.col("line_no")
    return ly.dehyphenated(ad.lines(s, d).withColumn("text", F.when(n % 3 == 0, "ab-").when(n % 3 == 1, "cd").otherwise("Ef-")))


@query("code_lines", f"WITH {ad.LINES}, c AS (SELECT *, sum((x1 - x0)::DOUBLE) OVER w / greatest(sum(length(text)) OVER w, 1) AS width, min(x0) OVER w AS edge FROM lines WINDOW w AS (PARTITION BY doc_id, page)) SELECT doc_id, page, string_agg(repeat(' ', floor((x0 - edge)::DOUBLE / greatest(width, 0.001))::INT) || text, chr(10) ORDER BY line_no) AS text FROM c GROUP BY 1, 2")
def code_lines(s, d):
    return ly.code_lines(ad.lines(s, d))


@query("geom_scalars", f"WITH {ad.BOXES} SELECT li.doc_id, line_no, round((li.x1 - li.x0) * (li.y1 - li.y0), 6) AS area, round(sqrt(pow(greatest(0, bl.x0 - li.x1, li.x0 - bl.x1), 2) + pow(greatest(0, bl.y0 - li.y1, li.y0 - bl.y1), 2)), 6) AS gap, floor(li.x0 * 1000 / 200)::INT AS nx0 FROM li JOIN bl ON li.doc_id = bl.doc_id AND line_no = block_no")
def geom_scalars(s, d):
    lines, blocks = ad.boxes(s, d)
    pairs = ly.side(lines, "a_", "line_no").join(ly.side(blocks, "b_", "block_no"), ly.PAGE).filter("a_id = b_id")
    a, b = Box.of("a_"), Box.of("b_")
    return pairs.select("doc_id", F.col("a_id").alias("line_no"), F.round(a.area, 6).alias("area"), F.round(a.gap(b), 6).alias("gap"), a.normalised(200, 200)[0].alias("nx0"))


@query("search_reranked", f"WITH {_PAIRS}, t AS (SELECT query_id, vec_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM pr QUALIFY rank <= 10) SELECT query_id, vec_id, rank, (vec_id * 7919 % 101)::DOUBLE AS score FROM t QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY vec_id * 7919 % 101 DESC, vec_id) <= 3")
def search_reranked(s, d):
    top = rt.dense_top_k_each(ad.table(s, d, "embeddings"), _questions(s, d), 10)
    return rt.reranked_each(top, (F.col("vec_id") * 7919 % 101).cast("double"), "vec_id")


def _routed(s, d):
    """Every question is a comparison; by its id it names two known labels and an unknown one, a single one, or none."""
    third = F.floor(F.col("query_id") / 20) % 3
    some = lambda *names: F.array(*map(F.lit, names)) if names else F.array().cast("array<string>")
    asked = _questions(s, d).select("query_id", F.lit("compare").alias("intent"), F.when(third == 0, some("l1", "l2", "l9x")).when(third == 1, some("l3")).otherwise(some()).alias("entities"), F.when(third == 0, some("l1", "l2", "l3")).when(third == 1, some("l3")).otherwise(some()).alias("only"))
    named = ad.table(s, d, "embeddings").withColumn("entity", F.concat(F.lit("l"), "label"))
    best = rt.dense_top_k_each(named, _questions(s, d), 5, by="entity")
    return rt.route_and_search_each(best, rt.routes(asked), 5, 2, "entity", "vec_id").select("query_id", "entity", "vec_id", "rank", "intent")


@query("route_compare", f"WITH {_PAIRS} SELECT query_id, 'l' || label AS entity, vec_id, row_number() OVER (PARTITION BY query_id, label ORDER BY score DESC, vec_id) AS rank, 'compare' AS intent FROM pr WHERE label IN (1, 2) AND query_id // 20 % 3 = 0 QUALIFY rank <= 2")
def route_compare(s, d):
    return _routed(s, d).filter("intent = 'compare'")


@query("route_fact", f"WITH {_PAIRS} SELECT query_id, 'l' || label AS entity, vec_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank, 'fact' AS intent FROM pr WHERE query_id // 20 % 3 = 2 OR (query_id // 20 % 3 = 1 AND label = 3) QUALIFY rank <= 5")
def route_fact(s, d):
    return _routed(s, d).filter("intent = 'fact'")


@query("inv_located", f"WITH {ad.SNAPSHOTS}, r AS (SELECT CASE WHEN doc_id % 2 = 0 THEN file_key ELSE lang || '/renamed/' || stem || '.md' END AS ref, lang, stem FROM files) SELECT ref, coalesce(s.file_key, n.file_key) AS file_key FROM r LEFT JOIN new_files s ON s.file_key = r.ref LEFT JOIN new_files n ON n.lang = r.lang AND n.stem = r.stem")
def inv_located(s, d):
    files = ad.files(s, d)
    refs = files.select(F.when(F.col("doc_id") % 2 == 0, F.col("file_key")).otherwise(F.concat("lang", F.lit("/renamed/"), "stem", F.lit(".md"))).alias("ref"))
    return inv.located(refs, ad.new_files(s, d))


@query("images_saved", f"WITH {ad.LINES} SELECT doc_id, line_no AS seq, 'p_' || first_value(page) OVER w || '_' || first_value(line_no) OVER w AS saved_as, row_number() OVER w = 1 AS is_new FROM lines WINDOW w AS (PARTITION BY doc_id, length(text) % 4 ORDER BY page, line_no)")
def images_saved(s, d):
    rows = ad.lines(s, d).select("doc_id", "page", F.col("line_no").alias("seq"), (F.length("text") % 4).alias("hash"))
    return inv.saved_images(rows).select("doc_id", "seq", "saved_as", "is_new")


@query("images_elsewhere", f"WITH {ad.LINES}, p AS (SELECT doc_id, page, line_no, length(text) % 40 AS path FROM lines) SELECT doc_id, line_no FROM p WHERE EXISTS (SELECT 1 FROM p o WHERE o.doc_id = p.doc_id AND o.path = p.path AND o.page <> p.page)")
def images_elsewhere(s, d):
    rows = ad.lines(s, d).select("doc_id", "page", "line_no", (F.length("text") % 40).alias("path"))
    return inv.used_elsewhere(rows).select("doc_id", "line_no")


@query("page_ranges", "SELECT doc_id, array_to_string(list_sort(list_distinct(list_concat([doc_id % 9], range(doc_id % 5, doc_id % 5 + 3)))), ',') AS pages FROM documents")
def page_ranges(s, d):
    n = F.col("doc_id")
    text = F.concat((n % 9).cast("string"), F.lit(", "), (n % 5).cast("string"), F.lit("-"), (n % 5 + 2).cast("string"))
    return ad.table(s, d, "documents").select("doc_id", F.array_join(src.page_numbers(text), ",").alias("pages"))


@query("reader_dispatch", "SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'pdf' WHEN doc_id % 3 = 0 THEN 'image' WHEN doc_id % 3 = 1 THEN 'docx' ELSE 'pdf' END AS reader FROM documents")
def reader_dispatch(s, d):
    n = F.col("doc_id")
    path = F.concat(F.lit("a/b"), n.cast("string"), F.when(n % 3 == 0, ".PNG").when(n % 3 == 1, ".docx").otherwise(".xyz"))
    head = F.when(n % 5 == 0, F.unhex(F.lit("255044462D"))).otherwise(F.unhex(F.lit("00000000")))
    return ad.table(s, d, "documents").select("doc_id", src.reader_of(path, head).alias("reader"))


_ONE_SPACE = "text"
for _c in tx.SPACES:
    _ONE_SPACE = f"replace({_ONE_SPACE}, chr({ord(_c)}), ' ')"


@query("text_cleaning", f"SELECT doc_id, {_ONE_SPACE} AS spaced, regexp_replace('<p>' || text || '</p>', '<[^>]*>', '', 'g') AS plain, 'a_' || doc_id AS asked FROM documents")
def text_cleaning(s, d):
    rows = ad.table(s, d, "documents")
    return rows.select("doc_id", tx.one_space("text").alias("spaced"), tx.strip_tags(F.concat(F.lit("<p>"), "text", F.lit("</p>"))).alias("plain"), F.concat(tx.attribute_question(F.lit("a_cm")), F.lit("_"), F.col("doc_id").cast("string")).alias("asked"))


@query("fragments_rendered", f"WITH {ad.LINES} SELECT doc_id, page, '## 第 ' || (page + 1) || ' 頁' || chr(10) || chr(10) || '### T' || chr(10) || chr(10) || arg_min(text, line_no) AS md FROM lines GROUP BY 1, 2")
def fragments_rendered(s, d):
    rows = ad.lines(s, d).groupBy("doc_id", "page").agg(F.min_by("text", "line_no").alias("body"))
    return sinks.rendered_pages(rows.withColumn("title", F.lit("T")).withColumn("subtitle", F.lit("")))
