"""A bound query for each operator over the test tables, with SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from paperloom.functions import text as tx
from paperloom.operators import attributes as at
from paperloom.operators import chunking as ch
from paperloom.operators import inventory as inv
from paperloom.operators import layout as ly
from paperloom.operators import maintenance as mt
from paperloom.operators import noise as nz
from paperloom.operators import retrieval as rt
from paperloom.operators import sessions as ss
from paperloom.operators import vector_index as vi
from paperloom.operators.shares import shared_out
from paperloom.plans import adapters as ad
from paperloom.sources import files as src
from paperloom.sources import sinks
from paperloom.sources.scratch import written

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def put(fn: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = fn
        if sql:
            SQL[name] = sql
        return fn

    return put


# --- inventory


@query("inv_by_type", "SELECT lang, count(*) AS n_files, sum(n_chars)::BIGINT AS bytes FROM documents GROUP BY lang")
def inv_by_type(s, d):
    return inv.totals(ad.files(s, d), "lang")


@query("inv_by_folder_pct", "SELECT coalesce(source, 'TOTAL') AS source, count(*) AS n_files, sum(n_chars)::BIGINT AS bytes, round(sum(n_chars) * 100.0 / (SELECT sum(n_chars) FROM documents), 4) AS pct, floor(sum(n_chars) / count(*))::BIGINT AS mean_bytes FROM documents GROUP BY ROLLUP (source)")
def inv_by_folder_pct(s, d):
    return inv.totals_with_share(ad.files(s, d), "source")


@query("inv_top_files", f"WITH {ad.FILES} SELECT file_key, size FROM files ORDER BY size DESC, file_key DESC LIMIT 20")
def inv_top_files(s, d):
    return inv.largest(ad.files(s, d).select("file_key", "size"), 20)


@query("inv_diff_path", f"WITH {ad.SNAPSHOTS} SELECT coalesce(o.file_key, n.file_key) AS file_key, CASE WHEN o.file_key IS NULL THEN 'added' WHEN n.file_key IS NULL THEN 'lost' ELSE 'modified' END AS change FROM old_files o FULL JOIN new_files n ON o.file_key = n.file_key WHERE o.file_key IS NULL OR n.file_key IS NULL OR o.mtime <> n.mtime")
def inv_diff_path(s, d):
    return inv.diff_by_path(ad.old_files(s, d), ad.new_files(s, d))


@query("inv_diff_stem", f"WITH {ad.SNAPSHOTS} SELECT coalesce(o.stem, n.stem) AS stem, o.file_key AS old_key, n.file_key AS new_key, CASE WHEN n.stem IS NULL THEN 'disappeared' WHEN o.stem IS NULL THEN CASE WHEN n.doc_id % 4 = 0 THEN 'new_with_output' ELSE 'new_without_output' END WHEN o.file_key = n.file_key THEN 'unchanged' ELSE 'moved' END AS state FROM old_files o FULL JOIN new_files n ON o.stem = n.stem")
def inv_diff_stem(s, d):
    return inv.diff_by_stem(ad.old_files(s, d), ad.new_files(s, d), ad.files(s, d).filter("doc_id % 4 = 0"))


@query("inv_status_carry", f"WITH {ad.SNAPSHOTS} SELECT n.file_key, CASE WHEN o.mtime = n.mtime THEN o.status ELSE 'unprocessed' END AS status FROM new_files n LEFT JOIN old_files o ON o.file_key = n.file_key")
def inv_status_carry(s, d):
    return inv.carried_status(ad.new_files(s, d), ad.old_files(s, d)).select("file_key", "status")


_HASH = f"WITH {ad.SNAPSHOTS}, dk AS (SELECT file_hash, max(file_key) AS disk_key FROM new_files GROUP BY 1), ix AS (SELECT file_hash, max(file_key) AS index_key FROM old_files GROUP BY 1), m AS (SELECT coalesce(dk.file_hash, ix.file_hash) AS file_hash, disk_key, index_key, CASE WHEN index_key IS NULL THEN 'missing' WHEN disk_key IS NULL THEN 'orphan' WHEN disk_key = index_key THEN 'same' ELSE 'moved' END AS state FROM dk FULL JOIN ix ON dk.file_hash = ix.file_hash)"


@query("inv_hash_moved", f"{_HASH} SELECT * FROM m")
def inv_hash_moved(s, d):
    return inv.matched_by_hash(ad.new_files(s, d), ad.old_files(s, d))


@query("inv_hash_orphans", f"WITH {ad.SNAPSHOTS} SELECT file_key, file_hash FROM old_files WHERE file_hash NOT IN (SELECT file_hash FROM new_files)")
def inv_hash_orphans(s, d):
    return inv.without_partner(ad.old_files(s, d), ad.new_files(s, d), "file_hash").select("file_key", "file_hash")


@query("inv_processed", f"WITH {ad.SNAPSHOTS} SELECT DISTINCT file_key FROM new_files WHERE stem IN (SELECT stem FROM files WHERE doc_id % 4 = 0) ORDER BY 1")
def inv_processed(s, d):
    return inv.processed(ad.new_files(s, d), ad.files(s, d).filter("doc_id % 4 = 0"))


_PART = "(('0x' || substr(md5({}::VARCHAR), 1, 8))::BIGINT % ceil(n / 40)::BIGINT)::INT"


@query("inv_collisions", f"WITH {ad.FILES}, p AS (SELECT *, count(*) OVER (PARTITION BY file_hash) AS n FROM files) SELECT file_hash AS key, n, {_PART.format('file_key')} AS part, string_agg(file_key, '|' ORDER BY file_key) AS items FROM p WHERE n > 1 GROUP BY 1, 2, 3")
def inv_collisions(s, d):
    return inv.collisions(ad.files(s, d), F.col("file_hash"), "file_key", 40)


@query("inv_tail_or_stem_match", f"WITH {ad.SNAPSHOTS}, t AS (SELECT source || '/' || stem || '.md' AS tail, max(file_key) AS by_tail FROM new_files GROUP BY 1), st AS (SELECT stem, count(*) AS n, min(file_key) AS by_stem FROM new_files GROUP BY 1) SELECT file_key, coalesce(by_tail, CASE WHEN n = 1 THEN by_stem END) AS new_key, CASE WHEN by_tail IS NOT NULL THEN 'tail' WHEN n = 1 THEN 'stem' WHEN n > 1 THEN 'ambiguous' ELSE 'orphan' END AS how FROM old_files o LEFT JOIN t ON t.tail = o.source || '/' || o.stem || '.md' LEFT JOIN st ON st.stem = o.stem")
def inv_tail_or_stem_match(s, d):
    return inv.matched_by_tail_or_stem(ad.old_files(s, d), ad.new_files(s, d))


@query("inv_transitions", f"WITH {ad.SNAPSHOTS} SELECT o.status AS old_value, n.lang AS new_value, count(*) AS n FROM old_files o JOIN new_files n USING (doc_id) GROUP BY 1, 2")
def inv_transitions(s, d):
    both = ad.old_files(s, d).select("doc_id", "status").join(ad.new_files(s, d).select("doc_id", "lang"), "doc_id")
    return inv.transitions(both, "status", "lang")


@query("inv_ids_by_file", f"WITH {ad.FILES}, p AS (SELECT lang || '/' || source AS file, lpad(doc_id::VARCHAR, 9, '0') AS item, count(*) OVER w AS n, first_value(file_hash) OVER (w ORDER BY doc_id) AS source FROM files WINDOW w AS (PARTITION BY lang || '/' || source)) SELECT file, n, {_PART.format('item')} AS part, source, string_agg(item, ',' ORDER BY item) AS items FROM p GROUP BY 1, 2, 3, 4")
def inv_ids_by_file(s, d):
    rows = ad.files(s, d).select(F.concat("lang", F.lit("/"), "source").alias("file"), F.lpad(F.col("doc_id").cast("string"), 9, "0").alias("item"), "file_hash", "doc_id")
    return inv.ids_by_file(rows, "file", "item", "file_hash", "doc_id", 40)


@query("inv_folders", f"WITH {ad.FILES} SELECT DISTINCT lang AS folder, 1 AS depth FROM files UNION SELECT DISTINCT lang || '/' || source, 2 FROM files")
def inv_folders(s, d):
    return inv.folders(ad.files(s, d))


@query("inv_estimate", f"WITH {ad.FILES} SELECT lang AS folder, count(*) AS n_files, sum(size)::BIGINT AS bytes, count(*) * 30 AS seconds FROM files GROUP BY 1")
def inv_estimate(s, d):
    return inv.processing_estimate(ad.files(s, d), {".md": 30, ".mp4": 1800})


@query("inv_trash_names", "SELECT file_key, CASE WHEN k = 1 THEN base ELSE base || '__' || (k - 1) END AS trash_name FROM (SELECT *, row_number() OVER (PARTITION BY base ORDER BY file_key) AS k FROM (SELECT doc_id || '/' || (doc_id % 20) || '.md' AS file_key, (doc_id % 20) || '.md' AS base FROM documents))")
def inv_trash_names(s, d):
    rows = ad.files(s, d).select(F.concat(F.col("doc_id").cast("string"), F.lit("/"), (F.col("doc_id") % 20).cast("string"), F.lit(".md")).alias("file_key"))
    return inv.trashed_names(rows)


@query("facet_values", "SELECT DISTINCT source AS value FROM documents WHERE coalesce(source, '') <> '' ORDER BY 1 LIMIT 1000")
def facet_values(s, d):
    return inv.distinct_values(ad.files(s, d), "source")


@query("facet_counts", "SELECT lang AS value, count(*) AS n FROM documents GROUP BY 1")
def facet_counts(s, d):
    return inv.value_counts(ad.files(s, d), "lang")


@query("facet_dependent", "SELECT DISTINCT source AS value FROM documents WHERE lang = 'de' AND coalesce(source, '') <> '' ORDER BY 1 LIMIT 1000")
def facet_dependent(s, d):
    return inv.distinct_values(ad.files(s, d), "source", F.col("lang") == "de")


@query("facet_two_levels", "SELECT lang, count(DISTINCT source) AS n_projects, count(DISTINCT source || '/' || doc_id) AS n_files FROM documents GROUP BY 1")
def facet_two_levels(s, d):
    return ad.files(s, d).groupBy("lang").agg(F.countDistinct("source").alias("n_projects"), F.countDistinct("source", "doc_id").alias("n_files"))


@query("status_hist_zero", "SELECT v.value, count(e.event_type) AS n FROM (VALUES ('click'), ('error'), ('purchase'), ('signup'), ('view'), ('refund')) v(value) LEFT JOIN events e ON e.event_type = v.value GROUP BY 1")
def status_hist_zero(s, d):
    domain = s.sql("SELECT * FROM VALUES ('click'), ('error'), ('purchase'), ('signup'), ('view'), ('refund') AS t(value)")
    return inv.zero_filled(ad.table(s, d, "events"), "event_type", domain)


@query("key_project_doctype", f"WITH {ad.FILES} SELECT file_key, source AS project, CASE lang WHEN 'de' THEN 'german' ELSE lang END AS doc_type, stem AS file_stem, '.md' AS ext FROM files")
def key_project_doctype(s, d):
    return ad.files(s, d).select("file_key", tx.project_of("file_key").alias("project"), tx.doc_type_of("file_key", names={"de": "german"}).alias("doc_type"), tx.stem_of("file_key").alias("file_stem"), tx.extension_of("file_key").alias("ext"))


@query("human_sizes", "SELECT doc_id, CASE WHEN n < 1024 THEN printf('%.2f B', n) WHEN n < 1048576 THEN printf('%.2f KB', n / 1024.0) ELSE printf('%.2f MB', n / 1048576.0) END AS size_text FROM (SELECT doc_id, n_chars * 97.0 AS n FROM documents)")
def human_sizes(s, d):
    return ad.files(s, d).select("doc_id", tx.human_size(F.col("size") * 97).alias("size_text"))


@query("human_times", "SELECT doc_id, array_to_string(list_filter([CASE WHEN t // 86400 > 0 THEN (t // 86400) || 'd' END, CASE WHEN t % 86400 // 3600 > 0 THEN (t % 86400 // 3600) || 'h' END, CASE WHEN t % 3600 // 60 > 0 THEN (t % 3600 // 60) || 'm' END, CASE WHEN t % 60 > 0 THEN (t % 60) || 's' END], lambda x: x IS NOT NULL), ' ') AS time_text FROM (SELECT doc_id, n_chars * 37 AS t FROM documents)")
def human_times(s, d):
    return ad.files(s, d).select("doc_id", tx.human_time(F.col("size") * 37).alias("time_text"))


# --- Markdown and chunks

_CUT = ad.MARKDOWN


@query("chunk_breadcrumb", f"WITH {_CUT} SELECT doc_id, page_pos, line_no, concat_ws(' > ', h3, h4, h5) AS path FROM pathed")
def chunk_breadcrumb(s, d):
    rows = ch.with_heading_path(ad.markdown(s, d), ["doc_id", "page_pos"], ["line_no"])
    return rows.select("doc_id", "page_pos", "line_no", ch.heading_path().alias("path"))


@query("chunk_split", f"WITH {_CUT} SELECT doc_id, page_pos, section_idx, concat_ws(' > ', h3, h4, h5) AS path, body FROM sections")
def chunk_split(s, d):
    return ch.sections(ad.markdown(s, d)).select("doc_id", "page_pos", "section_idx", ch.heading_path().alias("path"), "body")


_DEMOTE = f"""WITH {_CUT}, dp AS (
  SELECT *, CASE WHEN h5 IS NOT NULL THEN 5 WHEN h4 IS NOT NULL THEN 4 WHEN h3 IS NOT NULL THEN 3 ELSE 0 END AS depth FROM sections
), dm AS (
  SELECT *, depth > 0 AND body = '' AND NOT EXISTS (
    SELECT 1 FROM dp o WHERE o.doc_id = dp.doc_id AND o.page_pos = dp.page_pos AND o.depth > dp.depth
      AND (dp.h3 IS NULL OR o.h3 IS NOT DISTINCT FROM dp.h3) AND (dp.h4 IS NULL OR o.h4 IS NOT DISTINCT FROM dp.h4)) AS lone
  FROM dp
), d2 AS (
  SELECT doc_id, page_pos, page_num, section_idx,
         CASE WHEN lone THEN CASE depth WHEN 5 THEN h5 WHEN 4 THEN h4 ELSE h3 END ELSE body END AS body,
         CASE WHEN lone AND depth = 3 THEN NULL ELSE h3 END AS h3, CASE WHEN lone AND depth = 4 THEN NULL ELSE h4 END AS h4,
         CASE WHEN lone AND depth = 5 THEN NULL ELSE h5 END AS h5 FROM dm
), d3 AS (
  SELECT *, CASE WHEN row_number() OVER w = 1 OR concat_ws('|', coalesce(h3, '~'), coalesce(h4, '~'), coalesce(h5, '~')) <>
    lag(concat_ws('|', coalesce(h3, '~'), coalesce(h4, '~'), coalesce(h5, '~'))) OVER w THEN 1 ELSE 0 END AS st
  FROM d2 WINDOW w AS (PARTITION BY doc_id, page_pos ORDER BY section_idx)
), d4 AS (
  SELECT *, sum(st) OVER (PARTITION BY doc_id, page_pos ORDER BY section_idx) AS island FROM d3
), merged AS (
  SELECT doc_id, page_pos, page_num, island - 1 AS section_idx, any_value(h3) AS h3, any_value(h4) AS h4, any_value(h5) AS h5,
         coalesce(string_agg(body, chr(10) ORDER BY section_idx) FILTER (body <> ''), '') AS body
  FROM d4 GROUP BY doc_id, page_pos, page_num, island
)"""


@query("chunk_demote", f"{_DEMOTE} SELECT doc_id, page_pos, section_idx::BIGINT AS section_idx, concat_ws(' > ', h3, h4, h5) AS path, body FROM merged")
def chunk_demote(s, d):
    return ch.demoted(ch.sections(ad.markdown(s, d))).select("doc_id", "page_pos", "section_idx", ch.heading_path().alias("path"), "body")


_CHUNKS = (
    _DEMOTE
    + """, ck AS (
  SELECT m.*, p - 1 AS chunk_idx, trim(pieces[p]) AS text FROM (
    SELECT *, unnest(range(1, len(pieces) + 1)) AS p FROM (
      SELECT *, list_filter(list_transform(string_split(body, '. '), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> '') AS pieces FROM merged)) m
)"""
)


def _chunks(s, d, where=None):
    return ch.chunks(ch.demoted(ch.sections(ad.markdown(s, d, where))), ". ")


@query("chunk_pieces", f"{_CHUNKS} SELECT doc_id, page_pos, section_idx::BIGINT AS section_idx, chunk_idx, text FROM ck")
def chunk_pieces(s, d):
    return _chunks(s, d).select("doc_id", "page_pos", "section_idx", "chunk_idx", "text")


_UUID = """lower(substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' ||
  substr('89ab89ab89ab89ab', 1 + CAST('0x' || substr(h, 17, 1) AS INTEGER), 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12))"""
_IDS = (
    _CHUNKS
    + f""", named AS (
  SELECT *, sha1(unhex('{tx.NAMESPACE_DNS}') || encode(file_hash || '|' || page_num || '|' || section_idx::BIGINT || '|' || chunk_idx)) AS h
  FROM ck JOIN files USING (doc_id)
)"""
).replace("WITH lines AS", f"WITH {ad.FILES}, lines AS", 1)


@query("chunk_ids", f"{_IDS} SELECT doc_id, page_pos, section_idx::BIGINT AS section_idx, chunk_idx, {_UUID} AS chunk_id FROM named")
def chunk_ids(s, d):
    return ch.with_ids(_chunks(s, d), ad.files(s, d)).select("doc_id", "page_pos", "section_idx", "chunk_idx", "chunk_id")


@query("chunk_links", f"{_IDS}, u AS (SELECT *, {_UUID} AS id FROM named) SELECT id AS chunk_id, row_number() OVER w - 1 AS chunk_idx_global, lag(id) OVER w AS prev_chunk_id, lead(id) OVER w AS next_chunk_id, '[' || concat_ws(' | ', source, stem, 'P' || page_num, nullif(concat_ws(' > ', h3, h4, h5), '')) || '] ' || text AS text_with_prefix FROM u WINDOW w AS (PARTITION BY doc_id ORDER BY page_pos, section_idx, chunk_idx)")
def chunk_links(s, d):
    return ch.with_ids(_chunks(s, d), ad.files(s, d)).select("chunk_id", "chunk_idx_global", "prev_chunk_id", "next_chunk_id", "text_with_prefix")


@query("chunk_payload", f"{_IDS}, u AS (SELECT *, {_UUID} AS id FROM named) SELECT id, stem AS file_name, page_num AS page, concat_ws('/', h3, h4, h5) AS breadcrumb, coalesce(h5, h4, h3) AS header, length(text) AS chars, lag(id) OVER (PARTITION BY doc_id ORDER BY page_pos, section_idx, chunk_idx) AS prev_id, false AS has_image FROM u")
def chunk_payload(s, d):
    rows = ch.payload(ch.with_ids(_chunks(s, d), ad.files(s, d)))
    place, shown = "payload.metadata.location", {"file_name": "payload.metadata.source.file_name", "page": "payload.metadata.location.page", "header": "payload.metadata.location.current_header", "chars": "payload.content.char_count", "prev_id": "payload.chunking.prev_chunk_id", "has_image": "payload.visuals.has_image"}
    return rows.select("id", F.array_join(f"{place}.breadcrumb", "/").alias("breadcrumb"), *(F.col(c).alias(n) for n, c in shown.items()))


@query("md_parse", "SELECT doc_id, 0 AS page_pos, 7 AS page_num, 'a' || doc_id AS md FROM documents UNION ALL SELECT doc_id, 1, 8, 'b' || lang FROM documents")
def md_parse(s, d):
    docs = ad.table(s, d, "documents").select("doc_id", F.concat(F.lit("head\n## 第 7 頁\na"), F.col("doc_id").cast("string"), F.lit("\n---\n## 第 8 頁\nb"), "lang").alias("text"))
    return ch.split_pages(docs)


@query("pages_stitched", f"WITH {ad.LINES}, pg AS (SELECT doc_id, page, '## 第 ' || (page + 1) || ' 頁' || chr(10) || chr(10) || string_agg(text, chr(10) ORDER BY line_no) AS md FROM lines GROUP BY 1, 2) SELECT doc_id, '# doc' || doc_id || chr(10) || chr(10) || string_agg(md, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY page) || chr(10) AS md FROM pg GROUP BY doc_id")
def pages_stitched(s, d):
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "text"))), lambda x: x["text"]), "\n")
    pages = ad.lines(s, d).groupBy("doc_id", "page").agg(body.alias("body")).withColumn("title", F.lit(None).cast("string")).withColumn("subtitle", F.lit(""))
    return sinks.stitched(sinks.rendered_pages(pages), F.concat(F.lit("doc"), F.col("doc_id").cast("string")))


_RUNS = "len(regexp_extract_all(text, '{0}'))"
_WHITE = "[\\x09-\\x0d\\x1c-\\x20\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]+"


def broken_sql(source: str, keys: str) -> str:
    """``keys, bad`` of a table with ``text``, by the rules of ``text.quality_issue``."""
    lengths = f"length(text) AS n, {_RUNS.format(_WHITE)} AS sp, length(regexp_replace(text, '{_WHITE}', '', 'g')) AS nsp, {_RUNS.format(chr(92) + 'n+')} AS nl, length(replace(text, chr(10), '')) AS nnl, length(replace(replace(text, chr(10), ''), ' ', '')) AS dense, length(text) - length(regexp_replace(text, '[\\p{{L}}\\p{{N}}]', '', 'g')) AS al, length(text) - length(replace(text, chr(65533), '')) AS inv"
    return f"SELECT {keys}, n = 0 OR sp / (sp + nsp) > 0.7 OR nl / (nl + nnl) > 0.6 OR coalesce(al / nullif(dense, 0), 1) < 0.3 OR inv > greatest(6.0, n * 0.03) AS bad FROM (SELECT *, {lengths} FROM {source})"


@query("text_quality_gate", broken_sql("documents", "doc_id"))
def text_quality_gate(s, d):
    return ad.table(s, d, "documents").select("doc_id", tx.quality_issue("text").alias("bad"))


# --- noise

_EDGES = f"""WITH {ad.LINES}, fl AS (
  SELECT doc_id, page, arg_min(text, block_no) AS f, arg_max(text, block_no) AS l FROM lines GROUP BY 1, 2
), e AS (
  SELECT doc_id, page, edge, regexp_replace(regexp_replace(regexp_replace(t, '^\\s+|\\s+$', '', 'g'), '^\\d+\\s*', ''), '\\s*\\d+$', '') AS text
  FROM (SELECT doc_id, page, 'first' AS edge, f AS t FROM fl UNION ALL SELECT doc_id, page, 'last', l FROM fl)
), il AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id, edge ORDER BY page) - row_number() OVER (PARTITION BY doc_id, edge, text ORDER BY page) AS island FROM e
), runs AS (SELECT doc_id, edge, text, island, count(*) AS run FROM il GROUP BY ALL
), cnt AS (SELECT doc_id, edge, text, sum(run)::BIGINT AS n, max(run) AS streak FROM runs GROUP BY ALL
), com AS (
  SELECT c.* FROM cnt c JOIN (SELECT doc_id, edge, sum(n) AS n_pages FROM cnt GROUP BY ALL) p USING (doc_id, edge)
  WHERE n_pages >= 3 AND n > 3 AND (n >= n_pages * 0.2 OR streak >= 3))"""


@query("noise_running_lines", f"{_EDGES} SELECT doc_id, edge, text, n, streak FROM com")
def noise_running_lines(s, d):
    return nz.common_edges(nz.edge_blocks(ad.lines(s, d)))


@query("noise_ignored_edges")
def noise_ignored_edges(s, d):
    return nz.ignored_edges(nz.edge_blocks(ad.lines(s, d)))


@query("noise_adjacent_page", f"WITH {ad.LINES}, o AS (SELECT *, regexp_replace(text, '\\s+', '', 'g') AS norm_text FROM lines), k AS (SELECT * FROM o WHERE length(norm_text) >= 2), l AS (SELECT doc_id, page + 1 AS page, norm_text, arg_max(x0, block_no) AS bx, arg_max(y0, block_no) AS b_y FROM k GROUP BY 1, 2, 3) SELECT doc_id, page, line_no, norm_text FROM k JOIN l USING (doc_id, page, norm_text) WHERE abs(x0 - bx) / 100.0 <= 0.02 AND abs(y0 - b_y) / 100.0 <= 0.02")
def noise_adjacent_page(s, d):
    return nz.repeated_on_next_page(ad.lines(s, d), ad.PAGE_WIDTH, ad.PAGE_HEIGHT).select("doc_id", "page", "line_no", "norm_text")


@query("noise_page_numbers", f"WITH {ad.LINES} SELECT doc_id, line_no, (line_no % 5 IN (0, 4)) AND line_no % 3 <> 1 AS noise FROM lines")
def noise_page_numbers(s, d):
    n = F.col("line_no")
    rows = ad.lines(s, d).withColumn("text", F.when(n % 3 == 0, F.concat(F.lit(" "), (n % 1000).cast("string"), F.lit(" / 52"))).when(n % 3 == 2, F.concat(F.lit("- "), (n % 1000).cast("string"), F.lit(" -"))).otherwise(F.lit("3 words")))
    rows = rows.withColumn("y0", F.when(n % 5 == 0, 0.0).when(n % 5 == 4, 95.0).otherwise(40.0)).withColumn("y1", F.col("y0") + 5.0)
    return rows.select("doc_id", "line_no", nz.is_page_number(F.col("text"), F.col("y0"), F.col("y1"), 100.0).alias("noise"))


_GHOSTS = f"""WITH RECURSIVE {ad.LINES}, r AS (
  SELECT doc_id, page, text, line_no AS span_no, x0::DOUBLE AS x0, y0::DOUBLE / 8 AS y0, row_number() OVER (PARTITION BY doc_id, page, text ORDER BY line_no) AS k FROM lines
), kept AS (
  SELECT *, x0 AS lx, y0 AS ly, true AS keep FROM r WHERE k = 1
  UNION ALL
  SELECT r.doc_id, r.page, r.text, r.span_no, r.x0, r.y0, r.k, CASE WHEN near THEN lx ELSE r.x0 END, CASE WHEN near THEN ly ELSE r.y0 END, NOT near
  FROM (SELECT r.*, p.lx, p.ly, abs(p.lx - r.x0) <= 3 AND abs(p.ly - r.y0) <= 3 AS near FROM r JOIN kept p ON r.doc_id = p.doc_id AND r.page = p.page AND r.text = p.text AND r.k = p.k + 1) r
) SELECT doc_id, page, text, span_no, x0, y0 FROM kept WHERE keep"""


@query("noise_ghost_dedup", _GHOSTS)
def noise_ghost_dedup(s, d):
    spans = ad.lines(s, d).select("doc_id", "page", F.col("line_no").alias("span_no"), "text", "x0", (F.col("y0") / 8).alias("y0"))
    return nz.without_ghosts(spans)


@query("noise_banned_spans", f"WITH {ad.LINES}, s AS (SELECT doc_id, line_no, regexp_replace(text, '\\s+', '', 'g') AS t, x0, y0, x1, y1 FROM lines), b AS (SELECT doc_id, t || CASE WHEN line_no % 2 = 0 THEN 'more' ELSE '' END AS t, x0, y0, x1, y1 FROM s WHERE line_no % 9 = 0) SELECT doc_id, line_no FROM s WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.doc_id = s.doc_id AND b.t = s.t AND abs(b.y0 - s.y0) <= 5.0) AND NOT EXISTS (SELECT 1 FROM b WHERE b.doc_id = s.doc_id AND b.t <> s.t AND length(s.t) >= 3 AND contains(b.t, s.t) AND b.x0 - 5 <= s.x0 AND b.y0 - 5 <= s.y0 AND b.x1 + 5 >= s.x1 AND b.y1 + 5 >= s.y1)")
def noise_banned_spans(s, d):
    """Every ninth line is banned with its box, half of them as part of a longer text."""
    spans = ad.lines(s, d).select("doc_id", "line_no", "text", "x0", "y0", "x1", "y1")
    longer = F.concat(tx.no_space("text"), F.when(F.col("line_no") % 2 == 0, "more").otherwise(""))
    banned = spans.filter("line_no % 9 = 0").select("doc_id", longer.alias("norm_text"), *(F.col(c).alias(f"b_{c}") for c in ("x0", "y0", "x1", "y1")))
    return nz.without_banned(spans, banned).select("doc_id", "line_no")


@query("title_pick", f"WITH {ad.LINES}, t AS (SELECT *, max(size) OVER (PARTITION BY doc_id, page) AS top FROM lines) SELECT doc_id, page, CASE WHEN page = 0 OR count(*) = 1 THEN arg_min(text, line_no) END AS title FROM t WHERE top - size < 0.1 GROUP BY 1, 2")
def title_pick(s, d):
    return nz.title_of(ad.lines(s, d).withColumn("span_no", F.col("line_no")))


@query("title_main", f"WITH {ad.LINES}, b AS (SELECT doc_id, arg_min(text, -size * 1000000 + line_no) AS title FROM lines WHERE page < 3 GROUP BY 1) SELECT d.doc_id, coalesce(title, 'doc' || d.doc_id) AS title FROM documents d LEFT JOIN b USING (doc_id)")
def title_main(s, d):
    titles = ad.lines(s, d).select("doc_id", F.when(F.col("page") < 3, F.col("line_no")).otherwise(99).alias("page"), "size", F.col("text").alias("title"), F.col("page").alias("p"))
    return nz.main_title(titles.filter("p < 3"), ad.files(s, d), pages=99)


@query("size_mode", f"WITH {ad.LINES}, c AS (SELECT doc_id, size, count(*) AS n FROM lines GROUP BY 1, 2) SELECT doc_id, coalesce(min(size) FILTER (n >= 2), min(size)) AS size FROM c GROUP BY 1")
def size_mode(s, d):
    return nz.usual_size(ad.lines(s, d))


@query("quantile_nearest_rank", "SELECT l_suppkey, least(20000.0, greatest(2000.0, list_sort(list(l_extendedprice))[1 + least(count(*) - 1, count(*) * 20 // 100)])) AS threshold FROM lineitem GROUP BY 1")
def quantile_nearest_rank(s, d):
    return nz.nearest_rank(ad.table(s, d, "lineitem"), "l_suppkey", "l_extendedprice", 20, 2000.0, 20000.0)


def _signals(s, d):
    return ad.table(s, d, "lineitem").groupBy(F.col("l_orderkey").alias("doc_id")).agg((F.count("*") * 60).alias("drawings"), F.sum("l_linenumber").alias("images"), (F.max("l_suppkey") % 40).alias("chars"), F.countDistinct("l_linenumber").alias("font_sizes"), F.max("l_discount").alias("max_image_cover"))


_SIGNALS = "g AS (SELECT l_orderkey AS doc_id, count(*) * 60 AS drawings, sum(l_linenumber)::BIGINT AS images, max(l_suppkey) % 40 AS chars, count(DISTINCT l_linenumber) AS font_sizes, max(l_discount) AS cover FROM lineitem GROUP BY 1)"


@query("triage_route", f"WITH {_SIGNALS} SELECT doc_id, CASE WHEN drawings > 200 OR (chars < 20 AND cover >= 0.08) THEN 'slow' ELSE 'fast' END AS route FROM g")
def triage_route(s, d):
    return nz.page_route(_signals(s, d), cover=0.08).select("doc_id", "route")


@query("triage_score", f"WITH {_SIGNALS} SELECT doc_id, round(0.4 * greatest(0, least(1, drawings / 200.0)) + 0.3 * greatest(0, least(1, images / 5.0)) + 0.2 * greatest(0, least(1, 1 - chars / 500.0)) + 0.1 * greatest(0, least(1, font_sizes / 8.0)), 6) AS score FROM g")
def triage_score(s, d):
    return nz.page_score(_signals(s, d)).select("doc_id", F.round("score", 6).alias("score"))


# --- layout


@query("geom_overlap_argmax", f"WITH {ad.BOXES} SELECT doc_id, line_no, arg_min(block_no, -area * 1000 + block_no) AS block_no, round(max(area), 6) AS area FROM pairs WHERE area > 0 GROUP BY 1, 2")
def geom_overlap_argmax(s, d):
    lines, blocks = ad.boxes(s, d)
    return ly.largest_overlap(lines, blocks).select("doc_id", "line_no", "block_no", F.round("area", 6).alias("area"))


@query("geom_nearest", f"WITH {ad.BOXES}, hit AS (SELECT DISTINCT doc_id, line_no FROM pairs WHERE area > 0), n AS (SELECT doc_id, line_no, arg_min(block_no, far) AS b, min(far) AS f FROM pairs WHERE (doc_id, line_no) NOT IN (SELECT doc_id, line_no FROM hit) GROUP BY 1, 2) SELECT doc_id, line_no, CASE WHEN f < 100 THEN b END AS block_no FROM n")
def geom_nearest(s, d):
    lines, blocks = ad.boxes(s, d)
    return ly.nearest_block(lines, blocks, most=100.0).select("doc_id", "line_no", "block_no")


@query("geom_coverage", f"WITH {ad.BOXES} SELECT doc_id, round(avg(CASE WHEN hit THEN 1.0 ELSE 0.0 END), 6) AS share FROM (SELECT doc_id, block_no, max(area) > 0 AS hit FROM pairs GROUP BY 1, 2) GROUP BY 1")
def geom_coverage(s, d):
    lines, blocks = ad.boxes(s, d)
    return ly.coverage(blocks, lines).select("doc_id", F.round("share", 6).alias("share"))


@query("geom_self_overlap", f"WITH {ad.BOXES}, p AS (SELECT a.doc_id, greatest(0, least(a.x1, b.x1) - greatest(a.x0, b.x0)) * greatest(0, least(a.y1, b.y1) - greatest(a.y0, b.y0)) / ((a.x1 - a.x0) * (a.y1 - a.y0)) AS share FROM bl a JOIN bl b ON a.doc_id = b.doc_id AND a.block_no <> b.block_no) SELECT doc_id, round(max(share), 6) AS share FROM p GROUP BY 1")
def geom_self_overlap(s, d):
    return ly.largest_mutual_share(ad.boxes(s, d)[1]).select("doc_id", F.round("share", 6).alias("share"))


@query("geom_crowded", f"WITH {ad.BOXES}, w AS (SELECT doc_id, line_no, x0, y0, x1, y1 + 20 AS y1 FROM li) SELECT DISTINCT a.doc_id FROM w a JOIN w b ON a.doc_id = b.doc_id AND a.x0 < b.x1 AND b.x0 < a.x1 AND a.y0 < b.y1 AND b.y0 < a.y1 GROUP BY a.doc_id, a.line_no HAVING count(*) > 2")
def geom_crowded(s, d):
    return ly.crowded_pages(ad.boxes(s, d)[0].withColumn("y1", F.col("y1") + 20)).select("doc_id")


@query("geom_nearest_corner", f"WITH {ad.BOXES} SELECT li.doc_id, line_no AS ref_no, arg_min(block_no, round(sqrt(pow(li.x0 - bl.x0, 2) + pow(li.y0 - bl.y0, 2)), 6) * 1000 + block_no) AS block_no FROM li JOIN bl USING (doc_id) GROUP BY 1, 2")
def geom_nearest_corner(s, d):
    lines, blocks = ad.boxes(s, d)
    return ly.nearest_corner(lines.withColumnRenamed("line_no", "ref_no"), blocks).select("doc_id", "ref_no", "block_no")


@query("geom_not_covered", f"WITH {ad.BOXES} SELECT doc_id, block_no FROM bl a WHERE NOT EXISTS (SELECT 1 FROM bl b WHERE b.doc_id = a.doc_id AND b.block_no % 2 = 0 AND b.block_no <> a.block_no AND b.x0 - 50 <= a.x0 AND b.x1 + 50 >= a.x1 AND b.y0 - 20 <= a.y0 AND b.y1 + 20 >= a.y1)")
def geom_not_covered(s, d):
    blocks = ad.boxes(s, d)[1]
    tables = blocks.filter("block_no % 2 = 0").select("doc_id", "page", "block_no", (F.col("x0") - 50).alias("x0"), (F.col("y0") - 20).alias("y0"), (F.col("x1") + 50).alias("x1"), (F.col("y1") + 20).alias("y1"))
    return ly.not_covered(blocks, tables, 0.9999).select("doc_id", "block_no")


@query("geom_merged", f"WITH {ad.BOXES} SELECT doc_id, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1 FROM bl GROUP BY 1")
def geom_merged(s, d):
    return ly.merged_boxes(ad.boxes(s, d)[1], ["doc_id"])


@query("geom_widened", f"WITH {ad.BOXES}, g AS (SELECT a.doc_id, a.block_no, min(sqrt(pow(greatest(0, b.x0 - a.x1, a.x0 - b.x1), 2) + pow(greatest(0, b.y0 - a.y1, a.y0 - b.y1), 2))) AS gap FROM bl a JOIN bl b ON a.doc_id = b.doc_id AND a.block_no <> b.block_no GROUP BY 1, 2), w AS (SELECT bl.*, least((x1 - x0) * 0.05, coalesce(gap / 2, 1e300)) AS dx, least((y1 - y0) * 0.05, coalesce(gap / 2, 1e300)) AS dy FROM bl LEFT JOIN g USING (doc_id, block_no)) SELECT doc_id, block_no, round((x0 - dx)::DOUBLE, 6) AS x0, round((y0 - dy)::DOUBLE, 6) AS y0, round((x1 + dx)::DOUBLE, 6) AS x1, round((y1 + dy)::DOUBLE, 6) AS y1 FROM w")
def geom_widened(s, d):
    return ly.widened(ad.boxes(s, d)[1]).select("doc_id", "block_no", *(F.round(c, 6).alias(c) for c in ("x0", "y0", "x1", "y1")))


@query("read_order", f"WITH {ad.BOXES} SELECT doc_id, line_no, row_number() OVER (PARTITION BY doc_id ORDER BY round_even(y0 / 30, 0), x0, line_no) - 1 AS place FROM li")
def read_order(s, d):
    return ly.reading_order(ad.boxes(s, d)[0], 30.0).select("doc_id", "line_no", "place")


def _kinds(s, d):
    rows = ad.table(s, d, "lineitem").groupBy(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("pos")).agg(F.max("l_quantity").alias("q"))
    kind = F.element_at(F.array(*(F.lit(k) for k in ("list", "list", "table", "caption", "text"))), (F.col("q") % 5 + 1).cast("int"))
    return rows.select("doc_id", F.lit(0).alias("page"), "pos", kind.alias("kind"), (F.col("pos") * 20.0 + F.col("q") % 7).alias("y0"), (F.col("pos") * 20.0 + 15.0).alias("y1"), (F.col("q") % 4 * 10).alias("x0"))


_KINDS = "kd AS (SELECT l_orderkey AS doc_id, l_linenumber AS pos, max(l_quantity) AS q FROM lineitem GROUP BY ALL), k AS (SELECT doc_id, pos, ['list', 'list', 'table', 'caption', 'text'][(q % 5)::INT + 1] AS kind, pos * 20.0 + q % 7 AS y0, pos * 20.0 + 15.0 AS y1, q % 4 * 10 AS x0 FROM kd)"


@query("list_groups", f"WITH {_KINDS}, st AS (SELECT *, CASE WHEN kind = 'list' AND NOT (coalesce(lag(kind) OVER w, '') = 'list' AND y0 - lag(y1) OVER w < 8.0) THEN 1 ELSE 0 END AS start FROM k WINDOW w AS (PARTITION BY doc_id ORDER BY pos)), g AS (SELECT *, CASE WHEN kind = 'list' THEN sum(start) OVER (PARTITION BY doc_id ORDER BY pos) END AS gn FROM st) SELECT doc_id, pos, gn::BIGINT AS group_no, CASE WHEN kind = 'list' AND count(*) OVER (PARTITION BY doc_id, gn) = 1 THEN 'text' ELSE kind END AS kind FROM g")
def list_groups(s, d):
    return ly.list_groups(_kinds(s, d), 80.0).select("doc_id", "pos", "group_no", "kind")


@query("caption_groups", f"WITH {_KINDS}, n AS (SELECT *, lag(kind) OVER w AS bk, lag(y1) OVER w AS b1, lag(pos) OVER w AS bp, lead(kind) OVER w AS ak, lead(y0) OVER w AS a0, lead(pos) OVER w AS ap FROM k WINDOW w AS (PARTITION BY doc_id ORDER BY pos)) SELECT doc_id, pos, CASE WHEN bk = 'table' AND y0 - b1 < 8.0 THEN bp WHEN ak = 'table' AND a0 - y1 < 8.0 THEN ap END AS owner_pos FROM n WHERE kind = 'caption'")
def caption_groups(s, d):
    return ly.caption_owner(_kinds(s, d), 160.0).select("doc_id", "pos", "owner_pos")


@query("continuation", f"WITH {ad.LINES}, p AS (SELECT doc_id, page, arg_max(text, line_no) AS text FROM lines GROUP BY 1, 2) SELECT doc_id, page, coalesce(lead(page) OVER w > page AND NOT regexp_matches(text, '[.!?。！？]\\s*$') AND regexp_matches(lead(text) OVER w, '^\\s*\\p{{Ll}}'), false) AS goes_on FROM p WINDOW w AS (PARTITION BY doc_id ORDER BY page)")
def continuation(s, d):
    rows = ad.lines(s, d).groupBy("doc_id", "page").agg(F.max_by("text", "line_no").alias("text")).withColumn("pos", F.lit(0)).withColumn("kind", F.lit("text")).withColumn("y0", F.lit(0.0))
    return ly.continued(rows).select("doc_id", "page", "goes_on")


_QUOTES = f"""WITH RECURSIVE {_KINDS}, r AS (
  SELECT doc_id, pos, x0, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS n FROM k
), q AS (
  SELECT *, 0 AS quote_level FROM r WHERE n = 1
  UNION ALL
  SELECT r.*, CASE WHEN r.x0 > q.x0 + 5 THEN quote_level + 1 WHEN r.x0 < q.x0 - 5 THEN greatest(0, quote_level - 1) ELSE quote_level END
  FROM r JOIN q ON r.doc_id = q.doc_id AND r.n = q.n + 1
) SELECT doc_id, 0 AS page, pos, quote_level FROM q"""


@query("blockquote_levels", _QUOTES)
def blockquote_levels(s, d):
    return ly.blockquotes(_kinds(s, d).select("doc_id", "page", "pos", F.col("x0").cast("double")))


@query("heading_levels")
def heading_levels(s, d):
    return ly.heading_levels(ad.lines(s, d).select("doc_id", F.col("line_no").alias("pos"), (F.col("size") + F.length("text") % 7).alias("height")))


@query("missing_blocks", f"WITH {_KINDS}, m AS (SELECT * FROM k WHERE kind <> 'table'), f AS (SELECT *, CASE WHEN pos - lag(pos) OVER w = 1 AND abs(y0 - lag(y1) OVER w) < 8.0 THEN 0 ELSE 1 END AS st FROM m WINDOW w AS (PARTITION BY doc_id ORDER BY pos)) SELECT doc_id, pos AS line_no, sum(st) OVER (PARTITION BY doc_id ORDER BY pos)::BIGINT AS island FROM f")
def missing_blocks(s, d):
    return ly.missing_blocks(_kinds(s, d).filter("kind <> 'table'").withColumnRenamed("pos", "line_no"), 8.0).select("doc_id", "line_no", "island")


def _cells(s, d):
    items = shared_out(ad.table(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity"), "l_orderkey")
    return items.groupBy(F.col("l_orderkey").alias("table_id"), F.col("l_linenumber").alias("row_id")).agg(F.max("l_quantity").cast("int").alias("q")).withColumn("col_id", F.explode(F.array(F.lit(0), F.lit(2)))).withColumn("colspan", F.when(F.col("col_id") == 0, 2).otherwise(1)).withColumn("rowspan", F.lit(1)).withColumn("text", F.concat("q", F.lit("/"), "col_id"))


_CELLS = "cl AS (SELECT table_id, row_id, q, col_id, CASE WHEN col_id = 0 THEN 2 ELSE 1 END AS colspan, 1 AS rowspan, q || '/' || col_id AS text FROM (SELECT *, unnest([0, 2]) AS col_id FROM (SELECT l_orderkey AS table_id, l_linenumber AS row_id, max(l_quantity)::INT AS q FROM lineitem GROUP BY ALL)))"


@query("table_counts", f"WITH {_CELLS} SELECT table_id, n_rows, n_cols FROM (SELECT table_id, max(n)::BIGINT AS n_rows FROM (SELECT table_id, col_id, sum(rowspan) AS n FROM cl GROUP BY 1, 2) GROUP BY 1) JOIN (SELECT table_id, max(n)::BIGINT AS n_cols FROM (SELECT table_id, row_id, sum(colspan) AS n FROM cl GROUP BY 1, 2) GROUP BY 1) USING (table_id)")
def table_counts(s, d):
    return ly.table_size(_cells(s, d))


@query("table_grid", f"WITH {_CELLS} SELECT table_id, row_id, '| ' || (q || '/0') || ' |  | ' || (q || '/2') || ' |' AS line FROM cl WHERE col_id = 0")
def table_grid(s, d):
    return ly.table_grid(_cells(s, d))


@query("table_split_rows", f"WITH {_CELLS}, r AS (SELECT DISTINCT table_id, row_id, q % 3 + 1 AS n FROM cl), u AS (SELECT *, n > 1 AND avg(CASE WHEN n > 1 THEN 1.0 ELSE 0 END) OVER (PARTITION BY table_id) >= 0.5 AS used FROM r), sh AS (SELECT *, coalesce(sum(CASE WHEN used THEN n - 1 ELSE 0 END) OVER (PARTITION BY table_id ORDER BY row_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS shift FROM u) SELECT table_id, (row_id + shift + i)::BIGINT AS row_id, col_id, CASE WHEN used THEN text || '#' || (i + 1) ELSE array_to_string(list_transform(range(1, n + 1), lambda x: text || '#' || x), ' ') END AS text FROM (SELECT cl.*, used, shift, n, unnest(range(0, CASE WHEN used THEN n ELSE 1 END)) AS i FROM cl JOIN sh USING (table_id, row_id))")
def table_split_rows(s, d):
    rows = _cells(s, d).withColumn("lines", F.transform(F.sequence(F.lit(1), F.col("q") % 3 + 1), lambda k: F.concat("text", F.lit("#"), k.cast("string"))))
    return ly.split_rows(rows.select("table_id", "row_id", "col_id", "lines"))


@query("numbered_lines", "SELECT doc_id, round(avg(CASE WHEN n % 5 <> 0 THEN 1.0 ELSE 0.0 END), 6) AS share FROM (SELECT l_orderkey AS doc_id, l_linenumber, max(l_quantity)::INT AS n FROM lineitem GROUP BY ALL) GROUP BY 1 HAVING avg(CASE WHEN n % 5 <> 0 THEN 1.0 ELSE 0.0 END) > 0.6")
def numbered_lines(s, d):
    q = F.max("l_quantity").cast("int")
    rows = ad.table(s, d, "lineitem").groupBy(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("line_no")).agg(q.alias("q"))
    spans = rows.select("doc_id", F.lit(0).alias("page"), "line_no", F.when(F.col("q") % 5 != 0, F.col("q").cast("string")).otherwise("word").alias("text"), F.lit(1.0).alias("x0"))
    return ly.numbered_lines(spans).select("doc_id", F.round("share", 6).alias("share"))


# --- retrieval

def _terms(s, d):
    return rt.sparse_index(ad.table(s, d, "documents"), F.filter(F.split(F.lower("text"), r"[^a-z]+"), lambda x: x != ""))


TERMS = {"the": 1.0, "of": 0.5, "un": 2.0, "die": 1.5}


def _questions(s, d):
    """Every vector whose id is divisible by 20 is a query against all."""
    return ad.table(s, d, "embeddings").filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))


_EACH = "round(list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 12)"
_PAIRS = f"pr AS (SELECT q.vec_id AS query_id, e.vec_id, e.label, {_EACH} AS score FROM embeddings e, (SELECT * FROM embeddings WHERE vec_id % 20 = 0) q)"


@query("search_dense", f"WITH {_PAIRS} SELECT query_id, vec_id, round(score, 6) AS score FROM pr QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY pr.score DESC, vec_id) <= 10")
def search_dense(s, d):
    return rt.dense_top_k_each(ad.table(s, d, "embeddings"), _questions(s, d), 10).select("query_id", "vec_id", F.round("score", 6).alias("score"))


@query("search_dense_filtered", f"WITH {_PAIRS} SELECT query_id, vec_id, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM pr WHERE label IN (1, 2, 3) QUALIFY rank <= 10")
def search_dense_filtered(s, d):
    found = rt.dense_top_k_each(ad.table(s, d, "embeddings"), _questions(s, d), 10, where=F.col("label").isin(1, 2, 3))
    return found.select("query_id", "vec_id", F.round("score", 6).alias("score"), "rank")


@query("search_dense_each", f"WITH {_PAIRS} SELECT query_id, vec_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM pr QUALIFY rank <= 5")
def search_dense_each(s, d):
    return rt.dense_top_k_each(ad.table(s, d, "embeddings"), _questions(s, d), 5).select("query_id", "vec_id", "rank")


def _asked_terms(index, order=("df", "term")):
    """Four words of each document whose id is divisible by 20, the first with the largest weight: the rarest ones, or by another order."""
    spread = index.groupBy("term").agg(F.count("*").alias("df"))
    w = Window.partitionBy("query_id").orderBy(*order)
    own = index.filter("doc_id % 20 = 0").select(F.col("doc_id").alias("query_id"), "term").join(spread, "term").withColumn("place", F.row_number().over(w))
    return own.filter("place <= 4").select("query_id", "term", (5.0 - F.col("place")).alias("weight"))


_SPARSE_EACH = """tf AS (SELECT doc_id, t AS term, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS t FROM documents) GROUP BY ALL
), df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1
), qt AS (SELECT doc_id AS query_id, term, 5.0 - row_number() OVER (PARTITION BY doc_id ORDER BY df, term) AS weight FROM tf JOIN df USING (term) WHERE doc_id % 20 = 0 QUALIFY weight > 0
), sp AS (SELECT query_id, doc_id, sum(n * weight) AS score FROM tf JOIN qt USING (term) GROUP BY ALL)"""


@query("search_sparse", f"WITH {_SPARSE_EACH} SELECT query_id, doc_id, score::DOUBLE AS score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM sp QUALIFY rank <= 20")
def search_sparse(s, d):
    index = written(_terms(s, d), "terms")
    return rt.sparse_top_k_each(index, _asked_terms(index), 20)


_COMMON = _SPARSE_EACH.replace("ORDER BY df, term", "ORDER BY df DESC, term")


def _block_search(s, d):
    """Blocks, questions, who asks the same, and the plan of each question that differs."""
    index = written(_terms(s, d), "terms")
    blocks = written(rt.posting_blocks(index), "blocks")
    asked = written(_asked_terms(index, (F.desc("df"), "term")), "asked")
    same = written(rt.asked_once(asked), "same")
    firsts = asked.join(same.filter("query_id = asked").select("query_id"), "query_id")
    return blocks, asked, same, written(rt.block_plan(blocks, firsts, 20)[0], "plan")


@query("search_sparse_blocks", f"WITH {_COMMON} SELECT query_id, doc_id, score::DOUBLE AS score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM sp QUALIFY rank <= 20")
def search_sparse_blocks(s, d):
    """The four most frequent words of each document are asked: blocks that cannot hold a hit are left out."""
    blocks, asked, _, plan = _block_search(s, d)
    return rt.sparse_top_k_blocks(blocks, asked, 20, plan).withColumnRenamed("item", "doc_id")


@query("search_sparse_read")
def search_sparse_read(s, d):
    """How many of the postings of each query's words ``search_sparse_blocks`` reads for candidates."""
    _, _, same, plan = _block_search(s, d)
    return same.join(rt.postings_read(plan).withColumnRenamed("query_id", "asked"), "asked").drop("asked")


@query("search_index")
def search_index(s, d):
    """Approximate top 10 by an inverted file: 40 of 64 lists are looked at."""
    vectors = ad.table(s, d, "embeddings")
    lists = vi.fitted(vectors)
    return vi.top_k_each(vi.built(vectors, lists), vectors, _questions(s, d), lists, 10, probes=40, refine=2).select("query_id", "vec_id", "rank")


@query("search_index_whole", f"WITH {_PAIRS} SELECT query_id, vec_id, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM pr QUALIFY rank <= 10")
def search_index_whole(s, d):
    """All lists looked at: the index has every vector, and the codes tell enough to find the exact top 10."""
    vectors = ad.table(s, d, "embeddings")
    lists = vi.fitted(vectors)
    found = vi.top_k_each(vi.built(vectors, lists), vectors, _questions(s, d), lists, 10, probes=64, refine=8)
    return found.select("query_id", "vec_id", F.round("score", 6).alias("score"), "rank")


@query("search_hybrid_rrf", f"WITH {_PAIRS}, {_SPARSE_EACH}, a AS (SELECT query_id, vec_id AS id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS r FROM pr QUALIFY r <= 40), b AS (SELECT query_id, doc_id AS id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS r FROM sp QUALIFY r <= 40), f AS (SELECT query_id, id, round(sum(1.0::DOUBLE / (r + 60)), 12) AS score FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY ALL) SELECT query_id, id, round(score, 9) AS score FROM f QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY f.score DESC, id) <= 8")
def search_hybrid_rrf(s, d):
    dense = rt.dense_top_k_each(ad.table(s, d, "embeddings").withColumnRenamed("vec_id", "id"), _questions(s, d), 40, item="id")
    counted = written(rt.counted_terms(ad.table(s, d, "documents").withColumnRenamed("doc_id", "id"), F.lower("text"), "id"), "counted")
    index = counted.select(F.col("id").alias("doc_id"), F.explode(F.split("terms", " ")).alias("term"))
    sparse = rt.sparse_top_k_counted(counted, written(_asked_terms(index), "asked"), 40, "id")
    return rt.fused_each(dense, sparse, 8, "id").select("query_id", "id", F.round("score", 9).alias("score"))


@query("search_fanout", f"WITH {_PAIRS} SELECT query_id, label, vec_id, row_number() OVER (PARTITION BY query_id, label ORDER BY score DESC, vec_id) AS rank FROM pr QUALIFY rank <= 4")
def search_fanout(s, d):
    return rt.dense_top_k_each(ad.table(s, d, "embeddings"), _questions(s, d), 4, by="label").select("query_id", "label", "vec_id", "rank")


@query("hits_by_page", f"WITH {ad.HITS} SELECT file_key, page::INT AS page, greatest(0.0, max(score))::DOUBLE AS max_score, arg_min(project, pos) AS project, count(*) AS n_hits FROM hits WHERE page IS NOT NULL GROUP BY 1, 2")
def hits_by_page(s, d):
    return rt.by_page(ad.hits(s, d))


@query("context_grouped", f"WITH {ad.HITS}, p AS (SELECT *, count(*) OVER (PARTITION BY entity) AS n, min(pos) OVER (PARTITION BY entity) AS first_pos FROM hits) SELECT entity, first_pos, n AS n_hits, {_PART.format('pos')} AS part, string_agg('[' || pos || '] ' || text, chr(10) ORDER BY pos) AS context FROM p GROUP BY 1, 2, 3, 4")
def context_grouped(s, d):
    return rt.context_by_entity(ad.hits(s, d), 40)


# --- attributes


def _attrs(s, d):
    return at.melted(ad.attributes(s, d), "project", ad.FIELDS)


@query("attrs_melt", f"WITH {ad.ATTRIBUTES} SELECT * FROM attrs")
def attrs_melt(s, d):
    return _attrs(s, d)


@query("attrs_lookup", f"WITH {ad.ATTRIBUTES} SELECT * FROM attrs WHERE contains(lower(project), 'p1') AND attr IN ('size_cm', 'price')")
def attrs_lookup(s, d):
    return at.in_table_order(at.looked_up(_attrs(s, d), ["P 1"], ["Size", "price", "nothing"]))


@query("attrs_value_reverse", f"WITH {ad.ATTRIBUTES} SELECT * FROM attrs WHERE attr = 'type'")
def attrs_value_reverse(s, d):
    return at.looked_up(_attrs(s, d), [], ["economy"])


@query("attrs_markdown", f"WITH {ad.ATTRIBUTES} SELECT attr, project, '| ' || concat_ws(' | ', project, attr, value, coalesce(regexp_replace(printf('%.6f', number), '\\.?0+$', ''), '')) || ' |' AS line FROM attrs")
def attrs_markdown(s, d):
    return at.as_markdown(_attrs(s, d))


@query("attrs_fill_gate", "SELECT p_partkey, CASE WHEN p_size % 3 <> 0 THEN 'skipped' WHEN p_size % 4 = 0 THEN 'not_found' WHEN p_partkey % 3 = 0 THEN 'low_confidence' ELSE 'adopted' END AS state, CASE WHEN p_size % 3 <> 0 THEN p_type WHEN p_size % 4 <> 0 AND p_partkey % 3 <> 0 THEN p_brand ELSE '' END AS new_value FROM part")
def attrs_fill_gate(s, d):
    cells = ad.table(s, d, "part").select("p_partkey", F.when(F.col("p_size") % 3 == 0, "").otherwise(F.col("p_type")).alias("value"), F.when(F.col("p_size") % 4 == 0, "").otherwise(F.col("p_brand")).alias("answer"), F.element_at(F.array(F.lit("low"), F.lit("medium"), F.lit("high")), (F.col("p_partkey") % 3 + 1).cast("int")).alias("confidence"))
    return at.gated(cells).select("p_partkey", "state", "new_value")


@query("entity_resolve_unique", "SELECT name, CASE WHEN name IN (SELECT n_name FROM nation) THEN name WHEN n = 1 THEN one WHEN n > 1 AND ne = 1 THEN e END AS project FROM (SELECT s.name, count(n_name) AS n, min(n_name) AS one, count(*) FILTER (ends_with(n_name, s.name)) AS ne, min(n_name) FILTER (ends_with(n_name, s.name)) AS e FROM (SELECT DISTINCT '_' || s_nationkey AS name FROM supplier UNION SELECT DISTINCT 'NATION_' || s_nationkey FROM supplier UNION SELECT DISTINCT 'x' || s_nationkey FROM supplier) s LEFT JOIN nation ON contains(n_name, s.name) GROUP BY 1)")
def entity_resolve_unique(s, d):
    keys = ad.table(s, d, "supplier").select(F.explode(F.array(F.concat(F.lit("_"), "s_nationkey"), F.concat(F.lit("NATION_"), "s_nationkey"), F.concat(F.lit("x"), "s_nationkey"))).alias("name"))
    return at.uniquely_resolved(keys, ad.table(s, d, "nation").select(F.col("n_name").alias("project")))


@query("entity_resolve_greedy", "WITH kn AS (SELECT list(n_name ORDER BY n_nationkey) AS k FROM nation), m AS (SELECT s_suppkey, 'nation_' || s_nationkey AS a, '_2' AS b FROM supplier), h1 AS (SELECT *, list_filter(k, lambda x: contains(lower(x), a) OR contains(a, lower(x)))[1] AS p1 FROM m, kn), h2 AS (SELECT *, list_filter(k, lambda x: contains(lower(x), b) AND x IS DISTINCT FROM p1)[1] AS p2 FROM h1) SELECT s_suppkey AS group_id, 0 AS idx, p1 AS project FROM h2 UNION ALL SELECT s_suppkey, 1, p2 FROM h2")
def entity_resolve_greedy(s, d):
    mentions = ad.table(s, d, "supplier").select(F.col("s_suppkey").alias("group_id"), F.array(F.concat(F.lit("Nation _"), "s_nationkey"), F.lit("_2")).alias("names"))
    return at.greedily_resolved(mentions, ad.table(s, d, "nation").select(F.col("n_name").alias("project"), F.col("n_nationkey").alias("pos")))


# --- upkeep


@query("upsert_merge", "SELECT o_orderkey, round(CASE WHEN o_orderkey % 10 = 0 THEN o_totalprice * 2 ELSE o_totalprice END, 2) AS price FROM orders UNION ALL SELECT -o_orderkey - 1, round(o_totalprice, 2) FROM orders WHERE o_orderkey % 10 = 1")
def upsert_merge(s, d):
    base = ad.table(s, d, "orders").select("o_orderkey", "o_totalprice")
    delta = base.filter("o_orderkey % 10 = 0").withColumn("o_totalprice", F.col("o_totalprice") * 2).unionByName(base.filter("o_orderkey % 10 = 1").withColumn("o_orderkey", -F.col("o_orderkey") - 1))
    return mt.upserted(base, delta, "o_orderkey").select("o_orderkey", F.round("o_totalprice", 2).alias("price"))


@query("payload_update", f"WITH {ad.FILES} SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'moved/' || stem ELSE file_key END AS file_key, file_hash FROM files")
def payload_update(s, d):
    base = ad.files(s, d).select("doc_id", F.struct("file_key", "file_hash").alias("source"))
    updates = ad.files(s, d).filter("doc_id % 3 = 0").select("doc_id", F.concat(F.lit("moved/"), "stem").alias("new_value"))
    return mt.payload_updated(base, updates, "doc_id", "source", "file_key").select("doc_id", "source.file_key", "source.file_hash")


@query("incremental_anti", "SELECT doc_id FROM documents WHERE doc_id % 4 <> 1 OR doc_id % 3 = 0")
def incremental_anti(s, d):
    rows = ad.files(s, d).select("doc_id", F.lit("v2").alias("strategy"), F.lit("m").alias("model"))
    cache = rows.filter("doc_id % 4 = 1").withColumn("model", F.when(F.col("doc_id") % 3 == 0, "old").otherwise("m"))
    return mt.still_to_encode(rows, cache, ["doc_id", "strategy", "model"]).select("doc_id")


@query("cache_reasons", "SELECT doc_id, doc_id % 5 <> 0 AND doc_id % 2 = 0 AND doc_id % 3 <> 0 AS valid, CASE WHEN doc_id % 5 = 0 THEN 'no cache' ELSE concat_ws(', ', CASE WHEN doc_id % 2 = 1 THEN 'file_hash changed' END, CASE WHEN doc_id % 3 = 0 THEN 'strategy changed' END) END AS reason FROM documents")
def cache_reasons(s, d):
    now = ad.files(s, d).select("doc_id", "file_hash", F.lit("v2").alias("strategy"))
    was = now.filter("doc_id % 5 <> 0").select("doc_id", F.when(F.col("doc_id") % 2 == 0, F.col("file_hash")).otherwise("-").alias("file_hash"), F.when(F.col("doc_id") % 3 != 0, F.col("strategy")).alias("strategy"))
    return mt.cache_reasons(was, now, "doc_id", ["file_hash", "strategy"])


@query("three_way_skip", f"WITH {ad.FILES} SELECT file_key, CASE WHEN doc_id % 6 = 0 THEN 'safe_skip' WHEN doc_id % 4 = 0 THEN 'resume_skip' ELSE 'process' END AS action FROM files")
def three_way_skip(s, d):
    rows = ad.files(s, d)
    tracker = rows.filter("doc_id % 2 = 0").select("file_key", F.when(F.col("doc_id") % 4 == 0, "SUCCESS").otherwise("FAILED").alias("status"))
    return mt.classified(rows, tracker, rows.filter("doc_id % 6 = 0")).select("file_key", "action")


@query("log_without_undone", "SELECT event_id FROM events e WHERE event_type <> 'error' AND NOT EXISTS (SELECT 1 FROM events u WHERE u.event_type = 'error' AND u.event_id - 1 = e.event_id)")
def log_without_undone(s, d):
    log = ad.table(s, d, "events").select(F.col("event_id").alias("entry_id"), F.when(F.col("event_type") == "error", "undo").otherwise(F.col("event_type")).alias("action"), (F.col("event_id") - 1).alias("target"))
    return mt.undone_free(log).select(F.col("entry_id").alias("event_id"))


@query("retention_newest", "SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k <= 3")
def retention_newest(s, d):
    return mt.newest(ad.table(s, d, "events"), ["user_id"], [F.desc("ts"), F.desc("event_id")], 3).select("user_id", "event_id")


@query("phase_timer", "SELECT user_id, event_type, count(*) AS n, sum(m)::BIGINT AS micros FROM (SELECT *, epoch_us(lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) - epoch_us(ts) AS m FROM events) GROUP BY 1, 2")
def phase_timer(s, d):
    return mt.phase_times(ad.table(s, d, "events"), "user_id", "event_type", "ts", ["ts", "event_id"])


@query("state_machine_last", "SELECT user_id, arg_max(event_type, event_id) AS event_type FROM events GROUP BY 1")
def state_machine_last(s, d):
    return mt.last_state(ad.table(s, d, "events"), "user_id", "event_type", ["event_id"])


# --- sessions


@query("chat_last_turns", "SELECT conv_id, turn FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS k FROM conversations) WHERE k <= 3")
def chat_last_turns(s, d):
    return ss.last_turns(ad.table(s, d, "conversations"), 3).select("conv_id", "turn")


@query("chat_trim_orphans", "SELECT conv_id, turn, role FROM conversations c WHERE turn <= (SELECT max(turn) FROM conversations o WHERE o.conv_id = c.conv_id AND o.role <> 'user')")
def chat_trim_orphans(s, d):
    return ss.without_orphans(ad.table(s, d, "conversations")).select("conv_id", "turn", "role")


@query("chat_title_fallback", "WITH q AS (SELECT conv_id, trim(split_part(trim(arg_min(text, turn) FILTER (role = 'user')), chr(10), 1)) AS t FROM conversations GROUP BY 1) SELECT conv_id, coalesce(nullif(CASE WHEN length(t) > 20 THEN left(t, 20) || '…' ELSE t END, ''), 'untitled') AS title FROM q")
def chat_title_fallback(s, d):
    return ss.titles(ad.table(s, d, "conversations"))


@query("json_first_object", "SELECT event_id, json_extract_string(props, '$.k')::INT AS k FROM events")
def json_first_object(s, d):
    text = F.concat(F.lit("<think>{x}</think> so: "), "props", F.lit(" done"))
    return ad.table(s, d, "events").select("event_id", F.get_json_object(tx.first_json_object(text), "$.k").cast("int").alias("k"))


@query("plan_normalise", "SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN 'structured' WHEN 1 THEN 'compare' ELSE 'fact' END AS intent, CASE WHEN turn % 2 = 0 THEN 'r' || turn ELSE role END AS rewrites FROM conversations")
def plan_normalise(s, d):
    intent = F.element_at(F.array(F.lit("rank"), F.lit(" Compare"), F.lit("dance"), F.lit("fact")), (F.col("turn") % 4 + 1).cast("int"))
    answer = F.concat(F.lit('```json\n{"intent": "'), intent, F.lit('", "rewrites": [" '), F.when(F.col("turn") % 2 == 0, F.concat(F.lit("r"), F.col("turn").cast("string"))).otherwise(""), F.lit(' ", ""]}\n```'))
    rows = ad.table(s, d, "conversations").select(F.struct("conv_id", "turn").alias("conv_id"), answer.alias("answer"), F.col("role").alias("query"))
    return ss.normalised_plans(rows).select("conv_id.conv_id", "conv_id.turn", "intent", F.array_join("rewrites", "|").alias("rewrites"))


# --- pages


@query("html_links", "SELECT page_id, array_to_string(regexp_extract_all(html, '(?i)<a\\b[^>]*\\bhref=[\"'']([^\"'']*)[\"'']', 1), '|') AS links FROM pages")
def html_links(s, d):
    return ad.table(s, d, "pages").select("page_id", F.array_join(src.html_links("html"), "|").alias("links"))


@query("html_text", "SELECT page_id, trim(regexp_replace(regexp_replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script\\b.*?</script\\s*>', '', 'g'), '(?is)<style\\b.*?</style\\s*>', '', 'g'), '(?i)<br\\s*/?>|</(?:p|div|li|h[1-6]|tr|nav|footer)\\s*>', chr(10), 'g'), '(?s)<[^>]*>', '', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', chr(34)), '&#39;', chr(39)), '&amp;', '&'), '[ \\t]+', ' ', 'g'), '\\s*\\n\\s*', chr(10), 'g')) AS text FROM pages")
def html_text(s, d):
    return ad.table(s, d, "pages").select("page_id", src.html_text("html").alias("text"))


@query("html_markdown")
def html_markdown(s, d):
    return src.html_markdown(ad.table(s, d, "pages"), "page_id", "html")


@query("near_copy_indel")
def near_copy_indel(s, d):
    """All pairs of different lines of a document that are nearly the same."""
    rows = written(ad.lines(s, d).select("doc_id", "text").distinct(), "lines")
    pairs = nz.fuzzy_pairs(rows.withColumnRenamed("text", "a"), rows.withColumnRenamed("text", "b"), ["doc_id"])
    return pairs.filter("a < b").select("doc_id", "a", "b", F.round("ratio", 6).alias("ratio"))


def flagship(s: SparkSession, d: str) -> DataFrame:
    """Documents to Markdown sections, chunks with ids, a sparse index, a filtered top 8, grouped by file and page.

    The filter stands on the documents, and what the answer shows goes through the index with the chunk's id, so chunks
    are made once and of the wanted documents only.
    """
    english = F.col("lang") == "en"
    rows = ch.with_ids(_chunks(s, d, english), ad.files(s, d).filter(english))
    hit = F.struct("chunk_id", "file_key", F.col("page_num").alias("page"), tx.project_of("file_key").alias("project"), F.col("chunk_idx_global").alias("pos"))
    terms = F.filter(F.split(F.lower("text"), r"[^a-z]+"), lambda x: x.isin(list(TERMS)))
    top = rt.sparse_top_k(rt.sparse_index(rows.withColumn("hit", hit), terms, "hit"), TERMS, 8, "hit")
    return rt.by_page(top.select("hit.*", "score"))


QUERIES["flagship_search"] = flagship
_WEIGHTS = " + ".join(f"{w} * len(list_filter(w, lambda x: x = '{t}'))" for t, w in TERMS.items())
SQL["flagship_search"] = f"""{_IDS}, tk AS (
  SELECT {_UUID} AS id, file_key, page_num, source AS project, row_number() OVER (PARTITION BY doc_id ORDER BY page_pos, section_idx, chunk_idx) AS pos,
         lang, regexp_extract_all(lower(text), '[a-z]+') AS w FROM named
), sc AS (
  SELECT *, {_WEIGHTS} AS score FROM tk WHERE lang = 'en'
), top AS (
  SELECT * FROM sc WHERE score > 0 ORDER BY score DESC, id, file_key, page_num, project, pos LIMIT 8
)
SELECT file_key, page_num AS page, greatest(0, max(score))::DOUBLE AS max_score, arg_min(project, pos) AS project, count(*) AS n_hits FROM top GROUP BY 1, 2"""
