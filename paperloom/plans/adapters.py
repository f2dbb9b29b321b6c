"""The test tables in the shapes that the operators take, and the same shapes as SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.operators.shares import shared_out


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.concat("lang", F.lit("/"), "source", F.lit("/doc"), "doc_id", F.lit(".md"))
    return table(spark, sf_dir, "documents").select("doc_id", key.alias("file_key"), F.concat(F.lit("doc"), "doc_id").alias("stem"), F.md5(F.encode("text", "UTF-8")).alias("file_hash"), F.col("n_chars").alias("size"), "lang", "source")


FILES = """files AS (
  SELECT doc_id, lang || '/' || source || '/doc' || doc_id || '.md' AS file_key, 'doc' || doc_id AS stem,
         md5(text) AS file_hash, n_chars AS size, lang, source FROM documents)"""


def old_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Yesterday's snapshot: some files missing, some in another folder, some with another time."""
    rows = files(spark, sf_dir).filter("doc_id % 10 <> 0")
    moved = F.when(F.col("doc_id") % 7 == 1, F.concat(F.lit("old/"), "source", F.lit("/doc"), "doc_id", F.lit(".md"))).otherwise(F.col("file_key"))
    states = F.element_at(F.array(F.lit("ingested"), F.lit("encoded"), F.lit("processing")), (F.col("doc_id") % 3 + 1).cast("int"))
    return rows.withColumn("file_key", moved).withColumn("mtime", F.col("doc_id") * 60 + F.when(F.col("doc_id") % 5 == 2, 1).otherwise(0)).withColumn("status", states)


def new_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files(spark, sf_dir).filter("doc_id % 11 <> 0").withColumn("mtime", F.col("doc_id") * 60)


SNAPSHOTS = (
    FILES
    + """, old_files AS (
  SELECT * REPLACE (CASE WHEN doc_id % 7 = 1 THEN 'old/' || source || '/doc' || doc_id || '.md' ELSE file_key END AS file_key),
         doc_id * 60 + CASE WHEN doc_id % 5 = 2 THEN 1 ELSE 0 END AS mtime,
         CASE doc_id % 3 WHEN 0 THEN 'ingested' WHEN 1 THEN 'encoded' ELSE 'processing' END AS status
  FROM files WHERE doc_id % 10 <> 0
), new_files AS (SELECT *, doc_id * 60 AS mtime FROM files WHERE doc_id % 11 <> 0)"""
)

PAGE_LINES = 5
PAGE_WIDTH = PAGE_HEIGHT = 100.0


def lines(spark: SparkSession, sf_dir: str, where: Column | None = None) -> DataFrame:
    """Lines of the texts as positioned blocks, five a page."""
    docs = table(spark, sf_dir, "documents")
    rows = (docs if where is None else docs.filter(where)).select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "text"))
    rows = rows.withColumn("page", F.floor(F.col("line_no") / PAGE_LINES).cast("int")).withColumn("block_no", F.col("line_no"))
    rows = rows.withColumn("x0", 10.0 * (F.length("text") % 4)).withColumn("y0", 20.0 * (F.col("line_no") % PAGE_LINES))
    return rows.withColumn("x1", F.col("x0") + 50.0).withColumn("y1", F.col("y0") + 18.0).withColumn("size", 10.0 + F.length("text") % 5)


LINES = f"""lines AS (
  SELECT doc_id, i - 1 AS line_no, l[i] AS text, (i - 1) // {PAGE_LINES} AS page, i - 1 AS block_no,
         10.0 * (length(l[i]) % 4) AS x0, 20.0 * ((i - 1) % {PAGE_LINES}) AS y0,
         10.0 * (length(l[i]) % 4) + 50.0 AS x1, 20.0 * ((i - 1) % {PAGE_LINES}) + 18.0 AS y1, 10.0 + length(l[i]) % 5 AS size
  FROM (SELECT doc_id, string_split(text, chr(10)) AS l, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents)
)"""


def markdown(spark: SparkSession, sf_dir: str, where: Column | None = None) -> DataFrame:
    """The lines as Markdown with headings, ten a page, some of them blank."""
    n = F.col("line_no")
    text = F.when(n % 7 == 0, F.concat(F.lit("### A"), F.floor(n / 7).cast("string"))).when(n % 7 == 2, F.concat(F.lit("#### B"), n.cast("string"))).when(n % 7 == 4, F.concat(F.lit("##### C"), n.cast("string"))).when(n % 7 == 3, F.lit("")).otherwise(F.col("text"))
    rows = lines(spark, sf_dir, where).select("doc_id", F.floor(n / 10).cast("int").alias("page_pos"), (F.floor(n / 10) + 1).cast("int").alias("page_num"), "line_no", text.alias("text"))
    return rows


MARKDOWN = (
    LINES
    + """, md AS (
  SELECT doc_id, line_no // 10 AS page_pos, line_no // 10 + 1 AS page_num, line_no,
         CASE line_no % 7 WHEN 0 THEN '### A' || (line_no // 7) WHEN 2 THEN '#### B' || line_no
              WHEN 4 THEN '##### C' || line_no WHEN 3 THEN '' ELSE text END AS text FROM lines
), marked AS (
  SELECT *, CASE WHEN text LIKE '### A%' THEN 3 WHEN text LIKE '#### B%' THEN 4 WHEN text LIKE '##### C%' THEN 5 END AS level,
         CASE WHEN text LIKE '### A%' OR text LIKE '#### B%' OR text LIKE '##### C%' THEN trim(ltrim(text, '#')) END AS title FROM md
), latest AS (
  SELECT *, max(CASE WHEN level = 3 THEN line_no END) OVER w AS l3, max(CASE WHEN level = 4 THEN line_no END) OVER w AS l4,
         max(CASE WHEN level = 5 THEN line_no END) OVER w AS l5, max(CASE WHEN level < 4 THEN line_no END) OVER w AS c4,
         max(CASE WHEN level < 5 THEN line_no END) OVER w AS c5, count(level) OVER w AS part
  FROM marked WINDOW w AS (PARTITION BY doc_id, page_pos ORDER BY line_no ROWS UNBOUNDED PRECEDING)
), pathed AS (
  SELECT s.*, t3.title AS h3, CASE WHEN s.l4 > coalesce(s.c4, -1) THEN t4.title END AS h4,
         CASE WHEN s.l5 > coalesce(s.c5, -1) THEN t5.title END AS h5
  FROM latest s LEFT JOIN marked t3 ON t3.doc_id = s.doc_id AND t3.line_no = s.l3
  LEFT JOIN marked t4 ON t4.doc_id = s.doc_id AND t4.line_no = s.l4
  LEFT JOIN marked t5 ON t5.doc_id = s.doc_id AND t5.line_no = s.l5
), parts AS (
  SELECT doc_id, page_pos, page_num, part, max(h3) AS h3, max(h4) AS h4, max(h5) AS h5,
         regexp_replace(regexp_replace(coalesce(string_agg(text, chr(10) ORDER BY line_no) FILTER (level IS NULL), ''),
                        '\\n{3,}', chr(10) || chr(10), 'g'), '^\\s+|\\s+$', '', 'g') AS body
  FROM pathed GROUP BY doc_id, page_pos, page_num, part
), sections AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id, page_pos ORDER BY part) - 1 AS section_idx
  FROM parts WHERE part > 0 OR body <> ''
)"""
)


def boxes(spark: SparkSession, sf_dir: str, dealt: bool = True) -> tuple[DataFrame, DataFrame]:
    """Lines and blocks with boxes, made of line items; an order is a document of one page. ``dealt``: in shares of a bounded
    number of rows, those of an order in one."""
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    rows = (shared_out(items, "l_orderkey") if dealt else items).groupBy(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("n")).agg(F.max("l_quantity").alias("q"))
    rows = rows.withColumn("page", F.lit(0))

    def box(x: Column, y: Column, w: float, h: float, number: str) -> DataFrame:
        return rows.select("doc_id", "page", F.col("n").alias(number), x.alias("x0"), y.alias("y0"), (x + w).alias("x1"), (y + h).alias("y1"))

    return box(F.col("q") * 3.0, F.col("n") * 12.0, 40.0, 10.0, "line_no"), box((F.col("n") % 3) * 50.0, F.col("n") * 11.0, 60.0, 14.0, "block_no")


BOXES = """b AS (
  SELECT l_orderkey AS doc_id, l_linenumber AS n, max(l_quantity) AS q FROM lineitem GROUP BY ALL
), li AS (
  SELECT doc_id, n AS line_no, q * 3.0 AS x0, n * 12.0 AS y0, q * 3.0 + 40.0 AS x1, n * 12.0 + 10.0 AS y1 FROM b
), bl AS (
  SELECT doc_id, n AS block_no, (n % 3) * 50.0 AS x0, n * 11.0 AS y0, (n % 3) * 50.0 + 60.0 AS x1, n * 11.0 + 14.0 AS y1 FROM b
), pairs AS (
  SELECT li.doc_id, line_no, block_no, greatest(0, least(li.x1, bl.x1) - greatest(li.x0, bl.x0)) *
         greatest(0, least(li.y1, bl.y1) - greatest(li.y0, bl.y0)) AS area,
         sqrt(pow((li.x0 + li.x1 - bl.x0 - bl.x1) / 2, 2) * 5.0 + pow((li.y0 + li.y1 - bl.y0 - bl.y1) / 2, 2)) AS far
  FROM li JOIN bl USING (doc_id)
)"""


def attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part")
    return rows.select(F.concat(F.lit("P"), "p_partkey").alias("project"), F.col("p_brand").alias("brand"), F.col("p_type").alias("type"), F.concat(F.col("p_size").cast("string"), F.lit(" cm")).alias("size_cm"), F.format_string("%.2f", "p_retailprice").alias("price"))


FIELDS = ["brand", "type", "size_cm", "price"]
ATTRIBUTES = """wide AS (
  SELECT 'P' || p_partkey AS project, p_brand AS brand, p_type AS type, p_size || ' cm' AS size_cm, printf('%.2f', p_retailprice) AS price FROM part
), long AS (
  SELECT project, attr, value FROM (UNPIVOT wide ON brand, type, size_cm, price INTO NAME attr VALUE value)
), attrs AS (
  SELECT project, attr, value, CASE WHEN regexp_full_match(v, '[-+]?(\\d+\\.?\\d*|\\.\\d+)') THEN TRY_CAST(v AS DOUBLE)
    WHEN f <> '' AND length(v) - length(f) <= 4 THEN TRY_CAST(f AS DOUBLE) END AS number
  FROM (SELECT *, replace(trim(value), ',', '') AS v, regexp_extract(replace(trim(value), ',', ''), '[-+]?\\d+(?:\\.\\d+)?') AS f FROM long WHERE trim(value) <> '')
)"""


def hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Retrieved chunks: some without a page, some with scores under 0."""
    page = F.when(F.col("doc_id") % 17 != 0, (F.col("doc_id") % 3).cast("int"))
    return files(spark, sf_dir).select(F.concat("lang", F.lit("/"), "source").alias("file_key"), page.alias("page"), ((F.col("doc_id") % 13 - 3) / 10.0).alias("score"), F.col("stem").alias("project"), F.col("doc_id").alias("pos"), F.col("source").alias("entity"), F.col("stem").alias("text"))


HITS = (
    FILES
    + """, hits AS (
  SELECT lang || '/' || source AS file_key, CASE WHEN doc_id % 17 <> 0 THEN doc_id % 3 END AS page, (doc_id % 13 - 3) / 10.0 AS score,
         stem AS project, doc_id AS pos, source AS entity, stem AS text FROM files)"""
)
