"""License scans by diagonal voting over word k-grams."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from paperloom.llm.common import documents

#: Phrases whose places are counted exactly, and their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: Passages that a document may hold with some words changed, and their labels.
PASSAGES = {
    "licensed under cc by nc 4 0": "cc-by-nc",
    "this work is licensed under the gnu general public license version 3": "gpl",
    "licensed under the apache license version 2 0": "apache",
    "released under the mit license": "mit",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files": "mit",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "bsd",
    "this source code form is subject to the terms of the mozilla public license": "mpl",
    "all rights reserved": "reserved",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software": "mit",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution": "bsd",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies": "isc",
    "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license": "apache",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details you should have received a copy of the gnu general public license along with this program": "gpl",
    "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means": "unlicense",
}
#: Words of a gram. With two, a passage whose kept words stand in pairs at least has all of them in grams, whatever its length.
K = 2
#: Diagonals apart that still merge, share of a passage's words that a span needs, longest span against the passage in halves.
GAP, COVER, STRETCH_HALVES = 3, 0.8, 3
#: A span's length in the order that its window looks along; every template's own length is scaled to it.
SCALE = 1 << 20
#: The Kelvin sign is the one character outside A-Z that ``lower`` turns into an ASCII letter alone.
KELVIN = "K"


def words_of(text: Column) -> Column:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` with A-Z in lower case; null has none."""
    plain = F.lower(F.replace(F.coalesce(text, F.lit("")), F.lit(KELVIN), F.lit("Å")))
    return F.array_remove(F.split(plain, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), "")


def template_grams(phrases: dict[str, str], passages: dict[str, str]) -> list[tuple]:
    """``template, label, exact, words, k, span, at`` and the gram's words, for each gram of each template.

    ``span`` is the number of places that grams of one span may start at.
    """
    rows = []
    for number, (text, label, exact) in enumerate([(t, v, True) for t, v in phrases.items()] + [(t, v, False) for t, v in passages.items()]):
        words = text.split()
        if len(words) < K:
            raise ValueError(f"a template has {K} words or more, not {len(words)}")
        span = (len(words) if exact else len(words) * STRETCH_HALVES // 2) - K + 1
        rows += [(number, label, exact, len(words), K, span, at, *words[at : at + K]) for at in range(len(words) - K + 1)]
    return rows


def templates(spark: SparkSession, phrases: dict[str, str], passages: dict[str, str]) -> DataFrame:
    """The grams of the templates with their hash ``gram``, and template -1 for the row that each document sends ahead; fixed and small."""
    rows = [(-1, "", False, 1, 0, 1, 0, *[None] * K), *template_grams(phrases, passages)]
    schema = "template int, label string, exact boolean, words int, k int, span int, at int, " + ", ".join(f"t{j} string" for j in range(K))
    gram = F.when(F.col("k") == 0, F.lit(0).cast("long")).otherwise(gram_hash("t", K))
    return spark.createDataFrame(rows, schema).withColumn("gram", gram)


def gram_hash(prefix: str, k: int) -> Column:
    return F.xxhash64(*(f"{prefix}{j}" for j in range(k)))


def scanned(docs: DataFrame, key: str = "doc_id", text: str = "text", phrases: dict[str, str] = PHRASES, passages: dict[str, str] = PASSAGES) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score``.

    Every rolling word gram of every document is joined, by its hash and then word by word, to the places it has in the
    templates, which are broadcast (their number is fixed). A match votes for the diagonal document place minus template
    place. Votes of a document and template are laid out by diagonal, and neighbouring diagonals merge: for a phrase only
    the same one, for a passage those up to ``GAP`` apart, less than it has words. Within a merged run, spans are
    verified: the grams that start within a stretch of one and a half times the passage's length, from any vote on, have
    to hold ``COVER`` of the template's words; a phrase needs all its words in place. So inserted, dropped or changed words
    do not hide a passage, and neither do copies of it next to each other. ``score`` is the largest share of a template's
    words that a span has.

    Each document sends one row ahead of its matches, so the result has all documents from a single scan. Null and empty
    texts have no words; then ``first_word`` and ``last_word`` are null, labels '' and the score 0. Very long texts are
    scanned whole. Ids may be null or repeat, and repeated rows are scanned one by one; an empty table gives an empty
    result; other columns are not read.
    """
    spark = docs.sparkSession
    source = docs.select(F.monotonically_increasing_id().alias("uid"), F.col(f"`{key}`").alias("doc_id"), F.concat(F.array(F.lit("")), words_of(F.col(f"`{text}`"))).alias("doc_words"))
    places = source.select("uid", "doc_id", F.size("doc_words").alias("n"), "doc_words", F.posexplode("doc_words").alias("i", "w0"))
    places = places.select("uid", "doc_id", "n", (F.col("i") - 1).alias("i"), "w0", *(F.get("doc_words", F.col("i") + j).alias(f"w{j}") for j in range(1, K)))
    ahead = F.col("i") < 0
    gram = F.when(ahead, F.lit(0).cast("long")).when(F.col(f"w{K - 1}").isNotNull(), gram_hash("w", K))
    grams = places.withColumn("gram", gram)
    alike = reduce(Column.__and__, [F.col(f"w{j}") == F.col(f"t{j}") for j in range(K)])
    same = ahead & (F.col("k") == 0) | ~ahead & (F.col("k") > 0) & alike
    votes = grams.join(F.broadcast(templates(spark, phrases, passages)), "gram").filter(same)
    votes = votes.select("uid", "doc_id", "n", "template", "label", "exact", "words", "k", "span", "i", "at", (F.col("i") - F.col("at")).alias("diagonal")).repartition("uid")
    along = Window.partitionBy("uid", "template").orderBy("diagonal", "i")
    gap = F.when(F.col("exact"), 0).otherwise(F.least(F.lit(GAP), F.col("words") - 1))
    runs = votes.withColumn("start", F.when(F.col("diagonal") - F.lag("diagonal").over(along) > gap, 1).otherwise(0)).withColumn("run", F.sum("start").over(along))
    scaled = F.expr(f"i * {SCALE}L div span")
    stretch = Window.partitionBy("uid", "template", "run").orderBy("scaled").rangeBetween(0, SCALE - 1)
    spans = runs.withColumn("scaled", scaled).withColumn("ats", F.collect_set("at").over(stretch))
    covered = F.size(F.array_distinct(F.flatten(F.transform("ats", lambda a: F.sequence(a, a + F.col("k") - 1)))))
    spans = spans.withColumn("cover", F.when(F.col("k") > 0, covered / F.col("words"))).withColumn("base", F.col("exact") & F.coalesce(F.col("cover") == 1.0, F.lit(False)))
    passage = ~F.col("exact") & (F.col("cover") >= COVER)
    start = F.when(F.col("base"), F.col("i")).cast("long")

    def joined(chosen: Column) -> Column:
        return F.array_join(F.array_sort(F.collect_set(F.when(chosen, F.col("label")))), ",")

    return spans.groupBy("uid").agg(F.first("doc_id").alias("doc_id"), (F.first("n") - 1).cast("long").alias("n_words"), F.count_if("base").alias("n_base"), F.min(start).alias("first_word"), F.max(start).alias("last_word"), joined(F.col("base")).alias("base_labels"), joined(F.col("base") | passage).alias("labels"), F.coalesce(F.max("cover"), F.lit(0.0)).alias("score")).drop("uid")


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scanned(documents(spark, sf_dir))


def _template_rows() -> str:
    return ", ".join(f"({n}, '{label}', {str(exact).lower()}, {words}, {k}, {span}, {at}, '{' '.join(t for t in gram if t)}')" for n, label, exact, words, k, span, at, *gram in template_grams(PHRASES, PASSAGES))


OP9_SQL = rf"""
WITH d AS (
  SELECT row_number() OVER () AS uid, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
), tg AS (
  SELECT * FROM (VALUES {_template_rows()}) AS v(template, label, exact, words, k, span, place, gram)
), g AS (
  SELECT uid, i - 1 AS i, k, array_to_string(w[i:i + k - 1], ' ') AS gram
  FROM (SELECT uid, w, {K} AS k, unnest(range(1, len(w) - {K} + 2)) AS i FROM d WHERE len(w) >= {K})
), votes AS (
  SELECT uid, template, label, exact, words, tg.k AS k, span, i, place, i - place AS diagonal FROM g JOIN tg ON g.k = tg.k AND g.gram = tg.gram
), marked AS (
  SELECT *, CASE WHEN diagonal - lag(diagonal) OVER (PARTITION BY uid, template ORDER BY diagonal, i)
                      > CASE WHEN exact THEN 0 ELSE least({GAP}, words - 1) END THEN 1 ELSE 0 END AS start
  FROM votes
), runs AS (
  SELECT *, sum(start) OVER (PARTITION BY uid, template ORDER BY diagonal, i) AS run, CAST(i AS BIGINT) * {SCALE} // span AS scaled FROM marked
), spans AS (
  SELECT *, list(place) OVER (PARTITION BY uid, template, run ORDER BY scaled RANGE BETWEEN CURRENT ROW AND {SCALE - 1} FOLLOWING) AS places FROM runs
), verified AS (
  SELECT *, exact AND cover = 1 AS base, NOT exact AND cover >= {COVER} AS passage
  FROM (SELECT *, len(list_distinct(flatten(list_transform(places, lambda p: range(p, p + k))))) / words AS cover FROM spans)
), s AS (
  SELECT uid, count(*) FILTER (base) AS n_base, min(i) FILTER (base) AS first_word, max(i) FILTER (base) AS last_word,
         array_to_string(list_sort(list(DISTINCT label) FILTER (base)), ',') AS base_labels,
         array_to_string(list_sort(list(DISTINCT label) FILTER (base OR passage)), ',') AS labels, max(cover) AS score
  FROM verified GROUP BY uid
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word,
       coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0) AS score
FROM d LEFT JOIN s USING (uid)
"""
