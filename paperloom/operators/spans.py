"""Characters with tags among them to spans of one set of formats, in lines."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The tags that stand among characters and their formats.
TAGS = {"b": "bold", "i": "italic", "math": "math"}
BOX = ["x0", "y0", "x1", "y1"]


def formatted_spans(chars: DataFrame, by: list[str], tags: dict[str, str] = TAGS) -> DataFrame:
    """``*by, line, span, text, formats, x0..y1`` from ``chars(*by, pos, text, x0..y1)``, some of whose texts are tags.

    An opening tag opens its format unless it is open already, then it is text like any other; a closing tag closes it, and
    one without an opening tag is dropped. What lies between two changes of the open formats is a span, with the sorted open
    formats and ``plain``; a formula's tag is the beginning of its span, whose box it gives, other spans have the box around
    their characters. ``<br>`` ends a line; a line without spans is none; a line's last span ends with a line break.

    The state of a format before a place is that of its last tag, so a window over a stream's characters tells what each
    tag does, and running counts of what has an effect number the spans.
    """
    stream = Window.partitionBy(*by).orderBy("pos")
    earlier = stream.rowsBetween(Window.unboundedPreceding, -1)
    known = "|".join(tags)
    opening = F.regexp_extract("text", rf"^<({known})(?:\s[^>]*)?>", 1)
    closing = F.regexp_extract("text", rf"^</({known})>", 1)
    tag = F.startswith(F.col("text"), F.lit("<"))
    rows = chars.withColumn("opens", F.when(tag, F.nullif(opening, F.lit("")))).withColumn("closes", F.when(tag, F.nullif(closing, F.lit(""))))
    formats = sorted(set(tags.values()))
    own = lambda f, column: F.col(column).isin([t for t, name in tags.items() if name == f])
    event = lambda f: F.when(own(f, "opens"), True).when(own(f, "closes"), False)
    # In one projection the columns over one window are one pass over the rows.
    rows = rows.select("*", *(F.coalesce(F.last(event(f), ignorenulls=True).over(earlier), F.lit(False)).alias(f"was_{f}") for f in formats))
    begun = reduce(Column.__or__, [own(f, "opens") & ~F.col(f"was_{f}") for f in formats])
    ended = reduce(Column.__or__, [own(f, "closes") & F.col(f"was_{f}") for f in formats])
    rows = rows.withColumn("break", F.col("text") == "<br>").withColumn("begun", F.coalesce(begun, F.lit(False))).withColumn("ended", F.coalesce(ended, F.lit(False)))
    now = [((F.col(f"was_{f}") & ~F.coalesce(own(f, "closes"), F.lit(False))) | F.coalesce(own(f, "opens"), F.lit(False))).alias(f"is_{f}") for f in formats]
    count = lambda c: F.sum(F.when(c, 1).otherwise(0)).over(stream)
    rows = rows.select("*", *now, count(F.col("break")).alias("brs"), count(F.col("break") | F.col("begun") | F.col("ended")).alias("island"))
    formula = F.col("begun") & (F.col("opens") == "math") if "math" in tags else F.lit(False)
    shown = rows.withColumn("formula", F.coalesce(formula, F.lit(False))).filter(~F.col("break") & (F.col("formula") | (~F.col("begun") & F.col("closes").isNull())))
    letters = F.array_sort(F.collect_list(F.struct("pos", F.when(F.col("formula"), "").otherwise(F.col("text")).alias("t"))))
    head = lambda c: F.min_by(c, "pos")
    math = F.first("is_math") if "math" in formats else F.lit(False)
    around = [F.when(math, head(c)).otherwise(f(c)).alias(c) for c, f in zip(BOX, (F.min, F.min, F.max, F.max), strict=True)]
    spans = shown.groupBy(*by, "brs", "island").agg(F.min("pos").alias("first"), F.array_join(F.transform(letters, lambda x: x["t"]), "").alias("text"), *(F.first(f"is_{f}").alias(f"is_{f}") for f in formats), *around)
    named = F.array_sort(F.filter(F.array(F.lit("plain"), *(F.when(F.col(f"is_{f}"), f) for f in formats)), lambda x: x.isNotNull()))
    spans = spans.withColumn("formats", named)
    line = F.dense_rank().over(Window.partitionBy(*by).orderBy("brs")) - 1
    in_line = Window.partitionBy(*by, "brs").orderBy("first")
    last = F.lead("first").over(in_line).isNull()
    return spans.select(*by, line.alias("line"), (F.row_number().over(in_line) - 1).alias("span"), F.when(last, F.concat("text", F.lit("\n"))).otherwise(F.col("text")).alias("text"), "formats", *BOX)
