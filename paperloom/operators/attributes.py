"""A structured attribute table: melting, lookup with fallbacks, name resolution, gap filling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.functions.text import grams, norm, to_number

CONFIDENCE = {"low": 0, "medium": 1, "high": 2}


def melted(wide: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """``project, attr, value, number`` from a wide table; blank cells are absent."""
    text = wide.select(F.col(key).cast("string").alias("project"), *(F.col(f).cast("string").alias(f) for f in fields))
    rows = text.unpivot(["project"], fields, "attr", "value").filter(F.trim(F.coalesce("value", F.lit(""))) != "")
    return rows.withColumn("number", to_number("value"))


def parsed_long(rows: DataFrame) -> DataFrame:
    """Long rows with a number, and ``rejected`` where project or attribute is missing. All-blank rows fall away."""
    blank = F.coalesce(F.trim(F.concat_ws("", "project", "attr", "value")), F.lit("")) == ""
    lacks = (F.trim(F.coalesce("project", F.lit(""))) == "") | (F.trim(F.coalesce("attr", F.lit(""))) == "")
    return rows.filter(~blank).withColumn("rejected", lacks).withColumn("number", to_number("value"))


def loaded(rows: DataFrame, key: str = "project") -> DataFrame:
    """``project, attr, value, number, rejected`` of an attribute table in either form, which its header tells.

    With columns project, attr and value it is long, and rows without project or attribute are marked as rejected; else
    every column but ``key`` is an attribute. White space around header names does not count.
    """
    rows = rows.toDF(*(c.strip() for c in rows.columns))
    if {"project", "attr", "value"} <= set(rows.columns):
        return parsed_long(rows).select("project", "attr", "value", "number", "rejected")
    lacks = F.trim(F.coalesce("project", F.lit(""))) == ""
    return melted(rows, key, [c for c in rows.columns if c != key]).withColumn("rejected", lacks)


def alike(a: Column, b: Column) -> Column:
    """One name holds the other, white space and case aside."""
    return (norm(a) != "") & (F.contains(norm(b), norm(a)) | F.contains(norm(a), norm(b)))


def matched_attributes(table: DataFrame, wanted: list[str]) -> DataFrame:
    """``attr`` of the table that the wanted names mean; each name takes the first that is like it, in order."""
    return _named(_attributes(table, F.lit(False)), wanted)


def _attributes(table: DataFrame, held: Column) -> DataFrame:
    """``attr, pos, held``: the table's attributes in order, and whether one of their values is meant. One scan."""
    pos = F.min("pos") if "pos" in table.columns else F.first("attr")
    return table.groupBy("attr").agg(pos.alias("pos"), F.max(held).alias("held"))


def _named(attributes: DataFrame, wanted: list[str]) -> DataFrame:
    asked = attributes.select("attr", "pos", F.explode(F.array(*map(F.lit, wanted))).alias("wanted")).filter(alike(F.col("wanted"), F.col("attr")))
    return asked.groupBy("wanted").agg(F.min_by("attr", "pos").alias("attr")).select("attr").distinct()


def looked_up(table: DataFrame, entities: list[str], wanted: list[str], only: list[str] | None = None) -> DataFrame:
    """Rows of the table for entities and attributes; where no attribute has such a name, those with such a value.

    A wanted attribute that matches neither names nor values gives no rows at all: nothing stands in for it. Names and
    entities are short lists of a question and become predicates; the table is filtered where it is stored.
    """
    if only:
        table = table.filter(norm("project").isin(sorted({"".join(p.split()).lower() for p in only})))
    asked = [e for e in ("".join(e.split()).lower() for e in entities) if e]
    if asked:
        hit = F.lit(False)
        for e in asked:
            hit = hit | F.contains(norm("project"), F.lit(e)) | F.contains(F.lit(e), norm("project"))
        table = table.filter(hit)
    if not wanted:
        return table
    held = F.lit(False)
    for w in ("".join(w.split()).lower() for w in wanted):
        held = held | F.contains(norm("value"), F.lit(w)) if w else held
    known = _attributes(table, held)
    names = _named(known, wanted)
    none = names.agg((F.count("*") == 0).alias("none"))  # one row
    chosen = names.unionByName(known.filter("held").select("attr").join(F.broadcast(none)).filter("none").select("attr"))
    return table.join(chosen, "attr", "left_semi")


def in_table_order(rows: DataFrame) -> DataFrame:
    return rows.orderBy("attr", F.desc_nulls_last("number"), "project")


def as_markdown(rows: DataFrame) -> DataFrame:
    """One table row of Markdown per row, numbers without trailing zeros."""
    number = F.when(F.col("number").isNotNull(), F.regexp_replace(F.format_string("%.6f", "number"), r"\.?0+$", "")).otherwise("")
    return rows.select("attr", "project", F.concat_ws("", F.lit("| "), F.concat_ws(" | ", "project", "attr", "value", number), F.lit(" |")).alias("line"))


def held_in(parts: DataFrame, wholes: DataFrame) -> DataFrame:
    """``part, whole``: the pairs of ``parts(part)`` and ``wholes(whole)``, both distinct, where the whole contains the part.

    A whole that contains a part has all its runs of three characters, so it is found by the one of them that the fewest
    wholes have; a part of one or two characters is a run itself. Both ways are joins on runs: no name meets all others.
    Empty parts and nulls match nothing here.
    """
    runs = wholes.select("whole", F.explode(grams("whole", 3)).alias("gram"))
    asked = parts.filter(F.length("part") >= 3).select("part", F.explode(grams("part", 3)).alias("gram"))
    # A part that has a run which no whole has is in no whole.
    rarest = asked.join(runs.groupBy("gram").agg(F.count("*").alias("n")), "gram", "left").groupBy("part").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("of"))
    found = rarest.filter("of.n > 0").select("part", F.col("of.gram").alias("gram")).join(runs, "gram").filter(F.contains("whole", "part"))
    short = parts.filter(F.length("part").isin(1, 2)).select("part", F.col("part").alias("gram"))
    few = wholes.select("whole", F.explode(F.concat(grams("whole", 1), grams("whole", 2))).alias("gram"))
    return found.select("part", "whole").unionByName(short.join(few, "gram").select("part", "whole"))


def uniquely_resolved(names: DataFrame, known: DataFrame) -> DataFrame:
    """``name, project``: equal, else the one known name that holds it, else the one that ends with it, else null.

    Equal names of ``known(project)`` are found by a join on them, what is left by ``held_in``.
    """
    known = known.filter("project IS NOT NULL").groupBy("project").agg(F.count("*").alias("copies"))
    asked = names.select("name").distinct().withColumn("key", F.trim("name"))
    asked = asked.join(known.select(F.col("project").alias("same")), (F.col("key") != "") & (F.col("key") == F.col("same")), "left")
    rest = asked.filter("same IS NULL AND key <> ''").select(F.col("key").alias("part")).distinct()
    ends = F.endswith(F.col("project"), F.col("key"))
    pairs = held_in(rest, known.select(F.col("project").alias("whole"))).select(F.col("part").alias("key"), F.col("whole").alias("project")).join(known, "project")
    found = pairs.groupBy("key").agg(F.sum("copies").alias("n"), F.min("project").alias("one"), F.sum(F.when(ends, F.col("copies"))).alias("n_ends"), F.min(F.when(ends, F.col("project"))).alias("end"))
    return asked.join(found, "key", "left").select("name", F.coalesce("same", F.when(F.col("n") == 1, F.col("one")), F.when((F.col("n") > 1) & (F.col("n_ends") == 1), F.col("end"))).alias("project"))


def greedily_resolved(mentions: DataFrame, known: DataFrame) -> DataFrame:
    """``group_id, idx, project`` for ``mentions(group_id, names)``: in order, each mention takes the first free known name
    that it holds or that holds it; null where there is none. A known empty name matches everything.

    Distinct mentions meet the known names ``known(project, pos)`` in both directions by ``held_in``; what matches a mention
    is its list of candidates, and a fold over a group's mentions takes the first free one of each.
    """
    every = mentions.select("group_id", F.posexplode("names").alias("idx", "name"))
    asked = every.select("name").distinct().withColumn("m", norm("name")).filter("m <> ''")
    own = known.select("project", "pos", norm("project").alias("k"))
    ms, ks = asked.select("m").distinct(), own.select("k").filter("k <> ''").distinct()
    within = held_in(ms.withColumnRenamed("m", "part"), ks.withColumnRenamed("k", "whole")).select(F.col("part").alias("m"), F.col("whole").alias("k"))
    around = held_in(ks.withColumnRenamed("k", "part"), ms.withColumnRenamed("m", "whole")).select(F.col("whole").alias("m"), F.col("part").alias("k"))
    pairs = within.unionByName(around).distinct().join(own, "k").select("m", "pos", "project")
    empty = own.filter("k = ''").agg(F.collect_list(F.struct("pos", "project")).alias("all"))  # one row
    everywhere = ms.crossJoin(F.broadcast(empty)).select("m", F.explode("all").alias("e")).select("m", "e.pos", "e.project")
    matches = asked.join(pairs.unionByName(everywhere), "m").select("name", "pos", "project")
    lists = matches.groupBy("name").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "project"))), lambda x: x["project"]).alias("found"))
    rows = every.join(lists, "name", "left")
    ordered = F.array_sort(F.collect_list(F.struct("idx", F.coalesce("found", F.array().cast("array<string>")).alias("found"))))
    start = F.struct(F.array().cast("array<string>").alias("taken"), F.array().cast("array<string>").alias("out"))

    def step(state: Column, mention: Column) -> Column:
        hit = F.get(F.filter(mention["found"], lambda p: ~F.array_contains(state["taken"], p)), F.lit(0))
        return F.struct(F.when(hit.isNull(), state["taken"]).otherwise(F.concat(state["taken"], F.array(hit))).alias("taken"), F.concat(state["out"], F.array(hit)).alias("out"))

    folded = rows.groupBy("group_id").agg(F.aggregate(ordered, start, step)["out"].alias("out"))
    return folded.select("group_id", F.posexplode("out").alias("idx", "project"))


def gated(cells: DataFrame, least: str = "medium", overwrite: bool = False) -> DataFrame:
    """Cells with ``state``: skipped if filled already, not found, low confidence, adopted; and the ``new_value``."""
    rank = F.element_at(F.create_map(*[F.lit(x) for kv in CONFIDENCE.items() for x in kv]), F.col("confidence"))
    has = F.trim(F.coalesce("value", F.lit(""))) != ""
    state = F.when(has & F.lit(not overwrite), "skipped").when(F.trim(F.coalesce("answer", F.lit(""))) == "", "not_found").when(F.coalesce(rank, F.lit(-1)) < CONFIDENCE[least], "low_confidence").otherwise("adopted")
    return cells.withColumn("state", state).withColumn("new_value", F.when(F.col("state") == "adopted", F.col("answer")).otherwise(F.col("value")))


def in_first_seen_order(rows: DataFrame, field: str, pos: str) -> DataFrame:
    """``field, first_pos``: distinct values by where they were first seen. ``first_pos`` is the order; a sort by range
    gives it to any number of values."""
    return rows.groupBy(field).agg(F.min(pos).alias("first_pos")).orderBy("first_pos")


def unmatched_attributes(table: DataFrame, wanted: list[str]) -> list[str]:
    """The wanted names that are like no attribute of the table, in order; a question's names are few."""
    spark = table.sparkSession
    asked = spark.createDataFrame([(w,) for w in dict.fromkeys(wanted)], "wanted string")
    hit = {r.wanted for r in table.select("attr").distinct().join(F.broadcast(asked), alike(F.col("wanted"), F.col("attr"))).select("wanted").distinct().collect()}
    return [w for w in dict.fromkeys(wanted) if w not in hit]
