"""File inventories: totals, facets, snapshots and their differences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperloom.operators.positions import numbered

from paperloom.functions.text import extension_of, file_name, path_parts


def totals(files: DataFrame, by: str, size: str = "size") -> DataFrame:
    """``by, n_files, bytes`` for each value."""
    return files.groupBy(by).agg(F.count("*").alias("n_files"), F.sum(size).alias("bytes"))


def totals_with_share(files: DataFrame, by: str, size: str = "size") -> DataFrame:
    """Totals by value with the share of all bytes, the mean size rounded down, and a row ``TOTAL``."""
    rolled = files.rollup(by).agg(F.count("*").alias("n_files"), F.sum(size).alias("bytes"), F.grouping(by).alias("g"))
    whole = F.max(F.when(F.col("g") == 1, F.col("bytes"))).over(Window.partitionBy(F.lit(0)))
    return rolled.select(F.when(F.col("g") == 1, F.lit("TOTAL")).otherwise(F.col(by)).alias(by), "n_files", "bytes", F.round(F.col("bytes") * 100.0 / whole, 4).alias("pct"), F.floor(F.col("bytes") / F.col("n_files")).alias("mean_bytes"))


def largest(files: DataFrame, n: int, size: str = "size", path: str = "file_key") -> DataFrame:
    """The ``n`` largest files, of equal ones the later path first."""
    return files.orderBy(F.desc(size), F.desc(path)).limit(n)


def distinct_values(rows: DataFrame, field: str, where: Column | None = None, most: int = 1000) -> DataFrame:
    """The values of a facet in order, without missing ones."""
    rows = rows if where is None else rows.filter(where)
    return rows.filter(F.coalesce(F.col(field), F.lit("")) != "").select(F.col(field).alias("value")).distinct().orderBy("value").limit(most)


def value_counts(rows: DataFrame, field: str) -> DataFrame:
    return rows.groupBy(F.col(field).alias("value")).agg(F.count("*").alias("n"))


def zero_filled(rows: DataFrame, field: str, domain: DataFrame) -> DataFrame:
    """Counts for every value of ``domain(value)``, 0 for those that don't occur."""
    return F.broadcast(domain).join(value_counts(rows, field), "value", "left").select("value", F.coalesce("n", F.lit(0)).alias("n"))


def in_parts(rows: DataFrame, key: Column, item: Column, facts: list[Column], size: int) -> DataFrame:
    """``rows`` with ``key``, the group's ``facts`` and a ``part``: groups of any size in parts of about ``size`` members.

    A member's part follows from a hash of it, so no task orders or numbers a whole group; facts are partial sums, and the
    join of members to them splits a hot group. A null key is a group of its own.
    """
    keyed = rows.withColumn("key", key)
    own = keyed.groupBy(F.col("key").alias("_k")).agg(F.count("*").alias("n"), *facts)
    both = keyed.join(own, F.col("key").eqNullSafe(F.col("_k"))).drop("_k")
    digest = F.conv(F.substring(F.md5(item.cast("string")), 1, 8), 16, 10).cast("long")
    return both.withColumn("part", F.pmod(digest, F.ceil(F.col("n") / size)).cast("int"))


def collisions(rows: DataFrame, key: Column, item: str, size: int = 1000) -> DataFrame:
    """Keys that several items share: ``key, n, part, items`` with the items of a part in order."""
    shared = in_parts(rows, key, F.col(item), [], size).filter("n > 1")
    return shared.groupBy("key", "n", "part").agg(F.array_join(F.sort_array(F.collect_list(item)), "|").alias("items"))


def diff_by_path(old: DataFrame, new: DataFrame, key: str = "file_key", stamp: str = "mtime") -> DataFrame:
    """``key, change``: added, lost, or modified where the stamps differ."""
    both = old.select(key, F.col(stamp).alias("before"), F.lit(True).alias("was")).join(new.select(key, F.col(stamp).alias("after"), F.lit(True).alias("is")), key, "full_outer")
    change = F.when(F.col("was").isNull(), "added").when(F.col("is").isNull(), "lost").when(~F.col("before").eqNullSafe(F.col("after")), "modified")
    return both.select(key, change.alias("change")).filter("change IS NOT NULL")


def diff_by_stem(old: DataFrame, new: DataFrame, written: DataFrame) -> DataFrame:
    """``stem, old_key, new_key, state`` by stem: unchanged, moved, new with or without output, disappeared.

    ``written(stem)`` are stems whose output exists. Of several files with a stem the last by key counts, on each side.
    """
    last = lambda rows, name: rows.groupBy("stem").agg(F.max("file_key").alias(name))
    both = last(old, "old_key").join(last(new, "new_key"), "stem", "full_outer")
    both = both.join(written.select("stem", F.lit(True).alias("has")).distinct(), "stem", "left")
    state = F.when(F.col("new_key").isNull(), "disappeared").when(F.col("old_key").isNull(), F.when(F.col("has"), "new_with_output").otherwise("new_without_output")).when(F.col("old_key") == F.col("new_key"), "unchanged").otherwise("moved")
    return both.select("stem", "old_key", "new_key", state.alias("state"))


def carried_status(files: DataFrame, before: DataFrame, default: str = "unprocessed") -> DataFrame:
    """The files with the status they had, as long as their time stamp is the same."""
    old = before.select("file_key", F.col("mtime").alias("old_mtime"), F.col("status").alias("old_status"))
    kept = F.when(F.col("mtime") == F.col("old_mtime"), F.col("old_status"))
    return files.join(old, "file_key", "left").withColumn("status", F.coalesce(kept, F.lit(default))).drop("old_mtime", "old_status")


def matched_by_hash(disk: DataFrame, index: DataFrame) -> DataFrame:
    """Content hashes on disk and in an index: same, moved, missing in the index, orphaned there.

    Of several files with one hash the last path counts.
    """
    d = disk.groupBy("file_hash").agg(F.max("file_key").alias("disk_key"))
    i = index.groupBy("file_hash").agg(F.max("file_key").alias("index_key"))
    state = F.when(F.col("index_key").isNull(), "missing").when(F.col("disk_key").isNull(), "orphan").when(F.col("disk_key") == F.col("index_key"), "same").otherwise("moved")
    return d.join(i, "file_hash", "full_outer").select("file_hash", "disk_key", "index_key", state.alias("state"))


def without_partner(left: DataFrame, right: DataFrame, on: str) -> DataFrame:
    return left.join(right.select(on).distinct(), on, "left_anti")


def processed(files: DataFrame, outputs: DataFrame) -> DataFrame:
    """The files whose output exists, once each, in order."""
    return files.join(outputs, "stem", "left_semi").select("file_key").distinct().orderBy("file_key")


def tail_of(key: Column | str, parts: int = 2) -> Column:
    """The last parts of a path, by which moved trees are recognised."""
    own = path_parts(key)
    return F.array_join(F.slice(own, F.greatest(F.size(own) - parts + 1, F.lit(1)), F.lit(parts)), "/")


def matched_by_tail_or_stem(old: DataFrame, new: DataFrame) -> DataFrame:
    """``file_key, new_key, how`` for each old key: by path tail, else by a stem that only one new file has."""
    tails = new.groupBy(tail_of("file_key").alias("tail")).agg(F.max("file_key").alias("by_tail"))
    stems = new.groupBy("stem").agg(F.count("*").alias("n"), F.min("file_key").alias("by_stem"))
    joined = old.withColumn("tail", tail_of("file_key")).join(tails, "tail", "left").join(stems, "stem", "left")
    how = F.when(F.col("by_tail").isNotNull(), "tail").when(F.col("n") == 1, "stem").when(F.col("n") > 1, "ambiguous").otherwise("orphan")
    return joined.select("file_key", F.coalesce("by_tail", F.when(F.col("n") == 1, F.col("by_stem"))).alias("new_key"), how.alias("how"))


def transitions(rows: DataFrame, old: str, new: str) -> DataFrame:
    return rows.groupBy(F.col(old).alias("old_value"), F.col(new).alias("new_value")).agg(F.count("*").alias("n"))


def ids_by_file(rows: DataFrame, file: str, item: str, source: str, order: str, size: int = 1000) -> DataFrame:
    """``file, n, part, items, source``: a file's items in parts, each in order, and the source of the file's first."""
    parts = in_parts(rows, F.col(file), F.col(item), [F.min_by(source, order).alias("first_source")], size)
    return parts.groupBy(F.col("key").alias("file"), "n", "part", F.col("first_source").alias("source")).agg(F.array_join(F.sort_array(F.collect_list(F.col(item))), ",").alias("items"))


def folders(files: DataFrame) -> DataFrame:
    """Every folder above a file once, with its depth."""
    parts = path_parts("file_key")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    return files.filter(F.size(parts) > 1).select(F.explode(prefixes).alias("folder")).distinct().select("folder", F.size(path_parts("folder")).alias("depth"))


def processing_estimate(files: DataFrame, seconds: dict[str, int]) -> DataFrame:
    """Per top folder the files, bytes and estimated seconds, by extension."""
    table = F.create_map(*[F.lit(x) for kv in seconds.items() for x in kv])
    top = F.get(path_parts("file_key"), F.lit(0))
    return files.groupBy(top.alias("folder")).agg(F.count("*").alias("n_files"), F.sum("size").alias("bytes"), F.sum(F.coalesce(F.element_at(table, extension_of("file_key")), F.lit(0))).cast("long").alias("seconds"))


def trashed_names(files: DataFrame) -> DataFrame:
    """Names without collisions: the second file of a name gets ``__1`` and so on."""
    n = F.row_number().over(Window.partitionBy(file_name("file_key")).orderBy("file_key")) - 1
    return files.select("file_key", F.when(n == 0, file_name("file_key")).otherwise(F.concat(file_name("file_key"), F.lit("__"), n.cast("string"))).alias("trash_name"))


def located(refs: DataFrame, files: DataFrame) -> DataFrame:
    """``ref, file_key``: the file of a stored key; where a folder was renamed, the first of its type with that name."""
    direct = files.select(F.col("file_key").alias("ref"), F.col("file_key").alias("same"))
    named = files.groupBy(F.get(path_parts("file_key"), F.lit(0)).alias("folder"), file_name("file_key").alias("name")).agg(F.min("file_key").alias("found"))
    rows = refs.withColumn("folder", F.get(path_parts("ref"), F.lit(0))).withColumn("name", file_name("ref"))
    return rows.join(direct, "ref", "left").join(named, ["folder", "name"], "left").select("ref", F.coalesce("same", "found").alias("file_key"))


def saved_images(images: DataFrame) -> DataFrame:
    """Images with ``saved_as``: the name under which their content was first saved in their document."""
    w = Window.partitionBy("doc_id", "hash").orderBy("page", "seq")
    name = F.concat_ws("_", F.lit("p"), F.first("page").over(w), F.first("seq").over(w))
    return images.withColumn("saved_as", name).withColumn("is_new", F.row_number().over(w) == 1)


def used_elsewhere(refs: DataFrame) -> DataFrame:
    """References whose path another page of the document has too."""
    w = Window.partitionBy("doc_id", "path")
    return refs.withColumn("_a", F.min("page").over(w)).withColumn("_b", F.max("page").over(w)).filter("_a <> _b").drop("_a", "_b")


def shard(files: DataFrame, part: int, parts: int, key: str = "file_key", most: int | None = None) -> DataFrame:
    """The ``part``-th of ``parts`` portions of the files, of these the first ``most`` by key where a limit is asked for.

    A hash deals them, so no order over all files is needed; a portion's limit keeps so many rows a task.
    """
    digest = F.conv(F.substring(F.md5(F.col(key)), 1, 8), 16, 10).cast("long")
    own = files.filter(F.pmod(digest, F.lit(parts)) == part)
    return own if most is None else own.orderBy(key).limit(most)


def shard_in_order(files: DataFrame, part: int, parts: int, key: str = "file_key", most: int | None = None) -> DataFrame:
    """The ``part``-th of ``parts`` runs of the files in order of their key, each of the same length but the last; of these the
    first ``most``. The files are numbered by the counts of sorted tasks, and no task sees them all."""
    rows = numbered(files, key, name="_ordinal")
    size = F.ceil(F.lit(files.count()) / parts)
    end = (part + 1) * size if most is None else F.least((part + 1) * size, part * size + most)
    return rows.filter((F.col("_ordinal") >= part * size) & (F.col("_ordinal") < end)).drop("_ordinal")
