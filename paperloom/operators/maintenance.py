"""Keeping an index up to date: upserts, partial updates, incremental work, states."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def upserted(base: DataFrame, delta: DataFrame, key: str) -> DataFrame:
    """``base`` with the rows of ``delta`` in place of those with the same key."""
    return base.join(delta.select(key).distinct(), key, "left_anti").unionByName(delta)


def payload_updated(base: DataFrame, updates: DataFrame, key: str, field: str, nested: str) -> DataFrame:
    """One nested field of some rows replaced: ``updates(key, new_value)``; vectors and other fields stay as they are."""
    rows = base.join(updates.select(key, F.col("new_value").alias("_new")), key, "left")
    old = F.col(f"{field}.{nested}")
    return rows.withColumn(field, F.col(field).withField(nested, F.coalesce("_new", old))).drop("_new")


def still_to_encode(chunks: DataFrame, cache: DataFrame, on: list[str]) -> DataFrame:
    """Chunks without vectors of this strategy, model and version."""
    return chunks.join(cache.select(*on).distinct(), on, "left_anti")


def cache_reasons(manifest: DataFrame, expected: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """``key, valid, reason``: which fields of a cache's manifest changed, in order; ``no cache`` where there is none."""
    m = manifest.select(key, *(F.col(f).alias(f"m_{f}") for f in fields), F.lit(True).alias("has"))
    rows = expected.join(m, key, "left")
    reasons = F.filter(F.array(*(F.when(~F.col(f).eqNullSafe(F.col(f"m_{f}")), F.lit(f"{f} changed")) for f in fields)), lambda x: x.isNotNull())
    return rows.select(key, (F.coalesce("has", F.lit(False)) & (F.size(reasons) == 0)).alias("valid"), F.when(F.col("has").isNull(), "no cache").otherwise(F.array_join(reasons, ", ")).alias("reason"))


def classified(files: DataFrame, tracker: DataFrame, protected: DataFrame, done: str = "SUCCESS") -> DataFrame:
    """Files with ``action``: protected ones are safe, finished ones resumed, others processed; the first that holds."""
    rows = files.join(tracker.select("file_key", F.col("status").alias("_t")), "file_key", "left").join(protected.select("file_key", F.lit(True).alias("_p")).distinct(), "file_key", "left")
    return rows.withColumn("action", F.when(F.col("_p"), "safe_skip").when(F.col("_t") == done, "resume_skip").otherwise("process")).drop("_t", "_p")


def last_state(log: DataFrame, key: str, state: str, order: list[str]) -> DataFrame:
    """``key, state``: the latest entry of each key."""
    return log.groupBy(key).agg(F.max_by(state, F.struct(*order)).alias(state))


def undone_free(log: DataFrame) -> DataFrame:
    """Actions of an append-only log without those that a later undo names by ``target``."""
    undo = log.filter("action = 'undo'").select(F.col("target").alias("entry_id"))
    return log.filter("action <> 'undo'").join(undo, "entry_id", "left_anti")


def phase_times(log: DataFrame, by: str, phase: str, ts: str, order: list[str]) -> DataFrame:
    """``by, phase, n, micros``: a phase lasts until the next entry of its key."""
    w = Window.partitionBy(by).orderBy(*order)
    at = F.unix_micros(F.col(ts).cast("timestamp"))
    spent = F.lead(at).over(w) - at
    return log.withColumn("_s", spent).groupBy(by, phase).agg(F.count("*").alias("n"), F.sum("_s").alias("micros"))


def newest(rows: DataFrame, by: list[str], order: list[Column], keep: int) -> DataFrame:
    """The newest ``keep`` rows of each group."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("_n") <= keep).drop("_n")


def upload_plan(files: DataFrame, redo_all: bool = False) -> DataFrame:
    """Files with ``encode`` and ``action`` of an incremental upload.

    ``files(file_key, status, file_hash, n_chunks, cache_valid, ids_match)``. Protected: ingested files are left alone,
    encoded ones are uploaded and the others encoded only; ``redo_all`` takes every file for both. Of the chosen files
    those without chunks are ``empty``; those without a hash are rejected as ``no_hash``, since the ids of their chunks
    would be those of other files; then come ``invalid_cache`` and ``mismatch``, else ``upload``. Others are ``not_chosen``.
    """
    status, hashed = F.coalesce("status", F.lit("")), F.coalesce("file_hash", F.lit("")) != ""
    chosen = F.lit(redo_all) | (status == "encoded")
    action = F.when(~chosen, "not_chosen").when(F.coalesce("n_chunks", F.lit(0)) == 0, "empty").when(~hashed, "no_hash").when(~F.coalesce("cache_valid", F.lit(False)), "invalid_cache").when(~F.coalesce("ids_match", F.lit(False)), "mismatch").otherwise("upload")
    encode = (F.lit(redo_all) | (status != "ingested")) & (F.coalesce("n_chunks", F.lit(0)) > 0) & hashed
    return files.withColumn("encode", encode).withColumn("action", action)


def tracker_entries(files: DataFrame, key: Column, forced: bool = False) -> DataFrame:
    """``key, file_key, n`` for a rebuilt tracker, the first file of each key; refused where files share keys, unless ``forced``."""
    rows = files.groupBy(key.alias("key")).agg(F.min("file_key").alias("file_key"), F.count("*").alias("n"))
    if not forced and not rows.filter("n > 1").isEmpty():
        raise ValueError("several files share a key; the tracker stays as it is")
    return rows


def without_output(files: DataFrame, outputs: DataFrame, target: Column) -> DataFrame:
    """Files whose output ``target`` is not among ``outputs(path)`` yet."""
    return files.withColumn("_t", target).join(outputs.select(F.col("path").alias("_t")).distinct(), "_t", "left_anti").select(*files.columns)


def reset_for_rerun(tracker: DataFrame, extensions: tuple[str, ...]) -> DataFrame:
    """The tracker without entries of files with these extensions, so that they are processed again. Outputs stay."""
    own = F.lower(F.regexp_extract("file_key", r"(\.[^./\\]*)$", 1))
    return tracker.filter(~F.coalesce(own.isin(*extensions), F.lit(False)))


def file_stats(pages: DataFrame) -> DataFrame:
    """``doc_id, pages, ok, failed, titled, images, seconds, pages_per_second`` from ``pages(doc_id, ok, title, n_images, seconds)``."""
    ok = F.coalesce("ok", F.lit(False))
    rows = pages.groupBy("doc_id").agg(F.count("*").alias("pages"), F.count_if(ok).alias("ok"), F.count_if(~ok).alias("failed"), F.count_if(F.coalesce("title", F.lit("")) != "").alias("titled"), F.coalesce(F.sum("n_images"), F.lit(0)).alias("images"), F.coalesce(F.sum("seconds"), F.lit(0.0)).alias("seconds"))
    return rows.withColumn("pages_per_second", F.when(F.col("seconds") > 0, F.col("pages") / F.col("seconds")))


def still_offered(selected: Column | str, offered: Column | str) -> Column:
    """A stale selection without values that are no longer offered, in its own order."""
    selected, offered = (F.col(c) if isinstance(c, str) else c for c in (selected, offered))
    return F.array_intersect(selected, offered)


def page_after(rows: DataFrame, key: str, after, size: int = 512) -> DataFrame:
    """The next ``size`` rows of a scan in order of a unique key, those after ``after`` (None: from the start)."""
    return (rows if after is None else rows.filter(F.col(key) > F.lit(after))).orderBy(key).limit(size)


def merged_metadata(log: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """``by, name, number, text``: the numbers of a name add up, of its texts the last one counts."""
    said = F.when(F.col("text").isNotNull(), F.struct(*order))
    return log.groupBy(*by, "name").agg(F.sum("number").alias("number"), F.max_by("text", said).alias("text"))


def review_states(log: DataFrame, by: str = "file_key") -> DataFrame:
    """``by, status`` of files after a log ``by, entry_id, action`` of ``edit``, ``save``, ``discard``, ``encode`` and ``ingest``.

    A file is ``unprocessed`` until something happens; ``encode`` and ``ingest`` make it ``encoded`` and ``ingested``. An edit or a save
    makes it ``processing``. ``discard`` goes back to the encoded or ingested state before the edit, but not once a save
    has changed the file since then, nor to ``unprocessed``.
    """
    done = F.col("action").isin("encode", "ingest")
    last = Window.partitionBy(by).orderBy("entry_id").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = log.withColumn("since", F.max(F.when(done, F.col("entry_id"))).over(last))
    later = F.col("since").isNull() | (F.col("entry_id") > F.col("since"))
    touched = F.when(later & F.col("action").isin("edit", "discard"), F.col("entry_id"))
    base = F.max_by(F.when(F.col("action") == "encode", "encoded").otherwise("ingested"), F.when(done, F.col("entry_id")))
    facts = rows.groupBy(by).agg(F.when(F.count_if(done) > 0, base).alias("base"), F.count_if(later & (F.col("action") == "save")).alias("saves"), F.count_if(later & (F.col("action") == "edit")).alias("edits"), F.max_by("action", touched).alias("end"))
    open_edit = (F.col("saves") > 0) | ((F.col("edits") > 0) & ((F.col("end") == "edit") | F.col("base").isNull()))
    return facts.select(by, F.when(open_edit, "processing").otherwise(F.coalesce("base", F.lit("unprocessed"))).alias("status"))
