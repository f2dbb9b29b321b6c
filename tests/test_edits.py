"""Undo, replaced blocks, formatted spans and failing rows against plain Python."""

import os
import random

import pytest
from pyspark.sql import functions as F

from paperloom.operators import edits as ed
from paperloom.operators import maintenance as mt
from paperloom.operators import shares
from paperloom.operators import spans as sp
from paperloom.plans import adapters as ad
from paperloom.plans import edit_queries as eq
from paperloom.sources import quarantine as qu
from tests.conftest import SF


def folded(log):
    """Each file's stack, entry by entry."""
    stacks, out = {}, {}
    for file, entry, action, path in sorted(log, key=lambda r: r[1]):
        stack = stacks.setdefault(file, [])
        if action == "delete":
            stack.append(entry)
            out[entry] = [file, entry, path, None, "deleted"]
        elif action == "undo" and stack:
            out[stack.pop()][3:] = [entry, "restored"]
        elif action in ("undo_all", "save"):
            for e in stack:
                out[e][3:] = [entry, "restored"] if action == "undo_all" else [None, "saved"]
            stack.clear()
    return sorted(map(tuple, out.values()))


@pytest.mark.parametrize("seed", range(4))
def test_undo_is_last_in_first_out(spark, seed):
    rng = random.Random(seed)
    actions = ["delete"] * 5 + ["undo"] * (3 + seed) + ["undo_all", "save", "other"]
    log = [(rng.randrange(4), k, rng.choice(actions), f"p{rng.randrange(5)}") for k in range(300)]
    got = ed.matched_edits(spark.createDataFrame(log, "file_key long, entry_id long, action string, path string"))
    assert sorted(tuple(r) for r in got.collect()) == folded([r for r in log if r[2] != "other"])


def test_undo_of_several_images(spark):
    log = [(1, 1, "delete", "a"), (1, 2, "delete", "b"), (1, 3, "undo", None), (1, 4, "undo", None), (1, 5, "undo", None), (1, 6, "delete", "a"), (1, 7, "save", None), (1, 8, "undo_all", None)]
    got = ed.image_states(spark.createDataFrame(log, "file_key long, entry_id long, action string, path string")).collect()
    assert {(r.path, r.trashed) for r in got} == {("a", True), ("b", False)}


@pytest.mark.parametrize("seed", range(3))
def test_replacements_in_order(spark, seed):
    rng = random.Random(seed)
    structure = [(1, p, k, 10 * p + k) for p in range(3) for k in range(5)] + [(1, 0, 9, 3), (1, None, 0, 0), (2, 0, 0, 3)]
    events, known = [], [3, 4, 11, 12, 24, 0, 1]
    for seq in range(40):
        old, new = rng.choice(known), rng.choice([*known, 100 + seq, 100 + seq])
        if old != new and not any(e[2] == new or e[3] == new for e in events):
            events.append((1, seq, old, new))
            known.append(new)
    lists = {}
    for doc, parent, pos, block in sorted(structure, key=repr):
        lists.setdefault((doc, parent), []).append([pos, block])
    for own in lists.values():
        own.sort()
    for doc, _, old, new in events:
        for (d, _), own in lists.items():
            hit = next((x for x in own if d == doc and x[1] == old), None)
            if hit:
                hit[1] = new
        lists = {(d, new if d == doc and p == old else p): own for (d, p), own in lists.items()}
    want = sorted(((d, p, pos, b) for (d, p), own in lists.items() for pos, b in own), key=repr)
    if any(e[3] in (x[3] for x in structure) for e in events):
        return  # a block that comes back into a list is another case
    got = ed.replaced_structure(spark.createDataFrame(structure, "doc_id long, parent_id long, pos long, block_id long"), spark.createDataFrame(events, "doc_id long, seq long, old_id long, new_id long"))
    assert sorted((tuple(r) for r in got.select("doc_id", "parent_id", "pos", "block_id").collect()), key=repr) == want


def test_replaced_blocks_come_in_shares(spark, monkeypatch):
    """More rows make more shares, in every step: chains over many rounds, in one document and in many."""
    monkeypatch.setattr(shares, "ROWS", 200)
    monkeypatch.setattr(ed, "ROWS", 200)
    monkeypatch.setitem(ad.__dict__, "table", lambda s, d, name: s.range(6000).select((F.col("id") / 4).cast("long").alias("l_orderkey"), (F.col("id") % 4 + 1).alias("l_linenumber")))
    structure, replaced = eq._structure(spark, "")
    for own in (structure, replaced):
        dealt = own.groupBy(F.spark_partition_id().alias("share")).count().agg(F.max("count"), F.count("*")).first()
        assert dealt[0] < 600 and dealt[1] > 20
    links = ed.linked_edits(replaced)
    assert links.groupBy(F.spark_partition_id().alias("share")).count().agg(F.max("count")).first()[0] < 400
    assert ed.replaced_structure(structure, replaced).count() == 7500
    chain = spark.range(3000).select(F.lit(7).cast("long").alias("doc_id"), F.col("id").alias("seq"), F.col("id").alias("old_id"), (F.col("id") + 1).alias("new_id"))
    ends = ed.ends_of(chain)
    assert ends.count() == 3000 and ends.filter("end_id = 3000").count() == 3000
    assert ed.linked_edits(chain).groupBy(F.spark_partition_id().alias("share")).count().agg(F.max("count")).first()[0] < 400


def walked(chars):
    """One stream, character by character."""
    tags = {f"<{t}>": (True, f) for t, f in sp.TAGS.items()} | {f"</{t}>": (False, f) for t, f in sp.TAGS.items()}
    lines, line, span, formats = [], [], None, {"plain"}
    for text, *box in chars:
        opens, f = tags.get("<math>" if text.startswith("<math") else text, (None, None))
        if text == "<br>" or (opens and f not in formats) or (opens is False and f in formats):
            line += [span] if span else []
            span = None
            if text == "<br>":
                lines += [line] if line else []
                line = []
            elif opens:
                formats.add(f)
                span = ["", sorted(formats), box] if f == "math" else None
            else:
                formats.remove(f)
        elif opens is not False:
            if span is None:
                span = [text, sorted(formats), list(box)]
            else:
                span[0] += text
                if "math" not in formats:
                    span[2] = [f(a, b) for f, a, b in zip((min, min, max, max), span[2], box, strict=True)]
    line += [span] if span else []
    lines += [line] if line else []
    return [(n, k, t + ("\n" if k == len(own) - 1 else ""), tuple(fs), tuple(box)) for n, own in enumerate(lines) for k, (t, fs, box) in enumerate(own)]


def test_spans_of_all_documents_are_those_of_a_walk(spark):
    streams, got = {}, {}
    for r in eq.tagged_words(spark, SF).orderBy("doc_id", "pos").collect():
        streams.setdefault(r.doc_id, []).append((r.text, r.x0, r.y0, r.x1, r.y1))
    for r in eq.spans_formatted(spark, SF).orderBy("doc_id", "line", "span").collect():
        got.setdefault(r.doc_id, []).append((r.line, r.span, r.text, tuple(r.formats), (r.x0, r.y0, r.x1, r.y1)))
    assert got == {d: spans for d, chars in streams.items() if (spans := walked(chars))}


def test_failing_rows_are_data(spark, tmp_path):
    rows = spark.createDataFrame([(1, "5"), (2, "x"), (3, None), (4, "2"), (5, "99999999999")], "id long, text string")
    out = qu.tried(rows, lambda r: {"n": int(r["text"])}, "n int")
    got = {r.id: (r.n, r.error and r.error.split(":")[0]) for r in out.collect()}
    assert got[1] == (5, None) and got[4] == (2, None) and got[2] == (None, "ValueError") and got[3] == (None, "TypeError") and got[5][0] is None and got[5][1]
    first = qu.quarantined(out, "id").cache()
    assert {(r.id, r.tries) for r in first.collect()} == {(2, 1), (3, 1), (5, 1)}
    done = out.filter("error IS NULL").select("id")
    again = qu.tried(qu.to_try(rows, "id", done, first), lambda r: {"n": len(r["text"])}, "n int")
    second = qu.quarantined(again, "id", first).cache()
    assert {(r.id, r.tries) for r in second.collect()} == {(3, 2)}
    assert qu.to_try(rows, "id", done, second, most=2).filter("id = 3").isEmpty()
    routed = {r.id: (r.route, r.route_fallback) for r in qu.routed(rows, lambda r: "slow" if int(r["text"]) > 3 else "fast").collect()}
    assert routed == {1: ("slow", False), 2: ("fast", True), 3: ("fast", True), 4: ("fast", False), 5: ("slow", False)}


def test_files_that_cannot_be_read_are_rows(spark, tmp_path):
    (tmp_path / "a/b").mkdir(parents=True)
    (tmp_path / "a/x.PDF").write_bytes(b"12345")
    (tmp_path / "a/b/y.pdf").write_bytes(b"123")
    os.symlink(tmp_path / "nowhere", tmp_path / "a/lost.md")
    entries = qu.listed(spark, str(tmp_path)).cache()
    assert {(os.path.relpath(r.path, tmp_path), r.is_dir, r.error is None) for r in entries.collect()} == {("a", True, True), ("a/b", True, True), ("a/x.PDF", False, True), ("a/b/y.pdf", False, True), ("a/lost.md", False, False)}
    assert {tuple(r) for r in qu.folder_sizes(entries).collect()} == {(".pdf", 2, 8, 0), (".md", 0, 0, 1)}
    gone = qu.listed(spark, str(tmp_path / "none")).collect()
    assert len(gone) == 1 and gone[0].error
    assert qu.folder_sizes(qu.listed(spark, str(tmp_path / "a/b"))).select(F.sum("bytes")).first()[0] == 3


@pytest.mark.parametrize("seed", range(3))
def test_review_states_are_those_of_a_fold(spark, seed):
    rng = random.Random(seed)
    log = [(rng.randrange(60), k, rng.choice(["edit", "edit", "save", "discard", "discard", "encode", "ingest", "open"])) for k in range(300)]
    states = {}
    for file, _, action in log:
        status, prior, dirty = states.get(file, ("unprocessed", None, False))
        if action in ("encode", "ingest"):
            status, prior, dirty = {"encode": "encoded", "ingest": "ingested"}[action], None, False
        elif action in ("edit", "save"):
            if status in ("encoded", "ingested"):
                prior, dirty = status, False
            status, dirty = "processing", dirty or action == "save"
        elif action == "discard" and prior and not dirty:
            status, prior = prior, None
        states[file] = (status, prior, dirty)
    got = mt.review_states(spark.createDataFrame(log, "file_key long, entry_id long, action string"))
    assert {r.file_key: r.status for r in got.collect()} == {f: s[0] for f, s in states.items()}


def test_windows_over_a_stream_are_two_passes(spark):
    chars = spark.range(1).selectExpr("id AS doc_id", "0 AS pos", "'a' AS text", "0D AS x0", "0D AS y0", "1D AS x1", "1D AS y1")
    plan = sp.formatted_spans(chars, ["doc_id"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("- Window [") == 4  # two over characters, two over spans
