import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from paperloom.llm import decontamination as dc
from paperloom.llm import language, licenses, lm, sharding
from paperloom.llm.common import written
from tests.conftest import SF
from tests.llm.conftest import LONG, rows

ITEMS = "item_id long, text string"


def test_decontamination_of_odd_rows(spark, odd, empty):
    items = spark.createDataFrame([(1, "lazy dog"), (2, " ".join(f"tail{k}" if j else f"word{k % 97}" for k in range(100, 106) for j in (0, 1))), (3, None), (4, "--"), (None, "QUICK brown"), (5, "not in any text")], ITEMS)
    for block_bytes in (dc.BLOCK_BYTES, 40):
        got = {(r.doc_id, r.n_hit, r.n_items) for r in dc.contamination(odd, items, block_bytes=block_bytes).collect()}
        assert {(1, 4, 2), (2, 4, 2), (None, 4, 2), (3, 0, 0), (6, 12, 1), (8, 0, 0)} <= got
    kept = dc.decontaminated(odd, items)
    assert kept.columns == odd.columns and kept.count() == len(rows()) - 5
    cut = {r.doc_id: r.text for r in dc.decontaminated(odd, items, how="spans").collect() if r.doc_id}
    assert cut[1] == "The  fox jumps over the "
    assert len(cut[6].split()) == len(LONG.split()) - 12
    assert dc.contamination(empty, items).count() == 0
    assert dc.contamination(odd, items.limit(0)).filter("contaminated").count() == 0


def test_cut_spans_do_not_depend_on_blocks(spark, odd):
    line = [f"a{k}" for k in range(24)]
    items = [(1, " ".join(line[2:14])), (2, " ".join(line[8:20])), (3, " ".join(line[5:15])), (4, "a21 a22"), (4, "lazy dog"), (3, " ".join(line[5:15]))]
    text = "start, " + " ".join(line) + "; finish"
    docs = written(spark.createDataFrame([(1, text, "x"), (1, text, "y"), (2, "nothing", "z"), (3, None, "z"), (None, "", "z")], "uid long, text string, hit string"), "t")
    benchmark = spark.createDataFrame(items, ITEMS)
    for block_bytes in (40, 150, dc.BLOCK_BYTES):
        cut = dc.decontaminated(docs, benchmark, how="spans", key="uid", block_bytes=block_bytes)
        assert cut.columns == docs.columns
        left = "start, a0 a1  a20  a23; finish"
        assert sorted(map(repr, cut.collect())) == sorted(map(repr, [docs.first().__class__(uid=i, text=t, hit=h) for i, t, h in ((1, left, "x"), (1, left, "y"), (2, "nothing", "z"), (3, None, "z"), (None, "", "z"))]))
        assert {r.hit for r in dc.decontaminated(docs, benchmark, key="uid", block_bytes=block_bytes).collect()} == {"z"}
        assert [(r.n_hit, r.n_items) for r in dc.contamination(docs, benchmark, key="uid", block_bytes=block_bytes).collect() if r.contaminated] == [(20, 4)] * 2
    assert len({tuple(sorted((r.doc_id or 0, r.n_hit, r.items_sha256) for r in dc.contamination(odd, benchmark, block_bytes=b).collect())) for b in (60, dc.BLOCK_BYTES)}) == 1


def test_language_accuracy_on_held_out_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = language.op4_language(spark, "/root/testdata/sf0.01").join(docs.select("doc_id", "lang"), "doc_id")
    own = found.filter("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")), F.min("score"), F.max("score")).first()
    assert own[0] > 0.97 and 0 <= own[1] <= own[2] <= 1
    assert found.filter("held_out").count() == sum(zlib.crc32(str(r.doc_id).encode()) % 4 == 2 for r in docs.collect())


def test_language_of_odd_rows(spark, odd, empty):
    learned = language.trained_on(spark.read.parquet(f"{SF}/documents.parquet"))
    got = {r.doc_id: r for r in language.identified(odd, learned).collect()}
    assert len(language.identified(odd, learned).collect()) == len(rows())
    assert all(got[i].lang_pred == "und" and got[i].rejected and got[i].score == 0 for i in (3, 4, 5, 11))
    assert got[6].lang_pred in learned.names
    nothing = language.trained_on(empty)
    assert language.identified(odd, nothing).filter("lang_pred <> 'und'").count() == 0
    assert language.accepted(odd, learned).columns == odd.columns
    assert language.accepted(empty, learned).count() == 0


def test_language_equals_plain_compression(spark):
    """Every whole text against a loop of its own: letters, chunks, the smallest result, the margin."""
    import zstandard

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    contents = language.trained_on(docs).contents
    level, chunk = language.LEVEL, language.CHUNK_BYTES
    packers = {}
    for name, body in contents.items():
        own = zstandard.ZstdCompressionDict(body, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        own.precompute_compress(level=level)
        packers[name] = zstandard.ZstdCompressor(level=level, dict_data=own, write_content_size=False, write_dict_id=False)
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    for r in language.op4_language(spark, SF).collect():
        letters = " ".join(re.findall(r"[^\W\d_]+", texts[r.doc_id].lower())).encode()
        parts = [letters[k : k + chunk] for k in range(0, len(letters), chunk)]
        sizes = sorted((sum(len(p.compress(x)) for x in parts), name) for name, p in packers.items())
        assert (r.lang_pred, r.score) == ((sizes[0][1], pytest.approx(1 - sizes[0][0] / sizes[1][0])) if letters else ("und", 0.0))
        assert r.rejected == (not letters or r.score < language.MARGIN)


def test_language_ties_and_hot_ids(spark):
    same = [(k, f"these are the words of text {'abcdefghij'[k]} and no others", name) for k in range(10) for name in ("xx", "aa")]
    learned = language.learned(spark.createDataFrame(same + [(3, "x" * 300_000, "long")] * 50, "doc_id long, text string, lang string"))
    assert learned.names == ["aa", "long", "xx"] and all(len(c) <= language.DICTIONARY_BYTES for c in learned.contents.values())
    row = language.identified(spark.createDataFrame([(1, "the words of text and others")], "doc_id long, text string"), learned).first()
    assert (row.lang_pred, row.score, row.rejected) == ("aa", 0.0, True)


def test_sharding(spark, odd, empty):
    for table in (odd, spark.read.parquet(f"{SF}/documents.parquet")):
        got = sharding.sharded(table).collect()
        texts = sorted(((r.text or "").encode() for r in table.collect()), key=len)
        assert sorted((r.size, r.text_crc32) for r in got) == sorted((len(t) + 1, zlib.crc32(t)) for t in texts)
        for shard in {r.shard for r in got}:
            assert sorted(r.slot for r in got if r.shard == shard) == list(range(sum(r.shard == shard for r in got)))
    loads = Counter()
    for r in got:
        loads[r.shard] += r.size
    assert len(loads) == 8 and max(loads.values()) - min(loads.values()) < 0.01 * sum(loads.values()) / 8 + max(1, len(texts[len(texts) // 10]))
    assert sharding.sharded(empty).count() == 0


def plain_slot(doc_id, text, slots):
    import xxhash

    data = doc_id.to_bytes(8, "little", signed=True) if doc_id is not None else (text or "").encode()
    code = xxhash.xxh64_intdigest(data, 42)
    return (code - 2**64 if code >= 2**63 else code) % slots


def folded(shard_of, sizes, shards):
    """The map after a plain fold: slots, largest first, stay while their shard has room under the mean."""
    mean, loads, out = -(-sum(sizes.values()) // shards), [0] * shards, {}
    for size, slot in sorted(((sizes.get(k, 0), k) for k in shard_of), reverse=True):
        to = shard_of[slot]
        if to >= shards or loads[to] + size > mean:
            to = loads.index(min(loads))
        loads[to] += size
        out[slot] = to
    return out


def test_sharding_equals_a_plain_fold_and_goes_on_from_the_stored_map(spark, tmp_path):
    maps = sharding.SlotMaps(spark, f"file://{tmp_path}/map")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    more = written(docs.unionByName(docs.filter("doc_id % 3 = 0").withColumn("doc_id", F.col("doc_id") + 10**6)), "t")
    shard_of = {k: k * 8 // 4096 for k in range(4096)}
    for version, table in ((2, docs), (3, more), (4, more)):
        sizes = Counter()
        for r in table.collect():
            sizes[plain_slot(r.doc_id, r.text, 4096)] += len((r.text or "").encode()) + 1
        before, shard_of = shard_of, folded(shard_of, sizes, 8)
        got = sharding.sharded(table, maps=maps).collect()
        assert all((r.virtual_slot, r.shard, r.map_version) == (plain_slot(r.doc_id, "", 4096), shard_of[r.virtual_slot], version) for r in got)
        loads = Counter()
        for r in got:
            loads[r.shard] += r.size
        assert max(loads.values()) - min(loads.values()) < 0.01 * sum(loads.values()) / 8 + max(sizes.values())
        if version == 4:
            assert before == shard_of  # nothing has to move
    stored = spark.read.parquet(f"file://{tmp_path}/map")
    assert {r.version: r["count"] for r in stored.groupBy("version").count().collect()} == {v: 4096 for v in (1, 2, 3, 4)}
    with pytest.raises(ValueError):
        maps.store(maps.load(2))


def test_slot_maps_are_versions(spark, tmp_path):
    maps = sharding.SlotMaps(spark, f"file://{tmp_path}/map")
    first = maps.store(sharding.initial_map(spark, 8, 64))
    second = maps.store(sharding.grown(first, 8))
    moved = first.join(second.select("slot", F.col("shard").alias("new")), "slot").filter("shard <> new")
    assert second.first().version == 2 and maps.load(1).first().version == 1
    assert moved.filter("new <> 8").count() == 0 and moved.count() == 0  # 8 slots a shard: a ninth of them is less than one
    third = maps.store(sharding.grown(maps.load(2).withColumn("shard", F.floor(F.col("slot") / 32).cast("int")), 2))
    assert third.filter("shard = 2").count() == 2 * (32 // 3)


def test_every_passage_is_found_with_every_fifth_word_changed(spark):
    """Four words in five stay, which is what a span needs, whatever the passage's length."""
    changed = [(label, " ".join("zz" if k % 5 == 4 else w for k, w in enumerate(t.split()))) for t, label in licenses.PASSAGES.items()]
    kept = {t: 1 - t.split().count("zz") / len(t.split()) for _, t in changed}
    found = {r.doc_id: r for r in licenses.scanned(spark.createDataFrame([(t, t) for _, t in changed], "doc_id string, text string")).collect()}
    for label, text in changed:
        alone = len(text.split()) % 5 == 1  # then the last word stands alone behind a changed one, in no pair
        if kept[text] >= licenses.COVER and not alone:
            assert label in found[text].labels.split(","), text


def test_licenses_of_odd_rows(spark, odd, empty):
    got = {r.doc_id: r for r in licenses.scanned(odd).collect()}
    assert licenses.scanned(odd).count() == len(rows())
    assert (got[10].n_base, got[10].first_word, got[10].last_word, got[10].base_labels, got[10].labels, got[10].score) == (1, 9, 9, "mit", "mit", 1.0)
    assert (got[3].n_words, got[3].n_base, got[3].first_word, got[3].labels, got[3].score) == (0, 0, None, "", 0.0)
    assert got[6].n_words == 60_000
    assert licenses.scanned(empty).count() == 0
    mit = max((t for t, label in licenses.PASSAGES.items() if label == "mit"), key=len).split()
    texts = {
        "Permission is hereby granted, free of any charge, to a person obtaining a copy of this software and associated documentation files": (0, "", "mit"),
        "PERMISSION is hereby granted, free of charge, to any person obtaining one copy of this software and associated documentation files. Mit License MIT license": (2, "mit", "mit"),
        "All rights reserved. All rights reserved.": (0, "", "reserved"),
        "All rights reserved, rights reserved": (0, "", "reserved"),
        "all of the rights are reserved": (0, "", ""),
        "licensed under the Apache software version 2.0": (0, "", "apache"),
        "licensed under the apache " + "and " * 9 + "license version 2 0": (0, "", ""),
        " ".join("x" if k % 29 == 7 else w for k, w in enumerate(mit)): (0, "", "mit"),
        " ".join(mit[:40]) + " other words " * 200 + " ".join(mit[40:]): (0, "", "mit"),
        " ".join(mit[60:90]): (0, "", ""),
    }
    got = {r.doc_id: r for r in licenses.scanned(spark.createDataFrame([(t, t) for t in texts], "doc_id string, text string")).collect()}
    assert {t: (r.n_base, r.base_labels, r.labels) for t, r in got.items()} == texts
    row = got[list(texts)[1]]
    assert (row.first_word, row.last_word) == (20, 22)


def words(text):
    return (text or "").encode().lower().split() + [lm.END]


def exact_model(docs):
    """Every count and the score of a text's tokens from exact counts quantised the same way."""
    one, two, three = Counter(), Counter(), Counter()
    for i, w in docs.items():
        if zlib.crc32(str(i).encode()) % 7 != 2:
            one.update(w)
            two.update(zip([lm.END, *w[:-1]], w, strict=True))
            three.update(zip([lm.END, *w[:-2]], w[:-1], w[1:], strict=True) if len(w) > 1 else ())
    n, v = sum(one.values()), len(one)
    level = lambda c: 1.5 * 2.0 ** int(math.log2(c)) - 0.5 if c else 0.0

    def score(w):
        total = 0.0
        for k, x in enumerate(w):
            a, b = w[k - 2] if k > 1 else lm.END, w[k - 1] if k else lm.END
            p = min(1, (level(one[x]) + 1) / (n + v + 1))
            longest = (three[a, b, x], two[a, b]) if k else (two[b, x], one[b])
            for count, of in ((two[b, x], one[b]), longest):
                if of:
                    p = (1 - lm.WEIGHT) * p + lm.WEIGHT * min(1, max(level(count) - lm.DISCOUNT, 0) / level(of))
            total += math.log10(p)
        return total

    return one, n, v, score


#: A bound on what share of n-grams that are not held a full filter takes for held, with 10 bits and 4 probes an entry.
FALSE_POSITIVES = (1 - math.exp(-lm.PROBES / lm.ENTRY_BITS)) ** lm.PROBES * 1.3


def test_language_model_equals_exact_counts(spark):
    docs = {r.doc_id: words(r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    known, n, v, score = exact_model(docs)
    off, signed = [], []
    for r in lm.op10_lm_scoring(spark, SF).collect():
        w = docs[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(w), sum(known[x] > 0 for x in w), n)
        assert r.base_score == pytest.approx(sum(math.log10((known[x] + 1) / (n + v + 1)) for x in w))
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 7 == 2)
        off.append(abs(r.score - score(w)) / abs(score(w)))
        signed.append((r.score - score(w)) / abs(score(w)))
    # What the filter adds: with a false entry an n-gram is a level too high, at a rate of ``FALSE_POSITIVES`` at most.
    assert np.mean(off) < FALSE_POSITIVES and abs(np.mean(signed)) < FALSE_POSITIVES


def test_language_model_in_parts_and_of_odd_rows(spark, odd, empty, monkeypatch):
    monkeypatch.setattr(lm, "SEGMENT_BYTES", 4096)
    training = odd.select("text")
    shown = lambda df: {(r.doc_id, r.n_tokens, r.n_known, round(r.base_score, 6), round(r.score, 6)) for r in df.collect()}
    once = shown(lm.scored(odd, training))
    assert once == shown(lm.scored(odd, training, part_bytes=4096, frequent=3)) == shown(lm.scored(odd, training, part_bytes=20_000, frequent=10**9))
    assert {r[1] for r in once if r[0] in (3, 4, 5)} == {1}
    assert lm.scored(empty, training).count() == 0
    unknown = lm.scored(odd, empty.select("text")).collect()
    assert len(unknown) == len(rows()) and {r.n_known for r in unknown} == {0}


def test_language_model_tells_repeated_texts_apart(spark):
    """What occurs twice in training scores above what occurs once, from counts that a pruned model would not hold."""
    rng = random.Random(4)
    text = lambda: " ".join(f"w{rng.randrange(60)}" for _ in range(80))
    once, twice = [(k, text()) for k in range(40)], [(100 + k, text()) for k in range(10)] * 2
    docs = written(spark.createDataFrame(once + twice, "doc_id long, text string"), "t")
    got = [(r.doc_id, r.score / r.n_tokens) for r in lm.scored(docs, docs.select("text")).collect()]
    assert min(s for i, s in got if i >= 100) > sorted(s for i, s in got if i < 100)[35]


def test_filter_is_filled_and_probed_once(spark):
    """Twice the texts, with words of their own, ask for about twice the probes and no more: each distinct n-gram once."""
    asked = {}
    for n in (300, 600):
        rng = random.Random(n)
        texts = [" ".join(f"w{n}x{rng.randrange(3000)}" for _ in range(200)) for _ in range(n)]
        docs = written(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "t")
        rows_ = lm.row_ids(docs.withColumn("learn", lm.F.lit(True)), ["learn", "text"])
        told, parts = spark.sparkContext.accumulator(0), spark.sparkContext.accumulator(0)

        def count(k, told=told, parts=parts):
            told.add(k)
            parts.add(1)

        tokens = n * 201
        segments = -(-lm.ORDER * tokens * lm.ENTRY_BITS // (8 * 4096))
        lm.looked_up(lm.gram_parts(rows_, segments, 4), count).count()
        grams = set()
        for t in texts:
            w = words(t)
            back = [w[-1], w[-1], *w]
            grams |= {(x,) for x in w} | {(back[k + 1], x) for k, x in enumerate(w)} | {(back[k], back[k + 1], x) for k, x in enumerate(w) if k}
        asked[n] = told.value
        assert parts.value <= -(-segments // 4)
        assert abs(told.value - len(grams)) <= 0.01 * len(grams)
    assert 1.8 < asked[600] / asked[300] < 2.2


def test_filter_never_underestimates():
    rng = np.random.default_rng(0)
    keys = np.unique(rng.integers(0, 2**32, 5000).astype(np.uint64))
    counts = rng.integers(1, 5000, len(keys))
    bits, own = lm.filled(keys, counts)
    assert (lm.probed(keys, bits, own) >= lm.level_of(counts)).all()
    assert (lm.probed(keys, bits, own) == lm.level_of(counts)).mean() > 0.9
    others = np.setdiff1d(rng.integers(0, 2**32, 50_000).astype(np.uint64), keys)
    assert (lm.probed(others, bits, own) > 0).mean() < FALSE_POSITIVES
