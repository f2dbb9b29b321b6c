import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from paperloom.llm import packing, token_store, tokens
from paperloom.llm.common import shared_dir
from tests.conftest import SF
from tests.llm.conftest import rows

FILES = ["byte_bpe_50k.json", "word_bpe_49k.json"]
ENCODERS = {f: (tokens.WordwiseEncoder(tokens.vocabulary(f)), Tokenizer.from_file(tokens.vocabulary(f))) for f in FILES}
#: Encoders to which the names of special tokens are ordinary text.
PLAIN = {f: (tokens.WordwiseEncoder(tokens.vocabulary(f), plain=True), Tokenizer.from_file(tokens.vocabulary(f))) for f in FILES}
for _, library in PLAIN.values():
    library.encode_special_tokens = True
PIECES = [" ", "  ", "\n", "\t", " ", "\x1c", "\x85", "a", "B", "é", "́", "'s", "'", "12", "!", "<|endoftext|>", "<|startoftext|>", "<|", "中", "İ", "Σ", "ß", "×", "　", "word", "Don't", ". ", ".\n", "X\nY"]


def ids_of(file, texts):
    return [np.array([*e.ids, 2], "<u4") for e in ENCODERS[file][1].encode_batch(texts, add_special_tokens=False)]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(PIECES), max_size=10))
def test_wordwise_ids_are_the_tokenizers(pieces):
    for own, plain in [*ENCODERS.values(), *PLAIN.values()]:
        text = "".join(pieces)
        assert np.frombuffer(own.encode([text])[0], "<u4").tolist() == plain.encode(text, add_special_tokens=False).ids


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=30))
def test_wordwise_ids_of_any_text(text):
    for own, plain in ENCODERS.values():
        assert np.frombuffer(own.encode([text])[0], "<u4").tolist() == plain.encode(text, add_special_tokens=False).ids


@settings(max_examples=200, deadline=None)
@given(st.text(st.sampled_from("aBéÀßÿ'strevlmd09.,!<|> \t\n\x0b\r"), max_size=40))
def test_common_texts_are_cut_into_pieces_at_once(text):
    own, plain = ENCODERS[FILES[1]]
    assert np.frombuffer(own.encode([text])[0], "<u4").tolist() == plain.encode(text, add_special_tokens=False).ids


def test_common_texts_need_no_words():
    own, text = tokens.WordwiseEncoder(tokens.vocabulary(FILES[1])), "Un été, l'Straße don't 12\nGo. " * 40_000
    assert tokens.COMMON_TEXT.fullmatch(text) and len(tokens.BLOCK.findall(text)) == 2
    assert np.frombuffer(own.encode([text, "a 中"])[0], "<u4").tolist() == ENCODERS[FILES[1]][1].encode(text, add_special_tokens=False).ids
    assert not {"don't", "été,"} & own.spaced.keys() and "été" in own.pieces


def test_kept_pieces_are_bounded():
    made = []
    own = tokens.Pieces(lambda p: made.append(p) or p.encode(), 4)
    assert [own[p] for p in "abcabcdefdefdef"] == [p.encode() for p in "abcabcdefdefdef"]
    assert len(own) == 4 and made.count("a") == 1 and made.count("f") == 3


def test_names_of_special_tokens():
    """As the tokenizers have it, and spelt out where that is asked for."""
    for file, text in (("byte_bpe_50k.json", "a <|endoftext|> b"), ("word_bpe_49k.json", "a <|startoftext|> b<|endoftext|>")):
        ids, spelt = (np.frombuffer(e[file][0].encode([text, "c"])[0], "<u4").tolist() for e in (ENCODERS, PLAIN))
        assert ids == Tokenizer.from_file(tokens.vocabulary(file)).encode(text, add_special_tokens=False).ids
        assert spelt == PLAIN[file][1].encode(text, add_special_tokens=False).ids != ids


def checked_packing(got, streams):
    """Every id once, pieces cut as they should be, sequences gapless and short enough."""
    by_doc = {}
    for r in got:
        assert 0 < r.length <= 1024 and (r.piece == 0 or r.length == 1024)
        by_doc.setdefault((r.doc_id, r.piece, r.start, r.length, r.ids_crc32), []).append(r)
    want = [(i, k, start, n, zlib.crc32(s[start : start + n].tobytes())) for i, s in streams for k, (start, n) in enumerate(packing.cuts(len(s), 1024))]
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got), key=repr) == sorted(want, key=repr)
    sequences = {}
    for r in got:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 1024
    return len(sequences)


def test_packing_of_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    streams = [(r.doc_id, s) for r, s in zip(docs, ids_of(FILES[0], [r.text or "" for r in docs]), strict=True)]
    used = checked_packing(packing.op3_packing(spark, SF).collect(), streams)
    assert used <= 1.01 * sum(len(s) for _, s in streams) / 1024 + 2


def test_packing_of_odd_rows(odd, empty):
    streams = [(r[0], s) for r, s in zip(rows(), ids_of(FILES[0], [r[1] or "" for r in rows()]), strict=True)]
    checked_packing(packing.packed(odd, tokens.vocabulary(FILES[0])).collect(), streams)
    assert packing.packed(empty, tokens.vocabulary(FILES[0])).count() == 0


@settings(max_examples=30, deadline=None)
@given(st.dictionaries(st.integers(1, 32), st.integers(1, 50), max_size=12))
def test_plans_use_every_piece(counts):
    histogram = np.zeros(33, np.int64)
    for size, n in counts.items():
        histogram[size] = n
    plan = packing.planned(histogram, 32)
    used = np.zeros(33, np.int64)
    for held, repeats in plan:
        assert sum(held) <= 32 and repeats > 0
        for size in held:
            used[size] += repeats
    assert used.tolist() == histogram.tolist()


@pytest.mark.parametrize("n", [1, 1023, 1024, 1025, 2048, 5000])
def test_cuts(n):
    pieces = packing.cuts(n, 1024)
    assert pieces[0][0] == 0 and sum(size for _, size in pieces) == n and all(size == 1024 for _, size in pieces[1:])


def test_store_of_documents(spark):
    docs = sorted(spark.read.parquet(f"{SF}/documents.parquet").collect(), key=lambda r: r.doc_id)
    streams = ids_of(FILES[1], [r.text or "" for r in docs])
    starts = np.concatenate(([0], np.cumsum([len(s) for s in streams])[:-1]))
    want = [(r.doc_id, int(start), len(s), zlib.crc32(s.tobytes())) for r, s, start in zip(docs, streams, starts, strict=True)]
    assert sorted(tuple(r) for r in token_store.op6_token_store(spark, SF).collect()) == want


def test_every_stream_is_rebuilt_from_its_chunks(spark):
    """All documents of sf0.01: the ids that the stored chunks give are those that the tokenizer gives."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    store = token_store.write_store(docs, shared_dir(spark, "t"), tokens.vocabulary(FILES[1]))
    own = docs.select("doc_id", "text").collect()
    want = {r.doc_id: s for r, s in zip(own, ids_of(FILES[1], [r.text or "" for r in own]), strict=True)}
    at = 0
    for r in sorted(token_store.read_documents(store).collect(), key=lambda r: r.doc_id):
        assert r.start == at and np.array_equal(want[r.doc_id], r.ids)
        at += len(r.ids)
    assert at == sum(map(len, want.values()))


def test_store_of_odd_rows(spark, odd, empty):
    store = token_store.write_store(odd, shared_dir(spark, "t"), tokens.vocabulary(FILES[1]))
    want = [(r[0], s.tolist()) for r, s in zip(rows(), ids_of(FILES[1], [r[1] or "" for r in rows()]), strict=True)]
    back = token_store.read_documents(store).collect()
    assert sorted(((r.doc_id, list(r.ids)) for r in back), key=repr) == sorted(want, key=repr)
    at = 0
    for r in sorted(back, key=lambda r: r.start):
        assert r.start == at
        at += len(r.ids)
    ordered = [r.doc_id for r in sorted(back, key=lambda r: r.start) if r.doc_id is not None]
    assert ordered == sorted(ordered)
    digests = [bytes(r.digest) for r in store.chunks().collect()]
    assert len(digests) == len(set(digests))
    nothing = token_store.write_store(empty, shared_dir(spark, "t"), tokens.vocabulary(FILES[1]))
    assert token_store.read_index(nothing).count() == 0


def test_damage_is_found(spark, odd):
    store = token_store.write_store(odd, shared_dir(spark, "t"), tokens.vocabulary(FILES[1]))
    from pyspark.sql import functions as F

    bad = store.chunks().withColumn("data", F.concat("data", F.unhex(F.lit("0100")))).withColumnRenamed("digest", "place")
    path = shared_dir(spark, "damaged")
    bad.write.parquet(f"{path}/chunks")
    for name in ("recipes", "manifest"):
        spark.read.parquet(f"{store.path}/{name}").write.parquet(f"{path}/{name}")
    with pytest.raises(Exception, match="damaged"):
        token_store.read_index(token_store.Store(spark, path)).collect()


@given(st.lists(st.binary(max_size=40), max_size=6))
def test_joined_crc(parts):
    assert token_store.joined_crc([zlib.crc32(p) for p in parts], [len(p) for p in parts]) == zlib.crc32(b"".join(parts))


def test_equal_passages_cut_alike():
    rng = np.random.default_rng(0)
    shared = rng.integers(0, 49_000, 5000).astype("<u4")
    a, b = np.concatenate([rng.integers(0, 49_000, 700).astype("<u4"), shared]), np.concatenate([rng.integers(0, 49_000, 333).astype("<u4"), shared])
    one, two = ([set(), set()])
    for stream, out in ((a, one), (b, two)):
        at = 0
        for stop in token_store.chunk_ends(len(stream), token_store.cut_places([stream])[0]):
            out.add(stream[at:stop].tobytes())
            at = stop
        assert at == len(stream)
    assert len(one & two) > 0.7 * len(one)
