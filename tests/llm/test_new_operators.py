"""Hard negatives, byte-pair encoding and alignment against brute force and against the tokenizers' own libraries."""

import hashlib
import random
from array import array
from collections import Counter

import numpy as np
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from paperloom.llm import alignment, bpe, hard_negatives
from paperloom.llm.tokens import vocabulary
from tests.conftest import SF
from tests.llm.conftest import rows

FILES = ["word_bpe_49k.json", "byte_bpe_50k.json"]
CODERS = {f: (bpe.Encoder(vocabulary(f)), bpe.Decoder(vocabulary(f)), Tokenizer.from_file(vocabulary(f))) for f in FILES}
PIECES = [" ", "  ", "\n", "\t", "\x1c", "\x85", "a", "B", "é", "́", "'s", "'", "12", "!", "<|endoftext|>", "<|startoftext|>", "<|", "中", "İ", "Σ", "ß", "×", "　", "word", "Don't", ". ", "X\nY", "aaaaaaaaaaaaaaa", "😀", "\x00", "½"]


# -- hard negatives


def mined(rows, positives=5, negatives=10):
    """Brute force over ``(vec_id, label, vector)``, every row by itself."""
    sound = [(i, lab, np.floor(256 * np.array(v, float))) for i, lab, v in rows if lab is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    width = max((len(v) for _, _, v in sound), default=0)
    sound = [(i, lab, [int(x) for x in v] + [0] * (width - len(v))) for i, lab, v in sound]
    out = []
    for k, (anchor, label, vector) in enumerate(sound):
        if anchor is None or anchor % 100:
            continue
        scored = sorted((-sum(x * y for x, y in zip(vector, v, strict=True)), i is None, i or 0, n, i, lab) for n, (i, lab, v) in enumerate(sound) if n != k)
        for p in [s for s in scored if s[5] == label][:positives]:
            fit = [s for s in scored if s[5] != label and 30 * -p[0] <= 100 * -s[0] <= 90 * -p[0]][:negatives]
            out += [(anchor, p[4], r, s[4], -p[0], -s[0]) for r, s in enumerate(fit, 1)]
    return sorted(out, key=repr)


@pytest.mark.parametrize("first", [1, 3, 500])
def test_hard_negatives_equal_brute_force(spark, first):
    rng = random.Random(first)
    near = [[rng.gauss(0, 1) for _ in range(6)] for _ in range(4)]
    rows_ = [(k * 10, rng.randrange(4), [round(x + rng.gauss(0, 0.3), 2) for x in rng.choice(near)]) for k in range(400)]
    rows_ += [(100, 1, near[0]), (100, 1, near[0]), (None, 2, near[1]), (None, None, near[1]), (7, 1, None), (9, 1, [1.0, None] + near[0][2:]), (11, 1, [float("nan")] * 6), (13, 1, [float("inf")] * 6), (200, 3, near[2][:3]), (300, 3, [])]
    rows_ += [(5000 + k, 0, near[3]) for k in range(150)]  # a hot vector
    df = spark.createDataFrame([(i, lab, v, "x") for i, lab, v in rows_], "vec_id long, label int, embedding array<double>, anchor string").repartition(4)
    got = hard_negatives.hard_negatives(df, "vec_id % 100 = 0", lists=12, first=first)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert sorted((tuple(r) for r in got.collect()), key=repr) == mined(rows_)


def test_hard_negatives_of_small_slices_and_tiles(spark, monkeypatch):
    monkeypatch.setattr(hard_negatives, "SLICE", 7)
    monkeypatch.setattr(hard_negatives, "TILE", 3)
    table = spark.read.parquet(f"{SF}/embeddings.parquet")
    got = hard_negatives.op13_hard_negatives(spark, SF).collect()
    own = [(r.vec_id, (r.label + 1) % 10 if r.vec_id % 7 == 0 else r.label, list(r.embedding)) for r in table.collect()]
    assert sorted((tuple(r) for r in got), key=repr) == mined(own)


def test_hard_negatives_of_an_empty_table(spark):
    df = spark.createDataFrame([], "vec_id long, label int, embedding array<float>")
    assert hard_negatives.hard_negatives(df, "vec_id % 100 = 0").collect() == []


def test_tiles_are_not_broadcast(spark, monkeypatch):
    """However few bytes anchors have, their tiles may be very many."""
    plans, own = [], hard_negatives.best_of_pairs
    monkeypatch.setattr(hard_negatives, "best_of_pairs", lambda pairs, *more: plans.append(pairs._jdf.queryExecution().executedPlan().toString()) or own(pairs, *more))
    hard_negatives.op13_hard_negatives(spark, SF).count()
    last = [next(line for line in p.splitlines() if "Join" in line) for p in plans]
    assert len(last) == 4 and all("SortMergeJoin" in line for line in last)


def test_hard_negatives_refuse_what_does_not_fit(spark):
    df = spark.createDataFrame([(100, 1, [1e30]), (2, 1, [1.0])], "vec_id long, label int, embedding array<double>")
    with pytest.raises(Exception, match="does not fit"):
        hard_negatives.hard_negatives(df, "vec_id % 100 = 0").collect()


# -- byte-pair encoding


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(PIECES), max_size=12))
def test_ids_and_texts_are_the_librarys(pieces):
    text = "".join(pieces)
    for encoder, decoder, library in CODERS.values():
        want = library.encode(text, add_special_tokens=False).ids
        assert list(encoder.encode(text)) == want
        assert "".join(decoder.decode(array("I", want))) == library.decode(want, skip_special_tokens=False)


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=40))
def test_ids_of_any_text_are_the_librarys(text):
    for encoder, _, library in CODERS.values():
        assert list(encoder.encode(text)) == library.encode(text, add_special_tokens=False).ids


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 50255), max_size=300), st.integers(1, 7))
def test_text_of_any_ids_in_pieces_of_any_size(ids, size):
    _, decoder, library = CODERS["byte_bpe_50k.json"]
    was, bpe.IDS = bpe.IDS, size
    try:
        assert "".join(decoder.decode(array("I", ids))) == library.decode(ids, skip_special_tokens=False)
    finally:
        bpe.IDS = was


@pytest.mark.parametrize("letters", ["ab", "aeinrst", "an", "the", "xyz"])
def test_long_words_are_streamed_in_constant_memory(letters):
    rng = random.Random(letters)
    word = "".join(rng.choice(letters) for _ in range(30_000))
    for encoder, _, library in CODERS.values():
        machine = bpe.Transducer(encoder.merges, encoder.sizes)
        most, out = 0, array("I")
        for c in word[:-1]:
            out.extend(machine.feed([encoder.inner[c]]))
            most = max(most, len(machine.held))
        out.extend(machine.finish(encoder.last[word[-1]]))
        assert list(out) == library.encode(word, add_special_tokens=False).ids
        assert most <= 2 * encoder.merges.lookahead + encoder.merges.longest


def small_merges(rng):
    """A random proper merge list over three letters."""
    vocab, pairs = {c: k for k, c in enumerate("abc")}, []
    while len(pairs) < 12:
        a, b = rng.choice(list(vocab)), rng.choice(list(vocab))
        if a + b not in vocab and len(a + b) < 9:
            vocab[a + b] = len(vocab)
            pairs.append((a, b))
    return bpe.Merges(vocab, pairs, ""), [len(t) for t in vocab]


@pytest.mark.parametrize("seed", range(40))
def test_tokens_before_the_lookahead_never_change(seed):
    rng = random.Random(seed)
    merges, sizes = small_merges(rng)
    for _ in range(60):
        text = [rng.randrange(3) for _ in range(rng.randrange(1, 60))]
        more = [rng.randrange(3) for _ in range(rng.randrange(1, 20))]
        until, at = len(text) - merges.lookahead, 0
        stable = []
        for token in merges.merged(text):
            if (at := at + sizes[token]) > until:
                break
            stable.append(token)
        assert merges.merged(text + more)[: len(stable)] == stable


@pytest.mark.parametrize("seed", range(10))
def test_merges_of_many_words_with_and_without_heap_agree(seed, monkeypatch):
    rng = random.Random(seed)
    merges, _ = small_merges(rng)
    words = [[rng.randrange(3) for _ in range(rng.randrange(1, 40))] for _ in range(50)]
    ids, counts = merges.merged_words(np.concatenate([np.array(w) for w in words]), np.array([len(w) for w in words]))
    short = [merges.merged(w) for w in words]
    assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == short
    monkeypatch.setattr(bpe, "SHORT", 0)
    assert [merges.merged(w) for w in words] == short


def test_a_list_without_known_lookahead_holds_the_word():
    merges = bpe.Merges({"a": 0, "b": 1, "ab": 2, "aba": 3}, [("ab", "a"), ("a", "b")], "")
    assert merges.lookahead is None
    machine = bpe.Transducer(merges, [1, 1, 2, 3])
    assert [*machine.feed([0, 1]), *machine.finish(0)] == merges.merged([0, 1, 0])


def test_encoding_of_documents(spark, odd, empty):
    path, library = vocabulary(FILES[0]), CODERS[FILES[0]][2]
    got = {(r.doc_id, tuple(r.ids)): r.text for r in bpe.decoded(bpe.encoded(odd, path), path).collect()}
    want = {}
    for r in rows():
        ids = library.encode(r[1] or "", add_special_tokens=False).ids
        want[r[0], tuple(ids)] = library.decode(ids, skip_special_tokens=False)
    assert got == want and bpe.encoded(odd, path).count() == len(rows())
    assert bpe.decoded(bpe.encoded(empty, path), path).collect() == []
    with_nulls = spark.createDataFrame([(1, None), (2, []), (3, [320, None, 10**9, 320])], "doc_id long, ids array<int>")
    assert {r.doc_id: r.text for r in bpe.decoded(with_nulls, path).collect()} == {1: "", 2: "", 3: "a</w> a</w>"}


def test_op11_equals_the_library(spark):
    library = CODERS[FILES[0]][2]
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in bpe.op11_bpe(spark, SF).collect():
        ids = library.encode(texts[r.doc_id], add_special_tokens=False).ids
        text = library.decode(ids, skip_special_tokens=False)
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())


# -- alignment

PATHS = vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model")
BYTES = Tokenizer.from_file(PATHS[0])
BYTES.encode_special_tokens = True
MODEL = sentencepiece.SentencePieceProcessor(model_file=PATHS[1])


def byte_values():
    """The byte of each letter of a byte-level vocabulary: printable ones stand for themselves, others follow from 256 on."""
    own = [b for b in range(256) if chr(b).isprintable() and b not in (32, 160, 173)]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in own)}


def walked(texts):
    """Each text's row, by walking along both lists of tokens."""
    byte_of, counts, found = byte_values(), Counter(), []
    for text in texts:
        a, b = (BYTES.encode(" " + text, add_special_tokens=False).ids, MODEL.encode(text)) if text else ([], [])
        own_a = [bytes(byte_of[c] for c in BYTES.id_to_token(i)) for i in a]
        own_b = [bytes([int(p[3:5], 16)]) if MODEL.is_byte(i) else p.replace("▁", " ").encode() for i in b for p in [MODEL.id_to_piece(i)]]
        if not text or b"".join(own_a) != (" " + text).encode() or b"".join(own_b) != (" " + text).encode():
            found.append(None)
            continue
        links, groups, i, j, left_a, left_b = [], [([], [])], 0, 0, len(own_a[0]), len(own_b[0])
        groups[-1][0].append(a[0])
        groups[-1][1].append(b[0])
        while True:
            links.append((a[i], b[j]))
            step = min(left_a, left_b)
            left_a, left_b = left_a - step, left_b - step
            over = not left_a and not left_b
            if over and i + 1 == len(a):
                break
            if over:
                groups.append(([], []))
            if not left_a:
                i += 1
                left_a = len(own_a[i])
                groups[-1][0].append(a[i])
            if not left_b:
                j += 1
                left_b = len(own_b[j])
                groups[-1][1].append(b[j])
        counts.update(set(links))
        found.append((a, b, groups, links))
    most = {}
    for (x, _), n in counts.items():
        most[x] = max(most.get(x, 0), n)
    out = []
    for f in found:
        if f is None:
            out.append((0, 0, 0, 0, 0, 0, ""))
            continue
        a, b, groups, links = f
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        out.append((len(a), len(b), len(groups), len(links), sum(counts[p] == most[p[0]] for p in links), sum(counts[p] for p in links), hashlib.sha256(text.encode()).hexdigest()))
    return out


def rows_of(df):
    return [tuple(r)[1:] for r in df.orderBy("doc_id").collect()]


@pytest.mark.parametrize("frequent", [alignment.FREQUENT, 40, 1])
def test_alignment_equals_a_walk(spark, frequent):
    rng = random.Random(7)
    parts = [" ", "  ", "a", "word", "x y", "▁", "é", "\n", "\t", "<s>", "<|endoftext|>", "½", "中文", "\x00", "ﬁ", "12", ".", "　"]
    texts = [None, "", " ", "  ", " a", "a ", "a  b ", "▁"] + ["".join(rng.choice(parts) for _ in range(rng.randrange(9))) for _ in range(300)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    assert rows_of(alignment.aligned(df, *PATHS, frequent=frequent)) == walked(texts)


def test_alignment_of_odd_and_empty_tables(odd, empty):
    got = alignment.aligned(odd, *PATHS)
    texts = [r[1] for r in rows()]
    want = [(r[0], *w) for r, w in zip(rows(), walked(texts), strict=True)]
    assert sorted((tuple(r) for r in got.collect()), key=repr) == sorted(want, key=repr)
    assert alignment.aligned(empty, *PATHS).collect() == []


def test_op12_equals_a_walk(spark):
    texts = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", F.col("text")).orderBy("doc_id").collect()]
    assert rows_of(alignment.op12_alignment(spark, SF)) == walked(texts)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.sampled_from(list(" ab.\n▁é中<s>12")), max_size=30))
def test_pieces_by_units_are_the_models(text):
    if text and "▁" not in text:
        assert alignment.tokenizer(PATHS[1]).encode([text])[0].tolist() == MODEL.encode(text)
