"""Language model scores from a log-frequency Bloom filter of quantised n-gram counts."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.llm.common import Scratch, as_bytes, documents, id_remainder, qualified, removed, row_ids, shared_dir, spaced_words, stable, store, written

#: The token that ends every text; no word has a space.
END = b" "
#: Documents with this remainder of crc32(doc_id as text) modulo 7 are scored but not learned from.
MODULUS, HELD_OUT = 7, 2
#: Words of the longest n-gram.
ORDER = 3
#: Bits of filter and probes for each entry.
ENTRY_BITS, PROBES = 10, 4
#: Level q of a count is for counts from 2 ** (q - 1); levels go no further than this.
LEVELS = 48
#: Bytes of a segment of the filter, which stays in the processor's cache, and of a part of whole segments, which a task fills and probes.
SEGMENT_BYTES, PART_BYTES = 256 << 10, 4 << 20
#: What is taken off each count of two and more words, and the weight of a longer n-gram, whose context is known, against the shorter ones.
DISCOUNT, WEIGHT = 0.9, 0.7
#: Words that are more than one in so many training tokens are broadcast with their exact counts: so many at most.
FREQUENT = 1 << 20
#: Bytes of text whose tokens are looked at together, and distinct words that a task counts before it sends them on.
TEXT_BYTES, HELD_WORDS = 4 << 20, 150_000
GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def word_hash(word: bytes) -> int:
    return xxhash.xxh64_intdigest(word)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def longer(keys: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """The keys of the n-grams ``keys`` with one more word."""
    return mixed(keys * GOLDEN + hashes)


def placed(keys: np.ndarray, segments: int) -> np.ndarray:
    """The segment of each n-gram in the upper half, the rest of its hash, which tells n-grams of a segment apart, in the lower."""
    return ((keys >> np.uint64(32)) * np.uint64(segments) & ~np.uint64(0xFFFFFFFF)) | (keys & np.uint64(0xFFFFFFFF))


def level_of(counts: np.ndarray) -> np.ndarray:
    """The quantised count: 1 + floor(log2(count)), at most ``LEVELS``."""
    return np.minimum(LEVELS, np.frexp(counts.astype(np.float64))[1])


def count_of(levels: np.ndarray) -> np.ndarray:
    """The count a level stands for, the middle of its range; 0 for level 0."""
    return np.where(levels > 0, 1.5 * 2.0 ** (levels - 1) - 0.5, 0.0)


class TokenTable:
    """The tokens of some texts as numbers, and the hash of each distinct one."""

    def __init__(self, texts: list[bytes]) -> None:
        words, ends = [], []
        for text in texts:
            words += spaced_words(text)
            words.append(END)
            ends.append(len(words))
        told = pa.array(words, pa.binary()).dictionary_encode()
        self.words = told.dictionary.to_pylist()
        self.numbers = told.indices.to_numpy().astype(np.int64)
        self.sizes = np.diff(ends, prepend=0).astype(np.int64)
        self.hashes = np.fromiter((word_hash(w) for w in self.words), np.uint64, len(self.words))
        self.starts = np.concatenate(([0], np.cumsum(self.sizes)[:-1])).astype(np.int64)

    def summed(self, values: np.ndarray) -> np.ndarray:
        return np.add.reduceat(values, self.starts) if len(self.starts) else np.empty(0)

    def before(self) -> np.ndarray:
        """The number of the token before each; a text starts after an end, which every text has."""
        out = np.empty_like(self.numbers)
        out[1:] = self.numbers[:-1]
        out[self.starts] = self.numbers[self.starts + self.sizes - 1]
        return out

    def grams(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Keys of the distinct words, of the pair that ends at each token, and of the triple (at a text's first token: of the pair)."""
        single = mixed(self.hashes)
        own = self.hashes[self.numbers]
        pair = longer(single[self.before()], own)
        triple = longer(np.concatenate((pair[:1], pair[:-1])), own)
        triple[self.starts] = pair[self.starts]
        return single, pair, triple


def positions(rests: np.ndarray, level: int, bits: np.ndarray | int) -> Iterator[np.ndarray]:
    """The places of the n-grams' entries for a level, one array for each probe."""
    a = mixed(rests ^ np.uint64(level * int(GOLDEN) & (1 << 64) - 1))
    b = mixed(a) | np.uint64(1)
    for k in range(PROBES):
        yield (a + np.uint64(k) * b >> np.uint64(32)) * bits >> np.uint64(32)


def filled(rests: np.ndarray, counts: np.ndarray) -> tuple[int, np.ndarray]:
    """Bits and bytes of a segment that holds these n-grams: an entry for every level up to an n-gram's own."""
    levels = level_of(counts)
    bits = max(64, int(levels.sum()) * ENTRY_BITS)
    segment = np.zeros(bits, bool)
    for level in range(1, int(levels.max(initial=0)) + 1):
        for p in positions(rests[levels >= level], level, np.uint64(bits)):
            segment[p.astype(np.int64)] = True
    return bits, np.packbits(segment, bitorder="little")


def probed(rests: np.ndarray, bits: int, own: np.ndarray) -> np.ndarray:
    """The level of each n-gram in a segment: one entry after another until one is missing.

    So a count is never underestimated, and it is overestimated by one more level only with the filter's error rate.
    """
    out, at = np.zeros(len(rests), np.int64), np.arange(len(rests))
    for level in range(1, LEVELS + 1):
        there = np.ones(len(at), bool)
        for p in positions(rests[at], level, np.uint64(bits)):
            there &= (own[(p >> np.uint64(3)).astype(np.int64)] >> (p & np.uint64(7)).astype(np.uint8) & 1).astype(bool)
        at = at[there]
        if not len(at):
            break
        out[at] = level
    return out


def word_counts(rows: DataFrame) -> DataFrame:
    """``word, n`` over ``rows(text)``: counted in each batch of texts, then added up by word."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])

        for part in parts:
            for text in as_bytes(part.column(0)):
                held.update(spaced_words(text))
            held[END] += part.num_rows
            if len(held) > HELD_WORDS:
                yield out()
                held = Counter()
        if held:
            yield out()

    return rows.select("text").mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def packed(keys: np.ndarray, counts: np.ndarray) -> bytes:
    """Sorted keys of one part with their counts: the sizes of the runs of a segment, the keys' lower halves by byte planes, whose
    upper ones compress, then the counts other than 1 with their places."""
    segments = (keys >> np.uint64(32)).astype(np.int64)
    starts = np.flatnonzero(np.concatenate(([True], segments[1:] != segments[:-1])))
    runs = np.stack((segments[starts], np.diff(np.append(starts, len(keys))))).astype("<u4")
    planes = np.ascontiguousarray((keys & np.uint64(0xFFFFFFFF)).astype(">u4").view(np.uint8).reshape(-1, 4).T)
    other = np.flatnonzero(counts != 1)
    return b"".join([len(starts).to_bytes(8, "little"), len(keys).to_bytes(8, "little"), runs.tobytes(), planes.tobytes(), other.astype("<u4").tobytes(), np.minimum(counts[other], 2**32 - 1).astype("<u4").tobytes()])


def unpacked(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    runs, n = int.from_bytes(blob[:8], "little"), int.from_bytes(blob[8:16], "little")
    segments, sizes = np.frombuffer(blob, "<u4", 2 * runs, 16).reshape(2, -1).astype(np.int64)
    at = 16 + 8 * runs
    keys = np.ascontiguousarray(np.frombuffer(blob, np.uint8, 4 * n, at).reshape(4, n).T).view(">u4").reshape(-1).astype(np.uint64)
    keys |= np.repeat(segments, sizes).astype(np.uint64) << np.uint64(32)
    places, other = np.frombuffer(blob, "<u4", -1, at + 4 * n).reshape(2, -1)
    counts = np.ones(n, np.int64)
    counts[places] = other
    return keys, counts


class Portion:
    """Some consecutive rows of a task, of about ``TEXT_BYTES``: their tokens and distinct n-grams.

    What is a portion depends on the order of the task's rows only, not on the batches they come in, so that a later task
    over the same rows makes the same ones.
    """

    def __init__(self, number: int, rows: list[tuple], segments: int) -> None:
        self.number, self.rows = number, rows
        self.tokens = TokenTable([r[-1] for r in rows])
        single, pair, triple = self.tokens.grams()
        self.cuts = np.cumsum([len(single), len(pair)])
        self.placed = placed(np.concatenate((single, pair, triple)), segments)

    def distinct(self, learned: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The distinct n-grams, sorted, and how often each stands in the rows that are learned from."""
        tokens = self.tokens
        of_token = np.repeat(learned, tokens.sizes)
        weights = np.concatenate((np.bincount(tokens.numbers[of_token], minlength=len(tokens.words)), of_token, of_token))
        weights[self.cuts[1] + tokens.starts] = 0  # a text's first token ends no triple
        keys, back = np.unique(self.placed, return_inverse=True)
        return keys, np.bincount(back, weights=weights, minlength=len(keys)).astype(np.int64)

    def levels(self, known: np.ndarray) -> list[np.ndarray]:
        """The levels of words, pairs and triples from those of the distinct n-grams."""
        _, back = np.unique(self.placed, return_inverse=True)
        if len(known) != (back.max(initial=-1) + 1):
            raise RuntimeError("the rows of a task are not those whose n-grams were looked up")
        return np.split(known[back], self.cuts)


def portions_of(parts: Iterator[pa.RecordBatch], segments: int) -> Iterator[Portion]:
    """The portions of a task's rows, which have the text in the last column."""
    held, size, number = [], 0, 0
    for part in parts:
        columns = [column.to_pylist() for column in part.columns[:-1]]
        for row in zip(*columns, as_bytes(part.column(part.num_columns - 1)), strict=True):
            if held and size + len(row[-1]) > TEXT_BYTES:
                yield Portion(number, held, segments)
                held, size, number = [], 0, number + 1
            held.append(row)
            size += len(row[-1])
    if held:
        yield Portion(number, held, segments)


def gram_parts(rows: DataFrame, segments: int, each: int) -> DataFrame:
    """``task, portion, part, grams``: distinct n-grams of each portion of ``rows(uid, learn, text)``, with the counts to learn, by part of the filter."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for portion in portions_of(parts, segments):
            keys, counts = portion.distinct(np.array([r[1] for r in portion.rows], bool))
            part = (keys >> np.uint64(32)).astype(np.int64) // each
            starts = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1])))
            ends = np.append(starts[1:], len(keys)).tolist()
            blobs = [packed(keys[a:b], counts[a:b]) for a, b in zip(starts.tolist(), ends, strict=True)]
            own = [pa.array(np.full(len(starts), x)) for x in (portion.rows[0][0] >> 33, portion.number)]
            yield pa.RecordBatch.from_arrays([*own, pa.array(part[starts]), pa.array(blobs, pa.binary())], names=["task", "portion", "part", "grams"])

    return rows.select("uid", "learn", "text").mapInArrow(run, "task long, portion long, part long, grams binary")


def looked_up(grams: DataFrame, probes: Callable[[int], None] = lambda n: None) -> DataFrame:
    """``task, portion, part, levels``: each part of the filter is filled once, from all counts of its n-grams, and probed once
    for each distinct n-gram; what was found goes back to the portions that asked. ``probes`` is told of each part, for tests."""

    def answers(blobs: list[bytes]) -> list[bytes]:
        asked = [unpacked(b) for b in blobs]
        keys, counts = added(asked)
        segment = (keys >> np.uint64(32)).astype(np.int64)
        starts = np.flatnonzero(np.concatenate(([True], segment[1:] != segment[:-1])))
        levels = np.empty(len(keys), np.uint8)
        for a, b in zip(starts.tolist(), np.append(starts[1:], len(keys)).tolist(), strict=True):
            rests, own = keys[a:b] & np.uint64(0xFFFFFFFF), counts[a:b]
            bits, held = filled(rests[own > 0], own[own > 0])
            levels[a:b] = probed(rests, bits, held)
        probes(len(keys))
        return [levels[np.searchsorted(keys, own)].tobytes() for own, _ in asked]

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, rows = None, []

        def out() -> pa.RecordBatch:
            levels = answers([r[3] for r in rows])
            return pa.RecordBatch.from_arrays([*(pa.array([r[k] for r in rows], pa.int64()) for k in range(3)), pa.array(levels, pa.binary())], names=["task", "portion", "part", "levels"])

        for batch in parts:
            for row in zip(*(column.to_pylist() for column in batch.columns), strict=True):
                if row[2] != part and rows:
                    yield out()
                    rows = []
                part = row[2]
                rows.append(row)
        if rows:
            yield out()

    return grams.repartition("part").sortWithinPartitions("part").mapInArrow(run, "task long, portion long, part long, levels binary")


def added(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, sorted, with their counts summed up."""
    keys, counts = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    by_key = np.argsort(keys)
    keys, counts = keys[by_key], counts[by_key]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return keys[first], np.add.reduceat(counts, first)


def held_levels(folder: str, task: int) -> dict[int, np.ndarray]:
    """The levels of a task's portions, each read once from the shared folder."""
    files, place = store(f"{folder}/task={task}")
    found: dict[int, list] = {}
    for info in files.get_file_info(pafs.FileSelector(place, allow_not_found=True)):
        if info.base_name.startswith("part-"):
            with files.open_input_file(info.path) as file:
                table = pq.read_table(file)
            for portion, part, levels in zip(*(table.column(c).to_pylist() for c in ("portion", "part", "levels")), strict=True):
                found.setdefault(portion, []).append((part, levels))
    return {k: np.frombuffer(b"".join(levels for _, levels in sorted(own)), np.uint8) for k, own in found.items()}


class Model:
    """What scoring needs besides the levels of n-grams: the numbers of tokens and of distinct tokens in training."""

    def __init__(self, tokens: int, vocabulary: int) -> None:
        self.tokens, self.vocabulary = tokens, vocabulary

    def logs(self, tokens: TokenTable, levels: list[np.ndarray]) -> np.ndarray:
        """log10 of each token's probability: what the triple and then the pair that end there are of those that begin alike, mixed with its own share."""
        single, pair, triple = (count_of(x.astype(np.int64)) for x in levels)
        context = single[tokens.before()]
        earlier = np.concatenate((context[:1], pair[:-1]))
        earlier[tokens.starts] = context[tokens.starts]
        out = np.minimum(1.0, (single[tokens.numbers] + 1.0) / (self.tokens + self.vocabulary + 1))
        for counts, of in ((pair, context), (triple, earlier)):
            share = np.minimum(1.0, np.maximum(counts - DISCOUNT, 0.0) / np.maximum(1.0, of))
            out = np.where(of > 0, (1 - WEIGHT) * out + WEIGHT * share, out)
        return np.log10(out)


def scored(docs: DataFrame, training: DataFrame | Column, key: str = "doc_id", text: str = "text", frequent: int = FREQUENT, part_bytes: int = PART_BYTES) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n_tokens, n_known, train_tokens, base_score, score``.

    Counts come from all of ``training``: a condition on ``docs``, or a table of its own with ``text``. ``base_score`` adds up
    log10((c + 1) / (N + V + 1)) with exact counts: words over one in ``frequent`` training tokens, of which there are fewer
    than that, are broadcast; a document's other words are joined to their counts, and as none of those is frequent, the join
    has no hot key. ``score`` is the model's log10 probability; all its counts come from probes of the log-frequency filter.

    Every n-gram of ``ORDER`` words or fewer is held, however rare, so the filter grows with the corpus. It is cut by hash into
    parts; portions of text send their distinct n-grams and counts to the parts, each part is filled and probed once, and
    levels go back to the portions: what is moved and read is in proportion to the texts. ``part_bytes`` and ``frequent`` do
    not change a result.

    Null and empty texts have the end token only; very long ones are looked at as a whole. Ids may be null or repeat,
    and every row is scored. Without training rows every count is 0; an empty table gives an empty result. Other columns
    are not read.
    """
    spark, id_type = docs.sparkSession, docs.schema[key].dataType.simpleString()
    own = docs.select(F.col(f"`{key}`").alias("doc_id"), F.col(f"`{text}`").alias("text"), (F.coalesce(training, F.lit(False)) if isinstance(training, Column) else F.lit(False)).alias("learn"), F.lit(True).alias("wanted"))
    if not isinstance(training, Column):
        own = own.unionByName(training.select(F.lit(None).cast(id_type).alias("doc_id"), F.col("text"), F.lit(True).alias("learn"), F.lit(False).alias("wanted")))
    rows = row_ids(stable(own), ["doc_id", "learn", "wanted", "text"])
    with Scratch(spark) as scratch:
        counts = scratch.written(word_counts(rows.filter("learn")), "word-counts")
        total, vocabulary = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
        often = F.col("n") * F.lit(frequent) > F.lit(total)
        table = counts.filter(often).toArrow()  # under ``frequent`` rows
        known = spark.sparkContext.broadcast(dict(zip((bytes(w) for w in table.column("word").to_pylist()), table.column("n").to_pylist(), strict=True)))
        # An n-gram has no more entries than places in the texts, so a segment holds about ``SEGMENT_BYTES`` at most.
        segments, each = max(1, -(-ORDER * total * ENTRY_BITS // (8 * SEGMENT_BYTES))), max(1, part_bytes // SEGMENT_BYTES)
        folder = shared_dir(spark, "gram-levels")
        found = looked_up(gram_parts(rows, segments, each))
        found.repartition("task").sortWithinPartitions("task", "portion", "part").write.option("compression", "zstd").partitionBy("task").parquet(folder)
        schema = f"uid long, doc_id {id_type}, n_tokens long, n_known long, base_score double, score double, word binary, k long"
        scores = text_scores(known, Model(total, vocabulary), qualified(spark, folder), segments)
        both = scratch.written(rows.select("uid", "doc_id", "wanted", "text").mapInArrow(scores, schema), "scores")
        removed(spark, folder)
        rare = both.filter("word IS NOT NULL").select("uid", "word", "k").join(counts.filter(~often), "word")
        rest = rare.groupBy("uid").agg(F.sum("k").alias("more_known"), F.sum(F.col("k") * F.log10(F.col("n") + 1.0)).alias("more_base"))
        mixed = both.filter("word IS NULL").drop("word", "k").join(rest, "uid", "left")
        known_words, base = F.col("n_known") + F.coalesce("more_known", F.lit(0)), F.col("base_score") + F.coalesce("more_base", F.lit(0.0))
        out = mixed.select("doc_id", "n_tokens", known_words.alias("n_known"), F.lit(total).cast("long").alias("train_tokens"), base.alias("base_score"), "score")
        return written(out, "scored")


def text_scores(known, model: Model, folder: str, segments: int):
    """A row for each text, with what its frequent words add to the base score, and one for each of its other words."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["uid", "doc_id", "n_tokens", "n_known", "base_score", "score", "word", "k"]
        each, levels, id_type = math.log10(model.tokens + model.vocabulary + 1), None, None

        def typed(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            nonlocal id_type
            for part in parts:
                id_type = part.schema.field(1).type
                yield part

        for portion in portions_of(typed(parts), segments):
            rows, tokens = portion.rows, portion.tokens
            if levels is None:
                levels = held_levels(folder, rows[0][0] >> 33)
            wanted = np.array([r[2] for r in rows], bool)
            at = np.flatnonzero(wanted)
            if not len(at):
                continue
            c = np.fromiter((known.value.get(w, 0) for w in tokens.words), np.int64, len(tokens.words))
            base = tokens.summed(np.log10(c + 1.0)[tokens.numbers]) - tokens.sizes * each
            n_known = tokens.summed((c > 0).astype(np.int64)[tokens.numbers]).astype(np.int64)
            score = tokens.summed(model.logs(tokens, portion.levels(levels.get(portion.number, np.zeros(0, np.uint8)))))
            uid, ids = pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], id_type)
            own = [uid.take(pa.array(at)), ids.take(pa.array(at)), *(pa.array(x[at]) for x in (tokens.sizes, n_known, base, score))]
            yield pa.RecordBatch.from_arrays([*own, pa.nulls(len(at), pa.binary()), pa.nulls(len(at), pa.int64())], names=names)
            other = (c[tokens.numbers] == 0) & np.repeat(wanted, tokens.sizes)
            pairs, k = np.unique(np.repeat(np.arange(len(rows)), tokens.sizes)[other] * len(tokens.words) + tokens.numbers[other], return_counts=True)
            words = pa.array(tokens.words, pa.binary()).take(pa.array(pairs % len(tokens.words)))
            empty = [pa.nulls(len(pairs), kind) for kind in (id_type, pa.int64(), pa.int64(), pa.float64(), pa.float64())]
            yield pa.RecordBatch.from_arrays([uid.take(pa.array(pairs // len(tokens.words))), *empty, words, pa.array(k)], names=names)

    return run


def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.coalesce(id_remainder("doc_id", MODULUS) == HELD_OUT, F.lit(False))
    found = scored(documents(spark, sf_dir).select("doc_id", "text"), ~held_out)
    return found.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
