"""Packing documents into sequences of bounded length by patterns fitted with non-negative least squares."""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from paperloom.llm.common import bounded, documents, written
from paperloom.llm.tokens import encoder, end_bytes, vocabulary

LENGTH = 1024
END = 2
#: Documents in an enumerated pattern, and steps of the least squares fit.
PATTERN_DOCS, FIT_STEPS = 3, 400
#: Texts that are encoded together.
TEXTS = 200
PIECES = "doc_id {id}, piece int, start long, length long, ids_crc32 long, task int, rank long"


def cuts(n: int, length: int) -> list[tuple[int, int]]:
    """``start, length`` of the pieces of ``n`` ids: all are full but the first, which has what is left."""
    first = (n - 1) % length + 1
    return [(0, first)] + [(at, length) for at in range(first, n, length)]


def pieces(docs: DataFrame, key: str, text: str, tokenizer_path: str, length: int, end_id: int, plain: bool) -> DataFrame:
    """A row per piece, with the task that made it and the piece's number among those of its length in that task."""
    end = end_bytes(end_id)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, task, made = encoder(tokenizer_path, plain), TaskContext.get().partitionId(), np.zeros(length + 1, np.int64)
        for part in parts:
            ids, texts = part.column(0), part.column(1).to_pylist()
            for at in range(0, len(texts), TEXTS):
                rows = []
                for k, got in enumerate(own.encode([t or "" for t in texts[at : at + TEXTS]])):
                    got += end
                    for piece, (start, size) in enumerate(cuts(len(got) // 4, length)):
                        rows.append((at + k, piece, start, size, zlib.crc32(got[4 * start : 4 * (start + size)]), int(made[size])))
                        made[size] += 1
                doc, piece, start, size, crc, rank = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(doc)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(size, pa.int64()), pa.array(crc, pa.int64()), pa.array([task] * len(rows), pa.int32()), pa.array(rank, pa.int64())], names=["doc_id", "piece", "start", "length", "ids_crc32", "task", "rank"])

    source = docs.select(F.col(f"`{key}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    return source.mapInArrow(run, PIECES.format(id=docs.schema[key].dataType.simpleString()))


def patterns(length: int, present: np.ndarray) -> np.ndarray:
    """All sets of two or three present lengths that sum to ``length``, each descending; 0 fills the third place."""
    out = []
    for a in present[::-1]:
        rest = length - a
        b = present[(present <= min(a, rest)) & (present >= (rest + 1) // 2)]
        c = rest - b
        fits = (c == 0) | np.isin(c, present)
        out.append(np.stack([np.full(fits.sum(), a), b[fits], c[fits]], axis=1))
    return np.concatenate(out) if out else np.empty((0, PATTERN_DOCS), np.int64)


def fitted(histogram: np.ndarray, own: np.ndarray, steps: int = FIT_STEPS) -> np.ndarray:
    """Repeat counts ``x >= 0`` of the patterns with least ``|A x - histogram|``, by multiplicative updates.

    ``A`` has in a pattern's column how often it uses each length. The updates keep every count non-negative and lower
    the squares in each step.
    """
    wanted = histogram.astype(float)
    wanted[0] = 0.0
    pull = wanted[own].sum(axis=1)
    x = np.full(len(own), wanted.sum() / max(1, 3 * len(own)))
    for _ in range(steps):
        used = sum(np.bincount(own[:, k], x, len(wanted)) for k in range(own.shape[1]))
        used[0] = 0.0
        x *= pull / np.maximum(used[own].sum(axis=1), 1e-12)
    return x


def best_fit(histogram: np.ndarray, length: int) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit decreasing over a histogram: each piece goes to the fullest bin that has room, many bins at a time."""
    free: dict[int, list[tuple[tuple[int, ...], int]]] = defaultdict(list)
    for size in range(length, 0, -1):
        count = int(histogram[size])
        for room in range(size, length):
            fit = room // size
            while count and free.get(room):
                held, bins = free[room].pop()
                full = min(bins, count // fit)
                if full:
                    free[room - fit * size].append((held + (size,) * fit, full))
                    count -= full * fit
                    bins -= full
                if bins and count < fit and count:
                    free[room - count * size].append((held + (size,) * count, 1))
                    bins -= 1
                    count = 0
                if bins:
                    free[room].append((held, bins))
                if not full:
                    break
            if not count:
                break
        fit = length // size
        if count >= fit:
            free[length - fit * size].append(((size,) * fit, count // fit))
        if count % fit:
            free[length - (count % fit) * size].append(((size,) * (count % fit), 1))
    return [x for held in free.values() for x in held]


def planned(histogram: np.ndarray, length: int) -> list[tuple[tuple[int, ...], int]]:
    """``pattern, repeats`` that use every piece of the histogram exactly once.

    Pattern repeats are fitted by non-negative least squares and rounded; a pattern is repeated no more often than its
    pieces last. Best fit packs what the rounded patterns leave. The work depends on ``length`` only.
    """
    left = histogram.astype(np.int64).copy()
    out: list[tuple[tuple[int, ...], int]] = []
    if left[length]:
        out.append(((length,), int(left[length])))
        left[length] = 0
    own = patterns(length, np.flatnonzero(left[:length]))
    if len(own):
        repeats = np.rint(fitted(left[: length + 1], own)).astype(np.int64)
        for k in np.argsort(-repeats, kind="stable"):
            if repeats[k] <= 0:
                break
            sizes, need = np.unique(own[k][own[k] > 0], return_counts=True)
            times = int(min(repeats[k], (left[sizes] // need).min()))
            if times > 0:
                left[sizes] -= times * need
                out.append((tuple(int(s) for s in own[k] if s), times))
    return out + best_fit(left, length)


class Slots:
    """Where the pieces of each length go: ranges of their numbers, the first one's sequence, the place in it."""

    def __init__(self, plan: list[tuple[tuple[int, ...], int]]) -> None:
        rows: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
        taken: dict[int, int] = defaultdict(int)
        sequence = 0
        for held, repeats in plan:
            at = 0
            for size in held:
                rows[size].append((taken[size], sequence, at))
                taken[size] += repeats
                at += size
            sequence += repeats
        self.sequences = sequence
        self.rows = {size: np.array(r, np.int64) for size, r in rows.items()}

    def places(self, lengths: np.ndarray, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sequence, offset = np.empty(len(ranks), np.int64), np.empty(len(ranks), np.int64)
        for size in np.unique(lengths):
            at, rows = np.flatnonzero(lengths == size), self.rows[int(size)]
            row = rows[np.searchsorted(rows[:, 0], ranks[at], side="right") - 1]
            sequence[at] = row[:, 1] + ranks[at] - row[:, 0]
            offset[at] = row[:, 2]
        return sequence, offset


def packed(docs: DataFrame, tokenizer_path: str, key: str = "doc_id", text: str = "text", length: int = LENGTH, end_id: int = END, plain: bool = False) -> DataFrame:
    """One row per piece: ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``.

    One scan encodes the texts and writes the pieces (no ids) to the shared folder, each with its number among the
    pieces of its length in its task. The counts per task and length, summed up over the tasks before, turn these into
    numbers over all tasks; no length's pieces ever meet in one place. The plan is made on the driver from the
    histogram of lengths, which has ``length`` numbers whatever the input; its broadcast has as many rows as patterns
    exist at most.

    Names of special tokens in a text are those tokens, as the tokenizers have it, or ordinary text with ``plain``.
    Null texts are empty: one piece with the end id. Null or repeated ids and repeated rows are packed row by row.
    An empty table gives an empty result; other columns are not read.
    """
    bounded(docs.sparkSession)
    made = written(pieces(docs, key, text, tokenizer_path, length, end_id, plain), "pieces")
    counts = made.groupBy("task", "length").agg(F.count("*").alias("n"))
    before = written(counts.withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1))).select("task", "length", "n", F.coalesce("before", F.lit(0)).alias("before")), "piece-counts")
    histogram = np.zeros(length + 1, np.int64)
    for size, n in before.groupBy("length").agg(F.sum("n")).collect():
        histogram[size] = n
    sent = docs.sparkSession.sparkContext.broadcast(Slots(planned(histogram, length)))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            *rest, rank = part.columns
            sequence, offset = sent.value.places(part.column("length").to_numpy(), rank.to_numpy())
            yield pa.RecordBatch.from_arrays([*rest, pa.array(sequence), pa.array(offset)], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    ranked = made.join(before.drop("n"), ["task", "length"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("rank") + F.col("before")).alias("rank"))
    id_type = docs.schema[key].dataType.simpleString()
    return ranked.mapInArrow(run, f"doc_id {id_type}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(documents(spark, sf_dir), vocabulary("byte_bpe_50k.json"))
