"""Alignment of two tokenizers over the same bytes, and how often their tokens are linked across the corpus."""

from __future__ import annotations

import hashlib
import json
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.llm.bpe import Kept
from paperloom.llm.common import Scratch, documents, row_ids, written
from paperloom.llm.tokens import BYTE_LETTERS, WordwiseEncoder, vocabulary

#: Pairs of ids that a task gathers before it adds them up and sends them on, and salts that its sums are dealt out by.
HELD_PAIRS, SALTS = 1 << 20, 16
#: Pairs that are more than one in so many of all documents' pairs are broadcast with their counts: fewer than so many.
FREQUENT = 1 << 20
#: Words that are encoded together, and characters of texts, and bytes of ids, that are looked at together.
ENCODED, TEXT_CHARS, ID_BYTES = 4000, 1 << 20, 1 << 20
#: A run of spaces and what stands before the next.
UNIT = re.compile(" +[^ ]*")
SPACE = "▁"


class ByteTokens:
    """Ids of a byte-level file: of texts with a space before them, and each id's bytes."""

    def __init__(self, path: str) -> None:
        self.path, self.own = path, None
        with open(path, encoding="utf-8") as file:
            shape = json.load(file)
        byte_of = {chr(c): b for b, c in BYTE_LETTERS.items()} | {chr(b): b for b in range(256) if b not in BYTE_LETTERS}
        names = shape["model"]["vocab"] | {x["content"]: x["id"] for x in shape["added_tokens"]}
        self.bytes = [b""] * (max(names.values()) + 1)
        for name, i in names.items():
            self.bytes[i] = bytes(byte_of[c] for c in name) if all(c in byte_of for c in name) else name.encode()

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        self.own = self.own or WordwiseEncoder(self.path, plain=True)
        return [np.frombuffer(ids, "<u4") for ids in self.own.encode([" " + t for t in texts])]

    def release(self) -> None:
        """Gives up the kept words, for tasks that only look at ids."""
        self.own = None


class PieceTokens:
    """Ids of a sentence-piece model, which puts a space before each text by itself, and each id's bytes.

    A model without a piece in which a space follows something else never joins anything over such a place, so the ids of a
    text are those of its runs from space to space, one after another. Other models get whole texts.
    """

    def __init__(self, path: str) -> None:
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.bytes = [bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace(SPACE, " ").encode() for i, p in enumerate(pieces)]
        self.by_units = not any(re.search(f"[^{SPACE}]{SPACE}", p) for p in pieces) and self._ids([" a"])[0] == self.model.encode(" a", num_threads=1) and self.model.encode("a  b", out_type=str)[-1].endswith("b")
        self.kept = Kept()

    def _ids(self, texts: list[str]) -> list[list[int]]:
        return self.model.encode(texts, num_threads=1)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        if not self.by_units:
            return [np.array(ids, "<u4") for ids in self._ids(texts)]
        units = [t.split(" ") if "  " not in t and t[:1] != " " and t[-1:] != " " else [u[1:] for u in UNIT.findall(" " + t)] for t in texts]
        get, older = self.kept.new.get, self.kept.old.get
        found = [[get(u) or older(u) for u in us] for us in units]
        new = list({u for us, ids in zip(units, found, strict=True) if None in ids for u, x in zip(us, ids, strict=True) if x is None})
        extra = {}
        for at in range(0, len(new), ENCODED):
            part = new[at : at + ENCODED]
            # A unit without anything in it is a space at the end of a text; the model has no ids for an empty text.
            for unit, ids in zip(part, self._ids([u or " " for u in part]), strict=True):
                extra[unit] = array("I", ids if unit else self.alone()).tobytes()
                self.kept.put(unit, extra[unit])
        return [np.frombuffer(b"".join(ids if None not in ids else [extra[u] if x is None else x for u, x in zip(us, ids, strict=True)]), "<u4") for us, ids in zip(units, found, strict=True)]

    def release(self) -> None:
        """Gives up the kept words, for tasks that only look at ids."""
        self.kept = Kept()

    def alone(self) -> list[int]:
        """The ids of one space."""
        return [self.model.piece_to_id(SPACE)]


_OWN: dict[tuple[str, str], tuple] = {}


def tokenizer(path: str):
    return ByteTokens(path) if path.endswith(".json") else PieceTokens(path)


def runs(sizes: list[int], most: int) -> Iterator[range]:
    """Runs of consecutive places whose sizes add up to about ``most``; a larger one is a run of its own."""
    start = held = 0
    for k, size in enumerate(sizes):
        if held and held + size > most:
            yield range(start, k)
            start, held = k, 0
        held += size
    if start < len(sizes):
        yield range(start, len(sizes))


class Aligner:
    """Both tokenizers of a worker, with what follows from their vocabularies alone."""

    def __init__(self, path_a: str, path_b: str) -> None:
        self.a, self.b = tokenizer(path_a), tokenizer(path_b)
        self.kinds = [np.dtype("<u2") if len(t.bytes) <= 1 << 16 else np.dtype("<u4") for t in (self.a, self.b)]
        self.sizes = [np.array([len(x) for x in t.bytes], np.int64) for t in (self.a, self.b)]
        #: An id and what follows it in the text of the groups.
        self.words = [s for t, ends in ((self.a, b",|"), (self.b, b",;")) for end in ends for s in (b"%d%c" % (i, end) for i in range(len(t.bytes)))]

    def encoded(self, texts: list[str | None]) -> tuple[list[bytes], list[bytes]]:
        """The ids by both of each text; none where the text is empty or the tokens do not make up its bytes."""
        out = ([b""] * len(texts), [b""] * len(texts))
        for own in runs([len(t or "") for t in texts], TEXT_CHARS):
            there = [k for k in own if texts[k]]
            both = [t.encode([texts[k] for k in there]) for t in (self.a, self.b)]
            for k, a, b in zip(there, *both, strict=True):
                want = b" " + texts[k].encode()
                if all(b"".join(map(t.bytes.__getitem__, ids.tolist())) == want for t, ids in ((self.a, a), (self.b, b))):
                    for side, ids, kind in zip(out, (a, b), self.kinds, strict=True):
                        side[k] = ids.astype(kind).tobytes()
        return out


def aligner(path_a: str, path_b: str, encodes: bool = False) -> Aligner:
    """One per worker process and pair of files."""
    if (path_a, path_b) not in _OWN:
        _OWN[path_a, path_b] = Aligner(path_a, path_b)
    own = _OWN[path_a, path_b]
    if not encodes:
        own.a.release()
        own.b.release()
    return own


def linked(own: Aligner, part: pa.RecordBatch) -> Iterator[tuple[range, Links]]:
    """The links of the documents of a batch, some of them at a time."""
    a, b = part.column("a").to_pylist(), part.column("b").to_pylist()
    for run in runs([len(x) + len(y) for x, y in zip(a, b, strict=True)], ID_BYTES):
        yield run, Links(own, a[run.start : run.stop], b[run.start : run.stop])


class Links:
    """The groups and links of some documents, laid one after another: their ends are common cuts as well."""

    def __init__(self, own: Aligner, blobs_a: list[bytes], blobs_b: list[bytes]) -> None:
        self.own, self.n = own, len(blobs_a)
        (self.a, self.b), kinds = (np.frombuffer(b"".join(x), k).astype(np.int64) for x, k in zip((blobs_a, blobs_b), own.kinds, strict=True)), own.kinds
        self.n_a, self.n_b = (np.array([len(x) for x in blobs], np.int64) // kind.itemsize for blobs, kind in zip((blobs_a, blobs_b), kinds, strict=True))
        ends_a, ends_b = np.cumsum(own.sizes[0][self.a]), np.cumsum(own.sizes[1][self.b])
        cuts = np.intersect1d(ends_a, ends_b, assume_unique=True)
        self.group_a, self.group_b = np.searchsorted(cuts, ends_a), np.searchsorted(cuts, ends_b)
        doc_a = np.repeat(np.arange(self.n), self.n_a)
        starts_a = ends_a - own.sizes[0][self.a]
        starts_b = ends_b - own.sizes[1][self.b]
        # An A token is linked to the B tokens from the one that ends behind its start to the one that starts before its end.
        first, last = np.searchsorted(ends_b, starts_a, "right"), np.searchsorted(starts_b, ends_a, "left")
        each = last - first
        of_a = np.repeat(np.arange(len(self.a)), each)
        of_b = np.arange(len(of_a)) - np.repeat(np.cumsum(each) - each, each) + np.repeat(first, each)
        self.doc, self.pair = doc_a[of_a], self.a[of_a] * len(own.sizes[1]) + self.b[of_b]
        self.n_links = np.bincount(self.doc, minlength=self.n)
        self.n_groups = np.bincount(doc_a[np.flatnonzero(np.append(self.group_a[1:] != self.group_a[:-1], True))] if len(self.a) else doc_a, minlength=self.n)

    def distinct(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Document, pair and number of links of each distinct pair in a document."""
        span = len(self.own.sizes[0]) * len(self.own.sizes[1])
        keys, counts = np.unique(self.doc * span + self.pair, return_counts=True)
        return keys // span, keys % span, counts

    def digests(self) -> list[str]:
        """The SHA-256 of each document's groups as ``a1,a2|b1;a3|b2,b3``."""
        n_a, n_b = len(self.own.sizes[0]), len(self.own.sizes[1])
        ends = [np.append(g[1:] != g[:-1], True)[: len(g)] for g in (self.group_a, self.group_b)]
        out = np.empty(len(self.a) + len(self.b), np.int64)
        # In front of an A token stand the B tokens of earlier groups, in front of a B token the A tokens up to its group.
        out[np.arange(len(self.a)) + np.searchsorted(self.group_b, self.group_a, "left")] = self.a + ends[0] * n_a
        out[np.arange(len(self.b)) + np.searchsorted(self.group_a, self.group_b, "right")] = 2 * n_a + self.b + ends[1] * n_b
        at, digests, words = 0, [], self.own.words
        for size in (self.n_a + self.n_b).tolist():
            text = b"".join(map(words.__getitem__, out[at : at + size].tolist()))[:-1]
            digests.append(hashlib.sha256(text).hexdigest() if size else "")
            at += size
        return digests


def token_table(docs: DataFrame, path_a: str, path_b: str, key: str, text: str) -> DataFrame:
    """``uid, doc_id, a, b``: the ids of every text by both tokenizers."""
    id_type = docs.schema[key].dataType.simpleString()

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = aligner(path_a, path_b, encodes=True)
        for part in parts:
            a, b = own.encoded(part.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(a, pa.binary()), pa.array(b, pa.binary())], names=["uid", "doc_id", "a", "b"])

    return row_ids(docs, [key, text]).toDF("uid", "doc_id", "text").mapInArrow(run, f"uid long, doc_id {id_type}, a binary, b binary")


def pair_counts(tokens: DataFrame, path_a: str, path_b: str, held: int = HELD_PAIRS) -> DataFrame:
    """``pair, n``: in how many documents each pair of ids is linked; added up in each task, then by salted pair, then by pair."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, salt = aligner(path_a, path_b), (TaskContext.get().partitionId() if TaskContext.get() else 0) % SALTS
        keys: list[np.ndarray] = []

        def out() -> pa.RecordBatch:
            pair, n = np.unique(np.concatenate(keys), return_counts=True)
            keys.clear()
            return pa.RecordBatch.from_arrays([pa.array(pair), pa.array(np.full(len(pair), salt)), pa.array(n)], names=["pair", "salt", "n"])

        for part in parts:
            for _, links in linked(own, part):
                keys.append(links.distinct()[1])
                if sum(map(len, keys)) >= held:
                    yield out()
        if keys:
            yield out()

    partial = tokens.select("a", "b").mapInArrow(run, "pair long, salt long, n long")
    return partial.groupBy("pair", "salt").agg(F.sum("n").alias("n")).groupBy("pair").agg(F.sum("n").alias("n"))


def document_rows(tokens: DataFrame, path_a: str, path_b: str, known, id_type: str) -> DataFrame:
    """A row for each document, with what its broadcast pairs add up to, and one for each of its other pairs."""
    names = ["uid", "doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", "pair", "k"]

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, (pairs, counts, best) = aligner(path_a, path_b), known.value
        for part in parts:
            for at, links in linked(own, part):
                ids = part.slice(at.start, len(at)).select(["uid", "doc_id"])
                doc, pair, times = links.distinct()
                place = np.minimum(np.searchsorted(pairs, pair), max(0, len(pairs) - 1))
                there = pairs[place] == pair if len(pairs) else np.zeros(len(pair), bool)
                sums, bests = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
                np.add.at(sums, doc[there], times[there] * counts[place[there]])
                np.add.at(bests, doc[there], times[there] * best[place[there]])
                own_columns = [pa.array(x.astype(np.int64)) for x in (links.n_a, links.n_b, links.n_groups, links.n_links, bests, sums)]
                rest = [pa.nulls(len(at), pa.int64())] * 2
                yield pa.RecordBatch.from_arrays([*ids.columns, *own_columns, pa.array(links.digests(), pa.string()), *rest], names=names)
                other = np.flatnonzero(~there)
                none = [pa.nulls(len(other), t) for t in (part.schema.field("doc_id").type, *[pa.int64()] * 6, pa.string())]
                yield pa.RecordBatch.from_arrays([ids.column("uid").take(pa.array(doc[other])), *none, pa.array(pair[other]), pa.array(times[other])], names=names)

    return tokens.mapInArrow(run, f"uid long, doc_id {id_type}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string, pair long, k long")


def aligned(docs: DataFrame, path_a: str, path_b: str, key: str = "doc_id", text: str = "text", frequent: int = FREQUENT) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256``.

    Both tokenizers encode a space and the text. Where a token of each ends at the same byte is a cut, between cuts are the
    groups; tokens whose bytes overlap are linked. A pair's count is the number of documents that hold it linked:
    ``count_sum`` adds it up over a document's links, ``n_best`` counts the links whose pair has the highest count of its
    first id, ties included. Pairs that make up more than one in ``frequent`` of all documents' pairs are broadcast, of which
    there are fewer than that; the others are joined by pair and have no hot key. ``frequent`` does not change a result.

    Null and empty texts, and texts whose tokens do not make up their bytes, have zeros and an empty digest and count
    nowhere. Very long texts are taken whole. Ids may be null or repeat: each row is a document of its own. An empty table
    gives an empty result; other columns are not read.
    """
    spark, id_type = docs.sparkSession, docs.schema[key].dataType.simpleString()
    width = len(tokenizer(path_b).bytes)
    with Scratch(spark) as scratch:
        tokens = scratch.written(token_table(docs, path_a, path_b, key, text), "token-ids", compression="zstd")
        counts = scratch.written(pair_counts(tokens, path_a, path_b), "pair-counts")
        first = F.expr(f"pair div {width}")
        most = counts.groupBy(first.alias("first")).agg(F.max("n").alias("most"))  # a row for each id of the first tokenizer at most
        told = counts.join(F.broadcast(most), first == F.col("first")).select("pair", "n", (F.col("n") == F.col("most")).cast("long").alias("best"))
        total = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
        often = F.col("n") * F.lit(frequent) > F.lit(total)
        table = told.filter(often).toArrow().combine_chunks().sort_by("pair")  # under ``frequent`` rows
        known = spark.sparkContext.broadcast(tuple(table.column(c).to_numpy() for c in ("pair", "n", "best")))
        rows = scratch.written(document_rows(tokens, path_a, path_b, known, id_type), "alignments", compression="zstd")
        scratch.drop(tokens)
        rare = rows.filter("pair IS NOT NULL").select("uid", "pair", "k").join(told.filter(~often), "pair")
        rest = rare.groupBy("uid").agg(F.sum(F.col("k") * F.col("n")).alias("more"), F.sum(F.col("k") * F.col("best")).alias("more_best"))
        found = rows.filter("pair IS NULL").drop("pair", "k").join(rest, "uid", "left")
        out = found.select(
            "doc_id", "n_a", "n_b", "n_groups", "n_links", (F.col("n_best") + F.coalesce("more_best", F.lit(0))).alias("n_best"),
            (F.col("count_sum") + F.coalesce("more", F.lit(0))).alias("count_sum"), "groups_sha256",
        )
        return written(out, "aligned")


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aligned(documents(spark, sf_dir), vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model"))
