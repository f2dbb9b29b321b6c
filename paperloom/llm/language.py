"""Language identification by compression with one dictionary per language."""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from paperloom.llm.common import bounded, documents, id_remainder

#: Bytes of a language's dictionary, bytes of text compressed at once, compression level.
DICTIONARY_BYTES, CHUNK_BYTES, LEVEL = 64 << 10, 8192, 11
#: Labelled documents of a language that the sample is expected to have, and their size in bytes where there are such.
SAMPLE_DOCS, SAMPLE_SIZES = 128, (300, 8000)
#: Bytes of a language's sample, and characters of a text in it, before digits and marks are taken out.
SAMPLE_BYTES = 96 << 10
#: Relative saving over the runner-up below which a language is not accepted.
MARGIN = 0.001
UNKNOWN = "und"
LETTERS = re.compile(r"[^\W\d_]+")
#: Remainder of crc32(doc_id as text) modulo 4 that is never learned from.
HELD_OUT = 2


def letters_of(text: str) -> bytes:
    """The text's words of letters, lower-cased: digits, marks and capitals say little about the language."""
    return " ".join(w for w in LETTERS.findall(text.lower()) if any(map(str.isalpha, w))).encode("utf-8", "replace")


class Languages:
    """A compressor with a raw-content dictionary for each language."""

    def __init__(self, texts: dict[str, list[bytes]]) -> None:
        self.names = sorted(texts)
        self.contents = {name: b"\n".join(texts[name])[-DICTIONARY_BYTES:] for name in self.names}
        self.compressors: list = []

    def __getstate__(self) -> dict:
        return {"names": self.names, "contents": self.contents, "compressors": []}

    def sizes(self, letters: bytes) -> list[int]:
        """Compressed bytes by language, over the whole text in chunks."""
        if not self.compressors:
            for name in self.names:
                own = zstandard.ZstdCompressionDict(self.contents[name], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                own.precompute_compress(level=LEVEL)
                self.compressors.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=own, write_content_size=False, write_checksum=False, write_dict_id=False))
        chunks = [letters[at : at + CHUNK_BYTES] for at in range(0, len(letters), CHUNK_BYTES)]
        return [sum(len(c.compress(x)) for x in chunks) for c in self.compressors]

    def best(self, text: str | None) -> tuple[str, float]:
        """The language and its margin: the relative saving over the next best (1 where there is no other)."""
        letters = letters_of(text) if text else b""
        if not letters or not self.names:
            return UNKNOWN, 0.0
        sizes = self.sizes(letters)
        first, *rest = sorted(range(len(sizes)), key=lambda k: (sizes[k], k))
        return self.names[first], 1.0 - sizes[first] / sizes[rest[0]] if rest else 1.0


def purged(texts: dict[str, list[bytes]]) -> dict[str, list[bytes]]:
    """The sample without documents that a dictionary of the other half gives to another language."""
    kept: dict[str, list[bytes]] = {name: [] for name in texts}
    for half in (0, 1):
        judge = Languages({name: own[half::2] for name, own in texts.items()})
        for name, own in texts.items():
            for letters in own[1 - half :: 2]:
                sizes = judge.sizes(letters)
                if sizes[judge.names.index(name)] == min(sizes):
                    kept[name].append(letters)
    return {name: kept[name] or texts[name] for name in texts}


def learned(labelled: DataFrame, lang: str = "lang", text: str = "text", key: str = "doc_id") -> Languages:
    """Dictionaries from a bounded sample of the labelled rows.

    Each language's sample is the documents with the least hashes of their ids, about ``SAMPLE_DOCS`` of them, of
    ``SAMPLE_SIZES`` bytes where the language has such, until they fill ``SAMPLE_BYTES``, to which a longer text is cut
    here; equal texts and repeated ids (of which the least text stays) count once. The driver holds this sample, whose
    size depends on the number of languages only. Null and empty texts and null languages are not learned from.
    """
    low, high = SAMPLE_SIZES
    size = F.octet_length(F.col(f"`{text}`"))
    rows = labelled.filter(F.col(f"`{lang}`").isNotNull() & F.col(f"`{text}`").isNotNull())
    rows = rows.select(F.col(f"`{lang}`").cast("string").alias("lang"), F.col(f"`{text}`").alias("text"), F.pmod(F.xxhash64(F.col(f"`{key}`"), F.lit("sample")), F.lit(1 << 30)).alias("h"), ((size >= low) & (size <= high)).alias("fits"))
    counts: dict[str, dict[bool, int]] = defaultdict(dict)
    for name, fits, n in rows.groupBy("lang", "fits").count().collect():
        counts[name][fits] = n
    if not counts:
        return Languages({})
    bounds = [(name, bool(own.get(True)), min(1 << 30, SAMPLE_DOCS * (1 << 30) // own.get(True, own.get(False, 1)))) for name, own in sorted(counts.items())]
    sampled = rows.join(F.broadcast(labelled.sparkSession.createDataFrame(bounds, "lang string, fits boolean, bound long")), ["lang", "fits"]).filter("h <= bound")
    once = sampled.groupBy("lang", "h").agg(F.min(F.substring("text", 1, SAMPLE_BYTES)).alias("text"))
    ahead = F.sum(F.octet_length("text")).over(Window.partitionBy("lang").orderBy("h").rowsBetween(Window.unboundedPreceding, -1))
    enough = once.withColumn("ahead", F.coalesce(ahead, F.lit(0))).filter(F.col("ahead") < SAMPLE_BYTES)
    texts: dict[str, list[bytes]] = defaultdict(list)
    for name, body, _ in sorted(enough.select("lang", "text", "h").collect(), key=lambda r: r.h):
        letters = letters_of(body)
        if letters and letters not in texts[name]:
            texts[name].append(letters)
    return Languages(purged({name: own for name, own in texts.items() if own}))


def trained_on(docs: DataFrame, key: str = "doc_id", lang: str = "lang", text: str = "text") -> Languages:
    """Languages learned from the rows that are not held out; rows with a null id aren't learned from."""
    return learned(docs.filter(id_remainder(key, 4) != HELD_OUT), lang, text, key)


def identified(docs: DataFrame, languages: Languages, key: str = "doc_id", text: str = "text", margin: float = MARGIN) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, lang_pred, score, rejected``.

    Every whole text is compressed with each language's dictionary, and the smallest result wins; ``score`` is the
    relative saving over the runner-up; of equal results the first language by name wins, with a score of 0. ``rejected``
    is true where the score is below ``margin`` or the text is null, empty or has no letter, for which ``lang_pred`` is
    ``und`` and the score 0. Very long texts are compressed as a whole, in chunks. Only the text is looked at, so ids may
    be null or repeat, and equal rows get equal results. Without labelled rows everything is ``und``; an empty table
    gives an empty result; other columns are not read.
    """
    bounded(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(languages)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            found = [sent.value.best(t) for t in part.column(1).to_pylist()]
            names, scores = [f[0] for f in found], [min(1.0, max(0.0, f[1])) for f in found]
            out = [part.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array([n == UNKNOWN or s < margin for n, s in zip(names, scores, strict=True)], pa.bool_())]
            yield pa.RecordBatch.from_arrays(out, names=["doc_id", "lang_pred", "score", "rejected"])

    source = docs.select(F.col(f"`{key}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    return source.mapInArrow(run, f"doc_id {docs.schema[key].dataType.simpleString()}, lang_pred string, score double, rejected boolean")


def accepted(docs: DataFrame, languages: Languages, text: str = "text", margin: float = MARGIN) -> DataFrame:
    """The rows of ``docs``, all columns, whose language is not rejected (see ``identified``): ties, null texts and texts
    without letters go, each of repeated rows is judged alike, an empty table stays empty."""
    bounded(docs.sparkSession)
    sent, place = docs.sparkSession.sparkContext.broadcast(languages), docs.columns.index(text)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            found = [sent.value.best(t) for t in part.column(place).to_pylist()]
            yield part.filter(pa.array([name != UNKNOWN and score >= margin for name, score in found], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    found = identified(docs, trained_on(docs))
    return found.select("doc_id", F.coalesce(id_remainder("doc_id", 4) == HELD_OUT, F.lit(False)).alias("held_out"), "lang_pred", "score", "rejected")
