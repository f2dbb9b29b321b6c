"""Byte-pair encoding as a streaming transducer with bounded lookahead, and decoding as a byte-to-text state machine."""

from __future__ import annotations

import codecs
import heapq
import json
import re
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.llm.common import bounded, documents
from paperloom.llm.tokens import BYTE_LETTERS, known_cuts, vocabulary

#: Entries of each generation of a worker's table of ids, and the longest text that it keeps.
KEPT, KEPT_CHARS = 120_000, 60
#: Characters of texts that are looked up together, and ids that are decoded together.
BLOCK, IDS = 1 << 20, 1 << 16
#: Symbols of the longest word that is merged together with others; longer ones are streamed.
TOGETHER = 64
#: Symbols up to which merges are looked for one after another, without a heap.
SHORT = 24
#: A cut before ASCII punctuation after an ASCII letter or digit ends a word for every pattern of runs of letters, digits and others.
WORD_END = re.compile(r"(?<=[A-Za-z0-9])(?=[!-&(-/:-@\[-`{-~])")
#: White space that all files know as such.
BLANKS = "\t\n\x0b\x0c\r"
#: Texts of letters that are their own normal form, and ``PATTERN`` with the letters spelt out.
COMMON = re.compile("[!-~À-ÖØ-öø-ÿ]*")
COMMON_WORDS = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zà-öø-ÿß]+|[0-9]|[^a-zà-öø-ÿß0-9]+")


NO_RANK = 2**62


class Merges:
    """A merge list: ``of[left, right]`` is the rank and the new symbol, ``lookahead`` the symbols that can change what is before them."""

    def __init__(self, vocab: dict[str, int], pairs: list[tuple[str, str]], end: str) -> None:
        self.of: dict[tuple[int, int], tuple[int, int]] = {}
        size = {i: len(t[: -len(end)] if end and t.endswith(end) else t) for t, i in vocab.items()}
        made: dict[int, int] = {}
        left_of: dict[int, int] = {}
        proper = True
        for rank, (a, b) in enumerate(pairs):
            left, right, new = vocab[a], vocab[b], vocab[a + b]
            self.of[left, right] = rank, new
            proper &= new not in made and all(size[x] == 1 or x in made for x in (left, right))
            made[new], left_of[new] = rank, left
        self.longest = max(size.values(), default=1)
        self.lookahead = self._sufficient(pairs, vocab, size, left_of) if proper else None
        self.table = self._table()

    def _table(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """The merges as an open-addressing table: pairs, ranks, new symbols; and the most steps to a pair."""
        size = 1 << max(4, (4 * len(self.of)).bit_length())
        keys, ranks, news = np.full(size, -1, np.int64), np.full(size, NO_RANK, np.int64), np.zeros(size, np.int64)
        todo = np.array([(left << 32 | right, rank, new) for (left, right), (rank, new) in self.of.items()], np.int64).reshape(-1, 3)
        steps = 0
        at = self._slot(todo[:, 0], size)
        while len(todo):
            steps += 1
            _, first = np.unique(at, return_index=True)
            first = first[keys[at[first]] < 0]
            keys[at[first]], ranks[at[first]], news[at[first]] = todo[first].T
            rest = np.ones(len(todo), bool)
            rest[first] = False
            todo, at = todo[rest], (at[rest] + 1) & (size - 1)
        return keys, ranks, news, steps

    @staticmethod
    def _slot(pairs: np.ndarray, size: int) -> np.ndarray:
        mixed = (pairs ^ (pairs >> 29)).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (mixed >> np.uint64(64 - size.bit_length() + 1)).astype(np.int64)

    def found(self, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ranks and new symbols of pairs; ``NO_RANK`` where there is no merge."""
        keys, ranks, news, steps = self.table
        at = self._slot(pairs, len(keys))
        for _ in range(steps):
            wrong = np.flatnonzero((keys[at] != pairs) & (keys[at] >= 0))
            if not len(wrong):
                break
            at[wrong] = (at[wrong] + 1) & (len(keys) - 1)
        right = keys[at] == pairs
        return np.where(right, ranks[at], NO_RANK), news[at]

    def merged_words(self, symbols: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The merged symbols of many words at once, one word after another, and how many each has: the same as ``merged``.

        In each round every word makes the merges of its lowest rank, leftmost first; words without any are done.
        """
        word = np.repeat(np.arange(len(sizes)), sizes)
        done_symbols, done_words = [], []
        symbols = symbols.astype(np.int64)
        while len(symbols):
            pairs = np.append(symbols[:-1] << 32 | symbols[1:], 0)
            ranks, news = self.found(pairs)
            ranks[np.append(word[:-1] != word[1:], True)] = NO_RANK
            starts = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            each = np.diff(np.append(starts, len(word)))
            least = np.repeat(np.minimum.reduceat(ranks, starts), each)
            over = least == NO_RANK
            done_symbols.append(symbols[over])
            done_words.append(word[over])
            merge = ~over & (ranks == least)
            # Of equal symbols in a row, each second pair overlaps the one before it.
            follows = np.flatnonzero(merge[1:] & merge[:-1]) + 1
            if len(follows):
                begins = np.flatnonzero(merge & ~np.append(False, merge[:-1]))
                place = np.arange(len(merge)) - begins[np.maximum(np.searchsorted(begins, np.arange(len(merge)), "right") - 1, 0)]
                merge &= place % 2 == 0
            symbols = np.where(merge, news, symbols)
            keep = ~over & ~np.append(False, merge[:-1])
            symbols, word = symbols[keep], word[keep]
        words = np.concatenate(done_words) if done_words else np.zeros(0, np.int64)
        order = np.argsort(words, kind="stable")
        return (np.concatenate(done_symbols) if done_symbols else np.zeros(0, np.int64))[order], np.bincount(words, minlength=len(sizes))

    @staticmethod
    def _sufficient(pairs, vocab, size, left_of) -> int:
        """Symbols behind a token's end from which on no further symbol changes it.

        Take a text and the same text with more behind it, and merge both rank by rank. Where they agree up to a place, the
        place moves left only when the token before it is the left part of the merge at hand, by that token's length, and
        the right part then begins with what differed before: with the left part of the merge that moved the place last. So
        the moves are a chain of merges of growing rank, each of whose right parts has the left part of the one before on
        its left spine, and the longest chain is found in one pass over the list.
        """
        reach: dict[int, int] = {}
        most = 0
        for a, b in pairs:
            left, at, before = vocab[a], vocab[b], 0
            while at is not None:
                before = max(before, reach.get(at, 0))
                at = left_of.get(at)
            moved = before + size[left]
            reach[left] = max(reach.get(left, 0), moved)
            most = max(most, moved)
        return most

    def merged(self, symbols: list[int]) -> list[int]:
        """The symbols with all merges made, lowest rank first, leftmost of equal ones."""
        of = self.of
        if len(symbols) <= SHORT:
            out = list(symbols)
            while len(out) > 1:
                best = min((of[pair] for pair in zip(out, out[1:]) if pair in of), default=None)  # noqa: B905
                if best is None:
                    break
                at, made = 0, []
                while at < len(out):
                    if at + 1 < len(out) and of.get((out[at], out[at + 1])) == best:
                        made.append(best[1])
                        at += 2
                    else:
                        made.append(out[at])
                        at += 1
                out = made
            return out
        own, after, before = list(symbols), list(range(1, len(symbols) + 1)), list(range(-1, len(symbols) - 1))
        heap = [(*of[pair], k) for k, pair in enumerate(zip(own, own[1:])) if pair in of]  # noqa: B905
        heap = [(rank, k, new) for rank, new, k in heap]
        heapq.heapify(heap)
        end = len(own)
        while heap:
            rank, k, new = heapq.heappop(heap)
            right = after[k]
            if own[k] < 0 or right >= end or of.get((own[k], own[right])) != (rank, new):
                continue
            own[k], own[right] = new, -1
            after[k] = after[right]
            if after[k] < end:
                before[after[k]] = k
            for left in (before[k], k):
                if left >= 0 and after[left] < end and (own[left], own[after[left]]) in of:
                    found = of[own[left], own[after[left]]]
                    heapq.heappush(heap, (found[0], left, found[1]))
        return [x for x in own if x >= 0]


class Transducer:
    """Symbols of one word go in, tokens come out as soon as no later symbol can change them.

    It holds at most ``2 * lookahead`` symbols and a token's length besides, however long the word. A list that is no proper
    merge list (a token that two merges make, or that is used before it is made) has no known lookahead: then a word is held.
    """

    def __init__(self, merges: Merges, sizes: list[int]) -> None:
        self.merges, self.sizes, self.held = merges, sizes, []
        self.room = None if merges.lookahead is None else 2 * merges.lookahead + merges.longest

    def feed(self, symbols: Iterable[int]) -> Iterator[int]:
        """Takes symbols after which the word goes on."""
        for symbol in symbols:
            self.held.append(symbol)
            if self.room is not None and len(self.held) > self.room:
                yield from self._stable()

    def _stable(self) -> Iterator[int]:
        until, at = len(self.held) - self.merges.lookahead, 0
        for token in self.merges.merged(self.held):
            if at + self.sizes[token] > until:
                break
            at += self.sizes[token]
            yield token
        del self.held[:at]

    def finish(self, last: int) -> Iterator[int]:
        """Takes the word's last symbol."""
        yield from self.merges.merged([*self.held, last])
        self.held.clear()


class Kept:
    """A bounded table: when one generation is full the older one is dropped."""

    def __init__(self) -> None:
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def get(self, text: str) -> bytes | None:
        found = self.new.get(text)
        if found is None and (found := self.old.get(text)) is not None:
            self.put(text, found)
        return found

    def put(self, text: str, ids: bytes) -> None:
        if len(text) <= KEPT_CHARS:
            if len(self.new) >= KEPT:
                self.new, self.old = {}, self.new
            self.new[text] = ids


class Encoder:
    """Encodes texts by the merges of a tokenizer's file, with the names of its special tokens as the library takes them.

    Cutting a text into words (normalising and splitting) is the library's; the merges are made by ``Transducer``. Where a
    file drops all white space, words are looked up by what stands between white space.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            shape = json.load(file)
        whole, model = Tokenizer.from_file(path), shape["model"]
        if model["type"] != "BPE" or any(model.get(x) for x in ("unk_token", "continuing_subword_prefix", "dropout", "byte_fallback", "ignore_merges")):
            raise ValueError("the file is no plain byte-pair encoding")
        self.normalizer, self.cutter, self.end = whole.normalizer, whole.pre_tokenizer, model["end_of_word_suffix"] or ""
        vocab = model["vocab"]
        self.merges = Merges(vocab, [tuple(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]], self.end)
        self.names = {i: t for t, i in vocab.items()} | {x["id"]: x["content"] for x in shape["added_tokens"]}
        self.sizes = [len(self.names.get(i, "").removesuffix(self.end) if self.end else self.names.get(i, "")) for i in range(max(self.names) + 1)]
        self.inner = {c: vocab[c] for c in map(chr, range(0x180)) if c in vocab}
        self.last = {c: vocab[c + self.end] for c in self.inner if c + self.end in vocab}
        self.inner_of, self.last_of = np.full((2, 0x180), -1, np.int64)
        for own_ids, ids in ((self.inner_of, self.inner), (self.last_of, self.last)):
            for c, i in ids.items():
                own_ids[ord(c)] = i
        if any(x["lstrip"] or x["rstrip"] or x["single_word"] or x["normalized"] for x in shape["added_tokens"]):
            raise ValueError("special tokens that take in what stands around them are not known here")
        self.special = {x["content"]: x["id"] for x in shape["added_tokens"]}
        self.special_cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        #: Cutting between white space is right where no word has any and no pattern looks around itself.
        self.drops_blanks = known_cuts(shape)
        self.chunks, self.words = Kept(), Kept()

    def cut(self, text: str) -> list[str]:
        """The words of a text, each byte as its letter of the vocabulary."""
        if self.drops_blanks and COMMON.fullmatch(text):
            words = COMMON_WORDS.findall(text.lower())
            return words if text.isascii() else [w if w.isascii() else w.encode().decode("latin-1").translate(BYTE_LETTERS) for w in words]
        text = self.normalizer.normalize_str(text) if self.normalizer else text
        return [w for w, _ in self.cutter.pre_tokenize_str(text)]

    def streamed(self, word: str) -> bytes:
        """The ids of one word by the transducer."""
        machine = Transducer(self.merges, self.sizes)
        ids = array("I", machine.feed(self.inner[c] for c in word[:-1]))
        ids.extend(machine.finish(self.last[word[-1]]))
        return ids.tobytes()

    def words_of(self, words: list[str]) -> dict[str, bytes]:
        """The ids of words: long ones are streamed, the others merged together."""
        out = {w: self.streamed(w) for w in words if len(w) > TOGETHER}
        short = [w for w in words if len(w) <= TOGETHER]
        if short:
            sizes = np.fromiter(map(len, short), np.int64, len(short))
            letters = np.frombuffer("".join(short).encode("utf-32-le"), "<u4")
            symbols = self.inner_of[letters]
            ends = np.cumsum(sizes) - 1
            symbols[ends] = self.last_of[letters[ends]]
            ids, counts = self.merges.merged_words(symbols, sizes)
            flat, at = ids.astype("<u4").tobytes(), np.concatenate(([0], np.cumsum(counts))) * 4
            at = at.tolist()
            out.update({w: flat[a:b] for w, a, b in zip(short, at[:-1], at[1:], strict=True)})
        return out

    def chunks_of(self, chunks: list[str]) -> dict[str, bytes]:
        """The ids of texts without the names of special tokens; both tables keep what is short."""
        cuts = [[w for part in (WORD_END.split(c) if self.drops_blanks and len(c) > BLOCK else [c]) for w in self.cut(part)] for c in chunks]
        words = {w: self.words.get(w) for w in {w for ws in cuts for w in ws}}
        new = self.words_of([w for w, ids in words.items() if ids is None])
        words.update(new)
        for w, ids in new.items():
            self.words.put(w, ids)
        out = {}
        for chunk, ws in zip(chunks, cuts, strict=True):
            out[chunk] = ids = words[ws[0]] if len(ws) == 1 else b"".join([words[w] for w in ws])
            self.chunks.put(chunk, ids)
        return out

    def plain(self, texts: list[str]) -> list[bytes]:
        """Ids of texts without special tokens, looked up together."""
        if not self.drops_blanks:
            own = self.chunks_of(list(set(texts)))
            return [own[t] for t in texts]
        parts = []
        for text in texts:
            for c in BLANKS:
                if c in text:
                    text = text.replace(c, " ")
            parts.append(text.split(" "))
        held, older = self.chunks.new.get, self.chunks.old.get
        found = [[held(w) or older(w) for w in ws] for ws in parts]
        new = {w for ws, ids in zip(parts, found, strict=True) if None in ids for w, x in zip(ws, ids, strict=True) if x is None and w}
        extra = self.chunks_of(list(new)) | {"": b""}
        return [b"".join(ids if None not in ids else [extra[w] if x is None else x for w, x in zip(ws, ids, strict=True)]) for ws, ids in zip(parts, found, strict=True)]

    def pieces(self, texts: list[str]) -> Iterator[tuple[int, str | int]]:
        """The parts of texts that are encoded by themselves, with the number of the text: special tokens as ids, runs of about ``BLOCK`` characters."""
        for k, text in enumerate(texts):
            parts = self.special_cut.split(text) if self.special_cut and any(s in text for s in self.special) else [text]
            for special, part in enumerate(parts):
                if special % 2:
                    yield k, self.special[part]
                    continue
                at = 0
                while at < len(part):
                    until = part.find(" ", at + BLOCK) if self.drops_blanks and len(part) - at > BLOCK else -1
                    yield k, part[at : until if until >= 0 else len(part)]
                    at = until if until >= 0 else len(part)

    def encode_many(self, texts: list[str]) -> list[array]:
        """The ids of whole texts."""
        out = [array("I") for _ in texts]
        held: list[tuple[int, str | int]] = []
        size = 0

        def flush() -> None:
            ids = iter(self.plain([p for _, p in held if isinstance(p, str)]))
            for k, piece in held:
                if isinstance(piece, str):
                    out[k].frombytes(next(ids))
                else:
                    out[k].append(piece)
            held.clear()

        for k, piece in self.pieces(texts):
            held.append((k, piece))
            size += len(piece) if isinstance(piece, str) else 1
            if size >= BLOCK:
                flush()
                size = 0
        flush()
        return out

    def encode(self, text: str) -> array:
        return self.encode_many([text])[0]


class Decoder:
    """Ids to text, some at a time.

    With a byte-level decoder in the file, tokens are bytes, and an incremental state machine makes characters of them: it holds
    the bytes of an unfinished character only, and puts U+FFFD for what is none. Without a decoder tokens are joined by spaces.
    """

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as file:
            shape = json.load(file)
        kind = (shape["decoder"] or {"type": None})["type"]
        if kind not in (None, "ByteLevel"):
            raise ValueError(f"decoder {kind} is not known here")
        names = {i: t for t, i in shape["model"]["vocab"].items()} | {x["id"]: x["content"] for x in shape["added_tokens"]}
        self.by_bytes = kind == "ByteLevel"
        byte_of = {chr(c): b for b, c in BYTE_LETTERS.items()} | {chr(b): b for b in range(256) if b not in BYTE_LETTERS}
        self.tokens: list = ["" if not self.by_bytes else b""] * (max(names) + 1)
        for i, name in names.items():
            known = all(c in byte_of for c in name)
            self.tokens[i] = name if not self.by_bytes else bytes(byte_of[c] for c in name) if known else name.encode()

    def decode(self, ids: array) -> Iterator[str]:
        """The text of a stream of ids in pieces; ids that the file does not have are left out."""
        machine = codecs.getincrementaldecoder("utf-8")("replace")
        tokens, most, begun = self.tokens, len(self.tokens), False
        for at in range(0, len(ids), IDS):
            part = ids[at : at + IDS]
            own = list(map(tokens.__getitem__, part if max(part) < most else [i for i in part if i < most]))
            if self.by_bytes:
                yield machine.decode(b"".join(own))
            elif own:
                yield (" " if begun else "") + " ".join(own)
                begun = True
        yield machine.decode(b"", True)


_OWN: dict[tuple[type, str], Encoder | Decoder] = {}


def own(kind: type, path: str):
    """One coder per worker process and file."""
    if (kind, path) not in _OWN:
        _OWN[kind, path] = kind(path)
    return _OWN[kind, path]


def encoded(docs: DataFrame, tokenizer_path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, ids``: the ids of every whole text, as the library gives them without special tokens at the ends.

    Names of special tokens inside a text are these tokens, as the library takes them. Null texts are empty and have no ids;
    very long texts and words are encoded whole, in bounded memory besides the text and its ids. Ids may be null or repeat,
    every row is encoded by itself. An empty table gives an empty result; other columns are not read.
    """
    bounded(docs.sparkSession)
    id_type = docs.schema[key].dataType.simpleString()

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = own(Encoder, tokenizer_path)
        for part in parts:
            out = coder.encode_many([t or "" for t in part.column(1).to_pylist()])
            ends = array("i", [0])
            flat = array("I")
            for ids in out:
                flat.extend(ids)
                ends.append(len(flat))
            ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.Array.from_buffers(pa.int32(), len(flat), [None, pa.py_buffer(flat)]))
            yield pa.RecordBatch.from_arrays([part.column(0), ids], names=["doc_id", "ids"])

    return docs.select(F.col(f"`{key}`"), F.col(f"`{text}`")).mapInArrow(run, f"doc_id {id_type}, ids array<int>")


def decoded(rows: DataFrame, tokenizer_path: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """``doc_id, ids, text``: the text of every list of ids, special tokens included.

    A null list is empty; null ids in a list, and ids that the file does not have, are left out.
    """
    bounded(rows.sparkSession)
    id_type = rows.schema[key].dataType.simpleString()

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = own(Decoder, tokenizer_path)
        for part in parts:
            texts = []
            for own_ids in part.column(1):
                values = own_ids.values
                known = values.drop_null().cast(pa.uint32(), safe=False) if values is not None else pa.array([], pa.uint32())
                texts.append("".join(coder.decode(array("I", known.to_numpy().tobytes()))))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string())], names=["doc_id", "ids", "text"])

    return rows.select(F.col(f"`{key}`"), F.col(f"`{ids}`")).mapInArrow(run, f"doc_id {id_type}, ids array<int>, text string")


def op11_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = vocabulary("word_bpe_49k.json")
    rows = decoded(encoded(documents(spark, sf_dir), path), path)
    return rows.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"), F.sha2(F.encode("text", "UTF-8"), 256).alias("decoded_sha256"))
