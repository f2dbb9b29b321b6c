"""Token ids by a public tokenizer file, with the ids of repeated words kept in a bounded table."""

from __future__ import annotations

import json
import os
import re
import sys
from array import array
from operator import itemgetter

if sys.byteorder != "little" or array("I").itemsize != 4:
    raise ImportError("ids are kept as little-endian 32-bit integers")

#: Words whose ids a worker keeps: those that it meets again, until the table is full; others are encoded each time.
KEPT_WORDS = 300_000
#: Marks for words that were met once, a byte each by the word's hash.
MET = 1 << 22
#: Words that are encoded together.
ENCODED = 4000
_L, _P = "A-Za-zÀ-ÖØ-öø-ÿ", r"!-/:-@\[-`{-~"
#: Letters, perhaps marks, perhaps the same again in a new line: the tokenizers cut such a word at these places.
SIMPLE = re.compile(f"([{_L}]+)([{_P}]*)(?:\n([{_L}]+)([{_P}]*))?")
#: A space after white space and before white space or the end: only there a cut before the space could change ids.
UNSAFE = re.compile(r"\s (?:\s|\Z)")
#: A widespread pattern of words, and the normalizer that goes with it. For texts of the letters below, which
#: are their own normal form, lower-casing and this pattern with the letters spelt out do the same.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
NORMALIZER = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
COMMON_TEXT = re.compile("[\t-\r -~À-ÖØ-öø-ÿ]*")
COMMON_PIECES = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-zß-öø-ÿ0-9\t-\r ]+")
#: Characters of a text that are taken apart together; it goes on at the next white space.
BLOCK = re.compile("[^\0]{1,1000000}[^\t-\r ]*")
#: The cuts that never change ids: before a space that follows a non-space or precedes one.
SAFE_CUT = re.compile(r"(?<!\s)(?= )|(?= \S)")
_ENCODERS: dict[tuple[str, bool], WordwiseEncoder] = {}


def byte_letters() -> dict[int, int]:
    """The character that stands for each byte in a byte-level vocabulary: printable Latin-1 as it is, others from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = [b for b in range(256) if b not in plain]
    return {b: 256 + k for k, b in enumerate(others)}


BYTE_LETTERS = byte_letters()


def vocabulary(name: str) -> str:
    """The place of a public tokenizer's file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def known_cuts(shape: dict) -> bool:
    """Whether a tokenizer's file has ``NORMALIZER`` and cuts by ``PATTERN``, with no other steps."""
    split = {"type": "Split", "pattern": {"Regex": PATTERN}, "behavior": "Removed", "invert": True}
    level = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}
    return shape["normalizer"] == {"type": "Sequence", "normalizers": NORMALIZER} and shape["pre_tokenizer"] == {"type": "Sequence", "pretokenizers": [split, level]}


class Pieces(dict):
    """Ids of pieces; those that it does not have are made and kept, from half its room on when they are met again."""

    def __init__(self, made, room: int) -> None:
        super().__init__({"": b""})
        self.made, self.room, self.met = made, room, bytearray(MET)

    def __missing__(self, piece: str) -> bytes:
        got, at = self.made(piece), hash(piece) & MET - 1
        if len(self) < self.room and len(piece) < 60 and (2 * len(self) < self.room or self.met[at]):
            self[piece] = got
        self.met[at] = 1
        return got


class WordwiseEncoder:
    """Encodes texts as the tokenizer does, looking at each kept word once.

    The tokenizers cut at white space before they merge, so a text's ids are those of its words one after another, each
    word with the space before it. Texts are cut before spaces only, and where spaces stand next to other white space
    only before the last of them, which is where the tokenizers cut too. Where the file's own cuts are known and drop all
    white space, a text of common letters is cut into its pieces at once, and no words are looked up.

    A special token's name inside a text is that token, as the tokenizers have it; with ``plain`` it is ordinary text.
    A text with such a name is encoded by the tokenizer as a whole.
    """

    def __init__(self, path: str, plain: bool = False) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = plain
        #: Ids of words with a space before them, by the word, and of what starts a text.
        self.spaced: dict[str, bytes] = {}
        self.met = bytearray(MET)
        self.first: dict[str, bytes] = {"": b""}

        with open(path, encoding="utf-8") as file:
            shape = json.load(file)
        self.names = [] if plain else [x["content"] for x in shape["added_tokens"]]
        cut, normal = shape["pre_tokenizer"]["type"], shape["normalizer"]
        lowers = bool(normal) and any(x["type"] == "Lowercase" for x in normal.get("normalizers", []))
        #: True: a piece has the space before it. False: lower-cased, spaces dropped. None: words are not taken apart here.
        self.spaces = True if cut == "ByteLevel" and not normal else False if lowers and shape["model"]["end_of_word_suffix"] == "</w>" else None
        self.common = self.spaces is False and known_cuts(shape)
        #: Ids of the pieces of simple words; where nothing else is kept there is room for twice as many.
        self.pieces = Pieces(self._piece, KEPT_WORDS * (1 + self.common))

    def _piece(self, piece: str) -> bytes:
        plain = piece
        if not piece.isalpha() or not piece.isascii():
            plain = piece.encode().decode("latin-1").translate(BYTE_LETTERS)
        return array("I", [x.id for x in self.tokenizer.model.tokenize(plain)]).tobytes()

    def _simple(self, word: str, before: str) -> bytes | None:
        """The ids of a simple word from those of its pieces; None for other words."""
        found = SIMPLE.fullmatch(word) if self.spaces is not None and len(word) < 60 else None
        if not found:
            return None
        letters, marks, letters2, marks2 = found.groups("")
        own = self.pieces
        if not self.spaces:
            return own[letters.lower()] + own[marks] + own[letters2.lower()] + own[marks2]
        out = own[before + letters] + own[marks]
        return out + own["\n"] + own[letters2] + own[marks2] if letters2 else out

    def _encoded(self, new: list[str], before: str, kept: dict[str, bytes]) -> dict[str, bytes]:
        """The ids of new words; they are kept while there is room."""
        extra: dict[str, bytes] = {}

        def put(word: str, ids: bytes) -> None:
            at = hash(word) & MET - 1
            if self.met[at] and len(kept) < KEPT_WORDS and len(word) < 60:
                kept[word] = ids
            else:
                self.met[at] = 1
                extra[word] = ids

        other = []
        for word in new:
            ids = self._simple(word, before)
            if ids is None:
                other.append(word)
            else:
                put(word, ids)
        for at in range(0, len(other), ENCODED):
            part = other[at : at + ENCODED]
            for word, found in zip(part, self.tokenizer.encode_batch_fast([before + w for w in part], add_special_tokens=False), strict=True):
                put(word, array("I", found.ids).tobytes())
        return extra

    def _looked_up(self, words: list[list[str]], before: str, kept: dict[str, bytes]) -> list[list[bytes]]:
        get = kept.get
        out = [[get(w) for w in ws] for ws in words]
        missing = [(k, [i for i, x in enumerate(got) if x is None]) for k, got in enumerate(out) if None in got]
        extra = self._encoded(list({words[k][i] for k, at in missing for i in at}), before, kept)
        for k, at in missing:
            for i in at:
                out[k][i] = extra[words[k][i]] if words[k][i] in extra else kept[words[k][i]]
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        named = {k for name in self.names for k, text in enumerate(texts) if name in text}
        if named:
            others = iter(self.encode([t for k, t in enumerate(texts) if k not in named]))
            return [array("I", self.tokenizer.encode(t, add_special_tokens=False).ids).tobytes() if k in named else next(others) for k, t in enumerate(texts)]
        if self.common:
            taken = [self._taken_apart(t) if COMMON_TEXT.fullmatch(t) else None for t in texts]
            others = iter(self._by_words([t for t, ids in zip(texts, taken, strict=True) if ids is None]))
            return [next(others) if ids is None else ids for ids in taken]
        return self._by_words(texts)

    def _taken_apart(self, text: str) -> bytes:
        """The ids of a text of common letters."""
        out = [b""]
        for part in BLOCK.findall(text):
            pieces = COMMON_PIECES.findall(part.lower())
            out += itemgetter("", *pieces, "")(self.pieces)  # one call for all of them
        return b"".join(out)

    def _by_words(self, texts: list[str]) -> list[bytes]:
        starts, rest = [], []
        for text in texts:
            if UNSAFE.search(text):
                first, *words = SAFE_CUT.split(text)
                if not all(w.startswith(" ") for w in words):  # the text starts with a space and is cut there too
                    raise AssertionError("a cut that is not before a space")
                words = [w[1:] for w in words]
            else:
                first, *words = text.split(" ")
            starts.append([first])
            rest.append(words)
        heads, tails = self._looked_up(starts, "", self.first), self._looked_up(rest, " ", self.spaced)
        return [b"".join(h + t) for h, t in zip(heads, tails, strict=True)]


def encoder(path: str, plain: bool = False) -> WordwiseEncoder:
    """One encoder per worker process, file and treatment of special tokens' names."""
    if (path, plain) not in _ENCODERS:
        _ENCODERS[path, plain] = WordwiseEncoder(path, plain)
    return _ENCODERS[path, plain]


def end_bytes(end_id: int) -> bytes:
    return int(end_id).to_bytes(4, "little")
