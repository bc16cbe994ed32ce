"""BPE encoding by backtracking over longest token matches, decoding by an offset table.

An Aho-Corasick automaton finds the longest token that starts at each place of a piece. Tokens are laid from the
left; a token may follow another only if no merge across the seam would have come first (pair-compatibility table,
filled as pairs turn up). Where none fits, the last token is taken back and shortened; a place that has failed once
is not tried again, so a piece takes linear time and the result equals that of applying all merges.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from functools import cache
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tallyroom.llm._text import freeing

_NEVER = 1 << 40
_FINAL = 0x1000
#: Pieces whose tokens a task remembers in each of two generations (about 20 MB each), and pairs of tokens (about 20 MB).
CACHE_PIECES, CACHE_PAIRS = 120_000, 200_000
#: Pieces of a text that are put together at once.
SLICE = 20_000
_ASCII_PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\x09-\x0d\x20a-z0-9]+")
# The encoder that this one must equal takes letters and numbers from Unicode 16, the order of combining
# marks from Unicode 9 and lower case from Unicode 17. Ranges that Python's own tables (Unicode 15.1) lack or, for the
# marks, have too many.
LETTERS_16 = """1C89-1C8A A7CB-A7CD A7DA-A7DC 105C0-105F3 10D4A-10D65 10D6F-10D85 10EC2-10EC4 11380-11389 1138B 1138E
11390-113B5 113B7 113D1 113D3 11BC0-11BE0 13460-143FA 16100-1611D 16D40-16D6C 18CFF 1E5D0-1E5ED 1E5F0"""
NUMBERS_16 = "10D40-10D49 116D0-116E3 11BF0-11BF9 16130-16139 16D70-16D79 1CCF0-1CCF9 1E5F1-1E5FA"
MARKS_AFTER_9 = """7FD 898-89F 8CA-8D3 9FE C3C D3B-D3C EBA 1715 1ABF-1ACE 1DF6-1DFA A82C 10D24-10D27 10EAB-10EAC 10EFD-10EFF
10F46-10F50 10F82-10F85 11070 1133B 1145E 11839-1183A 11930 11938 1193D-1193E 11943 119E0 11A34 11A47 11A99 11D42
11D44-11D45 11D97 11F41-11F42 16FF0-16FF1 1E08F 1E130-1E136 1E2AE 1E2EC-1E2EF 1E4EC-1E4EF"""
#: White space, as it stands between the brackets of a pattern.
WHITE = r"\x09-\x0d\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: First and last capital, and the first one's small letter.
CAPITALS_17 = """1C89-1C89:1C8A A7CB-A7CB:264 A7CC-A7CC:A7CD A7CE-A7CE:A7CF A7D2-A7D2:A7D3 A7D4-A7D4:A7D5 A7DA-A7DA:A7DB
A7DC-A7DC:19B 10D50-10D65:10D70 16EA0-16EB8:16EBB"""


def _ranges(text: str) -> list[tuple[int, int]]:
    return [(int(r.partition("-")[0], 16), int(r.rpartition("-")[2], 16)) for r in text.split()]


def _members(ranges: list[tuple[int, int]]) -> str:
    """Ranges as they stand between the brackets of a pattern."""
    return "".join(f"\\U{a:08X}-\\U{b:08X}" for a, b in ranges)


def _category(first: str, more: str, most: int) -> str:
    """All code points up to `most` whose category begins with `first`, and `more`, as they stand between the brackets of a pattern."""
    kinds = np.fromiter((unicodedata.category(chr(c))[0] == first for c in range(most + 1)), bool, most + 1)
    for a, b in _ranges(more):
        kinds[a : b + 1] = True
    edges = np.flatnonzero(np.diff(kinds.astype(np.int8), prepend=0, append=0))
    return _members([(int(a), int(b) - 1) for a, b in edges.reshape(-1, 2)])


@cache
def _any_pieces(most: int) -> re.Pattern:
    """The pattern for texts of code points up to `most`; one for the first plane alone is read faster."""
    letters, numbers = _category("L", LETTERS_16, most), _category("N", NUMBERS_16, most)
    return re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{letters}]+|[{numbers}]|[^{WHITE}{letters}{numbers}]+")


_BEYOND = re.compile("[\U00010000-\U0010ffff]")
_MARKS = re.compile("([" + _members(_ranges(MARKS_AFTER_9)) + "])")
_SMALL = {c: int(to, 16) + c - a for spans, _, to in (x.partition(":") for x in CAPITALS_17.split()) for a, b in _ranges(spans) for c in range(a, b + 1)}
_CAPITALS = re.compile("[" + "".join(map(chr, _SMALL)) + "]")


def normalised(text: str) -> str:
    """Composed (NFC) and in lower case, character by character."""
    if not unicodedata.is_normalized("NFC", text):
        text = "".join([p if i % 2 else unicodedata.normalize("NFC", p) for i, p in enumerate(_MARKS.split(text))])
    if _CAPITALS.search(text):
        text = text.translate(_SMALL)
    return text.replace("\u03a3", "\u03c3").lower()


def _byte_letters() -> list[str]:
    """The printable letter that stands for each byte: itself where printable, else the next free one from 256 on."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    free = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(free)) for b in range(256)]


class WordBpe:
    """Encoder and decoder of a tokenizer file whose model is BPE with word ends."""

    def __init__(self, text: str):
        file = json.loads(text)
        model = file["model"]
        end = model["end_of_word_suffix"]
        vocab: dict[str, int] = model["vocab"]
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        first = len(vocab) - len(merges)
        if any(vocab[a + b if not a.endswith(end) else a] != first + i for i, (a, b) in enumerate(merges)):
            raise ValueError("token ids are not in the order of the merges")
        self.special = {t["content"]: t["id"] for t in file["added_tokens"]}
        self._special = re.compile("|".join(re.escape(s) for s in sorted(self.special, key=len, reverse=True))) if self.special else None
        self._letters = dict(enumerate(_byte_letters()))
        self.split = [(i, i) for i in range(first)] + [(vocab[a], vocab[b]) for a, b in merges]
        self.merged = {pair: first + i for i, pair in enumerate(self.split[first:])}
        self._fits: dict[int, bool] = {}
        reachable = [True] * first
        for t, (a, b) in enumerate(self.split[first:], first):
            reachable.append(reachable[a] and reachable[b] and self._apart(a, b, t))
        units = {t: name[: -len(end) - 1] + chr(ord(name[-len(end) - 1]) + _FINAL) if name.endswith(end) and name != end else name for name, t in vocab.items()}
        ids = {s: t for t, s in units.items() if reachable[t]}
        self._length = [0] * (max(vocab.values()) + 1)
        for s, t in ids.items():
            self._length[t] = len(s)
        self._shorter = [-1] * len(self._length)
        for s, t in ids.items():
            self._shorter[t] = next((ids[s[:n]] for n in range(len(s) - 1, 0, -1) if s[:n] in ids), -1)
        self._automaton = ahocorasick.Automaton()
        for s, t in ids.items():
            self._automaton.add_word(s, t)
        self._automaton.make_automaton()
        names = {t: s for s, t in vocab.items()} | {t: s for s, t in self.special.items()}
        self._kind = np.uint16 if max(names) < 1 << 16 else np.uint32
        self._spelled = _Offsets([names.get(t, "") for t in range(max(names) + 1)])
        self._numbers = _Offsets([str(t) for t in range(max(names) + 1)])
        self._known = _Known(self)

    def _apart(self, a: int, b: int, limit: int) -> bool:
        """Whether no merge across the seam of a and b comes before both are built (and before `limit`)."""
        while True:
            if self.merged.get((a, b), _NEVER) < limit:
                return False
            left, right = self.split[a][1], self.split[b][0]
            if a > b and left != a or right == b:
                if left == a:
                    return True
                limit, a = a, left
            else:
                limit, b = b + 1, right

    def _judged(self, a: int, b: int) -> bool:
        """A new entry of the pair table."""
        if len(self._fits) >= CACHE_PAIRS:
            self._fits.clear()
        good = self._fits[a << 20 | b] = self._apart(a, b, _NEVER)
        return good

    def _piece(self, piece: str) -> tuple[int, ...]:
        # printable ASCII stands for itself
        letters = piece if piece.isascii() and piece.isprintable() else piece.encode().decode("latin-1").translate(self._letters)
        letters = letters[:-1] + chr(ord(letters[-1]) + _FINAL)
        size, fits, judged = len(letters), self._fits.get, self._judged
        # the longest token at each place, one after the other: right where all neighbours fit
        out = [t for _, t in self._automaton.iter_long(letters)]
        last = out[0]
        for t in out[1:]:
            good = fits(last << 20 | t)
            if not (judged(last, t) if good is None else good):
                break
            last = t
        else:
            return tuple(out)
        length, shorter = self._length, self._shorter
        longest = [-1] * (size + 1)
        for end, t in self._automaton.iter(letters):
            # of tokens with one start the last that is found is the longest
            longest[end + 1 - length[t]] = t
        out, dead = [], bytearray(size + 1)
        at, token = 0, longest[0]
        while at < size:
            while token >= 0:
                to = at + length[token]
                if not dead[to]:
                    if not out:
                        break
                    good = fits(out[-1] << 20 | token)
                    if judged(out[-1], token) if good is None else good:
                        break
                token = shorter[token]
            if token >= 0:
                out.append(token)
                at = to
                token = longest[at]
            else:
                dead[at] = 1
                if not out:
                    raise ValueError(f"no tokens for {piece!r}")
                token = out.pop()
                at -= length[token]
        return tuple(out)

    def _pieces(self, text: str) -> list[str]:
        if text.isascii():
            return _ASCII_PIECES.findall(text.lower())
        return _any_pieces(0x10FFFF if _BEYOND.search(text) else 0xFFFF).findall(normalised(text))

    def _segments(self, text: str) -> list[str | int]:
        """The parts of a text between special tokens, and these by their number."""
        if self._special is None or "<" not in text:
            return [text]
        out, at = [], 0
        for m in self._special.finditer(text):
            out += [text[at : m.start()], self.special[m[0]]]
            at = m.end()
        return [*out, text[at:]]

    def encode(self, text: str) -> np.ndarray:
        """Ids of the tokens; equal pieces are encoded once."""
        out = []
        for s in self._segments(text):
            pieces = [s] if isinstance(s, int) else self._pieces(s)
            for i in range(0, len(pieces), SLICE):
                self._known.turn()
                out.append(b"".join(map(self._known.__getitem__, pieces[i : i + SLICE])))
        return np.frombuffer(b"".join(out), self._kind).astype(np.int64)

    def digests(self, text: str) -> tuple[int, str, str]:
        """Number of tokens, SHA-256 of their decimal ids joined by a space and of the decoded text."""
        ids = self.encode(text)
        return len(ids), hashlib.sha256(self._numbers.joined(ids)).hexdigest(), hashlib.sha256(self.decode(ids)).hexdigest()

    def forget(self) -> None:
        """Frees what it remembers of pieces and pairs: a worker process may be used again for other work."""
        self._known.clear()
        self._known.old = {}
        self._fits.clear()

    def decode(self, ids: np.ndarray) -> bytes:
        """UTF-8 of the tokens joined by one space, as this kind of file has no decoder."""
        return self._spelled.joined(ids)


class _Offsets:
    """Texts by number in one array of bytes, and where each begins."""

    def __init__(self, texts: list[str]):
        held = [f"{t} ".encode() for t in texts]
        self.data, self.at = np.frombuffer(b"".join(held), np.uint8), np.cumsum([0, *map(len, held)], dtype=np.int32)

    def joined(self, ids: np.ndarray, most: int = 1 << 16) -> bytes:
        """The texts of ids with a space between."""
        out = []
        for i in range(0, len(ids), most):
            some = ids[i : i + most]
            starts = self.at[some]
            lengths = self.at[some + 1] - starts
            ends = np.cumsum(lengths, dtype=np.int32)
            out.append(self.data[np.arange(ends[-1], dtype=np.int32) + np.repeat(starts - ends + lengths, lengths)].tobytes())
        return b"".join(out)[:-1]


class _Known(dict):
    """Ids of pieces (or of a special token, which is its id) as bytes; long pieces are not kept. When it is full, what
    it holds becomes the older generation, from which pieces in use come back."""

    def __init__(self, bpe: WordBpe):
        self.bpe, self.old = bpe, {}

    def __missing__(self, piece: str | int) -> bytes:
        told = self.old.get(piece)
        if told is None:
            told = np.array((piece,) if isinstance(piece, int) else self.bpe._piece(piece), self.bpe._kind).tobytes()
        if isinstance(piece, int) or len(piece) <= 64:
            self[piece] = told
        return told

    def turn(self) -> None:
        if len(self) >= CACHE_PIECES:
            self.old = dict(self)
            self.clear()


def encoded(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every text.

    A null or empty text has no tokens (digests of the empty string). Repeated rows give repeated rows; other columns
    are ignored; an empty table gives no rows. A text of any length is encoded whole, its pieces SLICE at a time. The
    tokenizer file is read on the driver and sent once to each executor; its size is the vocabulary's.
    """
    with open(path, encoding="utf-8") as f:
        file = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches):
        bpe = _loaded(file)
        for batch in batches:
            rows = {"doc_id": batch.column(0), "n_tokens": [], "ids_sha256": [], "decoded_sha256": []}
            for text in batch.column(1):
                for column, value in zip(("n_tokens", "ids_sha256", "decoded_sha256"), bpe.digests(text.as_py() or ""), strict=True):
                    rows[column].append(value)
            yield pa.RecordBatch.from_pydict(rows)
        bpe.forget()

    return docs.select("doc_id", "text").mapInArrow(freeing(run), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


_kept: dict[int, WordBpe] = {}


def _loaded(file) -> WordBpe:
    """The encoder of a broadcast file, built once in each worker process."""
    key = hash(file.value)
    if key not in _kept:
        _kept.clear()
        _kept[key] = WordBpe(file.value)
    return _kept[key]
