"""Packing of documents into token sequences by dynamic programming over places to cut.

Documents stay in the order of the table. A task lays the tokens of its documents one after the other, in blocks of
bounded size, and chooses the places where a sequence ends: ends of documents cost nothing, ends of sentences a little,
other places more. The cheapest choice (padding plus these penalties) comes from one pass over the places; the best
start of a padded sequence among all that are near enough is the head of a monotone queue.
"""

from __future__ import annotations

from array import array
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from tokenizers import Tokenizer

from tallyroom.llm._text import chunks, freeing, mix, powers
from tallyroom.llm.bpe import LETTERS_16, NUMBERS_16, WordBpe, _ranges, normalised

SIZE = 2048
#: What a cut inside a document costs, in padded tokens: after a sentence, and elsewhere. Each sequence costs FEW besides.
SENTENCE_CUT, OTHER_CUT, FEW = 16, 64, 4
#: Tokens that are laid and cut together; a longer document is cut there.
BLOCK = 1 << 18
#: Where no sentence ends for GAP tokens, every EVERY-th token is a place to cut.
GAP, EVERY = 512, 128
#: Characters that are split into pieces together, and pieces that a task remembers in each of two generations.
CHARS, CACHE_PIECES = 1 << 20, 200_000
#: Signs that end a sentence, at the end of a token.
ENDS = ".!?。！？…"
_WHITE = [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
_SPACE, _LETTER, _NUMBER, _SIGN = range(4)
_BASE = 0x9E3779B97F4A7C15 | 1
_U = np.uint64


def _classes() -> np.ndarray:
    """Class of every code point, as the tokenizer's pattern takes it."""
    import unicodedata

    first = np.fromiter((ord(unicodedata.category(chr(c))[0]) for c in range(0x110000)), np.uint8, 0x110000)
    out = np.full(0x110000, _SIGN, np.uint8)
    for kind, letter, more in ((_LETTER, "L", LETTERS_16), (_NUMBER, "N", NUMBERS_16)):
        out[first == ord(letter)] = kind
        for a, b in _ranges(more):
            out[a : b + 1] = kind
    out[_WHITE] = _SPACE
    return out


class Encoder:
    """Token ids of many texts at once: equal pieces of a run of text are looked up once and laid out by index."""

    def __init__(self, file: str):
        self.own, self.model = WordBpe(file), Tokenizer.from_str(file).model
        self.classes = _classes()
        self.kind = self.own._kind
        self.code = np.dtype(self.kind).char
        names = self.own._spelled
        spelled = [bytes(names.data[a : b - 1]).decode() for a, b in zip(names.at[:-1], names.at[1:], strict=True)]
        letters = {c: b for b, c in self.own._letters.items()}
        end = lambda s: bytes(letters[c] for c in s if c in letters).decode("utf-8", "ignore")
        self.ends = np.array([end(s.removesuffix("</w>"))[-1:] in tuple(ENDS) for s in spelled])
        self.known: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _ids(self, piece: str) -> bytes:
        told = self.old.get(piece)
        if told is None:
            letters = piece if piece.isascii() and piece.isprintable() else piece.encode().decode("latin-1").translate(self.own._letters)
            told = array(self.code, [t.id for t in self.model.tokenize(letters)]).tobytes()
        if len(piece) <= 64:
            self.known[piece] = told
        return told

    def _split(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of the pieces of a text."""
        kinds = self.classes[codes]
        first = kinds != _SPACE
        first[1:] &= (kinds[1:] != kinds[:-1]) | (kinds[1:] == _NUMBER)
        for i in np.flatnonzero(first & (codes == 39)).tolist():
            tail = codes[i + 1 : i + 3].tobytes().decode("utf-32-le")
            n = 2 if tail[:1] in ("s", "t", "m", "d") else 3 if tail in ("re", "ve", "ll") else 0
            if n:
                first[i + 1] = False
                if i + n < len(codes) and kinds[i + n] != _SPACE:
                    first[i + n] = True
        last = kinds != _SPACE
        last[:-1] &= first[1:] | (kinds[1:] == _SPACE)
        return np.flatnonzero(first), np.flatnonzero(last) + 1

    def _laid(self, text: str, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of a text without special tokens in lower case, and how many lie before each of the edges."""
        codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        starts, ends = self._split(codes)
        if not len(starts):
            return np.zeros(0, self.kind), np.zeros(len(edges), np.int64)
        sums = np.zeros(len(codes) + 1, _U)
        np.cumsum(mix(codes.astype(_U) + _U(1)) * powers(_BASE, len(codes)), out=sums[1:])
        lengths = ends - starts
        # equal pieces get equal numbers where they stand, when the power of the place is taken out
        h = (sums[ends] - sums[starts]) * powers(pow(_BASE, -1, 1 << 64), len(sums))[starts]
        del sums
        _, at, which = np.unique(h, return_index=True, return_inverse=True)
        places = np.repeat(starts[at][which] - (np.cumsum(lengths) - lengths), lengths)
        places += np.arange(len(places))
        inside = np.zeros(len(codes) + 1, np.int8)
        inside[starts] += 1
        inside[ends] -= 1
        if (lengths != lengths[at][which]).any() or (codes[places] != codes[np.cumsum(inside[:-1], dtype=np.int8) > 0]).any():
            at, which = np.arange(len(starts)), np.arange(len(starts))  # two pieces with one number
        if len(self.known) >= CACHE_PIECES:
            self.old, self.known = self.known, {}
        known, found = self.known, []
        for a, b in zip(starts[at].tolist(), ends[at].tolist(), strict=True):
            piece = text[a:b]
            found.append(known.get(piece) or self._ids(piece))
        flat = np.frombuffer(b"".join(found), self.kind)
        counts = np.fromiter(map(len, found), np.int64, len(found)) // np.dtype(self.kind).itemsize
        offsets = np.cumsum(counts) - counts
        each = counts[which]
        before = np.cumsum(each)
        index = np.repeat(offsets[which] - (before - each), each)
        index += np.arange(len(index))
        return flat[index], np.concatenate(([0], before))[np.searchsorted(starts, edges)]

    def encode(self, texts: list[str]) -> Iterator[np.ndarray]:
        """Ids of each text."""
        held, size = [], 0
        for text in texts:
            if self.own._special is not None and "<" in text and self.own._special.search(text):
                yield from self._together(held)
                held, size = [], 0
                yield self.own.encode(text).astype(self.kind)
                continue
            held.append(text.lower() if text.isascii() else normalised(text))
            size += len(text)
            if size >= CHARS:
                yield from self._together(held)
                held, size = [], 0
        yield from self._together(held)

    def _together(self, texts: list[str]) -> Iterator[np.ndarray]:
        if len(texts) == 1 and len(texts[0]) > CHARS:
            yield np.concatenate([self._laid(part, np.zeros(0, np.int64))[0] for part in _parts(texts[0])])
        elif texts:
            edges = np.cumsum([0, *(len(t) + 1 for t in texts)])
            ids, before = self._laid("\n".join([*texts, ""]), edges)
            for a, b in zip(before[:-1].tolist(), before[1:].tolist(), strict=True):
                yield ids[a:b]

    def forget(self) -> None:
        self.known, self.old = {}, {}
        self.own.forget()


def _parts(text: str) -> Iterator[str]:
    """A long text in runs that end at white space; a run without any grows until there is some."""
    at = 0
    while at < len(text):
        to = min(len(text), at + CHARS)
        while to < len(text) and not text[to - 1] in " \n\t\r":
            to += 1
        yield text[at:to]
        at = to


def cuts(n: int, docs: np.ndarray, sentences: np.ndarray, size: int = SIZE, sentence_cut: int = SENTENCE_CUT, other_cut: int = OTHER_CUT) -> np.ndarray:
    """Where the sequences of n tokens end, ascending, the last at n; docs and sentences are sorted places after their ends.

    A sequence of k tokens is padded to size, or not at all where k is a power of two.
    """
    cost = np.full(n + 1, -1, np.int64)
    cost[sentences] = sentence_cut
    cost[docs] = 0
    cost[0] = cost[n] = 0
    held = np.flatnonzero(cost >= 0)
    gap, every = min(GAP, size), min(EVERY, size)
    for a, b in zip(held[:-1], held[1:], strict=True) if (np.diff(held) > gap).any() else ():
        if b - a > gap:
            cost[a + every : b : every] = other_cut
    places = np.flatnonzero(cost >= 0)
    # starts from which a sequence of exactly a power of two ends at a place
    ends, starts = [], []
    for k in range(size.bit_length()):
        if 1 << k <= size:
            want = places - (1 << k)
            i = np.searchsorted(places, want)
            good = np.flatnonzero((places[np.minimum(i, len(places) - 1)] == want) & (want >= 0))
            ends.append(good)
            starts.append(i[good])
    ends, starts = np.concatenate(ends), np.concatenate(starts)
    order = np.argsort(ends, kind="stable")
    first = np.searchsorted(ends[order], np.arange(len(places) + 1)).tolist()
    exact, penalty, at = starts[order].tolist(), (cost[places] + FEW).tolist(), places.tolist()
    best, back = [0] * len(at), [0] * len(at)
    near: deque[tuple[int, int]] = deque()
    for j in range(1, len(at)):
        here, value = at[j], best[j - 1] + at[j - 1]
        while near and near[-1][0] >= value:
            near.pop()
        near.append((value, j - 1))
        while at[near[0][1]] < here - size:
            near.popleft()
        least, start = near[0]
        least += size - here
        for e in range(first[j], first[j + 1]):
            if best[exact[e]] < least:
                least, start = best[exact[e]], exact[e]
        best[j], back[j] = least + penalty[j], start
    out = [n] if n else []
    if n:
        # the rest may be cut into powers of two, at any place
        i = np.arange(np.searchsorted(places, n - size), len(places) - 1)
        rest = n - places[i]
        ones = np.array([int(r).bit_count() for r in rest])
        total = np.array(best)[i] + ones * FEW + (ones - 1) * other_cut
        j = len(at) - 1
        if total.min() < best[j]:
            k = int(np.argmin(total))
            left, j = int(rest[k]), int(i[k])
            while left & (left - 1):  # the smallest power stands last
                out.append(out[-1] - (left & -left))
                left &= left - 1
            if at[j]:
                out.append(at[j])
        while back[j]:
            j = back[j]
            out.append(at[j])
    return np.array(out[::-1], np.int64)


def packed(docs: DataFrame, path: str, end: int = 1, size: int = SIZE, sentence_cut: int = SENTENCE_CUT, other_cut: int = OTHER_CUT) -> DataFrame:
    """doc_id, start, length, ids, doc_tokens, sequence_id, offset: the pieces of all documents.

    A document is the ids of its text and the id `end`. ids is binary, little-endian unsigned 32-bit; start counts the
    document's ids before the piece, offset those of the sequence before it. Sequences hold documents in the order of
    the rows of a partition, so nothing is shuffled; a sequence_id is the number of the partition and of the sequence in
    it. A null or empty text is the id `end` alone, a null doc_id stays, repeated rows are packed each, an empty table
    gives no rows, other columns are ignored. A text of any length is encoded whole; its ids are laid in blocks of
    BLOCK, with a cut at the end of a block that the document crosses.
    """
    with open(path, encoding="utf-8") as f:
        file = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches):
        encoder, sequence = _loaded(file), TaskContext.get().partitionId() << 33
        held, tokens = [], 0
        for doc in _documents(batches, encoder, end):
            for part in _segments(*doc):
                held.append(part)
                tokens += len(part[2])
                if tokens >= BLOCK:
                    batch, n = _block(held, encoder.ends, size, sentence_cut, other_cut, sequence)
                    yield batch
                    held, tokens, sequence = [], 0, sequence + n
        if held:
            yield _block(held, encoder.ends, size, sentence_cut, other_cut, sequence)[0]
        encoder.forget()

    schema = f"doc_id {dict(docs.dtypes)['doc_id']}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
    return docs.select("doc_id", "text").mapInArrow(freeing(run), schema)


def _documents(batches, encoder: Encoder, end: int) -> Iterator[tuple]:
    for batch in batches:
        keys, texts = batch.column(0), batch.column(1)
        # parts of a batch, by bytes: as many texts become Python's strings as are encoded at once
        at = 0
        for some, _, _ in chunks(pa.array(np.arange(len(keys))), texts, CHARS):
            part = texts.slice(at, len(some))
            yield from ((keys[at + i], np.append(ids, np.array(end, encoder.kind))) for i, ids in enumerate(encoder.encode([t or "" for t in part.to_pylist()])))
            at += len(some)


def _segments(key, ids: np.ndarray) -> Iterator[tuple]:
    """(key, start, ids, number of ids of the whole) in runs of at most BLOCK ids."""
    for i in range(0, len(ids), BLOCK):
        yield key, i, ids[i : i + BLOCK], len(ids)


def _block(held: list[tuple], ends: np.ndarray, size: int, sentence_cut: int, other_cut: int, sequence: int) -> tuple[pa.RecordBatch, int]:
    """The pieces of documents (or segments) laid one after the other, and the number of their sequences."""
    ids = np.concatenate([h[2] for h in held]).astype("<u4")
    lengths = np.array([len(h[2]) for h in held])
    docs = np.cumsum(lengths)
    sentences = np.flatnonzero(ends[ids]) + 1
    close = np.zeros(len(ids) + 2, bool)
    close[docs] = close[docs - 1] = True  # a cut before the last id would leave it alone
    seams = cuts(len(ids), docs, sentences[~close[sentences]], size, sentence_cut, other_cut)
    stops = np.union1d(docs, seams)
    starts = np.concatenate(([0], stops[:-1]))
    doc, window = np.searchsorted(docs, starts, "right"), np.searchsorted(seams, starts, "right")
    begun = np.array([h[1] for h in held]) - (docs - lengths)
    data = memoryview(ids.tobytes())
    return pa.RecordBatch.from_pydict({
        "doc_id": pa.array([held[i][0].as_py() for i in doc.tolist()], held[0][0].type),
        "start": starts + begun[doc],
        "length": stops - starts,
        "ids": pa.array([bytes(data[4 * a : 4 * b]) for a, b in zip(starts.tolist(), stops.tolist(), strict=True)], pa.binary()),
        "doc_tokens": np.array([h[3] for h in held])[doc],
        "sequence_id": window + sequence,
        "offset": starts - np.concatenate(([0], seams))[window],
    }), len(seams)


_kept: dict[int, Encoder] = {}


def _loaded(file) -> Encoder:
    """The encoder of a broadcast file, built once in each worker process."""
    key = hash(file.value)
    if key not in _kept:
        _kept.clear()
        _kept[key] = Encoder(file.value)
    return _kept[key]
