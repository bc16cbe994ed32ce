"""Removal of repeated word windows with a log-structured fingerprint index.

Every batch of documents makes sorted, immutable runs of the fingerprints of its windows, dealt into buckets. Within a
bucket the runs of a batch are merged with each other and with the run of history; fingerprints that recur are
candidates. The words of the candidates are compared, so a collision removes nothing. The merge also compacts: one run
for each bucket is left, with the place of each fingerprint that has not recurred; places of the others are in a table of
their own. The next batch reads those two, and of older documents only the words of its hits.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyroom.llm._repeats import Units, buckets_for, contexts, covered, fingerprints, kept_runs, marked, mask, plain, recurring, stored, told_marks
from tallyroom.llm._text import chunks, grams, prefix_sums, span_hashes, words
from tallyroom.tables import staged

WINDOW, GRAM, BATCHES = 13, 5, 2
UNITS = Units(True, WINDOW, GRAM)


def _same(data: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether the `size` bytes at a are those at b."""
    if not len(size):
        return np.zeros(0, bool)
    stop = np.cumsum(size)
    step = np.arange(stop[-1]) - np.repeat(stop - size, size)
    return np.logical_and.reduceat(data[np.repeat(a, size) + step] == data[np.repeat(b, size) + step], stop - size)


def repeats(group: np.ndarray, doc: np.ndarray, at: np.ndarray, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Text and place of every window that also begins in a smaller document; words are compared, not hashes."""
    data = np.frombuffer(b"".join(texts), np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    starts, ends, first = words(data, offsets)
    h = grams(span_hashes(prefix_sums(data), starts, ends), WINDOW)
    n = np.maximum(np.diff(first) - WINDOW + 1, 0)
    which = np.repeat(np.arange(len(texts)), n)
    place = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
    word = first[which] + place
    low, size = starts[word], ends[word + WINDOW - 1] - starts[word]
    order = np.lexsort((doc[which], h[word], group[which]))
    which, place, low, size, key = which[order], place[order], low[order], size[order], h[word][order]
    new = np.ones(len(which), bool)
    new[1:] = (key[1:] != key[:-1]) | (group[which][1:] != group[which][:-1])
    head = np.flatnonzero(new)[np.cumsum(new) - 1] if len(new) else np.zeros(0, np.int64)
    later = np.flatnonzero(doc[which] > doc[which[head]])
    true = size[later] == size[head[later]]
    true[true] = _same(data, low[later[true]], low[head[later[true]]], size[later[true]])
    if true.all():
        return which[later], place[later]
    # different words under one hash: compare by the words themselves
    best: dict[tuple[int, bytes], int] = {}
    held = [(int(group[w]), data[a : a + s].tobytes()) for w, a, s in zip(which, low, size, strict=True)]
    for k, w in zip(held, which, strict=True):
        best[k] = min(best.get(k, int(doc[w])), int(doc[w]))
    later = np.array([i for i, (k, w) in enumerate(zip(held, which, strict=True)) if best[k] < doc[w]], np.int64)
    return which[later], place[later]


class FingerprintIndex:
    """The runs of the documents taken in so far, and the places of what recurs among them. `buckets` is set by the
    first batch and kept."""

    def __init__(self, buckets: int | None = None, runs: DataFrame | None = None, told: DataFrame | None = None):
        self.buckets, self.runs, self.told = buckets, runs, told

    def add(self, docs: DataFrame, old: DataFrame | None = None) -> DataFrame:
        """doc_id, start and stop (words) of what windows of `docs` have seen earlier in a smaller doc_id, in docs or in
        `old`, the documents taken in before (needed when there are any: their words are read where docs hit them).
        Windows of old that a smaller doc_id of docs holds are told as well."""
        if self.runs is not None and old is None:
            raise ValueError("the index holds earlier documents: give them as old, or what repeats only against them is missed")
        docs = plain(docs).where("doc_id IS NOT NULL")
        self.buckets = n = self.buckets or buckets_for(docs)
        found = staged(recurring(fingerprints(docs, UNITS, n), n, self.runs), "recurring")
        marks = told_marks(found)
        fresh, others = marks.where("NOT old"), []
        if old is not None:
            every = marks.where("old").drop("old")
            every = every if self.told is None else every.unionByName(self.told)
            hit = staged(fresh.select("signature").distinct(), "hits")
            others = [(plain(old).where("doc_id IS NOT NULL"), every.join(hit, "signature", "left_semi"))]
        self.told = marks.drop("old") if self.told is None else self.told.unionByName(marks.drop("old"))
        self.runs = kept_runs(found)
        return covered(contexts(docs, fresh, UNITS, *others), UNITS, repeats)


def stripped(docs: DataFrame, found: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and kept of every row, with found as from FingerprintIndex.add.

    A null or empty text has no words (the digest of the empty string); rows without doc_id keep all words; repeated
    rows are one document and give as many equal rows; other columns are ignored; an empty table gives no rows. A text
    of any length is read whole, and what is kept of it is one value.
    """

    def run(batches):
        for batch in batches:
            rows: list[list] = [[], [], [], []]
            begin, end = batch.column(2), batch.column(3)
            for number, data, offsets in chunks(pa.array(np.arange(batch.num_rows)), batch.column(1)):
                starts, ends, first = words(data, offsets)
                raw = data.tobytes()
                for i, row in enumerate(number):
                    some = np.arange(first[i], first[i + 1])
                    gone = mask(len(some), begin[row], end[row])
                    some = some[~gone]
                    kept = b" ".join([raw[a:b] for a, b in zip(starts[some].tolist(), ends[some].tolist(), strict=True)])
                    for column, value in zip(rows, (len(gone), int(gone.sum()), hashlib.sha256(kept).hexdigest(), kept.decode()), strict=True):
                        column.append(value)
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(rows, kinds, strict=True))], names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept"])

    return marked(plain(docs), found, run, "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string")


def deduplicated(docs: DataFrame, batches: int = BATCHES) -> DataFrame:
    """As `stripped`, the table taken in as `batches` batches, one after the other, of about as many documents each, in
    the order of doc_id; each is merged with the runs of those before it."""
    docs = plain(docs)
    known = stored(docs)
    cuts = sorted(set(known.approxQuantile("doc_id", [i / batches for i in range(1, batches)], 0.01)))
    ranges = [F.lit(True), *(F.col("doc_id") >= int(c) for c in cuts)], [*(F.col("doc_id") < int(c) for c in cuts), F.lit(True)]
    index, found = FingerprintIndex(buckets_for(known)), []
    for i, (low, high) in enumerate(zip(*ranges, strict=True)):
        seen = index.add(known.where(low & high), known.where(~low) if i else None)
        found.append(staged(seen.where(low), "intervals"))
    alone = docs.where("doc_id IS NULL")
    return stripped(known, reduce(DataFrame.unionByName, found)).unionByName(stripped(alone, found[0].limit(0)))
