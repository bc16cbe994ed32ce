"""Removal of repeated byte strings by deep-shallow suffix sorting.

The suffixes that can matter are the windows of WINDOW bytes whose signature recurs (see _repeats). All suffixes of a
signature meet in one task. Shallow: multikey quicksort with 8-byte characters; at each depth all open groups are
split at once by their next character, and suffixes alone in their group are done. Deep: what still agrees at SHALLOW
bytes is ordered by a blind trie, which compares only branching bytes on the way down and one whole string at its
end; groups that agree with their first member throughout are one leaf. A leaf holds equal windows, of which all but
the earliest are repeats.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyroom.llm._repeats import Units, marked, mask, plain, repeated, stored
from tallyroom.llm._text import chunks, freeing
from tallyroom.tables import staged

WINDOW, GRAM, SHALLOW = 100, 32, 32
UNITS = Units(False, WINDOW, GRAM)


def blind_trie(strings: list[bytes]) -> list[list[int]]:
    """Numbers of equal strings, by string in ascending order. All strings are of one length."""
    # inner node: [depth, {byte: child}]; leaf: list of numbers under a tuple
    root = None
    for i, s in enumerate(strings):
        if root is None:
            root = (i,), [i]
            continue
        node = root
        while isinstance(node[0], int):
            node = node[1].get(s[node[0]]) or next(iter(node[1].values()))
        other = strings[node[0][0]]
        if other == s:
            node[1].append(i)
            continue
        depth = next(d for d, (x, y) in enumerate(zip(s, other, strict=True)) if x != y)
        up, node = None, root
        while isinstance(node[0], int) and node[0] < depth:
            up, node = node, node[1][s[node[0]]]
        if isinstance(node[0], int) and node[0] == depth:
            node[1][s[depth]] = (i,), [i]
            continue
        inner = [depth, {other[depth]: node, s[depth]: ((i,), [i])}]
        if up is None:
            root = inner
        else:
            up[1][s[up[0]]] = inner
    out, stack = [], [root] if root else []
    while stack:
        node = stack.pop()
        if isinstance(node[0], int):
            stack += [node[1][b] for b in sorted(node[1], reverse=True)]
        else:
            out.append(node[1])
    return out


def equal_windows(data: np.ndarray, at: np.ndarray, group: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Of the windows that begin at `at`, those that equal another one of their group, and the number of their class."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)]).astype(np.uint64)
    char = np.zeros(len(data), np.uint64)
    for i in range(8):
        char = (char << np.uint64(8)) | padded[i : i + len(data)]
    open_, group = np.arange(len(at)), group.astype(np.int64)
    for depth in range(0, SHALLOW, 8):
        c = char[at[open_] + depth]
        order = np.lexsort((c, group))
        open_, group, c = open_[order], group[order], c[order]
        new = np.ones(len(open_), bool)
        new[1:] = (group[1:] != group[:-1]) | (c[1:] != c[:-1])
        alone = new & np.append(new[1:], True)
        group = np.cumsum(new)
        open_, group = open_[~alone], group[~alone]
        if not len(open_):
            return open_, group
    begin = np.flatnonzero(np.diff(group, prepend=-1))
    size = np.diff(np.append(begin, len(group)))
    first = np.repeat(at[open_[begin]], size)
    same = np.ones(len(open_), bool)
    for depth in [*range(SHALLOW, window - 8, 8), window - 8]:
        same &= char[at[open_] + depth] == char[first + depth]
    whole = np.logical_and.reduceat(same, begin)
    keep = np.repeat(whole, size)
    windows, classes = [open_[keep]], [group[keep]]
    number, raw = int(group[-1]) + 1, data.tobytes()
    for b, n in zip(begin[~whole].tolist(), size[~whole].tolist(), strict=True):
        some = open_[b : b + n]
        for leaf in blind_trie([raw[a : a + window] for a in at[some].tolist()]):
            if len(leaf) > 1:
                windows.append(some[leaf])
                classes.append(np.full(len(leaf), number))
                number += 1
    return np.concatenate(windows), np.concatenate(classes)


def repeats(group: np.ndarray, doc: np.ndarray, at: np.ndarray, texts: list[bytes], window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Text and place of every window that begins earlier, too: in a smaller document, or before in the same."""
    seen: dict[tuple[int, bytes], int] = {}
    first = np.array([seen.setdefault((g, t), i) for i, (g, t) in enumerate(zip(group.tolist(), texts, strict=True))])
    count = np.array([len(t) - window + 1 for t in texts])
    own = np.flatnonzero(first == np.arange(len(texts)))
    # a text that came before in its group repeats whole; a repeated row is no other place
    later = np.flatnonzero((first != np.arange(len(texts))) & ((doc != doc[first]) | (at != at[first])))
    data = np.frombuffer(b"".join(texts[i] for i in own), np.uint8)
    n = count[own]
    base = np.cumsum(n + window - 1) - (n + window - 1)
    place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    which = np.repeat(own, n)
    windows, classes = equal_windows(data, np.repeat(base, n) + place, np.repeat(group[own], n), window)
    out = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    if len(windows):
        w, p = which[windows], place[windows]
        order = np.lexsort((at[w] + p, doc[w], classes))
        w, p, classes = w[order], p[order], classes[order]
        new = np.diff(classes, prepend=-1) != 0
        head = np.flatnonzero(new)[np.cumsum(new) - 1]
        repeat = (doc[w] != doc[w[head]]) | (at[w] + p != (at[w] + p)[head])
        out[0].append(w[repeat])
        out[1].append(p[repeat])
    out[0].append(np.repeat(later, count[later]))
    out[1].append(np.concatenate([np.zeros(0, np.int64), *(np.arange(c) for c in count[later])]))
    return np.concatenate(out[0]), np.concatenate(out[1])


def stripped(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and kept (binary) of every row.

    A null or empty text has no bytes (the digest of nothing); rows without doc_id repeat nothing and nothing repeats
    them; repeated rows are one document and give as many equal rows; other columns are ignored; an empty table gives no
    rows. A text of any length is read whole, and what is kept of it is one value.
    """
    docs = plain(docs)
    known = stored(docs)
    found = staged(repeated(known, UNITS, repeats), "intervals")
    alone = docs.where("doc_id IS NULL")

    def run(batches):
        for batch in batches:
            rows: list[list] = [[], [], [], [], []]
            starts, stops = batch.column(2), batch.column(3)
            for number, data, offsets in chunks(pa.array(np.arange(batch.num_rows)), batch.column(1)):
                for i, row in enumerate(number):
                    own = data[offsets[i] : offsets[i + 1]]
                    gone = mask(len(own), starts[row], stops[row])
                    kept = own[~gone].tobytes()
                    for column, value in zip(rows, (len(own), int(gone.sum()), int((np.diff(gone.astype(np.int8), prepend=0) == 1).sum()), hashlib.sha256(kept).hexdigest(), kept), strict=True):
                        column.append(value)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(rows, kinds, strict=True))], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"
    none = F.lit(None).cast("array<bigint>")
    alone = alone.select("doc_id", "text", none.alias("starts"), none.alias("stops")).mapInArrow(freeing(run), schema)
    return marked(known, found, run, schema).unionByName(alone)
