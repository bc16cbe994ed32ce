"""Quality: gated attention over the passages of a document (multiple-instance learning from document labels).

A passage is PASSAGE_WORDS words in a row. It is read as the words in it, hashed into BUCKETS, whose vectors are learnt
and summed by the encoder's first layer, and as figures of its surface (letters, digits and signs, word lengths,
repetition, and how the whole document repeats itself). A gated attention, softmax of w (tanh(V e) * sigmoid(U e)),
weighs the encoded passages of a document; the weighted representation is scored. Everything is learnt from document
labels.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyroom.llm._text import chunks, freeing, prefix_sums, span_hashes, words
from tallyroom.llm.toxicity import held_out, training_rows
from tallyroom.tables import staged

PASSAGE_WORDS, TRAIN_DOCS, BUCKETS, HIDDEN, GATE, THRESHOLD = 64, 5000, 256, 16, 12, 0.3
#: Weight of the words beside the surface.
WORDS_SHARE = 0.25
_CLASSES = ["abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " \t\r", "\n", ".", ",", "!", "?", "|", "#$%&*@^~", "<>/\\={}[]_+", "'\"-:;()"]
_CLASS = np.full(256, len(_CLASSES), np.int64)
for _i, _members in enumerate(_CLASSES):
    _CLASS[list(_members.encode())] = _i
_KINDS = len(_CLASSES) + 1
SURFACE = _KINDS + 9
FEATURES = SURFACE + BUCKETS


@dataclass(frozen=True)
class Passages:
    """Passages as figures of their surface and the buckets of their words; indexing makes their features."""

    surface: np.ndarray
    words: np.ndarray  # buckets, passage after passage
    first: np.ndarray  # number of each passage's first word, and of all words

    @property
    def shape(self) -> tuple[int, int]:
        return len(self.surface), FEATURES

    def __getitem__(self, rows: np.ndarray) -> np.ndarray:
        n = (self.first[1:] - self.first[:-1])[rows]
        place = np.arange(n.sum()) + np.repeat(self.first[:-1][rows] - np.cumsum(n) + n, n)
        own = np.repeat(np.arange(len(rows)), n)
        bags = np.bincount(own * BUCKETS + self.words[place], minlength=len(rows) * BUCKETS).reshape(-1, BUCKETS)
        return np.hstack([self.surface[rows], np.sqrt(bags / np.maximum(n, 1)[:, None])])

    def spread(self, block: int = 4096) -> tuple[np.ndarray, np.ndarray]:
        """Mean and deviation of every feature."""
        total, square, n = np.zeros(FEATURES), np.zeros(FEATURES), len(self.surface)
        for i in range(0, n, block):
            x = self[np.arange(i, min(i + block, n))]
            total += x.sum(axis=0)
            square += (x * x).sum(axis=0)
        mean = total / max(n, 1)
        return mean, np.sqrt(np.maximum(square / max(n, 1) - mean**2, 0))


def read(data: np.ndarray, offsets: np.ndarray) -> tuple[Passages, np.ndarray]:
    """All passages, and for each text the number of its first one. A text without words has one of zeros."""
    starts, ends, first = words(data, offsets)
    n_words = np.diff(first)
    n_of = np.maximum(1, -(-n_words // PASSAGE_WORDS))
    at = np.concatenate([[0], np.cumsum(n_of)])
    n = int(at[-1])
    out = np.zeros((n, SURFACE))
    if not len(starts):
        return Passages(out, np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)), at
    doc = np.repeat(np.arange(len(n_words)), n_words)
    place = np.arange(len(starts)) - first[doc]
    of = at[doc] + place // PASSAGE_WORDS
    count = np.maximum(np.bincount(of, minlength=n), 1)
    head = np.flatnonzero(place % PASSAGE_WORDS == 0)
    # a passage's bytes run from its first word to the next passage's, within its text
    begin = starts[head]
    stop = np.minimum(np.append(begin[1:], len(data)), offsets[1:][doc[head]])
    owner = np.repeat(of[head], stop - begin)
    held = np.concatenate([data[begin[0] :]]) if len(owner) == len(data) - begin[0] else data[np.arange(len(owner)) + np.repeat(begin - np.cumsum(stop - begin) + (stop - begin), stop - begin)]
    kinds = np.bincount(owner * _KINDS + _CLASS[held], minlength=n * _KINDS).reshape(n, _KINDS)
    length = ends - starts
    h = span_hashes(prefix_sums(data), starts, ends)
    order = np.lexsort((h, of))
    fresh = np.ones(len(h), bool)
    fresh[1:] = (h[order][1:] != h[order][:-1]) | (of[order][1:] != of[order][:-1])
    upper = (data[starts] >= 65) & (data[starts] <= 90)
    second = data[np.minimum(starts + 1, len(data) - 1)]
    shout = upper & (length > 1) & (second >= 65) & (second <= 90)
    last = data[ends - 1]
    tail = ~(((last | 32) >= 97) & ((last | 32) <= 122) | (last >= 128) | ((last >= 48) & (last <= 57)))
    repeat = np.zeros(len(h), bool)
    repeat[1:] = (h[1:] == h[:-1]) & (doc[1:] == doc[:-1])
    mean = lambda v: np.bincount(of, v, n) / count
    average = mean(length)
    out[:, :_KINDS] = np.sqrt(kinds / np.maximum(kinds.sum(axis=1), 1)[:, None])
    whole = np.repeat(np.arange(len(n_words)), n_of)
    different = np.bincount(of[order][fresh], minlength=n)
    out[:, _KINDS:] = np.stack([
        np.log1p(average), np.sqrt(mean(np.minimum(length, 99.0) ** 2)) / 10, mean(upper), mean(shout), mean(tail), mean(repeat),
        different / count, np.log1p(n_words[whole]) / 10, np.minimum(kinds.sum(axis=1), 4000) / 1000,
    ], axis=1)
    return Passages(out, (h >> np.uint64(24)).astype(np.uint8), np.cumsum(np.concatenate([[0], np.bincount(of, minlength=n)]))), at


def passages(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Features of all passages, and for each text the number of its first one."""
    held, at = read(data, offsets)
    return held[np.arange(len(held.surface))], at


@dataclass
class Attention:
    """Encoder, gated attention and scorer; all arrays are small and go to the executors with the task."""

    mean: np.ndarray
    scale: np.ndarray
    p: dict[str, np.ndarray]

    def _forward(self, x: np.ndarray, at: np.ndarray):
        p, edge = self.p, at[:-1]
        doc = np.repeat(np.arange(len(edge)), np.diff(at))
        e = np.tanh(((x - self.mean) / self.scale) @ p["W"] + p["b"])
        t, g = np.tanh(e @ p["V"]), 1 / (1 + np.exp(-np.clip(e @ p["U"], -30, 30)))
        s = (t * g) @ p["w"]
        a = np.exp(s - np.maximum.reduceat(s, edge)[doc])
        a /= np.add.reduceat(a, edge)[doc]
        z = np.add.reduceat(a[:, None] * e, edge)
        return doc, e, t, g, a, z, z @ p["c"] + p["d"]

    def scores(self, x: np.ndarray, at: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self._forward(x, at)[-1], -30, 30)))

    def gradient(self, x: np.ndarray, at: np.ndarray, y: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
        p, edge = self.p, at[:-1]
        doc, e, t, g, a, z, logit = self._forward(x, at)
        out = (1 / (1 + np.exp(-np.clip(logit, -30, 30))) - y) * weight / weight.sum()
        dz = out[:, None] * p["c"]
        da = (dz[doc] * e).sum(axis=1)
        ds = a * (da - np.add.reduceat(a * da, edge)[doc])
        dtg = ds[:, None] * p["w"]
        dt, dg = dtg * g * (1 - t**2), dtg * t * g * (1 - g)
        de = a[:, None] * dz[doc] + dt @ p["V"].T + dg @ p["U"].T
        dx = de * (1 - e**2)
        return {"W": ((x - self.mean) / self.scale).T @ dx, "b": dx.sum(axis=0), "V": e.T @ dt, "U": e.T @ dg, "w": (t * g).T @ ds, "c": z.T @ out, "d": out.sum()}


def fitted(x: np.ndarray | Passages, at: np.ndarray, y: np.ndarray, epochs: int = 25, batch: int = 128, rate: float = 0.01, decay: float = 1e-4) -> Attention:
    """Adam over batches of documents in a fixed random order."""
    random = np.random.default_rng(7)
    draw = lambda *n: random.normal(0, 1 / np.sqrt(n[0]), n)
    p = {"W": draw(x.shape[1], HIDDEN), "b": np.zeros(HIDDEN), "V": draw(HIDDEN, GATE), "U": draw(HIDDEN, GATE), "w": draw(GATE), "c": draw(HIDDEN), "d": np.float64(0)}
    mean, deviation = x.spread() if isinstance(x, Passages) else (x.mean(axis=0), x.std(axis=0))
    net = Attention(mean, (deviation + 1e-3) / np.where(np.arange(FEATURES) < SURFACE, 1, WORDS_SHARE), p)
    m, v = ({k: np.zeros_like(a) for k, a in p.items()} for _ in range(2))
    sizes, step = np.diff(at), 0
    for epoch in range(epochs):
        order = random.permutation(len(y))
        for i in range(0, len(order), batch):
            some = order[i : i + batch]
            rows = np.concatenate([np.arange(at[j], at[j + 1]) for j in some])
            grad = net.gradient(x[rows], np.concatenate([[0], np.cumsum(sizes[some])]), y[some], np.ones(len(some)))
            step += 1
            for k, g in grad.items():
                g = g + decay * p[k]
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g * g
                p[k] = p[k] - rate * (1 - epoch / epochs) * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    return net


def trained(docs: DataFrame, labels: DataFrame, most: int = TRAIN_DOCS) -> Attention | float:
    """Fitted on all passages of at most `most` labelled documents; this bound holds for the fit alone. Of a passage its
    surface and a byte for each word come to the driver. Where the sample holds one class only, that class as a constant
    score."""
    sample = staged(training_rows(docs, labels, "quality", 5, 0, most), "quality-sample")

    def rows(batches):
        for batch in batches:
            for y, data, offsets in chunks(batch.column(0), batch.column(1)):
                held, at = read(data, offsets)
                spans = list(zip(at[:-1], at[1:], strict=True))
                columns = {
                    "n": pa.array(np.diff(at), pa.int32()), "surface": pa.array([held.surface[a:b].astype(np.float32).tobytes() for a, b in spans], pa.binary()),
                    "sizes": pa.array([np.diff(held.first[a : b + 1]).astype(np.uint8).tobytes() for a, b in spans], pa.binary()), "words": pa.array([held.words[held.first[a] : held.first[b]].tobytes() for a, b in spans], pa.binary()),
                }
                yield pa.RecordBatch.from_pydict({"y": pa.array(y, pa.int32()), **columns})

    got = sample.select("y", "text").mapInArrow(freeing(rows), "y int, n int, surface binary, sizes binary, words binary").toPandas()
    y = got["y"].to_numpy().astype(float)
    if not len(y) or y.min() == y.max():
        return float(len(y) > 0 and y[0] > 0)
    surface, sizes, words_ = (np.frombuffer(b"".join(got[c]), kind) for c, kind in (("surface", np.float32), ("sizes", np.uint8), ("words", np.uint8)))
    held = Passages(surface.reshape(-1, SURFACE), words_, np.cumsum(np.concatenate([[0], sizes.astype(np.int64)])))
    return fitted(held, np.concatenate([[0], np.cumsum(got["n"])]), np.minimum(y, 1))


def scored(docs: DataFrame, net: Attention | float) -> DataFrame:
    """doc_id, held_out, score and predicted of every row.

    Every passage of the whole text takes part, however long. A null or empty text has one passage of zeros; repeated
    rows are scored alike; a null doc_id is not held out; an empty table gives no rows; other columns are ignored.
    """

    def run(batches):
        for batch in batches:
            scores = [np.zeros(0)]
            for _, data, offsets in chunks(pa.array(np.arange(batch.num_rows)), batch.column(1)):
                scores.append(np.full(len(offsets) - 1, net) if isinstance(net, float) else net.scores(*passages(data, offsets)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(scores))], names=["doc_id", "score"])

    out = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(freeing(run), "doc_id long, score double")
    return out.select("doc_id", held_out(5, 0).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
