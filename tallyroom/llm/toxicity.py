"""Toxicity: a support vector machine on a gapped subsequence string kernel with Nystroem landmarks.

A word is the bag of its ordered letter triples, each weighed by DECAY for every letter that it skips, so that an
insult with inserted or missing characters stays close to the plain one. Signs between letters are skipped at no cost;
digits and signs that stand for letters are read as them; single characters one after the other are read as one word.
Letters of other scripts are told apart by a hash of their bytes. Words that tell the classes of the training texts
apart best, and are not alike, are the landmarks. A text is the largest normalised kernel of any of its words with each
landmark; the inverse root of the landmarks' kernel matrix turns these into Nystroem features for a linear machine,
whose margin a sigmoid makes a probability.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyroom.llm._text import chunks, freeing, prefix_sums, quoted, span_hashes, words
from tallyroom.tables import staged

LANDMARKS, TRAIN_DOCS, DECAY, FLOOR, THRESHOLD = 40, 6000, 0.5, 0.35, 0.3
#: Words that landmarks are chosen from, for each of them, and the kernel of two landmarks at most.
CANDIDATES, ALIKE = 20, 0.5
#: Texts of a landmark that tells its class, the share of class 1 among them, and kernels that it may be learnt at.
TELLING_ROWS, TELLING, LEVELS = 5, 0.8, (0.95, 0.8, 0.65, 0.5)
_SKIPS = [(a, b) for a in (1, 2, 3) for b in (1, 2, 3) if a + b <= 4]
_LETTERS = 64
#: 1-26: letters in either case and what stands for them; 0: skipped. Other letters have the codes from 27.
_CODE = np.zeros(256, np.int32)
for _c in range(26):
    _CODE[[65 + _c, 97 + _c]] = _c + 1
for _sign, _letter in zip("013457$@", "oieastsa", strict=True):
    _CODE[ord(_sign)] = ord(_letter) - 96


def codes_of(data: np.ndarray) -> np.ndarray:
    """The code of the letter that begins at each byte, 0 where none does."""
    out = _CODE[data]
    at = np.flatnonzero(data >= 0xC0)
    if len(at):
        h = data[at].astype(np.int64) * 131
        for i, by in ((1, 31), (2, 7), (3, 3)):
            more = data[np.minimum(at + i, len(data) - 1)]
            h += np.where((more >= 0x80) & (more < 0xC0) & (data[at] >= (0, 0xC0, 0xE0, 0xF0)[i]), more.astype(np.int64) * by, 0)
        out[at] = 27 + h % (_LETTERS - 27)
    return out


def _triples(codes: np.ndarray, owner: np.ndarray):
    """For each way to skip: owners, features and the weight of all triples that lie in one word."""
    for a, b in _SKIPS:
        n = len(codes) - a - b
        if n <= 0:
            continue
        x, y, z = codes[:n], codes[a : a + n], codes[a + b :]
        own = owner[:n]
        at = np.flatnonzero((own == owner[a + b :]) & (x > 0) & (y > 0) & (z > 0))
        yield own[at], (x[at] * _LETTERS + y[at]) * _LETTERS + z[at], DECAY ** (a + b - 2)


@dataclass(frozen=True)
class Kernel:
    """The landmarks as one table from triple to its weight in each of them."""

    weights: np.ndarray  # triples that any landmark has x landmarks; the first row is zero
    row: np.ndarray  # place of each triple in it

    @classmethod
    def of(cls, landmarks: list[str]) -> Kernel:
        found: list[tuple[np.ndarray, np.ndarray, float]] = []
        for i, word in enumerate(landmarks):
            codes = codes_of(np.frombuffer(word.encode(), np.uint8))
            codes = codes[codes > 0]
            found += [(np.full(len(triple), i), triple, weight) for _, triple, weight in _triples(codes, np.zeros(len(codes), np.int32))]
        used = np.unique(np.concatenate([np.zeros(0, np.int32), *(triple for _, triple, _ in found)]))
        row = np.zeros(_LETTERS**3, np.int32)
        row[used] = np.arange(1, len(used) + 1)
        table = np.zeros((len(used) + 1, len(landmarks)), np.float32)
        for i, triple, weight in found:
            np.add.at(table, (row[triple], i), weight)
        table /= np.maximum(np.linalg.norm(table, axis=0), 1e-9)
        return cls(table, row)

    def of_words(self, codes: np.ndarray, owner: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the words that come near any landmark and their normalised kernels with all of them.

        By Cauchy and Schwarz a kernel is at most the share of the word's weight that lies on triples of landmarks;
        words whose share is under FLOOR are left out, as their kernels would be taken for 0.
        """
        whole, on, hits = np.zeros(n), np.zeros(n), []
        for own, triple, weight in _triples(codes, owner):
            whole += np.bincount(own, minlength=n) * weight**2
            row = self.row[triple]
            at = np.flatnonzero(row)
            on += np.bincount(own[at], minlength=n) * weight**2
            hits.append((own[at], row[at], weight))
        near = np.flatnonzero(on > FLOOR**2 * np.maximum(whole, 1e-9))
        place = np.full(n, -1)
        place[near] = np.arange(len(near))
        # a triple is in few of the landmarks: only those entries of its row are summed
        line, column = np.nonzero(self.weights)
        held = np.bincount(line, minlength=len(self.weights))
        begin = np.cumsum(held) - held
        flat, value = [np.zeros(0, np.int64)], [np.zeros(0)]
        for own, row, weight in hits:
            at = np.flatnonzero(place[own] >= 0)
            n = held[row[at]]
            entry = np.repeat(begin[row[at]] - (np.cumsum(n) - n), n)
            entry += np.arange(len(entry))
            flat.append(np.repeat(place[own[at]], n) * self.weights.shape[1] + column[entry])
            value.append(self.weights[line[entry], column[entry]] * weight)
        out = np.bincount(np.concatenate(flat), np.concatenate(value), len(near) * self.weights.shape[1]).reshape(len(near), self.weights.shape[1]).astype(np.float32)
        out /= np.sqrt(np.maximum(whole[near], 1e-9))[:, None].astype(np.float32)
        out[out < FLOOR] = 0
        return near, np.minimum(out, 1)

    def of_texts(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """For each text its largest kernel with every landmark."""
        out = np.zeros((len(offsets) - 1, self.weights.shape[1]), np.float32)
        starts, ends, first = words(data, offsets)
        if not len(starts):
            return out
        doc = np.repeat(np.arange(len(out)), np.diff(first))
        joined = np.zeros(len(starts), bool)
        joined[1:] = (ends - starts == 1)[1:] & (ends - starts == 1)[:-1] & (doc[1:] == doc[:-1])
        begin = np.flatnonzero(~joined)
        starts, ends, doc = starts[begin], np.append(ends[begin[1:] - 1], ends[-1]), doc[begin]
        # each different word of the chunk once
        _, one, which = np.unique(span_hashes(prefix_sums(data), starts, ends), return_index=True, return_inverse=True)
        length = ends[one] - starts[one]
        stop = np.cumsum(length)
        at = np.arange(stop[-1]) + np.repeat(starts[one] - stop + length, length)
        codes, owner = codes_of(data)[at], np.repeat(np.arange(len(one), dtype=np.int32), length)
        letter = codes > 0
        near, kernels = self.of_words(codes[letter], owner[letter], len(one))
        place = np.full(len(one), -1)
        place[near] = np.arange(len(near))
        found = place[which]
        hit = np.flatnonzero(found >= 0)
        if len(hit):
            edge = np.flatnonzero(np.diff(doc[hit], prepend=-1))
            out[doc[hit[edge]]] = np.maximum.reduceat(kernels[found[hit]], edge)
        return out


@dataclass(frozen=True)
class Machine:
    kernel: Kernel
    root: np.ndarray  # landmarks x Nystroem features
    weights: np.ndarray
    bias: float
    slope: float
    shift: float

    def scores(self, kernels: np.ndarray) -> np.ndarray:
        margin = kernels @ (self.root @ self.weights) + self.bias
        return 1 / (1 + np.exp(-np.clip(self.slope * margin + self.shift, -30, 30)))


def _linear_svm(x: np.ndarray, y: np.ndarray, cost: float = 10.0, rounds: int = 60) -> tuple[np.ndarray, float]:
    """Squared-hinge machine by Newton steps; the classes weigh alike. y: -1 and 1."""
    x = np.hstack([x, np.ones((len(x), 1))])
    share = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())) * cost * len(y) / 100
    ridge = np.diag([*np.ones(x.shape[1] - 1), 1e-3])
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        on = y * (x @ w) < 1
        a = x[on] * share[on, None]
        new = np.linalg.solve(ridge + a.T @ x[on], a.T @ y[on])
        if np.allclose(new, w, atol=1e-9):
            break
        w = new
    return w[:-1], float(w[-1])


def _sigmoid(margin: np.ndarray, y: np.ndarray, rounds: int = 50) -> tuple[float, float]:
    """Platt's slope and shift, with his smoothed targets, by Newton steps."""
    up, down = (y > 0).sum(), (y < 0).sum()
    target = np.where(y > 0, (up + 1) / (up + 2), 1 / (down + 2))
    x, w = np.stack([margin, np.ones_like(margin)], axis=1), np.array([1.0, 0.0])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w = w + np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + 1e-6 * np.eye(2), x.T @ (target - p))
    return float(w[0]), float(w[1])


def unlike(candidates: list[str], most: int) -> list[str]:
    """The first `most` of the candidates whose kernel with each one taken before is less than ALIKE."""
    raw = [w.encode() for w in candidates]
    kernels = Kernel.of(candidates).of_texts(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
    out: list[int] = []
    for i in range(len(candidates)):
        if len(out) < most and not (kernels[i, out] >= ALIKE).any():
            out.append(i)
    return [candidates[i] for i in out]


def thinned(x: np.ndarray, y: np.ndarray, among: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """More rows of class 1: texts as they would be with one of their telling words alone, plain and disguised.

    Insults come in company, so each alone would get little of the weight that they share. A landmark tells its class
    where, of at least TELLING_ROWS texts that hold it, the share TELLING is of class 1; disguised it is as weak as the
    lowest of LEVELS at which that still holds. What a text holds besides stays.
    """
    rows = []
    for j in range(x.shape[1]):
        weakest = None
        for level in LEVELS:
            near = x[:, j] >= level
            if near.sum() < TELLING_ROWS or (y[near] > 0).mean() < TELLING:
                break
            weakest = level
        if weakest is not None:
            own = x[(x[:, j] >= LEVELS[0]) & (y > 0)]
            rest = np.where(own >= ALIKE, 0, own)
            rows += [np.maximum(rest, among[j] * strength) for strength in {1.0, weakest}]
    more = np.concatenate(rows) if rows else np.zeros((0, x.shape[1]))
    return np.concatenate([x, more]), np.concatenate([y, np.ones(len(more))])


def fitted(kernel: Kernel, landmarks: list[str], x: np.ndarray, y: np.ndarray) -> Machine:
    among = np.zeros((len(landmarks), len(landmarks)))
    for i, word in enumerate(landmarks):
        raw = np.frombuffer(word.encode(), np.uint8)
        among[i] = kernel.of_texts(raw, np.array([0, len(raw)]))[0]
    values, vectors = np.linalg.eigh((among + among.T) / 2)
    root = vectors / np.sqrt(np.maximum(values, 1e-3))
    more, classes = thinned(x, y, among)
    weights, bias = _linear_svm(more @ root, classes)
    slope, shift = _sigmoid(x @ root @ weights + bias, y)
    return Machine(kernel, root, weights, bias, slope, shift)


def held_out(modulus: int, rest: int, ident: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(ident).cast("string")) % modulus == rest, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, label: str, modulus: int, rest: int, most: int) -> DataFrame:
    """text and y (0 or 1) of at most `most` labelled rows that are not held out: those whose hashed ids are smallest.

    A document with several labels has the largest; labels without a document, and null labels, don't count.
    """
    own = labels.where(~held_out(modulus, rest) & F.col(label).isNotNull() & F.col("doc_id").isNotNull())
    own = own.groupBy("doc_id").agg(F.max(label).cast("int").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(own), "doc_id").select("text", "y")


def trained(docs: DataFrame, labels: DataFrame, most: int = TRAIN_DOCS, landmarks: int = LANDMARKS) -> Machine | float:
    """A machine, or where the sample holds only one class that class as a constant score.

    The only things that come to the driver are the candidates for landmarks and `most` rows of kernels.
    """
    sample = staged(training_rows(docs, labels, "toxic", 4, 2, most), "toxicity-sample")
    # each different text once, lest the words of a copied text look telling
    texts = sample.groupBy("text").agg(F.max("y").alias("y"))
    found = texts.agg(F.sum(F.col("y").cast("long")).alias("up"), F.count("*").alias("n")).first()
    if not found.up or found.up == found.n:
        return float(bool(found.up))
    split = F.array_distinct(F.split(F.lower("text"), r"[^\p{L}]+"))
    seen = texts.select(F.explode(split).alias("word"), "y").where("length(word) BETWEEN 3 AND 24").groupBy("word").agg(F.sum("y").alias("a"), F.count("*").alias("n"))
    a, n, up, every = F.col("a"), F.col("n"), F.lit(float(found.up)), F.lit(float(found.n))
    lift = (a * every - n * up) * F.abs(a * every - n * up) / (n * up * (every - n + 1) * (every - up + 1))  # chi square with its sign
    chosen = unlike([r.word for r in seen.orderBy(F.desc(lift), "word").limit(CANDIDATES * landmarks).collect()], landmarks)
    kernel = Kernel.of(chosen)

    def rows(batches):
        for batch in batches:
            for y, data, offsets in chunks(batch.column(0), batch.column(1)):
                x = kernel.of_texts(data, offsets).astype(float)
                yield pa.RecordBatch.from_pydict({"y": pa.array(y, pa.int32()), "x": pa.array(list(x), pa.list_(pa.float64()))})

    got = sample.select("y", "text").mapInArrow(freeing(rows), "y int, x array<double>").toPandas()
    return fitted(kernel, chosen, np.stack(got["x"]), np.where(got["y"] > 0, 1.0, -1.0))


def free_name(name: str, taken: list[str]) -> str:
    while name in taken:
        name += "_"
    return name


def scored(docs: DataFrame, machine: Machine | float, keep: list[str] | None = None) -> DataFrame:
    """doc_id, held_out, score and predicted of every row, or with `keep` those columns and the score (named
    score, or by a free name where there is such a column).

    A null or empty text is scored as one without words; repeated rows are scored alike; a null doc_id is not held out;
    an empty table gives no rows. A text of any length is read whole, by itself where it is longer than a chunk.
    """
    out = docs.select(*map(quoted, keep or ["doc_id"]), *([] if keep and "text" in keep else ["text"]))
    texts = out.columns.index("text")
    kept = [i for i, c in enumerate(out.columns) if keep or c == "doc_id"]
    name = free_name("score", out.columns)
    names = [out.columns[i] for i in kept]
    # by number inside, as mapInArrow takes no names with dots
    out = out.toDF(*[f"c{i}" for i in range(len(out.columns))])
    schema = ", ".join([*(f"c{i} {out.schema[i].dataType.simpleString()}" for i in kept), "score double"])

    def run(batches):
        for batch in batches:
            scores = [np.zeros(0)]
            for _, data, offsets in chunks(pa.array(np.arange(batch.num_rows)), batch.column(texts)):
                scores.append(np.full(len(offsets) - 1, machine) if isinstance(machine, float) else machine.scores(machine.kernel.of_texts(data, offsets)))
            yield pa.RecordBatch.from_arrays([*map(batch.column, kept), pa.array(np.concatenate(scores))], names=[*(f"c{i}" for i in kept), "score"])

    out = out.mapInArrow(freeing(run), schema).toDF(*names, name)
    return out if keep else out.select("doc_id", held_out(4, 2).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def clean(docs: DataFrame, machine: Machine | float) -> DataFrame:
    """The rows of docs, with all columns, that are not predicted toxic. Null and empty texts are scored as texts without
    words; repeated rows go or stay together; an empty table stays empty; other columns may have any name."""
    score = free_name("score", docs.columns)
    return scored(docs, machine, docs.columns).where(F.col(score) < THRESHOLD).select(*map(quoted, docs.columns))
