"""Finding what repeats across all documents without moving every position.

Shared by the two exact deduplicators, which differ in unit (byte or word) and in what they do with the candidates.

Of the hashes of all k-unit strings in a window, the smallest is the window's signature; equal windows have equal
signatures, and consecutive windows mostly share one, so a text of n units makes about 2 n / (window - k + 2) runs of
windows. `fingerprints` turns each batch of documents into sorted runs of signatures, one for each bucket, in which a
signature that recurs in the batch stands once; `recurring` merges the runs of a bucket and tells which signatures
recur anywhere. So a signature of a third of all documents is at most one entry for each batch.

`contexts` cuts the text of the runs that recur, each different text once for each batch, keyed by signature, for the
caller to compare. The words around a shared passage differ from text to text, so runs at its edges may be many under
one signature. Those of a signature with more than HOT are cut again into shorter runs by signatures of longer strings,
at last into single windows under their own hash. `covered` brings the caller's findings back to documents; equal single
windows of more than HOT batches don't meet there but are resolved by their smallest place.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace
from functools import reduce

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyroom.llm._text import chunks, freeing, grams, prefix_sums, rolling, span_hashes, words
from tallyroom.tables import new_path, staged

#: Documents whose signatures share a bucket, on average.
BUCKET_DOCS = 4096
#: Runs of one signature that may meet in one task.
HOT = 1024
#: Buckets that a stored table may have (Spark's own bound).
MOST_BUCKETS = 100_000
_U = np.uint64
_PLACE = _U((1 << 36) - 1)
_SHORT = 40


@dataclass(frozen=True)
class Units:
    """What windows are made of: `window` units a window, signatures from `gram` units."""

    by_word: bool
    window: int
    gram: int

    @property
    def finer(self) -> tuple[int, int]:
        """Grams for signatures under which too many runs meet; the last is a whole window."""
        return self.gram + 3 * (self.window - self.gram) // 4, self.window

    def hashes(self, data: np.ndarray, offsets: np.ndarray):
        """Hashes of all grams, the number of the first unit of each text, and starts and ends of units (by word)."""
        if not self.by_word:
            return rolling(prefix_sums(data), self.gram), offsets, None, None
        starts, ends, first = words(data, offsets)
        return grams(span_hashes(prefix_sums(data), starts, ends), self.gram), first, starts, ends

    def signatures(self, h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Runs of windows with one signature: signature, text, first window (from the text's start), length, and
        whether it has its signature from several places, so that windows in it may be equal.

        The smallest hash is told by its upper bits, of equal ones the leftmost. No run is longer than the grams in a
        window, so neither is what has to be cut from the text.
        """
        span = self.window - self.gram + 1
        n = len(h) - span + 1
        none = np.zeros(0, np.int64)
        if n <= 0:
            return none.astype(_U), none, none, none, none.astype(bool)
        low, width = (h & ~_PLACE) | np.arange(len(h), dtype=_U), 1
        while width * 2 <= span:
            low = np.minimum(low[:-width], low[width:])
            width *= 2
        if width < span:
            low = np.minimum(low[:n], low[span - width : span - width + n])
        count = np.maximum(np.diff(first) - self.window + 1, 0)
        text = np.repeat(np.arange(len(count)), count)
        at = np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)
        place = low[first[text] + at] & _PLACE
        edge = np.ones(len(text), bool)
        edge[1:] = (place[1:] != place[:-1]) | (at[1:] == 0)
        begin = np.flatnonzero(edge)
        signature = h[place[begin].astype(np.int64)]
        fresh = np.ones(len(begin), bool)
        fresh[1:] = (signature[1:] != signature[:-1]) | (at[begin[1:]] == 0)
        own = np.flatnonzero(fresh)
        several = np.diff(np.append(own, len(begin))) > 1
        signature, begin = signature[own], begin[own]
        long = np.diff(np.append(begin, len(text)))
        parts = -(-long // span)
        which = np.repeat(np.arange(len(begin)), parts)
        step = (np.arange(len(which)) - np.repeat(np.cumsum(parts) - parts, parts)) * span
        begin = begin[which] + step
        return signature[which], text[begin], at[begin], np.minimum(long[which] - step, span), several[which]


def packed(values: np.ndarray) -> bytes:
    """Numbers as planes of bytes, compressed."""
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(values.view(np.uint8).reshape(-1, values.itemsize).T).tobytes())


def unpacked(blob: bytes, kind: type) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8)
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(raw.reshape(size, -1).T).view(kind).ravel()


def delta(values: np.ndarray) -> bytes:
    """A sorted run as its differences."""
    return packed(np.diff(values, prepend=_U(0)))


def undelta(blob: bytes) -> np.ndarray:
    return np.cumsum(unpacked(blob, _U), dtype=_U)


_PARTS = (("signature", _U, undelta), ("doc", np.int64, None), ("at", np.int32, None), ("length", np.int32, None))
_RUN = "bucket long, signature binary, doc binary, at binary, length binary"


def _run_row(signature: np.ndarray, doc: np.ndarray, at: np.ndarray, length: np.ndarray) -> list[bytes]:
    return [delta(signature), packed(doc), packed(at.astype(np.int32)), packed(length.astype(np.int32))]


def _runs_of(table: pa.Table) -> list[np.ndarray]:
    return [np.concatenate([np.zeros(0, kind), *(own(b.as_py()) if own else unpacked(b.as_py(), kind) for b in table.column(c))]) for c, kind, own in _PARTS]


def fingerprints(docs: DataFrame, units: Units, buckets: int) -> DataFrame:
    """The sorted runs of every batch of docs (doc_id, text), by bucket.

    Signatures that recur within the batch, or in one run of bytes, are told apart at once: those runs go to a bucket
    from `buckets` on, dealt by document, where nothing has to be looked up. A signature is its bucket and 40 more bits,
    so that however many buckets there are, one in millions is equal to another of its bucket by chance; texts are
    compared later.
    """

    def run(batches):
        for batch in batches:
            found: list[list[np.ndarray]] = [[], [], [], [], []]
            for ids, data, offsets in chunks(batch.column(0), batch.column(1)):
                h, first, _, _ = units.hashes(data, offsets)
                signature, text, at, length, several = units.signatures(h, first)
                for column, values in zip(found, (signature, ids[text], at, length, several), strict=True):
                    column.append(values)
            if not found[0]:
                continue
            signature, doc, at, length, several = map(np.concatenate, found)
            if not len(signature):
                continue
            bucket = signature % _U(buckets)
            signature = bucket << _U(_SHORT) | (signature // _U(buckets)) & _U((1 << _SHORT) - 1)
            order = np.argsort(signature, kind="stable")
            signature, doc, at, length, bucket = signature[order], doc[order], at[order], length[order], bucket[order].astype(np.int64)
            fresh = np.ones(len(order), bool)
            fresh[1:] = signature[1:] != signature[:-1]
            recurs = ~fresh
            recurs[:-1] |= ~fresh[1:]
            if not units.by_word:
                recurs |= several[order]
            apart = buckets + (doc.view(_U) * _U(0x9E3779B97F4A7C15) >> _U(20)).astype(np.int64) % buckets
            # recurring ones in full, and one row of no length that shows the others that they are here
            parts = [(np.where(recurs, apart, bucket), length), (np.where(recurs & fresh, bucket, -1), np.zeros(len(order), np.int64))]
            for where, long in parts:
                held = np.flatnonzero(where >= 0)
                held = held[np.argsort(where[held], kind="stable")]
                cuts = np.flatnonzero(np.diff(where[held])) + 1
                for some in np.split(held, cuts) if len(held) else []:
                    row = _run_row(signature[some], doc[some], at[some], long[some])
                    yield pa.RecordBatch.from_arrays([pa.array([int(where[some[0]])]), *(pa.array([c], pa.binary()) for c in row)], names=["bucket", "signature", "doc", "at", "length"])

    return docs.mapInArrow(freeing(run), _RUN)


_FOUND = "doc_id long, at long, length int, signature long, old boolean, bucket long, run binary, run_doc binary, run_at binary, run_length binary"


def recurring(runs: DataFrame, buckets: int, history: DataFrame | None = None, keep: bool = True) -> DataFrame:
    """doc_id, at, length, signature and old (from history) of all runs of windows whose signature recurs, and with
    `keep` one row for each bucket with its merged run (run, run_doc, run_at, run_length).

    history: such merged runs of earlier batches. An entry of it is told when its signature first recurs; from then on
    it has no length in the run. So whoever keeps all that was told knows every place of a signature that recurs.
    """

    def merged(new: pa.Table, old: pa.Table | None = None) -> pa.Table:
        parts = [*_runs_of(new), np.zeros(0, bool)]
        parts[4] = np.zeros(len(parts[0]), bool)
        bucket = (new if new.num_rows else old).column("bucket")[0].as_py() if new.num_rows or old is not None and old.num_rows else 0
        run = []
        if bucket < buckets:
            if old is not None:
                held = _runs_of(old)
                parts = [np.concatenate(x) for x in zip(parts, [*held, np.ones(len(held[0]), bool)], strict=True)]
            order = np.argsort(parts[0], kind="stable")
            signature, doc, at, length, known = (x[order] for x in parts)
            again = np.zeros(len(signature), bool)
            again[1:] = signature[1:] == signature[:-1]
            first = ~again
            again[:-1] |= again[1:]
            if keep and len(signature):
                run = [_run_row(signature[first], doc[first], at[first], np.where(again, 0, length)[first])]
            held = np.flatnonzero(again & (length > 0))
            parts = [x[held] for x in (signature, doc, at, length, known)]
        signature, doc, at, length, known = parts
        n, more = len(doc), len(run)
        full = lambda values, kind: pa.array([*values.tolist(), *[None] * more], kind)
        columns = {"doc_id": full(doc, pa.int64()), "at": full(at, pa.int64()), "length": full(length, pa.int32()), "signature": full(signature.view(np.int64), pa.int64()), "old": full(known, pa.bool_()), "bucket": pa.array([bucket] * (n + more), pa.int64())}
        return pa.table(columns | {c: pa.array([*[None] * n, *(r[i] for r in run)], pa.binary()) for i, c in enumerate(("run", "run_doc", "run_at", "run_length"))})

    if history is None:
        return runs.groupBy("bucket").applyInArrow(lambda t: merged(t), _FOUND)
    return runs.groupBy("bucket").cogroup(history.groupBy("bucket")).applyInArrow(merged, _FOUND)


def kept_runs(found: DataFrame) -> DataFrame:
    """The merged runs among the rows of `recurring`, as it takes them for history."""
    return found.where("run IS NOT NULL").select("bucket", F.col("run").alias("signature"), F.col("run_doc").alias("doc"), F.col("run_at").alias("at"), F.col("run_length").alias("length"))


def told_marks(found: DataFrame) -> DataFrame:
    return found.where("run IS NULL").select("doc_id", "at", "length", "signature", "old")


def buckets_for(docs: DataFrame) -> int:
    return max(8, -(-docs.count() // BUCKET_DOCS))


def hot_signatures(rows: DataFrame) -> DataFrame:
    """Signatures of more than HOT rows; staged, so that Spark knows its size when it joins with it."""
    return staged(rows.where("signature IS NOT NULL").groupBy("signature").count().where(F.col("count") > HOT).select("signature"), "hot")


_CUT = "signature long, doc_id long, at long, length int, text binary, more array<long>"


def _once(rows: list[list], by_word: bool) -> pa.RecordBatch:
    """Rows (signature, doc_id, at, length, text, more), each text of a signature once, at its earliest place. The others
    repeat it whole: without signature and text, those that go on from one another as one. By word, what stands again in
    the same document is no repeat: its places are in `more`."""
    order = sorted(range(len(rows[0])), key=lambda j: (rows[1][j], rows[2][j]))
    seen: dict[tuple[int, bytes], int] = {}
    out: list[list] = [[], [], [], [], [], []]
    for j in order:
        s, doc, at, n, text, more = (column[j] for column in rows)
        k = seen.setdefault((s, text), len(out[0]))
        if k < len(out[0]):
            if by_word and doc == out[1][k]:
                out[5][k] = [*(out[5][k] or []), at, *(more or [])]
                continue
            if by_word or doc != out[1][k] or at != out[2][k]:
                for x in (at, *(more or [])):
                    if out[0] and out[4][-1] is None and out[1][-1] == doc and out[2][-1] <= x <= out[2][-1] + out[3][-1]:
                        out[3][-1] = max(out[3][-1], x + n - out[2][-1])
                    else:
                        for column, value in zip(out, (None, doc, x, n, None, None), strict=True):
                            column.append(value)
                continue
        for column, value in zip(out, (s, doc, at, n, text, more), strict=True):
            column.append(value)
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.list_(pa.int64()))
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds, strict=True)], names=["signature", "doc_id", "at", "length", "text", "more"])


def _cut(docs: DataFrame, marks: DataFrame, units: Units) -> DataFrame:
    marks = marks.groupBy("doc_id").agg(*(F.collect_list(c).alias(c) for c in ("at", "length", "signature")))

    def run(batches):
        for batch in batches:
            out: list[list] = [[], [], [], [], [], []]
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            lists = [batch.column(i) for i in (2, 3, 4)]
            for number, data, offsets in chunks(pa.array(np.arange(batch.num_rows)), batch.column(1)):
                first = starts = ends = None
                if units.by_word:
                    starts, ends, first = words(data, offsets)
                whole = data.tobytes()
                for i, row in enumerate(number):
                    at, length, signature = (column[row].values.to_numpy(zero_copy_only=False) for column in lists)
                    begin, size = (offsets[i], offsets[i + 1] - offsets[i]) if first is None else (first[i], first[i + 1] - first[i])
                    good = at + length + units.window - 1 <= size
                    for a, n, s in zip(at[good].tolist(), length[good].tolist(), signature[good].tolist(), strict=True):
                        low, high = begin + a, begin + a + n + units.window - 1
                        cut = whole[low:high] if first is None else b" ".join([whole[x:y] for x, y in zip(starts[low:high].tolist(), ends[low:high].tolist(), strict=True)])
                        for column, value in zip(out, (s, int(ids[row]), a, n, cut, None), strict=True):
                            column.append(value)
            yield _once(out, units.by_word)

    return docs.join(marks, "doc_id").select("doc_id", "text", "at", "length", "signature").mapInArrow(freeing(run), _CUT)


def _finer(rows: DataFrame, units: Units) -> DataFrame:
    """Rows as from _cut, cut into the shorter runs of units with a longer gram."""

    def run(batches):
        for batch in batches:
            _, doc, place = (batch.column(i).to_numpy() for i in range(3))
            out: list[list] = [[], [], [], [], [], []]
            texts, others = batch.column(4), batch.column(5).to_pylist()
            for number, data, offsets in chunks(pa.array(np.arange(batch.num_rows)), texts.cast(pa.large_binary())):
                h, first, starts, ends = units.hashes(data, offsets)
                signature, text, at, length, _ = units.signatures(h, first)
                whole = data.tobytes()
                low = first[text] + at
                high = low + length + units.window - 1
                if units.by_word:
                    low, high = starts[low], ends[high - 1]
                out[0] += signature.view(np.int64).tolist()
                out[1] += doc[number[text]].tolist()
                out[2] += (place[number[text]] + at).tolist()
                out[3] += length.tolist()
                out[4] += [whole[a:b] for a, b in zip(low.tolist(), high.tolist(), strict=True)]
                out[5] += [[x + a for x in others[i]] if others[i] else None for i, a in zip(number[text].tolist(), at.tolist(), strict=True)]
            yield _once(out, units.by_word)

    return rows.mapInArrow(freeing(run), _CUT)


def contexts(docs: DataFrame, marks: DataFrame, units: Units, *others: tuple[DataFrame, DataFrame]) -> DataFrame:
    """signature, doc_id, at (first unit), length (windows), text and more (by word, other places in the document) of the
    runs in marks, cut from docs, and of others (documents and marks): each different text once for each batch, at its
    earliest place; the others repeat it whole and come without signature and text."""
    rows, done = staged(reduce(DataFrame.unionByName, [_cut(d, m, units) for d, m in ((docs, marks), *others)]), "cut"), []
    for gram in units.finer:
        hot = hot_signatures(rows)
        if hot.isEmpty():
            break
        done.append(rows.join(hot, "signature", "left_anti").select(*rows.columns))
        rows = staged(_finer(rows.join(hot, "signature", "left_semi").select(*rows.columns), replace(units, gram=gram)), "cut")
    return reduce(DataFrame.unionByName, [*done, rows])


def covered(cut: DataFrame, units: Units, repeats: Callable) -> DataFrame:
    """doc_id and intervals [start, stop) of units that windows seen earlier cover, from rows as contexts gives them.

    repeats(group, doc, at, texts) gets whole groups (equal numbers: equal signature; ascending) with their texts ordered
    by doc and place, and returns two arrays: the number of the text and the place in it of every window seen earlier.
    """
    stop = (F.col("start") + F.col("length") + units.window - 1).alias("stop")
    out = [cut.where("text IS NULL").withColumnRenamed("at", "start").select("doc_id", "start", stop)]
    cut = cut.where("text IS NOT NULL")
    hot = hot_signatures(cut)
    if not hot.isEmpty():
        # single windows that are equal
        many, cut = cut.join(hot, "signature", "left_semi"), cut.join(hot, "signature", "left_anti")
        first = many.groupBy("signature", "text").agg(F.min(F.struct("doc_id", "at")).alias("first"))
        later = F.col("doc_id") > F.col("first.doc_id") if units.by_word else F.struct("doc_id", "at") > F.col("first")
        every = F.explode(F.concat(F.array("at"), F.coalesce("more", F.array().cast("array<bigint>")))).alias("start")
        out.append(many.join(first, ["signature", "text"]).where(later).select("doc_id", every, "length").select("doc_id", "start", stop))
    cut = cut.select("signature", "doc_id", "at", "text", "more").repartition("signature").sortWithinPartitions("signature", "doc_id", "at")

    def intervals(table: pa.Table) -> pa.RecordBatch:
        doc, at = (table.column(c).to_numpy() for c in ("doc_id", "at"))
        signature = table.column("signature").to_numpy()
        group = np.cumsum(np.diff(signature, prepend=signature[0]) != 0)
        which, place = repeats(group, doc, at, table.column("text").to_pylist())
        order = np.lexsort((place, which))
        which, place = which[order], place[order]
        new = np.ones(len(which), bool)
        new[1:] = (which[1:] != which[:-1]) | (place[1:] > place[:-1] + 1)
        begin = np.flatnonzero(new)
        end = np.append(begin[1:], len(which))[: len(begin)] - 1
        row, low, high = which[begin], place[begin], place[end] + units.window
        columns = doc[row], at[row] + low, at[row] + high
        more = table.column("more").combine_chunks()
        n = np.diff(more.offsets.to_numpy())[row]  # the same in other places of the document
        if n.sum():
            start = more.offsets.to_numpy()[:-1][row]
            other = more.values.to_numpy()[np.arange(n.sum()) + np.repeat(start - np.cumsum(n) + n, n)]
            columns = [np.concatenate(c) for c in zip(columns, (np.repeat(doc[row], n), other + np.repeat(low, n), other + np.repeat(high, n)), strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in columns], names=["doc_id", "start", "stop"])

    def run(batches: Iterator[pa.RecordBatch]):
        rest = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = table if rest is None else pa.concat_tables([rest, table])
            signature = table.column("signature").to_numpy()
            if not len(signature):
                continue
            n = int(np.searchsorted(signature, signature[-1]))  # the last group may go on
            if n:
                yield intervals(table.slice(0, n))
            rest = table.slice(n)
        if rest is not None and rest.num_rows:
            yield intervals(rest)

    out.append(cut.mapInArrow(freeing(run), "doc_id long, start long, stop long"))
    return reduce(DataFrame.unionByName, out)


def marked(docs: DataFrame, found: DataFrame, run: Callable, schema: str) -> DataFrame:
    """docs with the starts and stops of their intervals, through run (columns doc_id, text, starts, stops)."""
    found = found.groupBy("doc_id").agg(F.collect_list("start").alias("starts"), F.collect_list("stop").alias("stops"))
    return docs.join(found, "doc_id", "left").select("doc_id", "text", "starts", "stops").mapInArrow(freeing(run), schema)


def mask(n: int, starts, stops) -> np.ndarray:
    """Which of n units any interval covers."""
    if not starts.is_valid or not n:
        return np.zeros(n, bool)
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, np.minimum(starts.values.to_numpy(), n), 1)
    np.add.at(change, np.minimum(stops.values.to_numpy(), n), -1)
    return np.cumsum(change[:-1]) > 0


def plain(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))


def stored(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text), rows without doc_id left out, as a table in the shared folder that is bucketed by doc_id:
    joins with it move the other side only."""
    spark = docs.sparkSession
    n = min(MOST_BUCKETS, max(buckets_for(docs), int(spark.conf.get("spark.sql.shuffle.partitions"))))
    name = f"documents_{uuid.uuid4().hex}"
    known = docs.where("doc_id IS NOT NULL").repartition(n, "doc_id")
    known.write.format("parquet").option("compression", "zstd").option("path", new_path(spark, "stored")).bucketBy(n, "doc_id").saveAsTable(name)
    return spark.table(name)


def repeated(docs: DataFrame, units: Units, repeats: Callable) -> DataFrame:
    """Intervals (doc_id, start, stop) of units under windows seen earlier, in docs as from `stored`."""
    n = buckets_for(docs)
    found = staged(recurring(fingerprints(docs, units, n), n, keep=False), "recurring")
    return covered(contexts(docs, told_marks(found), units), units, repeats)
