"""Target-distribution importance resampling over hashed word features.

Features (runs of words) are hashed by CRC-32 into buckets. Equal features of a run of texts are hashed once: features
of one length are the rows of a matrix of bytes, and the checksums of all rows advance together, column by column.
The share of each bucket in the target against its share in the documents is what a feature gains; a document's gains
and a Gumbel number drawn from its id make its score, and the highest scores are drawn.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyroom.llm._text import CRC32_SQL, chunks, crc32_sql, freeing, lower_ascii
from tallyroom.tables import staged

BUCKETS, ORDERS, LEAST_WORDS, SEED = 10_000, 1, 20, 2024
#: Bytes of text whose features are grouped together, and features beyond so many bytes are hashed one by one.
TEXT_BYTES, LONG = 1 << 20, 64
#: Ranges of scores that are ranked by themselves.
RANGES = 256
_WORD = np.zeros(256, bool)
_WORD[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def _table() -> np.ndarray:
    """What a byte adds to a CRC-32 (reflected polynomial EDB88320)."""
    out = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        out = np.where(out & 1, (out >> 1) ^ np.uint32(0xEDB88320), out >> 1).astype(np.uint32)
    return out


_CRC = _table()


def crc_of_rows(rows: np.ndarray) -> np.ndarray:
    """CRC-32 of every row of a matrix of bytes."""
    crc = np.full(len(rows), 0xFFFFFFFF, np.uint32)
    for column in rows.T:
        crc = _CRC[(crc ^ column) & np.uint32(0xFF)] ^ (crc >> np.uint32(8))
    return ~crc


def crc_of_spans(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """CRC-32 of spans of bytes; equal spans are hashed once."""
    out = np.zeros(len(starts), np.uint32)
    order = np.argsort(lengths, kind="stable")
    edges = np.searchsorted(lengths[order], np.arange(1, LONG + 2))
    for n, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True), 1):
        if a < b:
            some = order[a:b]
            rows = data[starts[some][:, None] + np.arange(n)]
            if n <= 8:
                held = np.zeros((len(rows), 8), np.uint8)
                held[:, :n] = rows
                keys = held.view(np.uint64).ravel()
            else:
                keys = rows.view(f"V{n}").ravel()
            _, first, which = np.unique(keys, return_index=True, return_inverse=True)
            out[some] = crc_of_rows(rows[first])[which]
    for i in order[edges[-1] :].tolist():
        out[i] = zlib.crc32(data[starts[i] : starts[i] + lengths[i]])
    return out


def _features(data: np.ndarray, offsets: np.ndarray, orders: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """CRC-32 of the features of texts, the number of the text of each, and the texts' numbers of words and features."""
    n = len(offsets) - 1
    data = lower_ascii(data)
    inside = _WORD[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    edges = offsets[1:-1][(offsets[1:-1] > 0) & (offsets[1:-1] < len(data))]
    first[edges] = inside[edges]
    last[edges - 1] = inside[edges - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    text = np.searchsorted(offsets, starts, "right") - 1
    words = np.bincount(text, minlength=n)
    if orders > 1 and len(starts):
        # words with one space between, so that a feature is one span
        lengths = ends - starts
        at = np.cumsum(lengths + 1) - (lengths + 1)
        spaced = np.full(int(at[-1] + lengths[-1]), 0x20, np.uint8)
        spaced[np.arange(lengths.sum()) + np.repeat(np.arange(len(starts)), lengths)] = data[inside]
        data, starts, ends = spaced, at, at + lengths
    crc, of = [], []
    for k in range(min(orders, len(starts))):
        same = np.flatnonzero(text[k:] == text[: len(text) - k])
        crc.append(crc_of_spans(data, starts[same], ends[same + k] - starts[same]))
        of.append(text[same])
    crc, of = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (crc, of))
    return crc, of, words, np.bincount(of, minlength=n)


def hashed(docs: DataFrame, buckets: int = BUCKETS, orders: int = ORDERS) -> DataFrame:
    """doc_id, n_words, n_features and buckets (binary: an unsigned little-endian number for each feature, of 16 bits
    where they suffice, else 32). A null text has no words."""
    kind = _kind(buckets)

    def run(batches):
        for batch in batches:
            at = 0
            for keys, data, offsets in chunks(pa.array(np.arange(batch.num_rows)), batch.column(1), TEXT_BYTES):
                crc, of, words, features = _features(data, offsets, orders)
                if orders > 1:
                    crc = crc[np.argsort(of, kind="stable")]
                held = (crc % np.uint32(buckets)).astype(kind).tobytes()
                ends = np.cumsum(features) * np.dtype(kind).itemsize
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(at, len(keys)), pa.array(words), pa.array(features),
                    pa.array([held[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)], pa.binary()),
                ], ["doc_id", "n_words", "n_features", "buckets"])
                at += len(keys)

    return docs.select("doc_id", "text").mapInArrow(freeing(run), f"doc_id {dict(docs.dtypes)['doc_id']}, n_words long, n_features long, buckets binary")


def _kind(buckets: int) -> str:
    return "<u2" if buckets <= 1 << 16 else "<u4"


def counted(features: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """bucket and n, its features; each task counts its own rows first."""
    kind = _kind(buckets)

    def run(batches):
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for held in batch.column(0):
                total += np.bincount(np.frombuffer(held.as_buffer(), kind), minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"bucket": at, "n": total[at]})

    return features.select("buckets").mapInArrow(freeing(run), "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(features: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """For each bucket floor(1000 * ln of its smoothed share in the target by that in the features)."""
    s, t = np.zeros(buckets), np.zeros(buckets)
    # at most one row a bucket comes to the driver
    for held, df in ((s, features), (t, target)):
        for row in counted(df, buckets).toLocalIterator():
            held[row["bucket"]] = row["n"]
    return np.array([math.floor(1000 * math.log((b + 1) * (s.sum() + buckets) / ((a + 1) * (t.sum() + buckets)))) for a, b in zip(s, t, strict=True)], np.int64)


def weighed(features: DataFrame, gain: np.ndarray) -> DataFrame:
    """doc_id, n_words, n_features and weight, the sum of the gains of a document's features."""
    kind = _kind(len(gain))
    table = features.sparkSession.sparkContext.broadcast(gain)

    def run(batches):
        gain = table.value
        for batch in batches:
            weight = [int(gain[np.frombuffer(held.as_buffer(), kind)].sum()) for held in batch.column(3)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(weight, pa.int64())], ["doc_id", "n_words", "n_features", "weight"])

    return features.mapInArrow(freeing(run), f"doc_id {dict(features.dtypes)['doc_id']}, n_words long, n_features long, weight long")


def resampled(docs: DataFrame, target: DataFrame, percent: int = 10, least_words: int = LEAST_WORDS, buckets: int = BUCKETS, orders: int = ORDERS, seed: int = SEED) -> DataFrame:
    """doc_id, n_features, weight, score and rank of every document; target: rows with a text.

    Of the documents with at least least_words words, percent of a hundred (rounded down) are drawn by their scores,
    ties to the smaller doc_id; rank counts from 1, and is null for what isn't drawn. A null or empty text has no
    features, so weight 0, and isn't drawn while least_words is over 0. A null doc_id is drawn as an id without digits
    and comes first among ties; repeated rows are ranked one by one. Texts of any length are read whole; other columns
    are ignored. An empty target leaves the weight to the documents' own counts; an empty table gives no rows.
    """
    features = staged(hashed(docs, buckets, orders), "features")
    aim = staged(hashed(target.select(F.lit(0).alias("doc_id"), "text"), buckets, orders), "target")
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    gumbel = F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))
    scored = staged(weighed(features, gains(features, aim, buckets)).withColumn("score", F.col("weight") + gumbel), "scored")
    return ranked(scored, F.col("n_words") >= least_words, percent).select("doc_id", "n_features", "weight", "score", "rank")


def ranked(scored: DataFrame, able: F.Column, percent: int) -> DataFrame:
    """scored with rank: places of the highest scores among the rows that are able, up to percent of them.

    Scores are cut into ranges of about equal numbers of rows; the numbers of rows of the ranges (RANGES of them) tell
    how many stand before each, and only ranges that hold drawn rows are sorted, each by itself.
    """
    steps = F.array(*[F.lit(i / RANGES) for i in range(1, RANGES)])
    bounds = sorted(set(scored.where(able).agg(F.percentile_approx("score", steps, 10 * RANGES).alias("b")).first()["b"] or []), reverse=True)
    held = F.array(*[F.lit(b).cast("long") for b in bounds])
    # the number of bounds above a score; rows that aren't able have no range
    scored = scored.withColumn("_range", F.when(able, F.size(F.filter(held, lambda b: b > F.col("score")))))
    counts = dict(scored.where("_range IS NOT NULL").groupBy("_range").count().collect())
    drawn, before, at = percent * sum(counts.values()) // 100, {}, 0
    for r in sorted(counts):
        if at < drawn:
            before[r] = at
        at += counts[r]
    if not before:
        return scored.withColumn("rank", F.lit(None).cast("long")).drop("_range")
    offset = F.element_at(F.create_map(*[F.lit(x).cast("long") for pair in before.items() for x in pair]), F.col("_range").cast("long"))
    open_ = F.coalesce(F.col("_range") <= max(before), F.lit(False))
    place = offset + F.row_number().over(Window.partitionBy("_range").orderBy(F.desc("score"), "doc_id"))
    inside = scored.where(open_).withColumn("rank", F.when(place <= drawn, place).cast("long"))
    return inside.unionByName(scored.where(~open_).withColumn("rank", F.lit(None).cast("long"))).drop("_range")


ORACLE = f"""WITH {CRC32_SQL},
d AS (SELECT row_number() OVER () AS r, doc_id, text FROM documents),
w AS (SELECT r, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')) AS word FROM (
  SELECT r, text FROM d UNION ALL SELECT NULL, text FROM benchmark)),
held AS (SELECT r, word, count(*) AS n FROM w GROUP BY r, word),
codes AS (SELECT word, {crc32_sql("hex(encode(word))")} % 10000 AS bucket FROM (SELECT DISTINCT word FROM held), crc_table),
b AS (SELECT bucket, coalesce(sum(n) FILTER (r IS NOT NULL), 0) AS s, coalesce(sum(n) FILTER (r IS NULL), 0) AS t FROM held JOIN codes USING (word) GROUP BY bucket),
g AS (SELECT bucket, floor(1000 * ln((t + 1)::DOUBLE * ((SELECT sum(s) FROM b) + 10000) / ((s + 1)::DOUBLE * ((SELECT sum(t) FROM b) + 10000))))::BIGINT AS gain FROM b),
x AS (SELECT r, sum(n)::BIGINT AS n_features, sum(n * gain)::BIGINT AS weight FROM held JOIN codes USING (word) JOIN g USING (bucket) WHERE r IS NOT NULL GROUP BY r),
y AS (SELECT doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
    ('0x' || substr(sha256('2024:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT::DOUBLE AS h FROM d LEFT JOIN x USING (r)),
z AS (SELECT doc_id, n_features, weight, weight + floor(-1000 * ln(-ln((h + 0.5) / 4294967296)))::BIGINT AS score FROM y),
p AS (SELECT *, CASE WHEN n_features >= 20 THEN row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id NULLS FIRST) END AS place FROM z)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= (10 * (SELECT count(*) FROM z WHERE n_features >= 20)) // 100 THEN place END AS rank FROM p"""
