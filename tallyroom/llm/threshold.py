"""Exact top-k by inner product with Fagin's threshold algorithm.

Vectors are dealt into blocks of about BLOCK, and within a task into parts of LIST that have one sorted list for each
dimension. For a query the lists are read in step, from the end that its component favours; each vector met is scored in
full, and the sum over the lists of the query's component times the value read next bounds every vector not met. Reading
stops when the kth score beats it; the kth score of one part is the least that the next has to beat. A vector is met at
the smallest of its places in the lists, so all places that are read in one step are found by a few array operations.
Queries form blocks of their own, so no task holds more than one block of each.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyroom.tables import staged

BLOCK, LIST, QUERY_BLOCK, SCALE = 16384, 4096, 1024, 1024
FIRST_STEP = 64


def quantised(vectors: DataFrame, ident: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """ident and v, floor(SCALE * x) of every component as long. Vectors that are null or hold null or non-finite
    components go, as do rows without ident; an empty vector scores 0 with every other; repeated rows count once. Other
    columns are ignored, whatever their names."""
    fine = F.forall(vector, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    return vectors.where(F.col(ident).isNotNull() & fine).select(F.col(ident).cast("long").alias("vec_id"), F.transform(vector, lambda x: F.floor(x.cast("double") * SCALE)).alias("v")).distinct()


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    """Rows padded with zeros to `width` components: a shorter vector's inner product ends with it."""
    lists = column.combine_chunks()
    sizes = np.diff(lists.offsets.to_numpy())
    values = lists.flatten().to_numpy()
    out = np.zeros((len(sizes), width), np.int64)
    out[np.arange(width) < sizes[:, None]] = values
    return out


class Lists:
    """The vectors of a part as one sorted list for each dimension: of x (rows of one kind whose products are exact) the
    sorted values and each row's place among them."""

    def __init__(self, x: np.ndarray, ids: np.ndarray):
        self.x, self.ids, n = x, ids, len(x)
        order = np.argsort(x, axis=0, kind="stable").T
        self.values = np.take_along_axis(x.T, order, axis=1)
        self.place = np.empty(order.shape, np.int16 if n <= 1 << 15 else np.int32)
        np.put_along_axis(self.place, order, np.arange(n, dtype=self.place.dtype)[None, :], axis=1)

    def search(self, q: np.ndarray, own: int, k: int, best: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the k best for q, by score, then smaller id, of these vectors and of `best`, the ones found
        before; vectors with the id `own` take no part."""
        n = len(self.x)
        ids, scores = best
        up, down = np.flatnonzero(q > 0), np.flatnonzero(q < 0)
        # the step at which each row is met: without a list to read, all at once
        met = np.zeros(n, self.place.dtype)
        if len(up) or len(down):
            ends = [n - 1 - self.place[up].max(axis=0)] if len(up) else []
            met = np.minimum.reduce([*ends, *([self.place[down].min(axis=0)] if len(down) else [])])
        order = np.argsort(met, kind="stable")
        steps = met[order]
        at, depth = 0, min(FIRST_STEP, n)
        while at < n:
            to = int(np.searchsorted(steps, depth))
            rows = order[at:to]
            rows = rows[self.ids[rows] != own]
            ids, scores = np.concatenate([ids, self.ids[rows]]), np.concatenate([scores, self.x[rows] @ q])
            if len(ids) > k:
                fair = np.flatnonzero(scores >= np.partition(scores, -k)[-k])
                fair = fair[np.lexsort((ids[fair], -scores[fair]))[:k]]
                ids, scores = ids[fair], scores[fair]
            at = to
            if at < n and len(ids) == k and scores.min() > q[up] @ self.values[up, n - 1 - depth] + q[down] @ self.values[down, depth]:
                break
            depth = min(2 * depth, n)
        return ids, scores


def top_k(vectors: DataFrame, is_query, k: int = 10, block: int = BLOCK, query_block: int = QUERY_BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k best among all vectors but its own (all, if fewer).

    vectors: as from quantised; is_query: the condition on them that makes queries. Ties go to the smaller vec_id. An
    empty table gives no rows. Two vectors of one id are both candidates; a query id with several vectors is taken by
    its smallest vector. Vectors of other lengths are taken as if they ended in zeros.
    """
    vectors = staged(vectors, "vectors")
    queries = vectors.where(is_query).groupBy("vec_id").agg(F.min("v").alias("v"))
    n_blocks = max(1, -(-vectors.count() // block))
    n_query_blocks = max(1, -(-queries.count() // query_block))
    dealt = lambda n, salt: F.pmod(F.xxhash64("vec_id", F.lit(salt)), F.lit(n))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    left = queries.select("vec_id", "v", dealt(n_query_blocks, 1).alias("a"), every(n_blocks).alias("b"))
    right = vectors.select("vec_id", "v", dealt(n_blocks, 2).alias("b"), every(n_query_blocks).alias("a"))

    def cell(qs: pa.Table, xs: pa.Table) -> pa.Table:
        out: list[list] = [[], [], []]
        if qs.num_rows and xs.num_rows:
            width = max(1, *(np.diff(t.column("v").combine_chunks().offsets.to_numpy()).max() for t in (qs, xs)))
            q, x = _matrix(qs.column("v"), width), _matrix(xs.column("v"), width)
            if float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) * width < 2**52:
                q, x = q.astype(float), x.astype(float)  # exact, and multiplied faster
            ids = xs.column("vec_id").to_numpy()
            owns = qs.column("vec_id").to_pylist()
            best = [(np.zeros(0, np.int64), np.zeros(0, x.dtype))] * len(owns)
            for i in range(0, len(x), LIST):
                lists = Lists(x[i : i + LIST], ids[i : i + LIST])
                best = [lists.search(vector, own, k, b) for own, vector, b in zip(owns, q, best, strict=True)]
            out[0] = [np.repeat(own, len(b[0])) for own, b in zip(owns, best, strict=True)]
            out[1], out[2] = [b[0] for b in best], [b[1].astype(np.int64) for b in best]
        return pa.table({n: pa.array(np.concatenate([np.zeros(0, np.int64), *c]), pa.int64()) for n, c in zip(("query_id", "vec_id", "score"), out, strict=True)})

    found = left.groupBy("a", "b").cogroup(right.groupBy("a", "b")).applyInArrow(cell, "query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


ORACLE = """WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(coalesce(list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2])), 0) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10"""
