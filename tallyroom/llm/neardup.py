"""Near duplicates from bottom-k sketches of one hash function.

Each text keeps the K smallest hashes of its set of shingles. Equal sets form classes at once, and the smallest id of
a class stands for it. An inverted list holds the classes that retain a value. A link (Jaccard >= 0.8) shares about
0.8 of the sketch of the union; FLOOR of it, six standard deviations below, is asked for, so by the pigeonhole
principle two linked classes share one of the rarest (1 - FLOOR) K + 1 values of either, and only those values are
looked up: a passage that thousands of documents share is common and makes no candidates.

A list of copies would make as many pairs as the square of its length. So a first round compares each member of a list
with the most central one only: an estimate on the sketch of the union, then the exact test on full sets. Members that
then are in one component need no further comparison. A second round compares the members outside a list's largest
component with the others, exactly and in blocks, after dropping those that an exact bound shows to have no partner. No
list, partner or candidate is capped.
"""

from __future__ import annotations

import hashlib
import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyroom.llm._text import chunks, freeing, lower_ascii, quoted, shingle_sets
from tallyroom.tables import staged

K, FLOOR, SHINGLE, SIMILAR, BLOCK = 40, 0.4, 4, 80, 1024


def sketches(docs: DataFrame, shingle: int = SHINGLE, k: int = K) -> DataFrame:
    """doc_id, n (size of the set), digest of the set and its k smallest hashes in order (63 bits, so never negative)."""

    def run(batches):
        for batch in batches:
            n, digest, sketch = [], [], []
            for _, data, offsets in chunks(batch.column(0), batch.column(1)):
                for s in shingle_sets(lower_ascii(data), offsets, shingle):
                    n.append(len(s))
                    digest.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                    sketch.append((s[:k] >> np.uint64(1)).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.array(sketch, pa.list_(pa.int64()))], names=["doc_id", "n", "digest", "sketch"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(freeing(run), "doc_id long, n long, digest binary, sketch array<long>")


def _estimated(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """Pairs whose sketches, cut to the smallest K of their union, share at least FLOOR of it."""
    side = lambda x: classes.select(F.col("doc_id").alias(x), F.col("n").alias(f"n{x}"), F.col("sketch").alias(f"s{x}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").where((100 * F.col("na") >= SIMILAR * F.col("nb")) & (100 * F.col("nb") >= SIMILAR * F.col("na")))
    union = F.slice(F.array_sort(F.array_union("sa", "sb")), 1, K)
    return both.where(F.size(F.array_intersect(F.array_intersect("sa", "sb"), union)) >= FLOOR * F.size(union)).select("a", "b")


def _confirmed(pairs: DataFrame, texts: DataFrame, shingle: int) -> DataFrame:
    """Pairs whose full sets are similar."""

    def run(batches):
        for batch in batches:
            good = []
            sets = [(s for _, data, offsets in chunks(batch.column(0), batch.column(c)) for s in shingle_sets(lower_ascii(data), offsets, shingle)) for c in (2, 3)]
            for a, b in zip(*sets, strict=True):
                common = len(np.intersect1d(a, b, assume_unique=True))
                good.append(100 * common >= SIMILAR * (len(a) + len(b) - common))
            keep = pa.array(good, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], names=["a", "b"])

    side = lambda x: texts.select(F.col("doc_id").alias(x), F.col("text").alias(f"t{x}"))
    return pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "ta", "tb").mapInArrow(freeing(run), "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """doc_id and component_id (smallest id reachable) of all ends of links (a, b): the smallest label of itself and
    its neighbours, later also the label's label, until nothing changes."""
    ends = staged(links.select("a", "b").union(links.select("b", "a")).distinct(), "link-ends")
    labels = staged(ends.groupBy(F.col("a").alias("doc_id")).agg(F.least(F.min("b"), F.first("a")).alias("component_id")), "labels")
    for number in itertools.count():
        near = ends.join(labels.withColumnRenamed("doc_id", "b"), "b").select(F.col("a").alias("doc_id"), "component_id", F.lit(None).cast("long").alias("own"))
        every = near.union(labels.select("doc_id", "component_id", F.col("component_id").alias("own")))
        new = every.groupBy("doc_id").agg(F.min("component_id").alias("component_id"), F.max("own").alias("was"))
        if number > 1:  # groups around one document are done by now; long chains are left
            up = labels.select(F.col("doc_id").alias("component_id"), F.col("component_id").alias("jump"))
            new = new.join(up, "component_id", "left").select("doc_id", F.least("component_id", "jump").alias("component_id"), "was")
        new = staged(new, "labels")
        labels = new.select("doc_id", "component_id")
        if new.where("component_id < was").isEmpty():
            return labels


def _apart(lists: DataFrame, found: DataFrame, texts: DataFrame, shingle: int) -> DataFrame:
    """Links (a, b) between members of one list that are in different components, one at least for each member outside
    a list's largest component and each other component that it is similar to.

    Lists with one largest component form a group. Of its members only those stay of whose full sets at most a fifth is
    in no other set here, as the others have no partner. The members outside meet all members in blocks of about BLOCK;
    a block's intersections are a product of two matrices, and only links leave the task.
    """
    placed = staged(lists.join(found, "doc_id", "left").select("v", "doc_id", F.coalesce("component_id", "doc_id").alias("component")), "placed")
    largest = placed.groupBy("v", "component").count().groupBy("v").agg(F.max(F.struct("count", "component")).alias("m"), F.count("*").alias("parts"))
    largest = staged(largest.where("parts > 1").select("v", F.col("m.component").alias("g")), "largest")
    group = staged(placed.join(largest, "v").select("g", "doc_id", "component").distinct(), "groups")
    own = texts.join(staged(group.select("doc_id").distinct(), "grouped"), "doc_id").dropDuplicates(["doc_id"])

    def run(batches):
        for batch in batches:
            for ids, data, offsets in chunks(batch.column(0), batch.column(1)):
                sets = list(shingle_sets(lower_ascii(data), offsets, shingle))
                n = np.array([len(s) for s in sets])
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, n)), pa.array(np.repeat(n, n)), pa.array(np.concatenate(sets).view(np.int64))], names=["doc_id", "n", "v"])

    values = staged(own.mapInArrow(freeing(run), "doc_id long, n long, v long"), "full-sets")
    shared = staged(values.groupBy("v").agg(F.count("*").alias("df")).where("df > 1").select("v"), "full-shared")
    held = values.join(shared, "v").groupBy("doc_id", "n").agg(F.collect_list("v").alias("held")).where(100 * F.size("held") >= SIMILAR * F.col("n"))
    rows = staged(group.join(held, "doc_id"), "group-members")
    counts = rows.groupBy("g").agg(F.count("*").alias("members"), F.count_if(F.col("component") != F.col("g")).alias("outside")).where("outside > 0")
    counts = staged(counts.select("g", F.ceil(F.col("outside") / BLOCK).cast("int").alias("na"), F.ceil(F.col("members") / BLOCK).cast("int").alias("nb")), "group-blocks")
    rows = rows.join(counts, "g")
    dealt = lambda n: F.pmod(F.xxhash64("doc_id"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    fields = ("g", "doc_id", "component", "n", "held")
    left = rows.where("component <> g").select(*[F.col(c).alias(c) for c in fields], dealt("na").alias("x"), every("nb").alias("y"))
    right = rows.select(*fields, dealt("nb").alias("y"), every("na").alias("x"))

    def compare(xs: pa.Table, ys: pa.Table) -> pa.Table:
        out: list[np.ndarray] = [np.zeros(0, np.int64), np.zeros(0, np.int64)]
        if xs.num_rows and ys.num_rows:
            common = _intersections(xs.column("held").combine_chunks(), ys.column("held").combine_chunks())
            (ids, parts, n), (ids2, parts2, n2) = ([t.column(c).to_numpy() for c in ("doc_id", "component", "n")] for t in (xs, ys))
            x, y = np.nonzero((100 * common >= SIMILAR * (n[:, None] + n2 - common)) & (parts[:, None] != parts2))
            _, one = np.unique(np.stack([x, parts2[y]]), axis=1, return_index=True)  # a link to each other component is enough
            out = [np.minimum(ids[x[one]], ids2[y[one]]), np.maximum(ids[x[one]], ids2[y[one]])]
        return pa.table({"a": pa.array(out[0], pa.int64()), "b": pa.array(out[1], pa.int64())})

    return left.groupBy("g", "x", "y").cogroup(right.groupBy("g", "x", "y")).applyInArrow(compare, "a long, b long")


def _intersections(xs: pa.Array, ys: pa.Array, width: int = 4096) -> np.ndarray:
    """Sizes of the intersections of all sets in xs with all in ys, by products of `width` values at a time."""
    sides, values = [], []
    for side in (xs, ys):
        sides.append(np.repeat(np.arange(len(side)), np.diff(side.offsets.to_numpy())))
        values.append(side.flatten().to_numpy())
    _, place = np.unique(np.concatenate(values), return_inverse=True)
    columns = [place[: len(values[0])], place[len(values[0]) :]]
    for i in (0, 1):
        order = np.argsort(columns[i], kind="stable")
        columns[i], sides[i] = columns[i][order], sides[i][order]
    out = np.zeros((len(xs), len(ys)), np.float32)
    for at in range(0, int(place.max(initial=-1)) + 1, width):
        dense = []
        for rows, column, n in zip(sides, columns, out.shape, strict=True):
            low, high = np.searchsorted(column, [at, at + width])
            m = np.zeros((n, width), np.float32)
            m[rows[low:high], column[low:high] - at] = 1
            dense.append(m)
        out += dense[0] @ dense[1].T
    return out.astype(np.int64)


def _ordered(a, b):
    return F.least(a, b).alias("a"), F.greatest(a, b).alias("b")


def linked(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row.

    A null or empty text has an empty set and is linked with nothing; a null doc_id is linked with nothing, has no
    component and is kept. Repeated rows of one doc_id are one document of the class of their text. Other columns are
    ignored; an empty table gives no rows. The set of a text of any length is whole; one text must fit a task.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    every = staged(sketches(texts, shingle), "sketches")
    some = every.where("n > 0 AND doc_id IS NOT NULL")
    classes = staged(some.groupBy("digest").agg(F.min(F.struct("doc_id", "n", "sketch")).alias("c")).select("c.*").dropDuplicates(["doc_id"]), "classes")
    values = classes.select(F.explode("sketch").alias("v"), "doc_id", F.size("sketch").alias("s"))
    shared = staged(values.groupBy("v").agg(F.count("*").alias("df")).where("df > 1"), "shared-values")
    # a value that one class retains comes before all shared ones
    prefix = F.col("s") - F.ceil(FLOOR * F.col("s")) + 1 - (F.col("s") - F.size("held"))
    held = values.join(shared, "v").groupBy("doc_id", "s").agg(F.array_sort(F.collect_list(F.struct("df", "v"))).alias("held"))
    held = held.withColumn("weight", F.aggregate("held", F.lit(0).cast("long"), lambda a, x: a + x["df"])).where(prefix > 0)
    lists = staged(held.select("doc_id", "weight", F.explode(F.slice("held", 1, prefix.cast("int"))).alias("x")).select("x.v", "doc_id", "weight"), "inverted-lists")

    head = staged(lists.groupBy("v").agg(F.max(F.struct("weight", (-F.col("doc_id")).alias("id"))).alias("m"), F.count("*").alias("members")).where("members > 1").select("v", (-F.col("m.id")).alias("head")), "heads")
    first = staged(lists.join(head, "v").where("doc_id <> head").select(*_ordered("doc_id", "head")).distinct(), "first-candidates")
    links = staged(_confirmed(staged(_estimated(first, classes), "first-likely"), texts, shingle), "first-links")
    found = components(links)

    more = staged(_apart(lists, found, texts, shingle), "second-links")
    if not more.isEmpty():
        found = components(links.union(more))

    of_class = some.groupBy("digest").agg(F.min("doc_id").alias("head"))
    of_class = staged(of_class.join(found.withColumnRenamed("doc_id", "head"), "head", "left").select("digest", F.coalesce("component_id", "head").alias("component")), "classes-placed")
    own = F.when((F.col("n") > 0) & F.col("doc_id").isNotNull(), F.col("component")).otherwise(F.col("doc_id"))
    out = every.select("doc_id", "n", "digest").join(of_class, "digest", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), own.alias("component_id"), F.coalesce(F.col("doc_id") == own, F.lit(True)).alias("kept"))


def clean(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """The rows of docs, with all columns, that are the first of their component. Rows without doc_id stay, as do null
    and empty texts; repeated rows go or stay together; an empty table stays empty; other columns may have any name."""
    gone = staged(linked(docs, shingle).where(~F.col("kept")).select("doc_id"), "near-duplicates")
    return docs.join(gone, "doc_id", "left_anti").select(*map(quoted, docs.columns))
