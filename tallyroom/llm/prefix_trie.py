"""Prefix trie of conversations, built in range shards.

A turn is told by a digest of its role and text, and a conversation is the string of its turns' digests. These strings
are sorted and dealt by range into shards, so that the members of a node stand side by side. A shard gives its turns
small numbers, enters its sequences in a ternary search tree (the middle one first, so that the trees stay balanced),
and sums members, leaves and savings from the deepest nodes up. Nodes on the first and last sequence of a shard may
have members in its neighbours: these two paths are what a shard hands on, and runs of shards are merged in the same
way, until one is left.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Callable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyroom.llm._text import CRC32_SQL, crc32_sql, freeing
from tallyroom.tables import staged

HEADS = 6
#: Turns of a shard, shards that are merged at once, and bytes of ids that a row of a shared end carries.
SHARD_TURNS, FAN_IN, END_BYTES = 1 << 17, 512, 1 << 16
_D = 16
#: What is known of a node on an outer path: code points of its turn, members, the smallest one, and of what is finished
#: below it the children, their leaves and their savings.
_PART = struct.Struct("<qqqqqq")
_NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
_OUT = f"kind int, shard long, slot int, key binary, path binary, parts binary, ends string, {_NODE}"
_NODE_NAMES, _OUT_NAMES = ([x.split()[0] for x in schema.split(", ")] for schema in (_NODE, _OUT))
_FINISHED, _PATH, _ENDS = 0, 1, 2


def rebuilt(turns: DataFrame, heads: int = HEADS, span: int = 100) -> DataFrame:
    """conv_id, path (16 bytes a turn) and sizes (code points of each turn's text) of every conversation.

    A conversation c takes its first h turns from conversation c - c % span (c % span from 0 on), where h is
    crc32(decimal c) % heads, and the rest from its own turns after its first h. Turns of one number are in the order
    of role and text; repeated rows are turns of their own; rows without conv_id belong to no conversation.
    """
    role, text = (F.coalesce(c, F.lit("")) for c in ("role", "text"))
    digest = F.substring(F.unhex(F.sha2(F.concat_ws(":", F.length(role).cast("string"), role, text), 256)), 1, _D)
    part = F.struct("turn", role.alias("role"), text.alias("text"), digest.alias("digest"), F.length(text).cast("long").alias("size"))
    own = turns.where("conv_id IS NOT NULL").groupBy("conv_id").agg(F.array_sort(F.collect_list(part)).alias("t"))
    own = own.select("conv_id", F.transform("t", lambda x: F.struct(x["digest"].alias("digest"), x["size"].alias("size"))).alias("t"))
    own = staged(own.withColumn("h", F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads), "conversations")
    # a head is short and each has less than span followers
    base = own.where(F.pmod("conv_id", F.lit(span)) == 0).select(F.col("conv_id").alias("base"), F.slice("t", 1, heads - 1).alias("head"))
    own = own.withColumn("base", F.col("conv_id") - F.pmod("conv_id", F.lit(span))).join(base, "base", "left")
    none = F.slice("t", 1, 0)
    head = F.slice(F.coalesce("head", none), F.lit(1), F.col("h").cast("int"))
    rest = F.slice("t", F.col("h").cast("int") + 1, F.greatest(F.size("t") - F.col("h").cast("int"), F.lit(0)))
    whole = own.select("conv_id", F.concat(head, rest).alias("t"))
    path = F.unhex(F.array_join(F.transform("t", lambda x: F.hex(x["digest"])), ""))
    return whole.select("conv_id", path.alias("path"), F.transform("t", lambda x: x["size"]).alias("sizes"))


class Tree:
    """Ternary search trees over turn numbers: one for the children of each node, the node itself is an entry of them."""

    def __init__(self):
        # entry 0 is the root of the trie
        self.turn, self.low, self.high, self.child, self.parent, self.depth = [-1], [0], [0], [0], [-1], [0]

    def insert(self, turns: list[int]) -> int:
        """The node of a sequence, new where it wasn't there."""
        node = 0
        for t in turns:
            at, links = self.child[node], self.child
            slot = node
            while at:
                if t == self.turn[at]:
                    break
                links, slot = (self.low if t < self.turn[at] else self.high), at
                at = links[slot]
            else:
                at = links[slot] = len(self.turn)
                self.turn.append(t)
                self.low.append(0)
                self.high.append(0)
                self.child.append(0)
                self.parent.append(node)
                self.depth.append(self.depth[node] + 1)
            node = at
        return node


def _medians(n: int) -> Iterator[int]:
    """0 .. n - 1, the middle before the two halves."""
    left = [(0, n)]
    while left:
        a, b = left.pop()
        if a < b:
            m = (a + b) // 2
            yield m
            left += [(m + 1, b), (a, m)]


class Shard:
    """Sorted paths and what each adds to its nodes."""

    def __init__(self, number: int):
        self.number, self.turns = number, 0
        self.paths: list[bytes] = []
        self.parts: list[list[tuple]] = []
        self.ends: list[list[int]] = []

    def add_conversation(self, path: bytes, sizes: list[int], conv: int) -> None:
        if not self.paths or self.paths[-1] != path:
            self.paths.append(path)
            self.parts.append([(s, 0, conv, 0, 0, 0) for s in (0, *sizes)])
            self.ends.append([])
            self.turns += len(sizes)
        self.ends[-1].append(conv)
        self.turns += 1

    def add_path(self, path: bytes, parts: bytes) -> None:
        """An outer path of a smaller shard; its ends were handed on by themselves."""
        self.paths.append(path)
        self.parts.append(list(_PART.iter_unpack(parts)))
        self.ends.append([])

    def rows(self, last: bool = False) -> Iterator[dict]:
        """Finished nodes, and the two outer paths with their ends; where this is the last shard all nodes are finished."""
        if not self.paths:
            return
        split = [[p[i : i + _D] for i in range(0, len(p), _D)] for p in self.paths]
        # in the order of the digests, as the sequences are: the middle one divides the others
        numbers = {d: i for i, d in enumerate(sorted({d for turns in split for d in turns}))}
        tree, nodes = Tree(), [0] * len(split)
        for i in _medians(len(split)):
            nodes[i] = tree.insert([numbers[d] for d in split[i]])
        n, parent, depth = len(tree.turn), tree.parent, tree.depth
        size, convs, small = [0] * n, [0] * n, [0] * n
        children, leaves, saved, ends = [0] * n, [0] * n, [0] * n, [()] * n
        for node, parts, own in zip(nodes, self.parts, self.ends, strict=True):
            if own:
                ends[node] = own
            at = node
            for s, members, conv, below, below_leaves, below_saved in reversed(parts):
                members += len(own)
                if members:
                    small[at] = min(small[at], conv) if convs[at] else conv
                size[at] = s
                convs[at] += members
                children[at] += below
                leaves[at] += below_leaves
                saved[at] += below_saved
                at = parent[at]
        digests = list(numbers)
        outer = {} if last else self._outer(tree, digests, nodes[0]) | self._outer(tree, digests, nodes[-1])
        for at in np.argsort(-np.array(depth), kind="stable").tolist():
            if at not in outer:
                leaves[at] += children[at] == 0
                saved[at] += (convs[at] - 1) * size[at]
                up = parent[at]
                if up >= 0:
                    children[up] += 1
                    leaves[up] += leaves[at]
                    saved[up] += saved[at]
        # a node that was on an outer path before has a name by which its children and ends find it
        named = self._outer(tree, digests, *nodes) if not any(self.ends) else {}
        for at in range(n):
            if at not in outer:
                up = parent[at]
                held = hashlib.sha256(",".join(map(str, ends[at])).encode()).hexdigest()
                of = None if up < 0 or up in outer else small[up]
                yield self._row(_FINISHED, None, named.get(at), outer.get(up)) | dict(zip(_NODE_NAMES, (small[at], depth[at], of, convs[at], children[at], leaves[at], saved[at], held), strict=True))
        told = set()
        for slot, i in enumerate(dict.fromkeys((0, len(nodes) - 1)) if outer else ()):
            at, parts = nodes[i], []
            while at >= 0:
                # the paths share their upper nodes, which the first one brings
                parts.append(_PART.pack(size[at], 0, 0, 0, 0, 0) if at in told else _PART.pack(size[at], convs[at], small[at], children[at], leaves[at], saved[at]))
                told.add(at)
                at = parent[at]
            yield self._row(_PATH, slot, None, self.paths[i], b"".join(reversed(parts)))
        for at in told:
            yield from (self._row(_ENDS, slot, outer[at]) | {"ends": text} for slot, text in enumerate(_joined(ends[at])))

    @staticmethod
    def _outer(tree: Tree, digests: list[bytes], *nodes: int) -> dict[int, bytes]:
        """The nodes from the root to some others, each with a digest of its sequence as its name."""
        out = {0: hashlib.sha256().digest()[:_D]}
        for node in nodes:
            path = []
            while node > 0:
                path.append(node)
                node = tree.parent[node]
            held = hashlib.sha256()
            for at in reversed(path):
                held.update(digests[tree.turn[at]])
                out[at] = held.digest()[:_D]
        return out

    def _row(self, kind: int, slot: int | None, key: bytes | None, path: bytes | None = None, parts: bytes | None = None) -> dict:
        return dict.fromkeys(_OUT_NAMES) | {"kind": kind, "shard": self.number, "slot": slot, "key": key, "path": path, "parts": parts}


def _joined(ids: list[int]) -> Iterator[str]:
    """Ids joined by commas, in texts of bounded length."""
    held, size = [], 0
    for i in ids:
        held.append(str(i))
        size += len(held[-1]) + 1
        if size >= END_BYTES:
            yield ",".join(held)
            held, size = [], 0
    if held:
        yield ",".join(held)


def _folded(rows: DataFrame, full: Callable, add: Callable, last: bool = False) -> DataFrame:
    """Sorted rows of each partition as shards; `full` tells when a shard is closed."""

    def run(batches):
        shard = Shard(TaskContext.get().partitionId() << 32)
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if full(shard, row):
                    yield from _batches(shard.rows(last))
                    shard = Shard(shard.number + 1)
                add(shard, row)
        yield from _batches(shard.rows(last))

    return rows.mapInArrow(freeing(run), _OUT)


def _batches(rows: Iterator[dict], most: int = 10_000) -> Iterator[pa.RecordBatch]:
    while held := list(islice(rows, most)):
        yield pa.RecordBatch.from_pylist(held, _ARROW)


_ARROW = pa.schema([(name, {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "string": pa.string()}[kind]) for name, kind in (x.split() for x in _OUT.split(", "))])


def _ends(rows: DataFrame) -> DataFrame:
    """key and ends_sha256 of nodes whose ends lie in several shards: their texts in order, one after the other."""

    def run(batches):
        at, held, done = None, None, {"key": [], "ends_sha256": []}

        def close():
            if at is not None:
                done["key"].append(at)
                done["ends_sha256"].append(held.hexdigest())

        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if key != at:
                    close()
                    at, held = key, hashlib.sha256()
                else:
                    held.update(b",")
                held.update(text.encode())
        close()
        yield pa.RecordBatch.from_pydict(done, pa.schema([("key", pa.binary()), ("ends_sha256", pa.string())]))

    rows = rows.repartition("key").sortWithinPartitions("key", "shard", "slot").select("key", "ends")
    return rows.mapInArrow(freeing(run), "key binary, ends_sha256 string")


def nodes(convs: DataFrame) -> DataFrame:
    """The nodes of the trie of conversations (conv_id, path, sizes, as from rebuilt), one row each.

    conv_id is the smallest member, parent_conv_id that of the parent (root: null), n_convs the members, n_children
    the children, n_leaves the childless nodes of the subtree, saved_tokens the sum over the subtree of (n_convs - 1)
    times the code points of a node's turn, ends_sha256 the digest of the ids of the conversations that end in the
    node, ascending and joined by commas. Without conversations there is no node, not even the root. conv_id must be
    unique; equal conversations are members of one node however many they are. A conversation is held as one row.
    """
    rows = convs.repartitionByRange("path", "conv_id").sortWithinPartitions("path", "conv_id").select("path", "sizes", "conv_id")
    first = staged(_folded(rows, lambda shard, row: shard.turns >= SHARD_TURNS, lambda shard, row: shard.add_conversation(*row)), "trie")
    finished, open_ = [], first
    while True:
        paths = open_.where(F.col("kind") == _PATH)
        n = paths.select("shard").distinct().count()
        if not n:
            break
        last = n <= FAN_IN
        paths = (paths.repartition(1) if last else paths.repartitionByRange(-(-n // FAN_IN), "shard")).sortWithinPartitions("shard", "slot")

        def full(shard, row, most=2 * FAN_IN):
            return len(shard.paths) >= most and row[2] == 0

        open_ = staged(_folded(paths.select("path", "parts", "slot"), full, lambda shard, row: shard.add_path(*row[:2]), last), "trie-merged")
        finished.append(open_.where(F.col("kind") == _FINISHED))
    done = first.where(F.col("kind") == _FINISHED)
    names = ["key", *_NODE_NAMES]
    if not finished:
        return done.select(_NODE_NAMES)
    # nodes with members in several shards: a few for each shard
    shared = finished[0]
    for more in finished[1:]:
        shared = shared.unionByName(more)
    shared = shared.drop("ends_sha256").join(_ends(first.where(F.col("kind") == _ENDS)), "key", "left")
    shared = staged(shared.withColumn("ends_sha256", F.coalesce("ends_sha256", F.sha2(F.lit(""), 256))).select("path", *names), "trie-shared")
    heads = shared.select(F.col("key").alias("path"), F.col("conv_id").alias("_parent"))
    whole = done.select("path", *names).unionByName(shared).join(heads, "path", "left")
    return whole.withColumn("parent_conv_id", F.coalesce("parent_conv_id", "_parent")).select(_NODE_NAMES)


ORACLE = f"""WITH {CRC32_SQL},
o AS (SELECT conv_id, list({{'role': coalesce(role, ''), 'text': coalesce(text, '')}} ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS v
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
c AS (SELECT o.*, {crc32_sql("hex(encode(conv_id::VARCHAR))")} % 6 AS h FROM o, crc_table),
w AS (SELECT c.conv_id, list_concat(coalesce(b.v, [])[1:c.h], c.v[c.h + 1:]) AS v FROM c LEFT JOIN o b ON b.conv_id = c.conv_id - (c.conv_id % 100 + 100) % 100),
p AS (SELECT conv_id, d, len(v) AS n, sha256(to_json(v[1:d])::VARCHAR) AS node, CASE WHEN d > 0 THEN sha256(to_json(v[1:d - 1])::VARCHAR) END AS up,
    CASE WHEN d > 0 THEN length(v[d].text) ELSE 0 END AS size FROM w, unnest(range(len(v) + 1)) AS u(d)),
m AS (SELECT node, any_value(up) AS up, any_value(d) AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(size) AS size,
    sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (d = n), '')) AS ends_sha256 FROM p GROUP BY node),
k AS (SELECT up AS node, count(*) AS n_children FROM m WHERE up IS NOT NULL GROUP BY up),
s AS (SELECT p.node, count(*) FILTER (k.node IS NULL) AS n_leaves, sum((m.n_convs - 1) * m.size)::BIGINT AS saved_tokens
  FROM m LEFT JOIN k USING (node) JOIN p ON p.conv_id = m.conv_id AND p.d <= m.depth GROUP BY p.node)
SELECT m.conv_id, m.depth, u.conv_id AS parent_conv_id, m.n_convs, coalesce(n_children, 0) AS n_children, n_leaves, saved_tokens, m.ends_sha256
FROM m LEFT JOIN k ON k.node = m.node JOIN s ON s.node = m.node LEFT JOIN m u ON u.node = m.up"""
