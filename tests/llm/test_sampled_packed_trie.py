import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tallyroom.llm import packing, prefix_trie, resampling

PATH = public_tokenizers.path("word_bpe_49k.json")
LONG = "word. " * 30_000 + "x" * 5000
TEXTS = [
    None, "", " ", "One two, THREE thrée three's 42!", "Ünï 日本語 a-b", "the " * 25, "the " * 25, LONG, "\x00a\x01b", "don't 'twas they're '' 's's ''ll I'd",
    "x" * 70 + " " + "y" * 300, "one two three four five six seven eight nine ten eleven twelve a b c d e f g h i j",
]


def frame(spark, rows=tuple(enumerate(TEXTS))):
    return spark.createDataFrame([(i, t, "s", 1, 2) for i, t in rows], "doc_id long, text string, weight string, rank int, bucket int")


def drawn(docs, target, percent=10, least=20, buckets=10_000, orders=1):
    def features(text):
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", low)
        return len(words), [" ".join(words[i : i + k]) for k in range(1, orders + 1) for i in range(len(words) - k + 1)]

    def counts(texts):
        return Counter(zlib.crc32(f.encode()) % buckets for t in texts for f in features(t)[1])

    s, t = counts(x for _, x in docs), counts(target)
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (s.total() + buckets) / ((s[b] + 1) * (t.total() + buckets)))) for b in s}
    rows = []
    for i, text in docs:
        words, held = features(text)
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[zlib.crc32(f.encode()) % buckets] for f in held)
        rows.append([words >= least, i, len(held), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))])
    able = sorted((r for r in rows if r[0]), key=lambda r: (-r[4], r[1] is not None, r[1]))[: percent * sum(r[0] for r in rows) // 100]
    place = {id(r): n for n, r in enumerate(able, 1)}
    return sorted(((*r[1:], place.get(id(r))) for r in rows), key=repr)


@pytest.mark.parametrize("orders,percent", [(1, 10), (1, 60), (2, 100), (3, 50)])
def test_resampled(spark, orders, percent):
    docs = [*enumerate(TEXTS), (None, "a " * 30), (3, "One two, THREE")]
    docs += [(100 + i, f"{'alpha beta gamma ' * (i % 9)} {i} Some more Words") for i in range(300)]
    target = ["alpha beta", None, "words of THREE"]
    got = resampling.resampled(frame(spark, docs), spark.createDataFrame([(t, 1) for t in target], "text string, doc_id int"), percent, orders=orders, least_words=10)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert sorted(map(tuple, got.collect()), key=repr) == drawn(docs, target, percent, 10, orders=orders)


def test_resampled_empty_tables_and_repeated_rows(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert resampling.resampled(none, none).count() == 0
    got = resampling.resampled(frame(spark, [(7, "a b c")] * 6), none, 50, least_words=3).collect()
    assert sorted(r["rank"] or 0 for r in got) == [0, 0, 0, 1, 2, 3] and {r["n_features"] for r in got} == {3}


@settings(max_examples=100, deadline=None)
@given(st.lists(st.binary(max_size=90), max_size=40))
def test_checksums(parts):
    data = np.frombuffer(b"".join(parts), np.uint8)
    lengths = np.array([len(p) for p in parts if p], np.int64)
    got = resampling.crc_of_spans(data, np.cumsum(lengths) - lengths, lengths)
    assert got.tolist() == [zlib.crc32(p) for p in parts if p]


@pytest.fixture(scope="module")
def both():
    library = Tokenizer.from_file(PATH)
    library.no_truncation()
    library.no_padding()
    with open(PATH, encoding="utf-8") as f:
        return packing.Encoder(f.read()), library


def same(both, texts):
    own, library = both
    assert [ids.tolist() for ids in own.encode(texts)] == [library.encode(t, add_special_tokens=False).ids for t in texts]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.text(max_size=60), st.text("'sdmtrevl Abé1\n", max_size=60)), max_size=5))
def test_ids(both, texts):
    same(both, texts)


def test_ids_of_every_kind(both, monkeypatch):
    same(both, [t or "" for t in TEXTS] + ["a <|endoftext|> b", "<|endoftext|>", "İSTANBUL J̌ ﬁne"])
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    same(both, ["".join(f"a{chr(c)} " for c in points[i : i + 20_000]) for i in range(0, len(points), 20_000)])
    monkeypatch.setattr(packing, "CHARS", 50)
    monkeypatch.setattr(packing, "CACHE_PIECES", 5)
    same(both, [t or "" for t in TEXTS])


def cheapest(n, docs, sentences, size, sentence, other):
    """Least cost over all choices of places, without the free cut of the rest."""
    cost = {p: sentence for p in sentences} | dict.fromkeys(docs, 0) | {0: 0, n: 0}
    best = {0: 0}
    for p in sorted(cost)[1:]:
        best[p] = min(best[q] + (0 if (p - q).bit_count() == 1 else size - (p - q)) + cost[p] + packing.FEW for q in best if p - q <= size)
    return best[n]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 30), min_size=1, max_size=40), st.randoms())
def test_cuts_are_the_cheapest(steps, random):
    places = np.cumsum(steps).tolist()
    n = places[-1]
    docs = sorted({p for p in places if random.random() < 0.3} | {n})
    sentences = [p for p in places if p not in docs]
    got = packing.cuts(n, np.array(docs), np.array(sentences, np.int64), 32, 3, 9).tolist()
    lengths = np.diff([0, *got])
    assert got[-1] == n and (lengths > 0).all() and lengths.max() <= 32
    cost = sum((0 if int(k).bit_count() == 1 else 32 - int(k)) + packing.FEW for k in lengths)
    cost += sum(0 if p in docs else 3 if p in sentences else 9 for p in got)
    assert cost <= cheapest(n, docs, sentences, 32, 3, 9)


def check_packed(rows, docs, library, size=2048):
    ids = defaultdict(list)
    for i, t in docs:
        ids[i].append([*library.encode(t or "", add_special_tokens=False).ids, 1])
    pieces, windows = defaultdict(list), defaultdict(list)
    for r in rows:
        held = np.frombuffer(r["ids"], "<u4").tolist()
        assert len(held) == r["length"] > 0
        pieces[r["doc_id"]].append((r["start"], held, r["doc_tokens"]))
        windows[r["sequence_id"]].append((r["offset"], r["length"]))
    assert pieces.keys() == ids.keys()
    for i, held in pieces.items():
        want = ids[i]
        assert sorted(x for _, p, _ in held for x in p) == sorted(x for w in want for x in w)
        for start, p, total in held:
            assert any(len(w) == total and w[start : start + len(p)] == p for w in want)
    for held in windows.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= size
    lengths = [sum(n for _, n in held) for held in windows.values()]
    return sum(0 if n.bit_count() == 1 else size - n for n in lengths) / sum(lengths)


def test_packed(spark, both, monkeypatch):
    docs = [*enumerate(TEXTS), (None, "No id."), (3, "Repeated id. Here."), (3, "Repeated id. Here.")]
    docs += [(100 + i, f"A sentence of some words {i}. " * (i % 50) + "and no end") for i in range(200)]
    df = frame(spark, docs)
    got = packing.packed(df.coalesce(2), PATH)
    assert got.columns == ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]
    assert check_packed(got.collect(), docs, both[1]) < 0.02
    assert packing.packed(df.limit(0), PATH).count() == 0
    # a small size, and one that is no power of two
    check_packed(packing.packed(df.coalesce(1), PATH, size=100).collect(), docs, both[1], 100)


def test_long_documents_are_cut_at_blocks(both, monkeypatch):
    monkeypatch.setattr(packing, "BLOCK", 1000)
    ids = np.arange(5, 2505, dtype=np.uint16) % 1000
    parts = list(packing._segments("k", ids))
    assert [(p[1], len(p[2]), p[3]) for p in parts] == [(0, 1000, 2500), (1000, 1000, 2500), (2000, 500, 2500)]


def trie(rows, heads=6):
    held = defaultdict(list)
    for c, t, r, x, *_ in rows:
        if c is not None:
            held[c].append((t is not None, t or 0, r or "", x or ""))
    own = {c: [(r, x) for _, _, r, x in sorted(v)] for c, v in held.items()}
    whole = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % heads
        whole[c] = own.get(c - c % 100, [])[:h] + v[h:]
    members, children = defaultdict(list), defaultdict(set)
    for c, v in whole.items():
        for d in range(len(v) + 1):
            members[tuple(v[:d])].append(c)
    for k in members:
        if k:
            children[k[:-1]].add(k)
    leaves, saved = Counter(), Counter()
    for k, m in members.items():
        for d in range(len(k) + 1):
            saved[k[:d]] += (len(m) - 1) * len(k[-1][1]) if k else 0
            leaves[k[:d]] += k not in children
    out = []
    for k, m in members.items():
        ends = ",".join(str(c) for c in sorted(m) if len(whole[c]) == len(k))
        out.append((min(m), len(k), min(members[k[:-1]]) if k else None, len(m), len(children.get(k, ())), leaves[k], saved[k], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def turns(seed):
    import random

    rng = random.Random(seed)
    rows = [(None, 0, "user", "nobody", 1), (100, None, None, None, 2), (100, None, "user", "also first", 2), (100, 1, "user", "x퟿日本", 2), (-3, 0, "user", "minus", 0)]
    rows += [(100, 7, "user", "twice", 2)] * 2
    for c in range(250):
        if c % 100 or c == 0:
            rows += [(c, t, rng.choice(("user", "bot")), rng.choice(("a", "bb", "", "long text " * 50)), c) for t in range(rng.choice((1, 2, 3, 7)))]
    # equal conversations, and one with many turns
    rows += [(c, t, "user", "same", 3) for c in range(300, 400) for t in range(8)]
    return rows + [(450, t, "user", f"{t} " * (t % 3), 4) for t in range(300)]


@pytest.mark.parametrize("shard,fan", [(1 << 17, 512), (60, 4)])
def test_trie(spark, monkeypatch, shard, fan):
    monkeypatch.setattr(prefix_trie, "SHARD_TURNS", shard)
    monkeypatch.setattr(prefix_trie, "FAN_IN", fan)
    rows = turns(1)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, depth long")
    got = prefix_trie.nodes(prefix_trie.rebuilt(df))
    assert sorted(map(tuple, got.collect()), key=repr) == trie(rows)


def test_trie_of_nothing(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert prefix_trie.nodes(prefix_trie.rebuilt(df)).count() == 0
    df = spark.createDataFrame([(5, 0, "user", "gone")], df.schema)  # its first turns are those of a conversation that isn't there
    assert [tuple(r) for r in prefix_trie.nodes(prefix_trie.rebuilt(df)).collect()] == trie([(5, 0, "user", "gone")])


@given(st.lists(st.lists(st.integers(0, 5), max_size=5), max_size=30))
def test_search_trees(paths):
    tree = prefix_trie.Tree()
    paths = sorted(set(map(tuple, paths)))
    order = list(prefix_trie._medians(len(paths)))
    assert sorted(order) == list(range(len(paths)))
    found = {paths[i]: tree.insert(list(paths[i])) for i in order}
    assert len(tree.turn) == len({p[:d] for p in paths for d in range(len(p) + 1)} | {()})
    for p, node in found.items():
        back = []
        while node > 0:
            back.append(tree.turn[node])
            node = tree.parent[node]
        assert tuple(back[::-1]) == p


def test_texts_beyond_a_chunk(spark, both):
    """Read whole, and packed across the blocks that their ids are laid in."""
    docs = [(1, "Some words of one sentence. " * 60_000), (2, "short"), (3, "x" * 1_200_000 + " end")]
    df = frame(spark, docs)
    got = resampling.resampled(df, df.where("doc_id = 2"), 100, least_words=1)
    assert sorted(map(tuple, got.collect()), key=repr) == drawn(docs, ["short"], 100, 1)
    rows = packing.packed(df.where("doc_id < 3").coalesce(1), PATH).collect()
    assert check_packed(rows, docs[:2], both[1]) < 0.01 and max(r.doc_tokens for r in rows) == 360_001 > packing.BLOCK
