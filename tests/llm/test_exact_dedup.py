"""op3 and op4 against brute force, and the parts they are made of."""

import hashlib
import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tallyroom.llm import _repeats, fingerprint_index, queries, suffixes


def brute_bytes(rows, window=100):
    first, out = {}, []
    texts = sorted({(d, (t or "").encode()) for d, t in rows if d is not None})
    for d, t in texts:
        for i in range(len(t) - window + 1):
            first.setdefault(t[i : i + window], (d, i))
    for d, t in rows:
        t = (t or "").encode()
        gone = [False] * len(t)
        for i in range(len(t) - window + 1 if d is not None else 0):
            if first[t[i : i + window]] < (d, i):
                gone[i : i + window] = [True] * window
        kept = bytes(b for b, g in zip(t, gone, strict=True) if not g)
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((d, len(t), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def brute_words(rows, window=13):
    first, out = {}, []
    split = lambda t: re.findall(r"[^\x20\x09-\x0D]+", t or "")
    for d, t in rows:
        w = split(t)
        for i in range(len(w) - window + 1 if d is not None else 0):
            k = tuple(w[i : i + window])
            first[k] = min(first.get(k, d), d)
    for d, t in rows:
        w = split(t)
        gone = [False] * len(w)
        for i in range(len(w) - window + 1 if d is not None else 0):
            if first[tuple(w[i : i + window])] < d:
                gone[i : i + window] = [True] * window
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((d, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def rows():
    r = random.Random(3)
    vocabulary = ["th", "er", "on", "an", "ingly", "été", "über", "naïve", "a", "of,", "Zu."]
    prose = lambda n: " ".join(r.choice(vocabulary) + r.choice(vocabulary) for _ in range(n))
    passage, base = prose(60), prose(300)
    out = [(i, prose(r.randint(1, 120))) for i in range(20, 60)]
    out += [(i, prose(30) + " " + passage + "\n" + prose(20)) for i in range(60, 90)]
    out += [(i, base) for i in range(100, 120)]
    for i in range(120, 150):
        w = base.split(" ")
        w[r.randrange(300)] = "changed"
        out.append((i, " ".join(w)))
    out += [(200, None), (201, ""), (202, "a" * 500), (203, "ab" * 300), (204, "x " * 400), (205, base + " " + base), (206, " \t\n"), (207, "the same line\n" * 50)]
    out += [(100, base), (202, "a" * 500)]
    out += [(5, prose(4000)), (6, "tail")]
    return out


def test_bytes(spark, rows):
    docs = spark.createDataFrame([(t, d, 1) for d, t in rows], "text string, doc_id long, at int")
    got = suffixes.stripped(docs.repartition(5)).drop("kept").collect()
    assert sorted([tuple(r) for r in got], key=repr) == brute_bytes(rows)


def test_words(spark, rows):
    docs = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, length int").repartition(5)
    found = fingerprint_index.FingerprintIndex().add(docs)
    got = fingerprint_index.stripped(docs, found).drop("kept").collect()
    assert sorted([tuple(r) for r in got], key=repr) == brute_words(rows)


def test_batches_one_after_the_other(spark, rows):
    make = lambda some: spark.createDataFrame(some, "doc_id long, text string")
    old, mid, new = ([x for x in rows if x[0] in ids] for ids in (range(80), range(80, 130), range(130, 300)))
    index = fingerprint_index.FingerprintIndex(buckets=8)
    index.add(make(old))
    index.add(make(mid), make(old))
    docs = make(new)
    found = index.add(docs, make(old + mid))
    got = fingerprint_index.stripped(docs, found).drop("kept").collect()
    expected = [x for x in brute_words(rows) if x[0] in range(130, 300)]
    assert sorted([tuple(r) for r in got], key=repr) == expected
    assert index.runs.count() == 8


@pytest.mark.parametrize("operator", [lambda d: suffixes.stripped(d), lambda d: fingerprint_index.stripped(d, fingerprint_index.FingerprintIndex().add(d))])
def test_empty_table_and_null_ids(spark, operator):
    assert operator(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    got = operator(spark.createDataFrame([(None, "word " * 60), (None, "word " * 60), (1, None)], "doc_id long, text string")).collect()
    assert [r.n_removed for r in got] == [0, 0, 0]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.binary(min_size=6, max_size=6).map(lambda b: bytes(x % 3 for x in b)), max_size=30))
def test_blind_trie_orders_and_groups(strings):
    leaves = suffixes.blind_trie(strings)
    assert [strings[leaf[0]] for leaf in leaves] == sorted(set(strings))
    assert all({strings[i] for i in leaf} == {strings[leaf[0]]} for leaf in leaves)
    assert sorted(i for leaf in leaves for i in leaf) == list(range(len(strings)))


def test_colliding_hashes_remove_nothing(monkeypatch):
    monkeypatch.setattr(fingerprint_index, "grams", lambda h, n: np.zeros(max(0, len(h) - n + 1), np.uint64))
    texts = [b" ".join(b"w%d" % (i + j) for j in range(14)) for i in (0, 1, 50)]
    which, place = fingerprint_index.repeats(np.zeros(3, int), np.array([1, 2, 3]), np.zeros(3, int), texts)
    assert (which.tolist(), place.tolist()) == ([1], [0])


@pytest.mark.parametrize("operator,brute", [(lambda d: suffixes.stripped(d), brute_bytes), (lambda d: fingerprint_index.stripped(d, fingerprint_index.FingerprintIndex().add(d)), brute_words)])
def test_hot_signatures_give_the_same(spark, rows, monkeypatch, operator, brute):
    monkeypatch.setattr(_repeats, "HOT", 3)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert sorted([tuple(r) for r in operator(docs).drop("kept").collect()], key=repr) == brute(rows)


def test_hot_signatures_in_batches(spark, rows, monkeypatch):
    monkeypatch.setattr(_repeats, "HOT", 3)
    test_batches_one_after_the_other(spark, rows)


@pytest.mark.parametrize("units", [_repeats.Units(False, suffixes.WINDOW, suffixes.GRAM), fingerprint_index.UNITS])
def test_a_shared_passage_does_not_meet_under_one_signature(spark, monkeypatch, units):
    monkeypatch.setattr(_repeats, "HOT", 20, raising=False)
    r = random.Random(9)
    prose = lambda n: " ".join("w%d" % r.randrange(10**6) for _ in range(n))
    passage = prose(60)
    docs = spark.createDataFrame([(i, prose(20) + " " + passage + " " + prose(20)) for i in range(600)], "doc_id long, text string").coalesce(1)
    found = _repeats.recurring(_repeats.fingerprints(docs, units, 8), 8).where("run IS NULL")
    cut = _repeats.contexts(docs, found.select("doc_id", "at", "length", "signature"), units).where("text IS NOT NULL")
    assert max(r["count"] for r in cut.groupBy("signature").count().collect()) <= 20


def test_history_needs_the_older_documents(spark):
    docs = spark.createDataFrame([(1, "word " * 60)], "doc_id long, text string")
    index = fingerprint_index.FingerprintIndex(buckets=8)
    index.add(docs)
    with pytest.raises(ValueError):
        index.add(docs.selectExpr("doc_id + 1 AS doc_id", "text"))


def test_texts_that_repeat_themselves(spark):
    """Periods from 1 to 99 at lengths from 100 to 300: windows of one run of signatures may be equal."""
    r = random.Random(11)
    rows = [(1, "are " * 30), (2, "a" * 120)]
    for period in range(1, 100):
        unit = "".join(r.choice("abcdefghij ") for _ in range(period))
        for length in (100, 101, 100 + period, 101 + period, 150, 168, 300):
            rows.append((len(rows) + 1, ("%d|" % len(rows)) + (unit * 300)[:length] + "|"))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert sorted([tuple(x) for x in suffixes.stripped(docs).drop("kept").collect()], key=repr) == brute_bytes(rows)


@pytest.mark.parametrize("query,brute", [("op3_suffixes", brute_bytes), ("op4_fingerprints", brute_words)])
def test_queries_by_brute_force(spark, query, brute):
    sf = "/root/testdata/sf0.001"
    rows = [(x.doc_id, x.text) for x in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted([tuple(x) for x in queries.QUERIES[query](spark, sf).collect()], key=repr) == brute(rows)


@pytest.mark.parametrize("operator,brute", [(suffixes.stripped, brute_bytes), (fingerprint_index.deduplicated, brute_words)])
def test_a_passage_of_every_document_meets_in_small_groups(spark, monkeypatch, operator, brute):
    """One passage, shorter than a window and longer than one, in all documents: no group of a key grows with them."""
    monkeypatch.setattr(_repeats, "HOT", 16)
    r = random.Random(12)
    prose = lambda n: " ".join("w%d" % r.randrange(10**6) for _ in range(n))
    short, long = prose(10), prose(40)
    sizes = []
    whole = _repeats.contexts

    def watched(*args):
        cut = whole(*args)
        sizes.append(max([0, *(x["count"] for x in cut.where("text IS NOT NULL").groupBy("signature").count().collect())]))
        return cut

    monkeypatch.setattr(_repeats, "contexts", watched)
    monkeypatch.setattr(fingerprint_index, "contexts", watched)
    for n in (100, 400):
        rows = [(i, prose(15) + " " + short + " " + prose(15) + " " + long + " " + prose(15)) for i in range(n)]
        docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
        assert sorted([tuple(x) for x in operator(docs).drop("kept").collect()], key=repr) == brute(rows)
    assert max(sizes) <= 16


def test_equal_windows_of_many_batches(spark, monkeypatch, rows):
    """Windows that many batches hold don't meet in one task, and come out the same."""
    monkeypatch.setattr(_repeats, "HOT", 2)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(12)
    for operator, brute in ((suffixes.stripped, brute_bytes), (fingerprint_index.deduplicated, brute_words)):
        assert sorted([tuple(x) for x in operator(docs).drop("kept").collect()], key=repr) == brute(rows)


def test_extra_columns_and_dotted_names(spark):
    text = "word " * 60
    docs = spark.createDataFrame([(1, text, 0, "x"), (2, text, 1, None)], "doc_id long, text string, `starts` int, `a.b` string")
    assert [r.n_removed for r in sorted(suffixes.stripped(docs).collect())] == [295, 300]
    assert [r.n_removed for r in sorted(fingerprint_index.deduplicated(docs).collect())] == [0, 60]
