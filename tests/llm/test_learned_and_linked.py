"""op1, op2, op7 and op10 on small fixtures and against brute force."""

import random
import re

import numpy as np
import pytest

from tallyroom.llm import decontaminate, neardup, quality, toxicity
from tests.llm import brute


def prose(r, n):
    parts = ["th", "er", "on", "an", "ing", "re", "st", "ou"]
    return " ".join(r.choice(parts) + r.choice(parts) + r.choice(["", "s", "ly."]) for _ in range(n))


# toxicity


@pytest.fixture(scope="module")
def toxic(spark):
    r = random.Random(5)
    bad = ["zibblot", "crandoof", "mukwump"]
    rows, labels = [], []
    for i in range(600):
        t = prose(r, r.randint(5, 80)).split(" ")
        if i % 5 == 0:
            t.insert(r.randrange(len(t)), r.choice(bad))
        rows.append((i, " ".join(t)))
        labels.append((i, int(i % 5 == 0)))
    rows += [(1000, "thon zibbl.ot ering"), (1001, "z i b b l o t"), (1002, "Cr4nd00f here"), (1003, "muk-wump"), (1004, None), (1005, ""), (1006, "on an er"), (None, "mukwump"), (1000, "thon zibbl.ot ering")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame(labels, "doc_id long, toxic int")
    return docs, labels, toxicity.trained(docs, labels, landmarks=8)


def test_gapped_and_inserted_characters(toxic):
    docs, _, machine = toxic
    got = {}
    for r in toxicity.scored(docs, machine).collect():
        got.setdefault(r.doc_id, r)
    held = [r for i, r in got.items() if i is not None and i < 1000 and r.held_out]
    assert len(held) > 100 and np.mean([r.predicted == (r.doc_id % 5 == 0) for r in held]) > 0.98
    assert all(got[i].predicted == 1 for i in (1000, 1001, 1002, 1003, None)) and all(got[i].predicted == 0 for i in (1004, 1005, 1006))
    assert not got[None].held_out


def test_clean_keeps_columns_and_rows(spark, toxic):
    docs, _, machine = toxic
    some = docs.selectExpr("doc_id", "doc_id AS score", "text")
    kept = toxicity.clean(some, machine)
    assert kept.columns == some.columns and {1004, 1005, 1006} <= {r.doc_id for r in kept.collect()} and not {1000, 1001} & {r.doc_id for r in kept.collect()}


def test_kernel_by_brute_force():
    kernel = toxicity.Kernel.of(["idiot", "clowns"])

    def features(word):
        out = {}
        c = [x for x in toxicity.codes_of(np.frombuffer(word.encode(), np.uint8)) if x]
        for i in range(len(c)):
            for a, b in toxicity._SKIPS:
                if i + a + b < len(c) and c[i] and c[i + a] and c[i + a + b]:
                    k = (c[i], c[i + a], c[i + a + b])
                    out[k] = out.get(k, 0) + 0.5 ** (a + b - 2)
        return out

    for word in ("idiot", "i.d.i.o.t", "i--d--i--o--t", "1...d!!i0t", "idxiot", "clown", "other", "naïve", "дурак"):
        w = features(word)
        norm = sum(x * x for x in w.values()) ** 0.5  # no triple occurs twice in these
        expected = []
        for landmark in ("idiot", "clowns"):
            m = features(landmark)
            k = sum(x * m.get(t, 0) for t, x in w.items()) / max(norm, 1e-9) / sum(x * x for x in m.values()) ** 0.5
            expected.append(k if k >= toxicity.FLOOR else 0)
        raw = np.frombuffer(word.encode(), np.uint8)
        assert np.allclose(kernel.of_texts(raw, np.array([0, len(raw)]))[0], expected, atol=1e-5)


def test_other_scripts_and_signs():
    kernel = toxicity.Kernel.of(["idiot", "дурак", "馬鹿野郎"])
    words = ["i--d--i--o--t", "дурак", "д.у.р.а.к", "привет", "馬鹿野郎", "日本語文"]
    raw = [w.encode() for w in words]
    got = kernel.of_texts(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
    assert np.allclose([got[0, 0], got[1, 1], got[2, 1], got[4, 2]], 1) and not got[3].any() and not got[5].any()
    assert toxicity.unlike(["idiot", "idiots", "clown", "idiotic", "trash"], 3) == ["idiot", "clown", "trash"]


@pytest.mark.parametrize("module,label", [(toxicity, "toxic"), (quality, "quality")])
def test_one_class_and_no_rows(spark, module, label):
    docs = spark.createDataFrame([(i, "some words here") for i in range(40)], "doc_id long, text string")
    ones = spark.createDataFrame([(i, 1) for i in range(40)], f"doc_id long, {label} int")
    assert module.trained(docs, ones) == 1.0 and module.trained(docs, ones.limit(0)) == 0.0
    assert {r.score for r in module.scored(docs, 1.0).collect()} == {1.0}
    assert module.scored(docs.limit(0), 0.0).count() == 0


# quality


def test_quality(spark):
    r = random.Random(6)
    rows = []
    for i in range(700):
        t = prose(r, r.randint(10, 300))
        if i % 4 == 0:
            t = re.sub(" ", "### ", t)
        rows.append((i, t, int(i % 4 != 0)))
    docs = spark.createDataFrame([x[:2] for x in rows] + [(900, None), (901, ""), (None, "thon er")], "doc_id long, text string")
    net = quality.trained(docs, spark.createDataFrame([(x[0], x[2]) for x in rows], "doc_id long, quality int"))
    got = quality.scored(docs, net).collect()
    held = [x for x in got if x.held_out and x.doc_id < 700]
    assert len(got) == 703 and len(held) > 90 and np.mean([(x.score >= 0.5) == (x.doc_id % 4 != 0) for x in held]) > 0.98
    assert all(0 <= x.score <= 1 for x in got)


def test_attention_by_brute_force():
    """Passages of two texts, encoded, weighed and scored without arrays."""
    from math import exp, sqrt, tanh

    texts = ["thon er ing " * 50, "Re### st ou 12 thon", ""]
    raw = [t.encode() for t in texts]
    data, offsets = np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])
    held, at = quality.read(data, offsets)
    x, at2 = quality.passages(data, offsets)
    assert at.tolist() == at2.tolist() == [0, 3, 4, 5]
    for i, (doc, k) in enumerate([(0, 0), (0, 1), (0, 2), (1, 0)]):
        words = texts[doc].split()[k * quality.PASSAGE_WORDS : (k + 1) * quality.PASSAGE_WORDS]
        alone, _ = quality.read(np.frombuffer(" ".join(words).encode(), np.uint8), np.array([0, len(" ".join(words))]))
        counts = [0] * quality.BUCKETS
        for b in alone.words.tolist():
            counts[b] += 1
        assert np.allclose(x[i, quality.SURFACE :], [sqrt(c / len(words)) for c in counts])
    assert not x[4, quality.SURFACE :].any() and np.allclose(held.spread()[0], x.mean(axis=0)) and np.allclose(held.spread()[1], x.std(axis=0))
    net = quality.fitted(held, at, np.array([1.0, 0.0, 1.0]), epochs=3)
    p = {k: v.tolist() for k, v in net.p.items()}
    dot = lambda a, b: sum(u * v for u, v in zip(a, b, strict=True))
    columns = lambda m: list(zip(*m, strict=True))
    expected = []
    for a, b in zip(at[:-1], at[1:], strict=True):
        encoded, weights = [], []
        for row in x[a:b].tolist():
            z = [(v - m) / s for v, m, s in zip(row, net.mean.tolist(), net.scale.tolist(), strict=True)]
            e = [tanh(dot(z, w) + c) for w, c in zip(columns(p["W"]), p["b"], strict=True)]
            gate = [tanh(dot(e, v)) / (1 + exp(-dot(e, u))) for v, u in zip(columns(p["V"]), columns(p["U"]), strict=True)]
            encoded.append(e)
            weights.append(exp(dot(gate, p["w"])))
        whole = [dot(weights, c) / sum(weights) for c in columns(encoded)]
        expected.append(1 / (1 + exp(-dot(whole, p["c"]) - p["d"])))
    assert np.allclose(net.scores(x, at), expected)


def test_attention_gradient():
    r = np.random.default_rng(1)
    x, at, y = r.normal(size=(9, quality.FEATURES)), np.array([0, 2, 3, 9]), np.array([1.0, 0.0, 1.0])
    net = quality.fitted(x, at, y, epochs=1)
    grad = net.gradient(x, at, y, np.ones(3))

    def loss():
        p = net.scores(x, at)
        return -np.mean(y * np.log(p) + (1 - y) * np.log(1 - p))

    for k in ("W", "V", "U", "w", "c", "b"):
        i = (0,) * net.p[k].ndim
        old = net.p[k][i]
        net.p[k][i] = old + 1e-5
        up = loss()
        net.p[k][i] = old - 1e-5
        down = loss()
        net.p[k][i] = old
        assert abs((up - down) / 2e-5 - grad[k][i]) < 1e-6


# decontamination

ITEM = "A train leaves Lyon with 120 people and travels 300 km to meet Anna while the other 45 people stay behind with Bob at noon today"


def test_templates(spark):
    item = ITEM
    again = item.replace("120", "77").replace("300", "12.5").replace("Anna", "Wendy").replace("Bob", "Karl").replace("Lyon", "Rome").replace("45", "8").replace("km", "miles")
    twice = "Mr says that Anna met Anna while the red cat saw Bob run home again late"
    docs = [
        (1, "before it " + item + " and after"), (2, again), (3, item[: len(item) // 2]), (4, "no such thing at all here now"), (5, None), (6, ""), (None, item),
        (7, twice.replace("Anna", "Wendy")), (8, twice.replace("Anna", "Wendy", 1)), (9, "1 2 3 4 5 6 7 8 9"), (10, "short item"), (1, "before it " + item + " and after"),
    ]
    bench = [(1, item), (2, twice), (3, "Short item"), (4, None), (5, "1 2 3 4 5 6 7"), (None, "x y z"), (1, item)]
    docs = spark.createDataFrame([(d, t, 0) for d, t in docs], "doc_id long, text string, window int")
    bench = spark.createDataFrame(bench, "item_id long, text string")
    got = sorted(((r.doc_id, tuple(r.item_ids)) for r in decontaminate.judged(docs, bench).collect()), key=repr)
    assert got == sorted([(1, (1,)), (1, (1,)), (2, (1,)), (3, ()), (4, ()), (5, ()), (6, ()), (None, ()), (7, (2,)), (8, ()), (9, (5,)), (10, (3,))], key=repr)
    kept = decontaminate.clean(docs, bench)
    assert kept.columns == docs.columns and sorted([r.doc_id for r in kept.collect()], key=repr) == sorted([3, 4, 5, 6, None, 8], key=repr)
    assert decontaminate.judged(docs.limit(0), bench).count() == 0 and not any(r.contaminated for r in decontaminate.judged(docs, bench.limit(0)).collect())


def test_full_filter_gives_the_same(spark, monkeypatch):
    """A filter so small that it lets everything pass: the join decides."""
    docs = spark.createDataFrame([(1, ITEM), (2, "other words that do not match at all")], "doc_id long, text string")
    bench = spark.createDataFrame([(1, ITEM)], "item_id long, text string")
    monkeypatch.setattr(decontaminate, "FILTER_BITS", 4)
    assert [(r.doc_id, r.item_id, r.share) for r in decontaminate.leaks(docs, bench).collect()] == [(1, 1, 1.0)]


APPLES = "Anna has 5 apples in her bag. Bob gives her 3 apples on Monday. How many apples does Anna have now?"


def shares(spark, item, *texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.share for r in decontaminate.leaks(docs, spark.createDataFrame([(1, item)], "item_id long, text string")).collect()}
    return [got.get(i, 0) for i in range(len(texts))]


def test_names_at_openings_and_of_two_words(spark):
    other = APPLES.replace("Anna", "Wendy").replace("Bob", "Karl").replace("5", "9").replace("3", "4")
    long = APPLES.replace("Anna", "Mary Ann Smith").replace("Bob", "Old Karl")
    clean = "Anna sold 5 pears at the fair. Bob took 3 of them home on Monday. How late was it when Anna came back?"
    assert shares(spark, APPLES, APPLES, APPLES.lower().replace("anna", "Anna").replace("monday", "Monday"), other, long, "He said: " + other, clean) == [1, 1, 1, 1, 1, 0]
    assert shares(spark, long, APPLES, other, long) == [1, 1, 1]
    item = "the ship from Rome to Oslo takes nine hours while the one that Anna built for Bob, Carl and the rest is slow"
    assert shares(spark, item, item.replace("Rome", "New York"), item.replace("Bob, Carl", "Karl, Old Ben")) == [1, 1]
    # few words, fewer when the name is one of two words
    assert shares(spark, "Anna Smith swims very well", "Karl swims very well", "Anna Smith swims very well", "Karl swims rather well") == [1, 1, 0]


def test_slots_that_turn_into_several_values(spark):
    item = "a boat takes 2 hours to cross the lake and then 3 hours to come back while the tea costs 4 litres of water"
    assert shares(spark, item, item.replace("2 hours", "1 hour").replace("4 litres", "1 liter"), item.replace("3 hours", "90 minutes")) == [1, 1]
    item = "she puts 5 apples on the table for her 5 friends and asks what is left when all of them ate one"
    assert shares(spark, item, item.replace("5 apples", "7 apples").replace("5 friends", "3 friends"), item.replace("5 friends", "6 friends")) == [1, 1]
    # numbers of which most don't follow, and a name that doesn't, count against the windows that hold them
    item = "we saw 4 cats and then 4 dogs and then 4 cows and then all of them went home to their small and warm beds"
    some = shares(spark, item, item.replace("4 cats", "5 cats").replace("4 dogs", "6 dogs").replace("4 cows", "7 cows"))
    assert some == [0]
    item = "the man who told Anna about the old house on the hill that no one from here wants to buy said later to Anna that it was sold at last"
    assert shares(spark, item, item.replace("Anna", "Wendy", 1)) == [pytest.approx(21 / 26)]


def reworded(r, text):
    """An item with other numbers, names or units, or a few other words."""
    out = []
    for w in text.split(" "):
        bare = w.strip(".,?")
        if bare.isdigit() and r.random() < 0.7:
            w = w.replace(bare, str(r.randint(1, 99)))
        elif bare in NAMES and r.random() < 0.8:
            w = w.replace(bare, {n: NAMES[(i + 3) % len(NAMES)] for i, n in enumerate(NAMES)}[bare])
        elif bare in ("hours", "miles", "litres") and r.random() < 0.7:
            w = w.replace(bare, r.choice(["hour", "minutes", "km"]))
        elif r.random() < 0.03:
            w = "other" + w
        out.append(w)
    return " ".join(out)


NAMES = ["Anna", "Bob", "Carla", "Dimitri", "Eve", "Fred", "Mary Ann"]


def test_decontamination_by_brute_force(spark):
    r = random.Random(21)
    verbs = ["walks", "has", "sells", "needs", "gives", "counts", "finds"]
    things = ["apples", "stones", "hours", "miles", "litres", "birds of the forest", "3kg", "5.5 km"]
    sentence = lambda: f"{r.choice(NAMES)} {r.choice(verbs)} {r.randint(1, 99)} {r.choice(things)} {r.choice(['near', 'before', 'with'])} {r.choice(NAMES)}{r.choice(['.', ' and', ',', '?'])}"
    items = [(i, " ".join(sentence() for _ in range(r.randint(1, 6)))) for i in range(25)] + [(50, None), (51, "Two words"), (52, "1 2 3"), (None, "Anna has 1"), (3, "again the third with other words")]
    texts = [t for _, t in items if t]
    docs = [(i, r.choice(["", "Before. ", "intro\n", "It is said that "]) + reworded(r, r.choice(texts)) + r.choice(["", " After it", ". Then Bob left"])) for i in range(150)]
    docs += [(200, None), (201, ""), (202, " \n"), (None, texts[0]), (203, texts[0]), (203, texts[0]), (204, " ".join(texts)), (205, "Zoë " + texts[1] + " naïve. Été"), (206, texts[2] * 40)]
    expected = brute.leaks(docs, items)
    frame = lambda rows, name: spark.createDataFrame(rows, f"{name} long, text string").repartition(3)
    got = {(x.doc_id, x.item_id): x.share for x in decontaminate.leaks(frame(docs, "doc_id"), frame(items, "item_id")).collect()}
    assert {k: (got.get(k), expected.get(k)) for k in {*got, *expected} if got.get(k) != pytest.approx(expected.get(k))} == {}
    assert 40 < len({d for d, _ in got}) < 150


def test_columns_of_any_name_stay(spark, toxic):
    docs = spark.createDataFrame([(1, "some words here", "x", "y", 3.0), (2, None, None, "z", None)], "doc_id long, text string, `a.b` string, `c d` string, score double")
    none = spark.createDataFrame([], "item_id long, text string")
    for kept in (toxicity.clean(docs, 0.0), toxicity.clean(docs, toxic[2]), neardup.clean(docs), decontaminate.clean(docs, none)):
        assert kept.columns == docs.columns and sorted(map(tuple, kept.collect())) == sorted(map(tuple, docs.collect()))


def test_very_long_texts(spark, toxic):
    """Texts beyond a chunk: read whole."""
    long = "plain words " * 120_000
    docs = spark.createDataFrame([(1, long + "mukwump"), (2, long), (3, long + ITEM), (4, long.upper())], "doc_id long, text string")
    assert {x.doc_id: x.predicted for x in toxicity.scored(docs, toxic[2]).collect()} == {1: 1, 2: 0, 3: 0, 4: 0}
    assert {x.doc_id: x.contaminated for x in decontaminate.judged(docs, spark.createDataFrame([(1, ITEM)], "item_id long, text string")).collect()} == {1: False, 2: False, 3: True, 4: False}
    assert {x.doc_id: x.component_id for x in neardup.linked(docs).collect()} == {1: 1, 2: 2, 3: 3, 4: 2}


# near duplicates


def brute_links(rows):
    def shingles(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        return {tuple(w[i : i + 4]) for i in range(len(w) - 3)} if len(w) >= 4 else {tuple(w)} if w else set()

    sets = {d: shingles(t) for d, t in rows if d is not None}
    label = {d: d for d in sets}
    ids = sorted(sets)

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                label[y] = x
    return sorted([(d, len(sets[d]), root(d), root(d) == d) if d is not None else (None, len(shingles(t)), None, True) for d, t in rows], key=repr)


def test_components(spark):
    r = random.Random(8)
    base, passage = prose(r, 200).split(" "), prose(r, 30)
    rows = [(i, prose(r, r.randint(1, 60))) for i in range(30)] + [(i, passage + " " + prose(r, 100)) for i in range(30, 60)]
    for i in range(60, 160):
        w = list(base)
        for _ in range(r.randint(0, 7)):
            w[r.randrange(len(w))] = "new%d" % r.randrange(1000)
        rows.append((i, " ".join(w)))
    w = list(base)
    for i in range(160, 175):  # a chain whose ends are not similar
        w[(i - 160) * 11] = "link%d" % i
        rows.append((i, " ".join(w)))
    rows += [(200, None), (201, ""), (202, "one two"), (203, "ONE two"), (204, "one"), (205, " \n"), (None, "one two"), (60, rows[60][1]), (206, "a b c d"), (207, "A b c d")]
    docs = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, component_id int").repartition(4)
    got = sorted([tuple(x) for x in neardup.linked(docs).collect()], key=repr)
    assert got == brute_links(rows)
    kept = neardup.clean(docs)
    assert kept.columns == docs.columns and {x.doc_id for x in kept.collect()} == {x[0] for x in got if x[3]}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_links_near_the_threshold_are_found(spark, seed):
    """Recall against brute force on pairs around a similarity of 0.8, of 20 to 1500 words: none is lost."""
    r = random.Random(seed)
    words = lambda n: ["w%d" % r.randrange(10**6) for _ in range(n)]
    rows, linked = [], 0
    for n in (20, 60, 200, 600, 1500):
        for _ in range(40):
            base, share = words(n), words(30)
            other = list(base)
            for _ in range(max(1, round(n * r.uniform(0.02, 0.045)))):
                other[r.randrange(n)] = words(1)[0]
            rows += [(len(rows), " ".join(base)), (len(rows) + 1, " ".join(other)), (len(rows) + 2, " ".join(share + words(n)))]
    expected = brute.components(rows)
    got = {x.doc_id: x.component_id for x in neardup.linked(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    linked = sum(d != c for d, c in expected.items())
    assert got == expected and 40 < linked < 190


def test_no_rows_and_no_links(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert neardup.linked(none).count() == 0
    assert [tuple(x) for x in neardup.linked(spark.createDataFrame([(1, "a b c d e")], none.schema)).collect()] == [(1, 2, 1, True)]


def test_disguised_insults_in_a_plain_sentence(spark):
    """Each word that tells the class, with one letter put in, left out or doubled, is predicted where it stands alone."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    machine = toxicity.trained(docs, labels)
    insults = ["disgusting", "idiot", "worthless", "stupid", "loser", "pathetic", "clown", "moron", "trash"]
    forms = {v for w in insults for i in range(1, len(w)) for v in (w, w[:i] + "x" + w[i:], w[:i] + w[i + 1 :], w[:i] + w[i - 1 :], ".".join(w))}
    sentence = "the weather in the north was mild and he said that you are {} for all of it"
    rows = [(i, sentence.format(f)) for i, f in enumerate(sorted(forms))] + [(-1, sentence.format("late")), (-2, sentence.format("")), (-3, "")]
    got = {r.doc_id: r.predicted for r in toxicity.scored(spark.createDataFrame(rows, "doc_id long, text string"), machine).collect()}
    assert [t for i, t in rows if (i >= 0) != bool(got[i])] == []
