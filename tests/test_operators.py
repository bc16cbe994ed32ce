"""Operators on small fixtures, and every registered query that SQL can express against DuckDB."""

import random

import duckdb
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tallyroom import queries as registered
from tallyroom.functions import text as tx
from tallyroom.functions import values as vx
from tallyroom.operators import cases, evaluation, gates, governed, jobs, publication, retrieval, spans
from tallyroom.operators.governed import Dataset, Field, Refused
from tallyroom.plans import catalogs, questions
from tallyroom.sources import files, office
from tallyroom.streaming import events

SF = "/root/testdata/sf0.001"
SALES = Dataset({"order_amount": Field("decimal", aggregate=True), "region": Field("string"), "order_date": Field("date")})
ASKED = questions.Asked(SALES, {"order_amount": ("订单金额", "金额"), "region": ("地区", "区域"), "order_date": ("订单日期", "日期")})


@pytest.fixture(scope="module")
def sales(spark):
    regions = ["华东", "华南", "华北"]
    return spark.createDataFrame([(str((i + 1) * 10), regions[i % 3], f"2026-01-{i + 1:02d}") for i in range(12)], "order_amount string, region string, order_date string")


def test_aggregates_and_counts(spark, sales):
    row = governed.aggregated(SALES, sales, "avg", "order_amount", [("region", "eq", "华东"), ("order_date", "between", "2026-01-01", "2026-01-09")]).first()
    assert (row.aggregate_value, row.total_count, row.valid_count, row.null_count) == (40.0, 3, 3, 0)
    none = governed.aggregated(SALES, sales, "sum", "order_amount", [("region", "eq", "nowhere")]).first()
    assert none.aggregate_value is None and none.total_count == 0


@pytest.mark.parametrize("function,metric,filters", [
    ("median", "order_amount", []), ("sum", None, []), ("sum", "region", []), ("count", "unknown", []), ("count", None, [("unknown", "eq", "1")]), ("count", None, [("region", "gt", "1")]),
    ("count", None, [("order_amount", "gt", "x")]), ("count", None, [("order_amount", "gt", "NaN")]), ("count", None, [("order_date", "between", "2026-01-01")]), ("count", None, [("order_date", "eq", "2026-13-01")]),
])
def test_refusals(spark, sales, function, metric, filters):
    with pytest.raises(Refused):
        governed.aggregated(SALES, sales, function, metric, filters)


@pytest.mark.parametrize("question,outcome,value", [
    ("地区为华东且订单日期2026-01-01至2026-01-09，平均金额", "intent", 40.0), ("金额大于50，多少条", "intent", 7.0), ("金额总和", "intent", 780.0), ("金额最大且地区为华北", "intent", 120.0), ("地区=华南，金额不超过80，最小", "intent", 20.0),
    ("华东地区的平均金额", "intent", 55.0), ("统计华南地区的金额总和", "intent", 260.0), ("地区计数", "intent", 12.0), ("华东地区或华南地区的金额总和", "unavailable", None), ("地区的金额总和", "unavailable", None), ("华东地区和华南地区的金额总和", "unavailable", None), ("省份为浙江的金额总和", "unavailable", None),
    ("金额平均和总和", "clarification", None), ("地区为华东或华南的金额总和", "unavailable", None), ("重量大于5的金额总和", "unavailable", None), ("介绍一下制度", "unavailable", None), ("一共多少条", "intent", 12.0),
])
def test_questions(spark, sales, question, outcome, value):
    intents = questions.resolved(ASKED, spark.createDataFrame([(1, question)], "q_id int, question string"))
    assert intents.first().outcome == outcome
    got = questions.answers(ASKED, intents, sales).collect()
    assert [r.aggregate_value for r in got] == ([value] if outcome == "intent" else [])


def test_digest_is_independent_of_order(spark, sales):
    kinds = {"order_amount": "string", "region": "string", "order_date": "string"}
    a = publication.content_lanes(sales, kinds).first()
    assert a == publication.content_lanes(sales.repartition(7).orderBy(F.rand(3)), kinds).first()
    assert a != publication.content_lanes(sales.limit(11), kinds).first() and len(publication.content_hash(a)) == 64


def test_publication(spark, sales, tmp_path):
    rows = publication.typed(SALES, sales.withColumn("_row_number", F.monotonically_increasing_id() + 2), "_row_number").withColumns({"_source_id": F.lit("s"), "_dataset_id": F.lit("ds"), "_schema_version": F.lit(1).cast("long"), "_worksheet": F.lit("明细")})
    publisher = publication.Publisher(spark, f"file://{tmp_path}/store")
    assert publisher.publish("ds", SALES, rows).count() == 12 and publisher.publish("ds", SALES, rows.limit(5)).count() == 5
    active = publisher.active().collect()
    assert [(r.dataset_id, r.version, r.row_count) for r in active] == [("ds", 2, 5)]
    with pytest.raises(Exception):
        publisher.publish("ds", SALES, rows.withColumn("region", F.raise_error(F.lit("broken"))))
    assert publisher.read("ds").count() == 5


def test_rejected_cells(spark):
    cells = spark.createDataFrame([(2, "1.5", ""), (3, "x", "2026-01-01")], "n int, a string, d string")
    got = publication.bad_cells(Dataset({"a": Field("decimal"), "d": Field("date", null_policy="reject")}), cells, "n").orderBy("row_number").collect()
    assert [(r.row_number, r.column_name, r.problem) for r in got] == [(2, "d", "null_value_rejected"), (3, "a", "type_conversion_failed")] and got[1].sample.startswith("[redacted sha256:")
    assert publication.not_blank(spark.createDataFrame([("", None), (" ", "x")], "a string, b string"), ["a", "b"]).count() == 1


def test_merge_keeps_the_existing_hit_on_ties(spark):
    schema = "q_id int, source_id int, source_name string, chunk_index int, score double, tag string, rank int"
    a = spark.createDataFrame([(1, 1, "a", 0, 5.0, "old", 1), (1, 2, "b", 0, 4.0, "old", 2)], schema)
    b = spark.createDataFrame([(1, 1, "a", 0, 5.0, "new", 1), (1, 2, "b", 0, 4.5, "new", 2), (1, 3, "c", 1, 4.5, "new", 3)], schema)
    got = retrieval.merged(a, b).orderBy("rank").collect()
    assert [(r.source_id, r.tag, r.rank) for r in got] == [(1, "old", 1), (2, "new", 2), (3, "new", 3)]
    assert [r.again for r in retrieval.needs_more(a).collect()] == [True]


def test_retrieval_rounds(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "差旅票据应当在三十日内提交。材料齐全。"), (2, "密码不得外借。"), (3, None)], "doc_id long, text string")
    chunks = retrieval.chunked(docs).select(F.col("doc_id").alias("source_id"), F.concat(F.lit("s"), "doc_id").alias("source_name"), F.lit("文本").alias("source_type"), "chunk_index", "chunk")
    asked = spark.createDataFrame([(1, "差旅票据材料"), (2, "住房补贴多少")], "q_id int, question string")
    hits = retrieval.ranked(retrieval.hybrid_hits(asked, chunks))
    assert [(r.q_id, r.source_id) for r in hits.where("rank = 1").collect()] == [(1, 1)]
    assert retrieval.inspected(asked, hits, chunks).where("rank = 1").first().source_id == 1
    assert "[1] s1" in retrieval.answered(hits).first().context
    assert retrieval.broadened(asked).orderBy("q_id").first().question.startswith("差旅票据材料 ")
    monkeypatch.setattr(retrieval, "MATRIX_ROWS", 1)
    monkeypatch.setattr(retrieval, "MATRIX_CELLS", 1)
    assert retrieval.ranked(retrieval.hybrid_hits(asked, chunks)).count() == hits.count()


def test_postings_and_products_against_all_pairs(spark):
    rng = random.Random(5)
    words = ["票据", "差旅", "合同条款", "ab", "abc", "x_1", "材料"]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    vector = lambda: rng.choice([None, [], [1.0], [0.6, 0.8], [0.6, None, 0.8], [-1.0, 0.0, 0.0]])
    docs = [(i, f"s{i % 3}", "文本", i % 2, rng.choice((text(4), "", None)), vector()) for i in range(60)] * 2
    asked = [(i, rng.choice((text(2), text(1), "", None, "合同")), vector()) for i in range(15)]
    chunks = spark.createDataFrame(docs, "source_id int, source_name string, source_type string, chunk_index int, chunk string, vector array<double>")
    questions_ = spark.createDataFrame(asked, "q_id int, question string, asked array<double>")
    pairs = questions_.withColumn("terms", tx.search_terms(F.col("question"))).crossJoin(chunks).withColumn("hay", tx.haystack(F.col("source_name"), F.col("source_type"), F.col("chunk")))
    pairs = pairs.withColumns({"k": F.coalesce(tx.keyword_score(F.col("terms"), F.col("question"), F.col("hay")), F.lit(0)), "v": tx.dot(F.col("asked"), F.col("vector")), "m": F.array_sort(tx.matched(F.col("terms"), F.col("hay")))})
    row = lambda r: (r["q_id"], r["source_id"], r["k"], r["m"])
    got = retrieval.keyword_hits(questions_, chunks).select("q_id", "source_id", F.col("keyword_score").alias("k"), F.array_sort("matched_terms").alias("m"))
    assert sorted(map(row, got.collect())) == sorted(map(row, pairs.where("k > 0").collect()))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    for threshold in (2.2, 0.0, -1.0):
        want = pairs.where(retrieval.reliable(F.col("k") + 4 * F.col("v"), F.col("k"), F.col("v"), threshold))
        hits = retrieval.hybrid_hits(questions_, chunks, threshold)
        assert sorted((r["q_id"], r["source_id"], r["keyword_score"], round(r["score"], 9)) for r in hits.collect()) == sorted((r["q_id"], r["source_id"], r["k"], round(r["k"] + 4 * r["v"], 9)) for r in want.collect())
    assert "NestedLoop" not in hits._jdf.queryExecution().executedPlan().toString()
    none = spark.createDataFrame([], questions_.schema)
    assert retrieval.keyword_hits(none, chunks).count() == retrieval.hybrid_hits(none, chunks).count() == retrieval.hybrid_hits(questions_, chunks.limit(0)).count() == 0


def test_best_hits_are_those_of_all_pairs(spark, monkeypatch):
    rng = random.Random(8)
    words = ["the", "other", "ration", "at", "票据", "审批单", "ñez", "x_1", "差旅"]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    vector = lambda: rng.choice([None, [1.0, 0.0], [0.6, 0.8], [0.6, None], [-1.0, 0.1]])
    docs = [(i, rng.choice((None, "s1", "s2")), "t", i % 3, rng.choice((text(5), text(2), "", None)), vector()) for i in range(150)]
    chunks = spark.createDataFrame(docs, "source_id long, source_name string, source_type string, chunk_index int, chunk string, vector array<float>").repartition(3)
    asked = spark.createDataFrame([(i, rng.choice((text(2), text(4), "审批单 the", "", None)), vector()) for i in range(12)], "q_id long, question string, asked array<float>")
    monkeypatch.setattr(retrieval, "SCORED_ROWS", 7)
    key = lambda df, score: sorted((r["q_id"], r["rank"], r["source_id"], r["chunk_index"], round(r[score], 9)) for r in df.collect())
    assert key(retrieval.keyword_hits(asked, chunks, 4), "keyword_score") == key(retrieval.ranked(retrieval.keyword_hits(asked, chunks), 4, "keyword_score"), "keyword_score")
    assert key(retrieval.hybrid_hits(asked, chunks, limit=4), "score") == key(retrieval.ranked(retrieval.hybrid_hits(asked, chunks), 4), "score")
    # of 150 copies of a text a task hands on no more than the limit
    copies = retrieval.hay_of(spark.createDataFrame([(i, "s", "t", 0, "the other") for i in range(150)], "source_id long, source_name string, source_type string, chunk_index int, chunk string").coalesce(1))
    best = retrieval.scored_pairs(asked.limit(1).withColumn("question", F.lit("other")), copies, limit=4)
    assert sorted((r["rank"], r["keyword_score"]) for r in best.collect()) == [(i, 11) for i in (1, 2, 3, 4)]
    plan = best._jdf.queryExecution().executedPlan()
    assert "Join" not in plan.toString() and [r["_id"] for r in best.orderBy("rank").collect()] == [r["_id"] for r in copies.orderBy("source_id").limit(4).collect()]


def test_best_hits_write_no_chunks(spark, monkeypatch):
    names, written = [], retrieval.staged
    monkeypatch.setattr(retrieval, "staged", lambda df, name: (names.append(name), written(df, name))[1])
    chunks = spark.createDataFrame([(i, f"s{i % 3}", "t", 0, f"the other {i}") for i in range(40)], "source_id long, source_name string, source_type string, chunk_index int, chunk string").repartition(3)
    asked = spark.createDataFrame([(1, "other"), (2, "the 7"), (3, "none of it")], "q_id long, question string")
    for hits in (retrieval.keyword_hits(asked, chunks, 4), retrieval.hybrid_hits(asked, chunks, limit=4)):
        assert all(r["chunk"] == f"the other {r['source_id']}" and r["source_name"] == f"s{r['source_id'] % 3}" for r in hits.collect())
    assert "pairs" in names and "chunks" not in names
    # several blocks of questions read what is written once
    monkeypatch.setattr(retrieval, "MATRIX_ROWS", 1)
    again = retrieval.keyword_hits(asked, chunks, 4)
    assert names.count("chunks") == 1 and {r["q_id"] for r in again.collect()} == {1, 2}


def test_terms_of_texts():
    rng = random.Random(3)
    part = lambda n: "".join(rng.choice("ab_7é票 -") for _ in range(n))
    terms = [t for t in {"".join(rng.choice("ab_7") for _ in range(rng.choice((2, 3, 4, 7)))) for _ in range(90)} | {"票é", "é票é"}]
    texts = ["", *[part(rng.randrange(60)) for _ in range(80)], "", "ab", "a"]
    index = retrieval.TermIndex([terms[::2], [], terms[1::2], terms], ["ab", None, "", "a7"])
    for marked in (1 << 23, 0):
        index.MARKED = marked
        for begin in (0, 5):
            rows, ids = index.held(pa.array(texts)[begin:])
            got = sorted((i, index.names[t]) for i, t in zip(rows.tolist(), ids.tolist(), strict=True))
            assert got == sorted((i, t) for i, text in enumerate(texts[begin:]) for t in terms if t in text)
    assert retrieval.TermIndex([["ab"], ["abc"]], ["ab", "abc"]).scores(pa.array(["xabcx", "a", "ab c"])).tolist() == [[10, 11], [0, 0], [10, 0]]


def test_evaluation_fixture(spark):
    runs = spark.createDataFrame([
        ("a", True, True, False, ["x", "y"], ["t"], ["y"], [], 0.5, 1.0, 3.0, "passed"), ("b", True, False, False, ["x"], ["t"], ["x"], ["t"], 0.5, 0.0, 1.0, "failed"), ("c", False, True, True, [], [], [], [], 1.0, 1.0, 2.0, "failed"),
    ], "case_id string, expect_answer boolean, answerable boolean, false_positive boolean, expected_sources array<string>, expected_terms array<string>, missing_sources array<string>, missing_terms array<string>, source_recall double, term_recall double, top_score double, status string")
    table = spark.createDataFrame([("a", "财务", ["重点", "日报"]), ("b", None, ["重点 ", "重点"]), ("c", "财务", [])], "case_id string, category string, tags array<string>")
    s = evaluation.summary(runs).first()
    assert [float(s[c]) for c in ("pass_rate", "answer_pass_rate", "no_answer_accuracy", "false_positive_rate", "average_source_recall", "average_term_recall", "average_top_score", "maximum_top_score")] == [0.3333, 0.5, 0.0, 1.0, 0.5, 0.5, 2.0, 3.0]
    assert {r.name: (r.total, r.passed) for r in evaluation.by_category(runs, table).collect()} == {"未分类": (1, 0), "财务": (2, 1)}
    assert {r.name: (r.total, r.passed) for r in evaluation.by_tag(runs, table).collect()} == {"日报": (1, 1), "重点": (2, 1)}
    reasons = {r.case_id: r.r for r in runs.select("case_id", evaluation.failure_reasons().alias("r")).collect()}
    assert reasons == {"a": [], "b": ["no_hit", "missing_source", "missing_term"], "c": ["false_positive"]}
    empty = evaluation.summary(runs.limit(0)).first()
    assert empty.total == 0 and empty.pass_rate == 0 and empty.maximum_top_score == 0.0


def test_cases(spark):
    r = random.Random(2)
    rows = [(1, i, f"Q {r.randrange(8)}", r.choice([None, "k1", "k2"])) for i in range(40)]
    frame = spark.createDataFrame(rows, "batch int, n int, question string, external_key string")
    have = [("q  1", "k2"), ("Q 3", None)]
    for known in ([], have):
        expected = []
        seen = {f"q:{' '.join(q.split()).casefold()}" for q, _ in known} | {f"e:{k}" for _, k in known if k}
        for _, i, q, k in rows:
            if (f"e:{k}" if k else f"q:{q.casefold()}") not in seen:
                seen |= {f"q:{q.casefold()}"} | ({f"e:{k}"} if k else set())
                expected.append(i)
        left = cases.fresh(frame, spark.createDataFrame(known, "question string, external_key string"), "n")
        assert sorted(x.n for x in left.collect()) == expected and left.columns == frame.columns
        if not known:
            assert sorted(x.n for x in cases.deduplicated_by_both(frame, "batch", "n").collect()) == expected
    assert cases.deduplicated(frame, "n").count() == len({q for _, _, q, _ in rows})
    tops = spark.createDataFrame([(None,), ("3",), ("10.0",), ("11",), ("x",), ("2.5",)], "t string").select(cases.top_k(F.col("t")).alias("k")).collect()
    assert [x.k for x in tops] == [5, 3, 10, None, None, None]
    told = spark.createDataFrame([("", "c" * 81, ["a"] * 21, "k")], "question string, category string, tags array<string>, external_key string").select(cases.problems().alias("p")).first().p
    assert told == ["question_missing", "category_too_long", "tags_out_of_bounds"]


def test_gates_fail_closed(spark):
    g = spark.createDataFrame([(1, "a", "lte", 5.0), (2, "b", "gte", 5.0), (3, "c", "lte", 5.0), (4, "d", "lte", 5.0)], "place int, metric string, comparison string, bound double")
    m = spark.createDataFrame([("a", 5.0), ("b", 4.0), ("c", float("nan"))], "metric string, value double")
    assert [r.passed for r in gates.evaluated(g, m).orderBy("place").collect()] == [True, False, False, False]
    n = spark.range(1, 151).selectExpr("CAST(id AS double) x").agg(gates.percentile_disc("x", 0.95)).first()[0]
    assert n == 143.0


def test_jobs(spark):
    log = spark.createDataFrame([(1, 1, "queued"), (1, 2, "running"), (2, 3, "queued"), (1, 4, "done")], "job_id int, n int, status string")
    assert {r.job_id: (r.status, r.n_entries) for r in jobs.current(log, "job_id", "n").collect()} == {1: ("done", 3), 2: ("queued", 1)}
    numbered = jobs.sequenced(log, "n", buckets=3).orderBy("n").collect()
    assert [r.sequence for r in numbered] == [1, 2, 3, 4]
    assert jobs.allocated(log, "n").first().next_value == 5


def test_stream_is_resumed(spark, tmp_path):
    schema = "job_id long, n long, status string"
    root, source = f"file://{tmp_path}/root", f"file://{tmp_path}/log"
    spark.createDataFrame([(1, 1, "queued"), (2, 2, "queued")], schema).coalesce(1).write.mode("append").parquet(source)
    first = events.folded(spark, source, schema, "job_id", "n", root=root)
    assert {r.job_id: r.status for r in first.collect()} == {1: "queued", 2: "queued"}
    spark.createDataFrame([(1, 3, "done")], schema).coalesce(1).write.mode("append").parquet(source)
    again = events.folded(spark, source, schema, "job_id", "n", root=root)
    assert {r.job_id: (r.status, r.n_entries) for r in again.collect()} == {1: ("done", 2), 2: ("queued", 1)}
    # nothing new, and nothing at all
    assert sorted(events.folded(spark, source, schema, "job_id", "n", root=root).collect()) == sorted(again.collect())
    none = f"file://{tmp_path}/none"
    spark.createDataFrame([], schema).write.parquet(none)
    assert events.folded(spark, none, schema, "job_id", "n").count() == 0


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def test_workbooks_do_not_grow_with_the_table(spark, tmp_path):
    spark.range(0, 200_000, 400).selectExpr("id AS o_orderkey", "id % 3 AS o_custkey").write.parquet(f"{tmp_path}/orders.parquet")
    spark.range(3).selectExpr("id AS c_custkey", "4 AS c_nationkey").write.parquet(f"{tmp_path}/customer.parquet")
    assert registered._formula_books(spark, str(tmp_path)).count() == 200_000 // registered.BOOK_KEYS
    got = registered.uncached_formula_rows(spark, str(tmp_path)).collect()
    assert sorted((r["nation"], r["order_key"], r["customer"]) for r in got) == [(4, k, str(k % 3)) for k in range(0, 200_000, 400)]


def test_refused_rows_show_by_themselves(spark):
    """Rows without a number of their own (0) aren't refused for one another, and none is shuffled."""
    rows = [("a", "s", 0, ["1", None], [None, "=B1"], None), ("a", "s", 0, [None, "x"], ["=A1", None], None), ("a", "s", 1, ["2"], ["=A2"], None), ("a", "s", 2, [None], [None], None), ("b", None, None, None, None, "unreadable")]
    df = spark.createDataFrame(rows, "path string, worksheet string, row_number long, cells array<string>, formulas array<string>, problem string")
    kept, told = publication.without_uncached(df, [0])
    assert sorted(map(tuple, kept.collect()), key=repr) == sorted([rows[0], *rows[2:]], key=repr)
    assert sorted((r["place"], r["refused"]) for r in told.collect()) == [(0, True), (1, False)]
    assert "Exchange" not in kept._jdf.queryExecution().executedPlan().toString()
    assert publication.without_uncached(df, [])[0].count() == len(rows)


def test_workbooks_one_at_a_time(spark, monkeypatch):
    """A task writes a workbook from its rows alone; no list of all workbooks' rows is sent to it at once."""
    rows = spark.range(300).select(F.concat(F.lit("p"), F.col("id") % 7).alias("path"), F.array(F.col("id").cast("string"), F.when(F.col("id") % 2 == 0, "=A1")).alias("cells"))
    books = office.workbooks(rows, "s")
    got = sorted((r["path"], r["worksheet"], int(r["cells"][0])) for r in files.xlsx_cells(books).collect())
    assert got == sorted((f"p{i % 7}", "s", i) for i in range(300))
    monkeypatch.setattr(office, "workbooks", lambda rows, name: rows)
    assert registered._formula_books(spark, SF).columns == ["path", "cells"]
    # books in cells of their own go by slices, and one without sheets is null (an error before)
    sheets = [None if i % 9 == 0 else [[[str(i)]]] for i in range(2 * files.SLICE + 3)]
    made = spark.createDataFrame(list(enumerate(sheets)), "path int, s array<array<array<string>>>").coalesce(1).select(F.col("path").cast("string").alias("path"), office.workbook(F.array(F.lit("s")), "s").alias("content"))
    assert sorted(r["path"] for r in made.where("content IS NULL").collect()) == sorted(str(i) for i, s in enumerate(sheets) if s is None)
    assert sorted((r["path"], r["cells"][0]) for r in files.xlsx_cells(made.where("content IS NOT NULL")).collect()) == sorted((str(i), str(i)) for i, s in enumerate(sheets) if s)


def plain(v):
    return round(v, 9) if isinstance(v, float) else v if isinstance(v, (int, str, type(None))) else str(v)


@pytest.mark.parametrize("name", list(registered.QUERIES))
def test_against_duckdb(spark, duck, name):
    df = registered.QUERIES[name](spark, SF)
    got, columns = df.collect(), sorted(df.columns)
    if name not in registered.ORACLE_SQL:
        assert got
        return
    result = duck.sql(registered.ORACLE_SQL[name])
    assert sorted(result.columns) == columns
    places = [result.columns.index(c) for c in columns]
    expected = sorted((tuple(plain(r[i]) for i in places) for r in result.fetchall()), key=repr)
    assert sorted((tuple(plain(r[c]) for c in columns) for r in got), key=repr) == expected


CATALOG = ([("ds-sales", "sales.xlsx", "Sheet 1", True), ("ds-sales-2", "sales-2.xlsx", "Sheet 12", True), ("ds-old", "旧数据.csv", "旧", False)], "dataset_id string, source_name string, worksheet string, published boolean")
FIELDS = ([("ds-sales", ["amount", "订单金额"], "decimal", True, True), ("ds-sales", ["region", "地区"], "string", True, False), ("ds-sales-2", ["grade", "等级"], "string", True, False), ("ds-old", ["旧数据编号"], "integer", True, False)], "dataset_id string, names array<string>, kind string, filter boolean, aggregate boolean")


def test_chosen_datasets(spark):
    cases = {
        "SALES.xlsx的订单金额平均": ("chosen", None, "ds-sales"),
        "sales 2 的订单金额平均": ("chosen", None, "ds-sales-2"),  # the longer name
        "DS-SALES-2 和 sales.xlsx 合计": ("clarification", "several_datasets", None),
        "sheet12的合计": ("chosen", None, "ds-sales-2"),
        "sheet 12等级合计": ("chosen", None, "ds-sales"),  # a value of 等级, in which Sheet 1 stands
        "sheet 12 等级合计": ("chosen", None, "ds-sales-2"),  # not right before it
        "旧数据编号合计": ("clarification", "dataset_not_named", None),  # inside a field's name
        "旧数据的合计": ("unavailable", "not_published", None),
        "订单金额平均": ("clarification", "dataset_not_named", None),
        "": ("clarification", "dataset_not_named", None),
        None: ("clarification", "dataset_not_named", None),
    }
    asked = spark.createDataFrame(list(enumerate(cases)), "q_id int, question string")
    datasets, fields = spark.createDataFrame(*CATALOG), spark.createDataFrame(*FIELDS)
    rows = {r["question"]: r for r in catalogs.chosen(asked, datasets, fields).collect()}
    assert {q: (r["outcome"], r["reason"], r["dataset_id"]) for q, r in rows.items()} == cases
    assert rows["DS-SALES-2 和 sales.xlsx 合计"]["candidates"] == ["ds-sales", "ds-sales-2"]
    assert rows["SALES.xlsx的订单金额平均"]["rest"] == " " * 10 + "的订单金额平均"
    alone = catalogs.chosen(asked, datasets.where("dataset_id <> 'ds-sales-2'"), fields).where("question = '订单金额平均'").first()
    assert alone["outcome"] == "chosen" and alone["dataset_id"] == "ds-sales"
    assert {r["reason"] for r in catalogs.chosen(asked.limit(1), datasets.limit(0), fields).collect()} == {"no_dataset"}
    assert catalogs.chosen(asked.limit(0), datasets, fields).count() == 0


def test_routed_questions(spark):
    cases = {
        "订单金额最高吗": True, "订单金额平均值呢": True, "等级为最高": False, "等级为最高的记录": False, "sales.xlsx的等级为最高": False, "sales.xlsx的等级为最高，订单金额平均值": True,
        "地区为华东订单金额平均值": True, "订单金额平均值，地区为华东": True, "地区=最低 订单金额的最大是多少": True, "什么是平均值": False, "一共多少条": False, "订单金额": False, "": False, None: False,
    }
    asked = spark.createDataFrame(list(enumerate(cases)), "q_id int, question string")
    datasets, fields = spark.createDataFrame(*CATALOG), spark.createDataFrame(*FIELDS)
    got = {r["q_id"]: r["structured"] for r in catalogs.routed(asked, datasets, fields).collect()}
    assert got == dict(enumerate(cases.values()))
    alone = catalogs.routed(asked, datasets.where("dataset_id = 'ds-sales'"), fields).where("question = '一共多少条'").first()
    assert alone["structured"]


def test_names_found_in_texts(spark):
    names, texts = ["a", "ab", "abcab", "日本", "x" * 20, "b-c"], ["abcabcab", "日本日本", "x" * 22, "", None, "b-c"]
    got = spans.found(spark.createDataFrame(list(enumerate(texts)), "i int, text string"), spark.createDataFrame([(n,) for n in names] + [("",)], "name string"), "i")
    want = sorted((i, at, n) for i, t in enumerate(texts) for n in names for at in range(len(t or "")) if t.startswith(n, at))
    assert sorted((r["i"], r["start"], r["name"]) for r in got.collect()) == want
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_parts_that_no_name_has_stay_in_their_task(spark):
    """Of 300 texts of 40 characters only the parts that names are found by leave the tasks, not all of their 60,000."""
    rng = random.Random(5)
    drawn = lambda n, letters: "".join(rng.choices(letters, k=n))
    names = sorted({drawn(rng.randint(1, 30), "xyz日𝄞") for _ in range(80)})
    texts = [drawn(40, "abcdefgh") if i % 3 else drawn(10, "xyz日𝄞") + rng.choice(names) + "a" for i in range(300)]
    asked, held = spark.createDataFrame(list(enumerate(texts)), "i int, text string"), spark.createDataFrame([(n,) for n in names], "name string")
    want = sorted((i, at, n) for i, t in enumerate(texts) for n in names for at in range(len(t)) if t.startswith(n, at))
    assert sorted((r["i"], r["start"], r["name"]) for r in spans.found(asked, held, "i").collect()) == want
    own = spans.placed(held).collect()
    assert sorted(r["name"] for r in own) == names and all(len(r["name"]) >= r["_at"] + r["_size"] for r in own)
    left = spans.cut(asked, spans.placed(held), "i")
    assert left.where("i % 3 > 0").count() < 20 and left.count() < 10_000


def test_candidates_are_joined_last(spark):
    """Lists of a worksheet's datasets aren't shuffled with questions, and questions without a dataset don't meet in one task."""
    datasets = spark.createDataFrame([(f"ds-{i}", f"file{i}.csv", "shared sheet", i % 2 == 0) for i in range(10, 30)], "dataset_id string, source_name string, worksheet string, published boolean")
    asked = spark.createDataFrame([(0, "shared sheet合计"), (1, "file12合计"), (2, "ds-13合计"), (3, "ds-12和file14合计"), (4, "合计"), (5, "ds-12和file12.csv合计")], "q_id int, question string")
    out = catalogs.chosen(asked, datasets, spark.createDataFrame(*FIELDS))
    rows = {r["q_id"]: (r["reason"], r["dataset_id"], len(r["candidates"])) for r in out.collect()}
    assert rows == {0: ("several_datasets", None, 20), 1: (None, "ds-12", 0), 2: ("not_published", None, 0), 3: ("several_datasets", None, 2), 4: ("dataset_not_named", None, 0), 5: (None, "ds-12", 0)}
    assert "hashpartitioning(dataset_id" not in out._jdf.queryExecution().executedPlan().toString()


def test_longest_lists_of_a_task_come_first(spark, monkeypatch):
    """Writers buffer rows by the size of those before, so long lists may not follow thousands of rows without any."""
    datasets = spark.createDataFrame([(f"ds-{i}", f"file{i}.csv", "shared sheet" if i < 30 else f"pair {i // 2} leaf", i % 2 == 0) for i in range(10, 40)], "dataset_id string, source_name string, worksheet string, published boolean")
    asked = spark.createDataFrame([(i, ["ds-13合计", "pair 16 leaf合计", "shared sheet合计", "合计", "ds-12和file14合计", "shared sheet和pair 17 leaf合计"][i % 6]) for i in range(60)], "q_id int, question string")
    want = [(None, 0), ("several_datasets", 2), ("several_datasets", 20), ("dataset_not_named", 0), ("several_datasets", 2), ("several_datasets", 22)]
    for wide in (1000, 5):
        monkeypatch.setattr(catalogs, "WIDE", wide, raising=False)
        out = catalogs.chosen(asked, datasets, spark.createDataFrame(*FIELDS)).select("q_id", "reason", F.size("candidates").alias("n"), F.spark_partition_id().alias("task"))
        rows, tasks = out.collect(), {}
        assert sorted((r["q_id"], r["reason"] if r["reason"] != "not_published" else None, r["n"]) for r in rows) == [(i, *want[i % 6]) for i in range(60)]
        for r in rows:
            tasks.setdefault(r["task"], []).append(r["n"])
        assert all(n == sorted(n, reverse=True) for n in tasks.values())
        assert "BroadcastHashJoin [_width" not in out._jdf.queryExecution().executedPlan().toString()
    unknown = spark.createDataFrame([(None, "nobody.csv", "alone", True)], datasets.schema)
    row = catalogs.chosen(spark.createDataFrame([(1, "nobody合计")], "q_id int, question string"), datasets.union(unknown), spark.createDataFrame(*FIELDS)).first()
    assert (row["reason"], row["dataset_id"], row["candidates"]) == ("dataset_not_named", None, [])


def test_texts_of_bytes_by_slices(spark):
    """More files than a slice, some null (an error before), as texts and encodings in their order."""
    texts = [None if i % 7 == 0 else f"{i} 中文" if i % 2 else f"{i}" for i in range(3 * files.SLICE + 5)]
    raw = [None if t is None else t.encode("gb18030" if i % 3 else "utf-8-sig") for i, t in enumerate(texts)]
    rows = spark.createDataFrame(list(enumerate(raw)), "i int, b binary").coalesce(1).select("i", files.decoded("b").alias("t"), files.probed("b").alias("e"), files.csv_text("b").alias("c")).orderBy("i").collect()
    assert [r["t"] for r in rows] == [r["c"] for r in rows] == texts
    assert [r["e"] for r in rows] == [None if b is None else files.encoding_of(b) for b in raw]
    assert files.each(len, pa.int64(), pa.array([], pa.string())).to_pylist() == []


def test_drift_by_one_join(spark):
    """Headers drawn at random against the rules, one by one; a dataset's header and columns meet in one join."""
    rng, heads, columns = random.Random(3), [], []
    for i in range(60):
        heads.append((i, [rng.choice(["a", "A ", "b", "x y", "", None, "c"]) for _ in range(rng.randint(0, 5))]))
        columns += [(i + 5, n, rng.choice(["a", "A", "b", "x y", "", None, "q"])) for n in rng.sample(["a", "b", "a_2", "x_y", "column_1", "zz"], rng.randint(0, 4))]
    headers, confirmed = spark.createDataFrame(heads, "dataset_id int, headers array<string>"), spark.createDataFrame(columns, "dataset_id int, physical_name string, original_name string")
    names = {r[0]: r[1] for r in headers.select("dataset_id", vx.unique_names(F.col("headers"))).collect()}
    want = set()
    for i in range(65):
        cells = [(at, n, (o or "").strip()) for at, (n, o) in enumerate(zip(names.get(i, []), dict(heads).get(i, []), strict=True))]
        own = {n: o for d, n, o in columns if d == i}
        matched = {n: at for n in own for at, c, _ in cells if c == n}
        free = [(at, o) for at, _, o in cells if at not in matched.values()]
        taken = {}
        for n in sorted(set(own) - set(matched)):
            at = [at for at, o in free if o == own[n]]
            if len(at) == 1 and at[0] not in taken.values():
                taken[n] = at[0]
        matched |= taken
        want |= {(i, n, at, "matched") for n, at in matched.items()} | {(i, n, None, "missing") for n in set(own) - set(matched)}
        want |= {(i, c, at, "unexpected") for at, c, _ in cells if at not in matched.values()}
    out = publication.drifted(headers, confirmed)
    assert {tuple(r) for r in out.collect()} == want and out.count() == len(want)
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 1


def test_places_of_columns_are_not_broadcast(spark):
    """Places of columns take little room on disk and much in memory; their size on disk doesn't send them to every task."""
    rows = spark.createDataFrame([(i, 2, [f"a{i}", f"b{i}"]) for i in range(6)], "dataset_id int, row_number int, cells array<string>")
    headers = spark.createDataFrame([(i, ["x", "y"] if i % 2 else ["y", "x"]) for i in range(5)], "dataset_id int, headers array<string>")
    confirmed = spark.createDataFrame([(i, n, n) for i in range(5) for n in (("x", "y", "z") if i == 4 else ("x", "y"))], "dataset_id int, physical_name string, original_name string")
    fields, bad = publication.projected(rows, headers, confirmed)
    got = {r["dataset_id"]: r["fields"] for r in fields.collect()}
    assert got == {i: {"x": f"{'ba'[i % 2]}{i}", "y": f"{'ab'[i % 2]}{i}"} for i in range(4)}
    assert [(r["dataset_id"], r["missing"]) for r in bad.collect()] == [(4, ["z"])]
    assert "Broadcast" not in fields._jdf.queryExecution().executedPlan().toString()


def test_control_rows_and_numbers(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    changes = spark.createDataFrame([("old", 1, 2), ("new", 1, 3), ("zzz", 1, 1), ("c", 3, 0)], "v string, k int, at int")
    got = jobs.upserted(rows, changes, "k", order="at")
    assert sorted(map(tuple, got.collect())) == [(1, "new"), (2, "b"), (3, "c")]
    assert sorted(map(tuple, jobs.upserted(rows, changes, "k", rows.where("k = 2")).collect())) == [(1, "zzz"), (3, "c")]
    pairs = [("1e25", "1" + "0" * 25, True), ("1e25", "1" + "0" * 24 + "1", False), ("1.50", "1.5", True), ("x", "x", True), ("x", "1", False), (None, "1", False), (None, None, True), ("1" * 35, "1" * 35 + ".0", True)]
    df = spark.createDataFrame(pairs, "a string, b string, same boolean")
    assert df.where(vx.same_number(F.col("a"), F.col("b")) != F.col("same")).count() == 0
    header, parts = spark.createDataFrame([(1,), (2,)], "k int"), spark.createDataFrame([(1, 2, "b"), (1, 1, "a"), (1, 2, "a"), (9, 1, "z")], "k int, at int, v string")
    assert {r.k: [(p.at, p.v) for p in r.parts] for r in jobs.listed(header, parts, "k", "at").collect()} == {1: [(1, "a"), (2, "a"), (2, "b")], 2: []}


def test_flushed_batches_and_stores(spark, tmp_path):
    sizes = [10, 10, 90, 200, 5, 5, 5, 5, None, 100, 1]
    rows = spark.createDataFrame([(d, i, s) for d in ("a", None) for i, s in enumerate(sizes)], "d string, i int, s int")
    got = publication.flushed(rows, "d", "i", "s", 4, 100)
    assert [r.batch for r in got.where("d = 'a'").orderBy("i").collect()] == [1, 1, 2, None, 2, 2, 3, 3, 3, 4, 5] == [r.batch for r in got.where("d IS NULL").orderBy("i").collect()]
    store = f"file://{tmp_path}/store"
    first = spark.createDataFrame([(i, n, f"{i}.{n}") for i in range(20) for n in range(2)], "source_id int, chunk_index int, chunk string")
    retrieval.replace_chunks(store, first, buckets=3)
    new = spark.createDataFrame([(4, 0, "new"), (99, 0, "other")], first.schema)
    for _ in range(2):
        retrieval.replace_chunks(store, new, buckets=3)
        want = [tuple(r) for r in first.where("source_id <> 4").union(new).collect()]
        assert sorted(tuple(r) for r in retrieval.stored_chunks(spark, store).select(first.columns).collect()) == sorted(want)
