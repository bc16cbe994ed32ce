"""Retrieval quality: runs, summaries, breakdowns, comparisons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyroom.functions.values import stripped

UNSORTED = "未分类"


def scored_runs(cases: DataFrame, hits: DataFrame) -> DataFrame:
    """cases (case_id, expect_answer, expected_sources, expected_terms) and ranked hits (case_id, source_id,
    source_name, chunk, score) to runs. Recall is 1 where nothing is expected. A case that expects no answer passes
    without hits; the others need hits and nothing missing."""
    found = hits.groupBy("case_id").agg(
        F.array_sort(F.collect_set("source_id")).alias("matched_sources"), F.lower(F.concat_ws(" ", F.collect_list(F.concat_ws(" ", "source_name", "chunk")))).alias("_evidence"),
        F.max("score").alias("top_score"), F.count("*").alias("hit_count"),
    )
    runs = cases.join(found, "case_id", "left").withColumns({
        "matched_sources": F.coalesce("matched_sources", F.slice("expected_sources", 1, 0)), "_evidence": F.coalesce("_evidence", F.lit("")),
        "top_score": F.coalesce(F.col("top_score").cast("double"), F.lit(0.0)), "hit_count": F.coalesce("hit_count", F.lit(0)),
    })
    runs = runs.withColumns({
        "missing_sources": F.array_except("expected_sources", "matched_sources"), "found_terms": F.filter("expected_terms", lambda t: F.contains("_evidence", F.lower(t))),
        "missing_terms": F.filter("expected_terms", lambda t: ~F.contains("_evidence", F.lower(t))), "answerable": F.col("hit_count") > 0,
    })
    share = lambda all_, gone: F.when(F.size(all_) > 0, (F.size(all_) - F.size(gone)) / F.size(all_)).otherwise(1.0)
    passed = F.when(F.col("expect_answer"), F.col("answerable") & (F.size("missing_sources") == 0) & (F.size("missing_terms") == 0)).otherwise(~F.col("answerable"))
    return runs.withColumns({
        "source_recall": share("expected_sources", "missing_sources"), "term_recall": share("expected_terms", "missing_terms"),
        "false_positive": ~F.col("expect_answer") & F.col("answerable"), "status": F.when(passed, "passed").otherwise("failed"),
    }).drop("_evidence")


def ratio(part: Column, whole: Column) -> Column:
    """part / whole with four places, zero where whole is."""
    return F.when(whole == 0, F.lit(0).cast("decimal(12,4)")).otherwise((part.cast("decimal(20,0)") / whole).cast("decimal(12,4)"))


def summary(runs: DataFrame) -> DataFrame:
    """One row of twelve metrics; recalls are averaged over runs that expect an answer and something to recall."""
    ok, asks, fp = F.col("status") == "passed", F.col("expect_answer"), F.col("false_positive")
    n = F.count("*")
    mean = lambda c, where: F.coalesce(F.round(F.avg(F.when(where, F.col(c))), 4), F.lit(0.0))
    return runs.agg(
        n.alias("total"), F.count_if(ok).alias("passed"), F.count_if(~ok).alias("failed"), ratio(F.count_if(ok), n).alias("pass_rate"),
        ratio(F.count_if(ok & asks), F.count_if(asks)).alias("answer_pass_rate"), ratio(F.count_if(ok & ~asks), F.count_if(~asks)).alias("no_answer_accuracy"),
        F.count_if(fp).alias("false_positive_count"), ratio(F.count_if(fp), F.count_if(~asks)).alias("false_positive_rate"),
        mean("source_recall", asks & (F.size("expected_sources") > 0)).alias("average_source_recall"), mean("term_recall", asks & (F.size("expected_terms") > 0)).alias("average_term_recall"),
        mean("top_score", F.lit(True)).alias("average_top_score"), F.coalesce(F.max("top_score"), F.lit(0.0)).alias("maximum_top_score"),
    )


def _groups(rows: DataFrame) -> DataFrame:
    ok = F.col("status") == "passed"
    return rows.groupBy("name").agg(F.count("*").alias("total"), F.count_if(ok).alias("passed"), ratio(F.count_if(ok), F.count("*")).alias("pass_rate"))


def by_category(runs: DataFrame, cases: DataFrame) -> DataFrame:
    """name, total, passed, pass_rate; runs without a case, and blank categories, are unsorted."""
    named = runs.join(cases.select("case_id", stripped(F.col("category")).alias("category")), "case_id", "left")
    return _groups(named.select(F.coalesce(F.nullif(F.col("category"), F.lit("")), F.lit(UNSORTED)).alias("name"), "status"))


def by_tag(runs: DataFrame, cases: DataFrame) -> DataFrame:
    tags = F.array_distinct(F.filter(F.transform("tags", stripped), lambda t: F.length(t) > 0))
    return _groups(runs.join(cases.select("case_id", F.explode(tags).alias("name")), "case_id").select("name", "status"))


def latest(runs: DataFrame, key: str, *order: str) -> DataFrame:
    """The row of each key that comes last in the given order."""
    rest = [c for c in runs.columns if c != key]
    return runs.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("r")).select(key, "r.*")


def compared(left: DataFrame, right: DataFrame) -> DataFrame:
    """case_id and change (improved, regressed, same, left_only, right_only) of the latest runs of two batches."""
    both = left.select("case_id", F.col("status").alias("l")).join(right.select("case_id", F.col("status").alias("r")), "case_id", "full")
    change = F.when(F.col("r").isNull(), "left_only").when(F.col("l").isNull(), "right_only").when((F.col("l") == "failed") & (F.col("r") == "passed"), "improved").when((F.col("l") == "passed") & (F.col("r") == "failed"), "regressed").otherwise("same")
    return both.select("case_id", change.alias("change"))


def metric_delta(left: DataFrame, right: DataFrame) -> DataFrame:
    """Right minus left of each metric of two summaries, never minus zero."""
    side = lambda df, p: df.select(*[F.col(c).alias(p + c) for c in df.columns])
    one = F.lit(1).alias("_one")
    both = side(left, "l_").withColumn("_one", one).join(side(right, "r_").withColumn("_one", one), "_one")
    return both.select(*[((F.col("r_" + c) - F.col("l_" + c)) + F.lit(0)).alias(c) for c in left.columns])


def failure_reasons() -> Column:
    """Ordered reasons of a failed run; empty for one that passed."""
    return F.filter(
        F.array(
            F.when(F.col("false_positive"), "false_positive"), F.when(F.col("expect_answer") & ~F.col("answerable"), "no_hit"),
            F.when(F.size("missing_sources") > 0, "missing_source"), F.when(F.size("missing_terms") > 0, "missing_term"),
        ),
        lambda r: r.isNotNull() & (F.col("status") != "passed"),
    )


def filtered(cases: DataFrame, last: DataFrame, category=None, tag=None, expect_answer=None, status=None) -> DataFrame:
    """Cases by category, tag, expectation and latest status; a case without runs is idle."""
    rows = cases.join(last.select("case_id", F.col("status").alias("last_status")), "case_id", "left").withColumn("last_status", F.coalesce("last_status", F.lit("idle")))
    tests = [(category, lambda: F.col("category") == category), (tag, lambda: F.array_contains("tags", tag)), (expect_answer, lambda: F.col("expect_answer") == expect_answer), (status, lambda: F.col("last_status") == status)]
    for given, test in tests:
        rows = rows if given is None else rows.where(test())
    return rows


def facets(cases: DataFrame) -> DataFrame:
    """kind and value of all categories and tags, whatever the filters."""
    categories = cases.select(F.lit("category").alias("kind"), F.col("category").alias("value"))
    return categories.union(cases.select(F.lit("tag"), F.explode("tags"))).where("length(value) > 0").distinct()
