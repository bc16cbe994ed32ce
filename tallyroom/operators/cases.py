"""Import of evaluation cases: limits, lookups, duplicates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyroom.functions.text import question_key
from tallyroom.functions.values import stripped

TOP_K, MAX_TOP_K, MAX_NAME, MAX_TAGS, MAX_KEY = 5, 10, 80, 20, 120


def top_k(c):
    """A whole number from 1 to 10, 5 where blank; null where it is neither."""
    t = stripped(c)
    n = F.when(t.rlike(r"^[+-]?\d+(\.0*)?$"), t.try_cast("decimal(20,4)").try_cast("int"))
    return F.when(c.isNull() | (F.length(t) == 0), TOP_K).when(n.between(1, MAX_TOP_K), n)


def problems():
    """Limits that a row breaks, in order."""
    return F.filter(
        F.array(
            F.when(F.coalesce(F.length(stripped(F.col("question"))), F.lit(0)) == 0, "question_missing"), F.when(F.length("category") > MAX_NAME, "category_too_long"),
            F.when((F.size("tags") > MAX_TAGS) | F.exists("tags", lambda t: F.length(t) > MAX_NAME), "tags_out_of_bounds"), F.when(F.length("external_key") > MAX_KEY, "key_too_long"),
        ),
        lambda p: p.isNotNull(),
    )


def with_sources(rows: DataFrame, key: str, names: str, sources: DataFrame) -> DataFrame:
    """Ids for the source names of each row (array `names`): key, name, state (found, unknown, ambiguous), source_id."""
    grouped = sources.groupBy("source_name").agg(F.count("*").alias("n"), F.min("source_id").alias("source_id"))
    asked = rows.select(key, F.explode(names).alias("source_name")).join(grouped, "source_name", "left")
    state = F.when(F.col("n").isNull(), "unknown").when(F.col("n") > 1, "ambiguous").otherwise("found")
    return asked.select(key, "source_name", state.alias("state"), F.when(F.col("n") == 1, F.col("source_id")).alias("source_id"))


def _keyed(rows: DataFrame) -> DataFrame:
    return rows.withColumns({"_q": question_key(F.col("question")), "_e": F.nullif(stripped(F.coalesce("external_key", F.lit(""))), F.lit(""))})


def fresh(rows: DataFrame, existing: DataFrame, order: str, batch: str | None = None) -> DataFrame:
    """Rows (order, question, external_key) to insert. A row's key is its external key or, without one, its question
    without regard to case and spacing. It goes if an existing row, or an earlier row of its batch that stays, has that
    key; a row that stays or exists is known by both its external key and its question.

    So of equal external keys the first stays, whatever its question; of the rows without one those stay that come first
    for their question, before any row with a key that stays. Groups are never held, only their smallest places.
    """
    own = [batch] if batch else []
    keyed, have = _keyed(rows), _keyed(existing)
    named = keyed.where("_e IS NOT NULL").join(have.where("_e IS NOT NULL").select("_e").distinct(), "_e", "left_anti")
    first = named.groupBy(*own, "_e").agg(F.min(order).alias(order))
    named = named.join(first, [*own, "_e", order], "left_semi").dropDuplicates([*own, "_e"])
    plain = keyed.where("_e IS NULL").join(have.select("_q").distinct(), "_q", "left_anti")
    first = plain.groupBy(*own, "_q").agg(F.min(order).alias("_first"))
    taken = named.groupBy(*own, "_q").agg(F.min(order).alias("_taken"))
    first = first.join(taken, [*own, "_q"], "left").where("_taken IS NULL OR _first < _taken").select(*own, "_q", F.col("_first").alias(order))
    plain = plain.join(first, [*own, "_q", order], "left_semi").dropDuplicates([*own, "_q"])
    return named.select(*rows.columns).unionByName(plain.select(*rows.columns))


def deduplicated(rows: DataFrame, order: str) -> DataFrame:
    """Of the rows with one question the first. Where external keys decide as well, see deduplicated_by_both."""
    first = F.row_number().over(Window.partitionBy(question_key(F.col("question"))).orderBy(order))
    return rows.withColumn("_n", first).where("_n = 1").drop("_n")


def deduplicated_by_both(rows: DataFrame, batch: str, order: str) -> DataFrame:
    """The rows of each import batch that stay by the rule of `fresh`, with nothing there before."""
    return fresh(rows, rows.limit(0), order, batch)
