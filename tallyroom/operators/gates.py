"""Load-test figures: percentiles, rates and capacity gates."""

from __future__ import annotations

from collections.abc import Callable
from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyroom.tables import staged


def percentile_disc(column: str, q: float) -> Column:
    """Nearest rank: the value at place ceil(q n)."""
    return F.expr(f"percentile_disc({float(q)}) WITHIN GROUP (ORDER BY `{column}`)")


def nearest_rank(q: float) -> Callable[[Column], Column]:
    """Of a number of values, the place ceil(q n)."""
    return lambda n: F.ceil(F.lit(Decimal(str(q))).cast("decimal(12,9)") * n)


def placed(rows: DataFrame, group: str, value: str, places: dict[str, Callable[[Column], Column]], buckets: int = 64) -> DataFrame:
    """group, and for each name in places the value of the group that stands there, of all values in order; nulls don't
    count. A group's different values are never held by one task: they are counted, dealt by range, summed up within
    each range and shifted by what stands before it."""
    counts = rows.where(F.col(value).isNotNull()).groupBy(F.col(group).alias("_g"), F.col(value).alias("_v")).agg(F.count("*").alias("_c"))
    dealt = staged(counts.repartitionByRange(buckets, "_g", "_v").withColumn("_part", F.spark_partition_id()), "placed")
    before = Window.partitionBy("_g").orderBy("_part")
    parts = dealt.groupBy("_g", "_part").agg(F.sum("_c").alias("_c"))
    parts = parts.select("_g", "_part", (F.sum("_c").over(before) - F.col("_c")).alias("_before"), F.sum("_c").over(Window.partitionBy("_g")).alias("_n"))
    upto = F.col("_before") + F.sum("_c").over(Window.partitionBy("_g", "_part").orderBy("_v"))
    summed = dealt.join(parts, ["_g", "_part"]).select("_g", "_v", "_n", upto.alias("_upto"))
    return summed.groupBy(F.col("_g").alias(group)).agg(*[F.min(F.when(F.col("_upto") >= place(F.col("_n")), F.col("_v"))).alias(name) for name, place in places.items()])


def rollup(requests: DataFrame) -> DataFrame:
    """requests (kind, ok, latency, cached): for each kind the p95 of what succeeded, null if any success lacks the
    figure, the error rate and the share of successes from the cache."""
    ok = F.col("ok")
    counts = requests.groupBy("kind").agg(F.count("*").alias("n"), F.count_if(ok & F.col("latency").isNull()).alias("_lacking"), F.count_if(~ok).alias("n_errors"), F.count_if(ok & F.col("cached")).alias("n_cached"))
    p95 = placed(requests.where(ok), "kind", "latency", {"p95": nearest_rank(0.95)})
    return counts.join(p95, "kind", "left").select("kind", "n", F.when(F.col("_lacking") == 0, F.col("p95")).alias("p95"), "n_errors", "n_cached")


def evaluated(gates: DataFrame, metrics: DataFrame) -> DataFrame:
    """gates (place, metric, comparison lte or gte, bound) and metrics (metric, value): a missing or non-finite value
    fails."""
    both = gates.join(metrics, "metric", "left")
    v, b = F.col("value"), F.col("bound")
    holds = F.when(v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")), False).when(F.col("comparison") == "lte", v <= b).when(F.col("comparison") == "gte", v >= b).otherwise(False)
    return both.select("place", "metric", "comparison", "bound", "value", holds.alias("passed"))
