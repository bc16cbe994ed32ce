"""Governed aggregates: five functions, AND-only typed filters, always with total, valid and null counts."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from datetime import date, datetime, timedelta
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyroom.functions.values import conjunction

SPARK_TYPE = {"string": "string", "integer": "bigint", "decimal": "decimal(38,9)", "date": "date", "datetime": "timestamp_ntz", "boolean": "boolean"}
# Literals that a boolean filter takes for true and false.
TRUE, FALSE = ("1", "true", "yes", "是"), ("0", "false", "no", "否")


class Refused(ValueError):
    """A request that the dataset's confirmed columns don't allow."""


@dataclass(frozen=True)
class Field:
    kind: str
    aggregate: bool = False
    filter: bool = True
    null_policy: str = "ignore"


@dataclass(frozen=True)
class Dataset:
    """A table with confirmed columns; reading it casts each to its confirmed type."""

    fields: dict[str, Field] = field(default_factory=dict)

    def of(self, df: DataFrame) -> DataFrame:
        return df.select(*[F.col(n).cast(SPARK_TYPE[f.kind]).alias(n) for n, f in self.fields.items()])


def bound(value: str, kind: str) -> object:
    """A filter's text as a value of the column's type; anything else is refused."""
    try:
        if kind == "integer":
            return int(value)
        if kind == "decimal":
            number = Decimal(value)
            if number.is_finite():
                return number
        elif kind == "date":
            return date.fromisoformat(value)
        elif kind == "datetime":
            return datetime.fromisoformat(value)
        elif kind == "boolean":
            if value.strip().lower() in TRUE + FALSE:
                return value.strip().lower() in TRUE
        else:
            return value
    except (ValueError, ArithmeticError):
        pass
    raise Refused(f"not a {kind}")


def predicate(data: Dataset, name: str, operator: str, value: str, upper: str | None = None) -> Column:
    """One filter. between takes both ends; a bare day as the upper end of a datetime takes that whole day."""
    column = data.fields.get(name)
    if column is None or not column.filter or not re.fullmatch("[a-z0-9_]+", name):
        raise Refused("unknown or disallowed filter column")
    c, low = F.col(name), F.lit(bound(value, column.kind)).cast(SPARK_TYPE[column.kind])
    if operator == "between":
        if upper is None:
            raise Refused("between needs an upper value")
        high = bound(upper, column.kind)
        if column.kind == "datetime" and re.fullmatch(r"\d{4}-\d{2}-\d{2}", upper):
            return (c >= low) & (c < F.lit(high + timedelta(days=1)).cast("timestamp_ntz"))
        return (c >= low) & (c <= F.lit(high).cast(SPARK_TYPE[column.kind]))
    if operator != "eq" and column.kind not in ("integer", "decimal"):
        raise Refused("comparison of a column that is no number")
    tests = {"eq": c == low, "gt": c > low, "gte": c >= low, "lt": c < low, "lte": c <= low}
    if operator not in tests:
        raise Refused("unknown operator")
    return tests[operator]


def aggregated(data: Dataset, df: DataFrame, function: str, metric: str | None = None, filters: list[tuple] = ()) -> DataFrame:
    """One row: aggregate_value, total_count, valid_count, null_count. avg comes as a double with six places."""
    if function not in ("avg", "sum", "min", "max", "count"):
        raise Refused("unknown aggregate")
    if metric is None and function != "count":
        raise Refused("this aggregate needs a metric")
    if metric is not None and (metric not in data.fields or function != "count" and not data.fields[metric].aggregate):
        raise Refused("unknown or disallowed aggregate column")
    rows = data.of(df).where(conjunction([predicate(data, *f) for f in filters]))
    total = F.count("*")
    if metric is None:
        return rows.agg(total.alias("aggregate_value"), total.alias("total_count"), total.alias("valid_count"), F.lit(0).cast("long").alias("null_count"))
    m = F.col(metric)
    # sums of integers leave 64 bits
    wide = m.cast("decimal(38,0)") if data.fields[metric].kind == "integer" and function in ("sum", "avg") else m
    value = {"avg": lambda: F.round(F.avg(wide).cast("double"), 6), "sum": lambda: F.sum(wide), "min": lambda: F.min(m), "max": lambda: F.max(m), "count": lambda: F.count(m)}[function]()
    return rows.agg(value.alias("aggregate_value"), total.alias("total_count"), F.count(m).alias("valid_count"), (total - F.count(m)).alias("null_count"))
