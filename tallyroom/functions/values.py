"""Columns that name, classify, convert and encode the values of governed datasets."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# The patterns of typed cells.
INTEGER = r"^[+-]?\d+$"
DECIMAL = r"^[+-]?(\d+\.\d*|\.\d+|\d+)([eE][+-]?\d+)?$"
DATE = r"^\d{4}-\d{2}-\d{2}$"
DATETIME = r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(:\d{2}(\.\d{3}(\d{3})?)?)?(Z|[+-]\d{2}:\d{2})?$"
# The literals that ingestion reads as true and false.
TRUE, FALSE = ("1", "true", "yes", "y", "on"), ("0", "false", "no", "n", "off")


def bound(c: Column, f: Callable[[Column], Column]) -> Column:
    """f(c), where c is evaluated once, however often f reads it."""
    return F.get(F.transform(F.array(c), f), F.lit(0))


#: White space of any script.
BLANKS = "\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def stripped(c: Column) -> Column:
    """Without white space at either end, of any script."""
    # no pattern: this would be tried at every blank of a text
    return F.trim(c, F.lit(BLANKS))


def physical_name(original: Column, index: Column) -> Column:
    """Lower case, anything but a-z, 0-9 and _ as _, none at the ends, never digit first, never empty."""
    name = F.regexp_replace(F.regexp_replace(F.lower(original), "[^a-z0-9_]+", "_"), "^_+|_+$", "")
    return F.when(name.rlike("^[0-9]"), F.concat(F.lit("col_"), name)).when(F.length(name) > 0, name).otherwise(F.concat(F.lit("column_"), index.cast("string")))


def value_type(c: Column) -> Column:
    """Type that one cell's text looks like; null for blank cells. Dates and times must exist in the calendar."""
    t = stripped(c)
    day = F.substring(t, 1, 10).try_cast("date").isNotNull()
    return (
        F.when(c.isNull() | (F.length(t) == 0), F.lit(None).cast("string"))
        .when(F.lower(t).isin("true", "false"), "boolean")
        .when(t.rlike(INTEGER), "integer")
        .when(t.rlike(DECIMAL), "decimal")
        .when(t.rlike(DATE) & day, "date")
        .when(t.rlike(DATETIME) & day & F.regexp_replace(F.regexp_replace(t, "(Z|[+-][0-9]{2}:[0-9]{2})$", ""), "T", " ").try_cast("timestamp_ntz").isNotNull(), "datetime")
        .otherwise("string")
    )


def resolved_type(observed: Column) -> Column:
    """One type for the set of types seen in a column: none or mixed is string, integers among decimals are decimals."""
    kinds = F.array_sort(F.array_distinct(F.filter(observed, lambda x: x.isNotNull())))
    return F.when(F.size(kinds) == 1, kinds[0]).when(kinds == F.array(F.lit("decimal"), F.lit("integer")), "decimal").otherwise("string")


def decimal_38_9(c: Column) -> Column:
    """A number's text rounded half-even to nine places, from all its digits; null with more than 29 before the point."""
    # nearly all numbers fit a decimal as they are, and need none of the steps on digits
    plain, longer = r"^[+-]?[0-9]{1,29}(\.[0-9]{1,9})?$", r"^[+-]?[0-9]{1,17}\.[0-9]{1,20}$"
    short = lambda t: F.when(t.rlike(plain), t.try_cast("decimal(38,9)")).when(t.rlike(longer), F.bround(t.try_cast("decimal(38,20)"), 9).cast("decimal(38,9)"))
    return bound(c, lambda t: short(t).otherwise(_from_digits(t)))


def _from_digits(c: Column) -> Column:
    def parts(text: Column) -> Column:
        part = lambda i: F.regexp_extract(text, r"^([+-]?)(\d*)\.?(\d*)(?:[eE]([+-]?\d+))?$", i)
        power = F.greatest(F.least(F.coalesce(part(4).try_cast("decimal(20,0)"), F.lit(0)), F.lit(99)), F.lit(-99)).cast("int")
        return F.struct(part(1).alias("sign"), part(2).alias("whole"), part(3).alias("fraction"), power.alias("power"))

    def moved(p: Column) -> Column:
        # the digits with the point moved by the power of ten
        before = F.repeat(F.lit("0"), F.greatest(-p["power"], F.lit(0)))
        digits = F.concat(before, p["whole"], p["fraction"], F.repeat(F.lit("0"), F.greatest(p["power"] - F.length(p["fraction"]), F.lit(0)) + 10))
        return F.struct(p["sign"].alias("sign"), digits.alias("digits"), (F.length(before) + F.length(p["whole"]) + p["power"]).alias("point"))

    def cut(d: Column) -> Column:
        kept, rest = F.substr(d["digits"], F.lit(1), d["point"] + 9), F.rtrim(F.substr(d["digits"], d["point"] + 10), F.lit("0"))
        return F.struct(d["sign"].alias("sign"), kept.alias("kept"), rest.alias("rest"))

    def whole(x: Column) -> Column:
        odd = F.substring(x["kept"], -1, 1).isin("1", "3", "5", "7", "9")
        up = (x["rest"] > "5") | ((x["rest"] == "5") & odd)
        # as a whole number, where one more in the last place is exact; lpad would cut what is longer
        number = (F.concat(F.lit("0"), x["kept"]).try_cast("decimal(38,0)") + F.when(up, 1).otherwise(0)).cast("decimal(38,0)").cast("string")
        number = bound(number, lambda n: F.when(F.length(n) < 10, F.lpad(n, 10, "0")).otherwise(n))
        return F.concat(x["sign"], F.regexp_replace(number, r"(\d{9})$", ".$1")).try_cast("decimal(38,9)")

    # each step bound, as the next ones read it many times
    return bound(bound(bound(bound(c, parts), moved), cut), whole)


def converted(c: Column, kind: str) -> Column:
    """Strict conversion of a cell's text to a confirmed type; null where it fails (or is blank)."""
    t = stripped(c)
    if kind == "string":
        return c
    if kind == "integer":
        return F.when(t.rlike(INTEGER), t.try_cast("bigint"))
    if kind == "decimal":
        return F.when(t.rlike(DECIMAL), decimal_38_9(t))
    if kind == "date":
        return F.when(t.rlike(DATE), t.try_cast("date"))
    if kind == "datetime":  # zoned values are not taken
        return F.when(t.rlike(DATE + "|" + DATETIME) & ~t.rlike("(Z|[+-][0-9]{2}:[0-9]{2})$"), F.date_trunc("millisecond", F.replace(t, F.lit("T"), F.lit(" ")).try_cast("timestamp_ntz")).cast("timestamp_ntz"))
    low = F.lower(t)
    return F.when(low.isin(*TRUE), True).when(low.isin(*FALSE), False)


def blank(c: Column) -> Column:
    return c.isNull() | (F.length(stripped(c)) == 0)


def with_null_policy(c: Column, policy: str, kind: str) -> Column:
    """ignore and reject leave nulls (rejected rows are reported apart); zero fills numeric columns."""
    return F.coalesce(c, F.lit(0).cast("bigint" if kind == "integer" else "decimal(38,9)")) if policy == "zero" and kind in ("integer", "decimal") else c


def redacted(c: Column) -> Column:
    """What an error may show of a value: the start of its digest and its size."""
    return F.concat(F.lit("[redacted sha256:"), F.substring(F.sha2(c, 256), 1, 12), F.lit(" len="), F.octet_length(c).cast("string"), F.lit("]"))


def canonical(c: Column, kind: str) -> Column:
    """N; for null, else V, the size in bytes, a colon, the text and a semicolon."""
    text = {
        "boolean": lambda: F.when(c, "1").otherwise("0"),
        "datetime": lambda: F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSS"),
        "date": lambda: F.date_format(c, "yyyy-MM-dd"),
    }.get(kind, lambda: c.cast("string"))()
    return F.when(c.isNull(), "N;").otherwise(F.concat(F.lit("V"), F.octet_length(text).cast("string"), F.lit(":"), text, F.lit(";")))


def digest_lane(digest_hex: Column, lane: int) -> Column:
    """Bytes 8*lane.. of a hex digest as a little-endian number from 0 to 2^64 - 1, decimal(20,0)."""
    swapped = F.concat(*[F.substring(digest_hex, lane * 16 + 2 * i + 1, 2) for i in range(7, -1, -1)])
    return F.conv(swapped, 16, 10).cast("decimal(20,0)")


def conjunction(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, parts, F.lit(True))


def unique_names(names: Column) -> Column:
    """Physical names of a header's cells: the second of one name gets _2, or the next number that is free, and so on."""
    based = F.transform(names, lambda n, i: physical_name(F.coalesce(n, F.lit("")), i + 1))

    def add(have: Column, base: Column) -> Column:
        free = F.filter(F.transform(F.sequence(F.lit(2), F.size(have) + 2), lambda k: F.concat(base, F.lit("_"), k.cast("string"))), lambda n: ~F.array_contains(have, n))
        return F.concat(have, F.array(F.when(F.array_contains(have, base), free[0]).otherwise(base)))

    return F.aggregate(based, F.array().cast("array<string>"), add)


def schema_hash(columns: Column) -> Column:
    """SHA-256 of the columns of a preview (array of structs aliases, data_type, display_name, original_name,
    physical_name, in this order) as compact JSON."""
    return F.sha2(F.to_json(columns, {"ignoreNullFields": "false"}), 256)


def safe_identifier(c: Column) -> Column:
    """Lower case, anything but a-z, 0-9 and _ as _, none at the ends, 48 characters at most; a digest where nothing is left."""
    name = F.regexp_replace(F.regexp_replace(F.lower(stripped(c)), "[^a-z0-9_]+", "_"), "^_+|_+$", "")
    return F.substring(F.when(F.length(name) > 0, name).otherwise(F.substring(F.sha2(c, 256), 1, 16)), 1, 48)


def same_number(a: Column, b: Column) -> Column:
    """Whether two texts or numbers are one number, whatever its form; two nulls are, a null and a number aren't.
    Numbers have up to 18 places before 20 digits, 9 before 29 and none before 38; what is no such number is compared
    as text."""
    number = lambda c, scale: c.cast("string").try_cast(f"decimal(38,{scale})")
    same = F.coalesce(*[number(a, scale) == number(b, scale) for scale in (18, 9, 0)], a.cast("string") == b.cast("string"))
    return F.when(a.isNull() | b.isNull(), a.isNull() & b.isNull()).otherwise(same)


def record_estimate(size: Column, kind: Column) -> Column:
    """Records that a file of `size` bytes is taken to hold before it is read: one for each 512 bytes of a document, 256
    of anything else, from 1 to 9999."""
    step = F.when(kind.isin("文档", "PDF"), 512).otherwise(256)
    return F.least(F.lit(9999), F.greatest(F.lit(1), F.ceil(F.coalesce(size, F.lit(0)) / step))).cast("int")


def shown_number(c: Column, places: int = 0) -> Column:
    """With thousands separators; null as a word."""
    return F.coalesce(F.format_number(c, places), F.lit("null"))


def shown_filters(filters: Column) -> Column:
    """Filters (physical_name, operator, value, upper) as they are told beside an answer."""
    told = F.transform(filters, lambda f: F.concat(f["physical_name"], F.lit(":"), f["operator"], F.lit(":"), f["value"], F.coalesce(F.concat(F.lit(".."), f["upper"]), F.lit(""))))
    return F.when(F.size(filters) > 0, F.array_join(told, ",")).otherwise("none")
