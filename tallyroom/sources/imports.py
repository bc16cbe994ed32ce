"""Files of evaluation cases (JSON arrays, CSV, workbooks) read into records, and records into cases.

Whatever is wrong with a file or a record is a row that says so; no file fails the job. CSV files and workbooks become
JSON text in one small step for each file, and are then read as JSON files are, by functions on variants.
"""

from __future__ import annotations

import csv
import io
import json
import zipfile
from itertools import islice
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyroom.functions.values import stripped
from tallyroom.operators.cases import MAX_KEY, MAX_NAME, MAX_TAGS, MAX_TOP_K, TOP_K
from tallyroom.sources.files import MAX_UNZIPPED, sheet_rows
from tallyroom.tables import staged

# Limits of a file and a question, and what a boolean is written as.
MAX_BYTES, MAX_FILE_NAME, MAX_ROWS, MAX_QUESTION = 5 << 20, 240, 2000, 1000
TRUE, FALSE = ("true", "1", "是", "应有答案"), ("false", "0", "否", "应无答案")


def _table(name: str, content: bytes) -> tuple[str | None, str | None]:
    """Records of a CSV file or a workbook's first sheet as JSON text, or what is wrong with it."""
    if name.endswith(".csv"):
        try:
            reader = csv.DictReader(io.StringIO(content.decode("utf-8-sig")))
            records = list(islice(reader, MAX_ROWS + 1))
        except UnicodeDecodeError:
            return None, "not_utf8"
        except csv.Error:
            return None, "invalid_csv"
        records = [{k: v for k, v in r.items() if k is not None} for r in records]
    else:
        try:
            with zipfile.ZipFile(io.BytesIO(content)) as z:
                if sum(i.file_size for i in z.infolist()) > MAX_UNZIPPED:
                    return None, "unpacks_to_too_much"
            rows = ((row, cells) for sheet, row, cells, _ in sheet_rows(content, first=True))
            header = next(rows, (0, []))[1]
            names = [(h or "").strip() for h in header]
            records = [dict(zip(names, cells + [None] * (len(names) - len(cells)), strict=False)) for _, cells in islice(rows, MAX_ROWS + 1)]
        except (zipfile.BadZipFile, ElementTree.ParseError, KeyError, ValueError, IndexError, TypeError):
            return None, "invalid_xlsx"
    return json.dumps(records, ensure_ascii=False), None


@F.pandas_udf(T.StructType([T.StructField("text", T.StringType()), T.StructField("problem", T.StringType())]))
def _tables(name: pd.Series, content: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([_table(n, bytes(c)) for n, c in zip(name, content, strict=True)], columns=["text", "problem"])


def records(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of files (path, length, content; as the binaryFile source gives them) a summary (path, n_records, problem) and
    the records (path, row_number, record): row numbers count from 2, as a header would be 1; record is JSON text.

    The name of a file is what follows the last slash. A file with a problem has no records. Repeated files are read
    each; an empty folder gives no rows.
    """
    name = F.lower(F.regexp_extract("path", r"[^/]*$", 0))
    files = files.withColumns({"_name": name, "_kind": F.regexp_extract(name, r"\.(json|csv|xlsx)$", 1)})
    bounds = F.when(F.length("_name") > MAX_FILE_NAME, "name_too_long").when(F.col("length") == 0, "empty").when(F.col("length") > MAX_BYTES, "too_large").when(F.col("_kind") == "", "unknown_type")
    files = files.withColumn("_refused", bounds)
    refused = files.where("_refused IS NOT NULL").select("path", F.col("_refused").alias("problem"), F.lit(None).cast("string").alias("text"))
    good = files.where("_refused IS NULL")
    texts = F.regexp_replace(F.try_validate_utf8(F.col("content").cast("string")), "^\ufeff", "")
    plain = good.where("_kind = 'json'").select("path", F.when(texts.isNull(), "not_utf8").alias("problem"), texts.alias("text"))
    tables = good.where("_kind <> 'json'").select("path", _tables("_name", "content").alias("t")).select("path", "t.problem", "t.text")
    every = refused.unionByName(plain).unionByName(tables).withColumn("_v", F.try_parse_json("text"))
    array = F.schema_of_variant("_v").startswith("ARRAY")
    items = F.transform(F.when(array, F.col("_v").cast("array<variant>")), lambda x: F.to_json(x))
    every = every.select("path", "problem", F.col("_v").isNull().alias("_bad"), array.alias("_array"), items.alias("items"))
    n = F.coalesce(F.size("items"), F.lit(0))
    problem = F.coalesce("problem", F.when(F.col("_bad"), "invalid_json").when(~F.col("_array"), "not_an_array").when(n > MAX_ROWS, "too_many_rows").when(n == 0, "no_records"))
    read = staged(every.select("path", problem.alias("problem"), "items"), "imports")
    rows = read.where("problem IS NULL").select("path", F.posexplode("items").alias("at", "record")).select("path", (F.col("at") + 2).alias("row_number"), "record")
    return read.select("path", F.when(F.col("problem").isNull(), F.size("items")).otherwise(0).alias("n_records"), "problem"), rows


def _value(*names: str) -> Column:
    """The value of the first of the names that the record's fields have, without regard to white space around them."""
    entries = F.col("_fields")
    held = lambda n: F.try_element_at(F.filter(entries, lambda e: stripped(e["key"]) == n), F.lit(-1))
    out = F.when(held(names[0]).isNotNull(), held(names[0])["value"])
    for n in names[1:]:
        out = out.when(held(n).isNotNull(), held(n)["value"])
    return out


def _is(v: Column, *kinds: str) -> Column:
    return F.coalesce(F.schema_of_variant(v).rlike("^(" + "|".join(kinds) + ")"), F.lit(False))


def _text(v: Column) -> Column:
    return F.when(~_is(v, "OBJECT", "ARRAY", "VOID"), v.cast("string"))


def _list(v: Column) -> Column:
    """The different items of a list, or of a text between bars, stripped and without blanks; null where an item is no
    scalar or the value neither."""
    items = F.when(_is(v, "ARRAY"), v.cast("array<variant>"))
    scalars = F.when(~F.exists(items, lambda x: _is(x, "OBJECT", "ARRAY")), F.transform(items, lambda x: x.cast("string")))
    parts = F.when(v.isNull() | _is(v, "VOID"), F.array().cast("array<string>")).when(_is(v, "STRING"), F.split(v.cast("string"), r"\|")).otherwise(scalars)
    return F.array_distinct(F.filter(F.transform(parts, stripped), lambda x: F.length(x) > 0))


def cases(rows: DataFrame, sources: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of records (path, row_number, record) the cases, and the problems (path, row_number, field, problem) of those
    that are none, the first problem of each. sources: source_id, source_name.

    A case has question (white space collapsed), expect_answer, expected_source_ids, expected_terms, category, tags,
    top_k and external_key. Fields go by snake case or camel case names. Null items of lists are left out.
    """
    parsed = rows.withColumn("_r", F.try_parse_json("record"))
    object_ = _is(F.col("_r"), "OBJECT")
    parsed = parsed.withColumn("_fields", F.map_entries(F.when(object_, F.col("_r").cast("map<string,variant>"))))
    fields = {
        "question": ("question",), "expect_answer": ("expect_answer", "expectAnswer"), "expected_sources": ("expected_sources", "expectedSources"), "expected_terms": ("expected_terms", "expectedTerms"),
        "top_k": ("top_k", "topK"), "category": ("category",), "tags": ("tags",), "external_key": ("external_key", "externalKey"),
    }
    parsed = parsed.withColumns({f"_{f}": _value(*names) for f, names in fields.items()}).withColumn("_object", object_)
    c = {f: F.col(f"_{f}") for f in fields}
    lists = {f: _list(c[f]) for f in ("expected_sources", "expected_terms", "tags")}
    optional = lambda f: F.nullif(stripped(_text(c[f])), F.lit(""))
    word = F.lower(stripped(_text(c["expect_answer"])))
    scalar = _is(c["expect_answer"], "STRING", "BOOLEAN", "BIGINT")
    answer = F.when(scalar & word.isin(*TRUE), True).when(scalar & word.isin(*FALSE), False)
    k = stripped(_text(c["top_k"]))
    whole = F.when(_is(c["top_k"], "STRING"), F.when(k.rlike(r"^[+-]?\d+$"), k.try_cast("int"))).when(_is(c["top_k"], "BOOLEAN"), None).when(k.rlike(r"^[+-]?\d+(\.0*)?$"), k.try_cast("decimal(20,4)").try_cast("int"))
    number = F.when(c["top_k"].isNull() | _is(c["top_k"], "VOID") | (F.length(k) == 0), TOP_K).when(whole.between(1, MAX_TOP_K), whole)
    out = parsed.select(
        "path", "row_number", "_object", *[c[f] for f in fields], F.nullif(stripped(F.regexp_replace(_text(c["question"]), r"(?U)\s+", " ")), F.lit("")).alias("question"), answer.alias("expect_answer"),
        *[v.alias(f) for f, v in lists.items()], number.alias("top_k"), optional("category").alias("category"), optional("external_key").alias("external_key"),
    )
    out = staged(_with_ids(out, sources), "cases")
    nested = lambda f: _is(c[f], "OBJECT", "ARRAY")
    rules = [
        ("row", "no_object", ~F.col("_object")), ("question", "no_scalar", nested("question")), ("question", "missing", F.col("question").isNull()), ("question", "too_long", F.length("question") > MAX_QUESTION),
        ("expect_answer", "missing", c["expect_answer"].isNull() | _is(c["expect_answer"], "VOID") | (F.length(stripped(_text(c["expect_answer"]))) == 0)), ("expect_answer", "no_scalar", nested("expect_answer")), ("expect_answer", "no_boolean", F.col("expect_answer").isNull()),
        ("expected_sources", "no_list", F.col("expected_sources").isNull()), ("expected_sources", "unknown", F.col("_state") == "unknown"), ("expected_sources", "ambiguous", F.col("_state") == "ambiguous"), ("expected_terms", "no_list", F.col("expected_terms").isNull()),
        ("expected_evidence", "missing", F.col("expect_answer") & (F.size("expected_source_ids") == 0) & (F.size("expected_terms") == 0)), ("top_k", "out_of_bounds", F.col("top_k").isNull()),
        ("category", "no_scalar", nested("category")), ("tags", "no_list", F.col("tags").isNull()), ("external_key", "no_scalar", nested("external_key")), ("tags", "too_many", F.size("tags") > MAX_TAGS),
        ("tags", "too_long", F.exists("tags", lambda t: F.length(t) > MAX_NAME)), ("category", "too_long", F.length("category") > MAX_NAME), ("external_key", "too_long", F.length("external_key") > MAX_KEY),
    ]
    wrong = F.filter(F.array(*[F.when(F.coalesce(test, F.lit(False)), F.struct(F.lit(f).alias("field"), F.lit(p).alias("problem"))) for f, p, test in rules]), lambda x: x.isNotNull())
    told = out.withColumn("_wrong", F.try_element_at(wrong, F.lit(1)))
    good = told.where("_wrong IS NULL").select("path", "row_number", "question", "expect_answer", "expected_source_ids", "expected_terms", "category", "tags", "top_k", "external_key")
    return good, told.where("_wrong IS NOT NULL").select("path", "row_number", "_wrong.field", "_wrong.problem")


def _with_ids(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """rows with expected_source_ids (null where a name is unknown or ambiguous) and _state of the first such name."""
    held = sources.select(stripped(F.col("source_name")).alias("name"), F.col("source_id").cast("string").alias("source_id")).where("length(name) > 0 AND length(trim(source_id)) > 0")
    held = held.groupBy("name").agg(F.count("*").alias("n"), F.min("source_id").alias("source_id"))
    asked = rows.select("path", "row_number", F.posexplode("expected_sources").alias("place", "name")).join(held, "name", "left")
    state = F.when(F.col("n").isNull(), "unknown").when(F.col("n") > 1, "ambiguous")
    found = asked.groupBy("path", "row_number").agg(
        F.min(F.when(state.isNotNull(), F.struct("place", state.alias("state"))))["state"].alias("_state"),
        F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("place", "source_id"))), lambda x: x["source_id"])).alias("expected_source_ids"),
    )
    return rows.join(found, ["path", "row_number"], "left").withColumn("expected_source_ids", F.coalesce("expected_source_ids", F.array().cast("array<string>")))
