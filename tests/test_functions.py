"""Columns against plain Python."""

import hashlib
import io
import json
import random
import re
import zipfile
from decimal import ROUND_HALF_EVEN, Decimal, localcontext

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallyroom.functions import text as tx
from tallyroom.functions import values as vx
from tallyroom.sources import files


def column(spark, values, f, kind="string"):
    """f applied to each value, in order."""
    rows = spark.createDataFrame(list(enumerate(values)), f"i int, c {kind}").select("i", f(F.col("c")).alias("r")).collect()
    return [r.r for r in sorted(rows)]


def test_white_space_as_by_patterns(spark):
    rng = random.Random(4)
    signs = ["\x00", "\r", "\n", " ", "\t", "a", "é", "　", "\r\n", "\x85", "\u2029", "\x0b", "\x1c", "票", " " * 9, "\n\n"]
    cells = [chr(i) + "a" + chr(i) for i in range(1, 0x3100)] + ["".join(rng.choice(signs) for _ in range(rng.randrange(30))) for _ in range(3000)]

    def by_patterns(c):
        for pattern, by in (("\x00", ""), ("\r\n?", "\n"), ("[ \t]+", " "), ("\n{3,}", "\n\n")):
            c = F.regexp_replace(c, pattern, by)
        return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")

    assert column(spark, cells, tx.normalised) == column(spark, cells, by_patterns)
    assert column(spark, cells, vx.stripped) == column(spark, cells, lambda c: F.regexp_replace(c, r"(?U)^\s+|\s+$", ""))
    # a text without anything to replace meets no pattern for its blanks
    assert "regexp_replace" not in str(vx.stripped(F.col("c")))


def test_types(spark):
    cells = [" 12 ", "-1", "1.5", ".5", "1e3", "2024-02-29", "2023-02-29", "2024-1-2", "2024-01-02T03:04:05", "2024-01-02 03:04", "2024-01-02T03:04:05Z", "TRUE", "false", "yes", "", None, "　", "x"]
    assert column(spark, cells, vx.value_type) == ["integer", "integer", "decimal", "decimal", "decimal", "date", "string", "string", "datetime", "datetime", "datetime", "boolean", "boolean", "string", None, None, None, "string"]
    seen = [["integer"], ["integer", "decimal"], [], ["date", "integer"], ["decimal"], ["boolean", None]]
    assert column(spark, seen, vx.resolved_type, "array<string>") == ["integer", "decimal", "string", "string", "decimal", "boolean"]


def test_conversion(spark):
    decimals = ["1", "0.0000000005", "0.0000000015", "-2.5", "x", "12345678901234567890.123456789", "12345678901234567890123456789.0000000005", "0.00000000050000000000000000001", "-0.0000000025", "1.5e3", "25e-10", ".5", "7.", "123e-12", "-1E2"]
    with localcontext() as context:
        context.prec = 38
        expected = [None if d == "x" else Decimal(d).quantize(Decimal("1e-9"), ROUND_HALF_EVEN) for d in decimals]
    assert column(spark, decimals, lambda c: vx.converted(c, "decimal")) == expected
    assert column(spark, ["5", " 7 ", "1.5", ""], lambda c: vx.converted(c, "integer")) == [5, 7, None, None]
    assert [str(x) for x in column(spark, ["2024-02-29", "2024-2-9", "2023-02-29"], lambda c: vx.converted(c, "date"))] == ["2024-02-29", "None", "None"]
    assert [str(x) for x in column(spark, ["2024-01-02", "2024-01-02T03:04:05.678", "2024-01-02T03:04:05Z"], lambda c: vx.converted(c, "datetime"))] == ["2024-01-02 00:00:00", "2024-01-02 03:04:05.678000", "None"]
    assert column(spark, ["Yes", "off", "1", "maybe"], lambda c: vx.converted(c, "boolean")) == [True, False, True, None]
    assert column(spark, [" keep "], lambda c: vx.converted(c, "string")) == [" keep "]


def test_short_ways_to_a_decimal(spark):
    texts = ["1.0000000005", "1.0000000015", "-1.0000000015", "-0.0000000005", "+7", "007.10", "1.00000000050000000001", "9" * 29, "9" * 29 + ".999999999", "9" * 17 + ".99999999950000000000", "0.1234567885"]
    number = vx.decimal_38_9(F.col("t"))
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(number.alias("a"), vx._from_digits(F.col("t")).alias("b"))
    assert [r["a"] for r in df.collect()] == [r["b"] for r in df.collect()]
    assert None not in [r["a"] for r in df.collect()]


def test_names(spark):
    assert column(spark, ["Order Amount!", "2024 sales", "金额", "__a__"], lambda c: vx.physical_name(c, F.lit(3))) == ["order_amount", "col_2024_sales", "column_3", "a"]


def test_digest_lanes(spark):
    digest = hashlib.sha256(b"a").digest()
    expected = [int.from_bytes(digest[i : i + 8], "little") for i in range(0, 32, 8)]
    row = spark.range(1).select(*[vx.digest_lane(F.sha2(F.lit("a"), 256), i).alias(str(i)) for i in range(4)]).first()
    assert [int(x) for x in row] == expected and expected[0] == 14608863320967583690
    assert column(spark, [None, "é"], lambda c: vx.canonical(c, "string")) == ["N;", "V2:é;"]
    zero = spark.sql("SELECT CAST(0 AS DECIMAL(38,9)) d").select(vx.canonical(F.col("d"), "decimal")).first()[0]
    assert zero == "V11:0.000000000;"


def chunks(text, size=600, overlap=120):
    out, start = [], 0
    while True:
        end = min(len(text), start + size)
        if part := text[start:end].strip():
            out.append(part)
        if end >= len(text):
            return out
        start = end - overlap


@settings(max_examples=30, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(texts=st.lists(st.integers(0, 3000).map(lambda n: ("ab cd　ef\n" * 400)[:n]), min_size=1, max_size=8))
def test_chunks(spark, texts):
    assert column(spark, texts, tx.windows) == [chunks(t) for t in texts]


def test_text(spark):
    assert column(spark, [" a\x00b\r\nc\rd  \t e\n\n\n\nf　", None], tx.normalised) == ["ab\nc\nd e\n\nf", None]
    assert column(spark, ["abc def 中文", ""], tx.token_estimate) == [4, 1]
    assert column(spark, ["差旅 票据abc_1 x"], tx.raw_terms) == [["abc_1", "差旅", "旅票", "票据", "据a"]]
    assert set(tx.GROUPS[2]) <= set(column(spark, ["票据"], tx.search_terms)[0]) and column(spark, ["什么"], tx.search_terms) == [[]]
    assert column(spark, ["a | b||a |  "], tx.pipe_list) == [["a", "b"]]
    assert column(spark, ["  " + "x" * 30, "short"], tx.title) == ["x" * 18 + "...", "short"]
    assert column(spark, ["see [1] and [2, 3] ."], tx.without_citations) == ["see and [2, 3]."]
    assert column(spark, ["<p>a</p><script>x</script> b"], tx.plain_html) == ["a b"]
    hay = "src1 en the policy"
    scores = spark.createDataFrame([("the policy", hay), ("xy", hay), ("中", hay)], "q string, h string").select(tx.keyword_score(tx.search_terms(F.col("q")), F.col("q"), F.col("h"))).collect()
    assert [r[0] for r in scores] == [3 + 3 + 8, 0, 0]


ANSWERS = {
    "one\n[1] two": "one\n two", "x [0] [1, 2] [12].": "x [0] [1, 2].", "a 、b": "a、b", "a\n. b": "a\n. b", "`code` and **bold**": "`code` and bold", "  - item **x**": "  - item **x**",
    "- **x**": "x", "- a **x**": "- a x", "**a****b**": "ab", "**a**b": "**a**b", "a**b**": "a**b**", "_**b**": "_**b**", "\\**b**": "\\**b**", "**b\\**": "**b\\**", "** b**": "** b**", "**b **": "**b **",
    "***b***": "***b***", "**a** ***b***": "**a** ***b***", "**a* *b**": "a* *b", "****": "****", "**": "**", "**a** **": "**a** **", "```\n**a**": "```\n**a**", "```**a**``` **b**": "```**a**``` b",
    "`**a**\n**b**": "`**a**\nb", "``**a**` **b**": "``a` **b**", "\t**a**\n**b**": "**a**\nb", "    **a**": "**a**", "a\n   **b**": "a\n   b", "": "", None: None, "**é**é": "éé", "*a* **b**": "*a* b",
}


def test_answers(spark):
    assert column(spark, list(ANSWERS), tx.answer_text) == list(ANSWERS.values())


@given(st.text("*ab_ \\`-\n\r\t[1]", max_size=40))
def test_answers_keep_what_is_no_mark(text):
    got = tx.plain_answer(text)
    # nothing but stars and list marks goes, and code stays whole
    assert got.replace("*", "").replace("-", "").replace(" ", "").replace("\t", "") == text.replace("*", "").replace("-", "").replace(" ", "").replace("\t", "")
    assert (text.count("*") - got.count("*")) % 4 in (0, 1, 2, 3) and len(got) <= len(text)
    if "**" not in text:
        assert got == text
    for fence in text.split("```")[1::2]:
        assert fence in got


def test_embedding(spark):
    v = column(spark, ["报销 invoice", ""], tx.embedding)
    assert len(v[0]) == tx.DIMENSIONS and abs(sum(x * x for x in v[0]) - 1) < 1e-9 and not any(v[1])


def workbook():
    out = io.BytesIO()
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {ns} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="明细" sheetId="1" r:id="rId1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}><si><t>金额</t></si><si><r><t>地</t></r><r><t>区</t></r></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {ns}><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1" t="s"><v>1</v></c></row><row r="3"><c r="A3"><f>1+1</f><v>2</v></c><c r="C3" t="b"><v>1</v></c><c r="D3"/></row></sheetData></worksheet>')
    return out.getvalue()


def document():
    out = io.BytesIO()
    ns = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f"<w:document {ns}><w:body><w:p><w:r><w:t>First</w:t></w:r></w:p><w:p/><w:tbl><w:tr><w:tc><w:p><w:r><w:t>a</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>b</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>")
    return out.getvalue()


def test_files(spark, tmp_path):
    (tmp_path / "a.xlsx").write_bytes(workbook())
    (tmp_path / "b.docx").write_bytes(document())
    (tmp_path / "c.txt").write_bytes("你好 世界".encode("gb18030"))
    (tmp_path / "e.csv").write_bytes('a, b ,\n"x ""y""",,2\n'.encode())
    (tmp_path / "d.md").write_bytes(b"\xef\xbb\xbf# hi")
    got = {r.path.rpartition("/")[2]: r.text for r in files.documents(spark, f"file://{tmp_path}").collect()}
    assert got == {"a.xlsx": "[明细]\n金额 | 地区\n2 | true", "b.docx": "First\na | b", "c.txt": "你好 世界", "d.md": "# hi", "e.csv": 'a | b\nx "y" | 2'}
    cells = files.xlsx_cells(files.binary(spark, f"file://{tmp_path}", "*.xlsx")).orderBy("row_number").collect()
    assert [(r.row_number, r.cells, r.formulas[0]) for r in cells] == [(1, ["金额", "地区"], None), (3, ["2", None, "true"], "=1+1")]


@pytest.mark.parametrize("data,name", [(b"abc", "utf-8"), ("é".encode(), "utf-8"), ("中".encode("gb18030"), "gb18030"), (b"\xff\xfea\0", None), (b"a\0b", None), (b"\xef\xbb\xbfa", "utf-8-sig")])
def test_encodings(data, name):
    assert files.encoding_of(data) == name


def test_csv(spark, tmp_path):
    (tmp_path / "x.csv").write_text('h1,h2\n"a ""q""","line\nbreak"\n,  \n', encoding="utf-8")
    rows = files.csv_cells(spark, f"file://{tmp_path}/x.csv", ["a", "b"]).collect()
    assert rows[0].a == 'a "q"' and rows[0].b == "line\nbreak" and re.fullmatch(r"\s*", rows[1].b or "")


def test_imports(spark):
    from tallyroom.sources import imports

    header = "question,expect_answer,expected_sources,expected_terms,top_k,category,tags,external_key\n"
    contents = {
        "a.json": json.dumps([{"question": " a\n b ", "expectAnswer": True, "expected_terms": ["x", " x", 7, None]}, 5, {"question": ["q"]}, {"question": "", "expect_answer": 1}, {"question": "q"}, {"question": "q", "expect_answer": 2},
                              {"question": "q", "expect_answer": 0, "topK": 3.0, " tags ": "t| |u", "category": None}, {"question": "q", "expect_answer": "1", "expected_sources": "one|two"}, {"question": "q", "expect_answer": "1"},
                              {"question": "q", "expect_answer": 0, "top_k": True}, {"question": "q", "expect_answer": 0, "top_k": 2.5}, {"question": "q", "expect_answer": 0, "tags": [["n"]]}, {"question": "q", "expect_answer": 0, "category": "c" * 81},
                              {"question": "q", "expect_answer": 1, "expected_sources": ["one", "one "]}, {"question": "q" * 1001}]).encode(),
        "b.csv": (header + '"x, ""y""",false,,,,,,k\n').encode("utf-8-sig"), "c.csv": "é".encode("latin-1"), "d.json": b"\xff", "e.json": b"[]", "f.json": json.dumps([{}] * 2001).encode(), "g.xlsx": b"no zip", "h.json": b"", "i" * 240 + ".json": b"[]", "j.json": b"x" * (5 << 20) + b"y", "k.CSV": header.encode(),
    }
    files_ = spark.createDataFrame([(f"file:/x/{p}", len(c), c) for p, c in contents.items()], "path string, length long, content binary")
    summary, records = imports.records(files_)
    assert {r.path[8:10]: r.problem for r in summary.collect()} == {"a.": None, "b.": None, "c.": "not_utf8", "d.": "not_utf8", "e.": "no_records", "f.": "too_many_rows", "g.": "invalid_xlsx", "h.": "empty", "ii": "name_too_long", "j.": "too_large", "k.": "no_records"}
    good, bad = imports.cases(records, spark.createDataFrame([(1, "one"), (2, "two"), (3, "two"), (4, None)], "source_id int, source_name string"))
    rows = {(r.path[8], r.row_number): r for r in good.collect()}
    assert set(rows) == {("a", 2), ("a", 8), ("a", 15), ("b", 2)}
    assert rows["a", 2].question == "a b" and rows["a", 2].expected_terms == ["x", "7"] and rows["a", 2].top_k == 5
    assert rows["a", 8].top_k == 3 and rows["a", 8].tags == ["t", "u"] and rows["a", 8].category is None
    assert rows["a", 15].expected_source_ids == ["1"] and rows["b", 2].question == 'x, "y"' and rows["b", 2].external_key == "k"
    assert {(r.path[8], r.row_number): (r.field, r.problem) for r in bad.collect()} == {
        ("a", 3): ("row", "no_object"), ("a", 4): ("question", "no_scalar"), ("a", 5): ("question", "missing"), ("a", 6): ("expect_answer", "missing"), ("a", 7): ("expect_answer", "no_boolean"), ("a", 9): ("expected_sources", "ambiguous"),
        ("a", 10): ("expected_evidence", "missing"), ("a", 11): ("top_k", "out_of_bounds"), ("a", 12): ("top_k", "out_of_bounds"), ("a", 13): ("tags", "no_list"), ("a", 14): ("category", "too_long"), ("a", 16): ("question", "too_long"),
    }
    assert imports.records(files_.limit(0))[0].count() == 0
