"""Secret scans: base patterns plus linking of multipart credentials. DataFrame functions only.

Positions come from splitting a text at the matches of a pattern: the lengths of the pieces and of the matches add up
to code-point offsets. Parts have a role: access identifiers (`access`, `account`), secrets (`assign`, `hex`, `blob`)
and endpoints (`endpoint`). The first three kinds are strong by themselves. `account`, `blob` and `endpoint` are weak:
they are reported only where a part of a complementary role lies within SCOPE code points in the same document.

The interval join is a merge of sorted ends inside the row, so nothing is shuffled: as many parts come near one as begin
before its scope ends, less those that end before its scope begins. Sums over many matches, merges and cuts take about
linear time in the length of a text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyroom.llm._text import quoted

SCOPE = 200
KINDS = ("assign", "access", "hex", "account", "blob", "endpoint")
BASE = KINDS[:3]

# The patterns of the base kinds, as the contract states them.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"(?<![0-9a-f])[0-9a-f]{24,}"

ACCOUNT = r"""(?i)(user|user_?name|user_?id|login|client_?id)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.@-]+)"""
BLOB = r"(?<![A-Za-z0-9/+=])[A-Za-z0-9/+]{40}(?![A-Za-z0-9/+=])"
ENDPOINT = r"""https?://[^\x00-\x20"'<>]+|([0-9]{1,3}\.){3}[0-9]{1,3}(:[0-9]{1,5})?"""
_SPAN = "array<struct<start:int,k:int,stop:int>>"
#: Matches that are added up before a sum is carried on, and code points of a section that text is cut from.
_ADDED, _SECTION = 64, 512


def _running(steps: Column) -> Column:
    """Sums of the first entry, the first two, and so on: in parts, as each entry added copies what there is."""
    part = lambda i: F.slice(steps, i * _ADDED + 1, F.lit(_ADDED))
    last = lambda x: F.element_at(x, -1)
    parts = F.transform(F.sequence(F.lit(0), F.floor((F.size(steps) - 1) / _ADDED).cast("int")), part)
    add = lambda a, x: F.concat(a, F.array(F.aggregate(x, F.array(last(last(a))), lambda b, y: F.concat(b, F.array(last(b) + y)))))
    sums = F.aggregate(parts, F.array(F.array(F.lit(0))), add)
    return F.when(F.size(steps) > 0, F.flatten(F.transform(F.slice(sums, 2, F.size(sums)), lambda x: F.slice(x, 2, F.size(x))))).otherwise(F.array().cast("array<int>"))


def _with_matches(docs: DataFrame, *kinds: tuple[str, Column, str, int | None, int, str | None]) -> DataFrame:
    """docs with a column of spans for each (kind, condition, pattern, group, least, also): all matches of the pattern
    in t where the condition holds, less those whose group is shorter than `least` or that lack the pattern `also`.

    Step by step, as a lambda that reads a whole expression would work it out for each of its elements.
    """
    none = lambda kind: F.array().cast(f"array<{kind}>")
    hits, steps, stops = ({k[0]: F.col(f"_{name}_{k[0]}") for k in kinds} for name in ("hits", "steps", "stops"))
    docs = docs.withColumns({f"_hits_{k}": F.when(on, F.regexp_extract_all("t", F.lit(pattern), F.lit(0))).otherwise(none("string")) for k, on, pattern, *_ in kinds})
    gaps = lambda k, pattern: F.slice(F.transform(F.split("t", pattern, -1), F.length), 1, F.size(hits[k]))
    step = lambda k, pattern: F.zip_with(gaps(k, pattern), F.transform(hits[k], F.length), lambda a, b: a + b)
    docs = docs.withColumns({f"_steps_{k}": F.when(F.size(hits[k]) > 0, step(k, pattern)).otherwise(none("int")) for k, _, pattern, *_ in kinds})
    docs = docs.withColumns({f"_stops_{k}": _running(steps[k]) for k, *_ in kinds})

    def spans(k: str, group: int | None, pattern: str, least: int, also: str | None) -> Column:
        def good(hit: Column) -> Column:
            held = F.regexp_extract(hit, pattern, group) if group else hit
            return (F.length(held) >= least) & (F.lit(True) if also is None else held.rlike(also))

        every = F.zip_with(hits[k], stops[k], lambda hit, stop: F.struct((stop - F.length(hit)).alias("start"), F.lit(KINDS.index(k)).alias("k"), stop.alias("stop"), good(hit).alias("good")))
        return F.transform(F.filter(every, lambda s: s["good"]), lambda s: F.struct(s["start"], s["k"], s["stop"])).cast(_SPAN)

    return docs.withColumns({k: spans(k, group, pattern, least, also) for k, _, pattern, group, least, also in kinds})


def _counts(points: Column, asked: Column, equal: bool) -> Column:
    """For each number in asked how many points are smaller (or equal to it), by one sort of both together."""
    marked = F.concat(
        F.transform(points, lambda p: F.struct(p.alias("at"), F.lit(0 if equal else 1).alias("tie"), F.lit(-1).alias("i"))),
        F.transform(asked, lambda x, i: F.struct(x.alias("at"), F.lit(1 if equal else 0).alias("tie"), i.alias("i"))),
    )
    placed = F.filter(F.transform(F.array_sort(marked), lambda x, j: F.struct(x["i"].alias("i"), j.alias("n"))), lambda x: x["i"] >= 0)
    before = F.transform(placed, lambda x, j: F.struct(x["i"].alias("i"), (x["n"] - j).alias("n")))
    return F.transform(F.array_sort(before), lambda x: x["n"])


def _ends(spans: Column, end: str, more: int = 0) -> Column:
    return F.transform(spans, lambda s: s[end] + more)


def _meeting(spans: Column, others: Column, scope: int | None = None) -> Column:
    """For each span whether another one comes within scope of it, or without scope whether one overlaps it."""
    far, equal = (0, False) if scope is None else (scope, True)
    begun = _counts(_ends(others, "start"), _ends(spans, "stop", far), equal)
    over = _counts(_ends(others, "stop"), _ends(spans, "start", -far), not equal)
    return F.zip_with(begun, over, lambda a, b: a > b)


def _chosen(spans: Column, keep: Column) -> Column:
    both = F.filter(F.zip_with(spans, keep, lambda s, k: F.struct(s.alias("s"), k.alias("keep"))), lambda x: x["keep"])
    return F.when(F.size(spans) > 0, F.transform(both, lambda x: x["s"])).otherwise(spans)


def _told(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["k"] + 1), s["start"], s["stop"])), ",")


def with_spans(docs: DataFrame) -> DataFrame:
    """row (all columns of docs in one), t (the text, never null), and arrays of spans (start, k = place in KINDS, stop)
    by start, then kind: base and every (base and linked ones)."""
    named = [F.col(quoted(c)) for c in docs.columns]
    docs = docs.select(F.struct(*named).alias("row"), F.coalesce(F.col("text"), F.lit("")).alias("t"))
    t = F.col("t")
    docs = _with_matches(
        docs,
        ("assign", t.rlike(r"""(?i)(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]"""), ASSIGN, 2, 6, None),
        ("access", t.contains("AKIA"), ACCESS, None, 0, None),
        ("hex", t.rlike(HEX), HEX, None, 0, None),
        ("blob", t.rlike(BLOB), BLOB, None, 0, "[0-9].*[A-Za-z]|[A-Za-z].*[0-9]"),
    )
    docs = docs.withColumn("base", F.array_sort(F.concat("assign", "access", "hex")))
    free = lambda w: F.when(F.size(w) > 0, _chosen(w, F.transform(_meeting(w, F.col("base")), lambda x: ~x))).otherwise(w)
    docs = docs.withColumn("blob", free(F.col("blob")))
    docs = docs.withColumn("secret", F.concat("assign", "hex", "blob"))
    some = F.size("secret") > 0
    docs = _with_matches(docs, ("account", some, ACCOUNT, 2, 3, None), ("endpoint", some, ENDPOINT, None, 0, None))
    docs = docs.withColumn("account", free(F.col("account")))
    near = lambda w, others: F.when(F.size(w) > 0, _chosen(w, _meeting(w, others, SCOPE))).otherwise(w)
    linked = F.concat(
        near(F.col("account"), F.col("secret")), near(F.col("blob"), F.concat("access", "account", "endpoint")), near(F.col("endpoint"), F.col("secret")),
    )
    return docs.withColumn("every", F.when(F.size("secret") > 0, F.array_sort(F.concat("base", linked))).otherwise(F.col("base")))


def found(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans and n_linked of every row.

    A null or empty text has no spans (the digest of the empty string, an empty `spans`). Repeated rows give repeated
    rows; a null doc_id stays null; other columns are ignored, whatever their names. An empty table gives no rows. Long
    texts with many matches take about linear time.
    """
    out = with_spans(docs.select("doc_id", "text"))
    count = lambda k: F.size(k).cast("long").alias(f"n_{k}")
    return out.select(
        F.col("row")["doc_id"].alias("doc_id"), *map(count, BASE), F.sha2(_told(F.col("base")), 256).alias("base_sha256"), _told(F.col("every")).alias("spans"),
        (F.size("every") - F.size("base")).cast("long").alias("n_linked"),
    )


def _united(spans: Column) -> tuple[Column, Column]:
    """Starts and stops of what spans cover: a start opens if all that began before ended before it, a stop likewise."""
    starts, stops = F.array_sort(F.array_distinct(_ends(spans, "start"))), F.array_sort(F.array_distinct(_ends(spans, "stop")))

    def outer(points: Column, equal: bool) -> Column:
        ends = (_counts(_ends(spans, end), points, equal) for end in ("start", "stop"))
        balanced = F.zip_with(*ends, lambda a, b: a == b)
        return F.transform(F.filter(F.zip_with(points, balanced, lambda p, b: F.struct(p.alias("p"), b.alias("b"))), lambda x: x["b"]), lambda x: x["p"])

    return outer(starts, False), outer(stops, True)


def _pieces(text: Column, begin: Column, end: Column) -> Column:
    """The texts from each begin to the end of the same number; cut from sections, as a cut counts from the start."""
    sections = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{_SECTION}}}"), F.lit(0))

    def cut(a: Column, b: Column) -> Column:
        first, last = F.floor(a / _SECTION).cast("int"), F.floor(b / _SECTION).cast("int")
        part = lambda i: F.coalesce(F.get("sections", i), F.lit(""))
        long = F.concat(F.substr(part(first), a % _SECTION + 1), F.array_join(F.slice("sections", first + 2, F.greatest(last - first - 1, F.lit(0))), ""), F.substr(part(last), F.lit(1), b % _SECTION))
        return F.when(first == last, F.substr(part(first), a % _SECTION + 1, b - a)).otherwise(long)

    return sections, F.zip_with(begin, end, cut)


def redacted(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """docs, all rows and columns, with every span of `text` replaced by `mark` (touching or overlapping spans by one).

    Where there is n_chars, it follows the new text. Texts without spans stay as they are, null and empty ones too.
    Repeated rows stay repeated; an empty table stays empty; other columns may have any name, with dots too. Long texts
    with many spans take about linear time.
    """
    out = with_spans(docs).select("row", "t", "every")
    starts, stops = _united(F.col("every"))
    none = F.array().cast("array<int>")
    some = F.size("every") > 0
    out = out.withColumns({"starts": F.when(some, starts).otherwise(none), "stops": F.when(some, stops).otherwise(none)})
    sections, pieces = _pieces(F.col("t"), F.concat(F.array(F.lit(0)), F.col("stops")), F.concat(F.col("starts"), F.array(F.length("t"))))
    out = out.withColumn("sections", F.when(some, sections))
    out = out.withColumn("clean", F.when(some, F.array_join(pieces, mark)).otherwise(F.col("row")["text"]))
    own = {"text": F.col("clean"), "n_chars": F.when(some, F.length("clean").cast("long")).otherwise(F.col("row")["n_chars"]) if "n_chars" in docs.columns else None}
    return out.select(*[own.get(c, F.col("row")[c]).alias(c) for c in docs.columns])


_PARTS_SQL = """
pattern(kind, k, pat, grp, least) AS (VALUES
  ('assign', 0, '(?i)(password|passwd|secret|token|api_?key)["'']?\\x20*[:=]\\x20*["'']?([A-Za-z0-9+/_.=-]+)', 2, 6),
  ('access', 1, 'AKIA[A-Z0-9]+', 0, 20),
  ('hex', 2, '[0-9a-f]+', 0, 24),
  ('account', 3, '(?i)(user|user_?name|user_?id|login|client_?id)["'']?\\x20*[:=]\\x20*["'']?([A-Za-z0-9+/_.@-]+)', 2, 3),
  ('blob', 4, '[A-Za-z0-9/+=]+', 0, 40),
  ('endpoint', 5, 'https?://[^\\x00-\\x20"''<>]+|([0-9]{1,3}\\.){3}[0-9]{1,3}(:[0-9]{1,5})?', 0, 0)),
d AS (SELECT doc_id, coalesce(text, '') t FROM documents),
m AS (SELECT doc_id, kind, k, least, regexp_extract_all(t, pat, 0) h,
        CASE WHEN grp = 2 THEN regexp_extract_all(t, pat, 2) ELSE regexp_extract_all(t, pat, 0) END g, string_split_regex(t, pat) p
      FROM d, pattern),
u AS (SELECT doc_id, kind, k, least, unnest(range(len(h))) i, unnest(h) hit, unnest(g) held, unnest(p[1:len(h)]) gap FROM m),
s AS (SELECT doc_id, kind, k, least, i, hit, held, length(hit) n,
        sum(length(gap) + length(hit)) OVER (PARTITION BY doc_id, kind ORDER BY i) AS stop FROM u),
part AS (SELECT doc_id, kind, k, hit, CAST(stop - n AS BIGINT) AS start, CAST(stop AS BIGINT) AS stop FROM s
         WHERE length(held) >= least AND (kind <> 'blob' OR (length(hit) = 40 AND NOT contains(hit, '=')
               AND regexp_matches(hit, '[0-9].*[A-Za-z]|[A-Za-z].*[0-9]')))),
base AS (SELECT * FROM part WHERE k < 3),
free AS (SELECT * FROM part w WHERE k < 3 OR k = 5 OR NOT EXISTS (SELECT 1 FROM base b
         WHERE b.doc_id = w.doc_id AND w.start < b.stop AND b.start < w.stop)),
linked AS (SELECT * FROM free w WHERE k < 3 OR EXISTS (SELECT 1 FROM free o WHERE o.doc_id = w.doc_id
         AND w.start <= o.stop + 200 AND o.start <= w.stop + 200
         AND ((w.kind IN ('account', 'endpoint') AND o.kind IN ('assign', 'hex', 'blob'))
              OR (w.kind = 'blob' AND o.kind IN ('access', 'account', 'endpoint'))))),
told AS (SELECT doc_id, string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, k) spans,
           count(*) FILTER (WHERE k > 2) n_linked FROM linked GROUP BY doc_id),
b AS (SELECT doc_id, count(*) FILTER (WHERE k = 0) a, count(*) FILTER (WHERE k = 1) c, count(*) FILTER (WHERE k = 2) x,
        string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, k) spans FROM base GROUP BY doc_id)
"""
ORACLE = f"""WITH {_PARTS_SQL}
SELECT d.doc_id, coalesce(b.a, 0) AS n_assign, coalesce(b.c, 0) AS n_access, coalesce(b.x, 0) AS n_hex,
  sha256(coalesce(b.spans, '')) AS base_sha256, coalesce(told.spans, '') AS spans, coalesce(told.n_linked, 0) AS n_linked
FROM d LEFT JOIN b ON d.doc_id = b.doc_id LEFT JOIN told ON d.doc_id = told.doc_id"""
