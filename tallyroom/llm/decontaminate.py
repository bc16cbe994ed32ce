"""Benchmark decontamination by template canonicalisation.

Numbers, names and units become typed placeholders, so a question whose parameters were replaced keeps its template.
Windows of WINDOW template tokens are hash-joined with those of the benchmark. Matches of one document with one item
are grouped by diagonal (place in the document less place in the item). Along a diagonal every value of a slot should
always turn into the same value: the one it turns into most often is taken, and windows with another don't count. Numbers
and units, whose values may be equal by chance, count against windows only where more than half of them on the diagonal
are such others. Forms and spellings of a unit are one value. A document is contaminated by an item if the windows
left are at least SHARE of the item's windows.

Tokens: words without the signs around them, in lower case (ASCII); words of signs only are none. NUMBER: digits and
no letters. UNIT: a word of UNITS, or digits followed by one. NAME: capital, then a small letter; words of names with
only space between them are one. At the start of a sentence or line such a word may be a name or not, so every window
over it is taken in both readings, as a plain word and as NAME (one with the names right after it); a place counts as
found by any of its readings. A text with fewer tokens than WINDOW is one window. Places of an item with a reading of
fewer than two plain tokens tell nothing and don't count, unless it has no other.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyroom.llm._text import chunks, freeing, grams, lower_ascii, mix, prefix_sums, quoted, span_hashes, words
from tallyroom.tables import staged

WINDOW, SHARE = 5, 0.8
#: The filter of benchmark windows that goes to every task has 2 ** FILTER_BITS bits (4 MB), however many windows there
#: are: the more there are, the more it lets pass, and the join decides.
FILTER_BITS = 25
# Words that are read as units.
UNITS = """
kg g mg lb lbs oz km m cm mm ft inch inches mile miles yard yards mph kmh l ml litre litres liter liters gallon gallons
second seconds minute minutes hour hours day days week weeks month months year years usd eur gbp dollar dollars euro
euros cent cents pound pounds percent degree degrees kwh watt watts volt volts
""".split()
#: Other forms and spellings of a unit.
_SAME_UNIT = {
    "lbs": "lb", "pound": "lb", "pounds": "lb", "inches": "inch", "miles": "mile", "yards": "yard", "l": "litre", "litres": "litre", "liter": "litre", "liters": "litre",
    "gallons": "gallon", "seconds": "second", "minutes": "minute", "hours": "hour", "days": "day", "weeks": "week", "months": "month", "years": "year",
    "dollar": "usd", "dollars": "usd", "euro": "eur", "euros": "eur", "cents": "cent", "degrees": "degree", "watts": "watt", "volts": "volt",
}
_NUMBER, _NAME, _UNIT = 1, 2, 3
_KIND = mix(np.arange(1, 5, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_DIGIT, _CAPITAL, _SMALL, _LETTER, _CORE = (np.zeros(256, bool) for _ in range(5))
_DIGIT[48:58] = _CAPITAL[65:91] = _SMALL[97:123] = True
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True
_CORE[:] = _DIGIT | _LETTER
def _hash_of(word: str) -> np.ndarray:
    return span_hashes(prefix_sums(np.frombuffer(word.encode(), np.uint8)), np.array([0]), np.array([len(word)]))


_UNIT_HASHES = np.concatenate([_hash_of(u) for u in UNITS])
_UNIT_VALUES = np.concatenate([_hash_of(_SAME_UNIT.get(u, u)) for u in UNITS])[np.argsort(_UNIT_HASHES)]
_UNIT_HASHES = np.sort(_UNIT_HASHES)


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """Template hash, value hash and kind of the tokens, for each text the number of its first one, and of the tokens
    whether they may be names though they open a sentence, how many more tokens such a name takes in, and its value."""
    starts, ends, first = words(data, offsets)
    core = np.flatnonzero(_CORE[data])
    if not len(core) or not len(starts):
        none = np.zeros(0, np.uint64)
        return none, none, np.zeros(0, np.int8), np.zeros(len(offsets), np.int64), np.zeros(0, bool), np.zeros(0, np.int64), none
    begin = core[np.minimum(np.searchsorted(core, starts), len(core) - 1)]
    stop = core[np.maximum(np.searchsorted(core, ends) - 1, 0)] + 1
    held = np.flatnonzero((begin >= starts) & (begin < ends))
    bare = (begin == starts, stop == ends)
    begin, stop, after, bare_left, bare_right = begin[held], stop[held], ends[held], bare[0][held], bare[1][held]
    first = np.searchsorted(held, first)
    sums = prefix_sums(lower_ascii(data))
    value = span_hashes(sums, begin, stop)
    letters = np.concatenate([[0], np.cumsum(_LETTER[data], dtype=np.int32)])
    n_letters = letters[stop] - letters[begin]
    number = (n_letters == 0) & _DIGIT[data[begin]]
    unit = _member(value, _UNIT_HASHES)
    value[unit] = _unit_values(value[unit])
    # digits with a unit right behind them
    tail = np.flatnonzero(_DIGIT[data[begin]] & (n_letters > 0) & (n_letters < 9))
    if len(tail):
        cut = stop[tail] - n_letters[tail]
        solid = _DIGIT[data[cut - 1]] & (letters[stop[tail]] - letters[cut] == n_letters[tail])
        letters_value = span_hashes(sums, cut, stop[tail])
        solid &= _member(letters_value, _UNIT_HASHES)
        unit[tail] |= solid
        value[tail[solid]] = span_hashes(sums, begin[tail[solid]], cut[solid]) * np.uint64(3) + _unit_values(letters_value[solid])
    opens = np.ones(len(begin), bool)
    if len(begin) > 1:
        end_byte = data[after[:-1] - 1]
        closed = (end_byte == 46) | (end_byte == 33) | (end_byte == 63)
        breaks = np.concatenate([[0], np.cumsum(data == 10, dtype=np.int32)])
        opens[1:] = closed | (breaks[begin[1:]] > breaks[begin[:-1]])
    opens[first[:-1][first[:-1] < len(begin)]] = True
    name = _CAPITAL[data[begin]] & _SMALL[data[np.minimum(begin + 1, len(data) - 1)]] & (stop - begin > 1) & ~number & ~unit
    kind = np.where(number, _NUMBER, np.where(unit, _UNIT, np.where(name & ~opens, _NAME, 0))).astype(np.int8)
    # a name right after another, or after a word that opens a sentence and may be one
    further = np.zeros(len(begin), bool)
    further[1:] = (kind[1:] == _NAME) & name[:-1] & bare_right[:-1] & bare_left[1:]
    head = np.flatnonzero(~(further & (np.roll(kind, 1) == _NAME)))
    if not len(head):
        return value, value, kind, first, opens, np.zeros(0, np.int64), value
    rank = np.arange(len(begin)) - np.repeat(head, np.diff(head, append=len(begin)))
    plain_sum = np.add.reduceat(value, head)
    value = np.add.reduceat(value * (2 * rank + 1).astype(np.uint64), head)
    kind, opener = kind[head], (name & opens)[head]
    first = np.searchsorted(head, first)
    takes = np.zeros(len(head), np.int64)
    takes[:-1] = opener[:-1] & further[head[1:]]
    whole = value.copy()
    at = np.flatnonzero(takes)
    whole[at] += value[at + 1] + np.uint64(2) * plain_sum[at + 1]
    return np.where(kind > 0, _KIND[kind], value), value, kind, first, opener, takes, whole


def _other_readings(template: np.ndarray, first: np.ndarray, opener: np.ndarray, takes: np.ndarray):
    """Windows with at least one opening word read as a name: hash, tokens (-1 for none) and which are read so."""
    n = len(template)
    edge = np.repeat(first[1:], np.diff(first))
    near = np.concatenate([[0], np.cumsum(opener)])
    start = np.flatnonzero(near[np.minimum(np.arange(n) + WINDOW, edge)] > near[:n]) if n else np.zeros(0, np.int64)
    opening = np.zeros(n + 1, bool)
    opening[first] = True
    at, h = start, np.zeros(len(start), np.uint64)
    spot, named = np.full((len(start), WINDOW), -1), np.zeros((len(start), WINDOW), bool)
    done = []
    for step in range(WINDOW):
        more = np.flatnonzero(at < edge[spot[:, 0]] if step else at >= 0)
        if step:
            # the text ends before the window is full: a whole text of few tokens
            short = np.flatnonzero((at == edge[spot[:, 0]]) & opening[spot[:, 0]])
            done.append((mix(h[short]), spot[short], named[short]))
        at, h, spot, named = at[more], h[more], spot[more], named[more]
        either = np.flatnonzero(opener[at])
        as_name = np.zeros(len(at) + len(either), bool)
        as_name[len(at) :] = True
        which = np.concatenate([np.arange(len(at)), either])
        at, h, spot, named = at[which], h[which], spot[which], named[which]
        spot[:, step], named[:, step] = at, as_name
        h = h * np.uint64(0x100000001B3) + np.where(as_name, _KIND[_NAME], template[at])
        at = at + 1 + np.where(as_name, takes[at], 0)
    done.append((mix(h), spot, named))
    h, spot, named = (np.concatenate(x) for x in zip(*done, strict=True))
    other = named.any(axis=1)
    return h[other], spot[other], named[other]


def _unit_values(h: np.ndarray) -> np.ndarray:
    return _UNIT_VALUES[np.searchsorted(_UNIT_HASHES, h)]


def _member(h: np.ndarray, held: np.ndarray) -> np.ndarray:
    return held[np.minimum(np.searchsorted(held, h), len(held) - 1)] == h if len(held) else np.zeros(len(h), bool)


def window_filter(items: DataFrame) -> np.ndarray:
    """A Bloom filter of the column window of items, built in Spark: two bits for each, in bytes."""
    mask = (1 << FILTER_BITS) - 1
    bit = F.explode(F.array(*[F.shiftrightunsigned("window", n).bitwiseAND(F.lit(mask).cast("long")) for n in (0, 32)]))
    held = items.select(bit.alias("bit")).groupBy(F.shiftright("bit", 3).alias("at")).agg(F.bit_or(F.expr("shiftleft(1, CAST(bit & 7 AS INT))")).alias("bits"))
    got = held.toPandas()  # 2 ** FILTER_BITS / 8 rows at most
    out = np.zeros(1 << FILTER_BITS - 3, np.uint8)
    out[got["at"].to_numpy(np.int64)] = got["bits"].to_numpy(np.int64).astype(np.uint8)
    return out


def _passes(h: np.ndarray, held: np.ndarray) -> np.ndarray:
    """Which hashes the filter lets pass: all that it was made of, and few others while it is not full."""
    mask = np.uint64(8 * len(held) - 1)
    good = np.ones(len(h), bool)
    for n in (0, 32):
        bit = h >> np.uint64(n) & mask
        good &= (held[bit >> np.uint64(3)] >> (bit & np.uint64(7)).astype(np.uint8) & 1).astype(bool)
    return good


def windows(rows: DataFrame, ident: str, keep: Broadcast | None = None, telling: bool = False) -> DataFrame:
    """ident, window, place, n (windows of the text that count) and slots (value of each placeholder, in order, its
    kind in the two lowest bits); with `keep` (a filter) only windows that it lets pass; with `telling` only those with two plain tokens where there are any."""

    def run(batches):
        for batch in batches:
            out: dict[str, list] = {k: [] for k in ("id", "window", "place", "n", "slots")}
            sizes = [np.zeros(1, np.int64)]
            for ids, data, offsets in chunks(batch.column(0), batch.column(1)):
                template, value, kind, first, opener, takes, whole = tokens(data, offsets)
                if not len(template):
                    continue
                size = np.diff(first)
                short = np.flatnonzero((size > 0) & (size < WINDOW))
                h = grams(template, WINDOW)
                doc = np.repeat(np.arange(len(size)), size)
                at = np.flatnonzero(doc[: len(h)] == doc[WINDOW - 1 :]) if len(h) else np.zeros(0, np.int64)
                w = np.concatenate([h[at], *(grams(template[first[i] : first[i + 1]], int(size[i])) for i in short)])
                at = np.concatenate([at, first[short]])
                other, other_spot, other_named = _other_readings(template, first, opener, takes)
                n_plain, w = len(at), np.concatenate([w, other])
                at = np.concatenate([at, other_spot[:, 0]])
                good = np.ones(len(at), bool)
                if telling:
                    plain = np.concatenate([[0], np.cumsum(kind == 0)])
                    count = np.concatenate([plain[np.minimum(at[:n_plain] + WINDOW, first[doc[at[:n_plain]] + 1])] - plain[at[:n_plain]], ((kind[other_spot] == 0) & (other_spot >= 0) & ~other_named).sum(axis=1)])
                    least = np.full(len(template), WINDOW)
                    np.minimum.at(least, at, count)
                    # every reading of the place tells; or where no place is so, this reading; or where none does, any
                    good = np.zeros(len(at), bool)
                    left = np.ones(len(size), bool)
                    for tells in (least[at] >= 2, count >= 2, np.ones(len(at), bool)):
                        tells &= left[doc[at]]
                        good |= tells
                        left[doc[at[tells]]] = False
                counted = np.zeros(len(template), bool)
                counted[at[good]] = True
                n = np.bincount(doc[counted], minlength=len(size))
                hit = np.flatnonzero(good & _passes(w, keep.value)) if keep is not None else np.flatnonzero(good)
                low = hit[hit < n_plain]
                spot = at[low][:, None] + np.arange(WINDOW)
                spot[spot >= first[doc[at[low]] + 1][:, None]] = -1
                spot = np.concatenate([spot, other_spot[hit[len(low) :] - n_plain]])
                named = np.concatenate([np.zeros((len(low), WINDOW), bool), other_named[hit[len(low) :] - n_plain]])
                slot = ((kind[spot] > 0) | named) & (spot >= 0)
                out["id"].append(ids[doc[at[hit]]] if len(hit) else np.zeros(0, np.int64))
                out["window"].append(w[hit].view(np.int64))
                out["place"].append(at[hit] - first[:-1][doc[at[hit]]])
                out["n"].append(n[doc[at[hit]]])
                of_kind = np.where(named, _NAME, kind[spot])[slot].astype(np.uint64)
                out["slots"].append((np.where(named, whole[spot], value[spot])[slot] & ~np.uint64(3) | of_kind).view(np.int64))
                sizes.append(slot.sum(axis=1))
            *flat, slots = [pa.array(np.concatenate([np.zeros(0, np.int64), *c]), pa.int64()) for c in out.values()]
            ends = pa.array(np.cumsum(np.concatenate(sizes)), pa.int32())
            yield pa.RecordBatch.from_arrays([*flat, pa.ListArray.from_arrays(ends, slots)], names=[ident, "window", "place", "n", "slots"])

    return rows.where(F.col(ident).isNotNull()).select(F.col(ident).cast("long"), "text").mapInArrow(freeing(run), f"{ident} long, window long, place long, n long, slots array<long>")


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id and share of each contaminated document and item.

    Null ids and null or empty texts match nothing; repeated rows of either table count once; of documents with one
    id the windows are taken together, and an item with several texts is found by any of them.
    """
    of_items = windows(benchmark, "item_id", telling=True)
    of_items = staged(of_items.groupBy("item_id", "window", "place").agg(F.max("n").alias("n_item"), F.first("slots").alias("item_slots")), "benchmark-windows")
    keep = docs.sparkSession.sparkContext.broadcast(window_filter(of_items))
    found = windows(docs, "doc_id", keep).select("doc_id", "window", F.col("place").alias("at"), "slots")
    matched = found.join(of_items, "window").withColumn("diagonal", F.col("at") - F.col("place"))
    pair = F.explode_outer(F.arrays_zip(F.col("item_slots").alias("theirs"), F.col("slots").alias("ours")))
    diagonal = ["doc_id", "item_id", "diagonal"]
    # repeated rows once: so a diagonal has few rows, an item's at most
    turned = matched.select(*diagonal, "place", "window", "n_item", "item_slots", "slots").distinct().select(*diagonal, "place", "window", "n_item", pair.alias("slot"))
    turned = turned.select(*diagonal, "place", "window", "n_item", "slot.*").repartition(*diagonal)
    turn = F.struct(F.count("*").over(Window.partitionBy(*diagonal, "theirs", "ours")).alias("times"), (F.col("ours") == F.col("theirs")).alias("same"), "ours")
    turned = turned.withColumn("turn", turn).withColumn("best", F.max("turn").over(Window.partitionBy(*diagonal, "theirs"))["ours"])
    other, figure = F.col("ours") != F.col("best"), F.col("theirs").bitwiseAND(F.lit(3).cast("long")) != _NAME
    along = Window.partitionBy(*diagonal)
    turned = turned.withColumn("most", 2 * F.count_if(other & figure).over(along) > F.count_if(figure).over(along))
    rows = turned.groupBy(*diagonal, "place", "window").agg(F.max(F.coalesce(other & (~figure | F.col("most")), F.lit(False))).alias("wrong"), F.max("n_item").alias("n_item"))
    places = rows.where("NOT wrong").groupBy("doc_id", "item_id", "place").agg(F.max("n_item").alias("n_item"))
    share = places.groupBy("doc_id", "item_id").agg((F.count("*") / F.max("n_item")).alias("share"))
    return share.where(F.col("share") >= SHARE)


def judged(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, contaminated, n_items and item_ids (ascending) of every row of docs.

    Null or empty texts, a null doc_id, and every document where the benchmark is empty are not contaminated; repeated
    rows are judged alike; an empty table gives no rows; long texts are read whole; other columns are ignored.
    """
    hits = leaks(docs, benchmark).groupBy("doc_id").agg(F.array_sort(F.collect_set("item_id")).alias("item_ids"))
    out = docs.select("doc_id").join(hits, "doc_id", "left")
    none = F.array().cast("array<bigint>")
    return out.select("doc_id", F.col("item_ids").isNotNull().alias("contaminated"), F.coalesce(F.size("item_ids"), F.lit(0)).cast("long").alias("n_items"), F.coalesce("item_ids", none).alias("item_ids"))


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs, with all columns, that no item contaminates. Rows without doc_id stay, as do null and empty
    texts; repeated rows go or stay together; an empty table stays empty; other columns may have any name."""
    gone = staged(leaks(docs, benchmark).select("doc_id").distinct(), "contaminated")
    return docs.join(gone, "doc_id", "left_anti").select(*map(quoted, docs.columns))
