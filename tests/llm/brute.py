"""Brute-force versions of operators that SQL can't express, in plain Python."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np

from tallyroom.llm.decontaminate import _SAME_UNIT, SHARE, UNITS, WINDOW


def shingles(text, n):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()


def components(rows, n=4):
    """Smallest id of the component of each id, over all pairs."""
    sets = {d: shingles(t, n) for d, t in rows if d is not None}
    label, ids = {d: d for d in sets}, sorted(sets)

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    by_value = defaultdict(list)
    for d in ids:
        for s in sets[d]:
            by_value[s].append(d)
    common = Counter((a, b) for held in by_value.values() for i, a in enumerate(held) for b in held[i + 1 :])
    for (a, b), c in common.items():
        if 100 * c >= 80 * (len(sets[a]) + len(sets[b]) - c):
            x, y = sorted((root(a), root(b)))
            label[y] = x
    return {d: root(d) for d in ids}


def _core(c):
    return c.isalnum() if c.isascii() else True


def template(text):
    """Tokens of a text: [kind, value, opens as a name, joined to the name before], kinds as NUMBER, NAME, UNIT or None."""
    out, before = [], None
    for m in re.finditer(r"[^\x20\x09-\x0D]+", text or ""):
        places = [i for i, c in enumerate(m[0]) if _core(c)]
        if not places:
            continue
        core = m[0][places[0] : places[-1] + 1]
        low = "".join(c.lower() if c.isascii() else c for c in core)
        letters = [c for c in low if not c.isascii() or c.isalpha()]
        tail = re.fullmatch(r"([0-9](?:.*[0-9])?)([a-z]{1,8})", low, re.DOTALL)
        value, unit = low, low in UNITS
        if unit:
            value = _SAME_UNIT.get(low, low)
        elif tail and tail[2] in UNITS and len(letters) == len(tail[2]):
            value, unit = (tail[1], _SAME_UNIT.get(tail[2], tail[2])), True
        number = not letters
        begin = m.start() + places[0]
        opens = before is None or before["word"][-1] in ".!?" or "\n" in text[before["begin"] : begin]
        name = len(core) > 1 and "A" <= core[0] <= "Z" and "a" <= core[1] <= "z" and not number and not unit
        kind = "NUMBER" if number else "UNIT" if unit else "NAME" if name and not opens else None
        right, left = core[-1] == m[0][-1] and places[-1] == len(m[0]) - 1, places[0] == 0
        further = kind == "NAME" and before is not None and before["name"] and before["right"] and left
        before = {"word": m[0], "begin": begin, "name": name, "right": right, "kind": kind}
        if further and out and out[-1]["kind"] == "NAME":
            out[-1]["value"] = (*out[-1]["value"], value)
            continue
        out.append({"kind": kind, "value": (value,) if name else value, "opens": name and opens, "further": further})
    return out


def readings(text):
    """All windows of all readings: (place, template, slots, plain tokens)."""
    tokens, out = template(text), []

    def go(start, at, parts):
        if len(parts) == WINDOW or at == len(tokens):
            if len(parts) == WINDOW or start == 0:
                out.append((start, tuple(p[0] for p in parts), tuple(p[1] for p in parts if p[1]), sum(p[1] is None for p in parts)))
            return
        t = tokens[at]
        plain = t["value"] if isinstance(t["value"], str) else t["value"][0]
        go(start, at + 1, [*parts, ((t["kind"],), (t["kind"], t["value"])) if t["kind"] else (plain, None)])
        if t["opens"]:
            more = at + 1 < len(tokens) and tokens[at + 1]["further"]
            value = (*t["value"], *(tokens[at + 1]["value"] if more else ()))
            go(start, at + 1 + more, [*parts, (("NAME",), ("NAME", value))])

    for i in range(len(tokens)):
        go(i, i, [])
    return out


def leaks(docs, items):
    """{(doc, item): share} of contaminated documents."""
    held = defaultdict(set)
    for item, text in set(items):
        if item is None:
            continue
        every = readings(text)
        least = {}
        for place, _, _, plain in every:
            least[place] = min(least.get(place, WINDOW), plain)
        for tells in (lambda r: least[r[0]] >= 2, lambda r: r[3] >= 2, lambda r: True):
            good = [r for r in every if tells(r)]
            if good:
                break
        for place, window, slots, _ in good:
            held[window].add((item, place, slots, len({r[0] for r in good})))
    diagonals = defaultdict(set)
    for doc, text in set(docs):
        if doc is None:
            continue
        for at, window, slots, _ in readings(text):
            for item, place, theirs, n in held.get(window, ()):
                diagonals[doc, item, at - place].add((place, window, theirs, slots, n))
    places = defaultdict(dict)
    for (doc, item, _), rows in diagonals.items():
        turns = Counter((a, b) for r in rows for a, b in zip(r[2], r[3], strict=True))
        best = {}
        for (a, b), n in turns.items():
            best[a] = max(best.get(a, (0, False, "")), (n, a == b, repr(b)))
        other = lambda a, b: repr(b) != best[a][2]  # noqa: B023, E731
        figures = [(a, b) for r in rows for a, b in zip(r[2], r[3], strict=True) if a[0] != "NAME"]
        most = 2 * sum(other(a, b) for a, b in figures) > len(figures)
        for place, _, theirs, slots, n in rows:
            if not any(other(a, b) and (a[0] == "NAME" or most) for a, b in zip(theirs, slots, strict=True)):
                places[doc, item][place] = max(n, places[doc, item].get(place, 0))
    return {k: len(p) / max(p.values()) for k, p in places.items() if len(p) / max(p.values()) >= SHARE}


def sha(data):
    return hashlib.sha256(data.encode() if isinstance(data, str) else data).hexdigest()


def toxic(text, machine):
    """Score of a text by a fitted machine: every word's triples one by one."""
    from math import exp

    from tallyroom.llm import toxicity as tox

    words = []
    for m in re.finditer(r"[^\x20\x09-\x0D]+", text or ""):
        w = m[0].encode()
        if words and len(w) == 1 and words[-1][1] == 1:
            words[-1] = (words[-1][0] + w, 1)
        else:
            words.append((w, len(w)))
    n = machine.kernel.weights.shape[1]
    best = [0.0] * n
    for w in {w for w, _ in words}:
        c = [int(x) for x in tox.codes_of(np.frombuffer(w, np.uint8)) if x]
        norm, hits = 0.0, []
        for a, b in tox._SKIPS:
            for i in range(len(c) - a - b):
                weight = tox.DECAY ** (a + b - 2)
                norm += weight**2
                row = machine.kernel.row[(c[i] * tox._LETTERS + c[i + a]) * tox._LETTERS + c[i + a + b]]
                if row:
                    hits.append((row, weight))
        for j in range(n) if hits else ():
            k = min(1.0, sum(machine.kernel.weights[r, j] * v for r, v in hits) / norm**0.5)
            if k >= tox.FLOOR:
                best[j] = max(best[j], k)
    out = [sum(k * v for k, v in zip(best, column, strict=True)) for column in machine.root.T.tolist()]
    margin = sum(x * w for x, w in zip(out, machine.weights.tolist(), strict=True)) + machine.bias
    return 1 / (1 + exp(-max(-30, min(30, machine.slope * margin + machine.shift))))


def secret_spans(text):
    """(start, k, stop) of base and linked spans: every pair of parts is looked at."""
    from tallyroom.llm import secrets as sec

    def every(pattern, kind, group=0, least=0, also=None):
        return [(m.start(), sec.KINDS.index(kind), m.end()) for m in re.finditer(pattern, text, re.ASCII) if len(m[group]) >= least and (also is None or re.search(also, m[group]))]

    overlaps = lambda a, b: a[0] < b[2] and b[0] < a[2]
    near = lambda a, b: a[0] <= b[2] + sec.SCOPE and b[0] <= a[2] + sec.SCOPE
    assign, access, hexes = every(sec.ASSIGN, "assign", 2, 6), every(sec.ACCESS, "access"), every(sec.HEX, "hex")
    base = assign + access + hexes
    blob = [w for w in every(sec.BLOB, "blob", also="[0-9].*[A-Za-z]|[A-Za-z].*[0-9]") if not any(overlaps(w, b) for b in base)]
    account = [w for w in every(sec.ACCOUNT, "account", 2, 3) if not any(overlaps(w, b) for b in base)]
    endpoint = every(sec.ENDPOINT, "endpoint")
    secret = assign + hexes + blob
    linked = [w for w in account + endpoint if any(near(w, s) for s in secret)] + [w for w in blob if any(near(w, s) for s in access + account + endpoint)]
    return sorted(base + linked)


def redacted(text, mark="[SECRET]"):
    out, at, last = "", 0, None
    for a, _, b in secret_spans(text or ""):
        if last is None or a > last:
            out += text[at:a] + mark
        at = last = max(b, last or 0)
    return text if last is None else out + text[at:]


def encoded(text, library):
    ids = library.encode(text or "", add_special_tokens=False).ids
    return len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False))
