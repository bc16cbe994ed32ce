"""Vectorised words, shingles and hashes of the UTF-8 bytes of a batch of texts (inside tasks)."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 20
_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INV = pow(_BASE, -1, 1 << 64)
#: Byte values as random 64-bit numbers, the same on every machine.
_BYTE = np.random.Generator(np.random.PCG64(20260101)).integers(0, 1 << 64, 256, dtype=_U)
#: Word characters: all but space and 0x09-0x0D.
_IN_WORD = np.ones(256, bool)
_IN_WORD[[0x20, *range(0x09, 0x0E)]] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_powers: dict[int, np.ndarray] = {}


def freeing(run: Callable) -> Callable:
    """run (batches to batches), giving back what its task has used: a worker process stays for other work, and the
    allocators would keep the memory of the largest batch."""

    def whole(batches):
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):  # not with every C library
            ctypes.CDLL(None).malloc_trim(0)

    return whole


def quoted(name: str) -> str:
    """A column's name as F.col takes it, whatever signs it holds."""
    return "`" + name.replace("`", "``") + "`"


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1) modulo 2 ** 64; kept up to the size of a chunk, which every chunk needs."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n, CHUNK_BYTES + 1), base, _U)
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        if len(have) == CHUNK_BYTES + 1:
            _powers[base] = have
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A finaliser that spreads every bit (in place)."""
    h ^= h >> _U(33)
    h *= _U(0xFF51AFD7ED558CCD)
    h ^= h >> _U(33)
    h *= _U(0xC4CEB9FE1A85EC53)
    h ^= h >> _U(33)
    return h


def chunks(ids: pa.Array, texts: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(ids, bytes, offsets) of runs of whole texts of about `limit` bytes together; a null text is empty."""
    texts = texts.cast(pa.large_string()) if pa.types.is_string(texts.type) else texts
    if texts.null_count:
        texts = texts.fill_null("")
    if not len(texts):
        return
    offsets = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8)
    data = texts.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    keys = ids.to_numpy(zero_copy_only=False)
    i = 0
    while i < len(texts):
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield keys[i:j], data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return _LOWER[data]


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """Sums of value times power over each prefix: two of them give the hash of what lies between."""
    out = np.zeros(len(data) + 1, _U)
    np.cumsum(_BYTE[data] * powers(_BASE, len(data)), out=out[1:])
    return out


def span_hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return mix((sums[ends] - sums[starts]) * powers(_BASE_INV, len(sums))[starts])


def rolling(sums: np.ndarray, k: int) -> np.ndarray:
    """Hash of every k-byte string."""
    n = len(sums) - k
    return mix((sums[k:] - sums[:n]) * powers(_BASE_INV, len(sums))[:n]) if n > 0 else np.zeros(0, _U)


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words, and for each text the number of the first word (one more entry than texts)."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offsets), np.int64)
    inside = _IN_WORD[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    edges = offsets[:-1][offsets[:-1] < len(data)]
    first[edges] = inside[edges]
    edges = offsets[1:][offsets[1:] > 0] - 1
    last[edges] = inside[edges]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def grams(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of every n consecutive entries."""
    if len(h) < n:
        return np.zeros(0, _U)
    m = len(h) - n + 1
    out = h[:m].copy()
    for i in range(1, n):
        out *= _U(0x100000001B3)
        out += h[i : i + m]
    return mix(out)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, n: int) -> Iterator[np.ndarray]:
    """For each text its distinct n-word shingles as sorted hashes; fewer words make one shingle, no words none."""
    starts, ends, first = words(data, offsets)
    h = span_hashes(prefix_sums(data), starts, ends)
    g = grams(h, n)
    for a, b in zip(first[:-1], first[1:], strict=True):
        if b - a >= n:
            yield np.unique(g[a : b - n + 1])
        elif b > a:
            yield grams(h[a:b], int(b - a)) ^ _U(b - a)
        else:
            yield np.zeros(0, _U)


#: DuckDB SQL: what each byte adds to a CRC-32.
CRC32_SQL = """crc_table AS MATERIALIZED (SELECT list(v ORDER BY n) AS t FROM (SELECT n, list_reduce(list_concat([n], range(8)),
    lambda c, i: xor(c >> 1, CASE WHEN c % 2 = 1 THEN 3988292384 ELSE 0 END)) AS v FROM (SELECT unnest(range(256)) AS n)))"""


def crc32_sql(hex_bytes: str) -> str:
    """SQL of the CRC-32 of bytes given as hexadecimal text, beside CRC32_SQL's crc_table."""
    byte = f"(strpos('123456789ABCDEF', substr({hex_bytes}, 2 * i + 1, 1)) * 16 + strpos('123456789ABCDEF', substr({hex_bytes}, 2 * i + 2, 1)))"
    bytes_ = f"list_transform(range(length({hex_bytes}) // 2), lambda i: {byte}::BIGINT)"
    return f"xor(4294967295, list_reduce(list_concat([4294967295::BIGINT], {bytes_}), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])))"
