"""Vectorised tokenising and hashing of Arrow string columns.

Works on the UTF-8 bytes of an Arrow buffer, so no Python string is built per word. Text is handled
in pieces of about ``PIECE`` bytes cut between tokens, so working memory does not grow with the length
of a text; only the resulting token arrays (8 bytes a token) do.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

PIECE = 1 << 19
SLICE = 1 << 21

# two primes under 2**31 with a base each: hashes are pairs of polynomials over prime fields
_FIELDS = ((2147483647, 1103527590), (2147483629, 754974721))
_LONGEST = 1 << 22  # sums of 2**22 terms of 40 bits stay exact

# separators are the characters of [\x20\x09-\x0D]
WORDS = np.ones(256, np.uint8)
WORDS[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = 0
LINES = np.ones(256, np.uint8)
LINES[0x0A] = 0
# class 1: letters, digits and all of non-ASCII; class 2: other printable characters
WORDS_AND_MARKS = np.full(256, 2, np.uint8)
WORDS_AND_MARKS[WORDS == 0] = 0
WORDS_AND_MARKS[128:] = 1
for _a, _b in ((48, 58), (65, 91), (97, 123)):
    WORDS_AND_MARKS[_a:_b] = 1


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64 finaliser."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int, field: int, inverse: bool, cache: dict = {}) -> np.ndarray:  # noqa: B006
    """Powers 0 to n - 1 of a field's base, or of its inverse."""
    key = (field, inverse)
    if key not in cache or len(cache[key]) < n:
        prime, base = _FIELDS[field]
        base = pow(base, -1, prime) if inverse else base
        out, size, want = np.ones(1, np.uint64), 1, max(n, PIECE * 2)
        while size < want:
            out = np.concatenate([out, out * np.uint64(pow(base, size, prime)) % np.uint64(prime)])
            size *= 2
        cache[key] = out
    return cache[key][:n]


def _polynomials(values: np.ndarray, first: np.ndarray, end: np.ndarray, field: int) -> np.ndarray:
    """Polynomial of values[first:end] for each pair, over one prime field; the values are under 2**9."""
    prime = np.uint64(_FIELDS[field][0])
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * _powers(len(values), field, False), out=total[1:])
    return (total[end] - total[first]) % prime * _powers(len(values), field, True)[first] % prime


def stretches(hashes: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the stretches hashes[first:end]; equal sequences have equal ones, wherever they stand."""
    out = (end - first).astype(np.uint64)
    for field, (prime, _) in enumerate(_FIELDS):
        n = np.uint64(prime)
        terms = (mix(hashes + np.uint64(field)) >> np.uint64(33)) * _powers(len(hashes), field, False) % n
        total = np.r_[np.uint64(0), np.cumsum(terms)]
        out = mix(out) + (total[end] - total[first]) % n * _powers(len(hashes) + 1, field, True)[first] % n
    return mix(out)


def string_bytes(column) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, bounds) of an Arrow string column; null counts as empty. bounds has one entry more than rows."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        column = pa.concat_arrays(column.chunks) if isinstance(column, pa.ChunkedArray) else column
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    bounds = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[bounds[0] : bounds[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, bounds - bounds[0]


def slices(bounds: np.ndarray, limit: int = SLICE) -> Iterator[tuple[int, int]]:
    """Runs of rows [a, b) of at most ``limit`` bytes, or one longer row."""
    a, n = 0, len(bounds) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(bounds, bounds[a] + limit, "right")) - 1)
        yield a, min(b, n)
        a = min(b, n)


def tokenise(raw: np.ndarray, bounds: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, hashes) of the maximal runs of one non-zero class, within each text.

    Equal byte sequences have equal hashes, whichever text they stand in: 62 bits over two prime fields, mixed.
    """
    starts, ends, hashes = [], [], []
    first = np.zeros(len(raw) + 1, bool)
    first[bounds] = True
    a = 0
    while a < len(raw):
        b = min(a + PIECE, len(raw))
        while b < len(raw) and not first[b]:  # on to the next separator or text
            stop = min(b + 4096, len(raw))
            gap = np.flatnonzero((table[raw[b:stop]] == 0) | first[b:stop])
            if len(gap):
                b += int(gap[0])
                break
            b = stop
        kind = table[raw[a:b]]
        new = np.empty(b - a + 1, bool)
        new[0] = new[-1] = True
        new[1:-1] = (kind[1:] != kind[:-1]) | first[a + 1 : b]
        edges = np.flatnonzero(new)
        s, e = edges[:-1], edges[1:]
        keep = kind[s] != 0
        s, e = s[keep], e[keep]
        values = raw[a:b].astype(np.uint64) + np.uint64(1)
        h = (_polynomials(values, s, e, 0) << np.uint64(31)) + _polynomials(values, s, e, 1)
        for i in np.flatnonzero(e - s > _LONGEST):
            h[i] = int.from_bytes(hashlib.blake2b(raw[a + s[i] : a + e[i]].tobytes(), digest_size=8).digest(), "big")
        starts.append(s + a)
        ends.append(e + a)
        hashes.append(mix(h + (e - s).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)))
        a = b
    if not starts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return np.concatenate(starts), np.concatenate(ends), np.concatenate(hashes)


def per_text(starts: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Index bounds of each text's tokens (rows + 1 entries)."""
    return np.searchsorted(starts, bounds, "left")


def shingles(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k consecutive entries; none if there are fewer than k."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = hashes[:n].copy()
    for j in range(1, k):
        out *= np.uint64(0xD1342543DE82EF95)
        out += hashes[j : j + n]
    return mix(out)


def text_shingles(hashes: np.ndarray, k: int) -> np.ndarray:
    """k-word shingles of one text; a shorter text is one shingle of all its words, an empty one has none."""
    return shingles(hashes, min(k, len(hashes))) if len(hashes) else hashes


def occurrence(values: np.ndarray) -> np.ndarray:
    """Number of earlier equal entries of each entry."""
    order = np.argsort(values, kind="stable")
    v = values[order]
    new = np.r_[True, v[1:] != v[:-1]]
    at = np.arange(len(v))
    out = np.empty(len(v), np.int64)
    out[order] = at - np.maximum.accumulate(np.where(new, at, 0))
    return out
