"""Vectorised hashing of texts held in Arrow string columns.

All kernels work on the UTF-8 buffer of a whole record batch, cut into chunks
of half a MB, so that no Python object is made for a document or a word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
CHUNK = 1 << 19
#: Hashes are sums of symbol * base**place modulo the prime 2**31 - 1, in two lanes of a base each.
PRIME, SHIFT = U((1 << 31) - 1), U(31)
BASES = (1_103_515_245, 1_664_525_017)
#: Multiplier of the cheap sums modulo 2**64, which choose among places and never tell that texts are equal.
_ODD = 0x9E3779B97F4A7C15

#: Bytes that separate words: space, tab, line feed, vertical tab, form feed, carriage return.
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

_pow: dict = {}


def _fold(x: np.ndarray) -> np.ndarray:
    """A smaller number of the same residue modulo PRIME; changes its argument."""
    high = x >> SHIFT
    x &= PRIME
    x += high
    return x


def powers(lane: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo PRIME for i up to n."""
    if lane not in _pow or len(_pow[lane][0]) <= n:
        size, out = max(n + 1, CHUNK + 1), []
        for r in (BASES[lane] % int(PRIME), pow(BASES[lane], -1, int(PRIME))):
            table = np.ones(1, U)
            while len(table) < size:
                table = np.r_[table, _exact(table * U(pow(r, len(table), int(PRIME))))]
            out.append(table[:size])
        _pow[lane] = tuple(out)
    return _pow[lane]


def _exact(x: np.ndarray) -> np.ndarray:
    x = _fold(_fold(_fold(x)))
    x[x == PRIME] = 0
    return x


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser; changes its argument."""
    x ^= x >> U(32)
    x *= U(0xD6E8FEB86659FD93)
    x ^= x >> U(32)
    x *= U(0xD6E8FEB86659FD93)
    x ^= x >> U(32)
    return x


def prefix(symbols: np.ndarray) -> np.ndarray:
    """Prefix sums in two lanes whose differences hash every run of symbols; see runs()."""
    n = len(symbols)
    if n >= 1 << 30:
        raise ValueError("a text is too long to be hashed in one piece")
    out = np.zeros((2, n + 1), U)
    narrow = symbols.dtype == np.uint8
    for lane in range(2):
        x = symbols.astype(U) if narrow else symbols >> U(31 * lane)
        if narrow:
            x += U(1)
        else:
            x &= PRIME
        x *= powers(lane, n)[0][:n]
        np.cumsum(x if narrow and n < 1 << 24 else _fold(x), out=out[lane, 1:])  # sums stay below 2**63
    return out


def _lanes(low: np.ndarray, high: np.ndarray, inverse) -> np.ndarray:
    out = None
    for k in range(2):
        x = _fold(high[k] - low[k])
        x *= inverse(k)
        x = _exact(x)
        if out is None:
            out = x << SHIFT
        else:
            out |= x
    return mix(out)


def runs(p: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of symbols[start:end] for arrays of bounds; equal runs of one length hash alike, others with a probability of some 2**-60 only."""
    n = p.shape[1]
    return _lanes((p[0][start], p[1][start]), (p[0][end], p[1][end]), lambda k: powers(k, n)[1][start])


def grams(p: np.ndarray, k: int) -> np.ndarray:
    """Hash of every run of k symbols, by its start."""
    n = p.shape[1] - k
    return _lanes(p[:, :n], p[:, k:], lambda lane: powers(lane, n)[1][:n]) if n > 0 else np.zeros(0, U)


_odd: list[np.ndarray] = []


def choosers(symbols: np.ndarray, k: int) -> np.ndarray:
    """A number for every run of k symbols, by its start, that equal runs share. Cheap; it chooses among runs and never tells that two are equal."""
    n = len(symbols)
    if n < k:
        return np.zeros(0, U)
    if not _odd or len(_odd[0]) <= n:
        _odd[:] = [np.multiply.accumulate(np.r_[U(1), np.full(max(n, CHUNK) + 1, U(x))]) for x in (_ODD, pow(_ODD, -1, 1 << 64))]
    x = symbols.astype(U) + U(1)
    x *= _odd[0][:n]
    p = np.zeros(n + 1, U)
    np.cumsum(x, out=p[1:])
    return mix((p[k:] - p[: n - k + 1]) * _odd[1][: n - k + 1])


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (n + 1) of a string or binary column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    n = len(column)
    offsets = np.frombuffer(column.buffers()[1], np.int64, n + 1, 8 * column.offset) if n else np.zeros(1, np.int64)
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(offsets: np.ndarray, size: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about size bytes; a longer row is alone."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + size, "right")) - 1)
        yield i, min(j, n)
        i = j


def words(raw: np.ndarray, offsets: np.ndarray, space: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word, and the index of each row's first word (n + 1)."""
    inside = ~space[raw]
    edge = offsets[:-1][np.diff(offsets) > 0]
    before = np.empty_like(inside)
    before[1:] = inside[:-1]
    before[edge] = False
    starts = np.flatnonzero(inside & ~before)
    before[:-1] = inside[1:]
    if len(raw):
        before[-1] = False
    before[edge[1:] - 1] = False
    ends = np.flatnonzero(inside & ~before) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(raw: np.ndarray, offsets: np.ndarray, space: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word, and the index of each row's first word (n + 1)."""
    starts, ends, first = words(raw, offsets, space)
    h = runs(prefix(raw), starts, ends)
    h ^= (ends - starts).astype(U) * U(0xA24BAED4963EE407)
    return mix(h), first


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of x[i:i+w] by i, by doubling."""
    k, out = 1, x
    while 2 * k <= w:
        out = np.minimum(out[: len(out) - k], out[k:])
        k *= 2
    if k < w:
        n = len(x) - w + 1
        out = np.minimum(out[:n], out[w - k : w - k + n])
    return out


def expand(first: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """first[i], first[i]+1, ... (count[i] of them) for every i, and i itself."""
    owner = np.repeat(np.arange(len(count)), count)
    skip = np.cumsum(count) - count
    return first[owner] + (np.arange(len(owner)) - skip[owner]), owner
