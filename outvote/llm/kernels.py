"""Array code that runs inside tasks: words, hashes and windows of whole Arrow text columns.

Texts stay in Arrow's UTF-8 buffer. Work goes over the buffer in stretches of about
``STRETCH`` bytes, cut at white space or between texts, so memory does not follow the longest
text; what is kept of a text is eight bytes a word.
"""

import numpy as np
import pyarrow as pa

STRETCH = 1 << 17
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_STEP = np.uint64(0x9E3779B97F4A7C15)

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
CONTINUED = np.zeros(256, bool)  # bytes that do not begin a code point
CONTINUED[0x80:0xC0] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32
_SAME = np.arange(256, dtype=np.uint8)


def mix(x: np.ndarray) -> np.ndarray:
    """Finalizer of splitmix64: a bijection of 64-bit numbers."""
    x = x ^ (x >> np.uint64(30))
    x = x * _M1
    x = x ^ (x >> np.uint64(27))
    x = x * _M2
    return x ^ (x >> np.uint64(31))


def draw(x: np.ndarray, k: int) -> np.ndarray:
    """The k-th pseudo-random number of each element."""
    return mix(x + np.uint64((0x9E3779B97F4A7C15 * (k + 1)) % 2**64))


_BYTES = mix(np.arange(1, 257, dtype=np.uint64) * _STEP)
_BASE = 0x5851F42D4C957F2D  # odd, so it has an inverse
_INVERSE = pow(_BASE, -1, 2**64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_UP, _DOWN = _powers(_BASE, STRETCH + 1), _powers(_INVERSE, STRETCH + 1)


def utf8(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and text offsets (one more than texts) of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    n = len(column)
    if n == 0 or data is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    at = np.frombuffer(offsets, np.int64, n + 1, column.offset * 8)
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def _stretches(data, offsets):
    """Cuts between texts or after white space, about STRETCH bytes apart."""
    lo, end = 0, len(data)
    while lo < end:
        hi = lo + STRETCH
        if hi >= end:
            yield lo, end
            return
        at = int(offsets[np.searchsorted(offsets, hi, "right") - 1])
        if at > lo:
            hi = at
        else:
            back = hi
            while back > lo and not SPACE[data[max(lo, back - 4096) : back]].any():
                back = max(lo, back - 4096)
            if back > lo:
                part = np.flatnonzero(SPACE[data[max(lo, back - 4096) : back]])
                hi = max(lo, back - 4096) + int(part[-1]) + 1
            else:  # one word longer than a stretch
                while hi < end and not SPACE[data[hi - 1]] and hi != offsets[np.searchsorted(offsets, hi)]:
                    hi += 1
        yield lo, hi
        lo = hi


class Words:
    """Words of consecutive texts: ``hashes``, byte ``starts`` and ``ends``, and per text the range ``at[i]:at[i+1]``."""

    def __init__(self, column, lower: bool, space: np.ndarray = SPACE):
        """``space`` says which bytes part words; it must hold ASCII white space."""
        self.data, self.offsets = utf8(column)
        table = LOWER if lower else _SAME
        hashes, starts, ends = [], [], []
        for lo, hi in _stretches(self.data, self.offsets):
            part = self.data[lo:hi]
            solid = ~space[part]
            begin = solid.copy()
            begin[1:] &= ~solid[:-1]
            close = solid.copy()
            close[:-1] &= ~solid[1:]
            first, last = np.searchsorted(self.offsets, [lo, hi])
            cut = self.offsets[first:last] - lo
            cut = cut[(cut > 0) & (cut < hi - lo)]
            begin[cut] = solid[cut]
            close[cut - 1] = solid[cut - 1]
            s, e = np.flatnonzero(begin), np.flatnonzero(close) + 1
            if not len(s):
                continue
            n = hi - lo
            up, down = (_UP, _DOWN) if n <= STRETCH else (_powers(_BASE, n + 1), _powers(_INVERSE, n + 1))
            total = np.zeros(n + 1, np.uint64)
            np.cumsum(_BYTES[table[part]] * up[:n], out=total[1:])
            hashes.append(mix((total[e] - total[s]) * down[s] + (e - s).astype(np.uint64) * _STEP))
            starts.append(s + lo)
            ends.append(e + lo)
        empty = np.zeros(0, np.int64)
        self.hashes = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
        self.starts = np.concatenate(starts) if starts else empty
        self.ends = np.concatenate(ends) if ends else empty
        self.at = np.searchsorted(self.starts, self.offsets)

    def counts(self) -> np.ndarray:
        return np.diff(self.at)


def windows(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hash of each run of ``width`` consecutive words (fewer entries than words by width - 1)."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(n, width, np.uint64)
    for k in range(width):
        out = out * np.uint64(_BASE) + hashes[k : k + n]
    return mix(out)


def shingle_set(hashes: np.ndarray, width: int = 5) -> np.ndarray:
    """Sorted distinct shingles of one text's words; a shorter text is one shingle, an empty one none."""
    if len(hashes) == 0:
        return hashes
    return np.unique(windows(hashes, min(width, len(hashes))))


def slices(batch, text: str, most: int = 2 << 20):
    """Parts of a record batch with about ``most`` bytes of text, one row at least; memory that Arrow keeps is given back after each batch."""
    column = batch.column(batch.schema.get_field_index(text))
    _, at = utf8(column)
    lo, n = 0, len(column)
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + most, "right")) - 1)
        yield batch.slice(lo, min(hi, n) - lo)
        lo = hi
    pa.default_memory_pool().release_unused()
