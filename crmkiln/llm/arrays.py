"""Words of many texts at once, as NumPy arrays inside tasks: bounds, hashes, windows.

A slice of texts is one byte array with the offsets of its texts. Word hashes come from prefix
sums of a polynomial over 2**64 with random byte values, so a word, or a window of any number of
words, costs a subtraction and a product.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 20

_U = np.uint64
_BASE, _BASE_INVERSE = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64)
_STEP, _STEP_INVERSE = 0xD6E8FEB86659FD93, pow(0xD6E8FEB86659FD93, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash; one to one."""
    x = x ^ (x >> _U(33))
    x = x * _U(0xFF51AFD7ED558CCD)
    x ^= x >> _U(33)
    x *= _U(0xC4CEB9FE1A85EC53)
    x ^= x >> _U(33)
    return x


def powers(base: int, n: int) -> np.ndarray:
    known = _powers.get(base)
    if known is None or len(known) < n:
        size = max(n, SLICE_BYTES + 1)
        known = np.full(size, _U(base))
        known[0] = 1
        known = np.multiply.accumulate(known)
        _powers[base] = known
    return known[:n]


BYTE_VALUES = mix(np.arange(1, 257, dtype=_U))


def folded(values: np.ndarray) -> np.ndarray:
    """Byte values in which A-Z count as a-z."""
    values = values.copy()
    values[65:91] = values[97:123]
    return values


FOLDED_VALUES = folded(BYTE_VALUES)

#: Bytes inside a word of ``[^\x20\x09-\x0D]+``.
SPACED = np.ones(256, bool)
SPACED[[0x20, *range(0x09, 0x0E)]] = False
#: Bytes inside a word of ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` after A-Z were lower-cased.
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x41:0x5B] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True


def slices(texts: pa.Array, limit: int = SLICE_BYTES):
    """(first row, last row + 1, bytes, offsets) of runs of texts of about ``limit`` bytes; null
    counts as empty. A text is never split."""
    if len(texts) == 0:
        return
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    _, where, held = texts.buffers()
    offsets = np.frombuffer(where, np.int64)[texts.offset:texts.offset + len(texts) + 1]
    data = np.frombuffer(held, np.uint8) if held is not None else np.empty(0, np.uint8)
    row = 0
    while row < len(texts):
        end = int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1
        end = min(max(end, row + 1), len(texts))
        yield row, end, data[offsets[row]:offsets[end]], offsets[row:end + 1] - offsets[row]
        row = end


def word_bounds(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray):
    """Start and end of every word, and the index of the first word of every text (and the end)."""
    within = inside[data]
    n = len(data)
    if n == 0:
        empty = np.empty(0, np.int64)
        return empty, empty, np.zeros(len(offsets), np.int64)
    first = np.empty(n, bool)
    first[0] = True
    np.logical_not(within[:-1], out=first[1:])
    last = np.empty(n, bool)
    last[-1] = True
    np.logical_not(within[1:], out=last[:-1])
    edges = offsets[(offsets > 0) & (offsets < n)]
    first[edges] = True
    last[edges - 1] = True
    starts = np.flatnonzero(within & first)
    ends = np.flatnonzero(within & last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def prefix_sums(data: np.ndarray, values: np.ndarray = BYTE_VALUES) -> np.ndarray:
    sums = np.empty(len(data) + 1, _U)
    sums[0] = 0
    np.cumsum(values[data] * powers(_BASE, len(data)), out=sums[1:])
    return sums


def range_hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of the bytes of each range; ``sums`` from ``prefix_sums``."""
    raw = (sums[ends] - sums[starts]) * powers(_BASE_INVERSE, len(sums))[starts]
    return mix(raw + (ends - starts).astype(_U) * _U(_STEP))


def word_sums(hashes: np.ndarray) -> np.ndarray:
    sums = np.empty(len(hashes) + 1, _U)
    sums[0] = 0
    np.cumsum(hashes * powers(_STEP, len(hashes)), out=sums[1:])
    return sums


def window_hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of the words of each window; ``sums`` from ``word_sums``."""
    raw = (sums[ends] - sums[starts]) * powers(_STEP_INVERSE, len(sums))[starts]
    return mix(raw + (ends - starts).astype(_U) * _U(_BASE))


def all_windows(sums: np.ndarray, size: int) -> np.ndarray:
    """Hashes of the windows of ``size`` words at every place where one fits."""
    n = len(sums) - size
    if n <= 0:
        return np.empty(0, _U)
    raw = (sums[size:] - sums[:-size]) * powers(_STEP_INVERSE, n)
    return mix(raw + _U(size * _BASE & (1 << 64) - 1))


def sliding_minima(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every window of ``width`` values."""
    n = len(values)
    if n < width:
        return values[:0]
    blocks = -(-n // width)
    padded = np.full(blocks * width, np.iinfo(values.dtype).max, values.dtype)
    padded[:n] = values
    grid = padded.reshape(blocks, width)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n - width + 1], ahead[width - 1:n])


def expand(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """starts[0], starts[0]+1, ... (counts[0] of them), starts[1], ..."""
    total = int(counts.sum())
    if total == 0:
        return np.empty(0, np.int64)
    jumps = np.repeat(starts - np.concatenate(([0], np.cumsum(counts)[:-1])), counts)
    return jumps + np.arange(total)
