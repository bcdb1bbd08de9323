"""Words of Arrow text columns as 64-bit hashes, found with array operations.

A whole batch is one byte buffer. Byte classes tell words from separators, and a word's hash
is a polynomial over its bytes with random coefficients, so no Python loop runs per word.
Work goes in windows of at most ``WINDOW`` bytes (one longer word makes its own window),
which bounds the memory for texts of any length. Two words share a hash with probability
about 2**-64 per pair.
"""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

WINDOW = 1 << 20
SLICE = 1 << 21

_rng = np.random.default_rng(20240229)
_COEF = _rng.integers(1, 2**64, 256, dtype=np.uint64)
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_BASE_INV = np.uint64(pow(int(_BASE), -1, 2**64))
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}

#: ASCII capitals to small letters, all other bytes as they are.
FOLD = np.arange(256, dtype=np.uint8)
FOLD[ord("A") : ord("Z") + 1] += 32

#: Separators of words `[^\x20\x09-\x0D]+`.
BLANK = np.zeros(256, bool)
BLANK[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

#: Everything but ASCII letters, digits and non-ASCII bytes separates plain words.
NOT_PLAIN = np.ones(256, bool)
NOT_PLAIN[0x80:] = False
for _lo, _hi in ("09", "AZ", "az"):
    NOT_PLAIN[ord(_lo) : ord(_hi) + 1] = False


#: Rows of a batch between Spark and Python; texts are long, and a batch is held on both sides.
BATCH_ROWS = 1500


def batch_rows(spark, rows: int = BATCH_ROWS) -> None:
    """Set the size of batches; every operator that sends texts to Python calls this."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def batch_bytes(spark, size: int) -> None:
    """Bound the bytes of batches as well, where rows may be large: texts of many words or whole
    sets of shingles."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(size))


def release() -> None:
    """Give back freed memory at the end of a task, as workers are kept for other tasks."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):
        ctypes.CDLL(None).malloc_trim(0)


def mix(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit values; one to one."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(32)
    return x


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    n = max(WINDOW, n)
    if n in _POWERS:
        return _POWERS[n]
    made = []
    for base in (_BASE, _BASE_INV):
        p = np.full(n, base, np.uint64)
        p[0] = 1
        made.append(np.cumprod(p, dtype=np.uint64))
    if n == WINDOW:
        _POWERS[n] = (made[0], made[1])
    return made[0], made[1]


@dataclass
class Words:
    """Words of some rows: hashes in order, and where each row's words begin."""

    hashes: np.ndarray  # uint64
    rows: np.ndarray  # int64, one more than rows: row i has hashes[rows[i]:rows[i + 1]]

    def counts(self) -> np.ndarray:
        return np.diff(self.rows)


def buffer_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a text column and the row offsets in them; null is empty."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    raw = texts.buffers()
    offsets = np.frombuffer(raw[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    if raw[2] is None:
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    return np.frombuffer(raw[2], np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(data: np.ndarray, offsets: np.ndarray, size: int = SLICE) -> Iterator[tuple[int, int]]:
    """Ranges of rows with at most ``size`` bytes, or of one longer row."""
    at, n = 0, len(offsets) - 1
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + size, "right")) - 1)
        yield at, min(to, n)
        at = to


def bounds(data: np.ndarray, offsets: np.ndarray, blank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where words begin and end (exclusive); no word crosses a row."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    inside = ~blank[data]
    before = np.empty_like(inside)
    before[0] = False
    before[1:] = inside[:-1]
    first = offsets[:-1]
    before[first[first < len(data)]] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.empty_like(inside)
    after[-1] = False
    after[:-1] = inside[1:]
    last = offsets[1:][offsets[1:] > 0] - 1
    after[last] = False
    return starts, np.flatnonzero(inside & ~after) + 1


def hash_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, blank: np.ndarray) -> np.ndarray:
    """A hash for each word; ``data`` is already folded."""
    coef = np.where(blank, np.uint64(0), _COEF)
    out = np.empty(len(starts), np.uint64)
    at = 0
    while at < len(starts):
        base = starts[at]
        to = max(at + 1, int(np.searchsorted(ends, base + WINDOW, "right")))
        power, inverse = _powers(int(ends[to - 1] - base))
        part = coef[data[base : ends[to - 1]]]
        part *= power[: len(part)]
        begin = starts[at:to] - base
        out[at:to] = np.add.reduceat(part, begin) * inverse[begin]
        at = to
    return mix(out)


def words(
    texts: pa.Array, blank: np.ndarray = BLANK, fold: np.ndarray = FOLD, size: int = SLICE
) -> Iterator[tuple[int, int, Words]]:
    """``(first row, row after the last, words)`` for slices of a text column."""
    data, offsets = buffer_of(texts)
    for at, to in slices(data, offsets, size):
        part = fold[data[offsets[at] : offsets[to]]]
        own = offsets[at : to + 1] - offsets[at]
        starts, ends = bounds(part, own, blank)
        yield at, to, Words(hash_words(part, starts, ends, blank), np.searchsorted(starts, own).astype(np.int64))


def shingles(w: Words, size: int) -> Words:
    """Hashes of each row's runs of ``size`` words; a shorter row is one run, an empty row none."""
    counts = w.counts()
    coef = np.random.default_rng(7).integers(1, 2**64, size, dtype=np.uint64) | np.uint64(1)
    n = len(w.hashes)
    total = np.zeros(max(0, n - size + 1), np.uint64)
    for i in range(size):
        total += w.hashes[i : i + len(total)] * coef[i]
    made = np.where(counts >= size, counts - size + 1, (counts > 0).astype(np.int64))
    rows = np.zeros(len(counts) + 1, np.int64)
    np.cumsum(made, out=rows[1:])
    row = np.repeat(np.arange(len(counts)), made)
    start = w.rows[:-1][row] + np.arange(len(row)) - rows[:-1][row]
    short = counts[row] < size
    out = np.empty(len(row), np.uint64)
    out[~short] = total[start[~short]]
    for at in np.flatnonzero(short):
        own = w.hashes[w.rows[row[at]] : w.rows[row[at] + 1]]
        out[at] = (own * coef[: len(own)]).sum(dtype=np.uint64) + np.uint64(len(own))
    return Words(mix(out), rows)
