"""Words and shingles of Arrow string columns as 64-bit hashes, computed on whole batches with numpy.

A word is a maximal run of bytes outside ``[\\x20\\x09-\\x0D]``, with A-Z lower-cased. Offsets are of the UTF-8 text.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Bytes of text that are hashed at once, unless a single document is longer.
CHUNK_BYTES = 1 << 18

_rng = np.random.default_rng(20240229)
_LETTER = _rng.integers(1, 2**63, 256, dtype=np.uint64)
_LETTER[ord("A") : ord("Z") + 1] = _LETTER[ord("a") : ord("z") + 1]
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Every ASCII character but letters and digits, for words without punctuation.
PUNCTUATION = np.array([i < 128 and not chr(i).isalnum() for i in range(256)])
_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
_STEP = np.uint64(0xD6E8FEB86659FD93)


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit finaliser: every input bit changes about half the output bits."""
    x = np.asarray(x, np.uint64) ^ np.uint64((0xA0761D6478BD642F * (seed + 1)) % 2**64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_powers: dict[str, np.ndarray] = {}


def power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The powers of an odd number and of its inverse, n of each and more."""
    if "up" not in _powers or len(_powers["up"]) < n:
        size = max(n, CHUNK_BYTES + 1)
        for name, base in (("up", _BASE), ("down", _BASE_INV)):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            _powers[name] = np.multiply.accumulate(p)
    return _powers["up"], _powers["down"]


@dataclass
class Words:
    """The words of some documents: ``hashes[offsets[i]:offsets[i + 1]]`` are those of row ``first + i``.

    ``starts`` and ``ends`` are byte positions in the document's own text.
    """

    first: int
    hashes: np.ndarray
    offsets: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    prefixes: np.ndarray | None = None


def words(column: pa.Array, space: np.ndarray = _SPACE, prefix: int = 0) -> Iterator[Words]:
    """The words of every row of a string column, in chunks of rows; null counts as empty.

    ``space`` says for each byte whether it separates words. With ``prefix`` the hashes of the words' first bytes, so
    many of them, are in ``prefixes``.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    if not len(column):
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    for a, b in row_chunks(offsets):
        yield _chunk(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], a, space, prefix)
    give_back()


def give_back() -> None:
    """Return memory that is free to the system, since workers wait for their next task with what they hold."""
    pa.default_memory_pool().release_unused()
    if _TRIM is not None:
        _TRIM(0)


def row_chunks(offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about CHUNK_BYTES of text each."""
    a = 0
    while a < len(offsets) - 1:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + CHUNK_BYTES, "right")) - 1)
        yield a, b
        a = b


def _chunk(text: np.ndarray, bounds: np.ndarray, first: int, separates: np.ndarray, prefix: int) -> Words:
    n = len(text)
    space = separates[text]
    before, after = np.ones(n, bool), np.ones(n, bool)
    before[1:], after[:-1] = space[:-1], space[1:]
    full = bounds[:-1] < bounds[1:]
    before[bounds[:-1][full]] = True
    after[bounds[1:][full] - 1] = True
    starts, ends = np.flatnonzero(~space & before), np.flatnonzero(~space & after) + 1
    up, down = power_tables(n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_LETTER[text] * up[:n], out=total[1:])
    hashes = mix((total[ends] - total[starts]) * down[starts])
    offsets = np.searchsorted(starts, bounds)
    base = np.repeat(bounds[:-1], np.diff(offsets))
    heads = mix((total[np.minimum(starts + prefix, ends)] - total[starts]) * down[starts], 9) if prefix else None
    return Words(first, hashes, offsets, starts - base, ends - base, heads)


def shingle_stream(hashes: np.ndarray, n: int) -> np.ndarray:
    """The hash of the n words that begin at each word, in order (the last n - 1 words begin none)."""
    m = len(hashes) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(m, np.uint64)
    with np.errstate(over="ignore"):
        for j in range(n):
            out = out * _STEP + hashes[j : j + m]
    return mix(out, n)


def sequence_hash(hashes: np.ndarray) -> int:
    """One hash for a whole sequence of words."""
    n = len(hashes)
    up, _ = power_tables(n + 1)
    return int(mix(np.array([(hashes * up[:n]).sum(dtype=np.uint64)], np.uint64), n)[0])


def shingle_sets(w: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingles of each row, end to end, and their offsets.

    A row with 1 to n - 1 words has its whole sequence as one shingle; one without words has none.
    """
    counts = np.diff(w.offsets)
    each = np.where(counts >= n, counts - n + 1, np.minimum(counts, 1))
    stream = shingle_stream(w.hashes, n)
    bounds = np.concatenate([[0], np.cumsum(each)])
    out = np.empty(bounds[-1], np.uint64)
    for i in range(len(counts)):
        if counts[i] >= n:
            part = out[bounds[i] : bounds[i + 1]]
            part[:] = stream[w.offsets[i] : w.offsets[i] + each[i]]
            part.sort()
        elif counts[i]:
            k = int(counts[i])
            out[bounds[i]] = shingle_stream(w.hashes[w.offsets[i] : w.offsets[i + 1]], k)[0]
    rows = np.repeat(np.arange(len(counts)), each)
    new = np.ones(len(out), bool)
    new[1:] = (out[1:] != out[:-1]) | (rows[1:] != rows[:-1])
    return out[new], np.concatenate([[0], np.cumsum(np.bincount(rows[new], minlength=len(counts)))])
