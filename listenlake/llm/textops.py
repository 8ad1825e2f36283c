"""Vectorised text helpers shared by the operators of this subpackage.

Everything here works on one bounded slice of an Arrow batch at a time: the UTF-8 bytes of many texts side by side, with the
offsets at which each text begins.  Words, hashes and shingles of a whole slice come from a few numpy passes over its bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are worked on at once.  A longer text makes a slice of its own.
SLICE_BYTES = 1 << 20

_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every input bit (the splitmix64 finaliser)."""
    x = x ^ (x >> np.uint64(30))
    x = x * _M1
    x = x ^ (x >> np.uint64(27))
    x = x * _M2
    return x ^ (x >> np.uint64(31))


#: A random-looking 64-bit value for each byte; A-Z share the values of a-z.
_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _MULTIPLIER)
_FOLDED = _BYTE.copy()
_FOLDED[65:91] = _BYTE[97:123]

#: Bytes that belong to words: all but ASCII white space; and letters, digits and everything beyond ASCII.
NOT_SPACE = np.ones(256, dtype=bool)
NOT_SPACE[[0x20, *range(0x09, 0x0E)]] = False
LETTERS = np.zeros(256, dtype=bool)
LETTERS[0x30:0x3A] = LETTERS[0x41:0x5B] = LETTERS[0x61:0x7B] = LETTERS[0x80:] = True


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column side by side and the offset of each text, the end included; null counts as empty."""
    if column.null_count:
        column = pc.fill_null(column, "")
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    if data is None:
        return np.zeros(0, dtype=np.uint8), at - at[0]
    return np.frombuffer(data, dtype=np.uint8)[at[0] : at[-1]], at - at[0]


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of the batches in pieces of at most ``most`` bytes of text, or of one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        group = np.cumsum(sizes) // most
        edges = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows]
        for start, end in zip(edges, edges[1:]):
            yield batch.slice(start, end - start)


def sides(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, pa.RecordBatch]]:
    """Shard, side and rows of the stretches of batches sorted by their columns ``shard`` and ``side``."""
    for batch in batches:
        if not batch.num_rows:
            continue
        shard, side = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("shard", "side"))
        edges = [0, *(np.flatnonzero((np.diff(shard) != 0) | (np.diff(side) != 0)) + 1).tolist(), batch.num_rows]
        for start, end in zip(edges, edges[1:]):
            yield int(shard[start]), int(side[start]), batch.slice(start, end - start)


def word_spans(data: np.ndarray, at: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of each word (a run of ``inside`` bytes within one text) and the text it belongs to."""
    mask = inside[data]
    if not mask.any():
        none = np.zeros(0, dtype=np.int64)
        return none, none, none
    first, last = mask.copy(), mask.copy()
    first[1:] &= ~mask[:-1]
    last[:-1] &= ~mask[1:]
    edge = at[1:-1]
    edge = edge[(edge > 0) & (edge < len(data))]
    first[edge] = mask[edge]
    last[edge - 1] = mask[edge - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(at, starts, side="right") - 1


_powers: list[np.ndarray] = []


def _powers_to(n: int) -> list[np.ndarray]:
    """The multiplier's powers and their inverses; only as many as a usual slice needs are kept."""

    def made(size: int) -> list[np.ndarray]:
        steps = [np.full(size, base, dtype=np.uint64) for base in (_MULTIPLIER, _INVERSE)]
        for step in steps:
            step[0] = 1
        return [np.multiply.accumulate(step) for step in steps]

    if n > SLICE_BYTES + 1:
        return made(n)
    if not _powers:
        _powers.extend(made(SLICE_BYTES + 1))
    return _powers


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span, A-Z read as a-z; equal words have equal hashes wherever they stand."""
    up, down = _powers_to(len(data) + 1)
    total = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_FOLDED[data] * up[: len(data)], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def shingles(words: np.ndarray, owner: np.ndarray, texts: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the ``width``-word shingles and the text of each, in text order.

    A text of fewer words, but not none, has one shingle: its whole sequence.
    """
    count = np.bincount(owner, minlength=texts)
    begin = np.cumsum(count) - count
    keys = [mix(np.array([7919 * (i + 1)], dtype=np.uint64))[0] | np.uint64(1) for i in range(width)]
    n = max(0, len(words) - width + 1)
    value = np.zeros(n, dtype=np.uint64)
    for i, key in enumerate(keys):
        value += words[i : i + n] * key
    whole = owner[:n] == owner[width - 1 : width - 1 + n]
    value, of = mix(value[whole]), owner[:n][whole]
    short = np.flatnonzero((count > 0) & (count < width))
    if len(short):
        extra = np.zeros(len(short), dtype=np.uint64)
        for i in range(width - 1):
            has = count[short] > i
            extra[has] += words[begin[short[has]] + i] * keys[i]
        value, of = np.concatenate([value, mix(extra + count[short].astype(np.uint64))]), np.concatenate([of, short])
        order = np.argsort(of, kind="stable")
        value, of = value[order], of[order]
    return value, of
