"""Texts of Arrow batches as NumPy arrays: blocks of bounded size, their words, and hashes of those."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Bytes of text that one block holds; a longer text makes a block of its own.
BLOCK = 1 << 20

_rng = np.random.default_rng(0x5EED)
#: A random odd number for each byte; the second table folds A-Z to a-z.
SYMBOLS = _rng.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
FOLDED = SYMBOLS.copy()
FOLDED[65:91] = SYMBOLS[97:123]
BASE = np.uint64(0x9E3779B97F4A7C15)
BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
WHITE = np.zeros(256, dtype=bool)
WHITE[[9, 10, 11, 12, 13, 32]] = True

_powers: dict[int, np.ndarray] = {}


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base ** 0 to base ** (n - 1), modulo 2 ** 64."""
    have = _powers.get(int(base))
    if have is None or len(have) < n:
        have = np.full(max(n, BLOCK + 1), base, dtype=np.uint64)
        have[0] = 1
        have = np.multiply.accumulate(have)
        if len(have) <= 4 * BLOCK:
            _powers[int(base)] = have
    return have[:n]


def mixed(x: np.ndarray) -> np.ndarray:
    """Spreads the bits of 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


@dataclass
class Block:
    """Rows of a batch: their bytes one after the other, and where each row's begin (one more entry for the end)."""

    rows: pa.RecordBatch
    data: np.ndarray
    offsets: np.ndarray

    def texts(self) -> list[bytes]:
        raw, at = self.data.tobytes(), self.offsets.tolist()
        return [raw[a:b] for a, b in zip(at, at[1:])]


def blocks(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = BLOCK) -> Iterator[Block]:
    """Cuts batches into blocks of at most limit bytes of text, or one row. Null texts count as empty."""
    for batch in batches:
        if not batch.num_rows:
            continue
        col = batch.column(batch.schema.get_field_index(column)).cast(pa.large_string()).fill_null("")
        sizes = np.frombuffer(col.buffers()[1], dtype=np.int64)[col.offset : col.offset + len(col) + 1]
        data = np.frombuffer(col.buffers()[2] or b"", dtype=np.uint8)
        at = 0
        while at < len(col):
            end = max(at + 1, int(np.searchsorted(sizes, sizes[at] + limit, "right")) - 1)
            yield Block(batch.slice(at, end - at), data[sizes[at] : sizes[end]], sizes[at : end + 1] - sizes[at])
            at = end


@dataclass
class Words:
    """Words of a block in order: first byte, byte after the last one, row, and how many each row has."""

    start: np.ndarray
    end: np.ndarray
    row: np.ndarray
    count: np.ndarray


def words(block: Block, outside: np.ndarray = WHITE) -> Words:
    """outside: for each byte, whether it stands between words."""
    n, rows = len(block.data), len(block.offsets) - 1
    if not n:
        none = np.zeros(0, dtype=np.int64)
        return Words(none, none, none, np.zeros(rows, dtype=np.int64))
    inside = np.zeros(n + 1, dtype=bool)
    inside[:n] = ~outside[block.data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    heads = block.offsets[:-1]
    first[heads] |= inside[heads]
    first[n] = False
    start = np.flatnonzero(first)
    last = inside[:n] & ~inside[1:]
    tails = block.offsets[1:][block.offsets[1:] > 0] - 1
    last[tails] |= inside[tails]
    end = np.flatnonzero(last) + 1
    count = np.diff(np.searchsorted(start, block.offsets))
    return Words(start, end, np.repeat(np.arange(rows), count), count)


def word_hashes(block: Block, w: Words, symbols: np.ndarray = FOLDED) -> np.ndarray:
    """64-bit hashes of the words; those of equal words are equal in every block."""
    if not len(w.start):
        return np.zeros(0, dtype=np.uint64)
    n = len(block.data)
    prefix = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(symbols[block.data] * powers(BASE, n), out=prefix[1:])
    return mixed((prefix[w.end] - prefix[w.start]) * powers(BASE_INVERSE, n)[w.start])
