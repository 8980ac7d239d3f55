"""Words as `[^\\x20\\x09-\\x0D]+` over UTF-8 bytes, hashed and counted in numpy.

Texts come in as bytes. A null text is an empty one. Everything here is exact but
the word hash, which is 64 bits wide.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 20
#: Bytes hashed at once; the tables of powers that a process keeps are as long.
PIECE_BYTES = 1 << 18
END = np.uint64(0x9E3779B97F4A7C15)

SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def binary(column: pa.Array) -> pa.Array:
    """A text column as bytes, nulls as empty."""
    if pa.types.is_null(column.type):
        column = column.cast(pa.string())
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    return pc.fill_null(column.cast(pa.large_binary() if wide else pa.binary()), b"")


def slices(
    batch: pa.RecordBatch, text: str = "text", most: int = SLICE_BYTES, row: str | None = None
) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Cut a batch so that each part holds about `most` bytes of text, and one row at least.

    The text is a column of the batch, or of the struct that the column `row` holds.
    """
    if not batch.num_rows:
        return
    texts = batch.column(batch.schema.get_field_index(row or text))
    texts = binary(texts if row is None else texts.field(text))
    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False), dtype=np.int64)
    at = 0
    while at < batch.num_rows:
        before = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, before + most, side="right")))
        yield batch.slice(at, to - at), texts.slice(at, to - at).to_pylist()
        at = to


@dataclass
class Words:
    """The words of several texts: places in `buffer`, and where each text's words begin."""

    buffer: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray
    text_starts: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def text_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts)


def find_words(texts: list[bytes]) -> Words:
    joined = b"\n".join([*texts, b""])
    buffer = np.frombuffer(joined, dtype=np.uint8)
    text_starts = np.zeros(len(texts) + 1, dtype=np.int64)
    np.cumsum([len(t) + 1 for t in texts], out=text_starts[1:])
    inside = np.zeros(len(buffer) + 2, dtype=np.int8)
    inside[1:-1] = ~SPACE[buffer]
    edges = np.diff(inside)
    starts, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    return Words(buffer, starts, ends, np.searchsorted(starts, text_starts), text_starts)


@lru_cache(2)
def _constants(length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    table = np.random.default_rng(20).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    base = 0x5851F42D4C957F2D
    inverse = pow(base, -1, 1 << 64)
    return table, _powers(base, length), _powers(inverse, length)


def _powers(base: int, length: int) -> np.ndarray:
    factors = np.full(length, base, dtype=np.uint64)
    factors[0] = 1
    return np.multiply.accumulate(factors)


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values; one to one."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def hash_words(words: Words, buffer: np.ndarray | None = None) -> np.ndarray:
    """A 64-bit hash of each word, the same in every process.

    A word's bytes are read as digits: with random values for bytes, the sum of value times a
    power of the place, taken from prefix sums. Long buffers go through in pieces.
    """
    source = words.buffer if buffer is None else buffer
    found = np.empty(len(words.starts), dtype=np.uint64)
    at = 0
    while at < len(found):
        low = int(words.starts[at])
        to = max(at + 1, int(np.searchsorted(words.ends, low + PIECE_BYTES, side="right")))
        high = int(words.ends[to - 1])
        table, up, down = _constants(max(PIECE_BYTES, 1 << (high - low - 1).bit_length()))
        sums = np.zeros(high - low + 1, dtype=np.uint64)
        np.cumsum(table[source[low:high]] * up[: high - low], out=sums[1:])
        s, e = words.starts[at:to] - low, words.ends[at:to] - low
        found[at:to] = mixed((sums[e] - sums[s]) * down[s] + (e - s).astype(np.uint64))
        at = to
    return found


def lowered(buffer: np.ndarray) -> np.ndarray:
    """A-Z to a-z, all else unchanged."""
    return np.where((buffer >= 65) & (buffer <= 90), buffer + 32, buffer).astype(np.uint8)


def hash_runs(hashes: np.ndarray, length: int) -> np.ndarray:
    """A hash for each run of `length` neighbours (fewer values: none)."""
    n = len(hashes) - length + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    found = np.zeros(n, dtype=np.uint64)
    for k in range(length):
        found = found * np.uint64(0xD6E8FEB86659FD93) + hashes[k : k + n]
    return mixed(found)


def found_in(values: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which values are among the sorted known ones, and where those are."""
    if not len(known):
        return np.zeros(len(values), dtype=bool), np.zeros(len(values), dtype=np.int64)
    at = np.minimum(np.searchsorted(known, values), len(known) - 1)
    return known[at] == values, at


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The places start, start + 1, ... of every stretch, one stretch after another."""
    total = int(lengths.sum())
    shift = np.repeat(starts - (np.cumsum(lengths) - lengths), lengths)
    return shift + np.arange(total)
