"""Word splitting and rolling hashes over Arrow text columns, vectorised.

Texts of a batch lie back to back in one Arrow buffer. The functions here walk
that buffer in blocks of about a quarter megabyte, cut between documents or, inside a
very long text, between words, so memory does not follow the length of a text.

A hash of a run of symbols is the polynomial sum of their mapped values times
rising powers of an odd base modulo 2**64 (Rabin-Karp), shifted back to the
run's first position and scrambled. All runs of a block come from one prefix sum.
"""

from __future__ import annotations

import sys
import types
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK = 1 << 18

U64 = np.uint64


def _table(*separators: tuple[int, int]) -> np.ndarray:
    table = np.zeros(256, dtype=bool)
    for low, high in separators:
        table[low : high + 1] = True
    return table


#: Bytes between words: ASCII white space only.
SPACES = _table((0x09, 0x0D), (0x20, 0x20))
#: Bytes between words: every ASCII character but letters and digits.
NOT_WORD = _table((0x00, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7F))


def mix(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit values so that every bit depends on all others."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def salted(values: np.ndarray, salt: int) -> np.ndarray:
    """Another hash of the same values."""
    return mix(values.astype(U64, copy=False) + U64((salt * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) % 2**64))


class Rolling:
    """Prefix sums of one base, with its powers and their inverses up to a length that
    grows when asked for. The powers are not sent along with a task: every task brings
    its own copy of this module, so they live once per process, beside the modules."""

    def __init__(self, base: int):
        self.base, self.inverse, self.length = base, pow(base, -1, 2**64), 0

    def __reduce__(self):
        return Rolling, (self.base,)

    def grow(self, n: int) -> None:
        """Have powers for runs of ``n`` values."""
        if n <= self.length:
            return
        store = sys.modules.setdefault("_rolling_powers", types.ModuleType("_rolling_powers")).__dict__
        self.length, self.powers, self.inverses = store.get(str(self.base), (0, None, None))
        if n > self.length:
            self.length = max(n, BLOCK)
            self.powers, self.inverses = (np.cumprod(np.concatenate([np.ones(1, U64), np.full(self.length, x, U64)]), dtype=U64) for x in (self.base, self.inverse))
            store[str(self.base)] = self.length, self.powers, self.inverses

    def runs(self, values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Hash of values[s:e] for each pair of bounds."""
        n = len(values)
        self.grow(n)
        sums = np.zeros(n + 1, dtype=U64)
        np.cumsum(values * self.powers[:n], dtype=U64, out=sums[1:])
        return mix((sums[ends] - sums[starts]) * self.inverses[starts] + (ends - starts).astype(U64))


_BYTES = Rolling(0x5851F42D4C957F2D)
_WORDS = Rolling(0xD1342543DE82EF95)
#: What a byte counts as in a hash; the folded table reads A-Z as a-z.
EXACT = mix(np.arange(1, 257, dtype=U64) * U64(0x9E3779B97F4A7C15))
FOLDED = EXACT.copy()
FOLDED[65:91] = EXACT[97:123]


@dataclass
class Words:
    """Words of a run of texts: hash, byte bounds in the buffer, and for text i
    the word range first[i]:first[i + 1]."""

    hashes: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def owner(self) -> np.ndarray:
        """Index of the text of each word."""
        return np.repeat(np.arange(len(self.first) - 1), self.counts)


def buffer_of(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and bounds of a text column; null reads as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_binary()) if pa.types.is_large_string(column.type) or pa.types.is_string(column.type) else column
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    kind = np.int64 if pa.types.is_large_binary(column.type) else np.int32
    bounds = np.frombuffer(offsets, dtype=kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    whole = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[bounds[0] : bounds[-1]], bounds - bounds[0]


def _pieces(data: np.ndarray, bounds: np.ndarray, separators: np.ndarray) -> Iterator[tuple[int, int]]:
    """Byte ranges of about BLOCK bytes that end where no word goes on."""
    at, end = 0, len(data)
    while at < end:
        stop = min(at + BLOCK, end)
        if stop < end:
            cut = bounds[np.searchsorted(bounds, stop, side="right") - 1]
            if cut > at:
                stop = int(cut)
            else:
                gaps = np.flatnonzero(separators[data[at:stop]])
                while not len(gaps) and stop < end:  # one word longer than a block
                    low, stop = stop, min(stop + BLOCK, end)
                    gaps = low - at + np.flatnonzero(separators[data[low:stop]])
                if stop < end or len(gaps) and cut <= at:
                    following = bounds[np.searchsorted(bounds, at, side="right")]
                    stop = int(min(at + gaps[-1] + 1 if len(gaps) else stop, following if following > at else stop))
        yield at, stop
        at = stop


def split_words(data: np.ndarray, bounds: np.ndarray, fold: bool = False, separators: np.ndarray = SPACES) -> Words:
    """Words of every text: maximal runs of bytes that separate no words."""
    table = FOLDED if fold else EXACT
    hashes, starts, ends = [], [], []
    edges = np.unique(bounds)
    for low, high in _pieces(data, bounds, separators):
        part = data[low:high]
        inside = ~separators[part]
        begins, stops = inside.copy(), inside.copy()
        begins[1:] &= ~inside[:-1]
        stops[:-1] &= ~inside[1:]
        cuts = edges[np.searchsorted(edges, low, side="right") : np.searchsorted(edges, high, side="left")] - low
        begins[cuts] |= inside[cuts]
        stops[cuts - 1] |= inside[cuts - 1]
        s, e = np.flatnonzero(begins), np.flatnonzero(stops) + 1
        hashes.append(_BYTES.runs(table[part], s, e))
        starts.append(s + low)
        ends.append(e + low)
    if not hashes:
        none = np.zeros(0, np.int64)
        return Words(np.zeros(0, U64), none, none, np.zeros(len(bounds), np.int64))
    starts = np.concatenate(starts)
    return Words(np.concatenate(hashes), starts, np.concatenate(ends), np.searchsorted(starts, bounds))


def windows(hashes: np.ndarray, first: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all windows of ``length`` consecutive words of one text, and the
    index of each window's first word."""
    if len(hashes) < length:
        return np.zeros(0, U64), np.zeros(0, np.int64)
    owner = np.repeat(np.arange(len(first) - 1), np.diff(first))
    at = np.flatnonzero(owner[: len(owner) - length + 1] == owner[length - 1 :])
    found = []
    for low in range(0, len(at), BLOCK):
        part = at[low : low + BLOCK]
        base = part[0]
        found.append(_WORDS.runs(hashes[base : part[-1] + length], part - base, part - base + length))
    return (np.concatenate(found) if found else np.zeros(0, U64)), at


def sequences(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """One hash for the whole word sequence of each text."""
    out = np.zeros(len(first) - 1, U64)
    for i, (low, high) in enumerate(zip(first[:-1], first[1:])):
        if high > low:
            out[i] = _WORDS.runs(hashes[low:high], np.array([0]), np.array([high - low]))[0]
    return out


def slices(batch: pa.RecordBatch, text: str = "text", limit: int = 2 * BLOCK) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with at most ``limit`` bytes of text each, or one row."""
    column = batch.column(batch.schema.get_field_index(text))
    sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    group = np.cumsum(sizes) // limit
    edges = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(sizes)] if len(sizes) else [0]
    for low, high in zip(edges[:-1], edges[1:]):
        yield batch.slice(low, high - low)
