"""Words, lines and their hashes for whole batches of texts, in numpy.

Texts are handled as the UTF-8 bytes that Arrow already holds. A hash of any span is
the difference of two prefix sums, so every word and every window of words costs a
few array operations, however long the windows are.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import cache, cached_property

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 20

_rng = np.random.default_rng(20_240_229)
# Two independent hash families: (value of each byte, multiplier of words).
_BYTE_VALUES = _rng.integers(1, 2**63, (2, 256), dtype=np.uint64)
_BYTE_STEP = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
_WORD_STEP = (0xC2B2AE3D27D4EB4F, 0xA0761D6478BD642F)


def byte_table(members: Iterable[int]) -> np.ndarray:
    table = np.zeros(256, dtype=bool)
    table[list(members)] = True
    return table


# Words [^\x20\x09-\x0D]+ end at these bytes.
WHITE = byte_table([0x20, *range(0x09, 0x0E)])
# Words [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ of lower-cased text: letters, digits, non-ASCII.
NOT_ALNUM = byte_table(
    b for b in range(0x80) if not (chr(b).isdigit() or chr(b).isascii() and chr(b).isalpha())
)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32
CONTINUATION = byte_table(range(0x80, 0xC0))


TILE = 1 << 16  # positions whose powers are kept; longer arrays are summed tile by tile


@cache
def _powers(step: int, size: int) -> np.ndarray:
    """step^0 .. step^(size - 1) modulo 2^64."""
    table = np.full(size, step, dtype=np.uint64)
    table[0] = 1
    return np.multiply.accumulate(table)


def _tile_powers(step: int, tiles: int) -> np.ndarray:
    """Powers of the step at the beginning of each tile."""
    table = np.full(tiles, pow(step, TILE, 2**64), dtype=np.uint64)
    table[0] = 1
    return np.multiply.accumulate(table)


def mix(h: np.ndarray) -> np.ndarray:
    """Spread every input bit over all 64 bits (the finalizer of MurmurHash3)."""
    h = h ^ (h >> np.uint64(33))
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


def _ascending(places: np.ndarray) -> bool:
    return bool((places[1:] >= places[:-1]).all())


def _prefix_sums(
    values: np.ndarray, table: np.ndarray | None, step: int, places: list[np.ndarray]
) -> list[np.ndarray]:
    """For each array of places p: the sums of values[i] * step^i over i < p.

    Places in ascending order are served tile by tile, so nothing grows with the values;
    for others all sums are held, 8 bytes a value."""
    n = len(values)
    if not all(map(_ascending, places)):
        (sums,) = _prefix_sums(values, table, step, [np.arange(n + 1)])
        return [sums[p] for p in places]
    tiles = n // TILE + 1
    up, far = _powers(step, TILE), _tile_powers(step, tiles)
    found = [np.empty(len(p), dtype=np.uint64) for p in places]
    cuts = [np.searchsorted(p, np.arange(tiles + 1) * TILE) for p in places]
    before = np.zeros(1, dtype=np.uint64)
    for k in range(tiles):
        begin = k * TILE
        part = values[begin : begin + TILE]
        part = part if table is None else table[part]
        sums = np.zeros(len(part) + 1, dtype=np.uint64)
        np.cumsum(part * up[: len(part)], out=sums[1:])
        sums = sums * far[k] + before
        for p, out, cut in zip(places, found, cuts):
            here = slice(cut[k], cut[k + 1])
            out[here] = sums[p[here] - begin]
        before = sums[-1:]
    return found


def span_hashes(
    values: np.ndarray,
    starts: np.ndarray,
    ends: np.ndarray,
    step: int,
    table: np.ndarray | None = None,
) -> np.ndarray:
    """Polynomial hash of values[start:end], mixed with the length, for each span.

    With a table, table[v] stands for each value v."""
    from_start, to_end = _prefix_sums(values, table, step, [starts, ends])
    back = pow(step, -1, 2**64)
    h = to_end - from_start
    h *= _powers(back, TILE)[starts % TILE]
    h *= _tile_powers(back, len(values) // TILE + 1)[starts // TILE]
    return mix(h + (ends - starts).astype(np.uint64) * np.uint64(0x9FB21C651E98DF25))


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of every range, one after the other."""
    total = int(lengths.sum())
    first = np.cumsum(lengths) - lengths
    return np.arange(total) + np.repeat(starts - first, lengths)


def covered(n: int, starts: np.ndarray, lengths: np.ndarray | int) -> np.ndarray:
    """Which of n positions lie in at least one range."""
    edges = np.zeros(n + 1, dtype=np.int32)
    np.add.at(edges, starts, 1)
    np.add.at(edges, starts + lengths, -1)
    np.cumsum(edges, out=edges)
    return edges[:n] > 0


def repeated(keys: np.ndarray) -> np.ndarray:
    """Which keys occur at least twice."""
    flags = np.zeros(len(keys), dtype=bool)
    if len(keys):
        order = np.argsort(keys, kind="stable")
        same = keys[order[1:]] == keys[order[:-1]]
        flags[order[1:][same]] = True
        flags[order[:-1][same]] = True
    return flags


def later_repeats(keys: np.ndarray) -> np.ndarray:
    """Which keys equal an earlier one."""
    flags = np.zeros(len(keys), dtype=bool)
    if len(keys):
        order = np.argsort(keys, kind="stable")
        flags[order[1:][keys[order[1:]] == keys[order[:-1]]]] = True
    return flags


_LIBC = ctypes.CDLL(None)


def give_back() -> None:
    """Return freed memory to the system. Workers wait for their next task, and others run
    beside them, with all they once held; allocators keep it unless they are told."""
    pa.default_memory_pool().release_unused()
    if hasattr(_LIBC, "malloc_trim"):
        _LIBC.malloc_trim(0)


@dataclass
class Words:
    """Words of a chunk: byte spans, and the word bounds of each text."""

    starts: np.ndarray
    ends: np.ndarray
    bounds: np.ndarray  # text i has the words bounds[i] .. bounds[i + 1]

    @cached_property
    def counts(self) -> np.ndarray:
        return np.diff(self.bounds)

    @cached_property
    def text_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.counts)), self.counts)

    def windows(self, n: int) -> np.ndarray:
        """First words of all windows of n words of one text."""
        i = np.arange(max(0, len(self.starts) - n + 1))
        return i[i + n <= self.bounds[self.text_of[: len(i)] + 1]]


@dataclass
class Chunk:
    """Some consecutive texts of a batch; a null text is an empty one."""

    first: int  # row of the batch
    data: np.ndarray  # bytes of all texts
    offsets: np.ndarray  # text i is data[offsets[i]:offsets[i + 1]]

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def raw(self, i: int) -> bytes:
        return self.data[self.offsets[i] : self.offsets[i + 1]].tobytes()

    def lower(self) -> Chunk:
        """A-Z in lower case."""
        return Chunk(self.first, LOWER[self.data], self.offsets)

    def words(self, breaks: np.ndarray = WHITE) -> Words:
        inside = np.zeros(len(self.data) + 2, dtype=bool)
        np.logical_not(breaks[self.data], out=inside[1:-1])
        here, before, after = inside[1:-1], inside[:-2].copy(), inside[2:].copy()
        edges = self.offsets[(self.offsets > 0) & (self.offsets < len(self.data))]
        before[edges] = False
        after[edges - 1] = False
        starts = np.flatnonzero(here & ~before)
        ends = np.flatnonzero(here & ~after) + 1
        return Words(starts, ends, np.searchsorted(starts, self.offsets))

    def lines(self) -> Words:
        """Lines split at \\n, an empty text being one empty line. Bounds as for words."""
        breaks = np.flatnonzero(self.data == 0x0A)
        starts = np.sort(np.concatenate([self.offsets[:-1], breaks + 1]), kind="stable")
        ends = np.sort(np.concatenate([self.offsets[1:], breaks]), kind="stable")
        counts = 1 + np.diff(np.searchsorted(breaks, self.offsets))
        return Words(starts, ends, np.concatenate([[0], np.cumsum(counts)]))

    def hashes(self, spans: Words, family: int = 0) -> np.ndarray:
        """A hash of the bytes of each span."""
        return span_hashes(
            self.data, spans.starts, spans.ends, _BYTE_STEP[family], _BYTE_VALUES[family]
        )

    def chars(self, spans: Words) -> np.ndarray:
        """Code points of each span."""
        if not len(spans.starts):
            return np.zeros(0, dtype=np.int64)
        begins = np.append(~CONTINUATION[self.data], False)
        bounds = np.stack([spans.starts, spans.ends], axis=1).ravel()
        counts = np.add.reduceat(begins, bounds, dtype=np.int64)[::2]
        return np.where(spans.starts < spans.ends, counts, 0)

    def sums(self, marked: np.ndarray) -> np.ndarray:
        """How many bytes of each text are marked."""
        return np.array(
            [np.count_nonzero(marked[a:b]) for a, b in zip(self.offsets, self.offsets[1:])],
            dtype=np.int64,
        )


def window_hashes(
    words: np.ndarray, starts: np.ndarray, n: int | np.ndarray, family: int = 0
) -> np.ndarray:
    """A hash of the n words from each start."""
    return span_hashes(words, starts, starts + n, _WORD_STEP[family])


def chunks(texts: pa.Array, max_bytes: int = CHUNK_BYTES) -> Iterator[Chunk]:
    """Whole texts, about max_bytes at a time; a longer text is a chunk of its own."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if len(texts) == 0:
        return
    texts = texts.cast(pa.large_string())
    if texts.null_count:
        texts = texts.fill_null("")
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(data, dtype=np.uint8) if data else np.zeros(0, dtype=np.uint8)
    i = 0
    while i < len(texts):
        j = int(np.searchsorted(offsets, offsets[i] + max_bytes, side="right")) - 1
        j = min(max(j, i + 1), len(texts))
        yield Chunk(i, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
        i = j
    give_back()
