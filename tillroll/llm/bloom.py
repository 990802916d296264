"""Bloom filters of keys seen once and twice, built by tasks and merged in slices.

A task gathers keys and hands over its filters as compressed slices of bits, sparse ones
being small. Merging two tasks is once = a.once | b.once and twice = a.twice | b.twice |
(a.once & b.once), so a key of two tasks is never missed. Merged filters have a greatest
size and may be broadcast; what they let through has to be confirmed elsewhere.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import mix

SLICE_BITS = 1 << 20
BITS_PER_KEY = 16
MIN_BITS, MAX_BITS = 1 << 20, 1 << 29  # the largest filter is 64 MB
FLUSH_KEYS = 2 << 20

ROWS = pa.schema([("slice", pa.int32()), ("once", pa.binary()), ("twice", pa.binary())])
ROWS_SQL = "slice int, once binary, twice binary"


def size_for(keys: int) -> int:
    """Bits for so many keys, a power of two."""
    return min(max(1 << (BITS_PER_KEY * keys).bit_length(), MIN_BITS), MAX_BITS)


def positions(keys: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The two bits of each well-mixed key."""
    mask = np.uint64(bits - 1)
    return (keys & mask).astype(np.int64), ((keys >> np.uint64(32)) & mask).astype(np.int64)


def contains(packed: np.ndarray, keys: np.ndarray) -> np.ndarray:
    found = np.ones(len(keys), dtype=bool)
    for at in positions(keys, len(packed) * 8):
        found &= (packed[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 > 0
    return found


def _bits(at: np.ndarray, size: int) -> bytes:
    flags = np.zeros(size, dtype=bool)
    flags[at] = True
    return zlib.compress(np.packbits(flags).tobytes(), 1)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(c, f.type) for c, f in zip(zip(*rows), ROWS)], schema=ROWS
    )


def _slices(keys: np.ndarray, bits: int) -> Iterator[pa.RecordBatch]:
    """Rows of the filters of some keys, each key given once for each time it is seen."""
    keys, counts = np.unique(keys, return_counts=True)
    size = min(bits, SLICE_BITS)
    once = np.unique(np.concatenate(positions(keys, bits)))
    twice = np.unique(np.concatenate(positions(keys[counts > 1], bits)))
    edges = np.arange(0, bits + 1, size)
    cut, cut_twice = np.searchsorted(once, edges), np.searchsorted(twice, edges)
    for i in np.flatnonzero(np.diff(cut)):
        one = once[cut[i] : cut[i + 1]] - edges[i]
        two = twice[cut_twice[i] : cut_twice[i + 1]] - edges[i]
        yield _batch([(int(i), _bits(one, size), _bits(two, size))])


def build(source: DataFrame, keys_of: Callable, bits: int, twice: bool) -> np.ndarray:
    """The packed once-seen or twice-seen filter of keys_of(batch), arrays of keys."""

    def fill(batches):
        held: list[np.ndarray] = []
        for batch in batches:
            held.extend(keys_of(batch))
            if sum(map(len, held)) >= FLUSH_KEYS:
                yield from _slices(np.concatenate(held), bits)
                held = []
        if held:
            yield from _slices(np.concatenate(held), bits)

    def merge(batches):
        whole: dict[int, list[np.ndarray]] = {}
        for batch in batches:
            for row in batch.to_pylist():
                one, two = (
                    np.frombuffer(zlib.decompress(row[c]), dtype=np.uint8) for c in ("once", "twice")
                )
                if row["slice"] in whole:
                    old = whole[row["slice"]]
                    old[1] |= two | (old[0] & one)
                    old[0] |= one
                else:
                    whole[row["slice"]] = [one.copy(), two.copy()]
        for number, both in whole.items():
            yield _batch([(number, zlib.compress(both[twice].tobytes(), 1), b"")])

    merged = source.mapInArrow(fill, ROWS_SQL).repartition("slice").mapInArrow(merge, ROWS_SQL)
    packed = np.zeros(bits // 8, dtype=np.uint8)
    # Compressed slices of one filter, MAX_BITS at most, in one job and not one for each partition.
    for row in merged.select("slice", "once").collect():
        part = np.frombuffer(zlib.decompress(row.once), dtype=np.uint8)
        packed[row.slice * (SLICE_BITS // 8) :][: len(part)] = part
    return packed


def _mixed_ids(ids: pa.Array) -> np.ndarray:
    return mix(ids.to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64) + np.uint64(1))


def among(ids: DataFrame) -> Callable[[Column], Column]:
    """A test whether a long may be one of `ids` (a single column without nulls): true for
    all of them and a few others. The test of a null is false."""
    spark = ids.sparkSession
    packed = build(ids, lambda batch: [_mixed_ids(batch.column(0))], size_for(ids.count()), False)
    known = spark.sparkContext.broadcast(packed)

    def test(column: pa.Array) -> pa.Array:
        return pa.array(contains(known.value, _mixed_ids(column.fill_null(0))))

    def maybe(column: Column) -> Column:
        return column.isNotNull() & F.arrow_udf(test, "boolean")(column.cast("long"))

    return maybe
