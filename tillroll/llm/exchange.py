"""Which keys of which texts occur more than once, found by one shuffle of packed keys.

Documents are dealt to groups by a hash of doc_id. A task that has read some documents
sends, for each range of keys and each group, one row with all the keys, 8 bytes each. A
task of the other side gets all rows of a key range, sorts the keys and answers each
group with those of its keys that occur elsewhere too.

A key that a task meets twice is known to be repeated there and then: the task answers
its groups directly and sends the key on only once, so a key of a third of all rows
reaches its range at most twice a task. Ranges and groups grow in number with the data.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

GROUP_BYTES = 16 << 20  # of text in a group of documents
FLUSH_KEYS = 3 << 20

KEY_ROWS = pa.schema([("range", pa.int32()), ("grp", pa.int32()), ("keys", pa.binary())])
KEY_ROWS_SQL = "range int, grp int, keys binary"
ANSWERS = pa.schema([("grp", pa.int32()), ("keys", pa.binary())])
ANSWERS_SQL = "grp int, keys binary"
PACKED = pa.schema([("grp", pa.int32()), ("docs", pa.binary())])
PACKED_SQL = "grp int, docs binary"


@dataclass(frozen=True)
class Deal:
    """How many groups of documents and ranges of keys there are."""

    groups: int
    ranges: int

    @staticmethod
    def by_size(docs: DataFrame, text: str = "text", group_bytes: int = GROUP_BYTES) -> Deal:
        size = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
        groups = 1 + size // group_bytes
        return Deal(groups, 1 + groups // 2)

    def group(self, doc_id: str = "doc_id"):
        return F.pmod(F.xxhash64(doc_id), F.lit(self.groups)).cast("int")


def _rows(cells: np.ndarray, keys: np.ndarray, ranges: np.ndarray, groups: np.ndarray):
    """One row for each run of equal cells."""
    first = np.flatnonzero(np.diff(cells, prepend=-1))
    offsets = np.append(first, len(cells)) * 8
    packed = pa.Array.from_buffers(
        pa.binary(),
        len(first),
        [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(keys.tobytes())],
    )
    return pa.RecordBatch.from_arrays(
        [pa.array(ranges[first].astype(np.int32)), pa.array(groups[first].astype(np.int32)), packed],
        schema=KEY_ROWS,
    )


def _flush(deal: Deal, keys: np.ndarray, groups: np.ndarray, ranges: np.ndarray) -> Iterator:
    """Rows for the keys a task has gathered."""
    order = np.lexsort((groups, keys))
    keys, groups, ranges = keys[order], groups[order], ranges[order]
    same = keys[1:] == keys[:-1]
    starts = np.concatenate([[True], ~same])
    again = np.concatenate([same, [False]]) | np.concatenate([[False], same])
    second = np.concatenate([[False], same & starts[:-1]])
    # To the range: each key once, a repeated one twice.
    sent = starts | second
    k, g, r = keys[sent], groups[sent], ranges[sent]
    order = np.lexsort((k, g, r))
    k, g, r = k[order], g[order], r[order]
    yield _rows(r.astype(np.int64) * deal.groups + g, k, r, g)
    # Straight to the groups: repeated keys, under a range of each group's own.
    new = again & np.concatenate([[True], ~(same & (groups[1:] == groups[:-1]))])
    if new.any():
        k, g = keys[new], groups[new]
        order = np.argsort(g, kind="stable")
        k, g = k[order], g[order]
        yield _rows(g.astype(np.int64), k, deal.ranges + g, g)


def send_keys(deal: Deal, batches, keys_of: Callable) -> Iterator[pa.RecordBatch]:
    """keys_of(batch) yields (keys, group of each key, range hash of each key)."""
    held: list[tuple] = []
    for batch in batches:
        for keys, groups, spread in keys_of(batch):
            if len(keys):
                ranges = (spread % np.uint64(deal.ranges)).astype(np.int32)
                held.append((keys, groups.astype(np.int32), ranges))
        if sum(len(h[0]) for h in held) >= FLUSH_KEYS:
            yield from _flush(deal, *(np.concatenate(x) for x in zip(*held)))
            held = []
    if held:
        yield from _flush(deal, *(np.concatenate(x) for x in zip(*held)))


def unpack_keys(column: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All keys of a column of packed keys, and how many each row has."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    if not len(column):
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    keys = np.frombuffer(data, dtype=np.uint8)[at[0] : at[-1]].view(np.uint64)
    return keys, np.diff(at) // 8


def repeated_keys(deal: Deal, rows: DataFrame) -> DataFrame:
    """(grp, keys): of the keys sent by each group, those that occur more than once."""

    def judge(table: pa.Table) -> pa.Table:
        if not len(table):
            return ANSWERS.empty_table()
        if table["range"][0].as_py() >= deal.ranges:
            return table.select(["grp", "keys"]).cast(ANSWERS)
        keys, counts = unpack_keys(table["keys"])
        groups = np.repeat(table["grp"].to_numpy(), counts)
        order = np.argsort(keys, kind="stable")
        keys, groups = keys[order], groups[order]
        same = keys[1:] == keys[:-1]
        again = np.concatenate([same, [False]]) | np.concatenate([[False], same])
        keys, groups = keys[again], groups[again]
        order = np.lexsort((keys, groups))
        keys, groups = keys[order], groups[order]
        new = np.ones(len(keys), dtype=bool)
        new[1:] = (keys[1:] != keys[:-1]) | (groups[1:] != groups[:-1])
        keys, groups = keys[new], groups[new]
        if not len(keys):
            return ANSWERS.empty_table()
        batch = _rows(groups.astype(np.int64), keys, groups, groups)
        return pa.Table.from_batches([batch]).select(["grp", "keys"]).cast(ANSWERS)

    return rows.groupBy("range").applyInArrow(judge, ANSWERS_SQL)


def packed_docs(deal: Deal, docs: DataFrame) -> DataFrame:
    """(grp, docs): doc_id and text of some documents of a group, compressed."""

    def pack(batches):
        options = pa.ipc.IpcWriteOptions(compression="zstd")
        for batch in batches:
            groups = batch.column(0).to_numpy()
            order = np.argsort(groups, kind="stable")
            cuts = np.flatnonzero(np.diff(groups[order])) + 1
            out = []
            for rows in np.split(order, cuts) if len(order) else []:
                part = batch.select([1, 2]).take(pa.array(rows))
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, part.schema, options=options) as stream:
                    stream.write_batch(part)
                out.append((int(groups[rows[0]]), sink.getvalue().to_pybytes()))
            if out:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, f.type) for c, f in zip(zip(*out), PACKED)], schema=PACKED
                )

    keyed = docs.select(deal.group().alias("grp"), F.col("doc_id").cast("long"), "text")
    return keyed.mapInArrow(pack, PACKED_SQL)


def unpack_docs(column: pa.ChunkedArray) -> Iterator[pa.RecordBatch]:
    for chunk in column.chunks:
        for value in chunk:
            yield from pa.ipc.open_stream(value.as_buffer())
