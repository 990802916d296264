"""Substring dedup with difference-cover anchors.

Any two positions have an offset below the period at which both stand on the cover, modulo
the period. So two equal windows of `window` words share an anchor of window - period + 1
words that both of them index, though only |cover| positions of each period are hashed.
Pass 1 finds the anchors that occur more than once. Pass 2 extends them to whole windows:
every window around a repeated anchor is hashed in full and those are compared. Pass 3
removes the words that repeated windows cover.

Windows compare as a 64-bit hash within a key range chosen by a second, independent hash,
and the number of ranges grows with the data. Documents and keys move packed (see
`exchange`); every group is bounded in bytes, but for a single text longer than that.

Null and empty texts have no words. Texts shorter than a window lose nothing. Rows are
judged one by one, also when they share a doc_id; equal rows of `window` words or more
remove each other's words entirely, as the rule says. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .exchange import KEY_ROWS, KEY_ROWS_SQL, Deal, packed_docs, repeated_keys, send_keys
from .exchange import unpack_docs, unpack_keys
from .session import written
from .text import Chunk, chunks, covered, window_hashes

WINDOW = 35
# A perfect difference set modulo 21, every difference occurs once.
PERIOD, COVER = 21, (3, 6, 7, 12, 14)

RESULT = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("n_words", pa.int64()),
        ("n_removed", pa.int64()),
        ("kept", pa.string()),
        ("kept_sha256", pa.string()),
    ]
)
RESULT_SQL = "doc_id long, n_words long, n_removed long, kept string, kept_sha256 string"


def _anchors(chunk: Chunk, window: int):
    """(words, word hashes, anchor starts, anchor hashes)"""
    words = chunk.words()
    hashes = chunk.hashes(words)
    size = window - PERIOD + 1
    starts = words.windows(size)
    on_cover = np.zeros(PERIOD, dtype=bool)
    on_cover[list(COVER)] = True
    starts = starts[on_cover[(starts - words.bounds[words.text_of[starts]]) % PERIOD]]
    return words, hashes, starts, window_hashes(hashes, starts, size)


def _member(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which values are in the sorted array."""
    if not len(known):
        return np.zeros(len(values), dtype=bool)
    return known[np.minimum(np.searchsorted(known, values), len(known) - 1)] == values


def _known(tables: list) -> np.ndarray:
    return np.unique(np.concatenate([np.zeros(0, dtype=np.uint64), *tables]))


def repeated_windows(docs: DataFrame, deal: Deal, window: int = WINDOW) -> DataFrame:
    """(grp, keys): hashes of the windows of each group that occur more than once."""
    if window < PERIOD:
        raise ValueError(f"a window has at least {PERIOD} words")

    def anchor_keys(batch):
        groups = batch.column(0).to_numpy()
        for chunk in chunks(batch.column(1)):
            words, _, starts, keys = _anchors(chunk, window)
            yield keys, groups[chunk.first + words.text_of[starts]], keys

    def window_keys(batch_and_known):
        batch, known, group = batch_and_known
        for chunk in chunks(batch.column("text")):
            words, hashes, starts, keys = _anchors(chunk, window)
            hit = starts[_member(keys, known)]
            # Windows that hold a repeated anchor on one of the offsets below the period.
            first = np.maximum(hit - (PERIOD - 1), words.bounds[words.text_of[hit]])
            wanted = covered(len(hashes), first, hit - first + 1)
            whole = words.windows(window)
            whole = whole[wanted[whole]]
            found = window_hashes(hashes, whole, window)
            other = window_hashes(chunk.hashes(words, 1), whole, window, 1)
            yield found, np.full(len(whole), group), other

    def send_anchors(batches):
        yield from send_keys(deal, batches, anchor_keys)

    def send_windows(key, left, right):
        known = _known([unpack_keys(right["keys"])[0]])
        if not len(known):
            return KEY_ROWS.empty_table()
        work = ((b, known, key[0].as_py()) for b in unpack_docs(left["docs"]))
        return pa.Table.from_batches(send_keys(deal, work, window_keys), schema=KEY_ROWS)

    grouped = docs.select(deal.group().alias("grp"), "text")
    anchors = grouped.mapInArrow(send_anchors, KEY_ROWS_SQL)
    repeated = repeated_keys(deal, anchors)
    windows = (
        packed_docs(deal, docs)
        .groupBy("grp")
        .cogroup(repeated.groupBy("grp"))
        .applyInArrow(send_windows, KEY_ROWS_SQL)
    )
    return repeated_keys(deal, windows)


def remove_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_removed, kept (the other words, one space apart), kept_sha256."""
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    deal = Deal.by_size(docs)
    repeated = written(repeated_windows(docs, deal, window), "repeated-windows")

    def strip(key, left, right):
        known = _known([unpack_keys(right["keys"])[0]])
        out = []
        for batch in unpack_docs(left["docs"]):
            rows = []
            for chunk in chunks(batch.column("text")):
                words = chunk.words()
                gone = np.zeros(len(words.starts), dtype=bool)
                if len(known):
                    starts = words.windows(window)
                    keys = window_hashes(chunk.hashes(words), starts, window)
                    gone = covered(len(gone), starts[_member(keys, known)], window)
                for i in range(len(chunk)):
                    own = gone[words.bounds[i] : words.bounds[i + 1]]
                    split = chunk.raw(i).split()
                    kept = b" ".join(compress(split, ~own) if own.any() else split)
                    rows.append(
                        (len(split), int(own.sum()), kept, hashlib.sha256(kept).hexdigest())
                    )
            columns = list(zip(*rows)) or [()] * 4
            out.append(
                pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id"),
                        pa.array(columns[0], pa.int64()),
                        pa.array(columns[1], pa.int64()),
                        pa.array(columns[2], pa.binary()).cast(pa.string()),
                        pa.array(columns[3], pa.string()),
                    ],
                    schema=RESULT,
                )
            )
        return pa.Table.from_batches(out, schema=RESULT)

    return (
        packed_docs(deal, docs)
        .groupBy("grp")
        .cogroup(repeated.groupBy("grp"))
        .applyInArrow(strip, RESULT_SQL)
    )
