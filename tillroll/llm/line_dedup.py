"""Line dedup with two Bloom filters.

Pass 1: each task fills two Bloom filters of one geometry with the line keys it reads, one
of keys seen at least once and one of keys seen at least twice, and the tasks' filters are
merged (see `bloom`). The merged twice-seen filter has a greatest size and is broadcast.
Pass 2: only lines that hit it, suspected repeats, are shuffled, as 128-bit hashes. An
exact count of documents per key confirms them and finds the document that keeps them.
Pass 3: each document loses its confirmed lines.

A false positive of the filters costs a few shuffled bytes and never a line. Null and
empty texts are one empty line. A key shorter than min_chars is never dropped. Rows that
share a doc_id count as one document; rows without a doc_id are left as they are.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bloom
from .session import fresh_name, written
from .text import LOWER, Chunk, Words, chunks

KEYS = pa.schema([("doc_id", pa.int64()), ("k1", pa.int64()), ("k2", pa.int64())])


def _keys(chunk: Chunk, min_chars: int) -> tuple[Words, np.ndarray, np.ndarray, np.ndarray]:
    """All lines; which are long enough; two hashes of the trimmed lower-case line."""
    lines = chunk.lines()
    words = chunk.words()
    first = np.searchsorted(words.starts, lines.starts)
    last = np.searchsorted(words.ends, lines.ends, side="right") - 1
    filled = np.flatnonzero(last >= first)
    starts, ends = lines.starts.copy(), lines.starts.copy()
    starts[filled] = words.starts[first[filled]]
    ends[filled] = words.ends[last[filled]]
    lowered = Chunk(chunk.first, LOWER[chunk.data], chunk.offsets)
    spans = Words(starts, ends, lines.bounds)
    long_enough = chunk.chars(spans) >= min_chars
    return lines, long_enough, lowered.hashes(spans, 0), lowered.hashes(spans, 1)


def twice_seen(docs: DataFrame, bits: int, min_chars: int) -> np.ndarray:
    """The packed filter of keys that two documents, or more, seem to share."""

    def keys_of(batch):
        for chunk in chunks(batch.column(0)):
            lines, long_enough, k1, _ = _keys(chunk, min_chars)
            of_text = np.stack([lines.text_of[long_enough].astype(np.uint64), k1[long_enough]])
            yield np.unique(of_text, axis=1)[1]

    return bloom.build(docs.select("text"), keys_of, bits, twice=True)


def filter_bits(docs: DataFrame) -> int:
    """Bits for the lines of all texts; beyond the greatest size the filters let more
    lines through to the exact count, which is right for any number of them."""
    breaks = F.length("text") - F.length(F.replace("text", F.lit("\n")))
    n = docs.agg(F.sum(F.coalesce(breaks, F.lit(0)) + 1)).first()[0] or 0
    return bloom.size_for(n)


def repeated_lines(
    docs: DataFrame, min_chars: int = 20, min_docs: int = 3, bits: int | None = None
) -> DataFrame:
    """(doc_id, k1, k2): line keys that each document has to give up."""
    spark = docs.sparkSession
    bits = bits or filter_bits(docs)
    known = spark.sparkContext.broadcast(twice_seen(docs, bits, min_chars))

    def suspects(batches):
        packed = known.value
        for batch in batches:
            ids = batch.column(0)
            for chunk in chunks(batch.column(1)):
                lines, long_enough, k1, k2 = _keys(chunk, min_chars)
                hit = long_enough & bloom.contains(packed, k1)
                if hit.any():
                    rows = np.unique(
                        np.stack([lines.text_of[hit].astype(np.uint64), k1[hit], k2[hit]]), axis=1
                    )
                    yield pa.RecordBatch.from_arrays(
                        [
                            ids.take(pa.array(rows[0].astype(np.int64) + chunk.first)),
                            pa.array(rows[1].view(np.int64)),
                            pa.array(rows[2].view(np.int64)),
                        ],
                        schema=KEYS,
                    )

    keyed = docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long"), "text")
    found = written(keyed.mapInArrow(suspects, "doc_id long, k1 long, k2 long"), "line-suspects")
    keeper = (
        found.groupBy("k1", "k2")
        .agg(F.countDistinct("doc_id").alias("docs"), F.max("doc_id").alias("keeper"))
        .where(F.col("docs") >= min_docs)
    )
    return (
        found.join(keeper, ["k1", "k2"])
        .where(F.col("doc_id") < F.col("keeper"))
        .select("doc_id", "k1", "k2")
    )


CLEANED = pa.struct([("text", pa.string()), ("n_lines", pa.int64()), ("n_dropped", pa.int64())])
CLEANED_SQL = "text string, n_lines long, n_dropped long"


def _cleaned(min_chars: int):
    def clean(texts: pa.Array, first: pa.Array, second: pa.Array) -> pa.Array:
        out, n_lines, n_dropped = [], [], []
        for chunk in chunks(texts):
            lines, long_enough, k1, k2 = _keys(chunk, min_chars)
            for i in range(len(chunk)):
                lo, hi = lines.bounds[i], lines.bounds[i + 1]
                raw, row = chunk.raw(i), chunk.first + i
                drop = np.zeros(hi - lo, dtype=bool)
                if first[row].is_valid:
                    gone = set(zip(first[row].values.to_pylist(), second[row].values.to_pylist()))
                    at = np.flatnonzero(long_enough[lo:hi]) + lo
                    pairs = zip(k1[at].view(np.int64).tolist(), k2[at].view(np.int64).tolist())
                    drop[at - lo] = [p in gone for p in pairs]
                if drop.any():
                    raw = b"\n".join(x for x, d in zip(raw.split(b"\n"), drop) if not d)
                out.append(raw)
                n_lines.append(hi - lo)
                n_dropped.append(int(drop.sum()))
        return pa.StructArray.from_arrays(
            [
                pa.array(out, pa.binary()).cast(pa.string()),
                pa.array(n_lines, pa.int64()),
                pa.array(n_dropped, pa.int64()),
            ],
            fields=list(CLEANED),
        )

    return F.arrow_udf(clean, CLEANED_SQL)


def dedup_lines(
    docs: DataFrame, min_chars: int = 20, min_docs: int = 3, bits: int | None = None
) -> DataFrame:
    """`docs` with a struct column `lines`: (text, n_lines, n_dropped) of the cleaned text.

    `docs` needs doc_id and text; a column already called `lines` keeps its name and the
    struct is called `lines_`."""
    drops = (
        repeated_lines(docs, min_chars, min_docs, bits)
        .groupBy("doc_id")
        .agg(F.collect_set(F.struct("k1", "k2")).alias("gone"))
        .select(F.col("doc_id").alias("at"), "gone")
    )
    at, gone, lines = (fresh_name(docs, x) for x in ("at", "gone", "lines"))
    drops = drops.toDF(at, gone)
    joined = docs.join(drops, docs["doc_id"] == drops[at], "left").drop(at)
    keys = (F.col(gone).getField("k1"), F.col(gone).getField("k2"))
    cleaned = _cleaned(min_chars)(F.col("text"), *keys)
    return joined.withColumn(lines, cleaned).drop(gone)
