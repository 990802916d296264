"""Runs of words that repeat with a period, found in tiles of every scale.

A run is a stretch of consecutive words with smallest period q (words q apart are equal) that
no neighbouring word extends and that is at least `exponent` periods and `min_length` words
long. Periods are searched by octave: octave k has the periods 2^k .. 2^(k+1) - 1.

1. `tiles`: every octave cuts a document into overlapping tiles around boundaries 2 * 2^k words
   apart. A run of octave k is so long (4 periods at least) that it holds a boundary followed
   by a period and another 2^k words, so that the 2^k words from the boundary recur q words
   later. Only tiles where some q of the octave passes this test go on, with those q as
   candidates; a q whose first period is itself a repetition of a shorter one is none.
2. `fragments`: each tile is solved on its own, wherever it is. At its boundary two
   Z-functions, forward and backward, give for each candidate how far words q apart stay
   equal, up to the tile's ends: an interval of places, whole or cut at the tile's ends.
3. `runs`: fragments are shuffled by document and period, those that overlap or touch are
   stitched, and intervals that are long enough become runs. Tiles reach so far beyond the
   next boundary that the fragments of one run always overlap.

The tiles of a document hold at most 16 words for each of its words and octave, and only where
words repeat; fragments of one tile batch are stitched before they are shuffled, so a
document that is one run sends a few rows. Words are compared by 64-bit hashes. A text must
fit in a task, which needs some 200 bytes for each byte of a chunk of texts.

Rows are told apart by their id, the text's 64-bit hash and its length; repeated rows share
their runs, as equal texts do. A null id is an id like others. Null and empty texts have no
words and no runs. An empty table gives an empty table. Other columns are kept by `with_runs`
whatever their names are.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .session import fresh_name
from .text import WHITE, chunks, ranges, window_hashes

MIN_LENGTH, EXPONENT = 6, 4
PAIRS_AT_ONCE = 1 << 20

KEY = [("id", pa.int64()), ("digest", pa.int64()), ("size", pa.int64())]
KEYS = [name for name, _ in KEY]
TILES = pa.schema(
    [
        *KEY,
        ("octave", pa.int32()),
        ("start", pa.int64()),  # of the tile, a word number
        ("boundary", pa.int64()),
        ("periods", pa.list_(pa.int64())),
        ("words", pa.binary()),  # 8 bytes each
    ]
)
TILES_SQL = (
    "id long, digest long, size long, octave int, start long, boundary long, "
    "periods array<long>, words binary"
)
# Words first .. last - 1 equal the words a period later.
FRAGMENTS = pa.schema([*KEY, ("period", pa.int64()), ("first", pa.int64()), ("last", pa.int64())])
FRAGMENTS_SQL = "id long, digest long, size long, period long, first long, last long"


def _smallest_factors(limit: int) -> np.ndarray:
    """The smallest prime factor of each number below `limit`."""
    factor = np.arange(max(limit, 2))
    for p in range(2, int(limit**0.5) + 1):
        if factor[p] == p:
            multiples = factor[p * p :: p]
            multiples[multiples == np.arange(p * p, len(factor), p)] = p
    return factor


def _boundaries(octave: int, begins: np.ndarray, ends: np.ndarray) -> tuple:
    """Boundaries of an octave and the end of the text of each."""
    period, step = 1 << octave, 2 << octave
    # the last boundary with room for the least period and the words compared
    counts = np.maximum(0, (ends - begins - 2 * period) // step + 1)
    counts[ends - begins < EXPONENT * period] = 0
    inside = ranges(np.zeros(len(counts), dtype=np.int64), counts)
    return np.repeat(begins, counts) + inside * step, np.repeat(ends, counts), counts


def _candidates(hashes: np.ndarray, begins: np.ndarray, ends: np.ndarray, octave: int):
    """(boundary, period) pairs, in order, whose words recur and whose period is no repetition.

    `hashes` are the words of all texts; text i is hashes[begins[i]:ends[i]]."""
    period = 1 << octave
    at, end, _ = _boundaries(octave, begins, ends)
    if not len(at):
        return at, at
    # hashes of the next 2^octave words from every place, texts' ends aside
    places = np.arange(max(0, len(hashes) - period + 1))
    grams = window_hashes(hashes, places, period) if period > 1 else hashes
    found_at, found_period = [], []
    per_block = max(1, PAIRS_AT_ONCE // period)
    for i in range(0, len(at), per_block):
        a, e = at[i : i + per_block], end[i : i + per_block]
        if period == 1:
            hit = grams[a] == grams[a + 1]
            found_at.append(a[hit])
            found_period.append(np.ones(int(hit.sum()), dtype=np.int64))
            continue
        q = np.arange(period, 2 * period)
        later = a[:, None] + q
        within = later + period <= e[:, None]
        np.minimum(later, len(grams) - 1, out=later)
        row, column = np.nonzero((grams[later] == grams[a][:, None]) & within)
        found_at.append(a[row])
        found_period.append(q[column])
    a, q = np.concatenate(found_at), np.concatenate(found_period)
    return _primitive(hashes, a, q)


def _primitive(hashes: np.ndarray, at: np.ndarray, period: np.ndarray):
    """Leave out pairs whose first period is u repeated, for any divisor's length of u."""
    if not len(at) or int(period.max()) < 2:
        return at, period
    factors = _smallest_factors(int(period.max()) + 1)
    whole, rest = np.ones(len(at), dtype=bool), period.copy()
    while (open_ := np.flatnonzero(whole & (rest > 1))).size:
        prime = factors[rest[open_]]
        rest[open_] //= prime
        shorter, a = period[open_] // prime, at[open_]
        length = period[open_] - shorter
        same = window_hashes(hashes, a, length) == window_hashes(hashes, a + shorter, length)
        whole[open_[same]] = False
    return at[whole], period[whole]


def _tile_batch(keys: list[np.ndarray], hashes, begins, ends, octave: int, at, period):
    """One tile for each boundary with candidates. `keys` are per text."""
    reach = 8 << octave
    new = np.ones(len(at), dtype=bool)
    new[1:] = np.diff(at) != 0
    boundary = at[new]
    text = np.searchsorted(begins, boundary, side="right") - 1
    # texts without words begin where the next one does
    first = np.maximum(begins[text], boundary - reach)
    last = np.minimum(ends[text], boundary + reach)
    sizes = last - first
    words = hashes[ranges(first, sizes)]
    cuts = np.append(np.flatnonzero(new), len(at))
    return pa.RecordBatch.from_arrays(
        [
            *(pa.array(k.take(pa.array(text))) for k in keys),
            pa.array(np.full(len(boundary), octave, dtype=np.int32)),
            pa.array(first - begins[text]),
            pa.array(boundary - begins[text]),
            pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), pa.array(period)),
            _packed(words, sizes),
        ],
        schema=TILES,
    )


def _packed(words: np.ndarray, sizes: np.ndarray) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum(sizes)]) * 8
    large = pa.Array.from_buffers(
        pa.large_binary(),
        len(sizes),
        [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(words.tobytes())],
    )
    return large.cast(pa.binary())


def _pieces(at: np.ndarray, period: np.ndarray, octave: int, max_bytes: int = 16 << 20):
    """Runs of pairs whose tiles fill a batch; the pairs of a boundary stay together."""
    tile = 8 * (16 << octave)
    new = np.ones(len(at), dtype=bool)
    new[1:] = np.diff(at) != 0
    piece = ((np.cumsum(new) - 1) * tile) // max_bytes
    cuts = np.flatnonzero(np.diff(piece, prepend=-1, append=-1)) if len(at) else []
    for a, b in zip(cuts[:-1], cuts[1:]):
        yield at[a:b], period[a:b]


def tiles(docs: DataFrame) -> DataFrame:
    """Tiles with candidate periods of documents given as (id, digest, size, text)."""

    def explode(batches):
        for batch in batches:
            for chunk in chunks(batch.column(3)):
                keys = [batch.column(i).slice(chunk.first, len(chunk)) for i in range(3)]
                words = chunk.words(WHITE)
                hashes = chunk.hashes(words)
                begins, ends = words.bounds[:-1], words.bounds[1:]
                longest = int((ends - begins).max(initial=0))
                octave = 0
                while EXPONENT << octave <= longest:
                    pairs = _candidates(hashes, begins, ends, octave)
                    for at, period in _pieces(*pairs, octave):
                        yield _tile_batch(keys, hashes, begins, ends, octave, at, period)
                    octave += 1

    return docs.mapInArrow(explode, TILES_SQL)


def _z_values(words: np.ndarray, low, high, at, period) -> tuple[np.ndarray, np.ndarray]:
    """How far words `period` apart stay equal from `at` on, and before it, between `low` and
    `high`; all places in `words`."""
    forward, backward = high - period - at, at - low
    out = []
    for sizes, step in ((forward, 1), (backward, -1)):
        place = ranges(np.zeros(len(sizes), dtype=np.int64), sizes)
        here = np.repeat(at if step > 0 else at - 1, sizes) + step * place
        differs = words[here] != words[here + np.repeat(period, sizes)]
        # the first difference of each pair, or its end
        found = np.flatnonzero(differs)
        starts = np.cumsum(sizes) - sizes
        next_ = np.append(found, np.iinfo(np.int64).max)[np.searchsorted(found, starts)]
        out.append(np.minimum(next_ - starts, sizes))
    return out[0], out[1]


def _stitched(group: np.ndarray, first: np.ndarray, last: np.ndarray):
    """Overlapping or touching intervals of a group become one."""
    order = np.lexsort((last, first, group))
    group, first, last = group[order], first[order], last[order]
    # ends so far within the group: lift every group above the one before
    lift = group * (int(last.max(initial=0)) + 2)
    ends = np.maximum.accumulate(last + lift)
    new = np.ones(len(group), dtype=bool)
    new[1:] = first[1:] + lift[1:] > ends[:-1]
    starts = np.flatnonzero(new)
    closing = np.append(starts[1:], len(group)) - 1
    return group[starts], first[starts], (ends - lift)[closing]


def fragments(tiles_: DataFrame) -> DataFrame:
    """Intervals of places equal to the place a period later, one tile at a time."""

    def solve(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            periods = batch.column("periods")
            n = np.diff(periods.offsets.to_numpy())
            period = periods.flatten().to_numpy()
            tile = np.repeat(np.arange(batch.num_rows), n)
            packed = batch.column("words").cast(pa.large_binary())
            at = np.frombuffer(packed.buffers()[1], dtype=np.int64)
            at = at[packed.offset : packed.offset + len(packed) + 1] // 8
            words = np.frombuffer(packed.buffers()[2], dtype=np.uint64)
            start = batch.column("start").to_numpy()
            boundary = at[:-1] + batch.column("boundary").to_numpy() - start
            # as many pairs at once as their places fill an array
            cost = np.cumsum(np.repeat(np.diff(at), n)) // (4 << 20)
            cuts = np.flatnonzero(np.diff(cost, prepend=-1, append=-1))
            firsts, lasts = [], []
            for a, b in zip(cuts[:-1], cuts[1:]):
                t, q = tile[a:b], period[a:b]
                z, back = _z_values(words, at[:-1][t], at[1:][t], boundary[t], q)
                middle = boundary[t] - at[:-1][t] + start[t]
                firsts.append(middle - back)
                lasts.append(middle + z)
            first, last = np.concatenate(firsts), np.concatenate(lasts)
            # tiles of one document stand together; a group is a document and a period
            key = pa.table([batch.column(i) for i in range(3)], names=KEYS)
            changes = np.ones(batch.num_rows, dtype=bool)
            for name in KEYS:
                c = key[name].combine_chunks()
                known = c.is_valid().to_numpy(zero_copy_only=False)
                value = c.fill_null(0).to_numpy()
                same = (value[1:] == value[:-1]) & (known[1:] == known[:-1])
                changes[1:] &= same
            changes[1:] = ~changes[1:]
            doc = np.cumsum(changes) - 1
            top = int(period.max()) + 1
            group, first, last = _stitched(doc[tile] * top + period, first, last)
            row = np.flatnonzero(changes)[group // top]
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(i).take(pa.array(row)) for i in range(3)),
                    pa.array(group % top),
                    pa.array(first),
                    pa.array(last),
                ],
                schema=FRAGMENTS,
            )

    return tiles_.mapInArrow(solve, FRAGMENTS_SQL)


def runs(fragments_: DataFrame) -> DataFrame:
    """(id, digest, size, start, length, period) of all runs, from their fragments."""
    group = [*KEYS, "period"]
    by_place = Window.partitionBy(*group).orderBy("first", "last")
    before = F.max("last").over(by_place.rowsBetween(Window.unboundedPreceding, -1))
    opens = F.coalesce(F.col("first") > before, F.lit(True)).cast("int")
    stretches = (
        fragments_.withColumn("opens", opens)
        .withColumn("stretch", F.sum("opens").over(by_place))
        .groupBy(*group, "stretch")
        .agg(F.min("first").alias("start"), F.max("last").alias("last"))
    )
    length = F.col("last") - F.col("start") + F.col("period")
    return stretches.select(*KEYS, "start", length.alias("length"), "period").where(
        F.col("length") >= F.greatest(F.lit(MIN_LENGTH), EXPONENT * F.col("period"))
    )


RUNS_SQL = "array<struct<start: bigint, length: bigint, period: bigint>>"


def with_runs(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """`docs` and a column `runs`: the runs of the text, by start, then period.

    The runs of one document are one row, no more than its words. Texts are shuffled once if
    the rows with runs are too many to be broadcast by Spark's own size check."""
    name = fresh_name(docs, "runs")
    keyed = [F.col(doc_id).cast("long"), F.xxhash64(F.col(text)), F.octet_length(text).cast("long")]
    slim = docs.select(*(c.alias(k) for c, k in zip(keyed, KEYS)), F.col(text).alias("text"))
    found = (
        runs(fragments(tiles(slim)))
        .groupBy(*KEYS)
        .agg(F.array_sort(F.collect_list(F.struct("start", "length", "period"))).alias("found"))
        .select(F.struct(*KEYS).alias("of"), "found")
    )
    key = F.struct(*(c.alias(k) for c, k in zip(keyed, KEYS)))
    rows = docs.select(F.struct("*").alias("row"), key.alias("key"))
    joined = rows.join(found, F.col("key").eqNullSafe(F.col("of")), "left")
    none = F.array().cast(RUNS_SQL)
    return joined.select("row.*", F.coalesce("found", none).alias(name))


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit("([^\\x20\\x09-\\x0D]+)"), 1)


def collapsed(text: Column, runs_: Column) -> Column:
    """The text's words joined by one space, of each run only the first period."""

    def keep(texts: pa.Array, lists: pa.Array) -> pa.Array:
        out: list[str] = []
        sizes = np.diff(lists.offsets.to_numpy())
        flat = lists.flatten()
        start, length, period = (
            flat.field(i).to_numpy(zero_copy_only=False) for i in range(3)
        )
        ends = np.cumsum(sizes)
        for chunk in chunks(texts):
            words = chunk.words(WHITE)
            i = np.arange(chunk.first, chunk.first + len(chunk))
            of = np.repeat(i - chunk.first, sizes[i])
            here = ranges((ends - sizes)[i], sizes[i])
            edges = np.zeros(len(words.starts) + 1, dtype=np.int64)
            begin = words.bounds[of] + start[here]
            np.add.at(edges, begin + period[here], 1)
            np.add.at(edges, begin + length[here], -1)
            kept = np.cumsum(edges[:-1]) == 0
            # each kept word and a space after it, the last one's left out
            counts = np.concatenate([[0], np.cumsum(kept)])[words.bounds]
            starts, spans = words.starts[kept], (words.ends - words.starts)[kept]
            data = np.append(chunk.data, np.uint8(0x20))
            place = ranges(starts, spans + 1)
            closing = np.cumsum(spans + 1)
            place[closing - 1] = len(chunk.data)
            raw = data[place].tobytes()
            cut = np.concatenate([[0], closing])[counts].tolist()
            out.extend(raw[a : max(a, b - 1)].decode() for a, b in zip(cut[:-1], cut[1:]))
        return pa.array(out, type=pa.string())

    return F.arrow_udf(keep, "string")(text, runs_)


def runs_text(runs_: Column) -> Column:
    """`start,length,period` and a line feed for each run."""
    line = F.transform(runs_, lambda r: F.concat_ws(",", r.start, r.length, r.period))
    return F.array_join(F.transform(line, lambda s: F.concat(s, F.lit("\n"))), "")


def strongest(runs_: Column) -> Column:
    """The run of the greatest length over period, the first of equals; null without runs.

    Ratios are compared as doubles, which tells all ratios apart in texts of fewer than
    2^26 words, and never puts equal ratios in an order."""
    ranked = F.transform(
        runs_,
        lambda r: F.struct(
            (-(r.length / r.period)).alias("by"),
            r.start.alias("start"),
            r.period.alias("period"),
            r.length.alias("length"),
        ),
    )
    return F.array_min(ranked)

