"""Benchmark decontamination with suffix arrays of the training texts.

Documents are cut into shards, and a suffix array is built over the words of each. The
suffixes of the benchmark items are binary-searched in it, all at once; the interval found
holds every place where a benchmark window stands verbatim. From these places come the hit
words and the items found. Where windows stand one after the other, the places of the
documents and those of the items are sorted together to full depth, and neighbours in that
order give the longest verbatim match and where it stands on both sides. Documents with too
large a share of hit words are contaminated.

A window is `window` consecutive words of an item; a shorter item is one window as a whole.
The array leaves out suffixes that start with a word sequence no item has.

The benchmark may be of any size: its items are dealt to blocks of about BLOCK_BYTES of text
by a hash, a task indexes each block, and the indexes lie in the shared folder. All documents
are read once, against a Bloom filter of all windows (64 MB at most). Those it lets through,
and no others, are written aside and searched for each block in turn; one block's index at a
time is with the driver and the tasks. Only documents that the filter lets through are joined
with their hits. A filter of more than 33 million windows lets more documents through; the
result is the same.

Null or empty texts, on either side, have no words: such a document is never contaminated,
such an item never found. Rows with one item_id are one item; items without an id are one
item with an empty name. Equal documents get equal results; other columns pass through. A
single text, or item, is worked on as a whole by one task.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import bloom
from .session import fresh_name, written
from .text import NOT_ALNUM, Chunk, Words, chunks, covered, ranges, window_hashes

WINDOW = 13
BLOCK_BYTES = 4 << 20  # of the items indexed together
SHARD_BYTES = 4 << 20  # of the documents in a suffix array


@dataclass
class Searched:
    """The windows of some items, as sorted symbols of a vocabulary of their own."""

    vocabulary: np.ndarray  # hashes of the items' words, sorted; symbol = place + 1
    symbols: np.ndarray  # one row for each distinct window, padded with 0
    lengths: np.ndarray
    bounds: np.ndarray  # window i belongs to items[bounds[i]:bounds[i + 1]]
    items: np.ndarray
    names: list[str]
    # every place of a window in the items, in order: the window, the item, its first word
    at_place: np.ndarray
    place_item: np.ndarray
    place_start: np.ndarray
    bits: int = field(init=False)

    def __post_init__(self):
        self.bits = max(1, int(len(self.vocabulary) + 1).bit_length())

    def packed(self, columns: list[np.ndarray]) -> list[np.ndarray]:
        """Symbols, word by word, as few integers that compare in the same order."""
        per_key, keys = 64 // self.bits, []
        for i in range(0, len(columns), per_key):
            group = columns[i : i + per_key]
            shifts = [np.uint64(self.bits * (per_key - 1 - j)) for j in range(len(group))]
            keys.append(reduce(np.bitwise_or, (c << s for c, s in zip(group, shifts))))
        return keys


def _symbols(vocabulary: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Place of each word in the vocabulary plus 1; 0 if it isn't there."""
    if not len(vocabulary):
        return np.zeros(len(hashes), dtype=np.uint64)
    at = np.minimum(np.searchsorted(vocabulary, hashes), len(vocabulary) - 1)
    return np.where(vocabulary[at] == hashes, at + 1, 0).astype(np.uint64)


def _at_depth(symbols: np.ndarray, starts: np.ndarray, ends: np.ndarray, depth: int):
    """The symbols 0 .. depth - 1 words after each start, 0 from `ends` on."""
    padded = np.concatenate([symbols, np.zeros(1, dtype=np.uint64)])
    return [
        np.where(starts + k < ends, padded[np.minimum(starts + k, len(symbols))], 0).astype(
            np.uint64
        )
        for k in range(depth)
    ]


def index_items(names: list[str], texts: list[str | None], window: int) -> Searched:
    found, places, first = [], [], 0
    for chunk in chunks(pa.array(texts, pa.string())):
        lowered = chunk.lower()
        words = lowered.words(NOT_ALNUM)
        found.append(lowered.hashes(words))
        begin, end = words.bounds[:-1] + first, words.bounds[1:] + first
        first += len(words.starts)
        n = end - begin
        per_item = np.where(n >= window, n - window + 1, np.minimum(n, 1))
        item = np.repeat(np.arange(len(chunk)) + chunk.first, per_item)
        starts = ranges(begin, per_item)
        inside = ranges(np.zeros(len(n), dtype=np.int64), per_item)
        places.append((starts, np.minimum(window, np.repeat(n, per_item)), item, inside))
    hashes = np.concatenate([np.zeros(0, dtype=np.uint64), *found])
    starts, lengths, item, inside = (
        np.concatenate([np.zeros(0, dtype=np.int64), *(p[i] for p in places)]) for i in range(4)
    )
    vocabulary = np.unique(hashes)
    symbols = np.stack(
        _at_depth(_symbols(vocabulary, hashes), starts, starts + lengths, window), axis=1
    )
    rows, which = np.unique(symbols, axis=0, return_inverse=True)
    which = which.ravel()
    pairs = np.unique(np.stack([which, item], axis=1), axis=0)
    bounds = np.searchsorted(pairs[:, 0], np.arange(len(rows) + 1))
    return Searched(
        vocabulary, rows, (rows > 0).sum(axis=1), bounds, pairs[:, 1], names, which, item, inside
    )


def _search(array: list[np.ndarray], wanted: list[np.ndarray], right: bool) -> np.ndarray:
    """Binary search of all wanted keys in the sorted array at once, key by key."""
    low = np.zeros(len(wanted[0]), dtype=np.int64)
    high = np.full(len(wanted[0]), len(array[0]), dtype=np.int64)
    while (open_ := low < high).any():
        mid = (low + high) // 2
        at = np.minimum(mid, len(array[0]) - 1)
        less, equal = np.zeros(len(low), dtype=bool), np.ones(len(low), dtype=bool)
        for a, w in zip(array, wanted):
            less |= equal & (a[at] < w)
            equal &= a[at] == w
        go = open_ & (less | (equal if right else False))
        low = np.where(go, mid + 1, low)
        high = np.where(open_ & ~go, mid, high)
    return low


@dataclass
class Shard:
    """Suffixes of a shard's words, sorted to the depth of the windows."""

    words: Words
    places: np.ndarray  # the suffix array: first words, in suffix order
    keys: list[np.ndarray]

    @staticmethod
    def build(chunk: Chunk, searched: Searched) -> Shard:
        lowered = chunk.lower()
        words = lowered.words(NOT_ALNUM)
        symbols = _symbols(searched.vocabulary, lowered.hashes(words))
        ends = words.bounds[1:][words.text_of]
        least = int(searched.lengths.min()) if len(searched.lengths) else 1
        unknown = np.concatenate([[0], np.cumsum(symbols == 0)])
        places = words.windows(least)
        places = places[unknown[places + least] == unknown[places]]
        depth = searched.symbols.shape[1]
        keys = searched.packed(_at_depth(symbols, places, ends[places], depth))
        order = np.lexsort(keys[::-1])
        return Shard(words, places[order], [k[order] for k in keys])

    def locate(self, searched: Searched) -> tuple[np.ndarray, np.ndarray]:
        """(window, first word) of every occurrence of every window."""
        if not len(self.places) or not len(searched.lengths):
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        columns = list(searched.symbols.T)
        most = np.uint64((1 << searched.bits) - 1)
        upper = [np.where(k < searched.lengths, c, most) for k, c in enumerate(columns)]
        low = _search(self.keys, searched.packed(columns), right=False)
        high = _search(self.keys, searched.packed(upper), right=True)
        counts = high - low
        return np.repeat(np.arange(len(low)), counts), self.places[ranges(low, counts)]


@dataclass
class Matches:
    """Stretches of words that stand in a text and in an item alike."""

    text: np.ndarray
    start: np.ndarray  # first word, in the text
    words: np.ndarray
    item: np.ndarray
    item_start: np.ndarray

    def first_of(self, group: np.ndarray, *then: np.ndarray) -> np.ndarray:
        """Of each group the longest match; of equally long ones the first by `then`."""
        order = np.lexsort((*then[::-1], -self.words, group))
        return order[np.flatnonzero(np.diff(group[order], prepend=-1))]


class Stretches:
    """Window numbers in the order of the words, of texts first and then of items, sorted as
    suffixes: doubling ranks by the next 1, 2, 4 ... windows of the same stretch."""

    def __init__(self, windows: np.ndarray, goes_on: np.ndarray, n_texts: int):
        n = len(windows)
        ends = np.flatnonzero(~goes_on)
        self.n, self.n_texts = n, n_texts
        self.room = ends[np.searchsorted(ends, np.arange(n))] - np.arange(n) + 1
        ranks = np.unique(windows, return_inverse=True)[1].ravel() + 1
        self.levels, step = [ranks], 1
        most = min(self.room[:n_texts].max(initial=0), self.room[n_texts:].max(initial=0))
        while step < most:
            ahead = np.where(self.room > step, ranks[np.minimum(np.arange(n) + step, n - 1)], 0)
            ranks = np.unique(ranks * (n + 1) + ahead, return_inverse=True)[1].ravel() + 1
            self.levels.append(ranks)
            step *= 2
        self.order = np.argsort(ranks, kind="stable")

    def alike(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """How many windows the suffixes at x and y have in common."""
        most = np.minimum(self.room[x], self.room[y])
        found = np.zeros(len(x), dtype=np.int64)
        for k in reversed(range(len(self.levels))):
            a, b = (np.minimum(p + found, self.n - 1) for p in (x, y))
            same = (found < most) & (self.levels[k][a] == self.levels[k][b])
            found[same] += 1 << k
        return np.minimum(found, most)

    def nearest(self, of_items: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each place on one side: the place, the one on the other side whose suffix has
        most windows in common with its own (a neighbour in the order), and how many."""
        other = (self.order < self.n_texts) == of_items
        rank = np.arange(self.n)
        before = np.maximum.accumulate(np.where(other, rank, -1))
        after = np.minimum.accumulate(np.where(other, rank, self.n)[::-1])[::-1]
        mine = np.flatnonzero(~other)
        x = self.order[mine]
        best, most = np.zeros(len(x), dtype=np.int64), np.full(len(x), -1)
        for near in (before[mine], after[mine]):
            there = (near >= 0) & (near < self.n)
            y = self.order[np.clip(near, 0, self.n - 1)]
            common = np.where(there, self.alike(x, y), -1)
            best, most = np.where(common > most, y, best), np.maximum(common, most)
        return x, best, most


def _matches(
    searched: Searched, words: Words, window: np.ndarray, first: np.ndarray, of_items: bool
) -> Matches:
    """The longest match that starts at each place where a window was found: at each place of
    the texts or, with `of_items`, at each place of the items."""
    depth = searched.symbols.shape[1]
    whole = searched.lengths[window] == depth
    order = np.argsort(first[whole], kind="stable")
    places, numbers = first[whole][order], window[whole][order]
    found = np.zeros(len(searched.lengths), dtype=bool)
    found[numbers] = True
    own = np.flatnonzero(found[searched.at_place])
    on = np.zeros(len(places) + len(own), dtype=bool)
    if len(places):
        text, item = words.text_of[places], searched.place_item[own]
        on[: len(places) - 1] = (np.diff(places) == 1) & (np.diff(text) == 0)
        on[len(places) : -1] = (np.diff(own) == 1) & (np.diff(item) == 0)
    stretches = Stretches(
        np.concatenate([numbers, searched.at_place[own]]).astype(np.int64), on, len(places)
    )
    x, y, common = stretches.nearest(of_items)
    if of_items:
        x, y = y, x
    place, k = places[x], own[y - len(places)]
    # An item shorter than a window is a match as a whole; it is one of its names.
    short = np.flatnonzero(~whole)
    counts = np.diff(searched.bounds)[window[short]] if of_items else np.ones_like(short)
    named = searched.items[ranges(searched.bounds[:-1][window[short]], counts)]
    short = np.repeat(short, counts)
    start = np.concatenate([place, first[short]])
    text = words.text_of[start]
    return Matches(
        text,
        start - words.bounds[text],
        np.concatenate([common + depth - 1, searched.lengths[window[short]]]),
        np.concatenate([searched.place_item[k], named]),
        np.concatenate([searched.place_start[k], np.zeros(len(short), dtype=np.int64)]),
    )


MATCH = pa.struct(
    [
        ("words", pa.int64()),
        ("start", pa.int64()),
        ("item", pa.string()),
        ("item_start", pa.int64()),
    ]
)
FOUND = pa.struct([("hits", pa.binary()), ("items", pa.list_(pa.string())), ("match", MATCH)])
MATCH_SQL = "struct<words: long, start: long, item: string, item_start: long>"
FOUND_SQL = f"hits binary, items array<string>, match {MATCH_SQL}"
ITEM_MATCHES = pa.schema(
    [
        ("item", pa.string()),
        ("words", pa.int64()),
        ("doc_id", pa.int64()),
        ("start", pa.int64()),
        ("item_start", pa.int64()),
    ]
)
ITEM_MATCHES_SQL = "item string, words long, doc_id long, start long, item_start long"


def _find(texts: pa.Array, searched: Searched) -> pa.Array:
    """Per text: packed flags of the hit words (null: none), items, the longest match."""
    hits, items, matches = [], [], []
    for chunk in chunks(texts, SHARD_BYTES):
        shard = Shard.build(chunk, searched)
        words = shard.words
        window, first = shard.locate(searched)
        hit = covered(len(words.starts), first, searched.lengths[window])
        text = words.text_of[first]
        pairs = np.unique(text * len(searched.lengths) + window)
        text_of_pair, window_of_pair = np.divmod(pairs, max(1, len(searched.lengths)))
        counts = np.diff(searched.bounds)[window_of_pair]
        item = searched.items[ranges(searched.bounds[:-1][window_of_pair], counts)]
        named = np.unique(np.repeat(text_of_pair, counts) * len(searched.names) + item)
        text_of_item, item = np.divmod(named, max(1, len(searched.names)))
        item_bounds = np.searchsorted(text_of_item, np.arange(len(chunk) + 1))
        longest: list[dict | None] = [None] * len(chunk)
        if len(first):
            m = _matches(searched, words, window, first, of_items=False)
            for i in m.first_of(m.text, m.start).tolist():
                longest[m.text[i]] = {
                    "words": int(m.words[i]),
                    "start": int(m.start[i]),
                    "item": searched.names[m.item[i]],
                    "item_start": int(m.item_start[i]),
                }
        matches += longest
        for i in range(len(chunk)):
            own = item[item_bounds[i] : item_bounds[i + 1]]
            flags = hit[words.bounds[i] : words.bounds[i + 1]]
            hits.append(np.packbits(flags).tobytes() if len(own) else None)
            items.append([searched.names[j] for j in own])
    return pa.StructArray.from_arrays(
        [
            pa.array(hits, pa.binary()),
            pa.array(items, pa.list_(pa.string())),
            pa.array(matches, MATCH),
        ],
        fields=list(FOUND),
    )


def _find_items(batch: pa.RecordBatch, searched: Searched) -> Iterator[pa.RecordBatch]:
    """Per item found in a shard of (doc_id, text) rows, its longest match there."""
    ids = batch.column(0).to_pylist()
    for chunk in chunks(batch.column(1), SHARD_BYTES):
        shard = Shard.build(chunk, searched)
        window, first = shard.locate(searched)
        if not len(first):
            continue
        m = _matches(searched, shard.words, window, first, of_items=True)
        best = m.first_of(m.item, m.item_start, m.text, m.start)
        columns = (
            [searched.names[j] for j in m.item[best]],
            m.words[best],
            [ids[chunk.first + j] for j in m.text[best]],
            m.start[best],
            m.item_start[best],
        )
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, f.type) for c, f in zip(columns, ITEM_MATCHES)], schema=ITEM_MATCHES
        )


def _window_keys(chunk: Chunk, window: int) -> np.ndarray:
    """A hash of each window of the items of a chunk."""
    lowered = chunk.lower()
    words = lowered.words(NOT_ALNUM)
    n = words.counts
    per_item = np.where(n >= window, n - window + 1, np.minimum(n, 1))
    lengths = np.repeat(np.minimum(n, window), per_item)
    return window_hashes(lowered.hashes(words), ranges(words.bounds[:-1], per_item), lengths)


def _n_words(texts: pa.Array) -> pa.Array:
    counts = [c.lower().words(NOT_ALNUM).counts for c in chunks(texts)]
    return pa.array(np.concatenate([np.zeros(0, dtype=np.int64), *counts]))


SCREENED = pa.struct([("n_words", pa.int64()), ("maybe", pa.bool_())])
SCREENED_SQL = "n_words long, maybe boolean"


def _screen(texts: pa.Array, known: np.ndarray, lengths: list[int]) -> pa.Array:
    """Per text: its words, and whether it may hold a window (true if it does)."""
    n_words, maybe = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=bool)]
    for chunk in chunks(texts):
        lowered = chunk.lower()
        words = lowered.words(NOT_ALNUM)
        hashes = lowered.hashes(words)
        passed = np.zeros(len(chunk), dtype=bool)
        for n in lengths:
            places = words.windows(n)
            hit = bloom.contains(known, window_hashes(hashes, places, n))
            passed[words.text_of[places[hit]]] = True
        n_words.append(words.counts)
        maybe.append(passed)
    return pa.StructArray.from_arrays(
        [pa.array(np.concatenate(n_words)), pa.array(np.concatenate(maybe))],
        fields=list(SCREENED),
    )


@dataclass
class Benchmark:
    """The indexes of the blocks of items, in the shared folder, and the filter of all windows."""

    index: DataFrame  # block, data
    blocks: list[int]
    screen: Callable[[Column], Column]

    @staticmethod
    def of(benchmark: DataFrame, window: int, block_bytes: int) -> Benchmark:
        spark = benchmark.sparkSession
        items = (
            benchmark.select(
                F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("name"), "text"
            )
            .where(F.length("text") > 0)
            .distinct()
        )
        size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        n_blocks = 1 + size // block_bytes

        def build(table: pa.Table) -> pa.Table:
            names = table["name"].to_pylist()
            found = index_items(names, table["text"].to_pylist(), window)
            return pa.table(
                {"block": table["block"][:1], "data": pa.array([pickle.dumps(found)], pa.binary())}
            )

        dealt = items.withColumn("block", F.pmod(F.xxhash64("name", "text"), F.lit(n_blocks)))
        index = written(
            dealt.groupBy("block").applyInArrow(build, "block long, data binary"), "benchmark"
        )
        counted = items.select(F.arrow_udf(_n_words, "long")(F.col("text")).alias("n"))
        lengths = counted.where("n > 0").select(F.least("n", F.lit(window))).distinct()

        def keys_of(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
            return (_window_keys(c, window) for c in chunks(batch.column(0)))

        # at most `window` different lengths
        sizes = sorted(row[0] for row in lengths.collect())
        # a window starts at a word, and a word has two bytes or more with what follows it
        bits = bloom.size_for(size // 2)
        known = spark.sparkContext.broadcast(bloom.build(items.select("text"), keys_of, bits, False))

        def screen(texts: pa.Array) -> pa.Array:
            return _screen(texts, known.value, sizes)

        blocks = [row[0] for row in index.select("block").orderBy("block").collect()]
        return Benchmark(index, blocks, F.arrow_udf(screen, SCREENED_SQL))

    def passes(self) -> Iterator[Broadcast]:
        """The index of one block after the other, given up when the next one is asked for."""
        for block in self.blocks:
            data = self.index.where(F.col("block") == block).first().data
            known = self.index.sparkSession.sparkContext.broadcast(pickle.loads(data))
            yield known
            known.destroy()


def _runs(bits: Column) -> Column:
    """How many bits of a binary are set, and how many in the longest run."""

    def count(b: bytes | None) -> tuple[int, int]:
        if not b:
            return 0, 0
        flags = np.unpackbits(np.frombuffer(b, dtype=np.uint8)).view(np.int8)
        edges = np.flatnonzero(np.diff(np.concatenate([[0], flags, [0]])))
        lengths = edges[1::2] - edges[::2]
        return int(lengths.sum()), int(lengths.max(initial=0))

    def counts(column: pa.Array) -> pa.Array:
        found = np.array([count(b) for b in column.to_pylist()], dtype=np.int64).reshape(-1, 2)
        return pa.StructArray.from_arrays(
            [pa.array(found[:, 0]), pa.array(found[:, 1])], names=["n", "longest"]
        )

    return F.arrow_udf(counts, "n long, longest long")(bits)


def _merged(parts: Column) -> Column:
    """Bitwise or of equally long binaries."""

    def merge(column: pa.Array) -> pa.Array:
        return pa.array(
            [
                reduce(np.bitwise_or, (np.frombuffer(b, dtype=np.uint8) for b in some)).tobytes()
                for some in column.to_pylist()
            ],
            pa.binary(),
        )

    return F.arrow_udf(merge, "binary")(parts)


def _hits(suspects: DataFrame, searched: Benchmark) -> DataFrame:
    """What the blocks found, per id and digest of the text: hit words, items, longest match."""

    def finder(known: Broadcast):
        return F.arrow_udf(lambda texts: _find(texts, known.value), FOUND_SQL)

    passes = [
        written(
            suspects.select("id", "digest", finder(known)(F.col("text")).alias("f"))
            .where(F.size("f.items") > 0)
            .select("id", "digest", "f.*"),
            "contaminated",
        ).distinct()
        for known in searched.passes()
    ]
    if not passes:
        nothing = f"id string, digest long, {FOUND_SQL}"
        return suspects.sparkSession.createDataFrame([], nothing)
    match = F.col("match")
    # negative, so that the least is the longest and, of these, the first
    ranked = F.struct(
        (-match["words"]).alias("words"),
        *(match[c].alias(c) for c in ("start", "item", "item_start")),
    )
    best = F.struct(
        (-F.col("match.words")).alias("words"),
        *(F.col(f"match.{c}").alias(c) for c in ("start", "item", "item_start")),
    )
    return (
        reduce(DataFrame.unionByName, passes)
        .groupBy("id", "digest")
        .agg(
            F.collect_list("hits").alias("hits"),  # one of each block
            F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
            F.min(ranked).alias("match"),
        )
        .select("id", "digest", _merged(F.col("hits")).alias("hits"), "items", best.alias("match"))
    )


def find_contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    name: str = "contamination",
    window: int = WINDOW,
    one_in: int = 20,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """`docs` with a struct: n_words, n_hit, items (sorted names), longest (words of the
    longest run of hit words), contaminated (one word in `one_in`, or more, is hit) and match,
    the longest verbatim match of at least a window or a whole shorter item: words, start (the
    number of its first word in the text), item and item_start. Of equally long ones it is the
    first in the text, with one of the items that have it; null if nothing is hit."""
    searched = Benchmark.of(benchmark, window, block_bytes)
    found = fresh_name(docs, name)
    screened = docs.withColumn(found, searched.screen(F.col("text")))
    doc_id = F.col("doc_id").cast("string")
    held = F.col(found)

    def judged(n_hit: Column, items: Column, longest: Column, match: Column) -> Column:
        n_words = held["n_words"]
        return F.struct(
            n_words.alias("n_words"),
            n_hit.alias("n_hit"),
            items.alias("items"),
            longest.alias("longest"),
            ((n_hit > 0) & (one_in * n_hit >= n_words)).alias("contaminated"),
            match.alias("match"),
        )

    zero = F.lit(0).cast("long")
    clean = screened.where(~held["maybe"]).withColumn(
        found, judged(zero, F.array().cast("array<string>"), zero, F.lit(None).cast(MATCH_SQL))
    )
    suspects = written(screened.where(held["maybe"]), "suspects")
    digest = F.xxhash64("text")
    keyed = suspects.select(doc_id.alias("id"), digest.alias("digest"), "text")
    hit, key, of_text = (fresh_name(suspects, n) for n in ("hit", "key", "digest"))
    counted = _hits(keyed, searched).select(
        F.col("id").alias(key),
        F.col("digest").alias(of_text),
        F.struct("items", "match", _runs(F.col("hits")).alias("runs")).alias(hit),
    )
    same = doc_id.eqNullSafe(F.col(key)) & (digest == F.col(of_text))
    of = F.col(hit)
    known = suspects.join(counted, same, "left").withColumn(
        found,
        judged(
            F.coalesce(of["runs"]["n"], zero),
            F.coalesce(of["items"], F.array().cast("array<string>")),
            F.coalesce(of["runs"]["longest"], zero),
            of["match"],
        ),
    )
    return clean.unionByName(known.select(*clean.columns))


def longest_matches(
    docs: DataFrame,
    benchmark: DataFrame,
    window: int = WINDOW,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """Each item that is found, with its longest verbatim match: item, words, doc_id, start
    (first word in that document) and item_start. Of equally long ones it is the one with the
    least doc_id, then start and item_start, among those that the shards report."""
    searched = Benchmark.of(benchmark, window, block_bytes)
    screened = docs.select(F.col("doc_id").cast("long"), "text").where(
        searched.screen(F.col("text"))["maybe"]
    )
    suspects = written(screened, "suspects")

    def finder(known: Broadcast):
        def find(batches):
            for batch in batches:
                yield from _find_items(batch, known.value)

        return find

    passes = [
        written(suspects.mapInArrow(finder(known), ITEM_MATCHES_SQL), "matches")
        for known in searched.passes()
    ]
    if not passes:
        return docs.sparkSession.createDataFrame([], ITEM_MATCHES_SQL)
    ranked = F.struct((-F.col("words")).alias("words"), "doc_id", "start", "item_start")
    best = reduce(DataFrame.unionByName, passes).groupBy("item").agg(F.min(ranked).alias("m"))
    return best.select("item", (-F.col("m.words")).alias("words"), "m.doc_id", "m.start", "m.item_start")


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents that are not contaminated, with the columns they had."""
    name = fresh_name(docs, "contamination")
    marked = find_contamination(docs, benchmark, name, **options)
    return marked.where(~F.col(name)["contaminated"]).drop(name)
