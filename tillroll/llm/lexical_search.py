"""Ranked lexical search over bit-sliced Bloom signatures, exact in the end.

The index has a signature for every document: a Bloom filter of its terms, with one more entry
for each power of two that a term's count reaches. Documents of similar size share a number of
bits and lie together in blocks; a block is stored by bit, not by document: slice b is a bitmap
of the documents whose bit b is set. A term's slices, and-ed, are a bitmap of the documents
that may hold it, all that do among them, and those of its higher entries bound its count from
above. Sums of the terms' weights over these bitmaps, each with the greatest count possible,
are an upper bound on a document's score.

A search works on the queries in blocks of `QUERY_BYTES` of text, one after the other:

1. One pass over the documents counts those that hold each query term.
2. One pass over the index finds, for each query, the documents of greatest bound; these are
   scored exactly, and the k-th best score of a query is a threshold.
3. Another pass over the index hands on every document whose bound reaches the threshold.
   Only the others are provably not among the best k.
4. All of these are scored exactly from their whole texts, and each query keeps its best k.

Nothing depends on how tight the bounds are but the number of documents scored. Terms are told
apart by 64-bit hashes. Texts that are scored move once, with the list of their queries, if
Spark's own size check does not broadcast that list; a task holds the signatures of a few
thousand documents or one block of 16 MB.

A null text has no terms and is never found; a query without terms finds nothing. Rows that
share a doc_id are documents of their own, each with its place in the ranks; equal scores are
ranked by doc_id, null last. Rows of queries that share an id are queries of their own. An
empty table, of documents or of queries, gives no rows. Other columns are not looked at.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .session import written
from .text import NOT_ALNUM, chunks, mix, ranges

QUERY_BYTES = 8 << 20  # of query texts at once
BITS_PER_ENTRY, HASHES = 16, 4
MIN_BITS, MAX_BITS = 1 << 8, 1 << 21  # of a signature; a fuller one bounds less tightly
BLOCK_DOCS, BLOCK_BITS = 2048, 1 << 24
PAIRS_AT_ONCE = 4 << 20

INDEX = pa.schema(
    [
        ("bits", pa.int32()),
        ("ids", pa.list_(pa.int64())),
        ("lengths", pa.list_(pa.int64())),
        ("n_docs", pa.int64()),  # with a term
        ("n_terms", pa.int64()),
        ("slices", pa.binary()),  # `bits` bitmaps of the block's documents
    ]
)
INDEX_SQL = (
    "bits int, ids array<bigint>, lengths array<bigint>, n_docs bigint, n_terms bigint, "
    "slices binary"
)
COUNTS = pa.schema([("term", pa.int32()), ("df", pa.int64())])
FOUND = pa.schema([("item", pa.int32()), ("doc_id", pa.int64()), ("score", pa.int64())])
FOUND_SQL = "item int, doc_id bigint, score bigint"


def _entries(terms: np.ndarray, level: np.ndarray | int) -> np.ndarray:
    """The hash of the entry that says a term occurs 2^level times at least."""
    return mix(terms + np.asarray(level, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03))


def _positions(entries: np.ndarray, bits: int) -> np.ndarray:
    """The bits of each entry, a row for each hash."""
    other = mix(entries ^ np.uint64(0xA24BAED4963EE407))
    parts = [entries, entries >> np.uint64(32), other, other >> np.uint64(32)]
    return np.stack([(p & np.uint64(bits - 1)).astype(np.int64) for p in parts[:HASHES]])


def _term_counts(chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, term, count) of every different term of each text, and the texts' lengths."""
    words = chunk.lower().words(NOT_ALNUM)
    hashes, text = chunk.lower().hashes(words), words.text_of
    order = np.lexsort((hashes, text))
    hashes, text = hashes[order], text[order]
    new = np.ones(len(order), dtype=bool)
    new[1:] = (np.diff(hashes) != 0) | (np.diff(text) != 0)
    first = np.flatnonzero(new)
    counts = np.diff(np.append(first, len(order)))
    return text[first], hashes[first], counts, words.counts


def _floor_log2(counts: np.ndarray) -> np.ndarray:
    return np.frexp(counts.astype(np.float64))[1] - 1


class _Gathered:
    """Documents of one signature size that wait for a block."""

    def __init__(self, bits: int):
        self.bits, self.n = bits, 0
        self.limit = max(8, min(BLOCK_DOCS, BLOCK_BITS // bits))
        self.entries, self.docs, self.ids, self.lengths = [], [], [], []

    def add(self, entries, sizes, ids, lengths):
        """Documents one after the other; yields each full block."""
        ends = np.cumsum(sizes)
        at = 0
        while at < len(sizes):
            take = min(self.limit - self.n, len(sizes) - at)
            part = slice(ends[at] - sizes[at], ends[at + take - 1])
            self.entries.append(entries[part])
            self.docs.append(np.repeat(self.n + np.arange(take), sizes[at : at + take]))
            self.ids.append(ids.slice(at, take))
            self.lengths.append(lengths[at : at + take])
            self.n += take
            at += take
            if self.n == self.limit:
                yield self.block()

    def block(self) -> pa.RecordBatch:
        marks = np.zeros((self.bits, -(-self.n // 8) * 8), dtype=bool)
        docs = np.concatenate(self.docs)
        for at in _positions(np.concatenate(self.entries), self.bits):
            marks[at, docs] = True
        lengths = np.concatenate(self.lengths)
        row = [
            self.bits,
            pa.concat_arrays(self.ids).to_pylist(),
            lengths.tolist(),
            int((lengths > 0).sum()),
            int(lengths.sum()),
            np.packbits(marks, axis=1).tobytes(),
        ]
        self.__init__(self.bits)
        return pa.RecordBatch.from_arrays(
            [pa.array([v], f.type) for v, f in zip(row, INDEX)], schema=INDEX
        )


def build_index(docs: DataFrame) -> DataFrame:
    """Blocks of signatures of every row of `docs` (doc_id, text), each row once."""

    def index(batches):
        gathered: dict[int, _Gathered] = {}
        for batch in batches:
            for chunk in chunks(batch.column(1)):
                ids = batch.column(0).slice(chunk.first, len(chunk))
                text, terms, counts, lengths = _term_counts(chunk)
                levels = _floor_log2(counts) + 1
                level = ranges(np.zeros(len(levels), dtype=np.int64), levels)
                entries = _entries(np.repeat(terms, levels), level)
                sizes = np.bincount(text, weights=levels, minlength=len(chunk)).astype(np.int64)
                wanted = np.maximum(sizes * BITS_PER_ENTRY, MIN_BITS)
                bits = np.minimum(1 << np.ceil(np.log2(wanted)).astype(np.int64), MAX_BITS)
                starts = np.cumsum(sizes) - sizes
                for b in np.unique(bits[sizes > 0]):
                    rows = np.flatnonzero((bits == b) & (sizes > 0))
                    block = gathered.setdefault(int(b), _Gathered(int(b)))
                    yield from block.add(
                        entries[ranges(starts[rows], sizes[rows])],
                        sizes[rows],
                        ids.take(pa.array(rows)),
                        lengths[rows].astype(np.int64),
                    )
        for block in gathered.values():
            if block.n:
                yield block.block()

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(index, INDEX_SQL)


@dataclass(frozen=True)
class Queries:
    """Some queries, their different terms, and what scores depend on."""

    terms: np.ndarray  # hashes, ascending
    items: np.ndarray  # of each term, the queries that hold it: items[bounds[t]:bounds[t + 1]]
    bounds: np.ndarray
    n_items: int
    weights: np.ndarray | None = None
    n_docs: int = 0
    n_terms: int = 0
    thresholds: np.ndarray | None = None

    @staticmethod
    def of(texts: list[str | None]) -> Queries:
        items, hashes = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.uint64)]
        for chunk in chunks(pa.array(texts, type=pa.string())):
            text, terms, _, _ = _term_counts(chunk)
            items.append(chunk.first + text)
            hashes.append(terms)
        items, hashes = np.concatenate(items), np.concatenate(hashes)
        order = np.lexsort((items, hashes))
        terms, first = np.unique(hashes[order], return_index=True)
        return Queries(terms, items[order], np.append(first, len(order)), len(texts))

    def known(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which hashes are query terms, and the terms' numbers."""
        if not len(self.terms):
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        at = np.minimum(np.searchsorted(self.terms, hashes), len(self.terms) - 1)
        here = np.flatnonzero(self.terms[at] == hashes)
        return here, at[here]

    def weighted(self, df: np.ndarray, n_docs: int, n_terms: int) -> Queries:
        weights = np.floor(1000 * np.log((2 * n_docs + 2) / (2 * df + 1))).astype(np.int64)
        return replace(self, weights=weights, n_docs=n_docs, n_terms=n_terms)

    def impacts(self, term: np.ndarray, count: np.ndarray, length: np.ndarray) -> np.ndarray:
        """What a term adds to the score of a document of some length that holds it so often."""
        m = 100 - 50 + (50 * length * self.n_docs) // self.n_terms
        return self.weights[term] * ((1_000_000_000 * count) // (1000 * count + 20 * m))

    def scores(self, term, doc, count, lengths: np.ndarray) -> np.ndarray:
        """Scores of all queries (rows) for documents (columns) that hold terms so often."""
        n = len(lengths)
        total = np.zeros(self.n_items * n, dtype=np.float64)  # integers below 2^53, exact
        added = self.impacts(term, count, lengths[doc])
        sizes = np.diff(self.bounds)[term]
        cost = np.cumsum(sizes)
        cuts = np.searchsorted(cost, np.arange(PAIRS_AT_ONCE, cost[-1] if len(cost) else 0, PAIRS_AT_ONCE))
        cuts = np.unique(np.concatenate([[0], cuts, [len(term)]]))
        for a, b in zip(cuts[:-1], cuts[1:]):
            item = self.items[ranges(self.bounds[term[a:b]], sizes[a:b])]
            cell = item * n + np.repeat(doc[a:b], sizes[a:b])
            np.add.at(total, cell, np.repeat(added[a:b], sizes[a:b]).astype(np.float64))
        return total.reshape(self.n_items, n).astype(np.int64)

    def bounds_of(self, bits: int, lengths: np.ndarray, slices: np.ndarray) -> np.ndarray:
        """Upper bounds on the scores of all queries (rows) for a block's documents."""
        n = len(lengths)
        held = np.zeros((len(self.terms), n), dtype=np.uint8)  # levels that a term may reach
        open_, before, level = np.arange(len(self.terms)), None, 0
        while len(open_):
            at = _positions(_entries(self.terms[open_], level), bits)
            found = np.bitwise_and.reduce(slices[at], axis=0)
            if before is not None:
                found &= before
            some = found.any(axis=1)
            open_, before = open_[some], found[some]
            held[open_] += np.unpackbits(before, axis=1, count=n)
            level += 1
        term, doc = np.nonzero(held)
        most = (np.int64(1) << held[term, doc].astype(np.int64)) - 1
        return self.scores(term, doc, np.minimum(most, lengths[doc]), lengths)


def _found(item: np.ndarray, ids: pa.Array, doc: np.ndarray, score: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(item.astype(np.int32)), ids.take(pa.array(doc)), pa.array(score)], schema=FOUND
    )


def _block_rows(batch: pa.RecordBatch):
    """(bits, ids, lengths, slices) of each row of an index batch."""
    for i in range(batch.num_rows):
        bits = batch.column("bits")[i].as_py()
        slices = np.frombuffer(batch.column("slices")[i].as_buffer(), dtype=np.uint8)
        lengths = batch.column("lengths")[i].values.to_numpy(zero_copy_only=False)
        yield bits, batch.column("ids")[i].values, lengths, slices.reshape(bits, -1)


def greatest_bounds(index: DataFrame, queries, k: int) -> DataFrame:
    """(item, doc_id, score): of each task, the k documents of greatest bound for each query.

    `queries` is a broadcast of `Queries`."""

    def search(batches):
        best: pa.Table = pa.Table.from_batches([], schema=FOUND)
        for batch in batches:
            for bits, ids, lengths, slices in _block_rows(batch):
                bound = queries.value.bounds_of(bits, lengths, slices)
                top = np.argpartition(-bound, min(k, len(lengths) - 1), axis=1)[:, :k]
                item = np.repeat(np.arange(len(top)), top.shape[1])
                doc = top.ravel()
                some = bound[item, doc] > 0
                item, doc = item[some], doc[some]
                new = pa.Table.from_batches([_found(item, ids, doc, bound[item, doc])])
                best = _first_k(pa.concat_tables([best, new]), k)
        yield from best.combine_chunks().to_batches()

    return index.select("bits", "ids", "lengths", "slices").mapInArrow(search, FOUND_SQL)


def _first_k(found: pa.Table, k: int) -> pa.Table:
    item, score = found["item"].to_numpy(), found["score"].to_numpy()
    order = np.lexsort((-score, item))
    item = item[order]
    start = np.searchsorted(item, item)
    return found.take(pa.array(order[np.arange(len(item)) - start < k]))


def reaching(index: DataFrame, queries) -> DataFrame:
    """(item, doc_id, score) of all documents whose bound reaches the query's threshold."""

    def search(batches):
        for batch in batches:
            for bits, ids, lengths, slices in _block_rows(batch):
                bound = queries.value.bounds_of(bits, lengths, slices)
                item, doc = np.nonzero(bound >= queries.value.thresholds[:, None])
                if len(item):
                    yield _found(item, ids, doc, bound[item, doc])

    return index.select("bits", "ids", "lengths", "slices").mapInArrow(search, FOUND_SQL)


def document_counts(docs: DataFrame, queries) -> DataFrame:
    """(term, df): how many documents hold each query term, counted from the texts."""

    def count(batches):
        df = np.zeros(len(queries.value.terms), dtype=np.int64)
        for batch in batches:
            for chunk in chunks(batch.column(0)):
                _, terms, _, _ = _term_counts(chunk)
                df += np.bincount(queries.value.known(terms)[1], minlength=len(df))
        held = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays(
            [pa.array(held.astype(np.int32)), pa.array(df[held])], schema=COUNTS
        )

    counted = docs.select("text").mapInArrow(count, "term int, df bigint")
    return counted.groupBy("term").agg(F.sum("df").alias("df"))


def exact_scores(docs: DataFrame, candidates: DataFrame, queries) -> DataFrame:
    """(item, doc_id, score) of candidate documents, from their whole texts; scores above 0."""

    def score(batches):
        for batch in batches:
            for chunk in chunks(batch.column(1)):
                q = queries.value
                text, terms, counts, lengths = _term_counts(chunk)
                here, term = q.known(terms)
                ids = batch.column(0).slice(chunk.first, len(chunk))
                asked = batch.column(2).slice(chunk.first, len(chunk))
                item = asked.flatten().to_numpy(zero_copy_only=False)
                doc = np.repeat(np.arange(len(chunk)), np.diff(asked.offsets.to_numpy()))
                # as many documents at once as their scores fill an array
                step = max(1, PAIRS_AT_ONCE // max(q.n_items, 1))
                for a in range(0, len(chunk), step):
                    of = (text[here] >= a) & (text[here] < a + step)
                    n = min(step, len(chunk) - a)
                    found = q.scores(
                        term[of], text[here][of] - a, counts[here][of], lengths[a : a + n]
                    )
                    mine = (doc >= a) & (doc < a + n)
                    value = found[item[mine], doc[mine] - a]
                    good = value > 0
                    yield _found(item[mine][good], ids, doc[mine][good], value[good])

    asked = candidates.groupBy("doc_id").agg(F.collect_set("item").alias("items"))
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), "text")
    joined = rows.join(asked, F.col("id").eqNullSafe(F.col("doc_id")))
    return joined.select("id", "text", "items").mapInArrow(score, FOUND_SQL)


def _best(found: DataFrame, k: int) -> DataFrame:
    by_score = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(by_score)).where(F.col("rank") <= k)


def _search_block(docs: DataFrame, index: DataFrame, texts: list, totals, k: int) -> DataFrame:
    """(item, rank, doc_id, score) for the queries of one block, written."""
    context = docs.sparkSession.sparkContext
    held = []

    def shared(q: Queries):
        held.append(context.broadcast(q))
        return held[-1]

    queries = Queries.of(texts)
    df = np.zeros(len(queries.terms), dtype=np.int64)
    for row in document_counts(docs, shared(queries)).collect():  # a row for a query term
        df[row.term] = row.df
    queries = queries.weighted(df, *totals)
    seeds = _best(greatest_bounds(index, shared(queries), k), k)
    seeds = written(seeds.select("item", "doc_id"), "search-seeds")
    worst = _best(exact_scores(docs, seeds, held[-1]), k).where(F.col("rank") == k)
    thresholds = np.ones(len(texts), dtype=np.int64)
    for row in worst.select("item", "score").collect():  # a row for a query
        thresholds[row["item"]] = row["score"]
    last = shared(replace(queries, thresholds=thresholds))
    candidates = written(reaching(index, last).select("item", "doc_id"), "search-candidates")
    result = written(_best(exact_scores(docs, candidates, last), k), "search-found")
    for q in held:
        q.destroy()
    return result


def search(
    docs: DataFrame,
    items: DataFrame,
    k: int = 50,
    item_id: str = "item_id",
    query_bytes: int = QUERY_BYTES,
) -> DataFrame:
    """(item_id, rank, doc_id, score): the best k documents of each row of `items`.

    `docs` has doc_id and text, `items` the id column and text."""
    spark = docs.sparkSession
    index = written(build_index(docs), "search-index")
    n_docs, n_terms = index.agg(F.sum("n_docs"), F.sum("n_terms")).first()
    id_type = items.schema[item_id].dataType
    schema = T.StructType(
        [
            T.StructField(item_id, id_type),
            *(T.StructField(n, t) for n, t in [
                ("rank", T.IntegerType()), ("doc_id", T.LongType()), ("score", T.LongType())
            ]),
        ]
    )
    found = spark.createDataFrame([], schema)
    if not n_terms:
        return found
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_blocks = 1 + size // query_bytes
    numbered = items.select(F.col(item_id).alias("id"), "text").withColumn(
        "block", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(n_blocks))
    )
    numbered = written(numbered, "search-items")
    for block in range(n_blocks):
        rows = numbered.where(F.col("block") == block).collect()  # query_bytes of text
        if not rows:
            continue
        best = _search_block(docs, index, [r.text for r in rows], (n_docs, n_terms), k)
        names = spark.createDataFrame(
            [(i, r.id) for i, r in enumerate(rows)],
            T.StructType([T.StructField("item", T.IntegerType()), T.StructField(item_id, id_type)]),
        )
        found = found.unionByName(
            best.join(names, "item").select(item_id, "rank", "doc_id", "score")
        )
    return found
