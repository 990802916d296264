"""N-gram Jaccard self-join with a token-group matrix.

Equal shingle sets become one class first. Similar classes are then partitioned into
groups, and for a query set only those groups are opened whose token union can hold enough
of it: a member x with J(q, x) >= t shares at least t * |q| tokens with q, so the union
of its group does too. In opened groups overlaps are counted exactly.

Which groups a set can meet is found by segment keys. The token space is cut, by a hash,
into k segments; two sets with J >= t differ in few tokens, so some segments are equal
in both, and a key of a segment's content is shared. k and the number of repeated cuts
are set for each size octave, by the distribution of the segments that differing tokens
touch, so that a pair at the threshold has no common key with a probability below 2^-60, no
more than two 64-bit hashes that collide. A set's group is its least key that any other set
shares. Sets without a shared key have no partner at all.

Links inside groups come first; groups over MAX_GROUP sets are cut into parts that all
hold one pivot, the group's first set. Then the matrix of keys and sets tells where different
components still meet: the sets that such keys connect are opened as one group, and those
outside its largest component are its queries. Sets that are connected already are not
compared again, so a group of near copies costs about one comparison each, and no list of
pairs is built.

Null and empty texts have an empty set and are linked with nothing; a null doc_id has a
null component. Fewer words than a shingle make one shingle. Rows are nodes by their
doc_id; rows that share one are one node. An empty table gives no rows.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bloom
from .components import components
from .exchange import KEY_ROWS_SQL, Deal, repeated_keys, send_keys, unpack_keys
from .session import fresh_name, written
from .text import Chunk, chunks, mix, ranges, window_hashes

MAX_GROUP = 512
MAX_FAMILY = 2_048
BIN_BYTES = 16 << 20
KEY_BYTES = 64 << 20
LOST = 2.0**-60
EXACT_OCTAVE = 10


@dataclass(frozen=True)
class Similarity:
    """Sets of distinct word n-grams; links where 100 * shared >= percent * union."""

    ngram: int = 4
    percent: int = 85

    def linked(self, shared: np.ndarray, a: np.ndarray | int, b: np.ndarray | int) -> np.ndarray:
        return 100 * shared >= self.percent * (a + b - shared)

    def least_shared(self, size: int) -> int:
        """Of a set's tokens, how many any linked set has."""
        return -(-self.percent * size // 100)


def shingles(chunk: Chunk, ngram: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, and the texts' bounds."""
    lowered = chunk.lower()
    words = lowered.words()
    hashes = lowered.hashes(words)
    short = np.flatnonzero((words.counts > 0) & (words.counts < ngram))
    whole = words.windows(ngram)
    starts = np.concatenate([whole, words.bounds[short]])
    lengths = np.concatenate([np.full(len(whole), ngram), words.counts[short]])
    keys = window_hashes(hashes, starts, lengths)
    text = words.text_of[starts]
    order = np.lexsort((keys, text))
    keys, text = keys[order], text[order]
    new = np.ones(len(keys), dtype=bool)
    new[1:] = (keys[1:] != keys[:-1]) | (text[1:] != text[:-1])
    keys, text = keys[new], text[new]
    return keys, np.searchsorted(text, np.arange(len(chunk) + 1))


def closest_pairs(octave: int, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """(shared, differing) tokens of the pairs at the threshold whose larger set has 2^octave ..
    2^(octave + 1) - 1 tokens, nested ones included: any union of n tokens with the least share
    in common. Of those with equally many differing tokens, the one that shares fewest."""
    largest = 200 * ((2 << octave) - 1) // (100 + percent)
    unions = np.arange(1 << octave, largest + 1)
    shared = -(-percent * unions // 100)
    differing, first = np.unique(unions - shared, return_index=True)
    return shared[first][differing > 0], differing[differing > 0]


def lost(shared: np.ndarray, differing: np.ndarray, segments: int, exact: bool = True) -> float:
    """The greatest chance, over these pairs (differing ascending), that all shared tokens lie
    in segments that a differing one touches: E[(touched / segments) ^ shared].

    Exact by the distribution of the touched segments, token after token. Else a bound: with
    Poisson numbers of tokens segments are independent, and as the chance grows with the
    differing tokens and falls with the shared ones, it is 2 * 2 times that at most."""
    if not exact:
        met = np.exp(-differing / segments) * -np.expm1(-shared / segments)
        return float(4 * np.exp(segments * np.log1p(-met)).max(initial=0.0))
    touched = np.arange(segments + 1)
    hit, miss = touched / segments, 1 - touched[:-1] / segments
    with np.errstate(divide="ignore"):
        log_hit = np.log(hit)
    chance = (touched == 0).astype(float)
    worst, tokens = 0.0, 0
    for s, d in zip(shared, differing):
        for tokens in range(tokens + 1, d + 1):
            stays = chance * hit
            stays[1:] += chance[:-1] * miss
            chance = stays
        worst = max(worst, float((chance * np.exp(s * log_hit)).sum()))
    return worst


@lru_cache(maxsize=128)
def scheme(octave: int, percent: int) -> tuple[int, int]:
    """(segments, repetitions) for pairs whose larger set has 2^octave .. 2^(octave + 1) tokens."""
    shared, differing = closest_pairs(octave, percent)
    best = None
    for segments in sorted({int(2 * 1.05**i) for i in range(14 * (octave + 3))}):
        worst = lost(shared, differing, segments, octave <= EXACT_OCTAVE)
        if worst >= 1:
            continue
        times = math.ceil(math.log(LOST) / math.log(worst)) if worst > 0 else 1
        if best is None or segments * times < best[0]:
            best = (segments * times, segments, times)
        if times == 1:
            break  # more segments are more keys
    return best[1], best[2]


def segment_keys(
    tokens: np.ndarray, bounds: np.ndarray, percent: int
) -> tuple[np.ndarray, np.ndarray]:
    """(key, set it belongs to). Sets that can only be linked to equal ones have none."""
    sizes = np.diff(bounds)
    octaves = np.floor(np.log2(np.maximum(sizes, 1))).astype(int)
    # A set whose larger partner may be of the next octave has the keys of that as well.
    reaching = sizes * 100 >= percent * (2 << octaves)
    can_differ = sizes * 100 // percent > sizes
    keys, owners = [np.zeros(0, dtype=np.uint64)], [np.zeros(0, dtype=np.int64)]
    for up in (0, 1):
        for octave in np.unique(octaves[can_differ]):
            chosen = np.flatnonzero(
                can_differ & (octaves == octave) & (reaching if up else sizes > 0)
            )
            if not len(chosen):
                continue
            segments, times = scheme(int(octave) + up, percent)
            at = ranges(bounds[chosen], sizes[chosen])
            owner = np.repeat(np.arange(len(chosen)), sizes[chosen])
            for time in range(times):
                seed = np.uint64(((int(octave) + up) * 64 + time + 1) * 0x9E3779B97F4A7C15 % 2**64)
                mixed = mix(tokens[at] ^ seed)
                segment = ((mixed >> np.uint64(32)) * np.uint64(segments)) >> np.uint64(32)
                cell = owner * segments + segment.astype(np.int64)
                sums = np.zeros(len(chosen) * segments, dtype=np.uint64)
                np.add.at(sums, cell, mix(mixed))
                filled = np.flatnonzero(sums)
                place = (filled % segments).astype(np.uint64) + seed
                keys.append(mix(sums[filled] ^ mix(place)))
                owners.append(chosen[filled // segments])
    return np.concatenate(keys), np.concatenate(owners)


def _packed_rows(keys: np.ndarray, bounds: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(
        pa.binary(),
        len(bounds) - 1,
        [None, pa.py_buffer((bounds * 8).astype(np.int32)), pa.py_buffer(keys.tobytes())],
    )


SETS_SQL = "doc_id long, n long, d1 long, d2 long, keys binary"
SETS = pa.schema(
    [("doc_id", pa.int64()), ("n", pa.int64()), ("d1", pa.int64()), ("d2", pa.int64()),
     ("keys", pa.binary())]
)


def _digests(tokens: np.ndarray, bounds: np.ndarray) -> list[np.ndarray]:
    """Two sums of hashes that equal sets share."""
    out = []
    for seed in (0xA5A5A5A5A5A5A5A5, 0x5851F42D4C957F2D):
        sums = np.concatenate([[np.uint64(0)], np.cumsum(mix(tokens ^ np.uint64(seed)))])
        out.append((sums[bounds[1:]] - sums[bounds[:-1]]).view(np.int64))
    return out


def describe(docs: DataFrame, how: Similarity) -> DataFrame:
    """(doc_id, n, d1, d2, keys): size, digests and packed segment keys of each set."""

    def sets(batches):
        for batch in batches:
            ids = batch.column(0)
            for chunk in chunks(batch.column(1)):
                tokens, bounds = shingles(chunk, how.ngram)
                keys, owner = segment_keys(tokens, bounds, how.percent)
                order = np.argsort(owner, kind="stable")
                of = np.searchsorted(owner[order], np.arange(len(chunk) + 1))
                d1, d2 = _digests(tokens, bounds)
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.slice(chunk.first, len(chunk)),
                        pa.array(np.diff(bounds)),
                        pa.array(d1),
                        pa.array(d2),
                        _packed_rows(keys[order], of),
                    ],
                    schema=SETS,
                )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(sets, SETS_SQL)


def _shared_keys(reps: DataFrame, deal: Deal) -> DataFrame:
    """(rep, n, d1, d2, gid, keys): the classes that share a key, and all such keys."""
    grouped = reps.select(deal.group("rep").alias("grp"), "rep", "n", "d1", "d2", "keys")

    def send(batches):
        def keys_of(batch):
            keys, counts = unpack_keys(batch.column(1))
            yield keys, np.repeat(batch.column(0).to_numpy(), counts), keys >> np.uint64(17)

        yield from send_keys(deal, batches, keys_of)

    repeated = repeated_keys(deal, grouped.select("grp", "keys").mapInArrow(send, KEY_ROWS_SQL))
    schema = pa.schema(
        [("rep", pa.int64()), ("n", pa.int64()), ("d1", pa.int64()), ("d2", pa.int64()),
         ("gid", pa.int64()), ("keys", pa.list_(pa.int64()))]
    )

    def keep(left, right):
        known = np.unique(unpack_keys(right["keys"])[0])
        if not len(known) or not len(left):
            return schema.empty_table()
        keys, counts = unpack_keys(left["keys"])
        at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
        hit = known[at] == keys
        row = np.repeat(np.arange(len(left)), counts)[hit]
        keys = keys[hit].view(np.int64)
        order = np.lexsort((keys, row))
        row, keys = row[order], keys[order]
        rows, first = np.unique(row, return_index=True)
        columns = [left[c].take(pa.array(rows)).combine_chunks() for c in ("rep", "n", "d1", "d2")]
        bounds = pa.array(np.append(first, len(keys)).astype(np.int32))
        lists = pa.ListArray.from_arrays(bounds, pa.array(keys))
        return pa.Table.from_arrays([*columns, pa.array(keys[first]), lists], schema=schema)

    return (
        grouped.groupBy("grp")
        .cogroup(repeated.groupBy("grp"))
        .applyInArrow(keep, "rep long, n long, d1 long, d2 long, gid long, keys array<long>")
    )


class Group:
    """Sets of one group: postings from token to members, and the token union."""

    def __init__(self, sets: list[np.ndarray]):
        self.sizes = np.array([len(s) for s in sets])
        self.union, place = np.unique(np.concatenate(sets), return_inverse=True)
        members = np.repeat(np.arange(len(sets)), self.sizes)
        order = np.argsort(place, kind="stable")
        self.members = members[order]
        self.bounds = np.searchsorted(place[order], np.arange(len(self.union) + 1))

    def in_union(self, tokens: np.ndarray) -> np.ndarray:
        """The places in the token union of those tokens that it holds."""
        at = np.minimum(np.searchsorted(self.union, tokens), len(self.union) - 1)
        return at[self.union[at] == tokens]

    def shared(self, places: np.ndarray) -> np.ndarray:
        """How many of these tokens each member has."""
        counts = self.bounds[places + 1] - self.bounds[places]
        return np.bincount(
            self.members[ranges(self.bounds[places], counts)], minlength=len(self.sizes)
        )


def _overlap(a: np.ndarray, b: np.ndarray) -> int:
    at = np.minimum(np.searchsorted(b, a), len(b) - 1)
    return int((b[at] == a).sum())


def links_inside(ids: np.ndarray, sets: list[np.ndarray], how: Similarity) -> list[tuple]:
    """Links of every set to the least id of its component within one group."""
    parent = list(range(len(ids)))

    def root(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    group, parts = None, 0
    newest = -1  # the last set that was linked to another
    for i, tokens in enumerate(sets):
        parts += 1
        if newest >= 0 and how.linked(_overlap(tokens, sets[newest]), len(tokens), len(sets[newest])):
            parent[i] = root(newest)
            parts -= 1
            newest = i
            if parts == 1:
                continue
        if i == 0:
            continue
        if len(sets) <= 8:
            near = [
                j for j in range(i)
                if how.linked(_overlap(tokens, sets[j]), len(tokens), len(sets[j]))
            ]
        else:
            group = group or Group(sets)
            shared = group.shared(group.in_union(tokens))
            near = np.flatnonzero(how.linked(shared, group.sizes, len(tokens)))
            near = near[near < i]
        for j in near:
            if root(int(j)) != root(i):
                parent[root(i)] = root(int(j))
                parts -= 1
                newest = i
    roots = np.array([root(i) for i in range(len(ids))])
    least = np.full(len(ids), np.iinfo(np.int64).max)
    np.minimum.at(least, roots, ids)
    return [(i, j) for i, j in zip(ids, least[roots]) if i != j]


def links_across(
    ids: np.ndarray, components: np.ndarray, sets: list[np.ndarray], queries: list[tuple],
    how: Similarity,
) -> list[tuple]:
    """Links of query sets with the members of a group, one for each component that is not
    the query's own. The bound on the overlap decides if the group is opened."""
    group, links = Group(sets), []
    for query, component, tokens in queries:
        places = group.in_union(tokens)
        if len(places) < how.least_shared(len(tokens)):
            continue
        near = np.flatnonzero(how.linked(group.shared(places), group.sizes, len(tokens)))
        near = near[components[near] != component]
        _, first = np.unique(components[near], return_index=True)
        links.extend((query, ids[j]) for j in near[first])
    return links


def links_between(
    ids: np.ndarray, components: np.ndarray, sets: list[np.ndarray], how: Similarity
) -> list[tuple]:
    """Links between the components of one group: the sets outside the largest component
    are compared with all others."""
    names, of, counts = np.unique(components, return_inverse=True, return_counts=True)
    asking = np.flatnonzero(of != counts.argmax())
    queries = [(ids[i], components[i], sets[i]) for i in asking]
    return links_across(ids, components, sets, queries, how) if len(names) > 1 else []


LINKS = pa.schema([("u", pa.int64()), ("v", pa.int64())])
LINKS_SQL = "u long, v long"


def _compared(rows: DataFrame, how: Similarity) -> DataFrame:
    """Links (u, v) from the groups of stored rows (gid, part, rep, component, query, set), a
    bin of groups at a time. Queries are compared with the group's members; without
    queries, the group's components with each other; without components (all null), all
    sets."""
    weight = rows.agg(F.sum(F.octet_length("set"))).first()[0] or 0
    bins = 1 + weight // BIN_BYTES

    def compare(table: pa.Table) -> pa.Table:
        gid, part, rep = (table[c].to_numpy() for c in ("gid", "part", "rep"))
        component = table["component"].to_numpy()
        known = table["component"].null_count == 0
        query = table["query"].to_numpy(zero_copy_only=False)
        tokens, counts = unpack_keys(table["set"])
        starts = np.cumsum(counts) - counts
        order = np.lexsort((rep, counts, query, part, gid))
        cuts = np.flatnonzero(np.diff(gid[order]) | np.diff(part[order])) + 1
        links: list[tuple] = []
        for group in np.split(order, cuts):
            members, asking = group[~query[group]], group[query[group]]
            sets = [tokens[starts[i] : starts[i] + counts[i]] for i in members]
            if len(asking) and len(members):
                wanted = [
                    (rep[i], component[i], tokens[starts[i] : starts[i] + counts[i]])
                    for i in asking
                ]
                links.extend(links_across(rep[members], component[members], sets, wanted, how))
            elif len(members) > 1 and known:
                links.extend(links_between(rep[members], component[members], sets, how))
            elif len(members) > 1:
                links.extend(links_inside(rep[members], sets, how))
        columns = list(zip(*links)) or [(), ()]
        return pa.Table.from_arrays([pa.array(c, pa.int64()) for c in columns], schema=LINKS)

    binned = rows.withColumn("bin", F.pmod(F.xxhash64("gid", "part"), F.lit(bins)))
    return binned.groupBy("bin").applyInArrow(compare, LINKS_SQL)


BIN_COLUMNS = ["bin", "rep", "component", "gids", "set"]


def _compared_by_key(rows: DataFrame, how: Similarity) -> DataFrame:
    """Links (u, v) between the components that meet in each group of a bin's rows (bin, rep,
    component, gids, set)."""

    def compare(table: pa.Table) -> pa.Table:
        rep, component = table["rep"].to_numpy(), table["component"].to_numpy()
        tokens, counts = unpack_keys(table["set"])
        starts = np.cumsum(counts) - counts
        gids = table["gids"].combine_chunks()
        row = np.repeat(np.arange(len(table)), gids.value_lengths().to_numpy())
        gid = gids.flatten().to_numpy()
        order = np.lexsort((rep[row], counts[row], gid))
        cuts = np.flatnonzero(np.diff(gid[order])) + 1
        links: set[tuple] = set()
        for group in np.split(row[order], cuts):
            found = [tokens[starts[i] : starts[i] + counts[i]] for i in group]
            links.update(links_between(rep[group], component[group], found, how))
        columns = list(zip(*sorted(links))) or [(), ()]
        return pa.Table.from_arrays([pa.array(c, pa.int64()) for c in columns], schema=LINKS)

    return rows.groupBy("bin").applyInArrow(compare, LINKS_SQL)


def _candidate_sets(docs: DataFrame, shared: DataFrame, how: Similarity) -> DataFrame:
    """(rep, gid, cut, pivot, set): the whole token sets of the classes that share a key. What is
    known of their groups is joined before the sets are made, so that these move less."""
    kept = ["rep", "gid", "cut", "pivot"]

    def tokens(batches):
        for batch in batches:
            for chunk in chunks(batch.column("text")):
                found, bounds = shingles(chunk, how.ngram)
                same = np.ones(len(chunk), dtype=bool)
                for digest, name in zip(_digests(found, bounds), ("d1", "d2")):
                    want = batch.column(name).to_numpy()[chunk.first : chunk.first + len(chunk)]
                    same &= digest == want
                rows = batch.slice(chunk.first, len(chunk)).select(kept)
                whole = pa.RecordBatch.from_arrays(
                    [*rows.columns, _packed_rows(found, bounds)], names=[*kept, "set"]
                )
                yield whole.filter(pa.array(same))

    sizes = shared.groupBy("gid").agg(F.count("*").alias("members"), F.min("rep").alias("pivot"))
    cut = F.ceil(F.col("members") / MAX_GROUP).alias("cut")
    wanted = shared.select("rep", "gid", "d1", "d2").join(sizes, "gid")
    wanted = wanted.select("rep", "gid", cut, "pivot", "d1", "d2")
    candidate = bloom.among(shared.select("rep"))  # spares the other texts the shuffle
    texts = docs.select(F.col("doc_id").cast("long").alias("rep"), "text")
    texts = texts.where(candidate(F.col("rep")))
    return texts.join(wanted, "rep").mapInArrow(
        tokens, "rep long, gid long, cut long, pivot long, set binary"
    )


def link(docs: DataFrame, how: Similarity = Similarity()) -> tuple[DataFrame, DataFrame]:
    """(rows, links). rows: doc_id, n_shingles, rep, one for each row of `docs`, where rep is
    the least doc_id with an equal set. links: (u, v) between reps, enough to connect every
    component."""
    described = written(describe(docs, how), "sets")
    classes = ["n", "d1", "d2"]
    full = described.where("n > 0 AND doc_id IS NOT NULL")
    reps = written(
        full.groupBy(*classes)
        .agg(F.min(F.struct("doc_id", "keys")).alias("first"))
        .select(*classes, F.col("first.doc_id").alias("rep"), "first.keys"),
        "set-classes",
    )
    ids = reps.select(*(F.col(c).alias(f"_{c}") for c in classes), "rep")
    same = [described[c] == ids[f"_{c}"] for c in classes]
    rows = described.join(ids, same, "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("rep", "doc_id").alias("rep")
    )
    # Rows that share a doc_id, but not their sets, are one node.
    same_id = rows.where("doc_id <> rep").select(F.col("doc_id").alias("u"), F.col("rep").alias("v"))

    size = reps.agg(F.sum(F.octet_length("keys"))).first()[0] or 0
    parts = 1 + size // (4 << 20)
    shared = written(_shared_keys(reps, Deal(parts, parts)), "shared-keys")
    sets = written(_candidate_sets(docs, shared, how), "token-sets")
    columns = ["gid", "part", "rep", "component", "query", "set"]
    part = F.pmod(F.xxhash64("rep"), F.col("cut")).cast("int")
    member = sets.withColumns(
        {"part": part, "component": F.lit(None).cast("long"), "query": F.lit(False)}
    )
    pivots = (
        member.where("rep = pivot AND cut > 1")
        .withColumnRenamed("part", "own")
        .withColumn("part", _every_part())
        .where("part <> own")
    )
    inside = member.select(*columns).unionByName(pivots.select(*columns))
    # A pivot is its group's least set, so a component has one name in all parts that it is in.
    links = written(_compared(inside, how), "links-inside")
    named = links.select(F.col("u").alias("rep"), F.col("v").alias("component"))
    by_bin, blocks = _meetings(shared, sets, named, columns)
    across = _compared_by_key(by_bin, how)
    if blocks is not None:
        across = across.unionByName(_compared(written(blocks, "blocks"), how))
    return rows, written(links.unionByName(across).unionByName(same_id), "links")


def _every_part():
    return F.explode(F.sequence(F.lit(0), (F.col("cut") - 1).cast("int")))


def _meetings(
    shared: DataFrame, sets: DataFrame, named: DataFrame, columns: list[str]
) -> tuple[DataFrame, DataFrame | None]:
    """Sets to compare where different components still meet at a key, by bin and in blocks,
    if there are any.

    Sets connected by such keys are a family. One of up to MAX_FAMILY sets and KEY_BYTES is one
    group. In a larger one each key's sets are a group, and its keys are dealt to bins, to each
    of which a set moves once with all its keys there. A key with more than KEY_BYTES of sets is
    dealt in blocks: parts of its sets, each with parts of those outside its largest component."""
    by_key = shared.select("rep", "n", F.explode("keys").alias("gid")).join(named, "rep", "left")
    by_key = written(by_key.withColumn("component", F.coalesce("component", "rep")), "matrix")
    meeting = (
        by_key.groupBy("gid", "component")
        .agg(
            F.count("*").alias("n"),
            F.sum(8 * F.col("n")).alias("bytes"),
            F.min("rep").alias("least"),
            F.sum(F.xxhash64("rep").cast("decimal(20,0)")).alias("reps"),
        )
        .groupBy("gid")
        .agg(
            F.count("*").alias("components"),
            F.sum("n").alias("members"),
            F.sum("reps").alias("reps"),
            F.min("least").alias("least"),
            F.sum("bytes").alias("bytes"),
            F.max(F.struct("bytes", "component")).alias("largest"),
        )
        .where("components > 1")
        # keys of the same sets are one group
        .groupBy("members", "reps", "least")
        .agg(F.min(F.struct("gid", "largest", "bytes")).alias("first"))
        .select("first.*", "least")
    )
    open_ = written(by_key.join(meeting, "gid"), "meeting-keys")
    families = components(open_.select(F.col("rep").alias("u"), F.col("least").alias("v")))
    families = families.select(F.col("node").alias("rep"), F.col("component").alias("family"))
    reps = open_.select("rep", "component", (8 * F.col("n")).alias("size")).distinct()
    reps = reps.join(families, "rep")
    size = reps.groupBy("family").agg(F.count("*").alias("sets"), F.sum("size").alias("total"))
    sized = written(reps.join(size, "family"), "families")
    small = (F.col("sets") <= MAX_FAMILY) & (F.col("total") <= KEY_BYTES)
    some = 1 + (sized.where(small).agg(F.sum("size")).first()[0] or 0) // BIN_BYTES
    whole = sized.where(small).select(
        F.pmod(F.xxhash64("family"), F.lit(some)).alias("bin"), "rep", "component",
        F.array("family").alias("gids"),
    )
    large = sized.where(~small).select("rep", "family")
    keyed = written(open_.join(large, "rep"), "large-families")
    plain = keyed.where(F.col("bytes") <= KEY_BYTES)
    bins = plain.groupBy("family").agg(F.ceil(F.sum(8 * F.col("n")) / KEY_BYTES).alias("bins"))
    dealt = (
        plain.join(bins, "family")
        .withColumn("bin", F.xxhash64("family", F.pmod(F.xxhash64("gid"), F.col("bins"))))
        .groupBy("bin", "rep", "component")
        .agg(F.collect_list("gid").alias("gids"))
    )
    held = sets.select("rep", "set")
    by_bin = dealt.unionByName(whole).join(held, "rep").select(*BIN_COLUMNS)
    huge = keyed.where(F.col("bytes") > KEY_BYTES)
    if huge.isEmpty():
        return by_bin, None  # all sets would be shuffled to meet no row
    return by_bin, _blocks(huge).join(held, "rep").select(*columns)


def _blocks(keyed: DataFrame) -> DataFrame:
    """Sets of keys too large for one task, as blocks: a part of the members, and a part of the
    sets that ask, those outside the largest component. Each task has 2 * KEY_BYTES at most."""
    asking = F.col("bytes") - F.col("largest.bytes")
    rows = keyed.withColumns(
        {
            "parts": F.ceil(F.col("bytes") / KEY_BYTES).cast("int"),
            "asks": F.ceil(asking / KEY_BYTES).cast("int"),
        }
    )
    of = F.xxhash64("rep")
    member = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("asks") - 1)))
    member = member.withColumn("part", F.pmod(of, "parts") * F.col("asks") + F.col("other"))
    query = rows.where(F.col("component") != F.col("largest.component"))
    query = query.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    query = query.withColumn("part", F.col("other") * F.col("asks") + F.pmod(of, "asks"))
    blocks = member.withColumn("query", F.lit(False)).unionByName(
        query.withColumn("query", F.lit(True))
    )
    return blocks.select("gid", F.col("part").cast("int"), "rep", "component", "query")


def near_duplicates(docs: DataFrame, how: Similarity = Similarity()) -> DataFrame:
    """doc_id, n_shingles, component_id for each row."""
    rows, links = link(docs, how)
    named = components(links).select(F.col("node").alias("rep"), F.col("component"))
    return rows.join(named, "rep", "left").select(
        "doc_id", "n_shingles", F.coalesce("component", "rep").alias("component_id")
    )


def _nodes(docs: DataFrame, node: str) -> DataFrame:
    """`docs` with a number of its own for each row: its doc_id, but one above all ids for rows
    without one, and for all rows but one of a repeated doc_id."""
    of, at = fresh_name(docs, "of"), fresh_name(docs, "at")
    doc_id = F.col("doc_id").cast("long")
    ids = docs.select(doc_id.alias(of)).groupBy(of).agg(F.count("*").alias("n"))
    odd = written(ids.where(f"n > 1 OR `{of}` IS NULL").select(of), "odd-ids")
    if odd.isEmpty():
        return docs.withColumn(node, doc_id)
    maybe = bloom.among(odd.where(F.col(of).isNotNull()))(doc_id) | doc_id.isNull()
    maybe = F.coalesce(maybe, F.lit(True))
    same = doc_id.eqNullSafe(odd[of])
    plain = docs.where(~maybe).unionByName(docs.where(maybe).join(odd, same, "left_anti"))
    rows = docs.where(maybe).join(odd, same, "left_semi")
    rows = written(rows.withColumn(at, F.monotonically_increasing_id()), "odd-rows")
    first = rows.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias(of))
    first = first.agg(F.min(at).alias(node)).select(node)
    greatest = docs.agg(F.max(doc_id)).first()[0] or 0
    numbered = rows.join(first, rows[at] == first[node], "left").withColumn(
        node, F.when(F.col(node).isNotNull(), doc_id).otherwise(F.lit(greatest) + 1 + F.col(at))
    )
    return plain.withColumn(node, doc_id).unionByName(numbered.drop(at))


def one_of_each(docs: DataFrame, how: Similarity = Similarity()) -> DataFrame:
    """One document of each component, the one with the least doc_id; all columns as they
    were. Documents without words stay. Each row is a document: those without a doc_id, and
    all but one of a repeated doc_id, come after all others."""
    node = fresh_name(docs, "node")
    docs = _nodes(docs, node)
    found = near_duplicates(docs.select(F.col(node).alias("doc_id"), "text"), how)
    name = fresh_name(docs, "copy")
    copies = found.where("doc_id <> component_id").select(F.col("doc_id").alias(name))
    copies = written(copies.distinct(), "copies")
    maybe = bloom.among(copies)(F.col(node))  # the others need no comparison
    checked = docs.where(maybe).join(copies, docs[node] == copies[name], "left_anti")
    return docs.where(~maybe).unionByName(checked).drop(node)
