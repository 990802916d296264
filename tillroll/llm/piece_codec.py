"""SentencePiece encoding and decoding by vectorised merge rounds.

`encode` and `decode` turn a column of texts into a column of id lists and back, as the
sentencepiece library does with a byte-pair model that splits unknown characters into bytes.

A text is a line of symbols, at first its characters with a space (U+2581 in the vocabulary)
before all. As long as two neighbours form a piece, the pair of the best score is merged, the
leftmost of equals first. No piece of the model has a space after another character, so a
text falls into words, each with the spaces before it, that are merged apart from each other.
The words of a chunk of texts lie in flat numpy arrays, every different word once (told apart
by 128 bits of hash). In a round every word finds the least rank among its pairs (a segmented
minimum), all pairs of that rank merge from the left, overlapping ones in turn, and words
without a pair leave the arrays. Where a piece may be part of another one of a rank no worse
(such as runs of spaces, which share one), only the leftmost pair merges in that round, for
the next best pair may hold the merged symbol.

A word of more than `ROUND_SYMBOLS` symbols would need a round for each of its merges, each
over the whole word. It takes its merges from a queue by (rank, place) instead, which is the
same order at a cost of n log n.

A null or empty text has no pieces: begin and end ids alone. Texts are never cut; a task needs
some 150 bytes for each byte of a chunk, and a text of more than a chunk is one. Repeated rows
get equal results; other columns are not looked at; an empty table gives an empty table.
"""

from __future__ import annotations

import codecs
from dataclasses import dataclass
from functools import lru_cache
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import _BYTE_STEP, _BYTE_VALUES, Chunk, chunks, ranges, span_hashes

SPACE = "▁"
ROUND_SYMBOLS = 64
SYMBOL_BITS = 21  # a symbol is a piece id, or the number of pieces plus a code point
NO_RANK = np.iinfo(np.int32).max
REMEMBERED_WORDS, REMEMBERED_IDS = 200_000, 2_000_000

# Kinds of pieces in the model file.
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6


class PairTable:
    """Merged symbol of a pair of symbols, in an open hash table probed by whole arrays."""

    def __init__(self, pairs: dict[int, int]):
        keys = np.fromiter(pairs.keys(), dtype=np.uint64, count=len(pairs))
        merged = np.fromiter(pairs.values(), dtype=np.int32, count=len(pairs))
        bits = max(4, (8 * len(pairs)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys = np.zeros(1 << bits, dtype=np.uint64)  # 0, the unknown piece twice, is free
        self.merged = np.full(1 << bits, -1, dtype=np.int32)
        at = self._slot(keys)
        while len(keys):
            free = self.keys[at] == 0
            first = np.zeros(len(keys), dtype=bool)
            first[np.unique(at, return_index=True)[1]] = True
            put = free & first
            self.keys[at[put]], self.merged[at[put]] = keys[put], merged[put]
            keys, merged, at = keys[~put], merged[~put], (at[~put] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The merged symbol, or -1."""
        keys = (left.astype(np.uint64) << np.uint64(SYMBOL_BITS)) | right.astype(np.uint64)
        at = self._slot(keys)
        held = self.keys[at]
        found = np.where(held == keys, self.merged[at], -1)
        open_ = np.flatnonzero((held != keys) & (held != 0))
        while len(open_):
            at[open_] = (at[open_] + 1) & self.mask
            held = self.keys[at[open_]]
            hit = held == keys[open_]
            found[open_[hit]] = self.merged[at[open_[hit]]]
            open_ = open_[~hit & (held != 0)]
        return found


@dataclass
class Lists:
    """Lists of integers, one after the other."""

    values: np.ndarray
    offsets: np.ndarray

    def take(self, which: np.ndarray) -> Lists:
        sizes = np.diff(self.offsets)[which]
        values = self.values[ranges(self.offsets[which], sizes)]
        return Lists(values, np.concatenate([[0], np.cumsum(sizes)]))

    def then(self, other: Lists) -> Lists:
        return Lists(
            np.concatenate([self.values, other.values]),
            np.concatenate([self.offsets, self.offsets[-1] + other.offsets[1:]]),
        )


class PieceCodec:
    """A sentencepiece model file of the kind this module encodes as; others are refused."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2 as model_file

        model = model_file.ModelProto()
        with open(path, "rb") as file:
            model.ParseFromString(file.read())
        self._refuse_others(model)
        self.size = len(model.pieces)
        kinds = np.array([p.type for p in model.pieces])
        self.kinds = kinds
        self.begin, self.end = model.trainer_spec.bos_id, model.trainer_spec.eos_id
        self.byte_ids = np.zeros(256, dtype=np.int32)
        for i in np.flatnonzero(kinds == BYTE):
            self.byte_ids[int(model.pieces[i].piece[3:5], 16)] = i
        self._merges(model)
        self._surfaces(model)
        self._forget()

    @staticmethod
    def _refuse_others(model) -> None:
        spec, how = model.trainer_spec, model.normalizer_spec
        kinds = {p.type for p in model.pieces}
        inner = any(
            a != SPACE and b == SPACE for p in model.pieces for a, b in zip(p.piece, p.piece[1:])
        )
        if (
            spec.model_type != spec.BPE
            or not spec.byte_fallback
            or spec.treat_whitespace_as_suffix
            or how.precompiled_charsmap
            or not how.add_dummy_prefix
            or how.remove_extra_whitespaces
            or not how.escape_whitespaces
            or len(model.denormalizer_spec.precompiled_charsmap)
            or not kinds <= {NORMAL, UNKNOWN, CONTROL, BYTE}
            or sum(p.type == BYTE for p in model.pieces) != 256
            or inner
        ):
            raise ValueError("not a byte-pair model with byte fallback and plain normalization")

    def _merges(self, model) -> None:
        """Symbols of characters, ranks of pieces, and the pairs that form them."""
        pieces = {p.piece: i for i, p in enumerate(model.pieces) if p.type == NORMAL}
        scores = np.array([p.score for p in model.pieces])
        order = {s: r for r, s in enumerate(sorted({scores[i] for i in pieces.values()}, reverse=True))}
        self.ranks = np.full(self.size + 1, NO_RANK, dtype=np.int32)  # the last is for "no piece"
        for i in pieces.values():
            self.ranks[i] = order[scores[i]]
        self.of_char = np.arange(0x110000, dtype=np.int32) + self.size
        for piece, i in pieces.items():
            if len(piece) == 1:
                self.of_char[ord(piece)] = i

        def symbol(part: str) -> int | None:
            return pieces.get(part, self.size + ord(part) if len(part) == 1 else None)

        pairs: dict[int, int] = {}
        self.grows = np.zeros(self.size + 1, dtype=bool)  # into a piece of a rank no worse
        for piece, i in pieces.items():
            for cut in range(1, len(piece)):
                left, right = symbol(piece[:cut]), symbol(piece[cut:])
                if left is not None and right is not None:
                    pairs[left << SYMBOL_BITS | right] = i
                for part in (left, right):
                    if part is not None and part < self.size and self.ranks[part] >= self.ranks[i]:
                        self.grows[part] = True
        self.pairs = PairTable(pairs)
        self.pair_of = pairs

    def _surfaces(self, model) -> None:
        """The bytes that each id stands for."""
        out = []
        for p in model.pieces:
            if p.type == NORMAL:
                out.append(p.piece.replace(SPACE, " ").encode())
            elif p.type == BYTE:
                out.append(bytes([int(p.piece[3:5], 16)]))
            else:
                out.append(b"" if p.type == CONTROL else model.trainer_spec.unk_surface.encode())
        data = np.frombuffer(b"".join(out), dtype=np.uint8)
        self.surfaces = Lists(data, np.concatenate([[0], np.cumsum([len(s) for s in out])]))
        self.spaced = np.array([p.type == NORMAL and p.piece.startswith(SPACE) for p in model.pieces])

    # Encoding

    def _rounds(self, symbols: np.ndarray, bounds: np.ndarray) -> Lists:
        """Symbols of words after all merges. Word w is symbols[bounds[w]:bounds[w + 1]]."""
        n_words = len(bounds) - 1
        done_symbols, done_words = [], []
        words = np.arange(n_words)
        while len(words):
            sizes = np.diff(bounds)
            merged = np.full(len(symbols), -1, dtype=np.int32)
            inside = np.ones(len(symbols), dtype=bool)
            inside[bounds[1:] - 1] = False
            at = np.flatnonzero(inside)
            merged[at] = self.pairs.find(symbols[at], symbols[at + 1])
            rank = self.ranks[merged]
            least = np.minimum.reduceat(rank, bounds[:-1])
            # words without a pair are done
            over = least == NO_RANK
            if over.any():
                out = np.repeat(over, sizes)
                done_symbols.append(symbols[out])
                done_words.append(np.repeat(words[over], sizes[over]))
                symbols, merged, rank = symbols[~out], merged[~out], rank[~out]
                words, least, sizes = words[~over], least[~over], sizes[~over]
                bounds = np.concatenate([[0], np.cumsum(sizes)])
                if not len(words):
                    break
            word_of = np.repeat(np.arange(len(words)), sizes)
            chosen = np.flatnonzero(rank == least[word_of])
            # overlapping pairs in turn: every other one of a row of neighbours
            first = np.ones(len(chosen), dtype=bool)
            first[1:] = np.diff(chosen) > 1
            row = np.maximum.accumulate(np.where(first, np.arange(len(chosen)), 0))
            apart = ((np.arange(len(chosen)) - row) & 1) == 0
            # one pair only in words that hold a pair whose piece may grow at once
            owner = word_of[chosen]
            careful = np.zeros(len(words), dtype=bool)
            careful[owner[self.grows[merged[chosen]]]] = True
            leftmost = np.ones(len(chosen), dtype=bool)
            leftmost[1:] = owner[1:] != owner[:-1]
            chosen = chosen[apart & (leftmost | ~careful[owner])]
            symbols[chosen] = merged[chosen]
            kept = np.ones(len(symbols), dtype=bool)
            kept[chosen + 1] = False
            sizes = sizes - np.bincount(word_of[chosen], minlength=len(words))
            symbols = symbols[kept]
            bounds = np.concatenate([[0], np.cumsum(sizes)])
        if not done_words:
            return Lists(symbols, bounds)
        symbols, words = np.concatenate(done_symbols), np.concatenate(done_words)
        order = np.argsort(words, kind="stable")
        counts = np.bincount(words, minlength=n_words)
        return Lists(symbols[order], np.concatenate([[0], np.cumsum(counts)]))

    def _queue(self, symbols: np.ndarray) -> np.ndarray:
        """Symbols of one word after all merges, taken from a queue by (rank, place)."""
        line = symbols.tolist()
        n, ranks, pair_of = len(line), self.ranks.tolist(), self.pair_of
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        merged = self.pairs.find(symbols[:-1], symbols[1:])
        at = np.flatnonzero(merged >= 0)
        queue = (self.ranks[merged[at]].astype(np.int64) << 40 | at).tolist()
        heapify(queue)

        def offer(i: int, j: int) -> None:
            piece = pair_of.get(line[i] << SYMBOL_BITS | line[j])
            if piece is not None:
                heappush(queue, ranks[piece] << 40 | i)

        while queue:
            entry = heappop(queue)
            rank, i = entry >> 40, entry & ((1 << 40) - 1)
            j = after[i]
            if line[i] < 0 or j >= n:
                continue
            piece = pair_of.get(line[i] << SYMBOL_BITS | line[j])
            if piece is None or ranks[piece] != rank:
                continue  # the pair has changed since
            line[i], line[j] = piece, -1
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
                offer(i, after[i])
            if before[i] >= 0:
                offer(before[i], i)
        found = np.array(line, dtype=np.int32)
        return found[found >= 0]

    def _merge_words(self, symbols: np.ndarray, bounds: np.ndarray) -> Lists:
        sizes = np.diff(bounds)
        long = sizes > ROUND_SYMBOLS
        if not long.any():
            return self._rounds(symbols, bounds)
        short = np.flatnonzero(~long)
        found = self._rounds(*vars(Lists(symbols, bounds).take(short)).values())
        place = np.empty(len(sizes), dtype=np.int64)
        place[short] = np.arange(len(short))
        ends, parts = [found.offsets[-1]], [found.values]
        for k, w in enumerate(np.flatnonzero(long)):
            parts.append(self._queue(symbols[bounds[w] : bounds[w + 1]]))
            ends.append(ends[-1] + len(parts[-1]))
            place[w] = len(short) + k
        offsets = np.concatenate([found.offsets, np.array(ends[1:], dtype=np.int64)])
        return Lists(np.concatenate(parts), offsets).take(place)

    def _as_ids(self, merged: Lists) -> Lists:
        """Piece ids; characters that are no piece become the ids of their bytes."""
        values, offsets = merged.values, merged.offsets
        lone = np.flatnonzero(values >= self.size)
        if not len(lone):
            return merged
        chars = values[lone] - self.size
        raw = [chr(c).encode() for c in chars.tolist()]
        sizes = np.ones(len(values), dtype=np.int64)
        sizes[lone] = [len(r) for r in raw]
        ids = np.repeat(values, sizes)
        starts = np.cumsum(sizes) - sizes
        data = np.frombuffer(b"".join(raw), dtype=np.uint8)
        ids[ranges(starts[lone], sizes[lone])] = self.byte_ids[data]
        return Lists(ids, np.concatenate([[0], np.cumsum(sizes)])[offsets])

    def _word_ids(self, raw: bytes, sizes: np.ndarray) -> Lists:
        """Ids of words given as the bytes of all, spaces as U+0020."""
        chars = np.frombuffer(raw.decode().encode("utf-32-le"), dtype=np.uint32)
        begins = (np.frombuffer(raw, dtype=np.uint8) & 0xC0) != 0x80
        bounds = np.concatenate([[0], np.cumsum(begins)])[np.concatenate([[0], np.cumsum(sizes)])]
        chars = np.where(chars == 0x20, ord(SPACE), chars)
        return self._as_ids(self._merge_words(self.of_char[chars], bounds))

    def _forget(self) -> None:
        self.known = np.zeros((2, 0), dtype=np.uint64)  # hashes, in order of the first
        self.known_ids = Lists(np.zeros(0, dtype=np.int32), np.zeros(1, dtype=np.int64))
        self.known_at = np.zeros(0, dtype=np.int64)

    def _chunk_ids(self, chunk: Chunk) -> Lists:
        """Ids of each text of a chunk; every text that is not empty begins with a space."""
        data = chunk.data
        space = data == 0x20
        begins = space.copy()
        begins[1:] &= ~space[:-1]
        begins[chunk.offsets[:-1][np.diff(chunk.offsets) > 0]] = True
        starts = np.flatnonzero(begins)
        ends = np.append(starts[1:], len(data))
        if not len(starts):
            return Lists(np.zeros(0, dtype=np.int32), np.zeros(len(chunk) + 1, dtype=np.int64))
        one, two = (
            span_hashes(data, starts, ends, _BYTE_STEP[f], _BYTE_VALUES[f]) for f in (0, 1)
        )
        order = np.lexsort((two, one))
        new = np.ones(len(order), dtype=bool)
        new[1:] = (np.diff(one[order]) != 0) | (np.diff(two[order]) != 0)
        word = np.empty(len(order), dtype=np.int64)
        word[order] = np.cumsum(new) - 1
        kept = order[new]  # one place of each different word, by hash
        one, two = one[kept], two[kept]
        # words of earlier chunks are known
        at = np.searchsorted(self.known[0], one)
        near = np.minimum(at, max(len(self.known_at) - 1, 0))
        old = np.zeros(len(one), dtype=bool)
        if len(self.known_at):
            old = (self.known[0][near] == one) & (self.known[1][near] == two)
        place = np.empty(len(one), dtype=np.int64)
        if old.any():
            place[old] = self.known_at[near[old]]
        fresh = np.flatnonzero(~old)
        ids = self.known_ids
        if len(fresh):
            spans = kept[fresh]
            sizes = ends[spans] - starts[spans]
            raw = data[ranges(starts[spans], sizes)].tobytes()
            place[fresh] = len(ids.offsets) - 1 + np.arange(len(fresh))
            ids = ids.then(self._word_ids(raw, sizes))
            if len(self.known_at) < REMEMBERED_WORDS and len(ids.values) < REMEMBERED_IDS:
                self.known = np.insert(
                    self.known, at[fresh], np.stack([one[fresh], two[fresh]]), axis=1
                )
                self.known_at = np.insert(self.known_at, at[fresh], place[fresh])
                self.known_ids = ids
            else:
                self._forget()
        found = ids.take(place[word])
        words_before = np.searchsorted(starts, chunk.offsets)
        return Lists(found.values, found.offsets[words_before])

    def encode(self, texts: pa.Array, ends: bool = True) -> pa.Array:
        """A list of ids for each text, with the begin and end ids if `ends`."""
        if isinstance(texts, pa.ChunkedArray):
            texts = texts.combine_chunks()
        texts = pc.replace_substring(texts.cast(pa.large_string()).fill_null(""), SPACE, " ")
        prefix = pc.if_else(pc.equal(pc.binary_length(texts), 0), "", " ").cast(pa.large_string())
        texts = pc.binary_join_element_wise(prefix, texts, pa.scalar("", pa.large_string()))
        parts = []
        for chunk in chunks(texts):
            ids = self._chunk_ids(chunk)
            if ends:
                sizes = np.diff(ids.offsets) + 2
                offsets = np.concatenate([[0], np.cumsum(sizes)])
                values = np.empty(offsets[-1], dtype=np.int32)
                inside = np.ones(len(values), dtype=bool)
                inside[offsets[:-1]] = inside[offsets[1:] - 1] = False
                values[offsets[:-1]], values[offsets[1:] - 1] = self.begin, self.end
                values[inside] = ids.values
                ids = Lists(values, offsets)
            parts.append(
                pa.ListArray.from_arrays(
                    pa.array(ids.offsets.astype(np.int32)), pa.array(ids.values.astype(np.int32))
                )
            )
        return pa.concat_arrays(parts) if parts else pa.array([], type=pa.list_(pa.int32()))

    # Decoding

    def decode(self, lists: pa.Array) -> pa.Array:
        """The text of each list of ids; a null list or id has none.

        The space that encoding put before a text is taken off its first piece. Bytes that
        form no character become U+FFFD each."""
        if isinstance(lists, pa.ChunkedArray):
            lists = lists.combine_chunks()
        ids = lists.flatten().fill_null(self.begin).to_numpy(zero_copy_only=False)
        counts = pc.list_value_length(lists).fill_null(0).to_numpy(zero_copy_only=False)
        offsets = np.concatenate([[0], np.cumsum(counts, dtype=np.int64)])
        sizes = np.diff(self.surfaces.offsets)[ids]
        data = self.surfaces.values[ranges(self.surfaces.offsets[ids], sizes)]
        before = np.concatenate([[0], np.cumsum(sizes)])
        at = before[offsets]
        # the first piece that shows
        shown = np.flatnonzero(self.kinds[ids] != CONTROL)
        first = np.searchsorted(shown, offsets[:-1])
        some = (first < len(shown)) & (np.append(shown, 0)[first] < offsets[1:])
        first = np.append(shown, 0)[first]
        strip = some & self.spaced[np.append(ids, 0)[first]]
        begin = np.where(strip, before[first] + 1, at[:-1])
        raw = data.tobytes()
        texts = [
            raw[a:b].decode("utf-8", "each-byte") for a, b in zip(begin.tolist(), at[1:].tolist())
        ]
        # no character reaches over a control id that stands among the bytes
        kinds = self.kinds[ids]
        cuts = 1 + np.flatnonzero((kinds[1:] == CONTROL) & (kinds[:-1] == BYTE))
        text = np.searchsorted(offsets, cuts, side="right") - 1
        inner = (cuts > offsets[text]) & (cuts < offsets[text + 1] - 1)
        for t in np.unique(text[inner]):
            stops = [begin[t], *before[cuts[inner & (text == t)]], at[t + 1]]
            texts[t] = "".join(
                raw[a:b].decode("utf-8", "each-byte") for a, b in zip(stops[:-1], stops[1:])
            )
        return pa.array(texts, type=pa.string())


codecs.register_error("each-byte", lambda e: ("�" * (e.end - e.start), e.end))


@lru_cache(maxsize=2)
def codec(path: str) -> PieceCodec:
    return PieceCodec(path)


def encode(text: Column, path: str, ends: bool = True) -> Column:
    """Ids of a text, array<int>. `path` names a model file that every executor has."""

    def run(texts: pa.Array) -> pa.Array:
        return codec(path).encode(texts, ends)

    return F.arrow_udf(run, "array<int>")(text)


def decode(ids: Column, path: str) -> Column:
    """The text of an array of ids."""

    def run(lists: pa.Array) -> pa.Array:
        return codec(path).decode(lists)

    return F.arrow_udf(run, "string")(ids)


def sha256_of_ids(ids: Column) -> Column:
    """Lowercase hex of the ids as little-endian unsigned 32-bit integers."""

    def digest(lists: pa.Array) -> pa.Array:
        import hashlib

        values = np.ascontiguousarray(lists.values.to_numpy(zero_copy_only=False), dtype="<i4")
        at = lists.offsets.to_numpy()
        return pa.array([hashlib.sha256(values[a:b]).hexdigest() for a, b in zip(at[:-1], at[1:])])

    return F.arrow_udf(digest, "string")(ids)
