"""The numpy kernels against regular expressions and plain loops."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.llm.cases import ALNUM, EDGES, LOWER, WORD
from tillroll.llm import line_dedup
from tillroll.llm import text as T

TEXTS = st.lists(st.none() | st.text("aB9 \n\t\x0b\x1c.é中\U0001f600_", max_size=40), max_size=8)


def pieces(chunk, spans, i):
    return [
        chunk.data[s:e].tobytes().decode()
        for s, e in zip(
            spans.starts[spans.bounds[i] : spans.bounds[i + 1]],
            spans.ends[spans.bounds[i] : spans.bounds[i + 1]],
        )
    ]


@settings(max_examples=200, deadline=None)
@given(TEXTS, st.integers(1, 60))
def test_words_and_lines(texts, size):
    texts = texts + [t for _, t in EDGES[:6]]
    seen = 0
    for chunk in T.chunks(pa.array(texts, pa.string()), size):
        words, lines, lowered = chunk.words(), chunk.lines(), chunk.lower()
        alnum = lowered.words(T.NOT_ALNUM)
        for i in range(len(chunk)):
            text = texts[chunk.first + i] or ""
            assert pieces(chunk, words, i) == WORD.findall(text)
            assert pieces(lowered, alnum, i) == ALNUM.findall(text.translate(LOWER))
            assert pieces(chunk, lines, i) == text.split("\n")
            seen += 1
    assert seen == len(texts)


@settings(max_examples=100, deadline=None)
@given(TEXTS, st.integers(1, 4))
def test_hashes_tell_words_and_windows_apart(texts, n):
    for chunk in T.chunks(pa.array(texts, pa.string())):
        words = chunk.words()
        hashes = chunk.hashes(words)
        spelled = [chunk.data[s:e].tobytes() for s, e in zip(words.starts, words.ends)]
        pairs = set(zip(hashes.tolist(), spelled))
        assert len(pairs) == len(set(spelled)) == len(set(hashes.tolist()))
        starts = words.windows(n)
        keys = T.window_hashes(hashes, starts, n)
        windows = [tuple(spelled[i : i + n]) for i in starts]
        assert len(set(zip(keys.tolist(), windows))) == len(set(windows)) == len(set(keys.tolist()))


def test_a_slice_of_an_arrow_array():
    array = pa.array(["aa", None, "b c", ""]).slice(1, 2)
    (chunk,) = T.chunks(array)
    assert [chunk.raw(i) for i in range(2)] == [b"", b"b c"]


def test_helpers():
    assert T.ranges(np.array([3, 10]), np.array([2, 3])).tolist() == [3, 4, 10, 11, 12]
    assert T.covered(5, np.array([1, 2]), 2).tolist() == [False, True, True, True, False]
    keys = np.array([5, 1, 5, 2, 5])
    assert T.repeated(keys).tolist() == [True, False, True, False, True]
    assert T.later_repeats(keys).tolist() == [False, False, True, False, True]
    empty = np.zeros(0, dtype=np.uint64)
    assert not len(T.repeated(empty)) and not len(T.later_repeats(empty))


def test_span_hashes_across_tiles():
    """Any spans, in any order, against the sum written out with Python's integers."""
    rng = np.random.default_rng(3)
    n, step = 2 * T.TILE + 7, 0x9E3779B97F4A7C15
    values = rng.integers(0, 2**63, n, dtype=np.uint64)
    edges = [(0, 0), (0, 3), (T.TILE - 2, T.TILE + 2), (T.TILE, 2 * T.TILE), (5, n), (n, n)]
    random = np.sort(rng.integers(0, n + 1, (4, 2)), axis=1).tolist()

    def plain(start, end):
        h = 0
        for v in reversed(values[start:end].tolist()):
            h = (h * step + v) % 2**64
        return (h + (end - start) * 0x9FB21C651E98DF25) % 2**64

    for spans in (edges, edges[::-1] + random):
        starts, ends = np.array(spans).T
        expected = T.mix(np.array([plain(s, e) for s, e in spans], dtype=np.uint64))
        assert (T.span_hashes(values, starts, ends, step) == expected).all()
    table = rng.integers(0, 2**63, 256, dtype=np.uint64)
    letters = rng.integers(0, 256, n).astype(np.uint8)
    starts, ends = np.array(edges).T
    direct = T.span_hashes(table[letters], starts, ends, step)
    assert (T.span_hashes(letters, starts, ends, step, table) == direct).all()


def test_chars_counts_code_points():
    for chunk in T.chunks(pa.array(["é中\U0001f600 a", "", "bb", "cc é"])):
        words = chunk.words()
        assert chunk.chars(words).tolist() == [3, 1, 2, 2, 1]
        assert chunk.sums(chunk.data == ord("b")).tolist() == [0, 0, 2, 0]


def test_trimmed_lines_of_min_chars():
    texts = [" \t\n  Ab cé \x0b\nx\n\n", None, "", "\x1c é\n \n  ", "plain"]
    for chunk in T.chunks(pa.array(texts)):
        lines, long_enough, one, two = line_dedup._keys(chunk, 4)
        keys = [k.strip(" \t\n\x0b\f\r").translate(LOWER) for t in texts for k in (t or "").split("\n")]
        assert long_enough.tolist() == [len(k) >= 4 for k in keys]
        assert len(set(zip(one, two))) == len(set(zip(one, keys))) == len(set(keys))
