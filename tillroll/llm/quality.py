"""Quality rules: how much of a text lies in repeated n-grams and repeated lines.

Rolling hashes of several n-gram lengths run over each whole text in numpy. For each
length the characters inside n-grams that occur twice or more are measured, and the
characters of lines that equal an earlier line. One arrow_udf adds the figures to each
row; nothing is shuffled, so skew does not matter.

Null and empty texts have no words, all figures 0 and fail the base rule. Equal rows get
equal figures; an empty table stays empty; other columns pass through untouched.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .session import fresh_name
from .text import byte_table, chunks, covered, later_repeats, mix, repeated
from .text import window_hashes

SYMBOLS = byte_table(b"#*$%&|<>")


@dataclass(frozen=True)
class Rules:
    """A text fails at the first rule it breaks."""

    min_words: int = 20
    window: int = 8
    max_repeat_words: float = 0.30  # share of words in windows found twice
    # n-gram length -> greatest share of word characters inside repeated n-grams
    max_ngram_chars: tuple[tuple[int, float], ...] = ((5, 0.40), (6, 0.38), (8, 0.36), (10, 0.34))
    max_line_chars: float = 0.40  # share of word characters in repeated lines
    max_symbols: float = 0.10  # symbols to a word


FIGURES = pa.struct(
    [
        ("n_words", pa.int64()),
        ("word_chars", pa.int64()),
        ("n_symbols", pa.int64()),
        ("n_dup_lines", pa.int64()),
        ("n_repeat_words", pa.int64()),
        ("ngram_chars", pa.list_(pa.int64())),
        ("line_chars", pa.int64()),
        ("base_failed", pa.bool_()),
        ("kept", pa.bool_()),
    ]
)
FIGURES_SQL = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "ngram_chars array<long>, line_chars long, base_failed boolean, kept boolean"
)


def _measure(texts: pa.Array, rules: Rules) -> pa.Array:
    lengths = sorted({rules.window, *(n for n, _ in rules.max_ngram_chars)})
    columns: dict[str, list] = {f.name: [] for f in FIGURES}
    for chunk in chunks(texts):
        words, lines = chunk.words(), chunk.lines()
        hashes = chunk.hashes(words)
        chars = chunk.chars(words)

        def per_text(mask, weights=chars, words=words):
            return np.bincount(
                words.text_of[mask], weights[mask], minlength=len(words.counts)
            ).astype(np.int64)

        # A repeated n-gram begins with a repeated n-gram of the next shorter length.
        seed = mix(np.arange(len(chunk), dtype=np.uint64) + np.uint64(1))
        starts, inside = None, {}
        for n in lengths:
            here = words.windows(n)
            if starts is not None:
                here = here[np.isin(here, starts, assume_unique=True)]
            keys = window_hashes(hashes, here, n) ^ seed[words.text_of[here]]
            starts = here[repeated(keys)]
            inside[n] = covered(len(hashes), starts, n)

        first_word = np.searchsorted(words.starts, lines.starts)
        filled = np.searchsorted(words.starts, lines.ends) > first_word
        line_keys = chunk.hashes(lines)[filled] ^ seed[lines.text_of[filled]]
        again = np.flatnonzero(filled)[later_repeats(line_keys)]
        begin = np.searchsorted(words.starts, lines.starts[again])
        end = np.searchsorted(words.starts, lines.ends[again])
        in_lines = covered(len(hashes), begin, end - begin)

        everything = np.ones(len(hashes), dtype=bool)
        n_words, word_chars = words.counts, per_text(everything)
        repeat_words = per_text(inside[rules.window], np.ones(len(hashes)))
        line_chars = per_text(in_lines)
        grams = {n: per_text(inside[n]) for n, _ in rules.max_ngram_chars}
        failed = (n_words < rules.min_words) | (
            100 * repeat_words > round(100 * rules.max_repeat_words) * n_words
        )
        n_symbols = chunk.sums(SYMBOLS[chunk.data])
        bad = line_chars > rules.max_line_chars * word_chars
        bad |= n_symbols > rules.max_symbols * n_words
        for n, most in rules.max_ngram_chars:
            bad |= grams[n] > most * word_chars
        columns["n_words"].append(n_words)
        columns["word_chars"].append(word_chars)
        columns["n_symbols"].append(n_symbols)
        columns["n_dup_lines"].append(np.bincount(lines.text_of[again], minlength=len(chunk)))
        columns["n_repeat_words"].append(repeat_words)
        columns["ngram_chars"].append(np.stack(list(grams.values()), axis=1).ravel())
        columns["line_chars"].append(line_chars)
        columns["base_failed"].append(failed)
        columns["kept"].append(~failed & ~bad)
    if not columns["n_words"]:
        return pa.array([], FIGURES)
    arrays = []
    for field in FIGURES:
        values = np.concatenate(columns[field.name])
        if pa.types.is_list(field.type):
            ends = np.arange(len(texts) + 1, dtype=np.int32) * len(rules.max_ngram_chars)
            arrays.append(pa.ListArray.from_arrays(ends, pa.array(values, pa.int64())))
        else:
            arrays.append(pa.array(values, field.type))
    return pa.StructArray.from_arrays(arrays, fields=list(FIGURES))


def figures(text: Column, rules: Rules = Rules()) -> Column:
    """The figures and the verdict of each text, as a struct."""

    def measure(texts: pa.Array) -> pa.Array:
        return _measure(texts, rules)

    return F.arrow_udf(measure, FIGURES_SQL)(text)


def keep_good(docs: DataFrame, text: str = "text", rules: Rules = Rules()) -> DataFrame:
    """The rows whose text passes all rules, with the columns they had."""
    name = fresh_name(docs, "quality")
    judged = docs.withColumn(name, figures(F.col(f"`{text}`"), rules))
    return judged.where(F.col(name)["kept"]).drop(name)
