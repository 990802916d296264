"""Small tables for the corpus operators, and plain-Python definitions to compare with."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

from pyspark.sql import DataFrame, SparkSession

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}


def frame(spark: SparkSession, texts, partitions: int = 3) -> DataFrame:
    """documents rows: texts, or (doc_id, text) or (doc_id, text, source) tuples."""
    rows = []
    for i, t in enumerate(texts):
        doc_id, text, source = (
            (i, t, "s") if not isinstance(t, tuple) else (*t, "s") if len(t) == 2 else t
        )
        rows.append((doc_id, text, "en", source, len(text or "")))
    return spark.createDataFrame(rows, SCHEMA).repartition(partitions)


EDGES = [
    (0, None),
    (1, ""),
    (2, " \t\n\x0b "),
    (3, "word"),
    (4, "one two  three\n\nfour\x0cfive"),
    (5, "é 中文 ß\nİ ı ﬁ <|endoftext|> a<b 'tis they'll"),
    (6, "long " * 60_000),
    (7, "same text, twice over: " * 9),
    (8, "same text, twice over: " * 9),
    (8, "same text, twice over: " * 9),
    (9, " ".join(f"w{i}" for i in range(400))),
    (9, "another text of a repeated id, of some length, is a row of its own"),
    (None, "no id but words, one two three four five six seven"),
    (None, None),
]


def clashing(docs: DataFrame) -> DataFrame:
    """More columns, called as the operators' own might be."""
    for name in (
        "n_words", "kept", "lines", "mix", "contamination", "at", "gone", "key", "quality",
        "plan", "of", "rep", "copy", "hit", "digest", "size", "part", "grp", "keys", "Copy",
    ):
        if name.lower() not in {c.lower() for c in docs.columns}:
            docs = docs.selectExpr("*", f"'x' AS {name}")
    return docs


def words(text: str | None) -> list[str]:
    return WORD.findall(text or "")


def invented(rng: random.Random, n: int, vocabulary: int = 5_000) -> list[str]:
    return [f"{rng.choice('bcdfgh')}{rng.randrange(vocabulary)}" for _ in range(n)]


def shingle_set(text: str | None, n: int) -> frozenset:
    w = words((text or "").translate(LOWER))
    return frozenset(tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))) if w else frozenset()


def components(rows, n: int, percent: int) -> dict:
    """(doc_id, text) rows: the least doc_id reachable over links, by all pairs."""
    sets = defaultdict(list)
    for doc_id, text in rows:
        sets[doc_id].append(shingle_set(text, n))
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    flat = [(i, s) for i, many in sets.items() for s in many if s]
    for a, (i, s) in enumerate(flat):
        for j, t in flat[:a]:
            if 100 * len(s & t) >= percent * len(s | t):
                x, y = root(i), root(j)
                parent[max(x, y)] = min(x, y)
    return {i: root(i) for i in sets}


def repeated_word_flags(texts: list[str | None], n: int) -> list[list[bool]]:
    """Which words lie in windows of n words that start anywhere else too."""
    split = [words(t) for t in texts]
    seen = Counter(tuple(w[i : i + n]) for w in split for i in range(len(w) - n + 1))
    out = []
    for w in split:
        gone = [False] * len(w)
        for i in range(len(w) - n + 1):
            if seen[tuple(w[i : i + n])] > 1:
                gone[i : i + n] = [True] * n
        out.append(gone)
    return out
