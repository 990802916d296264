"""Language identification with a bit-sliced Bloom filter of character n-grams.

One table of bit masks serves all languages: an n-gram sets its language's bit in HASHES
rows of the table, and the AND of an n-gram's rows is the set of all languages that have
it, one lookup for all. Per text the bits are counted for each language; a count is
corrected for false positives, of which a language with a share f of its bits set has
f^HASHES, and the largest corrected count decides. The score is that language's share of
all corrected counts.

Training is on a sample that is bounded by a parameter: for each language the MAX_TEXTS
texts, or fewer, that come first by a hash of their id. From their n-grams each language
keeps its MAX_GRAMS most frequent, without those that are much more frequent in another
language. So the model's size is bounded, and it is broadcast. Prediction reads whole
texts and nothing but the text.

A null text, or one without letters, is `und` with score 0. A text whose n-grams nobody
has seen gets the first language, with score 0. Equal texts get equal results; ties go to
the first language by name; other columns pass through; without labelled texts all is `und`.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .session import written
from .text import mix

GRAMS = (3, 4)
HASHES = 3
TABLE_ROWS = 1 << 19
MAX_TEXTS = 2_000
MAX_GRAMS = 40_000
MAX_RATIO = 4.0  # how much more frequent an n-gram may be in another language
UNKNOWN = "und"
CHUNK_CHARS = 1 << 19

# Code points that are letters; the planes above the first are looked up one by one.
_LETTER = np.fromiter((chr(c).isalpha() for c in range(0x10000)), dtype=bool, count=0x10000)


def _letters(codes: np.ndarray) -> np.ndarray:
    flags = _LETTER[np.minimum(codes, 0xFFFF)]
    for i in np.flatnonzero(codes > 0xFFFF):
        flags[i] = chr(codes[i]).isalpha()
    return flags


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash of each n-gram, its text, number of letters of each text). Texts are lower-cased;
    what is not a letter counts as one space, and every text starts and ends with one."""
    # U+0000 in a text is no bound of texts.
    joined = "\x00".join(f" {t.lower()} ".replace("\x00", " ") for t in texts)
    codes = np.frombuffer(joined.encode("utf-32-le", "replace"), dtype=np.uint32)
    text = np.cumsum(codes == 0)
    letters = _letters(codes)
    counts = np.bincount(text[letters], minlength=len(texts))
    # The first of a run of other characters stays, as a space.
    keep = letters | (codes == 0)
    keep[1:] |= letters[:-1] | (codes[:-1] == 0)
    codes = np.where(letters, codes, 0)[keep].astype(np.uint64)
    text, letters = text[keep], letters[keep]
    hashes, owners = [], []
    for n in GRAMS:
        if len(codes) < n:
            continue
        size = len(codes) - n + 1
        h = np.full(size, n, dtype=np.uint64)
        for i in range(n):
            h = h * np.uint64(0x9E3779B97F4A7C15) + codes[i : i + size]
        # One space at most, at an end.
        good = (text[n - 1 :] == text[:size]) & letters[1 : size + 1]
        if n > 2:
            for i in range(2, n - 1):
                good &= letters[i : i + size]
        good &= letters[:size] | letters[n - 1 :]
        hashes.append(mix(h[good]))
        owners.append(text[:size][good])
    if not hashes:
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64), counts
    return np.concatenate(hashes), np.concatenate(owners), counts


def _rows(h: np.ndarray, size: int) -> list[np.ndarray]:
    """The rows of the table for each n-gram."""
    mask = np.uint64(size - 1)
    return [((h >> np.uint64(20 * i)) & mask).astype(np.int64) for i in range(HASHES)]


@dataclass
class Model:
    """languages, and for every 64 of them one table of masks with their fill."""

    languages: list[str]
    tables: list[np.ndarray]

    def __post_init__(self):
        fill = [
            (self.tables[i // 64] >> np.uint64(i % 64) & np.uint64(1)).mean()
            for i in range(len(self.languages))
        ]
        self.false = np.array(fill) ** HASHES

    def masks(self, h: np.ndarray) -> list[np.ndarray]:
        """For each table the languages that have each n-gram."""
        rows = _rows(h, TABLE_ROWS)
        out = []
        for table in self.tables:
            mask = table[rows[0]]
            for r in rows[1:]:
                mask = mask & table[r]
            out.append(mask)
        return out

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        h, owner, letters = grams(texts)
        total = np.bincount(owner, minlength=len(texts))
        masks = self.masks(h)
        counts = np.zeros((len(texts), max(1, len(self.languages))))
        for i in range(len(self.languages)):
            has = (masks[i // 64] >> np.uint64(i % 64)) & np.uint64(1)
            hits = np.bincount(owner, has, minlength=len(texts))
            counts[:, i] = np.maximum(0, hits - total * self.false[i]) / (1 - self.false[i])
        best = counts.argmax(axis=1)
        sums = counts.sum(axis=1)
        top = counts[np.arange(len(texts)), best]
        score = np.divide(top, sums, out=np.zeros(len(texts)), where=sums > 0)
        known = (letters > 0) & bool(self.languages)
        names = [self.languages[b] if k else UNKNOWN for b, k in zip(best, known)]
        return names, np.where(known, score, 0.0)


def _pieces(texts: list[str]):
    """Runs of texts of about CHUNK_CHARS characters, whole texts only."""
    held, size = [], 0
    for t in texts:
        held.append(t)
        size += len(t)
        if size >= CHUNK_CHARS:
            yield held
            held, size = [], 0
    if held:
        yield held


def train(labelled: DataFrame, max_texts: int = MAX_TEXTS, max_grams: int = MAX_GRAMS) -> Model:
    """A model from rows (id, text, lang); rows without a text or a language are left out."""
    rows = labelled.where("text IS NOT NULL AND lang IS NOT NULL")
    order = F.xxhash64("id")
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    languages = sorted(sizes)
    if not languages:
        return Model([], [np.zeros(TABLE_ROWS, dtype=np.uint64)])
    # About max_texts of each language: a share of the hash range, the same on every run.
    spread = 1 << 30
    shares = F.create_map(
        *(F.lit(x) for name in languages
          for x in (name, min(spread, -(-spread * max_texts // sizes[name]))))
    )
    chosen = rows.where(F.pmod(order, F.lit(spread)) < shares[F.col("lang")])
    number = F.create_map(*(F.lit(x) for i, n in enumerate(languages) for x in (n, i)))

    def count(batches):
        schema = pa.schema([("lang", pa.int32()), ("gram", pa.int64()), ("n", pa.int64())])
        for batch in batches:
            langs = np.array(batch.column(0).to_pylist())
            texts = batch.column(1).to_pylist()
            for lang in np.unique(langs):
                for piece in _pieces([texts[i] for i in np.flatnonzero(langs == lang)]):
                    found, n = np.unique(grams(piece)[0], return_counts=True)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.full(len(found), lang, dtype=np.int32)),
                            pa.array(found.view(np.int64)),
                            pa.array(n),
                        ],
                        schema=schema,
                    )

    counted = written(
        chosen.select(number[F.col("lang")].alias("lang"), "text")
        .mapInArrow(count, "lang int, gram long, n long")
        .groupBy("lang", "gram")
        .agg(F.sum("n").alias("n")),
        "language-grams",
    )
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    totals = {r["lang"]: r["n"] for r in counted.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    top = counted.withColumn("place", place).where(F.col("place") <= max_grams).where("n > 1")
    kept = top.select("lang", "gram", "n").toPandas()  # at most max_grams for each language
    rate = kept["n"] / kept["lang"].map(totals)
    kept = kept[rate * MAX_RATIO >= rate.groupby(kept["gram"]).transform("max")]
    tables = [np.zeros(TABLE_ROWS, dtype=np.uint64) for _ in range(-(-len(languages) // 64))]
    for lang, own in kept.groupby("lang"):
        for r in _rows(own["gram"].to_numpy().view(np.uint64), TABLE_ROWS):
            tables[lang // 64][r] |= np.uint64(1) << np.uint64(lang % 64)
    return Model(languages, tables)


def predictor(spark, model: Model):
    """A function of a text column: struct (lang, score)."""
    known = spark.sparkContext.broadcast(model)

    def predict(texts: pa.Array) -> pa.Array:
        names, scores = [], [np.zeros(0)]
        for piece in _pieces([t or "" for t in texts.to_pylist()]):
            found, score = known.value.predict(piece)
            names.extend(found)
            scores.append(score)
        return pa.StructArray.from_arrays(
            [pa.array(names, pa.string()), pa.array(np.concatenate(scores))], names=["lang", "score"]
        )

    def column(text: Column) -> Column:
        return F.arrow_udf(predict, "lang string, score double")(text)

    return column
