"""Token files: ORC tables of token ids in document order.

Documents are range-partitioned by doc_id and sorted, encoded in place, and each
partition becomes one ORC part, so `part` and doc_id ascend together over all files. ORC
keeps the ids as run-length encoded integers, gives every row group an index of least
and greatest values and a Bloom filter on doc_id; a reader of a few documents skips the
stripes and row groups that cannot hold them, and a reader of everything takes stripes
in parallel. A small manifest, one row for each part, has the parts' doc_id ranges and
token totals with running starts, so no pass over all rows is needed for positions.

A null or empty text has the end id alone. Rows without doc_id come first. Rows that
share a doc_id are ordered by their text; equal rows stay, each with its own place. Only
doc_id and text are read, so other columns cannot clash. An empty table gives no rows.
"""

from __future__ import annotations

import json
import os
import unicodedata
from array import array
from dataclasses import dataclass
from functools import lru_cache
from string import punctuation

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .text import give_back

WORD_BYTES = 64  # longer words are encoded without being remembered
REMEMBERED = 500_000


# How a tokenizer file of the one kind encoded here describes itself.
NORMALIZER = {
    "type": "Sequence",
    "normalizers": [
        {"type": "NFC"},
        {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "},
        {"type": "Lowercase"},
    ],
}
PRE_TOKENIZER = {
    "type": "Sequence",
    "pretokenizers": [
        {
            "type": "Split",
            "pattern": {
                "Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
            },
            "behavior": "Removed",
            "invert": True,
        },
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}
MODEL = {"type": "BPE", "dropout": None, "continuing_subword_prefix": None, "byte_fallback": False}


def _byte_symbols() -> dict[int, str]:
    """The printable character that byte-level vocabularies use for each byte."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(0x100, 0x200))
    return {b: chr(b if b in plain else next(others)) for b in range(256)}


def refuse_others(path: str) -> None:
    """An error for a tokenizer file that normalizes or splits words in another way."""
    with open(path, encoding="utf-8") as file:
        made = json.load(file)
    kind = {k: made["model"].get(k) for k in MODEL}
    if (made["normalizer"], made["pre_tokenizer"], kind) != (NORMALIZER, PRE_TOKENIZER, MODEL):
        raise ValueError("not a lower-casing byte-level tokenizer with word ends")


class WordIds(dict):
    """Ids of white-space separated words, as little-endian bytes, remembered.

    No token of this kind of tokenizer crosses white space, so a text's ids are those of
    its words. It also splits letters from what follows them. Words of letters in normal
    form go straight to the model; anything else takes the whole way through the tokenizer.
    Only for tokenizers that `refuse_others` lets pass.
    """

    def __init__(self, tokenizer, remembered: int = REMEMBERED):
        self.tokenizer, self.tokenize = tokenizer, tokenizer.model.tokenize
        self.remembered = remembered
        self.symbols = _byte_symbols()

    def _any(self, text: str) -> bytes:
        return array("i", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _letters(self, word: str) -> bytes:
        if word.isascii():
            if not word.islower():
                return self[word.lower()]
            return array("i", [t.id for t in self.tokenize(word)]).tobytes()
        lower = "".join(map(str.lower, word))
        if lower != word:
            return self[lower] if lower.isalpha() and len(lower) == len(word) else self._any(word)
        if not unicodedata.is_normalized("NFC", word):
            return self._any(word)
        symbols = word.encode().decode("latin-1").translate(self.symbols)
        return array("i", [t.id for t in self.tokenize(symbols)]).tobytes()

    def __missing__(self, word: str) -> bytes:
        if not word:
            return b""
        if len(word) > WORD_BYTES:
            return self._any(word)
        if word.isalpha():
            ids = self._letters(word)
        else:
            base = word.rstrip(punctuation)
            # a letter that NFC takes apart may end in a mark, which stays with what follows
            plain = base.isascii() or unicodedata.is_normalized("NFC", base)
            if base != word and plain and base.isalpha() and base.lower().isalpha():
                ids = self[base] + self[word[len(base) :]]
            else:
                ids = self._any(word)
        if len(self) >= self.remembered:
            self.clear()
        self[word] = ids
        return ids

    def encode(self, text: str) -> bytes:
        return b"".join(map(self.__getitem__, text.replace("\n", " ").split(" ")))


@lru_cache(maxsize=4)
def _word_ids(path: str, remembered: int = REMEMBERED) -> WordIds:
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    words = WordIds(Tokenizer.from_file(path), remembered)
    give_back()  # what reading the file took
    return words


@dataclass(frozen=True)
class TokenFiles:
    """Where token files are, and how they are laid out."""

    path: str
    stride: int = 1_000  # rows of a row group, the unit of skipping
    stripe_bytes: int = 64 << 20
    end_id: int = 1

    @property
    def rows_path(self) -> str:
        return f"{self.path}/rows"

    @property
    def manifest_path(self) -> str:
        return f"{self.path}/manifest"


ROWS = pa.schema(
    [
        ("part", pa.int32()),
        ("doc_id", pa.int64()),
        ("start_in_part", pa.int64()),
        ("n_tokens", pa.int32()),
        ("ids", pa.list_(pa.int32())),
    ]
)
ROWS_SQL = "part int, doc_id long, start_in_part long, n_tokens int, ids array<int>"


def write_tokens(
    docs: DataFrame, tokenizer_path: str, files: TokenFiles, remembered: int = REMEMBERED
) -> None:
    """Encode every text and write the files and their manifest.

    A worker remembers the ids of `remembered` words, about 150 bytes each. `tokenizer_path` names a file that the driver and every executor have, such as one of a
    package."""
    refuse_others(tokenizer_path)
    end = np.array([files.end_id], dtype="<i4").tobytes()

    def encode(batches):
        words = _word_ids(tokenizer_path, remembered)
        part, start = TaskContext.get().partitionId(), 0
        for batch in batches:
            packed = [words.encode(t or "") + end for t in batch.column(1).to_pylist()]
            sizes = np.fromiter(map(len, packed), dtype=np.int64, count=len(packed)) // 4
            ends = np.cumsum(sizes)
            ids = pa.array(np.frombuffer(b"".join(packed), dtype="<i4"))
            offsets = pa.array(np.concatenate([[0], ends]).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(len(packed), part, dtype=np.int32)),
                    batch.column(0),
                    pa.array(start + ends - sizes),
                    pa.array(sizes.astype(np.int32)),
                    pa.ListArray.from_arrays(offsets, ids),
                ],
                schema=ROWS,
            )
            start += int(ends[-1]) if len(ends) else 0

    (
        docs.select(F.col("doc_id").cast("long"), "text")
        .repartitionByRange("doc_id")
        .sortWithinPartitions("doc_id", "text")
        .mapInArrow(encode, ROWS_SQL)
        .write.option("orc.bloom.filter.columns", "doc_id")
        .option("orc.row.index.stride", files.stride)
        .option("orc.stripe.size", files.stripe_bytes)
        .orc(files.rows_path)
    )
    spark = docs.sparkSession
    totals = (
        spark.read.schema(ROWS_SQL)
        .orc(files.rows_path)
        .groupBy("part")
        .agg(
            F.count("*").alias("n_docs"),
            F.min("doc_id").alias("first_doc"),
            F.max("doc_id").alias("last_doc"),
            F.sum("n_tokens").alias("n_tokens"),
        )
    )
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row a file
    manifest = totals.withColumn(
        "start", F.coalesce(F.sum("n_tokens").over(before), F.lit(0).cast("long"))
    )
    manifest.write.parquet(files.manifest_path)


MANIFEST_SQL = (
    "part int, n_docs long, first_doc long, last_doc long, n_tokens long, start long"
)


def read_tokens(spark: SparkSession, files: TokenFiles) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids. A filter on doc_id
    reaches the files' indexes."""
    rows = spark.read.schema(ROWS_SQL).orc(files.rows_path)
    parts = spark.read.schema(MANIFEST_SQL).parquet(files.manifest_path)
    return rows.join(parts.select("part", "start"), "part").select(
        "doc_id",
        (F.col("start") + F.col("start_in_part")).alias("start"),
        F.col("n_tokens").cast("long").alias("n_tokens"),
        "ids",
    )


def crc32_of_ids(ids: Column) -> Column:
    """Unsigned crc32 of the ids as little-endian unsigned 32-bit integers."""

    def crc(lists: pa.Array) -> pa.Array:
        import zlib

        values = np.ascontiguousarray(lists.values.to_numpy(zero_copy_only=False), dtype="<i4")
        at = lists.offsets.to_numpy()
        return pa.array(
            [zlib.crc32(values[a:b]) for a, b in zip(at[:-1], at[1:])], type=pa.int64()
        )

    return F.arrow_udf(crc, "long")(ids)
