"""A corpus pipeline of five stages over the documents table.

Quality rules reject documents; of each group of near duplicates one document stays;
documents contaminated with benchmark passages go; sources are mixed to their target
weights; what is left is written as token files. Each stage takes (spark, docs, sf_dir) and
returns a DataFrame; all but the last return the columns of documents. `run` writes each
stage's result as Parquet to the shared scratch folder, and the next stage reads it there.

The last stage writes the token files and returns one row for each document in them:
doc_id, start, n_tokens and ids_crc32, read back from the files. After mixing a doc_id has
a row for each time its document is taken.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillroll.llm import decontaminate, jaccard_join, mix, quality, token_files
from tillroll.llm.queries import tokenizer_path
from tillroll.llm.session import prepare, written
from tillroll.session import scratch_path

# Near duplicates here share 80 % of their five-word shingles.
NEAR = jaccard_join.Similarity(ngram=5, percent=80)
# Words a worker remembers: few, as the workers of earlier stages are still there.
REMEMBERED = 50_000


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the rules on length, repetition and symbols."""
    prepare(spark)
    return quality.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, the one with the least doc_id."""
    prepare(spark)
    return jaccard_join.one_of_each(docs, NEAR)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than one word in 20 lies in benchmark windows."""
    benchmark = prepare(spark).read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontaminate.remove_contaminated(docs, benchmark)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights; documents repeat with the epochs of their source."""
    prepare(spark)
    return mix.mixed(docs)


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token files' rows: doc_id, start, n_tokens, ids_crc32."""
    files = token_files.TokenFiles(scratch_path(prepare(spark), "pipeline-tokens"))
    token_files.write_tokens(docs, tokenizer_path(), files, remembered=REMEMBERED)
    ids = token_files.crc32_of_ids(F.col("ids")).alias("ids_crc32")
    return token_files.read_tokens(spark, files).select("doc_id", "start", "n_tokens", ids)


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("mixing sources to target weights", mixing),
    ("token-ID / binary output", token_output),
]

# Tokenizing cannot be expressed in SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table of `sf_dir`."""
    docs = prepare(spark).read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), "pipeline-" + name.split()[0])
    return STAGES[-1][1](spark, docs, sf_dir)
