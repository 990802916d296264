"""The registered queries op1 .. op13 over the documents, benchmark and pages tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path
from . import decontaminate, html_text, jaccard_join, language_id, lexical_search, licenses
from . import line_dedup, mix, oracles, periodic_runs, piece_codec, quality, substring_dedup
from . import token_files
from .session import prepare


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def piece_model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    files = token_files.TokenFiles(scratch_path(spark, "tokens"))
    token_files.write_tokens(docs, tokenizer_path(), files)
    return token_files.read_tokens(spark, files).select(
        "doc_id", "start", "n_tokens", token_files.crc32_of_ids(F.col("ids")).alias("ids_crc32")
    )


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.find_contamination(docs, _table(spark, sf_dir, "benchmark"), "found")
    return found.select(
        "doc_id",
        "found.n_words",
        "found.n_hit",
        F.size("found.items").cast("long").alias("n_items"),
        F.sha2(F.array_join("found.items", ","), 256).alias("items_sha256"),
        "found.contaminated",
        F.col("found.longest").alias("longest_run"),
        F.coalesce("found.match.words", F.lit(0).cast("long")).alias("longest_match"),
        F.col("found.match.start").alias("match_start"),
    )


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    held_out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 5 == 0
    training = docs.where(~held_out).select(F.col("doc_id").alias("id"), "text", "lang")
    predict = language_id.predictor(spark, language_id.train(training))
    found = docs.select("doc_id", held_out.alias("held_out"), predict(F.col("text")).alias("p"))
    return found.select(
        "doc_id", "held_out", F.col("p.lang").alias("lang_pred"), F.col("p.score").alias("score")
    )


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mix.planned(docs).select(
        "doc_id", "mix.size", "mix.source_size", "mix.target", "mix.taken"
    )


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return substring_dedup.remove_repeats(docs).drop("kept")


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    judged = docs.select("doc_id", quality.figures(F.col("text")).alias("q"))
    return judged.select(
        "doc_id",
        *(
            f"q.{c}"
            for c in (
                "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                "base_failed", "kept",
            )
        ),
    )


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    found = docs.select("doc_id", licenses.scan(F.col("text")).alias("m"))
    return found.select(
        "doc_id",
        F.size("m").cast("long").alias("n_licenses"),
        F.array_join("m.license", ",").alias("licenses"),
        F.coalesce(F.array_max("m.share"), F.lit(0.0)).alias("best_share"),
    )


def op8_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.near_duplicates(_table(spark, sf_dir, "documents"))


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages")
    texts = pages.select("page_id", "url", html_text.extract(F.col("html")).alias("text"))
    return texts.withColumn("n_chars", F.length("text").cast("long"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup.dedup_lines(docs).select(
        "doc_id",
        "lines.n_lines",
        "lines.n_dropped",
        F.sha2(F.col("lines.text"), 256).alias("kept_sha256"),
    )


def op11_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    path = piece_model_path()
    encoded = docs.select("doc_id", piece_codec.encode(F.col("text"), path).alias("ids"))
    return encoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        piece_codec.sha256_of_ids(F.col("ids")).alias("ids_sha256"),
        F.sha2(piece_codec.decode(F.col("ids"), path), 256).alias("decoded_sha256"),
    )


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return lexical_search.search(docs, _table(spark, sf_dir, "benchmark"), k=50)


def _made_periodic(doc_id: Column, text: Column) -> Column:
    """The text; for a tenth of the ids its words from some place on repeat with a period."""
    h = F.crc32(doc_id.cast("string"))
    g = F.floor(h / 10)

    def made(words: Column) -> Column:
        n = F.size(words)
        a = F.pmod(g, n)
        p = 1 + F.floor((n - a) / (3 + F.pmod(g, F.lit(8))))
        repeated = F.transform(
            words,
            lambda w, i: F.when(i < a, w).otherwise(
                F.get(words, (a + F.pmod(i - a, p)).cast("int"))
            ),
        )
        return F.when(n > 0, F.array_join(repeated, " ")).otherwise(text)

    # the array of one binds the words to a variable, so that they are split once
    once = F.transform(F.array(periodic_runs.words_of(text)), made)
    return F.when(h % 10 == 0, F.get(once, F.lit(0))).otherwise(text)


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    made = docs.select("doc_id", _made_periodic(F.col("doc_id"), F.col("text")).alias("text"))
    found = periodic_runs.with_runs(made)
    runs, best = F.col("runs"), F.col("best")
    return found.withColumn("best", periodic_runs.strongest(runs)).select(
        "doc_id",
        F.size(runs).cast("long").alias("n_runs"),
        best.start.alias("start"),
        best.length.alias("length"),
        best.period.alias("period"),
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(periodic_runs.runs_text(runs), 256).alias("runs_sha256"),
        F.sha2(periodic_runs.collapsed(F.col("text"), runs), 256).alias("collapsed_sha256"),
    )


QUERIES = {
    f.__name__: f
    for f in (
        op1_token_files,
        op2_decontamination,
        op3_language_id,
        op4_mixing,
        op5_substring_dedup,
        op6_quality_rules,
        op7_license_scan,
        op8_ngram_jaccard,
        op9_html_extraction,
        op10_line_dedup,
        op11_sentencepiece,
        op12_lexical_search,
        op13_periodic_runs,
    )
}

SQL = {
    "op2_decontamination": oracles.DECONTAMINATION,
    "op4_mixing": oracles.MIX,
    "op5_substring_dedup": oracles.SUBSTRINGS,
    "op6_quality_rules": oracles.QUALITY,
    "op8_ngram_jaccard": oracles.JACCARD,
    "op10_line_dedup": oracles.LINES,
    "op12_lexical_search": oracles.SEARCH,
}
