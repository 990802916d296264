"""Nulls, empty and very long texts, ties, repeated rows, empty tables, clashing columns."""

from __future__ import annotations

import hashlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tests.llm.cases import EDGES, SCHEMA, clashing, components, frame, repeated_word_flags, words
from tillroll.llm import decontaminate, html_text, jaccard_join, language_id, licenses
from tillroll.llm import line_dedup, mix, quality, queries, substring_dedup, token_files
from tillroll.llm.session import prepare
from tillroll.session import scratch_path

TEXTS = Counter(EDGES)


@pytest.fixture(scope="module")
def docs(spark):
    prepare(spark)
    return clashing(frame(spark, EDGES))


@pytest.fixture(scope="module")
def nothing(spark):
    return clashing(prepare(spark).createDataFrame([], SCHEMA))


@pytest.fixture(scope="module")
def benchmark(spark):
    rows = [(1, None), (2, ""), (3, "same text, twice over"), (3, "w5 w6 w7"), (None, "ß")]
    return spark.createDataFrame(rows, "item_id long, text string")


def pairs(df, *columns):
    return Counter(tuple(r) for r in df.select("doc_id", *columns).collect())


def test_token_files(spark, docs, nothing):
    files = token_files.TokenFiles(scratch_path(spark, "edges"))
    token_files.write_tokens(docs, queries.tokenizer_path(), files)
    rows = token_files.read_tokens(spark, files).orderBy("start").collect()
    assert Counter(r.doc_id for r in rows) == Counter(i for i, _ in EDGES)
    assert [r.doc_id for r in rows] == sorted((i for i, _ in EDGES), key=lambda i: -1 if i is None else i)
    start = 0
    for r in rows:
        assert (r.start, r.n_tokens, r.ids[-1]) == (start, len(r.ids), 1)
        start += r.n_tokens
    assert [r.ids for r in rows if r.doc_id in (0, 1, 2)] == [[1]] * 3
    empty = token_files.TokenFiles(scratch_path(spark, "edges"))
    token_files.write_tokens(nothing, queries.tokenizer_path(), empty)
    assert token_files.read_tokens(spark, empty).count() == 0


def test_decontamination(docs, nothing, benchmark):
    found = decontaminate.find_contamination(docs, benchmark)
    assert found.columns == [*docs.columns, "contamination_"]
    got = {(r.doc_id, r.text): r["contamination_"] for r in found.collect()}
    assert found.count() == len(EDGES)
    assert got[0, None].n_words == got[1, ""].n_hit == 0
    assert got[EDGES[7]].n_hit == got[EDGES[7]].n_words == 36 and got[EDGES[7]].contaminated
    assert got[EDGES[7]].longest == 36 and got[EDGES[7]]["items"] == ["3"]
    assert (got[EDGES[10]].n_hit, got[EDGES[10]].contaminated) == (3, False)
    assert got[EDGES[5]]["items"] == [""]
    assert decontaminate.find_contamination(nothing, benchmark).count() == 0
    without = decontaminate.find_contamination(docs, benchmark.limit(0))
    assert without.where("contamination_.n_hit > 0").count() == 0


def test_decontamination_in_blocks(docs, benchmark):
    one = decontaminate.find_contamination(docs, benchmark)
    many = decontaminate.find_contamination(docs, benchmark, block_bytes=5)
    assert pairs(one, "text", F.col("contamination_").cast("string")) == pairs(
        many, "text", F.col("contamination_").cast("string")
    )
    kept = decontaminate.remove_contaminated(docs, benchmark)
    assert kept.columns == docs.columns
    assert kept.count() == one.where("NOT contamination_.contaminated").count() < len(EDGES)


def test_longest_run_over_items_of_several_blocks(spark):
    text = " ".join(f"v{i}" for i in range(60))
    part = text.split()
    items = [" ".join(part[a : a + 15]) for a in (10, 20, 33)]  # v10 .. v47, one run
    items.append(" ".join(part[55:]) + " and more words of its own, none of them in the text at all")
    benchmark = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    rows = frame(prepare(spark), [(1, text), (2, "nothing of it"), (3, None)])
    for block_bytes in (1 << 24, 5):
        found = decontaminate.find_contamination(rows, benchmark, block_bytes=block_bytes)
        got = {r.doc_id: (r.contamination.n_hit, r.contamination.longest) for r in found.collect()}
        assert got == {1: (38, 38), 2: (0, 0), 3: (0, 0)}, block_bytes


def test_language(spark, docs, nothing):
    labelled = docs.select(F.col("doc_id").alias("id"), "text", "lang")
    model = language_id.train(labelled)
    named = docs.withColumn("p", language_id.predictor(spark, model)(F.col("text")))
    got = {(r.doc_id, r.text): r.p for r in named.collect()}
    assert got[0, None].lang == got[1, ""].lang == got[2, EDGES[2][1]].lang == "und"
    assert {p.lang for (i, _), p in got.items() if i in (3, 4, 6, 7, 9)} == {"en"}
    untrained = language_id.train(nothing.select(F.col("doc_id").alias("id"), "text", "lang"))
    blank = docs.select(language_id.predictor(spark, untrained)(F.col("text")).alias("p"))
    assert {r.p.lang for r in blank.collect()} == {"und"}
    assert nothing.select(language_id.predictor(spark, model)(F.col("text"))).count() == 0


def test_language_of_texts_with_zeros(spark):
    pair = {"en": "the cat and the dog went out", "xx": "zuq woxi qazu xowu zaqi"}
    rows = [(i, text, lang) for i in range(4) for lang, text in pair.items()]
    model = language_id.train(spark.createDataFrame(rows, "id long, text string, lang string"))
    texts = ["the\x00cat and \x00\x00 the dog", *pair.values(), "\x00", "zuq\x00woxi", ""]
    names, _ = model.predict(texts)
    assert names == ["en", "en", "xx", "und", "xx", "und"]
    spaced = language_id.grams([t.replace("\x00", " ") for t in texts])
    assert all((a == b).all() for a, b in zip(language_id.grams(texts), spaced))
    df = spark.createDataFrame([(t,) for t in texts], "text string").coalesce(1)
    found = df.select("text", language_id.predictor(spark, model)(F.col("text")).alias("p"))
    assert {r.text: r.p.lang for r in found.collect()} == dict(zip(texts, names))


def test_mixing(docs, nothing):
    drawn = mix.planned(docs)
    assert drawn.columns == [*docs.columns, "mix_"]
    rows = [(r.text, r["mix_"]) for r in drawn.collect()]
    assert len(rows) == len(EDGES)
    total = sum(len(words(t)) for _, t in EDGES)
    for text, m in rows:
        assert (m.size, m.source_size, m.target) == (len(words(text)), total, 1.5 * total)
        assert 0 <= m.taken <= 2 * m.size
    assert 0 <= round(1.5 * total) - sum(m.taken for _, m in rows) <= 3
    mixed = mix.mixed(docs)
    assert mixed.columns == docs.columns
    assert sum(len(words(r.text)) for r in mixed.collect()) == sum(m.taken for _, m in rows)
    assert mix.planned(nothing).count() == mix.mixed(nothing).count() == 0


def test_substrings(docs, nothing):
    got = pairs(substring_dedup.remove_repeats(docs), "n_words", "n_removed", "kept")
    flags = repeated_word_flags([t for _, t in EDGES], 35)
    expected = Counter()
    for (i, text), gone in zip(EDGES, flags):
        kept = " ".join(w for w, g in zip(words(text), gone) if not g)
        expected[i, len(gone), sum(gone), kept] += 1
    assert got == expected
    assert substring_dedup.remove_repeats(nothing).count() == 0


def test_quality(docs, nothing):
    kept = quality.keep_good(docs)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {9}
    assert quality.keep_good(nothing).count() == 0


def test_licenses(docs, nothing):
    found = docs.select(licenses.scan(F.col("text")).alias("m"))
    assert found.count() == len(EDGES) and found.where("size(m) > 0").count() == 0
    assert nothing.select(licenses.scan(F.col("text"))).count() == 0


def test_jaccard(docs, nothing):
    rows = [(i, t) for i, t in EDGES if i is not None]
    expected = components(rows, 4, 85)
    got = jaccard_join.near_duplicates(docs).collect()
    assert Counter(r.doc_id for r in got) == Counter(i for i, _ in EDGES)
    for r in got:
        assert r.component_id == expected.get(r.doc_id)
    kept = jaccard_join.one_of_each(docs)
    assert kept.columns == docs.columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter(
        i for i, _ in EDGES if i is None or expected[i] == i
    )
    assert jaccard_join.near_duplicates(nothing).count() == 0
    assert jaccard_join.one_of_each(nothing).count() == 0


def test_one_of_each_of_repeated_and_missing_ids(spark):
    prepare(spark)
    some, other = (" ".join(f"{x}{i}" for i in range(60)) for x in "ab")
    rows = [(3, some), (3, some), (3, some.upper()), (5, some + " more"), (3, other)]
    rows += [(None, some), (None, other), (None, "alone w1 w2 w3 w4"), (None, "alone w1 w2 w3 w4")]
    rows += [(4, other), (6, "kept w5 w6 w7 w8"), (6, None), (None, None), (None, "")]
    kept = jaccard_join.one_of_each(clashing(frame(spark, rows))).select("doc_id", "text").collect()
    texts = Counter((r.text or "").lower() for r in kept)
    expected = [some, other, "alone w1 w2 w3 w4", "kept w5 w6 w7 w8", "", "", ""]
    assert Counter(t.replace(" more", "") for t in texts.elements()) == Counter(expected)
    ids = Counter(r.doc_id for r in kept if (r.text or "").startswith(("a", "b", "A")))
    assert ids[None] == 1 and sum(ids.values()) == 3


def test_pages(spark):
    pages = [None, "", "   ", "plain text", "<p>" + "word " * 60_000, "<p>broken <a href='x", "<"]
    df = spark.createDataFrame([(p,) for p in pages], "html string")
    got = [r[0] for r in df.select(html_text.extract(F.col("html"))).collect()]
    assert got[:3] == ["", "", ""] and got[4] == " ".join(["word"] * 60_000)
    assert df.limit(0).select(html_text.extract(F.col("html"))).count() == 0


def test_lines(docs, nothing):
    cleaned = line_dedup.dedup_lines(docs, min_chars=20, min_docs=2)
    assert cleaned.columns == [*docs.columns, "lines_"]
    rows = [(r.doc_id, r.text, r["lines_"]) for r in cleaned.collect()]
    assert len(rows) == len(EDGES)
    for doc_id, text, lines in rows:
        assert lines.n_lines == (text or "").count("\n") + 1
        dropped = doc_id == 7  # its line is that of 8, the larger id
        assert (lines.n_dropped, lines.text) == ((1, "") if dropped else (0, text or ""))
    assert line_dedup.dedup_lines(nothing).count() == 0


def test_digests_are_of_what_is_kept(docs):
    for r in substring_dedup.remove_repeats(docs).collect():
        assert r.kept_sha256 == hashlib.sha256(r.kept.encode()).hexdigest()
