"""Every registered corpus query: against its SQL, or its definition, on the small tables."""

from __future__ import annotations

import os
import zlib

import duckdb
import numpy as np
import pytest

import __spark_entry__ as entry_module
from tests.llm.cases import words
from tillroll.llm import html_text, licenses, queries

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in ("documents", "benchmark", "pages", "labels"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF_DIR}/{name}.parquet'")
    return con


@pytest.fixture(scope="module")
def documents(duck):
    found = duck.execute("SELECT doc_id, text, lang FROM documents").fetchall()
    return {i: (text, lang) for i, text, lang in found}


def test_all_are_registered():
    names = {name.split("_")[0] for name in queries.QUERIES}
    assert names == {f"op{n}" for n in range(1, 14)}
    assert set(queries.QUERIES) | {"pipeline"} <= set(entry_module.queries())


@pytest.mark.parametrize("name", list(queries.SQL))
def test_matches_sql(spark, duck, name):
    df = queries.QUERIES[name](spark, SF_DIR)
    cursor = duck.execute(queries.SQL[name])
    columns = [d[0] for d in cursor.description]
    order = sorted(df.columns)
    assert order == sorted(columns)
    expected = [dict(zip(columns, row)) for row in cursor.fetchall()]
    got = sorted(repr([row[c] for c in order]) for row in df.collect())
    assert got == sorted(repr([row[c] for c in order]) for row in expected)
    assert got


def test_token_files_against_the_tokenizer(spark, documents):
    from tokenizers import Tokenizer

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    tokenizer = Tokenizer.from_file(queries.tokenizer_path())
    got = {r.doc_id: r for r in queries.op1_token_files(spark, SF_DIR).collect()}
    assert set(got) == set(documents)
    start = 0
    for i in sorted(documents):
        ids = tokenizer.encode(documents[i][0] or "", add_special_tokens=False).ids + [1]
        packed = np.array(ids, dtype="<u4").tobytes()
        assert tuple(got[i]) == (i, start, len(ids), zlib.crc32(packed))
        start += len(ids)


def test_language_on_held_out_documents(spark, documents):
    rows = queries.op3_language_id(spark, SF_DIR).collect()
    assert len(rows) == len(documents)
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert 0 <= r.score <= 1
    held_out = [r for r in rows if r.held_out]
    right = sum(r.lang_pred == documents[r.doc_id][1] for r in held_out)
    assert right >= 0.95 * len(held_out) > 20


def test_licenses_against_plain_containment(spark, documents):
    lines = {
        "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
        "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
        "MIT": "Released under the MIT License.",
        "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    }
    assert all((k, v) in licenses.TEMPLATES for k, v in lines.items())
    for r in queries.op7_license_scan(spark, SF_DIR).collect():
        text = documents[r.doc_id][0] or ""
        assert r.licenses == ",".join(sorted(k for k, v in lines.items() if v in text))


def test_main_text_of_the_pages(spark, duck):
    import html
    import re

    pages = dict(duck.execute("SELECT page_id, html FROM pages").fetchall())
    for r in queries.op9_html_extraction(spark, SF_DIR).collect():
        (article,) = re.findall(r"<article>(.*)</article>", pages[r.page_id], re.S)
        article = re.sub(r"</?b>", "", article).replace("<br>", " ")
        blocks = [" ".join(html.unescape(b).split()) for b in re.split(r"</?(?:p|h1)>", article)]
        assert r.text == "\n".join(b for b in blocks if b) == html_text.main_text(pages[r.page_id])
        assert r.n_chars == len(r.text)


def test_quality_rules_reject_junk_and_keep_the_rest(spark, duck, documents):
    good = dict(duck.execute("SELECT doc_id, quality FROM labels").fetchall())
    kept = {r.doc_id: r.kept for r in queries.op6_quality_rules(spark, SF_DIR).collect()}
    for i, quality in good.items():
        if len(words(documents[i][0])) >= 20:
            assert kept[i] == bool(quality), documents[i][0][:200]
