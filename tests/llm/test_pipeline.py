"""The pipeline's stages against brute force, each on its own input."""

from __future__ import annotations

import pytest

import corpus_pipeline
from tests.llm.cases import ALNUM, LOWER, components, words
from tillroll.llm.session import written

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    """Input and output rows of each stage, by its name."""
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    found = {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs.collect()
        docs = written(stage(spark, docs, SF_DIR), "tested")
        found[name] = (before, docs.collect(), docs.columns)
    return found


def test_stages_keep_the_columns(spark, stages):
    columns = spark.read.parquet(f"{SF_DIR}/documents.parquet").columns
    names = list(stages)
    assert all(stages[n][2] == columns for n in names[:-1])
    assert stages[names[-1]][2] == ["doc_id", "start", "n_tokens", "ids_crc32"]


def test_quality_rules_drop_what_the_base_rules_drop(stages):
    before, after, _ = stages["quality rules"]
    kept = {r.doc_id for r in after}
    assert all(len(words(r.text)) >= 20 for r in after)
    assert 0.8 * len(before) < len(kept) < len(before)
    assert {tuple(r) for r in after} <= {tuple(r) for r in before}


def test_one_document_of_each_component_stays(stages):
    before, after, _ = stages["n-gram Jaccard join"]
    expected = components([(r.doc_id, r.text) for r in before], 5, 80)
    assert sorted(r.doc_id for r in after) == sorted(set(expected.values()))


def test_contaminated_documents_go(spark, stages):
    before, after, _ = stages["benchmark decontamination"]
    windows = set()
    for r in spark.read.parquet(f"{SF_DIR}/benchmark.parquet").collect():
        w = ALNUM.findall((r.text or "").translate(LOWER))
        n = min(13, len(w))
        windows |= {tuple(w[i : i + n]) for i in range(len(w) - n + 1) if n}
    lengths = {len(w) for w in windows}
    clean = []
    for r in before:
        w = ALNUM.findall((r.text or "").translate(LOWER))
        hit = set()
        for n in lengths:
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in windows:
                    hit.update(range(i, i + n))
        if not hit or 20 * len(hit) < len(w):
            clean.append(r.doc_id)
    assert sorted(r.doc_id for r in after) == sorted(clean) != sorted(r.doc_id for r in before)


def test_mix_takes_the_budgets(stages):
    before, after, _ = stages["mixing sources to target weights"]
    total = sum(len(words(r.text)) for r in before)
    taken = sum(len(words(r.text)) for r in after)
    assert abs(taken - 1.5 * total) <= len({r.source for r in before})
    texts = {r.doc_id: r.text for r in before}
    whole = [r for r in after if r.text == texts[r.doc_id]]
    assert len(after) - len(whole) <= len({r.source for r in before})
    assert all(texts[r.doc_id].startswith(r.text) for r in after)


def test_tokens_of_the_mix(spark, stages):
    before, after, _ = stages["token-ID / binary output"]
    assert sorted(r.doc_id for r in before) == sorted(r.doc_id for r in after)
    end = 0
    for r in sorted(after, key=lambda r: r.start):
        assert r.start == end
        end += r.n_tokens
    run = corpus_pipeline.run(spark, SF_DIR).collect()
    assert sorted(map(tuple, run)) == sorted(map(tuple, after))
