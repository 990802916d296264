"""SentencePiece encoding, ranked search and periodic runs against their definitions."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter
from fractions import Fraction

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tests.llm.cases import ALNUM, EDGES, LOWER, SCHEMA, clashing, frame, words
from tillroll.llm import lexical_search, periodic_runs, piece_codec, queries
from tillroll.llm.session import prepare

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    prepare(spark)
    return clashing(frame(spark, EDGES))


@pytest.fixture(scope="module")
def nothing(spark):
    return clashing(prepare(spark).createDataFrame([], SCHEMA))


@pytest.fixture(scope="module")
def documents():
    return dict(duckdb.sql(f"SELECT doc_id, text FROM '{SF_DIR}/documents.parquet'").fetchall())


# SentencePiece


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=queries.piece_model_path())


@pytest.fixture(scope="module")
def codec():
    return piece_codec.PieceCodec(queries.piece_model_path())


def some_texts(library):
    rng = random.Random(11)
    pieces = [library.id_to_piece(i).replace("▁", " ") for i in range(259, 32_000)]
    plain = "abcdefgh  \n\t.,'ÄéñçёЖ中日aaaeeetttss"

    def any_char():
        low, high = rng.choice([(1, 0x250), (0x600, 0x1000), (0x2000, 0x2600), (0x4E00, 0x9FFF), (0x10000, 0x1FFFF)])
        return chr(rng.randrange(low, high))

    yield from ("".join(rng.choice(pieces) for _ in range(rng.randrange(1, 12))) for _ in range(3_000))
    yield from ("".join(rng.choice(plain) for _ in range(rng.randrange(150))) for _ in range(3_000))
    yield from ("".join(any_char() for _ in range(rng.randrange(60))) for _ in range(1_500))
    yield from ("".join(rng.choice(" ab") for _ in range(rng.randrange(200))) for _ in range(500))
    yield from (" " * rng.randrange(90) + rng.choice(pieces) for _ in range(500))
    yield from ("", " ", "  ", "▁", "▁▁a", "a▁b", "\x00x\x00", "<s>hi</s><unk><0x41>", "⁇", "�")
    yield from ("a" * 3_000, " " * 70_000, "ab" * 5_000, "中文" * 3_000, "long " * 60_000, "\r\n\n")


def test_pieces_as_the_library(library, codec):
    texts = list(some_texts(library))
    got = codec.encode(pa.array(texts))
    want = library.encode(texts, add_bos=True, add_eos=True, num_threads=1)
    assert got.to_pylist() == want
    assert codec.decode(got).to_pylist() == library.decode(want)
    bare = codec.encode(pa.array(texts), ends=False)
    assert bare.to_pylist() == [w[1:-1] for w in want]


@pytest.mark.parametrize("symbols", [0, 10**9])
def test_rounds_and_queue_agree(library, codec, monkeypatch, symbols):
    monkeypatch.setattr(piece_codec, "ROUND_SYMBOLS", symbols)
    codec._forget()
    texts = [t for t in some_texts(library) if len(t) < 1_000][::3]
    want = library.encode(texts, add_bos=True, add_eos=True, num_threads=1)
    assert codec.encode(pa.array(texts)).to_pylist() == want


def test_any_ids_decode_as_the_library(library, codec):
    rng = random.Random(12)
    lists = [
        [rng.choice([rng.randrange(32_000), rng.randrange(259)]) for _ in range(rng.randrange(20))]
        for _ in range(5_000)
    ]
    got = codec.decode(pa.array(lists, type=pa.list_(pa.int32()))).to_pylist()
    assert got == [library.decode(ids) for ids in lists]
    assert codec.decode(pa.array([None, [None]], type=pa.list_(pa.int32()))).to_pylist() == ["", ""]


def test_other_models_are_refused(tmp_path):
    from sentencepiece import sentencepiece_model_pb2 as model_file

    model = model_file.ModelProto()
    with open(queries.piece_model_path(), "rb") as file:
        model.ParseFromString(file.read())
    for change in (
        lambda m: setattr(m.trainer_spec, "model_type", m.trainer_spec.UNIGRAM),
        lambda m: setattr(m.trainer_spec, "byte_fallback", False),
        lambda m: setattr(m.normalizer_spec, "remove_extra_whitespaces", True),
        lambda m: setattr(m.normalizer_spec, "add_dummy_prefix", False),
        lambda m: m.pieces.add(piece="a▁b", score=-5.0),
    ):
        other = model_file.ModelProto()
        other.CopyFrom(model)
        change(other)
        path = tmp_path / "other.model"
        path.write_bytes(other.SerializeToString())
        with pytest.raises(ValueError, match="not a byte-pair model"):
            piece_codec.PieceCodec(str(path))


def test_pieces_of_edge_rows(docs, nothing, library):
    path = queries.piece_model_path()
    ids = docs.withColumn("ids", piece_codec.encode(F.col("text"), path))
    rows = ids.select("doc_id", "text", "ids", piece_codec.decode(F.col("ids"), path).alias("back")).collect()
    assert len(rows) == len(EDGES)
    for r in rows:
        assert r.ids == library.encode(r.text or "", add_bos=True, add_eos=True)
        assert r.back == (r.text or "")
    assert nothing.select(piece_codec.encode(F.col("text"), path)).count() == 0


def test_registered_pieces(spark, documents, library):
    got = {r.doc_id: r for r in queries.op11_sentencepiece(spark, SF_DIR).collect()}
    assert set(got) == set(documents)
    for i, text in documents.items():
        ids = library.encode(text or "", add_bos=True, add_eos=True)
        assert tuple(got[i]) == (
            i,
            len(ids),
            hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest(),
            hashlib.sha256(library.decode(ids).encode()).hexdigest(),
        )


# Ranked search


def ranked(docs, items, k):
    held = [(i, Counter(ALNUM.findall((t or "").translate(LOWER)))) for i, t in docs]
    held = [(i, c) for i, c in held if c]
    n_docs, n_terms = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = []
    for item, text in items:
        scores = []
        for i, c in held:
            m = 100 - 50 + (50 * sum(c.values()) * n_docs) // n_terms
            score = sum(
                math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                * ((10**9 * c[t]) // (1000 * c[t] + 20 * m))
                for t in set(ALNUM.findall((text or "").translate(LOWER)))
                if t in c
            )
            if score > 0:
                scores.append((-score, i is None, i))
        scores.sort(key=lambda s: (s[0], s[1], s[2] or 0))
        out += [(item, n + 1, i, -s) for n, (s, _, i) in enumerate(scores[:k])]
    return Counter(out)


def zipf_texts(rng, n, size=400):
    def word():
        return f"w{int(rng.paretovariate(0.7))}"

    return [" ".join(word() for _ in range(rng.randrange(1, size))) for _ in range(n)]


@pytest.mark.parametrize("query_bytes", [lexical_search.QUERY_BYTES, 500])
def test_search_equals_brute_force(spark, query_bytes, monkeypatch):
    monkeypatch.setattr(lexical_search, "BLOCK_DOCS", 64)
    rng = random.Random(13)
    texts = zipf_texts(rng, 300)
    texts += [texts[0]] * 40 + [texts[1] + " w999999"] * 3  # ties beyond k
    rows = list(enumerate(texts))
    items = [(100 + i, t) for i, t in enumerate(zipf_texts(rng, 8, 30))] + [(200, texts[0][:200])]
    df = spark.createDataFrame(items, "item_id long, text string")
    found = lexical_search.search(frame(prepare(spark), rows), df, 10, query_bytes=query_bytes)
    assert Counter(tuple(r) for r in found.collect()) == ranked(rows, items, 10)


def test_bounds_hold_and_exclude(spark):
    """No bound is below a score, and most documents are excluded by theirs."""
    rng = random.Random(14)
    texts = zipf_texts(rng, 400, 200)
    df = prepare(spark).createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    q = lexical_search.Queries.of(["w900001 w17 w40 w900002", "w5 w123"])
    rows = lexical_search.build_index(df.coalesce(1)).collect()
    assert sorted(i for r in rows for i in r.ids) == list(range(400))
    chunk = next(iter(lexical_search.chunks(pa.array(texts), 1 << 30)))
    text, terms, counts, lengths = lexical_search._term_counts(chunk)
    here, term = q.known(terms)
    q = q.weighted(np.bincount(term, minlength=len(q.terms)), 400, int(lengths.sum()))
    exact = q.scores(term, text[here], counts[here], lengths)
    bound = np.zeros_like(exact)
    for r in rows:
        slices = np.frombuffer(r.slices, dtype=np.uint8).reshape(r.bits, -1)
        bound[:, r.ids] = q.bounds_of(r.bits, np.array(r.lengths), slices)
    assert (bound >= exact).all()
    assert ((bound > 0) & (exact == 0)).mean() < 0.05


def test_search_of_edge_rows(spark, docs, nothing):
    items = [(None, "ONE two"), (7, None), (7, "same text"), (8, "zzz qqq"), (9, "ß w17 long")]
    asked = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit(1))
    for k in (2, 50):
        got = lexical_search.search(docs, asked, k).collect()
        assert Counter(tuple(r) for r in got) == ranked(EDGES, items, k)
    assert lexical_search.search(nothing, asked).count() == 0
    assert lexical_search.search(docs, asked.limit(0)).count() == 0


# Periodic runs


def runs_of(w):
    """All runs, by comparing words at every distance."""
    out = []
    for q in range(1, len(w) // 4 + 1):
        i = 0
        while i + q < len(w):
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            stretch = w[i : j + q]
            smaller = (all(a == b for a, b in zip(stretch, stretch[p:])) for p in range(1, q))
            if len(stretch) >= max(6, 4 * q) and not any(smaller):
                out.append((i, len(stretch), q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def without(w, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


def strongest(runs):
    return min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)


def repeating_texts(n):
    rng = random.Random(15)
    for _ in range(n):
        t = [rng.choice("abcde"[: rng.choice([1, 2, 3, 5])]) for _ in range(rng.randrange(120))]
        for _ in range(rng.randrange(3)):
            p, at = rng.randrange(1, 25), rng.randrange(len(t) + 1)
            unit = [rng.choice("abxyz") for _ in range(p)]
            t[at:at] = (unit * 12)[: rng.randrange(p, 9 * p)]
        yield " ".join(t)


def test_runs_equal_brute_force(spark):
    texts = [*repeating_texts(700), ("a b c a b d " * 9 + "x ") * 7, "a " * 5, "a " * 6, "ab " * 9]
    found = periodic_runs.with_runs(frame(prepare(spark), texts, 5))
    runs = F.col("runs")
    rows = found.select(
        "doc_id", "text", "runs",
        periodic_runs.collapsed(F.col("text"), runs).alias("kept"),
        periodic_runs.strongest(runs).alias("best"),
        periodic_runs.runs_text(runs).alias("listed"),
    ).collect()
    assert len(rows) == len(texts)
    for r in rows:
        w = words(r.text)
        want = runs_of(w)
        assert [tuple(x) for x in r.runs] == want, r.text
        assert r.kept == without(w, want)
        best = r.best and (r.best.start, r.best.length, r.best.period)
        assert best == strongest(want)
        assert r.listed == "".join(f"{a},{b},{c}\n" for a, b, c in want)


def test_long_runs_are_stitched_from_many_tiles(spark, monkeypatch):
    rng = random.Random(16)
    unit = [f"v{rng.randrange(50)}" for _ in range(700)]
    plain = [f"u{i}" for i in range(500)]
    cases = {
        1: ("a " * 20_000, [(0, 20_000, 1)]),
        2: (" ".join(plain + unit * 9 + unit[:13]), [(500, 9 * 700 + 13, 700)]),
        3: (" ".join(plain * 4), [(0, 2_000, 500)]),
        4: (" ".join(plain * 4)[:-1], []),  # one letter short of four periods
        5: ("a b " * 4_000 + "c " * 4_000, [(0, 8_000, 2), (8_000, 4_000, 1)]),
    }
    df = frame(prepare(spark), [(i, t) for i, (t, _) in cases.items()])
    slim = df.selectExpr("doc_id AS id", "xxhash64(text) AS digest", "CAST(octet_length(text) AS BIGINT) AS size", "text")
    # tiles dealt over tasks at random: fragments of a run meet only in the stitching
    dealt = periodic_runs.tiles(slim).repartition(7)
    rows = periodic_runs.runs(periodic_runs.fragments(dealt)).collect()
    for i, (_, want) in cases.items():
        assert sorted((r.start, r.length, r.period) for r in rows if r.id == i) == want


def test_runs_of_edge_rows(docs, nothing):
    found = periodic_runs.with_runs(docs)
    assert found.columns == [*docs.columns, "runs"]
    rows = found.select("doc_id", "text", "runs").collect()
    assert Counter((r.doc_id, r.text) for r in rows) == Counter(EDGES)
    for r in rows:
        n = len(words(r.text))
        want = [(0, n, 1)] if r.doc_id == 6 else runs_of(words(r.text))
        assert [tuple(x) for x in r.runs] == want
    assert periodic_runs.with_runs(nothing).count() == 0
    again = periodic_runs.with_runs(found.withColumn("text", F.reverse("text")))
    assert again.columns == [*found.columns, "runs_"] and again.count() == len(EDGES)


def test_registered_runs(spark, documents):
    got = {r.doc_id: r for r in queries.op13_periodic_runs(spark, SF_DIR).collect()}
    assert set(got) == set(documents)
    made = 0
    for i, text in documents.items():
        w, h = words(text), zlib.crc32(str(i).encode())
        n, g = len(w), h // 10
        if h % 10 == 0 and n > 0:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[j] if j < a else w[a + (j - a) % p] for j in range(n)]
            made += 1
        r = got[i]
        if h % 10 and n > 1_500:  # only what differs from the rest is compared in full
            assert r.n_runs == 0 or r.length >= 4 * r.period
            continue
        runs = runs_of(w)
        best = strongest(runs)
        assert r.n_runs == len(runs)
        assert (r.start, r.length, r.period) == (best or (None,) * 3)
        assert r.exponent_milli == (1000 * best[1] // best[2] if best else None)
        lines = "".join(f"{x},{y},{z}\n" for x, y, z in runs)
        assert r.runs_sha256 == hashlib.sha256(lines.encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(without(w, runs).encode()).hexdigest()
    assert made > 5


def test_words_match_the_contract():
    text = "a b \x1cc\td\x0be"
    assert words(text) == re.findall(r"[^\x20\x09-\x0D]+", text)
