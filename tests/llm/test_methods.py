"""The operators against brute force on harder fixtures: skew, ties, thresholds, parameters."""

from __future__ import annotations

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tests.llm.cases import components, frame, invented, repeated_word_flags, words
from tillroll.llm import components as graph
from tillroll.llm import html_text, jaccard_join, language_id, licenses, line_dedup, mix, quality
from tillroll.llm import queries, substring_dedup, token_files
from tillroll.llm.exchange import Deal
from tillroll.llm.session import prepare
from tillroll.session import scratch_path


@pytest.fixture(scope="module", autouse=True)
def prepared(spark):
    return prepare(spark)


def near_copies(rng, base, n, changes):
    out = []
    for _ in range(n):
        copy = list(base)
        for _ in range(rng.randrange(changes + 1)):
            copy[rng.randrange(len(copy))] = f"x{rng.randrange(10**6)}"
        out.append(" ".join(copy))
    return out


def corpus(rng):
    """A third near copies of one text, families of others, shared passages, short texts."""
    texts = near_copies(rng, invented(rng, 120), 60, 4)
    for size in (6, 7, 9, 10, 13, 20, 34, 60, 150, 400):
        base = invented(rng, size)
        texts += near_copies(rng, base, 4, max(1, size // 40))
        texts += [" ".join([*base, *invented(rng, k)]) for k in (1, 2, size // 8 + 1)]
        texts += [" ".join(base[: -size // 10 or None]), " ".join(base).upper()]
    passage = invented(rng, 40)
    texts += [" ".join([*invented(rng, 30), *passage, *invented(rng, 20)]) for _ in range(30)]
    texts += ["a b c d", "a b c d", "A B C D", "a b c", "a", "", None]
    rng.shuffle(texts)
    return texts


@pytest.mark.parametrize("max_group", [512, 8])
@pytest.mark.parametrize("ngram,percent", [(4, 85), (5, 80)])
def test_jaccard_components(spark, monkeypatch, max_group, ngram, percent):
    monkeypatch.setattr(jaccard_join, "MAX_GROUP", max_group)
    monkeypatch.setattr(jaccard_join, "MAX_FAMILY", 2_048 if max_group > 8 else 3)
    monkeypatch.setattr(jaccard_join, "KEY_BYTES", 64 << 20 if max_group > 8 else 6_000)
    texts = corpus(random.Random(max_group + ngram))
    how = jaccard_join.Similarity(ngram, percent)
    got = jaccard_join.near_duplicates(frame(spark, texts), how).collect()
    expected = components(enumerate(texts), ngram, percent)
    assert {r.doc_id: r.component_id for r in got} == expected
    assert len(set(expected.values())) < len(texts) - 60


LONG = "words of a paragraph that goes on for long enough to count as text " * 2
KEPT = [
    f'<form id="aspnetForm"><div><p>{LONG}</p><p>{LONG}</p></div></form>',
    f"<form><main><h1>Title</h1><p>{LONG}</p></main></form>",
    f'<main><h2 id="related">Related work</h2><p>{LONG}</p></main>',
    f'<main><p>{LONG}</p><section id="legal"><p>{LONG}</p></section></main>',
    f'<main><p>{LONG}</p><div class="market-share"><p>{LONG}</p></div></main>',
    f'<main><p>{LONG}</p><p class="notice">Short</p></main>',
    f'<main><p>{LONG}</p><figure class="widget"><figcaption>Short</figcaption></figure></main>',
    "<main><p>Press <button>OK</button> to go on.</p></main>",
    "<p>One short paragraph.</p>",
]


@pytest.mark.parametrize("page", KEPT)
def test_text_is_kept_whatever_it_is_named(page):
    plain = re.sub("</(p|h1|h2|figcaption)>", "\n", page)
    lines = [" ".join(line.split()) for line in re.sub("<[^>]*>", "", plain).split("\n")]
    assert html_text.main_text(page).split("\n") == [line for line in lines if line]


@pytest.mark.parametrize(
    "part",
    [
        "<form><p>Subscribe to our letters now</p><input></form>",
        '<p class="ad">Buy now</p>', '<div class="social-share">Tell others</div>',
        '<div class="page-footer">All rights reserved</div>', "<button>Share</button>",
        f'<div class="cookie-notice"><p>{LONG}</p></div>', f'<div id="comments"><p>{LONG}</p></div>',
        "<fieldset><legend>Search</legend><p>Your words</p></fieldset>",
    ],
)
def test_parts_around_the_text_are_dropped(part):
    text = LONG.strip()
    assert html_text.main_text(f"<main><p>{LONG}</p>{part}<p>{LONG}</p></main>") == f"{text}\n{text}"


def test_segment_keys_meet_for_every_close_pair():
    rng = np.random.default_rng(1)
    for n in (6, 7, 11, 12, 16, 31, 63, 64, 200, 511, 700, 3000):
        for _ in range(40):
            a = np.unique(rng.integers(1, 2**63, n, dtype=np.uint64))
            differing = int(0.17 * n)
            gone = rng.integers(0, differing + 1)
            b = np.concatenate([a[gone:], rng.integers(1, 2**63, differing - gone, dtype=np.uint64)])
            b = np.unique(b)
            shared = len(np.intersect1d(a, b))
            if 100 * shared < 85 * (len(a) + len(b) - shared) or len(a) == shared == len(b):
                continue
            bounds = np.array([0, len(a), len(a) + len(b)])
            keys, owner = jaccard_join.segment_keys(np.concatenate([a, b]), bounds, 85)
            assert set(keys[owner == 0]) & set(keys[owner == 1]), n


def occupied(balls: int, cells: int) -> list[float]:
    """Chance that so many cells are hit, by inclusion and exclusion in whole numbers."""
    return [
        math.comb(cells, u) * sum((-1) ** j * math.comb(u, j) * (u - j) ** balls for j in range(u + 1))
        / cells**balls
        for u in range(cells + 1)
    ]


def lost_exactly(shared: int, differing: int, segments: int) -> float:
    chances = occupied(differing, segments)
    return sum(p * (u / segments) ** shared for u, p in enumerate(chances))


def test_lost_is_the_occupancy_distribution():
    for shared, differing, segments in ((6, 1, 5), (28, 4, 20), (109, 19, 20), (185, 32, 39)):
        exact = lost_exactly(shared, differing, segments)
        pair = np.array([shared]), np.array([differing])
        assert jaccard_join.lost(*pair, segments) == pytest.approx(exact, rel=1e-9)
        assert jaccard_join.lost(*pair, segments, exact=False) >= exact


@pytest.mark.parametrize("percent", [85, 80])
def test_pairs_at_the_threshold_are_not_lost(percent):
    how = jaccard_join.Similarity(percent=percent)
    for octave in range(2, 9):
        segments, times = jaccard_join.scheme(octave, percent)
        for larger in {1 << octave, (3 << octave) // 2, (2 << octave) - 1}:
            smaller = how.least_shared(larger)  # nested
            inside = (smaller, larger - smaller)
            shared = -(-2 * percent * larger // (100 + percent))  # equal sizes
            for s, d in (inside, (shared, 2 * (larger - shared))):
                if d:
                    assert lost_exactly(s, d, segments) ** times <= jaccard_join.LOST, (larger, d)
    for octave in (10, 11, 12):  # beyond the exact recurrence
        segments, times = jaccard_join.scheme(octave, percent)
        pairs = jaccard_join.closest_pairs(octave, percent)
        assert jaccard_join.lost(*pairs, segments) ** times <= jaccard_join.LOST


def test_components_of_chains_and_stars(spark):
    rng = random.Random(5)
    edges = [(i, i + 1) for i in range(100, 140)] + [(7, i) for i in range(200, 260)]
    edges += [(300, 300), (2, 1), (1, 2), (139, 7)]
    rng.shuffle(edges)
    parent = {x: x for e in edges for x in e}
    for _ in parent:
        for u, v in edges:
            parent[u] = parent[v] = min(parent[u], parent[v])
    found = graph.components(spark.createDataFrame(edges, "u long, v long")).collect()
    assert {r.node: r.component for r in found} == {k: v for k, v in parent.items() if k != 300}
    assert graph.components(spark.createDataFrame([], "u long, v long")).count() == 0


@pytest.mark.parametrize("groups,ranges", [(1, 1), (5, 3)])
def test_repeated_windows(spark, monkeypatch, groups, ranges):
    monkeypatch.setattr(Deal, "by_size", staticmethod(lambda *a, **k: Deal(groups, ranges)))
    rng = random.Random(groups)
    passage, hot = invented(rng, 60), invented(rng, 35)
    texts: list[str | None] = [" ".join(hot)] * 20 + [None, "", "one two"]
    for i in range(60):
        text = invented(rng, rng.randrange(20, 90), 40 if i % 9 == 0 else 5_000)
        at, length = rng.randrange(len(text)), rng.randrange(30, 40)
        start = rng.randrange(0, 60 - length + 1)
        text[at:at] = passage[start : start + length]
        texts.append((" " if i % 2 else "\n").join(text))
    texts.append(" ".join(["again"] * 100))
    got = {r.doc_id: r for r in substring_dedup.remove_repeats(frame(spark, texts)).collect()}
    for i, gone in enumerate(repeated_word_flags(texts, 35)):
        kept = [w for w, g in zip(words(texts[i]), gone) if not g]
        assert (got[i].n_words, got[i].n_removed) == (len(gone), sum(gone)), i
        assert got[i].kept == " ".join(kept)


def test_cover_has_every_difference():
    period, cover = substring_dedup.PERIOD, substring_dedup.COVER
    assert {(a - b) % period for a in cover for b in cover} == set(range(period))


@pytest.mark.parametrize("bits", [1 << 20, 64])
def test_lines_whatever_the_filter_lets_through(spark, bits):
    rng = random.Random(bits)
    pool = [f"line number {i} of a pool, é" for i in range(30)] + ["short", "", "  spaced out line here  "]
    docs = [(i, "\n".join(rng.choice(pool) + " " * (i % 2) for _ in range(rng.randrange(1, 9)))) for i in range(80)]
    docs += [(100 + i, "The HOT line of a third of all documents") for i in range(40)] + [(200, None)]
    holders = defaultdict(set)
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").lower()
    for i, text in docs:
        for line in (text or "").split("\n"):
            holders[key(line)].add(i)
    last = {k: max(v) for k, v in holders.items() if len(k) >= 20 and len(v) >= 3}
    got = line_dedup.dedup_lines(frame(spark, docs), bits=bits).collect()
    for r in got:
        kept = [x for x in (r.text or "").split("\n") if last.get(key(x), r.doc_id) == r.doc_id]
        assert r.lines.text == "\n".join(kept)
        assert r.lines.n_lines - r.lines.n_dropped == len(kept) or not kept
    assert len(got) == len(docs)


def filled(sizes: dict, weights, share, most):
    """Targets by rounds: whatever is above its cap is shared again by weight."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    target = dict.fromkeys(sizes, 0.0)
    left = share * sum(sizes.values())
    while left > 1e-9 and (open_ := [s for s in sizes if target[s] < most * sizes[s] - 1e-9]):
        total = sum(weight[s] for s in open_)
        for s in open_:
            target[s] += left * weight[s] / total
        left = 0.0
        for s in sizes:
            left += max(0.0, target[s] - most * sizes[s])
            target[s] = min(target[s], most * sizes[s])
    return target


@pytest.mark.parametrize("seed", [1, 2])
def test_mix(spark, seed):
    rng = random.Random(seed)
    names = ["b", "a", "Z", "é", None, "hot", ""] if seed == 1 else [f"s{i}" for i in range(25)]
    docs = []
    for i in range(400):
        source = "hot" if seed == 1 and i % 3 == 0 else rng.choice(names)
        n = 0 if i % 50 == 0 else rng.randrange(1, 200)
        docs.append((i, " ".join(invented(rng, n)) if n else rng.choice([None, "", " \n"]), source))
    sizes = Counter()
    for _, text, source in docs:
        sizes[source] += len(words(text))
    expected = filled(sizes, (3, 1, 2), 1.5, 2.0)
    runs = []
    for partitions in (1, 7):
        found = mix.planned(frame(spark, docs, partitions))
        runs.append(sorted((r.doc_id, r.mix) for r in found.select("doc_id", "mix").collect()))
        taken = Counter()
        for r in found.collect():
            assert r.mix.source_size == sizes[r.source]
            assert r.mix.target == pytest.approx(expected[r.source])
            assert 0 <= r.mix.taken <= 2 * r.mix.size == 2 * len(words(r.text))
            taken[r.source] += r.mix.taken
        for source, target in expected.items():
            assert abs(taken[source] - target) <= 0.5 + 1e-9
    assert runs[0] == runs[1]
    rows = mix.mixed(frame(spark, docs)).collect()
    got = Counter()
    for r in rows:
        got[r.doc_id] += len(words(r.text))
    assert got == Counter({i: m.taken for i, m in runs[0] if m.taken})


def test_language_filter_counts_are_corrected():
    """A filter with many n-grams answers some it never saw; the correction takes them off."""
    rng = np.random.default_rng(3)
    table = np.zeros(language_id.TABLE_ROWS, dtype=np.uint64)
    for bit, n in ((0, 400_000), (1, 2_000)):
        for rows in language_id._rows(rng.integers(1, 2**63, n, dtype=np.uint64), len(table)):
            table[rows] |= np.uint64(1 << bit)
    model = language_id.Model(["full", "small"], [table])
    assert model.false[0] > 0.5 > 1e-5 > model.false[1]
    unseen = " ".join("".join(chr(c) for c in rng.integers(0x4E00, 0x9000, 6)) for _ in range(400))
    total = len(language_id.grams([unseen])[0])
    (mask,) = model.masks(language_id.grams([unseen])[0])
    assert (mask & np.uint64(1)).sum() > 0.4 * total
    corrected = (mask & np.uint64(1)).sum() - total * model.false[0]
    assert abs(corrected) < 0.05 * total


def test_more_than_64_languages(spark):
    rng = random.Random(2)
    rows = []
    for i in range(70):
        letters = [chr(0x100 + 3 * i + j) for j in range(3)]
        for j in range(3):
            text = " ".join("".join(rng.choices(letters, k=5)) for _ in range(60))
            rows.append((10 * i + j, text, f"l{i:02}"))
    df = spark.createDataFrame(rows, "id long, text string, lang string")
    model = language_id.train(df.where("id % 10 < 2"))
    assert len(model.languages) == 70 and len(model.tables) == 2
    held_out = df.where("id % 10 = 2").withColumn("p", language_id.predictor(spark, model)(F.col("text")))
    assert all(r.p.lang == r.lang for r in held_out.collect())


def test_licenses_in_noise():
    rng = random.Random(4)
    library = licenses.build_library(licenses.TEMPLATES)
    texts, expected = [], []
    for i in range(150):
        name, notice = licenses.TEMPLATES[i % len(licenses.TEMPLATES)]
        copy = notice.split()
        for _ in range(len(copy) // 60):
            copy[rng.randrange(len(copy))] = "another"
        text = [*invented(rng, rng.randrange(300)), *copy, *invented(rng, rng.randrange(300))]
        texts.append(" ".join(text))
        expected.append(name)
    texts += [" ".join(invented(rng, 400)) for _ in range(50)]
    found = licenses._scan(pa.array(texts), library, licenses.MIN_SHARE).to_pylist()
    plain = []
    for text in texts:
        lowered = [w.lower() for w in text.split()]
        plain.append(lowered)
    for i, name in enumerate(expected):
        names = {m["license"]: m for m in found[i]}
        assert name in names, texts[i]
        assert names[name]["share"] >= licenses.MIN_SHARE
    assert not any(found[150:])
    for level in library.levels:
        window = level.stride * level.blocks
        for i in level.templates:
            near = licenses.least_similarity(len(library.shingles[i]), window)
            assert (1 - near) ** len(level.minima) <= licenses.MISSED


def found_licenses(*texts: str) -> list[list[str]]:
    library = licenses.build_library(licenses.TEMPLATES)
    found = licenses._scan(pa.array(texts), library, licenses.MIN_SHARE).to_pylist()
    return [[m["license"] for m in matches] for matches in found]


def test_every_template_is_its_own_license_only():
    rng = random.Random(8)
    texts = [
        " ".join([*invented(rng, 40), text, *invented(rng, 40)]) for _, text in licenses.TEMPLATES
    ]
    assert found_licenses(*texts) == [[name] for name, _ in licenses.TEMPLATES]


def test_licenses_of_the_same_wording():
    notices = dict(licenses.NOTICES)
    gpl, lgpl = notices["GPL-3.0"], notices["LGPL-2.1"]
    bsd = licenses.whole_text("BSD-3-Clause").replace("copyright holder nor", "University nor")
    filler = " ".join(invented(random.Random(9), 60))
    cases = {
        gpl.replace("version 3", "version 4"): [],
        notices["GPL-2.0"].replace("program", "library"): ["GPL-2.0"],
        lgpl.replace("version 2.1", "version 7"): [],
        f"{gpl} {filler} {notices['AGPL-3.0']}": ["AGPL-3.0", "GPL-3.0"],
        f"{gpl} {notices['GPL-2.0']}": ["GPL-2.0", "GPL-3.0"],
        bsd: ["BSD-3-Clause"],
        f"{licenses.whole_text('BSD-2-Clause')} {filler} {bsd}": ["BSD-2-Clause", "BSD-3-Clause"],
        f"{licenses.whole_text('GPL-3.0')} {licenses.whole_text('MIT')}": ["GPL-3.0", "MIT"],
        f"{licenses.whole_text('Apache-2.0')[:9_500]}": ["Apache-2.0"],
    }
    assert found_licenses(*cases) == list(cases.values())


def test_quality_figures(spark):
    rng = random.Random(6)
    texts = [" ".join(invented(rng, n) * (200 // n)) for n in (1, 4, 9, 30, 90)]
    texts += [" ".join(invented(rng, 200)), "\n".join(["the same line of a few words"] * 12), "# $ % | < > & * " * 10]
    texts += [" ".join([*invented(rng, 100), *(w := invented(rng, 30)), *invented(rng, 50), *w])]
    df = frame(spark, texts).select("text", quality.figures(F.col("text")).alias("q"))
    kept = {}
    for r in df.collect():
        w = words(r.text)
        flags = {}
        for n in (5, 6, 8, 10):
            seen = Counter(tuple(w[i : i + n]) for i in range(len(w) - n + 1))
            gone = [False] * len(w)
            for i in range(len(w) - n + 1):
                if seen[tuple(w[i : i + n])] > 1:
                    gone[i : i + n] = [True] * n
            flags[n] = gone
        chars = [sum(len(x) for x, g in zip(w, flags[n]) if g) for n in (5, 6, 8, 10)]
        assert (r.q.n_words, r.q.n_repeat_words) == (len(w), sum(flags[8]))
        assert r.q.ngram_chars == chars
        assert r.q.word_chars == sum(map(len, w))
        assert r.q.n_symbols == sum(c in "#*$%&|<>" for c in r.text)
        kept[r.text] = r.q.kept
    assert [kept[t] for t in texts] == [False] * 5 + [True, False, False, True]


PAGES = {
    "<main><h1>T</h1><p>one &amp; two&nbsp;three<p>four</main>": "T\none & two three\nfour",
    "<body><nav><a href=/>Home</a></nav><article><p>A <b>b</b><br>c <a href=x>d</a> e f</article>"
    "<div class='comments'><article><p>nice text by a reader, long enough to look like one</article></div>"
    "<footer>&copy; x</footer>": "A b c d e f",
    "<article><p>x</p><form><label>mail</label><input></form><script>var a='<p>no</p>'</script>"
    "<div class=\"adBox promo\">buy this now</div><p>y</p></article>": "x\ny",
    "<header><p>site</p></header><div id=content>" + "<p>" + "word " * 60 + "</p><p>end of it</p></div>"
    "<div class=sidebar><p>" + "other " * 30 + "</p></div>": " ".join(["word"] * 60) + "\nend of it",
    "<article><ul><li><a href=1>one two</a><li><a href=2>three four</a><li><a href=3>five</a></ul>"
    "<p>The text itself.</article><aside>see also</aside>": "The text itself.",
    "<article><p>cut &am": "cut &am",
    "<article><p>a<!-- <p>hidden</p> -->b</p><p style='display: none'>c</p><!-- open": "ab",
    "<div class='cookie-notice'>We use cookies and many words to say so, as every site does today,"
    " please accept them all</div><article><p>Short.</p></article>": "Short.",
}


WRAPPED = {
    **{
        f"<nav>Home</nav><div {mark}><{main}><h1>T</h1><p>The text.</p></{main}></div>": "T\nThe text."
        for mark in (
            "class='content-sidebar-wrap'", "id=page class=no-sidebar", "class=has-banner",
            "class='article-with-comments'", "class='noSidebar'", "class='sidebar'", "id=overlay",
        )
        for main in ("main", "article")
    },
    "<article><div class=entry-header><h1>Title</h1></div><div class=legal-analysis><p>a</p></div>"
    "<div class='notice-period'>b</div></article>": "Title\na\nb",
    "<article><p>x</p><div class='ad-slot'>buy</div><div class=shareButtons>tell</div>"
    "<div id='cookie-notice'>ok</div><div class='site-banner'>hey</div><p>y</article>": "x\ny",
    "<article><p>x</article><div class=related><article><p>other</article></div>": "x",
    "<div class=overlay><div class=comments><article>me too</article></div><main>x</main></div>": "x",
    "<div class=overlay><article>x<div class=comments><article>me too</article></div>": "x",
    "<div class=overlay hidden><main>gone</main></div><main>x</main>": "x",
    "<div id=page class=has-banner><div class=content><p>" + "word " * 60 + "</p></div></div>":
        " ".join(["word"] * 60),
}


def test_names_of_wrappers_lose_no_text():
    for page, text in WRAPPED.items():
        assert html_text.main_text(page) == text, page


VALID = {
    "<html><head><title>x</title><meta name=a><body><article><p>The text.": "The text.",
    "<head><script>1</script><link rel=a><article><p>The text.</article>": "The text.",
    "<head><title>x</title><b>So</b> " + "word " * 60 + "<p>and more": "So " + " ".join(["word"] * 60) + "\nand more",
    "<head><title>x</title></head><body><main>a</main>": "a",
    "<article><p>a <svg viewBox='0 0 1 1' class=\"a>b\"/> b</p><p>c</p></article>": "a b\nc",
    "<article><p>a<svg><path/><text>icon</text></svg> b</p><p>c</article>": "a b\nc",
    "<article><p>so <math><mi>x</mi><mo>=</mo><msup><mi>y</mi><mn>2</mn></msup></math> holds</article>":
        "so x=y2 holds",
    "<article><p>a <math/>b<math><semantics><mi>x</mi><annotation>\\x</annotation></semantics></math>"
    "<p>c</article>": "a bx\nc",
    "<article><p>see <object data=a.pdf><param name=p>the <b>file</b></object> here</article>":
        "see the file here",
    "<article><title-card>a</title-card><p>b</article>": "a\nb",
}


def test_valid_pages_lose_no_text():
    for page, text in VALID.items():
        assert html_text.main_text(page) == text, page


def test_main_text():
    for page, text in PAGES.items():
        assert html_text.main_text(page) == text, page


def test_the_tree_knows_its_table():
    tree = html_text.block_tree()
    for row in html_text.LABELLED:
        assert html_text.is_content(tree, row[:-1]) == row[-1]


def test_words_are_encoded_as_texts():
    ids = token_files._word_ids(queries.tokenizer_path())
    rng = random.Random(9)
    letters = "abAZéÉßΣσİı' .,!#$<|>_-09²½Ⅷ̣̃́HhÅ가가\x85\x1c\t\r\x0b中文字\U0001f600\nﬁ"
    texts = ["<|endoftext|>", "a<|startoftext|>b they'll 'S", "x" * 500, "İ'", "H̱ Å"]
    texts += ["".join(rng.choices(letters, k=rng.randrange(15))) for _ in range(3_000)]
    for text in texts:
        plain = ids.tokenizer.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(ids.encode(text), dtype="<i4").tolist() == plain, text


def test_letters_that_normalization_changes():
    """Every such letter before and after every punctuation sign, and in a word."""
    import unicodedata
    from string import punctuation

    ids = token_files._word_ids(queries.tokenizer_path())
    letters = [c for c in map(chr, range(0x110000)) if c.isalpha() and not unicodedata.is_normalized("NFC", c)]
    assert len(letters) > 1_000
    words = [w for c in letters for p in punctuation for w in (c + p, p + c)]
    words += [w for c in letters for w in (f"a{c}b,", f"\u09ac{c}.", c * 2 + "-", "x" * 70 + c + "!")]
    ids.clear()
    plain = ids.tokenizer.encode_batch(words, add_special_tokens=False)
    for word, want in zip(words, plain):
        assert np.frombuffer(ids.encode(word), dtype="<i4").tolist() == want.ids, ascii(word)


def test_tokenizers_of_another_kind_are_refused(spark):
    import public_tokenizers

    token_files.refuse_others(queries.tokenizer_path())
    files = token_files.TokenFiles(scratch_path(spark, "refused"))
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    with pytest.raises(ValueError, match="not a lower-casing"):
        token_files.write_tokens(docs, public_tokenizers.path("byte_bpe_50k.json"), files)


def test_token_files_are_sorted_and_pruned(spark):
    files = token_files.TokenFiles(scratch_path(spark, "pruned"), stride=1_000)
    docs = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit("a b").alias("text"))
    token_files.write_tokens(docs.repartition(6), queries.tokenizer_path(), files)
    one = token_files.read_tokens(spark, files).where("doc_id = 12345")
    (row,) = one.collect()
    assert (row.start, row.n_tokens) == (12_345 * 3, 3)
    rows = spark.read.schema(token_files.ROWS_SQL).orc(files.rows_path).where("doc_id = 12345")
    assert len(rows.collect()) == 1
    scan = rows._jdf.queryExecution().executedPlan().collectLeaves().head()
    # whole batches of the row groups that can hold it, of all 20,000 rows
    assert 0 < scan.metrics().apply("numOutputRows").value() <= 4_096
    manifest = spark.read.parquet(files.manifest_path).orderBy("part").collect()
    for a, b in zip(manifest, manifest[1:]):
        assert a.last_doc < b.first_doc and a.start + a.n_tokens == b.start
