"""Each corpus operator against a plain version of what it computes, and on odd inputs."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from sightline.llm import embeddings, language_id, mixing, packing, quality_classifier, quality_rules, queries, simhash, suffix_dedup, token_rollup, url_filter
from sightline.llm.common import Scratch
from sightline.llm.components import components

DOCS = "doc_id bigint, text string, lang string, source string, kept string"
ODD = [None, "", " \n\t ", "one", "two words", "a" * 3000, "x y z " * 500, "Ünï cødé 日本 текст", "the same text twice over here", "the same text twice over here"]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(k, t, "en" if k % 2 else None, None if k == 4 else f"s{k % 2}", "c") for k, t in enumerate(ODD)]
    return spark.createDataFrame([*rows, rows[8], (None, "no id", "en", "s1", "c")], DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def test_empty_tables(spark, empty):
    vectors = spark.createDataFrame([], "vec_id bigint, embedding array<float>, label int")
    pages = spark.createDataFrame([], "page_id bigint, url string, html string")
    assert embeddings.near_duplicates(vectors).count() == 0
    space = quality_classifier.fit(empty, spark.createDataFrame([], "doc_id bigint, quality int"))
    assert quality_classifier.score(empty, space).count() == 0
    assert url_filter.judge(pages, url_filter.bad_urls(pages), queries.URL_RULES).count() == 0
    assert suffix_dedup.remove_repeats(empty).count() == 0
    assert simhash.near_duplicates(empty).count() == 0
    assert language_id.identify(empty, language_id.learn(empty)).count() == 0
    assert quality_rules.judge(empty).count() == 0
    assert packing.pack(empty, queries.tokenizer_path()).count() == 0
    assert mixing.mix(empty).count() == 0


def test_components(spark):
    edges = [(k, k + 1) for k in range(1, 40)] + [(100, 7), (200, 201), (201, 200), (5, 5), (300, 299), (299, 298)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "u bigint, v bigint"), Scratch(spark, "t")).collect()}
    assert got == {**{k: 1 for k in range(1, 41)}, 100: 1, 200: 200, 201: 200, 298: 298, 299: 298, 300: 298}


@pytest.mark.parametrize("salt_rows", [2000, 7])
def test_embeddings(spark, monkeypatch, salt_rows):
    monkeypatch.setattr(embeddings, "SALT_ROWS", salt_rows)
    monkeypatch.setattr(embeddings, "SMALL", 64 if salt_rows > 7 else 3)
    rng = np.random.default_rng(1)
    base = rng.standard_normal((6, 20))
    x = np.vstack([base[k % 6] + rng.standard_normal(20) * (0.12 if k < 90 else 1) for k in range(140)])
    rows = [(k, [float(c) for c in v], k % 2) for k, v in enumerate(x)]
    rows += [(200, rows[0][1], 0), (201, rows[0][1], None), (202, [0.0] * 20, 0), (203, None, 0), (204, [float("nan")] * 20, 0), (205, [None] + [1.0] * 19, 0), (206, [], 1), (207, [1.0], 1)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embeddings.near_duplicates(df).collect()}
    own = [*range(140), 200]
    y = np.array([rows[k][1] if k < 140 else rows[0][1] for k in own])
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    lab = np.array([k % 2 if k < 140 else 0 for k in own])
    near = (y @ y.T >= 0.93) & (lab[:, None] == lab)
    comp = np.arange(len(own))
    for _ in range(20):
        comp = np.array([comp[near[k]].min() for k in range(len(own))])
    for k, v in enumerate(own):
        assert got[v] == (near[k].sum() - 1, own[comp[k]], own[comp[k]] == v)
    assert all(got[v] == (0, v, True) for v in range(201, 208))


@pytest.mark.parametrize(
    "dim, n, widths", [(64, 0, [64, 64]), (64, 5_700, [64, 64, 2]), (64, 200_000, [64, 64, 64]), (64, 10**9, [64] * 4 + [16]), (384, 0, [512] * 2), (384, 10**7, [512, 512, 64])]
)
def test_cross_polytope_recall(dim, n, widths):
    rng = np.random.default_rng(2)
    x = rng.standard_normal((600, dim))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    noise = rng.standard_normal(x.shape)
    noise -= (noise * x).sum(axis=1, keepdims=True) * x
    noise /= np.linalg.norm(noise, axis=1, keepdims=True)
    y = 0.931 * x + np.sqrt(1 - 0.931**2) * noise
    h = embeddings.CrossPolytope(dim, n)
    assert h.widths == widths
    (a, pa), (b, pb) = h.buckets(x), h.buckets(y)
    met = (a == b) | (pb == a[:, :, None]).any(axis=2) | (pa == b[:, :, None]).any(axis=2)
    assert met.any(axis=1).mean() > (0.999 if n < 10**6 else 0.99)


def test_embeddings_many_axes(spark, monkeypatch):
    """The whole operator with three axes and more: repeated ids, clashing columns and planted pairs at the threshold."""
    monkeypatch.setattr(embeddings, "SPREAD", 3000)
    rng = np.random.default_rng(5)
    x = rng.standard_normal((300, 32))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    z = rng.standard_normal(x.shape)
    z -= (z * x).sum(axis=1, keepdims=True) * x
    z /= np.linalg.norm(z, axis=1, keepdims=True)
    y = 0.935 * x + np.sqrt(1 - 0.935**2) * z
    rows = [(k, [float(c) for c in v], 1, "x") for k, v in enumerate(np.vstack([x, y]))]
    rows += [(700, rows[0][1], 1, "y"), (700, rows[0][1], 1, "y")]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int, rep string")
    got = embeddings.near_duplicates(df).collect()
    assert len(got) == 602 and sum(r.vec_id == 700 and r.component_id == 0 and r.n_links == 3 for r in got) == 2
    by_id = {r.vec_id: r for r in got}
    met = [by_id[k + 300].component_id == k and by_id[k].n_links == by_id[k + 300].n_links == 1 for k in range(1, 300)]
    assert np.mean(met) > 0.99 and by_id[0].n_links == 3


def test_embeddings_ids_on_several_vectors(spark):
    """Rows are what links, whatever their ids: one id may stand on different vectors, and on equal ones."""
    rng = np.random.default_rng(8)
    base = rng.standard_normal((7, 16))
    x = np.vstack([base[k % 7] + rng.standard_normal(16) * (0.1 if k < 50 else 1) for k in range(60)])
    x = np.vstack([x, x[3], x[3], x[20]])
    ids = [k % 23 for k in range(60)] + [3, 9, 40]
    near = (lambda y: y @ y.T >= 0.93)(x / np.linalg.norm(x, axis=1, keepdims=True))
    comp = np.array(ids)
    for _ in range(20):
        comp = np.array([comp[near[k]].min() for k in range(len(ids))])
    df = spark.createDataFrame([(i, [float(c) for c in v], 1) for i, v in zip(ids, x, strict=True)], "vec_id bigint, embedding array<double>, label int")
    got = Counter(tuple(r) for r in embeddings.near_duplicates(df).collect())
    assert got == Counter((i, int(near[k].sum()) - 1, int(comp[k]), bool(i == comp[k])) for k, i in enumerate(ids))
    e = np.eye(4)
    four = [(0, e[0] + e[1]), (0, e[2] + e[3]), (2, e[0] + 1.1 * e[1]), (3, e[2] + 1.1 * e[3])]
    df = spark.createDataFrame([(i, [float(c) for c in v], 1) for i, v in four], "vec_id bigint, embedding array<double>, label int")
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in embeddings.near_duplicates(df).collect()) == [(0, 1, 0), (0, 1, 0), (2, 1, 0), (3, 1, 0)]


def test_quality_classifier(spark):
    good = [f"The {w} of the day is long and calm, and {w} is what we all like to see." for w in map(str, range(60))]
    bad = [f"BUY!!! {w}$$$ NOW!!! ### {w} CHEAP*** %%% !!!" for w in map(str, range(60))]
    docs = spark.createDataFrame([*enumerate(good), *[(k + 100, t) for k, t in enumerate(bad)], (500, None), (501, "")], "doc_id bigint, text string")
    labels = spark.createDataFrame([(k, 1) for k in range(40)] + [(k + 100, 0) for k in range(40)] + [(700, 1), (1, None)], "doc_id bigint, quality int")
    got = {r.doc_id: (r.score, r.predicted) for r in quality_classifier.score(docs, quality_classifier.fit(docs, labels)).collect()}
    assert all(got[k][1] == 1 for k in range(40, 60)) and all(got[k + 100][1] == 0 for k in range(40, 60))
    assert all(0 <= s <= 1 for s, _ in got.values()) and len(got) == 122


def test_classifier_counts_are_whole():
    """Counts over 65,535 are the same when fitting and when scoring."""
    x = quality_classifier.terms(b"abc" * 70_000)
    assert x.max() > 65_535 and np.frombuffer(x.astype("<f4").tobytes(), "<f4").tolist() == x.tolist()


def test_classifier_sample_counts_documents(spark, monkeypatch):
    """An id on 500 rows is one labelled document."""
    docs = spark.range(500).select(F.lit(1).cast("bigint").alias("doc_id"), F.concat(F.lit("text "), "id").alias("text"))
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 1)], "doc_id bigint, quality int")
    space = quality_classifier.fit(docs, labels, sample=1)
    assert space.labels.tolist() in ([0.0], [])
    space = quality_classifier.fit(docs, labels)
    assert space.labels.tolist() == [0.0]


def test_classifier_votes_against_brute_force():
    rng = np.random.default_rng(7)
    counts = np.vstack([rng.poisson(0.3, (40, quality_classifier.HASHED + quality_classifier.FORM)).astype(np.float32)] * 2)  # each twice: ties
    labels = rng.integers(0, 2, 80).astype(float)
    space = quality_classifier.fit_space(counts, labels)
    asked = np.vstack([counts[:5], rng.poisson(0.3, (20, counts.shape[1])), np.zeros((1, counts.shape[1]))]).astype(np.float32)
    sims = space.fold(asked) @ space.vectors.T
    for k, got in enumerate(space.score(asked)):
        near = sorted(range(80), key=lambda j: (-sims[k, j], j))[: quality_classifier.NEIGHBOURS]
        w = [max(float(sims[k, j]), 0.0) ** 8 for j in near]
        want = sum(x * labels[j] for x, j in zip(w, near, strict=True)) / sum(w) if sum(w) > 1e-12 else space.prior
        assert got == pytest.approx(want, abs=1e-6)


@pytest.mark.parametrize(
    "url, host, path, rule, verdict",
    [
        ("http://A.B.Net/x?y#z", "a.b.net", "/x", "net/", "block"),
        ("http://m.example.net/en/1", "m.example.net", "/en/1", "example.net/en/", "allow"),
        ("http://example.net/en", "example.net", "/en", "net/", "block"),
        ("http://badexample.net/en/1", "badexample.net", "/en/1", "net/", "block"),
        ("http://x.example.com/de/1", "x.example.com", "/de/1", "example.com/de/", "block"),
        ("http://x.org/fr/1", "x.org", "/fr/1", "org/fr/", "allow"),
        ("http://x.net", "x.net", "", None, "allow"),
        ("http://x.org?a=/fr/", "x.org", "", None, "allow"),
        ("ftp://s://t/u", "s:", "//t/u", None, "allow"),
        ("no url", "", "", None, "allow"),
        (None, "", "", None, "allow"),
        ("https://www.cheap-pills.example.com/en/4.html?q", "www.cheap-pills.example.com", "/en/4.html", None, "block"),
        ("https://cheap-pills.example.com/en/4/", "cheap-pills.example.com", "/en/4/", None, "block"),
    ],
)
def test_url_filter(spark, url, host, path, rule, verdict):
    pages = spark.createDataFrame([(1, url, "x", None), (2, url, "y", "<p>a b c</p>")], "page_id bigint, url string, host string, html string")
    got = url_filter.judge(pages, url_filter.bad_urls(pages), queries.URL_RULES).collect()
    assert [(r.host, r.path, r.rule, r.verdict) for r in got] == [(host, path, rule, verdict)] * 2


def test_url_list_decides(spark):
    """Filter and join decide: a clean page at the canonical URL of a bad one is blocked, its neighbours are not."""
    rows = [
        (1, "http://h.example.com/a", "<p>x | y | z</p>"), (2, "https://www.h.example.com/a.html?q=1", "<p>clean and long enough</p>"), (3, "http://h.example.com/b", "<p>clean</p>"),
        (4, "http://h.example.org/fr/a", "| | |"), (5, "http://h.example.com/" + "a/" * 50_000, " | "), (6, "http://h.example.com/" + "a/" * 50_000 + "#x", None), (7, None, " | "),
    ]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    got = {r.page_id: (r.listed, r.verdict) for r in url_filter.judge(pages, url_filter.bad_urls(pages), queries.URL_RULES).collect()}
    blocked = {k for k, (listed, _) in got.items() if listed}
    assert blocked == {1, 2, 5, 6} == {k for k, (_, v) in got.items() if v == "block"} and len(got) == 7


def test_url_list_of_copies(spark):
    """A clean page elsewhere that carries a bad page's article is listed; short articles and other texts are not."""
    text = "one two three four five six seven eight nine ten"
    rows = [
        (1, "http://casino.example.com/a", f"<nav>x</nav><article><p>{text}</p></article>"), (2, "http://h.example.com/b", f"<article class='c'>\n<b>{text}</b>\x0b\t</article><p>y</p>"),
        (3, "http://h.example.com/b.html?q", None), (4, "http://h.example.com/c", f"<article>{text} more</article>"), (5, "http://casino.example.com/d", "<article>not found</article>"),
        (6, "http://h.example.com/e", "<article>not found</article>"), (7, "http://h.example.com/f", f"<p>{text}</p>"), (8, None, f"<article>{'| # ' * 30}</article>"),
        (9, "http://h.example.com/g", f"{'w ' * 5000}<article>{'| # ' * 30}</article>"), (9, "http://h.example.com/g", "<article></article>"), (10, "http://h.example.com/h", "<article></article>"),
    ]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    for blocks in (None, 1):
        keys = url_filter.bad_urls(pages, blocks=blocks)
        got = url_filter.judge(pages, keys, queries.URL_RULES).collect()
        assert {r.page_id for r in got if r.listed} == {1, 2, 3, 5, 9} and len(got) == len(rows)


def test_filter_follows_memory():
    assert [url_filter.most_blocks(g << 30) for g in (0, 1, 3, 4, 32)] == [256, 1 << 18, 1 << 20, 1 << 20, 1 << 23]
    assert url_filter.filter_blocks(10**11, 1 << 23) == 1 << 23


def test_filter_follows_the_list():
    assert [url_filter.filter_blocks(n) for n in (0, 1, 10**4, 10**6, 10**11)] == [256, 256, 256, 1 << 15, 1 << 20]


def test_url_list_beyond_the_filter(spark):
    """A filter far too small for its list passes everything; the exact join still decides."""
    pages = spark.range(400).select(F.col("id").alias("page_id"), F.concat(F.lit("http://h/"), F.col("id")).alias("url"))
    listed = spark.range(0, 400, 3).select(F.concat(F.lit("h/"), F.col("id")).alias("key"))
    got = url_filter.judge(pages, listed, [], blocks=1).collect()
    assert {r.page_id for r in got if r.verdict == "block"} == set(range(0, 400, 3))


def _brute_repeats(texts, length):
    count = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if count[t[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        runs = sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        out.append((len(t), sum(gone), runs, hashlib.sha256(bytes(b for b, g in zip(t, gone, strict=True) if not g)).hexdigest()))
    return out


@pytest.mark.parametrize("length, gram, rows", [(40, 8, 20_000), (100, 48, 20_000), (40, 8, 6), (100, 48, 3)])
def test_suffix_dedup(spark, monkeypatch, length, gram, rows):
    monkeypatch.setattr(suffix_dedup, "ROWS", rows)  # few: most anchors are split
    monkeypatch.setattr(suffix_dedup, "PART", 44 if rows > 100 else 9)
    rng = np.random.default_rng(length)

    def text(n):
        return "".join(rng.choice(list("abcd é" if rows > 3 else "abcd "), n))

    shared = [text(int(rng.integers(length - 5, 3 * length))) for _ in range(5)]
    docs = [None, "", "x", "a" * (3 * length), "ab" * (2 * length), text(length - 1), text(length)]
    for _ in range(60):
        parts = [text(int(rng.integers(0, length)))]
        for _ in range(int(rng.integers(0, 4))):
            p = shared[int(rng.integers(0, 5))]
            parts += [p[int(rng.integers(0, 10)) :], text(int(rng.integers(0, length)))]
        docs.append("".join(parts))
    docs += docs[20:24] + [docs[30][:50] + "Z" + docs[30][51:]]
    df = spark.createDataFrame([(k, t, "en", "s", "c") for k, t in enumerate(docs)], DOCS)
    shorter = length // 2 if rows != 6 else None
    found = suffix_dedup.remove_repeats(df, length=length, gram=gram if rows < 20_000 or length < 100 else 48, passages=max(shorter, gram) if shorter else None).collect()
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in found}
    assert [got[k] for k in range(len(docs))] == _brute_repeats([(t or "").encode() for t in docs], length)
    for r in found:
        assert "".join((docs[r.doc_id] or "").encode()[x.a : x.b].decode("utf-8", "ignore") for x in r.removed) in (docs[r.doc_id] or "") or r.n_spans > 1
    if shorter:
        want = [w[3] for w in _brute_repeats([(t or "").encode() for t in docs], max(shorter, gram))]
        for r in found:
            rest = r.without_passages
            assert (rest is None) == (docs[r.doc_id] is None)
            if rest is not None and "é" not in docs[r.doc_id]:
                assert hashlib.sha256(rest.encode()).hexdigest() == want[r.doc_id]


def test_suffix_dedup_pieces(monkeypatch, spark):
    """Texts longer than a piece are hashed in overlapping pieces."""
    monkeypatch.setattr(suffix_dedup, "PIECE_BITS", 9)
    rng = np.random.default_rng(5)
    texts = [bytes(rng.integers(97, 101, 2000, dtype=np.uint8)) for _ in range(2)]
    texts[1] = texts[1][:700] + texts[0][300:420] + texts[1][820:]
    whole = set()
    for d, t in enumerate(texts):
        for at, piece in suffix_dedup._pieces(t, 100):
            doc, p, h = suffix_dedup.anchors([piece], 100, 48)
            whole |= {(d, int(at + x), int(y)) for x, y in zip(p, h, strict=True)}
    hashes = Counter(h for _, _, h in {(d, p, h) for d, p, h in whole})
    shared = [(d, p) for d, p, h in whole if hashes[h] > 1]
    assert {d for d, _ in shared} == {0, 1} and all(300 <= p <= 420 if d == 0 else 700 <= p <= 820 for d, p in shared)


@pytest.mark.parametrize("bits", [9, 12])
def test_suffix_dedup_piece_ends(monkeypatch, spark, bits):
    """An anchor that two pieces of a text share is one place, whether they are hashed together or not."""
    monkeypatch.setattr(suffix_dedup, "PIECE_BITS", bits)
    rng = np.random.default_rng(bits)
    once, other, copy = ("".join(rng.choice(list("abcd"), 12_000)) for _ in range(3))
    docs = [once, other[:5000] + once[3000:3300] + other[5300:], copy, copy]
    df = spark.createDataFrame([(k, t, "en", "s", "c") for k, t in enumerate(docs)], DOCS)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.remove_repeats(df, length=100).collect()}
    assert [got[k] for k in range(len(docs))] == _brute_repeats([t.encode() for t in docs], 100)


def test_suffix_dedup_long_text(spark):
    """A text of more than one piece that repeats nowhere loses nothing."""
    text = np.random.default_rng(8).integers(33, 127, (2 << suffix_dedup.PIECE_BITS) + 9000, dtype=np.uint8).tobytes().decode()
    df = spark.createDataFrame([(1, text, "en", "s", "c")], DOCS)
    assert [(r.n_removed, r.n_spans) for r in suffix_dedup.remove_repeats(df).collect()] == [(0, 0)]


@pytest.mark.parametrize("rows", [20_000, 1])
def test_suffix_dedup_copies(monkeypatch, spark, rows):
    """However many copies a text has, each segment is dealt out to be sorted once."""
    monkeypatch.setattr(suffix_dedup, "ROWS", rows)
    dealt, sort = [], suffix_dedup._sort

    def spy(segments, *args):
        dealt.append((segments.count(), segments.select("anchor", "s1", "s2").distinct().count()))
        return sort(segments, *args)

    monkeypatch.setattr(suffix_dedup, "_sort", spy)
    rng = np.random.default_rng(6)
    text, other = ("".join(rng.choice(list("abcd"), 900)) for _ in range(2))
    docs = [text] * 40 + [text[:450] + "Z" + text[451:], other[:300] + text[200:400] + other[500:]]
    df = spark.createDataFrame([(k, t, "en", "s", "c") for k, t in enumerate(docs)], DOCS)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.remove_repeats(df, length=100).collect()}
    assert [got[k] for k in range(len(docs))] == _brute_repeats([t.encode() for t in docs], 100)
    assert max(dealt)[0] > 0 or rows == 1
    assert all(n == distinct for n, distinct in dealt)


def test_cut_repeats_keeps_rows(odd):
    got = suffix_dedup.cut_repeats(odd, count_col="none")
    assert got.columns == odd.columns and got.count() == odd.count()
    texts = {r.doc_id: r.text for r in got.collect()}
    assert texts[0] is None and texts[1] == "" and texts[5] == "" and texts[7] == ODD[7]


def _brute_fingerprint(text):
    import xxhash

    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(words[i : i + 4]).encode(), 42) for i in range(max(1, len(words) - 3))]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def test_simhash(spark, odd):
    got = {(r.doc_id, r.fingerprint, r.component_id) for r in simhash.near_duplicates(odd).collect()}
    fps = {k: _brute_fingerprint(t) for k, t in enumerate(ODD)}
    assert {(k, f"{v:016x}") for k, v in fps.items()} <= {g[:2] for g in got}
    comp = {g[0]: g[2] for g in got}
    assert comp[0] == comp[1] == comp[2] == 0 and comp[8] == comp[9] == 8 and None in comp
    assert sorted(simhash.keep_one(odd).select("doc_id").toPandas().doc_id.dropna()) == [0, 3, 4, 5, 6, 7, 8, 8]


@pytest.mark.parametrize("salted", [False, True])
def test_simhash_links(spark, monkeypatch, salted):
    if salted:
        monkeypatch.setattr(simhash, "SHARD_ROWS", 5)
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**63, 30, dtype=np.int64).view(np.uint64)
    fps = set(base.tolist())
    for b in base[:12].tolist():
        for _ in range(20):
            fps.add(b ^ sum(1 << int(k) for k in rng.choice(64, int(rng.integers(1, 6)), replace=False)))
    u = np.array(sorted(fps), np.uint64)
    df = spark.createDataFrame([(int(x),) for x in u.view(np.int64)], "fp bigint")
    label = np.arange(len(u))
    for i in range(len(u)):
        near = np.flatnonzero(np.bitwise_count(u ^ u[i]) <= 4)
        label[np.isin(label, label[near])] = label[near].min()
    comp = {r.node: r.component for r in components(simhash.links(df), Scratch(spark, "t")).collect()}
    got = np.array([comp.get(int(x), int(x)) for x in u.view(np.int64)])
    assert len(set(zip(label.tolist(), got.tolist(), strict=True))) == len(set(label.tolist())) == len(set(got.tolist()))


def test_simhash_hot_shard(spark, monkeypatch):
    """A task's share of a hot shard does not grow with the shard."""
    monkeypatch.setattr(simhash, "SHARD_ROWS", 5)
    df = spark.range(200).select(F.col("id").alias("fp"))  # equal in all blocks but the lowest
    dealt, run = [], type(df).mapInArrow

    def spy(rows, *args, **kwargs):
        dealt.append(rows.groupBy("key", "low", "high").count().agg(F.max("count")).first()[0])
        return run(rows, *args, **kwargs)

    monkeypatch.setattr(type(df), "mapInArrow", spy)
    comp = {r.component for r in components(simhash.links(df), Scratch(spark, "t")).collect()}
    assert comp == {0} and dealt[0] < 40


def _brute_viterbi(scores, penalty):
    n, m = scores.shape
    best, back = scores[0].astype(float), []
    for t in range(1, n):
        move = best[:, None] - penalty * (1 - np.eye(m))
        back.append(move.argmax(axis=0))
        best = move.max(axis=0) + scores[t]
    path = [int(best.argmax())]
    total = best.max()
    for b in reversed(back):
        path.append(int(b[path[-1]]))
    return total, path[::-1]


def test_viterbi():
    rng = np.random.default_rng(4)
    sizes = np.array([1, 7, 30, 2, 30])
    scores = rng.standard_normal((sizes.sum(), 3)).astype(np.float32) * 3
    path = language_id.viterbi(scores, sizes, 2.0)
    at = 0
    for n in sizes:
        own, p = scores[at : at + n], path[at : at + n]
        value = own[np.arange(n), p].sum() - 2.0 * (p[1:] != p[:-1]).sum()
        assert value == pytest.approx(_brute_viterbi(own, 2.0)[0], abs=1e-4)
        at += n


def test_many_languages():
    """Over 256 languages keep their numbers."""
    rng = np.random.default_rng(5)
    scores = rng.standard_normal((40, 300)).astype(np.float32)
    scores[:, 280] += 20
    assert (language_id.viterbi(scores, np.array([15, 25]), 2.0) == 280).all()


def test_language_sample_is_bounded(spark):
    """A text or an id on a third of the rows counts once in the sample."""
    hot = spark.range(500).select(F.lit(7).cast("bigint").alias("doc_id"), F.lit("hot text of the hot id").alias("text"), F.lit("aa").alias("lang"))
    many = spark.range(10, 500).select(F.col("id").alias("doc_id"), F.lit("the same text").alias("text"), F.lit("bb").alias("lang"))
    rest = spark.range(500, 1000).select(F.col("id").alias("doc_id"), F.concat(F.lit("text"), "id").alias("text"), F.lit("cc").alias("lang"))
    seen, real = [], type(hot).mapInArrow

    def spy(df, *args, **kwargs):
        seen.append(df.count())
        return real(df, *args, **kwargs)

    with pytest.MonkeyPatch.context() as m:
        m.setattr(type(hot), "mapInArrow", spy)
        language_id.learn(hot.union(many).union(rest), sample=100)
        language_id.learn(hot.union(hot), sample=100)
    assert seen[0] == 100 and seen[1] == 1


def test_lower_case_of_two_characters():
    text = "İİİ the cat"
    assert len(language_id._points(text)) == len(text)


def test_language_scores_against_brute_force(spark):
    """Scripts, word scores and document scores as a plain count of trigrams gives them."""
    from math import log

    texts = {"en": "the cat and the dog went to that house", "de": "der hund und die katze gingen zu dem haus", "ru": "кошка и собака пошли в дом"}
    docs = spark.createDataFrame([(k, f"{t} {t}", lang) for lang, t in texts.items() for k in range(3)], "doc_id bigint, text string, lang string")
    docs = docs.withColumn("doc_id", F.col("doc_id") * 3 + F.length("lang") + F.ascii("lang"))
    model = language_id.learn(docs)

    def grams(text):
        out, words = [], re.findall(r"[^\W\d_]+", text.lower())
        for w in words:
            x = "\0\0" + w + "\0"
            x = "\0" + w + "\0" if len(out) else x
            out.append([x[max(0, i) : i + 3] for i in range(len(x) - 2)])
        return words, out

    def bucket(g):
        x, y, z = (ord(c) for c in g)
        return ((x * 0x9E3779B1 ^ y * 0x85EBCA77 ^ z * 0xC2B2AE3D) & 0xFFFFFFFF) >> 17

    counts = {lang: Counter() for lang in model.langs}
    rows = docs.dropDuplicates(["doc_id"]).collect()
    for r in rows:
        c = language_id._points(r.text)
        code, _ = language_id._codes(c, language_id._scripts()[c] > 0)
        counts[r.lang].update(code.tolist())
    for k, lang in enumerate(model.langs):
        total = sum(counts[lang].values()) + 0.5 * language_id.BUCKETS
        some = list(counts[lang])[:50]
        assert [model.table[b, k] for b in some] == pytest.approx([log((counts[lang][b] + 0.5) / total) for b in some], abs=1e-4)
    c = language_id._points("the дом x")
    starts, lengths, scores = model.words(c)
    assert starts.tolist() == [0, 4, 8] and lengths.tolist() == [3, 3, 1]
    k = {lang: i for i, lang in enumerate(model.langs)}
    assert scores[0, k["ru"]] <= -1e6 and scores[1, k["en"]] <= -1e6 and scores[1, k["ru"]] > -1e6
    own = [bucket("\0" + "th"), bucket("the"), bucket("he\0")]
    first = bucket("\0\0t")
    assert scores[0, k["en"]] == pytest.approx(sum(float(model.table[b, k["en"]]) for b in [first, *own]), abs=1e-3)


def test_marks_are_of_words():
    """A combining mark belongs to the word of the letter before it; at a word's start, or alone, it is none."""
    for text, want in {
        "हिन्दी भाषा": [(0, 6), (7, 4)],
        "ที่นี่ x": [(0, 6), (7, 1)],
        "e\u0301te\u0301\u0301 \u0301a 1\u0301b": [(0, 6), (8, 1), (12, 1)],
        "\u0301\u0301": [],
        "": [],
    }.items():
        model = language_id.Model(["x"], np.zeros((language_id.BUCKETS, 1), np.float32), np.ones((len(language_id.SCRIPTS) + 2, 1), bool))
        starts, lengths, scores = model.words(language_id._points(text))
        assert list(zip(starts.tolist(), lengths.tolist(), strict=True)) == want and scores.shape == (len(want), 1)
        assert language_id.detect([text], model)[0][0] == ("x" if want else "und")


def test_language_id(spark, odd):
    text = {"en": "the cat and the dog went to the house with that man", "de": "der hund und die katze gingen nicht zu dem haus mit einem mann", "ru": "кошка и собака пошли в дом"}
    docs = spark.createDataFrame([(100 * n + k, f"{t} {k}", lang, "s", "c") for n, (lang, t) in enumerate(text.items()) for k in range(5)] + [(9, None, "en", "s", "c"), (9, "x", None, "s", "c")], DOCS)
    model = language_id.learn(docs)
    assert model.langs == ["de", "en", "ru"]
    got = language_id.detect([text["en"] + ". " + text["de"] * 2, text["ru"] + " the", "123 !", "", None], model)
    assert [g[0] for g in got] == ["de", "ru", "und", "und", "und"] and [s[2] for s in got[0][2]] == ["en", "de"]
    rows = {r.doc_id: r for r in language_id.identify(odd, model, spans=True).collect()}
    assert rows[0].lang_pred == rows[1].lang_pred == "und" and all(0 <= r.score <= 1 for r in rows.values())


def test_quality_rules(spark, odd):
    rows = [*ODD, "a b c d e f g h i j " * 3, "w " * 9, "l1 a b\nl1 a b\n\n\nl2", "no line repeats in this text of mine at all here.", "*# $ % & | < > x y z a b c d e f g h"]
    df = spark.createDataFrame([(k, t, "en", "s", "c") for k, t in enumerate(rows)], DOCS).withColumn("n_words", F.lit("clash"))
    got = {r.doc_id: r for r in quality_rules.judge(df, share=1.0).collect()}
    for k, t in enumerate(rows):
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        five = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
        covered = {j for i in range(len(w) - 4) if five[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
        lines = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        want = (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t or ""), len(lines) - len(set(lines)), len(covered))
        r = got[k]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (len(w) < 10 or 100 * len(covered) > 20 * len(w)) and (not r.base_failed or not r.kept)
    assert got[13].kept and not got[14].kept
    assert quality_rules.keep_good(df.drop("n_words")).columns == [c for c in df.columns if c != "n_words"]


def test_repeats_in_long_texts(spark, monkeypatch):
    monkeypatch.setattr(quality_rules, "START_BITS", 3)
    df = spark.createDataFrame([(1, "a b c d e x a b c d e y z a b c d"), (2, "a b c d e f")], "doc_id bigint, text string")
    assert {r.doc_id: r.n_repeat_words for r in quality_rules.statistics(df).collect()} == {1: 10, 2: 0}


def test_repeats_among_equal_high_bits(spark, monkeypatch):
    monkeypatch.setattr(quality_rules, "START_BITS", 61)  # three high bits: other hashes come between equal ones
    text = " ".join(["a b c d e", *[f"w{k}" for k in range(200)], "a b c d e"])
    df = spark.createDataFrame([(1, text), (2, "a b c d e f"), (3, "x " * 12)], "doc_id bigint, text string")
    assert {r.doc_id: r.n_repeat_words for r in quality_rules.statistics(df).collect()} == {1: 10, 2: 0, 3: 12}


def test_rule_order(spark):
    df = spark.range(100).toDF("n")
    rules = [quality_rules.Rule("none", F.col("n") < 0), quality_rules.Rule("most", F.col("n") < 90), quality_rules.Rule("null", F.lit(None).cast("boolean"))]
    more = quality_rules.Rule("more", F.col("n") >= 0)
    assert quality_rules.order_rules(df, rules)[0].name == "most"
    assert [r.name for r in quality_rules.order_rules(df.where("n < 0"), [*rules, more])] == ["none", "most", "null", "more"]
    assert quality_rules.order_rules(df, [rules[0], more])[0].name == "more"
    assert df.select(quality_rules.verdict(rules).alias("v")).where("v = 'most'").count() == 90


def test_rule_order_by_cost(spark):
    """Rejections count by what they cost, and the order takes one job."""
    df = spark.range(100).toDF("n")
    rules = [quality_rules.Rule("dear", F.col("n") < 90, F.lit(10)), quality_rules.Rule("cheap", F.col("n") < 10, F.lit(1)), quality_rules.Rule("free", F.col("n") < 20)]
    spark.sparkContext.setJobGroup("order", "rules")
    assert [r.name for r in quality_rules.order_rules(df, rules)] == ["free", "cheap", "dear"]
    assert [r.name for r in quality_rules.order_rules(df, [quality_rules.Rule("dear", F.col("n") < 90, F.lit(8)), *rules[1:]])] == ["free", "dear", "cheap"]
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("order"))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert 2 <= jobs <= 4  # one for each order, or two with adaptive execution


def test_rules_wait_for_each_other(spark):
    """A costly rule is evaluated on no row that an earlier one rejects."""
    df = spark.range(100).toDF("n")
    costly = quality_rules.Rule("costly", F.when(F.col("n") < 90, F.raise_error(F.lit("evaluated"))).otherwise(F.col("n") > 95))
    got = df.select(quality_rules.verdict([quality_rules.Rule("most", F.col("n") < 90), costly]).alias("v")).groupBy("v").count().collect()
    assert {r.v: r["count"] for r in got} == {"most": 90, "costly": 4, None: 6}


def test_keep_good_computes_lazily(spark, monkeypatch):
    """Repeated words are looked for in no text that a cheaper rule rejects, and the order changes nothing."""
    good = "The cat sat on the mat. Then it went to the house of a friend, and they all had tea. " * 1
    texts = ["BOOM", None, "", good, good + good, "BOOM ### $$$ %%% *** " * 9, "- a b c d e f g h i j.\n" * 1, "A B C D E F G H I J K L.", "- one two three four five.\n- six seven eight nine ten eleven."]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "_n bigint, text string")
    want = {r._n for r in quality_rules.judge(df, share=1.0).where("kept").collect()}
    assert 3 in want and not want & {0, 1, 2, 4, 5, 7, 8}
    names = ["few_words", *[r.name for r in quality_rules.default_rules()]]
    assert {r._n for r in quality_rules.keep_good(df, share=1.0).collect()} == want
    assert {r._n for r in quality_rules.keep_good(df, order=[quality_rules.REPEATS, *names]).collect()} == want
    real = quality_rules.words
    monkeypatch.setattr(quality_rules, "words", lambda t: F.when(t.contains("BOOM"), F.raise_error(F.lit("evaluated")).cast("array<string>")).otherwise(real(t)))
    assert {r._n for r in quality_rules.keep_good(df, order=[*names, quality_rules.REPEATS]).collect()} == want
    with pytest.raises(Exception, match="evaluated"):
        quality_rules.keep_good(df, order=[quality_rules.REPEATS, *names]).collect()


def test_packing(spark, odd):
    from tokenizers import Tokenizer

    path = queries.tokenizer_path()
    library = Tokenizer.from_file(path)
    more = spark.createDataFrame([(100 + k, f"word{k} " * (37 * k), "en", "s", "c") for k in range(60)], DOCS)
    docs = odd.where("doc_id is not null").dropDuplicates(["doc_id"]).unionByName(more)
    ids = {r.doc_id: [*library.encode(r.text or "", add_special_tokens=False).ids, 1] for r in docs.collect()}
    rows = packing.pack(docs, path, with_ids=True).collect()
    place = {}
    for r in rows:
        part = ids[r.doc_id][r.start : r.start + r.length]
        assert list(r.ids) == part and r.length == len(part) > 0 and r.doc_tokens == len(ids[r.doc_id])
        assert r.ids_crc32 == zlib.crc32(np.array(part, "<u4").tobytes())
        for k in range(r.length):
            assert place.setdefault((r.doc_id, r.start + k), r.sequence_id) == r.sequence_id
    assert sum(r.length for r in rows) == len(place) == sum(map(len, ids.values()))
    for s in {r.sequence_id for r in rows}:
        own = sorted((r for r in rows if r.sequence_id == s), key=lambda r: r.offset)
        at = 0
        for r in own:
            assert r.offset == at
            at += r.length
        assert at == own[0].window <= 2048 and at & (at - 1) == 0


def test_tokens_are_the_library_s():
    words = packing.WordTokenizer(queries.tokenizer_path())
    texts = ["", "İstanbul Σίσυφος ΟΔΟΣ", "a<|endoftext|>b", "²x½ 3¾", "µm ŉ ſ·", "don't 'RE they''ll", "e\u0301 x", "日本語", "naïve—“q” €5…", "\x00a\x1cb", "a_b __ 12", "a\u00a0b\u2003c", "a\x1c b\x1d\x1ec \x1f", "<|startoftext|>x <|endoftext|>", "\x85x \x0bq\x0cr", " \u0301x", "'s't '", None]
    for _ in range(2):  # new words, then known ones
        for t, got in zip(texts, words.encode(texts), strict=True):
            assert got.tolist() == words.library.encode(t or "", add_special_tokens=False).ids


def test_tokens_with_a_small_cache(monkeypatch):
    monkeypatch.setattr(packing, "CACHE_WORDS", 3)
    words = packing.WordTokenizer(queries.tokenizer_path())
    for texts in (["a b c d e", "f"], ["a x y"], [], ["", None]):
        assert [g.tolist() for g in words.encode(texts)] == [words.library.encode(t or "", add_special_tokens=False).ids for t in texts]


def test_slices():
    import pyarrow as pa

    texts = pa.array(["ab", None, "c" * 50, "", "def", "g"])
    got = [x.to_pylist() for x in packing.slices(texts, 5)]
    assert [t for x in got for t in x] == texts.to_pylist() and all(len(x) == 1 or sum(len(t or "") for t in x) <= 5 for x in got)


def test_mixing(spark):
    rows = [(k, "w " * (1 + k % 7), f"s{0 if k % 3 else k % 12}") for k in range(600)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    total = Counter()
    for _, t, s in rows:
        total[s] += t.count("w")
    grand = sum(total.values())
    for args in ({"entropy": 0.97}, {"repetition": 1.5}):
        drawn = mixing.mix(docs, **{"entropy": None, "repetition": None, **args}).collect()
        got = Counter()
        for r in drawn:
            got[r.source] += r.tokens
        assert abs(sum(got.values()) - grand) <= 7 * len(total)
        p = np.array([got[s] / sum(got.values()) for s in total])
        if "entropy" in args:
            assert -(p * np.log(p)).sum() / np.log(len(p)) == pytest.approx(0.97, abs=0.02)
        else:
            assert max(got[s] / total[s] for s in total) <= 1.5 + 0.2
        each = Counter((r.doc_id, r.epoch) for r in drawn)
        assert max(each.values()) == 1


def test_mixing_odd(odd):
    got = mixing.mix(odd, entropy=None, repetition=3.0)
    assert got.count() > 0 and mixing.mix(odd, keep=True).columns == odd.columns


def test_token_counts(spark, odd):
    import public_tokenizers as p
    import tiktoken
    from tokenizers import Tokenizer

    versions = {"w": (p.path("word_bpe_49k.json"), None), "b": (p.path("byte_bpe_50k.tiktoken"), p.PATTERN)}
    got = token_rollup.token_counts(odd.withColumn("short", F.upper("lang")), {"old": "text", "new": "short"}, versions)
    assert got.columns == ["doc_id", "lang", "source", "kept", "w/old", "w/new", "b/old", "b/new"]
    words = Tokenizer.from_file(p.path("word_bpe_49k.json"))
    import base64

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(p.path("byte_bpe_50k.tiktoken"), "rb"))}
    other = tiktoken.Encoding("t", pat_str=p.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rows = got.collect()
    assert len(rows) == len(ODD) + 2
    for r in rows:
        t = ODD[r.doc_id] if r.doc_id is not None else "no id"
        want = (None, None) if t is None else (len(words.encode(t, add_special_tokens=False).ids), len(other.encode_ordinary(t)))
        assert (r["w/old"], r["b/old"]) == want and (r["w/new"] is None) == (r.lang is None)


def test_rollup_query(spark):
    """The registered query against a plain count by the libraries."""
    import base64

    import public_tokenizers as p
    import tiktoken
    from tokenizers import Tokenizer

    sf = "/root/testdata/sf0.001"
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(p.path("byte_bpe_50k.tiktoken"), "rb"))}
    tools = {
        "word-bpe-49k": lambda t, x=Tokenizer.from_file(p.path("word_bpe_49k.json")): len(x.encode(t, add_special_tokens=False).ids),
        "byte-bpe-50k": lambda t, x=tiktoken.Encoding("t", pat_str=p.PATTERN, mergeable_ranks=ranks, special_tokens={}): len(x.encode_ordinary(t)),
    }
    toxic = {r.doc_id for r in spark.read.parquet(f"{sf}/labels.parquet").where("toxic = 1").collect()}
    docs, tokens = Counter(), Counter()
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        if r.doc_id not in toxic:
            text = "\n".join(dict.fromkeys((r.text or "").split("\n")))
            for v, count in tools.items():
                docs[r.source, r.lang, v] += 1
                tokens[r.source, r.lang, v] += count(text)
    got = {(r.source, r.lang, r.tokenizer): (r.docs, r.tokens) for r in queries.op10_token_rollup(spark, sf).collect()}
    assert got == {k: (docs[k], tokens[k]) for k in docs}


def test_rollup(spark, tmp_path):
    rows = spark.createDataFrame([("a", "en", "v1", 3), ("a", "en", "v1", 4), (None, "en", "v1", 5)], "source string, lang string, tokenizer string, tokens bigint")
    r = token_rollup.TokenRollup(spark, str(tmp_path / "r"))
    assert r.totals().count() == 0
    assert r.commit("1", token_rollup.inserts(rows)) and not r.commit("1", token_rollup.inserts(rows))
    (tmp_path / "r/writing-2-x").mkdir()  # a lost job's leavings
    assert r.commit("2", token_rollup.deletes(rows.where("tokens = 4")))
    changed = rows.where("tokens = 3").withColumn("new", F.lit(10))
    assert r.commit("3", token_rollup.revisions(changed, "tokens", "new"))
    want = {("a", "en", "v1", 1, 10), (None, "en", "v1", 1, 5)}
    assert {tuple(x) for x in r.totals().collect()} == want
    folded = r.compact(str(tmp_path / "s"))
    assert [f.batch for f in folded.folded().collect()] == ["1", "2", "3"] and len(folded.committed()) == 1 and r.folded() is None
    assert not folded.commit("2", token_rollup.inserts(rows)) and {tuple(x) for x in folded.totals().collect()} == want
    assert r.commit("4", token_rollup.deletes(rows.where("source is null"))) and r.totals().count() == 1
    with pytest.raises(ValueError):
        r.commit("../x", rows)
    assert r.commit("empty", token_rollup.inserts(rows.where("false").withColumn("docs", F.lit("clash")))) and not r.commit("empty", token_rollup.inserts(rows))


def test_rollup_folds_again(spark, tmp_path, monkeypatch):
    """Ids stay known over several compactions; folders do not grow with them, and a lost compaction leaves nothing."""
    rows = spark.createDataFrame([("a", "en", "v1", 3), ("b", None, "v1", 0)], "source string, lang string, tokenizer string, tokens bigint")
    r = token_rollup.TokenRollup(spark, str(tmp_path / "r{1}"))  # signs of patterns are plain in paths
    for k in range(5):
        assert r.commit(f"x{k}", token_rollup.inserts(rows))
    one = r.compact(str(tmp_path / "one"))
    assert one.commit("late", token_rollup.deletes(rows.where("source = 'b'")))
    two = one.compact(str(tmp_path / "two"))
    assert {(t.source, t.docs, t.tokens) for t in two.totals().collect()} == {("a", 5, 15), ("b", 4, 0)}
    assert {f.batch for f in two.folded().collect()} > {"x0", "x4", "late"} and len(list((tmp_path / "two").iterdir())) == 2
    assert not any(two.commit(b, token_rollup.inserts(rows)) for b in ("x0", "x4", "late")) and two.commit("x5", token_rollup.inserts(rows))
    with pytest.raises(FileExistsError):
        r.compact(str(tmp_path / "two"))
    monkeypatch.setattr(token_rollup.TokenRollup, "_totals", lambda *_: spark.range(1))  # no such columns: the job fails
    with pytest.raises(Exception, match="source|lang|tokenizer"):
        r.compact(str(tmp_path / "three"))
    assert not (tmp_path / "three").exists()
    monkeypatch.undo()
    assert r.compact(str(tmp_path / "three")).totals().count() == 2 and len(two.committed()) == 2


def test_rollup_without_batches(spark, tmp_path):
    none = token_rollup.TokenRollup(spark, str(tmp_path / "none")).compact(str(tmp_path / "some"))
    assert none.totals().count() == 0 and none.folded().count() == 0 and none.committed()


def test_rollup_two_writers(spark, tmp_path, monkeypatch):
    """A batch that another writer commits meanwhile is not added twice."""
    rows = spark.createDataFrame([("a", "en", "v1", 3)], "source string, lang string, tokenizer string, tokens bigint")
    one, two = (token_rollup.TokenRollup(spark, str(tmp_path / "r")) for _ in range(2))
    done, seen = one._done, []

    def late(batch):
        if not seen:
            seen.append(two.commit(batch, token_rollup.inserts(rows)))
            return False  # as it was before the other was through
        return done(batch)

    monkeypatch.setattr(one, "_done", late)
    assert not one.commit("1", token_rollup.inserts(rows)) and seen == [True]
    assert [(r.docs, r.tokens) for r in two.totals().collect()] == [(1, 3)]
    assert not [p for p in (tmp_path / "r").iterdir() if p.name.startswith("writing")]
