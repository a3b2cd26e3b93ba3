"""Exact deduplication, fill-in-the-middle and tokenizer alignment against plain versions, and on odd inputs."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sightline.llm import alignment, exact_dedup, fill_in_middle, queries

from .test_operators import DOCS, ODD

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(3)
    long = "".join(rng.choice("abcdefgh \n") for _ in range(200_000))
    near = long[:150_000] + "!" + long[150_001:]
    marked = ["a <P> b\nc", "x<S>", "<M>", "<|endoftext|> and <s> </s> <unk> <0x41>", "\n", "\n\nend\n", "no newline", "a\nb"]
    spaces = ["two  spaces   three", " lead", "trail ", "tab\tand\r\nlines", "nbsp\xa0 x", "wide\u3000 gap", "\u2581under \u2581", "日本 語 text это слово é e\u0301 ﬁ", "don't we'll IT'S", "a" * 5000, "emoji 🙂 🙂x", "\u0301 mark \u0301x", "x \u0085y"]
    return [*ODD, *ODD[:4], long, long, near, long + "x", "x" + long, "0" * 100_000, "0" * 100_000, *marked, *spaces]


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(k, t, "en", "s", "c") for k, t in enumerate(texts)]
    rows += [rows[10], (None, None, "en", "s", "c"), (None, "no id", "en", "s", "c"), (3, "another text of 3", "en", "s", "c")]
    df = spark.createDataFrame(rows, DOCS).withColumn("row", F.lit("clash")).withColumn("hash", F.lit(1)).withColumn("n", F.lit(1)).withColumn("form", F.lit("f"))
    return df.repartition(5)


def test_chunk_ends():
    rng = np.random.default_rng(1)
    data = rng.integers(0, 256, 400_000).astype(np.uint8)
    ends = [0, 10, 200_000, 200_000, 399_000, 400_000]
    cuts = exact_dedup.chunk_ends(data, ends)
    for start, end, own in zip([0, *ends], ends, cuts, strict=False):
        assert (own[-1:] == [end]) == (end > start)
        sizes = np.diff([start, *own])
        assert all(exact_dedup.LEAST <= s <= exact_dedup.MOST for s in sizes[:-1]) and all(0 < s <= exact_dedup.MOST for s in sizes)
    # the rolling hash, byte by byte
    h, want = 0, []
    for k, byte in enumerate(data.tolist()):
        h = ((h << 1) + int(exact_dedup._GEAR[byte])) & 0xFFFFFFFF
        if k >= 31 and h >> 20 == 0:
            want.append(k + 1)
    assert [x for x in np.concatenate(list(exact_dedup._marks(data, 4096))).tolist() if x > 31] == want
    # a text is cut alike wherever it stands, and an insertion moves nothing far from it
    text = data[10:200_000]
    assert [c + 10 for c in exact_dedup.chunk_ends(text, [len(text)])[0]] == cuts[2]
    moved = np.concatenate([text[:60_000], data[:7], text[60_000:]])
    again = {c - 7 for c in exact_dedup.chunk_ends(moved, [len(moved)])[0]}
    assert len(again & {c - 10 for c in cuts[2]}) > 0.6 * len(cuts[2])


@pytest.mark.parametrize("bits,sizes", [(64, (1024, 4096, 32_768)), (3, (32, 64, 100_000)), (0, (32, 1 << 20, 1 << 20))])
def test_exact_dedup(spark, docs, bits, sizes):
    """With few or no bits of hash, only the numbers of contents that share a hash tell chunks apart."""
    got = exact_dedup.mark(docs, carry=["source", "row"], sizes=sizes, hash_bits=bits).collect()
    rows = docs.collect()
    groups: dict = {}
    for r in rows:
        groups.setdefault(r.text or "", []).append(-1 if r.doc_id is None else r.doc_id)
    want = Counter((r.doc_id, max(g), len(g), hashlib.sha256((r.text or "").encode()).hexdigest()) for r in rows for g in [groups[r.text or ""]])
    assert Counter((r.doc_id, -1 if r.keep_id is None else r.keep_id, r.group_size, r.text_sha256) for r in got) == want
    assert Counter(r.text_sha256 for r in got if r.kept) == Counter({s: 1 for *_, s in want})  # one row of each group stays
    assert all(r.doc_id == r.keep_id for r in got if r.kept) and {r["row"] for r in got} == {"clash"}
    if bits == 64:
        assert max(r.n_chunks for r in got) > 20 and {r.n_chunks for r in got if r.text_sha256 == hashlib.sha256(b"").hexdigest()} == {0}


def _example(doc_id, text, rate=100, spm=50):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    h = [int(hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()[8 * k : 8 * k + 8], 16) for k in range(4)]
    a, b = sorted(x % (len(units) + 1) for x in h[:2])
    p, m, s = ("".join(u) for u in (units[:a], units[a:b], units[b:]))
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return len(units), "plain", None, None, text
    out = f"<S>{s}<P>{p}<M>{m}" if h[3] % 100 < spm else f"<P>{p}<S>{s}<M>{m}"
    return len(units), "spm" if h[3] % 100 < spm else "psm", len(p), len(m), out


@pytest.mark.parametrize("rate,spm", [(100, 50), (60, 0)])
def test_fill_in_middle(docs, rate, spm):
    made = fill_in_middle.transform(docs, rate=rate, spm_rate=spm)
    got = made.withColumn("back", fill_in_middle.restore(F.col("form"), F.col("output"))).collect()
    rows = docs.collect()
    assert Counter((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in got) == Counter((r.doc_id, *_example(r.doc_id, r.text, rate, spm)) for r in rows)
    assert Counter((r.doc_id, r.back) for r in got) == Counter((r.doc_id, r.text or "") for r in rows)


def test_fill_in_middle_marks_at_edges(spark):
    """Pieces of marks beside marks do not mislead the way back."""
    odd = ["<S\n>P>", "<\n<\n<P", "S>\n<M\n>", "<P\n<S\n<M", "\n<S", "$1 \\1\n\\E<S\n"]
    df = spark.createDataFrame([(k, t) for k in range(60) for t in odd], "doc_id int, text string")
    got = fill_in_middle.transform(df).select("doc_id", F.col("form"), fill_in_middle.restore(F.col("form"), F.col("output")).alias("back")).collect()
    assert Counter((r.doc_id, r.back) for r in got) == Counter((k, t) for k in range(60) for t in odd) and {"psm", "spm"} == {r.form for r in got}


def _brute_alignment(rows):
    import public_tokenizers as p
    import sentencepiece
    from tokenizers import Tokenizer

    a, b = Tokenizer.from_file(p.path("byte_bpe_50k.json")), sentencepiece.SentencePieceProcessor(model_file=p.path("piece_bpe_32k.model"))
    a.encode_special_tokens = True
    chars = alignment._byte_chars()
    names = {k: t for t, k in a.get_vocab().items()}
    own, counts = [], Counter()
    for doc_id, text in rows:
        x = a.encode(" " + text, add_special_tokens=False).ids if text else []
        y = b.encode(text) if text else []
        xb = [bytes(chars[c] for c in names[k]) for k in x]
        yb = [bytes([int(b.id_to_piece(k)[3:5], 16)]) if b.is_byte(k) else b.id_to_piece(k).replace("▁", " ").encode() for k in y]
        if not text or b"".join(xb) != (" " + text).encode() or b"".join(yb) != (" " + text).encode():
            own.append((doc_id, 0, 0, 0, [], ""))
            continue
        links, groups, i, j, at, ta, tb, ga, gb = [], [], 0, 0, 0, 0, 0, [], []
        xe, ye = np.cumsum([len(t) for t in xb]).tolist(), np.cumsum([len(t) for t in yb]).tolist()
        while i < len(x):
            links.append((x[i], y[j]))
            ga, gb = ga + [x[i]] * (ta != i + 1), gb + [y[j]] * (tb != j + 1)
            ta, tb = i + 1, j + 1
            ea, eb = xe[i], ye[j]
            i, j = i + (ea <= eb), j + (eb <= ea)
            if ea == eb:
                groups.append(",".join(map(str, ga)) + "|" + ",".join(map(str, gb)))
                ga, gb = [], []
        own.append((doc_id, len(x), len(y), len(groups), links, hashlib.sha256(";".join(groups).encode()).hexdigest()))
        counts.update(links)
    best: dict = {}
    for (_, y), n in counts.items():
        best[y] = max(best.get(y, 0), n)
    return Counter((d, na, nb, ng, len(links), sum(counts[k] == best[k[1]] for k in links), sum(counts[k] for k in links), sha) for d, na, nb, ng, links, sha in own)


COLUMNS = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


@pytest.mark.parametrize("block_links", [alignment.BLOCK_LINKS, 500])
def test_alignment(spark, docs, block_links, monkeypatch):
    import public_tokenizers as p

    monkeypatch.setattr(alignment, "LANE", 32 if block_links > 500 else 3)
    got = alignment.link_counts(docs, p.path("byte_bpe_50k.json"), p.path("piece_bpe_32k.model"), block_links=block_links)
    assert Counter(tuple(r[c] for c in COLUMNS) for r in got.collect()) == _brute_alignment([(r.doc_id, r.text) for r in docs.collect()])


def test_alignment_query(spark):
    got = queries.op13_alignment(spark, SF)
    assert got.columns == list(COLUMNS)
    want = _brute_alignment([(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()])
    assert Counter(tuple(r) for r in got.collect()) == want


def test_align_random():
    """Links and groups of random ends, however stretches are laid."""
    rng = np.random.default_rng(5)
    for _ in range(200):
        n = int(rng.integers(1, 60))
        common = np.unique(np.append(rng.integers(1, n + 1, rng.integers(0, 20)), n))
        a, b = (np.unique(np.concatenate([common, rng.integers(1, n + 1, rng.integers(0, 40))])) for _ in "ab")
        bounds = np.unique(np.append(rng.choice(common, rng.integers(0, 4)), n))
        ai, bi = np.searchsorted(a, bounds) + 1, np.searchsorted(b, bounds) + 1
        x, y, al, bl = alignment.align(a, b, np.append(0, ai[:-1]), ai, np.append(0, bi[:-1]), bi)
        want = {(int(np.searchsorted(a, p)), int(np.searchsorted(b, p))) for p in range(1, n + 1)}
        assert sorted(zip(x.tolist(), y.tolist(), strict=True)) == sorted(want)
        assert (al == np.isin(a, b)).all() and (bl == np.isin(b, a)).all()


def test_empty_tables(spark):
    import public_tokenizers as p

    empty = spark.createDataFrame([], DOCS)
    assert exact_dedup.mark(empty).count() == 0
    assert fill_in_middle.transform(empty).count() == 0
    assert alignment.link_counts(empty, p.path("byte_bpe_50k.json"), p.path("piece_bpe_32k.model")).count() == 0
    nothing = spark.createDataFrame([(1, None), (2, "")], "doc_id int, text string")
    assert {tuple(r) for r in alignment.link_counts(nothing, p.path("byte_bpe_50k.json"), p.path("piece_bpe_32k.model")).collect()} == {(k, 0, 0, 0, 0, 0, 0, "") for k in (1, 2)}


def test_units_span_batches(monkeypatch):
    """A worker that forgets units, and units too long to keep, give the same tokens."""
    import public_tokenizers as p

    tokens = alignment.UnitTokens(p.path("byte_bpe_50k.json"), p.path("piece_bpe_32k.model"))
    texts = pa.array(["some words here, " * 50 + "x" * 300, "other words"])
    first = alignment.align_texts(tokens, texts)
    monkeypatch.setattr(alignment, "CACHE_UNITS", 0)
    monkeypatch.setattr(alignment, "UNIT_BYTES", 3)
    second = alignment.align_texts(tokens, texts)
    assert first["sha"] == second["sha"] and (first["n_links"] == second["n_links"]).all()


def test_frequent_pieces_outlive_a_full_cache(monkeypatch):
    """When the tokenizer's cache is full, pieces of the texts at hand stay and the others go."""
    from sightline.llm import packing
    from sightline.llm.queries import tokenizer_path

    monkeypatch.setattr(packing, "CACHE_WORDS", 40)
    words, seen = packing.WordTokenizer(tokenizer_path()), []
    encode = words._encode
    monkeypatch.setattr(words, "_encode", lambda text: seen.append(text.split(" ")) or encode(text))
    often = [chr(97 + k) * 4 for k in range(20)]
    for k in range(4):
        rare = [chr(97 + j) * (5 + k) for j in range(26)]
        text = " ".join(often + rare)
        assert words.encode([text])[0].tolist() == words.library.encode(text, add_special_tokens=False).ids
        assert len(words.pieces) <= 60 + 46
    assert sum(part.count(often[0]) for part in seen) == 1
