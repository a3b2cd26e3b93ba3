"""Alignment of two tokenizers' tokens over the same bytes, with corpus-wide counts of linked ids.

Both tokenizations are arrays of byte ends. From a place where both ended, a probe compares runs of the two arrays at the
current shift between their indices, twice as many tokens each time: a stretch of one-to-one tokens is jumped. Where
ends differ, the two indices step on by the lesser end until they meet again; that irregular group gives the new shift.
Many stretches of a batch are walked at once, one numpy operation for all.

Tokens are made for each distinct unit of a batch, a text's parts between spaces that neither tokenizer's pieces cross,
and kept for later batches. Counts need the corpus: a block of documents keeps its links as indices into its distinct
pairs, only these pairs meet their totals in a join, and each block gets the totals of its own pairs back.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Scratch

#: Units of a stretch that is walked beside others, units kept by a worker, bytes of the longest unit kept, links of a block.
LANE, CACHE_UNITS, UNIT_BYTES, BLOCK_LINKS = 32, 100_000, 64, 2_000_000
#: Tokens compared at most by one probe of a stretch.
WIDEST = 4096


def align(a: np.ndarray, b: np.ndarray, a_from: np.ndarray, a_to: np.ndarray, b_from: np.ndarray, b_to: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Links (token of a, token of b), and which tokens of a and of b end a group.

    ``a`` and ``b``: byte ends, rising. Stretch k holds tokens a_from[k]..a_to[k] and b_from[k]..b_to[k], which begin and end together.
    """
    i, j, width = a_from.copy(), b_from.copy(), np.ones(len(a_from), np.int64)
    links: list[tuple[np.ndarray, np.ndarray]] = [(np.empty(0, np.int64), np.empty(0, np.int64))]
    a_last, b_last = np.zeros(len(a), bool), np.zeros(len(b), bool)
    at = np.flatnonzero(i < a_to)
    while len(at):
        n = np.minimum(np.minimum(width[at], a_to[at] - i[at]), b_to[at] - j[at])
        end = np.cumsum(n)
        k = np.arange(end[-1]) - np.repeat(end - n, n)
        x, y = np.repeat(i[at], n) + k, np.repeat(j[at], n) + k
        same = a[x] == b[y]
        run = np.minimum(n, np.minimum.reduceat(np.where(same, WIDEST, k), end - n))  # tokens before the first that differs
        hit = k < np.repeat(run, n)
        x, y = x[hit], y[hit]
        links.append((x, y))
        a_last[x] = b_last[y] = True
        i[at] += run
        j[at] += run
        whole = run == n
        width[at] = np.where(whole, np.minimum(2 * width[at], WIDEST), 1)
        odd = at[~whole]
        x, y = i[odd], j[odd]
        while len(odd):
            links.append((x, y))
            to_a, to_b = a[x], b[y]
            met = to_a == to_b
            a_last[x[met]] = b_last[y[met]] = True
            x, y = x + (to_a <= to_b), y + (to_b <= to_a)
            i[odd[met]], j[odd[met]] = x[met], y[met]
            odd, x, y = odd[~met], x[~met], y[~met]
        at = at[i[at] < a_to[at]]
    return np.concatenate([x for x, _ in links]), np.concatenate([y for _, y in links]), a_last, b_last


def _byte_chars() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones themselves, the rest from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


class UnitTokens:
    """Tokens (id and bytes) of units by a byte-level BPE (a file of ``tokenizers``) and a ``sentencepiece`` model."""

    def __init__(self, a_path: str, b_path: str):
        import sentencepiece
        from tokenizers import Tokenizer

        self.a, self.b = Tokenizer.from_file(a_path), sentencepiece.SentencePieceProcessor(model_file=b_path)
        self.a.encode_special_tokens = True
        chars, vocab = _byte_chars(), self.a.get_vocab(with_added_tokens=True)
        self.a_bytes = [b""] * (max(vocab.values()) + 1)
        for t, k in vocab.items():
            self.a_bytes[k] = bytes(chars[c] for c in t) if all(c in chars for c in t) else b""
        n = self.b.get_piece_size()
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(k) else p.replace("▁", " ").encode() for k, p in ((k, self.b.id_to_piece(k)) for k in range(n))]
        if any(" " in p.strip(" ") for p in (t.decode("utf-8", "ignore") for t in self.b_bytes)):
            raise ValueError("the model has pieces across spaces, so units are not independent")
        # id and length in one number
        self.a_codes = np.array([k << 32 | len(t) for k, t in enumerate(self.a_bytes)])
        self.b_codes = np.array([k << 32 | len(t) for k, t in enumerate(self.b_bytes)])
        self.kept: dict[bytes, tuple[bytes, bytes] | None] = {}
        after = [f"{k}{s}".encode() for last, ids in (("|", self.a_bytes), (";", self.b_bytes)) for k in range(len(ids)) for s in (",", last)]
        self.texts = pa.array(after, pa.binary())

    def _each(self, units: list[bytes]) -> Iterator[tuple[bytes, bytes] | None]:
        """The units one by one."""
        words = [u.decode() for u in units]
        found = self.a.encode_batch_fast(words, add_special_tokens=False)
        for u, x, y in zip(units, found, self.b.encode([w[1:] for w in words], num_threads=1), strict=True):
            if b"".join(map(self.a_bytes.__getitem__, x.ids)) == u == b"".join(map(self.b_bytes.__getitem__, y)):
                yield self.a_codes[x.ids].tobytes(), self.b_codes[y].tobytes()
            else:
                yield None

    def _joined(self, units: list[bytes]) -> Iterator[tuple[bytes, bytes] | None]:
        """Units whose first and last characters are plain, as one text; one by one if that text is not rebuilt."""
        text, sides = b"".join(units), []
        word = text.decode()
        ends = np.cumsum(np.fromiter(map(len, units), np.int64, len(units)))
        for ids, own, codes in ((self.a.encode_batch_fast([word], add_special_tokens=False)[0].ids, self.a_bytes, self.a_codes), (self.b.encode(word[1:]), self.b_bytes, self.b_codes)):
            if b"".join(map(own.__getitem__, ids)) != text:
                return self._each(units)
            found = codes[ids]
            to = np.cumsum(found & 0xFFFFFFFF)
            at = np.searchsorted(to, ends)
            if (to[at] != ends).any():
                return self._each(units)
            data, at = found.tobytes(), ((at + 1) * 8).tolist()
            sides.append([data[x:y] for x, y in zip([0, *at], at, strict=False)])
        return zip(*sides, strict=True)

    def codes(self, units: list[bytes], count: np.ndarray) -> list[tuple[bytes, bytes] | None]:
        """For each unit its codes by both; none if the tokens' bytes are not the unit's. Those that stand more than once are kept."""
        if len(self.kept) > CACHE_UNITS:
            self.kept.clear()
        new = [u for u in units if u not in self.kept]
        plain = [u for u in new if len(u) > 1 and 0x20 < u[1] < 0x7F and 0x20 < u[-1] < 0x7F]
        odd = [u for u in new if not (len(u) > 1 and 0x20 < u[1] < 0x7F and 0x20 < u[-1] < 0x7F)]
        own: dict[bytes, tuple[bytes, bytes] | None] = {}
        for rows, encode in ((plain, self._joined), (odd, self._each)):
            for lo in range(0, len(rows), 500):
                part = rows[lo : lo + 500]
                own.update(zip(part, encode(part), strict=True))
        out = [own[u] if u in own else self.kept[u] for u in units]
        self.kept.update((u, own[u]) for u, n in zip(units, count.tolist(), strict=True) if n > 1 and u in own and len(u) <= UNIT_BYTES)
        return out


def unit_starts(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Where units start: at the texts' ``starts``, and at single spaces between characters that are plainly no white space or marks."""
    lead = np.zeros(256, bool)
    lead[0x21:0x7F] = lead[0xC3:0xCA] = lead[0xD0:0xD2] = lead[0xE4:0xEE] = True
    two, three = np.zeros(256, bool), np.zeros(256, bool)
    two[0xC3:0xE0] = three[0xE4:0xEE] = True
    at = np.flatnonzero(data == 0x20)
    at = at[(at > 2) & (at < len(data) - 1)]
    prev, after = data[at - 1], data[at + 1]
    ascii_ = (prev > 0x20) & (prev < 0x7F)
    other = (prev >= 0x80) & (two[data[at - 2]] | (three[data[at - 3]] & (data[at - 2] >= 0x80)))
    found = np.zeros(len(data), bool)
    found[starts] = found[at[(ascii_ | other) & lead[after]]] = True
    return np.flatnonzero(found)


def _expand(codes: list[bytes], unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids and byte ends of all tokens of the units in turn, and each unit's number of tokens."""
    size = np.fromiter(map(len, codes), np.int64, len(codes)) // 8
    flat = np.frombuffer(b"".join(codes), np.int64)
    n = size[unit]
    end = np.cumsum(n)
    place = np.repeat((np.cumsum(size) - size)[unit] - (end - n), n) + np.arange(end[-1] if len(end) else 0)
    found = flat[place]
    return found >> 32, np.cumsum(found & 0xFFFFFFFF), n


_WORKERS: dict[tuple[str, str], UnitTokens] = {}


def _tokens(a_path: str, b_path: str) -> UnitTokens:
    key = (a_path, b_path)
    if key not in _WORKERS:
        _WORKERS[key] = UnitTokens(*key)
    return _WORKERS[key]


def align_texts(tokens: UnitTokens, texts: pa.Array) -> dict[str, np.ndarray | list]:
    """For each text n_a, n_b, n_groups, n_links and the digest of its groups; and its distinct linked pairs: doc, key, n.

    A key is the id of a times the number of b's ids, plus the id of b. Texts that are null, empty or not rebuilt by both have nothing.
    """
    zero = np.zeros(len(texts), np.int64)
    out = {"n_a": zero, "n_b": zero.copy(), "n_groups": zero.copy(), "n_links": zero.copy(), "sha": [""] * len(texts)}
    out |= {"doc": np.empty(0, np.int64), "key": np.empty(0, np.int64), "n": np.empty(0, np.int64)}
    real = np.flatnonzero(pc.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False))
    if not len(real):
        return out
    spaced = pc.binary_join_element_wise(pa.scalar(" ", pa.large_string()), pc.cast(texts.take(pa.array(real)), pa.large_string()), pa.scalar("", pa.large_string()))
    offsets = np.frombuffer(spaced.buffers()[1], np.int64)[: len(real) + 1]
    data = np.frombuffer(spaced.buffers()[2], np.uint8)[: offsets[-1]]
    starts = unit_starts(data, offsets[:-1])
    units = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(np.append(starts, offsets[-1])), pa.py_buffer(data)]).dictionary_encode()
    unit = units.indices.to_numpy().astype(np.int64)
    codes = tokens.codes(units.dictionary.to_pylist(), np.bincount(unit))
    doc = np.searchsorted(offsets, starts, "right") - 1
    bad = np.zeros(len(real), bool)
    bad[doc[np.array([c is None for c in codes], bool)[unit]]] = True
    good = ~bad[doc]
    unit, doc = unit[good], real[doc[good]]
    if not len(unit):
        return out
    a_ids, a_ends, a_n = _expand([c[0] if c else b"" for c in codes], unit)
    b_ids, b_ends, b_n = _expand([c[1] if c else b"" for c in codes], unit)
    a_at, b_at = np.concatenate([[0], np.cumsum(a_n)]), np.concatenate([[0], np.cumsum(b_n)])
    lanes = np.append(np.arange(0, len(unit), LANE), len(unit))
    x, y, a_last, b_last = align(a_ends, b_ends, a_at[lanes[:-1]], a_at[lanes[1:]], b_at[lanes[:-1]], b_at[lanes[1:]])
    a_doc, b_doc = np.repeat(doc, a_n), np.repeat(doc, b_n)
    out["n_a"], out["n_b"] = (np.bincount(d, minlength=len(texts)) for d in (a_doc, b_doc))
    out["n_groups"], out["n_links"] = np.bincount(a_doc[a_last], minlength=len(texts)), np.bincount(a_doc[x], minlength=len(texts))
    # groups as text: a's tokens of a group, then b's
    a_end, b_end = np.flatnonzero(a_last) + 1, np.concatenate([[0], np.flatnonzero(b_last) + 1])
    order = np.empty(len(a_ids) + len(b_ids), np.int64)
    order[np.arange(len(a_ids)) + b_end[np.cumsum(a_last) - a_last]] = 2 * a_ids + a_last
    order[np.arange(len(b_ids)) + a_end[np.cumsum(b_last) - b_last]] = 2 * (len(tokens.a_bytes) + b_ids) + b_last
    written = tokens.texts.take(pa.array(order))
    chars = np.frombuffer(written.buffers()[1], np.int32)
    view = memoryview(written.buffers()[2])
    to = np.cumsum(out["n_a"] + out["n_b"])
    for d in np.flatnonzero(out["n_a"]).tolist():
        out["sha"][d] = hashlib.sha256(view[chars[to[d] - out["n_a"][d] - out["n_b"][d]] : chars[to[d]] - 1]).hexdigest()
    n_keys = len(tokens.a_bytes) * len(tokens.b_bytes)
    cells = np.sort(a_doc[x] * n_keys + a_ids[x] * len(tokens.b_bytes) + b_ids[y])
    first = np.flatnonzero(np.concatenate([[True], cells[1:] != cells[:-1]]))
    out["doc"], out["key"], out["n"] = cells[first] // n_keys, cells[first] % n_keys, np.diff(np.append(first, len(cells)))
    return out


_STATS = ("n_a", "n_b", "n_groups", "n_links")


def link_counts(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text", block_links: int = BLOCK_LINKS) -> DataFrame:
    """One row per input row: id_col, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    ``a_path``: a byte-level BPE of ``tokenizers``, over a space and the text; ``b_path``: a ``sentencepiece`` model, which adds the
    space. Both files are there on every executor. Texts that are null, empty or not rebuilt by both have zeros and ''. A pair's
    count is the number of links of the corpus that hold it; rows that repeat count each. n_best are the links whose pair has the
    highest count of all pairs of its b id; count_sum is the sum of counts over links. Texts of any length are read whole. An empty
    table gives an empty table.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "alignment")
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = src.schema[0].dataType.simpleString()

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        from pyspark import TaskContext

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        tokens, block = _tokens(a_path, b_path), TaskContext.get().partitionId() << 33
        held: list[tuple[pa.Array, dict]] = []

        def out() -> pa.RecordBatch:
            nonlocal held, block
            ids = pa.concat_arrays([i for i, _ in held])
            n_docs = np.cumsum([0, *[len(i) for i, _ in held]])
            doc = np.concatenate([f["doc"] + d for d, (_, f) in zip(n_docs, held, strict=False)])
            n = np.concatenate([f["n"] for _, f in held])
            keys, place = np.unique(np.concatenate([f["key"] for _, f in held]), return_inverse=True)
            sums = np.bincount(place, n, len(keys)).astype(np.int64)
            cells = np.concatenate([np.diff(place.astype(np.uint32), prepend=np.uint32(0)), n.astype(np.uint32)])  # differences wrap
            one = lambda a: pa.ListArray.from_arrays(pa.array([0, len(a)], pa.int32()), a)
            stats = [one(pa.array(np.concatenate([f[s] for _, f in held]))) for s in _STATS]
            sha = one(pa.array([s for _, f in held for s in f["sha"]], pa.string()))
            cols = [pa.array([block]), one(ids), *stats, sha, one(pa.array(np.bincount(doc, minlength=len(ids)))), pa.array([pa.compress(cells.tobytes(), "zstd", asbytes=True)]), one(pa.array(keys)), one(pa.array(sums))]
            held, block = [], block + 1
            return pa.RecordBatch.from_arrays(cols, names)

        links = 0
        for b in batches:
            found = align_texts(tokens, b.column(1))
            held.append((b.column(0), found))
            links += int(found["n_links"].sum()) + len(b)
            if links >= block_links:
                yield out()
                links = 0
        if held:
            yield out()
        pa.default_memory_pool().release_unused()

    names = ["block", "ids", *_STATS, "sha", "n_cells", "cells", "keys", "sums"]
    longs = ", ".join(f"{c} array<bigint>" for c in _STATS)
    made = src.mapInArrow(blocks, f"block bigint, ids array<{kind}>, {longs}, sha array<string>, n_cells array<bigint>, cells binary, keys array<bigint>, sums array<bigint>")
    made = scratch.save(made, "blocks")
    n_b = _tokens_of_b(b_path)
    pairs = made.select("block", F.posexplode(F.arrays_zip("keys", "sums")).alias("k", "x")).select("block", "k", F.col("x.keys").alias("key"), F.col("x.sums").alias("n"))
    totals = pairs.groupBy("key").agg(F.sum("n").alias("total"))
    # a b id has no more pairs than there are a ids
    totals = totals.withColumn("best", F.col("total") == F.max("total").over(Window.partitionBy(F.col("key") % n_b)))
    counted = pairs.select("block", "k", "key").join(totals, "key").groupBy("block").agg(*[F.collect_list(c).alias(c) for c in ("k", "total", "best")])
    full = made.drop("keys", "sums").join(counted, "block", "left")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in range(len(b)):
                col = {c: b.column(k).slice(r, 1) for k, c in enumerate(b.schema.names)}
                flat = {c: pc.list_flatten(col[c]) for c in ("ids", *_STATS, "sha", "n_cells", "k", "total", "best")}
                n_cells, k = flat["n_cells"].to_numpy(), flat["k"].to_numpy()
                m = int(n_cells.sum())
                cells = np.frombuffer(pa.decompress(col["cells"][0].as_buffer(), 8 * m, "zstd"), np.uint32)
                total, best = np.zeros(len(k), np.int64), np.zeros(len(k), np.int64)
                total[k], best[k] = flat["total"].to_numpy(), flat["best"].to_numpy(zero_copy_only=False)
                place, n = np.cumsum(cells[:m], dtype=np.uint32), cells[m:].astype(np.int64)
                end = np.cumsum(n_cells)

                def per_doc(x: np.ndarray) -> pa.Array:
                    sums = np.concatenate([[0], np.cumsum(x)])
                    return pa.array(sums[end] - sums[end - n_cells])

                yield pa.RecordBatch.from_arrays([flat["ids"], *[flat[s] for s in _STATS], per_doc(n * best[place]), per_doc(n * total[place]), flat["sha"]], result)

    result = [id_col, *_STATS, "n_best", "count_sum", "groups_sha256"]
    full = full.select("block", "ids", *_STATS, "sha", "n_cells", "cells", "k", "total", "best")
    return full.mapInArrow(rows, f"`{id_col}` {kind}, " + ", ".join(f"{c} bigint" for c in result[1:-1]) + ", groups_sha256 string")


def _tokens_of_b(path: str) -> int:
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path).get_piece_size()
