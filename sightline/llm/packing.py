"""Hierarchical multi-length packing of tokenized documents.

A document is routed to the smallest of several context sizes (tiers) that holds it; what is longer is
cut into full windows of the largest tier and a rest. Tiers are packed from the longest to the shortest:
each piece opens a window of its tier, the gap takes the longest pieces of shorter tiers that fit, and
what remains of it takes the head of a short piece, whose rest goes back to its tier. So every window is
full. The pieces left over at the end of a partition are cut to windows at powers of two, so that they
need no padding either. Windows are then dealt to step groups of about equal numbers of tokens.

Packing works inside input partitions, on pools of bounded size: nothing is shuffled, and a lost
executor costs its partitions only. Tokenizing reuses the ids of words seen before in the worker.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_right, insort
from collections.abc import Iterator, Sequence
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches


TIERS = (256, 512, 1024, 2048)
END_ID = 1
#: A pool is packed when it holds so many tokens or documents.
POOL_TOKENS, POOL_DOCS = 6_000_000, 20_000
STEP_TOKENS = 65_536
#: Pieces of words that a worker keeps before it drops those that its last texts lack; some 60 MB.
CACHE_WORDS = 200_000


class WordTokenizer:
    """Ids of a word-level BPE of the ``tokenizers`` library, from a cache of pieces of words.

    The tokenizer normalizes (NFC, white space, lower case), cuts at white space and encodes what is between by itself,
    special tokens included, so the ids of a text are those of its words (between ASCII white space) in turn. Each
    distinct word of a slice of texts is looked up once; pieces not seen before are encoded together.
    """

    #: What the tokenizer makes of a word of plain characters: letters, one digit, an ending, or a run of anything else.
    PIECES = re.compile(r"[^\W\d_]+|\d|'(?:s|t|re|ve|m|ll|d)|(?:[^\w\s]|_)+")
    #: No combining marks, unusual spaces or numerals, nothing whose lower case depends on its place.
    PLAIN = re.compile("[\x20-\x7e\xa1-\xac\xae-\xb1\xb4-\xb8\xba\xbb\xbf-\u012f\u0131-\u024f\u2010-\u2027\u2030-\u205e\u20a0-\u20bf]*")

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.ends = np.zeros(self.library.get_vocab_size(), bool)  # ids that stand last in a piece
        self.ends[[k for t, k in self.library.get_vocab(with_added_tokens=False).items() if t.endswith("</w>")]] = True
        self.pieces: dict[str, bytes] = {}  # ids as little-endian 32-bit numbers

    def _ids(self, words: list[str]) -> list[bytes]:
        """Ids of distinct words: cut into pieces here where all characters are plain, and pieces not seen before encoded together."""
        low = " ".join(words).lower()
        odd: list[int] = []
        if "<|" in low or not self.PLAIN.fullmatch(low):
            plain = self.PLAIN.fullmatch
            odd = [k for k, w in enumerate(words) if not (w.isascii() and w.isprintable() or plain(w)) or "<|" in w]
            rest = list(words)
            for k in odd:
                rest[k] = ""
            low = " ".join(rest).lower()
        cut = [self.PIECES.findall(w) for w in low.split(" ")] if words else []
        used = set(chain.from_iterable(cut))
        unseen = list(used.difference(self.pieces))
        if len(self.pieces) > CACHE_WORDS * (1 if len(used) > CACHE_WORDS // 4 else 1.5):  # known pieces of many texts are the frequent ones
            self.pieces = {p: ids for p, ids in self.pieces.items() if p in used}
        for at in range(0, len(unseen), 5_000):  # what the library returns takes far more memory than the ids
            part = unseen[at : at + 5_000]
            ids = np.array(self._encode(" ".join(part)), "<u4")
            ends = (np.flatnonzero(self.ends[ids]) + 1) * 4
            data = ids.tobytes()
            self.pieces.update(zip(part, [data[a:b] for a, b in zip([0, *ends.tolist()], ends.tolist(), strict=False)], strict=True))
        get = self.pieces.__getitem__
        out = [get(c[0]) if len(c) == 1 else b"".join(map(get, c)) for c in cut]
        for k, e in zip(odd, self.library.encode_batch_fast([words[k] for k in odd], add_special_tokens=False), strict=True):
            out[k] = np.array(e.ids, "<u4").tobytes()
        return out

    def _encode(self, text: str) -> list[int]:
        return self.library.encode_batch_fast([text], add_special_tokens=False)[0].ids

    def encode_flat(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in turn, and where those of each begin (and the last end). Null texts have none."""
        cut = pc.ascii_split_whitespace(texts.fill_null(""))
        coded = cut.flatten().dictionary_encode()
        at, words = coded.indices.to_numpy(), coded.dictionary.to_pylist()
        own = self._ids(words)
        sizes = np.fromiter(map(len, own), np.int64, len(own)) // 4
        flat = np.frombuffer(b"".join(own), "<u4")
        n = sizes[at]
        ends = np.cumsum(n)
        place = np.repeat((np.cumsum(sizes) - sizes)[at] - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)
        offsets = cut.offsets.to_numpy() - cut.offsets[0].as_py()
        return flat[place], np.concatenate([[0], ends])[offsets]

    def encode(self, texts: Sequence[str | None]) -> list[np.ndarray]:
        ids, at = self.encode_flat(pa.array(texts, pa.string()))
        return [ids[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]


def slices(texts: pa.Array, most: int = 1 << 22) -> Iterator[pa.Array]:
    """The array cut into runs of rows with up to ``most`` bytes of text, or one row."""
    ends = np.cumsum(pc.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False))
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")))
        yield texts.slice(at, to - at)
        at = to


_TOKENIZERS: dict[str, WordTokenizer] = {}


def word_tokenizer(path: str) -> WordTokenizer:
    """The tokenizer of this Python worker, which keeps the pieces of the tasks it has run before."""
    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = WordTokenizer(path)
    return _TOKENIZERS[path]


class _Shelf:
    """Pieces (document, start, length) by length."""

    def __init__(self):
        self.items: list[tuple[int, int, int]] = []  # (length, -document, start): equal lengths go oldest first

    def put(self, doc: int, start: int, length: int) -> None:
        insort(self.items, (length, -doc, start))

    def longest(self, most: int) -> tuple[int, int, int] | None:
        k = bisect_right(self.items, (most, 1, 0))
        return self._out(k - 1) if k else None

    def _out(self, k: int) -> tuple[int, int, int]:
        length, doc, start = self.items.pop(k)
        return -doc, start, length


def pack_pieces(lengths: Sequence[int], tiers: Sequence[int] = TIERS) -> tuple[list[list[tuple[int, int, int]]], list[tuple[int, int, int]]]:
    """Full windows as lists of pieces (document, start, length), and the pieces left over (under one window)."""
    top, shelf, windows = tiers[-1], _Shelf(), []
    rest = []
    for doc, n in enumerate(lengths):
        for start in range(0, n - top + 1, top):
            windows.append([(doc, start, top)])
        if n % top:
            rest.append((n % top, -doc, n - n % top))
    shelf.items = sorted(rest)
    for size, below in zip(reversed(tiers), [*reversed(tiers[:-1]), 0], strict=True):
        while (first := shelf.longest(size)) is not None:
            if first[2] <= below:
                shelf.put(*first)
                break
            window, gap = [first], size - first[2]
            while gap and (piece := shelf.longest(gap)) is not None:
                window.append(piece)
                gap -= piece[2]
            if gap and shelf.items:  # all that is left is longer: cut the shortest
                doc, start, n = shelf._out(0)
                window.append((doc, start, gap))
                shelf.put(doc, start + gap, n - gap)
                gap = 0
            if gap:
                return windows, window
            windows.append(window)
    return windows, []


def cut_to_powers(pieces: list[tuple[int, int, int]], top: int) -> list[list[tuple[int, int, int]]]:
    """Windows at falling powers of two that the pieces fill exactly."""
    windows, todo, left = [], pieces[::-1], sum(p[2] for p in pieces)
    while left:
        size = min(top, 1 << (left.bit_length() - 1))
        left -= size
        window = []
        while size:
            doc, start, n = todo.pop()
            take = min(n, size)
            window.append((doc, start, take))
            if take < n:
                todo.append((doc, start + take, n - take))
            size -= take
        windows.append(window)
    return windows


def step_groups(sizes: Sequence[int], step_tokens: int) -> list[int]:
    """A group for each window: the longest first, each to the group with the fewest tokens so far."""
    import heapq

    heap = [(0, k) for k in range(max(1, round(sum(sizes) / step_tokens)))]
    out = [0] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        tokens, k = heapq.heappop(heap)
        out[i] = k
        heapq.heappush(heap, (tokens + sizes[i], k))
    return out


def pack(
    docs: DataFrame,
    tokenizer: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    tiers: Sequence[int] = TIERS,
    with_ids: bool = False,
) -> DataFrame:
    """One row per piece: id_col, start, length, ids_crc32, doc_tokens, sequence_id, offset, window, step_group.

    ``tokenizer``: path of a tokenizer file, there on every executor. Each document ends with id 1, so null and
    empty texts have one token. A window's pieces fill it without gaps; ``window`` is its size, the largest tier or
    a smaller power of two. Rows that repeat an id are packed one by one. ``with_ids`` adds the ids
    of each piece (array<bigint>). An empty table gives an empty table.
    """
    tiers = tuple(sorted(tiers))
    if any(t & (t - 1) for t in tiers):
        raise ValueError("tiers are powers of two")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        from pyspark import TaskContext

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        words = word_tokenizer(tokenizer)
        base = TaskContext.get().partitionId() << 32
        seq = step = 0
        pool: list[tuple[object, int, int, np.ndarray]] = []  # id, ids before, document's ids, ids
        tokens = 0

        def out(last: bool) -> pa.RecordBatch:
            nonlocal pool, tokens, seq, step
            windows, rest = pack_pieces([len(p[3]) for p in pool], tiers)
            if last:
                windows += cut_to_powers(rest, tiers[-1])
                rest = []
            sizes = [sum(p[2] for p in w) for w in windows]
            groups = step_groups(sizes, STEP_TOKENS) if windows else []
            cols: list[list] = [[] for _ in range(10)]
            for w, size, g in zip(windows, sizes, groups, strict=True):
                at = 0
                for d, start, n in w:
                    doc, before, total, ids = pool[d]
                    part = ids[start : start + n]
                    row = (doc, before + start, n, zlib.crc32(part), total, base + seq, at, size, base + step + g, part)
                    for c, x in zip(cols, row, strict=True):
                        c.append(x)
                    at += n
                seq += 1
            step += max(groups, default=-1) + 1
            pool = [(pool[d][0], pool[d][1] + s, pool[d][2], pool[d][3][s : s + n]) for d, s, n in rest]
            tokens = sum(len(p[3]) for p in pool)
            arrays = [pa.array(cols[0], id_type), *[pa.array(c, pa.int64()) for c in cols[1:9]]]
            if with_ids:
                arrays.append(pa.array(cols[9], pa.list_(pa.int64())))
            return pa.RecordBatch.from_arrays(arrays, names)

        id_type = None
        for b in batches:
            id_type = b.schema.field(0).type
            docs = iter(b.column(0).to_pylist())
            for part in slices(b.column(1)):
                ids, at = words.encode_flat(part)
                ids = np.insert(ids, at[1:], END_ID)
                at = (at + np.arange(len(at))).tolist()
                for lo, hi in zip(at[:-1], at[1:], strict=True):
                    pool.append((next(docs), 0, hi - lo, ids[lo:hi]))
                    tokens += hi - lo
                    if tokens >= POOL_TOKENS or len(pool) >= POOL_DOCS:
                        yield out(False)
        if pool:
            yield out(True)
        pa.default_memory_pool().release_unused()  # the worker waits for its next task beside others

    names = [id_col, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "window", "step_group"]
    names += ["ids"] * with_ids
    small_batches(docs.sparkSession)
    src = docs.select(F.col(id_col), F.col(text_col).alias("_text"))
    schema = f"`{id_col}` {src.schema[0].dataType.simpleString()}, " + ", ".join(f"{n} bigint" for n in names[1:9])
    return src.mapInArrow(run, schema + (", ids array<bigint>" if with_ids else ""))
