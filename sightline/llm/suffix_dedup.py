"""Removal of repeated byte strings by column-wise suffix sorting of a collection.

What is asked: every byte covered by a string of ``length`` bytes that also starts anywhere else.

1. Routing. Each window of ``length`` bytes has an anchor: the first place in it where the hash of ``GRAM`` bytes
   is least. Equal windows have equal anchors at equal places, so a repeat lies within segments that
   reach ``length - GRAM`` bytes before and ``length`` bytes after anchors of equal hash. Segments that
   are equal throughout are collapsed and counted; anchors whose hash occurs once are dropped. Only segments
   that differ from another of the same anchor go on, each once.
2. Suffix sorting of all segments of an anchor as one collection, column-wise and for many anchors at
   once: each round inserts one symbol in front of every segment's suffix, re-sorts the suffixes
   by that symbol (a stable deal, as the others are sorted already) and updates the common prefixes of neighbours
   (1 + the least common prefix in between, or 0). The symbols read in a round, in suffix order, are the
   round's column of the Burrows-Wheeler transform. Columns are read from a file, one after another, that
   stays in memory while it is small. Segments are aligned at their anchors, so suffixes of
   unequal lengths are never compared and earlier columns need not be kept. A suffix whose common prefix
   with a neighbour reaches ``length`` starts a repeat.
3. Repeats are carried back to all copies of a segment, and cut from each text.

Bytes outside a document match nothing, not even each other, so matches never cross documents.
"""

from __future__ import annotations

import hashlib
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, without

LENGTH, GRAM = 400, 48
#: Length at which a passage of over fifty words counts: fifty words of three letters and a space.
PASSAGE = 200
#: Texts are hashed together up to so many bytes; longer ones in overlapping pieces.
PIECE_BITS = 22
#: Segments that are sorted together, about; an anchor with more distinct ones is split.
ROWS = 20_000


def _gram_hashes(b: np.ndarray, gram: int) -> np.ndarray:
    """64-bit hashes of all strings of ``gram`` bytes (8, 16, 32 or 48)."""
    n = len(b) - 7
    h = np.ndarray((n,), "<u8", b.tobytes(), strides=(1,)).copy()
    by_width, width = {8: h}, 8
    while width * 2 <= gram:
        h = h[:-width] * np.uint64(0x9E3779B97F4A7C15) + h[width:]
        width *= 2
        by_width[width] = h
    if gram - width:
        rest = by_width[gram - width][width:]
        h = h[: len(rest)] * np.uint64(0xC2B2AE3D27D4EB4F) + rest
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def anchors(texts: list[bytes], length: int, gram: int, bits: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchors (text number, place, hash) of all windows of the texts, which hold ``2**bits`` bytes at most (PIECE_BITS)."""
    sizes = np.array([len(t) for t in texts], np.int64)
    b = np.frombuffer(b"".join(texts), np.uint8)
    none = np.empty(0, np.int64)
    if len(b) < length:
        return none, none, none.astype(np.uint64)
    ends = np.cumsum(sizes)
    starts = ends - sizes
    h = _gram_hashes(b, gram)
    low = np.uint64((1 << (bits or PIECE_BITS)) - 1)
    least = (h & ~low) | np.arange(len(h), dtype=np.uint64)  # of equal hashes, the first
    span, width = length - gram + 1, 1
    while width * 2 <= span:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if span > width:
        least = np.minimum(least[: width - span], least[span - width :])
    inside = np.zeros(len(least) + 1, np.int32)
    long = sizes >= length
    np.add.at(inside, starts[long], 1)
    np.add.at(inside, ends[long] - length + 1, -1)
    at = (least[np.cumsum(inside)[:-1] > 0] & low).astype(np.int64)
    at = at[np.concatenate([[True], at[1:] != at[:-1]])] if len(at) else at
    doc = np.searchsorted(ends, at, "right")
    return doc, at - starts[doc], h[at]


def _pieces(text: bytes, length: int, bits: int | None = None) -> Iterator[tuple[int, bytes]]:
    step = (1 << (bits or PIECE_BITS)) - length
    for at in range(0, max(1, len(text) - length + 1), step):
        yield at, text[at : at + step + length - 1]


def repeated_starts(anchor: np.ndarray, left: np.ndarray, right: np.ndarray, data: list[bytes], length: int, before: int) -> tuple[np.ndarray, np.ndarray]:
    """First and last place, from the anchor, where a repeat starts in each segment; first > last: none.

    ``anchor``: sorted group numbers. ``data``: bytes from ``left`` before to ``right`` after the anchor.
    """
    m, width = len(anchor), before + length
    first, last = np.full(m, width, np.int64), np.full(m, -width - 1, np.int64)
    with tempfile.SpooledTemporaryFile(max_size=1 << 27) as file:
        for at in range(0, m, 4096):  # rows to columns, block by block
            block = np.zeros((min(4096, m - at), width), np.uint8)
            for k, d in enumerate(data[at : at + 4096]):
                block[k, before - left[at + k] : before - left[at + k] + len(d)] = np.frombuffer(d, np.uint8)
            for j, column in enumerate(np.ascontiguousarray(block.T)):
                file.seek(j * m + at)
                file.write(column.tobytes())
        order, common = np.arange(m), np.zeros(m, np.int64)
        group = anchor.astype(np.int64) * 512
        head = np.concatenate([[True], group[1:] != group[:-1]])
        for j in range(width - 1, -1, -1):
            file.seek(j * m)
            symbol = np.frombuffer(file.read(m), np.uint8)[order].astype(np.int64)
            at = j - before
            outside = (left < -at) | (right <= at)
            if outside.any():
                symbol[outside[order]] = 256
            key = group + symbol
            if (key[1:] >= key[:-1]).all():
                same = np.concatenate([[False], key[1:] == key[:-1]])
                common = np.where(same, common + 1, 0)
            else:
                deal = np.argsort(key, kind="stable")
                key, symbol = key[deal], symbol[deal]
                same = np.concatenate([[False], key[1:] == key[:-1]])
                new = np.where(same, common[deal] + 1, 0)
                far = np.flatnonzero(same & (np.diff(deal, prepend=-1) > 1))
                if len(far):
                    ends = np.stack([deal[far - 1] + 1, deal[far] + 1], axis=1).ravel()
                    new[far] = np.minimum.reduceat(np.append(common, width), ends)[::2] + 1
                common, order = new, order[deal]
            common[(symbol == 256) | head] = 0
            if at <= 0:
                hit = np.flatnonzero(common >= length)
                if len(hit):
                    rows = order[np.concatenate([hit, hit - 1])]
                    first[rows] = np.minimum(first[rows], at)
                    last[rows] = np.maximum(last[rows], at)
    return first, last


def _segment(text: bytes, at: int, length: int, before: int) -> tuple[int, int, bytes]:
    left, right = min(at, before), min(len(text) - at, length)
    return left, right, text[at - left : at + right]


def _sort(segments: DataFrame, length: int, before: int) -> DataFrame:
    """(anchor, s1, s2, a, b): where repeats start and end, of distinct segments (anchor, s1, s2, left, right, data) that have any."""

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        count = 0

        def out(t: pa.Table) -> pa.RecordBatch:
            anchor = t["anchor"].to_numpy()
            group = np.cumsum(np.concatenate([[0], anchor[1:] != anchor[:-1]]))
            first, last = repeated_starts(group, t["left"].to_numpy(), t["right"].to_numpy(), t["data"].to_pylist(), length, before)
            some = first <= last
            arrays = [anchor[some], t["s1"].to_numpy()[some], t["s2"].to_numpy()[some], first[some], last[some] + length]
            return pa.RecordBatch.from_arrays([pa.array(x) for x in arrays], ["anchor", "s1", "s2", "a", "b"])

        for b in batches:
            held.append(b)
            count += b.num_rows
            if count >= ROWS:
                t = pa.Table.from_batches(held)
                anchor = t["anchor"].to_numpy()
                end = int(np.searchsorted(anchor, anchor[-1]))
                if end:
                    yield out(t.slice(0, end))
                held, count = t.slice(end).combine_chunks().to_batches(), len(t) - end
        if count:
            yield out(pa.Table.from_batches(held))

    rows = segments.repartition("anchor").sortWithinPartitions("anchor", "s1", "s2")
    return rows.mapInArrow(sort, "anchor bigint, s1 bigint, s2 bigint, a bigint, b bigint")


def _halves(digests: list[bytes]) -> list[np.ndarray]:
    """128-bit digests as two columns of 64-bit numbers."""
    x = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
    return [x[:, 0], x[:, 1]]


class _Rows:
    """Output rows gathered by column, given out as a batch once there are enough."""

    def __init__(self, **kinds: pa.DataType):
        self.kinds, self.cols = kinds, [[] for _ in kinds]

    def add(self, *row: object) -> None:
        for c, x in zip(self.cols, row, strict=True):
            c.append(x)

    def out(self, least: int = 1) -> Iterator[pa.RecordBatch]:
        if len(self.cols[0]) >= least:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(self.cols, self.kinds.values(), strict=True)], list(self.kinds))
            self.cols = [[] for _ in self.kinds]


#: Rows of an output batch, about.
OUT_ROWS = 20_000
_I32, _I64 = pa.int32(), pa.int64()


#: Starts that a part of a split anchor covers.
PART = 44


def _split(texts: DataFrame, scratch: Scratch, length: int, before: int) -> DataFrame:
    """(anchor, sig, a, b) like :func:`_sort`, for anchors with more distinct segments than a task should sort.

    The starts around an anchor are cut into parts of ``PART``. All windows of a part share a core, whose hash
    is part of the key, and equal pieces are collapsed before they meet. Of what is left, only parts that
    an end of a common passage falls into stay large: their windows are compared whole, by hash and count, which
    combines before the shuffle.
    """
    import xxhash

    h64, h128 = xxhash.xxh3_64_intdigest, xxhash.xxh3_128_digest

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = _Rows(anchor=_I64, s1=_I64, s2=_I64, key=_I64, sub=pa.binary(), high=_I32, first=_I32, last=_I32, data=pa.binary())
        for b in batches:
            for t, places in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                for p in places:
                    at = p["at"]
                    for low in range(-before, 1, PART):
                        high = min(low + PART - 1, 0)
                        first, last = max(low, -at), min(high, len(t) - at - length)
                        if first <= last:
                            data = t[at + first : at + last + length]
                            key = h64(t[at + high : at + low + length], low + before) ^ (p["anchor"] & (2**64 - 1))
                            rows.add(p["anchor"], p["s1"], p["s2"], key - 2**64 * (key >> 63), h128(data, first - low), high, first, last, data)
                    yield from rows.out(OUT_ROWS)
        yield from rows.out()

    parts = texts.mapInArrow(cut, "anchor bigint, s1 bigint, s2 bigint, key bigint, sub binary, high int, first int, last int, data binary")
    parts = scratch.save(parts, "parts")
    small = parts.drop("data")
    seg = ["anchor", "s1", "s2"]
    kinds = small.groupBy("key", "sub").agg(F.count("*").alias("n"), F.min(F.struct(*seg, "high")).alias("rep"))
    sizes = kinds.groupBy("key").agg(F.count("*").alias("m"))
    kinds = scratch.save(kinds.join(sizes.where("m > 1"), "key", "left").withColumn("m", F.coalesce("m", F.lit(1))), "part-kinds")
    some = kinds.where("m > 1").select("key", "sub", "m", "rep.*")
    reps = scratch.save(parts.drop("key", "sub").join(some, [*seg, "high"]), "part-reps")
    sortable = reps.where(F.col("m") <= ROWS).select(
        F.col("key").alias("anchor"), F.xxhash64("sub").alias("s1"), F.xxhash64(F.lit(1), "sub").alias("s2"), "sub",
        (F.col("high") - F.col("first")).alias("left"), (F.col("last") + length - F.col("high")).alias("right"), "data",
    )
    found = _sort(sortable.drop("sub"), length, PART - 1).withColumnRenamed("anchor", "key")
    found = found.join(sortable.select(F.col("anchor").alias("key"), "s1", "s2", "sub"), ["key", "s1", "s2"]).select("key", "sub", "a", "b")

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = _Rows(key=_I64, sub=pa.binary(), a=_I64, window=pa.binary())
        for b in batches:
            for key, sub, rest, data in zip(*[b.column(k).to_pylist() for k in range(4)], strict=True):
                for k in range(len(data) - length + 1):
                    rows.add(key, sub, rest + k, h128(data[k : k + length]))
                yield from rows.out(OUT_ROWS)
        yield from rows.out()

    large = reps.where(F.col("m") > ROWS).select("key", "sub", (F.col("first") - F.col("high")).cast("bigint").alias("rest"), "data")
    each = scratch.save(large.mapInArrow(windows, "key bigint, sub binary, a bigint, window binary"), "windows")
    again = each.groupBy("key", "a", "window").agg(F.count("*").alias("n")).where("n > 1").drop("n")
    whole = each.join(again, ["key", "a", "window"]).groupBy("key", "sub").agg(F.min("a").alias("a"), (F.max("a") + length).alias("b"))
    ranges = kinds.select("key", "sub", "n").join(found.unionByName(whole), ["key", "sub"], "left").where("n > 1 or a is not null")
    placed = small.join(ranges, ["key", "sub"])
    a = F.when(F.col("n") > 1, F.col("first")).otherwise(F.col("high") + F.col("a"))
    b = F.when(F.col("n") > 1, F.col("last") + length).otherwise(F.col("high") + F.col("b"))
    # every window holds the anchor, so ranges of one segment overlap
    out = placed.select(*seg, a.cast("bigint").alias("a"), b.cast("bigint").alias("b")).groupBy(*seg).agg(F.min("a").alias("a"), F.max("b").alias("b"))
    out = scratch.save(out, "split")
    scratch.drop("parts", "part-kinds", "part-reps", "windows")
    return out


#: Two hashes of a text, its identity: 128 bits.
KEY = ("k1", "k2")


def _identity(text: str) -> list[Column]:
    return [F.xxhash64(text).alias("k1"), F.xxhash64(F.lit("second"), F.col(text)).alias("k2")]


def spans(
    docs: DataFrame, text: Column, scratch: Scratch, length: int = LENGTH, gram: int = GRAM, within: DataFrame | None = None
) -> DataFrame:
    """(k1, k2, spans): of each distinct text (named by 128 bits) with a repeat, all repeated ranges [a, b).

    A range may end beyond the text, where the text's end is meant. ``within``: the same for a shorter length, which
    speeds the search up: a string that repeats lies wholly in a run of shorter ones, so only long runs are read.
    """
    import xxhash

    before = length - gram
    keyed = docs.select(text.cast("binary").alias("text")).where(F.octet_length("text") >= length)
    keyed = keyed.select("text", *_identity("text"))
    searched = keyed.withColumn("spans", F.lit(None).cast("array<struct<a:bigint,b:bigint>>")) if within is None else keyed.join(within, list(KEY))
    searched = searched.select("text", *KEY, "spans")

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, keys, runs = b.column(0).to_pylist(), [b.column(k).to_numpy() for k in (1, 2)], b.column(3).to_pylist()
            held: list[tuple[int, int, bytes]] = []
            total, end = 0, (-1, -1)

            def out() -> pa.RecordBatch:
                nonlocal end
                piece, at, h = anchors([p[2] for p in held], length, gram, PIECE_BITS)
                doc = np.array([p[0] for p in held])[piece]
                at = at + np.array([p[1] for p in held])[piece]
                # the last window of a piece and the first of the text's next one mostly have the same anchor
                new = (np.diff(doc, prepend=end[0]) != 0) | (np.diff(at, prepend=end[1]) != 0)
                end = (int(doc[-1]), int(at[-1]))
                doc, at, h = doc[new], at[new], h[new]
                size = np.array([len(t) for t in texts])[doc]
                left, right = np.minimum(at, before), np.minimum(size - at, length)
                digest = xxhash.xxh3_128_digest
                sig = [digest(texts[d][p - x : p + y], x) for d, p, x, y in zip(doc.tolist(), at.tolist(), left.tolist(), right.tolist(), strict=True)]
                arrays = [h.view(np.int64), *_halves(sig), *[k[doc] for k in keys], at]
                return pa.RecordBatch.from_arrays([pa.array(x) for x in arrays], ["anchor", "s1", "s2", "k1", "k2", "at"])

            for k, t in enumerate(texts):
                for lo, hi in [(0, len(t))] if runs[k] is None else merge([(x["a"], min(x["b"], len(t))) for x in runs[k]]):
                    if hi - lo < length:
                        continue
                    for start, piece in _pieces(t[lo:hi], length, PIECE_BITS):
                        if held and total + len(piece) > 1 << PIECE_BITS:
                            yield out()
                            held, total = [], 0
                        held.append((k, lo + start, piece))
                        total += len(piece)
            if held:
                yield out()

    found = searched.mapInArrow(find, "anchor bigint, s1 bigint, s2 bigint, k1 bigint, k2 bigint, at bigint")
    # only copies of a text give equal rows
    seg = ["anchor", "s1", "s2"]
    found = scratch.save(found.groupBy(*seg, *KEY, "at").agg(F.count("*").alias("n")), "anchors")
    # written first: Spark can then split the join of a very common anchor
    again = found.groupBy("anchor").agg(F.sum("n").alias("t"), ((F.min("s1") != F.max("s1")) | (F.min("s2") != F.max("s2"))).alias("mixed"))
    again = scratch.save(again.where("t > 1").select("anchor", "mixed"), "repeated-anchors")
    some = scratch.save(found.join(again, "anchor"), "repeated")
    scratch.drop("anchors", "repeated-anchors")
    kinds = some.groupBy(*seg, "mixed").agg(F.sum("n").alias("n"), F.min(F.struct(*KEY, "at")).alias("rep"))
    kinds = scratch.save(kinds, "kinds")

    # one text for each segment that is to be sorted, and its bytes
    hot = kinds.where("mixed").groupBy("anchor").count().where(F.col("count") > ROWS)
    hot = scratch.save(hot.select("anchor"), "hot")
    split = not hot.isEmpty()

    def carriers(of: DataFrame) -> DataFrame:
        wanted = of.groupBy(*[F.col(f"rep.{k}").alias(k) for k in KEY])
        wanted = wanted.agg(F.collect_list(F.struct(*seg, F.col("rep.at").alias("at"))).alias("places"))
        # one row of each text, combined before the shuffle: its copies would all give the same segments
        return keyed.dropDuplicates(list(KEY)).join(wanted, list(KEY)).select("text", "places")

    mixed = kinds.where("mixed")
    texts = carriers(mixed.join(hot, "anchor", "left_anti") if split else mixed)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = _Rows(anchor=_I64, s1=_I64, s2=_I64, left=_I32, right=_I32, data=pa.binary())
        for b in batches:
            for t, places in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                for p in places:
                    rows.add(p["anchor"], p["s1"], p["s2"], *_segment(t, p["at"], length, before))
                yield from rows.out(OUT_ROWS)
        yield from rows.out()

    segments = texts.mapInArrow(cut, "anchor bigint, s1 bigint, s2 bigint, left int, right int, data binary")

    single = scratch.save(_sort(segments, length, before), "sorted")
    if split:
        single = single.unionByName(_split(carriers(mixed.join(hot, "anchor", "left_semi")), scratch, length, before))

    # copies of a segment are repeats from end to end
    ranges = kinds.join(single, seg, "left").where("n > 1 or a is not null").select(*seg, "n", "a", "b")
    ranges = scratch.save(ranges, "segment-ranges")
    placed = some.drop("n").join(ranges, seg)
    a = F.when(F.col("n") > 1, -F.least("at", F.lit(before))).otherwise(F.col("a"))
    b = F.when(F.col("n") > 1, F.lit(length)).otherwise(F.col("b"))
    placed = placed.select(*KEY, F.struct((F.col("at") + a).alias("a"), (F.col("at") + b).alias("b")).alias("s"))
    out = scratch.save(placed.groupBy(*KEY).agg(F.sort_array(F.collect_set("s")).alias("spans")), "ranges")
    scratch.drop("repeated", "kinds", "sorted", "split", "segment-ranges")
    return out


def merge(found: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs of sorted ranges; ranges that touch are one run."""
    out: list[tuple[int, int]] = []
    for a, b in found:
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def remove_repeats(
    docs: DataFrame, text_col: str = "text", length: int = LENGTH, gram: int = GRAM, passages: int | None = None
) -> DataFrame:
    """``docs`` with kept (binary), n_bytes, n_removed, n_spans (long), removed (ranges), kept_sha256.

    Texts are judged as UTF-8 bytes, a null text as an empty one. All strings are judged on the input, copies of a text as
    rows of their own (so equal texts of ``length`` bytes or more lose all). Rows pass through whatever
    their other columns hold; columns of the names above are replaced. Empty tables give empty tables.
    ``passages``: a second length, no longer than the first; then there is one more column, without_passages (string): the whole text
    without the repeats of that length (characters cut apart at an end go too; null for a null text).
    """
    added = ("kept", "n_bytes", "n_removed", "n_spans", "removed", "kept_sha256", "without_passages")
    df = without(docs, *added, "_text", *KEY, "_spans", "_short")
    text = F.coalesce(F.col(text_col), F.lit(""))
    names = df.columns
    df = df.withColumn("_text", text.cast("binary")).select("*", *_identity("_text"))
    shorter = None
    if passages is not None:
        shorter = spans(docs, text, Scratch(docs.sparkSession, "passages"), passages, gram)
    ranges = spans(docs, text, Scratch(docs.sparkSession, "suffixes"), length, gram, shorter)
    df = df.join(ranges.withColumnRenamed("spans", "_spans"), list(KEY), "left")
    if shorter is None:
        df = df.withColumn("_short", F.lit(None).cast("array<struct<a:bigint,b:bigint>>"))
    else:
        df = df.join(shorter.withColumnRenamed("spans", "_short"), list(KEY), "left")
    df = df.select(*names, F.col(text_col).isNull().alias("_null"), "_text", "_spans", "_short")
    kinds = {n: df.schema[n].dataType.simpleString() for n in names}
    schema = ", ".join(f"`{n}` {k}" for n, k in kinds.items())
    schema += ", kept binary, n_bytes bigint, n_removed bigint, n_spans bigint, removed array<struct<a:bigint,b:bigint>>, kept_sha256 string"

    def outside(text: bytes, cut: list[tuple[int, int]]) -> bytes:
        parts, at = [], 0
        for a, b in cut:
            parts.append(text[at:a])
            at = b
        return b"".join([*parts, text[at:]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, sizes, gone, runs, sums, short = [], [], [], [], [], []
            null, texts, found, more = [batch.column(len(names) + k).to_pylist() for k in range(4)]
            for x, t, s, m in zip(null, texts, found, more, strict=True):
                cut = merge([(x["a"], min(x["b"], len(t))) for x in s or []])
                rest = outside(t, cut)
                kept.append(rest)
                sizes.append(len(t))
                gone.append(len(t) - len(rest))
                runs.append([{"a": a, "b": b} for a, b in cut])
                sums.append(hashlib.sha256(rest).hexdigest())
                if passages is not None:
                    short.append(None if x else outside(t, merge([(x["a"], min(x["b"], len(t))) for x in m or []])).decode("utf-8", "ignore"))
            new = [
                pa.array(kept, pa.binary()), pa.array(sizes, pa.int64()), pa.array(gone, pa.int64()), pa.array([len(r) for r in runs], pa.int64()),
                pa.array(runs, pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))), pa.array(sums, pa.string()),
            ]
            new += [pa.array(short, pa.string())] * (passages is not None)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], *new], [*names, *added[: len(new)]])

    return df.mapInArrow(run, schema + (", without_passages string" if passages is not None else ""))


def cut_repeats(docs: DataFrame, text_col: str = "text", count_col: str = "n_chars", length: int = LENGTH) -> DataFrame:
    """``docs`` with the repeats gone from its texts (characters cut apart at an end go too) and ``count_col`` recounted.

    Every row stays, if with an empty text; a null text stays null. Repeated rows and ids stay. An empty table gives
    an empty table.
    """
    names = docs.columns
    rest = [n for n in names if n not in (text_col, count_col)]
    own = docs.select(F.col(text_col).alias("_t"), *[F.col(n).alias(f"_c{k}") for k, n in enumerate(rest)])  # no name clashes
    found = remove_repeats(own, "_t", length=length)
    kept = F.when(F.col("_t").isNull(), F.lit(None)).otherwise(F.col("kept")).cast("binary")
    src = found.select(*own.columns[1:], kept.alias("_kept"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [None if k is None else k.decode("utf-8", "ignore") for k in b.column(b.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(texts, pa.string())], [*b.schema.names[:-1], "_new"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in src.schema if f.name != "_kept")
    out = src.mapInArrow(run, f"{schema}{', ' * bool(rest)}_new string")
    cols = {n: F.col(f"_c{k}") for k, n in enumerate(rest)} | {text_col: F.col("_new")}
    if count_col in names:
        cols[count_col] = F.length("_new").cast(docs.schema[count_col].dataType)
    return out.select(*[cols[n].alias(n) for n in names])
