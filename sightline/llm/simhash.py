"""SimHash near-duplicates: 64-bit fingerprints of 4-word shingles, linked through BK-trees of shards.

Shards. Two fingerprints that differ in at most 4 of 64 bits agree in at least two of six bit blocks, so
every link lies inside at least one of the 15 shards (block pair, value of the two blocks) of each
fingerprint. Each shard gets one BK-tree (children keyed by their integer Hamming distance to the parent), and
a query follows only the edges whose key is within the radius of its own distance. A shard's tree goes to
the tasks that hold the shard's queries; all trees together grow with the corpus, so they are shuffled and
not broadcast to every executor. A shard with more than ``SHARD_ROWS`` fingerprints is dealt into parts of
that size, and each pair of parts is a cell of its own: a tree of one, queries of the other. So a task
holds two parts at most, however large the shard.

Copies share a fingerprint and are collapsed before any search. A task joins what its shards link and
emits at most one edge per fingerprint (to the least of its set), never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch
from .components import components

#: Widths of the six blocks a fingerprint is cut into.
BLOCKS = (11, 11, 11, 11, 10, 10)
RADIUS = 4
SHARD_ROWS = 20_000


def fingerprint(text: bytes | None, shingle_words: int = 4) -> int:
    """SimHash of one text as a signed 64-bit integer; null or wordless texts give 0."""
    import xxhash

    words = (text or b"").lower().split()  # bytes: A-Z and ASCII white space only
    if not words:
        return 0
    joined = b" ".join(words)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    last = min(shingle_words, len(words)) - 1
    starts, ends = (ends - sizes)[: len(words) - last].tolist(), ends[last:].tolist()
    digest = xxhash.xxh64_intdigest
    votes = np.zeros(64, np.int64)
    for at in range(0, len(starts), 65280):
        part = [digest(joined[a:b], 42) for a, b in zip(starts[at : at + 65280], ends[at : at + 65280], strict=True)]
        bits = np.unpackbits(np.array(part, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        full = len(bits) // 255 * 255  # sums of 255 rows fit a byte
        votes += bits[:full].reshape(-1, 255, 64).sum(axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64)
        votes += bits[full:].sum(axis=0, dtype=np.uint8)
    return int(np.packbits(votes * 2 > len(starts), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, fp): one row per input row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = [fingerprint(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps, pa.int64())], ["id", "fp"])

    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))
    schema = T.StructType([T.StructField("id", src.schema["id"].dataType), T.StructField("fp", T.LongType())])
    return src.mapInArrow(run, schema).withColumnRenamed("id", id_col)


class BKForest:
    """BK-trees of many shards as flat arrays, built and searched level by level."""

    def __init__(self, shard: np.ndarray, fp: np.ndarray):
        """``shard``: sorted shard numbers 0..n-1; ``fp``: distinct fingerprints within each shard."""
        self.fp = fp = fp.view(np.uint64)  # bits of signed numbers would be counted on the absolute value
        self.roots = np.searchsorted(shard, np.arange(shard[-1] + 1 if len(shard) else 0))
        items = np.setdiff1d(np.arange(len(fp)), self.roots, assume_unique=True)
        at = self.roots[shard[items]]
        codes, nodes = [], []
        while len(items):
            code = at * 65 + np.bitwise_count(fp[items] ^ fp[at]).astype(np.int64)
            uniq, first, which = np.unique(code, return_index=True, return_inverse=True)
            codes.append(uniq)
            nodes.append(items[first])
            at = items[first][which]
            rest = items != at
            items, at = items[rest], at[rest]
        code = np.concatenate(codes) if codes else np.empty(0, np.int64)
        order = np.argsort(code)
        self.code, self.node = code[order], (np.concatenate(nodes)[order] if nodes else code)

    def search(self, shard: np.ndarray, fp: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (query row, node) within the radius."""
        fp = fp.view(np.uint64)
        q, at = np.arange(len(fp)), self.roots[shard]
        found_q, found_n = [], []
        while len(q):
            d = np.bitwise_count(fp[q] ^ self.fp[at]).astype(np.int64)
            hit = d <= radius
            found_q.append(q[hit])
            found_n.append(at[hit])
            lo = np.searchsorted(self.code, at * 65 + np.maximum(d - radius, 0))
            n = np.searchsorted(self.code, at * 65 + np.minimum(d + radius, 64), "right") - lo
            total = int(n.sum())
            step = np.arange(total) - np.repeat(np.cumsum(n) - n, n)
            at = self.node[np.repeat(lo, n) + step]
            q = np.repeat(q, n)
        return np.concatenate(found_q), np.concatenate(found_n)


def _join(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels after merging the sets of a[i] and b[i]; a label is the least row of its set."""
    while True:
        la, lb = label[a], label[b]
        if (la == lb).all():
            return label
        np.minimum.at(label, np.maximum(la, lb), np.minimum(la, lb))
        while (label != label[label]).any():
            label = label[label]


def _shard_edges(key: np.ndarray, fp: np.ndarray, tree: np.ndarray, ask: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges (fp, least fp of its set) of complete cells; rows are sorted by key.

    ``tree``: the row is in its cell's tree, ``ask``: it is a query there.
    """
    new = np.concatenate([[True], key[1:] != key[:-1]])
    shard = np.cumsum(new) - 1
    keep = np.bincount(shard)[shard] > 1
    shard, fp, tree, ask = shard[keep], fp[keep], tree[keep], ask[keep]
    with_tree = np.isin(shard, np.unique(shard[tree]))
    shard, fp, tree, ask = shard[with_tree], fp[with_tree], tree[with_tree], ask[with_tree]
    if not len(fp):
        return fp, fp
    shard = np.unique(shard, return_inverse=True)[1]
    order = np.lexsort((fp, shard))
    shard, fp, tree, ask = shard[order], fp[order], tree[order], ask[order]
    rows, asks = np.flatnonzero(tree), np.flatnonzero(ask)
    forest = BKForest(shard[rows], fp[rows])
    size = np.bincount(shard[rows])[shard[asks]]
    label = np.arange(len(fp))
    at = 0
    work = np.cumsum(size)
    while at < len(asks):  # so many queries at once that what they may visit stays bounded
        to = max(at + 1, int(np.searchsorted(work, (work[at - 1] if at else 0) + 2_000_000)))
        q, n = forest.search(shard[asks[at:to]], fp[asks[at:to]], radius)
        label = _join(label, asks[at:to][q], rows[n])
        at = to
    linked = label != np.arange(len(fp))
    return fp[linked], fp[label[linked]]


def links(fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Edges (u, v) between distinct fingerprints that join exactly those within reach of each other.

    ``fps`` has a column fp of distinct values. Each edge lies within a set that links of at most
    ``radius`` bits connect; the sets of all edges together are the components.
    """
    if radius > 4:
        raise ValueError("six blocks find links of up to 4 bits")
    parts, low = [], 0
    for width in BLOCKS:
        parts.append((F.shiftrightunsigned("fp", low).bitwiseAND(F.lit((1 << width) - 1)), width))
        low += width
    keys = []
    for k, (a, b) in enumerate(combinations(parts, 2)):
        keys.append(F.lit(k).cast("long") * F.lit(1 << 22) + a[0] * F.lit(1 << b[1]) + b[0])
    rows = fps.select("fp", F.explode(F.array(*keys)).alias("key"))
    hot = rows.groupBy("key").count().where(F.col("count") > SHARD_ROWS)
    hot = hot.select("key", F.ceil(F.col("count") / SHARD_ROWS).cast("int").alias("salts"))
    rows = rows.join(hot, "key", "left").withColumn("salts", F.coalesce("salts", F.lit(1)))
    own = F.pmod(F.xxhash64("fp"), F.col("salts"))
    rows = rows.select("key", "fp", own.alias("own"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("other"))
    low, high = F.least("own", "other"), F.greatest("own", "other")  # parts of the cell: the tree's, and the queries'
    rows = rows.select("key", low.alias("low"), high.alias("high"), "fp", (F.col("own") == low).alias("tree"), (F.col("own") == high).alias("ask"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        count = 0

        def cells(rows: tuple) -> np.ndarray:
            """Numbers of the rows' cells, from 0."""
            new = np.logical_or.reduce([c[1:] != c[:-1] for c in rows[:3]])
            return np.cumsum(np.concatenate([[False], new]))

        def out(rows: tuple) -> pa.RecordBatch:
            u, v = _shard_edges(cells(rows), *rows[3:], radius)
            return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])

        for b in batches:
            held.append(tuple(b.column(i).to_numpy(zero_copy_only=False) for i in range(6)))
            count += b.num_rows
            if count < 100_000:
                continue
            rows = tuple(np.concatenate(x) for x in zip(*held, strict=True))
            cell = cells(rows)
            cut = int(np.searchsorted(cell, cell[-1]))  # the last cell may go on
            if cut:
                yield out(tuple(c[:cut] for c in rows))
            held, count = [tuple(c[cut:] for c in rows)], count - cut
        if count:
            yield out(tuple(np.concatenate(x) for x in zip(*held, strict=True)))

    cell = ("key", "low", "high")
    return rows.repartition(*cell).sortWithinPartitions(*cell).mapInArrow(run, "u long, v long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """One row per input row: id_col, fingerprint (16 hex digits), component_id (smallest id reachable).

    Null and wordless texts have fingerprint zero and are linked like any other; fewer than four words make
    one shingle. Repeated rows and ids stay; a null id never names a component. Other columns are ignored.
    An empty table gives an empty table.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "simhash")
    rows = scratch.save(fingerprints(docs, id_col, text_col), "fingerprints")
    least = scratch.save(rows.groupBy("fp").agg(F.min(id_col).alias("least")), "least")
    comps = components(links(least.select("fp"), radius), scratch)
    least = least.join(comps.withColumnRenamed("node", "fp"), "fp", "left")
    least = least.withColumn("component", F.coalesce("component", "fp"))
    roots = least.groupBy("component").agg(F.min("least").alias("component_id"))
    ids = scratch.save(least.join(roots, "component").select("fp", "component_id"), "components")
    out = rows.join(ids, "fp").select(id_col, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
    return out


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """The rows of ``docs`` whose id is the least of their near-duplicate group; rows with a null id stay."""
    found = near_duplicates(docs.where(F.col(id_col).isNotNull()), id_col, text_col, radius)
    dropped = found.where(F.col(id_col) != F.col("component_id")).select(id_col).distinct()
    return docs.join(dropped, id_col, "left_anti").select(*docs.columns)
