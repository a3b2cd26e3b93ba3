"""Near-duplicate embeddings by cross-polytope hashing.

Hash: three rounds of random signs and a fast Hadamard transform, then the signed axis that the
rotated vector lies nearest to; two such axes or more make a bucket. Their number follows the logarithm of the number
of vectors, and the last rotation offers only as many axes as are still needed, so that there are about ``SPREAD`` buckets
for each vector of the largest label, however many there are. Each table stores a vector under its own bucket and also
sends it, as a query, to ``PROBES`` buckets next in line (the axes it lies next nearest to). Candidates of a bucket
are verified by cosine in double precision. Longer hashes agree less often, so tables are added with axes: of pairs at
cosine 0.931 at least 0.99 meet, up to 1e9 vectors of 64 components and 1e7 of 384 (tests).

Vectors that are equal are collapsed first and counted with their number. Buckets with one vector are
dropped before any vector is shuffled. A bucket of over ``SALT_ROWS`` rows is dealt into a square of parts,
each with a share of its stored vectors and a share of its queries. A pair is counted only in the first
bucket where it meets, so each task hands on sums per vector and at most one edge per vector, never pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch
from .components import components

TABLES, PROBES, SALT_ROWS = 12, 3, 2000
#: Buckets for each vector of a label, tables for each further whole axis, and most axes (short vectors fill buckets with links).
SPREAD, MORE_TABLES, MOST_AXES = 8, 8, 6
COSINE = 0.93


def hadamard(x: np.ndarray) -> np.ndarray:
    """Rows times the Hadamard matrix, whose order is a power of two."""
    n, d = x.shape
    h = 1
    while h < d:
        x = x.reshape(n, d // (2 * h), 2, h)
        x = np.stack([x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]], axis=2)
        h *= 2
    return x.reshape(n, d)


class CrossPolytope:
    """Hashes of all tables for ``n`` vectors of ``dim`` components: two axes, and more where ``n`` asks for more buckets."""

    def __init__(self, dim: int, n: int = 0, probes: int = PROBES, seed: int = 20):
        self.dim, self.size, self.probes = dim, 1 << max(1, (dim - 1).bit_length()), probes
        self.widths, buckets = [self.size] * 2, (2 * self.size) ** 2
        while buckets < SPREAD * n and len(self.widths) < MOST_AXES:
            self.widths.append(min(self.size, 1 << (-(-SPREAD * n // buckets) - 1).bit_length() - 1))
            buckets *= 2 * self.widths[-1]
        further = sum(w.bit_length() for w in self.widths[2:]) / self.size.bit_length()
        self.tables = TABLES + int(np.ceil(MORE_TABLES * further))
        self.signs = np.random.default_rng(seed).choice([-1.0, 1.0], (self.tables, len(self.widths), 3, self.size))

    def _axes(self, x: np.ndarray, signs: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """The three nearest signed axes and what each loses against the nearest; few axes offer the opposite one too."""
        for s in signs:
            x = hadamard(x * s) / np.sqrt(self.size)
        x = x[:, :width]
        near = np.argsort(-np.abs(x), axis=1, kind="stable")[:, :3]
        value = np.take_along_axis(x, near, 1)
        code, away = near * 2 + (value < 0), np.abs(value)
        loss = (away[:, :1] - away) ** 2
        if width < 3:
            code, loss = np.hstack([code, code[:, :1] ^ 1]), np.hstack([loss, (2 * away[:, :1]) ** 2])
        return code, loss

    def buckets(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Own buckets (n, tables) and probed buckets (n, tables, probes) of unit rows."""
        x = np.pad(x, ((0, 0), (0, self.size - x.shape[1])))
        own = np.empty((len(x), self.tables), np.int64)
        probed = np.empty((len(x), self.tables, self.probes), np.int64)
        for t in range(self.tables):
            codes, losses = np.zeros((len(x), 1), np.int64), np.zeros((len(x), 1))
            for signs, width in zip(self.signs[t], self.widths, strict=True):
                code, loss = self._axes(x, signs, width)
                codes = (codes[:, :, None] * (2 * width) + code[:, None, :]).reshape(len(x), -1)
                losses = (losses[:, :, None] + loss[:, None, :]).reshape(len(x), -1)
                best = np.argsort(losses, axis=1, kind="stable")[:, : self.probes + 1]
                codes, losses = np.take_along_axis(codes, best, 1), np.take_along_axis(losses, best, 1)
            if codes.shape[1] <= self.probes:
                codes = np.pad(codes, ((0, 0), (0, self.probes + 1 - codes.shape[1])), mode="edge")
            own[:, t], probed[:, t] = codes[:, 0], codes[:, 1:]
        return own, probed


def _unit(vectors: list | np.ndarray) -> np.ndarray:
    x = np.asarray(vectors, np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # squares of very large components stay finite
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _meet_first(own, probed, i, j, table, bucket) -> np.ndarray:
    """Whether (table, bucket) is the first place where rows i and j meet, one as stored and one as stored or probing."""
    first = np.ones(len(i), bool)
    for t in range(int(table.max(initial=-1)) + 1):
        left = np.flatnonzero(first & (table >= t))
        a, b = i[left], j[left]
        at_a = (own[a, t] == own[b, t]) | (probed[b, t] == own[a, t][:, None]).any(axis=1)  # in a's own bucket
        at_b = (own[a, t] == own[b, t]) | (probed[a, t] == own[b, t][:, None]).any(axis=1)
        big = np.iinfo(np.int64).max
        where = np.minimum(np.where(at_a, own[a, t], big), np.where(at_b, own[b, t], big))
        first[left] = np.where(table[left] > t, ~(at_a | at_b), where == bucket[left])
    return first


#: Buckets up to so many rows are compared together, pair by pair; larger ones by a matrix product each.
SMALL = 64


def _pairs(group, tree, query, x, cosine) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (query row, tree row) of the same group that are near enough, in blocks. ``group``: sorted numbers from 0."""
    size = np.bincount(group)
    start = np.cumsum(size) - size
    few = tree & (size[group] <= SMALL)
    rows = np.flatnonzero(few)
    at = 0
    count = size[group[rows]]
    total = np.cumsum(count)
    while at < len(rows):
        to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + 200_000)))
        own, n = rows[at:to], count[at:to]
        t = np.repeat(own, n)
        q = np.repeat(start[group[own]], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        ok = query[q] & (q != t)
        q, t = q[ok], t[ok]
        near = np.einsum("ij,ij->i", x[q], x[t]) >= cosine
        yield q[near], t[near]
        at = to
    for g in np.flatnonzero(size > SMALL):
        own = np.arange(start[g], start[g] + size[g])
        trees, queries = own[tree[own]], own[query[own]]
        for lo in range(0, len(queries), 1024):
            q, t = np.nonzero(x[queries[lo : lo + 1024]] @ x[trees].T >= cosine)
            q, t = queries[lo : lo + 1024][q], trees[t]
            yield q[q != t], t[q != t]


def _compare(x, own, probed, copies, stored, group, tree, query, table, bucket, cosine):
    """Links of each row, and labels of the sets they make, counting a pair only where it meets first."""
    links, label = np.zeros(len(x), np.int64), np.arange(len(x))
    for q, t in _pairs(group, tree, query, x, cosine):
        for lo in range(0, len(q), 200_000):
            a, b = q[lo : lo + 200_000], t[lo : lo + 200_000]
            ok = _meet_first(own, probed, a, b, table[a], bucket[a])
            a, b = a[ok], b[ok]
            np.add.at(links, a, copies[b])
            probing = ~stored[a]  # no salt has those in its tree: the stored row counts them here
            np.add.at(links, b[probing], copies[a[probing]])
            while len(a) and (label[a] != label[b]).any():
                la, lb = label[a], label[b]
                np.minimum.at(label, np.maximum(la, lb), np.minimum(la, lb))
                while (label != label[label]).any():
                    label = label[label]
    return links, label


def near_duplicates(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    cosine: float = COSINE,
) -> DataFrame:
    """One row per input row: id_col, n_links, component_id, kept (id_col = component_id).

    Vectors are compared only where labels are equal and not null. A vector that is null, empty, zero or
    holds null or non-finite components links with nothing, and vectors of different lengths do not link.
    Equal vectors are links of each other. Rows count one by one, whether or not they repeat an id: vectors are told apart by a
    number of their own, and ids only name the rows and the components. An empty table gives an empty table.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "embeddings")
    v = F.col("vec")
    rows = vectors.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(vector_col).cast("array<double>").alias("vec"))
    bad = F.exists(v, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))) | ~F.exists(v, lambda c: c != 0)
    good = rows.where(F.col("label").isNotNull() & F.col("id").isNotNull() & v.isNotNull() & ~bad)
    good = good.withColumn("vec", F.transform(v, lambda c: c + 0.0))  # one zero
    keyed = good.select("id", F.md5(F.concat_ws("|", F.col("label").cast("string"), F.array_join(F.transform("vec", lambda c: c.cast("string")), ","))).alias("same"), "label", "vec")
    # equal vectors have equal labels, so any row of a group has them; partial sums collapse a hot group before the shuffle
    groups = keyed.groupBy("same").agg(F.min("id").alias("rep"), F.count("*").alias("copies"), F.first("label").alias("label"), F.first("vec").alias("vec"))
    groups = scratch.save(groups.withColumn("node", F.monotonically_increasing_id()), "groups")  # written, so made once
    reps = groups.select("node", "label", "copies", "vec")
    largest = groups.groupBy("label").count().agg(F.max("count")).first()[0] or 0

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes: dict[int, CrossPolytope] = {}
        for b in batches:
            ids, vecs = b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_pylist()
            dims = np.array([len(x) for x in vecs])
            for d in np.unique(dims):
                pick = np.flatnonzero(dims == d)
                hashes.setdefault(int(d), CrossPolytope(int(d), largest))
                own, probed = hashes[int(d)].buckets(_unit([vecs[k] for k in pick]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[pick]), pa.array(list(own)), pa.array(list(probed.reshape(len(pick), -1)))], ["node", "own", "probed"]
                )

    codes = scratch.save(reps.select("node", "vec").mapInArrow(place, "node bigint, own array<bigint>, probed array<bigint>"), "codes")
    coded = reps.select("node", "label", F.size("vec").alias("dim")).join(codes, "node")
    coded = coded.withColumn("t", F.explode(F.sequence(F.lit(0), F.size("own") - 1)))
    spots = coded.select(
        "node", "label", "dim", "t",
        F.explode(F.array_union(F.array(F.get("own", F.col("t"))), F.slice("probed", F.col("t") * PROBES + 1, PROBES))).alias("bucket"),
        F.get("own", F.col("t")).alias("main"),
    ).withColumn("stored", F.col("bucket") == F.col("main")).drop("main")
    spots = scratch.save(spots, "spots")
    key = ["label", "dim", "t", "bucket"]
    sizes = spots.groupBy(*key).agg(F.count("*").alias("n"), F.count_if("stored").alias("n_stored")).where("n > 1 and n_stored > 0")
    sizes = sizes.withColumn("salts", F.ceil(F.col("n") / SALT_ROWS).cast("int")).drop("n", "n_stored")
    used = spots.join(sizes, key).withColumn("home", F.pmod(F.xxhash64("node"), F.col("salts")).cast("int"))
    # a salted bucket is a square of parts: trees by row, queries by column; a row stands in its row and column
    salt = F.sequence(F.lit(0), F.col("salts") - 1)
    across = F.transform(salt, lambda k: F.struct(F.col("home").alias("a"), k.alias("b")))
    down = F.transform(salt, lambda k: F.struct(k.alias("a"), F.col("home").alias("b")))
    used = used.withColumn("part", F.explode(F.when(F.col("stored"), F.array_union(across, down)).otherwise(down)))
    used = used.select("node", *key, "stored", "home", F.col("part.a").alias("a"), F.col("part.b").alias("b"))
    data = reps.select("node", "copies", "vec").join(codes, "node")
    full = used.join(data, "node").repartition(*key, "a", "b").sortWithinPartitions("dim", "label", "t", "bucket", "a", "b")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def starts(t: pa.Table) -> np.ndarray:
            cols = [t[c].to_numpy() for c in ("dim", "label", "t", "bucket", "a", "b")]
            return np.concatenate([[True], np.logical_or.reduce([c[1:] != c[:-1] for c in cols])])

        def flat(t: pa.Table, c: str) -> np.ndarray:
            return t[c].combine_chunks().flatten().to_numpy().reshape(len(t), -1)

        def out(t: pa.Table) -> Iterator[pa.RecordBatch]:
            dims = t["dim"].to_numpy()
            edges = [0, *(np.flatnonzero(dims[1:] != dims[:-1]) + 1).tolist(), len(t)]
            for lo, hi in zip(edges, edges[1:], strict=False):
                part = t.slice(lo, hi - lo)
                stored, home, ids = part["stored"].to_numpy().astype(bool), part["home"].to_numpy(), part["node"].to_numpy()
                own = flat(part, "own")
                links, label = _compare(
                    _unit(flat(part, "vec")), own, flat(part, "probed").reshape(*own.shape, PROBES), part["copies"].to_numpy(), stored,
                    np.cumsum(starts(part)) - 1, stored & (home == part["a"].to_numpy()), home == part["b"].to_numpy(), part["t"].to_numpy(), part["bucket"].to_numpy(), cosine,
                )
                some = (links > 0) | (label != np.arange(len(label)))
                yield pa.RecordBatch.from_arrays([pa.array(ids[some]), pa.array(links[some]), pa.array(ids[label[some]])], ["node", "links", "to"])

        held: list[pa.RecordBatch] = []
        count = 0
        for b in batches:
            held.append(b)
            count += b.num_rows
            if count >= 16_000:
                t = pa.Table.from_batches(held)
                cut = int(np.flatnonzero(starts(t))[-1])  # the last part may go on
                if cut:
                    yield from out(t.slice(0, cut))
                    held = t.slice(cut).combine_chunks().to_batches()
                    count = len(t) - cut
        if count:
            yield from out(pa.Table.from_batches(held))

    found = scratch.save(full.mapInArrow(compare, "node bigint, links bigint, to bigint"), "found")
    comps = components(found.select(F.col("node").alias("u"), F.col("to").alias("v")), scratch)
    n = found.groupBy("node").agg(F.sum("links").alias("links"))
    comps = scratch.save(comps, "components")
    names = comps.join(groups.select("node", "rep"), "node")
    names = names.select("node", "component").join(names.groupBy("component").agg(F.min("rep").alias("least")), "component").drop("component")
    per = groups.select("node", "same", "rep", "copies").join(n, "node", "left").join(names, "node", "left")
    per = scratch.save(per.select("same", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("least", "rep").alias("component_id")), "groups-out")
    linked = keyed.select("id", "same").join(per, "same").select("id", "n_links", "component_id")
    other = rows.where(~(F.col("label").isNotNull() & F.col("id").isNotNull() & v.isNotNull() & F.coalesce(~bad, F.lit(False))))
    other = other.select("id", F.lit(0).cast("bigint").alias("n_links"), F.col("id").alias("component_id"))
    both = linked.unionByName(other)
    return both.select(F.col("id").alias(id_col), "n_links", "component_id", (F.col("id").eqNullSafe(F.col("component_id"))).alias("kept"))
