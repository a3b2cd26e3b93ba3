"""Exact deduplication by recipes of content-defined chunks.

A text is cut where a rolling hash of its last 32 bytes has its high bits zero, so equal passages are cut alike
wherever they stand. Its recipe is the ordered list of its chunks' identifiers. Each chunk's bytes go once through a
shuffle, in which equal ones are combined first: there a hash that stands for several contents shows, and such contents
get numbers of their own. An identifier is a hash and that number, so equal identifiers are equal bytes, for certain.
From then on only identifiers move, some 8 bytes for 4 KB of text, however long a document is.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Scratch

#: Bytes of a chunk: at least (but for a text's last one), about, and at most. The least is no less than the hash's 32.
LEAST, ABOUT, MOST = 1024, 4096, 32_768
#: Bytes hashed at once.
BLOCK = 1 << 22

_GEAR = np.random.default_rng(11).integers(0, 1 << 32, 256, dtype=np.uint32)


def _marks(data: np.ndarray, about: int) -> Iterator[np.ndarray]:
    """Places (a block at a time) after which the rolling hash lets a chunk end; those within 32 bytes of a text's start say nothing."""
    high = np.uint32(33 - about.bit_length())
    for lo in range(0, len(data), BLOCK):
        from_ = max(0, lo - 31)
        h = _GEAR[data[from_ : lo + BLOCK]]
        for s in (1, 2, 4, 8, 16):  # hash of 2s bytes from two of s bytes
            longer = h.copy()
            longer[s:] += h[:-s] << np.uint32(s)
            h = longer
        yield np.flatnonzero(h[lo - from_ :] >> high == 0) + lo + 1


def chunk_ends(data: np.ndarray, ends: Sequence[int], least: int = LEAST, about: int = ABOUT, most: int = MOST) -> list[list[int]]:
    """For each text (that ends at ``ends``, in one run of bytes) where its chunks end. An empty text has no chunk."""
    if not 32 <= least <= most or about & (about - 1):
        raise ValueError("the least chunk has 32 bytes, and the usual one a power of two")
    marks = np.concatenate([np.empty(0, np.int64), *_marks(data, about)]).tolist()
    out, start = [], 0
    for end in ends:
        cuts = []
        at = start
        while end - at > least:
            k = bisect_left(marks, at + least)
            to = min(marks[k] if k < len(marks) else end, at + most, end)
            if to == end:
                break
            cuts.append(to)
            at = to
        if end > start:
            cuts.append(end)
        out.append(cuts)
        start = end
    return out


def mark(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    carry: Sequence[str] = (),
    sizes: tuple[int, int, int] = (LEAST, ABOUT, MOST),
    hash_bits: int = 64,
) -> DataFrame:
    """One row per input row: id_col, the columns ``carry``, keep_id, group_size, kept, text_sha256, n_chunks.

    Texts are equal when their bytes are; null counts as empty. Of equal texts the row with the largest id stays (a null id
    is the least, and of rows that also repeat the id exactly one stays). Texts of any length are read whole. An empty
    table gives an empty table. ``sizes``: bytes of chunks; ``hash_bits``: fewer make different chunks share hashes (tests).
    """
    spark, mask = docs.sparkSession, np.uint64((1 << hash_bits) - 1)
    scratch = Scratch(spark, "exact-dedup")
    src = docs.select(F.struct(F.col(id_col).alias("id"), *[F.col(c).alias(f"c{k}") for k, c in enumerate(carry)]).alias("own"), F.col(text_col).alias("text"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        row = TaskContext.get().partitionId() << 33
        for b in batches:
            own, texts = b.column(0), b.column(1).fill_null("")
            offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
            buffer = texts.buffers()[2] or pa.py_buffer(b"")
            view = memoryview(buffer)[offsets[0] : offsets[-1]]
            offsets -= offsets[0]
            cuts = chunk_ends(np.frombuffer(view, np.uint8), offsets[1:].tolist(), *sizes)
            flat, hashes, lists, shas, firsts = [0], [], [], [], []
            for k, own_cuts in enumerate(cuts):
                firsts.append(len(hashes))
                if own_cuts:
                    here = []
                    for to in own_cuts:
                        here.append(xxhash.xxh3_64_intdigest(view[flat[-1] : to]))
                        flat.append(to)
                    hashes += here
                else:  # an empty text has a row without a chunk
                    here = []
                    flat.append(flat[-1])
                    hashes.append(0)
                lists.append(len(here))
                shas.append(hashlib.sha256(view[offsets[k] : offsets[k + 1]]).hexdigest())
            n = np.diff([*firsts, len(hashes)])
            bits = (np.array(hashes, np.uint64) & mask).view(np.int64)
            some = np.repeat(np.array(lists) > 0, n)
            first = np.zeros(len(hashes), bool)
            first[firsts] = True
            place = pa.array(np.cumsum(first) - 1, mask=~first)  # the document on its first row only
            recipes = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lists)]), pa.int32()), pa.array(bits[some]))
            chunks = pa.BinaryArray.from_buffers(pa.binary(), len(hashes), [None, pa.py_buffer(np.array(flat, np.int32)), pa.py_buffer(view)])
            out = pa.RecordBatch.from_arrays(
                [
                    pa.array(np.repeat(row + np.arange(len(cuts)), n)), pa.array((np.arange(len(hashes)) - np.repeat(firsts, n)).astype(np.int32)),
                    pa.array(bits, mask=~some), chunks, own.take(place), pa.array(np.diff(offsets)).take(place), pa.array(shas, pa.string()).take(place), recipes.take(place),
                ],
                ["row", "pos", "hash", "chunk", "own", "n_bytes", "sha", "hashes"],
            )
            row += len(cuts)
            for at in range(0, len(out), 4096):
                yield out.slice(at, 4096)

    schema = f"row bigint, pos int, hash bigint, chunk binary, own {src.schema['own'].dataType.simpleString()}, n_bytes bigint, sha string, hashes array<bigint>"
    chunks = scratch.save(src.mapInArrow(cut, schema), "chunks")
    contents = chunks.where("hash is not null").groupBy("hash", "chunk").agg(F.count("*").alias("n"))
    shared = scratch.save(contents.groupBy("hash").agg(F.count("*").alias("n")).where("n > 1").select("hash"), "shared")
    recipes = chunks.where("n_bytes is not null").select("row", "own", "n_bytes", "sha", "hashes")
    if shared.isEmpty():
        recipes = recipes.withColumn("numbers", F.array().cast("array<struct<pos:int,number:int>>"))
    else:
        some = chunks.select("row", "pos", "hash", "chunk").join(shared, "hash", "left_semi")
        number = F.row_number().over(Window.partitionBy("hash").orderBy("chunk"))  # contents that share a hash: a handful
        numbered = some.select("hash", "chunk").distinct().withColumn("number", number).where("number > 1")
        at = some.join(numbered, ["hash", "chunk"]).groupBy("row").agg(F.sort_array(F.collect_list(F.struct("pos", "number"))).alias("numbers"))
        recipes = scratch.save(recipes.join(at, "row", "left").withColumn("numbers", F.coalesce("numbers", F.array())), "recipes")
    key = ["n_bytes", "hashes", "numbers"]
    groups = recipes.groupBy(*key).agg(F.count("*").alias("group_size"), F.max(F.struct("own.id", "row")).alias("stays"))
    found = recipes.join(groups, key)
    return found.select(
        F.col("own.id").alias(id_col), *[F.col(f"own.c{k}").alias(c) for k, c in enumerate(carry)], F.col("stays.id").alias("keep_id"), "group_size",
        (F.col("row") == F.col("stays.row")).alias("kept"), F.col("sha").alias("text_sha256"), F.size("hashes").alias("n_chunks"),
    )
