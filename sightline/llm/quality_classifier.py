"""Quality classifier: votes of the nearest labelled documents in a latent-semantic space.

Fit (on a bounded sample of labelled rows): terms are hashed byte trigrams and a few counts of form;
logarithmic counts are weighted by inverse document frequency, and a truncated SVD gives the latent
space. Score: each whole text is folded into the space, its cosine to every labelled vector is computed
in blocks, and the nearest vote with their similarity. What is broadcast is bounded by the
sample and the space: ``sample * rank + terms * rank`` numbers.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches


#: Labelled rows that the space is fitted on, at most.
SAMPLE = 4000
HASHED, FORM = 4096, 5
#: Weight of the shares of form beside the trigrams, whose vector has length 1.
FORM_WEIGHT = 3.0
RANK, NEIGHBOURS = 48, 15
#: A document's trigrams are counted in pieces of so many bytes (all of them).
PIECE = 1 << 22
#: Documents whose cosines are computed at once.
BLOCK = 500


def terms(text: bytes | None) -> np.ndarray:
    """Term counts of one whole text; null and empty texts have none."""
    out = np.zeros(HASHED + FORM, np.float32)
    text = text or b""
    for at in range(0, len(text), PIECE):
        b = np.frombuffer(text[at : at + PIECE + 2], np.uint8).astype(np.uint32)
        if len(b) > 2:
            code = (b[:-2] * np.uint32(0x9E3779B1) ^ b[1:-1] * np.uint32(0x85EBCA77) ^ b[2:] * np.uint32(0xC2B2AE3D)) >> np.uint32(20)
            out[:HASHED] += np.bincount(code, minlength=HASHED)
    words = text.split()
    lines = [x for x in text.split(b"\n") if x.strip()]
    raw = np.frombuffer(text, np.uint8)
    shares = (
        (sum(a == b for a, b in zip(words, words[1:], strict=False)), len(words) - 1),  # a word said again at once
        (len(words) - len(set(words)), len(words)),
        (len(lines) - len(set(lines)), len(lines)),
        (((raw >= 65) & (raw <= 90)).sum(), len(raw)),
        (((raw >= 33) & (raw <= 47)).sum(), len(raw)),
    )
    out[HASHED:] = [n / max(1, of) for n, of in shares]
    return out


def weigh(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Rows of weighted terms: trigrams to length 1, shares of form by their weight."""
    x = np.log1p(counts[:, :HASHED]) * idf
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    return np.hstack([x / np.where(norm > 0, norm, 1), FORM_WEIGHT * counts[:, HASHED:]])


@dataclass
class Space:
    """A fitted space: weights of terms, their projection, labelled vectors and labels."""

    idf: np.ndarray
    basis: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    prior: float

    def fold(self, counts: np.ndarray) -> np.ndarray:
        y = weigh(counts, self.idf) @ self.basis
        norm = np.linalg.norm(y, axis=1, keepdims=True)
        return (y / np.where(norm > 0, norm, 1)).astype(np.float32)

    def score(self, counts: np.ndarray) -> np.ndarray:
        """Share of label 1 among the nearest, by similarity; the prior where nothing is near."""
        if not len(self.labels):
            return np.full(len(counts), self.prior)
        sims = self.fold(counts) @ self.vectors.T
        k = min(NEIGHBOURS, sims.shape[1])
        least = -np.partition(-sims, k - 1, axis=1)[:, k - 1 : k]
        over, level = sims > least, sims == least  # of those level with the last one, the first make up the number
        take = over | level & (np.cumsum(level, axis=1) <= k - over.sum(axis=1, keepdims=True))
        near = np.nonzero(take)[1].reshape(len(sims), k)
        w = np.maximum(np.take_along_axis(sims, near, 1), 0).astype(np.float64) ** 8
        total = w.sum(axis=1)
        votes = (w * self.labels[near]).sum(axis=1)
        return np.clip(np.where(total > 1e-12, votes / np.where(total > 1e-12, total, 1), self.prior), 0, 1)


def fit_space(counts: np.ndarray, labels: np.ndarray, rank: int = RANK, seed: int = 3) -> Space:
    """Truncated SVD by subspace iteration. Without rows: a space in which every score is 0.5."""
    n, width = counts.shape
    if not n:
        return Space(np.ones(HASHED, np.float32), np.zeros((width, 1), np.float32), np.zeros((0, 1), np.float32), labels, 0.5)
    idf = (np.log((1 + n) / (1 + (counts[:, :HASHED] > 0).sum(axis=0))) + 0.2).astype(np.float32)
    x = weigh(counts, idf)
    q = np.random.default_rng(seed).standard_normal((width, min(rank + 16, n, width))).astype(np.float32)
    for _ in range(6):
        q, _ = np.linalg.qr(x.T @ (x @ q))
    _, _, vt = np.linalg.svd(x @ q, full_matrices=False)
    space = Space(idf, (q @ vt.T)[:, :rank].astype(np.float32), np.zeros((0, 1), np.float32), labels.astype(np.float64), float(labels.mean()))
    space.vectors = space.fold(counts)
    return space


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE) -> Space:
    """Fits on at most ``sample`` documents with a label, the same ones at each run (least hash of the id).

    Rows that repeat an id count once: with the least of their labels and the least of their texts that are not null.
    Of neighbours that are equally near, the ones with the least ids vote.
    """
    known = labels.where(F.col(label_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(label_col).cast("double").alias("label"))
    picked = known.groupBy("id").agg(F.min("label").alias("label")).orderBy(F.xxhash64("id"), "id").limit(sample)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text")).join(F.broadcast(picked), "id")
    rows = rows.groupBy("id").agg(F.min("label").alias("label"), F.min("text").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [terms(t).astype("<f4").tobytes() for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(found, pa.binary())], ["id", "label", "terms"])

    id_type = rows.schema["id"].dataType.simpleString()
    got = rows.select("id", "label", "text").mapInArrow(run, f"id {id_type}, label double, terms binary").toArrow()
    order = np.argsort(got["id"].to_numpy(), kind="stable")
    counts = np.array([np.frombuffer(t, "<f4") for t in got["terms"].to_pylist()], np.float32).reshape(-1, HASHED + FORM)
    return fit_space(counts[order], got["label"].to_numpy()[order])


def score(docs: DataFrame, space: Space, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """id_col, score (0..1), predicted (1 from ``threshold`` on): one row per input row.

    Null and empty texts are scored like any other (they lie near nothing and get the prior). An
    empty table gives an empty table.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(space)
    small_batches(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, BLOCK):
                part = b.slice(at, BLOCK)
                s = shared.value.score(np.array([terms(t) for t in part.column(1).to_pylist()]))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(s, pa.float64()), pa.array((s >= threshold).astype(np.int32))], [id_col, "score", "predicted"]
                )

    src = docs.select(F.col(id_col), F.col(text_col).cast("binary").alias("_text"))
    return src.mapInArrow(run, f"`{id_col}` {src.schema[0].dataType.simpleString()}, score double, predicted int")
