"""Language identification of mixed-language text.

Words are runs of letters and of the combining marks after them. The script of a word narrows its candidate languages to those that were
learned with letters of that script. Each word gets a log-likelihood per candidate from hashed character
trigrams (with word boundaries), and Viterbi with a switching penalty labels the words, so that spans
of a language come out. The document's language is the one whose spans hold the most letters.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches


#: Documents that the model is learned from, about.
SAMPLE = 20_000
LEARNERS = 12
BUCKETS = 1 << 15
PENALTY = 12.0
#: Texts are scored together up to so many characters; fewer with over eight languages.
GROUP_CHARS = 3_000_000

#: First and last code point of the main letters of each script (fixed values).
SCRIPTS = {
    "latin": [(0x41, 0x24F), (0x1E00, 0x1EFF)],
    "greek": [(0x370, 0x3FF), (0x1F00, 0x1FFF)],
    "cyrillic": [(0x400, 0x52F)],
    "hebrew": [(0x590, 0x5FF)],
    "arabic": [(0x600, 0x6FF), (0x750, 0x77F)],
    "devanagari": [(0x900, 0x97F)],
    "thai": [(0xE00, 0xE7F)],
    "kana": [(0x3040, 0x30FF)],
    "han": [(0x3400, 0x9FFF)],
    "hangul": [(0xAC00, 0xD7A3)],
}
_TABLE: list[np.ndarray] = []
_MARKS: list[np.ndarray] = []


def _scripts() -> np.ndarray:
    """For each code point: 0 if it is no letter, else 1 + its script, the last number for any other script."""
    if not _TABLE:
        table = np.zeros(0x110000, np.uint8)
        letters = [c for c in range(0x110000) if unicodedata.category(chr(c))[0] == "L"]
        table[letters] = len(SCRIPTS) + 1
        for k, ranges in enumerate(SCRIPTS.values()):
            for lo, hi in ranges:
                part = table[lo : hi + 1]
                part[part > 0] = k + 1
        _TABLE.append(table)
    return _TABLE[0]


def _letters(c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Script of each code point (0: no letter), and whether it is of a word: a letter, or a combining mark after one."""
    if not _MARKS:
        _MARKS.append(np.array([unicodedata.category(chr(x))[0] == "M" for x in range(0x110000)]))
    script, mark = _scripts()[c], _MARKS[0][c]
    letter = script > 0
    if mark.any():
        at = np.arange(len(c))
        last = np.maximum.accumulate(np.where(letter, at, -1))
        gap = np.maximum.accumulate(np.where(letter | mark, -1, at))
        letter |= mark & (last > gap)
    return script, letter


def _points(text: str) -> np.ndarray:
    """Code points of the text in lower case, one for each of its characters."""
    low = text.lower()
    if len(low) != len(text):  # the lower case of a few characters is two: the first of them stands for both
        low = "".join(c.lower()[0] for c in text)
    return np.frombuffer(low.encode("utf-32-le", "replace"), "<u4")


def _codes(c: np.ndarray, letter: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Trigram buckets at each letter and at each word's end, and their places; non-letters count as one boundary."""
    x = np.where(letter, c, 0).astype(np.uint32)
    x = np.concatenate([np.zeros(2, np.uint32), x, np.zeros(1, np.uint32)])
    code = (x[:-2] * np.uint32(0x9E3779B1) ^ x[1:-1] * np.uint32(0x85EBCA77) ^ x[2:] * np.uint32(0xC2B2AE3D)) >> np.uint32(17)
    here = np.append(letter, False)
    at = np.flatnonzero(here | np.concatenate([[False], here[:-1]]))
    return code[at].astype(np.int64), at


@dataclass
class Model:
    langs: list[str]
    table: np.ndarray  # (buckets, languages) log-probabilities
    allowed: np.ndarray  # (scripts + 2, languages): whether the script narrows to the language

    def words(self, c: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and lengths of the words of code points ``c``, and their scores (words, languages)."""
        script, letter = _letters(c)
        edge = np.diff(np.concatenate([[0], letter.astype(np.int8), [0]]))
        starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        if not len(starts):
            return starts, starts, np.zeros((0, len(self.langs)), np.float32)
        code, at = _codes(c, letter)
        cut = np.searchsorted(at, starts)
        scores = np.stack([np.add.reduceat(self.table[code, k], cut) for k in range(len(self.langs))], axis=1)
        ok = self.allowed[script[starts]]
        none = ~ok.any(axis=1)
        scores = np.where(ok | none[:, None], scores, np.float32(-1e6))
        scores[none] = 0
        return starts, ends - starts, scores


def viterbi(scores: np.ndarray, sizes: np.ndarray, penalty: float = PENALTY) -> np.ndarray:
    """Best language of each word. ``scores``: words of all texts in turn; ``sizes``: words of each text (over 0).

    Texts advance together, word by word, the longest first, so that those still running stay a prefix.
    """
    order = np.argsort(-sizes, kind="stable")
    first = (np.cumsum(sizes) - sizes)[order]
    running = len(sizes) - np.searchsorted(np.sort(sizes), np.arange(sizes.max()), "right")
    back = np.empty(scores.shape, np.min_scalar_type(max(scores.shape[1] - 1, 0)))
    value = scores[first].astype(np.float64)
    own = np.arange(scores.shape[1])
    for t in range(1, len(running)):
        n = running[t]
        v = value[:n]
        top = v.argmax(axis=1)
        best = v[np.arange(n), top] - penalty
        stay = v >= best[:, None]
        rows = first[:n] + t
        back[rows] = np.where(stay, own, top[:, None])
        value[:n] = np.maximum(v, best[:, None]) + scores[rows]
    out = np.empty(len(scores), np.int64)
    state = value.argmax(axis=1)
    for t in range(len(running) - 1, -1, -1):
        n = running[t]
        rows = first[:n] + t
        out[rows] = state[:n]
        if t:
            state[:n] = back[rows, state[:n]]
    return out


def detect(texts: list[str | None], model: Model, penalty: float = PENALTY) -> list[tuple[str, float, list[tuple[int, int, str]]]]:
    """(language, share of letters, spans (start, end, language)) of each text; ``und`` without letters."""
    out: list = [("und", 0.0, [])] * len(texts)
    group: list[int] = []
    chars = 0

    def flush() -> None:
        parts = [model.words(_points(texts[i])) for i in group]
        sizes = np.array([len(p[0]) for p in parts])
        some = sizes > 0
        if not some.any() or not model.langs:
            return
        path = viterbi(np.concatenate([p[2] for p in parts]), sizes[some], penalty)
        at = 0
        for i, (starts, lengths, _) in zip(group, parts, strict=True):
            n = len(starts)
            if n:
                own = path[at : at + n]
                at += n
                held = np.bincount(own, weights=lengths, minlength=len(model.langs))
                k = int(held.argmax())
                turn = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
                last = np.append(turn[1:], n) - 1
                spans = [(int(starts[a]), int(starts[b] + lengths[b]), model.langs[own[a]]) for a, b in zip(turn, last, strict=True)]
                out[i] = (model.langs[k], float(held[k] / held.sum()), spans)

    for i, t in enumerate(texts):
        if t:
            group.append(i)
            chars += len(t)
            if chars * max(1, len(model.langs) / 8) > GROUP_CHARS:
                flush()
                group, chars = [], 0
    if group:
        flush()
    return out


def learn(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", sample: int = SAMPLE) -> Model:
    """Learns from at most ``sample`` documents whose language is not null, those with the least hashes of their ids.

    Rows that repeat an id count once (the least by language and text); a null text teaches nothing. ``LEARNERS`` tasks
    sum trigrams and scripts per language; each sends a row per language to the driver.
    """
    rows = docs.where(F.col(lang_col).isNotNull()).select(F.xxhash64(id_col).alias("h"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    # the hash at which the sample ends; combined before it is sorted, so that a repeated id is one row
    last = rows.select("h").distinct().orderBy("h").limit(sample).agg(F.max("h")).first()[0]
    rows = rows.where(F.col("h") <= F.lit(last)).groupBy("h").agg(F.min(F.struct("lang", "text")).alias("row"))
    rows = rows.select("row.lang", "row.text").where("text is not null").repartition(LEARNERS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams: dict[str, np.ndarray] = {}
        scripts: dict[str, np.ndarray] = {}
        for b in batches:
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                c = _points(text)
                script, letter = _letters(c)
                g = grams.setdefault(lang, np.zeros(BUCKETS, np.int64))
                g += np.bincount(_codes(c, letter)[0], minlength=BUCKETS)
                s = scripts.setdefault(lang, np.zeros(len(SCRIPTS) + 2, np.int64))
                s += np.bincount(script, minlength=len(SCRIPTS) + 2)
        if grams:
            arrays = [pa.array(list(grams)), *[pa.array([x.tolist() for x in d.values()], pa.list_(pa.int64())) for d in (grams, scripts)]]
            yield pa.RecordBatch.from_arrays(arrays, ["lang", "grams", "scripts"])

    got = rows.mapInArrow(run, "lang string, grams array<bigint>, scripts array<bigint>").toArrow()
    langs = sorted(set(got["lang"].to_pylist()))
    grams, scripts = np.zeros((BUCKETS, len(langs))), np.zeros((len(SCRIPTS) + 2, len(langs)))
    for row in got.to_pylist():
        k = langs.index(row["lang"])
        grams[:, k] += row["grams"]
        scripts[:, k] += row["scripts"]
    scripts[0] = 0
    table = np.log((grams + 0.5) / (grams + 0.5).sum(axis=0)).astype(np.float32)
    allowed = scripts > 0.001 * np.maximum(scripts.sum(axis=0), 1)
    return Model(langs, table, allowed)


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", spans: bool = False) -> DataFrame:
    """id_col, lang_pred, score (share of letters): one row per input row; ``spans`` adds (start, end, lang) of each span.

    Null texts and texts without a letter give ``und`` and 0; combining marks are of the word of the letter before them,
    and marks alone are no letters. An empty table gives an empty table.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)
    small_batches(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = detect(b.column(1).to_pylist(), shared.value)
            arrays = [b.column(0), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())]
            if spans:
                kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("lang", pa.string())]))
                arrays.append(pa.array([[dict(zip(("start", "end", "lang"), s, strict=True)) for s in f[2]] for f in found], kind))
            yield pa.RecordBatch.from_arrays(arrays, [id_col, "lang_pred", "score", *["spans"] * spans])

    src = docs.select(F.col(id_col), F.col(text_col).alias("_text"))
    more = ", spans array<struct<start:bigint,end:bigint,lang:string>>" * spans
    return src.mapInArrow(run, f"`{id_col}` {src.schema[0].dataType.simpleString()}, lang_pred string, score double{more}")
