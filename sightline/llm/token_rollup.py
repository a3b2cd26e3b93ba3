"""Token counts by source, language and tokenizer version, kept up to date by signed deltas.

A batch of changes (inserts, deletes, revised counts) becomes additive totals per key, combined before
the shuffle, and is committed as one folder named by the batch's id. A batch whose folder is complete
is skipped, one that a lost job left half-written is written anew, so a replay changes nothing. Totals
are the sum over committed batches; ``compact`` folds them into one and keeps the folded ids in one table.
Folders are written under names of their own and renamed, which has to be atomic, as on HDFS and local disks; a store
that copies on rename gives no such promise.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

KEYS = ("source", "lang", "tokenizer")
SCHEMA = "source string, lang string, tokenizer string, docs bigint, tokens bigint"

_COUNTERS: dict[tuple, object] = {}


def _counter(path: str, pattern: str | None):
    """Counts the tokens of an array of texts with a tokenizer file; one for each worker and file."""
    key = (path, pattern)
    if key not in _COUNTERS:
        if pattern is None:
            from .packing import word_tokenizer

            words = word_tokenizer(path)
            _COUNTERS[key] = lambda texts: np.diff(words.encode_flat(texts)[1])
        else:
            import base64

            import tiktoken

            with open(path, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            encode = tiktoken.Encoding(path, pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
            _COUNTERS[key] = lambda texts: np.array([len(encode(t)) if t else 0 for t in texts.to_pylist()], np.int64)
    return _COUNTERS[key]


def token_counts(docs: DataFrame, texts: Mapping[str, str], versions: Mapping[str, tuple[str, str | None]]) -> DataFrame:
    """``docs`` without its text columns, with ``<version>/<name>`` for each version and text: its tokens.

    ``texts``: text columns by name. ``versions``: path of a tokenizer file that is there on every executor and, for files
    of ranks, the pattern of their words; without one the file is a word-level BPE in JSON. Special tokens are not
    added. A null text has a null count, an empty one 0. An empty table gives an empty table.
    """
    rest = [c for c in docs.columns if c not in texts.values()]
    names = [f"{v}/{t}" for v in versions for t in texts]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        from .packing import slices

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        for b in batches:
            found = []
            for path, pattern in versions.values():
                count = _counter(path, pattern)
                for k in range(len(texts)):
                    column = b.column(len(rest) + k)
                    n = np.concatenate([np.empty(0, np.int64), *[count(part) for part in slices(column)]])
                    found.append(pc.if_else(column.is_null(), pa.scalar(None, pa.int64()), pa.array(n)))
            yield pa.RecordBatch.from_arrays([*b.columns[: len(rest)], *found], [*rest, *names])

    src = docs.select(*rest, *[F.col(c).alias(f"_text{k}") for k, c in enumerate(texts.values())])
    kinds = [f"`{c}` {src.schema[c].dataType.simpleString()}" for c in rest]
    return src.mapInArrow(run, ", ".join([*kinds, *[f"`{n}` bigint" for n in names]]))


#: Tokenizer versions that are patterns: each match is a token.
PATTERNS = {
    "words-1": r"[^\x20\x09-\x0D]+",
    "pieces-2": r"[\p{L}]+|[\p{N}]|[^\x20\x09-\x0D\p{L}\p{N}]+",
}


def count_tokens(text: Column, version: str) -> Column:
    """Tokens of a text by a pattern version; null and empty texts have none."""
    return F.coalesce(F.regexp_count(text, F.lit(PATTERNS[version])), F.lit(0)).cast("bigint")


def inserts(counts: DataFrame) -> DataFrame:
    """Changes that add each row (source, lang, tokenizer, tokens)."""
    return counts.select(*KEYS, F.lit(1).cast("bigint").alias("docs"), F.col("tokens").cast("bigint").alias("tokens"))


def deletes(counts: DataFrame) -> DataFrame:
    """Changes that take each row, as it was last counted, out again."""
    return counts.select(*KEYS, F.lit(-1).cast("bigint").alias("docs"), (-F.col("tokens")).cast("bigint").alias("tokens"))


def revisions(counts: DataFrame, old: str, new: str) -> DataFrame:
    """Changes of rows whose count went from ``old`` to ``new``; documents stay as many."""
    return counts.select(*KEYS, F.lit(0).cast("bigint").alias("docs"), (F.col(new) - F.col(old)).cast("bigint").alias("tokens"))


class TokenRollup:
    """Committed batches under one folder of the shared storage."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._pattern = re.sub(r"([*?{}\[\]\\])", r"\\\1", self.path)  # where paths are read as patterns

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def committed(self) -> list[str]:
        """Ids of complete batches that have folders, in order; the ids of folded ones are rows of ``folded``."""
        fs, marks = self._fs(f"{self._pattern}/batch=*/_SUCCESS")
        return sorted(s.getPath().getParent().getName()[6:] for s in fs.globStatus(marks) or [])

    def folded(self) -> DataFrame | None:
        """(batch): ids that ``compact`` folded into the totals it left here; None where it left none."""
        fs, p = self._fs(f"{self.path}/folded/_SUCCESS")
        return self.spark.read.schema("batch string").parquet(f"{self._pattern}/folded") if fs.exists(p) else None

    def _done(self, batch: str) -> bool:
        fs, p = self._fs(f"{self.path}/batch={batch}/_SUCCESS")
        if fs.exists(p):
            return True
        folded = self.folded()  # sorted by id, so few of its row groups are read
        return folded is not None and not folded.where(F.col("batch") == batch).isEmpty()

    def _rename(self, own: str, final: str) -> bool:
        """Makes the folder ``own`` the folder ``final``; False, and ``own`` is gone, where ``final`` is there."""
        hadoop = self.spark._jvm.org.apache.hadoop.fs
        fs, p = self._fs(own)
        no_options = self.spark._sc._gateway.new_array(getattr(hadoop, "Options$Rename"), 0)
        try:
            context = hadoop.FileContext.getFileContext(fs.getUri(), self.spark._jsc.hadoopConfiguration())
            context.rename(p, hadoop.Path(final), no_options)
        except Py4JJavaError as e:
            fs.delete(p, True)
            if "FileAlreadyExistsException" in str(e.java_exception):
                return False
            raise
        return True

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Adds the batch unless it is there; says whether it did. Null keys are keys of their own, an empty batch counts.

        A folded batch counts as there.
        """
        if not re.fullmatch(r"[\w.-]+", batch):
            raise ValueError(f"not a batch id: {batch!r}")
        if self._done(batch):
            return False
        sums = changes.groupBy(*KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))
        own = f"{self.path}/writing-{batch}-{uuid.uuid4().hex[:12]}"
        sums.write.parquet(own)
        if self._rename(own, f"{self.path}/batch={batch}"):
            return True
        if self._done(batch):
            return False  # another writer was first
        raise RuntimeError(f"the folder of batch {batch!r} is there without its mark of success")

    def totals(self) -> DataFrame:
        """(source, lang, tokenizer, docs, tokens) over all committed batches; keys without documents are gone."""
        return self._totals(self.committed())

    def _totals(self, batches: list[str]) -> DataFrame:
        if not batches:
            return self.spark.createDataFrame([], SCHEMA)
        rows = self.spark.read.schema(SCHEMA).parquet(*[f"{self._pattern}/batch={b}" for b in batches])
        sums = rows.groupBy(*KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))
        return sums.where("docs <> 0 or tokens <> 0")

    def compact(self, into: str) -> "TokenRollup":
        """A new rollup at ``into``: one batch of totals and one table of the ids folded in, which count as there.

        Two jobs, whatever the number of batches. ``into`` comes whole by one rename: a lost compaction leaves
        nothing there, and where something is there already it raises ``FileExistsError``. Batches that are
        committed meanwhile are neither in the totals nor among the ids.
        """
        into, name = into.rstrip("/"), uuid.uuid4().hex[:12]
        own, batches = TokenRollup(self.spark, f"{into}-writing-{name}"), self.committed()
        ids = self.spark.createDataFrame([(b,) for b in batches], "batch string")
        before = self.folded()
        (ids if before is None else before.unionByName(ids)).sort("batch").write.parquet(f"{own.path}/folded")
        own.commit(f"folded-{name}", self._totals(batches))
        if not self._rename(own.path, into):
            raise FileExistsError(into)
        return TokenRollup(self.spark, into)


def without_repeated_lines(text: Column) -> Column:
    """The text's distinct lines, each where it first stood."""
    return F.array_join(F.array_distinct(F.split(F.coalesce(text, F.lit("")), "\n")), "\n")
