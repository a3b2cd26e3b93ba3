"""Incremental scans of arriving files, from a landing table of (scan_id, path, text, version) rows."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StatefulProcessor, StatefulProcessorHandle

from ..operators.scan import detect_all
from ..sources.sinks import bucket, write_epoch

_CHANGED = "scan_id string, path string, text string, digest string, version bigint"


class _Changes(StatefulProcessor):
    """Keeps the digest and the version of each file's newest text, and lets through only files that differ from it."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "digest string, version long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        newest = None
        for b in rows:
            for row in b[["text", "digest", "version"]].itertuples(index=False, name=None):
                if newest is None or (row[2], row[1] or "") > (newest[2], newest[1] or ""):
                    newest = row
        known = self.last.get() if self.last.exists() else None
        text, digest, version = newest[0], newest[1] or None, int(newest[2])
        if known is None or version >= known[1]:
            self.last.update((digest, version))
            if (known and known[0]) != digest:
                yield pd.DataFrame([(*key, text, digest, version)], columns=["scan_id", "path", "text", "digest", "version"])

    def close(self) -> None:
        pass


def changed_files(files: DataFrame) -> DataFrame:
    """Of a stream of files (scan_id, path, text, version): those whose text differs from the newest that came before.

    A null text says that the file was deleted. Of several versions the largest counts; an older one that comes later is
    ignored. State holds a digest for each file, never its text. The session needs the RocksDB state store.
    """
    rows = files.select(
        F.col("scan_id").cast("string").alias("scan_id"), "path", "text", F.coalesce(F.sha2("text", 256), F.lit("")).alias("digest"), F.col("version").cast("bigint").alias("version")
    )
    return rows.groupBy("scan_id", "path").transformWithStateInPandas(statefulProcessor=_Changes(), outputStructType=_CHANGED, outputMode="append", timeMode="none")


def scan_stream(files: DataFrame, path: str, checkpoint: str, user_rules: Sequence[dict] = ()) -> DataStreamWriter:
    """A writer that keeps the findings of arriving files (scan_id, path, text, and version if there is one) at ``path``.

    All detectors of a scan run on the files that changed, each batch once: a file that comes again unchanged is not
    scanned. ``path/findings`` and ``path/files`` get a folder for each batch; a batch that is replayed replaces its own. See
    :func:`current_findings`. ``files`` is a stream over a table, as file sources hide names that start with ``_`` or ``.``.
    """

    def scan(batch: DataFrame, epoch: int) -> None:
        batch.persist()
        write_epoch(detect_all(batch.where("text is not null"), user_rules), f"{path}/findings", epoch)
        index = batch.select("scan_id", "path", "digest", "version", bucket(F.col("scan_id")).alias("scan_bucket"))
        index.write.mode("overwrite").partitionBy("scan_bucket").parquet(f"{path}/files/epoch={epoch}")
        batch.unpersist()

    versioned = files if "version" in files.columns else files.withColumn("version", F.lit(0))
    return changed_files(versioned).writeStream.foreachBatch(scan).option("checkpointLocation", checkpoint)


def current_findings(spark: SparkSession, path: str) -> DataFrame:
    """Findings of the newest text of each file that is still there."""
    index = spark.read.schema("scan_id string, path string, digest string, version bigint, scan_bucket int, epoch bigint").parquet(f"{path}/files")
    newest = index.groupBy("scan_bucket", "scan_id", F.col("path").alias("file")).agg(F.max_by(F.struct("epoch", "digest"), "epoch").alias("last"))
    newest = newest.where("last.digest is not null").select("scan_bucket", "scan_id", "file", F.col("last.epoch").alias("epoch"))
    return spark.read.parquet(f"{path}/findings").join(newest, ["scan_bucket", "scan_id", "file", "epoch"], "left_semi")
