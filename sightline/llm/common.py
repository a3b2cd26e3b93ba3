"""Helpers that several corpus operators share: reading tables, shared scratch tables.

Batches that go to Python are bounded by Spark in bytes (spark.sql.execution.arrow.maxBytesPerBatch). That bound is the one
setting of a session that operators change: they lower it where it is larger than ``BATCH_BYTES``.
"""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, as in the word pattern ``[^\x20\x09-\x0D]+``.
WHITE = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share. Only a ``local`` session, as in tests, may name none and gets a temporary one."""
    path = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


class Scratch:
    """Tables written to the shared folder to cut lineage: a lost executor costs a reread, not a recomputation.

    Results are lazy and read them, so they stay until ``drop`` or else until the session ends, which deletes them.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
        small_batches(spark)

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def save(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        df.write.mode("overwrite").parquet(path)
        fs, root = self._fs(self.root)
        fs.deleteOnExit(root)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        for name in names:
            fs, p = self._fs(f"{self.root}/{name}")
            fs.delete(p, True)


#: Bytes of a batch that goes to Python, or one row.
BATCH_BYTES = 4 << 20


def small_batches(spark: SparkSession) -> None:
    """From now on batches for Python hold ``BATCH_BYTES`` at most. Results are lazy, so the setting stays."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(re.sub(r"\D", "", spark.conf.get(name))) > BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))


def crc_mod(column: str, divisor: int) -> Column:
    """crc32 of the value as text, modulo ``divisor``."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % F.lit(divisor)


def without(df: DataFrame, *names: str) -> DataFrame:
    """``df`` without columns an operator is about to add (an input column of that name gives way)."""
    return df.drop(*[c for c in df.columns if c.lower() in {n.lower() for n in names}])
