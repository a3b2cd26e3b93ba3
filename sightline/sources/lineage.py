"""Cutting lineage: tables that later stages read are written to the folder that all executors share."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The session's folder (spark.checkpoint.dir). Only a ``local`` session that names none gets a temporary one."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = context.getConf().get("spark.checkpoint.dir")
        if not folder:
            if not re.match(r"local(\[|$)", context.master):
                raise RuntimeError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
            folder = tempfile.mkdtemp(prefix="spark-")
        context.setCheckpointDir(folder)
    return context.getCheckpointDir().rstrip("/")


def written(df: DataFrame) -> DataFrame:
    """``df`` from its checkpoint, made now. Values that depend on where rows lay stay as they are from then on."""
    shared_folder(df.sparkSession)
    return df.checkpoint()
