"""Tables at rest."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .lineage import shared_folder, written


def stored_findings(findings: DataFrame) -> DataFrame:
    """Findings as they are stored: code cut at 500, whole numbers, ``raw`` as JSON, defaults for what is missing."""
    have = set(findings.columns)

    def col(name: str, default: object):
        return F.coalesce(F.col(name), F.lit(default)) if name in have else F.lit(default)

    raw = F.lit("{}")
    if "raw" in have:
        raw = F.col("raw") if findings.schema["raw"].dataType.simpleString() == "string" else F.to_json("raw")
    return findings.select(
        "scan_id", "file", col("line", 0).cast("int").alias("line"), F.substring(col("code", ""), 1, 500).alias("code"), "scanner",
        col("rule_id", "").alias("rule_id"), "title", "severity", col("severity_score", 0).cast("int").alias("severity_score"),
        col("cwe", "").alias("cwe"), col("owasp", "").alias("owasp"), col("description", "").alias("description"), raw.alias("raw"),
    )


#: Folders that findings and scans are dealt to by the hash of their scan.
BUCKETS = 64
#: Epoch of findings that no stream wrote.
BATCH = -1


def bucket(scan: Column) -> Column:
    """The folder ``scan_bucket`` of a scan, for readers that want only its files."""
    return F.pmod(F.xxhash64(scan), F.lit(BUCKETS)).cast("int")


def append_findings(findings: DataFrame, path: str) -> None:
    """Appends to folders ``epoch=-1/scan_bucket=<hash of the scan>``: a reader of one scan reads one, and a large scan is no single task's."""
    bucketed = stored_findings(findings).withColumn("epoch", F.lit(BATCH)).withColumn("scan_bucket", bucket(F.col("scan_id")))
    bucketed.write.mode("append").partitionBy("epoch", "scan_bucket").parquet(path)


def write_epoch(findings: DataFrame, path: str, epoch: int) -> None:
    """The findings of one batch of a stream, in a folder of its own, dealt like others: the same batch again replaces it."""
    bucketed = stored_findings(findings).withColumn("scan_bucket", bucket(F.col("scan_id")))
    bucketed.write.mode("overwrite").partitionBy("scan_bucket").parquet(f"{path}/epoch={epoch}")


def append(df: DataFrame, path: str) -> None:
    """Appends projects or recommendations."""
    df.write.mode("append").parquet(path)


_SCAN = "id, project_id, started_at, finished_at, files_scanned, findings_count, security_score, status, summary, version"


def _scan_rows(scans: DataFrame) -> DataFrame:
    defaults = {
        "started_at": F.lit(None).cast("timestamp"), "finished_at": F.lit(None).cast("timestamp"), "files_scanned": F.lit(0), "findings_count": F.lit(0), "security_score": F.lit(100),
        "status": F.lit("running"), "summary": F.lit(None).cast("string"), "version": F.lit(0),
    }
    for name, value in defaults.items():
        have = F.coalesce(F.col(name).cast("timestamp" if name.endswith("_at") else "string" if name in ("status", "summary") else "int"), value) if name in scans.columns else value
        scans = scans.withColumn(name, have)
    return scans.select(*_SCAN.split(", "))


def started(scans: DataFrame) -> DataFrame:
    """Rows of scans (id, project_id, started_at) that begin."""
    return _scan_rows(scans)


def ended(scans: DataFrame, finished_at: Column, status: str = "finished") -> DataFrame:
    """Rows of scans that end; they replace those of their start."""
    return _scan_rows(scans.withColumn("finished_at", finished_at).withColumn("status", F.lit(status)).withColumn("version", F.lit(1)))


def upsert_scans(changes: DataFrame, path: str) -> None:
    """Replaces scans in the table at ``path`` by rows of at least their version, and adds those that are not there.

    Only the folders of the changed scans are rewritten, from a checkpoint, and each is swapped as a whole. The same changes
    again, or a start that comes after the end, change nothing. One writer at a time.
    """
    spark = changes.sparkSession
    new = written(changes.withColumn("scan_bucket", bucket(F.col("id"))))
    touched = [r[0] for r in new.select("scan_bucket").distinct().collect()]  # ``BUCKETS`` at most
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    both = new
    if root.getFileSystem(spark._jsc.hadoopConfiguration()).exists(root):
        old = spark.read.schema(new.schema).parquet(path).where(F.col("scan_bucket").isin(touched))
        both = old.unionByName(new)
    cols = [c for c in new.columns if c not in ("id", "scan_bucket")]
    newest = both.groupBy("id", "scan_bucket").agg(F.max_by(F.struct(*cols), F.struct("version", F.coalesce("finished_at", "started_at"))).alias("s"))
    rows = written(newest.select("id", "s.*", "scan_bucket"))
    rows.repartition("scan_bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("scan_bucket").parquet(path)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new folder below the shared one, deleted when the session ends."""
    folder = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    p = spark._jvm.org.apache.hadoop.fs.Path(folder)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(p)
    return folder


def finished_scans(scans: DataFrame, findings: DataFrame) -> DataFrame:
    """Scans with the number of their findings, zero where there are none."""
    n = findings.groupBy(F.col("scan_id").alias("id")).agg(F.count("*").cast("int").alias("_n"))
    return scans.drop("findings_count").join(n, "id", "left").withColumn("findings_count", F.coalesce("_n", F.lit(0))).drop("_n")


def export_metrics(metrics: DataFrame, path: str) -> None:
    metrics.write.mode("overwrite").json(path)
