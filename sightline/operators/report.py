"""Aggregates of scans: severity counts, scores, top lists, shares, texts, digests."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import grade, penalty, security_score, severity_rank
from ..sources.lineage import written
from .findings import numbered

FOUR = ("Critical", "High", "Medium", "Low")


def severity_counts(findings: DataFrame, by: str = "scan_id") -> DataFrame:
    """(by, severity, n): zero-filled for the four labels; other labels as they come."""
    counts = findings.groupBy(by, "severity").agg(F.count("*").alias("n"))
    zeros = counts.select(by).distinct().withColumn("severity", F.explode(F.array(*[F.lit(s) for s in FOUR]))).withColumn("n", F.lit(0).cast("bigint"))
    return counts.unionByName(zeros).groupBy(by, "severity").agg(F.sum("n").alias("n"))


def scores(findings: DataFrame, files: DataFrame | None = None, by: str = "scan_id") -> DataFrame:
    """(by, n, critical, high, medium, low, files, score, grade) of each scan, in one aggregation.

    ``files``: (by, files) of all scans; those without findings get 100. Without it, the files are those that have findings.
    """
    out = findings.groupBy(by).agg(
        F.count("*").alias("n"),
        *[F.count_if(F.col("severity") == s).alias(s.lower()) for s in FOUR],
        F.sum(penalty(F.col("severity"))).alias("penalty"),
        *([] if files is not None else [F.count_distinct("file").alias("files")]),
    )
    if files is not None:
        out = files.join(out, by, "left").na.fill(0, ["n", *[s.lower() for s in FOUR], "penalty"])
    score = F.when(F.col("n") == 0, 100).otherwise(security_score(F.col("penalty"), F.col("files")))
    out = out.withColumn("score", score.cast("int"))
    return out.select(by, "n", *[s.lower() for s in FOUR], "files", "score", grade(F.col("score")).alias("grade"))


def dominant_language(files: DataFrame, by: str = "project_id") -> DataFrame:
    """The language with the most files of each project; ties go to the first by name."""
    counts = files.where("language is not null").groupBy(by, "language").agg(F.count("*").alias("n"))
    best = counts.groupBy(by).agg(F.min_by("language", F.struct((-F.col("n")).alias("n"), "language")).alias("language"))
    return files.select(by).distinct().join(best, by, "left").withColumn("language", F.coalesce("language", F.lit("unknown")))


def top(findings: DataFrame, key: str, k: int = 8, by: str = "scan_id", empty: str | None = None) -> DataFrame:
    """(by, key, n, rank): the ``k`` most frequent keys. Empty keys are left out, or called ``empty``."""
    name = F.coalesce(F.col(key), F.lit(""))
    df = findings.withColumn("_key", F.when(name == "", F.lit(empty)).otherwise(name)).where("_key is not null")
    counts = df.groupBy(by, F.col("_key").alias(key)).agg(F.count("*").alias("n"))
    w = Window.partitionBy(by).orderBy(F.col("n").desc(), key)
    return counts.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def shares(findings: DataFrame, by: str = "scan_id") -> DataFrame:
    """(by, severity, n, share, width): share as a whole percent, and width relative to the largest."""
    counts = severity_counts(findings, by)
    w = Window.partitionBy(by)
    total, most = F.sum("n").over(w), F.max("n").over(w)
    return counts.select(
        by, "severity", "n", F.concat(F.bround(100.0 * F.col("n") / total).cast("int").cast("string"), F.lit("%")).alias("share"),
        (100.0 * F.col("n") / F.greatest(most, F.lit(1))).alias("width"),
    )


def summary_text(findings: DataFrame, by: str = "scan_id") -> DataFrame:
    """One sentence for each scan; labels outside the four only count in the total."""
    out = findings.groupBy(by).agg(F.count("*").alias("n"), *[F.count_if(F.col("severity") == s).alias(s.lower()) for s in FOUR])
    text = F.format_string("%d findings: %d critical, %d high, %d medium, %d low.", "n", *[s.lower() for s in FOUR])
    return out.select(by, text.alias("summary"))


def leading_lines(findings: DataFrame, k: int, by: str = "scan_id", brief: bool = False) -> DataFrame:
    """(by, lines): the ``k`` findings of the highest score, in words; ties by id. ``brief``: title and place, in one line."""
    w = Window.partitionBy(by).orderBy(F.col("severity_score").desc(), "id")
    first = findings.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= k)
    # Fixed value: the words that results must agree on.
    text = F.format_string("%s (%s:%d)", "title", "file", "line") if brief else F.format_string("- [%s] %s (%s) in %s:%d", "severity", "title", "cwe", "file", "line")
    listed = F.transform(F.array_sort(F.collect_list(F.struct("_n", text.alias("text")))), lambda x: x["text"])
    return first.groupBy(by).agg(F.array_join(listed, "; " if brief else "\n").alias("lines"))


def concentration(findings: DataFrame, by: str = "scan_id") -> DataFrame:
    """The file with the most findings, their number, and the highest severity that occurs."""
    per = findings.groupBy(by, "file").agg(F.count("*").alias("n"), F.min(severity_rank(F.col("severity"))).alias("r"), F.min_by("severity", severity_rank(F.col("severity"))).alias("s"))
    return per.groupBy(by).agg(
        F.min_by("file", F.struct((-F.col("n")).alias("n"), "file")).alias("worst_file"), F.max("n").alias("worst_n"), F.min_by("s", "r").alias("highest"),
    )


def leading_findings(findings: DataFrame, k: int = 3, by: str = "scan_id") -> DataFrame:
    """(by, tally, leading): severities with their numbers by label, and the ``k`` findings of the highest score."""
    w = Window.partitionBy(by).orderBy(F.col("severity_score").desc(), "id")
    first = findings.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= k)
    first = first.groupBy(by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_n", "rule_id"))), lambda x: x["rule_id"]), ", ").alias("leading"))
    counts = findings.groupBy(by, "severity").agg(F.count("*").alias("n")).groupBy(by)
    pairs = F.transform(F.array_sort(F.collect_list(F.struct("severity", "n"))), lambda x: F.concat(x["severity"], F.lit(": "), x["n"].cast("string")))
    return counts.agg(F.array_join(pairs, ", ").alias("tally")).join(first, by)


#: Children of a digest's node, at most.
FAN = 1024


def digest(findings: DataFrame, columns: Sequence[str], by: str = "scan_id", fan: int = FAN, levels: int | None = None) -> DataFrame:
    """(by, digest): root of a tree of SHA-256 over a scan's findings, independent of their order and of how they lie.

    Each finding is hashed on its own. In the order of their hashes, ``fan`` findings make a node, whose digest is that of its
    children's joined; ``fan`` nodes make one of the next level, until a scan has one. So no list is longer than ``fan``,
    however many findings a scan has, and all but the numbering takes a single pass for each level.

    ``levels``: the tree ends at that level, all nodes of which are returned: more than one for a scan of over ``fan ** levels`` findings.
    """
    row = F.sha2(F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in columns]), 256)
    leaves = findings.select(F.col(by).alias("_by"), row.alias("h"))
    nodes = numbered(leaves.withColumn("_tie", F.monotonically_increasing_id()), ["_by"], [F.col("h"), F.col("_tie")], "_at")
    nodes = nodes.select("_by", (F.col("_at") - 1).cast("bigint").alias("at"), "h")
    level = 0
    while True:
        up = nodes.groupBy("_by", F.floor(F.col("at") / fan).alias("at")).agg(F.sort_array(F.collect_list(F.struct("at", "h"))).alias("xs"), F.count("*").alias("n"))
        joined = F.sha2(F.array_join(F.transform("xs", lambda x: x["h"]), ""), 256)
        if level:  # a first group of one child is all that the scan has: its root, which stays as it is
            joined = F.when((F.col("n") == 1) & (F.col("at") == 0), F.get("xs", F.lit(0))["h"]).otherwise(joined)
        nodes = written(up.select("_by", "at", joined.alias("h")))
        level += 1
        if level == levels:
            return nodes.select(F.col("_by").alias(by), F.col("h").alias("digest"))
        roots = nodes.groupBy("_by").agg(F.max("at").alias("last"))
        if roots.where("last > 0").isEmpty():
            return nodes.select(F.col("_by").alias(by), F.col("h").alias("digest"))


def durations(scans: DataFrame) -> DataFrame:
    """Scans with duration_minutes, to one place; null while not finished."""
    seconds = F.unix_timestamp("finished_at") - F.unix_timestamp("started_at")
    return scans.withColumn("duration_minutes", F.bround(F.greatest(seconds, F.lit(0)) / 60, 1))


def event_totals(events: DataFrame) -> DataFrame:
    """(scan_id, files, findings, errors) of a scan event log (scan_id, type, findings)."""
    return events.groupBy("scan_id").agg(
        F.count_if(F.col("type") == "file").alias("files"), F.coalesce(F.sum(F.when(F.col("type") == "file", F.col("findings"))), F.lit(0)).alias("findings"),
        F.count_if(F.col("type") == "error").alias("errors"),
    )


def throughput(runs: DataFrame) -> DataFrame:
    """Runs (files, bytes, seconds) with files and bytes a second; null for no time at all."""
    return runs.withColumn("files_per_s", F.try_divide("files", "seconds")).withColumn("bytes_per_s", F.try_divide("bytes", "seconds"))


def fix_plan(findings: DataFrame, recs: DataFrame, files: DataFrame) -> DataFrame:
    """Previews of fixes: findings (id, file, line, code) with secure_code of ``recs`` (finding_id) over ``files`` (file, text).

    A fix is ``refused`` where it touches over half of the file's lines, ``unlocated`` where the old code isn't
    found, else ``ready`` at the reported line if that holds the old code, or at the first line that does.
    """
    df = findings.join(recs.where("secure_code <> ''").select(F.col("finding_id").alias("id"), "secure_code"), "id").join(files, "file")
    lines, old = F.split("text", "\n"), F.trim("code")
    n_old, n_new = F.size(F.split("code", "\n")), F.size(F.split("secure_code", "\n"))
    at = F.when(F.coalesce(F.get(lines, F.col("line") - 1).contains(old), F.lit(False)), F.col("line")).otherwise(
        F.array_position(F.transform(lines, lambda x: x.contains(old)), F.lit(True)).cast("int")
    )
    status = F.when(F.greatest(n_old, n_new) / F.size(lines) > 0.5, "refused").when((at > 0) | F.col("text").contains(old), "ready").otherwise("unlocated")
    return df.select("id", "file", F.when(at > 0, at).alias("at_line"), "code", "secure_code", status.alias("status"))
