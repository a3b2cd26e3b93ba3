"""User rules: one YAML mapping per file, and a table of rules that grows by appending."""

from __future__ import annotations

import json
import logging
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.detect import MAX_PATTERN

SCHEMA = "id string, title string, pattern string, severity string, score int, cwe string, owasp string, extensions array<string>"
_ARROW = pa.schema([(c, pa.string()) for c in ("id", "title", "pattern", "severity")] + [("score", pa.int32()), ("cwe", pa.string()), ("owasp", pa.string()), ("extensions", pa.list_(pa.string()))])
#: What libyaml, which is faster, reads in another way than PyYAML's own loader: tabs, tags, directives, marks in flow keys, comments at block signs.
_OWN_READING = re.compile("[\t!%?\ufeff]|[|>][-+0-9]*#|\\\\[uUx]")
_LOG = logging.getLogger(__name__)


def parse_rules(files: DataFrame) -> DataFrame:
    """Rules (``SCHEMA``) of files (file, content) that hold one YAML mapping each.

    Files that hold no mapping with an id and a pattern are skipped and logged by the task; ``score`` is null where it is no number.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import yaml

        text = lambda x: None if x is None else str(x)
        fast = getattr(yaml, "CSafeLoader", yaml.SafeLoader)
        for b in batches:
            rows = []
            for file, content in zip(b["file"].to_pylist(), b["content"].to_pylist(), strict=True):
                try:
                    rule = yaml.load(content or "", Loader=yaml.SafeLoader if _OWN_READING.search(content or "") else fast)
                except yaml.YAMLError as e:
                    _LOG.warning("%s: %s", file, e)
                    continue
                if not isinstance(rule, dict) or not rule.get("id") or not rule.get("pattern"):
                    _LOG.warning("%s holds no rule", file)
                    continue
                ends, score = rule.get("extensions"), rule.get("score")
                own = {c: text(rule.get(c)) for c in ("id", "title", "pattern", "severity", "cwe", "owasp")}
                ends = [str(e) for e in ends] if isinstance(ends, list) else [str(ends)] if ends else None
                rows.append(own | {"score": int(score) if isinstance(score, (int, float)) or str(score).isdigit() else None, "extensions": ends})
            yield pa.RecordBatch.from_pylist(rows, _ARROW)

    return files.select("file", "content").mapInArrow(run, SCHEMA)


def load_rules(spark: SparkSession, path: str) -> DataFrame:
    """Rules of the ``*.yaml`` files under ``path``, read and parsed by tasks."""
    files = spark.read.text(path, wholetext=True, pathGlobFilter="*.yaml", recursiveFileLookup=True)
    return parse_rules(files.select(F.input_file_name().alias("file"), F.col("value").alias("content")))


def checked(spark: SparkSession, rule: dict) -> dict:
    """The rule, if Spark can run its pattern; else an error."""
    pattern = rule.get("pattern") or ""
    if not 0 < len(pattern) <= MAX_PATTERN:
        raise ValueError(f"a pattern has 1 to {MAX_PATTERN} characters")
    try:
        spark._jvm.java.util.regex.Pattern.compile("(?Ud)" + pattern)
    except Exception as e:  # the JVM's PatternSyntaxException
        raise ValueError(f"not a pattern: {pattern!r}") from e
    return rule


def add_rule(spark: SparkSession, path: str, id: str, title: str, pattern: str, severity: str = "Medium", **more: object) -> None:
    """Appends a rule to the table at ``path``."""
    rule = checked(spark, {"id": id, "title": title, "pattern": pattern, "severity": severity, **more})
    row = spark.range(1).select(F.from_json(F.lit(json.dumps(rule)), SCHEMA).alias("r")).select("r.*")
    row.write.mode("append").parquet(path)


def table_rules(rules: DataFrame) -> list[dict]:
    """Rules of a small table as :func:`sightline.operators.detect.custom` takes them, which puts them into the plan.

    Tables of any size go to :func:`sightline.operators.detect.custom_table` as they are.
    """
    return [{k: v for k, v in r.asDict().items() if v is not None} for r in rules.orderBy("id").collect()]
