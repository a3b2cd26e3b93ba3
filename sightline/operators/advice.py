"""The data side of recommendation texts: prompts, answers, choice among tiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ANSWER = "explanation string, impact string, attack_scenario string, root_cause string, recommended_fix string, secure_code string, owasp string, cwe string"


def prompts(findings: DataFrame) -> DataFrame:
    """Findings with the text that asks for advice; code is cut at 1,500 characters."""
    text = F.format_string("Finding: %s\nFile: %s (line %d)\nSeverity: %s CWE: %s", "title", "file", "line", "severity", "cwe")
    if "code" in findings.columns:
        text = F.concat(text, F.lit("\nCode:\n"), F.substring(F.coalesce("code", F.lit("")), 1, 1500))
    return findings.withColumn("prompt", text)


def json_part(text: Column) -> Column:
    """The JSON object of an answer: bare, in a fence, or between the first and the last brace; else null."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(text), r"^\s*```(?:json)?\s*", ""), r"\s*```\s*$", "")
    inner = F.regexp_extract(text, r"(?s)(\{.*\})", 1)
    return F.when(bare.startswith("{"), bare).when(inner != "", inner)


def parse_responses(answers: DataFrame, column: str = "response") -> DataFrame:
    """Answers with the eight columns of ``ANSWER``; all null where no object can be read."""
    return answers.withColumn("_a", F.from_json(json_part(F.col(column)), ANSWER)).select("*", "_a.*").drop("_a")


def first_success(*candidates: Column, names: tuple[str, str] = ("value", "tier")) -> list[Column]:
    """The first candidate that is not null, and its number."""
    tier = F.lit(None).cast("int")
    for k, c in reversed(list(enumerate(candidates))):
        tier = F.when(c.isNotNull(), k).otherwise(tier)
    return [F.coalesce(*candidates).alias(names[0]), tier.alias(names[1])]
