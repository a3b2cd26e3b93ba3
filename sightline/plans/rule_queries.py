"""Queries over rules: all built-in ones over lines of every language, rule files, and tables of user rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import detect
from ..operators.rules import RULES
from ..sources.rule_files import parse_rules
from .adapters import spread
from .adapters import view as v
from .registry import query
from .rule_lines import POSITIVE

#: Ends of file names by rule group.
ENDS = {
    "cpp": ".cpp", "csharp": ".cs", "css": ".css", "go": ".go", "html": ".html", "java": ".java", "js": ".js", "kotlin": ".kt", "php": ".php",
    "python": ".py", "ruby": ".rb", "rust": ".rs", "shell": ".sh", "sql": ".sql", "swift": ".swift",
}
#: What a rule looks for ahead, and what must therefore not come after the rest; DuckDB's patterns have no look-ahead. Nothing where it changes nothing.
AHEAD = {
    "S-SQLI-1": (r"(?!\s*#)", ""),
    "S-DESER-2": ("(?!Loader)", ""),
    "C-BUF-1": ("(?!.*strncpy|.*snprintf|.*memcpy_s|.*strcpy_s)", ".*(?:strncpy|snprintf|memcpy_s|strcpy_s)"),
    "W-CSRF-2": (r"\s*(?!.*csrf|.*token|.*nonce)", ".*(?:csrf|token|nonce)"),
    "W-HTML-FORM-1": (r"(?:(?!action\s*=)[^>])*>", r"[^>]*action\s*="),
    "W-HTML-AUTO-1": ("[^>]*(?!.*autocomplete)", "[^>]*>.*autocomplete"),
    "G-CLEAR-1": (r"(?!localhost|127\.0\.0\.1)", r"(?:localhost|127\.0\.0\.1)"),
    "R-DESER-1": ("(?!.*safe)", ".*safe"),
    "S-JSINJ-1": (r"\s*(?!.*static)", ".*static"),
}
#: Lines that such rules must not fit.
NEGATIVE = {
    "cpp": ["char b[10]; strncpy(b)"],
    "php": ["<form method=POST> csrf"],
    "html": ["<form action=x>", "<input type='password'> autocomplete"],
    "go": ["x http://localhost # c"],
    "ruby": ["YAML.load(x) safe"],
    "swift": ["evaluateJavaScript( static"],
}


def _lines() -> list[tuple[str, int, str]]:
    """Group, number and text: for each group the lines of its rules, those that they must not fit, comments and prose."""
    own = {g: [*xs, *NEGATIVE.get(g, []), "# eval(x)", "// system(x)", "x = 1 # exec(y)", "", "plain words"] for g, xs in POSITIVE.items()}
    return [(g, k, x) for g, xs in own.items() for k, x in enumerate(xs, 1)]


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _sql() -> str:
    rows = ", ".join(f"('{g}', {k}, {_quoted(x)})" for g, k, x in _lines())
    hits = []
    for r in RULES:
        look, after = AHEAD.get(r.rule_id, ("", "")) if "(?!" in r.pattern else ("", "")
        base = r.pattern.replace(look, "") if look else r.pattern
        whole = base + ("[^>]*>" if r.rule_id == "W-HTML-FORM-1" else "")
        flag = ", 'i'" if "i" in r.flags else ""
        found = f"regexp_matches(code, {_quoted(whole)}{flag})" + (f" AND NOT regexp_matches(code, {_quoted(base + after)}{flag})" if after else "")
        hits.append(f"SELECT file_id, line_no, grp, '{r.rule_id}' AS rule_id, {r.score} AS severity_score FROM c WHERE grp = '{r.group}' AND {found}")
    return rf"""WITH t AS (SELECT * FROM (VALUES {rows}) AS t(grp, k, line)), g AS (SELECT list(DISTINCT grp ORDER BY grp) AS gs FROM t),
l AS (SELECT c_custkey AS file_id, t.grp, CAST(k AS INT) AS line_no, CASE (c_custkey + k) % 4 WHEN 1 THEN reverse(line) WHEN 2 THEN upper(line) ELSE line END AS line FROM customer, g, t WHERE t.grp = gs[1 + c_custkey % len(gs)]),
c AS (SELECT *, CASE WHEN grp IN ('java', 'cpp', 'php', 'js', 'html', 'css') THEN line
  WHEN grp = 'python' THEN CASE WHEN NOT regexp_matches(trim(line), '^(#|[rf]?"{{3}}|[rf]?''{{3}})') AND NOT (regexp_matches(lower(line), 'test|example|demo|mock|fake|dummy|placeholder')
    AND regexp_matches(lower(line), '\b(password|passwd|secret|api[_-]?key|token)\s*=')) THEN split_part(line, '#', 1) END
  WHEN trim(line) = '' OR starts_with(trim(line), '#') OR starts_with(trim(line), '//') THEN NULL
  WHEN grp IN ('go', 'ruby', 'shell') AND contains(line, '#') THEN split_part(line, '#', 1)
  WHEN grp IN ('go', 'rust', 'csharp', 'kotlin', 'swift') AND contains(line, '//') THEN split_part(line, '//', 1) ELSE trim(line) END AS code FROM l)
SELECT file_id, line_no, grp, rule_id, severity_score FROM ({" UNION ALL ".join(hits)}) x"""


@query("p1_all_rules", _sql())
def p1_all_rules(spark, d):
    """A file of one of the languages for each customer: lines for all its rules, as they are, reversed or in capitals."""
    key, text, end = F.col("c_custkey"), F.lit(None).cast("string"), F.lit(None).cast("string")
    for at, group in enumerate(sorted(ENDS)):
        own = [(k, F.lit(x)) for g, k, x in _lines() if g == group]
        spelled = [F.when((key + k) % 4 == 1, F.reverse(x)).when((key + k) % 4 == 2, F.upper(x)).otherwise(x) for k, x in own]
        text = F.when(key % len(ENDS) == at, F.concat_ws("\n", *spelled)).otherwise(text)
        end = F.when(key % len(ENDS) == at, ENDS[group]).otherwise(end)
    customers = spread(spark.read.parquet(f"{d}/customer.parquet").select("c_custkey"))
    files = customers.select(key.alias("file_id"), F.concat(F.lit("f"), end).alias("path"), text.alias("text"))
    return detect.heuristics(files).select("file_id", "line_no", F.col("group").alias("grp"), "rule_id", "severity_score")


@query("s11_rule_files", r"""SELECT concat('U-', c_custkey) AS id, concat('Names ', c_mktsegment) AS title, concat(c_mktsegment, '\d+') AS pattern, 'High' AS severity, CAST(c_custkey % 10 AS INT) AS score, 2 AS n_extensions
FROM customer WHERE c_custkey % 5 = 0 UNION ALL SELECT concat('W-', c_custkey), NULL, 'x.y', NULL, NULL, NULL FROM customer WHERE c_custkey % 5 = 4""")
def s11(spark, d):
    """A rule file for each customer; three of five hold no rule."""
    key, segment = F.col("c_custkey").cast("string"), F.col("c_mktsegment")
    whole = F.concat(
        F.lit("id: U-"), key, F.lit("\ntitle: Names "), segment, F.lit("\npattern: '"), segment, F.lit("\\d+'\nseverity: High\nscore: "), (F.col("c_custkey") % 10).cast("string"), F.lit("\nextensions: [.py, .js]\n")
    )
    kinds = (whole, F.concat(F.lit("id: V-"), key, F.lit("\ntitle: no pattern")), F.lit("id: ["), F.concat(F.lit("- "), F.col("c_name")), F.concat(F.lit("id: W-"), key, F.lit("\npattern: x.y")))
    customers = spread(spark.read.parquet(f"{d}/customer.parquet").select("c_custkey", "c_mktsegment", "c_name"))
    files = customers.select(key.alias("file"), F.element_at(F.array(*kinds), (F.col("c_custkey") % 5 + 1).cast("int")).alias("content"))
    return parse_rules(files).select("id", "title", "pattern", "severity", "score", F.when(F.col("extensions").isNotNull(), F.size("extensions")).alias("n_extensions"))


_NONE = {"title": "string", "severity": "string", "cwe": "string", "owasp": "string", "extensions": "array<string>"}


def _rules(df, *names):
    """A table of rules, with nulls for what it lacks."""
    return df.select(*names, *[F.lit(None).cast(t).alias(c) for c, t in _NONE.items() if c not in df.columns])


def _code_files(spark, d):
    return v(spark, d, "code").select("file_id", F.concat(F.lit("f"), F.col("file_id"), F.lit(".py")).alias("path"), F.col("line").alias("text"))


@query("j7_rule_table", r"""SELECT file_id, concat('C-', c_custkey) AS rule_id, concat('Names ', c_mktsegment) AS title, 'Medium' AS severity, CAST(c_custkey % 7 AS INT) AS severity_score
FROM @code JOIN customer ON contains(line, concat('"', c_name, '"')) OR contains(line, concat('"test', c_name, '"')) UNION ALL SELECT file_id, 'ANY', 'Digits', 'Low', 1 FROM @code WHERE regexp_matches(line, '[0-9]{9}')
UNION ALL SELECT file_id, 'SLOW', 'Slow', 'Low', 1 FROM @code WHERE contains(line, 'shell=')""")
def j7_rule_table(spark, d):
    """A rule for each customer, one without literals and one whose search is watched, met through their literals."""
    c = spark.read.parquet(f"{d}/customer.parquet")
    names = ("id", "title", "pattern", "severity", "score")
    own = c.select(F.concat(F.lit("C-"), "c_custkey").alias("id"), F.concat(F.lit("Names "), "c_mktsegment").alias("title"), F.concat(F.lit('"(?:test)?'), "c_name", F.lit('"')).alias("pattern"), (F.col("c_custkey") % 7).cast("int").alias("score"))
    more = spark.createDataFrame([("ANY", "Digits", "[0-9]{9}", "Low", 1), ("SLOW", "Slow", r"(\w+\W?)*shell=", "Low", 1)], "id string, title string, pattern string, severity string, score int")
    rules = _rules(own, "id", "title", "pattern", "score").unionByName(_rules(more, *names))
    return detect.custom_table(_code_files(spark, d), rules).select("file_id", "rule_id", "title", "severity", "severity_score")


@query("f1_table_rules", "SELECT file_id, concat('M-', m) AS rule_id, concat('Names ', m) AS title, 'Low' AS severity, 2 AS severity_score FROM @code JOIN (SELECT DISTINCT c_mktsegment AS m FROM customer) s ON contains(line, m)")
def f1(spark, d):
    m = F.col("c_mktsegment")
    own = spark.read.parquet(f"{d}/customer.parquet").select(m).distinct()
    own = own.select(F.concat(F.lit("M-"), m).alias("id"), F.concat(F.lit("Names "), m).alias("title"), m.alias("pattern"), F.lit("Low").alias("severity"), F.lit(2).alias("score"))
    return detect.custom_table(_code_files(spark, d), _rules(own, "id", "title", "pattern", "severity", "score")).select("file_id", "rule_id", "title", "severity", "severity_score")
