"""One scan over source files: all detectors, duplicates, order, cap and score, for many scans at once."""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import cwe_owasp, score_severity, strip
from ..schemas import MAX_FILE_BYTES
from .detect import DEFAULTS, TIME_LIMIT, WORDING, LineIndex, by_group, code_files, code_of, is_risky, name_end, numbered, rule_words, timed_search, valid_rules
from .findings import cap, keep_first
from .literals import fold, growth
from .report import scores
from .rules import SCANNERS, Rule, java_pattern
from .taint import FOUND, FOUND_ARROW, flow_findings, flow_language, may_flow

COLUMNS = ("scan_id", "file", "line", "code", "scanner", "rule_id", "title", "severity", "severity_score", "cwe", "owasp", "description")
#: Findings of a scan that are kept.
MOST = 500


_ROW = "_rank int, _ks array<int>, _sure boolean, line string, " + FOUND
_ROW_ARROW = [pa.field("_rank", pa.int32()), pa.field("_ks", pa.list_(pa.int32())), pa.field("_sure", pa.bool_()), pa.field("line", pa.string()), *FOUND_ARROW]
_RULE = "array<struct<ord:int,rule_id:string,title:string,severity:string,severity_score:int,cwe:string,owasp:string,scanner:string,wording:string,pattern:string,extensions:array<string>>>"
#: Order of detectors.
BUILT_IN, PYTHON_FLOWS, USER_RULES, FLOWS, TOOLS = range(5)


def _hits(src: DataFrame, own: dict[str, list[Rule]], user: list[dict]) -> DataFrame:
    """Rows of files (scan_id, path, group, text): lines that may fit rules (numbers ``_ks``), and finished findings of flows.

    Each text is read once, for everything. Searches that could take long are done here, so that rows pass through Python once; ``_sure``:
    such a search found the rules' patterns.
    """
    n = sum(map(len, own.values()))
    patterns = numbered(own)
    words, always = rule_words({g: [*patterns.get(g, []), *[(n + j, r["pattern"]) for j, r in enumerate(user, 1)]] for g in SCANNERS})
    keys = ["scan_id", "path", "group"]
    slow = {n + j: (r["pattern"], growth(r["pattern"]), r.get("extensions") or ()) for j, r in enumerate(user, 1) if growth(r["pattern"]) > 1}
    end = name_end(F.col("path")) if any(ends for *_, ends in slow.values()) else F.lit("")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, search, empty = LineIndex(words, always), timed_search(TIME_LIMIT), (None,) * len(FOUND_ARROW)
        for b in batches:
            found = []
            for at, (group, lang, small, suffix, text) in enumerate(zip(*[b[c].to_pylist() for c in ("group", "_lang", "_small", "_end", "text")], strict=True)):
                if not text:
                    continue
                low = fold(text)
                for no, line, ks in index.lines(group, text, low):
                    mine = [k for k in ks if k <= n] if small else []
                    if mine:
                        found.append((at, BUILT_IN, mine, False, line, no, *empty[1:]))
                    mine = [k for k in ks if k > n]
                    long = [k for k in mine if k in slow and is_risky(line, slow[k][1])]
                    sure = [k for k in long if (not slow[k][2] or suffix in slow[k][2]) and search(slow[k][0], line)]
                    for its, known in (([k for k in mine if k not in long], False), (sure, True)):
                        if its:
                            found.append((at, USER_RULES, its, known, line, no, *empty[1:]))
                for rank, kind in ((PYTHON_FLOWS, "python-rules" if lang == "python" else None), (FLOWS, lang)):
                    if kind and may_flow(low, kind):
                        found += [(at, rank, None, None, None, *row) for row in flow_findings(text, kind)]
            kept = b.select(keys).take(pa.array([f[0] for f in found], pa.int32()))
            cols = [pa.array([f[k] for f in found], field.type) for k, field in enumerate(_ROW_ARROW, 1)]
            yield pa.RecordBatch.from_arrays([*kept.columns, *cols], [*keys, *[f.name for f in _ROW_ARROW]])

    kinds = ", ".join(f"`{c}` {src.schema[c].dataType.simpleString()}" for c in keys)
    small = F.octet_length("text") <= MAX_FILE_BYTES
    return src.select(*keys, flow_language(F.col("path")).alias("_lang"), small.alias("_small"), end.alias("_end"), "text").mapInArrow(run, f"{kinds}, {_ROW}")


def detect_all(
    files: DataFrame, user_rules: Sequence[dict] = (), tools: DataFrame | None = None, rules: list[Rule] | None = None
) -> DataFrame:
    """Findings of all detectors, each once, over files (scan_id, path, text): ``COLUMNS``, detector_rank, ordinal.

    Detectors in order: built-in rules, Python flows, user rules, flows of all languages, ``tools`` (findings of other
    tools, with as many of the columns as they have). Of findings with the same scan, file, line and rule the first stays.
    Null texts have no findings. Texts are read once: one pass finds flows and the lines that hold a rule's literals, and only
    those lines meet patterns.
    """
    own, user = by_group(rules), valid_rules(files.sparkSession, user_rules)
    table = [
        {"ord": k, "rule_id": r.rule_id, "title": r.title, "severity_score": r.score, "cwe": r.cwe, "scanner": SCANNERS[g], "wording": WORDING.get(g, " (line "), "pattern": java_pattern(r)}
        for g, its in own.items()
        for k, r in enumerate(its)
    ]
    for k, r in enumerate(user):
        facts = {n: r.get("score" if n == "severity_score" else n) or d for n, d in DEFAULTS.items()}
        facts["severity_score"] = 5 if r.get("score") is None else int(r["score"])
        table.append({"ord": k, "rule_id": r["id"], **facts, "scanner": "custom-rules", "pattern": r["pattern"], "extensions": r.get("extensions") or None})
    src = code_files(files.select("scan_id", "path", "text")).select("scan_id", "path", "group", "text")
    rows = _hits(src, own, user).withColumn("_k", F.explode_outer("_ks")).withColumn("_rule", F.element_at(F.from_json(F.lit(json.dumps(table)), _RULE), F.col("_k")))
    # flows are finished; a built-in rule sees the visible part of a line, a user rule the line
    built_in, by_user, rule = F.col("_rank") == BUILT_IN, F.col("_rank") == USER_RULES, F.col("_rule")
    rows = rows.withColumn("_code", F.when(built_in, code_of(own)).when(by_user, F.col("line")))
    right_name = F.coalesce(F.array_contains(rule["extensions"], name_end(F.col("path"))), F.lit(True))
    pattern = F.when(by_user, F.concat(F.lit("(?Ud)"), rule["pattern"])).otherwise(rule["pattern"])
    rows = rows.where(F.col("_k").isNull() | F.col("_sure") | (right_name & F.regexp_like("_code", pattern)))

    def shown(name: str) -> Column:
        return F.coalesce(rule[name], F.col(name))

    end = F.when(rule["wording"] == " (line ", ").").otherwise(".")
    said = F.when(built_in, F.concat(rule["title"], rule["wording"], F.col("line_no").cast("string"), end))
    severity = F.when(built_in, score_severity(rule["severity_score"]))
    found = rows.select(
        "scan_id", F.col("path").alias("file"), F.col("line_no").alias("line"), F.coalesce("code", F.substring(strip(F.col("line")), 1, 300)).alias("code"),
        shown("scanner").alias("scanner"), shown("rule_id").alias("rule_id"), shown("title").alias("title"), F.coalesce(severity, shown("severity")).alias("severity"),
        shown("severity_score").alias("severity_score"), shown("cwe").alias("cwe"), F.coalesce(F.when(built_in, cwe_owasp(rule["cwe"])), shown("owasp")).alias("owasp"),
        F.coalesce(said, "description", F.lit("")).alias("description"), F.col("_rank").alias("detector_rank"), F.coalesce(rule["ord"], "source_line").alias("ordinal"),
    )
    if tools is not None:
        named = tools.select(*[c for c in COLUMNS if c in tools.columns]).withColumn("detector_rank", F.lit(TOOLS)).withColumn("ordinal", F.lit(0))
        found = found.unionByName(named, allowMissingColumns=True)
    first = [F.col("detector_rank"), F.col("ordinal"), F.col("title"), F.col("code")]
    return keep_first(found, ["scan_id", "file", "line", "rule_id"], first)


def scan(
    files: DataFrame,
    user_rules: Sequence[dict] = (),
    tools: DataFrame | None = None,
    most: int = MOST,
    rules: list[Rule] | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Findings of each scan, the first ``most`` by score (with their ``position``), and one row per scan with its score.

    The score counts the findings that are kept, and all files of a known language outside skipped directories.
    """
    found = detect_all(files, user_rules, tools, rules)
    order = [F.col("severity_score").desc(), F.col("detector_rank"), F.col("file"), F.col("line"), F.col("ordinal"), F.col("rule_id")]
    found = cap(found, "scan_id", order, most)
    counts = code_files(files).groupBy("scan_id").agg(F.count("*").alias("files"))
    return found, scores(found, counts)
