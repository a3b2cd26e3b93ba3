"""Queries over code, paths, tool outputs and request logs derived from the given tables."""

from __future__ import annotations

import io
import zipfile

import pandas as pd
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions import redact
from ..operators import detect, taint
from ..operators.findings import rule_based_advice
from ..operators.rules import RULES, rules_named
from ..operators.scan import scan
from ..schemas import LANGUAGES, MAX_FILE_BYTES, SKIP_DIRS, WEB_GROUPS
from ..sources import files as S
from ..sources import ingest as I
from ..sources.sinks import scratch_path
from ..streaming import throttle
from .adapters import view as v
from .registry import query

_SUFFIX = r"lower(regexp_extract(string_split(path, '/')[-1], '^.*[^.].*?(\.[^.]+)$', 1))"
_LANG = "CASE " + " ".join(f"WHEN {_SUFFIX} IN ({', '.join(repr(s) for s in n)}) THEN '{k}'" for k, n in LANGUAGES.items()) + " END"
_GROUP = "CASE " + " ".join(f"WHEN {_SUFFIX} IN ({', '.join(repr(s) for s in n)}) THEN '{k}'" for k, n in WEB_GROUPS.items()) + f" ELSE {_LANG} END"
_SKIP = f"list_has_any(string_split(lower(path), '/')[1:-2], [{', '.join(repr(s) for s in SKIP_DIRS)}])"
_SEV = "CASE WHEN severity_score >= 9 THEN 'Critical' WHEN severity_score >= 7 THEN 'High' WHEN severity_score >= 4 THEN 'Medium' ELSE 'Low' END"


@query("s1_collect_files", f'SELECT file_id, path, length, {_GROUP} AS "group" FROM @paths WHERE NOT {_SKIP} AND {_LANG} IS NOT NULL')
def s1(spark, d):
    return detect.code_files(v(spark, d, "paths")).select("file_id", "path", "length", "group")


@query("s2_detect_language", f"SELECT file_id, {_LANG} AS language FROM @paths")
def s2(spark, d):
    return v(spark, d, "paths").select("file_id", C.language(F.col("path")).alias("language"))


@query("s3_skip_dirs", f"SELECT file_id, {_SKIP} AS skipped FROM @paths")
def s3(spark, d):
    return v(spark, d, "paths").select("file_id", C.skipped(F.col("path")).alias("skipped"))


@query("s4_size_guard", f"SELECT file_id, length <= {MAX_FILE_BYTES} AS heuristics FROM @paths WHERE {_LANG} IS NOT NULL")
def s4(spark, d):
    return v(spark, d, "paths").where(C.language(F.col("path")).isNotNull()).select("file_id", (F.col("length") <= MAX_FILE_BYTES).alias("heuristics"))


@query("s5_list_safe_files", f"SELECT file_id, path FROM @paths WHERE NOT {_SKIP} AND len(string_split(path, '/')) <= 11")
def s5(spark, d):
    return S.listed(v(spark, d, "paths")).select("file_id", "path")


_SAFE = ", ".join(repr(s) for s in S.SAFE_SUFFIXES)


@query("s6_validate_filename", f"""SELECT file_id, CASE WHEN trim(path) = '' THEN 'empty name' WHEN contains(path, '..') OR contains(path, '/') THEN 'path traversal' WHEN length(path) > 255 THEN 'name too long'
WHEN {_SUFFIX} <> '' AND {_SUFFIX} NOT IN ({_SAFE}) THEN 'type not allowed' END AS reason FROM @paths""")
def s6(spark, d):
    return v(spark, d, "paths").select("file_id", S.filename_reason(F.col("path")).alias("reason"))


@query("s7_content_reason", """SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 'empty' WHEN strlen(text) + 4 > 4000 THEN 'too large' WHEN doc_id % 5 IN (1, 2) THEN 'executable' END AS reason FROM documents""")
def s7(spark, d):
    t = spark.read.parquet(f"{d}/documents.parquet")
    head = F.when(F.col("doc_id") % 5 == 1, F.unhex(F.lit("7F454C46"))).when(F.col("doc_id") % 5 == 2, F.unhex(F.lit("4D5A0000"))).otherwise(F.lit("text").cast("binary"))
    content = F.when(F.col("doc_id") % 7 == 0, F.lit("").cast("binary")).otherwise(F.concat(head, F.col("text").cast("binary")))
    return t.select("doc_id", S.content_reason(content, 4000).alias("reason"))


@query("s8_is_executable", "SELECT doc_id, doc_id % 6 IN (1, 2, 3) AS executable FROM documents")
def s8(spark, d):
    t = spark.read.parquet(f"{d}/documents.parquet")
    heads = {1: "7F454C46", 2: "4D5A0000", 3: "FEEDFACF", 4: "504B0304"}
    head = F.unhex(C.choose((F.col("doc_id") % 6).cast("int"), heads, "00000000"))
    return t.select("doc_id", S.is_executable(F.concat(head, F.col("text").cast("binary"))).alias("executable"))


def _archives(spark, d):
    """An archive of each document: dense for every seventh, with a member outside it for every fifth."""

    def build(batches):
        for b in batches:
            out = []
            for k, text in zip(b["doc_id"], b["text"], strict=True):
                data = io.BytesIO()
                with zipfile.ZipFile(data, "w") as z:
                    if k % 7 == 0:
                        z.writestr("doc.txt", "0" * 1_000_000, zipfile.ZIP_DEFLATED)
                    else:
                        z.writestr("doc.txt", text)
                    if k % 5 == 0:
                        z.writestr("../out.txt", "x")
                out.append((str(k), data.getvalue()))
            yield pd.DataFrame(out, columns=["path", "content"])

    return spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").mapInPandas(build, "path string, content binary")


@query("s7_upload_reasons", """SELECT doc_id, CASE WHEN doc_id % 11 = 0 THEN 'empty' WHEN doc_id % 4 = 1 THEN 'blocked type application/x-dvi' WHEN doc_id % 4 = 2 THEN 'blocked type application/x-msdownload'
WHEN doc_id % 7 = 0 THEN 'zip bomb' END AS reason FROM documents""")
def s7_upload_reasons(spark, d):
    """Archives of documents under names of several types; the first reason counts."""
    k = F.col("path").cast("bigint")
    name = F.concat("path", F.when(k % 4 == 1, ".DVI.gz").when(k % 4 == 2, ".exe").otherwise(".zip"))
    content = F.when(k % 11 == 0, F.lit("").cast("binary")).otherwise(F.col("content"))
    return _archives(spark, d).select(k.alias("doc_id"), S.upload_reason(name, content).alias("reason"))


@query("s9_zip_bombs", "SELECT doc_id, doc_id % 7 = 0 AS is_bomb FROM documents")
def s9(spark, d):
    return S.zip_bombs(_archives(spark, d)).select(F.col("path").cast("bigint").alias("doc_id"), "is_bomb")


@query("s10_archive_members", """SELECT doc_id, 'doc.txt' AS member, 'ok' AS flag, CASE WHEN doc_id % 7 = 0 THEN NULL ELSE strlen(text) END AS n FROM documents
UNION ALL SELECT doc_id, '../out.txt', 'traversal', NULL FROM documents WHERE doc_id % 5 = 0""")
def s10(spark, d):
    return S.zip_members(_archives(spark, d)).select(F.col("path").cast("bigint").alias("doc_id"), "member", "flag", F.octet_length("data").alias("n"))


# ---- tool outputs: made by Spark from the orders, then parsed


def _outputs(spark, d, item, wrap):
    """(scan_id, content): the items of a scan joined into one tool output; ``wrap`` makes it of the array."""
    rows = v(spark, d, "issues").select("scan_id", item.alias("x"))
    return rows.groupBy("scan_id").agg(F.collect_list("x").alias("xs")).select("scan_id", wrap(F.col("xs")).alias("content"))


def _json(key):
    return lambda xs: F.to_json(F.struct(xs.alias(key)))


def _score(table: str) -> str:
    return {
        "bandit": "CASE sev WHEN 'low' THEN 3 WHEN 'medium' THEN 6 WHEN 'high' THEN 8 ELSE 5 END",
        "audit": "CASE sev WHEN 'high' THEN 8 WHEN 'medium' THEN 6 WHEN 'low' THEN 3 ELSE 5 END",
        "semgrep": "CASE sev WHEN 'low' THEN 3 WHEN 'medium' THEN 6 WHEN 'high' THEN 10 ELSE 5 END",
        "spotbugs": "CASE sev WHEN 'low' THEN 4 WHEN 'medium' THEN 7 WHEN 'high' THEN 9 ELSE 4 END",
    }[table]


def _sql(score: str, **cols: str) -> str:
    return f"SELECT scan_id, severity_score, {_SEV} AS severity, {', '.join(cols)} FROM (SELECT scan_id, {score} AS severity_score, {', '.join(f'{e} AS {c}' for c, e in cols.items())} FROM @issues) x"


def _pick(df, *cols):
    return df.select("scan_id", "severity_score", "severity", *cols)


_BASE = dict(file="file", line="line", rule_id="rule", description="msg")


@query("s12_bandit", _sql(_score("bandit"), **_BASE, title="'Bandit issue'", cwe="'CWE-20'"))
def s12(spark, d):
    item = F.struct(F.col("file").alias("filename"), F.col("line").alias("line_number"), F.col("rule").alias("test_id"), F.upper("sev").alias("issue_severity"), F.col("msg").alias("issue_text"))
    return _pick(I.parse(_outputs(spark, d, item, _json("results")), "bandit"), *_BASE, "title", "cwe")


@query("s13_semgrep", _sql(_score("semgrep"), **_BASE, title="substr(msg, 1, 200)"))
def s13(spark, d):
    label = C.choose(F.col("sev"), {"low": "INFO", "medium": "WARNING", "high": "ERROR"}, "OTHER")
    item = F.struct(F.col("file").alias("path"), F.struct("line").alias("start"), F.col("rule").alias("check_id"), F.struct(label.alias("severity"), F.col("msg").alias("message")).alias("extra"))
    return _pick(I.parse(_outputs(spark, d, item, _json("results")), "semgrep"), *_BASE, "title")


def _tag(name, value):
    return F.concat(F.lit(f"<{name}>"), value.cast("string"), F.lit(f"</{name}>"))


@query("s14_spotbugs", _sql(_score("spotbugs"), file="'a/b/C.java'", line="line", rule_id="rule", description="msg", title="concat('short ', rule)", cwe="CASE WHEN id % 2 = 0 THEN 'CWE-89' ELSE 'CWE-20' END"))
def s14(spark, d):
    p = C.choose(F.col("sev"), {"high": "1", "medium": "2", "low": "3"}, "4")
    cwe = F.when(F.col("id") % 2 == 0, ' cweid="89"').otherwise("")
    item = F.concat(F.lit('<BugInstance type="'), F.col("rule"), F.lit('" priority="'), p, F.lit('" shortMessage="short '), F.col("rule"), F.lit('"'), cwe, F.lit(">"), _tag("LongMessage", F.col("msg")),
                    F.lit("<Class><classname>a.b.C</classname></Class><SourceLine>"), _tag("start", F.col("line")), F.lit("</SourceLine></BugInstance>"))
    out = _outputs(spark, d, item, lambda xs: F.concat(F.lit("<BugCollection>"), F.array_join(xs, ""), F.lit("</BugCollection>")))
    return _pick(I.parse(out, "spotbugs"), "file", "line", "rule_id", "description", "title", "cwe")


def _joined(xs):
    return F.array_join(xs, "\n")


@query("s15_pmd", _sql("6", file="'Foo.java'", line="line", rule_id="CASE WHEN rule = 'R3' THEN 'J-CRYPTO-5' ELSE concat('PMD-', rule) END", description="msg", cwe="CASE WHEN rule = 'R3' THEN 'CWE-327' ELSE 'CWE-20' END"))
def s15(spark, d):
    rule = F.when(F.col("rule") == "R3", "InsecureCrypto").otherwise(F.col("rule"))
    item = F.concat(F.lit("src/main/Foo.java:"), F.col("line"), F.lit(":\t"), rule, F.lit(":\t"), F.col("msg"))
    return _pick(I.parse(_outputs(spark, d, item, _joined), "pmd"), "file", "line", "rule_id", "description", "cwe")


@query("s16_clang", _sql("7", file="'x.c'", line="line", rule_id="CASE WHEN rule = 'R1' THEN 'unix.Malloc' ELSE rule END", title="CASE WHEN rule = 'R1' THEN 'Memory leak / UAF' ELSE 'Clang analyzer finding' END", cwe="CASE WHEN rule = 'R1' THEN 'CWE-416' ELSE 'CWE-20' END", description="msg"))
def s16(spark, d):
    rule = F.when(F.col("rule") == "R1", "unix.Malloc").otherwise(F.col("rule"))
    item = F.concat(F.lit("src/x.c:"), F.col("line"), F.lit(":7: warning: "), F.col("msg"), F.lit(" ["), rule, F.lit("]"))
    return _pick(I.parse(_outputs(spark, d, item, _joined), "clang"), "file", "line", "rule_id", "title", "cwe", "description")


@query("s17_pip_audit", _sql(_score("audit"), rule_id="concat('PIP-', rule)", code="concat('p', line, ' 1.', line)", title="concat('Vulnerable Python package: p', line)", cwe="CASE WHEN id % 2 = 0 THEN 'CWE-79' ELSE 'CVE-1' END", description="CASE WHEN id % 2 = 0 THEN 'see CWE-79' ELSE msg END"))
def s17(spark, d):
    item = F.struct(F.col("rule").alias("id"), F.lit("CVE-1").alias("cve"), F.concat(F.lit("p"), F.col("line")).alias("package_name"), F.concat(F.lit("1."), F.col("line")).alias("current_version"),
                    F.col("sev").alias("vulnerability_type"), F.when(F.col("id") % 2 == 0, "see CWE-79").otherwise(F.col("msg")).alias("description"))
    return _pick(I.parse(_outputs(spark, d, item, _json("vulnerabilities")), "pip-audit"), "rule_id", "code", "title", "cwe", "description")


@query("s18_npm_audit", f"SELECT scan_id, severity_score, {_SEV} AS severity, rule_id, code, description FROM (SELECT scan_id, {_score('audit')} AS severity_score, concat('NPM-p', id) AS rule_id, concat('p', id, ' unknown') AS code, msg AS description FROM @issues WHERE id % 3 <> 0) x")
def s18(spark, d):
    value = F.struct(F.when(F.col("id") % 3 != 0, F.col("sev")).alias("severity"), F.array(F.struct(F.col("msg").alias("title"))).alias("via"))
    item = F.struct(F.concat(F.lit("p"), F.col("id")).alias("k"), value.alias("v"))
    out = _outputs(spark, d, item, lambda xs: F.to_json(F.struct(F.map_from_entries(xs).alias("vulnerabilities"))))
    return _pick(I.parse(out, "npm-audit"), "rule_id", "code", "description")


@query("s19_composer_audit", _sql(_score("audit"), rule_id="concat('COMPOSER-', rule)", code="concat('p', line, ' 2')", description="msg"))
def s19(spark, d):
    item = F.struct(F.col("rule").alias("id"), F.concat(F.lit("p"), F.col("line")).alias("package"), F.lit("2").alias("version"), F.col("sev").alias("severity"), F.col("msg").alias("description"))
    return _pick(I.parse(_outputs(spark, d, item, _json("vulnerabilities")), "composer-audit"), "rule_id", "code", "description")


@query("s20_dependency_check", _sql(_score("audit"), rule_id="concat('DEPCHECK-', rule)", code="concat('jar', line)", description="msg"))
def s20(spark, d):
    vuln = F.struct(F.col("rule").alias("cve"), F.col("sev").alias("severity"), F.col("msg").alias("description"))
    item = F.struct(F.concat(F.lit("jar"), F.col("line")).alias("name"), F.array(vuln).alias("vulnerabilities"))
    out = _outputs(spark, d, item, lambda xs: F.to_json(F.struct(F.struct(xs.alias("dependencies")).alias("reportSchema"))))
    return _pick(I.parse(out, "dependency-check"), "rule_id", "code", "description")


def _table(col: str, table: dict, k: int, default: str = "NULL") -> str:
    return f"CASE {col} " + " ".join(f"WHEN {p} THEN {x[k]!r}" if isinstance(x[k], int) else f"WHEN {p} THEN '{x[k]}'" for p, x in table.items()) + f" ELSE {default} END"


_RISK = [_table("port", I.RISKY_PORTS, k) for k in range(3)]
_OPEN = f"""SELECT scan_id, host AS file, port AS line, coalesce(t, '') <> '' AS risky, s AS severity_score, c AS cwe, CASE WHEN t IS NOT NULL THEN concat(t, ' (port ', port, ')') ELSE concat('Open service ', banner, ' on port ', port) END AS title FROM
(SELECT *, {_RISK[0]} AS t, coalesce({_RISK[1]}, 'CWE-200') AS c, coalesce({_RISK[2]}, 3) AS s FROM @ports) x WHERE t IS NOT NULL OR banner <> ''"""


@query("s21_nmap", f"SELECT scan_id, file, line, severity_score, cwe, title FROM ({_OPEN}) y")
def s21(spark, d):
    p = v(spark, d, "ports")
    service = F.concat(F.lit('<port portid="'), F.col("port"), F.lit('"><service product="'), F.col("banner"), F.lit('"/></port>'))
    out = p.groupBy("scan_id", "host").agg(F.collect_list(service).alias("xs"))
    xml = F.concat(F.lit('<nmaprun><host><address addr="'), F.col("host"), F.lit('"/><ports>'), F.array_join("xs", ""), F.lit("</ports></host></nmaprun>"))
    return I.parse(out.select("scan_id", xml.alias("content")), "nmap").select("scan_id", "file", "line", "severity_score", "cwe", "title")


@query("s8_expiring_certificates", """SELECT c_custkey AS id, CASE WHEN days > 0 THEN 6 ELSE 9 END AS severity_score, concat('TLS certificate expires soon (', days, ' days)') AS title FROM (SELECT c_custkey, c_custkey % 50 - 10 AS days FROM customer) x WHERE days < 30""")
def certificates(spark, d):
    """A certificate for each customer, which ends before or after a day."""
    key, day = F.col("c_custkey"), F.lit("2024-06-01").cast("date")
    ends = F.date_add(day, (key % 50 - 10).cast("int")).cast("timestamp")
    certs = spark.read.parquet(f"{d}/customer.parquet").select(key.alias("scan_id"), F.concat(F.lit("h"), key).alias("host"), F.lit(443).alias("port"), ends.alias("not_after"))
    return I.expiring_certificates(certs, day.cast("timestamp")).select(F.col("scan_id").alias("id"), "severity_score", "title")


@query("s14_large_outputs", "SELECT file, line, rule AS rule_id, msg AS description, CASE sev WHEN 'high' THEN 9 WHEN 'medium' THEN 7 ELSE 4 END AS severity_score FROM (SELECT *, 'a/b/C.java' AS file FROM (SELECT scan_id, line, rule, msg, sev FROM @issues) y) x")
def s14_large(spark, d):
    """Outputs written as files, whose names are the scans, and read by element."""
    p = C.choose(F.col("sev"), {"high": "1", "medium": "2"}, "3")
    item = F.concat(F.lit('<BugInstance type="'), F.col("rule"), F.lit('" priority="'), p, F.lit('">'), _tag("LongMessage", F.col("msg")), F.lit("<Class><classname>a.b.C</classname></Class><SourceLine>"), _tag("start", F.col("line")), F.lit("</SourceLine></BugInstance>"))
    path = scratch_path(spark, "xml")

    def whole(batches):
        yield pd.DataFrame({"value": ["<BugCollection>"]})
        for b in batches:
            yield b
        yield pd.DataFrame({"value": ["</BugCollection>"]})

    v(spark, d, "issues").select(item.alias("value")).mapInPandas(whole, "value string").write.text(path)
    return I.parse_files(spark, path, "spotbugs").select("file", "line", "rule_id", "description", "severity_score")


@query("j8_open_ports", f"SELECT scan_id, file, line, severity_score, cwe, title FROM ({_OPEN}) y")
def j8(spark, d):
    return I.open_ports(v(spark, d, "ports")).select("scan_id", "file", "line", "severity_score", "cwe", "title")


_EXPO = [_table("port", I.EXPOSURE_PORTS, k) for k in range(3)]


@query("j8_exposure", f"""WITH k AS (SELECT *, {_EXPO[0]} AS t, {_EXPO[1]} AS c, {_EXPO[2]} AS s FROM @ports),
w AS (SELECT *, CASE WHEN banner LIKE 'OpenSSH%' THEN 'OpenSSH 7.4' WHEN banner LIKE 'Apache%' THEN 'Apache 2.4' WHEN banner LIKE 'nginx%' THEN 'nginx 1.19' WHEN banner = 'Postfix' THEN 'Postfix' END AS b FROM k WHERE t IS NOT NULL)
SELECT scan_id, host AS file, port AS line, concat(t, ' (port ', port, ')') AS title, s AS severity_score FROM w UNION ALL SELECT scan_id, host, port, concat(b, ' version disclosed in banner'), 3 FROM w WHERE b IS NOT NULL
UNION ALL SELECT DISTINCT scan_id, host, 0, 'No exposed services found on scanned ports', 1 FROM @ports WHERE host NOT IN (SELECT host FROM w)""")
def j8_exposure(spark, d):
    p = v(spark, d, "ports")
    found = I.exposure(p.select("scan_id", "host", "port", "banner"), p.select("scan_id", "host").distinct())
    return found.select("scan_id", "file", "line", "title", "severity_score")


@query("s22_openvas", f"SELECT scan_id, severity_score, {_SEV} AS severity, file, line, title, cwe, description FROM (SELECT scan_id, CAST(cvss AS INT) AS severity_score, file, line, rule AS title, CASE WHEN id % 2 = 0 THEN 'CWE-79' ELSE 'CWE-20' END AS cwe, msg AS description FROM @issues) x")
def s22(spark, d):
    cwe = F.when(F.col("id") % 2 == 0, "<cwe>CWE-79</cwe>").otherwise("")
    item = F.concat(F.lit("<result>"), _tag("name", F.col("rule")), cwe, _tag("description", F.col("msg")), _tag("host", F.col("file")), _tag("port", F.concat(F.col("line"), F.lit("/tcp"))), _tag("cvss_base", F.col("cvss")), F.lit("</result>"))
    out = _outputs(spark, d, item, lambda xs: F.concat(F.lit("<report>"), F.array_join(xs, ""), F.lit("</report>")))
    return _pick(I.parse(out, "openvas"), "file", "line", "title", "cwe", "description")


@query("s23_nessus", f"SELECT scan_id, severity_score, {_SEV} AS severity, file, title, cwe, description FROM (SELECT scan_id, CASE WHEN id % 3 = 0 THEN CAST(cvss AS INT) WHEN id % 3 = 1 THEN 4 ELSE 5 END AS severity_score, file, rule AS title, 'CWE-20' AS cwe, msg AS description FROM @issues) x")
def s23(spark, d):
    item = F.struct(F.col("rule").alias("name"), F.when(F.col("id") % 3 == 0, F.col("cvss")).alias("cvss_base_score"), F.when(F.col("id") % 3 == 1, 4.0).alias("severity"), F.col("msg").alias("description"), F.col("file").alias("host"))
    return _pick(I.parse(_outputs(spark, d, item, _json("vulnerabilities")), "nessus"), "file", "title", "cwe", "description")


_LOOSE = "SELECT scan_id, {s} AS severity_score, {v} AS severity, file, line, title, rule_id, description FROM (SELECT scan_id, cvss, file, line, rule AS title, rule AS rule_id, msg AS description FROM @issues) x"


@query("s24_generic_json", _LOOSE.format(s="CAST(cvss AS INT)", v="'Medium'"))
def s24_json(spark, d):
    item = F.struct(F.col("file").alias("path"), F.col("line").alias("port"), F.col("rule").alias("name"), F.col("rule").alias("plugin_id"), F.col("cvss").alias("cvss_base"), F.col("msg").alias("summary"))
    return _pick(I.parse(_outputs(spark, d, item, _json("findings")), "json"), "file", "line", "title", "rule_id", "description")


@query("s24_generic_xml", _LOOSE.format(s="5", v="'Medium'"))
def s24_xml(spark, d):
    item = F.concat(F.lit("<finding>"), _tag("host", F.col("file")), _tag("line", F.col("line")), _tag("title", F.col("rule")), _tag("nvt_oid", F.col("rule")), _tag("description", F.col("msg")), F.lit("</finding>"))
    out = _outputs(spark, d, item, lambda xs: F.concat(F.lit("<r>"), F.array_join(xs, ""), F.lit("</r>")))
    return _pick(I.parse(out, "xml"), "file", "line", "title", "rule_id", "description")


@query("s24_generic_text", """SELECT scan_id, substr(t, 1, 100) AS title, substr(t, 1, 300) AS description, CAST(i AS INT) AS line FROM (SELECT scan_id, trim(unnest(xs)) AS t, generate_subscripts(xs, 1) AS i FROM
(SELECT scan_id, list(CASE WHEN id % 3 = 0 THEN concat('  Severity ', msg) WHEN id % 3 = 1 THEN concat('CVE-', id) ELSE msg END ORDER BY id) AS xs FROM @issues GROUP BY 1) g) x WHERE regexp_matches(lower(t), 'cve-|cwe-|severity|risk|vulnerability|exploit')""")
def s24_text(spark, d):
    line = F.when(F.col("id") % 3 == 0, F.concat(F.lit("  Severity "), F.col("msg"))).when(F.col("id") % 3 == 1, F.concat(F.lit("CVE-"), F.col("id"))).otherwise(F.col("msg"))
    out = _outputs(spark, d, F.struct("id", line.alias("t")), lambda xs: F.array_join(F.transform(F.array_sort(xs), lambda x: x["t"]), "\n"))
    return I.parse(out, "text").select("scan_id", "title", "description", "line")


@query("p12_normalize", f"SELECT scan_id, file, line, rule_id, title, CAST(floor(cvss) AS INT) AS severity_score, CASE WHEN line % 2 = 0 THEN 'Odd' ELSE 'Medium' END AS severity, cwe FROM (SELECT scan_id, file, line, rule AS rule_id, msg AS title, cvss, CASE WHEN id % 2 = 0 THEN 'CWE-22' ELSE 'CWE-20' END AS cwe FROM @issues) x")
def p12(spark, d):
    raw = v(spark, d, "issues").select("scan_id", F.col("file").alias("host"), F.col("line").alias("port"), F.col("rule").alias("nvt_oid"), F.col("msg").alias("script"), F.col("cvss").alias("cvss_base"), F.when(F.col("line") % 2 == 0, "Odd").alias("severity"), F.when(F.col("id") % 2 == 0, "CWE-22").alias("cwe_id"))
    return I.normalize(raw, "x").select("scan_id", "file", "line", "rule_id", "title", "severity_score", "severity", "cwe")


@query("j12_missing_headers", """WITH h AS (SELECT unnest(['strict-transport-security', 'content-security-policy', 'x-content-type-options', 'x-frame-options']) AS h, unnest(['HSTS header missing', 'Content-Security-Policy missing', 'X-Content-Type-Options missing', 'X-Frame-Options missing (clickjacking)']) AS title, unnest([5, 5, 3, 4]) AS s, unnest([2, 3, 5, 7]) AS k)
SELECT page_id, title, s AS severity_score FROM pages, h WHERE page_id % k <> 0 UNION ALL SELECT page_id, 'Server version disclosed: Apache/2.4', 3 FROM pages WHERE page_id % 2 = 1""")
def j12(spark, d):
    p = spark.read.parquet(f"{d}/pages.parquet")
    names = {2: "strict-transport-security", 3: "content-security-policy", 5: "x-content-type-options", 7: "x-frame-options"}
    pairs = [F.when(F.col("page_id") % k == 0, F.struct(F.lit(h).alias("k"), F.lit("1").alias("v"))) for k, h in names.items()]
    server = F.struct(F.lit("server").alias("k"), F.when(F.col("page_id") % 2 == 1, "Apache/2.4").otherwise("Apache").alias("v"))
    rows = p.select(F.col("page_id").cast("string").alias("scan_id"), F.lit("h").alias("host"), F.lit(80).alias("port"), F.map_from_entries(F.array_compact(F.array(*pairs, server))).alias("headers"))
    return I.missing_headers(rows).select(F.col("scan_id").cast("bigint").alias("page_id"), "title", "severity_score")


# ---- rules over lines


def _files(spark, d, end=".py"):
    return v(spark, d, "code").select("file_id", F.concat(F.lit("f"), F.col("file_id"), F.lit(end)).alias("path"), F.col("line").alias("text"))


def _py_rules(code: str) -> str:
    skip = {"S-SQLI-1"}  # look-ahead, which DuckDB lacks; no line of the adapter holds "execute"
    out = []
    for r in RULES:
        if r.group == "python" and r.rule_id not in skip:
            p = r.pattern.replace("(?!Loader)", "").replace("'", "''")
            out.append(f"SELECT *, '{r.rule_id}' AS rule_id, {r.score} AS severity_score, '{r.cwe}' AS cwe FROM l WHERE regexp_matches({code}, '{p}'{chr(44) + chr(39) + 'i' + chr(39) if 'i' in r.flags else ''})")
    return " UNION ALL ".join(out)


_CODE = r"""l AS (SELECT file_id, line, split_part(line, '#', 1) AS code FROM @code WHERE NOT regexp_matches(trim(line), '^(#|[rf]?"{3})')
AND NOT (regexp_matches(lower(line), 'test|example|demo|mock|fake|dummy|placeholder') AND regexp_matches(lower(line), '\b(password|passwd|secret|api[_-]?key|token)\s*=')))"""


@query("p1_rule_match", f"WITH {_CODE} SELECT file_id, rule_id, severity_score, {_SEV} AS severity, cwe, line AS code FROM ({_py_rules('code')}) x")
def p1(spark, d):
    found = detect.heuristics(_files(spark, d))
    return found.select("file_id", "rule_id", "severity_score", "severity", "cwe", "code")


@query("p1_documents", r"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents)
SELECT doc_id, CAST(n AS INT) AS line_no, 'S-HARDCODE-4' AS rule_id FROM l WHERE regexp_matches(split_part(line, '#', 1), '\btoken\s*=\s*[''"][A-Za-z0-9_\-\.]{16,}[''"]', 'i')
AND NOT regexp_matches(trim(line), '^#') AND NOT regexp_matches(lower(line), 'test|example|demo|mock|fake|dummy|placeholder')""")
def p1_documents(spark, d):
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", F.concat(F.col("doc_id"), F.lit(".py")).alias("path"), "text")
    return detect.heuristics(docs, rules_named("python", "S-HARDCODE-4")).select("doc_id", "line_no", "rule_id")


@query("d8_lines", "SELECT doc_id, CAST(count(*) AS BIGINT) AS n, CAST(sum(length(line)) AS BIGINT) AS chars FROM (SELECT doc_id, unnest(string_split_regex(regexp_replace(text, '(\\r\\n|[\\n\\r\\x0b\\x0c\\x1c\\x1d\\x1e\\x{85}\\x{2028}\\x{2029}])$', ''), '\\r\\n|[\\n\\r\\x0b\\x0c\\x1c\\x1d\\x1e\\x{85}\\x{2028}\\x{2029}]')) AS line FROM documents WHERE text <> '') x GROUP BY 1".replace("\\\\", "\\"))
def d8(spark, d):
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text")
    return detect.lines(docs).groupBy("doc_id").agg(F.count("*").alias("n"), F.sum(F.length("line")).alias("chars"))


@query("p2_visible_lines", f"WITH {_CODE} SELECT file_id, code FROM l")
def p2(spark, d):
    return v(spark, d, "code").select("file_id", detect.python_code(F.col("line")).alias("code")).where("code is not null")


@query("p3_generic_cut", r"""SELECT file_id, CASE WHEN contains(line, '#') THEN split_part(line, '#', 1) WHEN contains(line, '//') THEN split_part(line, '//', 1) ELSE trim(line) END AS code FROM @code WHERE NOT starts_with(trim(line), '#')""")
def p3(spark, d):
    return v(spark, d, "code").select("file_id", detect.generic_code(F.col("line"), "go").alias("code")).where("code is not null")


@query("p4_safe_assignment", r"SELECT file_id, regexp_matches(lower(line), 'test|example|demo|mock|fake|dummy|placeholder') AND regexp_matches(lower(line), '\b(password|passwd|secret|api[_-]?key|token)\s*=') AS safe FROM @code")
def p4(spark, d):
    return v(spark, d, "code").select("file_id", detect.safe_assignment(F.col("line")).alias("safe"))


@query("p5_web_dispatch", f'SELECT file_id, {_GROUP} AS "group" FROM @paths WHERE {_LANG} = \'web\'')
def p5(spark, d):
    return v(spark, d, "paths").where(C.language(F.col("path")) == "web").select("file_id", C.rule_group(F.col("path")).alias("group"))


@query("p6_projection", f"WITH {_CODE} SELECT file_id, 'python-heuristic' AS scanner, concat('Unsafe pickle deserialization detected on line ', 1, '.') AS description, line AS code FROM l WHERE regexp_matches(code, '\\bpickle\\.(?:loads|load)\\s*\\(')".replace("\\\\", "\\"))
def p6(spark, d):
    return detect.heuristics(_files(spark, d), rules_named("python", "S-DESER-1")).select("file_id", "scanner", "description", "code")


@query("p1_pages_cleartext", "SELECT page_id, 'W-MIXED-1' AS rule_id FROM pages WHERE contains(url, 'http://')")
def p1_pages(spark, d):
    p = spark.read.parquet(f"{d}/pages.parquet").select("page_id", F.concat(F.col("page_id"), F.lit(".js")).alias("path"), F.col("url").alias("text"))
    return detect.heuristics(p, rules_named("js", "W-MIXED-1")).select("page_id", "rule_id")


@query("j7_custom_rules", r"""SELECT file_id, 'U-1' AS rule_id, 'Digest' AS title, 'High' AS severity, 5 AS severity_score FROM @code WHERE regexp_matches(line, 'hashlib\.\w+')
UNION ALL SELECT file_id, 'U-2', 'Custom Finding', 'Medium', 7 FROM @code WHERE contains(line, 'http')""")
def j7(spark, d):
    rules = [
        {"id": "U-1", "title": "Digest", "pattern": r"hashlib\.\w+", "severity": "High", "extensions": [".py"]},
        {"id": "U-2", "pattern": "http", "score": 7},
        {"id": "U-3", "pattern": "x", "extensions": [".PY"]},
        {"id": "U-4", "pattern": "("},
        {"id": "U-5", "pattern": "a" * 501},
    ]
    return detect.custom(_files(spark, d), rules).select("file_id", "rule_id", "title", "severity", "severity_score")


@query("l3_rule_based_advice", """SELECT file_id, rule_id, concat(title, ' was reported in f', file_id, '.py (line 1) by python-heuristic. Severity: Critical. This matches ', cwe, '.') AS explanation,
CASE cwe WHEN 'CWE-78' THEN 'avoid shell=True / use argument lists and allowlists for commands' ELSE 'never deserialize untrusted data; validate class allowlists / use safe formats (JSON)' END AS recommended_fix FROM
(SELECT file_id, 'S-CMDI-1' AS rule_id, 'Shell=True allows command injection' AS title, 'CWE-78' AS cwe FROM @code WHERE contains(line, 'shell=True') UNION ALL SELECT file_id, 'S-DESER-1', 'Unsafe pickle deserialization', 'CWE-502' FROM @code WHERE contains(line, 'pickle.loads(')) x""")
def l3(spark, d):
    found = detect.heuristics(_files(spark, d)).where("severity = 'Critical'").withColumnRenamed("path", "file").withColumnRenamed("line_no", "line")
    return rule_based_advice(found).select("file_id", "rule_id", "explanation", "recommended_fix")


def _taint_text(end):
    lines = ["def run():", "x = input()", "y = x.strip()", "z = F", "cursor.execute(y)", "print(z)"] if end == ".py" else ["String a = request.getParameter(b);", "a = req.getParameter(b);", "stmt.execute(a);"]
    return F.concat_ws("\n", *[F.replace(F.lit(t), F.lit("F"), F.concat(F.lit("v"), F.col("file_id"))) for t in lines])


@query("z4_python_taint", "SELECT c_custkey AS file_id, line_no, 'S-SQLI-TAINT' AS rule_id, source_line, variable FROM customer, (SELECT 5 AS line_no, 2 AS source_line, 'y' AS variable) t")
def z4(spark, d):
    f = v(spark, d, "code").select("file_id", F.concat(F.lit("f"), F.col("file_id"), F.lit(".py")).alias("path"), _taint_text(".py").alias("text"))
    return taint.python_taint(f).select("file_id", "line_no", "rule_id", "source_line", "variable")


@query("z5_taint", "SELECT c_custkey AS file_id, line_no, 'TAINT-SQL' AS rule_id, source_line, variable FROM customer, (SELECT 3 AS line_no, 2 AS source_line, 'a' AS variable) t")
def z5(spark, d):
    f = v(spark, d, "code").select("file_id", F.concat(F.lit("f"), F.col("file_id"), F.lit(".java")).alias("path"), _taint_text(".java").alias("text"))
    return taint.taint(f).select("file_id", "line_no", "rule_id", "source_line", "variable")


#: Lines of a generated file, each with a number of its own (J) and the variable that it reads (R).
_FLOW_LINES = 10
_FLOW_CODE = {
    ".py": ("vJ = input()", "vJ = vR.strip()", "cursor.execute(vR)", "os.system(vR)", "def fJ():", "vR = 1"),
    ".java": ("vJ = req.getParameter(b);", "vJ = vR.trim();", "stmt.execute(vR);", "run.exec(vR);", "public fJ(a) {", "final vR = 1;"),
}


def _flow_files(spark, d, *ends):
    """A file for each customer and language: sources, copies, sinks, scopes and constants in an order that follows the key."""

    def text(end):
        def line(j):
            digit = (F.col("file_id") * 7 + j * 13 + F.floor(F.col("file_id") / (j + 1))) % 12
            code = F.element_at(F.array(*[F.lit(t) for t in _FLOW_CODE[end]]), (digit % 6 + 1).cast("int"))
            read = F.greatest(j - 1 - F.floor(digit / 6), F.lit(0)).cast("string")
            return F.replace(F.replace(code, F.lit("J"), j.cast("string")), F.lit("R"), read)

        # a function of the line's number: ten lines written out make a method that the JVM doesn't compile
        return F.array_join(F.transform(F.sequence(F.lit(1), F.lit(_FLOW_LINES)), line), "\n")

    # rows of a generator: filters on their paths stay behind the rows' deal over tasks, which all languages share
    files = [F.struct(F.concat(F.lit("f"), F.col("file_id"), F.lit(end)).alias("path"), text(end).alias("text")) for end in ends]
    return v(spark, d, "code").select("file_id", F.inline(F.array(*files)))


# o: where the variable of each line so far was tainted; a scope empties it, a constant does not
_FLOW_CTE = f"""WITH RECURSIVE s(file_id, j, o, kind, r, src) AS (SELECT c_custkey, CAST(0 AS INT), CAST([] AS INT[]), CAST(-1 AS BIGINT), CAST(0 AS BIGINT), CAST(NULL AS INT) FROM customer UNION ALL
SELECT file_id, j + 1, list_append(CASE WHEN kind = 4 THEN list_transform(o, lambda x: CAST(NULL AS INT)) ELSE o END, CAST(CASE kind WHEN 0 THEN j + 1 WHEN 1 THEN o[r] END AS INT)), kind, r, o[r] FROM
(SELECT file_id, j, o, digit % 6 AS kind, greatest(j - digit // 6, 0) AS r FROM (SELECT *, CAST((file_id * 7 + (j + 1) * 13 + file_id // (j + 2)) % 12 AS BIGINT) AS digit FROM s WHERE j < {_FLOW_LINES}) x) y)"""


def _flow_sql(rules):
    return f"""{_FLOW_CTE}
SELECT file_id, min(j) AS line_no, CASE kind WHEN 2 THEN '{rules[0]}' ELSE '{rules[1]}' END AS rule_id, src AS source_line, concat('v', r) AS variable FROM s WHERE kind IN (2, 3) AND src IS NOT NULL GROUP BY file_id, kind, src, r"""


@query("z4_python_flows", _flow_sql(("S-SQLI-TAINT", "S-CMDI-TAINT")))
def z4_flows(spark, d):
    return taint.python_taint(_flow_files(spark, d, ".py")).select("file_id", "line_no", "rule_id", "source_line", "variable")


@query("z5_flows", _flow_sql(("TAINT-SQL", "TAINT-CMD")))
def z5_flows(spark, d):
    return taint.taint(_flow_files(spark, d, ".java")).select("file_id", "line_no", "rule_id", "source_line", "variable")


_USER_RULES = [{"id": "S-CMDI-2", "title": "Again", "pattern": r"os\.system"}, {"id": "U-1", "title": "One", "pattern": r"\w+ = 1;?$", "severity": "Low", "score": 6}]


@query("scan_tree", rf"""{_FLOW_CTE}, b AS (SELECT '.py' AS ext UNION ALL SELECT '.java'), u AS (
SELECT file_id, '.py' AS ext, j AS line, 'S-CMDI-2' AS rule_id, 'python-heuristic' AS scanner, 7 AS severity_score, 0 AS rank, 8 AS ord FROM s WHERE kind = 3
UNION ALL SELECT file_id, '.py', min(j), CASE kind WHEN 2 THEN 'S-SQLI-TAINT' ELSE 'S-CMDI-TAINT' END, 'python-heuristic', 9, 1, src FROM s WHERE kind IN (2, 3) AND src IS NOT NULL GROUP BY file_id, kind, src, r
UNION ALL SELECT file_id, '.py', j, 'S-CMDI-2', 'custom-rules', 5, 2, 0 FROM s WHERE kind = 3
UNION ALL SELECT file_id, ext, j, 'U-1', 'custom-rules', 6, 2, 1 FROM s, b WHERE kind = 5
UNION ALL SELECT file_id, ext, min(j), CASE kind WHEN 2 THEN 'TAINT-SQL' ELSE 'TAINT-CMD' END, 'TaintAnalyzer', 9, 3, src FROM s, b WHERE kind IN (2, 3) AND src IS NOT NULL GROUP BY file_id, ext, kind, src, r
UNION ALL SELECT c_custkey, '.py', 3, 'TAINT-SQL', 'tool', 2, 4, 0 FROM customer UNION ALL SELECT c_custkey, '.java', 1, 'T-1', 'tool', 9, 4, 0 FROM customer),
f AS (SELECT file_id % 60 AS scan_id, concat('f', file_id, ext) AS file, * FROM u),
k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY scan_id, file, line, rule_id ORDER BY rank, ord) AS q FROM f) x WHERE q = 1)
SELECT scan_id, file, CAST(line AS INT) AS line, rule_id, scanner, severity_score, CAST(position AS INT) AS position FROM
(SELECT *, row_number() OVER (PARTITION BY scan_id ORDER BY severity_score DESC, rank, file, line, ord, rule_id) AS position FROM k) y WHERE position <= 60""")
def scan_tree(spark, d):
    """Files of two languages with flows; a user rule and a tool find again what others found on the same line."""
    files = _flow_files(spark, d, ".py", ".java").withColumn("scan_id", F.col("file_id") % 60)
    file, path = [F.concat(F.lit("f"), F.col("file_id"), F.lit(end)) for end in (".py", ".java")]
    own = v(spark, d, "code").select((F.col("file_id") % 60).alias("scan_id"), F.inline(F.array(*[
        F.struct(f.alias("file"), F.lit(line).alias("line"), F.lit(rule).alias("rule_id"), F.lit("tool").alias("scanner"), F.lit(score).alias("severity_score")) for f, line, rule, score in ((file, 3, "TAINT-SQL", 2), (path, 1, "T-1", 9))
    ])))
    found, _ = scan(files, _USER_RULES, own, most=60)
    return found.select("scan_id", "file", "line", "rule_id", "scanner", "severity_score", "position")


@query("f4_registered_format", f"SELECT scan_id, file, rule AS title, severity_score, {_SEV} AS severity FROM (SELECT scan_id, file, rule, CAST(cvss AS INT) AS severity_score FROM @issues) x")
def f4(spark, d):
    def bars(outputs):
        """A finding for each line of the form title|file|score."""
        part = F.split("text", r"\|")
        rows = outputs.select("scan_id", F.explode(F.split("content", "\n")).alias("text"))
        return I.normalize(rows.select("scan_id", part[0].alias("title"), part[1].alias("file"), part[2].cast("int").alias("severity_score")), "bars")

    I.register("bars", bars)
    item = F.concat_ws("|", "rule", "file", F.col("cvss").cast("int"))
    return I.parse(_outputs(spark, d, item, lambda xs: F.array_join(xs, "\n")), "bars").select("scan_id", "file", "title", "severity_score", "severity")


# ---- values


@query("p7_score_severity", f"SELECT id, severity_score, {_SEV} AS label FROM @findings")
def p7(spark, d):
    return v(spark, d, "findings").select("id", "severity_score", C.score_severity(F.col("severity_score")).alias("label"))


@query("p8_severity_of", "SELECT id, CASE WHEN id % 4 = 0 THEN 'High' WHEN id % 4 = 1 THEN 'Informational' WHEN id % 4 = 2 AND severity_score >= 9 THEN 'Critical' WHEN id % 4 = 2 AND severity_score >= 7 THEN 'High' WHEN id % 4 = 2 AND severity_score >= 4 THEN 'Medium' WHEN id % 4 = 2 THEN 'Low' ELSE 'Informational' END AS label FROM @findings")
def p8(spark, d):
    k = F.col("id") % 4
    label = F.when(k == 0, "  HIGH ").when(k == 1, "informational").when(k == 2, "odd")
    return v(spark, d, "findings").select("id", C.severity_of(label, F.when(k != 3, F.col("severity_score"))).alias("label"))


@query("p9_cwe_family", r"SELECT c_custkey AS id, CASE WHEN regexp_extract(c_name, '(\d+)', 1) = '' THEN '' ELSE concat('CWE-', CAST(regexp_extract(c_name, '(\d+)', 1) AS BIGINT)) END AS family FROM customer")
def p9(spark, d):
    return spark.read.parquet(f"{d}/customer.parquet").select(F.col("c_custkey").alias("id"), C.cwe_family(F.col("c_name")).alias("family"))


@query("p10_times", "SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M UTC') AS iso, CASE WHEN event_id % 2 = 0 THEN strftime(ts, '%Y-%m-%d 00:00 UTC') ELSE 'Not available' END AS other FROM events")
def p10(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet")
    iso = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    other = F.when(F.col("event_id") % 2 == 0, F.date_format("ts", "yyyy-MM-dd")).otherwise("soon")
    return e.select("event_id", C.format_time(C.parse_time(iso)).alias("iso"), C.format_time(C.parse_time(other)).alias("other"))


@query("p11_safe_int", "SELECT c_custkey AS id, CASE c_custkey % 4 WHEN 0 THEN least(c_custkey, 900) WHEN 1 THEN 5 WHEN 2 THEN 0 ELSE 5 END AS n FROM customer")
def p11(spark, d):
    k = F.col("c_custkey")
    text = F.when(k % 4 == 0, k.cast("string")).when(k % 4 == 1, F.concat(k, F.lit(".9"))).when(k % 4 == 2, F.concat(F.lit("-"), k))
    return spark.read.parquet(f"{d}/customer.parquet").select(k.alias("id"), C.safe_int(text, 5, 0, 900).alias("n"))


@query("p13_tool_severities", "SELECT id, CASE sev WHEN 'high' THEN 8 WHEN 'medium' THEN 6 WHEN 'low' THEN 3 ELSE 5 END AS score FROM @issues")
def p13(spark, d):
    return v(spark, d, "issues").select("id", C.choose(F.col("sev"), I.AUDIT_SCORE, 5).alias("score"))


@query("p14_locations", "SELECT file_id, concat(path, CASE WHEN file_id <> 0 THEN concat(':', file_id) ELSE '' END) AS location, concat(CASE WHEN length(path) > 34 THEN string_split(path, '/')[-1] ELSE path END, CASE WHEN file_id <> 0 THEN concat(':', file_id) ELSE '' END) AS short FROM (SELECT file_id, concat('aaaaaaaaaaaaaaaaaaaaaa/', path) AS path FROM @paths) x")
def p14(spark, d):
    p = F.concat(F.lit("aaaaaaaaaaaaaaaaaaaaaa/"), F.col("path"))
    return v(spark, d, "paths").select("file_id", C.location(p, F.col("file_id")).alias("location"), C.short_location(p, F.col("file_id")).alias("short"))


@query("p15_clean")
def p15(spark, d):
    return spark.read.parquet(f"{d}/documents.parquet").select("doc_id", redact.clean(F.col("text"), 1500).alias("cleaned"))


@query("p16_has_secret", r"""SELECT doc_id, regexp_matches(text, '\b((?:AKIA|ASIA)[0-9A-Z]{16})\b') OR regexp_matches(text, '\b(glpat-[0-9A-Za-z_\-]{8,})\b') OR regexp_matches(text, '\b(sk-[A-Za-z0-9_-]{12,})\b') OR regexp_matches(text, '\b(gh[pousr]_[A-Za-z0-9]{20,})\b')
OR regexp_matches(text, '\b(xox[baprs]-[A-Za-z0-9\-]{10,})\b') OR regexp_matches(text, '\b(eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{5,})\b') OR regexp_matches(text, '-----BEGIN [A-Z ]*PRIVATE KEY-----[\s\S]*?-----END [A-Z ]*PRIVATE KEY-----')
OR regexp_matches(text, '([a-zA-Z][a-zA-Z0-9+.-]*://[^\s/:@]+:)([^\s/@]{3,})(@)') OR regexp_matches(text, '(?i)(?:api[_-]?key|apikey|access[_-]?key|secret[_-]?(?:key)?|auth[_-]?token|token|passwd|password|pwd|client[_-]?secret)\s*[:=]\s*["'']?[^\s"'',;)]{6,}')
OR regexp_matches(text, '(?i)\bbearer\s+[A-Za-z0-9._+\-/]{10,}') AS has_secret FROM documents""")
def p16(spark, d):
    return spark.read.parquet(f"{d}/documents.parquet").select("doc_id", redact.has_secret(F.col("text")).alias("has_secret"))


@query("p17_code_excerpt", "SELECT doc_id, len(xs[1:14]) AS n, greatest(len(xs) - 14, 0) AS omitted, list_sum(list_transform(xs[1:14], lambda x: least(length(x), 110))) AS chars FROM (SELECT doc_id, CASE WHEN ends_with(text, chr(10)) THEN string_split(text, chr(10))[1:-2] ELSE string_split(text, chr(10)) END AS xs FROM documents) x")
def p17(spark, d):
    e = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", redact.code_excerpt(F.col("text")).alias("e"))
    chars = F.aggregate(F.col("e.lines"), F.lit(0), lambda a, x: a + F.length(x))
    return e.select("doc_id", F.size("e.lines").alias("n"), F.col("e.omitted").alias("omitted"), chars.alias("chars"))


@query("p19_scan_targets", "SELECT c_custkey AS id, CASE c_custkey % 6 WHEN 0 THEN false WHEN 1 THEN true WHEN 2 THEN false WHEN 3 THEN false WHEN 4 THEN true ELSE c_custkey % 32 NOT BETWEEN 16 AND 31 END AS allowed FROM customer")
def p19(spark, d):
    k = F.col("c_custkey")
    t = F.when(k % 6 == 0, F.concat(F.lit("10.1.2."), k % 250)).when(k % 6 == 1, F.concat(F.lit("8.8.4."), k % 250)).when(k % 6 == 2, "a;b").when(k % 6 == 3, "").when(k % 6 == 4, F.concat(F.lit("host"), k)).otherwise(F.concat(F.lit("172."), k % 32, F.lit(".0.1")))
    return spark.read.parquet(f"{d}/customer.parquet").select(k.alias("id"), C.allowed_target(t).alias("allowed"))


@query("p20_hosts", r"SELECT page_id, regexp_replace(regexp_replace(url, '^https?://', '', 'i'), '[/:].*$', '') AS host FROM pages")
def p20(spark, d):
    return spark.read.parquet(f"{d}/pages.parquet").select("page_id", C.bare_host(F.col("url")).alias("host"))


@query("p21_banners", "SELECT id, CASE id % 6 WHEN 0 THEN 'OpenSSH' WHEN 1 THEN 'Apache' WHEN 2 THEN 'nginx' WHEN 3 THEN 'OpenSSL' END AS product, CASE id % 6 WHEN 0 THEN '7.4' WHEN 1 THEN '2.4' WHEN 2 THEN '1.19' WHEN 3 THEN '1.1' END AS version, id % 6 IN (0, 1, 2, 3) AS outdated FROM @ports")
def p21(spark, d):
    product, version = C.banner_version(F.col("banner"))
    return v(spark, d, "ports").select("id", product.alias("product"), version.alias("version"), C.outdated(product, version).alias("outdated"))


@query("p22_path_rules", "SELECT file_id, starts_with(path, 'src/') OR starts_with(path, 'lib/') AS allowed FROM @paths")
def p22(spark, d):
    return v(spark, d, "paths").select("file_id", C.allowed_path(F.col("path"), ["src", "lib/"], [".git"]).alias("allowed"))


# ---- request logs


def _requests(spark, d):
    return throttle.numbered(v(spark, d, "requests").withColumnRenamed("client", "key"))


_GREEDY = """WITH RECURSIVE r AS (SELECT *, row_number() OVER (PARTITION BY client ORDER BY ts, event_id) AS k, epoch(ts) AS t FROM @requests),
w(client, k, event_id, allowed, times) AS (SELECT client, k, event_id, true, {first} FROM r WHERE k = 1 UNION ALL
SELECT r.client, r.k, r.event_id, len(list_filter(w.times, lambda x: r.t - x < {win})) < 3, CASE WHEN len(list_filter(w.times, lambda x: r.t - x < {win})) >= 3 THEN list_filter(w.times, lambda x: r.t - x < {win}) ELSE {step} END
FROM w JOIN r ON r.client = w.client AND r.k = w.k + 1) SELECT event_id, client AS key, allowed FROM w"""


@query("z1_rate_limit", _GREEDY.format(win=3600, first="[t]", step="list_append(list_filter(w.times, lambda x: r.t - x < 3600), r.t)"))
def z1(spark, d):
    return throttle.replay(_requests(spark, d), "limit", 3, 3600).select("event_id", "key", "allowed")


@query("z2_lockout", _GREEDY.format(win=21600, first="CASE WHEN kind = 'login_failed' THEN [t] ELSE CAST([] AS DOUBLE[]) END", step="CASE r.kind WHEN 'login_failed' THEN list_append(list_filter(w.times, lambda x: r.t - x < 21600), r.t) WHEN 'login_ok' THEN CAST([] AS DOUBLE[]) ELSE list_filter(w.times, lambda x: r.t - x < 21600) END"))
def z2(spark, d):
    return throttle.replay(_requests(spark, d), "lockout", 3, 21600).select("event_id", "key", "allowed")


@query("z3_idle_keys", _GREEDY.format(win=3600, first="[t]", step="list_append(list_filter(w.times, lambda x: r.t - x < 3600), r.t)").replace("SELECT event_id, client AS key, allowed FROM w", """, a AS
(SELECT w.client, t, event_id, t - lag(t) OVER (PARTITION BY w.client ORDER BY t, event_id) AS gap FROM w JOIN r USING (client, k, event_id) WHERE allowed),
s AS (SELECT *, sum(CASE WHEN gap IS NULL OR gap >= 3600 THEN 1 ELSE 0 END) OVER (PARTITION BY client ORDER BY t, event_id) AS span FROM a)
SELECT client AS key, min(t) AS since, max(t) + 3600 AS until, count(*) AS n FROM s GROUP BY client, span"""))
def z3(spark, d):
    return throttle.state_spans(_requests(spark, d), 3, 3600)
