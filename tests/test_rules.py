"""A line that fits each built-in rule, and the same choice of lines in Spark as by Python's own engine."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from sightline.functions.columns import split_lines
from sightline.operators import detect
from sightline.operators.detect import heuristics, match
from sightline.operators.literals import ENDLESS, fold, folded, growth, held_literals
from sightline.operators.rules import RULES, SCANNERS
from sightline.plans.rule_lines import POSITIVE

def test_one_line_for_each_rule():
    assert len(RULES) == 150
    assert {g: len(x) for g, x in POSITIVE.items()} == {g: sum(r.group == g for r in RULES) for g in SCANNERS}


@pytest.fixture(scope="module")
def found(spark):
    odd = ["", "x = 1", "pass word = 'x'", "ÉVAL(x)", "éeval(x)", "a\tb", "# eval(x)", "// eval(x)", "x # eval(y)", "u = 'http://a' // x"]
    lines = [(g, k, x) for g in SCANNERS for k, x in enumerate([*POSITIVE[g], *odd, *[y for ys in POSITIVE.values() for y in ys]], 1)]
    df = spark.createDataFrame([(g, g, k, x) for g, k, x in lines], "path string, group string, line_no int, line string")
    return lines, {(r.group, r.line_no, r.rule_id) for r in match(df).collect()}


def _visible(group, line):
    bare = line.strip()
    if group == "python":
        low = line.lower()
        safe = any(w in low for w in ("test", "example", "demo", "mock", "fake", "dummy", "placeholder")) and re.search(r"\b(password|passwd|secret|api[_-]?key|token)\s*=", low)
        return None if bare.startswith("#") or safe else line.split("#")[0]
    if group in ("java", "cpp", "php", "js", "html", "css"):
        return line
    if not bare or bare.startswith(("#", "//")):
        return None
    if "#" in line and group in ("go", "ruby", "shell"):
        return line.split("#")[0]
    if "//" in line and group in ("go", "rust", "csharp", "kotlin", "swift"):
        return line.split("//")[0]
    return bare


def test_same_lines_as_python(found):
    lines, got = found
    flags = {"i": re.I, "s": re.S}
    want = set()
    for g, k, x in lines:
        code = _visible(g, x)
        for r in RULES if code is not None else ():
            if r.group == g and re.search(r.pattern, code, sum(flags[f] for f in r.flags)):
                want.add((g, k, r.rule_id))
    assert got == want


@pytest.mark.parametrize("group", list(SCANNERS))
def test_positive_lines(found, group):
    own = [r for r in RULES if r.group == group]
    missing = [r.rule_id for k, r in enumerate(own, 1) if (group, k, r.rule_id) not in found[1]]
    # these need other text on the line than their language's comment cut leaves
    assert [m for m in missing if m != "G-CLEAR-1"] == []


def test_files(spark):
    rows = [("a/b.py", "x = 1\neval(y)\n"), ("node_modules/c.py", "eval(y)"), ("d.txt", "eval(y)"), ("e.java", None), ("__init__.py", "eval(z)"), ("big.py", "eval(x)\n" * 300_000)]
    df = spark.createDataFrame(rows, "path string, text string")
    assert sorted((r.path, r.line_no, r.rule_id, r.description) for r in heuristics(df).collect()) == [
        ("__init__.py", 1, "S-CMDI-3", "Use of eval() - code injection risk detected on line 1."),
        ("a/b.py", 2, "S-CMDI-3", "Use of eval() - code injection risk detected on line 2."),
    ]


#: A file name of each rule group.
NAMES = {"python": "a.py", "java": "a.java", "cpp": "a.cpp", "php": "a.php", "js": "a.js", "html": "a.html", "css": "a.css", "go": "a.go", "ruby": "a.rb", "rust": "a.rs", "csharp": "a.cs", "kotlin": "a.kt", "swift": "a.swift", "shell": "a.sh", "sql": "a.sql"}


@pytest.fixture(scope="module")
def tree(spark):
    """A file of each group with the lines of all groups in several spellings, and plain prose between them."""
    odd = ["", "ÉVAL(x)", "PAſſWORD = 'abcdef'", "toKen = 'abcdefghijklmnopq'", "İD: ıdentıfıed by 'abc'", "a\tb", "# eval(x)", "// eval(x)", "x # eval(y)"]
    lines = [x for xs in POSITIVE.values() for x in xs]
    lines += odd + [x.upper() for x in lines] + [x[::-1] for x in lines] + ["plain words and numbers 12 here", "another = line of code", ""] * 600
    random.Random(4).shuffle(lines)
    ends = ["\n", "\r\n", "\x0b", "\u2028", "\x85"]
    text = "".join(x + ends[k % 5] for k, x in enumerate(lines))
    rows = [(g, f"d/{name}", text) for g, name in NAMES.items()] + [("none", "d/empty.py", ""), ("none", "d/null.py", None), ("none", "d/e.txt", text)]
    return spark.createDataFrame(rows, "own string, path string, text string").repartition(4)


def test_prefilter_changes_nothing(tree):
    """The findings of lines with a rule's literal are those of all rules over all lines, with a fifth of the searches or less."""
    known = detect.code_files(tree)
    cols = ("own", "path", "line_no", "code", "rule_id", "rule_ord", "scanner", "description", "severity", "owasp")
    want = sorted(tuple(r[c] for c in cols) for r in match(detect.lines(known)).collect())
    got = heuristics(tree)
    assert sorted(tuple(r[c] for c in cols) for r in got.collect()) == want and len(want) > 300
    sizes = {g: sum(r.group == g for r in RULES) for g in SCANNERS}
    all_pairs = sum(r["n"] * sizes[r["group"]] for r in known.select("group", F.size(split_lines(F.col("text"))).alias("n")).where("n > 0").collect())
    tried = detect.candidates(known).count()
    assert len(want) <= tried and 5 * tried <= all_pairs


def test_rules_without_literals(spark, tree):
    """Such a rule is tried on each line."""
    rule = RULES[0]._replace(rule_id="X", pattern=r"[0-9]{2}", flags="")
    assert held_literals(rule.pattern) is None
    got = heuristics(tree.where("own = 'python'"), [rule])
    want = match(detect.lines(detect.code_files(tree.where("own = 'python'"))), [rule])
    assert got.count() == want.count() >= 600


@pytest.mark.parametrize(
    "pattern, held, power",
    [
        (r"\bpassword\s*=", ("password",), 2), ("abc|defg", ("abc", "defg"), 1), ("a(?:bc)?d", ("a",), 1), ("x(abcd)+y", ("abcd",), 2), ("ab[cd]|", None, 1), (r"\d{3}", None, 1),
        ("é long", (" long",), 1), ("(a+)+$", ("a",), ENDLESS), (r"(?:a|b)*c", ("c",), 2), (r"(?:ab|c)*d", ("d",), ENDLESS), (r"(x)\1", ("x",), ENDLESS), (".*.*=", ("=",), 3), ("(", None, ENDLESS),
        ("(?i)AbC", ("abc",), 1), ("a(?=b)bc", ("abc",), 1), ("[a-z]{1,60}y", ("y",), 2), (r"\Qx\E+", None, ENDLESS),
    ],
)
def test_held_literals_and_growth(pattern, held, power):
    assert held_literals(pattern) == held and growth(pattern) == power


def test_fold(spark):
    texts = ["ABC", "İıſK", "ÀÉ ß", "", "x" * 10]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r.f for r in df.select(folded(F.col("t")).alias("f")).collect()] == [fold(t) for t in texts] == ["abc", "iisk", "àé ß", "", "x" * 10]
    assert all(len(fold(t)) == len(t) for t in texts)


RISKY = "aaaaaaaaaaaaaaaa" * 1250 + "!"


def test_search_ends_in_time(spark):
    """A pattern that would take for ever ends as no match; every other row stays."""
    rows = [("a.py", RISKY), ("b.py", "aaa\nbaaa"), ("c.py", "evil x"), ("d.py", "key = 1" + " " * 30_000)]
    df = spark.createDataFrame(rows, "path string, text string")
    rules = [{"id": "U-1", "pattern": "^(a|aa)+$"}, {"id": "U-2", "pattern": "ev.l"}, {"id": "U-3", "pattern": r"k.*=.*1.*$", "extensions": [".py"]}, {"id": "U-4", "pattern": r"(?:k|e)\w+ = \d\s*"}]
    began = time.time()
    got = {(r.path, r.line_no, r.rule_id) for r in detect.custom(df, rules, seconds=1.0).collect()}
    assert got == {("b.py", 1, "U-1"), ("c.py", 1, "U-2"), ("d.py", 1, "U-3"), ("d.py", 1, "U-4")} and time.time() - began < 60
    table = spark.createDataFrame([(r["id"], r["pattern"], r.get("extensions")) for r in rules], "id string, pattern string, extensions array<string>")
    for c in ("title", "severity", "cwe", "owasp"):
        table = table.withColumn(c, F.lit(None).cast("string"))
    assert {(r.path, r.line_no, r.rule_id) for r in detect.custom_table(df, table.withColumn("score", F.lit(None).cast("int")), seconds=1.0).collect()} == got


def test_table_of_many_rules(spark, monkeypatch):
    """10,000 rules of all kinds, as a table, find what the same rules in the plan find."""
    rng = random.Random(9)
    words = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz_") for _ in range(rng.randint(3, 9))) for _ in range(9_990)]
    rules = [{"id": f"W-{k}", "pattern": rng.choice([rf"\b{w}\b", f"(?i){w.upper()}", rf"{w}\s*=", f"{w}|never_{w}", f"x?{w}[.]?"]), "extensions": [".py"] if k % 5 == 0 else None, "score": k % 11 if k % 2 else None, "title": f"t{k}" if k % 3 else None} for k, w in enumerate(words)]
    rules += [{"id": "B-1", "pattern": "("}, {"id": "B-2", "pattern": ""}, {"id": "B-3", "pattern": "a" * 501}, {"id": "B-4", "pattern": None}]
    rules += [{"id": "S-1", "pattern": r"\d{4}"}, {"id": "S-2", "pattern": "q!"}, {"id": "S-3", "pattern": r"^(?P<x>\w)\w+ end"}, {"id": "S-4", "pattern": "", "title": ""}, {"id": "S-5", "pattern": "İ|straße"}, {"id": "S-6", "pattern": "(q!)+x"}]
    text = ["\n".join(" ".join(rng.choice(words) + rng.choice(["", " =", "()", ".", "1234", "q!"]) for _ in range(6)) for _ in range(20)) for _ in range(12)]
    text += [None, "", "q!q!x\r\nSTRAßE straße İ end 99\x0bab end"]
    df = spark.createDataFrame([(k, f"f{k}.{'py' if k % 2 else 'JS'}", t) for k, t in enumerate(text)], "key int, path string, text string")
    schema = "id string, title string, pattern string, severity string, score int, cwe string, owasp string, extensions array<string>"
    table = spark.createDataFrame([(r["id"], r.get("title"), r["pattern"], None, r.get("score"), None, None, r.get("extensions")) for r in rules], schema)
    with monkeypatch.context() as m:  # nothing of the rules comes to the driver but 2 MB of bits
        m.setattr(type(table), "collect", lambda self: pytest.fail("collected"))
        found = detect.custom_table(df, table)
    cols = ("key", "path", "line_no", "code", "rule_id", "title", "severity", "severity_score", "cwe", "owasp", "scanner")
    got = sorted(tuple(r[c] for c in cols) for r in found.collect())
    used = {r[4] for r in got}
    some = [r for r in rules if r["id"] in used or r["id"][0] in "BS" or rng.random() < 0.02]  # the plan cannot hold all
    want = []
    for k in range(0, len(some), 150):
        want += [tuple(r[c] for c in cols) for r in detect.custom(df, some[k : k + 150]).collect()]
    assert got == sorted(want) and len(got) > 1000
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    assert sorted(tuple(r[c] for c in cols) for r in detect.custom_table(df, table).collect()) == got
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_rules_with_shared_parts_meet_few_lines(spark, monkeypatch):
    """Names that differ in a few digits only: each line is searched for its own name's pattern, however many rules there are."""
    from sightline.operators.literals import windows

    assert windows("ab") == [] and {w["size"] for w in windows("x" * 100)} == {32}
    names = [f"Customer#{k:09d}" for k in range(2_000)]
    df = spark.createDataFrame([(k, f"f{k}.py", f'password = "{x}"') for k, x in enumerate(names)], "n int, path string, text string")
    rules = [(f"C-{k}-{j}", f'"(?:test)?{x}"') for k, x in enumerate(names) for j in range(2)]  # each pattern twice
    table = spark.createDataFrame(rules, "id string, pattern string")
    for c in ("title", "severity", "cwe", "owasp"):
        table = table.withColumn(c, F.lit(None).cast("string"))
    table = table.withColumn("score", F.lit(None).cast("int")).withColumn("extensions", F.lit(None).cast("array<string>"))
    searched = []
    inner = detect.risky_search
    monkeypatch.setattr(detect, "risky_search", lambda line, power: inner(line, power) | F.lit(True))  # all pairs go to the worker
    monkeypatch.setattr(detect, "within_time", lambda pairs, seconds: searched.append(pairs.count()) or pairs)
    got = sorted((r.n, r.rule_id) for r in detect.custom_table(df, table).collect())
    assert searched == [2_000]  # before, all pairs that share a run of three digits
    assert got == sorted((k, f"C-{k}-{j}") for k in range(2_000) for j in range(2))
