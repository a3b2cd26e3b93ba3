"""Rule matching over code lines: one finding for each line and rule that fits it.

Patterns are run only where their literals stand. For the built-in rules one automaton of a language's literals reads each
whole text once, and each pattern sees the lines that hold one of its own. Tables of user rules of any size are joined
with lines through windows of their literals. A search that could take long runs in a worker that ends it in time.
"""

from __future__ import annotations

import json
from bisect import bisect_right
from collections.abc import Callable, Iterable, Iterator, Sequence
from itertools import accumulate
from math import log10

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import cwe_name, cwe_owasp, rule_group, score_severity, skipped, split_lines, strip, suffix
from ..schemas import MAX_FILE_BYTES
from ..sources.lineage import written
from .literals import BASE, ENDLESS, fold, folded, growth, held_literals, windows
from .rules import RULES, SCANNERS, Rule, java_pattern

#: What stands between a title and the line's number in a group's descriptions.
WORDING = {"python": " detected on line "} | dict.fromkeys(("java", "cpp", "php", "js", "html", "css"), " on line ")


def code_files(files: DataFrame) -> DataFrame:
    """Files (path, text) of a known language outside skipped directories, with their rule ``group``."""
    return files.where(~skipped(F.col("path"))).withColumn("group", rule_group(F.col("path"))).where(F.col("group").isNotNull())


def lines(files: DataFrame, text_col: str = "text") -> DataFrame:
    """One row per line: the columns of ``files`` without its text, line_no (from 1), line."""
    rest = [c for c in files.columns if c != text_col]
    rows = files.select(*rest, F.posexplode(split_lines(F.coalesce(F.col(text_col), F.lit(""))))).where(F.col("col").isNotNull())
    return rows.select(*rest, (F.col("pos") + 1).alias("line_no"), F.col("col").alias("line"))


def safe_assignment(line: Column) -> Column:
    """Whether a credential is set to what only looks like one: the line names a test or a placeholder."""
    low = F.lower(line)
    # Words of placeholders, and names of credentials.
    return low.rlike("test|example|demo|mock|fake|dummy|placeholder") & low.rlike(r"(?Ud)\b(password|passwd|secret|api[_-]?key|token)\s*=")


def python_code(line: Column) -> Column:
    """A Python line up to its comment; null where no rule may look at it."""
    bare = strip(line)
    # Fixed value: what a line begins with that is all comment or text.
    comment = bare.rlike("""^(#|[rf]?\\"{3}|[rf]?'{3})""")
    return F.when(~comment & ~safe_assignment(line), F.substring_index(line, "#", 1))


#: Languages without rules of their own for what is code, and those of them where // or # begins a comment.
GENERIC = ("go", "ruby", "rust", "csharp", "kotlin", "swift", "shell", "sql")
SLASHES, HASHES = ("go", "rust", "csharp", "kotlin", "swift"), ("go", "ruby", "shell")


def generic_code(line: Column, group: Column | str) -> Column:
    """A line up to its comment for the other languages; null where no rule may look at it."""
    bare, group = strip(line), F.lit(group) if isinstance(group, str) else group
    code = F.when(group.isin(*HASHES) & line.contains("#"), F.substring_index(line, "#", 1))
    code = code.when(group.isin(*SLASHES) & line.contains("//"), F.substring_index(line, "//", 1)).otherwise(bare)
    return F.when((bare != "") & ~bare.startswith("#") & ~bare.startswith("//"), code)


def visible_code(line: Column, group: Column | str) -> Column:
    """What rules see of a line of a group. All groups share few expressions, since the JVM doesn't compile large generated methods."""
    group = F.lit(group) if isinstance(group, str) else group
    return F.when(group == "python", python_code(line)).when(group.isin(*GENERIC), generic_code(line, group)).otherwise(line)


_FACTS = "array<struct<ord:int,rule_id:string,title:string,cwe:string,score:int,scanner:string,wording:string>>"


def valid_rules(spark: SparkSession, rules: Sequence[dict]) -> list[dict]:
    """User rules whose pattern is there, short enough and compiles."""
    compiles = spark._jvm.java.util.regex.Pattern

    def valid(rule: dict) -> bool:
        p = rule.get("pattern") or ""
        try:
            return 0 < len(p) <= MAX_PATTERN and compiles.compile("(?Ud)" + p) is not None
        except Exception:  # the JVM's PatternSyntaxException
            return False

    return [r for r in rules if valid(r)]


def by_group(rules: list[Rule] | None, groups: list[str] | None = None) -> dict[str, list[Rule]]:
    own = {g: [r for r in (RULES if rules is None else rules) if r.group == g] for g in groups or list(SCANNERS)}
    return {g: r for g, r in own.items() if r}


def _findings(found: DataFrame, own: dict[str, list[Rule]], keys: list[str]) -> DataFrame:
    """Findings of rows (keys, group, line) that fit rule number ``_k`` (from 1, over all groups in turn)."""
    table = [
        {"ord": k, "rule_id": r.rule_id, "title": r.title, "cwe": r.cwe, "score": r.score, "scanner": SCANNERS[group], "wording": WORDING.get(group, " (line ")}
        for group, its in own.items()
        for k, r in enumerate(its)
    ]
    rule = F.from_json(F.lit(json.dumps(table)), _FACTS)  # a constant, which the optimizer folds
    hit = F.col("_hit")
    end = F.when(hit["wording"] == " (line ", ").").otherwise(".")
    return found.withColumn("_hit", F.element_at(rule, F.col("_k"))).select(
        *keys,
        "group",
        F.substring(strip(F.col("line")), 1, 300).alias("code"),
        hit["scanner"].alias("scanner"),
        hit["rule_id"].alias("rule_id"),
        hit["title"].alias("title"),
        hit["score"].alias("severity_score"),
        score_severity(hit["score"]).alias("severity"),
        hit["cwe"].alias("cwe"),
        cwe_name(hit["cwe"]).alias("name"),
        cwe_owasp(hit["cwe"]).alias("owasp"),
        F.concat(hit["title"], hit["wording"], F.col("line_no").cast("string"), end).alias("description"),
        hit["ord"].alias("rule_ord"),
    )


def code_of(groups: Iterable[str]) -> Column:
    """What rules see of a row's line, by its group."""
    return F.when(F.col("group").isin(*groups), visible_code(F.col("line"), F.col("group")))


def match(rows: DataFrame, rules: list[Rule] | None = None, groups: list[str] | None = None) -> DataFrame:
    """Findings of lines (path, group, line_no, line, and any keys): all columns plus rule_ord and the finding's.

    One pass over the lines: the line's group picks which rules are tried, all of them on each line. Patterns are
    literals, so each compiles once per task. For whole files :func:`heuristics` tries far fewer.
    """
    keys = [c for c in rows.columns if c not in ("line", "group")]
    own = by_group(rules, groups)
    hits, k = F.array().cast("array<int>"), 0
    for group, its in own.items():
        found = []
        for r in its:
            k += 1
            found.append(F.when(F.col("_code").rlike(java_pattern(r)), F.lit(k)))
        hits = F.when(F.col("group") == group, F.array_compact(F.array(*found))).otherwise(hits)
    df = rows.where(F.col("group").isin(list(own))).withColumn("_code", code_of(own)).where(F.col("_code").isNotNull())
    return _findings(df.withColumn("_k", F.explode(hits)), own, keys)


class LineIndex:
    """Finds the lines of a text that hold literals of rules, by one automaton for each group of rules."""

    def __init__(self, words: dict[str, dict[str, list[int]]], always: dict[str, list[int]]):
        import ahocorasick

        self.always, self.automata = always, {}
        for group, own in words.items():
            self.automata[group] = ahocorasick.Automaton()
            for word, ks in own.items():
                self.automata[group].add_word(word, ks)
            self.automata[group].make_automaton()

    def lines(self, group: str, text: str, low: str) -> Iterator[tuple[int, str, list[int]]]:
        """Number (from 1), line and numbers of rules of each line that may fit some; ``low``: the folded text."""
        hits: dict[int, set[int]] = {}
        parts = None
        for end, ks in self.automata[group].iter(low) if group in self.automata else ():
            if parts is None:
                parts = text.splitlines(keepends=True)
                starts = list(accumulate(map(len, parts), initial=0))
            hits.setdefault(bisect_right(starts, end) - 1, set()).update(ks)
        if group in self.always:
            parts = parts or text.splitlines(keepends=True)
            for line in range(len(parts)):
                hits.setdefault(line, set()).update(self.always[group])
        for line in sorted(hits):
            yield line + 1, parts[line].splitlines()[0], sorted(hits[line])


def rule_words(patterns: dict[str, list[tuple[int, str]]]) -> tuple[dict[str, dict[str, list[int]]], dict[str, list[int]]]:
    """For each group's numbered patterns: numbers by literal, and the numbers of patterns that have none."""
    words: dict[str, dict[str, list[int]]] = {}
    always: dict[str, list[int]] = {}
    for group, its in patterns.items():
        for k, pattern in its:
            held = held_literals(pattern)
            for word in held or ():
                words.setdefault(group, {}).setdefault(word, []).append(k)
            if not held:
                always.setdefault(group, []).append(k)
    return words, always


def numbered(own: dict[str, list[Rule]]) -> dict[str, list[tuple[int, str]]]:
    """The groups' patterns, with numbers from 1 over all groups in turn."""
    k, out = 0, {}
    for group, its in own.items():
        out[group] = [(k + j, r.pattern) for j, r in enumerate(its, 1)]
        k += len(its)
    return out


def candidates(files: DataFrame, rules: list[Rule] | None = None, groups: list[str] | None = None) -> DataFrame:
    """Lines and rules that may fit, of files (path, text, group, and any keys): the columns without text, line_no, line, _k.

    An automaton of a group's literals reads each text once. ``_k``: number of a rule (from 1, over all groups in turn) one of
    whose literals stands on the line; a rule without literals is there for each line. Lines without a candidate never
    leave the worker.
    """
    rest = [c for c in files.columns if c != "text"]
    words, always = rule_words(numbered(by_group(rules, groups)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = LineIndex(words, always)
        for b in batches:
            texts = enumerate(zip(b["group"].to_pylist(), b["text"].to_pylist(), strict=True))
            found = [(at, *hit) for at, (group, text) in texts if text for hit in index.lines(group, text, fold(text))]
            rows, numbers, lines, ks = zip(*found, strict=True) if found else ((), (), (), ())
            kept = b.select(rest).take(pa.array(rows, pa.int32()))
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(numbers, pa.int32()), pa.array(lines, pa.string()), pa.array(ks, pa.list_(pa.int32()))], [*rest, "line_no", "line", "_ks"])

    kinds = [f"`{c}` {files.schema[c].dataType.simpleString()}" for c in rest]
    known = files.where(F.col("group").isin(sorted({*words, *always}))).select(*rest, "text")
    found = known.mapInArrow(run, ", ".join([*kinds, "line_no int, line string, _ks array<int>"]))
    return found.withColumn("_k", F.explode("_ks")).drop("_ks")


def heuristics(files: DataFrame, rules: list[Rule] | None = None) -> DataFrame:
    """Findings of all built-in rules over files (path, text, and any keys); files over 2 MiB have none.

    ``rules``: only these are tried. A pattern runs on the lines that hold one of its literals (:func:`candidates`), so
    the rows are those of :func:`match` over all lines.
    """
    known = code_files(files).where(F.octet_length("text") <= MAX_FILE_BYTES)
    own = by_group(rules)
    rows = candidates(known, rules).withColumn("_code", code_of(own))
    # the pattern is a column, so each row runs its own and the plan stays small; few rows get here
    pattern = F.element_at(F.array(*[F.lit(java_pattern(r)) for its in own.values() for r in its]), F.col("_k"))
    rows = rows.where(F.regexp_like("_code", pattern))
    return _findings(rows, own, [c for c in rows.columns if c not in ("line", "group", "_k", "_code")])


#: User rules: longer patterns are ignored.
MAX_PATTERN = 500


#: Seconds that a search may take; a longer one counts as no match.
TIME_LIMIT = 2.0
#: Steps up to which a search is not watched: a line's length to the power of the pattern's growth.
STEPS = 1e9


def risky_search(line: Column, power: Column | int) -> Column:
    return (power if isinstance(power, Column) else F.lit(power)) * F.log10(F.greatest(F.length(line), F.lit(10))) > float(np.log10(STEPS))


def is_risky(line: str, power: int) -> bool:
    """The same in a worker."""
    return power * log10(max(len(line), 10)) > log10(STEPS)


def timed_search(seconds: float) -> Callable[[str, str], bool]:
    """Searches patterns in lines; one that takes longer than ``seconds`` or that the engine does not know counts as no match."""
    import regex

    known: dict[str, object] = {}

    def found(pattern: str, line: str) -> bool:
        if pattern not in known:
            known.clear() if len(known) > 10_000 else None
            try:
                known[pattern] = regex.compile(pattern)
            except regex.error:
                known[pattern] = None
        try:
            return known[pattern] is not None and known[pattern].search(line, timeout=seconds) is not None
        except TimeoutError:
            return False

    return found


def within_time(pairs: DataFrame, seconds: float = TIME_LIMIT) -> DataFrame:
    """Rows (line, pattern, risky, and any keys) whose pattern is found in the line, or that are not risky.

    Risky pairs are searched in a worker (:func:`timed_search`). Only rows that may be findings get here, so few pass through Python.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = timed_search(seconds)
        for b in batches:
            pairs = zip(b["line"].to_pylist(), b["pattern"].to_pylist(), b["risky"].to_pylist(), strict=True)
            yield b.filter(pa.array([not risky or found(pattern, line) for line, pattern, risky in pairs], pa.bool_()))

    return pairs.mapInArrow(run, pairs.schema)


DEFAULTS = {"title": "Custom Finding", "severity": "Medium", "severity_score": 5, "cwe": "CWE-Misc", "owasp": "Other"}


def name_end(path: Column) -> Column:
    """The suffix of a path's file name as it is written."""
    return F.regexp_extract(F.element_at(F.split(path, "/"), -1), r"^.*[^.].*?(\.[^.]+)$", 1)


def _user_findings(found: DataFrame, keys: list[str]) -> DataFrame:
    own = [F.coalesce(F.nullif(F.col(f"_rule.{n}"), F.lit("")) if isinstance(v, str) else F.col(f"_rule.{n}"), F.lit(v)).alias(n) for n, v in DEFAULTS.items()]
    code = F.substring(strip(F.col("line")), 1, 300).alias("code")
    return found.select(*keys, code, F.lit("custom-rules").alias("scanner"), F.col("_rule.rule_id").alias("rule_id"), *own, F.col("_rule.ord").alias("rule_ord"))


def custom(files: DataFrame, rules: list[dict], max_line: int | None = None, seconds: float = TIME_LIMIT) -> DataFrame:
    """Findings of user rules (id, title, pattern, severity, extensions, score, cwe, owasp) over files (path, text, keys).

    A rule whose pattern is missing, too long or does not compile is ignored. ``extensions`` is compared as
    written; without it a rule looks at every file. The score does not follow from the severity. Lines of any length are
    searched, unless ``max_line`` leaves out longer ones; a search that takes longer than ``seconds`` counts as no match.
    Rules are part of the plan; for many of them see :func:`custom_table`.
    """
    rows = lines(files)
    keys = [c for c in rows.columns if c != "line"]
    own = valid_rules(files.sparkSession, rules)
    facts = [{"ord": k, "rule_id": r["id"], "pattern": r["pattern"], "severity_score": None if r.get("score") is None else int(r["score"]), **{n: r.get(n) for n in ("title", "severity", "cwe", "owasp")}} for k, r in enumerate(own)]
    line, hits = F.col("line"), []
    for k, r in enumerate(own):
        p, words = r["pattern"], held_literals(r["pattern"])
        may = F.lit(True)
        if words:  # a cheap test that keeps searches few
            low = folded(line)
            may = F.contains(low, F.lit(words[0]))
            for w in words[1:]:
                may = may | F.contains(low, F.lit(w))
        if r.get("extensions"):
            may = name_end(F.col("path")).isin(list(r["extensions"])) & may
        risky = F.lit(True) if growth(p) == ENDLESS else risky_search(line, growth(p))
        hits.append(F.when(may & (risky | line.rlike("(?Ud)" + p)), F.struct(F.lit(k + 1).alias("k"), risky.alias("risky"))))
    if max_line is not None:
        rows = rows.where(F.length("line") <= max_line)
    hits = F.array_compact(F.array(*hits)) if hits else F.array().cast("array<struct<k:int,risky:boolean>>")
    rule = F.from_json(F.lit(json.dumps(facts)), "array<struct<ord:int,rule_id:string,pattern:string,title:string,severity:string,severity_score:int,cwe:string,owasp:string>>")
    found = rows.withColumn("_h", F.explode(hits)).withColumn("_rule", F.element_at(rule, F.col("_h.k")))
    if any(growth(r["pattern"]) > 1 for r in own):
        found = within_time(found.select(*keys, "line", "_rule", F.col("_rule.pattern").alias("pattern"), F.col("_h.risky").alias("risky")), seconds)
    return _user_findings(found, keys)


def pattern_windows(rules: DataFrame) -> DataFrame:
    """(pattern, windows, power) for each distinct pattern of rules that runs: missing, too long and broken ones are left out.

    ``windows``: for each of the literals of which a match holds one, the windows that may stand for it; null where the pattern tells no
    such literals of three characters. ``power``: see :func:`sightline.operators.literals.growth`.
    """
    usable = F.length("pattern").between(1, MAX_PATTERN) & F.expr("try_reflect('java.util.regex.Pattern', 'compile', concat('(?Ud)', pattern))").isNotNull()
    kind = pa.list_(pa.list_(pa.struct([("key", pa.int64()), ("run", pa.int32()), ("size", pa.int32())])))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found, power = [], []
            for p in b["pattern"].to_pylist():
                own = [windows(w) for w in held_literals(p) or ("",)]
                found.append(own if all(own) else None)
                power.append(growth(p))
            yield pa.RecordBatch.from_arrays([b["pattern"], pa.array(found, kind), pa.array(power, pa.int32())], ["pattern", "windows", "power"])

    return rules.select("pattern").distinct().where(usable).mapInArrow(run, "pattern string, windows array<array<struct<key:bigint,run:int,size:int>>>, power int")


def pattern_keys(patterns: DataFrame) -> DataFrame:
    """(pattern, power, keys, key, run, size) of :func:`pattern_windows`: a row for each of a pattern's keys.

    Of a literal's windows the one that the fewest literals of the table hold stands for it, so literals that share long parts are told
    apart by the rest. A pattern without windows has -1 alone.
    """
    each = patterns.select("pattern", F.posexplode("windows").alias("_literal", "_own")).select("pattern", "_literal", F.posexplode("_own").alias("_at", "_w"))
    each = each.select("pattern", "_literal", "_at", "_w.*")
    shared = each.groupBy("key").agg(F.count("*").alias("_n"))
    chosen = each.join(shared, "key").groupBy("pattern", "_literal").agg(F.min(F.struct("_n", "_at", "key", "run", "size")).alias("_w"))
    chosen = chosen.groupBy("pattern").agg(F.collect_set(F.struct("_w.key", "_w.run", "_w.size")).alias("_posts"))
    none = F.array(F.struct(F.lit(-1).cast("bigint").alias("key"), F.lit(-1).alias("run"), F.lit(0).alias("size")))
    posts = patterns.select("pattern", "power").join(chosen, "pattern", "left").withColumn("_posts", F.coalesce("_posts", none))
    return posts.select("pattern", "power", F.col("_posts.key").alias("keys"), F.inline("_posts"))


def run_bits(posts: DataFrame) -> bytes:
    """A bit for each of the 2 ** 24 three-byte runs, set where the column ``run`` has it: 2 MB however many rows there are."""
    rows = posts.where("run >= 0").groupBy(F.floor(F.col("run") / 32768).cast("int").alias("b")).agg(F.bitmap_construct_agg(F.col("run") % 32768).alias("bits"))
    out = bytearray(1 << 21)
    for r in rows.toLocalIterator():  # 512 rows of 4 KB at most
        out[r.b * 4096 : r.b * 4096 + len(r.bits)] = r.bits
    return bytes(out)


def lines_with_keys(files: DataFrame, bits: bytes, sizes: Sequence[int], every_line: bool) -> DataFrame:
    """Lines of files (path, text, and any keys) that hold a run whose bit is set: the keys, line_no, line, _found (distinct).

    ``_found``: keys of the windows of each of ``sizes`` that begin with such a run. With ``every_line`` each line is there, and
    has -1 among them.
    """
    rest = [c for c in files.columns if c != "text"]
    shared = files.sparkSession.sparkContext.broadcast(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = np.unpackbits(np.frombuffer(shared.value, np.uint8), bitorder="little").view(bool)
        for b in batches:
            rows, numbers, lines_, found = [], [], [], []
            for at, text in enumerate(b["text"].to_pylist()):
                parts = text.splitlines(keepends=True) if text else []
                low = [fold(x).encode() for x in parts]
                data = np.frombuffer(b"".join(low), np.uint8)
                runs = data.astype(np.int32)
                place = np.flatnonzero(wanted[runs[:-2] << 16 | runs[1:-1] << 8 | runs[2:]]) if len(data) > 2 else np.empty(0, np.int64)
                line = np.searchsorted(np.cumsum([len(x) for x in low]), place, "right")
                own: dict[int, set[int]] = {k: {-1} for k in range(len(parts))} if every_line else {}
                key = np.zeros(len(place), np.uint64)
                for n in range(max(sizes, default=0) if len(place) else 0):
                    inside = int(np.searchsorted(place, len(data) - n))  # places are in order, so those that end in time come first
                    place, line, key = place[:inside], line[:inside], key[:inside]
                    key = key * np.uint64(BASE) + (data[place + n].astype(np.uint64) + np.uint64(1))
                    if n + 1 in sizes:
                        for k, x in zip(line.tolist(), (key >> np.uint64(1)).tolist(), strict=True):
                            own.setdefault(k, set()).add(x)
                rows += [at] * len(own)
                numbers += [k + 1 for k in own]
                lines_ += [parts[k].splitlines()[0] for k in own]
                found += map(list, own.values())
            kept = b.select(rest).take(pa.array(rows, pa.int32()))
            yield pa.RecordBatch.from_arrays(
                [*kept.columns, pa.array(numbers, pa.int32()), pa.array(lines_, pa.string()), pa.array(found, pa.list_(pa.int64()))], [*rest, "line_no", "line", "_found"]
            )

    kinds = [f"`{c}` {files.schema[c].dataType.simpleString()}" for c in rest]
    return files.select(*rest, "text").mapInArrow(run, ", ".join([*kinds, "line_no int, line string, _found array<bigint>"]))


def custom_table(files: DataFrame, rules: DataFrame, seconds: float = TIME_LIMIT) -> DataFrame:
    """The findings of :func:`custom` for a table of rules of any size (``rule_files.SCHEMA``); rules never come to the driver.

    A join through windows of literals (:func:`pattern_keys`) pairs lines with distinct patterns that may fit; pairs are verified with the
    pattern as a column, and those that fit meet the rules that have the pattern. Patterns that tell no run of three characters are
    tried on every line. Whether a side is broadcast is Spark's choice by its size. A line and a pattern meet once, by the first of
    the pattern's keys that the line has. rule_ord is 0.
    """
    keys = [c for c in files.columns if c != "text"] + ["line_no"]
    posts = written(pattern_keys(written(pattern_windows(rules))))  # patterns are read once
    sizes = [r["size"] for r in posts.where("size > 0").select("size").distinct().toLocalIterator()]  # a few at most
    rows = lines_with_keys(files, run_bits(posts), sizes, not posts.where("run < 0").isEmpty())
    posts = posts.select(F.col("key").alias("_key"), F.col("keys").alias("_keys"), "pattern", F.col("power").alias("_power"))
    pairs = rows.withColumn("_key", F.explode("_found")).join(posts, "_key")
    first = F.get(F.filter("_keys", lambda k: F.array_contains("_found", k)), F.lit(0)) == F.col("_key")
    pairs = pairs.where(first).withColumn("risky", risky_search(F.col("line"), F.col("_power")))
    pairs = pairs.where(F.when(F.col("risky"), True).otherwise(F.regexp_like("line", F.concat(F.lit("(?Ud)"), "pattern"))))
    pairs = within_time(pairs.select(*keys, "line", "pattern", "risky"), seconds)
    rule = F.struct(F.lit(0).alias("ord"), F.col("id").alias("rule_id"), "title", "severity", F.col("score").alias("severity_score"), "cwe", "owasp").alias("_rule")
    found = pairs.join(rules.select("pattern", F.col("extensions").alias("_ends"), rule), "pattern")
    end = F.coalesce(F.size("_ends") <= 0, F.lit(True)) | F.array_contains("_ends", name_end(F.col("path")))
    return _user_findings(found.where(end), keys)


__all__ = ["candidates", "code_files", "custom", "custom_table", "heuristics", "lines", "match", "suffix", "visible_code", "within_time"]
