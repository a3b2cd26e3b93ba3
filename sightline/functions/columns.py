"""Column functions: labels, paths, dates, numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schemas import CWE_CATALOG, CWE_DEFAULT, LANGUAGES, PENALTY, SEVERITIES, SKIP_DIRS, WEB_GROUPS

#: What ends a line for ``splitlines``.
LINE_ENDS = "\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]"


def strip(c: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def split_lines(text: Column) -> Column:
    """The lines of a text; an end of line at the very end starts no further line, an empty text has none."""
    parts = F.split(text, LINE_ENDS)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def choose(key: Column, values: dict, default=None) -> Column:
    """Looks a key up in a small fixed table."""
    pairs = [F.lit(x) for kv in values.items() for x in kv]
    found = F.element_at(F.create_map(*pairs), key)
    return found if default is None else F.coalesce(found, F.lit(default))


def score_severity(score: Column) -> Column:
    return F.when(score >= 9, "Critical").when(score >= 7, "High").when(score >= 4, "Medium").otherwise("Low")


def severity_of(label: Column, score: Column) -> Column:
    """A label in any case and spacing, else what the score says, else Informational."""
    known = choose(F.lower(strip(label)), {s.lower(): s for s in SEVERITIES})
    return F.coalesce(known, F.when(score.isNotNull(), score_severity(score)), F.lit("Informational"))


def severity_rank(label: Column) -> Column:
    return choose(label, {s: k for k, s in enumerate(SEVERITIES)}, len(SEVERITIES))


def penalty(label: Column) -> Column:
    return choose(label, PENALTY, 2)


def security_score(total_penalty: Column, files: Column) -> Column:
    """100 less the scaled penalty, at least 0; halves are rounded to even. Two to nine files scale it up."""
    scale = F.when(files <= 1, F.lit(1.0)).otherwise(F.greatest(F.lit(0.4), F.lit(10.0) / files))
    return F.greatest(F.lit(0), F.lit(100) - F.bround(total_penalty * scale).cast("int"))


def grade(score: Column) -> Column:
    out = F.lit("F (Critical)")
    for at, name in ((30, "D (High Risk)"), (50, "C (At Risk)"), (70, "B (Acceptable)"), (80, "A (Good)"), (90, "A+ (Secure)")):
        out = F.when(score >= at, name).otherwise(out)
    return out


def grade_letter(score: Column) -> Column:
    out, s = F.lit("F"), F.greatest(F.lit(0), F.least(F.lit(100), score))
    for at, name in ((30, "D"), (50, "C"), (70, "B"), (80, "A"), (90, "A+")):
        out = F.when(s >= at, name).otherwise(out)
    return out


# What a grade letter says.
GRADE_BANDS = {
    "A+": "Strong posture",
    "A": "Strong posture",
    "B": "Generally sound, targeted improvements required",
    "C": "Elevated risk, structured remediation needed",
    "D": "High risk, prompt remediation required",
    "F": "Severe risk, immediate action required",
}


def grade_band(letter: Column) -> Column:
    return choose(letter, GRADE_BANDS)


def cwe_name(cwe: Column) -> Column:
    return choose(cwe, {k: v[0] for k, v in CWE_CATALOG.items()}, CWE_DEFAULT[0])


def cwe_owasp(cwe: Column) -> Column:
    return choose(cwe, {k: v[1] for k, v in CWE_CATALOG.items()}, CWE_DEFAULT[1])


def cwe_family(cwe: Column) -> Column:
    """CWE and the first number in the id, without leading zeros; empty without a number."""
    n = F.regexp_extract(F.coalesce(cwe, F.lit("")), r"(\d+)", 1)
    return F.when(n == "", "").otherwise(F.concat(F.lit("CWE-"), n.cast("bigint").cast("string")))


def safe_int(value: Column, default: int, low: int, high: int) -> Column:
    """A whole number written in text, clamped; anything else is the default."""
    v = strip(value.cast("string"))
    n = F.when(v.rlike(r"^[+-]?\d{1,18}$"), v.try_cast("bigint"))
    return F.when(n.isNull(), F.lit(default)).otherwise(F.greatest(F.lit(low), F.least(F.lit(high), n)))


def parse_time(value: Column) -> Column:
    """An ISO time or date as a UTC timestamp, whatever its zone; null where it is none."""
    v = strip(value)
    return F.coalesce(
        F.when(v.rlike(r"^\d{4}-\d\d-\d\d([T ]\d\d:\d\d(:\d\d(\.\d{1,6})?)?(Z|[+-]\d\d:?\d\d)?)?$"), v.try_cast("timestamp")),
        F.try_to_timestamp(F.when(v.rlike(r"^\d{4}-\d\d-\d\d[T ]\d\d:\d\d:\d\d"), F.replace(F.substring(v, 1, 19), F.lit("T"), F.lit(" "))), F.lit("yyyy-MM-dd HH:mm:ss")),
    )


def format_time(value: Column) -> Column:
    return F.coalesce(F.concat(F.date_format(value, "yyyy-MM-dd HH:mm"), F.lit(" UTC")), F.lit("Not available"))


def location(file: Column, line: Column, unknown: str = "unknown location") -> Column:
    f = F.when(F.coalesce(file, F.lit("")) == "", F.lit(unknown)).otherwise(file)
    return F.when(F.coalesce(line, F.lit(0)) != 0, F.concat(f, F.lit(":"), line.cast("string"))).otherwise(f)


def short_location(file: Column, line: Column) -> Column:
    """Only the file's name where the path is longer than 34 characters."""
    name = F.when((F.length(file) > 34) & file.rlike(r"[\\/]"), F.element_at(F.split(file, r"[\\/]"), -1)).otherwise(file)
    return location(name, line, "unknown")


def suffix(path: Column) -> Column:
    """The lower-cased suffix of a path's file name; names that only start with a dot have none."""
    name = F.element_at(F.split(path, "/"), -1)
    return F.lower(F.regexp_extract(name, r"^.*[^.].*?(\.[^.]+)$", 1))


def language(path: Column) -> Column:
    return choose(suffix(path), {s: lang for lang, names in LANGUAGES.items() for s in names})


def rule_group(path: Column) -> Column:
    """Rule group of a file: its language, or for web files the group of the suffix."""
    web = choose(suffix(path), {s: g for g, names in WEB_GROUPS.items() for s in names})
    return F.coalesce(web, language(path))


def skipped(path: Column) -> Column:
    """Whether a directory above the file is one that is never read."""
    parts = F.split(F.lower(path), "/")
    return F.arrays_overlap(F.slice(parts, 1, F.size(parts) - 1), F.array(*[F.lit(d) for d in SKIP_DIRS]))


def bare_host(target: Column) -> Column:
    """Host of a target, without scheme, path and port."""
    return F.regexp_replace(F.regexp_replace(strip(target), r"(?i)^https?://", ""), r"[/:].*$", "")


def banner_version(banner: Column) -> tuple[Column, Column]:
    """(product, version) of the first pattern that a service banner holds."""
    # Products and their version patterns, in order.
    patterns = {
        "OpenSSH": r"OpenSSH[_-](\d+\.\d+)",
        "Apache": r"Apache[/ ](\d\.\d+)",
        "nginx": r"nginx/(\d+\.\d+)",
        "OpenSSL": r"(?:OpenSSL|openssl)/(\d+\.\d+[\.\d]*)",
        "MySQL": r"MySQL[/ ](\d+\.\d+)",
        "vsftpd": r"vsftpd (\d+\.\d+)",
    }
    product, version = F.lit(None).cast("string"), F.lit(None).cast("string")
    for name, p in reversed(patterns.items()):
        product = F.when(banner.rlike(p), name).otherwise(product)
        version = F.when(banner.rlike(p), F.regexp_extract(banner, p, 1)).otherwise(version)
    return product, version


def outdated(product: Column, version: Column) -> Column:
    """Whether the version without its last part is under the product's first sound one."""
    major = F.regexp_replace(version, r"\.[^.]*$", "").try_cast("double")
    # First sound versions.
    least = choose(product, {"OpenSSH": 8.0, "Apache": 2.4, "OpenSSL": 3.0, "nginx": 1.18})
    return F.coalesce(major < least, F.lit(False))


# Networks that are never a target.
BLOCKED_NETS = (("127.0.0.0", 8), ("10.0.0.0", 8), ("172.16.0.0", 12), ("192.168.0.0", 16), ("169.254.0.0", 16))


def ipv4_number(address: Column) -> Column:
    """A dotted address as a number; null where it is none."""
    ok = address.rlike(r"^(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)(?:\.(?!$)|$)){4}$")
    p = F.split(address, r"\.")
    n = sum((F.element_at(p, k + 1).try_cast("bigint") * (1 << (24 - 8 * k)) for k in range(4)), F.lit(0).cast("bigint"))
    return F.when(ok, n)


def allowed_target(target: Column) -> Column:
    """Not empty, at most 253 characters, without shell characters, and in no blocked network."""
    host = strip(F.coalesce(target, F.lit("")))
    n = ipv4_number(host)
    blocked = F.lit(False)
    for base, bits in BLOCKED_NETS:
        low = sum(int(x) << (24 - 8 * k) for k, x in enumerate(base.split(".")))
        blocked = blocked | n.between(low, low + (1 << (32 - bits)) - 1)
    six = (host == "::1") | F.lower(host).rlike("^f[cd][0-9a-f]{2}:")
    return (host != "") & (F.length(host) <= 253) & ~host.rlike(r"[;&|`$<>(){}\[\]!\\'\"\s]") & ~F.coalesce(blocked, F.lit(False)) & ~six


def allowed_path(path: Column, roots: list[str], blocked: list[str] = ()) -> Column:
    """Under an allowed root, without a ``..`` part, and under no blocked directory."""

    def under(root: str) -> Column:
        r = root.rstrip("/")
        return (path == r) | path.startswith(r + "/")

    ok, bad = F.lit(False), F.lit(False)
    for r in roots:
        ok = ok | under(r)
    for r in blocked:
        bad = bad | under(r)
    return ok & ~bad & ~F.array_contains(F.split(path, r"[\\/]"), "..")
