"""Cleaning and redaction of evidence text, in Arrow batches (Spark has neither NFKC nor masks by length)."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

# What a secret looks like, and which group of the pattern is the secret; in this order.
SECRETS = (
    (r"\b((?:AKIA|ASIA)[0-9A-Z]{16})\b", 1),
    (r"\b(glpat-[0-9A-Za-z_\-]{8,})\b", 1),
    (r"\b(sk-[A-Za-z0-9_-]{12,})\b", 1),
    (r"\b(gh[pousr]_[A-Za-z0-9]{20,})\b", 1),
    (r"\b(xox[baprs]-[A-Za-z0-9\-]{10,})\b", 1),
    (r"\b(eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{5,})\b", 1),
    (r"(-----BEGIN [A-Z ]*PRIVATE KEY-----)[\s\S]*?(-----END [A-Z ]*PRIVATE KEY-----)", 0),
    (r"([a-zA-Z][a-zA-Z0-9+.-]*://[^\s/:@]+:)([^\s/@]{3,})(@)", 2),
    (r"(?i)((?:api[_-]?key|apikey|access[_-]?key|secret[_-]?(?:key)?|auth[_-]?token|token|passwd|password|pwd|client[_-]?secret)\s*[:=]\s*[\"']?)([^\s\"',;)]{6,})", 2),
    (r"(?i)\b(bearer\s+)([A-Za-z0-9._+\-/]{10,})", 2),
)
BLOCK = "█"
_COMPILED = [(re.compile(p), g) for p, g in SECRETS]


def mask(secret: str) -> str:
    """All of a short secret; of a longer one all but four characters at the start and two at the end."""
    if len(secret) <= 8:
        return BLOCK * max(len(secret), 4)
    return secret[:4] + BLOCK * min(max(len(secret) - 6, 4), 24) + secret[-2:]


def redact(text: str) -> str:
    for pattern, group in _COMPILED:

        def masked(m: re.Match, g: int = group) -> str:
            if not m[g]:
                return m[0]
            a, b = m.start(g) - m.start(), m.end(g) - m.start()
            return m[0][:a] + mask(m[g]) + m[0][b:]

        text = pattern.sub(masked, text)
    return text


def clean_text(text: str | None, most: int | None = None) -> str:
    """Normalized, without control characters and secrets, tidied, and cut at ``most`` characters."""
    if text is None:
        return ""
    out = "".join(c for c in unicodedata.normalize("NFKC", text) if c in "\n\t" or ord(c) >= 32)
    out = re.sub(r"\n{4,}", "\n\n\n", re.sub(r"[ \t]+\n", "\n", redact(out)))
    if most is not None and len(out) > most:
        out = out[:most].rstrip() + " …"
    return out.strip()


def clean(text: Column, most: int | None = None) -> Column:
    @pandas_udf("string")
    def run(values: pd.Series) -> pd.Series:
        return values.map(lambda v: clean_text(v if isinstance(v, str) else None, most))

    return run(text)


def has_secret(text: Column) -> Column:
    """Whether any pattern fits; stays in the JVM."""
    out = F.lit(False)
    for p, _ in SECRETS:
        out = out | F.coalesce(text.rlike("(?Ud)" + p), F.lit(False))
    return out


def code_excerpt(code: Column, lines: int = 14, width: int = 110) -> Column:
    """struct(lines, omitted) of cleaned code: tabs as four blanks, long lines and long excerpts cut."""
    from .columns import split_lines

    all_lines = split_lines(code)
    cut = F.transform(F.slice(all_lines, 1, lines), lambda x: F.replace(x, F.lit("\t"), F.lit("    ")))
    cut = F.transform(cut, lambda x: F.when(F.length(x) > width, F.concat(F.substring(x, 1, width - 1), F.lit("…"))).otherwise(x))
    return F.struct(cut.alias("lines"), F.greatest(F.size(all_lines) - lines, F.lit(0)).alias("omitted"))
