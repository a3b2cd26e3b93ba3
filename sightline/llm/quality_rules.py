"""Quality rules as a short-circuit cascade, in DataFrame functions only.

Each rule is a named reject condition that computes its own statistic of the text, and states what that costs for a row:
the characters it reads. One aggregation over a sample of raw texts gives each rule's mean cost and share of rejections,
rules are ordered by rejection per cost, and the verdict is one nested CASE: a rule is evaluated only for rows that
every earlier rule passed. The verdict is the same in any order. No clock is read, so a busy cluster changes nothing.

``judge`` returns the base statistics of every row, so these are computed for all; only the other rules wait for
the base ones and for each other. ``keep_good`` computes nothing for a row that an earlier rule rejects: the text of
such rows is nulled before the one statistic that takes several steps, the repeated words.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WHITE, without

SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class Rule:
    """``reject``: a boolean column over the text and its number of words; null counts as no rejection.

    ``cost``: a column with the steps that a row takes, about one for each character read; one step where it is not given.
    """

    name: str
    reject: Column
    cost: Column | None = None


def words(text: Column) -> Column:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a text; null or blank texts have none."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(WHITE))
    return F.array_remove(F.split(trimmed, r"[\x20\x09-\x0D]+"), "")


def count_of(text: Column, chars: str) -> Column:
    """How many characters of the text are among ``chars``."""
    return F.regexp_count(text, F.lit(f"[{chars}]"))


#: A window's start takes so many low bits beside its hash; texts with more words keep both in full.
START_BITS = 22


def _repeated(df: DataFrame, hashes: str, out: str, window: int = 5) -> DataFrame:
    """Adds how many words lie in windows whose hash occurs twice or more; ``hashes``: of all windows, by start.

    Only texts with a repeat are worked on. Windows sorted by (high bits, start) lie in one run with their
    equals; the runs of two or more are sorted by (hash, start), where equals lie beside each other. The starts
    of those, sorted again, cover ``min(window, gap to the next start)`` words each. The steps are columns of
    their own, so that each is evaluated once.
    """
    h, mask = F.col(hashes), (1 << START_BITS) - 1
    df = df.withColumn("_dup", F.size(F.array_distinct(h)) < F.size(h))
    packed = F.transform(h, lambda x, i: x.bitwiseAND(F.lit(~mask)).bitwiseOR(i.cast("bigint")))
    df = df.withColumn("_sorted", F.when(F.col("_dup") & (F.size(h) <= mask), F.sort_array(packed)))

    def start(p: Column) -> Column:
        return p.bitwiseAND(F.lit(mask))

    def beside(p: Column, i: Column) -> Column:
        # equal high bits only make a candidate; the full hashes decide below
        near = [F.get("_sorted", i + k) for k in (-1, 1)]
        same = [F.coalesce(x.bitwiseAND(F.lit(~mask)) == p.bitwiseAND(F.lit(~mask)), F.lit(False)) for x in near]
        return same[0] | same[1]

    short = F.transform(F.filter("_sorted", beside), lambda p: F.struct(F.get(h, start(p).cast("int")).alias("h"), start(p).alias("i")))
    full = F.transform(h, lambda x, i: F.struct(x.alias("h"), i.cast("bigint").alias("i")))
    df = df.withColumn("_pairs", F.sort_array(F.when(F.col("_sorted").isNotNull(), short).when(F.col("_dup"), full)))
    pair = [lambda x, i, k=k: F.coalesce(F.get("_pairs", i + k)["h"] == x["h"], F.lit(False)) for k in (-1, 1)]
    df = df.withColumn("_starts", F.sort_array(F.transform(F.filter("_pairs", lambda x, i: pair[0](x, i) | pair[1](x, i)), lambda x: x["i"])))
    reach = F.transform("_starts", lambda s, i: F.least(F.coalesce(F.get("_starts", i + 1), s + window) - s, F.lit(window)))
    covered = F.aggregate(reach, F.lit(0).cast("bigint"), lambda total, x: total + x)
    return df.withColumn(out, F.when(F.col("_dup"), covered).otherwise(F.lit(0).cast("bigint"))).drop("_dup", "_sorted", "_pairs", "_starts")


STATISTICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def statistics(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long), over whole texts.

    Null and empty texts have zeros. Windows of five words are compared by 64-bit hash. Input columns of
    the same names are replaced; all others pass through.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    df = without(docs, *STATISTICS, "_words", "_hash", "_lines", "_dup", "_sorted", "_pairs", "_starts")
    kept = df.columns
    df = df.withColumn("_words", words(F.col(text_col)))
    n = F.size("_words")
    five = F.arrays_zip(*[F.slice("_words", k + 1, F.greatest(n - 4, F.lit(0))).alias(f"w{k}") for k in range(5)])
    df = df.select(
        *kept,
        n.cast("bigint").alias("n_words"),
        F.length(F.array_join("_words", "")).cast("bigint").alias("word_chars"),
        F.transform(five, lambda w: F.xxhash64(*[w[f"w{k}"] for k in range(5)])).alias("_hash"),
    )
    df = _repeated(df, "_hash", "n_repeat_words")
    df = df.withColumn("_lines", F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(WHITE)) != ""))
    return df.select(
        *kept,
        "n_words",
        "word_chars",
        count_of(text, SYMBOLS).cast("bigint").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("bigint").alias("n_dup_lines"),
        "n_repeat_words",
    )


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


#: Patterns of the rules: a word, capital letters, no letter, ends of sentences, lines that begin as items or end in an ellipsis.
WORD = r"[^\x20\x09-\x0D]+"
CAPITAL, NO_LETTER, STOP = r"\p{Lu}", r"[^\p{L}\p{M}]", "[.!?\u2026\u3002\uff01\uff1f]"
ITEM, ELLIPSIS = r"^[ \t]*[-*\u2022]", r"(?:\.\.\.|\u2026)[ \t]*$"
REPEATS = "repeated_words"


def default_rules(text_col: str = "text", n: Column | None = None) -> list[Rule]:
    """Rules beyond the base ones; each states a fixed share, so a verdict never depends on other rows.

    ``n``: the number of words; then each rule computes what else it needs. Without it the columns of
    :func:`statistics` are there and are used.
    """
    text, known = F.coalesce(F.col(text_col), F.lit("")), n is None
    n = F.col("n_words") if known else n

    def hits(pattern: str) -> Column:
        return F.regexp_count(text, F.lit(pattern))

    lines = F.size(F.split(text, "\n"))
    filled = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(WHITE)) != "")
    chars = F.col("word_chars") if known else F.length(text) - hits(r"[\x20\x09-\x0D]")
    symbols = F.col("n_symbols") if known else count_of(text, SYMBOLS)
    repeated = F.col("n_dup_lines") if known else F.size(filled) - F.size(F.array_distinct(filled))
    one, read = F.lit(1), F.length(text) + 1  # a look at a statistic, a pass over the text
    held = one if known else read
    return [
        Rule("symbols", 10 * symbols > n, held),
        Rule("word_lengths", F.abs(chars - 11 * n) > 9 * n, held),  # under 2 or over 20 characters a word
        Rule("duplicate_lines", 2 * repeated > lines, read if known else 5 * read),  # split, trimmed, compared
        Rule("exclamations", 2 * count_of(text, "!") > n, read),
        Rule("capitals", 10 * hits(CAPITAL) > 3 * F.length(text), read),
        Rule("few_letters", 20 * hits(NO_LETTER) > 9 * F.length(text), read),
        Rule("no_sentences", 200 * hits(STOP) < n, read),
        Rule("item_lines", 10 * hits("(?md)" + ITEM) > 9 * lines, 2 * read),
        Rule("ellipsis_lines", 10 * hits("(?md)" + ELLIPSIS) > 3 * lines, 2 * read),
    ]


#: Share of the rows that the order of rules is estimated on. Nothing of them is gathered but two sums for each rule.
SHARE = 0.01


def sampled(docs: DataFrame, share: float, seed: int = 7) -> DataFrame:
    return docs.sample(withReplacement=False, fraction=min(1.0, share), seed=seed)


def order_rules(sample: DataFrame, rules: list[Rule]) -> list[Rule]:
    """Rules by rejection per cost, both means over ``sample``, in one aggregation that sends one row to the driver.

    The sample only sets the order of evaluation. On an empty sample the given order stays, as it does among equals.
    """
    sums = [F.sum(F.lit(1) if r.cost is None else r.cost).alias(f"c{k}") for k, r in enumerate(rules)]
    hits = [F.count_if(F.coalesce(r.reject, F.lit(False))).alias(f"r{k}") for k, r in enumerate(rules)]
    row = sample.agg(F.count(F.lit(1)).alias("n"), *sums, *hits).first()
    if not row["n"]:
        return rules
    place = {r.name: row[f"r{k}"] / max(row[f"c{k}"] or 0, 1) for k, r in enumerate(rules)}
    return sorted(rules, key=lambda r: -place[r.name])


def verdict(rules: list[Rule]) -> Column:
    """Name of the first rule that rejects, else null; later rules are not evaluated for that row."""
    out = F.lit(None).cast("string")
    for rule in reversed(rules):
        out = F.when(F.coalesce(rule.reject, F.lit(False)), F.lit(rule.name)).otherwise(out)
    return out


def _barred(keep: Column) -> Column:
    """``keep`` as a column to filter on, which Spark cannot push below the columns it is made of: the row's number in it
    bars that. Pushed down, each of those columns would be computed once for each of its uses.
    """
    return keep & (F.monotonically_increasing_id() >= 0)


def _word_count(text_col: str) -> Column:
    return F.regexp_count(F.coalesce(F.col(text_col), F.lit("")), F.lit(WORD)).cast("bigint")


def judge(docs: DataFrame, text_col: str = "text", share: float = SHARE) -> DataFrame:
    """``docs`` with the statistics, base_failed and kept.

    kept is false where base_failed, else where no rule of the cascade rejects. Null and empty texts fail
    the base rules. Repeated rows are judged one by one; an empty table gives an empty table.
    """
    df = without(docs, "base_failed", "kept")
    sample = statistics(sampled(df.select(F.col(text_col).alias("text")), share))
    order = [r.name for r in order_rules(sample, default_rules())]
    rules = {r.name: r for r in default_rules(text_col)}
    stats = statistics(df, text_col)
    kept = F.when(base_failed(), F.lit(False)).otherwise(verdict([rules[k] for k in order]).isNull())
    return stats.withColumn("base_failed", base_failed()).withColumn("kept", _barred(kept))


def repeated_words(docs: DataFrame, text_col: str, out: str) -> DataFrame:
    """``docs`` with the number of words in windows of five found twice or more; null where the text is null."""
    names = docs.columns
    df = docs.withColumn("_words", F.when(F.col(text_col).isNotNull(), words(F.col(text_col))))
    five = F.arrays_zip(*[F.slice("_words", k + 1, F.greatest(F.size("_words") - 4, F.lit(0))).alias(f"w{k}") for k in range(5)])
    df = df.select(*names, F.transform(five, lambda w: F.xxhash64(*[w[f"w{k}"] for k in range(5)])).alias("_hash"))
    return _repeated(df, "_hash", "_repeats").select(*names, F.when(F.col("_hash").isNotNull(), F.col("_repeats")).alias(out))


def keep_good(docs: DataFrame, text_col: str = "text", share: float = SHARE, order: list[str] | None = None) -> DataFrame:
    """The rows of ``docs`` that :func:`judge` keeps, with the columns of ``docs``.

    ``order``: names of all rules in the order of evaluation, instead of the estimated one. Null and empty texts go;
    repeated rows are judged one by one; an empty table gives an empty table.
    """

    def cheap(n: Column, text: str) -> list[Rule]:
        return [Rule("few_words", n < 10), *default_rules(text, n)]

    if order is None:
        sample = sampled(docs.select(F.col(text_col).alias("text")), share).withColumn("n_words", _word_count("text"))
        sample = repeated_words(sample, "text", "n_repeat_words")
        size = F.length(F.coalesce("text", F.lit(""))) + 1  # split into words, five of them hashed for each window, hashes sorted
        repeats = Rule(REPEATS, 100 * F.col("n_repeat_words") > 20 * F.col("n_words"), 10 * size)
        order = [r.name for r in order_rules(sample, [*cheap(F.col("n_words"), "text"), repeats])]
    own = docs.select(*[F.col(c).alias(f"_c{k}") for k, c in enumerate(docs.columns)])  # no name clashes
    text = f"_c{docs.columns.index(text_col)}"
    own = own.withColumn("_n", _word_count(text))
    rules = {r.name: r for r in cheap(F.col("_n"), text)}
    at = order.index(REPEATS)
    before, after = [rules[k] for k in order[:at]], [rules[k] for k in order[at + 1 :]]
    own = own.withColumn("_left", F.when(verdict(before).isNull(), F.col(text)))
    own = repeated_words(own, "_left", "_again")
    kept = F.when(100 * F.col("_again") <= 20 * F.col("_n"), verdict(after).isNull())  # _again is null where a rule has rejected
    own = own.withColumn("_kept", _barred(F.coalesce(kept, F.lit(False)))).where("_kept")
    return own.select(*[F.col(f"_c{k}").alias(c) for k, c in enumerate(docs.columns)])
