"""URL filter: rules by host and path, then a list of canonical URLs behind a blocked Bloom filter.

The list can be of any length. A blocked Bloom filter of it (each key sets ``BITS`` bits in one block of 512) has
a block for about ``KEYS_A_BLOCK`` keys, 80 bytes each. Its broadcast takes at most ``MEMORY_SHARE`` of the smaller of an
executor's and the driver's memory: with 4 GB that is a filter for 40 million URLs (84 MB), with 32 GB one for 320 million.
A longer list only lets more through to the join.
URLs that pass are possible hits; only they are shuffled into the exact hash join with the list, which
removes false positives. All others never leave their partition. URLs and html of any length are read whole.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, without

#: Bits set for each key, at most, in its block of eight words.
BITS = 8
#: About 1 % false positives.
KEYS_A_BLOCK = 40
LEAST_BLOCKS, MOST_BLOCKS = 1 << 8, 1 << 20
#: Part of the memory that a filter may take, and bytes of one of its blocks.
MEMORY_SHARE, BLOCK_BYTES = 1 / 32, 80


def host_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty where it is null or has no ``://``."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://(.*)$", 1)
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    lower = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return lower, F.regexp_extract(rest, r"(?s)^[^/?#]*(/[^?#]*)", 1)


def rule_match(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> Column:
    """The longest fitting rule as struct(rule, verdict), else null. ``rules``: (verdict, host, path), a few."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, h, p in sorted(rules, key=lambda r: (len(r[1]) + len(r[2]), r)):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def canonical(host: Column, path: Column) -> Column:
    """``host/path`` without leading ``www.`` and ``m.``, trailing slashes and ``.html``; query and fragment are gone."""
    short = F.regexp_replace(host, r"^(?:www|m)\.", "")
    return F.concat(short, F.regexp_replace(F.regexp_replace(path, r"/+$", ""), r"\.html?$", ""))


def _place(key: Column, blocks: int) -> tuple[Column, list[Column]]:
    """Block of a key, and for each of its eight words the mask with the key's bit."""
    block = F.pmod(F.xxhash64(F.lit("block"), key), F.lit(blocks)).cast("int")
    bits = F.xxhash64(F.lit("bits"), key)
    return block, [
        F.call_function("shiftleft", F.lit(1).cast("bigint"), F.shiftrightunsigned(bits, 6 * k).bitwiseAND(F.lit(63)).cast("int")) for k in range(BITS)
    ]


def filter_blocks(keys: int, most: int = MOST_BLOCKS) -> int:
    """Blocks of a filter for so many keys: a power of two, ``most`` at most."""
    return min(most, max(LEAST_BLOCKS, 1 << (max(keys - 1, 0) // KEYS_A_BLOCK).bit_length()))


def most_blocks(memory: int) -> int:
    """The largest power of two of blocks that take ``MEMORY_SHARE`` of so many bytes, ``LEAST_BLOCKS`` at least."""
    return max(LEAST_BLOCKS, 1 << int(memory * MEMORY_SHARE / BLOCK_BYTES).bit_length() >> 1)


def _memory(spark: SparkSession) -> int:
    """Bytes of memory of an executor or the driver, whichever has less; 1 GB is Spark's default."""
    conf = spark.sparkContext.getConf()
    units = {"": 1, "b": 1, "k": 1 << 10, "m": 1 << 20, "g": 1 << 30, "t": 1 << 40}

    def size(name: str) -> int:
        number, unit = re.match(r"(\d+)([a-z]?)", conf.get(name, "1g").strip().lower()).groups()
        return int(number) * units[unit]

    return min(size("spark.executor.memory"), size("spark.driver.memory"))


def bloom(listed: DataFrame, key: str, blocks: int) -> DataFrame:
    """(block, w0..w7): at most ``blocks`` rows, made by partial bit_or before the shuffle."""
    block, masks = _place(F.col(key), blocks)
    return listed.groupBy(block.alias("block")).agg(*[F.bit_or(m).alias(f"w{k}") for k, m in enumerate(masks)])


#: Columns that a filter needs beside those of its input.
_SIFT = ("_block", "block", *[f"w{k}" for k in range(BITS)])


def possible(df: DataFrame, keys: DataFrame, key: str, blocks: int | None = None) -> DataFrame:
    """``df`` with ``_hit``: false where ``key`` is surely not among ``keys`` (distinct, a written table, same column), by a broadcast filter.

    No row leaves its partition. ``blocks`` of the filter follow from the number of keys and the memory unless given.
    """
    spark = df.sparkSession
    blocks = blocks or filter_blocks(keys.count(), most_blocks(_memory(spark)))
    block, masks = _place(F.col(key), blocks)
    joined = df.withColumn("_block", block).join(F.broadcast(bloom(keys, key, blocks)), F.col("_block") == F.col("block"), "left")
    hit = reduce(lambda a, b: a & b, [F.col(f"w{k}").bitwiseAND(m) != 0 for k, m in enumerate(masks)])
    return joined.select(*df.columns, F.coalesce(hit, F.lit(False)).alias("_hit"))


def judge(
    pages: DataFrame,
    listed: DataFrame,
    rules: Sequence[tuple[str, str, str]],
    url_col: str = "url",
    blocks: int | None = None,
) -> DataFrame:
    """``pages`` with host, path, rule, listed (boolean) and verdict.

    The longest fitting rule gives the verdict; without one, a URL whose canonical form is in
    ``listed`` (column ``key``, repeats allowed) is blocked and any other allowed. Null URLs and URLs
    without ``://`` have an empty host and path, fit no rule and are never listed; URLs of any length are judged whole.
    Of rules that fit equally long ones, the last by (verdict, host, path) wins. Repeated rows are judged one by one.
    Columns of those names are replaced; empty tables give empty tables, an empty list lists nothing. ``blocks`` of
    the filter follow from the list's length unless given.
    """
    added = ("host", "path", "rule", "listed", "verdict")
    host, path = host_path(F.col(url_col))
    df = without(pages, *added, "_rule", "_key", "_hit", *_SIFT)
    names = df.columns
    df = df.withColumn("host", host).withColumn("path", path)
    df = df.withColumn("_rule", rule_match(F.col("host"), F.col("path"), rules))
    df = df.withColumn("_key", canonical(F.col("host"), F.col("path")))
    keys = listed.select(F.col("key").alias("_key")).where("_key <> ''").distinct()
    keys = Scratch(pages.sparkSession, "url-list").save(keys, "keys")
    sifted = possible(df, keys, "_key", blocks).withColumn("_hit", F.col("_rule").isNull() & F.col("_hit"))
    cols = [*names, "host", "path", "_rule", "_key"]
    exact = sifted.where("_hit").select(*cols).join(keys.hint("shuffle_hash").withColumn("listed", F.lit(True)), "_key", "left").select(*cols, "listed")
    rest = sifted.where("not _hit").select(*cols).withColumn("listed", F.lit(None).cast("boolean"))
    both = exact.unionByName(rest).withColumn("listed", F.coalesce("listed", F.lit(False)))
    verdict = F.coalesce(F.col("_rule.verdict"), F.when(F.col("listed"), F.lit("block")).otherwise(F.lit("allow")))
    return both.select(*names, "host", "path", F.col("_rule.rule").alias("rule"), "listed", verdict.alias("verdict"))


#: Host labels whose pages put their canonical URLs on the list.
SPAM_WORDS = ("spam", "pills", "casino", "porn", "xxx", "warez", "viagra")
#: Marks that stand after a space, and the number of spaces for each one from which a page's text is junk.
MARK, MARKS_PER_SPACE = r" [|#*$%~^]", 20
#: What an article is, its tags, its white space; an article of fewer words tells nothing of its copies.
ARTICLE, TAG, SPACES, ARTICLE_WORDS = r"(?s)<article[^>]*>(.*)</article>", r"(?s)<[^>]*>", r"[\x20\x09-\x0D]+", 10


def article(html: Column) -> Column:
    """The text of a page's article without tags, words with one space between; empty without an article, null for null."""
    plain = F.regexp_replace(F.regexp_extract(html, ARTICLE, 1), TAG, " ")
    return F.btrim(F.regexp_replace(plain, SPACES, " "))


def bad_urls(pages: DataFrame, url_col: str = "url", html_col: str = "html", blocks: int | None = None) -> DataFrame:
    """(key): canonical URLs of bad pages and of those that carry a bad page's article.

    Bad by content: more than one space in ``MARKS_PER_SPACE`` is followed by a mark. Bad by host: a label has one of
    ``SPAM_WORDS`` between hyphens. A page whose article of ``ARTICLE_WORDS`` words or more equals a bad page's is a copy of it,
    whatever its host and the rest of it hold. Other pages at the same canonical URL are then listed too.
    A null html is no evidence; a null URL has no key, but its article counts. Repeated rows change nothing.

    Articles are compared by SHA-256. Only digests and keys move, and only those of articles that pass a filter of the bad ones.
    """
    host, path = host_path(F.col(url_col))
    words = r"(?:^|[.-])(?:" + "|".join(SPAM_WORDS) + r")(?:[.-]|$)"
    junk = MARKS_PER_SPACE * F.regexp_count(html_col, F.lit(MARK)) > F.regexp_count(html_col, F.lit(" "))
    text = article(F.col(html_col))
    digest = F.when(F.regexp_count(text, F.lit(" ")) >= ARTICLE_WORDS - 1, F.sha2(text, 256))
    scratch = Scratch(pages.sparkSession, "url-evidence")
    seen = pages.select(canonical(host, path).alias("key"), (host.rlike(words) | F.coalesce(junk, F.lit(False))).alias("bad"), digest.alias("article"))
    seen = scratch.save(seen, "seen")
    copied = scratch.save(seen.where("bad and article is not null").select("article").distinct(), "articles")
    copies = possible(seen.where("not bad and article is not null"), copied, "article", blocks).where("_hit")
    copies = copies.select("key", "article").distinct().join(copied.hint("shuffle_hash"), "article", "left_semi")
    return seen.where("bad").select("key").union(copies.select("key"))
