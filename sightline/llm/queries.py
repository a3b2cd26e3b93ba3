"""One registered query for each corpus operator, over whole tables, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, embeddings, exact_dedup, fill_in_middle, language_id, mixing, packing, quality_classifier, quality_rules, simhash, suffix_dedup, token_rollup, url_filter
from .common import Scratch, crc_mod, shared_dir, table

#: Part of the largest possible entropy that the mixture is to have.
MIX_ENTROPY = 0.93
#: Verdict, host and path of the host rules (given).
URL_RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(table(spark, sf_dir, "embeddings"))


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held = table(spark, sf_dir, "documents"), crc_mod("doc_id", 4) == 2
    space = quality_classifier.fit(docs, table(spark, sf_dir, "labels").where(~held))
    scored = quality_classifier.score(docs.select("doc_id", "text"), space)
    return scored.select("doc_id", held.alias("held_out"), "score", "predicted")


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    judged = url_filter.judge(pages.drop("html"), url_filter.bad_urls(pages), URL_RULES)
    return judged.select("page_id", "host", "path", "rule", "verdict", "listed")


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The digest is of repeats of 400 bytes; ``text`` is each text without the repeats of ``PASSAGE`` bytes."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    cut = suffix_dedup.remove_repeats(docs, passages=suffix_dedup.PASSAGE)
    return cut.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", F.col("without_passages").alias("text"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held = table(spark, sf_dir, "documents"), crc_mod("doc_id", 5) == 0
    model = language_id.learn(docs.where(~held))
    found = language_id.identify(docs, model)
    return found.select("doc_id", held.alias("held_out"), "lang_pred", "score")


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    return quality_rules.judge(table(spark, sf_dir, "documents").select("doc_id", "text")).select(*names)


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path())


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), budget=1.0, entropy=MIX_ENTROPY, repetition=None)


def _rollup(scratch: Scratch, counts: DataFrame, versions: list[str], toxic: DataFrame) -> DataFrame:
    """Totals after loads by two tokenizer versions, revised counts, deletes, and a replay of each batch.

    ``counts``: doc_id, source, lang and, for each version, its counts ``<version>/old`` and ``<version>/new``.
    """

    def rows(v: str, tokens: str, of: DataFrame) -> DataFrame:
        return of.select("source", "lang", F.lit(v).alias("tokenizer"), F.col(f"`{v}/{tokens}`").alias("tokens"), F.col(f"`{v}/old`").alias("old"))

    revised = rows(versions[0], "new", counts).unionByName(rows(versions[1], "new", counts)).where("old <> tokens")
    gone = counts.join(toxic, "doc_id", "left_semi")
    batches = {
        "1-load": token_rollup.inserts(rows(versions[0], "old", counts)),
        "2-load": token_rollup.inserts(rows(versions[1], "old", counts)),
        "3-lines": token_rollup.revisions(revised, "old", "tokens"),
        "4-toxic": token_rollup.deletes(rows(versions[0], "new", gone).unionByName(rows(versions[1], "new", gone))),
    }
    rollup = token_rollup.TokenRollup(scratch.spark, f"{scratch.root}/rollup")
    for _ in range(2):  # the second time nothing is added
        for name, changes in batches.items():
            rollup.commit(name, changes)
    return rollup.totals()


def _toxic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels").where("toxic = 1").select("doc_id").distinct()


def _shortened(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with ``short``: the text without its repeated lines, null where there are none."""
    short = token_rollup.without_repeated_lines(F.col("text"))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang")
    return docs.withColumn("short", F.when(F.length(short) < F.length("text"), short))


def op10_token_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of two tokenizer versions; repeated lines are taken out of texts, then toxic documents go."""
    import public_tokenizers as p

    versions = {"word-bpe-49k": (p.path("word_bpe_49k.json"), None), "byte-bpe-50k": (p.path("byte_bpe_50k.tiktoken"), p.PATTERN)}
    counts = token_rollup.token_counts(_shortened(spark, sf_dir), {"old": "text", "new": "short"}, versions)
    cols = [F.coalesce(f"`{v}/new`", f"`{v}/old`").alias(f"{v}/new") for v in versions]
    counts = counts.select("doc_id", "source", "lang", *[F.col(f"`{v}/old`") for v in versions], *cols)
    scratch = Scratch(spark, "token-counts")
    return _rollup(scratch, scratch.save(counts, "counts"), list(versions), _toxic(spark, sf_dir))


def rollup_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same changes with counts by two patterns, which SQL can check."""
    counts, cols = _shortened(spark, sf_dir), []
    for v in token_rollup.PATTERNS:
        n = token_rollup.count_tokens(F.col("text"), v)
        cols += [n.alias(f"{v}/old"), F.when(F.col("short").isNotNull(), token_rollup.count_tokens(F.col("short"), v)).otherwise(n).alias(f"{v}/new")]
    scratch = Scratch(spark, "token-counts")
    counts = scratch.save(counts.select("doc_id", "source", "lang", *cols), "counts")
    return _rollup(scratch, counts, list(token_rollup.PATTERNS), _toxic(spark, sf_dir))


def op11_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.mark(table(spark, sf_dir, "documents")).drop("n_chunks")


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_in_middle.transform(table(spark, sf_dir, "documents"))
    text = fill_in_middle.restore(F.col("form"), F.col("output"))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(text, 256).alias("restored_sha256"))


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as p

    return alignment.link_counts(table(spark, sf_dir, "documents"), p.path("byte_bpe_50k.json"), p.path("piece_bpe_32k.model"))


QUERIES = {
    "op1_embeddings": op1_embeddings,
    "op2_quality_classifier": op2_quality_classifier,
    "op3_url_filter": op3_url_filter,
    "op4_suffix_dedup": op4_suffix_dedup,
    "op5_simhash": op5_simhash,
    "op6_language_id": op6_language_id,
    "op7_quality_rules": op7_quality_rules,
    "op8_packing": op8_packing,
    "op9_mixing": op9_mixing,
    "op10_token_rollup": op10_token_rollup,
    "op11_exact_dedup": op11_exact_dedup,
    "op12_fill_in_middle": op12_fill_in_middle,
    "op13_alignment": op13_alignment,
    "rollup_patterns": rollup_patterns,
}

_WORD = r"[^\x20\x09-\x0D]+"
_CANONICAL = r"regexp_replace(host, '^(?:www|m)\.', '') || regexp_replace(regexp_replace(path, '/+$', ''), '\.html?$', '')"



def _plain(pattern: str) -> str:
    r"""The pattern with the characters that its \u escapes name, which DuckDB's patterns lack."""
    return pattern.replace(r"\u2022", "\u2022").replace(r"\u2026", "\u2026")


#: Quality statistics of a table ``docs`` (doc_id, text), and the verdict; shared with the pipeline's tests.
QUALITY_SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS w FROM documents),
g AS (SELECT doc_id, unnest(range(1, len(w) - 3)) AS i, unnest(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) AS five FROM d WHERE len(w) >= 5),
k AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, five) AS c FROM g),
r AS (SELECT doc_id, sum(least(5, coalesce(nxt - i, 5))) AS n FROM
      (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nxt FROM k WHERE c > 1) GROUP BY doc_id),
l AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{_WORD}')) AS lines FROM d),
s AS (SELECT d.doc_id, text, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
      CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
      CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, CAST(coalesce(r.n, 0) AS BIGINT) AS n_repeat_words
      FROM d JOIN l USING (doc_id) LEFT JOIN r USING (doc_id)),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
      10 * n_symbols > n_words OR word_chars < 2 * n_words OR word_chars > 20 * n_words
      OR 2 * n_dup_lines > len(string_split(text, chr(10))) OR 2 * length(regexp_replace(text, '[^!]', '', 'g')) > n_words
      OR 10 * len(regexp_extract_all(text, '{quality_rules.CAPITAL}')) > 3 * length(text) OR 20 * len(regexp_extract_all(text, '{quality_rules.NO_LETTER}')) > 9 * length(text)
      OR 200 * len(regexp_extract_all(text, '{quality_rules.STOP}')) < n_words
      OR 10 * len(regexp_extract_all(text, '(?m){_plain(quality_rules.ITEM)}')) > 9 * len(string_split(text, chr(10)))
      OR 10 * len(regexp_extract_all(text, '(?m){_plain(quality_rules.ELLIPSIS)}')) > 3 * len(string_split(text, chr(10))) AS rejected FROM s)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT rejected AS kept FROM b
"""

ORACLE_SQL: dict[str, str] = {
    "op3_url_filter": rf"""
WITH a AS (SELECT page_id, html, regexp_extract(coalesce(url, ''), '(?s)^.*?://(.*)$', 1) AS rest FROM pages),
h AS (SELECT page_id, html, lower(regexp_extract(rest, '(?s)^([^/?#]*)', 1)) AS host, regexp_extract(rest, '(?s)^[^/?#]*(/[^?#]*)', 1) AS path FROM a),
c AS (SELECT *, {_CANONICAL} AS key, CASE
  WHEN (host = 'example.net' OR host LIKE '%.example.net') AND path LIKE '/en/%' THEN 'example.net/en/'
  WHEN (host = 'example.com' OR host LIKE '%.example.com') AND path LIKE '/de/%' THEN 'example.com/de/'
  WHEN (host = 'org' OR host LIKE '%.org') AND path LIKE '/fr/%' THEN 'org/fr/'
  WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/%' THEN 'net/' END AS rule FROM h),
e AS (SELECT key, regexp_matches(host, '(?:^|[.-])(?:{"|".join(url_filter.SPAM_WORDS)})(?:[.-]|$)')
  OR coalesce({url_filter.MARKS_PER_SPACE} * len(regexp_extract_all(html, '{url_filter.MARK}')) > len(regexp_extract_all(html, ' ')), false) AS bad,
  trim(regexp_replace(regexp_replace(regexp_extract(html, '{url_filter.ARTICLE}', 1), '{url_filter.TAG}', ' ', 'g'), '{url_filter.SPACES}', ' ', 'g')) AS article FROM c),
t AS (SELECT DISTINCT key FROM e WHERE key <> '' AND (bad OR len(string_split(article, ' ')) >= {url_filter.ARTICLE_WORDS} AND article IN (SELECT article FROM e WHERE bad AND article IS NOT NULL)))
SELECT page_id, host, path, rule, rule IS NULL AND key IN (SELECT key FROM t) AS listed,
  CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow'
       WHEN key IN (SELECT key FROM t) THEN 'block' ELSE 'allow' END AS verdict FROM c
""",
    "op7_quality_rules": QUALITY_SQL,
    "op9_mixing": rf"""
WITH RECURSIVE t AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '{_WORD}')) AS BIGINT) AS tokens,
  CAST('0x' || substr(md5('mix:b:' || doc_id), 1, 8) AS BIGINT) % (SELECT CASE WHEN count(*) <= 102400000 THEN 1024 ELSE CAST(pow(2, floor(log2(greatest((count(*) - 1) // 100000, 1))) + 1) AS BIGINT) END FROM documents) AS block FROM documents),
bl AS (SELECT source, block, sum(tokens) AS in_block FROM t GROUP BY 1, 2),
s AS (SELECT source, sum(in_block) AS total FROM bl GROUP BY 1),
g AS (SELECT CAST(sum(total) AS DOUBLE) AS grand FROM s),
p AS (SELECT list(total / grand ORDER BY source) AS ps FROM s, g WHERE total > 0),
b(i, lo, hi) AS (SELECT 0, CAST(0 AS DOUBLE), CAST(1 AS DOUBLE) UNION ALL
  SELECT i + 1, CASE WHEN up THEN mid ELSE lo END, CASE WHEN up THEN hi ELSE mid END FROM
    (SELECT *, ln(z) - mid * l / z >= {MIX_ENTROPY} * ln(greatest(len(ps), 2)) AS up FROM
      (SELECT i, lo, hi, (lo + hi) / 2 AS mid, ps, list_sum(list_transform(ps, lambda x: pow(x, (lo + hi) / 2))) AS z,
              list_sum(list_transform(ps, lambda x: pow(x, (lo + hi) / 2) * ln(x))) AS l FROM b, p WHERE i < 20))),
e AS (SELECT lo AS a, list_sum(list_transform(ps, lambda x: pow(x, lo))) AS z FROM b, p WHERE i = 20),
q AS (SELECT source, total, CAST(floor(pow(total / grand, a) / z * grand) AS BIGINT) AS part FROM s, g, e WHERE total > 0),
pl AS (SELECT s.source, CAST(coalesce(part // q.total, 1) AS BIGINT) AS epochs, coalesce(part % q.total, 0) AS over FROM s LEFT JOIN q ON s.source IS NOT DISTINCT FROM q.source),
la AS (SELECT bl.source, block, epochs, in_block, over - coalesce(sum(in_block) OVER (PARTITION BY bl.source
  ORDER BY md5('mix:' || epochs || ':block:' || block) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest
  FROM bl JOIN pl ON bl.source IS NOT DISTINCT FROM pl.source),
f AS (SELECT t.*, epochs, rest, CASE WHEN rest <= 0 THEN 0 WHEN rest >= in_block THEN 2 ELSE 1 END AS state
  FROM t JOIN la ON t.block = la.block AND t.source IS NOT DISTINCT FROM la.source),
w AS (SELECT doc_id, source, tokens, block, unnest(range(0, epochs + CASE WHEN state = 2 THEN 1 ELSE 0 END)) AS epoch FROM f),
x AS (SELECT *, sum(tokens) OVER (PARTITION BY source, block ORDER BY md5('mix:' || epochs || ':doc:' || doc_id) RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
  - sum(tokens) OVER (PARTITION BY source, block, doc_id) AS before FROM f WHERE state = 1),
o AS (SELECT doc_id, source, tokens, block, epoch FROM w UNION ALL SELECT doc_id, source, tokens, block, epochs FROM x WHERE before < rest)
SELECT doc_id, source, tokens, CAST(epoch AS INTEGER) AS epoch,
  substr(md5('mix:' || epoch || ':block:' || block), 1, 8) || '-' || substr(md5('mix:' || epoch || ':doc:' || doc_id), 1, 16) AS draw_key FROM o
""",
    "op11_exact_dedup": """
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
g AS (SELECT text, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY text)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(text) AS text_sha256 FROM d JOIN g USING (text)
""",
    "op12_fill_in_middle": r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, sha256('7:' || doc_id) AS h, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS u FROM documents),
k AS (SELECT *, CAST(len(u) AS BIGINT) AS n, CAST('0x' || substr(h, 1, 8) AS BIGINT) % (len(u) + 1) AS a, CAST('0x' || substr(h, 9, 8) AS BIGINT) % (len(u) + 1) AS b,
  CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR CAST('0x' || substr(h, 17, 8) AS BIGINT) % 100 >= 100 THEN 'plain'
       WHEN CAST('0x' || substr(h, 25, 8) AS BIGINT) % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM d),
p AS (SELECT *, array_to_string(u[1:least(a, b)], '') AS prefix, array_to_string(u[least(a, b) + 1:greatest(a, b)], '') AS middle, array_to_string(u[greatest(a, b) + 1:], '') AS suffix FROM k)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN CAST(length(prefix) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(middle) AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
  sha256(text) AS restored_sha256 FROM p
""",
    "rollup_patterns": rf"""
WITH v AS (SELECT * FROM (VALUES ('words-1', '{token_rollup.PATTERNS["words-1"]}'), ('pieces-2', '{token_rollup.PATTERNS["pieces-2"]}')) AS v(tokenizer, pattern)),
d AS (SELECT source, lang, array_to_string(list_distinct(string_split(coalesce(text, ''), chr(10))), chr(10)) AS text FROM documents
  WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1))
SELECT source, lang, tokenizer, count(*) AS docs, CAST(sum(CASE tokenizer WHEN 'words-1' THEN len(regexp_extract_all(text, '{token_rollup.PATTERNS["words-1"]}'))
  ELSE len(regexp_extract_all(text, '{token_rollup.PATTERNS["pieces-2"]}')) END) AS BIGINT) AS tokens FROM d, v GROUP BY 1, 2, 3
""",
}
