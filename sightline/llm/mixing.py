"""Mixing sources to target weights by temperature, in DataFrame functions only.

Shares of the sources' tokens are raised to an exponent and normalised. The exponent is bisected until
the weights reach a target entropy or keep within a repetition limit. A source's weight then buys it a
number of tokens: whole epochs of the source, and part of one more. Each epoch is a permutation of the
source's blocks and of the documents within each block; only block totals are accumulated over a
source (a row for each of its blocks), and only the block where the budget ends is accumulated by document.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch

#: Blocks of a source, at least; a document's block follows from its id. There are as many, at a power of two, as leave
#: a block of the largest possible source about ``BLOCK_ROWS`` documents.
BLOCKS, BLOCK_ROWS = 1024, 100_000
#: Bisection steps in all, and how many of them one pass over the sources serves.
STEPS, AT_ONCE = 20, 5


def token_count(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text, as its tokens; null texts have none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint")


def solve_exponent(shares: DataFrame, budget: float, entropy: float | None, repetition: float | None) -> float:
    """The exponent in 0..1 at which the mixture meets its target, to ``2**-STEPS``.

    ``shares``: one row per source with p (share, over 0) and total (tokens). Entropy (as a part of the
    largest possible, 0..1) falls and the largest repetition falls as the exponent grows. With ``entropy``: the largest
    exponent whose entropy is no less. With ``repetition``: the smallest one at which no source is
    repeated more often. Only sums over the sources reach the driver.
    """
    lo, hi = 0.0, 1.0
    for _ in range(STEPS // AT_ONCE):
        grid = [lo + (hi - lo) * k / 2**AT_ONCE for k in range(1, 2**AT_ONCE)]
        sums = [F.count("*").alias("n")]
        for k, a in enumerate(grid):
            w = F.pow("p", F.lit(a))
            sums += [F.sum(w).alias(f"z{k}"), F.sum(w * F.log("p")).alias(f"l{k}"), F.max(w / F.col("total")).alias(f"m{k}")]
        row = shares.agg(*sums).first()
        if not row["n"]:
            return 1.0
        for _ in range(AT_ONCE):
            mid = (lo + hi) / 2
            k = grid.index(mid)
            z = row[f"z{k}"]
            if entropy is not None:
                h = math.log(z) - mid * row[f"l{k}"] / z
                up = h >= entropy * math.log(max(row["n"], 2))
            else:
                up = budget * row[f"m{k}"] / z > repetition
            lo, hi = (mid, hi) if up else (lo, mid)
    return lo if entropy is not None else hi


def _order(*parts: Column) -> Column:
    return F.md5(F.concat_ws(":", *[p.cast("string") for p in parts]))


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    source_col: str = "source",
    text_col: str = "text",
    budget: float = 1.0,
    entropy: float | None = None,
    repetition: float | None = 2.0,
    seed: str = "mix",
    keep: bool = False,
) -> DataFrame:
    """One row for each time a document is drawn: id_col, source_col, tokens, epoch (from 0), draw_key.

    ``budget``: tokens to draw, as a multiple of all tokens. Rows sorted by (epoch, draw_key) within a source are its
    stream. A source may end up to one document over its part. Sources without tokens are drawn once
    whole (they cost nothing); a null source is a source. Rows that repeat an id are drawn together.
    Texts of any length are counted whole, null and empty ones as 0 tokens. An empty table gives an empty table.
    ``keep``: pass all columns of ``docs`` through (text read again).
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "mixing")
    block = F.conv(F.substring(_order(F.lit(seed), F.lit("b"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 1, 8), 16, 10)
    rows = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), token_count(F.col(text_col)).alias("tokens"))
    rows = scratch.save(rows.withColumn("block", block.cast("bigint")), "rows")
    n_blocks = max(BLOCKS, 1 << (max(rows.count() - 1, 0) // BLOCK_ROWS).bit_length())
    rows = rows.withColumn("block", (F.col("block") % n_blocks).cast("int"))
    blocks = scratch.save(rows.groupBy("source", "block").agg(F.sum("tokens").alias("in_block")), "blocks")
    sources = blocks.groupBy("source").agg(F.sum("in_block").alias("total"))
    grand = sources.agg(F.sum("total")).first()[0] or 0
    spent = grand * budget
    shares = scratch.save(sources.where("total > 0").select("source", "total", (F.col("total") / F.lit(float(max(grand, 1)))).alias("p")), "shares")
    a = solve_exponent(shares, spent, entropy, repetition)
    z = shares.agg(F.sum(F.pow("p", F.lit(a)))).first()[0] or 1.0
    share = shares.select(F.col("source").alias("s2"), "total", F.floor(F.pow("p", F.lit(a)) / F.lit(z) * F.lit(float(spent))).alias("part"))
    plan = sources.select(F.col("source").alias("s")).join(share, F.col("s").eqNullSafe(F.col("s2")), "left").select(
        "s",
        F.coalesce(F.floor(F.col("part") / F.col("total")), F.lit(1)).cast("int").alias("epochs"),
        F.coalesce(F.col("part") - F.floor(F.col("part") / F.col("total")) * F.col("total"), F.lit(0)).alias("over"),
    )
    plan = scratch.save(plan, "plan")

    # where the budget ends: blocks in the order of the last epoch, with what stands before each
    last = blocks.join(plan, blocks["source"].eqNullSafe(plan["s"])).withColumn(
        "block_key", _order(F.lit(seed), F.col("epochs"), F.lit("block"), F.col("block"))
    )
    before = F.sum("in_block").over(Window.partitionBy("source").orderBy("block_key").rowsBetween(Window.unboundedPreceding, -1))
    last = last.withColumn("left", F.col("over") - F.coalesce(before, F.lit(0)))
    state = F.when(F.col("left") <= 0, 0).when(F.col("left") >= F.col("in_block"), 2).otherwise(1)
    last = last.select(F.col("source").alias("bs"), F.col("block").alias("bb"), "epochs", "left", state.alias("state"))
    full = rows.join(last, rows["source"].eqNullSafe(last["bs"]) & (rows["block"] == last["bb"])).drop("bs", "bb")
    full = scratch.save(full, "placed")

    whole = F.col("epochs") + F.when(F.col("state") == 2, 1).otherwise(0)
    drawn = full.where(whole > 0).withColumn("epoch", F.explode(F.sequence(F.lit(0), whole - 1)))
    drawn = drawn.select("id", "source", "tokens", "block", "epoch")
    edge = full.where("state = 1").withColumn("doc_key", _order(F.lit(seed), F.col("epochs"), F.lit("doc"), F.coalesce(F.col("id").cast("string"), F.lit(""))))
    spent_before = F.sum("tokens").over(
        Window.partitionBy("source", "block").orderBy("doc_key").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    ) - F.sum("tokens").over(Window.partitionBy("source", "block", "doc_key"))
    edge = edge.withColumn("spent_before", spent_before).where("spent_before < left")
    drawn = drawn.unionByName(edge.select("id", "source", "tokens", "block", F.col("epochs").alias("epoch")))
    key = F.concat_ws(
        "-",
        F.substring(_order(F.lit(seed), F.col("epoch"), F.lit("block"), F.col("block")), 1, 8),
        F.substring(_order(F.lit(seed), F.col("epoch"), F.lit("doc"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 1, 16),
    )
    out = drawn.select(F.col("id").alias(id_col), F.col("source").alias(source_col), "tokens", "epoch", key.alias("draw_key"))
    if not keep:
        return out
    counts = out.groupBy(F.col(id_col).alias("_id")).agg(F.count_distinct("epoch").alias("_draws"))
    again = docs.join(counts, F.col(id_col).eqNullSafe(F.col("_id"))).withColumn("_draws", F.explode(F.sequence(F.lit(1), F.col("_draws").cast("int"))))
    return again.select(*docs.columns)
