"""Fill-in-the-middle examples, by a pipeline of pyarrow.compute kernels over each batch.

Texts are split into lines as list arrays and flattened beside the index of their parent; a line's ordinal is its place
less its parent's first. Ordinals against a document's two cut points give each line a role. Lines of one role are
filtered, put back into lists, and joined to a prefix, middle or suffix; no Python code sees a row.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small_batches

#: Before the prefix, the suffix and the middle.
MARKS = ("<P>", "<S>", "<M>")
SEED, RATE, SPM_RATE = 7, 100, 50


def _mod(x: pa.Array, by: pa.Array | int) -> pa.Array:
    return pc.subtract(x, pc.multiply(pc.divide(x, by), by))


def _lines(text: pa.Array) -> tuple[pa.Array, pa.Array, pa.Array, pa.Array]:
    """Lines with their newlines, the parent and the ordinal of each, and the number of lines of each text."""
    pieces = pc.split_pattern(text, "\n")
    size = pc.cast(pc.list_value_length(pieces), pa.int64())
    parent, units = pc.list_parent_indices(pieces), pc.list_flatten(pieces)
    first = pc.subtract(pc.cumulative_sum(size), size)
    ordinal = pc.subtract(pa.array(range(len(units)), pa.int64()), first.take(parent))
    last = pc.equal(ordinal, pc.subtract(size, 1).take(parent))
    lines = pc.binary_join_element_wise(units, pc.if_else(last, pa.scalar("", units.type), pa.scalar("\n", units.type)), pa.scalar("", units.type))
    none = pc.and_(last, pc.equal(pc.binary_length(lines), 0))  # nothing comes after a newline at the end
    real = pc.invert(none)
    n = pc.subtract(size, pc.cast(pc.or_(pc.equal(pc.binary_length(text), 0), pc.ends_with(text, "\n")), pa.int64()))
    return lines.filter(real), parent.filter(real), ordinal.filter(real), n


def _joined(lines: pa.Array, role: pa.Array, count: pa.Array) -> pa.Array:
    """The lines of a role, ``count`` of them in each text, as one string for each text."""
    offsets = pa.concat_arrays([pa.array([0], pa.int64()), pc.cumulative_sum(count)])
    return pc.binary_join(pa.LargeListArray.from_arrays(offsets, lines.filter(role)), pa.scalar("", lines.type))


def _examples(text: pa.Array, h: list[pa.Array], rate: int, spm_rate: int, marks: tuple[str, str, str]) -> list[pa.Array]:
    """n, form, prefix_chars, middle_chars and output of each text (large strings, no nulls)."""
    lines, parent, ordinal, n = _lines(text)
    one, other = (_mod(x, pc.add(n, 1)) for x in h[:2])
    start, end = pc.min_element_wise(one, other), pc.max_element_wise(one, other)
    early, late = pc.less(ordinal, start.take(parent)), pc.greater_equal(ordinal, end.take(parent))
    prefix = _joined(lines, early, start)
    middle = _joined(lines, pc.invert(pc.or_(early, late)), pc.subtract(end, start))
    suffix = _joined(lines, late, pc.subtract(n, end))
    plain = pc.or_(pc.equal(n, 0), pc.greater_equal(_mod(h[2], 100), rate))
    for m in marks:
        plain = pc.or_(plain, pc.match_substring(text, m))
    spm = pc.less(_mod(h[3], 100), spm_rate)
    p, s, m, none = (pa.scalar(x, text.type) for x in (*marks, ""))
    psm_out = pc.binary_join_element_wise(p, prefix, s, suffix, m, middle, none)
    spm_out = pc.binary_join_element_wise(s, suffix, p, prefix, m, middle, none)
    form = pc.if_else(plain, "plain", pc.if_else(spm, "spm", "psm"))
    null = pa.scalar(None, pa.int64())
    chars = [pc.if_else(plain, null, pc.cast(pc.utf8_length(x), pa.int64())) for x in (prefix, middle)]
    return [n, form, *chars, pc.if_else(plain, text, pc.if_else(spm, spm_out, psm_out))]


def transform(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    rate: int = RATE,
    spm_rate: int = SPM_RATE,
    seed: int = SEED,
    marks: tuple[str, str, str] = MARKS,
) -> DataFrame:
    """One row per input row: id_col, n (lines), form (plain, psm or spm), prefix_chars, middle_chars, output.

    Cuts and form follow the SHA-256 of seed and id alone (a null id counts as empty), so equal rows get equal examples.
    Null counts as an empty text, which is plain, as is one that holds a mark. Texts of any length are cut whole.
    An empty table gives an empty table.
    """
    small_batches(docs.sparkSession)
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256)
    h = [F.conv(F.substring(digest, 1 + 8 * k, 8), 16, 10).cast("bigint").alias(f"h{k}") for k in range(4)]
    src = docs.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("_text"), *h)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, form, before, within, output = _examples(pc.cast(b.column(1), pa.large_string()), b.columns[2:], rate, spm_rate, marks)
            yield pa.RecordBatch.from_arrays([b.column(0), n, form, before, within, pc.cast(output, pa.string())], names)

    names = [id_col, "n", "form", "prefix_chars", "middle_chars", "output"]
    kind = src.schema[0].dataType.simpleString()
    return src.mapInArrow(run, f"`{id_col}` {kind}, n bigint, form string, prefix_chars bigint, middle_chars bigint, output string")


def restore(form: Column, output: Column, marks: tuple[str, str, str] = MARKS) -> Column:
    """The text that an example was made of, rebuilt from its form and output alone (marks stand in it once each)."""
    p, s, m = marks
    middle = F.substring_index(output, m, -1)
    head = F.substring_index(output, m, 1)
    psm = F.concat(F.replace(F.substring_index(head, s, 1), F.lit(p)), middle, F.substring_index(head, s, -1))
    spm = F.concat(F.substring_index(head, p, -1), middle, F.replace(F.substring_index(head, p, 1), F.lit(s)))
    return F.when(form == "plain", output).when(form == "psm", psm).otherwise(spm)
