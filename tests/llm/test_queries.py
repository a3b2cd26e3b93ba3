"""The registered queries at the smallest scale, and the pipeline stage by stage against plain versions."""

import pytest
from pyspark.sql import functions as F

from sightline.llm import packing, queries, quality_rules, simhash, suffix_dedup

from ..compare import assert_same, connection
from .test_operators import _brute_fingerprint, _brute_repeats

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_against_sql(spark, name):
    assert_same(queries.QUERIES[name](spark, SF), connection(SF), queries.ORACLE_SQL[name])


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang")
    found = queries.op6_language_id(spark, SF).join(docs, "doc_id").where("held_out").collect()
    assert sum(r.lang_pred == r.lang for r in found) >= 0.95 * len(found)
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    found = queries.op2_quality_classifier(spark, SF).join(labels, "doc_id").where("held_out").collect()
    assert sum(r.predicted == r.quality for r in found) >= 0.8 * len(found)


def test_suffix_dedup_query(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in queries.op4_suffix_dedup(spark, SF).collect()}
    assert [got[r.doc_id] for r in docs] == _brute_repeats([(r.text or "").encode() for r in docs], 400)


def test_pipeline(spark, tmp_path):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names, kept = docs.columns, []
    for k, (_, stage) in enumerate(p.STAGES):
        stage(spark, docs, SF).write.parquet(str(tmp_path / str(k)))
        before, docs = docs, spark.read.parquet(str(tmp_path / str(k)))
        kept.append((before, docs))
        if k < len(p.STAGES) - 1:
            assert docs.columns == names
    (a, b), (_, c), (_, e), (_, f), (_, g) = kept
    good = {r.doc_id for r in quality_rules.judge(a).where("kept").collect()}
    assert {r.doc_id for r in b.collect()} == good
    least = {r.doc_id for r in simhash.near_duplicates(b).where("doc_id = component_id").collect()}
    assert {r.doc_id for r in c.collect()} == least
    before = c.collect()
    removed = dict(zip([r.doc_id for r in before], _brute_repeats([(r.text or "").encode() for r in before], suffix_dedup.PASSAGE), strict=True))
    assert {r.doc_id for r in e.collect()} == least
    assert all(len((r.text or "").encode()) <= removed[r.doc_id][0] - removed[r.doc_id][1] and r.n_chars == len(r.text) for r in e.collect())
    # each document is drawn whole, some more than once, none that is not there; every token of every draw is packed once
    drawn = [r.doc_id for r in f.collect()]
    assert set(drawn) <= least and len(set(drawn)) > 0.5 * len(least)
    words = packing.WordTokenizer(queries.tokenizer_path())
    tokens = sum(len(x) + 1 for x in words.encode([r.text for r in f.collect()]))
    assert g.agg({"length": "sum"}).first()[0] == tokens
    full = g.groupBy("sequence_id").agg(F.sum("length").alias("n")).collect()
    assert all(r.n == 2048 or r.n & (r.n - 1) == 0 for r in full)


def test_pipeline_on_odd_tables(spark, tmp_path):
    """An empty table gives an empty one at each stage; nulls, repeated rows and clashing names pass through."""
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    prose = docs.where("lang = 'en'").limit(3).withColumn("key", F.lit("clash")).withColumn("kept", F.lit(1))
    odd = prose.unionByName(prose.limit(1)).unionByName(prose.limit(1).withColumn("source", F.lit(None).cast("string")).withColumn("lang", F.lit(None).cast("string")))
    odd = odd.unionByName(prose.limit(1).withColumn("text", F.lit(None).cast("string"))).unionByName(prose.limit(1).withColumn("doc_id", F.lit(None).cast("bigint")))
    odd.write.parquet(str(tmp_path / "odd"))
    for k, (_, stage) in enumerate(p.STAGES):
        assert stage(spark, docs.limit(0), SF).count() == 0
        found = stage(spark, spark.read.parquet(str(tmp_path / "odd")), SF)
        if k < len(p.STAGES) - 1:
            assert found.columns == odd.columns
        assert found.count() >= 0


def test_simhash_query(spark):
    """The registered query against fingerprints and links of all pairs."""
    import numpy as np

    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    fps = np.array([_brute_fingerprint(r.text) for r in docs], np.uint64)
    ids = np.array([r.doc_id for r in docs])
    comp = ids.copy()
    while True:
        new = np.array([comp[np.bitwise_count(fps ^ f) <= 4].min() for f in fps])
        if (new == comp).all():
            break
        comp = new
    got = {(r.doc_id, r.fingerprint, r.component_id) for r in queries.op5_simhash(spark, SF).collect()}
    assert got == {(int(i), f"{int(f):016x}", int(c)) for i, f, c in zip(ids, fps, comp, strict=True)}
