"""The stages in order on a small table, each against a plain version of itself."""

import corpus_pipeline as cp
from forkweave.llm import pii, quality
from pyspark.sql import functions as F
from test_neardup import brute

SF = "/root/testdata/sf0.001"


#: Names that the operators give columns of their own.
CLASHES = "score gone_id gone_h h row rest n kept mix_target mix_buckets mix_key mix_copy pii_text pii_key pii_terms pii_near pii_spans none ids order".split()


def test_stages_keep_columns_of_any_name(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(60).cache()
    odd = docs.withColumns({c: F.concat(F.lit(f"{c} "), F.col("doc_id").cast("string")) for c in CLASHES})
    for name, stage in cp.STAGES:
        plain, got = stage(spark, docs, SF), stage(spark, odd, SF)
        if name == "packing":
            assert got.columns == plain.columns and got.count() == plain.count()
            continue
        rows = got.collect()
        assert got.columns == odd.columns and sorted(r.doc_id for r in rows) == sorted(r.doc_id for r in plain.collect()), name
        assert all(r[c] == f"{c} {r.doc_id}" for r in rows for c in CLASHES), name
        assert got.schema["n_chars"].dataType == docs.schema["n_chars"].dataType


def test_stages_on_odd_rows_and_none(spark):
    schema = spark.read.parquet(f"{SF}/documents.parquet").schema
    rows = [(None, None, None, None, None), (9007199254740993, "", "en", "s", 0), (9007199254740995, "a b c d e f g", "en", None, 13), (None, "a b c d e f g", "en", "s", 13), (5, "x" * 300_000, "en", "s", 300_000), (6, "mail a@b.c " * 3000, "en", "s", 33_000)]
    rows += [(7, "same text of more than five words", "en", "s", 33)] * 3 + [(8, "same text of more than five words", "en", "t", 33), (9007199254740997, "a b c d e f g", "en", "s", 13)]
    docs = spark.createDataFrame([(*r[: len(schema.fields)],) for r in rows], schema)
    for name, stage in cp.STAGES:
        assert stage(spark, docs.limit(0), SF).count() == 0, name
        got = stage(spark, docs, SF).collect()
        ids = {r.doc_id for r in docs.collect()}
        assert {r.doc_id for r in got} <= ids, name
        if name == "near_dedup":
            assert sorted((r.doc_id is None, r.doc_id or 0) for r in got) == [(False, 5), (False, 6), (False, 7), (False, 9007199254740993), (False, 9007199254740995), (True, 0), (True, 0)]
        if name == "pii":
            text = {r.doc_id: (r.text, r.n_chars) for r in got if r.doc_id is not None}
            assert text[6] == ("mail [EMAIL] " * 3000, 39_000) and len(got) == len(rows) and [r.n_chars for r in got if r.doc_id is None and r.text is None] == [None]
        if name == "packing":
            assert {r.doc_id for r in got} == ids


def test_repeats_follow_one_rule(spark):
    docs = spark.createDataFrame([(1, "t " * 9, "b"), (1, "t " * 9, "a"), (2, "other words here and there now", "c"), (None, "t " * 9, "d"), (None, "t " * 9, "d")], "doc_id long, text string, source string")
    want = [("a",), ("c",), ("d",), ("d",)]
    assert sorted(tuple(r) for r in cp.distinct(spark, docs, SF).select("source").collect()) == want
    alone = docs.where("doc_id is null")
    assert cp.distinct(spark, alone, SF).count() == 2  # whatever other rows there are


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("score", F.lit("clash")).withColumn("text", F.when(F.col("doc_id") != 3, F.col("text")))
    own = docs.columns
    good = cp.good(spark, docs, SF).cache()
    trees = quality.learn(spark, docs, spark.read.parquet(f"{SF}/labels.parquet"))
    scores = {r.doc_id: r.score for r in quality.score(spark, docs.select("doc_id", "text"), trees).collect()}
    assert {r.doc_id for r in good.collect()} == {i for i, s in scores.items() if s >= 0.5}
    assert good.columns == own and {r.score for r in good.collect()} == {"clash"}
    one = cp.distinct(spark, good.unionAll(good.limit(3)), SF).cache()
    rows = [(r.doc_id, r.text) for r in good.collect()]
    assert sorted(r.doc_id for r in one.collect()) == sorted(d for d, _, _, k in brute(rows, 5, 80, 100) if k)
    clean = cp.clean(spark, one, SF).cache()
    assert clean.count() == one.count()
    assert pii.found(clean).where(F.size("pii_base") > 0).count() == 0
    mixed = cp.mixed(spark, clean, SF).cache()
    assert mixed.columns == clean.columns and mixed.select("doc_id").distinct().count() > 0.5 * clean.count()
    most = mixed.groupBy("doc_id").count().agg(F.max("count")).first()[0]
    assert most == 2
    pieces = cp.packed(spark, mixed, SF)
    assert pieces.agg(F.sum("length")).first()[0] == pieces.where("start = 0").agg(F.sum("doc_tokens")).first()[0]
    assert pieces.where("start = 0").count() == mixed.count()


def test_run(spark):
    assert cp.run(spark, SF).count() > 0
