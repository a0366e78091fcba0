"""The pipeline: each stage on its predecessor's rows, and what it must catch and keep."""

import random

from pyspark.sql import functions as F

import corpus_pipeline as P

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    for k, (_, stage) in enumerate(P.STAGES):
        before = docs
        out = stage(spark, docs, SF)
        out.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        assert docs.select("doc_id").exceptAll(before.select("doc_id")).count() == 0
        if k < len(P.STAGES) - 1:
            assert docs.columns == columns
    assert docs.where("not lossless").count() == 0
    assert {r.doc_id for r in docs.collect()} == {r.doc_id for r in P.run(spark, SF).collect()}


def test_planted(spark, tmp_path):
    r = random.Random(9)
    words = [f"w{a}{b}" for a in "abcdefgh" for b in range(40)]
    para = lambda n: " ".join(r.choice(words) for _ in range(n))
    item = spark.read.parquet(f"{SF}/benchmark.parquet").first().text
    clean = [para(80) for _ in range(10)]
    rows = [*enumerate(clean), (20, clean[0]), (21, clean[1].replace("wa1 ", "wb2 ", 1)), (22, para(30) + " " + item + " " + para(30))]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    assert {x.doc_id for x in P.minhash_dedup(spark, docs, SF).collect()} == {*range(10), 22}
    assert {x.doc_id for x in P.decontamination(spark, docs, SF).collect()} == {*range(10), 20, 21}
    lines = {x.doc_id: x for x in P.line_dedup(spark, docs, SF).collect()}
    assert 20 not in lines and set(range(10)) <= set(lines)
    assert P.line_dedup(spark, docs, SF).where(F.col("n_chars") != F.length("text")).count() == 0
