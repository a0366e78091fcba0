"""Readers and writers on small files."""

import json

import pytest
from pyspark.sql import functions as F

from lodestone.sources import readers, writers


def put(path, *rows):
    path.write_text("\n".join(r if isinstance(r, str) else json.dumps(r, ensure_ascii=False) for r in rows) + "\n", encoding="utf-8")
    return str(path)


def test_strict_lines(spark, tmp_path):
    assert readers.jsonl(spark, put(tmp_path / "a", {"x": 1}), "x int").count() == 1
    with pytest.raises(Exception):
        readers.jsonl(spark, put(tmp_path / "b", {"x": 1}, "{oops"), "x int").collect()


def test_any_json(spark, tmp_path):
    p = put(tmp_path / "a", {"index": {"_id": "1"}}, {"_source": {"t": "a"}}, {"index": {"_id": "2"}}, {"_source": {"t": "b"}})
    assert sorted(r.t for r in readers.any_json(spark, p).collect()) == ["a", "b"]
    assert readers.any_json(spark, put(tmp_path / "b", json.dumps([{"t": 1}, {"t": 2}])), array=True, limit=1).count() == 1


def test_bulk(spark, tmp_path):
    act = lambda i, kind="index": {kind: {"_id": i, "_index": "p"}}
    p = put(tmp_path / "products-1.ndjson", act("1"), {"sku_id": "1", "title": "a"}, act("x"), {"sku_id": "2"}, {"sku_id": "3"}, act("4"), act("5"), {"sku_id": "5"}, act("6", "delete"), "{bad", {"index": {"_index": "p"}}, {"sku_id": "7"}, act("8"))
    got = [(r.no, r.error) for r in readers.bulk_pairs(spark, p).orderBy("no").collect()]
    assert got == [(2, None), (4, "ID_MISMATCH"), (5, "ORPHAN_DOCUMENT"), (7, "TWO_ACTIONS"), (8, None), (9, "DELETE_ACTION"), (10, "BAD_JSON"), (12, "NO_ID"), (13, "DANGLING_ACTION")]


def test_shards(spark):
    names = spark.createDataFrame([("products-000001.ndjson",), ("products-3.jsonl",), ("products-03.ndjson",), ("other.txt",)], "name string")
    assert sorted(map(tuple, readers.shard_faults(names).collect())) == [(2, "MISSING"), (3, "DUPLICATE")]


def test_discover(spark):
    rows = spark.createDataFrame([(("x", ["a", "b"]), "t")], "goods struct<GoodsTitle:string,tags:array<string>>, note string")
    assert readers.discover(rows, {"title": ["title", "name"], "tags": ["TAGS"], "none": ["zzz"]}) == {"title": "goods.GoodsTitle", "tags": "goods.tags", "none": None}
    assert rows.select(readers.as_text(rows, "goods.tags").alias("x")).first().x == "a b"


def test_lexicons(spark, tmp_path):
    p = put(tmp_path / "a", "# note", "a:x, y", "b", "c:", "a:z", "d:1:2")
    assert {r.key: r["values"] for r in readers.lexicon(spark, p).collect()} == {"a": ["z"], "d": ["1:2"]}
    t = put(tmp_path / "b", "# note", "苹果\tbrand\t7", "x\tcategory\toops", "lonely")
    assert sorted(map(tuple, readers.dictionary_tsv(spark, t).collect())) == [("x", "CATEGORY", 0), ("苹果", "BRAND", 7)]
    assert [r.word for r in readers.word_list(spark, p).orderBy("no").collect()][:2] == ["a:x, y", "b"]


def test_log(spark, tmp_path):
    p = tmp_path / "log.csv"
    p.write_bytes("﻿query,sid\n手机,1\n".encode())
    assert [tuple(r) for r in readers.query_log(spark, str(p), {"text": "query", "session": "sid"}).collect()] == [("手机", "1")]


def test_tasks(spark, tmp_path):
    span = lambda s, e, t, l: {"type": "labels", "value": {"start": s, "end": e, "text": t, "labels": [l]}}
    rows = [
        {"id": 1, "data": {"text": "华为手机"}, "annotations": [{"id": 1, "was_cancelled": True, "result": []}, {"id": 2, "result": [span(0, 2, "华为", "BRAND"), span(2, 4, "手表", "CATEGORY"), span(2, 9, "x", "CATEGORY"), {"type": "choices", "value": {}}]}]},
        {"id": 2, "data": {"text": "a"}, "annotations": [{"id": 3, "result": []}, {"id": 4, "result": []}]},
    ]
    read = readers.chosen_annotation(readers.tasks(spark, put(tmp_path / "a", json.dumps(rows, ensure_ascii=False))))
    assert {r.id: r.error for r in read.collect()} == {1: None, 2: "SEVERAL_ANNOTATIONS"}
    assert [(r.label, r.fault) for r in readers.annotation_spans(read, ["BRAND", "CATEGORY"]).collect()] == [("BRAND", None), ("CATEGORY", "TEXT_MISMATCH"), ("CATEGORY", "BAD_RANGE")]


def test_writers(spark, tmp_path):
    rows = spark.createDataFrame([(1, "ann"), (2, "ben"), (3, "ann")], "id long, annotator string")
    assert {r.annotator: r.n for r in writers.shares(rows, str(tmp_path / "s")).collect()} == {"ann": 2, "ben": 1}
    writers.append_new(rows, str(tmp_path / "t"))
    writers.append_new(rows.union(spark.createDataFrame([(4, "cyd")], rows.schema)), str(tmp_path / "t"))
    assert spark.read.parquet(str(tmp_path / "t")).count() == 4
    counts = writers.accepted_and_rejected(rows.withColumn("reason", F.when(F.col("id") == 2, "odd")), str(tmp_path / "u"))
    assert {r.reason: r.n for r in counts.collect()} == {"accepted": 2, "odd": 1}
    entries = spark.createDataFrame([("b", "X", 1), ("A", "Y", 0)], "term string, label string, priority int")
    writers.dictionary_tsv(entries, str(tmp_path / "d"))
    assert [r.value for r in spark.read.text(str(tmp_path / "d")).collect()] == ["A\tY\t0", "b\tX\t1"]
    spans = spark.createDataFrame([(1, "ab", [(0, 1, "L", "a", 0.5), (1, 2, "L", "b", 1.0)])], "id long, text string, entities array<struct<start:int,end:int,label:string,text:string,confidence:double>>")
    writers.tasks(spans, str(tmp_path / "k"))
    assert spark.read.json(str(tmp_path / "k")).first().predictions[0].score == 0.75


def test_label_map(spark, tmp_path):
    p = put(tmp_path / "m.tsv", "# raw to ours", "HP\tbrand", "HC\t category ", "bad", "HP\tseries")
    assert sorted(map(tuple, readers.label_map(spark, p).collect())) == [("HC", "CATEGORY"), ("HP", "SERIES")]


def test_inputs(spark, tmp_path):
    d = tmp_path / "d"
    d.mkdir()
    for n in ("products-2.jsonl", "products-1.ndjson", "products-10.txt", "other.jsonl"):
        put(d / n, "{}")
    names = [x.rpartition("/")[2] for x in readers.inputs(spark, [str(d), str(d / "products-1.ndjson"), str(d / "o*.jsonl")])]
    assert names == ["products-1.ndjson", "products-2.jsonl", "other.jsonl"]
    put(d / "products-4.jsonl", "{}")
    for wrong in (str(d), str(d / "none*")):
        with pytest.raises(ValueError):
            readers.inputs(spark, [wrong])


def test_reports(spark, tmp_path):
    p = str(tmp_path / "r.json")
    for values in ({"n": 1}, spark.range(1).select(F.lit("兄").alias("t"))):
        writers.report(values, p)
    assert json.loads((tmp_path / "r.json").read_text(encoding="utf-8")) == {"t": "兄"} and not list(tmp_path.glob("*.tmp"))
    with pytest.raises(ValueError):
        writers.report(spark.range(2), p)
    assert writers.fingerprint({"a": 1, "b": 2}) == writers.fingerprint({"b": 2, "a": 1}) != writers.fingerprint({"a": 1})
    config = {"a": {"b": 1}}
    assert writers.overridden(config, ["a.b=2", "c.d=x"]) == {"a": {"b": 2}, "c": {"d": "x"}} and config == {"a": {"b": 1}}
    made = writers.manifest(spark, str(tmp_path / "m.json"), [p], config, model="m")
    import hashlib

    assert made["files"][0]["sha256"] == hashlib.sha256((tmp_path / "r.json").read_bytes()).hexdigest() and json.loads((tmp_path / "m.json").read_text())["model"] == "m"


def test_append_checks_the_input(spark, tmp_path):
    p = str(tmp_path / "t")
    writers.append_new(spark.range(3), p)
    writers.append_new(spark.range(5), p)
    assert spark.read.parquet(p).count() == 5
    with pytest.raises(ValueError):
        writers.append_new(spark.range(2), p)
