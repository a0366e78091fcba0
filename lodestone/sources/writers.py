"""Sinks: line JSON, dictionaries, annotation tasks, splits, annotators' shares, appends that resume, accepted and rejected rows."""

from __future__ import annotations

import hashlib
import json
import sys
import uuid
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import normalize


def jsonl(rows: DataFrame, path: str) -> None:
    """Line JSON; the commit protocol makes it whole or absent."""
    rows.write.mode("overwrite").json(path)


def dictionary_tsv(entries: DataFrame, path: str) -> None:
    """One file of term, label and priority by normal form, then term; dictionaries are small by nature."""
    entries.orderBy(normalize(F.col("term")), "term").coalesce(1).select(F.concat_ws("\t", "term", "label", F.col("priority").cast("string"))).write.mode("overwrite").text(path)


def tasks(rows: DataFrame, path: str, model: str = "weak") -> None:
    """Annotation tasks of rows (id, text, entities) as line JSON, the entities as predictions with their mean confidence."""
    result = F.transform("entities", lambda e: F.struct(F.lit("label").alias("from_name"), F.lit("text").alias("to_name"), F.lit("labels").alias("type"), F.struct(e["start"].alias("start"), e["end"].alias("end"), e["text"].alias("text"), F.array(e["label"]).alias("labels")).alias("value")))
    total = F.aggregate("entities", F.lit(0.0), lambda a, e: a + e["confidence"])
    score = F.when(F.size("entities") > 0, F.bround(total / F.size("entities"), 4)).otherwise(0.0)
    rows.select("id", F.struct("text").alias("data"), F.array(F.struct(F.lit(model).alias("model_version"), score.alias("score"), result.alias("result"))).alias("predictions")).write.mode("overwrite").json(path)


def splits(rows: DataFrame, path: str, column: str = "split") -> None:
    rows.write.mode("overwrite").partitionBy(column).json(path)


def shares(assigned: DataFrame, path: str) -> DataFrame:
    """Writes each annotator's rows and gives the manifest (annotator, n, ids_sha256); an annotator's share is bounded work."""
    assigned.write.mode("overwrite").partitionBy("annotator").json(path)
    return assigned.groupBy("annotator").agg(F.count("*").alias("n"), F.sha2(F.array_join(F.sort_array(F.collect_list(F.col("id").cast("string"))), "\n"), 256).alias("ids_sha256"))


def _put(spark: SparkSession, path: str, text: str) -> None:
    """Writes a small file beside its place and renames it, so that readers see it whole or not at all."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    to, tmp = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex[:8]}.tmp")
    fs = to.getFileSystem(conf)
    out = fs.create(tmp, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    if fs.exists(to):
        fs.delete(to, False)
    if not fs.rename(tmp, to):
        raise OSError(f"could not rename to {path}")


def report(values: DataFrame | dict, path: str) -> None:
    """One JSON report, of a dict or of a table of one row."""
    spark = SparkSession.active()
    if isinstance(values, DataFrame):
        rows = values.limit(2).toJSON().collect()
        if len(rows) != 1:
            raise ValueError("a report is one row")
        values = json.loads(rows[0])
    _put(spark, path, json.dumps(values, ensure_ascii=False, indent=2))


def fingerprint(config: dict) -> str:
    """First 12 hex digits of the SHA-256 of a configuration, whatever the order of its keys."""
    return hashlib.sha256(json.dumps(config, sort_keys=True, ensure_ascii=False).encode()).hexdigest()[:12]


def overridden(config: dict, pairs: list[str]) -> dict:
    """config with a.b=value pairs set; values are JSON where they parse, else text."""
    out = json.loads(json.dumps(config))
    for pair in pairs:
        name, sep, raw = pair.partition("=")
        if not sep:
            raise ValueError(f"{pair}: name=value is asked for")
        *path, last = name.split(".")
        at = out
        for k in path:
            at = at.setdefault(k, {})
        try:
            at[last] = json.loads(raw)
        except json.JSONDecodeError:
            at[last] = raw
    return out


def manifest(spark: SparkSession, path: str, files: list[str], config: dict, **extra: object) -> dict:
    """Writes and gives where a dataset came from: time, versions, the configuration's fingerprint and each file's SHA-256,
    which executors compute. A file is hashed whole, so its size is bounded by a task's memory (2 GB at most)."""
    hashes = spark.read.format("binaryFile").load(files).select("path", "length", F.sha2("content", 256).alias("sha256")).orderBy("path").collect() if files else []
    out = {"created_at": datetime.now(timezone.utc).isoformat(timespec="seconds"), "python": sys.version.split()[0], "spark": spark.version, "config": fingerprint(config), "files": [r.asDict() for r in hashes], **extra}
    _put(spark, path, json.dumps(out, ensure_ascii=False, indent=2))
    return out


def append_new(rows: DataFrame, path: str, key: str = "id") -> None:
    """Appends the rows whose key the table lacks, so that a run that stopped can go on. Keys of the table that the rows
    lack mean another input, which is an error."""
    spark = rows.sparkSession
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
        done = spark.read.parquet(path).select(key).distinct()
        if done.join(rows.select(key), key, "left_anti").limit(1).count():
            raise ValueError(f"{path} holds rows of another input")
        rows = rows.join(done, key, "left_anti")
    rows.write.mode("append").parquet(path)


def accepted_and_rejected(rows: DataFrame, path: str, reason: str = "reason") -> DataFrame:
    """Writes rows without a reason and rows with one apart; gives the reasons' counts."""
    rows.where(F.col(reason).isNull()).drop(reason).write.mode("overwrite").parquet(f"{path}/accepted")
    rows.where(F.col(reason).isNotNull()).write.mode("overwrite").parquet(f"{path}/rejected")
    return rows.groupBy(F.coalesce(F.col(reason), F.lit("accepted")).alias("reason")).agg(F.count("*").alias("n"))
