"""Readers: line JSON, catalogue exports, dictionaries and lexicons, query logs and annotation exports."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructType

ACTIONS = ("index", "create", "update", "delete")


def jsonl(spark: SparkSession, path: str, schema: str | StructType) -> DataFrame:
    """Strict line JSON: a bad row is an error."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def any_json(spark: SparkSession, path: str, array: bool = False, limit: int | None = None) -> DataFrame:
    """Rows of an array, of lines or of a bulk dump: action lines go, `_source` is unwrapped."""
    rows = spark.read.option("multiLine", array).json(path)
    acts = [c for c in rows.columns if c in ACTIONS]
    rest = [c for c in rows.columns if c not in acts and c != "_corrupt_record"]
    if acts and rest:
        rows = rows.where(F.coalesce(*[F.col(c).cast("string") for c in rest]).isNotNull()).select(*rest)
    if "_source" in rows.columns:
        inner = rows.schema["_source"].dataType.names
        rows = rows.select(*[F.coalesce(F.col(f"_source.{c}"), F.col(c)).alias(c) if c in rows.columns else F.col(f"_source.{c}").alias(c) for c in inner])
    return rows.limit(limit) if limit is not None else rows


def lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file, no, line) in the order of each file, which may be split among tasks."""
    rows = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("seq"), F.col("value").alias("line"))
    return rows.withColumn("no", F.row_number().over(W.partitionBy("file").orderBy("block", "seq"))).select("file", "no", "line")


def bulk_pairs(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file, no, doc_id, index, document, error) of action and document lines; error is null for a good pair.

    Windows run per file: exports come in shards of bounded size."""
    rows = lines(spark, path).where(F.trim("line") != "")
    action = F.from_json("line", "map<string,string>")
    rows = rows.withColumn("m", action).withColumn("kind", F.when(F.col("m").isNull() | (F.size("m") == 0), "bad").when((F.size("m") == 1) & F.map_keys("m")[0].isin(*ACTIONS), F.map_keys("m")[0]).otherwise("document"))
    w = W.partitionBy("file").orderBy("no")
    rows = rows.withColumn("before", F.lag("kind").over(w)).withColumn("body", F.from_json(F.map_values(F.lag("m").over(w))[0], "struct<_id:string,_index:string>")).withColumn("after", F.lead("kind").over(w))
    sku = F.col("m")["sku_id"]
    is_action, follows = F.col("kind").isin(*ACTIONS), F.col("before").isin("index", "create", "update")
    error = (
        F.when(F.col("kind") == "bad", "BAD_JSON")
        .when(F.col("kind") == "delete", "DELETE_ACTION")
        .when(is_action & F.col("before").isin("index", "create", "update"), "TWO_ACTIONS")
        .when(is_action & F.col("after").isNull(), "DANGLING_ACTION")
        .when(is_action, None)
        .when(~F.coalesce(follows, F.lit(False)), "ORPHAN_DOCUMENT")
        .when(F.col("body").isNull(), "BAD_ACTION")
        .when(F.coalesce("body._id", F.lit("")) == "", "NO_ID")
        .when(F.coalesce("body._index", F.lit("")) == "", "NO_INDEX")
        .when(F.coalesce(sku, F.lit("")) == "", "NO_SKU")
        .when(F.col("body._id") != sku, "ID_MISMATCH")
    )
    out = rows.withColumn("error", error).where((F.col("kind") == "document") | F.col("error").isNotNull())
    return out.select("file", "no", F.col("body._id").alias("doc_id"), F.col("body._index").alias("index"), F.col("line").alias("document"), "error")


def shard_faults(names: DataFrame) -> DataFrame:
    """(shard, fault) of file names products-N: numbers that repeat, and those missing from 1 to the greatest."""
    number = F.regexp_extract(F.col("name"), "(?i)^products-([0-9]+)\\.(?:ndjson|nljson|jsonl)$", 1)
    found = names.select(number.alias("n")).where("n <> ''").select(F.col("n").cast("int").alias("shard")).groupBy("shard").agg(F.count("*").alias("c"))
    wanted = found.agg(F.max("shard").alias("m")).where("m is not null").select(F.explode(F.sequence(F.lit(1), "m")).alias("shard"))
    return found.where("c > 1").select("shard", F.lit("DUPLICATE").alias("fault")).union(wanted.join(found, "shard", "left_anti").select("shard", F.lit("MISSING").alias("fault")))


def discover(rows: DataFrame, wanted: dict[str, list[str]], overrides: dict[str, str] | None = None) -> dict[str, str | None]:
    """Path of each wanted field in a schema two levels deep: an override, else a name that is one of the candidates
    whatever its case, else one that contains a candidate."""
    paths = []
    for f in rows.schema.fields:
        inner = f.dataType.elementType if isinstance(f.dataType, ArrayType) else f.dataType
        paths += [f.name] + ([f"{f.name}.{g.name}" for g in inner.fields] if isinstance(inner, StructType) else [])
    out: dict[str, str | None] = {}
    for field, names in wanted.items():
        leaf = {p: p.rpartition(".")[2].lower() for p in paths}
        exact = next((p for n in names for p in paths if leaf[p] == n.lower()), None)
        out[field] = (overrides or {}).get(field) or exact or next((p for n in names for p in paths if n.lower() in leaf[p]), None)
    return out


def as_text(rows: DataFrame, path: str) -> Column:
    """A field as text: lists joined by spaces, of structs the first of name, value, text and cn."""
    kind = rows.select(path).schema.fields[0].dataType
    if isinstance(kind, ArrayType) and isinstance(kind.elementType, StringType):
        return F.concat_ws(" ", path)
    if isinstance(kind, StructType):
        known = [F.col(f"{path}.{n}").cast("string") for n in ("name", "value", "text", "cn") if n in kind.names]
        return F.coalesce(*known) if known else F.lit(None).cast("string")
    return F.col(path).cast("string")


def _plain(spark: SparkSession, path: str) -> DataFrame:
    return lines(spark, path).select("no", F.trim(F.regexp_replace("line", "^\\ufeff", "")).alias("line")).where("line <> '' and not startswith(line, '#')")


def dictionary_tsv(spark: SparkSession, path: str, weighted: bool = False) -> DataFrame:
    """(term, label, priority) or (term, label, weight): two columns at least, the third 0 or 1.0 if it is no number."""
    parts = F.split("line", "\t")
    rows = _plain(spark, path).where(F.size(parts) >= 2).select(F.trim(parts[0]).alias("term"), F.upper(F.trim(parts[1])).alias("label"), F.trim(F.get(parts, F.lit(2))).alias("third")).where("term <> '' and label <> ''")
    third = F.coalesce(F.col("third").try_cast("double"), F.lit(1.0)).alias("weight") if weighted else F.coalesce(F.col("third").try_cast("int"), F.lit(0)).alias("priority")
    return rows.select("term", "label", third)


def lexicon(spark: SparkSession, path: str) -> DataFrame:
    """(no, key, values) of key:v1,v2 lines in order; lines without a value go, of a repeated key the last line counts."""
    parts = F.split("line", ":", 2)
    values = F.filter(F.transform(F.split(parts[1], ","), lambda x: F.trim(x)), lambda x: x != "")
    rows = _plain(spark, path).where(F.size(parts) == 2).select("no", F.trim(parts[0]).alias("key"), values.alias("values")).where("key <> '' and size(values) > 0")
    return rows.withColumn("_last", F.max("no").over(W.partitionBy("key"))).where("no = _last").drop("_last")


def label_map(spark: SparkSession, path: str) -> DataFrame:
    """(raw, label) of a table of raw and project labels, the latter in upper case; of a repeated raw label the last line counts."""
    parts = F.split("line", "\t")
    rows = _plain(spark, path).where(F.size(parts) >= 2).select("no", F.trim(parts[0]).alias("raw"), F.upper(F.trim(parts[1])).alias("label")).where("raw <> '' and label <> ''")
    return rows.groupBy("raw").agg(F.max_by("label", "no").alias("label"))


def inputs(spark: SparkSession, specs: list[str]) -> list[str]:
    """Paths of files, folders (their shards products-N, by number) and globs, in the order given, each file once.

    Works on any store that Spark reads. Shards of a folder that repeat or are missing are an error, as is no file."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    shard = re.compile(r"(?i)products-([0-9]+)\.(?:ndjson|nljson|jsonl)$")
    found: dict[str, None] = {}
    for spec in specs:
        path = jvm.org.apache.hadoop.fs.Path(spec)
        fs = path.getFileSystem(conf)
        if fs.exists(path) and fs.getFileStatus(path).isDirectory():
            held = {str(x.getPath()): shard.fullmatch(x.getPath().getName()) for x in fs.listStatus(path) if x.isFile()}
            numbered = sorted((int(m[1]), name) for name, m in held.items() if m)
            numbers = [n for n, _ in numbered]
            if numbers != list(range(1, len(numbers) + 1)):
                raise ValueError(f"{spec}: shards {numbers[:20]} do not run from 1 without gaps and repeats")
            names = [name for _, name in numbered]
        else:
            names = sorted((str(x.getPath()) for x in fs.globStatus(path) or [] if x.isFile()), key=lambda n: n.rpartition("/")[2])
        found |= dict.fromkeys(names)
    if not found:
        raise ValueError("no input file")
    return list(found)


def jdbc(spark: SparkSession, url: str, query: str, key: str, low: int, high: int, parts: int, rows: int = 5000, **options: str) -> DataFrame:
    """A query over JDBC, read in `parts` ranges of an integer key at once, each fetched `rows` at a time.

    Ranges take the place of pages after the last key: they need no page before them, and a lost one is read again.
    Keys below low and from high on fall to the first and the last range, null keys to the first."""
    if parts < 1 or high < low:
        raise ValueError("a range of keys and one part at least")
    edges = [low + (high - low) * i // parts for i in range(1, parts)]
    edges = sorted(set(edges))
    where = ["1 = 1"] if not edges else [f"{key} < {edges[0]} OR {key} IS NULL", *[f"{key} >= {a} AND {key} < {b}" for a, b in zip(edges, edges[1:])], f"{key} >= {edges[-1]}"]
    return spark.read.jdbc(url, f"({query}) q", predicates=where, properties={"fetchsize": str(rows), **options})


def word_list(spark: SparkSession, path: str) -> DataFrame:
    return _plain(spark, path).select("no", F.col("line").alias("word"))


def query_log(spark: SparkSession, path: str, columns: dict[str, str]) -> DataFrame:
    """A CSV log with the given columns under our names; a byte-order mark is no part of the first name."""
    rows = spark.read.option("header", True).option("encoding", "UTF-8").csv(path)
    rows = rows.toDF(*[c.lstrip(chr(0xFEFF)) for c in rows.columns])
    return rows.select(*[F.col(c).alias(n) for n, c in columns.items()])


# Annotation exports ---------------------------------------------------------------------------------------------------

_RESULT = "array<struct<from_name:string,to_name:string,type:string,value:struct<start:int,end:int,text:string,labels:array<string>>>>"
TASK = f"id long, data struct<text:string,query_id:string,group_id:string,source:string>, annotations array<struct<id:long,completed_by:string,was_cancelled:boolean,skipped:boolean,ground_truth:boolean,result:{_RESULT}>>"


def tasks(spark: SparkSession, path: str) -> DataFrame:
    """Tasks of an export, a JSON array."""
    return spark.read.schema(TASK).option("multiLine", True).json(path)


def chosen_annotation(rows: DataFrame) -> DataFrame:
    """tasks with `chosen`: the one ground truth, else the one annotation that is not cancelled; error says why there is none."""
    active = F.filter(F.coalesce("annotations", F.array().cast(rows.schema["annotations"].dataType)), lambda a: ~F.coalesce(a["was_cancelled"], F.lit(False)) & ~F.coalesce(a["skipped"], F.lit(False)))
    truth = F.filter(active, lambda a: F.coalesce(a["ground_truth"], F.lit(False)))
    chosen = F.when(F.size(truth) == 1, F.get(truth, F.lit(0))).when((F.size(truth) == 0) & (F.size(active) == 1), F.get(active, F.lit(0)))
    error = F.when(F.size(truth) > 1, "SEVERAL_TRUTHS").when((F.size(truth) == 0) & (F.size(active) > 1), "SEVERAL_ANNOTATIONS").when(F.size(active) == 0, "NO_ANNOTATION")
    return rows.withColumn("chosen", chosen).withColumn("error", error)


def annotation_spans(rows: DataFrame, labels: list[str]) -> DataFrame:
    """(id, start, end, label, text, fault) of the chosen annotations' label results; choices are no spans."""
    each = rows.select("id", F.col("data.text").alias("whole"), F.explode("chosen.result").alias("r")).where("r.type = 'labels'").select("id", "whole", "r.value")
    label = F.get("value.labels", F.lit(0))
    fault = (
        F.when(F.size("value.labels") != 1, "NOT_ONE_LABEL")
        .when(~label.isin(labels), "UNKNOWN_LABEL")
        .when(F.col("value.start").isNull() | F.col("value.end").isNull(), "NO_OFFSET")
        .when((F.col("value.start") < 0) | (F.col("value.end") > F.length("whole")) | (F.col("value.start") >= F.col("value.end")), "BAD_RANGE")
        .when(F.substring(F.col("whole"), F.col("value.start") + 1, F.col("value.end") - F.col("value.start")) != F.col("value.text"), "TEXT_MISMATCH")
    )
    return each.select("id", F.col("value.start").alias("start"), F.col("value.end").alias("end"), label.alias("label"), F.col("value.text").alias("text"), fault.alias("fault"))
