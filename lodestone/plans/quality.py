"""Annotation-quality and streaming queries with their SQL.

Gold spans are the words of part names; predictions are a copy that the key perturbs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import decode as D
from ..operators import quality as Q
from ..operators import weak_labels as L
from ..sources.tables import table

LABELS = ["MODIFIER", "CATEGORY", "COLOR"]
_SPANS = "array<struct<start:int,end:int,label:string,text:string>>"


def _words(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("text"), F.split("p_name", " ").alias("w"))
    return p.withColumn("cut", F.length(F.col("w")[0]))


def gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _words(spark, sf_dir)
    a = p.select("id", F.lit(0).alias("start"), F.col("cut").alias("end"), F.when(F.col("w")[0].isin("red", "blue"), "COLOR").otherwise("MODIFIER").alias("label"), F.col("w")[0].alias("text"))
    return a.union(p.select("id", F.col("cut") + 1, F.length("text"), F.lit("CATEGORY"), F.col("w")[1]))


def pred(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of gold: every 7th has another label, every 5th ends early, every 11th is missing, every 13th has one span more."""
    g = gold(spark, sf_dir)
    k = F.col("id") + F.col("start")
    changed = g.where(k % 11 != 0).select("id", "start", F.when(k % 5 == 0, F.col("end") - 1).otherwise(F.col("end")).alias("end"), F.when(k % 7 == 0, "COLOR").otherwise(F.col("label")).alias("label"), "text")
    return changed.union(g.where((F.col("id") % 13 == 0) & (F.col("start") == 0)).select("id", F.lit(90), F.lit(95), F.lit("COLOR"), F.lit("extra")))


_SPANS_SQL = """
w AS (SELECT p_partkey AS id, p_name AS t, split_part(p_name, ' ', 1) AS a, split_part(p_name, ' ', 2) AS b FROM part),
gold AS (SELECT id, 0 AS s, length(a) AS e, CASE WHEN a IN ('red', 'blue') THEN 'COLOR' ELSE 'MODIFIER' END AS label, a AS text FROM w UNION ALL SELECT id, length(a) + 1, length(t), 'CATEGORY', b FROM w),
pred AS (SELECT id, s, CASE WHEN (id + s) % 5 = 0 THEN e - 1 ELSE e END AS e, CASE WHEN (id + s) % 7 = 0 THEN 'COLOR' ELSE label END AS label, text FROM gold WHERE (id + s) % 11 <> 0
  UNION ALL SELECT id, 90, 95, 'COLOR', 'extra' FROM gold WHERE id % 13 = 0 AND s = 0),
j AS (SELECT coalesce(g.label, p.label) AS label, g.id IS NOT NULL AND p.id IS NOT NULL AS tp, g.id IS NULL AS fp, p.id IS NULL AS fn FROM gold g FULL JOIN pred p ON g.id = p.id AND g.s = p.s AND g.e = p.e AND g.label = p.label)"""


def span_prf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.scores(Q.outcomes(gold(spark, sf_dir), pred(spark, sf_dir)))


SPAN_PRF = f"""WITH {_SPANS_SQL},
c AS (SELECT label, CAST(count(*) FILTER (tp) AS BIGINT) AS tp, CAST(count(*) FILTER (fp) AS BIGINT) AS fp, CAST(count(*) FILTER (fn) AS BIGINT) AS fn FROM j GROUP BY label
  UNION ALL SELECT 'micro', count(*) FILTER (tp), count(*) FILTER (fp), count(*) FILTER (fn) FROM j),
r AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp::DOUBLE / (tp + fp) ELSE 0.0::DOUBLE END AS p, CASE WHEN tp + fn > 0 THEN tp::DOUBLE / (tp + fn) ELSE 0.0::DOUBLE END AS q FROM c),
f AS (SELECT label, tp, fp, fn, round(p, 6) AS precision, round(q, 6) AS recall, round(CASE WHEN p + q > 0 THEN 2 * p * q / (p + q) ELSE 0.0::DOUBLE END, 6) AS f1 FROM r)
SELECT * FROM f UNION ALL SELECT 'macro', CAST(sum(tp) AS BIGINT), CAST(sum(fp) AS BIGINT), CAST(sum(fn) AS BIGINT), round(avg(precision), 6), round(avg(recall), 6), round(avg(f1), 6) FROM f WHERE label <> 'micro' AND tp + fn > 0"""


def confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.confusion(gold(spark, sf_dir), pred(spark, sf_dir))


CONFUSION = f"WITH {_SPANS_SQL} SELECT coalesce(g.label, 'O') AS gold, coalesce(p.label, 'O') AS pred, count(*) AS n FROM gold g FULL JOIN pred p ON g.id = p.id AND g.s = p.s AND g.e = p.e GROUP BY 1, 2"


def error_taxonomy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.error_kinds(gold(spark, sf_dir), pred(spark, sf_dir)).groupBy("kind", "gold_label", "pred_label").agg(F.count("*").alias("n"))


# here a gold span overlaps its own perturbed copy alone, so no greedy order is needed
ERRORS = f"""WITH {_SPANS_SQL},
x AS (SELECT CASE WHEN p.id IS NULL THEN 'missing' WHEN g.s = p.s AND g.e = p.e THEN 'type' WHEN g.label = p.label THEN 'boundary' ELSE 'boundary_type' END AS kind, g.label AS gold_label, p.label AS pred_label
  FROM gold g LEFT JOIN pred p ON g.id = p.id AND g.s = p.s AND p.s < 90 WHERE p.id IS NULL OR g.e <> p.e OR g.label <> p.label
  UNION ALL SELECT 'spurious', NULL, label FROM pred WHERE s = 90)
SELECT kind, gold_label, pred_label, count(*) AS n FROM x GROUP BY ALL"""


def oov_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = spark.createDataFrame([(w,) for w in ("gear", "bolt", "red", "hot", "new")], "surface string")
    return Q.oov_recall(gold(spark, sf_dir), pred(spark, sf_dir), known)


OOV = f"""WITH {_SPANS_SQL}, u AS (SELECT * FROM gold WHERE text NOT IN ('gear', 'bolt', 'red', 'hot', 'new'))
SELECT count(*) AS support, count(p.id) AS found, round(avg(CASE WHEN p.id IS NULL THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END), 6) AS recall FROM u LEFT JOIN pred p ON u.id = p.id AND u.s = p.s AND u.e = p.e AND u.label = p.label"""


def _annotators(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, name, spans) of two annotators: gold and the perturbed copy; every 3rd item has but one."""
    lists = lambda d: d.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("start", "end", "label"))).alias("spans"))
    a = lists(gold(spark, sf_dir)).withColumn("name", F.lit("ann"))
    b = lists(pred(spark, sf_dir)).where("id % 3 <> 0").withColumn("name", F.lit("ben"))
    return a.unionByName(b)


def agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.agreement(_annotators(spark, sf_dir))


AGREEMENT = f"""WITH {_SPANS_SQL}, g AS (SELECT * FROM gold WHERE id % 3 <> 0 AND id IN (SELECT id FROM pred)), p AS (SELECT * FROM pred WHERE id % 3 <> 0),
m AS (SELECT g.id, count(*) AS m FROM g JOIN p ON g.id = p.id AND g.s = p.s AND g.e = p.e AND g.label = p.label GROUP BY g.id),
c AS (SELECT id, (SELECT count(*) FROM g WHERE g.id = x.id) AS l, (SELECT count(*) FROM p WHERE p.id = x.id) AS r FROM (SELECT DISTINCT id FROM g) x)
SELECT count(*) AS pairs, count(*) FILTER (coalesce(m, 0) = l AND coalesce(m, 0) = r) AS exact, round(count(*) FILTER (coalesce(m, 0) = l AND coalesce(m, 0) = r)::DOUBLE / count(*), 6) AS exact_rate,
  round((2 * sum(coalesce(m, 0)))::DOUBLE / sum(l + r)::DOUBLE, 6) AS f1 FROM c LEFT JOIN m USING (id)"""


def conflict_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _annotators(spark, sf_dir)
    l, r = rows.where("name = 'ann'").select("id", F.col("spans").alias("l")), rows.where("name = 'ben'").select("id", F.col("spans").alias("r"))
    return l.join(r, "id").groupBy(Q.conflict_kind(F.col("l"), F.col("r")).alias("kind")).agg(F.count("*").alias("n"))


CONFLICT_TYPES = f"""WITH {_SPANS_SQL}, g AS (SELECT id, list({{'s': s, 'e': e, 'l': label}} ORDER BY s, e, label) AS l, list({{'s': s, 'e': e}} ORDER BY s, e) AS lp FROM gold GROUP BY id),
p AS (SELECT id, list({{'s': s, 'e': e, 'l': label}} ORDER BY s, e, label) AS r, list({{'s': s, 'e': e}} ORDER BY s, e) AS rp FROM pred WHERE id % 3 <> 0 GROUP BY id)
SELECT CASE WHEN l = r THEN 'NONE' WHEN lp = rp THEN 'LABEL' WHEN len(l) = len(r) AND NOT list_contains(list_transform(rp, lambda x: x.s), 90) THEN 'BOUNDARY' ELSE 'ENTITY_SET' END AS kind, count(*) AS n FROM g JOIN p USING (id) GROUP BY 1"""


def merge_gold_silver(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _annotators(spark, sf_dir)
    decided = table(spark, sf_dir, "part").where("p_partkey % 2 = 0").select(F.col("p_partkey").alias("id"))
    return Q.merge_annotations(rows, decided).groupBy("status").agg(F.count("*").alias("n"))


MERGE = f"""WITH {_SPANS_SQL}, g AS (SELECT id, list({{'s': s, 'e': e, 'l': label}} ORDER BY s, e, label) AS l FROM gold GROUP BY id),
p AS (SELECT id, list({{'s': s, 'e': e, 'l': label}} ORDER BY s, e, label) AS r FROM pred WHERE id % 3 <> 0 GROUP BY id)
SELECT CASE WHEN r IS NULL THEN 'silver_single' WHEN l = r THEN 'gold_agreement' WHEN id % 2 = 0 THEN 'gold_adjudicated' ELSE 'unresolved' END AS status, count(*) AS n FROM g LEFT JOIN p USING (id) GROUP BY 1"""


def assign_round_robin(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"))
    return Q.assign(items, ["ann", "ben", "cyd"], 0.2).groupBy("annotator", "role").agg(F.count("*").alias("n"), F.sum("id").alias("ids"))


ASSIGN = """WITH o AS (SELECT p_partkey AS id, row_number() OVER (ORDER BY sha256('42:' || p_partkey), p_partkey) - 1 AS k, count(*) OVER () AS n FROM part),
names AS (SELECT ['ann', 'ben', 'cyd'] AS l),
r AS (SELECT l[1 + k % 3] AS annotator, CASE WHEN k < round_even(n * 0.2::DOUBLE, 0) THEN 'overlap_primary' ELSE 'single' END AS role, id FROM o, names
  UNION ALL SELECT l[1 + (k + 1 + (k // 3) % 2) % 3], 'overlap_secondary', id FROM o, names WHERE k < round_even(n * 0.2::DOUBLE, 0))
SELECT annotator, role, count(*) AS n, CAST(sum(id) AS BIGINT) AS ids FROM r GROUP BY annotator, role"""


def validate_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = pred(spark, sf_dir).groupBy("id").agg(F.collect_list(F.struct("start", "end", "label", "text")).alias("entities"))
    texts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("text"))
    return Q.validate(texts.join(rows, "id"), ["MODIFIER", "CATEGORY", "COLOR"])


VALIDATE = f"""WITH {_SPANS_SQL} SELECT CASE WHEN e > length(t) OR s >= e THEN 'BAD_RANGE' WHEN substr(t, CAST(s + 1 AS INT), CAST(e - s AS INT)) <> text THEN 'TEXT_MISMATCH' ELSE 'OK' END AS code, count(*) AS n FROM pred JOIN w USING (id) GROUP BY 1"""


def class_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.class_weights(gold(spark, sf_dir).select(F.col("label").alias("tag")))


WEIGHTS = f"""WITH {_SPANS_SQL}, c AS (SELECT label AS tag, least(10.0::DOUBLE, sqrt(sum(count(*)) OVER ()::DOUBLE / count(*))) AS w FROM gold GROUP BY label) SELECT tag, round(w / avg(w) OVER (), 6) AS weight FROM c"""


def uncertainty(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = pred(spark, sf_dir).groupBy("id").agg(F.collect_list(F.struct(F.col("label"), (F.lit(0.5) + (F.col("id") % 50) / 100.0).alias("confidence"))).alias("entities"))
    all_ids = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"))
    return all_ids.join(rows, "id", "left").groupBy(L.uncertain(F.col("entities"), ["CATEGORY"], 0.6).alias("reason")).agg(F.count("*").alias("n"))


UNCERTAIN = f"""WITH {_SPANS_SQL}, x AS (SELECT p_partkey AS id, list(label) FILTER (label IS NOT NULL) AS l FROM part LEFT JOIN pred ON id = p_partkey GROUP BY p_partkey)
SELECT CASE WHEN l IS NULL OR len(l) = 0 THEN 'no_entity' WHEN NOT list_contains(l, 'CATEGORY') THEN 'missing:CATEGORY' WHEN 0.5 + (id % 50) / 100.0::DOUBLE < 0.6 THEN 'low_confidence' END AS reason, count(*) AS n FROM x GROUP BY 1"""


def structured_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Brands and the first category that stand in titles made of brand, name and type."""
    p = table(spark, sf_dir, "part")
    rows = p.select(F.col("p_partkey").alias("id"), F.concat_ws(" ", "p_brand", "p_name", "p_brand").alias("text"), F.array("p_brand").alias("brands"), F.array(F.lit("zzz"), F.split("p_name", " ")[1], F.split("p_name", " ")[0]).alias("categories"))
    spans = L.structured(rows).select("id", F.explode("entities").alias("e"))
    return spans.select("id", "e.start", "e.end", "e.label", "e.text")


STRUCTURED = """WITH t AS (SELECT p_partkey AS id, p_brand AS b, split_part(p_name, ' ', 2) AS c, p_brand || ' ' || p_name || ' ' || p_brand AS text FROM part)
SELECT id, 0 AS start, CAST(length(b) AS INT) AS end, 'BRAND' AS label, b AS text FROM t UNION ALL SELECT id, CAST(length(text) - length(b) AS INT), CAST(length(text) AS INT), 'BRAND', b FROM t
UNION ALL SELECT id, CAST(length(text) - length(b) - 1 - length(c) AS INT), CAST(length(text) - length(b) - 1 AS INT), 'CATEGORY', c FROM t"""


def parity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of items whose spans two models give alike, and the difference of their micro F1 against gold."""
    rows = _annotators(spark, sf_dir)
    l, r = rows.where("name = 'ann'").select("id", F.col("spans").alias("l")), rows.where("name = 'ben'").select("id", F.col("spans").alias("r"))
    return l.join(r, "id").agg(F.count("*").alias("items"), F.round(F.avg((F.col("l") != F.col("r")).cast("double")), 6).alias("mismatch_rate"))


PARITY = f"""WITH {_SPANS_SQL}, g AS (SELECT id, list({{'s': s, 'e': e, 'l': label}} ORDER BY s, e, label) AS l FROM gold GROUP BY id),
p AS (SELECT id, list({{'s': s, 'e': e, 'l': label}} ORDER BY s, e, label) AS r FROM pred WHERE id % 3 <> 0 GROUP BY id)
SELECT count(*) AS items, round(avg(CASE WHEN l = r THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END), 6) AS mismatch_rate FROM g JOIN p USING (id)"""

def compare_annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    other = d.where("id % 7 <> 0").withColumn("text", F.when(F.col("id") % 5 == 0, F.concat("text", F.lit("."))).otherwise(F.col("text")))
    return Q.compare(d.where("id % 11 <> 0"), other).groupBy("fault").agg(F.count("*").alias("n"), F.sum("id").alias("ids"))


COMPARE = """WITH l AS (SELECT doc_id AS id, text FROM documents WHERE doc_id % 11 <> 0), r AS (SELECT doc_id AS id, CASE WHEN doc_id % 5 = 0 THEN text || '.' ELSE text END AS text FROM documents WHERE doc_id % 7 <> 0),
f AS (SELECT coalesce(l.id, r.id) AS id, CASE WHEN r.id IS NULL THEN 'LEFT_ONLY' WHEN l.id IS NULL THEN 'RIGHT_ONLY' WHEN l.text <> r.text THEN 'TEXT_MISMATCH' END AS fault FROM l FULL JOIN r ON l.id = r.id)
SELECT fault, count(*) AS n, CAST(sum(id) AS BIGINT) AS ids FROM f WHERE fault IS NOT NULL GROUP BY fault"""


def project_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tags of the characters of part names under their gold spans."""
    spans = gold(spark, sf_dir).groupBy("id").agg(F.array_sort(F.collect_list(F.struct("start", "end", "label"))).alias("spans"))
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("text")).join(spans, "id")
    return rows.withColumn("tokens", D.characters(F.col("text"))).select("id", F.array_join(D.tags(F.col("tokens"), F.col("spans")), " ").alias("tags"))


TAGS = f"""WITH {_SPANS_SQL}, x AS (SELECT id, string_agg('B-' || label || repeat(' I-' || label, CAST(e - s - 1 AS INT)), ' ' ORDER BY s) AS tags FROM gold GROUP BY id) SELECT id, tags FROM x"""


def span_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans made of lines: equal ones of several ship modes become one."""
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("id"), F.col("l_linenumber").alias("start"), (F.col("l_linenumber") + 1).alias("end"), F.col("l_returnflag").alias("label"), (F.col("l_orderkey") % 7).cast("string").alias("source"), (F.col("l_linestatus") == "F").alias("locked"))
    return Q.merge_candidates(rows).withColumn("sources", F.array_join("sources", ",")).withColumn("locked", F.col("locked").cast("int"))


SOURCES = """SELECT l_partkey AS id, l_linenumber AS start, l_linenumber + 1 AS end, l_returnflag AS label, string_agg(DISTINCT CAST(l_orderkey % 7 AS VARCHAR), ',' ORDER BY CAST(l_orderkey % 7 AS VARCHAR)) AS sources,
  CAST(max(CASE WHEN l_linestatus = 'F' THEN 1 ELSE 0 END) AS INT) AS locked FROM lineitem GROUP BY ALL"""


def key_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.key_faults(table(spark, sf_dir, "lineitem"), "l_orderkey")


KEY_CHECK = "SELECT l_orderkey AS key, count(*) AS n FROM lineitem GROUP BY l_orderkey HAVING count(*) > 1 OR l_orderkey IS NULL"


def aligned_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders against themselves, some ids changed and the last ones cut off."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("no"), F.col("o_custkey").alias("id"))
    other = o.where("no % 10 <> 3").withColumn("id", F.when(F.col("no") % 7 == 0, F.col("id") + 1).otherwise(F.col("id")))
    return Q.aligned(o, other)


ALIGNED = """SELECT no, left_id, right_id, fault FROM (SELECT o_orderkey AS no, o_custkey AS left_id,
  CASE WHEN o_orderkey % 10 = 3 THEN NULL WHEN o_orderkey % 7 = 0 THEN o_custkey + 1 ELSE o_custkey END AS right_id, CASE WHEN o_orderkey % 10 = 3 THEN 'RIGHT_SHORTER' WHEN o_orderkey % 7 = 0 THEN 'ID_MISMATCH' END AS fault FROM orders) WHERE fault IS NOT NULL"""

QUERIES = {
    "span_sources": (span_sources, SOURCES),
    "key_check": (key_check, KEY_CHECK),
    "aligned_rows": (aligned_rows, ALIGNED),
    "compare_annotations": (compare_annotations, COMPARE),
    "project_tags": (project_tags, TAGS),
    "span_prf": (span_prf, SPAN_PRF),
    "confusion": (confusion, CONFUSION),
    "error_taxonomy": (error_taxonomy, ERRORS),
    "oov_recall": (oov_recall, OOV),
    "agreement": (agreement, AGREEMENT),
    "conflict_types": (conflict_types, CONFLICT_TYPES),
    "merge_gold_silver": (merge_gold_silver, MERGE),
    "assign_round_robin": (assign_round_robin, ASSIGN),
    "validate_spans": (validate_spans, VALIDATE),
    "class_weights": (class_weights, WEIGHTS),
    "uncertainty": (uncertainty, UNCERTAIN),
    "structured_spans": (structured_spans, STRUCTURED),
    "model_parity": (parity, PARITY),
}
