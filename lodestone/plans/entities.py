"""Entity, query-understanding and span queries with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import spans as S
from ..functions import text as T
from ..operators import entities as E
from ..operators import rules as R
from ..operators import serving as V
from ..sources.tables import table

ENTRIES = [
    *[(w, "CATEGORY", 0) for w in ("anvil", "bolt", "gear", "gizmo", "plate", "ring", "rod", "widget")], ("red", "COLOR", 0), ("blue", "COLOR", 0),
    *[(w, "MODIFIER", 0) for w in ("cold", "hot", "large", "new", "old", "small")], ("red widget", "SERIES", 100), ("blue gear", "MODIFIER", 50), ("Hot", "ATTRIBUTE", 0),
]
# Hot and hot are one key, and ATTRIBUTE ranks over MODIFIER
_VALUES = ", ".join(f"('{t}', '{'ATTRIBUTE' if t == 'hot' else label}', {p})" for t, label, p in ENTRIES if t != "Hot")
_SPANS_SQL = f"""
dict AS (SELECT * FROM (VALUES {_VALUES}) t(term, label, priority)),
texts AS (SELECT p_partkey AS id, p_name AS text FROM part),
cand AS (SELECT id, text, strpos(' ' || text || ' ', ' ' || term || ' ') - 1 AS s, strpos(' ' || text || ' ', ' ' || term || ' ') - 1 + length(term) AS e, label, priority
  FROM texts JOIN dict ON contains(' ' || text || ' ', ' ' || term || ' ')),
"""


def _dictionary(spark: SparkSession) -> DataFrame:
    return E.dictionary(spark.createDataFrame(ENTRIES, "term string, label string, priority int"))


def _titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("text"))


def _recognised(spark: SparkSession, sf_dir: str, longest: bool) -> DataFrame:
    """Distinct titles are recognised once."""
    titles = _titles(spark, sf_dir)
    kinds = titles.groupBy("text").agg(F.min("id").alias("id"))
    found = E.recognise(kinds, _dictionary(spark), 10, longest).select("text", "entities")
    return titles.join(found, "text").select("id", "text", "entities")


def _flat(rows: DataFrame) -> DataFrame:
    return rows.select("id", F.explode("entities").alias("e")).select("id", "e.start", "e.end", "e.label", "e.text")


def dictionary_ner(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(_recognised(spark, sf_dir, False))


def _greedy_sql(order: str) -> str:
    # terms nest one level deep here, so the best span and what does not touch it is the whole greedy choice
    return f"""WITH {_SPANS_SQL}
r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY {order}) AS k FROM cand),
b AS (SELECT id, s AS bs, e AS be FROM r WHERE k = 1)
SELECT r.id, CAST(s AS INT) AS start, CAST(e AS INT) AS end, label, substr(text, CAST(s + 1 AS INT), CAST(e - s AS INT)) AS text FROM r JOIN b USING (id) WHERE k = 1 OR s >= be OR e <= bs"""


def ner_length_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(_recognised(spark, sf_dir, True))


def offline_ner(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The weighted dictionary over distinct titles; priorities serve as weights."""
    entries = spark.createDataFrame([(t, label, p) for t, label, p in ENTRIES], "term string, label string, p int").select("term", "label", (0.5 + F.col("p") / 100.0).cast("double").alias("weight"))
    titles = _titles(spark, sf_dir)
    found = R.offline_dictionary(titles.groupBy("text").agg(F.min("id").alias("id")), entries, 10).select("text", "entities")
    return titles.join(found, "text").select("id", F.explode("entities").alias("e")).select("id", "e.start", "e.end", "e.label", "e.text", F.round("e.confidence", 6).alias("confidence"))


# offline, MODIFIER ranks over ATTRIBUTE
_OFFLINE_SQL = f"""SELECT id, start, "end", CASE WHEN text = 'hot' THEN 'MODIFIER' ELSE label END AS label, text,
  round(least(1.0::DOUBLE, 0.9::DOUBLE * CASE text WHEN 'red widget' THEN 1.5::DOUBLE WHEN 'blue gear' THEN 1.0::DOUBLE ELSE 0.5::DOUBLE END), 6) AS confidence FROM ({_greedy_sql("e - s DESC, s")})"""


def rule_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles made of part rows with model numbers, sizes and listed words; patterns look around, so there is no SQL."""
    more = F.array(*map(F.lit, ("GBH-4UB 黑色", "Mate60 Pro 512GB", "USB 2只", "不锈钢 500ml", "12mm abs", "儿童 5g")))
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.concat_ws(" ", "p_name", F.get(more, (F.col("p_partkey") % 6).cast("int"))).alias("text"))
    return R.rules(rows).select("id", F.explode("entities").alias("e")).select("id", "e.start", "e.end", "e.label", "e.text", "e.confidence")


def residual_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _recognised(spark, sf_dir, False).withColumn("entities", F.filter("entities", lambda e: e["label"] != "CATEGORY"))
    return rows.select("id", S.residual(F.col("text"), F.transform("entities", lambda e: F.struct(e["start"].alias("start"), e["end"].alias("end")))).alias("residual"))


RESIDUAL = """SELECT p_partkey AS id, CASE WHEN p_name IN ('red widget', 'blue gear') THEN ''
  ELSE trim(array_to_string(list_filter(string_split(p_name, ' '), lambda w: w NOT IN ('red', 'blue', 'cold', 'hot', 'large', 'new', 'old', 'small')), ' ')) END AS residual FROM part"""

RULES = [("red", "RED"), ("widget", "gadget"), ("small", "tiny")]


def rewrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _titles(spark, sf_dir).select("id", E.rewrite(F.col("text"), RULES).alias("rewritten"))


REWRITE = "SELECT p_partkey AS id, replace(replace(replace(p_name, 'red', 'RED'), 'widget', 'gadget'), 'small', 'tiny') AS rewritten FROM part"
SYNONYMS_OF = [("gear", ["gear", "cog"]), ("ring", ["ring", "band"]), ("rod", ["rod", "bar", "band"])]


def synonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _titles(spark, sf_dir).select("id", F.array_join(E.synonyms(F.col("text"), SYNONYMS_OF), ",").alias("synonyms"))


SYNONYMS = """SELECT p_partkey AS id, array_to_string(list_concat(CASE WHEN contains(p_name, 'gear') THEN ['gear', 'cog'] ELSE [] END,
  CASE WHEN contains(p_name, 'ring') THEN ['ring', 'band'] ELSE [] END, CASE WHEN contains(p_name, 'rod') THEN ['rod', 'bar', 'band'] ELSE [] END), ',') AS synonyms FROM part"""


def normalize_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.md5(T.normalize(F.col("text"))).alias("normal_md5"), F.md5(T.template_key(F.col("text"))).alias("template_md5"))


NORMALIZE = """WITH n AS (SELECT doc_id, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)
SELECT doc_id, md5(t) AS normal_md5, md5(regexp_replace(regexp_replace(regexp_replace(t, '[0-9]+', '#', 'g'), '[a-z]+', '@', 'g'), '[ \\t\\n\\x0B\\f\\r]+', '', 'g')) AS template_md5 FROM n"""


def cache_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _titles(spark, sf_dir)
    filters = F.array(F.lit("sort=RELEVANCE"), F.lit("pageSize=20"), F.concat(F.lit("brand="), (F.col("id") % 5).cast("string")))
    return rows.select("id", V.cache_key({"index": "index-v1", "dict": "dict-v2", "ner": "ner-v3", "rule": "rule-v4"}, F.col("text"), filters, F.lit(1)).alias("cache_key"))


CACHE_KEYS = """SELECT p_partkey AS id, 'search:result:index-v1:dict-v2:ner-v3:rule-v4:' || substr(sha256(p_name), 1, 16) || ':' ||
  substr(sha256(array_to_string(list_sort(['sort=RELEVANCE', 'pageSize=20', 'brand=' || CAST(p_partkey % 5 AS VARCHAR)]), '&')), 1, 16) || ':1' AS cache_key FROM part"""


def request_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests made of event rows, some of them wrong."""
    e = table(spark, sf_dir, "events")
    rows = e.select(F.col("event_id").alias("q"), F.when(F.col("event_id") % 7 == 0, "  ").otherwise(F.concat(F.lit(" "), "event_type")).alias("query"), (F.col("event_id") % 4 - 1).cast("int").alias("page"), F.when(F.col("event_id") % 3 == 0, None).otherwise((F.col("event_id") % 150).cast("int")).alias("page_size"), F.when(F.col("event_id") % 11 == 0, "ODD").when(F.col("event_id") % 2 == 0, None).otherwise("PRICE_ASC").alias("sort"))
    return V.normalise_requests(rows).groupBy("error_code", "sort", "page").agg(F.count("*").alias("n"), F.sum("page_size").alias("sizes"), F.max("query").alias("last_query"))


REQUESTS = """WITH r AS (SELECT event_id, CASE WHEN event_id % 7 = 0 THEN '  ' ELSE ' ' || event_type END AS query, event_id % 4 - 1 AS page,
  CASE WHEN event_id % 3 <> 0 THEN event_id % 150 END AS page_size, CASE WHEN event_id % 11 = 0 THEN 'ODD' WHEN event_id % 2 <> 0 THEN 'PRICE_ASC' END AS sort FROM events),
n AS (SELECT trim(query) AS query, CAST(greatest(page, 1) AS INT) AS page, least(CASE WHEN page_size IS NULL OR page_size < 1 THEN 20 ELSE page_size END, 100) AS page_size, coalesce(sort, 'RELEVANCE') AS sort,
  CASE WHEN trim(query) = '' THEN 'QUERY_BLANK' WHEN length(query) > 100 THEN 'QUERY_TOO_LONG' WHEN sort = 'ODD' THEN 'BAD_SORT' END AS error_code FROM r)
SELECT error_code, sort, page, count(*) AS n, CAST(sum(page_size) AS BIGINT) AS sizes, max(query) AS last_query FROM n GROUP BY error_code, sort, page"""


def measure_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantities in titles made of part rows; patterns look behind, so there is no SQL."""
    units = F.array(*map(F.lit, ("500ml", "1kg 盒装", "8x250mm", "12GB+512GB", "220-240V", "512G", "500g", "6口味", "2只", "10英寸")))
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.concat_ws(" ", "p_name", F.get(units, (F.col("p_partkey") % 10).cast("int"))).alias("text"))
    return E.annotate_measures(rows)


def viterbi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two tags over emissions made of line quantities, for every order at its full length; tests compare all paths."""
    line = F.struct("l_linenumber", (F.col("l_quantity") % 7).alias("a"), (F.col("l_quantity") % 5).alias("b"))
    rows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(line)).alias("x"))
    path = S.viterbi(F.transform("x", lambda e: F.array(e["a"], e["b"])), *VITERBI_SCORES)
    return rows.select("l_orderkey", F.array_join(F.transform(path, lambda t: t.cast("string")), "").alias("path"))


#: Scores of tag to tag, of the first tag and of the last.
VITERBI_SCORES = ([[2.0, 0.5], [1.0, 1.5]], [0.25, 0.0], [0.0, 0.75])


def bio_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tags made of line flags: R begins, A goes on, N is outside."""
    rows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_returnflag"))).alias("x"))
    tags = F.transform("x", lambda e: F.when(e["l_returnflag"] == "R", "B-X").when(e["l_returnflag"] == "A", "I-X").otherwise("O"))
    spans = rows.select("l_orderkey", F.explode(S.bio_decode(tags)).alias("s"))
    return spans.select("l_orderkey", "s.start", "s.end", "s.label")


BIO = """WITH t AS (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_returnflag) - 1 AS i, l_returnflag AS f, lag(l_returnflag) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_returnflag) AS pf FROM lineitem),
b AS (SELECT *, sum(CASE WHEN f = 'R' OR (f = 'A' AND (pf IS NULL OR pf = 'N')) THEN 1 ELSE 0 END) OVER (PARTITION BY l_orderkey ORDER BY i) AS g FROM t)
SELECT l_orderkey, CAST(min(i) AS INT) AS start, CAST(max(i) + 1 AS INT) AS end, 'X' AS label FROM b WHERE f <> 'N' GROUP BY l_orderkey, g"""


def entity_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clauses of requests that name distinct titles, in words."""
    titles = _titles(spark, sf_dir).groupBy("text").agg(F.min("id").alias("id"))
    found = E.recognise(titles, _dictionary(spark), 10)
    rows = found.select(F.col("id").alias("q"), S.residual(F.col("text"), F.transform("entities", lambda e: F.struct(e["start"].alias("start"), e["end"].alias("end")))).alias("residual"), F.transform("entities", lambda e: F.struct(e["label"].alias("label"), e["text"].alias("text"))).alias("entities"))
    return E.entity_clauses(spark, rows).groupBy("occur", "kind", "field", "boost", "msm").agg(F.count("*").alias("clauses"))


ENTITY_QUERY = f"""WITH dict AS (SELECT * FROM (VALUES {_VALUES}) t(term, label, priority)),
t AS (SELECT DISTINCT p_name AS text FROM part),
e AS (SELECT text, 'SERIES' AS label FROM t WHERE text = 'red widget' UNION ALL SELECT text, 'MODIFIER' FROM t WHERE text = 'blue gear'
  UNION ALL SELECT text, label FROM (SELECT text, unnest(string_split(text, ' ')) AS w FROM t WHERE text NOT IN ('red widget', 'blue gear')) JOIN dict ON w = term),
c AS (SELECT * FROM (VALUES ('CATEGORY', 'match', 'category_name', 50.0), ('CATEGORY', 'phrase', 'title', 40.0), ('MODIFIER', 'match', 'tags', 10.0), ('MODIFIER', 'match', 'title', 5.0),
  ('COLOR', 'match', 'attributes', 8.0), ('ATTRIBUTE', 'match', 'attributes', 5.0), ('ATTRIBUTE', 'match', 'title', 5.0), ('SERIES', 'match', 'model_no', 20.0)) t(label, kind, field, boost))
SELECT 'should' AS occur, kind, field, CAST(boost AS DOUBLE) AS boost, 1 AS msm, count(*) AS clauses FROM e JOIN c USING (label) GROUP BY kind, field, boost"""

QUERIES = {
    "dictionary_ner": (dictionary_ner, _greedy_sql("priority DESC, s")),
    "ner_length_first": (ner_length_first, _greedy_sql("e - s DESC, priority DESC, s")),
    "offline_ner": (offline_ner, _OFFLINE_SQL),
    "rule_spans": (rule_spans, None),
    "residual_text": (residual_text, RESIDUAL),
    "rewrite": (rewrite, REWRITE),
    "synonyms": (synonyms, SYNONYMS),
    "normalize_text": (normalize_text, NORMALIZE),
    "cache_keys": (cache_keys, CACHE_KEYS),
    "request_checks": (request_checks, REQUESTS),
    "measure_spans": (measure_spans, None),
    "viterbi": (viterbi, None),
    "bio_decode": (bio_decode, BIO),
    "entity_query": (entity_query, ENTITY_QUERY),
}
