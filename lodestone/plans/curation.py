"""Curation, grouping and join queries with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import curation as C
from ..operators import grouping as G
from ..sources.tables import table


def import_funnel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as titles: language, length, markup and digits drop rows, then repeated texts of a source."""
    d = table(spark, sf_dir, "documents")
    rules = [("channel", ~F.col("lang").isin("en", "fr", "de")), ("length", ~F.col("n_chars").between(60, 20000)), ("test", F.col("text").rlike(C.TEST_TITLE)), ("markup", F.col("text").rlike(C.MARKUP)), ("shouting", F.contains("text", F.lit("!!")))]
    return C.drop_counts(C.funnel(d, rules, [("dup_text", ["text"]), ("dup_start", ["source", "lang", "n_chars"])], [F.col("doc_id")]))


IMPORT_FUNNEL = r"""WITH r AS (SELECT *, CASE WHEN lang NOT IN ('en', 'fr', 'de') THEN 'channel' WHEN n_chars NOT BETWEEN 60 AND 20000 THEN 'length'
  WHEN regexp_matches(text, '<[A-Za-z/][^>]{0,200}>|&([A-Za-z]{2,12}|#\d{2,7}|#x[0-9A-Fa-f]{2,6});') THEN 'markup' WHEN contains(text, '!!') THEN 'shouting' END AS reason FROM documents),
a AS (SELECT *, row_number() OVER (PARTITION BY reason IS NULL, text ORDER BY doc_id) AS k FROM r),
b AS (SELECT * EXCLUDE (reason, k), CASE WHEN reason IS NULL AND k > 1 THEN 'dup_text' ELSE reason END AS reason FROM a),
c AS (SELECT *, row_number() OVER (PARTITION BY reason IS NULL, source, lang, n_chars ORDER BY doc_id) AS k FROM b)
SELECT coalesce(CASE WHEN reason IS NULL AND k > 1 THEN 'dup_start' ELSE reason END, 'kept') AS reason, count(*) AS n FROM c GROUP BY 1"""


def dedup_sku_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    return C.dedup_first(p, ["p_brand", "p_name"], [F.col("p_partkey")]).select("p_partkey", "p_brand", "p_name")


DEDUP = "SELECT p_partkey, p_brand, p_name FROM part QUALIFY row_number() OVER (PARTITION BY p_brand, p_name ORDER BY p_partkey) = 1"


def field_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return C.coverage(d, ["text", "lang", "quality", "toxic"])


COVERAGE = """WITH d AS (SELECT * FROM documents LEFT JOIN labels USING (doc_id)),
f AS (SELECT 'text' AS field, trim(text) <> '' AS has FROM d UNION ALL SELECT 'lang', trim(lang) <> '' FROM d UNION ALL SELECT 'quality', quality IS NOT NULL FROM d UNION ALL SELECT 'toxic', toxic IS NOT NULL FROM d)
SELECT field, count(*) FILTER (has) AS filled, round(avg(CASE WHEN has THEN 1.0::DOUBLE ELSE 0.0 END) * 100, 4) AS pct FROM f GROUP BY field"""


def cardinality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct titles, rows over the first of each, templates and the largest template."""
    rows = table(spark, sf_dir, "events").select(F.concat_ws(" ", "event_type", "props").alias("title"))
    titles = rows.groupBy("title").agg(F.count("*").alias("n"))
    one = titles.agg(F.count("*").alias("titles"), F.sum(F.col("n") - 1).alias("repeats"))
    keys = titles.groupBy(T.template_key(F.col("title")).alias("k")).agg(F.sum("n").alias("n")).agg(F.count("*").alias("templates"), F.max("n").alias("largest"))
    return one.crossJoin(F.broadcast(keys))


CARDINALITY = """WITH t AS (SELECT event_type || ' ' || props AS title, count(*) AS n FROM events GROUP BY 1),
k AS (SELECT regexp_replace(regexp_replace(regexp_replace(lower(title), '[0-9]+', '#', 'g'), '[a-z]+', '@', 'g'), '\\s+', '', 'g') AS k, sum(n) AS n FROM t GROUP BY 1)
SELECT (SELECT count(*) FROM t) AS titles, (SELECT CAST(sum(n - 1) AS BIGINT) FROM t) AS repeats, count(*) AS templates, CAST(max(n) AS BIGINT) AS largest FROM k"""


def verbatim_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    words = F.split("p_name", " ")
    return p.groupBy("p_brand").agg(F.round(F.avg(F.contains(T.normalize(F.col("p_name")), T.normalize(F.substring("p_type", 1, 2))).cast("double")), 6).alias("type_in_title"), F.round(F.avg((words[0] == "red").cast("double")), 6).alias("red"))


VERBATIM = "SELECT p_brand, round(avg(CASE WHEN contains(lower(p_name), lower(substr(p_type, 1, 2))) THEN 1.0::DOUBLE ELSE 0.0 END), 6) AS type_in_title, round(avg(CASE WHEN split_part(p_name, ' ', 1) = 'red' THEN 1.0::DOUBLE ELSE 0.0 END), 6) AS red FROM part GROUP BY p_brand"


def _percentile(function, place: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return function(table(spark, sf_dir, "documents"), "n_chars", [0.5, 0.9, 0.95, 0.99], ["lang"])

    sql = f"""WITH r AS (SELECT lang, n_chars, row_number() OVER (PARTITION BY lang ORDER BY n_chars) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n FROM documents),
qs AS (SELECT unnest([0.5, 0.9, 0.95, 0.99])::DOUBLE AS q) SELECT lang, q, n_chars AS value FROM r, qs WHERE i = {place}"""
    return query, sql


def length_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.length_coverage(table(spark, sf_dir, "documents"), F.length("text"), [64, 128, 512, 2048, 8192])


LENGTHS = "SELECT c AS max_length, round(avg(CASE WHEN length(text) <= c THEN 1.0::DOUBLE ELSE 0.0 END) * 100, 6) AS pct FROM documents, (SELECT unnest([64, 128, 512, 2048, 8192])::INT AS c) GROUP BY c"


def template_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select(T.template_key(F.concat_ws(" ", "event_type", "props")).alias("template"))
    return rows.groupBy("template").agg(F.count("*").alias("n"))


TEMPLATES = "SELECT regexp_replace(regexp_replace(regexp_replace(lower(event_type || ' ' || props), '[0-9]+', '#', 'g'), '[a-z]+', '@', 'g'), '\\s+', '', 'g') AS template, count(*) AS n FROM events GROUP BY 1"
_GRAMS = """t AS (SELECT p_partkey AS id, regexp_replace(lower(p_name || p_brand), '\\s+', '', 'g') AS t FROM part),
g AS (SELECT DISTINCT id, substr(t, CAST(i AS INT), 4) AS s FROM t, LATERAL (SELECT unnest(range(1, greatest(length(t) - 2, 2))) AS i))"""


def shingles(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    rows = p.select(F.col("p_partkey").alias("id"), F.explode(T.shingles(F.concat("p_name", "p_brand"))).alias("s"))
    return rows.groupBy("id").agg(F.count("*").alias("n"), F.min(F.substring(F.md5("s"), 1, 16)).alias("least"))


SHINGLES = f"WITH {_GRAMS} SELECT id, count(*) AS n, min(substr(md5(s), 1, 16)) AS least FROM g GROUP BY id"


def minhash_signature(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    return G.signatures(p, "p_partkey", F.concat("p_name", "p_brand"), G.permutations(8))


MINHASH = f"""WITH {_GRAMS}, h AS (SELECT id, (('0x' || substr(md5(s), 1, 16))::UBIGINT)::HUGEINT % {G.MERSENNE} AS h FROM g),
p AS (SELECT * FROM (VALUES {", ".join(f"({i}, {a}::HUGEINT, {b}::HUGEINT)" for i, (a, b) in enumerate(G.permutations(8)))}) t(p, a, b))
SELECT id, CAST(p AS INT) AS p, CAST(min((a * h + b) % {G.MERSENNE}) AS BIGINT) AS value FROM h, p GROUP BY id, p"""


def _names(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    return p.select(F.col("p_partkey").alias("id"), F.concat_ws(" ", "p_name", "p_brand", "p_type", "p_size").alias("text"), "p_brand", "p_name", "p_type", "p_size")


def lsh_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _names(spark, sf_dir)
    sets = rows.select("id", T.shingles(F.col("text")).alias("x"))
    return G.lsh_pairs(G.fast_signatures(rows, "id", F.col("text"), 64), sets, 16, 4, 0.8)


def dup_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of all parts over equal names of a brand and equal kinds and sizes of a name. Reachability over whole groups
    is too slow in SQL; tests compare with union-find."""
    from ..sources.shared import folder

    rows = _names(spark, sf_dir)
    edges = G.key_edges(rows, "id", F.concat_ws("|", "p_brand", "p_name")).union(G.key_edges(rows, "id", F.concat_ws("|", "p_name", "p_type", F.col("p_size").cast("string"))))
    return G.components(spark, rows.select("id"), edges, folder(spark, "groups"))


def split_no_leak(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows and leaking groups of a split by name."""
    rows = _names(spark, sf_dir).select("id", F.xxhash64("p_name", "p_brand").alias("grp"))
    placed = rows.join(G.split_groups(rows, {"train": 0.8, "validation": 0.1, "test": 0.1}).select("grp", "split"), "grp")
    bad = G.leaks(placed).agg(F.count("*").alias("leaks"))
    return placed.agg(F.count("*").alias("n"), F.count_distinct("split").alias("splits"), F.count_distinct("grp").alias("groups")).crossJoin(F.broadcast(bad))


SPLIT = "SELECT count(*) AS n, CAST(3 AS BIGINT) AS splits, count(DISTINCT p_name || p_brand) AS groups, CAST(0 AS BIGINT) AS leaks FROM part"


def bottom_k_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.bottom_k(table(spark, sf_dir, "documents"), F.col("doc_id"), 100).select("doc_id", "sample_hash")


BOTTOM_K = "SELECT doc_id, substr(md5('42|' || CAST(doc_id AS VARCHAR)), 1, 16) AS sample_hash FROM documents ORDER BY sample_hash LIMIT 100"


def strat_quota(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.stratified(table(spark, sf_dir, "part"), "p_type", F.col("p_partkey"), 100).select("p_partkey", "p_type", "quota")


STRAT = """WITH s AS (SELECT p_type, greatest(1, CAST(round_even(100.0::DOUBLE * count(*) / sum(count(*)) OVER (), 0) AS INT)) AS quota FROM part GROUP BY p_type)
SELECT p_partkey, p_type, quota FROM part JOIN s USING (p_type) QUALIFY row_number() OVER (PARTITION BY p_type ORDER BY substr(md5('42|' || CAST(p_partkey AS VARCHAR)), 1, 16)) <= quota"""


def strat_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Many small strata: quotas fall short of the number and are topped up."""
    return C.sample(table(spark, sf_dir, "part"), "p_brand", F.col("p_partkey"), 120).select("p_partkey", "p_brand")


STRAT_SAMPLE = """WITH s AS (SELECT p_brand, greatest(1, CAST(round_even(120.0::DOUBLE * count(*) / sum(count(*)) OVER (), 0) AS INT)) AS quota FROM part GROUP BY p_brand),
h AS (SELECT p_partkey, p_brand, substr(md5('42|' || CAST(p_partkey AS VARCHAR)), 1, 16) AS h FROM part),
r AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY h) AS r FROM h)
SELECT p_partkey, p_brand FROM r JOIN s USING (p_brand) ORDER BY r > quota, h LIMIT 120"""


def strat_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.sample(table(spark, sf_dir, "part"), "p_brand", F.col("p_partkey"), 60, cap=4).select("p_partkey", "p_brand")


STRAT_CAP = """WITH h AS (SELECT p_partkey, p_brand, substr(md5('42|' || CAST(p_partkey AS VARCHAR)), 1, 16) AS h FROM part)
SELECT p_partkey, p_brand FROM (SELECT * FROM h QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY h) <= 4) ORDER BY h LIMIT 60"""


def split_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders by customer, whole customers to splits by largest deficit; the urgent ones stand for gold. Tests compare with the greedy loop."""
    groups = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("grp"), (F.col("o_orderkey") % 5 == 0).alias("gold"))
    return G.pack_groups(groups, {"train": 0.8, "validation": 0.1, "test": 0.1})


def capped_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """In hash order at most 3 of a brand and 12 of a name, over the 1000 first; a sequence, so without SQL."""
    p = table(spark, sf_dir, "part").withColumn("h", C.stable_hash("42", F.col("p_partkey")))
    return C.capped(p.select("p_partkey", "p_brand", "p_name", "h"), "h", [("p_brand", 3), ("p_name", 12)], 1000)


def conflict_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.conflicts(table(spark, sf_dir, "part"), "p_name", "p_brand")


CONFLICTS = 'SELECT p_name, count(DISTINCT p_brand) AS "values" FROM part GROUP BY p_name HAVING count(DISTINCT p_brand) > 1'


def query_log_anon(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").withColumn("text", F.concat(F.lit(" "), "event_type", F.lit(" "), "props"))
    return C.anonymise_log(rows, "salt", "text", "event_id", "user_id")


LOG = """SELECT 'q_' || substr(sha256('salt|' || CAST(event_id AS VARCHAR)), 1, 24) AS query_id, trim(event_type || ' ' || props) AS text, 'g_' || substr(sha256('salt|' || CAST(user_id AS VARCHAR)), 1, 24) AS group_id FROM events"""


def alias_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    text = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit('["'), "p_name", F.lit('", "'), F.upper("p_name"), F.lit('", "x"]'))).otherwise(F.concat_ws("；", "p_name", F.lit(" "), F.concat(F.lit("a|"), "p_brand")))
    return p.select("p_partkey", F.array_join(C.split_aliases(text), "/").alias("aliases"))


ALIASES = "SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN p_name || '/x' ELSE p_name || '/a/' || p_brand END AS aliases FROM part"


def attribute_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").withColumn("title", F.concat_ws(" ", "p_name", "p_type"))
    spec = F.to_json(F.create_map(F.lit("kind"), F.col("p_type"), F.lit("tone"), F.split("p_name", " ")[0], F.lit("other"), F.lit("zzz")))
    attr = F.to_json(F.create_map(F.lit("Kind"), F.upper("p_type")))
    rows = p.withColumn("spec_json", spec).withColumn("attr_json", attr)
    return C.attributes(rows, "p_partkey", "title", {"spec": "spec_json", "sku_attr": "attr_json"}).select("id", "name", "value", F.array_join("sources", ",").alias("sources"))


ATTRIBUTES = """SELECT p_partkey AS id, 'Kind' AS name, upper(p_type) AS value, 'sku_attr,spec' AS sources FROM part
UNION ALL SELECT p_partkey, 'tone', split_part(p_name, ' ', 1), 'spec' FROM part"""


def hierarchy_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three levels: customers to nations to regions."""
    c, n, r = (table(spark, sf_dir, t) for t in ("customer", "nation", "region"))
    joined = c.join(F.broadcast(n), c["c_nationkey"] == n["n_nationkey"], "left").join(F.broadcast(r), n["n_regionkey"] == r["r_regionkey"], "left")
    return joined.groupBy("r_name", "n_name").agg(F.count("*").alias("customers"))


HIERARCHY = "SELECT r_name, n_name, count(*) AS customers FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey GROUP BY r_name, n_name"


def export_star_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines inner to parts, left to suppliers and nations, keys made by nullif and coalesce. Nations are 25 rows by definition; the others are left to the planner."""
    line, part, supplier, nation = (table(spark, sf_dir, t) for t in ("lineitem", "part", "supplier", "nation"))
    sums = line.groupBy("l_partkey", "l_suppkey").agg(F.sum("l_quantity").alias("q"), F.count("*").alias("n"))
    out = sums.join(part, sums["l_partkey"] == part["p_partkey"]).join(supplier, sums["l_suppkey"] == supplier["s_suppkey"], "left").join(F.broadcast(nation), supplier["s_nationkey"] == nation["n_nationkey"], "left")
    return out.groupBy("p_type", F.coalesce(F.nullif("n_name", F.lit("")), F.lit("unknown")).alias("nation")).agg(F.round(F.sum("q"), 2).alias("quantity"), F.sum("n").alias("lines"))


STAR = """SELECT p_type, coalesce(nullif(n_name, ''), 'unknown') AS nation, round(sum(l_quantity), 2) AS quantity, count(*) AS lines FROM lineitem JOIN part ON l_partkey = p_partkey
LEFT JOIN supplier ON l_suppkey = s_suppkey LEFT JOIN nation ON s_nationkey = n_nationkey GROUP BY 1, 2"""


def _dict_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    pick = lambda values, by: F.get(F.array(*map(F.lit, values)), (by % len(values)).cast("int"))
    k = F.col("p_partkey")
    return p.select(k.alias("id"), F.concat_ws(" ", "p_name", k.cast("string")).alias("term"), pick(["APPROVED", "DRAFT", "APPROVED", "DISABLED"], k).alias("status"), pick(["RUNTIME", "TRAINING", "BOTH"], k).alias("usage_scope"), pick(["MASTER_DATA", "NER", "MANUAL", "LLM", "MANUAL"], k).alias("source_type"), (k % 10).cast("int").alias("priority"))


_ENTRIES = """e AS (SELECT p_partkey AS id, p_name || ' ' || p_partkey AS term, ['APPROVED', 'DRAFT', 'APPROVED', 'DISABLED'][1 + p_partkey % 4] AS status, ['RUNTIME', 'TRAINING', 'BOTH'][1 + p_partkey % 3] AS usage_scope,
  ['MASTER_DATA', 'NER', 'MANUAL', 'LLM', 'MANUAL'][1 + p_partkey % 5] AS source_type, CAST(p_partkey % 10 AS INT) AS priority FROM part)"""


def _snapshot(where: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = _dict_entries(spark, sf_dir).where(where)
        return rows.withColumn("place", F.row_number().over(W.partitionBy("priority").orderBy(F.desc(F.length("term")), "id"))).select("id", "term", "priority", "place")

    return query, f"WITH {_ENTRIES} SELECT id, term, priority, CAST(row_number() OVER (PARTITION BY priority ORDER BY length(term) DESC, id) AS INT) AS place FROM e WHERE {where}"


QUERIES = {
    "import_funnel": (import_funnel, IMPORT_FUNNEL),
    "dedup_sku_title": (dedup_sku_title, DEDUP),
    "field_coverage": (field_coverage, COVERAGE),
    "cardinality": (cardinality, CARDINALITY),
    "verbatim_ratio": (verbatim_ratio, VERBATIM),
    "pctl_floor": _percentile(C.percentile_floor, "floor(q * (n - 1))"),
    "pctl_nearest": _percentile(C.percentile_nearest, "greatest(ceil(n * q) - 1, 0)"),
    "pctl_index": _percentile(C.percentile_index, "least(floor(n * q), n - 1)"),
    "length_coverage": (length_coverage, LENGTHS),
    "template_keys": (template_keys, TEMPLATES),
    "shingles": (shingles, SHINGLES),
    "minhash_signature": (minhash_signature, MINHASH),
    "lsh_pairs": (lsh_pairs, None),
    "dup_groups": (dup_groups, None),
    "split_no_leak": (split_no_leak, SPLIT),
    "bottom_k_sample": (bottom_k_sample, BOTTOM_K),
    "strat_quota": (strat_quota, STRAT),
    "strat_sample": (strat_sample, STRAT_SAMPLE),
    "strat_cap": (strat_cap, STRAT_CAP),
    "split_packed": (split_packed, None),
    "capped_sample": (capped_sample, None),
    "conflict_groups": (conflict_groups, CONFLICTS),
    "query_log_anon": (query_log_anon, LOG),
    "alias_split": (alias_split, ALIASES),
    "attribute_candidates": (attribute_candidates, ATTRIBUTES),
    "hierarchy_join": (hierarchy_join, HIERARCHY),
    "export_star_join": (export_star_join, STAR),
    "dict_snapshot_runtime": _snapshot("status = 'APPROVED' AND usage_scope IN ('RUNTIME', 'BOTH')"),
    "dict_snapshot_training": _snapshot("status = 'APPROVED' AND usage_scope IN ('TRAINING', 'BOTH') AND source_type IN ('MASTER_DATA', 'MANUAL')"),
}
