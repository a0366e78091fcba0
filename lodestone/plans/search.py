"""Search queries over the driver's tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import retrieval as R
from ..sources.tables import PRODUCTS_SQL, products

#: Requests: number, words, sort.
REQUESTS = [(1, "red widget", "RELEVANCE"), (2, "hot gear", "RELEVANCE"), (3, "small bolt", "RELEVANCE"), (4, "blue", "RELEVANCE")]
_CLAUSE = "q long, clause int, grp int, occur string, kind string, field string, text string, boost double, msm int"


def _clauses(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    return spark.createDataFrame(rows, _CLAUSE)


def _index(rows: DataFrame) -> R.Index:
    return R.build_index(rows, {"title": F.col("title"), "brand_name": F.col("brand_name"), "tags": F.col("tags"), "attributes": F.col("attributes")})


def _title_hits(spark: SparkSession, rows: DataFrame) -> DataFrame:
    """(q, all of a product, score) of the requests' words on the title with sales and rating."""
    clauses = _clauses(spark, [(q, 1, 1, "must", "match", "title", words, 1.0, None) for q, words, _ in REQUESTS])
    found = R.boolean(R.match_scores(_index(rows), clauses), clauses)
    hits = R.with_products(found, rows)
    return hits.withColumn("score", F.round(R.business_score(F.col("score"), F.col("sales_count"), F.col("rating")), 6))


_TERMS_SQL = """
toks AS (SELECT sku_id AS doc, unnest(string_split(lower(title), ' ')) AS term FROM products),
tf AS (SELECT doc, term, count(*) AS tf FROM toks GROUP BY doc, term),
dl AS (SELECT doc, count(*) AS dl FROM toks GROUP BY doc),
st AS (SELECT CAST(count(*) AS DOUBLE) AS n, avg(CAST(dl AS DOUBLE)) AS avgdl FROM dl),
df AS (SELECT term, CAST(count(*) AS DOUBLE) AS df FROM tf GROUP BY term),
req AS (SELECT * FROM (VALUES (1, 'red widget'), (2, 'hot gear'), (3, 'small bolt'), (4, 'blue')) t(q, words)),
qt AS (SELECT DISTINCT q, unnest(string_split(words, ' ')) AS term FROM req),
bm AS (SELECT q, tf.doc, sum(ln(1.0::DOUBLE + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * (tf / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl)))) AS score
  FROM qt JOIN tf USING (term) JOIN df USING (term) JOIN dl USING (doc), st GROUP BY q, tf.doc),
hits AS (SELECT CAST(q AS BIGINT) AS q, p.* , round(score + (0.3::DOUBLE * coalesce(sales_count, 0) + 0.2::DOUBLE * coalesce(rating, 0)), 6) AS score FROM bm JOIN products p ON p.sku_id = bm.doc)
"""


def search_relevance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.page(_title_hits(spark, products(spark, sf_dir))).select("q", "rank", "sku_id", "title", "score")


SEARCH_RELEVANCE = f"""WITH {PRODUCTS_SQL}, {_TERMS_SQL}
SELECT q, rank, sku_id, title, score FROM (SELECT *, CAST(row_number() OVER (PARTITION BY q ORDER BY score DESC, sku_id) AS INT) AS rank FROM hits) WHERE rank <= 20"""


def search_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics are of the filtered products: filters go ahead of the postings."""
    rows = R.apply_filters(products(spark, sf_dir), brands=[f"Brand#{i}" for i in range(10, 20)], min_fen=92000, max_fen=98000, in_stock=True)
    return R.page(R.item(_title_hits(spark, rows)), size=50).select("q", "rank", "sku_id", "price_fen", "score")


SEARCH_FILTERED = f"""WITH {PRODUCTS_SQL.replace("products AS", "allp AS")}, products AS (SELECT * FROM allp
  WHERE brand_name IN ({", ".join(f"'Brand#{i}'" for i in range(10, 20))}) AND price >= 920.0 AND price <= 980.0 AND in_stock), {_TERMS_SQL}
SELECT q, rank, sku_id, CAST(floor(price * 100 + 0.5) AS BIGINT) AS price_fen, score FROM (SELECT *, CAST(row_number() OVER (PARTITION BY q ORDER BY score DESC, sku_id) AS INT) AS rank FROM hits) WHERE rank <= 50"""


def _sorted(sort: str, column: str, direction: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return R.page(_title_hits(spark, products(spark, sf_dir)), sort, number=2).select("q", "rank", "sku_id", column)

    sql = f"""WITH {PRODUCTS_SQL}, {_TERMS_SQL}
SELECT q, rank, sku_id, {column} FROM (SELECT *, CAST(row_number() OVER (PARTITION BY q ORDER BY {column} {direction}, sku_id) AS INT) AS rank FROM hits) WHERE rank BETWEEN 21 AND 40"""
    return query, sql


def facets_top20(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.facets(_title_hits(spark, products(spark, sf_dir)), {"brands": "brand_name", "categories": "category_name"})


FACETS_TOP20 = f"""WITH {PRODUCTS_SQL}, {_TERMS_SQL},
f AS (SELECT q, 'brands' AS facet, brand_name AS key FROM hits UNION ALL SELECT q, 'categories', category_name FROM hits),
c AS (SELECT q, facet, key, count(*) AS count FROM f WHERE key IS NOT NULL GROUP BY q, facet, key)
SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY q, facet ORDER BY count DESC, key) AS INT) AS rank FROM c) WHERE rank <= 20"""


def spu_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of a page of 200, one hit a product name."""
    hits = R.page(_title_hits(spark, products(spark, sf_dir)).withColumn("spu_id", F.col("title")), "PRICE_ASC", size=200)
    return R.dedup_spu(hits).select("q", "rank", "sku_id", "spu_id", "score")


SPU_DEDUP = f"""WITH {PRODUCTS_SQL}, {_TERMS_SQL},
pg AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY price, sku_id) AS pos FROM hits) WHERE pos <= 200),
d AS (SELECT *, min(pos) OVER (PARTITION BY q, title) AS place, row_number() OVER (PARTITION BY q, title ORDER BY score DESC, pos) AS k FROM pg)
SELECT q, CAST(row_number() OVER (PARTITION BY q ORDER BY place) AS INT) AS rank, sku_id, title AS spu_id, score FROM d WHERE k = 1"""


def phrase_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = products(spark, sf_dir)
    clauses = _clauses(spark, [(1, 1, 1, "must", "phrase", "title", "red widget", 40.0, None), (2, 1, 1, "must", "phrase", "title", "widget red", 40.0, None), (3, 1, 1, "must", "phrase", "title", "gear", 40.0, None)])
    return R.phrase_scores(_index(rows), clauses).select("q", F.col("doc").alias("sku_id"), F.round("score", 6).alias("score"))


PHRASE_MATCH = f"""WITH {PRODUCTS_SQL}, {_TERMS_SQL},
want AS (SELECT * FROM (VALUES (1, 'red widget'), (2, 'widget red'), (3, 'gear')) t(q, phrase)),
w AS (SELECT q, phrase, sum(ln(1.0::DOUBLE + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE))) AS weight FROM (SELECT q, phrase, unnest(string_split(phrase, ' ')) AS term FROM want) JOIN df USING (term), st GROUP BY q, phrase)
SELECT CAST(q AS BIGINT) AS q, sku_id, round(40.0::DOUBLE * weight * (1.0::DOUBLE / (1.0::DOUBLE + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl))), 6) AS score
FROM w JOIN products ON contains(' ' || title || ' ', ' ' || phrase || ' ') JOIN dl ON dl.doc = sku_id, st"""


def boolean_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A brand is a must, a category and tags are should, an accessory is excluded; titles of two colours are must_not."""
    rows = products(spark, sf_dir)
    clauses = _clauses(spark, [
        (1, 1, 1, "must", "match", "brand_name", "Brand#11", 50.0, None), (1, 2, 1, "must", "phrase", "title", "Brand#11", 40.0, None),
        (1, 3, 2, "should", "match", "tags", "red", 10.0, None), (1, 4, 3, "must_not", "phrase", "title", "red widget", 1.0, None),
        (2, 1, 1, "should", "match", "tags", "hot", 10.0, 1), (2, 2, 2, "should", "match", "title", "gear", 5.0, 1),
    ])
    index = _index(rows)
    scores = R.match_scores(index, clauses.where("kind = 'match'")).union(R.phrase_scores(index, clauses.where("kind = 'phrase'")))
    return R.boolean(scores, clauses).groupBy("q").agg(F.count("*").alias("hits"), F.min("doc").alias("first_sku"), F.sum("doc").alias("sku_sum"))


BOOLEAN_QUERY = f"""WITH {PRODUCTS_SQL},
h AS (SELECT 1 AS q, sku_id FROM products WHERE brand_name = 'Brand#11' AND NOT contains(' ' || title || ' ', ' red widget ')
  UNION ALL SELECT 2, sku_id FROM products WHERE tags = 'hot' OR list_contains(string_split(title, ' '), 'gear'))
SELECT CAST(q AS BIGINT) AS q, count(*) AS hits, min(sku_id) AS first_sku, CAST(sum(sku_id) AS BIGINT) AS sku_sum FROM h GROUP BY q"""


def zero_hit_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests whose brand clause finds nothing are asked again by title alone."""
    rows = products(spark, sf_dir)
    index = _index(rows)
    strict = _clauses(spark, [(1, 1, 1, "must", "match", "brand_name", "Brand#99999", 50.0, None), (1, 2, 2, "must", "match", "title", "red", 1.0, None), (2, 1, 1, "must", "match", "brand_name", "Brand#11", 50.0, None), (2, 2, 2, "must", "match", "title", "gear", 1.0, None)])
    loose = strict.where("field = 'title'")
    found = R.boolean(R.match_scores(index, strict), strict).withColumn("fallback", F.lit(False))
    missing = loose.join(found.select("q").distinct(), "q", "left_anti")
    again = R.boolean(R.match_scores(index, missing), missing).withColumn("fallback", F.lit(True))
    return found.union(again).groupBy("q", "fallback").agg(F.count("*").alias("hits"), F.max("doc").alias("last_sku"))


ZERO_HIT_FALLBACK = f"""WITH {PRODUCTS_SQL},
h AS (SELECT 1 AS q, true AS fallback, sku_id FROM products WHERE list_contains(string_split(title, ' '), 'red')
  UNION ALL SELECT 2, false, sku_id FROM products WHERE brand_name = 'Brand#11' AND list_contains(string_split(title, ' '), 'gear'))
SELECT CAST(q AS BIGINT) AS q, fallback, count(*) AS hits, max(sku_id) AS last_sku FROM h GROUP BY q, fallback"""


def highlight_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return products(spark, sf_dir).where("tags = 'red'").select("sku_id", R.highlight(F.col("title"), F.array(F.lit("red"), F.lit("gear"))).alias("highlight_title"))


HIGHLIGHT = f"""WITH {PRODUCTS_SQL}
SELECT sku_id, array_to_string(list_transform(string_split(title, ' '), lambda w: CASE WHEN w IN ('red', 'gear') THEN '<em>' || w || '</em>' ELSE w END), ' ') AS highlight_title FROM products WHERE tags = 'red'"""


def min_score_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _title_hits(spark, products(spark, sf_dir)).where("score >= 12.0").groupBy("q").agg(F.count("*").alias("hits"), F.max("score").alias("best"))


MIN_SCORE = f"WITH {PRODUCTS_SQL}, {_TERMS_SQL} SELECT q, count(*) AS hits, max(score) AS best FROM hits WHERE score >= 12.0 GROUP BY q"


def price_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranges that share their inclusive ends: a product may lie in two."""
    ends = [("a", 900.0, 920.0), ("b", 920.0, 940.0), ("c", 940.0, 960.0), ("d", 960.0, 980.0), ("e", 980.0, None)]
    rows = products(spark, sf_dir).select(F.explode(F.array(*[F.struct(F.lit(n).alias("bucket"), ((F.col("price") >= lo) & (F.col("price") <= hi if hi else F.lit(True))).alias("inside")) for n, lo, hi in ends])).alias("b"))
    return rows.where(F.col("b.inside")).groupBy(F.col("b.bucket").alias("bucket")).agg(F.count("*").alias("products"))


PRICE_BUCKETS = f"""WITH {PRODUCTS_SQL}, e AS (SELECT * FROM (VALUES ('a', 900.0, 920.0), ('b', 920.0, 940.0), ('c', 940.0, 960.0), ('d', 960.0, 980.0), ('e', 980.0, NULL)) t(bucket, lo, hi))
SELECT bucket, count(*) AS products FROM products JOIN e ON price >= lo::DOUBLE AND (hi IS NULL OR price <= hi::DOUBLE) GROUP BY bucket"""


_SORTED = {name: _sorted(*spec) for name, spec in {"search_sort_price": ("PRICE_ASC", "price", "ASC"), "search_sort_price_desc": ("PRICE_DESC", "price", "DESC"), "search_sort_sales": ("SALES_DESC", "sales_count", "DESC NULLS LAST"), "search_sort_rating": ("RATING_DESC", "rating", "DESC NULLS LAST")}.items()}

QUERIES = {
    "search_relevance": (search_relevance, SEARCH_RELEVANCE),
    "search_filtered": (search_filtered, SEARCH_FILTERED),
    **_SORTED,
    "facets_top20": (facets_top20, FACETS_TOP20),
    "spu_dedup": (spu_dedup, SPU_DEDUP),
    "phrase_match": (phrase_match, PHRASE_MATCH),
    "boolean_query": (boolean_query, BOOLEAN_QUERY),
    "zero_hit_fallback": (zero_hit_fallback, ZERO_HIT_FALLBACK),
    "highlight_titles": (highlight_titles, HIGHLIGHT),
    "min_score_cut": (min_score_cut, MIN_SCORE),
    "price_buckets": (price_buckets, PRICE_BUCKETS),
}
