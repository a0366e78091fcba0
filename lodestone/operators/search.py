"""A whole search: requests are checked, rewritten, recognised, made into clauses, matched, and paged, all requests in one plan."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.spans import residual
from ..sources.shared import folder
from . import entities as E
from . import retrieval as R
from .serving import normalise_requests


@dataclass
class Knowledge:
    """What a search knows besides the products: a dictionary (see entities.dictionary) of terms up to `longest`
    characters, ordered rewrite rules, synonyms, aliases of entities, accessory phrases and the fields of ids."""

    dictionary: DataFrame
    longest: int
    rewrites: list[tuple[str, str]] = field(default_factory=list)
    synonyms: list[tuple[str, list[str]]] = field(default_factory=list)
    aliases: DataFrame | None = None
    exclusions: DataFrame | None = None
    id_fields: dict[str, str] = field(default_factory=dict)


@dataclass
class Found:
    requests: DataFrame  # q, query, rewritten, residual, entities, synonyms, page, page_size, sort, error_code
    clauses: DataFrame
    hits: DataFrame  # q, doc, score
    page: DataFrame  # q, rank, score, highlight and the product's columns


def understand(requests: DataFrame, known: Knowledge) -> DataFrame:
    """Requests (q, query, page, page_size, sort) checked, with rewritten, residual, entities (label, text, normalized_id,
    normalized_type) and synonyms. Requests with an error have no entities."""
    rows = normalise_requests(requests).withColumn("rewritten", E.rewrite(F.col("query"), known.rewrites))
    rows = rows.withColumn("synonyms", E.synonyms(F.col("query"), known.synonyms))
    texts = rows.where("error_code is null").select(F.col("q").alias("id"), F.col("query").alias("text"))
    spans = E.recognise(texts, known.dictionary, known.longest).select(F.col("id").alias("q"), "entities")
    each = spans.select(F.col("q").alias("id"), F.posexplode("entities").alias("at", "e")).select("id", "at", "e.label", "e.text")
    if known.aliases is None:
        named = each.withColumn("normalized_id", F.lit(None).cast("string")).withColumn("normalized_type", F.lit(None).cast("string"))
    else:
        told = E.normalise_entities(each.select("id", "label", "text").distinct(), known.aliases).groupBy("id", "label", "text").agg(F.min(F.struct("normalized_id", "normalized_type")).alias("n"))
        named = each.join(told, ["id", "label", "text"]).select("id", "at", "label", "text", F.col("n.normalized_id").cast("string").alias("normalized_id"), F.col("n.normalized_type").alias("normalized_type"))
    entity = F.struct("at", "label", "text", "normalized_id", "normalized_type")
    grouped = named.groupBy(F.col("id").alias("q")).agg(F.array_sort(F.collect_list(entity)).alias("named"))
    cut = F.transform(F.coalesce("entities", F.filter("entities", lambda e: F.lit(False))), lambda e: F.struct(e["start"].alias("start"), e["end"].alias("end")))
    out = rows.join(spans, "q", "left").join(grouped, "q", "left").withColumn("residual", residual(F.col("query"), cut))
    kept = F.transform("named", lambda e: F.struct(e["label"].alias("label"), e["text"].alias("text"), e["normalized_id"].alias("normalized_id"), e["normalized_type"].alias("normalized_type")))
    return out.withColumn("entities", F.coalesce(kept, F.array().cast("array<struct<label:string,text:string,normalized_id:string,normalized_type:string>>"))).drop("named")


def matching(index: R.Index, products: DataFrame, clauses: DataFrame, id_fields: list[str]) -> DataFrame:
    """(q, doc, score) of products that clauses of any kind accept."""
    scores = R.match_scores(index, clauses.where("kind = 'match'")).union(R.phrase_scores(index, clauses.where("kind = 'phrase'")))
    fields = [f for f in id_fields if f in products.columns]
    if fields:
        scores = scores.union(R.term_scores(products, clauses.where("kind = 'term'"), fields))
    return R.boolean(scores, clauses)


def _order(score: Column) -> list[Column]:
    """Each request's own sort; missing values come last, the product id breaks ties."""
    keys = {"PRICE_ASC": F.col("price"), "PRICE_DESC": -F.col("price"), "SALES_DESC": -F.col("sales_count"), "RATING_DESC": -F.col("rating")}
    key = F.when(F.col("sort") == "RELEVANCE", -score)
    for name, column in keys.items():
        key = key.when(F.col("sort") == name, column.cast("double"))
    return [key.asc_nulls_last(), F.asc("sku_id")]


def search(spark: SparkSession, requests: DataFrame, products: DataFrame, index: R.Index, known: Knowledge, least: float = 0.0) -> Found:
    """Requests against products (sku_id, spu_id, title, price, sales_count, rating, ...) and an index over them.

    A request whose entities lead to no hit at all asks its rewritten text on the title instead. Sales and rating add to
    the score only where relevance is the sort; hits under `least` are none. SPUs are made one within a page. Filters
    belong ahead: products and index are those of the filtered catalogue. Requests with an error have no hits.
    Requests, clauses and first hits are written to the shared folder, since several steps read each of them."""
    root = folder(spark, "search")

    def cut(rows: DataFrame, name: str) -> DataFrame:
        rows.write.parquet(f"{root}/{name}")
        return spark.read.schema(rows.schema).parquet(f"{root}/{name}")

    asked = cut(understand(requests, known), "requests")
    fine = asked.where("error_code is null")
    effective = F.when(F.trim("rewritten") != "", F.col("rewritten")).otherwise(F.col("query"))
    clauses = cut(E.request_clauses(spark, fine.select("q", effective.alias("query"), "residual", "entities", "synonyms"), known.exclusions, known.id_fields), "clauses")
    found = cut(matching(index, products, clauses, list(known.id_fields.values())), "found")
    lost = fine.where(F.size("entities") > 0).join(found.select("q").distinct(), "q", "left_anti")
    plain = lost.select("q", effective.alias("query"), F.lit("").alias("residual"), F.filter("entities", lambda e: F.lit(False)).alias("entities"), "synonyms")
    again = cut(E.request_clauses(spark, plain), "again")
    hits = found.union(matching(index, products, again, []))
    rows = R.with_products(hits, products).join(fine.select("q", "sort", "page", "page_size", "rewritten"), "q")
    rows = rows.withColumn("score", F.when(F.col("sort") == "RELEVANCE", R.business_score(F.col("score"), F.col("sales_count"), F.col("rating"))).otherwise(F.col("score"))).where(F.col("score") >= least)
    ranked = rows.withColumn("rank", F.row_number().over(W.partitionBy("q").orderBy(*_order(F.col("score")))))
    first = (F.col("page") - 1) * F.col("page_size")
    paged = ranked.where((F.col("rank") > first) & (F.col("rank") <= first + F.col("page_size")))
    terms = F.transform(R.analyzed(F.col("rewritten")), lambda x: x["term"])
    shown = paged.withColumn("highlight", R.highlight(F.col("title"), terms)).drop("sort", "page", "page_size", "rewritten", "doc")
    return Found(asked, clauses, rows.select("q", "doc", "score"), R.dedup_spu(R.item(shown)))
