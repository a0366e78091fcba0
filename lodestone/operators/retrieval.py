"""Full-text retrieval: inverted index, BM25 match and phrase clauses, boolean queries, facets, ranking and paging.

Requests are rows. The clauses of all requests meet the postings in one join; products are filtered before that."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import analyze, analyzed, price_fen

K1, B = 1.2, 0.75
SORTS = ("RELEVANCE", "PRICE_ASC", "PRICE_DESC", "SALES_DESC", "RATING_DESC")


@dataclass
class Index:
    postings: DataFrame  # field, term, doc, positions, tf, dl
    terms: DataFrame  # field, term, df, n, avgdl


def build_index(products: DataFrame, fields: dict[str, Column], id_col: str = "sku_id", mode: str = "fine") -> Index:
    """Postings and term statistics of the given fields; statistics are of the documents that have the field."""
    rows = products.select(F.col(id_col).alias("doc"), F.explode(F.create_map(*[x for f, c in fields.items() for x in (F.lit(f), c)])).alias("field", "text"))
    terms = rows.select("doc", "field", analyze(F.col("text"), mode).alias("t")).where(F.size("t") > 0)
    flat = terms.select("doc", "field", F.size("t").cast("long").alias("dl"), F.explode("t").alias("x")).select("doc", "field", "dl", "x.term", "x.position")
    postings = flat.groupBy("field", "term", "doc", "dl").agg(F.sort_array(F.collect_list("position")).alias("positions"), F.count("*").alias("tf"))
    sizes = terms.groupBy("field").agg(F.count("*").alias("n"), F.avg(F.size("t").cast("double")).alias("avgdl"))
    return Index(postings, postings.groupBy("field", "term").agg(F.count("*").alias("df")).join(F.broadcast(sizes), "field"))


def save_index(index: Index, folder: str) -> None:
    """Stores an index: a folder for each field, in it terms side by side, so that asked terms read few row groups."""
    index.postings.repartition("field", "term").sortWithinPartitions("field", "term", "doc").write.mode("overwrite").partitionBy("field").parquet(f"{folder}/postings")
    index.terms.repartition("field").sortWithinPartitions("field", "term").write.mode("overwrite").partitionBy("field").parquet(f"{folder}/terms")


def load_index(spark: SparkSession, folder: str) -> Index:
    return Index(spark.read.parquet(f"{folder}/postings"), spark.read.parquet(f"{folder}/terms"))


def idf(n: Column, df: Column) -> Column:
    n, df = n.cast("double"), df.cast("double")
    return F.log(1.0 + (n - df + 0.5) / (df + 0.5))


def bm25(tf: Column, dl: Column, avgdl: Column) -> Column:
    tf = tf.cast("double")
    return tf / (tf + K1 * (1.0 - B + B * dl.cast("double") / avgdl))


def _meet(index: Index, asked: DataFrame) -> DataFrame:
    """Postings of asked terms (field, term, ...) with the statistics of each. The size of postings and terms is guessed
    from the files below their sums, far too low for compressed tables, so the guess may not choose a side to broadcast:
    both joins merge. The postings of one asked term meet in one task, which sorts them and can spill."""
    known = asked.hint("merge").join(index.terms, ["field", "term"]).repartition("field", "term")
    return index.postings.join(known.hint("merge"), ["field", "term"])


def with_products(hits: DataFrame, products: DataFrame, id_col: str = "sku_id") -> DataFrame:
    """Hits (doc, ...) with their products. The guessed size of a compressed catalogue may not choose to broadcast it."""
    return hits.hint("merge").join(products, hits["doc"] == products[id_col])


def match_scores(index: Index, clauses: DataFrame, mode: str = "fine") -> DataFrame:
    """(q, clause, doc, score) of clauses (q, clause, field, text, boost): any term of the text."""
    asked = clauses.select("q", "clause", "field", "boost", F.explode(F.array_distinct(F.transform(analyze(F.col("text"), mode), lambda x: x["term"]))).alias("term"))
    return _meet(index, asked).groupBy("q", "clause", "doc").agg(F.sum(F.col("boost") * idf(F.col("n"), F.col("df")) * bm25(F.col("tf"), F.col("dl"), F.col("avgdl"))).alias("score"))


def phrase_scores(index: Index, clauses: DataFrame, mode: str = "fine") -> DataFrame:
    """(q, clause, doc, score) of clauses whose terms stand one after the other."""
    asked = clauses.select("q", "clause", "field", "boost", analyze(F.col("text"), mode).alias("t"))
    asked = asked.select("q", "clause", "field", "boost", F.size("t").alias("terms"), F.explode("t").alias("x")).select("q", "clause", "field", "boost", "terms", "x.term", F.col("x.position").alias("qpos"))
    at = _meet(index, asked).select("q", "clause", "doc", "boost", "terms", "qpos", "n", "df", "dl", "avgdl", F.explode("positions").alias("p"))
    runs = at.groupBy("q", "clause", "doc", "boost", "terms", "dl", "avgdl", (F.col("p") - F.col("qpos")).alias("start")).agg(F.count_distinct("qpos").alias("met"), F.sum(idf(F.col("n"), F.col("df"))).alias("weight"))
    whole = runs.where("met = terms").groupBy("q", "clause", "doc", "boost", "dl", "avgdl").agg(F.count("*").alias("tf"), F.max("weight").alias("weight"))
    return whole.select("q", "clause", "doc", (F.col("boost") * F.col("weight") * bm25(F.col("tf"), F.col("dl"), F.col("avgdl"))).alias("score"))


def term_scores(products: DataFrame, clauses: DataFrame, fields: list[str], id_col: str = "sku_id") -> DataFrame:
    """(q, clause, doc, score) of clauses whose text equals a field; the score is the boost."""
    rows = products.select(F.col(id_col).alias("doc"), F.explode(F.create_map(*[x for f in fields for x in (F.lit(f), F.col(f).cast("string"))])).alias("field", "text"))
    return rows.join(clauses.select("q", "clause", "field", "text", "boost"), ["field", "text"]).select("q", "clause", "doc", F.col("boost").cast("double").alias("score"))


def boolean(scores: DataFrame, clauses: DataFrame) -> DataFrame:
    """(q, doc, score): clauses (q, clause, grp, occur, msm) put together.

    Every must group needs one of its clauses, must_not clauses exclude, msm (null: 0 with a must group, else 1)
    should clauses have to match; the score sums what matched of must and should."""
    shape = clauses.groupBy("q").agg(F.count_distinct(F.when(F.col("occur") == "must", F.col("grp"))).alias("musts"), F.max("msm").alias("msm"))
    hits = scores.join(clauses.select("q", "clause", "grp", "occur"), ["q", "clause"])
    one = hits.groupBy("q", "doc").agg(
        F.count_distinct(F.when(F.col("occur") == "must", F.col("grp"))).alias("met"),
        F.count_distinct(F.when(F.col("occur") == "should", F.col("grp"))).alias("helped"),
        F.max(F.col("occur") == "must_not").alias("banned"),
        F.sum(F.when(F.col("occur") != "must_not", F.col("score")).otherwise(0.0)).alias("score"),
    )
    fit = one.join(shape, "q").where("met = musts and not banned")
    return fit.where(F.col("helped") >= F.coalesce("msm", F.when(F.col("musts") > 0, 0).otherwise(1))).select("q", "doc", "score")


def business_score(score: Column, sales: Column, rating: Column) -> Column:
    return score + (0.3 * F.coalesce(sales.cast("double"), F.lit(0.0)) + 0.2 * F.coalesce(rating, F.lit(0.0)))


def apply_filters(products: DataFrame, brands: list[str] | None = None, categories: list[str] | None = None, min_fen: int | None = None, max_fen: int | None = None, in_stock: bool | None = None) -> DataFrame:
    """Exact filters; empty lists and null ends mean no filter, in_stock filters only when true."""
    out = products
    if brands:
        out = out.where(F.col("brand_name").isin(brands))
    if categories:
        out = out.where(F.col("category_name").isin(categories))
    if min_fen is not None:
        out = out.where(F.col("price") >= min_fen / 100.0)
    if max_fen is not None:
        out = out.where(F.col("price") <= max_fen / 100.0)
    return out.where("in_stock") if in_stock else out


def order_of(sort: str) -> list[Column]:
    """Total order of a sort; the product id breaks ties."""
    first = {"RELEVANCE": F.desc("score"), "PRICE_ASC": F.asc("price"), "PRICE_DESC": F.desc("price"), "SALES_DESC": F.desc("sales_count"), "RATING_DESC": F.desc("rating")}[sort]
    return [first, F.asc("sku_id")]


def page(hits: DataFrame, sort: str = "RELEVANCE", number: int = 1, size: int = 20, by: str = "q") -> DataFrame:
    """The page's hits of every request with their rank."""
    ranked = hits.withColumn("rank", F.row_number().over(W.partitionBy(by).orderBy(*order_of(sort))))
    return ranked.where(F.col("rank").between((number - 1) * size + 1, number * size))


def facets(hits: DataFrame, keys: dict[str, str], most: int = 20, by: str = "q") -> DataFrame:
    """(q, facet, key, count, rank): the commonest values of each key over all hits."""
    rows = hits.select(by, F.explode(F.create_map(*[x for f, c in keys.items() for x in (F.lit(f), F.col(c))])).alias("facet", "key")).where("key is not null")
    counts = rows.groupBy(by, "facet", "key").agg(F.count("*").alias("count"))
    return counts.withColumn("rank", F.row_number().over(W.partitionBy(by, "facet").orderBy(F.desc("count"), "key"))).where(F.col("rank") <= most)


def dedup_spu(hits: DataFrame, by: str = "q") -> DataFrame:
    """One hit of each spu of a page: the best score (ties: the earlier), at the place of the spu's first hit; blank spus stay."""
    blank = F.coalesce(F.trim("spu_id"), F.lit("")) == ""
    key = F.when(blank, F.concat(F.lit("row "), F.col("rank").cast("string"))).otherwise(F.concat(F.lit("spu "), F.col("spu_id")))
    w = W.partitionBy(by, "_key")
    out = hits.withColumn("_key", key).withColumn("place", F.min("rank").over(w))
    out = out.withColumn("_best", F.row_number().over(w.orderBy(F.desc("score"), "rank"))).where("_best = 1")
    return out.drop("_key", "_best").withColumn("rank", F.row_number().over(W.partitionBy(by).orderBy("place"))).drop("place")


def highlight(title: Column, terms: Column, mode: str = "fine") -> Column:
    """Title with every analysed term that is among terms wrapped in <em>, whatever script it is in."""
    hits = F.filter(analyzed(title, mode), lambda x: F.array_contains(terms, x["term"]))
    marked = F.aggregate(
        hits,
        F.struct(F.lit("").alias("out"), F.lit(0).alias("at")),
        lambda a, x: F.struct(F.concat(a["out"], F.substring(title, a["at"] + 1, x["start"] - a["at"]), F.lit("<em>"), F.substring(title, x["start"] + 1, x["end"] - x["start"]), F.lit("</em>")).alias("out"), x["end"].alias("at")),
    )
    return F.concat(marked["out"], F.substring(title, marked["at"] + 1, F.length(title)))


def item(hits: DataFrame, id_col: str | None = None) -> DataFrame:
    """Result rows: price in fen (0 without a price); a blank sku_id gives way to the document's id (id_col); in_stock
    given as text is true only where it says true."""
    out = hits.withColumn("price_fen", F.coalesce(price_fen(F.col("price")), F.lit(0).cast("long")))
    if id_col:
        out = out.withColumn("sku_id", F.coalesce(F.when(F.trim(F.col("sku_id").cast("string")) != "", F.col("sku_id")), F.col(id_col)))
    if dict(out.dtypes).get("in_stock") == "string":
        out = out.withColumn("in_stock", F.coalesce(F.lower(F.trim("in_stock")) == "true", F.lit(False)))
    return out


def page_numbers(page: Column, pages: Column, most: int = 5) -> Column:
    """The page numbers to show: at most `most`, around the page as far as there are pages."""
    first = F.greatest(F.lit(1), F.least(page - most // 2, pages - most + 1))
    return F.when(pages > 0, F.sequence(first, F.least(pages, first + most - 1))).otherwise(F.array().cast("array<int>"))


def trace(requests: DataFrame, clauses: DataFrame, hits: DataFrame, terms: str = "fine") -> DataFrame:
    """One row a request (q, query, rewritten, entities, synonyms) with what each step made of it: its terms, its clauses in
    words, and how many hits it has with the best ones. Requests without clauses or hits have empty lists."""
    said = explain_clauses(clauses).groupBy("q").agg(F.array_sort(F.collect_list(F.struct("clause", "explanation"))).alias("_said"))
    ranked = hits.withColumn("_r", F.row_number().over(W.partitionBy("q").orderBy(F.desc("score"), "doc"))).where("_r <= 10")
    best = ranked.groupBy("q").agg(F.transform(F.array_sort(F.collect_list(F.struct("_r", "doc", "score"))), lambda x: F.struct(x["doc"].alias("doc"), x["score"].alias("score"))).alias("_best"))
    found = hits.groupBy("q").agg(F.count("*").alias("_n"))
    kind = dict(best.dtypes)["_best"]
    out = requests.join(said, "q", "left").join(best, "q", "left").join(found, "q", "left")
    return out.select(
        "q", "query", "rewritten", analyzed(F.col("rewritten"), terms).alias("terms"), "entities", "synonyms",
        F.coalesce(F.transform("_said", lambda x: x["explanation"]), F.array().cast("array<string>")).alias("clauses"),
        F.coalesce("_n", F.lit(0)).alias("total"), F.coalesce("_best", F.array().cast(kind)).alias("best"),
    )


def explain_clauses(clauses: DataFrame) -> DataFrame:
    """Each clause in words: occur type(field=text)^boost."""
    return clauses.withColumn("explanation", F.format_string("%s %s(%s=%s)^%s", "occur", "kind", "field", "text", F.format_number("boost", 1)))
