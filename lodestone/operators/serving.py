"""Requests in and results out: normalisation and checks, versioned cache keys, cached results with expiry, warm-up."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .retrieval import SORTS

MOST_PAGE, DEFAULT_PAGE, MOST_QUERY = 100, 20, 100
#: Seconds that results, hot lists and recognitions live, and the jitter on results.
TTL, HOT_TTL, NER_TTL, JITTER = 120, 120, 3600, 30


def normalise_requests(requests: DataFrame) -> DataFrame:
    """requests with trimmed query, page from 1, page_size 20 by default and 100 at most, default sort, and error_code (null if fine)."""
    query = F.coalesce("query", F.lit(""))
    error = F.when(F.trim(query) == "", "QUERY_BLANK").when(F.length(query) > MOST_QUERY, "QUERY_TOO_LONG").when(~F.col("sort").isin(*SORTS), "BAD_SORT")
    size = F.when(F.col("page_size").isNull() | (F.col("page_size") < 1), DEFAULT_PAGE).otherwise(F.col("page_size"))
    return requests.withColumns({"error_code": error, "query": F.trim(query), "page": F.greatest(F.coalesce("page", F.lit(1)), F.lit(1)), "page_size": F.least(size, F.lit(MOST_PAGE)), "sort": F.coalesce("sort", F.lit("RELEVANCE"))})


def cache_key(versions: dict[str, str], query: Column, filters: Column, page: Column) -> Column:
    """search:result:<versions>:<query hash>:<hash of the sorted filters>:<page>; the order of filters does not matter."""
    short = lambda c: F.substring(F.sha2(c, 256), 1, 16)
    return F.concat_ws(":", F.lit("search:result"), *[F.lit(versions[k]) for k in ("index", "dict", "ner", "rule")], short(query), short(F.array_join(F.sort_array(filters), "&")), page.cast("string"))


def store(results: DataFrame, now: Column, seconds: int = TTL, jitter: int = JITTER) -> DataFrame:
    """results (cache_key, ...) with expires_at; the jitter comes of the key, so that a retry writes the same."""
    extra = F.pmod(F.xxhash64("cache_key"), F.lit(jitter + 1)) if jitter else F.lit(0)
    return results.withColumn("expires_at", F.timestamp_add("SECOND", (F.lit(seconds) + extra).cast("int"), now))


def lookup(requests: DataFrame, cache: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """Requests answered by entries that have not expired, and those left."""
    live = cache.where(F.col("expires_at") > now)
    return requests.join(live, "cache_key"), requests.join(live.select("cache_key").distinct(), "cache_key", "left_anti")


def hot_slice(hot: DataFrame, page: int, size: int) -> DataFrame:
    """A page of a stored list (q, rank, ...); total is the list's length."""
    total = hot.groupBy("q").agg(F.count("*").alias("total"))
    return hot.where(F.col("rank").between((page - 1) * size + 1, page * size)).join(total, "q")


def warm_up(queries: DataFrame, search: Callable[[DataFrame], DataFrame], now: Column) -> DataFrame:
    """Results of all hot queries in one job, ready to store."""
    return store(search(queries), now, HOT_TTL, 0)


def degrade_reasons(cache: Column, model: Column, index: Column) -> Column:
    """Names of the parts that were not available."""
    return F.array_compact(F.array(F.when(~cache, "CACHE_UNAVAILABLE"), F.when(~model, "NER_UNAVAILABLE"), F.when(~index, "SEARCH_UNAVAILABLE")))
