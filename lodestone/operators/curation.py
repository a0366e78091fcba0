"""Catalogue curation: funnels, deduplication, profiles, percentiles, sampling and log import."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import normalize

# Titles of test products, markup, and the separators of alias lists.
TEST_TITLE = "(?i)(?:修改名称测试|测试商品|测试专用|请勿下单|不要下单|非卖品勿拍|勿拍链接)"
MARKUP = "<[A-Za-z/][^>]{0,200}>|&(?:[A-Za-z]{2,12}|#\\d{2,7}|#x[0-9A-Fa-f]{2,6});"
ALIAS_SEPARATORS = "[,，;；|、\\n\\r]+"
INVALID_BRANDS = ("无", "无品牌", "品牌", "测试", "123", "其他", "其它", "other", "oem")


def first_reason(rules: list[tuple[str, Column]]) -> Column:
    """Name of the first rule that holds, null if none: every row is counted under one reason."""
    out = None
    for name, rule in rules:
        out = F.when(rule, name) if out is None else out.when(rule, name)
    return out


def funnel(rows: DataFrame, rules: list[tuple[str, Column]], keys: list[tuple[str, list[str]]], order: list[Column]) -> DataFrame:
    """rows with drop_reason: the first rule that holds, then, among survivors, repeated keys in the given order."""
    out = rows.withColumn("drop_reason", first_reason(rules))
    for reason, columns in keys:
        w = W.partitionBy(F.col("drop_reason").isNull(), *columns).orderBy(*order)
        out = out.withColumn("_n", F.row_number().over(w)).withColumn("drop_reason", F.when(F.col("drop_reason").isNull() & (F.col("_n") > 1), reason).otherwise(F.col("drop_reason"))).drop("_n")
    return out


def drop_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy(F.coalesce("drop_reason", F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"))


def active(states: list[str]) -> Column:
    """State columns, where given, must be "1"."""
    return F.forall(F.array(*[F.coalesce(F.col(s), F.lit("")) for s in states]), lambda x: x.isin("", "1"))


def dedup_first(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key."""
    return rows.withColumn("_n", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def conflicts(rows: DataFrame, group: str, value: str) -> DataFrame:
    """Groups with several distinct values."""
    return rows.groupBy(group).agg(F.count_distinct(value).alias("values")).where("values > 1")


def coverage(rows: DataFrame, columns: list[str]) -> DataFrame:
    """(field, filled, pct): rows whose field has text."""
    flags = F.explode(F.create_map(*[x for c in columns for x in (F.lit(c), F.coalesce(F.trim(F.col(c).cast("string")) != "", F.lit(False)))]))
    return rows.select(flags.alias("field", "has")).groupBy("field").agg(F.count_if("has").alias("filled"), F.round(F.avg(F.col("has").cast("double")) * 100, 4).alias("pct"))


def percentile_floor(rows: DataFrame, column: str, quantiles: list[float], by: list[str] | None = None) -> DataFrame:
    """(by, q, value): the value at place floor(q * (n - 1)) of the sorted column."""
    return _at(rows, column, quantiles, by, lambda q, n: F.floor(F.lit(q) * (n - 1)))


def percentile_nearest(rows: DataFrame, column: str, quantiles: list[float], by: list[str] | None = None) -> DataFrame:
    """(by, q, value): the value at rank ceil(n * q)."""
    return _at(rows, column, quantiles, by, lambda q, n: F.greatest(F.ceil(n * F.lit(q)) - 1, F.lit(0)))


def percentile_index(rows: DataFrame, column: str, quantiles: list[float], by: list[str] | None = None) -> DataFrame:
    """(by, q, value): the value at place int(n * q), the last at most."""
    return _at(rows, column, quantiles, by, lambda q, n: F.least(F.floor(n * F.lit(q)), n - 1))


def _at(rows: DataFrame, column: str, quantiles: list[float], by: list[str] | None, place) -> DataFrame:
    """Counts per value come first, so that sorting is over distinct values and one group may be large."""
    by = by or []
    counts = rows.where(F.col(column).isNotNull()).groupBy(*by, column).agg(F.count("*").alias("_c"))
    w = W.partitionBy(*by).orderBy(column)
    sums = counts.withColumn("_hi", F.sum("_c").over(w)).withColumn("_n", F.sum("_c").over(W.partitionBy(*by)))
    each = sums.select(*by, column, "_hi", "_c", "_n", F.explode(F.array(*[F.struct(F.lit(q).alias("q"), place(q, F.col("_n")).alias("at")) for q in quantiles])).alias("_q"))
    return each.where((F.col("_q.at") < F.col("_hi")) & (F.col("_q.at") >= F.col("_hi") - F.col("_c"))).select(*by, F.col("_q.q").alias("q"), F.col(column).alias("value"))


def length_coverage(rows: DataFrame, length: Column, candidates: list[int]) -> DataFrame:
    """(max_length, pct): share of rows that a limit holds whole."""
    flags = F.explode(F.array(*[F.struct(F.lit(c).alias("max_length"), (length <= c).alias("fits")) for c in candidates])).alias("x")
    return rows.select(flags).groupBy(F.col("x.max_length").alias("max_length")).agg(F.round(F.avg(F.col("x.fits").cast("double")) * 100, 6).alias("pct"))


def stable_hash(seed: str, *columns: Column) -> Column:
    """First 16 hex digits of md5; hex order is the order of the 64-bit number."""
    return F.substring(F.md5(F.concat_ws("|", F.lit(seed), *[c.cast("string") for c in columns])), 1, 16)


def bottom_k(rows: DataFrame, key: Column, k: int, seed: str = "42") -> DataFrame:
    """The k rows of least hash: a sample that stays the same as long as the rows do."""
    return rows.withColumn("sample_hash", stable_hash(seed, key)).orderBy("sample_hash").limit(k)


def stratified(rows: DataFrame, stratum: str, key: Column, n: int, seed: str = "42") -> DataFrame:
    """At least one row a stratum and its share of n, least hashes first."""
    counts = rows.groupBy(stratum).agg(F.count("*").alias("_size"))
    total = counts.agg(F.sum("_size").alias("_all"))
    quota = counts.crossJoin(F.broadcast(total)).select(stratum, F.greatest(F.lit(1), F.bround(F.lit(float(n)) * F.col("_size") / F.col("_all")).cast("int")).alias("quota"))
    out = rows.withColumn("sample_hash", stable_hash(seed, key)).join(quota, stratum)
    return out.withColumn("_r", F.row_number().over(W.partitionBy(stratum).orderBy("sample_hash"))).where("_r <= quota").drop("_r")


def sample(rows: DataFrame, stratum: str, key: Column, n: int, cap: int | None = None, seed: str = "42") -> DataFrame:
    """n rows: of each stratum its share (at least one), topped up by hash from what is left; or with `cap` rows of a
    stratum at most and no top-up. Within 2 n ranks of a stratum lies all that can be taken, so no stratum is sorted whole."""
    hashed = rows.withColumn("sample_hash", stable_hash(seed, key))
    ranked = hashed.withColumn("_r", F.row_number().over(W.partitionBy(stratum).orderBy("sample_hash"))).where(F.col("_r") <= (cap or 2 * n))
    if cap:
        return ranked.drop("_r").orderBy("sample_hash").limit(n)
    counts = rows.groupBy(stratum).agg(F.count("*").alias("_size"))
    total = counts.agg(F.sum("_size").alias("_all"))
    quota = counts.crossJoin(F.broadcast(total)).select(stratum, F.greatest(F.lit(1), F.bround(F.lit(float(n)) * F.col("_size") / F.col("_all")).cast("int")).alias("_quota"))
    return ranked.join(quota, stratum).orderBy(F.col("_r") > F.col("_quota"), "sample_hash").limit(n).drop("_r", "_quota")


def compact(rows: DataFrame, private: list[str], keep: list[str] | None = None) -> DataFrame:
    """rows as (id, text, meta): meta is JSON of the other columns, without private ones, blanks, nulls and empty lists;
    columns of `keep` stay even when empty."""
    keep = keep or []
    own = [f for f in rows.schema.fields if f.name not in {"id", "text", *private}]

    def value(f) -> Column:
        c = F.col(f.name)
        if f.name in keep:
            return c
        kind = f.dataType.typeName()
        return F.when(F.trim(c) != "", F.trim(c)) if kind == "string" else F.when(F.size(c) > 0, c) if kind == "array" else c

    return rows.select(F.col("id").cast("string").alias("id"), "text", F.to_json(F.struct(*[value(f).alias(f.name) for f in own])).alias("meta"))


def capped(rows: DataFrame, order: str, caps: list[tuple[str, int]], pool: int) -> DataFrame:
    """Rows in order, each taken unless one of its keys has used up its cap; a skipped row uses up nothing.

    That is a sequence, so it runs in one task, over the `pool` first rows, which bounds it."""
    import pandas as pd

    def run(frames):
        used: list[dict] = [{} for _ in caps]
        frame = pd.concat(list(frames), ignore_index=True).sort_values(order, kind="stable")
        keep = []
        for row in frame.itertuples():
            values = [getattr(row, c) for c, _ in caps]
            if all(u.get(v, 0) < most for u, v, (_, most) in zip(used, values, caps, strict=True)):
                for u, v in zip(used, values, strict=True):
                    u[v] = u.get(v, 0) + 1
                keep.append(row.Index)
        yield frame.loc[keep]

    first = rows.orderBy(order).limit(pool)
    return first.coalesce(1).mapInPandas(run, first.schema)


def anonymise_log(rows: DataFrame, salt: str, text: str, ident: str, group: str, most: int = 200) -> DataFrame:
    """(query_id, text, group_id) of log rows with a text of at most `most` characters; ids are salted hashes."""
    digest = lambda p, c: F.concat(F.lit(p), F.substring(F.sha2(F.concat_ws("|", F.lit(salt), c.cast("string")), 256), 1, 24))
    kept = rows.where((F.trim(text) != "") & (F.length(F.trim(text)) <= most))
    out = kept.select(digest("q_", F.col(ident)).alias("query_id"), F.trim(text).alias("text"), digest("g_", F.coalesce(F.col(group).cast("string"), F.trim(text))).alias("group_id"))
    return dedup_first(out, ["query_id"], [F.col("text"), F.col("group_id")])


def split_aliases(c: Column) -> Column:
    """A JSON list or a separated list, trimmed, each normal form once, in order."""
    parts = F.when(F.trim(c).startswith("["), F.coalesce(F.from_json(c, "array<string>"), F.array().cast("array<string>"))).otherwise(F.split(c, ALIAS_SEPARATORS))
    parts = F.filter(F.transform(parts, lambda x: F.trim(x)), lambda x: x != "")
    return F.aggregate(parts, F.array().cast("array<string>"), lambda a, x: F.when(F.exists(a, lambda y: normalize(y) == normalize(x)), a).otherwise(F.concat(a, F.array(x))))


def valid_brands(c: Column) -> Column:
    return F.filter(c, lambda x: ~normalize(F.trim(x)).isin(*INVALID_BRANDS) & (F.trim(x) != ""))


def attributes(rows: DataFrame, id_col: str, title: str, sources: dict[str, str], most: int = 50) -> DataFrame:
    """(id, name, value, sources) from JSON columns of {name: value}: values of 2 to 40 characters that stand in the title."""
    out = None
    for source, column in sources.items():
        part = rows.select(F.col(id_col).alias("id"), F.col(title).alias("title"), F.explode(F.from_json(column, "map<string,string>")).alias("name", "value"), F.lit(source).alias("source"))
        out = part if out is None else out.union(part)
    out = out.where(F.length("value").between(2, 40) & F.contains(normalize(F.col("title")), normalize(F.col("value"))))
    merged = out.groupBy("id", normalize(F.col("name")).alias("_n"), normalize(F.col("value")).alias("_v")).agg(F.min("name").alias("name"), F.min("value").alias("value"), F.sort_array(F.collect_set("source")).alias("sources"))
    return merged.withColumn("_r", F.row_number().over(W.partitionBy("id").orderBy("_n", "_v"))).where(F.col("_r") <= most).select("id", "name", "value", "sources")
