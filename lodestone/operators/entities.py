"""Entities of queries and titles: dictionaries, rules, merging, normalisation and what queries become through them."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.spans import by_length, by_priority, overlaps, resolve_overlaps
from ..functions.text import normalize
from .quantities import annotate_measures, measures  # noqa: F401

# Rank of each label, online.
LABEL_RANK = {
    "BRAND": 17, "CATEGORY": 16, "PRODUCT": 15, "SERIES": 14, "MODEL": 13, "COLOR": 12, "MATERIAL": 11, "SPEC": 10, "FUNCTION": 9,
    "STYLE": 8, "AUDIENCE": 7, "SCENE": 6, "REGION": 5, "ORGANIZATION": 4, "PERSON": 3, "ATTRIBUTE": 2, "MODIFIER": 1,
}
# Rank of each label, offline.
OFFLINE_RANK = {
    "BRAND": 100, "CATEGORY": 95, "MODEL": 90, "CAPACITY": 86, "SIZE": 85, "WEIGHT": 84, "SPEC": 83, "PACKAGE_COMBINATION": 75,
    "COLOR": 70, "MATERIAL": 68, "FLAVOR": 66, "APPEARANCE": 60, "AUDIENCE": 58, "SCENE": 56, "FUNCTION": 54, "MODIFIER": 10,
}
# Occurrence of a label in the boolean query, its fields and boosts.
LABEL_CLAUSES = [
    ("BRAND", "must", "match", "brand_name", 50.0), ("BRAND", "must", "phrase", "title", 40.0),
    ("CATEGORY", "should", "match", "category_name", 50.0), ("CATEGORY", "should", "phrase", "title", 40.0),
    ("MODIFIER", "should", "match", "tags", 10.0), ("MODIFIER", "should", "match", "title", 5.0),
    ("ATTRIBUTE", "should", "match", "attributes", 5.0), ("ATTRIBUTE", "should", "match", "title", 5.0),
    ("MODEL", "must", "match", "model_no", 30.0), ("MODEL", "must", "phrase", "title", 20.0),
    ("PRODUCT", "should", "match", "title", 20.0), ("SERIES", "should", "match", "model_no", 20.0), ("COLOR", "should", "match", "attributes", 8.0),
    ("MATERIAL", "should", "match", "attributes", 8.0), ("SPEC", "should", "match", "attributes", 8.0), ("FUNCTION", "should", "match", "attributes", 6.0),
    ("STYLE", "should", "match", "tags", 6.0), ("AUDIENCE", "should", "match", "attributes", 5.0), ("SCENE", "should", "match", "tags", 5.0),
    ("REGION", "should", "match", "attributes", 4.0), ("PERSON", "should", "match", "title", 3.0), ("ORGANIZATION", "should", "match", "title", 3.0),
]
SPAN = "struct<start:int,end:int,label:string,text:string,confidence:double,source:string,priority:int,label_rank:int>"


def dictionary(entries: DataFrame, rank: dict[str, int] | None = None) -> DataFrame:
    """One entry for each lower-cased term: priority, label rank and length decide, then the label's name."""
    rank = rank or LABEL_RANK
    ranks = F.create_map(*[x for k, v in rank.items() for x in (F.lit(k), F.lit(v))])
    rows = entries.select(F.lower("term").alias("key"), "term", F.upper("label").alias("label"), F.coalesce(F.col("priority").cast("int"), F.lit(0)).alias("priority"))
    rows = rows.where(F.trim("key") != "").withColumn("label_rank", F.coalesce(ranks[F.col("label")], F.lit(0)))
    w = W.partitionBy("key").orderBy(F.desc("priority"), F.desc("label_rank"), F.desc(F.length("term")), "label")
    return rows.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def word_bounded(text: Column, start: Column, end: Column, term: Column) -> Column:
    """ASCII words must not touch a letter, digit, - or _ on either side."""
    word = "^[A-Za-z0-9_-]$"
    before, after = F.substring(text, start, 1), F.substring(text, end + 1, 1)
    clear = (F.when(start > 0, ~before.rlike(word)).otherwise(True)) & ~after.rlike(word)
    return ~term.rlike("^[A-Za-z0-9_-]+$") | clear


def candidates(texts: DataFrame, entries: DataFrame, most: int) -> DataFrame:
    """(id, text, span) of every place where a term of up to `most` characters stands: substrings of the text meet the
    dictionary in an equi-join, never term by term."""
    at = texts.select("id", "text", F.explode(F.sequence(F.lit(0), F.length("text") - 1)).alias("start")).where(F.length("text") > 0)
    cut = at.select("id", "text", "start", F.explode(F.sequence(F.lit(1), F.least(F.lit(most), F.length("text") - F.col("start")))).alias("n"))
    keyed = cut.select("id", "text", "start", (F.col("start") + F.col("n")).alias("end"), F.lower(F.substring(F.col("text"), F.col("start") + 1, F.col("n"))).alias("key"))
    met = keyed.join(entries, "key").where(word_bounded(F.col("text"), F.col("start"), F.col("end"), F.col("term")))
    surface = F.substring(F.col("text"), F.col("start") + 1, F.col("end") - F.col("start"))
    span = F.struct("start", "end", "label", surface.alias("text"), F.lit(1.0).alias("confidence"), F.lit("dictionary").alias("source"), "priority", "label_rank")
    return met.select("id", span.cast(SPAN).alias("span"))


def recognise(texts: DataFrame, entries: DataFrame, most: int, longest_first: bool = False) -> DataFrame:
    """texts (id, text) with entities: the dictionary's spans that do not overlap, by priority or by length."""
    found = candidates(texts, entries, most).groupBy("id").agg(F.collect_list("span").alias("spans"))
    out = texts.join(found, "id", "left")
    empty = F.array().cast(f"array<{SPAN}>")
    return out.select("id", "text", resolve_overlaps(F.coalesce("spans", empty), SPAN, by_length if longest_first else by_priority).alias("entities"))


def merge_hybrid(model: Column, lexicon: Column) -> Column:
    """Model spans with gaps filled by the dictionary; a wider dictionary CATEGORY of two or more characters takes the
    place of CATEGORY fragments inside it, but never of BRAND, MODEL or SERIES."""

    def step(kept: Column, d: Column) -> Column:
        touched = F.filter(kept, lambda m: overlaps(m, d))
        inside = lambda m: (m["start"] >= d["start"]) & (m["end"] <= d["end"])
        wider = F.exists(touched, lambda m: (m["label"] == "CATEGORY") & inside(m) & ((m["end"] - m["start"]) < (d["end"] - d["start"])))
        clear = F.forall(touched, lambda m: inside(m) & ~m["label"].isin("BRAND", "MODEL", "SERIES"))
        replace = (d["label"] == "CATEGORY") & (d["end"] - d["start"] >= 2) & wider & clear
        return F.when(F.size(touched) == 0, F.concat(kept, F.array(d))).when(replace, F.concat(F.filter(kept, lambda m: ~overlaps(m, d)), F.array(d))).otherwise(kept)

    return F.array_sort(F.aggregate(lexicon, model, step))


def fuse(model: Column, lexicon: Column, rules: Column, accept: float = 0.6, fallback: float = 0.45, bonus: float = 0.05) -> Column:
    """Offline fusion: rules win over what they overlap, sure model spans stay (with a bonus where the dictionary
    agrees), dictionary spans and then half-sure model spans fill the gaps."""
    same = lambda a, b: (a["start"] == b["start"]) & (a["end"] == b["end"]) & (a["label"] == b["label"])
    sure = F.filter(model, lambda m: (m["confidence"] >= accept) & ~F.exists(rules, lambda r: overlaps(r, m)))
    raised = F.transform(sure, lambda m: F.when(F.exists(lexicon, lambda d: same(m, d)), m.withField("confidence", F.least(F.lit(1.0), m["confidence"] + bonus)).withField("source", F.lit("hybrid"))).otherwise(m))
    maybe = F.filter(model, lambda m: (m["confidence"] >= fallback) & (m["confidence"] < accept))
    fill = lambda kept, x: F.when(F.exists(kept, lambda y: overlaps(x, y)), kept).otherwise(F.concat(kept, F.array(x)))
    return F.array_sort(F.aggregate(F.concat(lexicon, maybe), F.concat(rules, raised), fill))


def degraded(model: Column, accept: float = 0.6) -> Column:
    """Whether a model span was not sure enough to stay."""
    return F.exists(model, lambda m: m["confidence"] < accept)


# What queries become --------------------------------------------------------------------------------------------------


def rewrite(query: Column, rules: list[tuple[str, str]]) -> Column:
    """Ordered replacement, each rule once over the text, whatever the case; canonical text is hit as well."""
    for old, new in rules:
        query = F.regexp_replace(query, "(?i)" + re.escape(old), new.replace("\\", "\\\\").replace("$", "\\$"))
    return query


def synonyms(query: Column, lexicon: list[tuple[str, list[str]]]) -> Column:
    """Synonyms of every trigger that the query contains, in the lexicon's order, each once."""
    parts = [F.when(F.contains(query, F.lit(trigger)), F.array(*map(F.lit, words))).otherwise(F.array().cast("array<string>")) for trigger, words in lexicon]
    return F.array_distinct(F.concat(*parts)) if parts else F.array().cast("array<string>")


def exclusion_terms(spark: SparkSession, categories: list[str], suffixes: list[str], specific: dict[str, list[str]], also: dict[str, list[str]], accessory: tuple[str, ...]) -> DataFrame:
    """(category, position, term): a registered category that is no accessory with every suffix, then its own terms,
    each followed by its synonyms, each term once."""
    rows = []
    for c in categories:
        part = any(c.endswith(s) and len(c) > len(s) for s in suffixes) or c.endswith(accessory)
        base = ([] if part or c not in specific else [c + s for s in suffixes]) + specific.get(c, [])
        rows += [(c, i, t) for i, t in enumerate(dict.fromkeys(x for b in base for x in (b, *also.get(b, []))))]
    return spark.createDataFrame(rows, "category string, position int, term string")


def entity_clauses(spark: SparkSession, requests: DataFrame) -> DataFrame:
    """Clauses (q, clause, grp, occur, kind, field, text, boost, msm) of requests (q, residual, entities).

    A label's clauses of one entity are a group; residual words are a must on the title; one should group is needed
    only when nothing is left besides the entities."""
    table = F.broadcast(spark.createDataFrame(LABEL_CLAUSES, "label string, occur string, kind string, field string, boost double"))
    each = requests.select("q", F.posexplode("entities").alias("grp", "e")).select("q", "grp", "e.label", "e.text").join(table, "label")
    rest = requests.where(F.trim("residual") != "").select("q", F.lit(-1).alias("grp"), F.lit("must").alias("occur"), F.lit("match").alias("kind"), F.lit("title").alias("field"), F.col("residual").alias("text"), F.lit(1.0).alias("boost"))
    rows = each.select("q", "grp", "occur", "kind", "field", "text", "boost").union(rest)
    msm = requests.select("q", F.when((F.trim("residual") == "") & F.exists("entities", lambda e: ~e["label"].isin("BRAND", "MODEL")), 1).alias("msm"))
    numbered = rows.withColumn("clause", F.row_number().over(W.partitionBy("q").orderBy("grp", "field", "kind")))
    return numbered.join(msm, "q").select("q", "clause", "grp", "occur", "kind", "field", "text", "boost", "msm")


#: Boosts of clauses on normalised ids and on synonyms.
ID_BOOST, SYNONYM_BOOST = 60.0, 0.5


def request_clauses(spark: SparkSession, requests: DataFrame, exclusions: DataFrame | None = None, id_fields: dict[str, str] | None = None) -> DataFrame:
    """All clauses of requests (q, query, residual, entities, synonyms), as entity_clauses gives them and besides:
    accessory phrases of a CATEGORY, of exclusions (category, position, term), are must_not on the title; ids that
    entities were normalised to (fields normalized_id, normalized_type) are terms of the type's field, never needed;
    synonyms are should on the title. A request without entities asks its whole query on the title."""
    named = F.filter("entities", lambda e: (F.trim(e["text"]) != "") & (F.trim(e["label"]) != ""))
    rows = requests.withColumn("entities", F.coalesce(named, F.filter("entities", lambda e: F.lit(False)))).withColumn("_plain", F.coalesce(F.size("entities") <= 0, F.lit(True)))
    base = rows.withColumn("residual", F.when(F.col("_plain"), F.col("query")).otherwise(F.col("residual")))
    known = base.withColumn("entities", F.transform(F.coalesce("entities", F.array().cast(requests.schema["entities"].dataType)), lambda e: F.struct(e["label"].alias("label"), e["text"].alias("text"))))
    out = entity_clauses(spark, known.select("q", "residual", "entities"))
    columns = ["q", "grp", "occur", "kind", "field", "text", "boost"]

    def more(of: DataFrame, grp: Column, occur: str, kind: str, field: Column, text: Column, boost: float) -> DataFrame:
        return of.select("q", grp.cast("int").alias("grp"), F.lit(occur).alias("occur"), F.lit(kind).alias("kind"), field.alias("field"), text.alias("text"), F.lit(boost).alias("boost")).where("trim(text) <> '' and field is not null")

    each = rows.select("q", F.posexplode("entities").alias("at", "e"))
    # groups of the added clauses lie behind those of the entities, so that each of them counts by itself
    extra = more(rows.select("q", F.posexplode("synonyms").alias("at", "s")), 200000 + F.col("at"), "should", "match", F.lit("title"), F.col("s"), SYNONYM_BOOST)
    if exclusions is not None:
        banned = each.where("e.label = 'CATEGORY'").select("q", F.col("e.text").alias("category")).distinct().join(exclusions, "category")
        extra = extra.union(more(banned, 300000 + F.col("position"), "must_not", "phrase", F.lit("title"), F.col("term"), 1.0))
    kind = requests.schema["entities"].dataType.elementType
    if id_fields and "normalized_id" in kind.names:
        field = F.create_map(*[x for k, v in id_fields.items() for x in (F.lit(k), F.lit(v))])[F.col("e.normalized_type")]
        extra = extra.union(more(each, 100000 + F.col("at"), "should", "term", field, F.col("e.normalized_id"), ID_BOOST))
    msm = out.groupBy("q").agg(F.max("msm").alias("msm"))
    rows_of = out.select(*columns).union(extra.select(*columns)).join(msm, "q", "left")
    numbered = rows_of.withColumn("clause", F.row_number().over(W.partitionBy("q").orderBy("grp", "field", "kind", "text")))
    return numbered.select("q", "clause", "grp", "occur", "kind", "field", "text", "boost", "msm")


def normalise_entities(entities: DataFrame, aliases: DataFrame) -> DataFrame:
    """entities (id, label, text) with normalized text, id and type by (label, alias); n匹 becomes n HP."""
    known = aliases.select("label", normalize(F.col("alias")).alias("_key"), "canonical", "business_id", "id_type")
    out = entities.withColumn("_key", normalize(F.col("text"))).join(known, ["label", "_key"], "left")
    power = F.regexp_extract("text", "^([0-9]+(?:\\.[0-9]+)?)\\s*匹$", 1)
    is_power = (F.col("label") == "SPEC") & (power != "")
    return out.select(
        "id", "label", "text",
        F.coalesce("canonical", F.when(is_power, F.concat(power, F.lit(" HP")))).alias("normalized_text"), F.col("business_id").alias("normalized_id"),
        F.coalesce("id_type", F.when(is_power, F.lit("standardized_power"))).alias("normalized_type"),
    )


def map_raw_label(raw: Column, table: dict[str, str]) -> Column:
    """Project label of a model's raw label: BIOES prefix off, the table, names already in upper case, a prefix of the table, else ATTRIBUTE."""
    name = F.regexp_replace(F.trim(raw), "^[BIES]-", "")
    exact = F.create_map(*[x for k, v in table.items() for x in (F.lit(k), F.lit(v))])[name] if table else F.lit(None).cast("string")
    out = F.coalesce(exact, F.when(name.rlike("^[A-Z][A-Z0-9_]*$"), name))
    for k, v in sorted(table.items(), key=lambda kv: -len(kv[0])):
        out = F.coalesce(out, F.when(name.startswith(k), F.lit(v)))
    return F.coalesce(out, F.lit("ATTRIBUTE"))


def softmax_best(scores: Column) -> Column:
    """(label index, confidence) of a row of scores; ties go to the lower index."""
    top = F.array_max(scores)
    total = F.aggregate(scores, F.lit(0.0), lambda a, x: a + F.exp(x.cast("double") - top))
    return F.struct((F.array_position(scores, top) - 1).cast("int").alias("best"), (1.0 / total).alias("confidence"))
