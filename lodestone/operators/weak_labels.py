"""Weak labels: spans from structured fields, merging of sources, review of model answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.spans import overlaps, resolve_overlaps
from ..functions.text import normalize

SPAN = "struct<start:int,end:int,label:string,text:string,confidence:double,source:string>"
#: Sources from the surest on.
SOURCES = ("structured", "dictionary", "rule")


def places(text: Column, surface: Column, step: int | None = None) -> Column:
    """0-based places of a surface in a text, whatever the case; step 1 gives overlapping ones, None goes on behind each."""
    t, s = normalize(text), normalize(surface)
    hits = F.filter(F.sequence(F.lit(0), F.length(t) - F.length(s)), lambda i: F.substring(t, i + 1, F.length(s)) == s)
    hits = F.when((F.length(s) > 0) & (F.length(t) >= F.length(s)), hits).otherwise(F.array().cast("array<int>"))
    if step == 1:
        return hits
    return F.aggregate(hits, F.array().cast("array<int>"), lambda a, i: F.when((F.size(a) == 0) | (i >= F.get(a, F.size(a) - 1) + F.length(s)), F.concat(a, F.array(i))).otherwise(a))


def _bounded(text: Column, at: Column, size: Column) -> Column:
    """A Latin surface must not touch Latin letters or digits."""
    latin = "^[A-Za-z0-9]$"
    inner = F.substring(text, at + 1, size)
    left = ~inner.rlike("^[A-Za-z0-9]") | (at == 0) | ~F.substring(text, at, 1).rlike(latin)
    return left & (~inner.rlike("[A-Za-z0-9]$") | ~F.substring(text, at + size + 1, 1).rlike(latin))


def structured(rows: DataFrame) -> DataFrame:
    """rows (id, text, brands, categories) with entities: all places of all brands, and the first category that stands
    in the text; surfaces of two or more characters, verbatim."""

    def spans(surface: Column, label: str) -> Column:
        size = F.length(surface)
        at = F.filter(places(F.col("text"), surface), lambda i: _bounded(F.col("text"), i, size))
        return F.transform(at, lambda i: F.struct(i.alias("start"), (i + size).alias("end"), F.lit(label).alias("label"), F.substring(F.col("text"), i + 1, size).alias("text"), F.lit(1.0).alias("confidence"), F.lit("structured").alias("source")).cast(SPAN))

    long = lambda a: F.filter(a, lambda x: F.length(x) >= 2)
    brands = F.flatten(F.transform(long("brands"), lambda b: spans(b, "BRAND")))
    found = F.filter(F.transform(long("categories"), lambda c: spans(c, "CATEGORY")), lambda x: F.size(x) > 0)
    category = F.when(F.size(found) > 0, F.slice(found[0], 1, 1)).otherwise(F.array().cast(f"array<{SPAN}>"))
    rank = lambda x: [x["start"] - x["end"], x["start"]]
    return rows.select("id", "text", resolve_overlaps(F.array_distinct(F.concat(brands, category)), SPAN, rank).alias("entities"))


def merge_sources(spans: Column) -> Column:
    """Spans of all sources, the surer source first, then the longer span, without overlaps; one CATEGORY at most:
    structured first, then the earliest, then the longest."""
    rank = F.array(*map(F.lit, SOURCES))
    kept = resolve_overlaps(spans, SPAN, lambda x: [F.array_position(rank, x["source"]), x["start"] - x["end"], x["start"]])
    chosen = F.array_min(F.transform(F.filter(kept, lambda x: x["label"] == "CATEGORY"), lambda x: F.struct((x["source"] != "structured").alias("a"), x["start"].alias("b"), (-x["end"]).alias("c"))))
    return F.filter(kept, lambda x: (x["label"] != "CATEGORY") | ((x["start"] == chosen["b"]) & (x["end"] == -chosen["c"])))


def uncertain(entities: Column, required: list[str], least: float) -> Column:
    """Why a prediction wants a look: no_entity, missing:<labels>, low_confidence, or null."""
    empty = entities.isNull() | (F.size(entities) == 0)
    missing = F.array_except(F.array(*map(F.lit, required)), F.transform(entities, lambda e: e["label"]))
    low = F.array_min(F.transform(entities, lambda e: e["confidence"])) < least
    return F.when(empty, "no_entity").when(F.size(missing) > 0, F.concat(F.lit("missing:"), F.array_join(missing, ","))).when(low, "low_confidence")


def parse_answer(raw: Column) -> Column:
    """Entities of a model's answer: a JSON list, a list wrapped in an object, either within a code fence."""
    body = F.regexp_replace(F.trim(raw), "(?s)^```[a-z]*\\s*|\\s*```$", "")
    kind = "array<struct<text:string,label:string>>"
    return F.coalesce(F.when(body.startswith("["), F.from_json(body, kind)), F.from_json(body, f"struct<entities:{kind}>")["entities"])


def relocate(answers: DataFrame, labels: list[str]) -> DataFrame:
    """(id, entities, misses): every place of each surface of the answers (id, text, answer); surfaces that the text
    lacks and labels out of scope are misses."""
    each = answers.select("id", "text", F.explode_outer("answer").alias("a"))
    at = F.when(F.col("a.label").isin(labels), places(F.col("text"), F.col("a.text"), 1)).otherwise(F.array().cast("array<int>"))
    flat = each.withColumn("at", at).withColumn("miss", (F.col("a").isNotNull() & (F.size("at") == 0)).cast("int"))
    spans = F.transform("at", lambda i: F.struct(i.alias("start"), (i + F.length("a.text")).alias("end"), F.col("a.label").alias("label"), F.substring(F.col("text"), i + 1, F.length("a.text")).alias("text"), F.lit(1.0).alias("confidence"), F.lit("llm").alias("source")).cast(SPAN))
    return flat.groupBy("id").agg(F.array_distinct(F.flatten(F.collect_list(spans))).alias("entities"), F.sum("miss").alias("misses"))


def review(candidates: Column, decisions: Column, accept: float = 0.7) -> Column:
    """Why an item is rejected, the first reason that holds, or null: soft candidates need a decision each, decisions
    must name a candidate, be sure enough, and what is kept must not overlap. Locked candidates stay as they are."""
    soft = F.filter(candidates, lambda c: ~c["locked"])
    undecided = F.exists(soft, lambda c: ~F.exists(decisions, lambda d: d["id"] == c["id"]))
    unknown = F.exists(decisions, lambda d: ~F.exists(candidates, lambda c: c["id"] == d["id"]))
    locked = F.exists(decisions, lambda d: F.exists(candidates, lambda c: (c["id"] == d["id"]) & c["locked"]) & ~d["keep"])
    unsure = F.exists(decisions, lambda d: d["confidence"] < accept)
    kept = F.filter(candidates, lambda c: c["locked"] | F.exists(decisions, lambda d: (d["id"] == c["id"]) & d["keep"]))
    clash = F.exists(kept, lambda a: F.exists(kept, lambda b: (a["id"] != b["id"]) & overlaps(a, b)))
    return F.when(decisions.isNull(), "NO_DECISIONS").when(unknown, "UNKNOWN_ID").when(locked, "LOCKED_REMOVED").when(undecided, "UNDECIDED").when(unsure, "LOW_CONFIDENCE").when(clash, "OVERLAP").when(F.size(kept) == 0, "EMPTY")
