"""Annotation quality: strict span scores, error kinds, agreement, conflicts, assignment, merging and validation."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

KEY = ["id", "start", "end", "label"]


def ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(0.0)


def outcomes(gold: DataFrame, pred: DataFrame) -> DataFrame:
    """(id, start, end, label, tp, fp, fn) of the distinct spans of either side."""
    g, p = gold.select(*KEY).distinct().withColumn("g", F.lit(1)), pred.select(*KEY).distinct().withColumn("p", F.lit(1))
    both = g.join(p, KEY, "full_outer")
    return both.select(*KEY, F.when(F.col("g").isNotNull() & F.col("p").isNotNull(), 1).otherwise(0).alias("tp"), F.when(F.col("g").isNull(), 1).otherwise(0).alias("fp"), F.when(F.col("p").isNull(), 1).otherwise(0).alias("fn"))


def scores(out: DataFrame) -> DataFrame:
    """(label, tp, fp, fn, precision, recall, f1): every label, `micro` over all and `macro` over labels with gold spans."""
    sums = [F.sum(c).alias(c) for c in ("tp", "fp", "fn")]

    def finish(rows: DataFrame) -> DataFrame:
        p, r = ratio(F.col("tp"), F.col("tp") + F.col("fp")), ratio(F.col("tp"), F.col("tp") + F.col("fn"))
        return rows.withColumn("precision", F.round(p, 6)).withColumn("recall", F.round(r, 6)).withColumn("f1", F.round(F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0), 6))

    per = finish(out.groupBy("label").agg(*sums))
    micro = finish(out.agg(*sums).select(F.lit("micro").alias("label"), "tp", "fp", "fn"))
    macro = per.where("tp + fn > 0").agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")], *[F.round(F.avg(c), 6).alias(c) for c in ("precision", "recall", "f1")])
    return per.unionByName(micro).unionByName(macro.withColumn("label", F.lit("macro")))


def confusion(gold: DataFrame, pred: DataFrame) -> DataFrame:
    """(gold, pred, n) over places, O where a side has no span."""
    place = ["id", "start", "end"]
    g, p = gold.select(*place, F.col("label").alias("gold")).distinct(), pred.select(*place, F.col("label").alias("pred")).distinct()
    both = g.join(p, place, "full_outer")
    return both.groupBy(F.coalesce("gold", F.lit("O")).alias("gold"), F.coalesce("pred", F.lit("O")).alias("pred")).agg(F.count("*").alias("n"))


def error_kinds(gold: DataFrame, pred: DataFrame) -> DataFrame:
    """(id, kind, gold_label, pred_label) of wrong spans, each gold and each prediction used once.

    By document, in order of (start, end, label): same place, other label (type); else overlap with the same label
    (boundary) or another (boundary_type); else missing. Predictions that are left are spurious. The matching is
    greedy and sequential, so it runs per document; a document's spans are few."""
    import pandas as pd

    g = gold.select(*KEY).distinct().withColumn("side", F.lit("g"))
    rows = g.union(pred.select(*KEY).distinct().withColumn("side", F.lit("p")))
    wrong = rows.groupBy(*KEY).agg(F.count("*").alias("n"), F.min("side").alias("side")).where("n = 1").drop("n")

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        order = sorted(zip(frame["start"], frame["end"], frame["label"], frame["side"], strict=True))
        golds, free = [x[:3] for x in order if x[3] == "g"], [x[:3] for x in order if x[3] == "p"]
        found, rest = [], []
        for x in golds:
            same = next((y for y in free if y[:2] == x[:2]), None)
            if same:
                free.remove(same)
                found.append(("type", x[2], same[2]))
            else:
                rest.append(x)
        for x in rest:
            over = next((y for y in free if y[0] < x[1] and x[0] < y[1]), None)
            if over:
                free.remove(over)
                found.append(("boundary" if over[2] == x[2] else "boundary_type", x[2], over[2]))
            else:
                found.append(("missing", x[2], None))
        found += [("spurious", None, y[2]) for y in free]
        return pd.DataFrame([(frame["id"].iloc[0], *f) for f in found], columns=["id", "kind", "gold_label", "pred_label"])

    return wrong.groupBy("id").applyInPandas(run, "id long, kind string, gold_label string, pred_label string")


def oov_recall(gold: DataFrame, pred: DataFrame, known: DataFrame) -> DataFrame:
    """(support, found, recall) of gold spans whose text the known surfaces lack."""
    unseen = gold.join(known.select(F.lower("surface").alias("_s")).distinct(), F.lower("text") == F.col("_s"), "left_anti")
    hit = unseen.select(*KEY).distinct().join(pred.select(*KEY).distinct().withColumn("_hit", F.lit(1)), KEY, "left")
    return hit.agg(F.count("*").alias("support"), F.count("_hit").alias("found"), F.round(F.coalesce(F.avg(F.coalesce("_hit", F.lit(0)).cast("double")), F.lit(0.0)), 6).alias("recall"))


def agreement(rows: DataFrame) -> DataFrame:
    """(pairs, exact, exact_rate, f1) over pairs of annotators of one item, rows being (id, name, spans: list)."""
    l, r = rows.select("id", F.col("name").alias("ln"), F.col("spans").alias("ls")), rows.select("id", F.col("name").alias("rn"), F.col("spans").alias("rs"))
    pair = l.join(r, "id").where("ln < rn")
    matched = F.size(F.array_intersect("ls", "rs"))
    sums = pair.agg(F.count("*").alias("pairs"), F.count_if((matched == F.size("ls")) & (matched == F.size("rs"))).alias("exact"), F.sum(matched).alias("m"), F.sum(F.size("ls") + F.size("rs")).alias("t"))
    return sums.select("pairs", "exact", F.round(ratio(F.col("exact"), F.col("pairs")), 6).alias("exact_rate"), F.round(F.when(F.col("pairs") == 0, None).when(F.col("t") == 0, 1.0).otherwise(2 * F.col("m") / F.col("t")), 6).alias("f1"))


def conflict_kind(l: Column, r: Column) -> Column:
    """Kind of difference between two span lists: none, label, boundary or other entities."""
    place = lambda a: F.array_sort(F.transform(a, lambda x: F.struct(x["start"], x["end"])))
    over = lambda a, b: F.forall(a, lambda x: F.exists(b, lambda y: (x["start"] < y["end"]) & (y["start"] < x["end"])))
    return F.when(F.array_sort(l) == F.array_sort(r), "NONE").when(place(l) == place(r), "LABEL").when((F.size(l) == F.size(r)) & over(l, r) & over(r, l), "BOUNDARY").otherwise("ENTITY_SET")


def assign(items: DataFrame, names: list[str], overlap: float, seed: str = "42") -> DataFrame:
    """(id, annotator, role): items round robin in the order of their hash; the first share of them has a second annotator.

    Places come from counts of hash slices, so no task orders all items."""
    n = len(names)
    slices = items.withColumn("h", F.sha2(F.concat_ws(":", F.lit(seed), F.col("id").cast("string")), 256)).withColumn("slice", F.substring("h", 1, 2))
    inside = slices.withColumn("r", F.row_number().over(W.partitionBy("slice").orderBy("h", "id")))
    sums = slices.groupBy("slice").agg(F.count("*").alias("c")).withColumn("before", F.sum("c").over(W.orderBy("slice")) - F.col("c")).withColumn("all", F.sum("c").over(W.partitionBy()))
    placed = inside.join(F.broadcast(sums), "slice").withColumn("k", F.col("before") + F.col("r") - 1)
    who = F.array(*map(F.lit, names))
    twice = F.col("k") < F.bround(F.col("all") * overlap)
    step = F.lit(1) + F.pmod(F.floor(F.col("k") / n), F.lit(max(1, n - 1)))
    first = placed.select("id", F.get(who, F.pmod("k", F.lit(n)).cast("int")).alias("annotator"), F.when(twice, "overlap_primary").otherwise("single").alias("role"))
    second = placed.where(twice & F.lit(n > 1)).select("id", F.get(who, F.pmod(F.col("k") + step, F.lit(n)).cast("int")).alias("annotator"), F.lit("overlap_secondary").alias("role"))
    return first.union(second)


def merge_annotations(rows: DataFrame, adjudicated: DataFrame) -> DataFrame:
    """(id, status): one annotator silver_single, equal ones gold_agreement, others gold_adjudicated if decided, else unresolved."""
    one = rows.groupBy("id").agg(F.count("*").alias("n"), F.count_distinct(F.to_json(F.array_sort("spans"))).alias("kinds"))
    done = one.join(adjudicated.select("id").distinct().withColumn("_d", F.lit(True)), "id", "left")
    return done.select("id", F.when(F.col("n") == 1, "silver_single").when(F.col("kinds") == 1, "gold_agreement").when(F.col("_d"), "gold_adjudicated").otherwise("unresolved").alias("status"))


def merge_adjudicated(rows: DataFrame, adjudicated: DataFrame) -> DataFrame:
    """(id, status, spans, error) of rows (id, text, spans) and adjudicated (id, text, spans): equal or single answers
    stay, conflicts take the adjudicated row. error: MISSING (conflict without one), SEVERAL (more than one), TEXT_MISMATCH,
    UNUSED (an adjudicated row without a conflict)."""
    spans = F.array_sort("spans")
    one = rows.groupBy("id").agg(F.count("*").alias("n"), F.count_distinct(F.to_json(spans)).alias("kinds"), F.collect_set("text").alias("texts"), F.min(F.struct(F.to_json(spans).alias("k"), spans.alias("spans"))).alias("own"))
    told = adjudicated.groupBy("id").agg(F.count("*").alias("m"), F.min(F.struct(F.to_json(spans).alias("k"), spans.alias("spans"), F.col("text").alias("text"))).alias("told"))
    clash = F.col("kinds") > 1
    status = F.when(F.col("n").isNull(), None).when(F.col("n") == 1, "silver_single").when(~clash, "gold_agreement").otherwise("gold_adjudicated")
    error = F.when(F.col("m") > 1, "SEVERAL").when(F.col("n").isNull() | (~clash & F.col("m").isNotNull()), "UNUSED").when(clash & F.col("m").isNull(), "MISSING").when(clash & ~F.array_contains("texts", F.col("told.text")), "TEXT_MISMATCH")
    return one.join(told, "id", "full_outer").select("id", status.alias("status"), F.when(clash, F.col("told.spans")).otherwise(F.col("own.spans")).alias("spans"), error.alias("error"))


def merge_candidates(spans: DataFrame) -> DataFrame:
    """(id, start, end, label, sources, locked) of spans (..., source, locked): equal spans are one, with all their sources."""
    return spans.groupBy(*KEY).agg(F.sort_array(F.collect_set("source")).alias("sources"), F.max(F.coalesce("locked", F.lit(False))).alias("locked"))


def aligned(left: DataFrame, right: DataFrame) -> DataFrame:
    """(no, left_id, right_id, fault) of two numbered tables (no, id) that should hold the same ids at the same places."""
    both = left.select("no", F.col("id").alias("left_id"), F.lit(True).alias("_l")).join(right.select("no", F.col("id").alias("right_id"), F.lit(True).alias("_r")), "no", "full_outer")
    fault = F.when(F.col("_l").isNull(), "RIGHT_LONGER").when(F.col("_r").isNull(), "RIGHT_SHORTER").when(~F.col("left_id").cast("string").eqNullSafe(F.col("right_id").cast("string")), "ID_MISMATCH")
    return both.select("no", "left_id", "right_id", fault.alias("fault")).where("fault is not null")


def key_faults(rows: DataFrame, key: str) -> DataFrame:
    """(key, n) of keys that repeat or are null: a join on the key would multiply or lose rows."""
    return rows.groupBy(F.col(key).alias("key")).agg(F.count("*").alias("n")).where("n > 1 or key is null")


def gate(stats: DataFrame, most_missed: float = 0.05) -> DataFrame:
    """(miss_rate, incomplete, passed) of one row of counts (asked, missed, unparsed, unanswered)."""
    rate = ratio(F.col("missed"), F.col("asked"))
    gaps = F.coalesce("unparsed", F.lit(0)) + F.coalesce("unanswered", F.lit(0))
    return stats.select(F.round(rate, 6).alias("miss_rate"), gaps.cast("long").alias("incomplete"), ((rate <= most_missed) & (gaps == 0)).alias("passed"))


def validate(rows: DataFrame, labels: list[str]) -> DataFrame:
    """(code, n) of faults of spans in rows (id, text, entities)."""
    flat = rows.select("id", "text", F.posexplode("entities").alias("i", "e")).select("id", "text", "i", "e.start", "e.end", "e.label", F.col("e.text").alias("surface"))
    w = W.partitionBy("id").orderBy("start", "end", "i")
    ahead = flat.withColumn("_end", F.max("end").over(w.rowsBetween(W.unboundedPreceding, -1))).withColumn("_same", F.count("*").over(W.partitionBy("id", "start", "end", "label")))
    code = (
        F.when(~F.col("label").isin(labels), "UNKNOWN_LABEL")
        .when((F.col("start") < 0) | (F.col("end") > F.length("text")) | (F.col("start") >= F.col("end")), "BAD_RANGE")
        .when(F.substring(F.col("text"), F.col("start") + 1, F.col("end") - F.col("start")) != F.col("surface"), "TEXT_MISMATCH")
        .when(F.col("_same") > 1, "DUPLICATE")
        .when(F.col("_end") > F.col("start"), "OVERLAP")
        .otherwise("OK")
    )
    return ahead.groupBy(code.alias("code")).agg(F.count("*").alias("n"))


def class_weights(tags: DataFrame, mode: str = "inv_sqrt", cap: float = 10.0) -> DataFrame:
    """(tag, weight): rarer tags weigh more, up to the cap, 1 on average."""
    counts = tags.groupBy("tag").agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").cast("double").alias("t"))
    share = F.col("t") / F.col("n")
    raw = F.least(F.lit(cap), F.sqrt(share) if mode == "inv_sqrt" else share)
    rows = counts.crossJoin(F.broadcast(total)).select("tag", raw.alias("w"))
    return rows.crossJoin(F.broadcast(rows.agg(F.avg("w").alias("m")))).select("tag", F.round(F.col("w") / F.col("m"), 6).alias("weight"))


def legal_transitions(tags: list[str]) -> list[tuple[str, str, bool]]:
    """Whether a tag may follow another under BIO or BIOES."""
    def ok(a: str, b: str) -> bool:
        if b[0] in "IE":
            return a[0] in "BI" and a[2:] == b[2:]
        return not ("E-" + a[2:] in tags and a[0] in "BI")

    return [(a, b, ok(a, b)) for a in tags for b in tags]


def crf_marginals(emissions: list[list[float]], transitions: list[list[float]], first: list[float], last: list[float]) -> list[list[float]]:
    """Tag marginals of one sequence by forward and backward sums."""
    def total(xs: list[float]) -> float:
        m = max(xs)
        return m + math.log(sum(math.exp(x - m) for x in xs))

    n, tags = len(emissions), range(len(first))
    if not n:
        return []
    f = [[first[j] + emissions[0][j] for j in tags]]
    for e in emissions[1:]:
        f.append([total([f[-1][i] + transitions[i][j] for i in tags]) + e[j] for j in tags])
    b = [list(last)]
    for e in reversed(emissions[1:]):
        b.insert(0, [total([transitions[i][j] + e[j] + b[0][j] for j in tags]) for i in tags])
    z = total([f[-1][j] + last[j] for j in tags])
    return [[math.exp(f[t][j] + b[t][j] - z) for j in tags] for t in range(n)]


def compare(left: DataFrame, right: DataFrame, text: str = "text") -> DataFrame:
    """(id, fault) of two annotators' files that should hold the same items: items of one side alone, texts that differ."""
    both = left.select("id", F.col(text).alias("_l"), F.lit(True).alias("_hl")).join(right.select("id", F.col(text).alias("_r"), F.lit(True).alias("_hr")), "id", "full_outer")
    fault = F.when(F.col("_hr").isNull(), "LEFT_ONLY").when(F.col("_hl").isNull(), "RIGHT_ONLY").when(~F.col("_l").eqNullSafe(F.col("_r")), "TEXT_MISMATCH")
    return both.select("id", fault.alias("fault")).where("fault is not null")
