"""Column functions over arrays of spans (start, end, label, ...)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def overlaps(a: Column, b: Column) -> Column:
    return (a["start"] < b["end"]) & (b["start"] < a["end"])


def by_priority(x: Column) -> list[Column]:
    """Priority, label rank, length, start."""
    return [-x["priority"], -x["label_rank"], x["start"] - x["end"], x["start"]]


def by_length(x: Column) -> list[Column]:
    """Length, priority, confidence, start."""
    return [x["start"] - x["end"], -x["priority"], -x["confidence"], x["start"]]


def resolve_overlaps(spans: Column, kind: str, rank: Callable[[Column], list[Column]]) -> Column:
    """Greedy choice of spans that do not overlap, best rank first, given back in order of start; kind is the struct type."""
    keyed = F.transform(spans, lambda x: F.struct(*[c.cast("double").alias(f"k{i}") for i, c in enumerate(rank(x))], x.alias("x")))
    chosen = F.aggregate(
        F.transform(F.array_sort(keyed), lambda k: k["x"]),
        F.array().cast(f"array<{kind}>"),
        lambda kept, x: F.when(F.exists(kept, lambda y: overlaps(x, y)), kept).otherwise(F.concat(kept, F.array(x))),
    )
    return F.array_sort(chosen)


def residual(text: Column, spans: Column) -> Column:
    """What is left of a text when its spans are cut out; spans may overlap, reach outside or be null."""
    size = F.length(text)
    marks = F.transform(F.filter(F.coalesce(spans, F.array().cast("array<struct<start:int,end:int>>")), lambda x: x.isNotNull()), lambda x: F.struct(F.greatest(x["start"], F.lit(0)).alias("s"), F.least(x["end"], size).alias("e")))
    state = F.aggregate(
        F.array_sort(F.filter(marks, lambda x: x["s"] < x["e"])),
        F.struct(F.lit("").alias("out"), F.lit(0).alias("at")),
        lambda a, x: F.struct(F.concat(a["out"], F.when(x["s"] > a["at"], F.substring(text, a["at"] + 1, x["s"] - a["at"])).otherwise(F.lit(""))).alias("out"), F.greatest(a["at"], x["e"]).alias("at")),
    )
    return F.trim(F.concat(state["out"], F.substring(text, state["at"] + 1, size)))


def bio_decode(tags: Column, strict: bool = False) -> Column:
    """Spans of token numbers from BIO or BIOES tags; an I- or E- tag that continues nothing begins a span, or is dropped when strict."""
    kind = "array<struct<start:int,end:int,label:string>>"
    start = F.struct(F.array().cast(kind).alias("done"), F.lit("").alias("label"), F.lit(0).alias("start"), F.lit(0).alias("at"))

    def close(a: Column) -> Column:
        return F.when(a["label"] == "", a["done"]).otherwise(F.concat(a["done"], F.array(F.struct(a["start"].alias("start"), a["at"].alias("end"), a["label"].alias("label")))))

    def step(a: Column, tag: Column) -> Column:
        head, label = F.substring(tag, 1, 1), F.when(tag == "O", "").otherwise(F.substring(tag, 3, 100))
        goes_on = head.isin("I", "E") & (label == a["label"])
        opens = head.isin("B", "S") | (F.lit(not strict) & head.isin("I", "E") & ~goes_on)
        done = F.when(goes_on, a["done"]).otherwise(close(a))
        now, since = F.when(goes_on | opens, label).otherwise(F.lit("")), F.when(goes_on, a["start"]).otherwise(a["at"])
        ends = head.isin("E", "S") & (now != "")
        one = F.array(F.struct(since.alias("start"), (a["at"] + 1).alias("end"), now.alias("label")))
        return F.struct(F.when(ends, F.concat(done, one)).otherwise(done).alias("done"), F.when(ends, F.lit("")).otherwise(now).alias("label"), since.cast("int").alias("start"), (a["at"] + 1).cast("int").alias("at"))

    return F.aggregate(tags, start, step, close)


def viterbi(emissions: Column, transitions: list[list[float]], first: list[float], last: list[float]) -> Column:
    """Best tag path of one sequence of emission rows; ties go to the lower tag."""
    n = len(first)
    tags = range(n)

    def column(values: list[float]) -> Column:
        return F.array(*[F.lit(float(v)) for v in values])

    init = F.struct(F.array().cast("array<double>").alias("score"), F.array().cast("array<array<int>>").alias("back"))

    def step(a: Column, e: Column) -> Column:
        e = F.transform(e, lambda v: v.cast("double"))
        opening = F.struct(F.zip_with(column(first), e, lambda x, y: x + y).alias("score"), a["back"].alias("back"))
        best = [F.array_max(F.array(*[F.struct((a["score"][i] + float(transitions[i][j])).alias("s"), F.lit(-i).alias("i")) for i in tags])) for j in tags]
        more = F.struct(F.array(*[best[j]["s"] + e[j] for j in tags]).alias("score"), F.concat(a["back"], F.array(F.array(*[-best[j]["i"] for j in tags]))).alias("back"))
        return F.when(F.size(a["score"]) == 0, opening).otherwise(more)

    def path(a: Column) -> Column:
        top = F.array_max(F.array(*[F.struct((a["score"][i] + float(last[i])).alias("s"), F.lit(-i).alias("i")) for i in tags]))
        back = F.aggregate(F.reverse(a["back"]), F.array((-top["i"]).cast("int")), lambda p, row: F.concat(F.array(F.get(row, p[0])), p))
        return F.when(F.size(a["score"]) == 0, F.array().cast("array<int>")).otherwise(back)

    return F.aggregate(emissions, init, step, path)
