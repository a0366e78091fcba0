"""Personal data: fixed forms first, then bootstrapped contextual extraction.

The fixed forms are seeds. The words around seeds are lexical patterns; patterns and identifier-like instances form a
graph that Spark scores round by round: a pattern is as good as the known share of what it extracts, an instance as
good as the patterns that extract it. Instances of high score that the forms did not find are added."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import Scratch, small_side

KINDS = ("email", "ip", "card", "phone")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)+")
# A match begins at the first digit of a run, so that long runs are read once.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_WORD = re.compile(r"\S+")
#: Words of digits and marks standing side by side, the last one whole.
_RUN = re.compile(r"(?<!\S)[+(\[]*[0-9][0-9()\[\]./+-]*(?: [(\[]*[0-9][0-9()\[\]./+-]*)+(?=[,;:!?'\"]*(?:\s|$))")
#: Digits that one identifier may have.
MOST_DIGITS = 19
_DIGIT = re.compile(r"[0-9]")
_NUMBER = re.compile(r"[0-9]+")
#: Characters read on either side of an instance for its context.
CONTEXT = 120

Span = tuple[int, int]


def emails(text: str) -> Iterator[Span]:
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            end = m.end()
        at = text.find("@", max(at + 1, end))


def ips(text: str) -> Iterator[Span]:
    for m in _IP.finditer(text):
        parts = [p.lstrip("0") for p in m.group().split(".")]
        if all(len(p) < 4 and int(p or 0) <= 255 for p in parts):
            yield m.span()


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def cards(text: str) -> Iterator[Span]:
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13:
            digits = m.group().replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                yield m.span()


def phones(text: str) -> Iterator[Span]:
    for m in _PHONE.finditer(text):
        if 9 <= len(_DIGIT.findall(m.group())) <= 15:
            yield m.span()


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """All spans of the fixed forms, by kind as in KINDS, then by start."""
    out = [("email", *s) for s in emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        out += [(kind, *s) for kind, find in (("ip", ips), ("card", cards), ("phone", phones)) for s in find(text)]
    return out


def fits(kind: str, instance: str) -> bool:
    """Whether an instance that a pattern of `kind` extracts could be of that kind at all."""
    digits = len(_DIGIT.findall(instance))
    if kind == "email":
        return "@" in instance[1:-1]
    if kind == "ip":
        return 4 <= digits <= 12 and instance.count(".") + instance.count(":") >= 3
    return digits >= (12 if kind == "card" else 7) and not any(c.isalpha() for c in instance)


def _bare(text: str, start: int, end: int) -> Span:
    """A span less the marks around it; a + and a bracket that closes inside stay."""
    while end > start and not text[end - 1].isalnum():
        end -= 1
    while start < end and not text[start].isalnum() and text[start] != "+" and not (text[start] == "(" and text.find(")", start, end) > 0):
        start += 1
    return start, end


def instances(text: str, base: list[tuple[str, int, int]]) -> Iterator[tuple[str | None, int, int]]:
    """Base spans, and words with an @ or at least four digits and runs of number words that no base span touches, less
    the marks around them. A run and a word of it both count; runs longer than an identifier go by their words."""
    yield from base
    if "@" not in text and not _DIGIT.search(text):
        return
    words = [m.span() for m in _WORD.finditer(text) if "@" in m.group() or len(_DIGIT.findall(m.group())) >= 4]
    runs = [m.span() for m in _RUN.finditer(text) if len(_DIGIT.findall(m.group())) <= MOST_DIGITS]
    taken = sorted((s, e) for _, s, e in base)
    i = 0
    for start, end in sorted(words + runs):
        while i < len(taken) and taken[i][1] <= start:
            i += 1
        if any(s < end for s, _ in taken[i : i + 1]):
            continue
        start, end = _bare(text, start, end)
        if end - start >= 5 and any(fits(k, text[start:end]) for k in KINDS):
            yield None, start, end


def patterns(text: str, start: int, end: int) -> list[str]:
    """The lexical patterns around a span: two words before; a word before and one after. Numbers count alike."""
    before = [_NUMBER.sub("0", w) for w in text[max(0, start - CONTEXT) : start].lower().split()[-2:]]
    after = [_NUMBER.sub("0", w) for w in text[end : end + CONTEXT].lower().split()[:1]]
    out = []
    if len(before) == 2:
        out.append("L " + " ".join(before))
    if before and after:
        out.append(f"M {before[-1]} _ {after[0]}")
    return out


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in sorted(spans, key=lambda x: (KINDS.index(x[0]), x[1], x[2])))


_FOUND = "id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, seen array<struct<kind:string,start:int,end:int,value:string,patterns:array<string>>>"
_SEEN = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("value", pa.string()), ("patterns", pa.list_(pa.string()))]))


def _detect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts: list[list[int]] = [[], [], [], []]
        shas, spans, seen = [], [], []
        for text in batch.column(1).to_pylist():
            text = text or ""
            base = base_spans(text)
            line = joined(base)
            for n, kind in zip(counts, KINDS, strict=True):
                n.append(sum(k == kind for k, _, _ in base))
            shas.append(hashlib.sha256(line.encode()).hexdigest())
            spans.append(line)
            seen.append([{"kind": k, "start": s, "end": e, "value": text[s:e], "patterns": patterns(text, s, e)} for k, s, e in instances(text, base)])
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), *[pa.array(n, pa.int64()) for n in counts], pa.array(shas, pa.string()), pa.array(spans, pa.string()), pa.array(seen, _SEEN)],
            ["id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "seen"],
        )


def _shape(kind: Column, value: Column) -> Column:
    """fits() as an expression."""
    digits = F.length(F.regexp_replace(value, "[^0-9]", ""))
    marks = F.length(F.regexp_replace(value, "[^.:]", ""))
    plain = ~F.exists(F.split(value, ""), lambda c: F.lower(c) != F.upper(c))
    return (
        F.when(kind == "email", F.instr(value, "@").between(2, F.length(value) - 1))
        .when(kind == "ip", digits.between(4, 12) & (marks >= 3))
        .when(kind == "card", (digits >= 12) & plain)
        .otherwise((digits >= 7) & plain)
    )


def bootstrap(graph: DataFrame, scratch: Scratch, rounds: int, sure: float, support: int) -> DataFrame:
    """(value, kind, score) of instances that the forms did not find, from edges (pattern, value, kind or null).

    Each round: the confidence of a pattern for a kind is the summed score of that kind's instances over all distinct
    instances it extracts, if `support` or more of them are known, by their form or since an earlier round; an unknown
    instance scores 1 less the product of (1 - confidence) over its patterns; those at or over `sure` count as known in
    the next round."""
    edges = scratch.cut(graph.groupBy("pattern", "value").agg(F.max("kind").alias("kind")), "edges")
    known = edges.where("kind is not null").select("value", "kind", F.lit(1.0).alias("score")).distinct()
    # a pattern of fewer instances than `support` never has that many known ones
    extracted = scratch.cut(edges.groupBy("pattern").agg(F.count("*").alias("n")).where(f"n >= {support}"), "extracted")
    useful = scratch.cut(edges.join(small_side(extracted.select("pattern")), "pattern", "left_semi"), "useful")
    found = None
    for _ in range(rounds):
        now = known if found is None else known.union(found.join(known, "value", "left_anti"))
        held = useful.select("pattern", "value").join(now, "value").groupBy("pattern", "kind").agg(F.sum("score").alias("mass"), F.count("*").alias("hits"))
        good = held.where(f"hits >= {support}").join(extracted, "pattern").select("pattern", F.col("kind"), (F.col("mass") / F.col("n")).alias("confidence"))
        good = good.where(F.col("confidence") >= sure / 2)
        scored = useful.where("kind is null").select("pattern", "value").join(good, "pattern").where(_shape(F.col("kind"), F.col("value"))).groupBy("value", "kind").agg((1 - F.product(1 - F.col("confidence"))).alias("score"))
        best = scored.groupBy("value").agg(F.max_by(F.struct("kind", "score"), F.struct("score", "kind")).alias("b"))
        new = scratch.cut(best.select("value", "b.kind", "b.score").where(F.col("score") >= sure), "found")
        if found is not None and new.count() == found.count() and not new.join(found, ["value", "kind"], "left_anti").limit(1).count():
            return new
        found = new
    return found


def find_pii(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rounds: int = 4, sure: float = 0.8, support: int = 3) -> DataFrame:
    """(id_col, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added) for every row of docs.

    Counts and base_sha256 are of the fixed forms; spans holds those and the n_added spans that contexts revealed.
    Null and empty texts have no spans. Rows are answered each, repeated and null ids included; instances are
    counted once however many rows repeat them; other columns are left alone."""
    scratch = Scratch(spark, "pii")
    src = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    rows = scratch.cut(src.mapInArrow(_detect, _FOUND).withColumn("row", F.monotonically_increasing_id()), "rows")
    seen = rows.where(F.size("seen") > 0).select("row", F.explode("seen").alias("s")).select("row", "s.*")
    graph = seen.select(F.explode("patterns").alias("pattern"), "value", "kind")
    found = bootstrap(graph, scratch, rounds, sure, support)
    added = seen.where("kind is null").drop("kind").join(small_side(found.select("value", F.col("kind"))), "value")
    added = added.groupBy("row").agg(F.collect_list(F.struct("kind", "start", "end")).alias("added"))
    # a word gives way to the run it belongs to
    wider = lambda x: lambda y: (y["start"] <= x["start"]) & (y["end"] >= x["end"]) & (y["end"] - y["start"] > x["end"] - x["start"])
    added = added.select("row", F.filter("added", lambda x: ~F.exists("added", wider(x))).alias("added"))
    added = scratch.cut(added, "added")
    old = F.when(F.col("spans") == "", F.array().cast("array<struct<kind:string,start:int,end:int>>")).otherwise(
        F.transform(F.split("spans", ","), lambda x: F.struct(F.split(x, ":")[0].alias("kind"), F.split(x, ":")[1].cast("int").alias("start"), F.split(x, ":")[2].cast("int").alias("end")))
    )
    place = lambda x: F.struct(F.array_position(F.array(*map(F.lit, KINDS)), x["kind"]).alias("p"), x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind"))
    merged = F.array_join(F.transform(F.array_sort(F.transform(F.concat(old, "added"), place)), lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    out = rows.drop("seen").join(small_side(added), "row", "left")
    return out.select(
        F.col("id").alias(id_col), "n_email", "n_ip", "n_card", "n_phone", "base_sha256",
        F.when(F.col("added").isNull(), F.col("spans")).otherwise(merged).alias("spans"), F.coalesce(F.size("added"), F.lit(0)).cast("long").alias("n_added"),
    )
