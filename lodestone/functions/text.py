"""Column functions over text; all native. Offsets are code points, as Spark counts them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Space-like code points and zero-width ones, which become a space; full-width ASCII is U+FF01 to U+FF5E.
SPACES = "".join(map(chr, (0xA0, 0x2000, 0x2001, 0x2002, 0x2003, 0x2004, 0x2005, 0x2006, 0x2007, 0x2008, 0x2009, 0x200A, 0x202F, 0x205F, 0x3000)))
ZERO_WIDTH = "".join(map(chr, (0x200B, 0x200C, 0x200D, 0xFEFF)))
_FROM = SPACES + ZERO_WIDTH + "".join(chr(c) for c in range(0xFF01, 0xFF5F)) + "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_TO = " " * (len(SPACES) + len(ZERO_WIDTH)) + "".join(chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)).lower() + "abcdefghijklmnopqrstuvwxyz"
CONTROL = "".join(chr(c) for c in [*range(32), 127])
CJK = "\u3400-\u4dbf\u4e00-\u9fff"


def normalize(c: Column) -> Column:
    """Length-preserving normal form: odd spaces to a space, full-width to ASCII, A-Z to a-z, nothing else."""
    return F.translate(c, _FROM, _TO)


def clean_control(c: Column) -> tuple[Column, Column]:
    """Text with control characters as spaces, trimmed, and how many were replaced."""
    return F.trim(F.translate(c, CONTROL, " " * len(CONTROL))), F.length(c) - F.length(F.translate(c, CONTROL, ""))


def has_text(c: Column) -> Column:
    return F.coalesce(F.trim(c) != "", F.lit(False))


def template_key(c: Column) -> Column:
    """Digits as #, Latin runs as @, white space gone."""
    out = F.regexp_replace(normalize(c), "[0-9]+", "#")
    return F.regexp_replace(F.regexp_replace(out, "[a-z]+", "@"), "\\s+", "")


def shingles(c: Column, n: int = 4) -> Column:
    """Distinct character n-grams of the normal form without white space; a shorter text is its own shingle."""
    text = F.regexp_replace(normalize(c), "\\s+", "")
    grams = F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{n}}})).") , F.lit(1))
    return F.when(F.length(text) <= n, F.filter(F.array(text), lambda x: x != "")).otherwise(F.array_distinct(grams))


def analyze(c: Column, mode: str = "fine") -> Column:
    """Terms of a text with their positions. fine: Latin or digit runs and single ideographs; coarse: ideographs in pairs."""
    pattern = f"[a-z0-9#]+|[{CJK}]" if mode == "fine" else f"[a-z0-9#]+|[{CJK}]{{1,2}}"
    return F.transform(F.regexp_extract_all(normalize(c), F.lit(pattern), F.lit(0)), lambda t, i: F.struct(t.alias("term"), i.alias("position")))


def matches(text: Column, pattern: str) -> Column:
    """(start, end) of a pattern's matches, which are not empty: what stands between them gives their places."""
    found, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    start = F.struct(F.array().cast("array<struct<start:int,end:int>>").alias("done"), F.lit(0).alias("at"))

    def step(a: Column, i: Column) -> Column:
        begin = a["at"] + F.length(F.get(gaps, i))
        end = begin + F.length(F.get(found, i))
        return F.struct(F.concat(a["done"], F.array(F.struct(begin.alias("start"), end.alias("end")))).alias("done"), end.alias("at"))

    order = F.when(F.size(found) > 0, F.sequence(F.lit(0), F.size(found) - 1)).otherwise(F.array().cast("array<int>"))
    return F.aggregate(order, start, step, lambda a: a["done"])


def analyzed(c: Column, mode: str = "fine") -> Column:
    """(term, position, start, end, type) of a text's terms; type is word, number or ideograph. Offsets hold in the
    text itself, since the normal form keeps lengths."""
    pattern = f"[a-z0-9#]+|[{CJK}]" if mode == "fine" else f"[a-z0-9#]+|[{CJK}]{{1,2}}"
    text = normalize(c)

    def one(m: Column, i: Column) -> Column:
        term = F.substring(text, m["start"] + 1, m["end"] - m["start"])
        kind = F.when(term.rlike("^[0-9]+$"), "number").when(term.rlike("^[a-z0-9#]"), "word").otherwise("ideograph")
        return F.struct(term.alias("term"), i.alias("position"), m["start"].alias("start"), m["end"].alias("end"), kind.alias("type"))

    return F.transform(matches(text, pattern), one)


def price_fen(yuan: Column) -> Column:
    """Half-up rounding to hundredths."""
    return F.floor(yuan * 100 + 0.5).cast("long")
