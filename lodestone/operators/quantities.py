"""Quantities in titles: numbers with units, and what numbers joined by a sign make together.

A reader walks the text once. At every number that begins afresh it reads up to three members (number, blanks, unit),
joined by one kind of sign, and asks for each stretch of members what it means; where meanings overlap the widest stays."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Units and their labels.
LATIN_UNITS = {
    "CAPACITY": "gb tb mb kb ml l", "SIZE": "mm cm km inch m", "WEIGHT": "kg mg", "SPEC": "v kv w kw a ma mah hz khz rpm dpi",
}
CJK_UNITS = {
    "CAPACITY": "毫升 升", "SIZE": "英寸 厘米 毫米 寸 码 米", "WEIGHT": "毫克 千克 公斤 克 斤 两 磅 吨",
    "SPEC": "瓦 伏 安 度 匹 马力 头 孔 位 口 档 层 座", "PACKAGE_COMBINATION": "片 只 支 卷 包 件 盒 套 对 双 节 张 袋 瓶 罐 组 箱 粒 枚 块 根 个 条",
}
# Signs, units that count in a compound, a unit that begins another word (6口味 counts flavours).
SIGNS = {"range": "-~～—–至", "times": "xX×*ｘＸ", "plus": "+"}
LENGTHS = frozenset("mm cm km m 毫米 厘米 米".split())
STORAGE = frozenset("gb g tb t".split())
MASSES = frozenset("mg g kg μg ug".split())
NOT_BEFORE = {"口": "味"}

UNIT_LABEL = {unit: label for table in (LATIN_UNITS, CJK_UNITS) for label, units in table.items() for unit in units.split()}
_SIGN = {c: kind for kind, signs in SIGNS.items() for c in signs}
#: Units by first character, the longest first; bare g and t and masses of a litre are units of compounds only.
_UNITS: dict[str, list[str]] = {}
for _u in sorted({*UNIT_LABEL, *STORAGE, *MASSES}, key=lambda u: (-len(u), u)):
    _UNITS.setdefault(_u[0], []).append(_u)
_MOST_MEMBERS = 3

Span = tuple[int, int, str]


def _wordy(c: str) -> bool:
    return c.isascii() and c.isalnum()


def _blanks(text: str, at: int) -> int:
    while at < len(text) and text[at].isspace():
        at += 1
    return at


@dataclass
class Member:
    """A number and the unit after it; end is after the unit, or after the number where none follows."""

    digits: str
    written: str
    unit: str
    end: int


def _member(text: str, at: int) -> Member | None:
    end = at
    while end < len(text) and text[end].isdecimal():
        end += 1
    if end == at:
        return None
    if end + 1 < len(text) and text[end] == "." and text[end + 1].isdecimal():
        end += 1
        while end < len(text) and text[end].isdecimal():
            end += 1
    digits, after = text[at:end], _blanks(text, end)
    for unit in _UNITS.get(text[after : after + 1].lower(), ()):
        stop = after + len(unit)
        if text[after:stop].lower() == unit:
            # a unit of letters ends where no word goes on, or where a sign stands
            if not unit.isascii() or stop == len(text) or not _wordy(text[stop]) or (text[stop] in _SIGN and stop + 1 < len(text) and text[stop + 1].isdecimal()):
                return Member(digits, text[after:stop], unit, stop)
    return Member(digits, "", "", end)


def _alone(text: str, m: Member) -> str | None:
    """What one member means."""
    after = text[m.end : m.end + 1]
    if not m.unit or after == "/" or (after and NOT_BEFORE.get(m.unit) == after) or (m.unit.isascii() and after and _wordy(after)):
        return None
    if m.unit in ("g", "t"):  # the case decides
        return "CAPACITY" if m.written.isupper() else "WEIGHT"
    return UNIT_LABEL.get(m.unit)


def _jointly(text: str, members: list[Member], sign: str) -> str | None:
    """What members joined by a sign mean."""
    *before, last = members
    after = text[last.end : last.end + 1]
    if not last.unit or (after and _wordy(after)):
        return None
    plain, whole = all(not m.unit for m in before), all("." not in m.digits for m in members)
    if sign == "range":
        return _alone(text, last) if plain and len(members) == 2 and last.unit in UNIT_LABEL else None
    if sign == "plus":
        fits = len(members) == 2 and whole and all(len(m.digits) <= 4 for m in members) and last.unit in STORAGE and before[0].unit in ("", *STORAGE)
        return "CAPACITY" if fits else None
    if plain and last.unit in LENGTHS:
        return "SIZE"
    units = [m.unit for m in members]
    if units == ["dpi", "dpi"] and whole:
        return "SPEC"
    return "SIZE" if units == ["g", "mm"] else None


def _of_a_litre(text: str, members: list[Member], sign: str) -> int:
    """Where a mass of a litre, or a range of them, ends; 0 if it is none."""
    last = members[-1]
    if last.unit not in MASSES or (len(members) > 1 and (sign != "range" or len(members) > 2 or members[0].unit)):
        return 0
    at = _blanks(text, last.end)
    at = _blanks(text, at + 1) if text[at : at + 1] == "/" else len(text)
    return at + 1 if text[at : at + 1].lower() == "l" and not _wordy(text[at + 1 : at + 2] or " ") else 0


def _meanings(text: str, at: int) -> Iterator[Span]:
    """(start, end, label) of all that may begin with the number at a place."""
    members, sign = [], ""
    place = at
    while len(members) < _MOST_MEMBERS and (m := _member(text, place)):
        members.append(m)
        label = _alone(text, m) if len(members) == 1 else _jointly(text, members, sign)
        if label:
            yield at, m.end, label
        if end := _of_a_litre(text, members, sign):
            yield at, end, "SPEC"
        place = _blanks(text, m.end)
        kind = _SIGN.get(text[place : place + 1], "")
        if not kind or (sign and kind != sign):
            break
        sign, place = kind, _blanks(text, place + 1)
    # numbers that a letter makes a grade: 1080p, 4K, 2700K
    digits = members[0].digits
    stop = at + len(digits)
    letter, beyond = text[stop : stop + 1].lower(), text[stop + 1 : stop + 2]
    if "." not in digits and not (beyond and _wordy(beyond)) and ((letter == "p" and len(digits) <= 4) or (letter == "k" and (digits in ("2", "4", "8") or 3 <= len(digits) <= 5))):
        yield at, stop + 1, "SPEC"


def measures(text: str) -> list[Span]:
    """(start, end, label) of the quantities of a text, the widest where they overlap, in order of start."""
    found: list[Span] = []
    for at, c in enumerate(text):
        if c.isdecimal():
            if not at or not (_wordy(text[at - 1]) or text[at - 1] == "."):
                found += _meanings(text, at)
        elif c == "号":  # a grade by number, of one or two digits
            digits = [i for i in (at - 2, at - 1) if i >= 0 and text[i].isdecimal()]
            if digits and digits[-1] == at - 1:
                found.append((digits[0], at + 1, "SPEC"))
    kept: list[Span] = []
    for span in sorted(found, key=lambda s: (s[0] - s[1], s[0], s[2])):
        if all(span[1] <= s or e <= span[0] for s, e, _ in kept):
            kept.append(span)
    return sorted(kept)


def annotate_measures(texts: DataFrame) -> DataFrame:
    """(id, start, end, label, text) of the quantities in texts (id, text). Distinct texts are read once, in Arrow
    batches; null texts have none, repeated ids are answered each."""
    schema = pa.schema([("text", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("label", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(t, *span) for t in batch.column(0).to_pylist() for span in measures(t)]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)

    kinds = texts.where("text is not null").select("text").distinct().mapInArrow(run, "text string, start int, end int, label string")
    met = texts.select(F.col("id").cast("long").alias("id"), F.col("text").alias("_whole")).join(kinds.withColumnRenamed("text", "_kind"), F.col("_whole") == F.col("_kind"))
    return met.select("id", "start", "end", "label", F.expr("substring(_whole, start + 1, end - start)").alias("text"))
