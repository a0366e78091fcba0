"""Between characters and model tokens: tokenisers with offsets, projection of spans to tags and back, batches by length."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import normalize

TOKENS = "array<struct<piece:string,start:int,end:int>>"


def characters(text: Column) -> Column:
    """Each character that is no white space as a token with its offsets."""
    spots = F.sequence(F.lit(0), F.length(text) - 1)
    each = F.transform(spots, lambda i: F.struct(F.substring(normalize(text), i + 1, 1).alias("piece"), i.alias("start"), (i + 1).alias("end")))
    return F.when(F.length(text) > 0, F.filter(each, lambda t: ~t["piece"].rlike("^\\s$"))).otherwise(F.array()).cast(TOKENS)


def word_pieces(vocabulary: set[str], unknown: str = "[UNK]", longest: int = 100) -> Callable[[str], list[tuple[str, int, int]]]:
    """Greedy longest-match pieces: words part at white space, ideographs and punctuation stand alone, later pieces of a word begin with ##."""

    def alone(c: str) -> bool:
        return "㐀" <= c <= "䶿" or "一" <= c <= "鿿" or (not c.isalnum() and not c.isspace())

    def run(text: str) -> list[tuple[str, int, int]]:
        out, i, n = [], 0, len(text)
        while i < n:
            if text[i].isspace():
                i += 1
                continue
            j = i + 1
            if not alone(text[i]):
                while j < n and not text[j].isspace() and not alone(text[j]):
                    j += 1
            word, pieces, at = text[i:j].lower(), [], 0
            while at < len(word) and len(word) <= longest:
                end = next((e for e in range(len(word), at, -1) if ("##" if at else "") + word[at:e] in vocabulary), None)
                if end is None:
                    break
                pieces.append((("##" if at else "") + word[at:end], i + at, i + end))
                at = end
            out += pieces if at == len(word) else [(unknown, i, j)]
            i = j
        return out

    return run


def tokenize(texts: DataFrame, split: Callable[[str], list[tuple[str, int, int]]], most: int = 128) -> DataFrame:
    """(id, tokens, truncated) of texts (id, text): at most `most` - 2 tokens, as two places belong to the model's marks."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(i, split(t or "")) for i, t in zip(frame["id"], frame["text"], strict=True)]
            yield pd.DataFrame({"id": [i for i, _ in rows], "tokens": [[dict(zip(("piece", "start", "end"), x, strict=True)) for x in r[: most - 2]] for _, r in rows], "truncated": [len(r) > most - 2 for _, r in rows]})

    return texts.select(F.col("id").cast("long"), "text").mapInPandas(run, f"id long, tokens {TOKENS}, truncated boolean")


def tags(tokens: Column, spans: Column, boundary: str = "expand") -> Column:
    """BIO tags of tokens under spans that do not overlap. A span that cuts a token takes it whole (expand) or is left out (drop)."""
    touches = lambda t, s: (t["start"] < s["end"]) & (t["end"] > s["start"])
    cuts = lambda s: F.exists(tokens, lambda t: touches(t, s) & ((t["start"] < s["start"]) | (t["end"] > s["end"])))
    used = spans if boundary == "expand" else F.filter(spans, lambda s: ~cuts(s))
    hit = lambda t: F.get(F.filter(used, lambda s: touches(t, s)), F.lit(0))

    def one(t: Column, i: Column) -> Column:
        before = F.when(i > 0, F.get(tokens, i - 1))
        return F.when(hit(t).isNull(), F.lit("O")).otherwise(F.concat(F.when(before.isNotNull() & touches(before, hit(t)), F.lit("I-")).otherwise(F.lit("B-")), hit(t)["label"]))

    return F.transform(tokens, one)


def character_spans(text: Column, tokens: Column, found: Column) -> Column:
    """Spans of token numbers as spans of characters with their text, white space at the ends taken off."""

    def one(s: Column) -> Column:
        start, end = F.get(tokens, s["start"])["start"], F.get(tokens, s["end"] - 1)["end"]
        raw = F.substring(text, start + 1, end - start)
        left, right = F.length(raw) - F.length(F.ltrim(raw)), F.length(raw) - F.length(F.rtrim(raw))
        return F.struct((start + left).alias("start"), (end - right).alias("end"), s["label"].alias("label"), F.trim(raw).alias("text"))

    return F.filter(F.transform(found, one), lambda s: s["start"] < s["end"])


def predict(texts: DataFrame, model: Callable[[list[str]], list[list[dict]]], schema: str, batch: int = 64) -> DataFrame:
    """(id, entities) by any model function over batches of texts alike in length; a failing batch gives null entities."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            frame = frame.iloc[frame["text"].fillna("").str.len().argsort(kind="stable")]
            for at in range(0, len(frame), batch):
                part = frame.iloc[at : at + batch]
                try:
                    found = model(part["text"].fillna("").tolist())
                except Exception:  # the caller's model: its texts go on to the dictionary
                    found = [None] * len(part)
                yield pd.DataFrame({"id": part["id"].to_numpy(), "entities": found})

    return texts.select(F.col("id").cast("long"), "text").mapInPandas(run, f"id long, entities {schema}")
