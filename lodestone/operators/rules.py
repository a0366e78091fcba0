"""Offline recognition: model numbers, word lists, quantities and weighted dictionaries, put together by rank of label;
modes of the recogniser and rows made of model answers. Native but for quantities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.spans import resolve_overlaps
from ..functions.text import matches, normalize
from .entities import OFFLINE_RANK, candidates, merge_hybrid
from .quantities import annotate_measures
from .weak_labels import SPAN, places

# Rank of each label among rules.
RULE_RANK = {"CAPACITY": 95, "SIZE": 94, "WEIGHT": 93, "SPEC": 92, "PACKAGE_COMBINATION": 85, "COLOR": 80, "MATERIAL": 70, "AUDIENCE": 60, "MODEL": 50}
# Patterns of model numbers, their suffix, and words that are none.
MODEL_PATTERNS = (
    r"(?i)(?<![A-Za-z0-9])[a-z]{1,8}[-_]?[a-z0-9]{1,8}(?:[-_][a-z0-9]{1,8}){0,2}(?:\s?(?:pro\s?max|pro|plus|ultra|max|se|lite|mini))?(?![A-Za-z0-9])",
    r"(?i)(?<![A-Za-z0-9])\d{1,4}[a-z]{1,5}(?:[-_][a-z0-9]{1,5})?(?![A-Za-z0-9])",
)
MODEL_SUFFIX = r"(?i)\s+(?:pro\s?max|pro|plus|ultra|max|se|lite|mini)$"
MODEL_STOPWORDS = ("pro", "plus", "max", "ultra", "mini", "se", "lite", "new", "type", "usb", "hd", "led", "lcd", "oled", "cm", "mm", "kg", "ml", "gb", "tb", "pcs", "set", "diy")
# Word lists of the rules.
LEXICONS = {
    "COLOR": ("黑色", "白色", "红色", "蓝色", "绿色", "黄色", "粉色", "紫色", "灰色", "银色", "金色", "米色", "棕色", "橙色", "透明", "香槟金", "深空灰", "星光色", "曜石黑", "雅川青", "远峰蓝"),
    "MATERIAL": ("不锈钢", "塑料", "abs", "pc", "铝合金", "实木", "玻璃", "陶瓷", "硅胶", "纯棉", "真皮", "碳纤维", "亚克力", "橡胶"),
    "AUDIENCE": ("男士", "女士", "儿童", "婴儿", "老人", "学生", "男童", "女童", "孕妇", "宝宝", "情侣"),
}
#: Confidence of quantities, of a bare g or t (told apart by case alone), of model numbers and of listed words.
MEASURE, BARE, MODEL, LISTED = 0.75, 0.55, 0.55, 0.80


def _span(text: Column, start: Column, end: Column, label: str | Column, confidence: float | Column, source: str = "rule") -> Column:
    label, confidence = (x if isinstance(x, Column) else F.lit(x) for x in (label, confidence))
    return F.struct(start.cast("int").alias("start"), end.cast("int").alias("end"), label.alias("label"), F.substring(text, start + 1, end - start).alias("text"), confidence.cast("double").alias("confidence"), F.lit(source).alias("source")).cast(SPAN)


def models(text: Column) -> Column:
    """Model numbers: letters and digits both, no bare unit or marketing word, judged without their suffix."""

    def likely(surface: Column) -> Column:
        core = F.trim(F.regexp_replace(surface, MODEL_SUFFIX, ""))
        letters = F.lower(F.regexp_replace(core, "[^A-Za-z]", ""))
        return (F.length(core) >= 2) & core.rlike("[0-9]") & (letters != "") & (~letters.isin(*MODEL_STOPWORDS) | (F.length(core) > 4))

    each = F.array_distinct(F.concat(*[F.transform(matches(text, p), lambda m: _span(text, m["start"], m["end"], "MODEL", MODEL)) for p in MODEL_PATTERNS]))
    return F.filter(each, lambda s: likely(s["text"]))


def listed(text: Column, words: tuple[str, ...], label: str) -> Column:
    """Every place, overlapping ones too, of every word of a list, whatever the case."""

    def of(word: str) -> Column:
        spans = F.transform(places(text, F.lit(word), 1), lambda i: _span(text, i, i + len(word), label, LISTED))
        return F.when(F.contains(normalize(text), F.lit(word)), spans).otherwise(F.array().cast(f"array<{SPAN}>"))

    parts = [of(w) for w in words]
    return F.concat(*parts)


def _rank(table: dict[str, int], label: Column) -> Column:
    return F.coalesce(F.create_map(*[x for k, v in table.items() for x in (F.lit(k), F.lit(v))])[label], F.lit(0))


def rules(texts: DataFrame, labels: tuple[str, ...] = tuple(RULE_RANK)) -> DataFrame:
    """texts (id, text) with entities of the wanted labels: rank of label, then length, confidence and start decide
    where spans overlap. Null and empty texts have none; ids are taken to be unique."""
    text, none = F.col("text"), F.array().cast(f"array<{SPAN}>")
    native = [models(text)] * ("MODEL" in labels) + [listed(text, words, k) for k, words in LEXICONS.items() if k in labels]
    out = texts.select("id", "text", F.coalesce(F.concat(*native), none).alias("found") if native else none.alias("found"))
    wanted = [x for x in RULE_RANK if x in labels and x not in LEXICONS and x != "MODEL"]
    if wanted:
        unsure = F.col("text").rlike("^[0-9]+(?:\\.[0-9]+)?\\s*[gGtT]$")
        flat = annotate_measures(texts.select("id", "text")).where(F.col("label").isin(wanted))
        span = F.struct("start", "end", "label", "text", F.when(unsure, BARE).otherwise(MEASURE).alias("confidence"), F.lit("rule").alias("source")).cast(SPAN)
        out = out.join(flat.groupBy("id").agg(F.collect_list(span).alias("sized")), "id", "left").withColumn("found", F.concat("found", F.coalesce("sized", none)))
    order = lambda s: [-_rank(RULE_RANK, s["label"]), s["start"] - s["end"], -s["confidence"], s["start"]]
    return out.select("id", "text", resolve_overlaps(F.col("found"), SPAN, order).alias("entities"))


def offline_dictionary(texts: DataFrame, entries: DataFrame, most: int, least: dict[str, int] | None = None, sure: float = 0.9, latin: bool = True) -> DataFrame:
    """texts (id, text) with entities of entries (term, label, weight): from each place the longest accepted term, then
    length, rank of label and start decide. Labels have a least length; Latin terms stand alone (latin); confidence is
    sure * weight, 1 at most. Of a term's labels the first by rank counts."""
    rank = _rank(OFFLINE_RANK, F.col("label"))
    one = entries.groupBy(normalize(F.col("term")).alias("key")).agg(F.max_by(F.struct("term", "label", "weight"), F.struct(rank, "label")).alias("e")).where("key <> ''")
    size = F.length("key")
    short = F.coalesce(F.create_map(*[x for k, v in least.items() for x in (F.lit(k), F.lit(v))])[F.col("e.label")], F.lit(1)) if least else F.lit(1)
    # candidates bounds ASCII words by itself; terms are handed over so that only its equi-join is used where latin is off
    lexicon = one.where(size >= short).select("key", (F.col("e.term") if latin else F.lit("一")).alias("term"), F.upper("e.label").alias("label"), F.lit(0).alias("priority"), _rank(OFFLINE_RANK, F.upper("e.label")).alias("label_rank"), F.col("e.weight").cast("double").alias("weight"))
    met = candidates(texts, lexicon.drop("weight"), most).select("id", "span.*").withColumn("key", normalize(F.col("text")))
    met = met.join(lexicon.select("key", "weight"), "key")
    span = F.struct("start", "end", "label", "text", F.least(F.lit(1.0), F.lit(sure) * F.col("weight")).alias("confidence"), F.lit("dictionary").alias("source")).cast(SPAN)
    longest = met.groupBy("id", "start").agg(F.max_by(span, F.col("end")).alias("span"))
    spans = longest.groupBy("id").agg(F.collect_list("span").alias("found"))
    order = lambda s: [s["start"] - s["end"], -_rank(OFFLINE_RANK, s["label"]), -s["confidence"], s["start"]]
    joined = texts.join(spans, "id", "left")
    return joined.select("id", "text", resolve_overlaps(F.coalesce("found", F.array().cast(f"array<{SPAN}>")), SPAN, order).alias("entities"))


def mode_of(given: str | None) -> str:
    """dictionary, model, shadow or hybrid; rule means dictionary, anything else hybrid."""
    value = (given or "").strip().lower()
    value = "dictionary" if value == "rule" else value
    return value if value in ("dictionary", "model", "shadow", "hybrid") else "hybrid"


def by_mode(mode: str | None, model: Column, lexicon: Column, ready: bool = True) -> Column:
    """Entities that a mode answers with. A null of the model (it failed on that row) gives the dictionary's, as does a
    model that is not ready; shadow runs the model and answers with the dictionary's."""
    mode = mode_of(mode)
    if not ready or mode in ("dictionary", "shadow"):
        return lexicon
    return F.coalesce(model if mode == "model" else merge_hybrid(model, lexicon), lexicon)


def first_verbatim(title: Column, names: Column) -> Column:
    """The first of the names that stands in the title, whatever the case; null if none does."""
    return F.get(F.filter(names, lambda x: (F.trim(x) != "") & F.contains(normalize(title), normalize(x))), F.lit(0))
