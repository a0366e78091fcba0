"""Co-trained quality classifier: a view of the text and a view of the metadata teach each other over rounds, are
calibrated on held-out labels and scored together over all documents.

The models are fitted on a bounded sample of labelled rows; all unlabelled rows are scored on the cluster each round,
and those that one view is sure of enter the other's fit as sums that Spark makes, so nothing of them is cut."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernels as K
from .scratch import Scratch, semi_join, small_side

U64 = K.U64
#: Bounds of the labelled sample and of the word features of a model.
LABELLED, FEATURES = 12_000, 256
#: Partitions whose sums come to the driver in a step of a fit.
SUMS = 48
ROUNDS = 3
#: Calibrated chance at which a view teaches its label to the other.
CONFIDENT = 0.97
#: Bytes of a word's beginning that count as a feature of their own.
PREFIX = 6
DENSE = ("upper", "marks", "bars", "bangs", "digits", "again", "distinct", "long", "short_lines")
_MARKS = np.zeros(256, bool)
_MARKS[[ord(c) for c in "#$%&*@^~_=+<>{}[]\\"]] = True


def text_features(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Dense shares of each document of a chunk, and the hashes of its words and word beginnings with offsets."""
    h, start, end, wo = K.words(data, off)
    n, size = np.diff(wo), np.maximum(np.diff(off), 1)

    def per(flags: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(flags)])
        return (total[off[1:]] - total[off[:-1]]) / size

    upper, letters = (data >= 65) & (data <= 90), ((data | 32) >= 97) & ((data | 32) <= 122)
    same = np.zeros(len(h) + 1, np.int64)
    same[1:-1] = h[1:] == h[:-1]
    same = np.concatenate([[0], np.cumsum(same[: len(h)])])
    heads = wo[:-1].clip(max=max(len(h) - 1, 0))
    again = (same[wo[1:]] - same[np.minimum(heads + 1, wo[1:])]) / np.maximum(n, 1)
    lens = np.concatenate([[0], np.cumsum(end - start)])
    # hash of the first bytes of each word, marked apart from whole words
    beginnings, width = np.zeros(len(start), U64), end - start
    for j in range(PREFIX if len(start) else 0):
        value = K._BYTE[K._LOWER[data[np.minimum(start + j, len(data) - 1)]]]
        value[width <= j] = 0
        beginnings += value * K._power(PREFIX)[j]
    beginnings = K.mix(beginnings ^ U64(0x5BD1E995))
    ordered = h.copy()
    for d in range(len(n)):
        ordered[wo[d] : wo[d + 1]].sort()
    fresh = np.ones(len(h), bool)
    fresh[1:] = ordered[1:] != ordered[:-1]
    fresh[wo[:-1][n > 0]] = True
    total = np.concatenate([[0], np.cumsum(fresh)])
    distinct = total[wo[1:]] - total[wo[:-1]]
    words = np.maximum(n, 1)
    dense = np.stack(
        [
            per(upper) / np.maximum(per(letters), 1e-9) * (per(letters) > 0), per(_MARKS[data]) * 10, per(data == 124) * 20, per(data == 33) * 10, per((data >= 48) & (data <= 57)) * 10,
            again * 5, 1 - distinct / words, (lens[wo[1:]] - lens[wo[:-1]]) / words / 10, np.minimum(per(data == 10) * 20, 5),
        ], 1,
    )
    return np.minimum(dense, 10).astype(np.float64), np.stack([h, beginnings], 1).reshape(-1), 2 * wo


#: Places for a language, a source and a size; the first of each is for null.
SLOTS = (8, 32, 12)


def metadata_places(lang: list, source: list, n_chars: list) -> np.ndarray:
    """One number for each row's hashed language, hashed source and size by a power of four; null has places of its own."""

    def place(values: list, slots: int) -> np.ndarray:
        known = {v: 0 if v is None else 1 + int(K.mix(np.array([int.from_bytes(v.encode(), "little") % (2**64 - 59)], U64))[0] % U64(slots - 1)) for v in set(values)}
        return np.array([known[v] for v in values], np.int64)

    size = np.array([0 if c is None or c <= 0 else min(SLOTS[2] - 1, 1 + (int(c).bit_length() - 1) // 2) for c in n_chars], np.int64)
    return (place(lang, SLOTS[0]) * SLOTS[1] + place(source, SLOTS[1])) * SLOTS[2] + size


def metadata_features(places: np.ndarray) -> np.ndarray:
    """One-hot rows of metadata_places."""
    out, rows = np.zeros((len(places), sum(SLOTS))), np.arange(len(places))
    out[rows, places // (SLOTS[1] * SLOTS[2])] = 1
    out[rows, SLOTS[0] + places // SLOTS[2] % SLOTS[1]] = 1
    out[rows, SLOTS[0] + SLOTS[1] + places % SLOTS[2]] = 1
    return out


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def newton_sums(x: np.ndarray, y: np.ndarray, weight: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Curvature and gradient of the log loss at w; x has a last column of ones."""
    p = _sigmoid(x @ w)
    return (x * (weight * (p * (1 - p) + 1e-6))[:, None]).T @ x, x.T @ (weight * (y - p))


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 12, weight: np.ndarray | None = None, more: Callable | None = None) -> np.ndarray:
    """Ridge logistic regression by Newton steps; the last weight is the intercept. more(w) gives the sums of rows that
    are elsewhere."""
    x = np.hstack([x, np.ones((len(x), 1))])
    weight = np.ones(len(x)) if weight is None else weight
    penalty = np.full(x.shape[1], ridge)
    penalty[-1] = 1e-3
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        bend, slope = newton_sums(x, y, weight, w)
        if more:
            bend, slope = (a + b for a, b in zip((bend, slope), more(w), strict=True))
        step = np.linalg.solve(bend + np.diag(penalty), slope - penalty * w)
        w += np.clip(step, -4, 4)
        if np.abs(step).max(initial=0) < (1e-2 if more else 1e-6):
            break
    return w


@dataclass
class View:
    """A fitted view: standardised columns, weights and Platt scaling of its score."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    platt: np.ndarray

    def raw(self, x: np.ndarray) -> np.ndarray:
        return (x - self.mean) / self.scale @ self.weights[:-1] + self.weights[-1]

    def logit(self, x: np.ndarray) -> np.ndarray:
        return self.raw(x) * self.platt[0] + self.platt[1]


def fit_view(x: np.ndarray, y: np.ndarray, held_x: np.ndarray, held_y: np.ndarray, taught: tuple | None = None, more: Callable | None = None) -> View:
    """A view of labelled rows, of taught rows (x, y, weight), and of rows whose sums more(mean, scale) gives; calibrated
    on held-out labels."""
    mean, scale = x.mean(0), x.std(0) + 1e-2
    rows, labels, weight = (x, y, np.ones(len(y))) if taught is None else (np.vstack([x, taught[0]]), np.append(y, taught[1]), np.append(np.ones(len(y)), taught[2]))
    view = View(mean, scale, fit_logistic((rows - mean) / scale, labels, weight=weight, more=more and more(mean, scale)), np.array([1.0, 0.0]))
    if 0 < held_y.sum() < len(held_y):
        view.platt = fit_logistic(view.raw(held_x)[:, None], held_y, ridge=0.01)
        if view.platt[0] <= 0:  # the view knows nothing: it tells the base rate
            view.platt = np.array([0.0, np.log((held_y.mean() + 1e-6) / (1 - held_y.mean() + 1e-6))])
    return view


def word_strength(pos, total, n_pos: float, n_neg: float):
    """z of the log odds of a word's document counts in the two classes, as an expression."""
    a, b = pos + 0.1, total - pos + 0.1 * n_neg / max(n_pos, 1.0)
    return (F.log(a / (n_pos - pos + 1)) - F.log(b / (n_neg - (total - pos) + 1))) / F.sqrt(1 / a + 1 / b)


def presence(hashes: np.ndarray, off: np.ndarray, vocabulary: np.ndarray) -> np.ndarray:
    """(documents, words) with 1 where a document holds a word of the vocabulary."""
    out = np.zeros((len(off) - 1, len(vocabulary)))
    if len(vocabulary) and len(hashes):
        flags = np.zeros(1 << 16, bool)
        flags[(vocabulary & U64(0xFFFF)).astype(np.int64)] = True
        hit = np.flatnonzero(flags[(hashes & U64(0xFFFF)).astype(np.int64)])
        at = np.searchsorted(vocabulary, hashes[hit]).clip(max=len(vocabulary) - 1)
        same = vocabulary[at] == hashes[hit]
        out[np.searchsorted(off, hit[same], "right") - 1, at[same]] = 1
    return out


@dataclass
class CoTrained:
    vocabulary: np.ndarray
    text: View
    meta: View
    joint: np.ndarray  # weights of the two calibrated views and intercept
    taught: dict[str, tuple[int, int]]  # rows that each view got as bad and as good from the other, at the end

    def probability(self, text: np.ndarray, meta: np.ndarray) -> np.ndarray:
        t = self.text.logit(text)
        return _sigmoid(np.stack([t, self.meta.logit(meta), np.ones(len(t))], 1) @ self.joint)


class Unlabelled:
    """All rows without a label as a table (dense, bits, meta): what co-training asks of them, answered by Spark."""

    def __init__(self, rows: DataFrame, words: int):
        self.rows, self.words = rows, words

    def sure_by_text(self, view: View) -> list[tuple[int, bool, int]]:
        """(metadata, bad, rows) of the rows that the text view is sure of; as many as there are kinds of metadata at most."""
        words = self.words

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                p = _sigmoid(view.logit(text_columns(batch.column(0), batch.column(1), words)))
                sure = np.flatnonzero(np.maximum(p, 1 - p) >= CONFIDENT)
                yield pa.RecordBatch.from_arrays([pa.array(np.asarray(batch.column(2))[sure]), pa.array(p[sure] > 0.5)], ["meta", "bad"])

        got = self.rows.mapInArrow(run, "meta int, bad boolean").groupBy("meta", "bad").count().collect()
        return sorted((r.meta, r.bad, r["count"]) for r in got)

    def sure_by_meta(self, view: View) -> list[tuple[int, bool, int]]:
        """The same of the metadata view, which needs the counts of its kinds only."""
        kinds = self.rows.groupBy("meta").count().collect()
        p = _sigmoid(view.logit(metadata_features(np.array([r.meta for r in kinds], np.int64)))) if kinds else []
        return sorted((r.meta, bool(q > 0.5), r["count"]) for r, q in zip(kinds, p, strict=True) if max(q, 1 - q) >= CONFIDENT)

    def sums(self, told: dict[int, tuple[float, float]]):
        """more(mean, scale)(w) of fit_view: Newton sums over the texts of rows whose metadata tells (label, weight)."""
        words = self.words

        def of_view(mean: np.ndarray, scale: np.ndarray):
            def at(w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
                def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                    bend, slope = np.zeros((len(w), len(w))), np.zeros(len(w))
                    for batch in batches:
                        meta = np.asarray(batch.column(2))
                        some = np.flatnonzero(np.isin(meta, list(told)))
                        if len(some):
                            x = np.hstack([(text_columns(batch.column(0), batch.column(1), words)[some] - mean) / scale, np.ones((len(some), 1))])
                            y, weight = np.array([told[m] for m in meta[some].tolist()]).T
                            a, b = newton_sums(x, y, weight, w)
                            bend, slope = bend + a, slope + b
                    yield pa.RecordBatch.from_arrays([pa.array([bend.tobytes()], pa.binary()), pa.array([slope.tobytes()], pa.binary())], ["bend", "slope"])

                got = self.rows.coalesce(SUMS).mapInArrow(run, "bend binary, slope binary").collect()
                return sum((np.frombuffer(r.bend).reshape(len(w), -1) for r in got), np.zeros((len(w), len(w)))), sum((np.frombuffer(r.slope) for r in got), np.zeros(len(w)))

            return at

        return of_view


def _weights(told: list[tuple[int, bool, int]], y: np.ndarray) -> dict[bool, float]:
    """Weight of a taught row by class: together those of a class count at most as much as its labelled rows."""
    rows = {bad: sum(n for _, b, n in told if b == bad) for bad in (False, True)}
    return {bad: min(1.0, float((y == bad).sum()) / n) if n else 0.0 for bad, n in rows.items()}


def co_train(vocabulary: np.ndarray, known: tuple[np.ndarray, np.ndarray], y: np.ndarray, unlabelled: Unlabelled | None, rounds: int = ROUNDS) -> CoTrained:
    """Models from (text columns, metadata columns) of labelled rows and from all unlabelled ones.

    Each round both views are fitted and calibrated; each then labels all unlabelled rows, and those of either class
    that it is sure of are given to the other. A fifth of the labelled rows is held out for calibration."""
    y = y.astype(float)
    held = np.arange(len(y)) % 5 == 4
    if len(y) < 50:
        held[:] = False
    train = ~held
    xt, xm = known
    check = held if held.any() else train
    to_meta: list[tuple[int, bool, int]] = []
    to_text: list[tuple[int, bool, int]] = []

    def views() -> tuple[View, View]:
        weight = _weights(to_meta, y[train])
        rows = metadata_features(np.array([m for m, _, _ in to_meta], np.int64))
        taught = (rows, np.array([float(b) for _, b, _ in to_meta]), np.array([n * weight[b] for _, b, n in to_meta])) if to_meta else None
        weight = _weights(to_text, y[train])
        more = unlabelled.sums({m: (float(b), weight[b]) for m, b, _ in to_text}) if unlabelled and to_text else None
        return fit_view(xt[train], y[train], xt[check], y[check], more=more), fit_view(xm[train], y[train], xm[check], y[check], taught)

    text, meta = views()
    for _ in range(rounds if unlabelled else 0):
        before = to_meta, to_text
        to_meta, to_text = unlabelled.sure_by_text(text), unlabelled.sure_by_meta(meta)
        if (to_meta, to_text) == before:
            break
        text, meta = views()
    both = np.stack([text.logit(xt[check]), meta.logit(xm[check])], 1)
    joint = fit_logistic(both, y[check], ridge=0.1) if 0 < y[check].sum() < check.sum() else np.array([1.0, 0.0, 0.0])
    joint[:2] = np.maximum(joint[:2], 0)
    count = lambda told: tuple(sum(n for _, b, n in told if b == bad) for bad in (True, False))
    return CoTrained(vocabulary, text, meta, joint, {"meta": count(to_meta), "text": count(to_text)})


def text_columns(dense: pa.Array, bits: pa.Array, words: int) -> np.ndarray:
    """(rows, columns) of the text view from binary values of a batch."""
    n = len(dense)
    shares = np.frombuffer(b"".join(dense.to_pylist())).reshape(n, len(DENSE))
    packed = np.frombuffer(b"".join(bits.to_pylist()), np.uint8).reshape(n, (words + 7) // 8)
    return np.hstack([shares, np.unpackbits(packed, axis=1)[:, :words].astype(float)])


def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, off = K.text_buffers(batch.column(1))
        for a, b in K.chunks(off):
            hashes, at = K.distinct(*text_features(data[off[a] : off[b]], off[a : b + 1] - off[a])[1:])
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), K.list_of(hashes, at)], ["id", "hashes"])


def _featured(vocabularies: dict[str, np.ndarray]):
    """Rows (id, text, lang, source, n_chars) to (id, dense, a column of word bits for each model, meta)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = K.text_buffers(batch.column(1))
            for a, b in K.chunks(off):
                dense, hashes, at = text_features(data[off[a] : off[b]], off[a : b + 1] - off[a])
                bits = [pa.array([x.tobytes() for x in np.packbits(presence(hashes, at, v).astype(bool), axis=1)], pa.binary()) for v in vocabularies.values()]
                places = metadata_places(*(batch.column(i).slice(a, b - a).to_pylist() for i in (2, 3, 4)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), K.binary_rows(dense), *bits, pa.array(places.astype(np.int32))], ["id", "dense", *vocabularies, "meta"])

    return run


def fit(spark: SparkSession, docs: DataFrame, labels: DataFrame, labelled: int = LABELLED, rounds: int = ROUNDS) -> tuple[dict[str, CoTrained], DataFrame | None]:
    """Models of poor quality and of toxicity, and the features of all rows (id, dense, poor, toxic, meta).

    The labelled sample is drawn by a hash of the id. Words are counted and chosen by Spark: those whose document
    counts part the classes most surely (z over 3.5)."""
    scratch = Scratch(spark, "quality")
    src = _source(docs)
    marks = labels.where("doc_id is not null and quality is not null and toxic is not null").groupBy(F.col("doc_id").cast("long").alias("id")).agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic"))
    marks = scratch.cut(marks, "marks")
    present = marks.join(src.select("id").distinct(), "id", "left_semi")
    drawn = scratch.cut(present.orderBy(F.xxhash64("id", F.lit(3)), "id").limit(labelled), "labelled")
    known = {r.id: (r.quality, r.toxic) for r in drawn.collect()}
    if not known:
        return {}, None
    sample = scratch.cut(semi_join(src, drawn.select("id"), "id").dropDuplicates(["id"]).mapInArrow(_sampled, "id long, hashes array<long>"), "sample")
    flags = drawn.select("id", (F.col("quality") == 0).cast("long").alias("poor"), (F.col("toxic") == 1).cast("long").alias("toxic"))
    counts = sample.select("id", F.explode("hashes").alias("h")).join(F.broadcast(flags), "id").groupBy("h").agg(F.count("*").alias("n"), F.sum("poor").alias("poor"), F.sum("toxic").alias("toxic"))
    counts = scratch.cut(counts.where("n >= 5"), "counts")
    is_bad = {"poor": lambda m: m[0] == 0, "toxic": lambda m: m[1] == 1}
    vocabularies = {}
    for name, bad in is_bad.items():
        n_pos = float(sum(map(bad, known.values())))
        strength = F.abs(word_strength(F.col(name).cast("double"), F.col("n").cast("double"), n_pos, len(known) - n_pos))
        chosen = counts.select("h", strength.alias("z")).where("z > 3.5").orderBy(F.desc("z"), "h").limit(FEATURES).collect()
        vocabularies[name] = np.sort(np.array([r.h for r in chosen], np.int64).view(U64))
    features = scratch.cut(src.mapInArrow(_featured(vocabularies), "id long, dense binary, poor binary, toxic binary, meta int"), "features")
    scratch.drop(sample, counts)
    got = features.join(F.broadcast(drawn.select("id")), "id", "left_semi").dropDuplicates(["id"]).orderBy("id").toArrow().combine_chunks()
    ids, meta = got.column("id").to_pylist(), metadata_features(np.asarray(got.column("meta"), np.int64))
    loose = scratch.cut(features.where("id is not null").join(small_side(marks.select("id")), "id", "left_anti").drop("id"), "unlabelled")
    models = {}
    for name, bad in is_bad.items():
        words = len(vocabularies[name])
        text = text_columns(got.column("dense"), got.column(name), words)
        models[name] = co_train(vocabularies[name], (text, meta), np.array([bad(known[i]) for i in ids]), Unlabelled(loose.select("dense", name, "meta"), words), rounds)
    scratch.drop(drawn, loose, marks)
    return models, features


def _source(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"), F.col("n_chars").cast("long").alias("n_chars"))


def score(spark: SparkSession, docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """(doc_id, p_poor, p_toxic, kept) for every row of docs (doc_id, text, lang, source, n_chars).

    A row is kept when both calibrated chances are under the threshold. Null texts count as empty ones and null
    metadata as a value of its own; rows are scored each, repeated and null ids included; other columns are left
    alone. Without usable labels nothing is rejected: both chances are 0."""
    models, features = fit(spark, docs, labels)
    if features is None:
        return _source(docs).select(F.col("id").alias("doc_id"), F.lit(0.0).alias("p_poor"), F.lit(0.0).alias("p_toxic"), F.lit(True).alias("kept"))
    shared = spark.sparkContext.broadcast(models)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            meta = metadata_features(np.asarray(batch.column(4), np.int64))
            chances = [m.probability(text_columns(batch.column(1), batch.column(k), len(m.vocabulary)), meta) for k, m in zip((2, 3), shared.value.values(), strict=True)]
            kept = (chances[0] < threshold) & (chances[1] < threshold)
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, chances), pa.array(kept)], ["id", "p_poor", "p_toxic", "kept"])

    return features.mapInArrow(run, "id long, p_poor double, p_toxic double, kept boolean").withColumnRenamed("id", "doc_id")


def keep_good(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that the classifier keeps, with the columns of docs; of a repeated doc_id all rows go if one is rejected."""
    gone = score(spark, docs, labels).where("not kept and doc_id is not null").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
