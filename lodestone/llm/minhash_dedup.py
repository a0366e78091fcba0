"""Near-duplicate documents: banded MinHash candidates, sequential Bayesian pruning, exact confirmation."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernels as K
from .links import link
from .scratch import Scratch, semi_join

#: 64 bands of 8 rows miss a pair of similarity 0.8 eight times in a million, one of 0.85 not once in ten million.
BANDS, ROWS = 64, 8
#: Hashes compared at a time, and the posterior probability under which a pair is given up.
BATCH, MISS = 64, 1e-6


def prune_table(threshold: float, size: int = BANDS * ROWS, batch: int = BATCH, miss: float = MISS) -> list[tuple[int, int]]:
    """(hashes compared, least number of agreements) for each batch.

    With a uniform prior the similarity after m agreements of n is Beta(m + 1, n - m + 1); a pair goes as soon
    as the posterior chance of reaching the threshold is under `miss`. That chance, a regularised incomplete
    beta function with whole parameters, is a binomial sum: P(Bin(n + 1, threshold) <= m). Signatures keep 8 bits
    of each hash, of which one in 256 agrees by chance."""
    threshold += (1 - threshold) / 256
    out = []
    for n in range(batch, size + 1, batch):
        chance, m = 0.0, -1
        while chance < miss:
            m += 1
            chance += math.exp(math.lgamma(n + 2) - math.lgamma(m + 1) - math.lgamma(n + 2 - m) + m * math.log(threshold) + (n + 1 - m) * math.log(1 - threshold))
        out.append((n, m))
    return out


def _sketch(words: int):
    """Batches of (id, text) to (id, n_shingles, two set fingerprints, signature of 8-bit values, band keys)."""
    hasher = K.MinHash(BANDS * ROWS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = K.text_buffers(batch.column(1))
            for a, b in K.chunks(off):
                part = off[a : b + 1] - off[a]
                h, _, _, wo = K.words(data[off[a] : off[b]], part)
                s, so = K.distinct(*K.shingles(h, wo, words))
                sig = hasher(s, so)
                prints = []
                for salt in (K.U64(0x51ED270B), K.U64(0x2545F4914F6CDD1D)):
                    total = np.concatenate([[K.U64(0)], np.cumsum(K.mix(s + salt))])
                    prints.append(total[so[1:]] - total[so[:-1]])
                full = np.diff(so) > 0
                keys = K.bands(sig, ROWS)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(a, b - a),
                        K.longs(np.diff(so)),
                        K.longs(prints[0]),
                        K.longs(prints[1]),
                        K.binary_rows((sig & np.uint32(0xFF)).astype(np.uint8)),
                        K.list_of(keys[full].reshape(-1), np.concatenate([[0], np.cumsum(np.where(full, BANDS, 0))])),
                    ],
                    ["id", "n_shingles", "p1", "p2", "signature", "bands"],
                )

    return run


def _sets(words: int):
    """Batches of (id, text) to (id, set: sorted 64-bit hashes of all shingles)."""

    def run(batches):
        for batch in batches:
            data, off = K.text_buffers(batch.column(1))
            for a, b in K.chunks(off):
                part = off[a : b + 1] - off[a]
                h, _, _, wo = K.words(data[off[a] : off[b]], part)
                s, so = K.distinct(*K.shingles(h, wo, words))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), K.binary_segments(s, so)], ["id", "shingles"])

    return run


def _prune(threshold: float):
    table = prune_table(threshold)

    def run(batches):
        for batch in batches:
            left = K.matrix_of(batch.column(2), np.uint8, BANDS * ROWS)
            right = K.matrix_of(batch.column(3), np.uint8, BANDS * ROWS)
            alive, agreed, done = np.arange(len(left)), np.zeros(len(left), np.int64), 0
            for n, least in table:
                agreed[alive] += (left[alive, done:n] == right[alive, done:n]).sum(1)
                alive, done = alive[agreed[alive] >= least], n
            kept = pa.array(alive)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(kept), batch.column(1).take(kept)], ["a", "b"])

    return run


def _confirm(percent: int):
    def run(batches):
        for batch in batches:
            (da, oa), (db, ob) = K.text_buffers(batch.column(2)), K.text_buffers(batch.column(3))
            keep = []
            for i in range(batch.num_rows):
                x = np.frombuffer(da[oa[i] : oa[i + 1]].tobytes(), K.U64)
                y = np.frombuffer(db[ob[i] : ob[i + 1]].tobytes(), K.U64)
                if min(len(x), len(y)) * 100 < percent * max(len(x), len(y)):
                    continue
                both = len(np.intersect1d(x, y, assume_unique=True))
                if 100 * both >= percent * (len(x) + len(y) - both):
                    keep.append(i)
            kept = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(kept), batch.column(1).take(kept)], ["a", "b"])

    return run


def _compare(percent: int):
    """Blocks (key1, key2, key3, side, id, component, signature, shingles), sorted by key, to links (a, b) that hold."""
    table = prune_table(percent / 100)

    def links(rows: list[tuple]) -> Iterator[tuple[int, int]]:
        ys = [r for r in rows if r[0] == 1]
        if not ys:
            return
        sigs = np.stack([np.frombuffer(r[3], np.uint8) for r in ys])
        sets = [np.frombuffer(r[4], K.U64) for r in ys]
        size, ids, comps = np.array([len(s) for s in sets]), np.array([r[1] for r in ys]), np.array([r[2] for r in ys])
        for _, i, comp, sig, raw in (r for r in rows if r[0] == 0):
            own, x = np.frombuffer(sig, np.uint8), np.frombuffer(raw, K.U64)
            alive = np.flatnonzero((comps != comp) & (np.minimum(size, len(x)) * 100 >= np.maximum(size, len(x)) * percent))
            agreed, done = np.zeros(len(ys), np.int64), 0
            for n, least in table:
                agreed[alive] += (sigs[alive, done:n] == own[done:n]).sum(1)
                alive, done = alive[agreed[alive] >= least], n
            met = set()
            for j in alive[np.argsort(-agreed[alive], kind="stable")].tolist():
                if comps[j] not in met:  # one link connects the components
                    both = len(np.intersect1d(x, sets[j], assume_unique=True))
                    if 100 * both >= percent * (len(x) + len(sets[j]) - both):
                        met.add(comps[j])
                        yield min(i, int(ids[j])), max(i, int(ids[j]))

    def run(batches):
        key, rows = None, []
        for batch in batches:
            out = []
            for k1, k2, k3, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (k1, k2, k3) != key:
                    out += links(rows)
                    key, rows = (k1, k2, k3), []
                rows.append(row)
            yield pa.RecordBatch.from_arrays([pa.array([p[i] for p in out], pa.int64()) for i in (0, 1)], ["a", "b"])
        out = list(links(rows))
        yield pa.RecordBatch.from_arrays([pa.array([p[i] for p in out], pa.int64()) for i in (0, 1)], ["a", "b"])

    return run


def near_duplicates(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """(id_col, n_shingles, component_id, kept) for every row of docs.

    Words are runs of bytes other than ASCII white space, A-Z lower-cased; a document's set holds its distinct
    shingles of `words` words, or its whole sequence if it has fewer. Documents are linked when
    100 * intersection >= percent * union, which is confirmed on full sets; component_id is the smallest id
    reachable. Null and empty texts have no shingles and are linked with nothing; a row with a null id takes no
    part, has a null component_id and is kept; rows that repeat an id count as one document. Other columns,
    whatever their names, are left alone."""
    scratch = Scratch(spark, "minhash")
    src = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    sketch = scratch.cut(src.mapInArrow(_sketch(words), "id long, n_shingles long, p1 long, p2 long, signature binary, bands array<long>"), "sketch")

    # equal sets are one class, led by the smallest id
    classes = sketch.where("n_shingles > 0 and id is not null").groupBy("p1", "p2", "n_shingles").agg(F.min("id").alias("leader"))
    member = scratch.cut(sketch.select("id", "n_shingles", "p1", "p2").join(classes, ["p1", "p2", "n_shingles"], "left").select("id", "n_shingles", "leader"), "member")
    leads = sketch.join(classes.select("p1", "p2", "n_shingles", F.col("leader").alias("id")), ["p1", "p2", "n_shingles", "id"], "left_semi")
    leads = scratch.cut(leads.select("id", "signature", "bands", F.col("n_shingles").alias("size")).dropDuplicates(["id"]), "leads")
    scratch.drop(sketch)

    signatures = leads.select("id", "signature")

    def sets_of(wanted: DataFrame) -> DataFrame:
        return scratch.cut(semi_join(src, wanted, "id").mapInArrow(_sets(words), "id long, shingles binary").dropDuplicates(["id"]), "sets")

    def verify(pairs: DataFrame) -> DataFrame:
        seen = pairs.join(signatures.toDF("a", "sa"), "a").join(signatures.toDF("b", "sb"), "b").select("a", "b", "sa", "sb")
        alive = scratch.cut(seen.mapInArrow(_prune(percent / 100), "a long, b long"), "alive")
        wanted = scratch.cut(alive.select(F.col("a").alias("id")).union(alive.select("b")).distinct(), "wanted")
        sets = sets_of(wanted)
        full = alive.join(sets.toDF("a", "xa"), "a").join(sets.toDF("b", "xb"), "b").select("a", "b", "xa", "xb")
        found = scratch.cut(full.mapInArrow(_confirm(percent), "a long, b long"), "confirmed")
        scratch.drop(alive, wanted, sets)
        return found

    def blocks(rows: DataFrame) -> DataFrame:
        rows = scratch.cut(rows, "blocks")
        wanted = scratch.cut(rows.select("id").distinct(), "wanted")
        full = rows.join(sets_of(wanted).join(signatures, "id"), "id").select("key1", "key2", "key3", "side", "id", "component", "signature", "shingles")
        full = full.repartition("key1", "key2", "key3").sortWithinPartitions("key1", "key2", "key3")
        return scratch.cut(full.mapInArrow(_compare(percent), "a long, b long"), "confirmed").distinct()

    label = link(leads.select(F.explode("bands").alias("bucket"), "id", "size"), verify, scratch, percent, blocks)
    out = member.join(label.withColumnRenamed("id", "leader"), "leader", "left")
    out = out.select("id", "n_shingles", F.when(F.col("id").isNotNull(), F.coalesce("component", "leader", "id")).alias("component_id"))
    out = out.withColumn("kept", F.col("id").isNull() | (F.col("id") == F.col("component_id")))
    return out.withColumnRenamed("id", id_col)


def keep_one(spark: SparkSession, docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs that lead their group of near copies, with the columns of docs."""
    found = near_duplicates(spark, docs, words=words, percent=percent)
    gone = found.where("not kept").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
