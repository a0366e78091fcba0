"""Benchmark passages in documents: CGK embedding of item-sized windows, repeated bit-sampling LSH, exact edit check.

A CGK walk reads a string step by step; at step j it writes the symbol under it and moves on only if bit j of the
symbol's random word says so. Two strings walked with the same bits differ in few places when few edits part them.
Sampling some steps of the walk gives a hash that such strings share; several walks bring the recall to the target.
Symbols are words. Windows of W words stand side by side in a document, and each item is entered with all its shifts,
so every window that lies within a copy may meet its item. Nothing is shuffled: the items, in indexes of a bounded
size that lie in the shared folder, are read by the tasks that search documents."""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernels as K
from .scratch import Scratch

U64 = K.U64
SAMPLES = 4
MOST_REPEATS = 64
#: Words of all items of one index; more items take more indexes, each searched in a pass of its own.
MOST_WORDS = 500_000
_PAD = U64(0xA5A5A5A5DEADBEEF)


def window_words(n: int) -> int:
    """Largest power of two W, up to 64, for which a grid of step W has a window of W words inside any n words."""
    w = 1
    while 4 * w - 1 <= n and w < 64:
        w *= 2
    return w


@dataclass
class _Class:
    """Items of one window size."""

    size: int
    step: int
    samples: list[list[int]]  # by repeat, the steps of the walk that are sampled
    keys: list[np.ndarray]  # by repeat, sorted keys
    items: list[np.ndarray]  # the item and the shift of each key
    shifts: list[np.ndarray]
    _flags: dict[int, np.ndarray] = field(default_factory=dict)

    def flags(self, r: int) -> np.ndarray:
        """By repeat, a bitmap over the keys' low bits; made where it is used."""
        if r not in self._flags:
            self._flags[r] = np.zeros(1 << 20, bool)
            self._flags[r][(self.keys[r] & U64((1 << 20) - 1)).astype(np.int64)] = True
        return self._flags[r]


def _walk(h: np.ndarray, bits: np.ndarray, starts: np.ndarray, size: int, samples: list[int]) -> np.ndarray:
    """Sampled hash of the walk over the `size` words at each start; h and bits reach 2 * size beyond the last."""
    at, key = starts.copy(), np.zeros(len(starts), U64)
    word = np.empty(len(starts), U64)
    for j in range(samples[-1] + 1):
        if j and j % 48 == 0:  # a word steers 48 steps
            bits = K.mix(bits + U64(j))
        if j in samples:
            key = K.mix(key ^ np.where(at - starts < size, h[at], _PAD)) + U64(j)
        np.take(bits, at, out=word, mode="clip")
        np.right_shift(word, U64(63 - j % 48), out=word)
        np.bitwise_and(word, U64(1), out=word)
        at += word.view(np.int64)
    return key


def _padded(h: np.ndarray, size: int) -> np.ndarray:
    return np.concatenate([h, np.full(2 * size + 2, _PAD)])


def _bits(h: np.ndarray, r: int) -> np.ndarray:
    """A random word for each symbol in repeat r; its upper bits steer the walk."""
    return h * (K.mix(np.array([1000 + r], U64))[0] | U64(1))


class Index:
    """Items (sequences of word hashes) entered under the sampled walks of all their shifts."""

    def __init__(self, items: list[np.ndarray], repeats: int | dict[int, int], similarity: float):
        """repeats of all windows, or by window size."""
        self.items = items
        self.allowed = [int(len(x) * (1 - similarity) + 1e-9) for x in items]
        by_size: dict[int, list[int]] = {}
        for i, x in enumerate(items):
            if len(x):
                by_size.setdefault(window_words(len(x)), []).append(i)
        self.classes = []
        for size, members in sorted(by_size.items()):
            rng = np.random.Generator(np.random.PCG64([99, size]))
            step, steps = size, max(1, 3 * size // 2)
            c = _Class(size, step, [], [], [], [])
            n = min(SAMPLES, steps)
            edges = np.linspace(0, steps, n + 1).astype(int)
            for r in range(repeats if isinstance(repeats, int) else repeats[size]):
                c.samples.append([int(rng.integers(a, b)) for a, b in zip(edges[:-1], edges[1:], strict=True)])
                keys, who, shift = [], [], []
                for i in members:
                    h = _padded(items[i], size)
                    starts = np.arange(len(items[i]) - size + 1, dtype=np.int64)
                    keys.append(_walk(h, _bits(h, r), starts, size, c.samples[r]))
                    who.append(np.full(len(starts), i))
                    shift.append(starts)
                k = np.concatenate(keys)
                order = np.argsort(k, kind="stable")
                c.keys.append(k[order])
                c.items.append(np.concatenate(who)[order].astype(np.int32))
                c.shifts.append(np.concatenate(shift)[order].astype(np.int32))
            self.classes.append(c)
        self.repeats = max((len(c.keys) for c in self.classes), default=0)
        self.masks: dict[int, tuple[dict[int, int], dict[int, int]]] = {}

    def candidates(self, h: np.ndarray, off: np.ndarray, only: int | None = None) -> np.ndarray:
        """Distinct rows (document, item, first word that the item would have) of a chunk, of one repeat or of all."""
        found, counts = [], np.diff(off)
        grids = []
        for c in self.classes:
            n = np.where(counts >= c.size, (counts - c.size) // c.step + 1, 0)
            doc = np.repeat(np.arange(len(counts)), n)
            starts = off[doc] + c.step * (np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n))
            grids.append((doc, starts))
        wide = _padded(h, max((c.size for c in self.classes), default=1))
        for r in range(self.repeats) if only is None else (only,):
            bits = _bits(wide, r)
            for c, (doc, starts) in zip(self.classes, grids, strict=True):
                if not len(starts) or r >= len(c.keys):
                    continue
                key = _walk(wide, bits, starts, c.size, c.samples[r])
                hit = np.flatnonzero(c.flags(r)[(key & U64((1 << 20) - 1)).astype(np.int64)])
                lo = np.searchsorted(c.keys[r], key[hit], "left")
                n = np.searchsorted(c.keys[r], key[hit], "right") - lo
                hit, lo, n = hit[n > 0], lo[n > 0], n[n > 0]
                if len(hit):
                    slot = np.repeat(lo, n) + (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n))
                    at = np.repeat(hit, n)
                    found.append(np.stack([doc[at], c.items[r][slot], starts[at] - c.shifts[r][slot] - off[doc[at]]], 1))
        return np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 3), np.int64)

    def _mask(self, i: int) -> tuple[dict[int, int], dict[int, int]]:
        if i not in self.masks:
            ahead: dict[int, int] = {}
            back: dict[int, int] = {}
            x = self.items[i].tolist()
            for j, w in enumerate(x):
                ahead[w] = ahead.get(w, 0) | 1 << j
                back[w] = back.get(w, 0) | 1 << (len(x) - 1 - j)
            self.masks[i] = ahead, back
        return self.masks[i]

    def search(self, h: np.ndarray, off: np.ndarray) -> list[tuple[int, int, int, int, int]]:
        """(document, item, first word, end word, distance) of the best place of each item found in each document."""
        best: dict[tuple[int, int], tuple[int, int, int]] = {}
        last: tuple[int, int, int] | None = None
        for d, i, at in self.candidates(h, off).tolist():
            k, n = self.allowed[i], len(self.items[i])
            # a candidate a few words on lies within what the last one has searched
            if last and last[:2] == (d, i) and at - last[2] <= k:
                continue
            last = (d, i, at)
            lo, hi = max(0, at - 2 * k - 1), min(int(off[d + 1] - off[d]), at + n + 2 * k + 1)
            words = h[off[d] + lo : off[d] + hi].tolist()
            ahead, back = self._mask(i)
            if sum(w in ahead for w in words) < n - k:  # an edit accounts for one word of the item at most
                continue
            cost, end = nearest(ahead, n, words)
            if cost > k:
                continue
            _, length = nearest(back, n, words[:end][::-1], anchored=True)
            got = (cost, lo + end - length, lo + end)
            if (d, i) not in best or got < best[d, i]:
                best[d, i] = got
        return [(d, i, a, b, cost) for (d, i), (cost, a, b) in best.items()]


def nearest(mask: dict[int, int], n: int, words: list[int], anchored: bool = False) -> tuple[int, int]:
    """Least edit distance between a pattern of n words and a stretch of words, and where that stretch ends first.

    Bit-parallel columns of the edit matrix (Myers 1999, Hyyro 2003); anchored: the stretch begins at the first word."""
    full, top = (1 << n) - 1, 1 << (n - 1)
    pv, mv, cost = full, 0, n
    best, end = n, 0
    for j, w in enumerate(words, 1):
        eq = mask.get(w, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | ~(xh | pv) & full
        mh = pv & xh
        if ph & top:
            cost += 1
        elif mh & top:
            cost -= 1
        ph = (ph << 1 | anchored) & full
        mh = mh << 1 & full
        pv = mh | ~(xv | ph) & full
        mv = ph & xv
        if cost < best:
            best, end = cost, j
    return best, end


def calibrate(items: list[np.ndarray], similarity: float, recall: float, trials: int = 400) -> dict[int, int]:
    """Repeats by window size that find `recall` of copies with the most edits allowed, by trial on items spread over
    all of that size; more repeats find more of copies with fewer edits. An error tells if MOST_REPEATS are too few."""
    by_size: dict[int, list[np.ndarray]] = {}
    for x in items:
        if len(x):
            by_size.setdefault(window_words(len(x)), []).append(x)
    out = {}
    for size, members in by_size.items():
        rng = np.random.Generator(np.random.PCG64([5, size]))
        some = [members[int(i)] for i in np.linspace(0, len(members) - 1, min(len(members), trials))]
        docs, owners = [], []
        for t in range(trials):
            i = t % len(some)
            x = some[i].tolist()
            for _ in range(int(len(x) * (1 - similarity) + 1e-9)):
                at, kind = int(rng.integers(0, len(x))), int(rng.integers(0, 3))
                x[at : at + (kind != 0)] = [] if kind == 2 and len(x) > 1 else [int(rng.integers(0, 2**63))]
            before = rng.integers(0, 2**63, int(rng.integers(0, 64))).tolist()
            docs.append(np.array(before + x + rng.integers(0, 2**63, 70).tolist(), U64))
            owners.append(i)
        h, off = np.concatenate(docs), np.concatenate([[0], np.cumsum([len(x) for x in docs])]).astype(np.int64)
        index, met = Index(some, MOST_REPEATS, similarity), np.zeros(trials, bool)
        for r in range(MOST_REPEATS):
            got = {(d, i) for d, i, _ in index.candidates(h, off, r).tolist()}
            met |= np.array([(d, i) in got for d, i in enumerate(owners)])
            if met.mean() >= recall:
                out[size] = r + 1
                break
        else:
            raise ValueError(f"{MOST_REPEATS} repeats find {met.mean():.3f} of the copies of items with windows of {size} words; {recall} are asked for")
    return out


def leaks(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = 0.8, recall: float = 0.95) -> DataFrame:
    """(id_col, item_id, first_word, end_word, distance, item_words) of each benchmark item found in each row of docs.

    An item is found when a stretch of the document is within (1 - similarity) * its words by word edits; the best
    stretch is given (least distance, then first). recall is that of copies with the most edits allowed. Words part at
    ASCII white space, A-Z lower-cased. Null and empty texts hold nothing and null, empty or blank items are never
    found; rows that repeat an id, or items that repeat a text, are answered each; an empty benchmark gives no rows.
    Other columns are left alone. Items beyond MOST_WORDS words are searched in further passes, each of bounded size;
    indexes are files in the shared folder, of which driver and tasks hold one at a time."""
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    src = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    schema = f"{id_col} long, item_id long, first_word long, end_word long, distance long, item_words long"
    scratch = Scratch(spark, "items")
    parts, ids, items, carried = [], [], [], 0

    def close() -> None:
        nonlocal ids, items, carried
        if items:
            path = f"{scratch.path('index')}.pickle"
            _store(path, pickle.dumps((ids, Index(items, calibrate(items, similarity, recall), similarity)), protocol=5))
            parts.append(src.mapInArrow(_scan(path), schema))
        ids, items, carried = [], [], 0

    for row in rows.toLocalIterator():
        data = np.frombuffer(row.text.encode(), np.uint8)
        h = K.words(data, np.array([0, len(data)]))[0]
        if len(h):
            ids.append(row.item_id)
            items.append(h)
            carried += len(h)
        if carried >= MOST_WORDS:
            close()
    close()
    if not parts:
        return spark.createDataFrame([], schema)
    out = parts[0]
    for part in parts[1:]:
        out = out.union(part)
    return out


def _store(path: str, raw: bytes) -> None:
    store, at = fs.FileSystem.from_uri(path)
    store.create_dir(at.rsplit("/", 1)[0], recursive=True)
    with store.open_output_stream(at) as out:
        out.write(raw)


@lru_cache(maxsize=1)
def _load(path: str) -> tuple[list, Index]:
    store, at = fs.FileSystem.from_uri(path)
    with store.open_input_stream(at) as src:
        return pickle.loads(src.read())


def _scan(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, index = _load(path)
        for batch in batches:
            data, off = K.text_buffers(batch.column(1))
            names = batch.column(0).to_pylist()
            rows = []
            for a, b in K.chunks(off, 1 << 20):
                h, _, _, wo = K.words(data[off[a] : off[b]], off[a : b + 1] - off[a])
                rows += [(names[a + d], ids[i], s, e, cost, len(index.items[i])) for d, i, s, e, cost in index.search(h, wo)]
            columns = list(zip(*rows, strict=True)) or [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["id", "item_id", "first_word", "end_word", "distance", "item_words"])

    return run


def clean(spark: SparkSession, docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs that hold no benchmark item, with the columns of docs; rows with a null doc_id stay."""
    found = leaks(spark, docs, benchmark).where("doc_id is not null").select("doc_id").distinct()
    return docs.join(found, "doc_id", "left_anti").select(*docs.columns)
