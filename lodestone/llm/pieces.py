"""SentencePiece BPE with seeded merge-dropout: every candidate merge that the agenda yields is skipped when a keyed
hash says so, which gives varied segmentations that all decode to the same text.

A text is a leading space mark and its characters, spaces as marks; characters without a piece, and the mark itself
where a text holds it, become byte pieces. Merges never cross the beginning of a run of marks, so the distinct
segments of a chunk are segmented once without dropout, in arrays: one agenda step for all of them at a time. Each
occurrence has a key of its own, by seed, document and place; it takes the shared segmentation if its key skips none
of the merges that led there, and is segmented by itself otherwise."""

from __future__ import annotations

import heapq
import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernels as K

U64 = K.U64
MARK = 0x2581
BIG = np.int32(2**31 - 1)
#: Longer segments go through the heap, whose time does not grow with the square of the length.
WIDTHS = (2, 4, 6, 8, 10, 12, 16, 24, 40)
#: Symbols that are processed at a time, so that they stay in the processor's cache.
BLOCK = 1 << 17
#: Bytes of text that are encoded at a time.
CHUNK = 1 << 19
_NORMAL, _BYTE = 1, 6


def _fields(raw: bytes) -> Iterator[tuple[int, bytes | int]]:
    """Numbers and values of a protocol buffer message's fields."""
    at = 0

    def varint() -> int:
        nonlocal at
        out = shift = 0
        while True:
            b = raw[at]
            at += 1
            out |= (b & 127) << shift
            shift += 7
            if b < 128:
                return out

    while at < len(raw):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
        else:
            size = {1: 8, 5: 4}.get(kind) or varint()
            yield tag >> 3, raw[at : at + size]
            at += size


class Model:
    """Pieces and merges of a SentencePiece BPE model with byte fallback."""

    def __init__(self, raw: bytes):
        self.pieces: list[tuple[str, float, int]] = []
        for number, value in _fields(raw):
            if number == 1:
                f = dict(_fields(value))
                self.pieces.append((f[1].decode(), struct.unpack("<f", f.get(2, b"\0\0\0\0"))[0], f.get(3, _NORMAL)))
        normal = {p: i for i, (p, _, kind) in enumerate(self.pieces) if kind == _NORMAL}
        self.byte_id = np.zeros(256, np.int32)
        table = []
        for i, (p, _, kind) in enumerate(self.pieces):
            if kind == _BYTE:
                self.byte_id[int(p[3:5], 16)] = i
                table.append(bytes([int(p[3:5], 16)]))
            else:
                table.append(p.replace(chr(MARK), " ").encode() if kind == _NORMAL else b"")
        self.size = len(self.pieces)
        self.lens = np.array([len(x) for x in table], np.int64)
        self.at = np.concatenate([[0], np.cumsum(self.lens)])[:-1]
        self.bytes = np.frombuffer(b"".join(table) + b"\0", np.uint8)
        # rank of a piece: higher score first, then lower id
        by_rank = sorted(normal.values(), key=lambda i: (-self.pieces[i][1], i))
        self.piece_of_rank = np.array(by_rank, np.int32)
        rank_of = {i: r for r, i in enumerate(by_rank)}
        self.merges: dict[tuple[int, int], int] = {}
        merging: set[int] = set()
        crossing = False
        for p, i in normal.items():
            for k in range(1, len(p)):
                left, right = normal.get(p[:k]), normal.get(p[k:])
                if left is not None and right is not None:
                    self.merges[left, right] = rank_of[i]
                    merging.update(map(ord, p))
                    crossing |= chr(MARK) in p.lstrip(chr(MARK))
        if crossing:
            raise ValueError("pieces with a space mark after other characters are not supported")
        # symbol of a character: its piece, or size + code point
        self.char_symbol = np.arange(0x110000, dtype=np.int32) + self.size
        for p, i in normal.items():
            if len(p) == 1:
                self.char_symbol[ord(p)] = i
        self.char_symbol[MARK] = self.size + MARK  # the mark as a character of a text
        self.char_symbol[0x20] = normal[chr(MARK)]
        self.lone = np.ones(0x110000, bool)  # characters that never merge
        self.lone[[c for c in merging if c != MARK]] = False
        self.lone[0x20] = False
        # open hash table of the merges
        self.mask = (1 << 20) - 1
        slots = np.full((self.mask + 1, 2), -1, np.int64)
        self.probes = 1
        for (a, b), r in self.merges.items():
            key = a << 32 | b
            at, n = int(self._slot(np.array([key]))[0]), 1
            while slots[at, 0] >= 0:
                at, n = (at + 1) & self.mask, n + 1
            slots[at] = key, r
            self.probes = max(self.probes, n)
        self.keys, self.ranks = slots[:, 0].copy(), slots[:, 1].astype(np.int32)

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return (K.mix(key.astype(U64)) & U64(self.mask)).astype(np.int64)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of the piece that two symbols make, BIG where they make none; negative symbols are absent."""
        out = np.full(left.shape, BIG)
        ok = np.flatnonzero((left >= 0) & (right >= 0) & (left < self.size) & (right < self.size))
        if len(ok):
            key = left.reshape(-1)[ok].astype(np.int64) << 32 | right.reshape(-1)[ok]
            at = self._slot(key)
            flat = out.reshape(-1)
            for _ in range(self.probes):
                there = self.keys[at]
                hit = there == key
                flat[ok[hit]] = self.ranks[at[hit]]
                more = ~hit & (there >= 0)
                if not more.any():
                    break
                ok, key, at = ok[more], key[more], (at[more] + 1) & self.mask
        return out

    # segmentation -----------------------------------------------------------------------------------------------

    def heap(self, symbols: list[int], key: int, dropout: float) -> list[int]:
        """Agenda processing of one segment with a heap."""
        n, limit = len(symbols), int(dropout * 2**64)
        sym, nxt, prev = list(symbols), list(range(1, n + 1)), list(range(-1, n - 1))
        agenda: list[tuple[int, int, int, int]] = []

        def offer(i: int, j: int) -> None:
            r = self.merges.get((sym[i], sym[j]))
            if r is not None:
                heapq.heappush(agenda, (r, i, sym[i], sym[j]))

        for i in range(n - 1):
            offer(i, i + 1)
        while agenda:
            r, i, a, b = heapq.heappop(agenda)
            j = nxt[i] if sym[i] >= 0 else n
            if j >= n or sym[i] != a or sym[j] != b:
                continue
            if limit and int(_draw(np.array([key], U64), np.array([i]), np.array([a]), np.array([b]))[0]) < limit:
                continue
            sym[i], sym[j] = int(self.piece_of_rank[r]), -1
            nxt[i] = nxt[j]
            if nxt[j] < n:
                prev[nxt[j]] = i
                offer(i, nxt[j])
            if prev[i] >= 0:
                offer(prev[i], i)
        return [s for s in sym if s >= 0]

    def rows(self, sym: np.ndarray, key: np.ndarray, dropout: float, merges: list | None = None) -> np.ndarray:
        """Agenda processing of many segments, one a column, padded with -1; a step pops one candidate of each.
        merges gets (column, place, left, right) of every merge that is made."""
        w, n = sym.shape
        out = np.empty_like(sym)
        who, beg = np.arange(n), np.repeat(np.arange(w, dtype=np.int32)[:, None], n, 1)
        rank = np.full((w, n), BIG)
        rank[:-1] = self.rank(sym[:-1], sym[1:])
        limit = U64(min(int(dropout * 2**64), 2**64 - 1))
        while len(who):
            j = rank.argmin(0)
            c = np.arange(len(who))
            best = rank[j, c]
            live = best < BIG
            if np.count_nonzero(live) <= 0.8 * len(who):
                out[:, who[~live]] = sym[:, ~live]
                who, key, j, best = who[live], key[live], j[live], best[live]
                sym, beg, rank = sym[:, live], beg[:, live], rank[:, live]
                if not len(who):
                    break
                c = np.arange(len(who))
                live = np.ones(len(who), bool)
            up = np.minimum(j + 1, w - 1)
            a, b = sym[j, c], sym[up, c]
            merge = live
            if dropout:
                skip = live & (_draw(key, beg[j, c], a, b) < limit)
                rank[j[skip], c[skip]] = BIG
                merge = live & ~skip
            if merges is not None:
                merges.append((who[merge], beg[j, c][merge], a[merge], b[merge]))
            # the merged pair's right symbol goes, and what is beyond moves down one place
            edge = np.where(merge, j, w)
            for x in range(int(edge.min()) + 1, w - 1):
                down = edge < x
                for array in (sym, beg, rank):
                    np.copyto(array[x], array[x + 1], where=down)
            moved = np.flatnonzero(edge < w - 1)
            sym[w - 1, moved], rank[w - 2 :, moved] = -1, BIG
            m, jm = c[merge], j[merge]
            made = self.piece_of_rank[best[merge]]
            sym[jm, m] = made
            rank[jm, m] = self.rank(made, np.where(jm + 1 < w, sym[np.minimum(jm + 1, w - 1), m], -1))
            before = jm > 0
            m, jm = m[before], jm[before]
            rank[jm - 1, m] = self.rank(sym[jm - 1, m], made[before])
        return out

    def encode(self, texts: list[str], salt: np.ndarray, dropout: float) -> tuple[np.ndarray, np.ndarray]:
        """Piece ids of all texts and their offsets; salt is the 64-bit key of each text."""
        joined = " " + " ".join(texts) if texts else ""
        cp = np.frombuffer(joined.encode("utf-32-le"), np.uint32).astype(np.int64)
        n = len(cp)
        doc_at = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])]).astype(np.int64)
        if n == 0:
            return np.zeros(0, np.int32), np.zeros(len(texts) + 1, np.int64)
        sym = self.char_symbol[cp]
        # a segment begins at a document, at a run of marks, at a character that never merges, and after one
        space, lone = cp == 0x20, self.lone[cp]
        first = lone.copy()
        first[1:] |= lone[:-1] | (space[1:] & ~space[:-1])
        first[doc_at[:-1]] = True
        start = np.flatnonzero(first)
        lens = np.diff(np.append(start, n))
        place = np.arange(n) - np.repeat(start, lens)
        h = K.mix(np.add.reduceat(K.mix(sym.astype(U64)) * K._power(int(lens.max()) + 1)[place], start) + lens.astype(U64))
        _, where, back = np.unique(h, return_index=True, return_inverse=True)
        flat, size, merges = self._segments(sym, start[where], lens[where], np.zeros(len(where), U64), 0.0, bool(dropout))
        if dropout:
            doc_of = np.searchsorted(doc_at, start, "right") - 1
            key = K.mix(salt[doc_of] ^ K.mix((start - doc_at[doc_of]).astype(U64) + U64(1)))
            own = np.flatnonzero(self._skips(merges, back, key, dropout) | (lens > WIDTHS[-1]))
            more, sizes, _ = self._segments(sym, start[own], lens[own], key[own], dropout, False)
            back[own] = len(size) + np.arange(len(own))
            flat, size = np.concatenate([flat, more]), np.concatenate([size, sizes])
        from_ = np.concatenate([[0], np.cumsum(size)])[:-1]
        count = size[back]
        ends = np.cumsum(count)
        ids = flat[np.repeat(from_[back] - (ends - count), count) + np.arange(ends[-1])]
        off = np.concatenate([[0], ends])[np.append(np.searchsorted(start, doc_at[:-1]), len(start))]
        return ids.astype(np.int32), off.astype(np.int64)

    def _segments(self, sym: np.ndarray, start: np.ndarray, lens: np.ndarray, key: np.ndarray, dropout: float, trace: bool) -> tuple[np.ndarray, np.ndarray, list]:
        """Pieces of the segments one after the other, how many each has, and with trace the merges of the short ones."""
        parts, owner, merges = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)], []
        low = 0
        for w in WIDTHS:
            pick = np.flatnonzero((lens > low) & (lens <= w))
            low = w
            for some in np.array_split(pick, len(pick) * w // BLOCK + 1) if len(pick) else ():
                at = np.arange(w)[:, None] + start[some]
                block = np.where(np.arange(w)[:, None] < lens[some], sym[np.minimum(at, len(sym) - 1)], -1).astype(np.int32)
                made: list | None = [] if trace else None
                done = np.ascontiguousarray(self.rows(block, key[some], dropout, made).T)
                merges += [(some[who], place, a, b) for who, place, a, b in made or ()]
                keep = done >= 0
                parts.append(done[keep])
                owner.append(np.repeat(some, keep.sum(1)))
        for i in np.flatnonzero(lens > WIDTHS[-1]) if dropout or not trace else ():
            got = self.heap(sym[start[i] : start[i] + lens[i]].tolist(), int(key[i]), dropout)
            parts.append(np.array(got, np.int32))
            owner.append(np.full(len(got), i))
        flat, own = np.concatenate(parts), np.concatenate(owner)
        order = np.argsort(own, kind="stable")
        flat, own = self._with_bytes(flat[order], own[order])
        return flat, np.bincount(own, minlength=len(start)), merges

    def _skips(self, merges: list, back: np.ndarray, key: np.ndarray, dropout: float) -> np.ndarray:
        """Whether the key of each occurrence skips a merge of its segment."""
        out = np.zeros(len(back), bool)
        if not merges:
            return out
        who, place, a, b = (np.concatenate(x) for x in zip(*merges, strict=True))
        order = np.argsort(who, kind="stable")
        who, place, a, b = who[order], place[order], a[order], b[order]
        n = np.bincount(who, minlength=int(back.max()) + 1)
        first = np.cumsum(n) - n
        limit = U64(min(int(dropout * 2**64), 2**64 - 1))
        times = n[back]
        ends = np.cumsum(times)
        for lo in range(0, len(back), 1 << 16):
            hi = min(lo + (1 << 16), len(back))
            t = times[lo:hi]
            base = ends[lo] - times[lo]
            at = np.repeat(first[back[lo:hi]] - (ends[lo:hi] - t - base), t) + np.arange(t.sum())
            skipped = _draw(np.repeat(key[lo:hi], t), place[at], a[at], b[at]) < limit
            out[np.repeat(np.arange(lo, hi), t)[skipped]] = True
        return out

    def _with_bytes(self, flat: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbols that are no pieces as byte pieces of their UTF-8 form."""
        odd = np.flatnonzero(flat >= self.size)
        if not len(odd):
            return flat, own
        raw = {c: chr(c - self.size).encode() for c in np.unique(flat[odd]).tolist()}
        times = np.ones(len(flat), np.int64)
        times[odd] = [len(raw[c]) for c in flat[odd].tolist()]
        out, at = np.repeat(flat, times), np.cumsum(times) - times
        for i in odd:
            b = raw[int(flat[i])]
            out[at[i] : at[i] + len(b)] = self.byte_id[np.frombuffer(b, np.uint8)]
        return out, np.repeat(own, times)

    def decode(self, ids: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """UTF-8 bytes of all token lists and their offsets, the leading mark of each taken off."""
        lens = self.lens[ids]
        ends = np.cumsum(lens)
        total = int(ends[-1]) if len(ends) else 0
        data = self.bytes[np.repeat(self.at[ids] - (ends - lens), lens) + np.arange(total)]
        doc = np.concatenate([[0], ends])[off]
        some = doc[:-1][np.diff(doc) > 0]
        keep = np.ones(total, bool)
        keep[some[data[some] == 0x20]] = False
        gone = np.concatenate([[0], np.cumsum(~keep)])
        return data[keep], doc - gone[doc]


def _draw(key: np.ndarray, place: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Keyed hash of a candidate merge: the occurrence of its segment, where it stands and the two symbols."""
    pair = left.astype(U64) << U64(32) | right.astype(U64)
    return K.mix(key ^ K.mix(pair + K.mix(place.astype(U64) + U64(1))))


def salts(ids: np.ndarray, seed: int) -> np.ndarray:
    """Key of each document, by seed and id."""
    return K.mix(ids.astype(np.int64).view(U64) ^ K.mix(np.array([seed & (2**64 - 1)], U64)))


@lru_cache(maxsize=2)
def _model(raw: bytes) -> Model:
    return Model(raw)


def encode_documents(spark: SparkSession, docs: DataFrame, model_path: str, dropout: float = 0.1, seed: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_tokens, token_ids, lossless) for every row of docs.

    dropout is the chance that a candidate merge is skipped, by a hash keyed with seed, id and place in the text, so
    equal words are cut differently from place to place; 0 gives the model's own segmentation. Every row is
    decoded again and compared with its text byte by byte; lossless tells the outcome. Null texts are as empty
    ones: no tokens, lossless. Rows with a null id are encoded under id 0; repeated rows are encoded alike;
    other columns are left alone. The model file (under 1 MB) is read at the driver and sent with the job."""
    with open(model_path, "rb") as f:
        raw = f.read()
    shared = spark.sparkContext.broadcast(raw)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _model(shared.value)
        for batch in batches:
            data, off = K.text_buffers(batch.column(1))
            number = np.array(batch.column(0).fill_null(0).to_numpy(zero_copy_only=False), np.int64)
            for a, b in K.chunks(off, CHUNK):
                part, at = data[off[a] : off[b]], off[a : b + 1] - off[a]
                full = np.flatnonzero(np.diff(at))
                texts = [x or "" for x in batch.column(1).slice(a, b - a).to_pylist()]
                ids, to = model.encode([texts[i] for i in full], salts(number[a:b][full], seed), dropout)
                size = np.zeros(b - a, np.int64)
                size[full] = np.diff(to)
                where = np.concatenate([[0], np.cumsum(size)])
                again, back = model.decode(ids, where)
                same = np.diff(back) == np.diff(at)
                if same.all() and np.array_equal(again, part):
                    ok = same
                else:
                    ok = np.array([np.array_equal(again[back[i] : back[i + 1]], part[at[i] : at[i + 1]]) for i in range(b - a)])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), pa.array(size), pa.ListArray.from_arrays(pa.array(where.astype(np.int32)), pa.array(ids)), pa.array(ok)],
                    ["id", "n_tokens", "token_ids", "lossless"],
                )

    src = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return src.mapInArrow(run, "id long, n_tokens long, token_ids array<int>, lossless boolean").withColumnRenamed("id", id_col)


def decode_documents(spark: SparkSession, tokens: DataFrame, model_path: str, id_col: str = "doc_id") -> DataFrame:
    """(id_col, text) of token lists; null and empty lists give an empty text."""
    with open(model_path, "rb") as f:
        shared = spark.sparkContext.broadcast(f.read())

    def run(batches):
        model = _model(shared.value)
        for batch in batches:
            col = batch.column(1)
            lists = [np.array(x or [], np.int32) for x in col.to_pylist()]
            off = np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int64)
            data, at = model.decode(np.concatenate(lists) if lists else np.zeros(0, np.int32), off)
            raw = data.tobytes()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([raw[a:b].decode() for a, b in zip(at[:-1], at[1:], strict=True)], pa.string())], ["id", "text"])

    return tokens.select(F.col(id_col).cast("long").alias("id"), "token_ids").mapInArrow(run, "id long, text string").withColumnRenamed("id", id_col)
