"""Fuzzy duplicate lines with DataFrame functions alone: MinHash of character shingles, banding, exact Jaccard
confirmation, components by joins; one line of each component stays.

A shingle is WIDTH characters at every offset. A line is signed within its own row: the hashes of its shingles and the
STARTS, fixed places of the hash range, are sorted into a ring, and the ROWS entries after each start are a window. Lines
share a window when none of the hashes in it is of one line alone, as often as ROWS values of MinHash agree; windows of a
line with few shingles hold starts too, so fewer hashes, which makes good that its windows overlap. A line with many
shingles is signed over those that begin with chosen characters, one with few of those over all its shingles, and one in
between both ways, so that lines that are alike meet one way at least. What windows bring together is confirmed on the
full sets of shingles."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernels as K
from .links import link
from .scratch import MOST_BROADCAST, Scratch, semi_join, small_side

U64 = K.U64
#: Characters of a shingle; a shorter line is its own shingle.
WIDTH = 5
#: Windows of a signature, and their entries: of 12 windows a pair at 0.8 shares none 8 times in a thousand.
STARTS, ROWS = 12, 5
#: Chosen shingles from which they sign a line, and under which all its shingles sign it (too).
FEWEST, ENOUGH = 20, 28
#: Values of signatures().
BINS = 96
#: Least hashes that make a sketch, and the bits in which sketches of lines that are compared differ at most.
LEAST, APART = 28, 18
#: Words of 64 cells that tell where the shingles of a line fall that is compared with a whole bucket; those a shuffle row has.
FINE, WORDS = 64, 16
_EMPTY = np.uint32(0xFFFFFFFF)
_STARTS = [-(2**63) + j * 2**64 // STARTS for j in range(STARTS)]
#: Shingles that begin with chosen characters: about one in seven in Latin texts, all others.
_CHOSEN = r"(?s)(?=([%s\x{80}-\x{10FFFF}].{%d}))" % ("".join(rf"\x{c:02x}" for c in range(128) if c % 6 == 5), WIDTH - 1)
_PLACE = np.random.Generator(np.random.PCG64(31)).integers(0, 2**63, WIDTH, dtype=U64) * U64(2) + U64(1)


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once a row."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _last(line: Column) -> Column:
    """Number of the last shingle, from 0."""
    return F.greatest(F.length(line) - WIDTH, F.lit(0))


def _hash(wide: Column, at: Column) -> Column:
    """Hash of the shingle at a place of a line in UTF-32, where every character has four bytes."""
    return F.xxhash64(F.substring(wide, at * 4 + 1, F.lit(4 * WIDTH)))


def _set(line: Column) -> Column:
    """Distinct hashes of a line's shingles. Spark compiles what stands outside of the lambdas, if not in a generator."""
    return F.array_distinct(let(F.encode(line, "UTF-32"), lambda wide: F.transform(F.sequence(F.lit(0), _last(line)), lambda at: _hash(wide, at))))


def signatures(lines: list[str]) -> np.ndarray:
    """(lines, BINS) of lines that are not empty: least hashes of the parts of the hash range, in numpy. Only tests use it."""
    full = [x if len(x) >= WIDTH else x.ljust(WIDTH, "\0") for x in lines]
    lens = np.array([len(x) for x in full])
    points = np.frombuffer("".join(full).encode("utf-32-le"), np.uint32).astype(U64)
    ends = np.cumsum(lens)
    whole = np.ones(len(points), bool)
    for k in range(1, WIDTH):
        whole[ends - k] = False
    n = len(points) - WIDTH + 1
    h = points[:n] * _PLACE[0]
    for j in range(1, WIDTH):
        h += points[j : n + j] * _PLACE[j]
    whole = whole[:n]
    h = K.mix(h[whole])
    part = ((h >> U64(32)) * U64(BINS) >> U64(32)).astype(np.int64)
    out = np.full(len(lines) * BINS, _EMPTY)
    np.minimum.at(out, np.repeat(np.arange(len(lines)) * BINS, lens)[:n][whole] + part, h.astype(np.uint32))
    out = out.reshape(-1, BINS)
    given = out.copy()
    row, col = np.nonzero(out == _EMPTY)
    turn = 0
    while len(row):
        turn += 1
        other = (K.mix(col.astype(U64) + U64(turn * BINS)) % U64(BINS)).astype(np.int64) if turn < 200 else (col + turn) % BINS
        out[row, col] = given[row, other]
        left = out[row, col] == _EMPTY
        row, col = row[left], col[left]
    return out


def lines_of(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc, no, line) of every line that is not blank, trimmed."""
    doc = F.col(id_col).cast("long")
    src = docs.where(doc.isNotNull()).select(doc.alias("doc"), F.posexplode(F.split(F.col(text_col).cast("string"), "\n")).alias("no", "line"))
    return src.select("doc", "no", F.trim("line").alias("line")).where("line <> ''")


def _keys(lines: DataFrame) -> list[Column]:
    """Two independent hashes that tell lines apart."""
    return [F.xxhash64("line").alias("k1"), F.xxhash64(F.lit(1), "line").alias("k2")]


def _places(docs: DataFrame, id_col: str, text_col: str, scratch: Scratch) -> DataFrame:
    """(doc, no, k1, k2) of every line, written."""
    lines = lines_of(docs, id_col, text_col)
    return scratch.cut(lines.select("doc", "no", *_keys(lines)), "places")


def _kinds(spark: SparkSession, docs: DataFrame, id_col: str, text_col: str, scratch: Scratch, places: DataFrame | None = None) -> DataFrame:
    """(k1, k2, doc, no, again) of distinct lines: the first place, and whether there are others."""
    places = _places(docs, id_col, text_col, scratch) if places is None else places
    once = places.groupBy("k1", "k2").agg(F.min(F.struct("doc", "no")).alias("at"), (F.count("*") > 1).alias("again"))
    kinds = scratch.cut(once.select("k1", "k2", "at.doc", "at.no", "again"), "kinds")
    scratch.release()
    return kinds


def _buckets(lines: DataFrame, *keys: str) -> DataFrame:
    """(keys, bucket, sketch) of lines (keys, line): a row for each window of a line's signature, made in the row of the line.

    The sketch has a bit for each remainder by 64: whether an odd number of the LEAST least hashes leave it. Lines at 0.8
    have about 25 of 28 in common, so that about 6 bits differ; of lines that share a window by chance, about 22."""
    empty = F.array().cast("array<long>")
    found = F.transform(F.regexp_extract_all("line", F.lit(_CHOSEN), F.lit(1)), lambda x: F.xxhash64(x))
    chosen = lines.select(*keys, "line", F.when(F.length("line") >= FEWEST + WIDTH - 1, F.array_distinct(found)).otherwise(empty).alias("chosen"))
    ways = [F.when(F.size("chosen") >= FEWEST, F.sort_array("chosen")), F.when(F.size("chosen") < ENOUGH, F.sort_array(_set(F.col("line"))))]
    owns = chosen.select(*keys, *[own.otherwise(empty).alias(f"own{way}") for way, own in enumerate(ways)])
    sets = owns.select(*keys, F.inline(F.array(*[F.struct(F.lit(way).alias("way"), F.col(f"own{way}").alias("own")) for way in (0, 1)]))).where(F.size("own") > 0)
    starts = F.array(*[F.lit(x).cast("long") for x in _STARTS])
    odd = F.aggregate(F.slice("own", 1, LEAST), F.lit(0).cast("long"), lambda bits, h: bits.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), h.bitwiseAND(F.lit(63).cast("long")).cast("int"))))
    rings = sets.select(*keys, "way", odd.alias("sketch"), F.sort_array(F.concat("own", starts)).alias("ring"))
    # after the greatest the ring goes on from the least
    around = rings.select(*keys, "way", "sketch", F.concat("ring", F.slice("ring", 1, ROWS)).alias("ring"))
    ends = F.array(*[F.struct(F.lit(x).cast("long").alias("start"), F.lit(_STARTS[(j + ROWS) % STARTS]).cast("long").alias("bare")) for j, x in enumerate(_STARTS)])
    # one expression for the window, so that its place in the ring is looked for once
    each = around.select(*keys, "way", "sketch", "ring", F.inline(ends)).select(*keys, "way", "sketch", "start", "bare", F.slice("ring", (F.array_position("ring", F.col("start")) + 1).cast("int"), ROWS).alias("window"))
    # a window that ends with the start ROWS later holds no hash
    return each.where(F.element_at("window", -1) != F.col("bare")).select(*keys, F.xxhash64("start", "way", "window").alias("bucket"), "sketch")


def _near(x: Column, y: Column) -> Column:
    """Whether lines with these sketches are worth comparing."""
    return F.bit_count(x.bitwiseXOR(y)) <= APART


def _cells(texts: DataFrame) -> DataFrame:
    """(node, fewest, most, cells) of texts (node, line): which of 64 * FINE cells the line's shingles fall in, how many of
    them (fewest), and the size of its set. The cells that only one of two lines has are at most the shingles that one of
    them alone has, so pairs that differ in too many cells cannot be alike and need no comparison."""
    each = texts.repartition("node").select("node", _set(F.col("line")).alias("own")).select("node", F.explode("own").alias("h"))
    bit = F.expr("shiftleft(1L, cast(shiftrightunsigned(h, 58) as int))")
    word, zero = F.shiftrightunsigned("h", 48).bitwiseAND(F.lit(FINE - 1).cast("long")), F.lit(0).cast("long")
    # sums of a line, WORDS words a row
    parts = each.select("node", F.shiftright(word, WORDS.bit_length() - 1).alias("part"), word.bitwiseAND(F.lit(WORDS - 1).cast("long")).alias("word"), bit.alias("bit")).groupBy("node", "part")
    sums = parts.agg(F.count("*").alias("most"), *[F.bit_or(F.when(F.col("word") == w, F.col("bit")).otherwise(zero)).alias(f"w{w}") for w in range(WORDS)])
    full = sums.select("node", "part", "most", F.array(*[f"w{w}" for w in range(WORDS)]).alias("cells"))
    none = F.array(*[zero] * WORDS)
    full = full.groupBy("node").agg(F.sum("most").alias("most"), F.concat(*[F.coalesce(F.max(F.when(F.col("part") == p, F.col("cells"))), none) for p in range(FINE // WORDS)]).alias("cells"))
    return full.select("node", F.aggregate("cells", zero, lambda n, x: n + F.bit_count(x)).alias("fewest"), "most", "cells")


def _possible(x: Callable[[str], Column], y: Callable[[str], Column], percent: int) -> Column:
    """Whether sets of these cells, x("cells") and so on, can reach the similarity."""
    near = (x("most") * 100 >= y("fewest") * percent) & (y("most") * 100 >= x("fewest") * percent)
    apart = None
    for w in range(FINE):
        one = F.bit_count(F.get(x("cells"), F.lit(w)).bitwiseXOR(F.get(y("cells"), F.lit(w))))
        apart = one if apart is None else apart + one
        if w + 1 in (WORDS, FINE):  # most pairs are too far apart by the first words
            near = near & (apart * (100 + percent) <= (x("most") + y("most")) * (100 - percent))
    return near


def removed_lines(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 80) -> DataFrame:
    """(doc, gone: sorted line numbers) for every document that loses lines."""
    scratch = Scratch(spark, "lines")
    def texts_of(wanted: DataFrame) -> DataFrame:
        """wanted (node, k2, doc, no) with the line of each; documents without a wanted line are not taken apart."""
        owners = scratch.cut(wanted.select(F.col("doc").alias("_owner")).distinct(), "owners")
        some = semi_join(docs.select(F.col(id_col).cast("long").alias("_owner"), F.col(text_col).alias("_text")), owners, "_owner")
        return lines_of(some, "_owner", "_text").join(small_side(wanted), ["doc", "no"]).where((F.xxhash64("line") == F.col("node")) & (F.xxhash64(F.lit(1), "line") == F.col("k2"))).select("node", "line")

    places = _places(docs, id_col, text_col, scratch)
    kinds = _kinds(spark, docs, id_col, text_col, scratch, places)
    asked: list[DataFrame] = []
    owned: list[DataFrame] = []

    def every(tables: list[DataFrame]) -> DataFrame:
        return reduce(DataFrame.union, tables)

    def texts_for(nodes: DataFrame) -> DataFrame:
        """Texts of the nodes (node, distinct and written) and of those asked for before."""
        new = scratch.cut(nodes.join(every([x.select("node") for x in asked]), "node", "left_anti"), "new") if asked else nodes
        if not asked or new.limit(1).count():
            named = kinds.select(F.col("k1").alias("node"), F.struct("k2", "doc", "no").alias("at")).join(small_side(new), "node", "left_semi")
            # of lines whose first key is the same by chance, one is linked
            wanted = scratch.cut(named.groupBy("node").agg(F.min("at").alias("at")).select("node", "at.*"), "wanted")
            texts = scratch.cut(texts_of(wanted), "texts")
            if texts.count() > wanted.count():  # rows that repeat an id
                texts = scratch.cut(texts.dropDuplicates(["node"]), "texts")
            asked.append(wanted)
            owned.append(texts)
        return every(owned)

    def of(table: DataFrame, ids: DataFrame) -> DataFrame:
        """Rows of a table of nodes whose node is among ids (node, distinct and written)."""
        return table.join(small_side(ids), "node", "left_semi")

    def verify(pairs: DataFrame) -> DataFrame:
        """Those of the pairs whose full sets reach the similarity."""
        alive = scratch.cut(pairs, "alive")
        texts = texts_for(scratch.cut(alive.select(F.col("a").alias("node")).union(alive.select("b")).distinct(), "nodes"))
        first = scratch.cut(alive.select(F.col("a").alias("node")).distinct(), "asked")
        full = texts.toDF("b", "tb").join(small_side(alive), "b").join(of(texts, first).toDF("a", "ta"), "a")
        sets = full.select("a", "b", _set(F.col("ta")).alias("sa"), _set(F.col("tb")).alias("sb"))
        holds = F.size(F.array_intersect("sa", "sb")) * (100 + percent) >= (F.size("sa") + F.size("sb")) * percent
        # written with those that do not hold: a filter would make the sets once more
        found = scratch.cut(sets.select("a", "b", holds.alias("holds")), "confirmed").where("holds").select("a", "b")
        scratch.drop(alive)
        return found

    def dealt(rows: DataFrame, columns: list[str]) -> DataFrame:
        """(key1, key2, key3, xs, ys) of blocks: they are few and dear, so as many partitions as can work, not as their bytes would tell."""
        full = rows.repartition(4 * spark.sparkContext.defaultParallelism, "key1", "key2", "key3")
        of_side = lambda at: F.collect_list(F.when(F.col("side") == at, F.struct(*columns)))
        return full.groupBy("key1", "key2", "key3").agg(of_side(0).alias("xs"), of_side(1).alias("ys"))

    def blocks(rows: DataFrame) -> DataFrame:
        rows = scratch.cut(rows, "blocks")
        # only members whose sketch is near another's are compared by cells
        near = lambda x, y: (x["component"] != y["component"]) & _near(x["size"], y["size"])
        with_near = lambda these, those: F.transform(F.filter(these, lambda x: F.exists(those, lambda y: near(x, y))), lambda x: x["id"])
        full = dealt(rows, ["id", "component", "size"]).select("key1", "key2", "key3", with_near("xs", "ys").alias("nx"), with_near("ys", "xs").alias("ny")).where("size(nx) > 0")
        sides = F.array(F.struct(F.lit(0).alias("side"), F.col("nx").alias("ids")), F.struct(F.lit(1).alias("side"), F.col("ny").alias("ids")))
        some = scratch.cut(full.select("key1", "key2", "key3", F.inline(sides)).select("key1", "key2", "key3", "side", F.explode("ids").alias("id")), "near")
        nodes = scratch.cut(some.select(F.col("id").alias("node")).distinct(), "nodes")
        fine = scratch.cut(_cells(of(texts_for(nodes), nodes)), "fine").withColumnRenamed("node", "id")
        full = dealt(rows.join(some, ["key1", "key2", "key3", "side", "id"], "left_semi").join(fine, "id"), ["id", "component", "size", "fewest", "most", "cells"])
        worth = lambda x, y: near(x, y) & _possible(lambda c: x[c], lambda c: y[c], percent)
        ends = lambda x, y: F.struct(F.least(x["id"], y["id"]).alias("a"), F.greatest(x["id"], y["id"]).alias("b"))
        met = F.flatten(F.transform("xs", lambda x: F.transform(F.filter("ys", lambda y: worth(x, y)), lambda y: ends(x, y))))
        return verify(full.select(F.inline(met)).distinct())

    # a line is known by its first key, so that buckets need no join with the kinds
    buckets = _buckets(lines_of(docs, id_col, text_col).select(F.xxhash64("line").alias("id"), "line"), "id")
    buckets = buckets.withColumnRenamed("sketch", "size")
    label = link(buckets, verify, scratch, percent, blocks, large=0, dealt=True, near=_near)
    linked = label.join(every(asked).select(F.col("node").alias("id"), "k2"), "id").select(F.col("id").alias("k1"), "k2", "component")
    # only kinds that stand twice, or that gave way to another, lose lines
    own = kinds.select("k1", "k2", "again", F.struct("doc", "no").alias("at"))
    own = scratch.cut(own.join(linked, ["k1", "k2"], "left").where("again or component is not null"), "own")
    least = own.where("component is not null").groupBy("component").agg(F.min("at").alias("least"))
    kept = own.join(least, "component", "left").select("k1", "k2", F.coalesce("least", "at").alias("stays"))
    kept = scratch.cut(kept.select("k1", "k2", F.col("stays.doc").alias("sdoc"), F.col("stays.no").alias("sno")), "kept")
    gone = places.join(small_side(kept), ["k1", "k2"]).where("doc <> sdoc or no <> sno").select("doc", "no")
    return scratch.cut(gone.groupBy("doc").agg(F.sort_array(F.collect_set("no")).alias("gone")), "gone")


def dedup_lines(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 80) -> DataFrame:
    """docs with text_col less its repeated lines, and the columns n_lines and n_removed (lines that are not blank).

    Lines are compared trimmed; lines are alike when 100 * intersection >= percent * union of their character
    shingles (WIDTH characters at every offset; a shorter line is one shingle). Of each component of alike lines the
    first stays (least document id, then line number), blank lines stay, and the others keep their order. Null texts
    stay null with 0 lines; empty texts stay empty; a row with a null id takes no part and stays as it is; rows that
    repeat an id count as one document and lose the same places. Ids may be any 64-bit number.
    Columns that docs has already under the names n_lines or n_removed are replaced."""
    gone = removed_lines(spark, docs, id_col, text_col, percent)
    src = docs.drop("n_lines", "n_removed")
    own = src.columns
    doc, lost_lines = (next(n for n in (f"{x}{i}" for i in range(10**6)) if n not in {c.lower() for c in own}) for x in ("_doc", "_gone"))
    side = gone.select(F.col("doc").alias(doc), F.col("gone").alias(lost_lines))
    n, lost = gone.agg(F.count("*"), F.sum(F.size("gone"))).first()
    joined = src.join(F.broadcast(side) if 64 * n + 8 * (lost or 0) <= MOST_BROADCAST else side.hint("shuffle_hash"), F.col(id_col).cast("long") == F.col(doc), "left")
    parts = F.split(F.col(text_col).cast("string"), "\n")
    stay = F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), F.col(lost_lines))
    less = let(parts, lambda all_: F.array_join(F.transform(stay, lambda i: F.get(all_, i)), "\n"))
    n_lines = F.when(F.col(text_col).isNull(), F.lit(0)).otherwise(F.size(F.filter(parts, lambda x: F.trim(x) != "")))
    return joined.select(
        *[F.when(F.col(lost_lines).isNull(), F.col(c)).otherwise(less).alias(c) if c == text_col else F.col(c) for c in own],
        n_lines.cast("long").alias("n_lines"),
        F.coalesce(F.size(lost_lines), F.lit(0)).cast("long").alias("n_removed"),
    )
