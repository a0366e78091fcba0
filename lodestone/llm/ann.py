"""Approximate nearest neighbours by inner product: a neighbour graph by NN-descent, queries by greedy graph search.

Equal vectors are one node. For the graph every vector gets one more coordinate that brings it to the largest length,
so that inner products order as distances do. Graph and search work on 8-bit codes; the scores given are exact. Both
descent and search are joins whose rows are bounded: K links a node out, a hashed K of those in, a beam a query."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import kernels as K
from .scratch import Scratch

#: Links a node keeps, rounds of descent, starting partitions and their block, results a local join gives a node.
LINKS, DESCENTS, STARTS, BLOCK, OFFERS = 24, 4, 4, 256, 8
#: Candidates a query keeps, and the most rounds of its search.
BEAM, ROUNDS = 200, 8


def _raw(dim: int):
    """(id, list) to (id, raw doubles, squared length) of the vectors that take part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            col = batch.column(1)
            flat = np.asarray(col.flatten().cast(pa.float64()).fill_null(np.nan), float).reshape(-1, dim)
            square = (flat * flat).sum(1) if len(flat) else np.zeros(0)
            ok = np.flatnonzero(np.isfinite(flat).all(1) & (flat != 0).any(1) & np.isfinite(square))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(ok)), K.binary_rows(flat[ok]) if len(ok) else pa.array([], pa.binary()), pa.array(square[ok])], ["id", "raw", "square"])

    return run


def _code(most: float):
    """(id, raw, square) to (id, code): 8-bit coordinates, the one more included, and their scale."""

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            square = np.asarray(batch.column(2))
            raw, _ = K.text_buffers(batch.column(1))
            x = np.frombuffer(raw.tobytes(), float).reshape(batch.num_rows, -1)
            x = np.hstack([x, np.sqrt(np.maximum(most - square, 0))[:, None]])
            scale = (np.abs(x).max(1) / 127).astype(np.float32)
            code = np.round(x / scale[:, None]).astype(np.int8)
            yield pa.RecordBatch.from_arrays([batch.column(0), K.binary_rows(np.hstack([code.view(np.uint8), scale[:, None].view(np.uint8)]))], ["id", "code"])

    return run


def _decoded(col: pa.Array) -> np.ndarray:
    """Codes as float32 rows."""
    raw, off = K.text_buffers(col)
    m = raw.reshape(len(off) - 1, -1)
    return m[:, :-4].view(np.int8).astype(np.float32) * np.ascontiguousarray(m[:, -4:]).view(np.float32)


_FOUND = "u long, v long, s double"


def _links(u: list, v: list, s: list) -> pa.RecordBatch:
    cat = lambda parts, kind: pa.array(np.concatenate(parts) if parts else np.zeros(0), kind)
    return pa.RecordBatch.from_arrays([cat(u, pa.int64()), cat(v, pa.int64()), cat(s, pa.float64())], ["u", "v", "s"])


def _mutual(offers: int):
    """Rows (list of (id, code, least)) to links: for each member its best others that beat its least score."""

    def run(batches):
        for batch in batches:
            lists = batch.column(0)
            values = lists.flatten()
            ids, codes, least = (values.field(i) for i in range(3))
            ids, least, x = np.asarray(ids), np.asarray(least), _decoded(codes) if len(values) else np.zeros((0, 1), np.float32)
            off = np.asarray(lists.offsets) - lists.offsets[0].as_py()
            u, v, s = [], [], []
            for a, b in zip(off[:-1], off[1:], strict=True):
                if b - a < 2:
                    continue
                score = x[a:b] @ x[a:b].T
                np.fill_diagonal(score, -np.inf)
                n = min(offers, b - a - 1)
                best = np.argpartition(-score, n - 1, axis=1)[:, :n]
                value = np.take_along_axis(score, best, 1)
                good = value > least[a:b, None]
                u.append(np.repeat(ids[a:b], good.sum(1)))
                v.append(ids[a:b][best[good]])
                s.append(value[good].astype(float))
            yield _links(u, v, s)

    return run


def _best(links: DataFrame, k: int) -> DataFrame:
    merged = links.groupBy("u", "v").agg(F.max("s").alias("s"))
    return merged.withColumn("_r", F.row_number().over(W.partitionBy("u").orderBy(F.desc("s"), "v"))).where(F.col("_r") <= k).drop("_r")


def _around(edges: DataFrame, k: int, seed: int) -> DataFrame:
    """Distinct (u, v): the links out of u and a hashed k of those into it."""
    back = edges.select(F.col("v").alias("u"), F.col("u").alias("v"))
    back = back.withColumn("_r", F.row_number().over(W.partitionBy("u").orderBy(F.xxhash64("u", "v", F.lit(seed)), "v"))).where(F.col("_r") <= k).drop("_r")
    return edges.select("u", "v").union(back).distinct()


def build_graph(nodes: DataFrame, scratch: Scratch, links: int = LINKS, descents: int = DESCENTS) -> DataFrame:
    """(u, around: list of (id, code)) from nodes (id, code): NN-descent.

    Starting links come from blocks of nodes alike in the signs of random projections, codes of many nodes being cut
    into blocks by a hash. A descent joins the neighbours of every node with one another."""
    n = nodes.count()
    bits = max(0, int(np.ceil(np.log2(max(1, n) / BLOCK))))

    def signs(t: int):
        def run(batches):
            for batch in batches:
                if batch.num_rows:
                    x = _decoded(batch.column(1))
                    planes = np.random.Generator(np.random.PCG64(100 + t)).normal(size=(x.shape[1], max(bits, 1)))
                    key = ((x @ planes > 0) * (1 << np.arange(max(bits, 1)))).sum(1) if bits else np.zeros(len(x), np.int64)
                    yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(key + (t << 40))], ["id", "code", "part"])

        return run

    edges = None
    for t in range(STARTS if bits else 1):
        keyed = nodes.mapInArrow(signs(t), "id long, code binary, part long")
        sizes = keyed.groupBy("part").agg(F.ceil(F.count("*") / BLOCK).alias("cuts"))
        cut = keyed.join(sizes, "part").withColumn("cut", F.pmod(F.xxhash64("id", F.lit(t)), F.col("cuts")))
        lists = cut.groupBy("part", "cut").agg(F.collect_list(F.struct("id", "code", F.lit(float("-inf")).alias("least"))).alias("l")).select("l")
        found = lists.mapInArrow(_mutual(links // 2), _FOUND)
        edges = found if edges is None else edges.union(found)
    edges = scratch.cut(_best(edges, links), "edges")
    for step in range(descents):
        least = edges.groupBy(F.col("u").alias("id")).agg(F.when(F.count("*") >= links, F.min("s")).otherwise(float("-inf")).alias("least"))
        told = nodes.join(least, "id", "left").select(F.col("id").alias("v"), "code", F.coalesce("least", F.lit(float("-inf"))).alias("least"))
        lists = _around(edges, links, step).join(told, "v").groupBy("u").agg(F.collect_list(F.struct(F.col("v").alias("id"), "code", "least")).alias("l")).select("l")
        new = scratch.cut(_best(lists.mapInArrow(_mutual(OFFERS), _FOUND).union(edges), links), "edges")
        scratch.drop(edges)
        edges = new
    around = _around(edges, links, descents).join(nodes.withColumnRenamed("id", "v"), "v")
    return scratch.cut(around.groupBy("u").agg(F.collect_list(F.struct(F.col("v").alias("id"), "code")).alias("around")), "graph")


def _step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (q, raw, least, around) to links (q, id, score) over the query's least score."""
    for batch in batches:
        lists = batch.column(3)
        values = lists.flatten()
        if not len(values):
            continue
        ids, x = np.asarray(values.field(0)), _decoded(values.field(1))
        raw, _ = K.text_buffers(batch.column(1))
        q = np.frombuffer(raw.tobytes(), float).reshape(batch.num_rows, -1).astype(np.float32)
        sizes = np.diff(np.asarray(lists.offsets))
        score = np.einsum("ij,ij->i", np.repeat(q, sizes, 0), x[:, :-1]).astype(float)
        good = score > np.repeat(np.asarray(batch.column(2)), sizes)
        yield _links([np.repeat(np.asarray(batch.column(0)), sizes)[good]], [ids[good]], [score[good]])


def _exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (q, v, raw of q, raw of v) to links with the exact inner product."""
    for batch in batches:
        if batch.num_rows:
            a, b = (np.frombuffer(K.text_buffers(batch.column(i))[0].tobytes(), float).reshape(batch.num_rows, -1) for i in (2, 3))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array((a * b).sum(1))], ["u", "v", "s"])


def search(queries: DataFrame, graph: DataFrame, scratch: Scratch, beam: int = BEAM, rounds: int = ROUNDS) -> DataFrame:
    """(q, v) of the best `beam` nodes found for queries (q, raw, start): each round opens the unopened nodes of the beam."""
    pool = scratch.cut(queries.select("q", F.col("start").alias("node"), F.lit(float("-inf")).alias("s"), F.lit(False).alias("opened")), "pool")
    for _ in range(rounds):
        least = pool.groupBy("q").agg(F.when(F.count("*") >= beam, F.min("s")).otherwise(float("-inf")).alias("least"))
        opening = pool.where("not opened").join(least, "q").join(queries.select("q", "raw"), "q").select("q", "raw", "least", F.col("node").alias("u"))
        found = opening.join(graph, "u").select("q", "raw", "least", "around").mapInArrow(_step, _FOUND)
        grown = pool.select("q", "node", "s", F.lit(True).alias("opened")).union(found.select(F.col("u").alias("q"), F.col("v").alias("node"), "s", F.lit(False).alias("opened")))
        grown = grown.groupBy("q", "node").agg(F.max("s").alias("s"), F.max("opened").alias("opened"))
        kept = grown.withColumn("_r", F.row_number().over(W.partitionBy("q").orderBy(F.desc("s"), "node"))).where(F.col("_r") <= beam).drop("_r")
        new = scratch.cut(kept, "pool")
        scratch.drop(pool)
        pool = new
        if not pool.where("not opened").limit(1).count():
            break
    return pool.select("q", F.col("node").alias("v"))


def nearest(spark: SparkSession, embeddings: DataFrame, every: int = 20, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): for each row whose id is divisible by `every`, its k nearest other rows found.

    Nearness is the inner product in double precision on the original vectors, ties go to the smaller id, ranks run
    from 1; fewer candidates give fewer rows. Vectors that are null, all zero or hold null or non-finite values take
    no part, nor do rows with a null id, nor vectors of another length than the commonest (ties: the longest). Of
    rows that repeat an id the first vector in byte order counts. Equal vectors are searched once."""
    scratch = Scratch(spark, "ann")
    schema = "query_id long, rank int, vec_id long, score double"
    src = embeddings.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("vector")).where("id is not null and size(vector) > 0")
    shape = src.groupBy(F.size("vector").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    if shape is None:
        return spark.createDataFrame([], schema)
    raw = src.where(F.size("vector") == shape.d).mapInArrow(_raw(shape.d), "id long, raw binary, square double")
    rows = scratch.cut(raw.groupBy("id").agg(F.min_by(F.struct("raw", "square"), "raw").alias("x")).select("id", "x.raw", "x.square"), "rows")
    most = rows.agg(F.max("square")).first()[0]
    if most is None:
        return spark.createDataFrame([], schema)

    # equal vectors: one node, named by the least id; of each the k + 1 least ids can be among anyone's k nearest
    classes = scratch.cut(rows.groupBy("raw").agg(F.min("id").alias("node"), F.min("square").alias("square")), "classes")
    nodes = scratch.cut(classes.select(F.col("node").alias("id"), "raw", "square").mapInArrow(_code(most), "id long, code binary"), "nodes")
    first = rows.withColumn("_r", F.row_number().over(W.partitionBy("raw").orderBy("id"))).where(F.col("_r") <= k + 1)
    members = scratch.cut(first.join(classes.select("raw", "node"), "raw").select("node", "id"), "members")
    asked = scratch.cut(rows.where(F.col("id") % every == 0).join(classes.select("raw", "node"), "raw").select(F.col("id").alias("query_id"), F.col("node").alias("q")), "asked")
    graph = build_graph(nodes, scratch)
    asking = scratch.cut(classes.join(asked.select(F.col("q").alias("node")).distinct(), "node").select(F.col("node").alias("q"), "raw", F.col("node").alias("start")), "asking")
    pool = search(asking, graph, scratch)

    pairs = pool.join(asking.select("q", "raw"), "q").join(classes.select(F.col("node").alias("v"), F.col("raw").alias("other")), "v").select("q", "v", "raw", "other")
    scored = pairs.mapInArrow(_exact, _FOUND)
    near = scored.withColumn("_r", F.row_number().over(W.partitionBy("u").orderBy(F.desc("s"), "v"))).where(F.col("_r") <= k + 1)
    each = near.select(F.col("u").alias("q"), F.col("v").alias("node"), "s").join(members, "node")
    each = each.withColumn("_r", F.row_number().over(W.partitionBy("q").orderBy(F.desc("s"), "id"))).where(F.col("_r") <= k + 1)
    each = scratch.cut(each.select("q", "id", "s", "_r"), "each")
    # a query of a class finds its class's list less itself
    own = each.select(F.col("q").alias("_q"), F.col("id").alias("_id"), F.col("_r").alias("_own"))
    out = asked.join(own, (F.col("q") == F.col("_q")) & (F.col("query_id") == F.col("_id")), "left").join(each, "q").where("id <> query_id")
    rank = F.col("_r") - F.when(F.col("_own") < F.col("_r"), 1).otherwise(0)
    return out.select("query_id", rank.cast("int").alias("rank"), F.col("id").alias("vec_id"), F.col("s").alias("score")).where(F.col("rank") <= k)
