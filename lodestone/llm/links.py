"""Links among the members of banded buckets without emitting all pairs of a bucket.

Round 1 compares every member of a bucket with the bucket's least id, round 2, in buckets that still hold several
components, with another leader. What is then left are pairs of one bucket in different components: small buckets
give them by a join, large ones are compared block by block, where only links that hold are emitted. So every pair
of a bucket is compared or already connected: nothing is capped and nothing is lost."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graph import components
from .scratch import MOST_TOGETHER, Scratch, small_side, together

#: Members from which an open bucket counts as large, and the rows of a block.
LARGE, BLOCK = 48, 192


def _alike(a: Column, b: Column, percent: int) -> Column:
    """Sizes so far apart cannot reach the similarity."""
    return F.least(a, b) * 100 >= F.greatest(a, b) * percent


def shared_buckets(buckets: DataFrame, scratch: Scratch) -> DataFrame:
    """(bucket, id, size, leader) of the buckets with at least two ids, the leader being the least."""
    least = buckets.groupBy("bucket").agg(F.min("id").alias("leader"), F.max("id").alias("_most")).where("leader < _most").drop("_most")
    least = scratch.cut(least, "leaders")
    out = scratch.cut(buckets.join(small_side(least), "bucket").select("bucket", "id", "size", "leader"), "buckets")
    scratch.drop(least)
    return out


def dealt_buckets(buckets: DataFrame, scratch: Scratch) -> DataFrame:
    """The same, with the leader's size as lsize and without the rows of the leaders, of buckets that are dear to make and
    may repeat rows: one shuffle serves to find what is shared and to take it."""
    rows = buckets.select("bucket", "id", "size").repartition("bucket")
    least = rows.groupBy("bucket").agg(F.min("id").alias("leader"), F.max("id").alias("_most"), F.min_by("size", "id").alias("lsize")).where("leader < _most").drop("_most")
    shared = rows.join(least.hint("shuffle_hash"), "bucket").where("id > leader").dropDuplicates(["bucket", "id"])
    out = scratch.cut(shared.select("bucket", "id", "size", "leader", "lsize"), "buckets")
    scratch.release()
    return out


def link(buckets: DataFrame, verify: Callable[[DataFrame], DataFrame], scratch: Scratch, percent: int, blocks: Callable[[DataFrame], DataFrame], large: int | None = None, dealt: bool = False, near: Callable[[Column, Column], Column] | None = None) -> DataFrame:
    """(id, component) of the ids that have a link which holds.

    buckets (bucket long, id long, size), each pair of bucket and id once; verify takes (a, b), a < b, and returns
    those that hold. With `dealt`, buckets may repeat rows and are made once, and `near`
    tells of two sizes, which may be any number that tells of an id's set, whether the ids are worth comparing. blocks
    takes (key1, key2, key3, side, id, component, size), where the rows of one key are to be compared
    side 0 with side 1, and returns the links (a, b) that hold. Buckets under `large` members give their pairs by a
    join."""
    large = LARGE if large is None else large
    alike = near or (lambda x, y: _alike(x, y, percent))
    shared = (dealt_buckets if dealt else shared_buckets)(buckets, scratch)
    few = shared.count() <= MOST_TOGETHER
    shared = together(shared, few)
    met = shared.where("id > leader")
    if dealt and near:
        met = met.where(near(F.col("size"), F.col("lsize")))
    first = met.select(F.col("leader").alias("a"), F.col("id").alias("b")).distinct()
    edges = scratch.cut(verify(first), "edges")
    label = components(edges, scratch)

    def open_buckets(rows: DataFrame) -> DataFrame:
        # a leader has met all members of its bucket and need not be met again
        known = rows.where("id <> leader").select("bucket", "id", "size").join(label, "id", "left").select("bucket", "id", "size", F.coalesce("component", "id").alias("component"))
        known = together(scratch.cut(known, "known"), few)
        several = known.groupBy("bucket").agg(F.min("component").alias("_lo"), F.max("component").alias("_hi"), F.count("*").alias("members")).where("_lo < _hi")
        out = together(scratch.cut(known.join(several.select("bucket", "members"), "bucket"), "open"), few)
        scratch.drop(known)
        return out

    # another leader: the member whose hash with the bucket is least
    still = open_buckets(shared)
    scratch.drop(shared)
    if not still.limit(1).count():
        return label
    order = F.xxhash64("bucket", "id")
    other = still.groupBy("bucket").agg(F.min_by(F.struct("id", "component", "size"), order).alias("l"))
    still = scratch.cut(still.join(other, "bucket").select("bucket", "id", "component", "size", F.col("l.id").alias("leader"), F.col("l.component").alias("leads"), F.col("l.size").alias("lsize")), "led")
    still = together(still, few)
    second = still.where("component <> leads").where(alike(F.col("size"), F.col("lsize"))).select(F.least("id", "leader").alias("a"), F.greatest("id", "leader").alias("b")).distinct()
    edges = edges.union(scratch.cut(verify(second.join(edges, ["a", "b"], "left_anti")), "edges"))
    label = components(edges, scratch)

    # what is left: pairs of one bucket in different components
    rest = open_buckets(still)
    scratch.drop(still)
    if not rest.limit(1).count():
        return label
    if large > 1:
        small = rest.where(F.col("members") < large)
        left = small.select("bucket", F.col("id").alias("a"), F.col("component").alias("ca"), F.col("size").alias("sa"))
        right = small.select("bucket", F.col("id").alias("b"), F.col("component").alias("cb"), F.col("size").alias("sb"))
        worth = (F.col("a") < F.col("b")) & (F.col("ca") != F.col("cb")) & alike(F.col("sa"), F.col("sb"))
        edges = edges.union(verify(left.join(right, (left["bucket"] == right["bucket"]) & worth).select("a", "b").distinct()))
    edges = edges.union(blocks(_blocks(rest.where(F.col("members") >= large))))
    return components(scratch.cut(edges, "edges"), scratch)


def _blocks(rest: DataFrame) -> DataFrame:
    """Members outside a bucket's commonest component (side 0) against all its members (side 1), cut into blocks."""
    sizes = rest.groupBy("bucket", "component").agg(F.count("*").alias("n"))
    shape = sizes.groupBy("bucket").agg(F.max_by("component", F.struct("n", "component")).alias("main"), F.sum("n").alias("all"), F.max("n").alias("most"))
    shape = shape.select("bucket", "main", F.ceil((F.col("all") - F.col("most")) / BLOCK).cast("int").alias("xs"), F.ceil(F.col("all") / BLOCK).cast("int").alias("ys"))
    rows = rest.join(shape, "bucket")
    mix = F.xxhash64("id")
    x = rows.where("component <> main").select("bucket", F.pmod(mix, F.col("xs")).cast("int").alias("xb"), F.explode(F.sequence(F.lit(0), F.col("ys") - 1)).alias("yb"), F.lit(0).alias("side"), "id", "component", "size")
    y = rows.select("bucket", F.explode(F.sequence(F.lit(0), F.col("xs") - 1)).alias("xb"), F.pmod(mix, F.col("ys")).cast("int").alias("yb"), F.lit(1).alias("side"), "id", "component", "size")
    return x.union(y).toDF("key1", "key2", "key3", "side", "id", "component", "size")
