"""Near-duplicate groups of titles and splits that do not leak: shingles, MinHash, LSH pairs, components, packing."""

from __future__ import annotations

import math
import random

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import shingles

MERSENNE = 2**61 - 1


def permutations(n: int, seed: int = 42) -> list[tuple[int, int]]:
    r = random.Random(seed)
    return [(r.randrange(1, MERSENNE), r.randrange(0, MERSENNE)) for _ in range(n)]


def shingle_hash(s: Column) -> Column:
    """First 16 hex digits of md5 as an exact decimal."""
    return F.conv(F.substring(F.md5(s), 1, 16), 16, 10).cast("decimal(20,0)")


def signatures(rows: DataFrame, id_col: str, text: Column, perms: list[tuple[int, int]], n: int = 4) -> DataFrame:
    """(id, p, value): least (a * h + b) mod 2^61 - 1 over the shingles, exact in decimals."""
    flat = rows.select(F.col(id_col).alias("id"), F.explode(shingles(text, n)).alias("s")).select("id", (shingle_hash(F.col("s")) % F.lit(MERSENNE).cast("decimal(20,0)")).cast("decimal(19,0)").alias("h"))
    mins = [F.min(((F.lit(a).cast("decimal(19,0)") * F.col("h") + F.lit(b).cast("decimal(19,0)")) % F.lit(MERSENNE).cast("decimal(20,0)")).cast("decimal(19,0)")).alias(f"m{i}") for i, (a, b) in enumerate(perms)]
    wide = flat.groupBy("id").agg(*mins)
    return wide.select("id", F.posexplode(F.array(*[F.col(f"m{i}").cast("long") for i in range(len(perms))])).alias("p", "value"))


def fast_signatures(rows: DataFrame, id_col: str, text: Column, k: int, n: int = 4) -> DataFrame:
    """(id, values): the same with seeded 64-bit hashes instead of decimals."""
    flat = rows.select(F.col(id_col).alias("id"), F.explode(shingles(text, n)).alias("s")).select("id", F.xxhash64("s").alias("h"))
    return flat.groupBy("id").agg(*[F.min(F.xxhash64("h", F.lit(i))).alias(f"m{i}") for i in range(k)]).select("id", F.array(*[f"m{i}" for i in range(k)]).alias("values"))


def lsh_pairs(signed: DataFrame, sets: DataFrame, bands: int, rows: int, threshold: float, most: int = 200) -> DataFrame:
    """(a, b, jaccard) of members with their bucket's least id, buckets of 2 to `most` members, as the rule has it."""
    keys = F.explode(F.array(*[F.xxhash64(F.lit(i), *[F.get("values", F.lit(i * rows + j)) for j in range(rows)]) for i in range(bands)]))
    buckets = signed.select("id", keys.alias("bucket"))
    lead = buckets.groupBy("bucket").agg(F.min("id").alias("a"), F.count("*").alias("n")).where(f"n between 2 and {most}")
    pairs = buckets.join(lead, "bucket").where("id <> a").select("a", F.col("id").alias("b")).distinct()
    both = pairs.join(sets.toDF("a", "xa"), "a").join(sets.toDF("b", "xb"), "b")
    common = F.size(F.array_intersect("xa", "xb"))
    jaccard = common / (F.size("xa") + F.size("xb") - common)
    return both.select("a", "b", F.round(jaccard.cast("double"), 6).alias("jaccard")).where(F.col("jaccard") >= threshold)


def key_edges(rows: DataFrame, id_col: str, key: Column) -> DataFrame:
    """(a, b): every member of a key with its least id."""
    keyed = rows.select(F.col(id_col).alias("id"), key.alias("key")).where("key is not null")
    least = keyed.groupBy("key").agg(F.min("id").alias("a"), F.count("*").alias("n")).where("n > 1")
    return keyed.join(least, "key").where("id <> a").select("a", F.col("id").alias("b"))


def components(spark: SparkSession, nodes: DataFrame, edges: DataFrame, folder: str) -> DataFrame:
    """(id, grp): the least id that edges (a, b) connect to; rounds are tables in `folder`, which all executors share."""
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    schema = "a long, b long"
    both.select(F.col("a").cast("long"), F.col("b").cast("long")).write.mode("overwrite").parquet(f"{folder}/edges")
    both = spark.read.schema(schema).parquet(f"{folder}/edges")
    nodes.select(F.col("id").cast("long"), F.col("id").cast("long").alias("grp")).write.mode("overwrite").parquet(f"{folder}/0")
    for i in range(1, 64):
        label = spark.read.schema("id long, grp long").parquet(f"{folder}/{i - 1}")
        near = both.join(label.select(F.col("id").alias("b"), F.col("grp").alias("g")), "b").groupBy(F.col("a").alias("id")).agg(F.min("g").alias("g"))
        new = label.join(near, "id", "left").select("id", F.least("grp", "g").alias("grp"))
        jump = new.select(F.col("id").alias("grp"), F.col("grp").alias("up"))
        new.join(jump, "grp", "left").select("id", F.coalesce("up", "grp").alias("grp")).write.mode("overwrite").parquet(f"{folder}/{i}")
        now = spark.read.schema("id long, grp long").parquet(f"{folder}/{i}")
        if not now.join(label.withColumnRenamed("grp", "old"), "id").where("grp <> old").limit(1).count():
            return now
    raise RuntimeError("groups did not settle")


def split_groups(groups: DataFrame, shares: dict[str, float], seed: str = "42") -> DataFrame:
    """(grp, split): groups by size, then hash, go to splits so that running totals follow the shares.

    A group lies in one split whole, at the place its first row has in the running total; no driver loop is needed."""
    sized = groups.groupBy("grp").agg(F.count("*").alias("n"))
    # prefix sums in two levels: within hash slices, then over the slices
    sized = sized.withColumn("slice", F.pmod(F.xxhash64("grp"), F.lit(64)))
    within = W.partitionBy("slice").orderBy(F.desc("n"), F.md5(F.concat_ws("|", F.lit(seed), F.col("grp").cast("string"))))
    sums = sized.withColumn("run", F.sum("n").over(within))
    totals = sized.groupBy("slice").agg(F.sum("n").alias("t"))
    base = totals.withColumn("base", F.sum("t").over(W.orderBy("slice")) - F.col("t")).withColumn("all", F.sum("t").over(W.partitionBy()))
    placed = sums.join(F.broadcast(base), "slice").withColumn("at", (F.col("base") + F.col("run") - F.col("n")) / F.col("all"))
    out, edge = None, 0.0
    for name, share in shares.items():
        edge += share
        out = F.when(F.col("at") < edge, name) if out is None else out.when(F.col("at") < edge, name)
    return placed.select("grp", F.coalesce(out, F.lit(list(shares)[-1])).alias("split"), "n")


def _fill(room: dict[str, float], size: int, groups: int) -> dict[str, int]:
    """How many of `groups` groups of one size each split gets when each goes to the split with most room left (ties:
    the first named). All places above a level are taken whatever the order, so the level is searched, not walked to; the
    last steps are walked, where ties matter."""
    def above(level: float) -> dict[str, int]:
        return {k: max(0, math.ceil((r - level) / size) - 1) for k, r in room.items()}

    low, high = min(room.values()) - size * (groups + 1), max(room.values())
    while high - low > size / 4:
        middle = (low + high) / 2
        low, high = (low, middle) if sum(above(middle).values()) <= groups else (middle, high)
    taken = above(high)
    for k, n in taken.items():
        room[k] -= n * size
    for _ in range(groups - sum(taken.values())):
        k = max(room, key=room.__getitem__)
        room[k] -= size
        taken[k] += 1
    return taken


def pack_groups(groups: DataFrame, shares: dict[str, float], seed: str = "42", hold_out: bool = False) -> DataFrame:
    """(grp, split, n) of groups (grp, gold): the largest first, each to the split that lacks most rows; gold groups
    (all rows gold) go ahead of the others. hold_out gives other groups to the first split and gold ones to the rest.

    Groups of one size are alike, so the driver sees a count for each size (of N rows at most sqrt(2 N) sizes) and
    sets how many of a size go where; which ones is by hash, through sums of hash slices."""
    sized = groups.groupBy("grp").agg(F.count("*").alias("n"), F.min(F.coalesce("gold", F.lit(False))).alias("gold"))
    sized = sized.withColumn("slice", F.pmod(F.xxhash64("grp"), F.lit(64)))
    counts = sized.groupBy("gold", "n").agg(F.count("*").alias("c")).collect()
    total, golden = sum(r.n * r.c for r in counts), sum(r.n * r.c for r in counts if r.gold)
    names = list(shares)
    room = {k: v * total for k, v in shares.items()}
    hold_out = hold_out and golden < total
    if hold_out:
        rest = sum(shares[k] for k in names[1:])
        if golden and rest <= 0:
            raise ValueError("held-out splits need a share")
        room |= {k: golden * shares[k] / rest if rest else 0.0 for k in names[1:]}
    plan = []
    for r in sorted(counts, key=lambda r: (not r.gold, -r.n)):
        open_to = names if not hold_out else names[1:] if r.gold else names[:1]
        own = {k: room[k] for k in open_to}
        at = 0
        for k, c in _fill(own, r.n, r.c).items():
            plan.append((r.gold, r.n, k, at, at + c))
            at += c
        room |= own
    ranges = groups.sparkSession.createDataFrame(plan, "gold boolean, n long, split string, lo long, hi long")
    order = W.partitionBy("gold", "n", "slice").orderBy(F.md5(F.concat_ws("|", F.lit(seed), F.col("grp").cast("string"))), "grp")
    slices = sized.groupBy("gold", "n", "slice").agg(F.count("*").alias("c"))
    before = slices.withColumn("before", F.sum("c").over(W.partitionBy("gold", "n").orderBy("slice")) - F.col("c")).drop("c")
    placed = sized.withColumn("r", F.row_number().over(order)).join(before, ["gold", "n", "slice"]).withColumn("at", F.col("before") + F.col("r") - 1)
    return placed.join(ranges, ["gold", "n"]).where("at >= lo and at < hi").select("grp", "split", "n")


def leaks(rows: DataFrame, group: str = "grp", split: str = "split") -> DataFrame:
    """Groups that lie in several splits."""
    return rows.groupBy(group).agg(F.count_distinct(split).alias("splits")).where("splits > 1")
