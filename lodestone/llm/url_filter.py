"""Allow and block rules over urls: a trie of reversed host labels, then of path segments."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Rules that may be sent to every executor; larger lists go through judge_by_join.
MOST_BROADCAST = 500_000


@dataclass(frozen=True)
class Rule:
    verdict: str  # allow or block
    host: str  # the host itself and its subdomains
    path: str = "/"  # beginning of the path

    @property
    def name(self) -> str:
        return self.host + self.path

    @property
    def rank(self) -> tuple[int, int, bool]:
        """Longest rule first, then the longer host, then block."""
        return len(self.name), len(self.host), self.verdict == "block"


@dataclass
class _Node:
    next: dict = field(default_factory=dict)
    paths: _Node | None = None  # at a host node: the trie of path segments below it
    rules: list = field(default_factory=list)  # at a path node: (rest of the last segment, rule)


class RuleTrie:
    def __init__(self, rules: Iterable[Rule]):
        self.root = _Node()
        for rule in rules:
            node = self.root
            for label in reversed(rule.host.translate(str.maketrans(UPPER, LOWER)).split(".")):
                node = node.next.setdefault(label, _Node())
            node.paths = node.paths or _Node()
            node = node.paths
            *whole, rest = rule.path.split("/")
            for segment in whole:
                node = node.next.setdefault(segment, _Node())
            node.rules.append((rest, rule))

    def find(self, host: str, path: str) -> Rule | None:
        """The longest rule that fits, or None."""
        best, node, segments = None, self.root, path.split("/")
        for label in reversed(host.split(".")):
            node = node.next.get(label)
            if node is None:
                break
            at = node.paths
            for segment in segments if at else ():
                for rest, rule in at.rules:
                    if segment.startswith(rest) and (best is None or rule.rank > best.rank):
                        best = rule
                at = at.next.get(segment)
                if at is None:
                    break
        return best


def judge(urls: DataFrame, rules: Iterable[Rule], id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """(id_col, host, path, rule, verdict) for every row.

    The longest rule (host and path together) that fits decides; a tie goes to the longer host, then to block.
    Without a rule the verdict is `default` and the rule null. Null urls and urls without :// have an empty host
    and path. Rows are kept as they are, repeated and null ids included; other columns are left out. Over
    MOST_BROADCAST rules the same is computed by a join."""
    rules = list(rules)
    if len(rules) > MOST_BROADCAST:
        return judge_by_join(urls, rules, id_col, url_col, default)
    trie = RuleTrie(rules)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [trie.find(h, p) for h, p in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            names = pa.array([r.name if r else None for r in found], pa.string())
            verdicts = pa.array([r.verdict if r else default for r in found], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, names, verdicts], ["id", "host", "path", "rule", "verdict"])

    return parsed(urls, id_col, url_col).mapInArrow(run, "id long, host string, path string, rule string, verdict string").withColumnRenamed("id", id_col)


def parsed(urls: DataFrame, id_col: str, url_col: str) -> DataFrame:
    """(id, host, path)."""
    url = F.coalesce(F.col(url_col).cast("string"), F.lit(""))
    at = F.instr(url, "://")
    src = urls.select(F.col(id_col).cast("long").alias("id"), F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise(F.lit("")).alias("rest"))
    src = src.withColumn("raw", F.regexp_extract("rest", "^[^/?#]*", 0))
    after = F.col("rest").substr(F.length("raw") + 1, F.length("rest"))
    return src.select("id", F.translate("raw", UPPER, LOWER).alias("host"), F.regexp_extract(after, "^[^?#]*", 0).alias("path"))


def judge_by_join(urls: DataFrame, rules: Iterable[Rule], id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """judge() for rule lists too large to broadcast: host suffixes and folders of each url meet the rules in a join."""
    spark = urls.sparkSession
    lower = str.maketrans(UPPER, LOWER)
    rows = [(r.host.translate(lower), r.path.rpartition("/")[0], r.path, r.name, r.verdict, *r.rank) for r in rules]
    table = spark.createDataFrame(rows, "rhost string, folder string, rpath string, rule string, verdict string, size int, hsize int, blocks boolean")
    src = parsed(urls, id_col, url_col).withColumn("row", F.monotonically_increasing_id())
    labels, segments = F.split("host", "\\."), F.split("path", "/")
    keys = src.select("row", "path", F.explode(F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))).alias("rhost"))
    keys = keys.select("row", "path", "rhost", F.explode(F.transform(F.sequence(F.lit(1), F.size(segments)), lambda i: F.array_join(F.slice(segments, 1, i - 1), "/"))).alias("folder"))
    hits = keys.join(table, ["rhost", "folder"]).where(F.col("path").startswith(F.col("rpath")))
    best = hits.groupBy("row").agg(F.max_by(F.struct("rule", "verdict"), F.struct("size", "hsize", "blocks")).alias("b"))
    out = src.join(best, "row", "left")
    return out.select(F.col("id").alias(id_col), "host", "path", F.col("b.rule").alias("rule"), F.coalesce("b.verdict", F.lit(default)).alias("verdict"))
