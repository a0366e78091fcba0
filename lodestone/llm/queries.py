"""The opN_ queries over the driver's tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

#: A SentencePiece BPE model with byte fallback; any other path may be given.
MODEL_PATH = "/opt/tokenizers/piece_bpe_32k.model"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op6_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .minhash_dedup import near_duplicates

    return near_duplicates(spark, _table(spark, sf_dir, "documents"), words=2, percent=80)


#: The rules of op7: verdict, host, path.
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]


def op1_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ann import nearest

    return nearest(spark, _table(spark, sf_dir, "embeddings"))


def op2_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import leaks

    return leaks(spark, _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .line_dedup import dedup_lines

    return dedup_lines(spark, _table(spark, sf_dir, "documents")).select("doc_id", "text", "n_lines", "n_removed")


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .html_text import extract

    return extract(_table(spark, sf_dir, "pages"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .scratch import Scratch
    from .warc import read_archives, write_archives

    return read_archives(write_archives(spark, _table(spark, sf_dir, "pages"), Scratch(spark, "op5").path("warc")))


def op7_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .url_filter import Rule, judge

    return judge(_table(spark, sf_dir, "pages"), [Rule(*x) for x in RULES])


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import score

    return score(spark, _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import find_pii

    return find_pii(spark, _table(spark, sf_dir, "documents"))


def op10_sentencepiece(spark: SparkSession, sf_dir: str, model_path: str | None = None) -> DataFrame:
    from .pieces import encode_documents

    return encode_documents(spark, _table(spark, sf_dir, "documents"), model_path or MODEL_PATH)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_ann": op1_ann,
    "op2_benchmark_decontamination": op2_benchmark_decontamination,
    "op3_line_dedup": op3_line_dedup,
    "op4_html_extraction": op4_html_extraction,
    "op5_warc": op5_warc,
    "op6_minhash_near_dedup": op6_minhash_near_dedup,
    "op7_url_filters": op7_url_filters,
    "op8_quality_classifier": op8_quality_classifier,
    "op9_pii": op9_pii,
    "op10_sentencepiece": op10_sentencepiece,
}

OP5_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, CAST(octet_length(encode(html)) AS BIGINT) AS payload_bytes, sha1(html) AS sha, min(page_id) OVER (PARTITION BY html) AS first FROM p),
bits AS (SELECT *, list_transform(range(32), lambda i:
  substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1 + (
    (CAST('0x' || substr(sha, CAST(1 + 2 * ((5 * i) // 8) AS INT), 2) AS INT) * 256
     + CASE WHEN (5 * i) // 8 < 19 THEN CAST('0x' || substr(sha, CAST(3 + 2 * ((5 * i) // 8) AS INT), 2) AS INT) ELSE 0 END)
    // CAST(pow(2, 11 - (5 * i) % 8) AS INT)) % 32 AS INT), 1)) AS letters FROM d)
SELECT page_id, payload_bytes, array_to_string(letters, '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to
FROM bits
"""

OP6_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) = 1 THEN ws
  ELSE list_distinct(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])) END AS sh FROM w),
c AS (SELECT min(doc_id) AS rep, list_sort(sh) AS sh, len(sh) AS n FROM s WHERE len(sh) > 0 GROUP BY list_sort(sh), len(sh)),
e AS (SELECT rep, n, unnest(sh) AS x FROM c),
pairs AS (SELECT a.rep AS a, b.rep AS b FROM e a JOIN e b ON a.x = b.x AND a.rep < b.rep AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
  GROUP BY a.rep, b.rep, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
both_ways AS (SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs),
reach AS (SELECT rep AS id, rep AS seen FROM c UNION SELECT r.id, p.b FROM reach r JOIN both_ways p ON r.seen = p.a),
comp AS (SELECT id, min(seen) AS component_id FROM reach GROUP BY id)
SELECT s.doc_id, CAST(len(s.sh) AS BIGINT) AS n_shingles, coalesce(comp.component_id, s.doc_id) AS component_id,
  s.doc_id = coalesce(comp.component_id, s.doc_id) AS kept
FROM s LEFT JOIN c ON list_sort(s.sh) = c.sh LEFT JOIN comp ON comp.id = c.rep
"""

OP7_SQL = r"""
WITH r AS (SELECT page_id, coalesce(url, '') AS url FROM pages),
u AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM r),
h AS (SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS raw FROM u),
p AS (SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM h),
rules AS (SELECT * FROM (VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')) t(verdict, rhost, rpath)),
m AS (SELECT p.page_id, rhost || rpath AS rule, verdict, row_number() OVER (PARTITION BY p.page_id ORDER BY length(rhost || rpath) DESC, length(rhost) DESC, verdict DESC) AS k
  FROM p JOIN rules ON (p.host = rhost OR suffix(p.host, '.' || rhost)) AND starts_with(p.path, rpath))
SELECT p.page_id, p.host, p.path, m.rule, coalesce(m.verdict, 'allow') AS verdict FROM p LEFT JOIN m ON m.page_id = p.page_id AND m.k = 1
"""

ORACLES: dict[str, str] = {"op5_warc": OP5_SQL, "op6_minhash_near_dedup": OP6_SQL, "op7_url_filters": OP7_SQL}
