"""The registered queries opN_ of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ctw, decontaminate, licenses, minhash, packing, quality, secrets, suffixdedup, urlfilter, vptree
from .common import read

TOKENIZER_FILE = "word_bpe_49k.json"


def tokenizer_path(name: str = TOKENIZER_FILE) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(read(spark, sf_dir, "documents"))


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return quality.score(docs, quality.fit(docs, read(spark, sf_dir, "labels")))


def op3_vantage_point_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vptree.nearest(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op4_context_tree_weighting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ctw.score(read(spark, sf_dir, "documents"))


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(read(spark, sf_dir, "documents"))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages")
    return urlfilter.judge(pages, urlfilter.crawled_twice(pages))


def op7_cost_balanced_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"), tokenizer_path())


def op8_license_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(spark, read(spark, sf_dir, "documents"))


def op9_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixdedup.remove_repeats(read(spark, sf_dir, "documents"))


def op10_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name[:2] == "op" and name[2:3].isdigit()}


OP3_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
             AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
d AS (SELECT q.vec_id AS query_id, v.vec_id,
             sqrt(list_reduce(list_prepend(0.0::DOUBLE, list_transform(range(1, len(q.e) + 1), lambda i: (q.e[i] - v.e[i]) * (q.e[i] - v.e[i]))), lambda a, b: a + b)) AS score
      FROM v q JOIN v ON q.vec_id % 100 = 0 AND v.vec_id <> q.vec_id AND len(v.e) = len(q.e)),
r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id)::INTEGER AS rank, vec_id, score FROM d)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10"""


def _op6_sql() -> str:
    order = sorted(urlfilter.RULES, key=lambda r: -len(r[1] + r[2]))
    fits = lambda d, p: f"(host = '{d}' OR ends_with(host, '.{d}')) AND starts_with(path, '{p}')"
    rule = " ".join(f"WHEN {fits(d, p)} THEN '{d}{p}'" for _, d, p in order)
    verdict = " ".join(f"WHEN {fits(d, p)} THEN '{v}'" for v, d, p in order)
    return f"""
WITH r AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
s AS (SELECT page_id, regexp_extract(rest, '^[^/?#]*') AS raw, rest FROM r),
t AS (SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM s),
u AS (SELECT *, CASE WHEN host <> '' THEN regexp_replace(regexp_replace(host, ':(80|443)$', ''), '^(www|m)[.]', '')
        || regexp_replace(regexp_replace(path, '/index[.]html?$', ''), '([.]html?|/+)$', '') END AS canonical FROM t),
l AS (SELECT canonical AS c FROM u WHERE canonical IS NOT NULL GROUP BY canonical HAVING count(*) > 1)
SELECT page_id, host, path, CASE {rule} END AS rule,
       CASE {verdict} WHEN c IS NOT NULL THEN 'block' ELSE 'allow' END AS verdict, c IS NOT NULL AS listed
FROM u LEFT JOIN l ON u.canonical = l.c"""


def oracle_sql() -> dict[str, str]:
    return {"op3_vantage_point_search": OP3_SQL, "op6_url_filter": _op6_sql(), "op8_license_digests": licenses.oracle()}
