"""The opN_ queries of this package and their SQL, for the driver's entry module."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.llm import bpe, html_extract, media, ngram_join, packing, pii, sharding, topk, toxicity, url_filter
from cairn.llm.common import spread, table

#: The block list of the url filter query: hosts with all their page numbers in four languages, 1.2 million URLs, made without a look at the pages.
LISTED_HOSTS = tuple(m + h for h in ("spam-farm.example.org", "spam-farm.example.com", "cheap-pills.example.com", "free-bets.example.com", "casino-win.example.com") for m in ("", "m."))
LISTED_LANGUAGES, LISTED_NUMBERS = ("en", "de", "fr", "es"), 10_000


def tokenizer_path() -> str:
    return public_tokenizers.path("byte_bpe_50k.json")


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return pii.find_pii(docs, redact=False).select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans")


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_filter.filter_urls(pages, url_filter.enumerated_urls(spark, LISTED_HOSTS, LISTED_LANGUAGES, LISTED_NUMBERS)).select("page_id", "host", "path", "rule", "verdict")


def op3_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_components(spread(table(spark, sf_dir, "documents").select("doc_id", "text")))


def op3_jaccard_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_links(spread(table(spark, sf_dir, "documents").select("doc_id", "text")))


def op4_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.col("vec_id") % 50 == 0)


def op5_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = media.store(spread(table(spark, sf_dir, "documents").select("doc_id", "text")))
    out = media.with_samples(media.with_headers(index))
    return out.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", F.col("length").alias("media_bytes"), "media_sha256", "feature", "width", "height", "depth")


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_decode(spread(table(spark, sf_dir, "documents").select("doc_id", "text")), tokenizer_path(), keep=False)


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(spread(table(spark, sf_dir, "documents").select("doc_id", "text")), tokenizer_path())
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return toxicity.score_toxicity(docs, table(spark, sf_dir, "labels").select("doc_id", "toxic")).select("doc_id", "held_out", "score", "predicted")


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    size = F.coalesce(F.octet_length("text"), F.lit(0)) + 8
    out = sharding.shard(docs, sharding.text_key("text", "doc_id"), size, ties=["doc_id"])
    crc = F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary"))
    return out.select("doc_id", "size", crc.alias("text_crc32"), F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op10_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract_text(spread(table(spark, sf_dir, "pages").select("page_id", "url", "html")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    named = (op1_pii, op2_url_filter, op3_jaccard, op3_jaccard_links, op4_topk, op5_media, op6_bpe, op7_packing, op8_toxicity, op9_sharding, op10_html)
    return {f.__name__: f for f in named}


def oracle_sql() -> dict[str, str]:
    return {"op2_url_filter": URL_FILTER_SQL, "op3_jaccard": JACCARD_SQL, "op3_jaccard_links": JACCARD_LINKS_SQL, "op4_topk": TOPK_SQL}


URL_FILTER_SQL = r"""
WITH a AS (SELECT page_id, url, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) END AS rest FROM pages),
b AS (SELECT page_id, rest, coalesce(translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
             coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path,
             regexp_extract(rest, '^[^?#]*\?([^#]*)', 1) AS query FROM a),
c AS (SELECT *, array_to_string(list_sort(list_filter(string_split(query, '&'), lambda p: p <> '' AND NOT regexp_matches(p, '^(utm_[a-z_]+|ref|fbclid|gclid)(=|$)'))), '&') AS kept FROM b),
d AS (SELECT page_id, host, path, CASE WHEN host <> '' THEN
             regexp_replace(regexp_replace(host, ':(80|443)$', ''), '^www\.', '') || regexp_replace(path, '/+$', '') || CASE WHEN coalesce(kept, '') <> '' THEN '?' || kept ELSE '' END END AS canonical FROM c),
r AS (SELECT *, CASE
        WHEN (host = 'example.org' OR host LIKE '%.example.org') AND starts_with(path, '/en/1') THEN 'example.org/en/1'
        WHEN (host = 'example.org' OR host LIKE '%.example.org') AND starts_with(path, '/es/') THEN 'example.org/es/'
        WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/fr/') THEN 'com/fr/'
        WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/de/') THEN 'com/de/'
        WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/') THEN 'org/' END AS rule FROM d)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('org/', 'com/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
       WHEN regexp_matches(canonical, '^(m\.)?(spam-farm\.example\.(org|com)|(cheap-pills|free-bets|casino-win)\.example\.com)/(en|de|fr|es)/(0|[1-9][0-9]{0,3})(\.html|\?page=2)?$') THEN 'block' ELSE 'allow' END AS verdict
FROM r
"""

TOPK_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS query_id, b.vec_id AS vec_id, CAST(list_sum(list_transform(list_zip(a.q, b.q), lambda p: p[1] * p[2])) AS BIGINT) AS score
      FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.q) = len(b.q) WHERE a.vec_id % 50 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""

JACCARD_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
             ELSE list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))) END AS g FROM w),
n AS (SELECT doc_id, CAST(len(g) AS BIGINT) AS n FROM s),
g AS (SELECT doc_id, unnest(g) AS h FROM s),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM g a JOIN g b ON a.h = b.h AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM o JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 75 * (x.n + y.n - k)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id, doc_id AS c FROM n UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.doc_id AND r.c < e.b)
SELECT n.doc_id, n.n AS n_shingles, min(r.c) AS component_id FROM n JOIN r USING (doc_id) GROUP BY 1, 2
"""

JACCARD_LINKS_SQL = JACCARD_SQL.replace(
    "SELECT n.doc_id, n.n AS n_shingles, min(r.c) AS component_id FROM n JOIN r USING (doc_id) GROUP BY 1, 2",
    "SELECT n.doc_id, n.n AS n_shingles, min(r.c) AS component_id, (SELECT count(*) FROM e WHERE e.a = n.doc_id) AS n_links FROM n JOIN r USING (doc_id) GROUP BY 1, 2",
)
