"""The queries of this subpackage: each operator over its whole table, with production parameters."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import DataFrame, SparkSession

from tablelog.llm import decontaminate, html_extract, jaccard_join, packing, quality_cnn, quality_rules, sharding, token_counts, toxicity_mil, url_filter

#: Rules of host and path prefix, and hosts whose pages are blocked where no rule speaks.
URL_RULES = (("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block"))
BLOCKED_HOSTS = ("spam-farm.example.com/", "spam-farm.example.net/", "spam-farm.example.org/")
#: A list of the size that is common for advert hosts: n0.ads.example.net/ and on.
ADVERT_HOSTS = 1_000_000


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(_read(spark, sf_dir, "pages"), URL_RULES, chain(BLOCKED_HOSTS, (f"n{k}.ads.example.net/" for k in range(ADVERT_HOSTS))))


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_components(_read(spark, sf_dir, "documents"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(_read(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_read(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def op5_quality_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _read(spark, sf_dir, "documents")
    net = quality_cnn.train(documents, _read(spark, sf_dir, "labels"))
    scored = quality_cnn.score_texts(documents, net)
    return scored.select("doc_id", toxicity_mil.held_out().alias("held_out"), "score", "predicted")


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _read(spark, sf_dir, "documents")
    return quality_rules.judge(documents, quality_rules.fit_rules(documents, _read(spark, sf_dir, "labels")))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(_read(spark, sf_dir, "pages"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _read(spark, sf_dir, "documents")
    model = toxicity_mil.train(documents, _read(spark, sf_dir, "labels"))
    scored = toxicity_mil.score_texts(documents, model)
    return scored.select("doc_id", toxicity_mil.held_out().alias("held_out"), "score", "predicted", "n_offending", "worst_start", "worst_bytes", "worst_score")


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(_read(spark, sf_dir, "documents"))


def queries() -> dict:
    return {f.__name__: f for f in (op1_url_filter, op2_jaccard_join, op3_token_counts, op4_packing, op5_quality_cnn, op6_quality_rules, op7_decontamination, op8_html_extraction, op9_toxicity, op10_sharding)}


def oracle_sql() -> dict[str, str]:
    return {"op1_url_filter": _OP1, "op2_jaccard_join": _OP2}


_OP1 = r"""
WITH rest AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), raw AS (
  SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS raw_host FROM rest
), parsed AS (
  SELECT page_id, translate(raw_host, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(substr(rest, length(raw_host) + 1), '^[^?#]*') AS path FROM raw
), rules(rule, action, rule_host, rule_path) AS (
  VALUES ('org/', 'allow', 'org', '/'), ('example.org/es/', 'block', 'example.org', '/es/'), ('example.org/en/1', 'block', 'example.org', '/en/1'),
         ('com/fr/', 'allow', 'com', '/fr/'), ('com/de/', 'block', 'com', '/de/')
), fits AS (
  SELECT page_id, arg_max(rule, length(rule)) AS rule, arg_max(action, length(rule)) AS action
  FROM parsed JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
  GROUP BY page_id
)
SELECT p.page_id, host, path, rule,
       coalesce(action, CASE WHEN path LIKE '/%' AND regexp_matches(host, '(^|\.)(spam-farm\.example\.(com|net|org)|n(0|[1-9][0-9]{0,5})\.ads\.example\.net)$') THEN 'block' ELSE 'allow' END) AS verdict
FROM parsed p LEFT JOIN fits f ON p.page_id = f.page_id
"""


_OP2 = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(w[k:k + 4], ' ') AS g
  FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(len(w) - 4, 1))) AS k FROM d WHERE len(w) > 0) t
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), p AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id
), l AS (
  SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 80 * (x.n + y.n - i)
), reach(doc_id, r) AS (
  SELECT doc_id, doc_id FROM d UNION SELECT reach.doc_id, l.b FROM reach JOIN l ON l.a = reach.r
)
SELECT d.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(reach.r) AS component_id
FROM d JOIN reach ON reach.doc_id = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id GROUP BY d.doc_id
"""
