"""Queries opN_<name> over whole tables, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from copse.llm import decontam, dedup, html, jaccard, langid, licences, packing, pii, quality, sharding
from copse.llm.common import documents

#: Production topology: 4 regions of 2 racks of 5 shards.
TOPOLOGY = sharding.Topology.regular(40)


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    """Where a public tokenizer's file is installed."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.licence_report(documents(spark, sf_dir))


def op2_sum_of_squares_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packing_report(documents(spark, sf_dir), vocabulary())


def op3_quality_gam(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return quality.score(docs, quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def op4_hash_tree_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign_shards(documents(spark, sf_dir), TOPOLOGY)


def op5_consensus_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract_pages(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return langid.predict(docs, langid.fit(docs))


def op7_pii_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pii_report(documents(spark, sf_dir))


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(documents(spark, sf_dir))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.find_leaks(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.dedup_report(documents(spark, sf_dir), keep="largest")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and name[2].isdigit()}


_OP10 = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
     g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256 FROM d JOIN g USING (t)
"""

_BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+",
    "card": r"[0-9](?:[\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"\b(?:" + "|".join(rf"{country}[0-9]{{2}}(?: ?[A-Z0-9]){{{n - 4}}}" for country, n in pii.IBAN_LENGTHS.items()) + r")\b",
    "secret": r"\b[0-9A-Fa-f]{32,64}\b",
}
_DIGITS = "regexp_replace(s.hit, '[^0-9]', '', 'g')"
_LUHN = f"list_sum(list_transform(string_split(reverse({_DIGITS}), ''), lambda c, i: CASE WHEN i % 2 = 1 THEN c::INT ELSE (c::INT * 2) // 10 + (c::INT * 2) % 10 END)) % 10 = 0"
_FLAT = "replace(s.hit, ' ', '')"
_MOD97 = f"list_reduce(list_prepend(0::BIGINT, list_transform(string_split({_FLAT}[5:] || {_FLAT}[:4], ''), lambda c: CASE WHEN c BETWEEN '0' AND '9' THEN ascii(c) - 48 ELSE ascii(c) - 55 END::BIGINT)), lambda a, v: CASE WHEN v < 10 THEN (a * 10 + v) % 97 ELSE (a * 100 + v) % 97 END) = 1"
_HOLDS = {
    "email": "true",
    "ip": "len(list_filter(string_split(s.hit, '.'), lambda p: p::HUGEINT > 255)) = 0",
    "card": f"length({_DIGITS}) BETWEEN 14 AND 19 AND {_LUHN}",
    "phone": f"length({_DIGITS}) BETWEEN 10 AND 15",
    "iban": _MOD97,
    "secret": "regexp_matches(s.hit, '[0-9]') AND regexp_matches(s.hit, '[A-Za-z]')",
}


def _op7_sql() -> str:
    parts = []
    for rank, (kind, pattern) in enumerate(_BASE.items()):
        parts.append(f"""
  SELECT doc_id, t, {rank} AS rank, '{kind}' AS kind, unnest(list_zip(regexp_extract_all(t, '(?s)(.*?)({pattern})', 1), regexp_extract_all(t, '(?s)(.*?)({pattern})', 2))) AS z,
         generate_subscripts(regexp_extract_all(t, '(?s)(.*?)({pattern})', 1), 1) AS i FROM d""")
    near = " ".join(f"WHEN kind = '{k}' THEN regexp_matches(t[greatest(start - 40, 0) + 1:start], '(?i)\\b(?:{words})\\b')" for k, words in pii.CONTEXT.items())
    prior = " ".join(f"WHEN kind = '{k}' THEN {p}" for k, p in pii.PRIOR.items())
    holds = " ".join(f"WHEN s.kind = '{k}' THEN {x}" for k, x in _HOLDS.items())
    counts = ", ".join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in list(_BASE)[:4])
    order = "ORDER BY start, rank"
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
raw AS ({' UNION ALL '.join(parts)}),
placed AS (SELECT doc_id, t, rank, kind, z[2] AS hit, (sum(length(z[1]) + length(z[2])) OVER (PARTITION BY doc_id, kind ORDER BY i))::BIGINT AS stop FROM raw),
s AS (SELECT doc_id, t, rank, kind, hit, stop - length(hit) AS start, stop FROM placed),
sure AS (SELECT doc_id, rank, kind, start, kind || ':' || start || ':' || stop AS told, CASE {prior} END + CASE WHEN CASE {near} END THEN 20 ELSE -10 END AS score FROM s WHERE CASE {holds} END),
ok AS (SELECT *, printf('%d.%02d', score // 100, score % 100) AS shown FROM sure WHERE score >= 50 OR kind NOT IN ('iban', 'secret')),
per AS (SELECT doc_id, {counts}, coalesce(string_agg(told, ',' {order}) FILTER (kind NOT IN ('iban', 'secret')), '') AS base, string_agg(told, ',' {order}) AS spans, string_agg(shown, ',' {order}) AS scores
        FROM ok GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_email, 0) AS n_email, coalesce(n_ip, 0) AS n_ip, coalesce(n_card, 0) AS n_card, coalesce(n_phone, 0) AS n_phone,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(scores, '') AS scores
FROM d LEFT JOIN per ON d.doc_id = per.doc_id
"""


def oracle_sql() -> dict[str, str]:
    return {"op7_pii_spans": _op7_sql(), "op10_exact_dedup": _OP10}
