"""Registered queries of the training-data operators, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import (bpe, conversations, decontaminate, hnsw, html_crf, jaccard, langid, merkle, pii, secret_scan, simhash,
               substrings, toxicity)
from .oracle import MANIFEST_SQL, REPAIR_SQL
from .spans import duck_digest, duck_spans


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_crf.extract_digest(_table(spark, sf_dir, "pages"))


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_digest(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op3_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.link_digest(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op4_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.repeats_digest(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pii_digest(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op7_hnsw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hnsw.nearest_digest(_table(spark, sf_dir, "embeddings"))


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.language_digest(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "pages"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity_digest(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.secrets_digest(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op11_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest_digest(_table(spark, sf_dir, "documents"))


def op12_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.repair_digest(_table(spark, sf_dir, "conversations"))


def op13_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_digest(_table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_extract": op1_extract,
    "op2_bpe": op2_bpe,
    "op3_jaccard": op3_jaccard,
    "op4_substrings": op4_substrings,
    "op5_pii": op5_pii,
    "op6_decontaminate": op6_decontaminate,
    "op7_hnsw": op7_hnsw,
    "op8_language": op8_language,
    "op9_toxicity": op9_toxicity,
    "op10_secrets": op10_secrets,
    "op11_manifest": op11_manifest,
    "op12_conversations": op12_conversations,
    "op13_simhash": op13_simhash,
}

# ------------------------------------------------------------------ DuckDB

_DIGITS = "regexp_replace(m, '[ -]', '', 'g')"
_LUHN = (f"list_sum(list_transform(string_split(reverse({_DIGITS}), ''), lambda d, i: CASE WHEN i % 2 = 1 THEN d::INT "
         "WHEN d::INT > 4 THEN 2 * d::INT - 9 ELSE 2 * d::INT END)) % 10 = 0")
_CODE = "replace(m, ' ', '')"
_MOD97 = (f"list_reduce(list_concat([0], list_transform(string_split({_CODE}[5:] || {_CODE}[:4], ''), lambda c: "
          "CASE WHEN ascii(c) >= 65 THEN ascii(c) - 55 ELSE ascii(c) - 48 END)), "
          "lambda a, v: (a * CASE WHEN v >= 10 THEN 100 ELSE 10 END + v) % 97) = 1")
_DUCK_VALID = {
    "email": "true",
    "ip": "list_bool_and(list_transform(string_split(m, '.'), lambda x: length(ltrim(x, '0')) < 4 "
          "AND ('0' || left(ltrim(x, '0'), 3))::INT < 256))",
    "card": f"length({_DIGITS}) BETWEEN 12 AND 19 AND {_LUHN}",
    "phone": "length(regexp_replace(m, '[^0-9]', '', 'g')) BETWEEN 9 AND 15",
    "iban": f"NOT regexp_matches(right(x, 1) || left(y, 1), '[A-Za-z0-9]') AND length({_CODE}) BETWEEN 15 AND 34 "
            f"AND {_MOD97}",
}
# Rules again, in the form that has no possessive repeats.
_DUCK_RULES = {
    "assign": (r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]+""",
               r"""length(regexp_extract(m, '^[A-Za-z_]+["'']?\x20*[:=]\x20*["'']?(.*)$', 1)) >= 12"""),
    "access": (r"AKIA[A-Z0-9]+", "length(m) >= 18"),
    "hex": (r"[0-9a-f]+", "length(m) >= 16"),
    **{r.kind: (r.pattern.replace("}+", "}"), "true") for r in secret_scan.RULES[3:]},
}


def _spans_sql(parts: list[str], fields: str, n_base: int) -> str:
    base = duck_digest(f"list_filter(s, lambda z: z.rank < {n_base})")
    return (f"SELECT doc_id, {fields}, sha256({base}) AS base_sha256, {duck_digest('s')} AS spans FROM ("
            f"SELECT doc_id, list_sort(flatten([{', '.join(parts)}])) AS s FROM ("
            "SELECT doc_id, coalesce(text, '') AS t FROM documents))")


def _counts(kinds) -> str:
    return ", ".join(f"len(list_filter(s, lambda z: z.kind = '{k}'))::BIGINT AS n_{k}" for k in kinds)


_WORDS = (r"list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', "
          r"'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '')")
CONTAMINATION_SQL = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
i AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
iw AS (SELECT DISTINCT item_id, l, unnest(list_transform(range(1, len(w) - l + 2), lambda s: array_to_string(w[s:s + l - 1], ' '))) AS g
  FROM (SELECT item_id, w, least(10, len(w)) AS l FROM i WHERE len(w) > 0)),
dw AS (SELECT doc_id, l, unnest(range(1, len(w) - l + 2)) AS s,
  unnest(list_transform(range(1, len(w) - l + 2), lambda s: array_to_string(w[s:s + l - 1], ' '))) AS g
  FROM d, (SELECT DISTINCT l FROM iw)),
hits AS (SELECT doc_id, item_id, s, dw.l AS l FROM dw JOIN iw USING (l, g)),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + l)) AS p FROM hits) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids
  FROM (SELECT DISTINCT doc_id, item_id FROM hits) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN its USING (doc_id)"""

ORACLE_SQL = {
    "op5_pii": _spans_sql([duck_spans(k, n, pii.PLAIN_PATTERNS[k], _DUCK_VALID[k])
                           for n, k in enumerate(pii.KINDS)], _counts(pii.KINDS[:4]), 4),
    "op6_decontaminate": CONTAMINATION_SQL,
    "op10_secrets": _spans_sql([duck_spans(k, n, *_DUCK_RULES[k]) for n, k in enumerate(_DUCK_RULES)],
                               _counts(secret_scan.BASE), 3),
    "op11_manifest": MANIFEST_SQL,
    "op12_conversations": REPAIR_SQL,
}
