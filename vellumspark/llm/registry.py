"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from vellumspark.llm import decontamination, embedding_duplicates, line_dedup, near_duplicates, packing, secrets, sharding, token_counts, toxicity, url_filter
from vellumspark.llm.common import table

URL_RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/")]


def op1_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0
    out = toxicity.score_toxicity(docs, table(spark, sf_dir, "labels"))
    return out.select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op2_sharding(spark, sf_dir):
    out = sharding.shard_documents(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def op3_token_counts(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_counts.with_token_counts(docs, public_tokenizers.path("piece_bpe_32k.model"))


def op5_url_filter(spark, sf_dir):
    out = url_filter.judge_urls(table(spark, sf_dir, "pages").select("page_id", "url"), url_filter.rules_frame(spark, URL_RULES))
    return out.select("page_id", "host", "path", "rule", "verdict")


def op6_packing(spark, sf_dir):
    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op4_embedding_duplicates(spark, sf_dir):
    return embedding_duplicates.link_vectors(table(spark, sf_dir, "embeddings"))


def op7_decontamination(spark, sf_dir):
    return decontamination.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("text_hash")


def op8_near_duplicates(spark, sf_dir):
    return near_duplicates.near_duplicate_groups(table(spark, sf_dir, "documents"))


def op9_line_dedup(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup.dedup_lines(docs).select("doc_id", "n_words", "removed_words", "text")


def op10_secrets(spark, sf_dir):
    return secrets.secret_digest(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_toxicity, op2_sharding, op3_token_counts, op4_embedding_duplicates, op5_url_filter, op6_packing, op7_decontamination, op8_near_duplicates, op9_line_dedup, op10_secrets)}

_RULES_SQL = ", ".join(f"('{v}', '{r.partition('/')[0]}', '/{r.partition('/')[2]}', '{r}')" for v, r in URL_RULES)

ORACLES = {
    "op5_url_filter": f"""
        WITH rules(verdict, host, path, rule) AS (VALUES {_RULES_SQL}),
        seen AS (
            SELECT page_id,
                translate(regexp_extract(coalesce(url, ''), '^(?s:.*?)://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                regexp_extract(coalesce(url, ''), '^(?s:.*?)://[^/?#]*([^?#]*)', 1) AS path
            FROM pages),
        judged AS (
            SELECT s.*, r.rule, r.verdict, row_number() OVER (PARTITION BY s.page_id ORDER BY length(r.rule) DESC NULLS LAST) AS k
            FROM seen s LEFT JOIN rules r ON (s.host = r.host OR ends_with(s.host, '.' || r.host)) AND starts_with(s.path, r.path))
        SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM judged WHERE k = 1""",
}
