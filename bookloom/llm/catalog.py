"""The queries of this package, and the SQL that states the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bookloom.llm import bpe_codec, exact_dedup, language_id, near_dedup, packing, prefix_trie, quality_classifier, quality_rules, token_alignment, token_counts, toxicity, url_filters, warc
from bookloom.llm.common import modest_batches, scratch_path


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    modest_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(_table(spark, sf_dir, "documents"))


RULES = [url_filters.Rule(*r) for r in (("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block"))]


def op2_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No table labels pages: what an explicit rule blocks is bad, all else good, and templates are judged by that."""
    return url_filters.judge(_table(spark, sf_dir, "pages"), RULES)


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.classes(_table(spark, sf_dir, "documents"))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.dedup(_table(spark, sf_dir, "documents"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes the archives of all pages and reads them back."""
    pages = _table(spark, sf_dir, "pages")
    path = scratch_path(spark, "archives")
    warc.write_archives(pages.select(pages["page_id"].alias("record_id"), pages["url"].alias("uri"), pages["html"].alias("payload")), path)
    return warc.read_archives(spark, path, payloads=False).select(F.col("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"))


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(_table(spark, sf_dir, "documents"))


def op10_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_codec.encode_documents(_table(spark, sf_dir, "documents"), real=False)


def op11_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(_table(spark, sf_dir, "documents"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.nodes(prefix_trie.rebuilt(_table(spark, sf_dir, "conversations")))


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_alignment.align_documents(_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_quality_rules, op2_url_filters, op3_near_dedup, op4_exact_dedup, op5_quality_classifier, op6_packing, op7_toxicity, op9_warc, op8_token_counts, op10_bpe_codec, op11_language_id, op12_prefix_trie, op13_token_alignment)}


def oracle_sql() -> dict[str, str]:
    """Quality rules, exact dedup, archives and the trie; the other rows depend on trained models, tokenizers or searches."""
    return {
        "op1_quality_rules": quality_rules.sql(),
        "op4_exact_dedup": r"""WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
 SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept, sha256(t) AS text_sha256 FROM n WINDOW w AS (PARTITION BY t)""",
        "op9_warc": """WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages), d AS (SELECT page_id, strlen(h) AS payload_bytes, sha1(h) AS payload_digest, max(page_id) OVER (PARTITION BY h) AS top FROM p)
 SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= 1000 AND page_id <> top THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN payload_bytes >= 1000 AND page_id <> top THEN top END AS refers_to FROM d""",
        "op12_prefix_trie": prefix_trie.SQL,
    }
