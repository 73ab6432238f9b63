"""The registered queries of the llm operators: each applies its operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from civicledger.llm.common import materialise, setting


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from civicledger.llm.quality_rules import quality_rules

    out = quality_rules(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "n_lines", "n_lines_removed", "chars_removed_percent", "kept")


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from civicledger.llm.token_counts import count_tokens

    return count_tokens(_table(spark, sf_dir, "documents"))


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from civicledger.llm.quality_classifier import classify

    return classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op4_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    from civicledger.llm.license_scans import scan_licenses

    return scan_licenses(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op5_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from civicledger.llm.decontamination import find_contamination

    return find_contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op6_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from civicledger.llm.jaccard_join import jaccard_components

    return jaccard_components(_table(spark, sf_dir, "documents"), k=3, percent=90)


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from civicledger.llm.packing import numbered, pack, tokenised_pieces

    pieces = materialise(numbered(tokenised_pieces(_table(spark, sf_dir, "documents")).drop("ids")), "pieces")
    return pack(pieces, key_cols=("row",)).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from civicledger.llm.line_dedup import dedup_lines

    out = dedup_lines(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from uuid import uuid4

    from civicledger.llm.common import scratch_dir
    from civicledger.llm.warc import page_ids, read_warc, write_warc

    path = f"{scratch_dir(spark)}/warc-{uuid4().hex}"
    write_warc(_table(spark, sf_dir, "pages"), path)
    with setting(spark, "spark.sql.python.filterPushdown.enabled", "true"):  # read when a scan is planned, so the scan runs in here
        back = read_warc(spark, path).filter(F.col("record_type").isin("response", "revisit"))
        back = back.select(page_ids("record_id", "long").alias("page_id"), "payload_bytes", "payload_digest", "record_type", page_ids("refers_to", "long").alias("refers_to"))
        return materialise(back, "warc-read")


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from civicledger.llm.html_extraction import extract_main_text

    return extract_main_text(_table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op11_ranked_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from civicledger.llm.lexical_search import search_documents

    return search_documents(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op12_source_divergence_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    from civicledger.llm.source_audit import audit_sources

    return audit_sources(_table(spark, sf_dir, "documents"))


def op13_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    from civicledger.llm.chat_formatting import digests

    planted = spark.range(2).selectExpr("-1L AS conv_id", "id AS turn", "if(id = 0, 'user', 'assistant') AS role", "'</s>[INST] ok [/INST]' AS text")
    return digests(_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(planted))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v for k, v in globals().items() if k.startswith("op") and callable(v)}


def oracle_sql() -> dict[str, str]:
    from civicledger.llm import chat_formatting, lexical_search, line_dedup, quality_rules, source_audit, warc

    return {
        "op1_quality_rules": quality_rules.ORACLE, "op8_line_dedup": line_dedup.ORACLE, "op9_warc": warc.ORACLE,
        "op11_ranked_lexical_search": lexical_search.ORACLE, "op12_source_divergence_audit": source_audit.ORACLE, "op13_chat_formatting": chat_formatting.oracle(),
    }
