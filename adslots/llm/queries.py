"""Registered queries of the training-data operators, each over its whole table, and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, decontaminate, htmltext, lines, lmscore, mixing, near, oracles, pii, quality, sharding, spelling, suffix, urls
from .common import table


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.shard_documents(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mix_documents(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "source_size", "target", "taken")


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.judge_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["stop"] - s["start"])
    return out.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
        F.size("near").cast("long").alias("n_near_items"),
    )


def op1_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near.classify(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_links", "first_id")


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.dedup_documents(table(spark, sf_dir, "documents"))


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge_urls(table(spark, sf_dir, "pages"))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The key is a parameter of the operator; this one is only for the query's reruns to agree."""
    return pii.pseudonymise(table(spark, sf_dir, "documents"), key="rerun key")


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lmscore.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = htmltext.extract(table(spark, sf_dir, "pages"))
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op11_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lines.dedup_lines(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.group_variants(table(spark, sf_dir, "documents"))


def op13_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align_documents(table(spark, sf_dir, "documents"))


QUERIES = {
    "op2_html_extraction": op2_html_extraction,
    "op9_lm_scoring": op9_lm_scoring,
    "op8_pii": op8_pii,
    "op3_url_filter": op3_url_filter,
    "op7_suffix_dedup": op7_suffix_dedup,
    "op1_jaccard_join": op1_jaccard_join,
    "op5_decontamination": op5_decontamination,
    "op6_quality": op6_quality,
    "op4_sharding": op4_sharding,
    "op10_mixing": op10_mixing,
    "op11_line_dedup": op11_line_dedup,
    "op12_spelling_variants": op12_spelling_variants,
    "op13_tokenizer_alignment": op13_tokenizer_alignment,
}

ORACLES: dict[str, str] = {
    "op3_url_filter": oracles.OP3,
    "op5_decontamination": oracles.OP5,
    "op6_quality": oracles.OP6,
    "op11_line_dedup": oracles.OP11,
}
