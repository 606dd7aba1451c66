"""The subpackage's registered queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kbspark.llm import chat, decontaminate, divergence, filter_audit, html_text, language_id, line_dedup, mixing, near_dup, nearest, packing, secrets, toxicity
from kbspark.llm.common import table


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.digest(near_dup.near_duplicates(table(spark, sf_dir, "documents")))


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.scan(table(spark, sf_dir, "documents")))


def op3_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return html_text.digest(html_text.extract(pages, html_text.train(pages)))


def op4_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.digest(decontaminate.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.split_and_identify(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = "</s>[INST] ok [/INST]"
    probe = spark.createDataFrame([(-1, 0, "user", text), (-1, 1, "assistant", text)], "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(probe)
    return chat.digest(chat.format_chats(rows))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.digest(line_dedup.dedup_lines(table(spark, sf_dir, "documents")))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return toxicity.digest(toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels"))))


def op10_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.digest(packing.pack(table(spark, sf_dir, "documents")))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.digest(mixing.mix(table(spark, sf_dir, "documents")))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.divergence(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_near_dedup, op2_secret_scan, op3_html_text, op4_nearest, op5_decontaminate, op6_line_dedup, op7_language_id, op8_chat_format, op9_toxicity, op10_pack, op11_filter_audit, op12_source_mix, op13_source_divergence)}
ORACLES: dict[str, str] = {"op4_nearest": nearest.ORACLE, "op5_decontaminate": decontaminate.ORACLE, "op6_line_dedup": line_dedup.ORACLE, "op8_chat_format": chat.ORACLE, "op11_filter_audit": filter_audit.ORACLE, "op13_source_divergence": divergence.ORACLE}
