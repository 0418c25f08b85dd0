"""The thin queries opN_<name> of the corpus operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sidetrace.llm import chat, dac, decontam, html, jaccard, licenses, lm, media, packing, toxicity
from sidetrace.llm.common import fixed, table
from sidetrace.llm.oracles import ORACLE_SQL  # noqa: F401


#: The conversation that op1 formats beside those of the table.
CONTROL_TEXT = "</s>[INST] ok [/INST]"


def op1_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = fixed(spark, [(-1, 0, "user", CONTROL_TEXT), (-1, 1, "assistant", CONTROL_TEXT)], "conv_id long, turn long, role string, text string")
    return chat.digests(chat.format_trees(chat.conversation_messages(rows.union(extra))))


def op2_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The target is what the labels call good; the background is all other documents."""
    good = table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    return lm.cross_entropy_difference(table(spark, sf_dir, "documents"), good)


def op3_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.digests(media.store_text(table(spark, sf_dir, "documents")))


def op4_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract_pages(table(spark, sf_dir, "pages"))


def op5_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), n=8, coverage=0.5)


def op6_dac(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dac.round_trip(table(spark, sf_dir, "documents"), end_id=0)


def op7_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_join(table(spark, sf_dir, "documents"), n=4, percent=85)


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(licenses.document_paths(table(spark, sf_dir, "documents")))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return toxicity.toxicity(docs, table(spark, sf_dir, "labels")).drop("text")


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), capacity=1024, end_id=2)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_chat": op1_chat,
    "op2_lm": op2_lm,
    "op3_media": op3_media,
    "op4_html": op4_html,
    "op5_decontam": op5_decontam,
    "op6_dac": op6_dac,
    "op7_jaccard": op7_jaccard,
    "op8_licenses": op8_licenses,
    "op9_toxicity": op9_toxicity,
    "op10_packing": op10_packing,
}
