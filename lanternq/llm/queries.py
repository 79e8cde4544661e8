"""The pN_ queries: each problem's operator over its whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lanternq.llm import boilerplate, contamination, dedup, language, lines, markup, mojibake, packing, pairs, pii
from lanternq.sources.tables import table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return pii.personal_information(pii.fields(table(spark, d, "goldset"), table(spark, d, "answers")))


def p1_redacted(spark: SparkSession, d: str) -> DataFrame:
    return pii.redacted(pii.fields(table(spark, d, "goldset"), table(spark, d, "answers")))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return boilerplate.boilerplate_lines(boilerplate.html_pages(table(spark, d, "documents")))


def p2_articles(spark: SparkSession, d: str) -> DataFrame:
    return boilerplate.articles(boilerplate.html_pages(table(spark, d, "documents"))).select("doc_id", "article")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return lines.repeated_lines(table(spark, d, "documents")).select("doc_id", F.col("line_no").cast("long").alias("line_no")).distinct()


def p3_cleaned(spark: SparkSession, d: str) -> DataFrame:
    return lines.without_repeated_lines(table(spark, d, "documents")).select("doc_id", "clean_text", "removed")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return markup.markup_rows(table(spark, d, "documents"))


def p4_cleaned(spark: SparkSession, d: str) -> DataFrame:
    return markup.cleaned(table(spark, d, "documents")).select("doc_id", "markups", "clean_text")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return dedup.copies(table(spark, d, "documents"))


def p5_collapsed(spark: SparkSession, d: str) -> DataFrame:
    return dedup.collapsed(table(spark, d, "documents"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return mojibake.garbled_documents(table(spark, d, "documents")).select("doc_id")


def p6_restored(spark: SparkSession, d: str) -> DataFrame:
    return mojibake.restored(table(spark, d, "documents")).select("doc_id", "restored")


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return pairs.defects(table(spark, d, "troubleshooting"))


def p8_packed(spark: SparkSession, d: str) -> DataFrame:
    return packing.packed(table(spark, d, "documents"), table(spark, d, "capacities"))


def p8_fill(spark: SparkSession, d: str) -> DataFrame:
    return packing.summary(p8_packed(spark, d), table(spark, d, "capacities"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return contamination.leaks(table(spark, d, "documents"), table(spark, d, "evalitems"))


def p9_containment(spark: SparkSession, d: str) -> DataFrame:
    return contamination.containment(table(spark, d, "documents"), table(spark, d, "evalitems"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return language.mislabelled(table(spark, d, "documents"))


def p10_segments(spark: SparkSession, d: str) -> DataFrame:
    return language.segments(table(spark, d, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [p1_found, p1_redacted, p2_found, p2_articles, p3_found, p3_cleaned, p4_found, p4_cleaned, p5_found, p5_collapsed, p6_found, p6_restored, p7_found, p8_packed, p8_fill, p9_found, p9_containment, p10_found, p10_segments]
    return {f.__name__: f for f in found}
