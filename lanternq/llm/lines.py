"""Lines repeated across the documents of one source (problem 3)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lanternq.plans.scale import cut, digest, salted_join

#: A line is frequent when it stands in at least MIN_DOCS and at least MIN_SHARE of its source's documents.
MIN_DOCS, MIN_SHARE = 5, 0.05


def line_key(line: Column) -> Column:
    """What two lines must share to be the same: their letters and digits, case ignored (ß as ss)."""
    return F.regexp_replace(F.replace(F.lower(line), F.lit("ß"), F.lit("ss")), r"[^\p{L}\p{N}]+", "")


def document_lines(docs: DataFrame) -> DataFrame:
    """``doc_id, source, line_no, line, h1, h2`` of every line with a letter or digit of documents with a source.
    Null texts and sources give no lines."""
    lines = docs.where("source is not null and text is not null").select("doc_id", "source", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    lines = lines.withColumn("key", line_key(F.col("line"))).where("key <> ''")
    h1, h2 = digest(F.col("key"))
    return lines.select("doc_id", "source", "line_no", "line", h1.alias("h1"), h2.alias("h2"))


def frequent_lines(docs: DataFrame, min_docs: int = MIN_DOCS, min_share: float = MIN_SHARE) -> DataFrame:
    """``source, h1, h2, n_docs``: distinct documents are counted per source and line hash. The first aggregation is
    keyed by document too, so one source or one line that fills a third of the corpus is spread over all tasks; the
    second adds up map-side partial counts. At most lines-per-document / min_share rows come out per source."""
    per_doc = document_lines(docs).select("source", "h1", "h2", "doc_id").distinct()
    counts = per_doc.groupBy("source", "h1", "h2").agg(F.count("*").alias("n_docs")).where(F.col("n_docs") >= min_docs)
    sizes = docs.where("source is not null").select("source", "doc_id").distinct().groupBy("source").agg(F.count("*").alias("source_docs"))
    return counts.join(sizes, "source").where(F.col("n_docs") >= F.col("source_docs") * F.lit(min_share)).select("source", "h1", "h2", "n_docs")


def repeated_lines(docs: DataFrame, min_docs: int = MIN_DOCS, min_share: float = MIN_SHARE) -> DataFrame:
    """``doc_id, line_no`` of every line that its source repeats excessively, with ``line`` and ``n_docs``."""
    frequent = cut(frequent_lines(docs, min_docs, min_share))
    return salted_join(document_lines(docs), frequent, ["source", "h1", "h2"], "doc_id", row_bytes=96)


def without_repeated_lines(docs: DataFrame, min_docs: int = MIN_DOCS, min_share: float = MIN_SHARE) -> DataFrame:
    """The documents with ``clean_text`` (frequent lines removed) and ``removed`` (how many). Every other column stays.

    Documents without a source or text keep their text. The line numbers to drop are gathered per document, which is
    bounded by that document's own length, and applied by position, so texts never travel through the shuffle twice."""
    drops = repeated_lines(docs, min_docs, min_share).groupBy("doc_id").agg(F.collect_set("line_no").alias("_drop"))
    kept = F.filter(F.split("text", "\n"), lambda line, i: ~F.array_contains(F.col("_drop"), i))
    return (
        docs.join(drops, "doc_id", "left")
        .withColumn("clean_text", F.when(F.col("_drop").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n")))
        .withColumn("removed", F.coalesce(F.size("_drop"), F.lit(0)))
        .drop("_drop")
    )
