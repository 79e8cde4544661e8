"""Changes to chunk and index tables (D1-D7, U1-U3), as joins that leave unchanged rows where they are."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def first_of(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """One row per key, the first in order."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("_n = 1").drop("_n")


def add(chunks: DataFrame, new: DataFrame) -> DataFrame:
    """New chunks replace those of the same id."""
    return chunks.join(new.select("chunk_id"), "chunk_id", "left_anti").unionByName(new)


def upsert(chunks: DataFrame, new: DataFrame, by: str = "doc_id", where: DataFrame | None = None) -> DataFrame:
    """All chunks of the new chunks' documents are replaced (by ``doc_id``, or by ``source`` for pages that were
    edited in place). ``where`` names further documents whose chunks go, such as those that no longer have any."""
    gone = new.select(by).distinct() if where is None else new.select(by).union(where.select(by)).distinct()
    return chunks.join(gone, by, "left_anti").unionByName(new)


def upsert_document(chunks: DataFrame, doc_id: str, new: DataFrame) -> tuple[DataFrame, int, int]:
    """D2 for one document: the chunks after its old ones were replaced, how many went and how many came. A new chunk of
    another document raises ValueError."""
    if new.where(~F.col("doc_id").eqNullSafe(F.lit(doc_id))).limit(1).count():
        raise ValueError(f"chunks of other documents than {doc_id!r}")
    return chunks.where(~F.col("doc_id").eqNullSafe(F.lit(doc_id))).unionByName(new), chunks.where(F.col("doc_id") == doc_id).count(), new.count()


def checked_vectors(vectors: DataFrame, dim: int, chunks: DataFrame | None = None) -> DataFrame:
    """Vectors as they are; one of another dimension, or (with ``chunks``) a chunk without a vector or the other way
    round, raises ValueError."""
    if vectors.where(F.col("vector").isNull() | (F.size("vector") != dim)).limit(1).count():
        raise ValueError(f"vectors are not of dimension {dim}")
    if chunks is not None and (chunks.join(vectors, "chunk_id", "left_anti").limit(1).count() or vectors.join(chunks, "chunk_id", "left_anti").limit(1).count()):
        raise ValueError("chunks and vectors don't match")
    return vectors


def delete(chunks: DataFrame, doc_ids: DataFrame) -> DataFrame:
    """Without the chunks of some documents; unknown ids change nothing."""
    return chunks.join(doc_ids.select("doc_id").distinct(), "doc_id", "left_anti")


def changed_frequencies(terms: DataFrame, removed: DataFrame, added: DataFrame) -> DataFrame:
    """Document frequencies after postings were removed and added, by their difference alone; a term that no chunk
    holds any more is dropped."""
    delta = removed.groupBy("term").agg((-F.count("*")).alias("df")).unionByName(added.groupBy("term").agg(F.count("*").alias("df")))
    return terms.unionByName(delta).groupBy("term").agg(F.sum("df").alias("df")).where("df > 0")


def upsert_stats(before: DataFrame, new: DataFrame) -> DataFrame:
    """What an upsert did, one row: documents and chunks that came, were replaced, and are there now."""
    old = before.groupBy("doc_id").agg(F.count("*").alias("old"))
    fresh = new.groupBy("doc_id").agg(F.count("*").alias("fresh"))
    both = old.join(fresh, "doc_id", "full")
    zero = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    return both.agg(
        zero(F.when(F.col("fresh").isNotNull(), 1)).alias("documents"),
        zero(F.when(F.col("fresh").isNotNull() & F.col("old").isNull(), 1)).alias("documents_new"),
        zero(F.when(F.col("old").isNull(), F.col("fresh"))).alias("chunks_added"),
        zero(F.when(F.col("fresh").isNotNull(), F.col("old"))).alias("chunks_replaced"),
        zero(F.coalesce("fresh", "old")).alias("chunks_total"),
    )


def stats(chunks: DataFrame) -> DataFrame:
    """Chunks, documents, mean (one decimal) and greatest number of characters."""
    n = F.length(F.coalesce("text", F.lit("")))
    return chunks.agg(F.count("*").alias("chunks"), F.countDistinct("doc_id").alias("documents"), F.coalesce(F.round(F.avg(n), 1), F.lit(0.0)).alias("mean_chars"), F.coalesce(F.max(n), F.lit(0)).alias("max_chars"))


def get(chunks: DataFrame, *chunk_ids: str) -> DataFrame:
    """Chunks by id."""
    return chunks.where(F.col("chunk_id").isin(*chunk_ids))


def contains(chunks: DataFrame, chunk_id: str) -> bool:
    """Whether there is a chunk of this id."""
    return bool(get(chunks, chunk_id).limit(1).count())


def vector(vectors: DataFrame, chunk_id: str) -> list[float] | None:
    """A chunk's vector, or None."""
    row = get(vectors, chunk_id).select("vector").first()
    return row and list(row["vector"])


def doc_ids(chunks: DataFrame) -> DataFrame:
    """The documents there are."""
    return chunks.select("doc_id").distinct()
