"""Records that differ only in formatting (problem 5).

Every field value is canonicalised to its words, replaced by an integer identifier, records become tuples of integers
(sorted where the order of the fields is free), and the tuples are grouped. The identifier is a 128-bit hash of the
canonical value instead of a counter: it is the same on every executor and after every retry, needs no dictionary join,
and only the integers cross the network."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lanternq.plans.scale import cut, digest, salted_join

#: A field line starts with one or two label words and a colon ...
FIELD = r"^[^\p{L}\p{N}]*\p{L}+([^\p{L}\p{N}:]+\p{L}+){0,2}\s*:"
#: ... or holds one to four label words, a number and a few more words, whatever stands between them.
MEASURE = r"^[^\p{L}\p{N}]*(\p{L}+[^\p{L}\p{N}]+){1,4}\p{N}+([^\p{L}\p{N}]+[\p{L}\p{N}]+){0,8}[^\p{L}\p{N}]*$"
MIN_FIELDS = 3


def canonical(value: Column) -> Column:
    """The words (runs of letters and digits) of a value, case ignored (ß as ss), joined by one space."""
    return F.trim(F.regexp_replace(F.replace(F.lower(value), F.lit("ß"), F.lit("ss")), r"[^\p{L}\p{N}]+", " "))


def encoded(docs: DataFrame) -> DataFrame:
    """``doc_id, t1, t2``: each record as the fingerprint of its tuple of value identifiers. Records (at least three
    non-blank lines, all of them fields, or all after a title line) are sorted tuples of their lines; any other text
    is one value. A text without a word is encoded like the empty text; null texts give no row."""
    raw = F.filter(F.split("text", "\r?\n|\r"), lambda x: x.rlike(r"[\p{L}\p{N}]"))
    rows = docs.where("text is not null").select("doc_id", canonical(F.col("text")).alias("whole"), raw.alias("raw"))
    rest = F.slice("raw", 2, F.greatest(F.size("raw") - 1, F.lit(1)))
    record = (F.size("raw") >= MIN_FIELDS) & (F.forall("raw", lambda x: x.rlike(FIELD)) | F.forall(rest, lambda x: x.rlike(MEASURE)))
    values = F.when(record, F.transform("raw", canonical)).otherwise(F.array("whole"))
    ids = F.array_sort(F.transform(values, lambda v: F.struct(*[h.alias(n) for n, h in zip(("a", "b"), digest(v), strict=True)])))
    rows = rows.select("doc_id", ids.alias("ids"))
    t1, t2 = digest(F.col("ids"))
    return rows.select("doc_id", t1.alias("t1"), t2.alias("t2"))


def collapsed(docs: DataFrame) -> DataFrame:
    """``rep_id, n_copies``: one row per distinct text. Grouping is by compact fingerprints with map-side partial
    min and count, so a group holding a third of all rows is no larger than any other."""
    return encoded(docs).groupBy("t1", "t2").agg(F.min("doc_id").alias("rep_id"), F.countDistinct("doc_id").alias("n_copies")).select("rep_id", "n_copies")


def copies(docs: DataFrame) -> DataFrame:
    """``doc_id_a, doc_id_b``: the smallest id of each group of equal texts and every further one."""
    codes = cut(encoded(docs))
    groups = cut(codes.groupBy("t1", "t2").agg(F.min("doc_id").alias("doc_id_a"), F.max("doc_id").alias("last")).where("last > doc_id_a").drop("last"))
    pairs = salted_join(codes, groups, ["t1", "t2"], "doc_id", row_bytes=48)
    return pairs.where("doc_id > doc_id_a").select("doc_id_a", F.col("doc_id").alias("doc_id_b")).distinct()
