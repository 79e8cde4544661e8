"""Evaluation texts inside the corpus (problem 9): MinHash containment search, verified by exact shingles.

Items and documents are compared at one size: an item of any length can leak in part, and the smallest part to be found
has RUN = 13 words (nine five-word shingles), so every item is cut into passages of that size and documents are probed
with windows of that size. That takes away the bias of MinHash against containment in long texts: the sketches (several
permutations) of a leaked passage and its window are equal with certainty, so the candidate search misses nothing.
Candidates are verified by comparing their shingles. How much of an item of which size class a document holds is
reported by :func:`containment`."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lanternq.plans.scale import cut, salted_join

RUN, SHINGLE = 13, 5
#: Permutations of a sketch.
PERMUTATIONS = 3
#: The items' sketches go to the scanning tasks as a bit filter of this fixed size (8 MB), whatever their number.
FILTER_BITS = 26
WORD = regex.compile(r"[\p{L}\p{N}]+")
A, C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
SCHEMA = "id long, sketch long, shingles array<long>"


class WordHashes(dict):
    """64-bit hashes of words, kept for the words seen lately."""

    def __missing__(self, word: str) -> int:
        if len(self) > 500_000:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


def mixed(x: np.ndarray, seed: int = 0) -> np.ndarray:
    x = x + np.uint64((seed * int(A)) & (1 << 64) - 1)
    x = (x ^ (x >> np.uint64(32))) * C
    return x ^ (x >> np.uint64(29))


def shingles(h: np.ndarray) -> np.ndarray:
    """The hash of every SHINGLE successive words (given by their hashes)."""
    m, acc = len(h) - SHINGLE + 1, np.zeros(max(0, len(h) - SHINGLE + 1), np.uint64)
    for j in range(SHINGLE):
        acc = acc * A + h[j : j + m]
    return mixed(acc)


def sketches_of(s: np.ndarray) -> np.ndarray:
    """Of every RUN words, the MinHashes of their shingles under each permutation, folded into one number."""
    width = RUN - SHINGLE + 1
    m = len(s) - width + 1
    sketch = np.zeros(m, np.uint64)
    for p in range(PERMUTATIONS):
        x = mixed(s, p + 1)
        low = x[:m].copy()
        for j in range(1, width):
            np.minimum(low, x[j : j + m], out=low)
        sketch = mixed(sketch ^ low, 99)
    return sketch


def _sketcher(wanted):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, width = WordHashes(), RUN - SHINGLE + 1
        bits = None if wanted is None else wanted.value
        for batch in batches:
            ids, sketch, parts = [], [], []
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = WORD.findall(text.lower()) if text else ()
                if len(words) < RUN:
                    continue
                s = shingles(np.array([known[w] for w in words], np.uint64))
                found = sketches_of(s)
                at = np.arange(len(found))
                if bits is not None:
                    at = at[_in(bits, found)]
                    if not len(at):
                        continue
                ids.append(np.full(len(at), i, np.int64))
                sketch.append(found[at].view(np.int64))
                parts.append(np.lib.stride_tricks.sliding_window_view(s, width)[at].view(np.int64).ravel())
            if ids:
                flat = pa.array(np.concatenate(parts))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, width, dtype=np.int32)), flat)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(ids)), pa.array(np.concatenate(sketch)), lists], ["id", "sketch", "shingles"])

    return run


def sketches(texts: DataFrame, id_col: str, text_col: str = "text", wanted=None) -> DataFrame:
    """``id, sketch, shingles`` of every window of RUN words of every text; only those that may be wanted, if a filter
    (:func:`bit_filter`) is given."""
    return texts.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(_sketcher(wanted), SCHEMA)


def _in(bits: np.ndarray, sketch: np.ndarray) -> np.ndarray:
    at = sketch >> np.uint64(64 - 5 - len(bits).bit_length())
    return (bits[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) == 1


def bit_filter(index: DataFrame) -> np.ndarray:
    """The sketches of ``index`` as bits of a table of 2**FILTER_BITS. The words of the table are combined in Spark; at
    most 2**(FILTER_BITS - 6) of them reach the driver."""
    at = F.shiftrightunsigned("sketch", 64 - FILTER_BITS)
    words = index.groupBy(F.shiftrightunsigned(at, 6).alias("word")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(shiftrightunsigned(sketch, {64 - FILTER_BITS}) % 64 as int))")).alias("bits")).toPandas()
    table = np.zeros(1 << (FILTER_BITS - 6), np.uint64)
    table[words["word"].to_numpy().astype(np.int64)] = words["bits"].to_numpy().astype(np.int64).view(np.uint64)
    return table


def passages(docs: DataFrame, items: DataFrame) -> DataFrame:
    """``doc_id, item_id, sketch``: the items' passages found in documents, candidates by sketch that have the same
    shingles. One plan for any number of items: documents stream past a filter of fixed size, and what may match is
    joined by sketch, salted if the items' sketches are too many to be broadcast."""
    spark = docs.sparkSession
    index = cut(sketches(items, "item_id").distinct().withColumnRenamed("id", "item_id"))
    wanted = spark.sparkContext.broadcast(bit_filter(index))
    found = salted_join(sketches(docs, "doc_id", wanted=wanted), index.withColumnRenamed("shingles", "item_shingles"), ["sketch"], "id", row_bytes=120)
    return found.where(F.col("shingles") == F.col("item_shingles")).select(F.col("id").alias("doc_id"), "item_id", "sketch")


def leaks(docs: DataFrame, items: DataFrame) -> DataFrame:
    """``doc_id, item_id``: the document and the item share a run of at least 13 words. Null texts and texts under 13
    words share none; repeated rows give one case."""
    return passages(docs, items).select("doc_id", "item_id").distinct()


def containment(docs: DataFrame, items: DataFrame) -> DataFrame:
    """``item_id, size_class, n_docs, most``: of every item that leaked, its size class (items of RUN to 2 RUN words are
    class 0, twice as long ones class 1, ...), the number of documents that hold a part, and the largest share of its
    passages that one document holds."""
    index = sketches(items, "item_id").select(F.col("id").alias("item_id"), "sketch").distinct().groupBy("item_id").agg(F.count("*").alias("n"))
    held = passages(docs, items).distinct().groupBy("item_id", "doc_id").agg(F.count("*").alias("k")).groupBy("item_id").agg(F.count("*").alias("n_docs"), F.max("k").alias("k"))
    size = F.floor(F.log2((F.col("n") + RUN - 1) / RUN)).cast("int")
    return held.join(index, "item_id").select("item_id", size.alias("size_class"), "n_docs", F.round(F.col("k") / F.col("n"), 6).alias("most"))
