"""Documents in containers of fixed capacity (problem 8): packed along a Hilbert curve.

Documents are measured in tokens of a public tokenizer and hashed to vectors, which are projected to a few dimensions
and placed on a Hilbert curve. Range-sorting by the curve brings similar documents together; each stretch of the curve
is packed by best fit decreasing, so that containers hold neighbours and little space is lost."""

from __future__ import annotations

import base64
import bisect
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lanternq.plans.scale import cut

#: The public tokenizer (ranks of a byte-level BPE); its path is a parameter, the file is never copied.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: how that vocabulary's texts are cut before merging.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
DIMENSIONS, BITS = 4, 8
#: Documents of one stretch of the curve are packed together; a stretch holds this many, the last one up to twice as many.
STRETCH = 4096


def encoder(path: str = VOCABULARY):
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def hilbert_key(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Positions of integer points (n x d, each below 2**bits) on the Hilbert curve, by Skilling's transform."""
    x = points.astype(np.int64).T.copy()
    d, m = len(x), 1 << (bits - 1)
    q = m
    while q > 1:
        p = q - 1
        for i in range(d):
            up = (x[i] & q) != 0
            t = np.where(up, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(up, x[0] ^ p, x[0] ^ t)
            x[i] ^= t
        q >>= 1
    for i in range(1, d):
        x[i] ^= x[i - 1]
    t, q = np.zeros_like(x[0]), m
    while q > 1:
        t = np.where((x[d - 1] & q) != 0, t ^ (q - 1), t)
        q >>= 1
    x ^= t
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(d):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


def _direction(path: str, n: int) -> np.ndarray:
    """A fixed pseudo-random direction (one row of DIMENSIONS signs) for every token: the hashing projection."""
    h = np.array([xxhash.xxh64_intdigest(i.to_bytes(4, "little"), seed=len(path.rsplit("/", 1)[-1])) for i in range(n)], np.uint64)
    return (((h[:, None] >> np.arange(DIMENSIONS, dtype=np.uint64)) & np.uint64(1)).astype(np.float32) * 2 - 1).astype(np.float32)


def _measure(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        signs = _direction(path, enc.n_vocab)
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1).to_pylist()
            counts, points = np.zeros(len(texts), np.int64), np.zeros((len(texts), DIMENSIONS), np.float32)
            for k, text in enumerate(texts):
                if text:
                    tokens = np.array(enc.encode_ordinary(text), np.int64)
                    counts[k] = len(tokens)
                    points[k] = signs[tokens].sum(0)
            length = np.sqrt(np.maximum(counts, 1))[:, None]
            grid = np.clip((points / (3 * length) + 0.5) * (1 << BITS), 0, (1 << BITS) - 1)
            yield pa.RecordBatch.from_arrays([ids, pa.array(counts), pa.array(hilbert_key(grid.astype(np.int64)))], ["doc_id", "n_tokens", "key"])

    return run


def measured(docs: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """``doc_id, n_tokens, key``: size in tokens and place on the curve. Null and empty texts have size 0."""
    return docs.select("doc_id", "text").mapInArrow(_measure(path), "doc_id long, n_tokens long, key long")


def best_fit_decreasing(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The container of each item: largest first, each into the fullest container that still takes it."""
    out = np.empty(len(sizes), np.int64)
    free: list[tuple[int, int]] = []
    n = 0
    for i in np.lexsort((np.arange(len(sizes)), -sizes)):
        size = int(sizes[i])
        at = bisect.bisect_left(free, (size, -1))
        if at < len(free):
            room, b = free.pop(at)
        else:
            room, b, n = capacity, n, n + 1
        out[i] = b
        bisect.insort(free, (room - size, b))
    return out


def _pack(kinds: list[tuple[str, int]], ids: np.ndarray, sizes: np.ndarray, stretch: int) -> list[pa.Array]:
    """One stretch of the curve in containers of every kind, as columns."""
    columns: list[list] = [[] for _ in range(7)]
    for name, capacity in kinds:
        pieces = np.maximum(1, -(-sizes // capacity))
        who = np.repeat(np.arange(len(sizes)), pieces)
        piece = np.arange(len(who)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        size = np.minimum(capacity, sizes[who] - piece * capacity)
        for k, v in enumerate((np.full(len(who), name, object), np.full(len(who), stretch), best_fit_decreasing(size, capacity), ids[who], piece.astype(np.int32), piece * capacity, size)):
            columns[k].append(v)
    return [pa.array(np.concatenate(c)) for c in columns]


def _packer(kinds: list[tuple[str, int]], length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        names = ["container", "stretch", "bin", "doc_id", "piece", "first_token", "n_tokens"]
        part, n, ids, sizes = TaskContext.get().partitionId(), 0, np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            ids, sizes = np.concatenate([ids, batch.column(0).to_numpy()]), np.concatenate([sizes, batch.column(1).to_numpy()])
            while len(ids) >= 2 * length:
                yield pa.RecordBatch.from_arrays(_pack(kinds, ids[:length], sizes[:length], (part << 32) + n), names)
                ids, sizes, n = ids[length:], sizes[length:], n + 1
        if len(ids):
            yield pa.RecordBatch.from_arrays(_pack(kinds, ids, sizes, (part << 32) + n), names)

    return run


def packed(docs: DataFrame, capacities: DataFrame, path: str = VOCABULARY, stretch: int = STRETCH) -> DataFrame:
    """``container, stretch, bin, doc_id, piece, first_token, n_tokens``: every document once in a container of every
    capacity, numbered by (stretch, bin). Only a document larger than the capacity is split, into full pieces and a
    rest. The texts are tokenized once, where they lie; ids, sizes and curve keys alone are sorted, into as many ranges
    of the curve as the session has shuffle partitions, and every range is cut by rank into stretches of ``stretch``
    to twice as many documents. The id is part of the order, so equal keys don't pile up in one range.

    ``capacities`` is a fixed list of container kinds (a handful of rows), read by the driver; documents without text
    take a place of size 0, rows repeated for one id count once, with the largest size."""
    kinds = [(r["container"], int(r["capacity"])) for r in capacities.where("capacity > 0").dropDuplicates(["container"]).orderBy("container").collect()]
    spark = docs.sparkSession
    sizes = measured(docs, path).groupBy("doc_id").agg(F.max(F.struct("n_tokens", "key")).alias("m")).select("doc_id", "m.n_tokens", "m.key")
    sizes = cut(sizes)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts = max(1, min(parts, sizes.count() // stretch))
    ranged = sizes.repartitionByRange(parts, "key", F.xxhash64("doc_id")).sortWithinPartitions("key", F.xxhash64("doc_id")).select("doc_id", "n_tokens")
    schema = "container string, stretch long, bin long, doc_id long, piece int, first_token long, n_tokens long"
    return ranged.mapInArrow(_packer(kinds, stretch), schema)


def summary(assignment: DataFrame, capacities: DataFrame) -> DataFrame:
    """``container, capacity, n_bins, n_pieces, tokens, least_bins, fill``: how full the containers of each kind are,
    beside the number that could not be undercut (all tokens over the capacity)."""
    per_bin = assignment.groupBy("container", "stretch", "bin").agg(F.count("*").alias("pieces"), F.sum("n_tokens").alias("load"))
    per = per_bin.groupBy("container").agg(F.count("*").alias("n_bins"), F.sum("pieces").alias("n_pieces"), F.sum("load").alias("tokens"))
    out = per.join(F.broadcast(capacities.select("container", "capacity").distinct()), "container")
    return out.select("container", "capacity", "n_bins", "n_pieces", "tokens", F.ceil(F.col("tokens") / F.col("capacity")).alias("least_bins"), F.round(F.col("tokens") / (F.col("n_bins") * F.col("capacity")), 6).alias("fill"))
