"""Connected components, blocks of sorted rows, and a bounded Bloom filter of ids."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, map_arrow, save


def components(edges: DataFrame) -> DataFrame:
    """edges: a, b (long). node, component: the smallest node reachable, for every node that has an edge to another.

    Alternating large-star and small-star rounds on saved tables, until the star forest
    no longer changes. Minima are pre-aggregated; a hub's rows meet in a join that
    adaptive execution splits, never in one group.
    """
    e = edges.filter("a <> b").select(F.greatest("a", "b").alias("node"), F.least("a", "b").alias("top")).distinct()
    e, was = save(e, "edges"), None
    while True:
        both = e.select(F.col("node").alias("u"), F.col("top").alias("v")).union(e.select("top", "node"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("node"), F.col("m").alias("top")).distinct()
        low = large.groupBy("node").agg(F.min("top").alias("m"))
        small = large.join(low, "node").filter("top <> m").select(F.col("top").alias("node"), "m").union(low.select("node", "m")).distinct()
        new = save(small.select("node", F.col("m").alias("top")), "stars")
        forget(e)
        e = new
        h = F.xxhash64("node", "top")
        now = tuple(e.agg(F.count("*"), F.bit_xor(h), F.sum(F.shiftright(h, 20))).first())
        if now == was:
            return e.withColumnRenamed("top", "component")
        was = now


def fixed_bytes(column: pa.Array, width: int) -> np.ndarray:
    """A binary column of one width as an (n, width) array."""
    if not len(column):
        return np.zeros((0, width), np.uint8)
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]].reshape(len(column), width)


def blocks(batches: Iterator[pa.RecordBatch], keys: int, widths: dict[str, int]) -> Iterator[dict[str, np.ndarray]]:
    """Groups of rows equal in their first `keys` (integer) columns, from rows sorted by them, across batches."""
    held: dict[str, np.ndarray] | None = None
    for b in batches:
        if not b.num_rows:
            continue
        cols = {n: fixed_bytes(b.column(i), widths[n]) if n in widths else b.column(i).to_numpy(zero_copy_only=False) for i, n in enumerate(b.schema.names)}
        if held is not None:
            cols = {n: np.concatenate([held[n], c]) for n, c in cols.items()}
        names = b.schema.names[:keys]
        n = len(cols[names[0]])
        change = np.zeros(n - 1, bool)
        for k in names:
            change |= cols[k][1:] != cols[k][:-1]
        at = np.concatenate([[0], np.flatnonzero(change) + 1]).tolist()
        for a, z in zip(at[:-1], at[1:]):
            yield {k: c[a:z] for k, c in cols.items()}
        held = {k: c[at[-1] :] for k, c in cols.items()}
    if held is not None:
        yield held


def _bits(ids: np.ndarray, log2: int) -> list[np.ndarray]:
    x = ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(31)
    x *= np.uint64(0xD6E8FEB86659FD93)
    return [(x >> np.uint64(64 - log2)).astype(np.int64), ((x * np.uint64(0xC2B2AE3D27D4EB4F)) >> np.uint64(64 - log2)).astype(np.int64)]


def id_filter(ids: DataFrame, most_log2: int = 27) -> Callable[[np.ndarray], np.ndarray]:
    """ids: one long column. A function ids -> maybe among them, from a Bloom filter of at most 2^most_log2 bits (16 MB).

    It only prunes; a join must follow. From about 13 million ids on it prunes less and less.
    """
    n = ids.count()
    log2 = int(min(most_log2, max(16, np.ceil(np.log2(10 * max(n, 1))))))

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(1 << (log2 - 6), np.uint64)
        for b in batches:
            for x in _bits(b.column(0).to_numpy(zero_copy_only=False), log2):
                np.bitwise_or.at(bits, x >> 6, np.uint64(1) << (x & 63).astype(np.uint64))
        at = np.flatnonzero(bits)
        for a in range(0, len(at), 100_000):
            some = at[a : a + 100_000]
            yield pa.record_batch([pa.array(some), pa.array(bits[some].view(np.int64))], ["at", "bits"])

    packed = np.zeros(1 << (log2 - 6), "<i8")
    # bounded by the filter's size, whatever the number of ids
    got = map_arrow(ids.filter(F.col(ids.columns[0]).isNotNull()), words, "at long, bits long").groupBy("at").agg(F.bit_or("bits").alias("bits")).toArrow()
    packed[got["at"].to_numpy()] = got["bits"].to_numpy()
    shared = ids.sparkSession.sparkContext.broadcast(packed)

    def among(x: np.ndarray) -> np.ndarray:
        p = shared.value.view(np.uint8)
        a, b = _bits(x, log2)
        return ((p[a >> 3] >> (a & 7).astype(np.uint8)) & (p[b >> 3] >> (b & 7).astype(np.uint8)) & 1).astype(bool)

    return among
