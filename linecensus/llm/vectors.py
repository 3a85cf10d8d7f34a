"""Embedding near-dedup by cross-polytope hashing.

A vector, padded to a power of two, is turned by three rounds of random signs and a fast
Hadamard transform; the cross-polytope vertex nearest to the result (the coordinate of
largest size, and its sign) is one hash. A table's code joins `k` of them, where k grows
with the logarithm of the rows of a label so that buckets stay small. Besides its home
bucket each vector probes, in each table, the buckets where one hash takes the second
nearest vertex; two vectors are candidates if one's home is among the other's buckets.
The number of tables follows from a simulation at the threshold: pairs at exactly that
cosine are missed with probability MISS at most, closer ones more rarely. Every candidate
pair is verified by its cosine in double precision.

Equal vectors of a label form a class and never become pairs. Buckets are compared in
blocks of at most 2 * BLOCK rows, so a hot bucket is dealt out; from a block come only
sums of links and a star for each of its components. A pair that meets in several buckets
is counted in the first of them, which both vectors' codes tell.

Defined results: vectors that are null, empty, zero or hold null or non-finite components,
and those without a label, link with nothing (n_links 0, a component of their own);
vectors of different length never link; rows with one id count as one vertex of the graph;
a row without an id takes the smallest id it reaches, null if there is none. Repeated rows
each give a row and are linked with each other. Ties do not arise: a cosine is at the
threshold or above, or below. Vectors of any length fit, one row at a time. Columns other
than id, vector and label are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, parts, save
from .graph import blocks, components

THRESHOLD = 0.93
MISS = 1e-5
BUCKET = 64
BLOCK = 512


@lru_cache(maxsize=4)
def _signs(tables: int, k: int, size: int) -> np.ndarray:
    return np.random.default_rng(977).choice([-1.0, 1.0], (tables, k, 3, size))


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of the last axis, scaled to keep lengths."""
    n, h = x.shape[-1], 1
    while h < n:
        y = x.reshape(*x.shape[:-1], n // (2 * h), 2, h)
        x = np.stack([y[..., 0, :] + y[..., 1, :], y[..., 0, :] - y[..., 1, :]], axis=-2).reshape(*x.shape)
        h *= 2
    return x / np.sqrt(n)


def codes(x: np.ndarray, tables: int, k: int) -> np.ndarray:
    """(rows, tables, 1 + k) codes of unit vectors: home, then the probes. A code holds its table's number."""
    size = 1 << max(1, (x.shape[1] - 1).bit_length())
    x = np.pad(x, ((0, 0), (0, size - x.shape[1])))
    out = np.zeros((len(x), tables, 1 + k), np.int64)
    rows = np.arange(len(x))
    for t in range(tables):
        best, second = np.zeros((k, len(x)), np.int64), np.zeros((k, len(x)), np.int64)
        for j in range(k):
            y = x
            for s in _signs(tables, k, size)[t, j]:
                y = hadamard(y * s)
            for to in (best, second):
                at = np.abs(y).argmax(axis=1)
                to[j] = 2 * at + (y[rows, at] < 0)
                y = y.copy()
                y[rows, at] = 0
        for p in range(1 + k):
            code = np.full(len(x), t, np.int64)
            for j in range(k):
                code = code * (2 * size) + (second[j] if p == j + 1 else best[j])
            out[:, t, p] = code
    return out


@lru_cache(maxsize=8)
def tables_for(dim: int, k: int, threshold: float = THRESHOLD, miss: float = MISS) -> int:
    """How many tables miss a pair at the threshold with probability `miss` at most, by simulation."""
    rng = np.random.default_rng(31)
    n, trial = 2000, 8
    a, b = rng.normal(size=(n, dim)), rng.normal(size=(n, dim))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b -= (a * b).sum(1, keepdims=True) * a
    b = threshold * a + np.sqrt(1 - threshold**2) * b / np.maximum(1e-12, np.linalg.norm(b, axis=1, keepdims=True))
    x, y = codes(a, trial, k), codes(b, trial, k)
    met = (x[:, :, :1] == y).any(axis=2) | (y[:, :, :1] == x).any(axis=2)
    p = min(0.999, met.mean() - 2 * met.std() / np.sqrt(met.size))
    return int(np.ceil(np.log(miss) / np.log(1 - p)))


def _unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _code_type(dim: int, tables: int, k: int) -> np.dtype:
    """The smaller integer that holds every code."""
    size = 1 << max(1, (dim - 1).bit_length())
    return np.dtype(np.int32 if tables * (2 * size) ** k < 2**31 else np.int64)


def _signed(dim: int, tables: int, k: int, kind: np.dtype) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for a in range(0, b.num_rows, 2000):
                part = b.slice(a, 2000)
                x = part.column(4).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim).astype(kind)
                c = codes(_unit(x), tables, k).reshape(len(x), -1)
                short = c.astype(_code_type(dim, tables, k))
                yield pa.record_batch([*part.columns[:4], pa.array([v.tobytes() for v in x], pa.binary()), pa.array([v.tobytes() for v in short], pa.binary()), pa.array(list(c), pa.list_(pa.int64()))], ["class", "label", "id", "copies", "vector", "codes", "list"])

    return run


def _first_meeting(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The code of the bucket in which each pair of rows of (tables, 1 + k) codes is counted."""
    hx, hy = x[:, :, 0], y[:, :, 0]
    x_in_y, y_in_x = (hx[:, :, None] == y).any(axis=2), (hy[:, :, None] == x).any(axis=2)
    t = (x_in_y | y_in_x).argmax(axis=1)
    r = np.arange(len(x))
    top = np.iinfo(np.int64).max
    return np.minimum(np.where(x_in_y[r, t], hx[r, t], top), np.where(y_in_x[r, t], hy[r, t], top))


def _linked(dim: int, tables: int, k: int, kind: np.dtype, threshold: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Blocks (label, code, i, j) -> rows (0, class, links) and (1, id, smallest id of its component here)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = _code_type(dim, tables, k)
        for g in blocks(batches, 4, {"vector": kind.itemsize * dim, "codes": code.itemsize * tables * (1 + k)}):
            i, j, m = g["i"][0], g["j"][0], len(g["class"])
            x = _unit(np.ascontiguousarray(g["vector"]).view(kind).reshape(m, dim))
            c = np.ascontiguousarray(g["codes"]).view(code).astype(np.int64).reshape(m, tables, 1 + k)
            left, right = np.flatnonzero(g["chunk"] == i), np.flatnonzero(g["chunk"] == j)
            near = x[left] @ x[right].T >= threshold
            near &= g["home"][left, None] | g["home"][None, right]
            if i == j:
                near &= left[:, None] < right[None, :]
            a, b = np.nonzero(near)
            if not len(a):
                continue
            a, b = left[a], right[b]
            links = np.zeros(m, np.int64)
            for s in range(0, len(a), 20_000):
                p, q = a[s : s + 20_000], b[s : s + 20_000]
                here = _first_meeting(c[p], c[q]) == g["code"][0]
                np.add.at(links, p[here], g["copies"][q[here]])
                np.add.at(links, q[here], g["copies"][p[here]])
            low = g["id"].copy()
            while True:  # components of the block, by smallest ids
                was = low.copy()
                np.minimum.at(low, a, was[b])
                np.minimum.at(low, b, low[a])
                if (low == was).all():
                    break
            some, star = np.flatnonzero(links), np.flatnonzero(low != g["id"])
            yield pa.record_batch([pa.array(np.repeat([0, 1], [len(some), len(star)]).astype(np.int32)), pa.array(np.concatenate([g["class"][some], g["id"][star]])), pa.array(np.concatenate([links[some], low[star]]))], ["kind", "a", "b"])

    return run


def _pairs(classes: DataFrame, dim: int, kind: np.dtype, threshold: float) -> DataFrame:
    n = parts(classes.sparkSession)
    own = classes.filter(F.col("dim") == dim)
    most = own.groupBy("label").count().agg(F.max("count")).first()[0] or 0
    size = 1 << max(1, (dim - 1).bit_length())
    k = max(1, int(np.ceil(np.log(max(1, most / BUCKET)) / np.log(2 * size))))
    tables = tables_for(dim, k, threshold)
    signed = save(map_arrow(own.select("class", "label", "id", "copies", "vector"), _signed(dim, tables, k, kind), "class long, label long, id long, copies long, vector binary, codes binary, list array<long>"), "signed")
    rows = signed.select("class", "label", F.posexplode("list").alias("pos", "code")).select("class", "label", "code", (F.col("pos") % (1 + k) == 0).alias("home"))
    sizes = rows.groupBy("label", "code").agg(F.count("*").alias("n"), F.max("home").alias("some")).filter("n > 1 and some")
    many = F.ceil(F.col("n") / BLOCK)
    narrow = rows.join(sizes, ["label", "code"]).withColumn("chunk", F.pmod(F.xxhash64("class"), many)).withColumn("other", F.explode(F.sequence(F.lit(0), many - 1)))
    wide = narrow.join(signed.drop("label", "list"), "class")
    wide = wide.select("label", "code", F.least("chunk", "other").alias("i"), F.greatest("chunk", "other").alias("j"), "chunk", "home", "class", "id", "copies", "vector", "codes")
    wide = wide.repartition(n, "label", "code", "i", "j").sortWithinPartitions("label", "code", "i", "j")
    return map_arrow(wide, _linked(dim, tables, k, kind, threshold), "kind int, a long, b long")


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", threshold: float = THRESHOLD) -> DataFrame:
    """vec_id, n_links, component_id, kept: one row per row of vectors."""
    v = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), F.col(vector_col).cast("array<double>").alias("vector"))
    sound = F.col("label").isNotNull() & F.col("vector").isNotNull() & F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vector", lambda x: x != 0)
    v = v.withColumn("sound", F.coalesce(sound, F.lit(False)))
    marks = (F.xxhash64("label", "vector").alias("d1"), F.xxhash64(F.lit(17), "vector", "label").alias("d2"))
    rows = v.select("id", "sound", *marks)
    grouped = v.filter("sound").select("id", "label", "vector", *marks).groupBy("d1", "d2").agg(F.min("id").alias("id"), F.count("*").alias("copies"), F.first("label").alias("label"), F.first("vector").alias("vector"))
    classes = save(grouped.withColumn("class", F.monotonically_increasing_id()).withColumn("dim", F.size("vector")), "classes")
    # classes without any id still count as links: they get ids of their own, below all others, and lose them at the end
    named = classes.withColumn("id", F.coalesce("id", F.lit(2**62) + F.col("class")))
    found = None
    # vectors of floats travel as such: their doubles hold nothing more
    kind = np.dtype(np.float32 if vectors.schema[vector_col].dataType.simpleString() == "array<float>" else np.float64)
    for dim in sorted(r["dim"] for r in classes.select("dim").distinct().collect()):
        part = _pairs(named, dim, kind, threshold)
        found = part if found is None else found.union(part)
    found = save(found if found is not None else classes.select(F.lit(0).alias("kind"), F.lit(0).cast("long").alias("a"), F.lit(0).cast("long").alias("b")).limit(0), "links")
    links = found.filter("kind = 0").groupBy(F.col("a").alias("class")).agg(F.sum("b").alias("links"))
    top = components(found.filter("kind = 1").select("a", "b"))
    of_class = named.select("class", "d1", "d2", "id", "copies").join(links, "class", "left").join(top.withColumnRenamed("node", "id"), "id", "left")
    of_class = of_class.select("d1", "d2", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("links"), F.coalesce("component", "id").alias("component"))
    known, alone = rows.filter("sound").join(of_class, ["d1", "d2"]), rows.filter(~F.col("sound"))
    component = F.when(F.col("component") < 2**62, F.col("component"))
    out = known.select("id", F.col("links").cast("long").alias("n_links"), component.alias("component_id")).union(alone.select("id", F.lit(0).cast("long"), "id"))
    return out.select(F.col("id").alias("vec_id"), "n_links", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))
