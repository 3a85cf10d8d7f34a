"""Near duplicates by MinHash with odd sketches.

A document's set is its distinct SHINGLE-word shingles (64-bit hashes). One scan gives per
row the set's size, its digest, minima under BANDS * ROWS hashes (band keys are made of a
few each), MinHash samples of one permutation (the least hash in each of SAMPLES bins), and
the odd sketch: the samples, folded by parity into BITS bits. Rows with one set form a class
(exact copies never become pairs). Candidates share a band key; a pair at the threshold
misses all bands with probability (1 - 0.85^5)^25 < 1e-6, and below 0.85 there are as many
bands of LOOSE_ROWS minima as keep that bound (27 at 0.8).

The population count z of the XOR of two sketches estimates in how many samples two sets
differ, -BITS / 2 * ln(1 - 2z / BITS), and so how many they share; that number over the
bins which their union fills estimates the Jaccard similarity. What lies below the
threshold by more than SIGMAS standard deviations (of the samples and of the folding; a few
hundredths) is dropped, the rest is confirmed on the full sets. These are computed once for
the rows that need it; a row that is compared with many is dealt out with them in blocks.

Two rounds keep the pairs near linear in a group's size. First each bucket's members meet
its smallest. Then only buckets that still hold several components are looked at, in blocks
of at most 2 * BLOCK rows: the sketches tell which rows may be similar to one of another
component, and only those rows meet again with their full sets. From a block comes a
spanning forest of its links, never its pairs. So each pair that could join two components
is judged, and hot buckets are dealt out over many blocks; nothing is capped.

Defined results: a row without words or text has n_shingles 0 and links with nothing; rows
with one id count as one document; a row without an id takes the component of its class
(null if no member has an id). Repeated rows each give a row. Texts of any length are
read whole. A pair exactly at the threshold is linked. Nothing but id and text columns is
read, whatever else there is.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import few, forget, map_arrow, parts, save
from .graph import blocks, components, fixed_bytes, id_filter

SHINGLE = 5
BANDS, ROWS = 25, 5
SAMPLES, BITS, SIGMAS = 4096, 2048, 5
THRESHOLD = 0.85
LOOSE_ROWS, MISS = 4, 1e-6
BLOCK = 1024  # rows with sketches, 300 bytes each: a bucket of so many is not copied at all
DEAL = 64
CACHE = 8 << 20  # bytes of words that a worker remembers


def banding(threshold: float) -> tuple[int, int]:
    """Bands, and minima in each, with which a pair at the threshold misses all bands with probability below MISS."""
    if threshold >= THRESHOLD:
        return BANDS, ROWS
    return math.ceil(math.log(MISS) / math.log1p(-(threshold**LOOSE_ROWS))), LOOSE_ROWS


@lru_cache(maxsize=4)
def _drawn(n: int, rows: int) -> tuple[np.ndarray, np.ndarray, list[int], np.ndarray]:
    """Multipliers and addends of the minima, weights of a shingle's words, weights of a band's minima."""
    rng = np.random.default_rng(20240229)
    mul = (rng.integers(0, 2**32, n * rows, np.uint64).astype(np.uint32)) | np.uint32(1)
    add = rng.integers(0, 2**32, n * rows, np.uint64).astype(np.uint32)
    place = [int(x) | 1 for x in rng.integers(0, 2**63, SHINGLE, np.int64)]
    return mul, add, place, rng.integers(0, 2**63, (n, rows), np.int64).astype(np.uint64) | np.uint64(1)


_PLACE = _drawn(BANDS, ROWS)[2]


class _Words(dict):
    """word -> 64-bit hash; forgets all when its words and their entries (about 150 bytes each) take CACHE bytes."""

    held = 0

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        self.held += 150 + len(word)
        if self.held > CACHE:
            self.clear()
            self.held = 150 + len(word)
        self[word] = h
        return h


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(32))


def shingles(text: str | None, cache: _Words | None = None, k: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of the k-word shingles; of the whole sequence if it is shorter."""
    words = (text or "").encode().lower().split()  # of bytes: lower-cases A-Z, splits at \x20\x09-\x0D
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) < k:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), 1)], np.uint64)
    cache = _Words() if cache is None else cache
    h = np.fromiter(map(cache.__getitem__, words), np.uint64, len(words))
    n = len(h) - k + 1
    total = np.zeros(n, np.uint64)
    for i in range(k):
        total += h[i : i + n] * np.uint64(_PLACE[i])
    return np.unique(_mix(total))


def minima(hashes: np.ndarray, shape: tuple[int, int] = (BANDS, ROWS)) -> np.ndarray:
    mul, add, _, _ = _drawn(*shape)
    h = (hashes >> np.uint64(16)).astype(np.uint32)
    out = np.full(len(mul), 2**32 - 1, np.uint32)
    for a in range(0, len(h), 512):
        np.minimum(out, (h[a : a + 512, None] * mul + add).min(axis=0), out=out)
    return out


def bands(mins: np.ndarray, shape: tuple[int, int] = (BANDS, ROWS)) -> np.ndarray:
    m = mins.astype(np.uint64).reshape(shape)
    return _mix((m * _drawn(*shape)[3]).sum(axis=1, dtype=np.uint64) + np.arange(1, shape[0] + 1, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F))


def samples(hashes: np.ndarray) -> np.ndarray:
    """Of sorted hashes, the least in each bin; a bin is a value of the leading bits."""
    bins = hashes >> np.uint64(64 - SAMPLES.bit_length() + 1)
    return hashes[np.flatnonzero(np.diff(bins, prepend=bins[:1] + np.uint64(1)))]


def odd_sketch(some: np.ndarray) -> bytes:
    """Samples folded by parity into BITS bits."""
    at = (some * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - BITS.bit_length() + 1)
    return np.packbits(np.bincount(at.astype(np.int64), minlength=BITS) & 1).tobytes()


def _filled(n: np.ndarray) -> np.ndarray:
    """How many bins n hashes fill, on average."""
    return SAMPLES * (1 - np.exp(-n / SAMPLES))


def shared(ka: np.ndarray, kb: np.ndarray, z: np.ndarray) -> np.ndarray:
    """How many samples two sets of ka and kb share, estimated from the population count of the XOR of their sketches."""
    return (ka + kb + BITS / 2 * np.log(np.maximum(1 - 2 * z / BITS, 1e-9))) / 2


def estimate(na: np.ndarray, nb: np.ndarray, ka: np.ndarray, kb: np.ndarray, z: np.ndarray) -> np.ndarray:
    """Jaccard similarity of sets of na and nb shingles."""
    both, more = shared(ka, kb, z), (ka + kb) / (_filled(na) + _filled(nb))
    j = np.ones_like(both)
    for _ in range(4):  # the union's size depends on it
        j = np.clip(both / (_filled((na + nb) / (1 + j)) * more), 0, 1)
    return j


def similar(na: np.ndarray, nb: np.ndarray, ka: np.ndarray, kb: np.ndarray, z: np.ndarray, threshold: float) -> np.ndarray:
    """Which pairs may reach the threshold, by their sizes and by what their sketches estimate."""
    union = (na + nb) / (1 + threshold)
    bins = _filled(union) * (ka + kb) / (_filled(na) + _filled(nb))
    differ = np.maximum(0, ka + kb - 2 * threshold * bins)
    fade = np.exp(-4 * differ / BITS)
    folding = (BITS / 4 * (1 - fade) - differ * fade) / fade
    slack = SIGMAS * np.sqrt(threshold * (1 - threshold) * bins * np.maximum(0, 1 - bins / union) + folding / 4) + 1
    return (shared(ka, kb, z) >= threshold * bins - slack) & (np.minimum(na, nb) >= threshold * np.maximum(na, nb) - 1e-6)


def _signatures(batches: Iterator[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    """(text, columns to keep) -> (these columns, n, digest, bands, k, sketch)."""
    cache, shape = _Words(), banding(threshold)
    own = pa.schema([("n", pa.int64()), ("digest", pa.binary()), ("bands", pa.list_(pa.int64())), ("k", pa.int64()), ("sketch", pa.binary())])
    for b in batches:
        out = []
        for text in b.column(0):
            h = shingles(text.as_py(), cache)
            if len(h):
                some = samples(h)
                out.append((len(h), xxhash.xxh3_128_digest(h.tobytes()), bands(minima(h, shape), shape).view(np.int64), len(some), odd_sketch(some)))
            else:
                out.append((0, None, None, None, None))
        if out:
            yield pa.RecordBatch.from_arrays([*b.columns[1:], *[pa.array(c, f.type) for c, f in zip(zip(*out), own)]], [*b.schema.names[1:], *own.names])


def signatures(docs: DataFrame, text_col: str, threshold: float, **kept: Column) -> DataFrame:
    """The `kept` columns (as longs) of each row, and what its text's set gives."""
    rows = docs.select(F.col(text_col).cast("string").alias("text"), *[c.cast("long").alias(k) for k, c in kept.items()])
    return map_arrow(rows, partial(_signatures, threshold=threshold), ", ".join(f"{k} long" for k in kept) + ", n long, digest binary, bands array<long>, k long, sketch binary")


def sets_of(wanted: DataFrame, docs: DataFrame, text_col: str) -> DataFrame:
    """wanted: id, mark (xxhash64 of a text). id, hashes (sorted, as bytes). Saved. Each text's set is computed once in a task, however many copies it has."""
    among = id_filter(wanted.select("mark").distinct())

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, seen = _Words(), set()
        for b in batches:
            b = b.filter(pa.array(among(b.column(0).to_numpy(zero_copy_only=False))))
            marks, out = b.column(0).to_pylist(), []
            fresh = [k for k, m in enumerate(marks) if not (m in seen or seen.add(m))]
            for k in fresh:
                out.append((marks[k], shingles(b.column(1)[k].as_py(), cache).tobytes()))
            if out:
                m, h = zip(*out)
                yield pa.record_batch([pa.array(m, pa.int64()), pa.array(h, pa.binary())], ["mark", "hashes"])

    text = F.col(text_col).cast("string")
    rows = map_arrow(docs.select(F.xxhash64(text).alias("mark"), text.alias("text")), sets, "mark long, hashes binary")
    return save(rows.join(few(wanted), "mark").groupBy("id", "mark").agg(F.first("hashes").alias("hashes")).select("id", "hashes"), "sets")


def linked(x: np.ndarray, y: np.ndarray, threshold: float) -> bool:
    """Whether two sorted sets reach the threshold."""
    less, more = (x, y) if len(x) <= len(y) else (y, x)
    if not len(more):
        return False
    both = int((more[np.minimum(np.searchsorted(more, less), len(more) - 1)] == less).sum())
    return 100 * both >= round(100 * threshold) * (len(x) + len(y) - both) > 0


def _compared(threshold: float):
    """Rows (a, chunk, kind, id, hashes) in order: the sets of a (kind 0), then those to compare them with -> a, b, linked."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, hubs = None, []
        for b in batches:
            out = []
            for a, chunk, kind, i, raw in zip(*(b.column(k).to_pylist() for k in range(4)), b.column(4)):
                if (a, chunk) != block:
                    block, hubs = (a, chunk), []
                x = np.frombuffer(raw.as_buffer(), np.uint64)
                if kind == 0:
                    hubs.append(x.copy())
                else:
                    out.append((a, i, any(linked(x, y, threshold) for y in hubs)))
            if out:
                a, i, near = zip(*out)
                yield pa.record_batch([pa.array(a, pa.int64()), pa.array(i, pa.int64()), pa.array(near, pa.bool_())], ["a", "b", "linked"])

    return compare


def confirmed(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """pairs: a, b; sets: id, hashes. Those pairs whose full sets reach the threshold. Saved.

    The set of a comes once to each block of about DEAL partners, not once for each pair.
    """
    n = parts(pairs.sparkSession)
    blocks_of = pairs.groupBy("a").agg(F.ceil(F.count("*") / DEAL).alias("many"))
    dealt = pairs.join(blocks_of, "a").select("a", F.pmod(F.xxhash64("b"), F.col("many")).alias("chunk"), F.lit(1).alias("kind"), F.col("b").alias("id"))
    hubs = blocks_of.select("a", F.explode(F.sequence(F.lit(0).cast("long"), F.col("many") - 1)).alias("chunk"), F.lit(0).alias("kind"), F.col("a").alias("id"))
    rows = dealt.union(hubs).join(sets, "id").select("a", "chunk", "kind", "id", "hashes")
    rows = rows.repartition(n, "a", "chunk").sortWithinPartitions("a", "chunk", "kind")
    return save(map_arrow(rows, _compared(threshold), "a long, b long, linked boolean").filter("linked").select("a", "b").distinct(), "confirmed")


WIDE = {"sketch": BITS // 8}


def _passing_pairs(g: dict[str, np.ndarray], threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of rows of a block, in different components, that may be similar; and one less their estimates."""
    i, j = g["i"][0], g["j"][0]
    left, right = np.flatnonzero(g["chunk"] == i), np.flatnonzero(g["chunk"] == j)
    words, found = np.ascontiguousarray(g["sketch"]).view(np.uint64).reshape(len(g["n"]), -1), []
    for a in range(0, len(left), 32):
        l = left[a : a + 32]
        z = np.bitwise_count(words[l, None, :] ^ words[None, right, :]).sum(axis=2, dtype=np.int64)
        of = g["n"][l, None], g["n"][None, right], g["k"][l, None], g["k"][None, right], z
        near = similar(*of, threshold)
        near &= g["top"][l, None] != g["top"][None, right]
        if i == j:
            near &= g["id"][l, None] < g["id"][None, right]
        x, y = np.nonzero(near)
        found.append((l[x], right[y], 1 - estimate(*of)[x, y]))
    return tuple(np.concatenate(c) for c in zip(*found)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))


def _suspects(threshold: float):
    """Blocks (key, i, j) of rows with sketches: the rows that may be similar to one of another component."""

    def suspects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in blocks(batches, 3, WIDE):
            x, y, _ = _passing_pairs(g, threshold)
            at = np.unique(np.concatenate([x, y]))
            if len(at):
                yield pa.record_batch([pa.array(g[c][at].astype(np.int64)) for c in SUSPECT], list(SUSPECT))

    return suspects


SUSPECT = ("key", "i", "j", "id", "top", "chunk")


def _forests(threshold: float):
    """Blocks of suspects with their full sets: a spanning forest of the links between components."""

    def forest(i: int, j: int, rows: list[tuple]) -> pa.RecordBatch | None:
        ids, tops, chunks = (np.array(c, np.int64) for c in list(zip(*rows))[:3])
        sets = [r[3] for r in rows]
        some = [samples(h) for h in sets]
        g = {"i": [i], "j": [j], "id": ids, "top": tops, "chunk": chunks, "n": np.array([len(h) for h in sets]), "k": np.array([len(h) for h in some])}
        g["sketch"] = np.stack([np.frombuffer(odd_sketch(h), np.uint8) for h in some])
        x, y, apart = _passing_pairs(g, threshold)
        parent, found = {t: t for t in tops.tolist()}, []

        def root(a: int) -> int:
            while parent[a] != a:
                parent[a] = parent[parent[a]]
                a = parent[a]
            return a

        for p, q in zip(*(v[np.argsort(apart, kind="stable")].tolist() for v in (x, y))):  # most similar first
            a, b = root(int(tops[p])), root(int(tops[q]))
            if a != b and linked(sets[p], sets[q], threshold):
                parent[max(a, b)] = min(a, b)
                found.append(sorted((int(ids[p]), int(ids[q]))))
        if found:
            a, b = zip(*found)
            return pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    def forests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, rows = None, []
        for b in batches:
            for key, i, j, *row, raw in zip(*(b.column(c).to_pylist() for c in range(6)), b.column(6)):
                if (key, i, j) != block:
                    if rows and (out := forest(*block[1:], rows)):
                        yield out
                    block, rows = (key, i, j), []
                rows.append((*row, np.frombuffer(raw.as_buffer(), np.uint64).copy()))
        if rows and (out := forest(*block[1:], rows)):
            yield out

    return forests


def _close(threshold: float):
    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            c = dict(zip(b.schema.names, b.columns))
            x, y = (fixed_bytes(c[k], BITS // 8) for k in ("sa", "sb"))
            z = np.bitwise_count(x ^ y).sum(axis=1, dtype=np.int64)
            near = similar(*(c[k].to_numpy() for k in ("na", "nb", "ka", "kb")), z, threshold)
            yield pa.RecordBatch.from_arrays([c["a"], c["b"]], ["a", "b"]).filter(pa.array(near))

    return close


def _merged(tops: DataFrame | None, more: DataFrame) -> DataFrame:
    """node, component after links `more` (a, b) join components of `tops`."""
    if tops is None:
        return components(more)
    up = more.join(tops.select(F.col("node").alias("a"), F.col("component").alias("ca")), "a", "left").join(tops.select(F.col("node").alias("b"), F.col("component").alias("cb")), "b", "left")
    second = components(up.select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b")))
    old = tops.join(second.select(F.col("node").alias("component"), F.col("component").alias("final")), "component", "left").select("node", F.coalesce("final", "component").alias("component"))
    out = save(old.union(second.join(tops, "node", "left_anti").select("node", "component")), "tops")
    forget(second)
    return out


def _components(signed: DataFrame, docs: DataFrame, text_col: str, threshold: float) -> DataFrame:
    """signed: id, mark and the signatures, saved. digest -> component_id of every set."""
    n = parts(docs.sparkSession)
    wide = [F.first(c).alias(c) for c in ("mark", "n", "bands", "k", "sketch")]
    reps = save(signed.filter("n > 0").groupBy("digest").agg(F.min("id").alias("id"), *wide), "reps")
    named = reps.filter("id is not null")
    keys = named.select("id", F.explode("bands").alias("key"))
    buckets = keys.groupBy("key").agg(F.count("*").alias("size"), F.min("id").alias("least")).filter("size > 1")
    members = save(keys.join(buckets, "key"), "members")
    sketches = named.select("id", "n", "k", "sketch")

    # round 1: every member against the smallest of its bucket
    of = {x: sketches.select(F.col("id").alias(x), *[F.col(c).alias(c[0] + x) for c in ("n", "k", "sketch")]) for x in "ab"}
    stars = members.filter("id <> least").select(F.col("least").alias("a"), F.col("id").alias("b")).distinct()
    stars = save(map_arrow(stars.join(of["a"], "a").join(of["b"], "b").select("a", "b", "na", "nb", "ka", "kb", "sa", "sb"), _close(threshold), "a long, b long"), "stars")
    marks = named.select("id", "mark").distinct()
    have = stars.select(F.col("a").alias("id")).union(stars.select("b")).distinct()
    sets = [sets_of(marks.join(have, "id", "left_semi"), docs, text_col)]
    links = confirmed(stars, sets[0], threshold)
    tops = _merged(None, links)

    # round 2: buckets that hold several components
    many = F.ceil(F.col("size") / BLOCK)
    placed = members.join(tops.withColumnRenamed("node", "id"), "id", "left").select("key", "id", "size", F.coalesce("component", "id").alias("top"))
    mixed = placed.groupBy("key").agg(F.min("top").alias("lo"), F.max("top").alias("hi")).filter("lo < hi").select("key")
    rows = placed.join(mixed, "key").withColumn("chunk", F.pmod(F.xxhash64("id"), many)).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), many - 1))).join(sketches, "id")
    rows = rows.select("key", F.least("chunk", "other").alias("i"), F.greatest("chunk", "other").alias("j"), "id", "top", "n", "k", "sketch", "chunk")
    rows = rows.repartition(n, "key", "i", "j").sortWithinPartitions("key", "i", "j")
    found = save(map_arrow(rows, _suspects(threshold), ", ".join(f"{c} long" for c in SUSPECT)), "suspects")
    old = [members, stars, links, found]
    if not found.isEmpty():
        more = found.select("id").distinct().join(have, "id", "left_anti")
        if not more.isEmpty():  # every set is computed once
            sets.append(sets_of(marks.join(more, "id", "left_semi"), docs, text_col))
        full = sets[0] if len(sets) == 1 else sets[0].union(sets[1])
        rows = found.join(full, "id").select(*SUSPECT, "hashes").repartition(n, "key", "i", "j").sortWithinPartitions("key", "i", "j")
        links = save(map_arrow(rows, _forests(threshold), "a long, b long").distinct(), "links")
        old.append(links)
        if not links.isEmpty():
            old.append(tops)
            tops = _merged(tops, links)
    final = tops.select("node", F.col("component").alias("final"))
    out = save(reps.select("digest", "id").join(final.withColumnRenamed("node", "id"), "id", "left").select("digest", F.coalesce("final", "id").alias("component_id")), "components")
    for df in [*old, *sets, reps, tops]:  # nothing reads them any more
        forget(df)
    return out


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row per row of docs."""
    mark = F.xxhash64(F.col(text_col).cast("string"))
    signed = save(signatures(docs, text_col, threshold, id=F.col(id_col), mark=mark), "signed")
    out = signed.select("id", "n", "digest").join(_components(signed, docs, text_col, threshold), "digest", "left")
    component = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id"))
    return out.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))


def kept_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row of each component of docs, that of the smallest id; columns as in docs.

    Rows are compared by a number of their own: repeated rows and rows without an id are
    documents too (null ids come last), and rows that share an id only are not taken for one
    document. Rows without words stay. The rows themselves are told by two hashes of their id
    and text, so texts are neither copied nor, as long as few rows go, shuffled.
    """
    text, own = F.col(text_col).cast("string"), F.col(id_col).cast("long")
    content = {"h1__of_minhash": F.xxhash64(own, text), "h2__of_minhash": F.xxhash64(text, F.lit(17), own)}
    h = list(content)
    signed = save(signatures(docs, text_col, threshold, id=F.monotonically_increasing_id(), own=own, mark=F.xxhash64(text), **content), "signed")
    placed = signed.select("id", "own", "n", "digest", *h).join(_components(signed, docs, text_col, threshold), "digest", "left")
    placed = placed.withColumn("component_id", F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id")))
    first = placed.groupBy("component_id").agg(F.min(F.struct(F.col("own").isNull(), "own", "id"))["id"].alias("first"))
    told = placed.join(first, "component_id").groupBy(*h).agg(F.count("*").alias("rows"), F.sum((F.col("id") == F.col("first")).cast("long")).alias("stay"))
    told = save(told.filter("stay < rows").select(*h, "stay"), "told")
    forget(signed)
    out = docs.withColumns(content).join(few(told.filter("stay = 0").select(*h)), h, "left_anti")
    repeated = told.filter("stay > 0").select(*h)
    if not repeated.isEmpty():  # equal rows, one of which stays
        out = out.join(few(repeated), h, "left_anti").unionByName(out.join(few(repeated), h, "left_semi").dropDuplicates(h))
    return out.select(*docs.columns)
