"""Quality classifier: naive Bayes support vectors.

Features are indicators of hashed n-grams: byte 2- and 3-grams and words; and of n-gram
statistics in bins: adjacent equal words, distinct words, length. Their counts in
each class cover all learning rows; r = log((p + 1) / |p + 1|) - log((q + 1) / |q + 1|) is
the log-count ratio. A linear hinge-loss model over r-scaled indicators (unit length) is
fitted by dual coordinate descent on a bounded sample (SAMPLE rows of each class, chosen
by a hash of the id), and a logistic curve, weighted back to all learning rows, turns its
margin into a score.

Defined results: a null text is the empty text, whose one feature is the bin of length 0;
a text of any length is read whole, in pieces; without learning rows of both classes every score is the share of label 1
among them (0.5 if there is none). A score of exactly 0.5 predicts 1. Labels without a quality are not used; of several
labels of an id the largest counts. Repeated rows each give a row. lang, source, toxic
and ids are never features; other columns are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, few, map_arrow, save

LOG2 = 18
SIZE = (1 << LOG2) + 256  # the last 256: bins
SAMPLE = 4_000
COST = 1.0
EPOCHS = 30
FOLDS, HELD_OUT = 3, 1
PIECE = 1 << 20
CACHE = 16 << 20


class _Words(dict):
    """word -> feature number; forgets all when its words and their entries (about 150 bytes each) take CACHE bytes."""

    held = 0

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word) >> (64 - LOG2)
        self.held += 150 + len(word)
        if self.held > CACHE:
            self.clear()
            self.held = 150 + len(word)
        self[word] = h
        return h


def features(text: str | None, cache: _Words | None = None) -> np.ndarray:
    """Sorted distinct feature numbers of the whole text."""
    raw = (text or "").encode()
    found = []
    for a in range(0, max(1, len(raw)), PIECE):
        b = np.frombuffer(raw[a : a + PIECE + 2], np.uint8).astype(np.uint32)
        two = (b[:-1] << np.uint32(8)) | b[1:]
        three = (two[:-1] << np.uint32(8)) | b[2:] if len(b) > 2 else two[:0]
        grams = np.concatenate([two | np.uint32(0x1000000), three])
        found.append(np.unique((grams * np.uint32(0x9E3779B1)) >> np.uint32(32 - LOG2)))
    cache = _Words() if cache is None else cache
    words = raw.split()
    h = np.fromiter(map(cache.__getitem__, words), np.int64, len(words))
    some = np.unique(h)
    bins = [len(words).bit_length()]
    if len(h) > 1:
        equal = int((h[1:] == h[:-1]).sum())
        bins += [32 + min(31, equal), 64 + int(63 * equal / (len(h) - 1)), 128 + int(63 * len(some) / len(h)), 192 + int(31 * np.log2(len(some)) / 32)]
    return np.unique(np.concatenate([*found, some, np.array(bins) + (1 << LOG2)])).astype(np.int32)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(quality, text) -> (feature, p, q): in how many texts of label 1 and 0; feature -1 counts texts."""
    cache, n = _Words(), np.zeros((2, SIZE + 1), np.int64)
    for b in batches:
        for label, text in zip(b.column(0).to_pylist(), b.column(1)):
            n[label, features(text.as_py(), cache)] += 1
            n[label, -1] += 1
    at = np.flatnonzero(n.any(axis=0))
    if len(at):
        yield pa.record_batch([pa.array(np.where(at == SIZE, -1, at)), pa.array(n[1, at]), pa.array(n[0, at])], ["feature", "p", "q"])


def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    cache = _Words()
    for b in batches:
        yield pa.record_batch([b.column(0), pa.array([features(t.as_py(), cache).tobytes() for t in b.column(1)], pa.binary())], ["quality", "features"])


def dual_descent(rows: list[np.ndarray], values: list[np.ndarray], y: np.ndarray, size: int, cost: float = COST, epochs: int = EPOCHS) -> np.ndarray:
    """w (the last is the bias) of the L2-regularised hinge loss, by dual coordinate descent with a fixed order of random passes."""
    rng = np.random.default_rng(5)
    w, alpha = np.zeros(size + 1), np.zeros(len(y))
    square = np.array([v @ v + 1.0 for v in values])
    for _ in range(epochs):
        moved = 0.0
        for i in rng.permutation(len(y)):
            at, v = rows[i], values[i]
            grad = y[i] * (w[at] @ v + w[-1]) - 1
            new = min(max(alpha[i] - grad / square[i], 0.0), cost)
            d = (new - alpha[i]) * y[i]
            if d:
                alpha[i] = new
                w[at] += d * v
                w[-1] += d
                moved = max(moved, abs(d))
        if moved < 1e-3:
            break
    return w


def _logistic(m: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """a, b of the weighted logistic fit of y to a * m + b, by Newton steps with a small ridge."""
    x, ab = np.stack([m, np.ones_like(m)], 1), np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ ab, -30, 30)))
        grad = x.T @ (weight * (p - y)) + 1e-3 * ab
        hess = (x * (weight * p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        step = np.linalg.solve(hess, grad)
        ab -= np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return float(ab[0]), float(ab[1])


class Model:
    def __init__(self, r: np.ndarray, w: np.ndarray, a: float, b: float) -> None:
        self.square, self.weight, self.bias, self.a, self.b = r * r, w[:-1] * r, float(w[-1]), a, b

    def margin(self, at: np.ndarray) -> float:
        return float(self.weight[at].sum() / max(1e-12, np.sqrt(self.square[at].sum()))) + self.bias if len(at) else self.bias

    def score(self, at: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.a * self.margin(at) + self.b, -60, 60))))


def learn(rows: DataFrame, sample: int = SAMPLE) -> Model:
    """rows: id, quality (0, 1), text. Only sums per feature and the bounded sample come to the driver."""
    rows = save(rows, "labelled")
    got = map_arrow(rows.select("quality", "text"), _counted, "feature long, p long, q long").groupBy("feature").agg(F.sum("p").alias("p"), F.sum("q").alias("q")).toArrow()
    n = np.zeros((2, SIZE + 1))
    n[:, got["feature"].to_numpy()] = got["p"].to_numpy(), got["q"].to_numpy()
    n, (ones, zeros) = n[:, :-1], n[:, -1]
    if not ones or not zeros:
        share = ones / (ones + zeros) if ones + zeros else 0.5
        return Model(np.zeros(SIZE), np.zeros(SIZE + 1), 0.0, float(np.log(max(share, 1e-9) / max(1 - share, 1e-9))))
    smooth = n + 1
    r = np.log(smooth[0] / smooth[0].sum()) - np.log(smooth[1] / smooth[1].sum())
    r[(n.sum(axis=0) == 0)] = 0.0
    part = F.pmod(F.xxhash64("id", F.lit(3)), F.lit(1 << 30)) / float(1 << 30)
    few = rows.filter(F.when(F.col("quality") == 1, part < sample / ones).otherwise(part < sample / zeros))
    few = few.select("quality", "text", F.xxhash64("id", "text").alias("order"))
    table = few.select("order", "quality", "text")
    taken = map_arrow(table.select("quality", "text"), _sampled, "quality int, features binary").toArrow()
    data = sorted(zip(taken["quality"].to_pylist(), taken["features"].to_pylist()))  # one order, however tasks end
    y = np.array([q for q, _ in data])
    rows_ = [np.frombuffer(f, np.int32) for _, f in data]
    if not 0 < y.sum() < len(y):
        share = ones / (ones + zeros)
        return Model(r, np.zeros(len(r) + 1), 0.0, float(np.log(share / (1 - share))))
    values = [r[f] / max(1e-12, np.sqrt((r[f] ** 2).sum())) for f in rows_]
    w = dual_descent(rows_, values, np.where(y == 1, 1.0, -1.0), len(r))
    margins = np.array([(w[f] @ v if len(f) else 0.0) + w[-1] for f, v in zip(rows_, values)])
    weight = np.where(y == 1, ones / y.sum(), zeros / (len(y) - y.sum())) / (ones + zeros) * len(y)
    return Model(r, w, *_logistic(margins, y.astype(float), weight))


def score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted: one row per row of docs."""
    apart = crc_mod(id_col, FOLDS) == HELD_OUT
    wanted = labels.filter(labels["quality"].isin(0, 1) & labels[id_col].isNotNull() & ~apart).groupBy(F.col(id_col).cast("long").alias("id")).agg(F.max("quality").cast("int").alias("quality"))
    wanted = save(wanted, "labels")
    texts = docs.filter(docs[id_col].isNotNull() & ~apart).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    model = learn(texts.join(few(wanted), "id").select("id", "quality", "text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = _Words()
        for b in batches:
            s = [shared.value.score(features(t.as_py(), cache)) for t in b.column(2)]
            yield pa.record_batch([b.column(0), b.column(1), pa.array(s, pa.float64()), pa.array([int(x >= 0.5) for x in s], pa.int32())], ["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), apart.alias("held_out"), F.col(text_col).cast("string").alias("text"))
    return map_arrow(rows, run, "doc_id long, held_out boolean, score double, predicted int")
