"""Language ID with bit-sliced Bloom filters over character n-grams.

Training counts every 3- and 4-gram of the learning rows per language (partial counts per
task, then sums in Spark). A gram belongs to a language if its share there is at least
SHARE of its largest share in any language and at least RATE. (RATE is a share, so it acts
alike at every size of input, and bounds a language's grams by 1 / RATE; the table has
room for them all.) Each kept gram sets its language's bit at HASHES places of a table of
bit masks: one AND of the masks at a gram's places returns all languages that hold the gram. A text's
languages are then compared by popcounts over its grams, corrected for the false positives
that each language's fill makes: (hits - f * n) / (1 - f).

Defined results: `und` with score 0 for a text that is null or has no letter; a text whose
grams no language holds gets the commonest learned language with score 0; without any
learning row every text is `und`. score is the best count's share of the best two. Ties go
to the smaller language name. Repeated rows each give a row. Only id, text and, for
learning, lang are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, map_arrow, save

SHARE = 0.25
RATE = 2.5e-6
LOG2 = 20  # of the places, at least
ROOM = 8  # places for each gram of the largest language, at least
HASHES = 3
PIECE = 1_000_000
FOLDS, HELD_OUT = 4, 2


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """By code point: lower-cased single letter, or a space for what is no letter."""
    out = np.full(0x110000, 0x20, np.uint32)
    for c in range(0x110000):
        s = chr(c)
        if s.isalpha():
            low = s.lower()
            out[c] = ord(low) if len(low) == 1 else c
    return out


def _pieces(texts: list[str | None]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, number of rows, letters, starts) of runs of rows; a long text is split, its parts come one by one."""
    table = _letters()
    at, held, size = 0, [], 0

    def coded(rows: list[str]) -> tuple[np.ndarray, np.ndarray]:
        starts = np.cumsum([0] + [len(r) + 1 for r in rows[:-1]])
        joined = " ".join(rows) + " "
        return table[np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)], starts

    for k, text in enumerate(texts):
        text = text or ""
        if held and size + len(text) > PIECE:
            yield at, len(held), *coded(held)
            at, held, size = k, [], 0
        if len(text) > PIECE:
            for a in range(0, len(text), PIECE):  # parts overlap so that no gram is lost: 3 characters before
                yield k, 1, *coded([text[max(0, a - 2) : a + PIECE + 1]])
            at = k + 1
        else:
            held.append(text)
            size += len(text)
    if held:
        yield at, len(held), *coded(held)


def _grams(c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the 3- and 4-grams, and the places of their second letters. Inner characters are letters."""
    x = np.concatenate([[np.uint32(0x20)], c, [np.uint32(0x20)] * 2]).astype(np.uint64)  # x[i + 1] is c[i]
    inner = c != 0x20
    three = np.flatnonzero(inner)
    follows = np.concatenate([inner[1:], [False]])
    four = np.flatnonzero(inner & follows)
    k = [np.uint64(v) for v in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]
    h3 = x[three] * k[0] + x[three + 1] * k[1] + x[three + 2] * k[2]
    h4 = x[four] * k[0] + x[four + 1] * k[1] + x[four + 2] * k[2] + x[four + 3] * k[3] + np.uint64(1)
    h, at = np.concatenate([h3, h4]), np.concatenate([three, four])
    h = (h ^ (h >> np.uint64(29))) * k[3]
    return h ^ (h >> np.uint64(32)), at


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, text) -> (lang, gram, n), merged within the task."""
    held: dict[str, list] = {}
    sizes: dict[str, int] = {}

    def merged(lang: str) -> tuple[np.ndarray, np.ndarray]:
        g, n = (np.concatenate(z) for z in zip(*held[lang]))
        g, inv = np.unique(g, return_inverse=True)
        return g, np.bincount(inv, n).astype(np.int64)

    for b in batches:
        langs = np.array(b.column(0).to_pylist(), dtype=object)
        texts = b.column(1).to_pylist()
        for lang in dict.fromkeys(langs.tolist()):
            for _, _, c, _ in _pieces([texts[i] for i in np.flatnonzero(langs == lang)]):
                g, n = np.unique(_grams(c)[0], return_counts=True)
                held.setdefault(lang, []).append((g, n))
                sizes[lang] = sizes.get(lang, 0) + len(g)
                if sizes[lang] > 2_000_000:
                    held[lang] = [merged(lang)]
                    sizes[lang] = len(held[lang][0][0])
                    if sizes[lang] > 1_000_000:  # bounded memory: hand over what there is
                        yield _count_rows(lang, *held.pop(lang)[0])
                        sizes[lang] = 0
    for lang in list(held):
        yield _count_rows(lang, *merged(lang))
        del held[lang]


def _count_rows(lang: str, g: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    return pa.record_batch([pa.array([lang] * len(g), pa.string()), pa.array(g.view(np.int64)), pa.array(n.astype(np.int64))], ["lang", "gram", "n"])


def _places(g: np.ndarray, log2: int) -> list[np.ndarray]:
    odd = g | np.uint64(1)
    return [((g + np.uint64(i) * odd) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - log2)).astype(np.int64) for i in range(1, HASHES + 1)]


class Model:
    """langs; masks: (words, places) of uint64; rates: false positives of each language."""

    def __init__(self, langs: list[str], masks: np.ndarray, first: int) -> None:
        self.langs, self.masks, self.first = langs, masks, first
        fill = [np.count_nonzero((masks[i // 64] >> np.uint64(i % 64)) & np.uint64(1)) / masks.shape[1] for i in range(len(langs))]
        self.rates = np.array(fill) ** HASHES if langs else np.zeros(0)

    def hits(self, c: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Grams, and hits of each language, of each text."""
        g, at = _grams(c)
        order = np.argsort(at, kind="stable")
        g, at = g[order], at[order]
        edges = np.searchsorted(at, np.append(starts, len(c)))
        places = _places(g, self.masks.shape[1].bit_length() - 1)
        out = np.zeros((len(starts), len(self.langs)), np.int64)
        for w in range(self.masks.shape[0]):
            m = self.masks[w][places[0]]
            for p in places[1:]:
                m &= self.masks[w][p]
            for i in range(64 * w, min(64 * w + 64, len(self.langs))):
                total = np.concatenate([[0], np.cumsum((m >> np.uint64(i % 64)) & np.uint64(1), dtype=np.int64)])
                out[:, i] = np.diff(total[edges])
        return np.diff(edges), out

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        n, hits = np.zeros(len(texts), np.int64), np.zeros((len(texts), len(self.langs)), np.int64)
        for first, rows, c, starts in _pieces(texts):
            a, b = self.hits(c, starts)
            n[first : first + rows] += a
            hits[first : first + rows] += b
        if not self.langs:
            return ["und"] * len(texts), [0.0] * len(texts)
        sure = np.maximum(0, (hits - self.rates * n[:, None]) / np.maximum(1e-9, 1 - self.rates))
        best = sure.argmax(axis=1)
        top = sure[np.arange(len(texts)), best]
        rest = sure.copy()
        rest[np.arange(len(texts)), best] = 0
        score = np.where(top > 0, top / np.maximum(1e-300, top + rest.max(axis=1)), 0.0)
        langs = [self.langs[k if t > 0 else self.first] if some else "und" for k, t, some in zip(best.tolist(), top.tolist(), (n > 0).tolist())]
        return langs, np.where(n > 0, score, 0.0).tolist()


def learn(rows: DataFrame, share: float = SHARE, least: float = RATE, log2: int = LOG2) -> Model:
    """rows: lang, text. Counts cover all rows; what comes to the driver is a row per language, and the filter.

    The number of languages is that of distinct `lang` values; the filter has 2^22 masks at most for each 64.
    """
    rows = rows.filter("lang is not null and text is not null").select(F.col("lang").cast("string"), F.col("text").cast("string"))
    counts = save(map_arrow(rows, _counts, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")), "grams")
    totals = counts.groupBy("lang").agg(F.sum("n").alias("total"))
    known = sorted((r["lang"], r["total"]) for r in totals.collect())
    langs = [k for k, _ in known]
    if not langs:
        return Model([], np.zeros((1, 1 << log2), np.uint64), 0)
    rated = counts.join(totals, "lang").withColumn("rate", F.col("n") / F.col("total")).filter(F.col("rate") >= least)
    best = rated.groupBy("gram").agg(F.max("rate").alias("best"))
    kept = save(rated.join(best, "gram").filter(F.col("rate") >= share * F.col("best")).select("lang", "gram"), "kept")
    most = max(r["count"] for r in kept.groupBy("lang").count().collect())
    log2 = max(log2, int(np.ceil(np.log2(ROOM * most))))
    index = {k: i for i, k in enumerate(langs)}

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            i = np.array([index[k] for k in b.column(0).to_pylist()], np.int64)
            mask = (np.uint64(1) << (i % 64).astype(np.uint64)).view(np.int64)
            for p in _places(b.column(1).to_numpy().view(np.uint64), log2):
                yield pa.record_batch([pa.array(i // 64), pa.array(p), pa.array(mask)], ["word", "at", "mask"])

    got = map_arrow(kept, bits, "word long, at long, mask long").groupBy("word", "at").agg(F.bit_or("mask").alias("mask")).toArrow()
    masks = np.zeros(((len(langs) + 63) // 64, 1 << log2), np.uint64)
    masks[got["word"].to_numpy(), got["at"].to_numpy()] = got["mask"].to_numpy().view(np.uint64)
    return Model(langs, masks, max(range(len(langs)), key=lambda i: (known[i][1], -i)))


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, text hash `mark`, lang_pred, score: one row per row of docs."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            langs, score = shared.value.predict(b.column(2).to_pylist())
            yield pa.record_batch([b.column(0), b.column(1), pa.array(langs, pa.string()), pa.array(score, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(id_col).alias("held_out"), F.col(text_col).cast("string").alias("text"))
    return map_arrow(rows, run, "doc_id long, held_out boolean, lang_pred string, score double")


def held_out(id_col: str) -> Column:
    return crc_mod(id_col, FOLDS) == HELD_OUT


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """doc_id, held_out, lang_pred, score; learned from the rows that are not held out."""
    rows = docs.filter(~held_out(id_col)).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    return predict(docs, learn(rows), id_col, text_col)


def known_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of docs that have a language: not `und`, and with grams that a language holds. Columns as in docs."""
    rows = docs.filter(~held_out(id_col)).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(learn(rows))
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            langs, score = shared.value.predict(b.column(at).to_pylist())
            yield b.filter(pa.array([k != "und" and s > 0 for k, s in zip(langs, score)], pa.bool_()))

    return map_arrow(docs, run, docs.schema)
