"""BPE encoding and decoding over a table of distinct words.

A word is a run without spaces and line feeds. The tokenizers handled here drop white space
before anything else, other kinds of it inside a word too, so a text's ids are those of its
words in order. Spark splits the texts into words. Runs of rows with about CHUNK words form a chunk: its vocabulary and, for
each word, its place there. A first scan deals the vocabularies out by hashes of the words,
in packed rows (bucket, chunk, places in the vocabulary, words); these meet by bucket, each
distinct word is encoded once, and its ids go back to the chunks that asked. A second scan
turns each chunk into a skeleton, the places of its words, which is joined with the answers
by chunk; ids follow by position. So neither words nor texts are shuffled once for each
occurrence. Decoding joins the ids of each text with the id-to-piece table, whose size is
the vocabulary's and which every task holds, and sets the pieces in order, as the tokenizer
without a decoder does: with spaces between.

A chunk's key is a hash of its rows, so both scans, and any repeated task, agree on it; a
skeleton that misses an answer stops the job rather than return wrong ids. Rows that come
out of a shuffle, whose order may change from scan to scan, are saved first.

Defined results: a null text is the empty text: 0 tokens and digests of nothing. Repeated
rows each give a row; a null id stays null. A text of any length is encoded whole; it is
held in one task. Nothing but id and text columns is read.
"""

from __future__ import annotations

import hashlib
import os
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, parts, save

CHUNK = 5_000_000  # words of a chunk, about
SLICE = 200_000  # words that are assembled at once, unless one text has more


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@lru_cache(maxsize=2)
def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    tok.no_truncation()
    tok.no_padding()
    if tok.decoder is not None or '"Removed"' not in tok.to_str():
        raise ValueError("only tokenizers that drop white space and have no decoder split into words this way")
    return tok


@lru_cache(maxsize=2)
def _pieces(path: str) -> pa.Array:
    """The id-to-piece table."""
    vocab = _tokenizer(path).get_vocab(with_added_tokens=True)
    out = [""] * (max(vocab.values()) + 1)
    for piece, i in vocab.items():
        out[i] = piece
    return pa.array(out, pa.string())


def words_of(text: Column) -> Column:
    """Cut at spaces and line feeds, literally: a pattern of all white space takes three times as long."""
    return F.array_remove(F.split(F.replace(F.coalesce(text.cast("string"), F.lit("")), F.lit("\n"), F.lit(" ")), " ", -1), "")


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list, np.ndarray, np.ndarray, pa.Array]]:
    """Rows (id, words) -> (key, ids, words of each row, places of the words, vocabulary)."""

    def done(ids: list, counts: list, coded: list) -> tuple:
        whole = pa.chunked_array(coded).unify_dictionaries()
        vocab, codes = whole.chunk(0).dictionary, np.concatenate([c.indices.to_numpy() for c in whole.chunks]).astype(np.uint32)
        n, key = np.concatenate(counts), xxhash.xxh3_64(repr(ids).encode())
        for part in (n.tobytes(), codes.tobytes(), "\n".join(vocab.to_pylist()).encode()):
            key.update(part)
        return key.intdigest() - 2**63, ids, n, codes, vocab

    ids, counts, coded, size = [], [], [], 0
    for b in batches:
        if not b.num_rows:
            continue
        words = b.column(1)
        ids += b.column(0).to_pylist()
        counts.append(pc.list_value_length(words).to_numpy().astype(np.int32))
        coded.append(words.flatten().cast(pa.string()).dictionary_encode())
        size += int(counts[-1].sum())
        if size >= CHUNK:
            yield done(ids, counts, coded)
            ids, counts, coded, size = [], [], [], 0
    if ids:
        yield done(ids, counts, coded)


def _vocabulary(buckets: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, _, _, _, vocab in _chunks(batches):
            of = np.fromiter(map(xxhash.xxh3_64_intdigest, vocab.cast(pa.binary()).to_pylist()), np.uint64, len(vocab)) % np.uint64(buckets)
            order = np.argsort(of, kind="stable")
            cuts = np.flatnonzero(np.diff(of[order])) + 1
            out = []
            for places in np.split(order, cuts) if len(order) else []:
                text = "\n".join(vocab.take(pa.array(places)).to_pylist()).encode()
                out.append((int(of[places[0]]), key, len(places), _pack(places), len(text), pa.compress(text, "zstd", asbytes=True)))
                if len(out) >= 50:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), WORDS_SCHEMA)], schema=WORDS_SCHEMA)
                    out = []
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), WORDS_SCHEMA)], schema=WORDS_SCHEMA)

    return run


def _pack(codes: np.ndarray) -> bytes:
    return pa.compress(np.ascontiguousarray(codes.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes(), "zstd", asbytes=True)


def _unpack(data: bytes, n: int) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(data, n * 4, "zstd", asbytes=True), np.uint8).reshape(4, n) if n else np.zeros((4, 0), np.uint8)
    return np.ascontiguousarray(planes.T).view("<u4").ravel()


def _skeletons(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for key, ids, counts, codes, vocab in _chunks(batches):
        yield pa.RecordBatch.from_pydict({"chunk": [key], "kind": [1], "n": [len(codes)], "size": [len(vocab)], "ids": [ids], "lens": [counts.tobytes()], "data": [_pack(codes)]}, schema=ROWS_SCHEMA)


WORDS = "bucket long, chunk long, n long, places binary, bytes long, words binary"
WORDS_SCHEMA = pa.schema([("bucket", pa.int64()), ("chunk", pa.int64()), ("n", pa.int64()), ("places", pa.binary()), ("bytes", pa.int64()), ("words", pa.binary())])
ROWS = "chunk long, kind int, n long, size long, ids array<long>, lens binary, data binary"
ROWS_SCHEMA = pa.schema([("chunk", pa.int64()), ("kind", pa.int32()), ("n", pa.int64()), ("size", pa.int64()), ("ids", pa.list_(pa.int64())), ("lens", pa.binary()), ("data", pa.binary())])


def _encoder(path: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Packed words, by bucket -> answers: per chunk and bucket the places, the number of ids of each, the ids.

    A word is in one bucket and a bucket in one task, which holds the ids of the bucket's
    words and no others: so each distinct word is encoded once.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok, bucket, table = _tokenizer(path), None, {}
        for b in batches:
            for k in range(b.num_rows):
                row = b.slice(k, 1).to_pylist()[0]
                if row["bucket"] != bucket:
                    bucket, table = row["bucket"], {}
                words = pa.decompress(row["words"], row["bytes"], "zstd", asbytes=True).decode().split("\n")
                fresh = [w for w in words if w not in table]
                for a in range(0, len(fresh), 4096):
                    some = fresh[a : a + 4096]
                    table.update(zip(some, (array("I", e.ids).tobytes() for e in tok.encode_batch(some, add_special_tokens=False))))
                ids = [table[w] for w in words]
                lens = np.fromiter(map(len, ids), np.uint32, len(ids)) // 4
                flat = np.frombuffer(b"".join(ids), np.uint32)
                both = np.concatenate([_unpack(row["places"], row["n"]), lens])
                yield pa.RecordBatch.from_pydict({"chunk": [row["chunk"]], "kind": [0], "n": [row["n"]], "size": [len(flat)], "ids": [[]], "lens": [_pack(both)], "data": [_pack(flat)]}, schema=ROWS_SCHEMA)

    return encode


Finish = Callable[[list, np.ndarray, np.ndarray, pa.Array], pa.RecordBatch]


def _assembler(path: str, finish: Finish) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Answers, then skeletons, of each chunk -> finish(row ids, all token ids, where each text's begin and end, decoded texts), slice by slice."""

    def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = _pieces(path)
        chunk, got, table = None, [], None
        for row in (b.slice(k, 1).to_pylist()[0] for b in batches for k in range(b.num_rows)):
            if row["chunk"] != chunk:
                chunk, got, table = row["chunk"], [], None
            if row["kind"] == 0:
                got.append(row)
                continue
            if table is None:
                table = _table(got, row["size"])
                got = []
            lens, starts, flat = table
            codes, stops = _unpack(row["data"], row["n"]), np.cumsum(np.frombuffer(row["lens"], np.int32), dtype=np.int64)
            first = 0
            while first < len(stops):
                begin = int(stops[first - 1]) if first else 0
                last = max(first + 1, int(np.searchsorted(stops, begin + SLICE, "right")))
                some = codes[begin : int(stops[last - 1])]
                of_word = lens[some]
                ends = np.cumsum(of_word)
                ids = flat[np.repeat(starts[some] - ends + of_word, of_word) + np.arange(int(ends[-1]) if len(ends) else 0)]
                bounds = np.concatenate([[0], ends])[np.concatenate([[0], stops[first:last] - begin])]
                yield finish(row["ids"][first:last], ids, bounds, decoded(ids, bounds, pieces))
                first = last

    return assemble


def decoded(ids: np.ndarray, bounds: np.ndarray, pieces: pa.Array) -> pa.Array:
    """The texts of token ids, through the id-to-piece table."""
    joined = pieces.take(pa.array(ids.astype(np.int64)))
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), joined), " ")


def _table(got: list[dict], size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a chunk's vocabulary: number of ids, where they start, all ids."""
    lens, starts, seen = np.zeros(size, np.int64), np.zeros(size, np.int64), np.zeros(size, bool)
    flats, at = [np.zeros(0, np.uint32)], 0
    for row in got:
        head = _unpack(row["lens"], 2 * row["n"])
        places, counts = head[: row["n"]], head[row["n"] :].astype(np.int64)
        lens[places], starts[places], seen[places] = counts, at + np.cumsum(counts) - counts, True
        flats.append(_unpack(row["data"], row["size"]))
        at += row["size"]
    if not seen.all():
        raise RuntimeError("a chunk misses the ids of some of its words: its rows changed between two scans")
    return lens, starts, np.concatenate(flats)


def _steady(docs: DataFrame) -> DataFrame:
    """docs, or a saved copy if rows come out of a shuffle, in an order that may change from scan to scan."""
    return save(docs, "texts") if "Exchange" in docs._jdf.queryExecution().executedPlan().toString() else docs


def _run(docs: DataFrame, path: str, id_col: str, text_col: str, finish: Finish, ddl: str) -> DataFrame:
    n = parts(docs.sparkSession)
    texts = _steady(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))).select("id", words_of(F.col("text")).alias("words"))
    words = map_arrow(texts, _vocabulary(4 * n), WORDS)
    answers = map_arrow(words.repartition(n, "bucket").sortWithinPartitions("bucket"), _encoder(path), ROWS)
    both = answers.union(map_arrow(texts, _skeletons, ROWS)).repartition(n, "chunk").sortWithinPartitions("chunk", "kind")
    return map_arrow(both, _assembler(path, finish), ddl)


def encode(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids (array<int>), decoded (string): one row per row of docs."""

    def finish(rows: list, ids: np.ndarray, bounds: np.ndarray, shown: pa.Array) -> pa.RecordBatch:
        lists = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ids.astype(np.int32)))
        return pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), lists, shown], ["doc_id", "ids", "decoded"])

    return _run(docs, path or default_path(), id_col, text_col, finish, "doc_id long, ids array<int>, decoded string")


def digests(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: one row per row of docs."""

    def finish(rows: list, ids: np.ndarray, bounds: np.ndarray, shown: pa.Array) -> pa.RecordBatch:
        raw = memoryview(ids.astype("<u4").tobytes())
        ids_sha = [hashlib.sha256(raw[4 * a : 4 * z]).hexdigest() for a, z in zip(bounds[:-1].tolist(), bounds[1:].tolist())]
        shown_sha = [hashlib.sha256(x.as_buffer()).hexdigest() for x in shown]
        return pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array(np.diff(bounds).astype(np.int64)), pa.array(ids_sha, pa.string()), pa.array(shown_sha, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return _run(docs, path or default_path(), id_col, text_col, finish, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def decode(encoded: DataFrame, path: str | None = None, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id, decoded from the ids alone, by a DataFrame join with the id-to-piece table. The table is broadcast: its size is the vocabulary's."""
    spark = encoded.sparkSession
    path = path or default_path()
    table = spark.createDataFrame(list(enumerate(_pieces(path).to_pylist())), "id int, piece string")
    numbered = encoded.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"), F.col(ids_col).alias("ids"))
    rows = numbered.select("row", "doc_id", F.posexplode_outer("ids").alias("pos", "id"))
    joined = rows.join(F.broadcast(table), "id", "left")
    out = joined.groupBy("row", "doc_id").agg(F.array_sort(F.collect_list(F.when(F.col("piece").isNotNull(), F.struct("pos", "piece")))).alias("x"))
    return out.select("doc_id", F.array_join(F.transform("x", lambda x: x["piece"]), " ").alias("decoded"))
