"""WARC archives: write with an index first, read back by coalesced byte ranges.

Rows are decided before they are written: of equal payloads of at least REVISIT bytes the
row with the largest id is the response, the others are revisits of it (the decision joins
narrow rows of ids and digests; only then do ids meet the pages). Each task writes one
archive of gzip members, one per record, under a name of its own attempt, and returns the
index rows: file, offset, length, url, digest and id. What a lost or repeated task left
behind is in no index row. The archive folder is opened through pyarrow's file systems, so
it may be any store that pyarrow and Spark both reach; here it is the shared folder.

Reading takes index rows, deals them out by file and SEGMENT, sorts them by offset and
joins ranges that lie within GAP bytes into reads of at most READ bytes (a longer record
is read whole). Every record's length, payload digest and id are verified against its
index row; a mismatch stops the job.

Defined results: null html is the empty payload; a null url is written as about:blank; a
null id is never referred to, unless no row of its payload has an id: then all of them are
responses. Rows with the same id and payload are all responses if one is. A payload of any
length is one record. Columns other than id, url and html are not read, whatever their names.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, parts, save, shared_dir

REVISIT = 1000
SEGMENT = 8 << 20
GAP = 64 << 10
READ = 4 << 20
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
INDEX = "file string, offset long, length long, url string, digest string, page_id long, record_type string, refers_to long"


def _fields(pairs: list[tuple[str, str]]) -> bytes:
    return "".join(f"{k}: {v}\r\n" for k, v in pairs).encode()


def _line(text: str) -> str:
    """A header value: white space and control characters are percent-encoded."""
    return "".join(c if c > " " and c != "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in text)


def _urn(page_id: int | None) -> str:
    return f"<urn:page:{'none' if page_id is None else page_id}>"


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None = None) -> bytes:
    """One uncompressed WARC/1.1 record; with refers_to, a revisit."""
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    http = b"HTTP/1.1 200 OK\r\n" + _fields([("Content-Type", "text/html; charset=utf-8"), ("Content-Length", str(len(payload)))]) + b"\r\n"
    block = http if refers_to is not None else http + payload
    head = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", _urn(page_id)), ("WARC-Date", DATE), ("WARC-Target-URI", _line(url or "about:blank")), ("WARC-Payload-Digest", f"sha1:{digest}")]
    if refers_to is not None:
        head += [("WARC-Profile", PROFILE), ("WARC-Refers-To", _urn(refers_to))]
    head += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + _fields(head) + b"\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """Header fields (names in lower case), HTTP header fields, payload of one record."""
    if not data.startswith(b"WARC/1."):
        raise ValueError("not a WARC record")

    def fields(raw: bytes) -> dict[str, str]:
        return {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in raw.decode().split("\r\n")[1:])}

    head, _, rest = data.partition(b"\r\n\r\n")
    known = fields(head)
    n = int(known["content-length"])
    if len(rest) != n + 4 or rest[n:] != b"\r\n\r\n":
        raise ValueError("a record's block has another length than its header says")
    http, _, payload = rest[:n].partition(b"\r\n\r\n")
    return known, fields(http), payload


def _store(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def _writer(folder: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = _store(folder)
        context, out, name, at = TaskContext.get(), None, "", 0
        for b in batches:
            found = []
            for page_id, url, html, refers_to in zip(*(c.to_pylist() for c in b.columns)):
                if out is None:
                    name = f"part-{context.partitionId():06d}-{context.taskAttemptId()}-{uuid.uuid4().hex[:8]}.warc.gz"
                    out = store.open_output_stream(f"{base}/{name}", compression=None)
                payload = (html or "").encode()
                member = gzip.compress(record(page_id, url, payload, refers_to), 5, mtime=0)
                out.write(member)
                found.append((name, at, len(member), url, hashlib.sha1(payload).hexdigest(), page_id, "response" if refers_to is None else "revisit", refers_to))
                at += len(member)
            if found:
                schema = pa.schema([("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("url", pa.string()), ("digest", pa.string()), ("page_id", pa.int64()), ("record_type", pa.string()), ("refers_to", pa.int64())])
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found), schema)], schema=schema)
        if out is not None:
            out.close()

    return write


def decided(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, html, refers_to (null: a response)."""
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("html"))
    rows = rows.withColumn("digest", F.sha1(F.encode("html", "UTF-8")))
    long = rows.filter(F.octet_length("html") >= REVISIT).select("page_id", "digest")
    owners = long.groupBy("digest").agg(F.max("page_id").alias("owner"), F.count("*").alias("n")).filter("n > 1 and owner is not null").select("digest", "owner")
    revisits = long.join(owners, "digest").filter(~F.col("page_id").eqNullSafe(F.col("owner"))).distinct()
    revisits = revisits.select(F.col("page_id").alias("r_id"), F.col("digest").alias("r_digest"), F.col("owner").alias("refers_to"))
    return rows.join(revisits, (rows["digest"] == revisits["r_digest"]) & rows["page_id"].eqNullSafe(revisits["r_id"]), "left").select("page_id", "url", "html", "refers_to")


def write(pages: DataFrame, folder: str, **names: str) -> DataFrame:
    """Writes the archives of pages into a folder (created); their index, saved."""
    store, base = _store(folder)
    store.create_dir(base, recursive=True)
    return save(map_arrow(decided(pages, **names), _writer(folder), INDEX), "warc-index")


def _reader(folder: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = _store(folder)
        name, source = None, None
        for b in batches:
            rows, k = b.to_pylist(), 0
            while k < len(rows):
                first, z = rows[k], k + 1
                stop = first["offset"] + first["length"]
                while z < len(rows) and rows[z]["file"] == first["file"] and rows[z]["offset"] - stop <= GAP and rows[z]["offset"] + rows[z]["length"] - first["offset"] <= READ:
                    stop = max(stop, rows[z]["offset"] + rows[z]["length"])
                    z += 1
                if first["file"] != name:
                    if source is not None:
                        source.close()
                    name, source = first["file"], store.open_input_file(f"{base}/{first['file']}")
                data, out = source.read_at(stop - first["offset"], first["offset"]), []
                for r in rows[k:z]:
                    at = r["offset"] - first["offset"]
                    out.append(_checked(r, zlib.decompress(data[at : at + r["length"]], 31)))
                schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)
                k = z
        if source is not None:
            source.close()

    return read


def _checked(row: dict, data: bytes) -> tuple:
    head, http, payload = parse(data)
    digest = base64.b32decode(head["warc-payload-digest"].removeprefix("sha1:")).hex()
    kind = head["warc-type"]
    page_id, refers_to = (None if x in (None, "none") else int(x) for x in (head.get(k, "<urn:page:none>")[10:-1] for k in ("warc-record-id", "warc-refers-to")))
    if digest != row["digest"] or page_id != row["page_id"] or kind != row["record_type"] or kind == "response" and (hashlib.sha1(payload).hexdigest() != digest or len(payload) != int(http["content-length"])):
        raise ValueError(f"record at {row['offset']} of {row['file']} differs from its index row")
    return page_id, head["warc-target-uri"], int(http["content-length"]), digest, kind, refers_to, payload


def read(index: DataFrame, folder: str) -> DataFrame:
    """The records of (selected) index rows: page_id, url, payload_bytes, payload_digest, record_type, refers_to, payload (empty for revisits)."""
    n = parts(index.sparkSession)
    dealt = index.withColumn("segment", F.floor(F.col("offset") / SEGMENT)).repartition(n, "file", "segment").sortWithinPartitions("file", "offset").drop("segment")
    return map_arrow(dealt, _reader(folder), "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary")


def round_trip(pages: DataFrame, **names: str) -> DataFrame:
    """pages written to archives in the shared folder and read back: one row per page, without payloads."""
    folder = f"{shared_dir(pages.sparkSession)}/warc-{uuid.uuid4().hex}"
    return read(write(pages, folder, **names), folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
