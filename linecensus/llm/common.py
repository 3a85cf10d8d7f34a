"""What the operators share: the shared folder, saved intermediate tables, and small column helpers."""

from __future__ import annotations

import atexit
import ctypes
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import partial

import pyarrow as pa
from pyarrow import RecordBatch
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.ship import ship

#: White space of the word contract, as a Java, Python and RE2 class body.
SPACE = r"\x20\x09-\x0D"
WORD = rf"[^{SPACE}]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names. Where it is unset, a local session (tests) gets one; on a cluster that is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="linecensus-")
        atexit.register(shutil.rmtree, found, True)
        found = f"file://{found}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def save(df: DataFrame, name: str, **options: str) -> DataFrame:
    """df written as Parquet in the shared folder and reread: cuts the lineage, survives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def forget(df: DataFrame) -> None:
    """Delete the folder of a saved table that nothing reads any more (loops)."""
    jvm = df.sparkSession._jvm
    for d in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(d)
        path.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_of(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def crc_mod(name: str, n: int) -> Column:
    """crc32 of the id as text, modulo n; a null id counts as the empty text."""
    return F.crc32(F.encode(F.coalesce(F.col(name).cast("string"), F.lit("")), "UTF-8")) % n


#: Bytes of an Arrow batch, at most (a larger row comes alone), and rows of a table that may be broadcast.
BATCH, FEW = 8 << 20, 200_000


def _lean(f: Callable[[Iterator[RecordBatch]], Iterator[RecordBatch]], batches: Iterator[RecordBatch]) -> Iterator[RecordBatch]:
    """f, in a worker that gives its free memory back when the task ends: workers are kept, and several share an executor."""
    pa.set_memory_pool(pa.system_memory_pool())
    try:
        yield from f(batches)
    finally:
        getattr(ctypes.CDLL(None), "malloc_trim", lambda _: 0)(0)


def map_arrow(df: DataFrame, f: Callable[[Iterator[RecordBatch]], Iterator[RecordBatch]], ddl: str) -> DataFrame:
    """mapInArrow. Lowers the session's limit of bytes in a batch to BATCH where it is higher."""
    spark, limit = df.sparkSession, "spark.sql.execution.arrow.maxBytesPerBatch"
    ship(spark)
    if int(spark.conf.get(limit).rstrip("b")) > BATCH:
        spark.conf.set(limit, str(BATCH))
    return df.mapInArrow(partial(_lean, f), ddl)


def few(df: DataFrame) -> DataFrame:
    """df, narrow and cheap to read again, to be broadcast if it has FEW rows at most; beyond that joins shuffle it."""
    return F.broadcast(df) if df.limit(FEW + 1).count() <= FEW else df
