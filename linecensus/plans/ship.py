"""Makes this package importable on executors that do not have it on their path, and bounds what its functions hold there."""

from __future__ import annotations

import ctypes
import tempfile
import zipfile
from collections.abc import Callable, Iterator
from functools import wraps
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()
#: Bytes of an Arrow batch, at most (a larger row comes alone).
BATCH = 8 << 20


def trim() -> None:
    """Give a worker's free memory back: workers are kept, and several share an executor."""
    getattr(ctypes.CDLL(None), "malloc_trim", lambda _: 0)(0)


def lean(f: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """f on batches, in a worker that trims its memory when the task ends."""

    @wraps(f)
    def run(batches):
        import pyarrow as pa

        pa.set_memory_pool(pa.system_memory_pool())
        try:
            yield from f(batches)
        finally:
            trim()

    return run


def ship(spark: SparkSession) -> None:
    """Once for each application: send the package's sources along, as --py-files would. Lowers the session's limit of bytes in a batch to BATCH where it is higher."""
    limit = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(limit)) > BATCH:
        spark.conf.set(limit, str(BATCH))
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    _shipped.add(sc.applicationId)
    root = Path(__file__).resolve().parents[1]
    to = Path(tempfile.mkdtemp(prefix="linecensus-src-")) / f"{root.name}.zip"
    with zipfile.ZipFile(to, "w") as z:
        for p in sorted(root.rglob("*")):
            if p.suffix in (".py", ".def"):
                z.write(p, p.relative_to(root.parent))
    sc.addPyFile(str(to))
