"""Exact duplicates by content: the file to keep, and for the others whose copy they are."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def mark_duplicates(files: DataFrame, content: str = "content", known: str | None = None) -> DataFrame:
    """files with `duplicate_of`: null for the kept file of each content.

    Kept is the first path in byte order; if `known` names a boolean column, the last known file
    after the first instead, where there is one. Only keys and paths meet in the aggregation
    (length and SHA-256; minima and maxima are pre-aggregated). The join that marks the files
    takes their other columns along, contents too, unless the keys to join are broadcast.
    """
    key = [F.octet_length(content).alias("k_length"), F.sha2(F.col(content).cast("binary"), 256).alias("k_digest")]
    good = F.col(known) if known else F.lit(False)
    narrow = files.select("path", *key, good.alias("good"))
    first = narrow.groupBy("k_length", "k_digest").agg(F.min("path").alias("first"), F.max(F.when(F.col("good"), F.col("path"))).alias("last"))
    keep = F.when(F.col("last") > F.col("first"), F.col("last")).otherwise(F.col("first"))
    pick = first.select("k_length", "k_digest", keep.alias("keep"))
    keyed = files.withColumns({"k_length": F.octet_length(content), "k_digest": F.sha2(F.col(content).cast("binary"), 256)})
    out = keyed.join(pick, ["k_length", "k_digest"], "left")
    return out.withColumn("duplicate_of", F.when(F.col("path") != F.col("keep"), F.col("keep"))).drop("k_length", "k_digest", "keep")
