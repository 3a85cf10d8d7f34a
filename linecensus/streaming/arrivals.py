"""Counting files as they arrive: the same stateless steps on a stream, and running totals by language."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import native
from ..operators import count, report
from ..plans.catalog import Catalog


def counted_stream(spark: SparkSession, folder: str, schema: str, catalog: Catalog | None = None) -> DataFrame:
    """Parquet files of rows (name, language, content) that keep arriving in a folder, counted."""
    rows = spark.readStream.schema(schema).parquet(folder)
    return count.count(rows.withColumn("lines", native.file_lines(F.col("content"))), catalog)


def running_totals(counted: DataFrame) -> DataFrame:
    """By language, for update or complete mode; the state is a row for each language."""
    return report.by_language(counted)
