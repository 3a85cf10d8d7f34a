"""Aggregates of file counts: by language, totals, cutoffs, percentages, scaled code."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.catalog import Catalog, builtin

MEASURES = ("blank", "comment", "code")
#: What a percentage is of: all lines of the column (t), code, code + comment, code + blank, all three.
DENOMINATORS = {"c": ("code",), "cm": ("code", "comment"), "cb": ("code", "blank"), "cmb": ("code", "comment", "blank")}


@dataclass(frozen=True)
class Cutoff:
    """Languages up to `value` of a measure (c code, f files, m comment, cm both) become "Other"; percent: of the total."""

    key: str
    value: float
    percent: bool = False

    @classmethod
    def parse(cls, text: str) -> Cutoff:
        key, _, value = text.partition(":")
        if key not in ("c", "f", "m", "cm") or not value:
            raise ValueError(f"not a cutoff: {text!r}")
        return cls(key, float(value.removesuffix("%")), value.endswith("%"))

    def measure(self) -> Column:
        return {"c": F.col("code"), "f": F.col("files"), "m": F.col("comment"), "cm": F.col("code") + F.col("comment")}[self.key]


def _sums(df: DataFrame, *by: str, files: Column | None = None) -> DataFrame:
    n = F.count("*") if files is None else F.sum(files)
    return df.groupBy(*by).agg(n.cast("long").alias("files"), *[F.coalesce(F.sum(m), F.lit(0)).cast("long").alias(m) for m in MEASURES])


def by_language(files: DataFrame) -> DataFrame:
    return _sums(files, "language")


def total(files: DataFrame) -> DataFrame:
    """One row: the SUM."""
    return _sums(files)


def with_sum(files: DataFrame, label: str = "SUM") -> DataFrame:
    """By language, and the SUM row, in one rollup."""
    out = files.rollup("language").agg(F.grouping("language").alias("g"), F.count("*").alias("files"), *[F.coalesce(F.sum(m), F.lit(0)).alias(m) for m in MEASURES])
    return out.withColumn("language", F.when(F.col("g") == 1, F.lit(label)).otherwise(F.col("language"))).drop("g")


def cutoff(languages: DataFrame, c: Cutoff, label: str = "Other") -> DataFrame:
    grand = languages.agg(F.sum(c.measure()).alias("grand"))  # one row, joined as a scalar
    limit = F.col("grand") * c.value / 100 if c.percent else F.lit(c.value)
    name = F.when(c.measure() <= limit, F.lit(label)).otherwise(F.col("language"))
    return _sums(languages.join(F.broadcast(grand)).withColumn("language", name), "language", files=F.col("files"))


def percentages(languages: DataFrame, of: str = "t") -> DataFrame:
    """blank, comment, code as percentages, two decimals; a divisor of 0 gives 0."""
    kept = languages.columns
    if of == "t":
        # one row, joined as a scalar: no task sees all rows
        languages = languages.join(F.broadcast(languages.agg(*[F.sum(m).alias(f"{m}__all") for m in MEASURES])))
        base = {m: F.col(f"{m}__all") for m in MEASURES}
    else:
        row = sum((F.col(k) for k in DENOMINATORS[of]), F.lit(0))
        base = dict.fromkeys(MEASURES, row)
    share = {m: F.when(b > 0, F.round(100.0 * F.col(m) / b, 2)).otherwise(F.lit(0.0)) for m, b in base.items()}
    return languages.select(*[share[c].alias(c) if c in share else F.col(c) for c in kept])


def extensions(pairs: DataFrame) -> DataFrame:
    """pairs: key, language. The extensions of each language, sorted, in one text."""
    return pairs.groupBy("language").agg(F.array_join(F.array_sort(F.collect_set("key")), ", ").alias("extensions"))


def scaled(files: DataFrame, catalog: Catalog | None = None) -> DataFrame:
    """files with the language's factor and `scaled` (code times factor; 1.0 where unknown)."""
    catalog = catalog or builtin()
    dim = catalog.frame(files.sparkSession, "languages").select("language", F.coalesce("scale", F.lit(1.0)).alias("factor"))
    out = files.join(F.broadcast(dim), "language", "left").withColumn("factor", F.coalesce("factor", F.lit(1.0)))
    return out.withColumn("scaled", F.col("code") * F.col("factor"))


def ordered(df: DataFrame, name: str = "language") -> DataFrame:
    """By code, largest first; then by name, paths by their parts."""
    return df.orderBy(F.col("code").desc(), F.split(name, "/") if name == "path" else F.col(name))


def sql_tables(files: DataFrame, run: int, project: str, timestamp: str, elapsed: float, catalog: Catalog | None = None) -> tuple[DataFrame, DataFrame]:
    """The `metadata` and `t` tables."""
    spark = files.sparkSession
    meta = spark.createDataFrame([(run, timestamp, project, elapsed)], "id long, timestamp string, Project string, elapsed_s double")
    parts = F.split("path", "/")
    folder = F.array_join(F.slice(parts, 1, F.greatest(F.lit(0), F.size(parts) - 1)), "/")
    rows = scaled(files, catalog).select(
        F.lit(run).cast("long").alias("id"), F.lit(project).alias("Project"), F.col("language").alias("Language"), F.col("path").alias("File"), folder.alias("File_dirname"), F.element_at(parts, -1).alias("File_basename"),
        F.col("blank").alias("nBlank"), F.col("comment").alias("nComment"), F.col("code").alias("nCode"), F.col("scaled").alias("nScaled"),
    )
    return meta, rows
