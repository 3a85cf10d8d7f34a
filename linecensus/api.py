"""The whole run as lazy DataFrames: scan, select, drop copies, classify, count."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import native
from .operators import classify, count, dedupe, select
from .plans.catalog import Catalog, builtin
from .sources.tree import scan



@dataclass(frozen=True)
class RunOptions:
    selection: select.Selection = field(default_factory=select.Selection)
    classification: classify.ClassifyOptions = field(default_factory=classify.ClassifyOptions)
    counting: count.CountOptions = field(default_factory=count.CountOptions)
    include_ext: tuple[str, ...] = ()
    include_lang: tuple[str, ...] = ()
    exclude_lang: tuple[str, ...] = ()
    skip_uniqueness: bool = False
    source: tuple[tuple[str, object], ...] = ()  # options of the tree source


@dataclass
class Run:
    """counted: path, name, language, blank, comment, code; ignored: path, reason."""

    counted: DataFrame
    ignored: DataFrame
    classified: DataFrame


def _why(df: DataFrame, reason) -> DataFrame:
    return df.select("path", reason.alias("reason"))


def run(spark: SparkSession, paths: list[str], o: RunOptions = RunOptions(), catalog: Catalog | None = None) -> Run:
    return run_files(scan(spark, paths, **dict(o.source)), o, catalog)


def run_files(files: DataFrame, o: RunOptions = RunOptions(), catalog: Catalog | None = None) -> Run:
    """files: the columns of the tree source, from any table."""
    catalog = catalog or builtin()
    files = select.select(files, o.selection)
    ignored = _why(files.filter("reason is not null"), F.col("reason"))
    kept = files.filter("reason is null")
    if not o.skip_uniqueness:
        known = classify.by_name(kept.withColumn("first_line", F.lit("")), catalog, o.classification).withColumn("known", F.col("candidate").isNotNull())
        marked = dedupe.mark_duplicates(known.drop("candidate", "skip_reason", "first_line"), "content", "known")
        ignored = ignored.unionByName(_why(marked.filter("duplicate_of is not null"), F.concat(F.lit("duplicate of "), "duplicate_of")))
        kept = marked.filter("duplicate_of is null")
    if o.include_ext:
        wanted = F.coalesce(F.col("ext").isin(*o.include_ext), F.lit(False))
        ignored = ignored.unionByName(_why(kept.filter(~wanted), F.lit("not in --include-ext")))
        kept = kept.filter(wanted)
    done = classify.classify(kept.withColumn("lines", native.file_lines(F.col("content"))).drop("head", "content"), catalog, o.classification)
    reason = F.col("skip_reason")
    if o.include_lang:
        reason = F.coalesce(reason, F.when(~F.col("language").isin(*o.include_lang), F.lit("not in --include-lang")))
    if o.exclude_lang:
        reason = F.coalesce(reason, F.when(F.col("language").isin(*o.exclude_lang), F.lit("in --exclude-lang")))
    done = done.withColumn("skip_reason", reason)
    tallied = count.count(done.filter("skip_reason is null"), catalog, o.counting)
    ignored = ignored.unionByName(_why(done.filter("skip_reason is not null"), F.col("skip_reason"))).unionByName(_why(tallied.filter("count_error is not null"), F.col("count_error")))
    counted = tallied.filter("count_error is null").select("path", "name", "language", "blank", "comment", "code")
    return Run(counted, ignored, done.filter("skip_reason is null"))
