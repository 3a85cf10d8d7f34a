"""Blank, comment and code lines of files."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import native
from ..functions.steps import Context, NotCountable, Options, apply_chain, blanks_removed, counted
from ..plans.catalog import Catalog, builtin
from ..plans.ship import lean, ship


@dataclass(frozen=True)
class CountOptions:
    filters: Options = field(default_factory=Options)
    skip_leading: int = 0
    skip_leading_exts: tuple[str, ...] = ()
    ignore_regex: tuple[str, ...] = ()


def _trimmed(files: DataFrame, o: CountOptions) -> DataFrame:
    """--skip-leading: N first lines off, for all or some extensions."""
    if not o.skip_leading:
        return files
    cut = F.slice("lines", o.skip_leading + 1, F.greatest(F.lit(0), F.size("lines") - o.skip_leading))
    return files.withColumn("lines", F.when(F.col("ext").isin(*o.skip_leading_exts), cut).otherwise(F.col("lines")) if o.skip_leading_exts else cut)


def count_native(files: DataFrame, language: str, catalog: Catalog | None = None, o: CountOptions = CountOptions()) -> DataFrame:
    """Files of one language whose chain has a Column form: blank, comment, code without leaving the JVM."""
    entry = (catalog or builtin()).languages[language]
    plain = native.chain(F.col("solid"), entry.chain, entry.continuation, language in (catalog or builtin()).script_languages)
    if plain is None or o.filters != Options() or language in ("COBOL", "X++"):
        raise ValueError(f"{language} has no Column form under these options")
    df = _trimmed(files, o).withColumn("solid", native.blanks_removed(F.col("lines"), entry.continuation))
    df = df.withColumn("stripped", plain)
    code = F.col("stripped")
    for p in o.ignore_regex:
        code = F.filter(code, lambda x, p=p: ~x.rlike(native.jvm(p)))
    n = {"blank": F.size("lines") - F.size("solid"), "comment": F.greatest(F.lit(0), F.size("solid") - F.size("stripped")), "code": F.size(code)}
    return df.withColumns({k: v.cast("long") for k, v in n.items()}).drop("solid", "stripped")


def count(files: DataFrame, catalog: Catalog | None = None, o: CountOptions = CountOptions()) -> DataFrame:
    """files (language, name, lines) with blank, comment, code and `count_error` (null if counted). One Arrow-batched function for all languages."""
    catalog = catalog or builtin()
    ship(files.sparkSession)
    languages, scripts = catalog.languages, catalog.script_languages

    @F.pandas_udf("blank long, comment long, code long, error string")
    @lean
    def tally(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for names, files_, lines in batches:
            out = []
            for language, file, x in zip(names, files_, lines):
                entry = languages.get(language)
                try:
                    if entry is None:
                        raise NotCountable(f"unknown language {language}")
                    out.append((*counted(list(x) if x is not None else [], entry.chain, Context(language, file or "", o.filters), entry.continuation, language in scripts, o.ignore_regex), None))
                except NotCountable as e:
                    out.append((None, None, None, str(e)))
            yield pd.DataFrame(out, columns=["blank", "comment", "code", "error"]).astype({k: "Int64" for k in ("blank", "comment", "code")})

    df = _trimmed(files, o).withColumn("c", tally("language", "name", "lines"))
    return df.withColumns({k: F.col(f"c.{k}") for k in ("blank", "comment", "code")} | {"count_error": F.col("c.error")}).drop("c")


def strip(files: DataFrame, catalog: Catalog | None = None, options: Options = Options()) -> DataFrame:
    """files (language, name, lines) with `solid` (non-blank) and `stripped` (code) lines."""
    catalog = catalog or builtin()
    ship(files.sparkSession)
    languages, scripts = catalog.languages, catalog.script_languages

    @F.pandas_udf("solid array<string>, stripped array<string>")
    @lean
    def run(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for names, files_, lines in batches:
            out = []
            for language, file, x in zip(names, files_, lines):
                entry, x = languages.get(language), list(x) if x is not None else []
                if entry is None or entry.pseudo:
                    out.append((x, x))
                    continue
                solid = blanks_removed(x, entry.continuation)
                out.append((solid, apply_chain(solid, entry.chain, Context(language, file or "", options), entry.continuation, language in scripts)))
            yield pd.DataFrame(out, columns=["solid", "stripped"])

    return files.withColumn("c", run("language", "name", "lines")).withColumns({"solid": F.col("c.solid"), "stripped": F.col("c.stripped")}).drop("c")
