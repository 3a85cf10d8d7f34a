"""Language of each file: a cascade of lookups joined from the catalogue, then resolvers on the content."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.resolve import content_needed, resolved
from ..plans.catalog import Catalog, builtin
from ..plans.ship import lean, ship


@dataclass(frozen=True)
class ClassifyOptions:
    autoconf: bool = False
    ignore_case_ext: bool = False
    lang_no_ext: str | None = None
    no_autogen: bool = False


def _lookup(df: DataFrame, catalog: Catalog, table: str, key: str, out: str) -> DataFrame:
    """Left join with a dimension of the catalogue, whose size is the catalogue's (hundreds of rows)."""
    dim = catalog.frame(df.sparkSession, table)
    value = F.col("language") if "language" in dim.columns else F.lit(True)
    return df.join(F.broadcast(dim.select(F.col("key").alias(key), value.alias(out))), key, "left")


def interpreter(line: Column) -> Column:
    """Of a #! line: the program's base name; env's first word that sets no variable."""
    words = F.filter(F.split(F.substring(line, 3, 2**31 - 1), r"[\s]+"), lambda w: w != "")
    base = F.element_at(F.split(F.get(words, F.lit(0)), "/"), -1)
    named = F.get(F.filter(F.slice(words, F.lit(2), F.greatest(F.lit(0), F.size(words) - 1)), lambda w: ~w.contains("=")), F.lit(0))
    return F.when(line.startswith("#!"), F.when(base == "env", F.element_at(F.split(named, "/"), -1)).otherwise(base))


def by_name(files: DataFrame, catalog: Catalog, o: ClassifyOptions = ClassifyOptions()) -> DataFrame:
    """files (name, first_line) with `candidate` (a language or an unresolved choice) or `skip_reason`."""
    if catalog.everything:
        return files.withColumns({"candidate": F.lit(catalog.everything), "skip_reason": F.lit(None).cast("string")})
    kept = files.columns
    df = files.withColumn("c_name", F.regexp_replace("name", r"\.in\z", "") if o.autoconf else F.col("name"))
    parts = F.split("c_name", r"\.", -1)
    for n in (3, 2, 1):
        ext = F.array_join(F.slice(parts, F.greatest(F.lit(1), F.size(parts) - n + 1), F.lit(n)), ".")
        df = df.withColumn(f"c_ext{n}", F.when(F.size(parts) > n, F.lower(ext) if o.ignore_case_ext else ext))
    df = df.withColumns({"c_low": F.lower("c_name"), "c_program": interpreter(F.col("first_line"))})
    df = _lookup(_lookup(df, catalog, "not_code_names", "c_name", "c_not_name"), catalog, "names", "c_name", "c_whole")
    steps = [(F.col("c_not_name").isNotNull(), None, F.concat(F.lit("listed in Not_Code_Filename: "), "c_name")), (F.col("c_name").endswith("~"), None, "temporary editor file"), (F.col("c_whole").isNotNull(), F.col("c_whole"), None)]
    for n in (3, 2, 1):
        df = _lookup(_lookup(df, catalog, "not_code_extensions", f"c_ext{n}", f"c_no{n}"), catalog, "extensions", f"c_ext{n}", f"c_is{n}")
        steps += [(F.col(f"c_no{n}").isNotNull(), None, F.concat(F.lit("listed in Not_Code_Extension: "), f"c_ext{n}")), (F.col(f"c_is{n}").isNotNull(), F.col(f"c_is{n}"), None)]
    dotted, stem = F.contains("c_name", F.lit(".")), F.regexp_replace("c_name", r"\.[^.]*\z", "")
    prefix = F.lit(None).cast("string")
    for p in sorted(catalog.prefixes, key=len):  # the longest is tested first
        prefix = F.when(F.startswith(stem, F.lit(p)), F.lit(catalog.prefixes[p])).otherwise(prefix)
    df = df.withColumn("c_prefix", prefix)
    df = _lookup(_lookup(df, catalog, "names", "c_low", "c_lower"), catalog, "scripts", "c_program", "c_script")
    steps += [(dotted & F.col("c_prefix").isNotNull(), F.col("c_prefix"), None), (~dotted & F.col("c_lower").isNotNull(), F.col("c_lower"), None)]
    if o.lang_no_ext:
        steps.append((~dotted, F.lit(o.lang_no_ext), None))
    line = F.col("first_line")
    steps += [
        (line.isNull(), None, "language unknown (empty file)"), (F.col("c_script").isNotNull(), F.col("c_script"), None),
        (line.contains("<?xml ") | line.contains("<?xml\t"), F.lit("XML"), None), (F.lit(True), None, "language unknown"),
    ]
    language, reason = F.lit(None).cast("string"), F.lit(None).cast("string")
    for test, name, why in reversed(steps):
        language = F.when(test, F.lit(None) if name is None else name).otherwise(language)
        reason = F.when(test, F.lit(why) if why is None or isinstance(why, str) else why).otherwise(reason)
    return df.withColumns({"candidate": language, "skip_reason": reason}).select(*kept, "candidate", "skip_reason")


def classify(files: DataFrame, catalog: Catalog | None = None, o: ClassifyOptions = ClassifyOptions()) -> DataFrame:
    """files (name, lines) with exactly one of `language` and `skip_reason`. Content is read only where a choice is open."""
    catalog = catalog or builtin()
    ship(files.sparkSession)
    no_autogen = o.no_autogen

    @F.pandas_udf("language string, skip_reason string")
    @lean
    def look(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for names, lines in batches:
            yield pd.DataFrame([resolved(n, list(x), no_autogen) if x is not None else (n, None) for n, x in zip(names, lines)], columns=["language", "skip_reason"])

    df = by_name(files.withColumn("first_line", F.get("lines", F.lit(0))), catalog, o)
    asked = [k for k in {*catalog.extensions.values(), *catalog.names.values()} if content_needed(k)]
    open_choice = F.col("candidate").isin(*asked) if asked else F.lit(False)
    df = df.withColumn("c_got", look(F.col("candidate"), F.when(open_choice, F.col("lines"))))
    return df.withColumns({"language": F.col("c_got.language"), "skip_reason": F.coalesce("skip_reason", "c_got.skip_reason")}).drop("candidate", "c_got", "first_line")
