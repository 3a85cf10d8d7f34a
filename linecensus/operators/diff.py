"""Two trees compared: files aligned by path, lines by longest common subsequences."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.sequence import common, delta
from ..functions.steps import Context, Options, apply_chain, blanks_removed
from ..plans.catalog import Catalog, builtin
from ..plans.ship import lean, ship

EDITS = ("same", "modified", "added", "removed")
KINDS = ("blank", "comment", "code")


@dataclass(frozen=True)
class DiffOptions:
    ignore_whitespace: bool = False
    ignore_case: bool = False
    filters: Options = field(default_factory=Options)


def leading(left: DataFrame, right: DataFrame) -> tuple[int, int]:
    """Path parts to drop on each side, found from files whose base name is unique on both sides: the pair with the longest shared suffix, shortest prefixes."""
    name = F.element_at(F.split("path", "/"), -1)

    def unique(df: DataFrame, side: str) -> DataFrame:
        return df.select("path", name.alias("base")).groupBy("base").agg(F.count("*").alias("n"), F.min("path").alias(side)).filter("n = 1").drop("n")

    x, y = (F.reverse(F.split(c, "/")) for c in ("l", "r"))
    equal = F.transform(F.sequence(F.lit(0), F.least(F.size(x), F.size(y)) - 1), lambda i: F.get(x, i) == F.get(y, i))
    shared = F.coalesce(F.nullif(F.array_position(equal, False), F.lit(0)) - 1, F.size(equal))
    both = unique(left, "l").join(unique(right, "r"), "base").select((F.size(x) - shared).alias("a"), (F.size(y) - shared).alias("b"))
    got = both.agg(F.min("a"), F.min("b")).first()
    if got[0] is not None:
        return got[0], got[1]
    return tuple(_common_parts(df) for df in (left, right))


def _common_parts(df: DataFrame) -> int:
    """Leading folders that all paths of a side share (one file: its first part)."""
    got = df.agg(F.min("path"), F.max("path"), F.count("*")).first()  # all paths share what the least and the greatest share
    if not got[2]:
        return 0
    a, b = (p.split("/")[:-1] for p in got[:2])
    return next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b))) if got[2] > 1 else min(1, len(a))


def align(left: DataFrame, right: DataFrame, keys: tuple[int, int] | None = None) -> DataFrame:
    """key, left_path, right_path: a full outer join on paths without their leading parts. Of equal keys on a side the last path counts. One file on each side: a pair."""
    if keys is None:
        counts = [df.limit(2).count() for df in (left, right)]
        if counts == [1, 1]:
            one = [df.select("path").first()[0] for df in (left, right)]
            return left.sparkSession.createDataFrame([(one[0], *one)], "key string, left_path string, right_path string")
        keys = leading(left, right)

    def keyed(df: DataFrame, drop: int, side: str) -> DataFrame:
        parts = F.split("path", "/")
        return df.groupBy(F.array_join(F.slice(parts, drop + 1, F.size(parts)), "/").alias("key")).agg(F.max("path").alias(f"{side}_path"))

    return keyed(left, keys[0], "left").join(keyed(right, keys[1], "right"), "key", "full_outer")


def only_changed(files: DataFrame, root: str, changed: DataFrame) -> DataFrame:
    """files (path) whose path below root is among `changed` (path): the files that differ between two revisions."""
    names = changed.select(F.concat(F.lit(root.rstrip("/") + "/"), "path").alias("path")).distinct()
    return files.join(names, "path", "left_semi")


def by_file(files: DataFrame) -> DataFrame:
    """path, language, disposition, blank, comment, code: four rows per file, also the empty ones."""
    rows: list[Column] = [F.struct(F.lit(e).alias("disposition"), (F.col("disposition") == e).cast("long").alias("files"), *[F.col(f"{k}_{e}").alias(k) for k in KINDS]) for e in EDITS]
    return files.select(F.coalesce("left_path", "right_path").alias("path"), "language", F.inline(F.array(*rows)))


def _normal(lines: list[str], o: DiffOptions) -> list[str]:
    lines = ["".join(x.split()) for x in lines] if o.ignore_whitespace else lines
    return [x.lower() for x in lines] if o.ignore_case else lines


def _kinds(lines: list[str], language: str, name: str, catalog: Catalog, o: DiffOptions) -> tuple[int, list[str], list[str]]:
    """Blank lines, and the comment and code lines: what a comparison with its own stripped form removes or keeps."""
    entry = catalog.languages.get(language)
    solid = blanks_removed(lines, entry.continuation if entry else None, language if language != "COBOL" else "")
    code = apply_chain(solid, entry.chain, Context(language, name, o.filters), entry.continuation, language in catalog.script_languages) if entry and not entry.pseudo else solid
    pairs, comments, kept, i, j = [*common(solid, code), (len(solid), len(code))], [], [], 0, 0
    for a, b in pairs:
        changed = min(a - i, b - j)
        kept += solid[i : i + changed]
        comments += solid[i + changed : a]
        kept += solid[a : a + 1]
        i, j = a + 1, b + 1
    return len(lines) - len(solid), comments, kept


def pair_deltas(left: list[str] | None, right: list[str] | None, language: str, name: str, catalog: Catalog, o: DiffOptions) -> dict[str, tuple[int, int, int, int]]:
    """Of a pair (None: no such file): (same, modified, added, removed) for blank, comment and code."""
    sides = [_kinds(x, language, name, catalog, o) if x is not None else (0, [], []) for x in (left, right)]
    (lb, lm, lc), (rb, rm, rc) = sides
    if left is not None and left == right:
        return {"blank": (lb, 0, 0, 0), "comment": (len(lm), 0, 0, 0), "code": (len(lc), 0, 0, 0)}
    return {"blank": (0, 0, max(0, rb - lb), max(0, lb - rb)), "comment": delta(_normal(lm, o), _normal(rm, o)), "code": delta(_normal(lc, o), _normal(rc, o))}


def compare(left: DataFrame, right: DataFrame, catalog: Catalog | None = None, o: DiffOptions = DiffOptions(), keys: tuple[int, int] | None = None) -> DataFrame:
    """left, right: path, name, language, lines. One row per aligned file: language, disposition, and the twelve line tallies.

    A pair has its left file's language and is left out without one; a file on one side only is added or removed.
    """
    catalog = catalog or builtin()
    ship(left.sparkSession)
    cols = [f"{k}_{e}" for k in KINDS for e in EDITS]

    @F.pandas_udf(", ".join(f"{c} long" for c in cols))
    @lean
    def run(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
        for languages, names, lefts, rights in batches:
            out = []
            for language, name, x, y in zip(languages, names, lefts, rights):
                d = pair_deltas(None if x is None else list(x), None if y is None else list(y), language, name or "", catalog, o)
                out.append([n for k in KINDS for n in d[k]])
            yield pd.DataFrame(out, columns=cols)

    def side(df: DataFrame, s: str) -> DataFrame:
        return df.select(F.col("path").alias(f"{s}_path"), F.col("name").alias(f"{s}_name"), F.col("language").alias(f"{s}_language"), F.col("lines").alias(f"{s}_lines"))

    df = align(left, right, keys).join(side(left, "left"), "left_path", "left").join(side(right, "right"), "right_path", "left")
    df = df.withColumn("language", F.when(F.col("left_path").isNotNull(), F.col("left_language")).otherwise(F.col("right_language"))).filter("language is not null")
    what = F.when(F.col("left_path").isNull(), "added").when(F.col("right_path").isNull(), "removed").when(F.col("left_lines") == F.col("right_lines"), "same").otherwise("modified")
    df = df.withColumns({"disposition": what, "d": run("language", F.coalesce("left_name", "right_name"), "left_lines", "right_lines")})
    return df.select("key", "left_path", "right_path", "language", "disposition", *[F.col(f"d.{c}").alias(c) for c in cols])


def by_language(files: DataFrame) -> DataFrame:
    """language, disposition, files, blank, comment, code: four rows per language, also the empty ones."""
    sums = files.groupBy("language").agg(*[F.sum((F.col("disposition") == e).cast("long")).alias(f"files_{e}") for e in EDITS], *[F.sum(f"{k}_{e}").alias(f"{k}_{e}") for k in KINDS for e in EDITS])
    rows: list[Column] = [F.struct(F.lit(e).alias("disposition"), *[F.col(f"{k}_{e}").alias(k) for k in ("files", *KINDS)]) for e in EDITS]
    return sums.select("language", F.inline(F.array(*rows)))


def alignment_lines(files: DataFrame) -> DataFrame:
    """One text per file: == same, != modified, + added, - removed; sorted."""
    sign = F.when(F.col("disposition") == "same", "  == ").when(F.col("disposition") == "modified", "  != ").when(F.col("disposition") == "added", "  + ").otherwise("  - ")
    return files.select(F.concat(sign, F.coalesce("left_path", "right_path")).alias("value")).orderBy("value")
