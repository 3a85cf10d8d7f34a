"""File-level predicates: each file keeps or gets the first reason why it is left out, in a fixed order."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.patterns import jvm


@dataclass(frozen=True)
class Selection:
    skip_hidden: bool = False
    match_f: str = ""
    not_match_f: tuple[str, ...] = ()
    match_d: str = ""
    fullpath: bool = False
    exclude_ext: tuple[str, ...] = ()
    max_mb: float | None = None
    binaries: bool = False


def looks_binary(head: Column) -> Column:
    """Of a first block: a NUL, or more than a third of its bytes are neither text nor UTF-8 sequences.

    UTF-8 sequences are taken out by a pattern over the bytes as Latin-1 characters; a sequence cut
    off at the end counts as text.
    """
    text = F.decode(head, "ISO-8859-1")
    tail = r"[\x{80}-\x{BF}]"
    known = rf"[\x{{C2}}-\x{{DF}}](?:{tail}|\z)|[\x{{E0}}-\x{{EF}}](?:{tail}{{2}}|{tail}?\z)|[\x{{F0}}-\x{{F4}}](?:{tail}{{3}}|{tail}{{0,2}}\z)"
    rest = F.regexp_replace(F.regexp_replace(text, known, ""), r"[\x20-\x7F\n\r\x08\t\f\x1B]", "")
    return F.contains(text, F.lit("\0")) | (F.length(rest) * 3 > F.octet_length(head))


def reasons(s: Selection) -> list[tuple[Column, str]]:
    """(left out if, reason), in order."""
    subject, found = (F.col("path") if s.fullpath else F.col("name")), ~F.col("explicit")
    out = [(F.col("error").isNotNull(), None)]
    if s.skip_hidden:
        out.append((found & F.col("name").startswith("."), "hidden file"))
    if s.match_f:
        out.append((found & ~subject.rlike(jvm(s.match_f)), "did not match --match-f"))
    out += [(found & subject.rlike(jvm(p)), "matched --not-match-f") for p in s.not_match_f]
    if s.match_d:
        out.append((found & ~F.col("dir").rlike(jvm(s.match_d)), "directory did not match --match-d"))
    if s.exclude_ext:
        out.append((F.coalesce(F.col("ext").isin(*s.exclude_ext), F.lit(False)), "excluded extension"))
    out.append((F.col("length") == 0, "zero sized file"))
    if s.max_mb is not None:
        out.append((F.col("length") / 1048576.0 > s.max_mb, "exceeds --max-file-size"))
    if not s.binaries:
        out.append((F.coalesce(looks_binary(F.col("head")), F.lit(False)), "binary file"))
    return out


def select(files: DataFrame, s: Selection = Selection()) -> DataFrame:
    """files with `reason`: null for those to count. One row per path."""
    reason = F.lit(None).cast("string")
    for wrong, why in reversed(reasons(s)):
        reason = F.when(wrong, F.col("error") if why is None else F.lit(why)).otherwise(reason)
    return files.withColumn("reason", reason)
