"""Column expressions: decoding, blank lines, comment grammars and the steps that need no memory."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .patterns import WHITE_JVM, jvm
from .steps import DIALECTS

BLANK = rf"\A[{WHITE_JVM}]*\z"
#: Byte order marks, longest first.
MARKS = ("2B2F76382D", "0000FEFF", "FFFE0000", "2B2F7638", "2B2F7639", "2B2F762B", "2B2F762F", "DD736673", "84319533", "EFBBBF", "F7644C", "0EFEFF", "FBEE28", "FEFF", "FFFE")


def decoded(content: Column) -> Column:
    """Bytes -> text: one byte order mark off; UTF-8 if valid, else one character for each byte."""
    bare = content
    for mark in reversed(MARKS):
        n = len(mark) // 2
        bare = F.when(F.hex(F.substring(content, 1, n)) == mark, F.substring(content, n + 1, 2**31 - 1)).otherwise(bare)
    text = bare.cast("string")
    return F.when(F.is_valid_utf8(text), text).otherwise(F.decode(bare, "ISO-8859-1"))


def split_lines(text: Column, empty: Column | None = None) -> Column:
    """Text -> lines without terminators: one final LF and a CR at each line's end dropped; no text, no lines."""
    lines = F.transform(F.split(F.regexp_replace(text, "\n\\z", ""), "\n", -1), lambda x: F.regexp_replace(x, "\r\\z", ""))
    none = F.array().cast("array<string>")
    return F.when(text.isNull() | (F.length(text) == 0 if empty is None else empty), none).otherwise(lines)


def file_lines(content: Column) -> Column:
    """Bytes -> lines; a file of only a byte order mark has one blank line, an empty one has none."""
    return split_lines(decoded(content), content.isNull() | (F.octet_length(content) == 0))


def folder(path: Column) -> Column:
    """What is before the last /; nothing if there is none."""
    parts = F.split(path, "/")
    return F.array_join(F.slice(parts, 1, F.greatest(F.lit(0), F.size(parts) - 1)), "/")


def extension(path: Column) -> Column:
    """What follows the last dot of the name; null if that dot is first or there is none."""
    name = F.element_at(F.split(path, "/"), -1)
    return F.when(name.rlike(r"(?s)\A.+\."), F.substring_index(name, ".", -1))


def is_blank(line: Column) -> Column:
    return line.rlike(BLANK)


def blanks_removed(lines: Column, continuation: str | None = None) -> Column:
    """Blank lines dropped; one whose previous line matches the continuation stays."""
    if not continuation:
        return F.filter(lines, lambda x: ~is_blank(x))
    goes_on = jvm(continuation, True)
    return F.filter(lines, lambda x, i: ~is_blank(x) | ((i > 0) & F.coalesce(F.concat(F.get(lines, i - 1), F.lit("\n")).rlike(goes_on), F.lit(False))))


def strip_comments(text: Column, dialect: str) -> Column:
    return F.regexp_replace(text, DIALECTS[dialect], "")


def _matches(pattern: str, caseless: bool = False) -> Callable[[Column], Column]:
    return lambda x: F.concat(x, F.lit("\n")).rlike(jvm(pattern, caseless))


def _first_match(lines: Column, pattern: str) -> Column:
    """1-based place of the first match, 0 if there is none."""
    return F.array_position(F.transform(lines, _matches(pattern)), True)


#: Steps as (lines, arguments, newlines present) -> lines.
NATIVE: dict[str, Callable[[Column, list[str], bool], Column]] = {
    "remove_matches": lambda l, a, n: F.filter(l, lambda x: ~_matches(a[0], True)(x)),
    "remove_above": lambda l, a, n: F.when(_first_match(l, a[0]) > 0, F.slice(l, F.greatest(F.lit(1), _first_match(l, a[0])), F.size(l) + 1)).otherwise(l),
    "remove_below": lambda l, a, n: F.when(_first_match(l, a[0]) > 0, F.slice(l, F.lit(1), F.greatest(F.lit(0), _first_match(l, a[0]) - 1))).otherwise(l),
    "call_regexp_common": lambda l, a, n: F.split(strip_comments(F.array_join(F.transform(l, lambda x: F.concat(x, F.lit(("\n" if n else "") + ("\n" if a[0] == "C++" else "")))), ""), a[0]), "\n", -1),
    "remove_f77_comments": lambda l, a, n: F.filter(l, lambda x: ~x.rlike(rf"\A[*cC]|\A[{WHITE_JVM}]*!")),
    "remove_f90_comments": lambda l, a, n: F.filter(l, lambda x: ~_matches(r"^(\s*!|\s*$)")(x) | _matches(r"^\s*!(hpf|omp)\$", True)(x)),
    "remove_jcl_comments": lambda l, a, n: F.filter(NATIVE["remove_below"](l, [r"^\s*//\s*$"], n), lambda x: ~is_blank(x) & ~x.startswith("//*")),
    "remove_bf_comments": lambda l, a, n: F.filter(F.transform(l, lambda x: F.regexp_replace(x, r"[^<>+\-.,\[\]]", "")), lambda x: x != ""),
    "powershell_to_C": lambda l, a, n: F.transform(l, lambda x: F.replace(F.replace(x, F.lit("<#"), F.lit("/*")), F.lit("#>"), F.lit("*/"))),
    "smarty_to_C": lambda l, a, n: F.transform(l, lambda x: F.replace(F.replace(x, F.lit("{*"), F.lit("/*")), F.lit("*}"), F.lit("*/"))),
    "add_newlines": lambda l, a, n: l,
    "pre_post_fix": lambda l, a, n: F.concat(F.array(F.concat(F.lit(a[0]), F.coalesce(F.get(l, F.lit(0)), F.lit("")))), F.slice(l, 2, F.greatest(F.lit(0), F.size(l) - 1)), F.array(F.lit(a[1]))),
    "rm_last_line": lambda l, a, n: F.slice(l, 1, F.greatest(F.lit(0), F.size(l) - 1)),
}


def chain(lines: Column, steps: list[tuple[str, list[str]]], continuation: str | None = None, script: bool = False) -> Column | None:
    """The chain (default options) as one expression over non-blank lines; None if a step has no Column form."""
    active = [(s, a) for s, a in steps if s not in ("rm_comments_in_strings", "remove_inline")]
    if any(s not in NATIVE for s, _ in active):
        return None
    out, newlines = lines, True
    for s, a in active:
        out = blanks_removed(NATIVE[s](out, a, newlines), continuation)
        newlines = s == "add_newlines" or newlines and s not in ("pre_post_fix", "call_regexp_common")
    if script:
        head = F.get(lines, F.lit(0))
        out = F.when(head.startswith("#!") & ~F.get(out, F.lit(0)).eqNullSafe(head), F.concat(F.array(head), out)).otherwise(out)
    return F.when(F.size(lines) == 0, lines).otherwise(out)
