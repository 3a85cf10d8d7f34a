"""Regular expressions of the catalogue, written in Perl's dialect, for Python and for the JVM."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import lru_cache

#: Unicode White_Space, as the body of a character class (Python).
WHITE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
#: The same for Java and RE2.
WHITE_JVM = r"\t-\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
_CLASSES = {"alpha": "a-zA-Z", "digit": "0-9", "alnum": "a-zA-Z0-9", "upper": "A-Z", "lower": "a-z", "space": WHITE, "punct": r"!-/:-@\[-`{-~", "xdigit": "0-9a-fA-F"}
_PIECE = re.compile(r"\[:(\w+):\]|\\([0-3]?[0-7]{2})(?![0-9])|\\s|\\S|\\.|\[\^?\]?|\]|.", re.S)
_PIECE_OR_CLASS = re.compile(r"\\.|\[\^?\]?(?:\\.|[^\]\\])*\]|.", re.S)
_BLANK = re.compile(f"[{WHITE}]*\\Z")


def translate(pattern: str) -> str:
    """A Python pattern with the same matches: POSIX classes, octal escapes, and Unicode white space for \\s."""
    out, inside = [], False
    for m in _PIECE.finditer(pattern):
        p = m[0]
        if m[1] and inside:
            out.append(_CLASSES[m[1]])
        elif m[2]:
            out.append(f"\\x{int(m[2], 8):02x}")
        elif p == "\\s":
            out.append(WHITE if inside else f"[{WHITE}]")
        elif p == "\\S" and not inside:
            out.append(f"[^{WHITE}]")
        elif p[0] == "[" and not inside:
            inside = True
            out.append(p.replace("]", "\\]"))
        elif p[0] == "[":
            out.append("\\[" + p[1:].replace("]", "\\]"))
        else:
            inside = inside and p != "]"
            out.append(p)
    return "".join(out)


@lru_cache(maxsize=4096)
def compiled(pattern: str, caseless: bool = False) -> re.Pattern:
    return re.compile(translate(pattern), re.I if caseless else 0)


@lru_cache(maxsize=4096)
def finder(pattern: str) -> Callable[[str], re.Match | None]:
    """The compiled pattern's search; its match where ^ begins it, so that a search does not try every place of a line."""
    depth, alone = 0, pattern.removeprefix("(?i)").startswith("^")
    for m in _PIECE_OR_CLASS.finditer(pattern):
        depth += (m[0] == "(") - (m[0] == ")")
        alone = alone and not (m[0] == "|" and not depth)
    p = compiled(pattern)
    return p.match if alone else p.search


def jvm(pattern: str, caseless: bool = False) -> str:
    """The pattern for Spark's engine: Unix lines and Unicode classes."""
    text = re.sub(r"\[:(\w+):\]", lambda m: {"alpha": r"\p{Alpha}", "digit": "0-9", "alnum": r"\p{Alnum}", "space": r"\s"}.get(m[1], _CLASSES.get(m[1], "")), pattern)
    text = re.sub(r"\\([0-3]?[0-7]{2})(?![0-9])", lambda m: f"\\x{int(m[1], 8):02x}", text)
    return f"(?dU{'i' if caseless else ''}){text}"


def blank(line: str) -> bool:
    return _BLANK.match(line) is not None


def trim_left(line: str) -> str:
    return re.sub(f"\\A[{WHITE}]+", "", line)
