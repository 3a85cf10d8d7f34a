"""The language catalogue: text definitions, edits at run time, and its tables as DataFrames."""

from __future__ import annotations

import json
import pkgutil
from dataclasses import dataclass, field
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession

from ..functions.steps import STEPS

#: Extensions and names that are never source text.
NOT_CODE_EXTENSIONS = frozenset("1 2 3 4 5 6 7 8 9 a ai avi bak bmp bz2 class com dat data dia dll doc docx dump dvi dylib eps exe gif gz hdf ico ico in jar jpeg jpg lib log mp3 mpeg mpg o obj out pdf png ps so svgz swf tar tgz tif tiff ttf wav woff xls xlsx zip".split())
NOT_CODE_NAMES = frozenset("AUTHORS BUGS BUILD_INFO CHANGES COPYING COPYING2 CREDITS CVSROOT ChangeLog Changelog DESCRIPTION FAQ INSTALL LICENSE MAINTAINERS MANIFEST NEWS PORTING README README.Unix README.VMS RELEASE THANKS TODO TODO_LIST Entries Repository Root Tag".split())
ARITY = {"remove_matches": 1, "remove_inline": 1, "rm_comments_in_strings": 2, "remove_between_general": 2, "remove_between_regex": 2, "replace_between_regex": 3, "replace_regex": 1, "remove_above": 1, "remove_below": 1, "remove_below_above": 2, "call_regexp_common": 1, "pre_post_fix": 2}
PROPERTIES = {"extension": "extensions", "filename": "names", "script_exe": "scripts", "prefix": "prefixes"}


class DefinitionError(ValueError):
    pass


@dataclass
class Language:
    name: str
    chain: list[tuple[str, list[str]]] = field(default_factory=list)
    scale: float | None = None
    continuation: str | None = None

    @property
    def pseudo(self) -> bool:
        return any(n == "die" for n, _ in self.chain)


@dataclass
class Catalog:
    languages: dict[str, Language] = field(default_factory=dict)
    extensions: dict[str, str] = field(default_factory=dict)
    names: dict[str, str] = field(default_factory=dict)
    scripts: dict[str, str] = field(default_factory=dict)
    prefixes: dict[str, str] = field(default_factory=dict)
    not_code_extensions: set[str] = field(default_factory=lambda: set(NOT_CODE_EXTENSIONS))
    not_code_names: set[str] = field(default_factory=lambda: set(NOT_CODE_NAMES))
    everything: str | None = None

    def __post_init__(self) -> None:
        self.not_code_extensions -= set(self.extensions)
        self.not_code_names -= set(self.names)

    @property
    def script_languages(self) -> set[str]:
        return set(self.scripts.values())

    def merged(self, new: Catalog) -> Catalog:
        """New definitions added: a known language (one with a scale) keeps its chain and gains names."""
        known = {k for k, v in self.languages.items() if v.scale is not None}
        both = {t: getattr(self, t) | getattr(new, t) for t in PROPERTIES.values()}
        return Catalog({**self.languages, **{k: v for k, v in new.languages.items() if k not in known}}, **both, not_code_extensions=set(self.not_code_extensions), not_code_names=set(self.not_code_names))

    def replaced(self, new: Catalog) -> Catalog:
        """Only the new definitions; prefixes and what is not code stay."""
        return Catalog(new.languages, new.extensions, new.names, new.scripts, self.prefixes | new.prefixes, set(self.not_code_extensions), set(self.not_code_names))

    def forced(self, language: str | None = None, extension: str | None = None, script: str | None = None) -> Catalog:
        """A language for an extension, an interpreter, or (with neither) every file."""
        if language not in self.languages:
            raise DefinitionError(f"unknown language {language!r}")
        out = Catalog(self.languages, dict(self.extensions), dict(self.names), dict(self.scripts), self.prefixes, set(self.not_code_extensions), set(self.not_code_names))
        if extension:
            out.extensions[extension] = language
            out.not_code_extensions.discard(extension)
        elif script:
            out.scripts[script] = language
        else:
            out.everything = language
        return out

    def frame(self, spark: SparkSession, table: str) -> DataFrame:
        """A dimension: `extensions`, `names`, `scripts`, `prefixes` (key, language), `not_code_*` (key) or `languages`."""
        if table == "languages":
            return spark.createDataFrame([(v.name, v.scale, v.continuation, v.pseudo, v.name in self.script_languages, [" ".join([n, *a]) for n, a in v.chain]) for v in self.languages.values()], "language string, scale double, continuation string, pseudo boolean, script boolean, chain array<string>")
        got = getattr(self, table)
        if isinstance(got, dict):
            return spark.createDataFrame(sorted(got.items()), "key string, language string")
        return spark.createDataFrame([(k,) for k in sorted(got)], "key string")


def _step(words: list[str], where: str) -> tuple[str, list[str]]:
    """A filter of a chain, checked: a known name with all its arguments."""
    name, *args = words or [""]
    if name not in STEPS:
        raise DefinitionError(f"{where}: unknown filter {name}")
    if len(args) < ARITY.get(name, 0):
        raise DefinitionError(f"{where}: {name} needs {ARITY[name]} arguments")
    return name, args


#: The tables of a catalogue in JSON.
TABLES = {"extensions": "language_by_extension", "scripts": "language_by_script", "names": "language_by_file_type", "prefixes": "language_by_prefix"}


def from_json(text: str) -> Catalog:
    """A catalogue from JSON: the tables by key, filters_by_language (lists of a name and its arguments), scale_factor,
    eol_continuation_re, extension_collision (choice -> extensions), not_code_extension and not_code_filename."""
    try:
        raw = json.loads(text)
    except ValueError as e:
        raise DefinitionError(f"not JSON: {e}") from e
    if not isinstance(raw, dict):
        raise DefinitionError("a catalogue is a JSON object")
    tables = {}
    for own, key in TABLES.items():
        tables[own] = raw.get(key, {})
        if not isinstance(tables[own], dict) or not all(isinstance(v, str) for v in tables[own].values()):
            raise DefinitionError(f"{key}: not an object of texts")
    tables["extensions"] = tables["extensions"] | {e: choice for choice, es in raw.get("extension_collision", {}).items() for e in es}
    chains, scales, ends = (raw.get(k, {}) for k in ("filters_by_language", "scale_factor", "eol_continuation_re"))
    names = {*chains, *scales, *ends, *(v for t in tables.values() for v in t.values())}
    languages = {n: Language(n, [_step(list(map(str, f)), n) for f in chains.get(n, [])], float(scales[n]) if n in scales else None, ends.get(n)) for n in sorted(names)}
    return Catalog(languages, **tables, not_code_extensions=set(raw.get("not_code_extension", [])), not_code_names=set(raw.get("not_code_filename", [])))


def to_json(catalog: Catalog) -> str:
    """What from_json reads."""
    own = catalog.languages.values()
    raw = {key: getattr(catalog, t) for t, key in TABLES.items()} | {"filters_by_language": {v.name: [[n, *a] for n, a in v.chain] for v in own}, "scale_factor": {v.name: v.scale for v in own if v.scale is not None}, "eol_continuation_re": {v.name: v.continuation for v in own if v.continuation}}
    return json.dumps(raw | {"not_code_extension": sorted(catalog.not_code_extensions), "not_code_filename": sorted(catalog.not_code_names)}, indent=1, sort_keys=True, ensure_ascii=False)


def parse(text: str) -> Catalog:
    """Definitions: a language at the line's start, its properties indented; # starts a comment line."""
    out, now = Catalog(not_code_extensions=set(), not_code_names=set()), None
    for number, raw in enumerate(text.splitlines(), 1):
        if not raw.strip() or raw.lstrip().startswith("#"):
            continue
        if not raw[0].isspace():
            now = out.languages.setdefault(raw.strip(), Language(raw.strip()))
            continue
        key, _, value = raw.strip().partition(" ")
        value = value.strip()
        if now is None:
            raise DefinitionError(f"line {number}: {key} before any language")
        if key == "filter":
            now.chain.append(_step(value.split(), f"line {number}"))
        elif key in PROPERTIES:
            getattr(out, PROPERTIES[key])[value] = now.name
        elif key == "3rd_gen_scale":
            now.scale = float(value)
        elif key == "end_of_line_continuation":
            now.continuation = value
        else:
            raise DefinitionError(f"line {number}: unknown property {key}")
    return out


def definitions(catalog: Catalog, shared: bool = False) -> str:
    """The catalogue as text. Unresolved choices are left out; shared: their extensions go to each language they may mean."""
    have: dict[str, dict[str, list[str]]] = {}
    for prop, table in PROPERTIES.items():
        for key, language in sorted(getattr(catalog, table).items()):
            entry = catalog.languages.get(language)
            targets = [language]
            if entry and entry.pseudo and shared and prop == "extension":
                targets = [t for t in language.split("/") if t in catalog.languages and not any(v == t for v in catalog.extensions.values())]
            for t in targets:
                have.setdefault(t, {}).setdefault(prop, []).append(key)
    out = []
    for v in sorted(catalog.languages.values(), key=lambda v: v.name):
        if v.pseudo or "Brain" in v.name or "(unknown)" in v.name:
            continue
        out.append(v.name)
        out += [f"    filter {' '.join([n, *a])}" for n, a in v.chain]
        out += [f"    {p} {k}" for p in PROPERTIES for k in have.get(v.name, {}).get(p, ())]
        out += [f"    3rd_gen_scale {v.scale:.2f}"] if v.scale is not None else []
        out += [f"    end_of_line_continuation {v.continuation}"] if v.continuation else []
    return "\n".join(out) + "\n"


@lru_cache(maxsize=1)
def builtin() -> Catalog:
    got = parse(pkgutil.get_data(__package__, "languages.def").decode())
    return Catalog(got.languages, got.extensions, got.names, got.scripts, got.prefixes)
