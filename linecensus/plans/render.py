"""Reports as text, Markdown, JSON, YAML, CSV, XML and SQL. Inputs are the small aggregated rows, or file rows where asked for by file."""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from html import escape

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..operators.report import DENOMINATORS, MEASURES


@dataclass
class Report:
    """rows: dicts with language (and path, by file), files, blank, comment, code; ordered. seconds 0: no rates."""

    rows: list[dict]
    by_file: bool = False
    seconds: float = 0.0
    url: str = "linecensus"
    version: str = "0.1"
    sum_one: bool = False
    total: bool = False  # a column of all lines
    thousands: str = ""
    percent: list[dict] | None = None
    percent_of: str = "t"
    sums: dict = field(default_factory=dict)

    def __post_init__(self) -> None:
        self.sums = self.sums or {m: sum(r[m] for r in self.rows) for m in MEASURES} | {"files": sum(r.get("files", 1) for r in self.rows)}

    def header(self) -> str:
        lines = sum(self.sums[m] for m in MEASURES)
        return f"{self.url} v {self.version}  T={self.seconds:.2f} s ({self.sums['files'] / self.seconds:.1f} files/s, {lines / self.seconds:.1f} lines/s)" if self.seconds > 0 else ""


def grouped(n: int, mark: str) -> str:
    """Digits in threes from the right."""
    return f"{n:,}".replace(",", mark) if mark else str(n)


def _sum_percent(r: Report) -> dict:
    """The SUM row in percent: of itself by column, else of its own denominator; 0 where that is 0."""
    if r.percent_of == "t":
        return {m: 100.0 if r.sums[m] else 0.0 for m in MEASURES}
    base = sum(r.sums[m] for m in DENOMINATORS[r.percent_of])
    return {m: round(100.0 * r.sums[m] / base, 2) if base > 0 else 0.0 for m in MEASURES}


def _table(r: Report) -> tuple[list[str], list[list]]:
    """Header and rows of cells; numbers stay numbers."""
    head = ["File" if r.by_file else "Language", *([] if r.by_file else ["files"]), *MEASURES, *(["total"] if r.total else [])]
    rows = []
    for x in r.percent or r.rows:
        rows.append([x["path"] if r.by_file else x["language"], *([] if r.by_file else [x["files"]]), *(x[m] for m in MEASURES), *([sum(x[m] for m in MEASURES)] if r.total else [])])
    if r.sums["files"] > 1 or r.sum_one:
        s = _sum_percent(r) if r.percent else r.sums
        rows.append(["SUM:", *([] if r.by_file else [r.sums["files"]]), *(s[m] for m in MEASURES), *([sum(s[m] for m in MEASURES)] if r.total else [])])
    return head, rows


def text(r: Report) -> str:
    head, rows = _table(r)
    show = lambda v: v if isinstance(v, str) else f"{v:.2f}" if isinstance(v, float) else grouped(v, r.thousands)
    cells = [[show(v) for v in x] for x in rows]
    first = max([20, *(len(c[0]) for c in cells)])
    widths = [max([12, len(h), *(len(c[k]) for c in cells)]) for k, h in enumerate(head[1:], 1)]
    line = lambda c: "│ " + c[0].ljust(first) + "".join(f" │ {v:>{w}}" for v, w in zip(c[1:], widths)) + " │"
    rule = lambda a, b, c: a + b.join("─" * (w + 2) for w in [first, *widths]) + c
    has_sum = bool(cells) and cells[-1][0] == "SUM:"
    body = [line(c) for c in (cells[:-1] if has_sum else cells)]
    tail = [rule("├", "┼", "┤"), line(cells[-1])] if has_sum else []
    return "\n".join([*([r.header()] if r.header() else []), rule("┌", "┬", "┐"), line(head), rule("├", "┼", "┤"), *body, *tail, rule("└", "┴", "┘")]) + "\n"


def markdown(r: Report) -> str:
    head, rows = _table(r)
    out = ([r.header(), ""] if r.header() else []) + ["|".join(head), "|".join([":-------", *["-------:"] * (len(head) - 1)])]
    for x in rows:
        if x[0] == "SUM:" and r.by_file:
            x = [x[0], r.sums["files"], *x[1:]]  # the SUM row has a cell for files in either form
        out.append("|".join(str(v) for v in x))
    return "\n".join(out) + "\n"


def _tree(r: Report) -> dict:
    head = {"url": r.url, "version": r.version, "elapsed_seconds": r.seconds, "n_files": r.sums["files"], "n_lines": sum(r.sums[m] for m in MEASURES)}
    body = {x["path"]: {m: x[m] for m in MEASURES} | {"language": x["language"]} for x in r.rows} if r.by_file else {x["language"]: {"nFiles": x["files"]} | {m: x[m] for m in MEASURES} for x in r.rows}
    return {"header": head, **body, "SUM": {m: r.sums[m] for m in MEASURES} | {"nFiles": r.sums["files"]}}


def json_text(r: Report) -> str:
    return json.dumps(_tree(r), indent=1, ensure_ascii=False) + "\n"


def yaml(r: Report) -> str:
    out = ["---"]
    for key, values in _tree(r).items():
        shown = "'" + key.replace("'", "''") + "'" if r.by_file and key not in ("header", "SUM") else key
        out += [f"{shown}:", *(f"  {k}: {v}" for k, v in values.items())]
    return "\n".join(out) + "\n"


def csv_cell(v: object, mark: str = ",") -> str:
    s = str(v)
    return '"' + s.replace('"', '""') + '"' if mark in s or '"' in s or "\n" in s else s


def csv(r: Report, mark: str = ",") -> str:
    head = ["language", "filename", *MEASURES] if r.by_file else ["files", "language", *MEASURES]
    rows = [[x["language"], x["path"]] if r.by_file else [x["files"], x["language"]] for x in r.rows]
    out = [mark.join(head)] + [mark.join(csv_cell(v, mark) for v in [*a, *(x[m] for m in MEASURES)]) for a, x in zip(rows, r.rows)]
    out.append(mark.join(str(v) for v in [r.sums["files"], "SUM", *(r.sums[m] for m in MEASURES)]))
    return "\n".join(out) + "\n"


def xml(r: Report, xsl: str | None = None) -> str:
    q = lambda v: escape(str(v))
    kind, item = ("files", "file") if r.by_file else ("languages", "language")
    out = ['<?xml version="1.0" encoding="UTF-8"?>', *([f'<?xml-stylesheet type="text/xsl" href="{q(xsl)}"?>'] if xsl else []), "<results>", "<header>"]
    out += [f"  <{k}>{q(v)}</{k}>" for k, v in _tree(r)["header"].items()] + ["</header>", f"<{kind}>"]
    for x in r.rows:
        own = f'name="{q(x["path"])}"' if r.by_file else f'name="{q(x["language"])}" files_count="{x["files"]}"'
        out.append(f"  <{item} {own} " + " ".join(f'{m}="{x[m]}"' for m in MEASURES) + (f' language="{q(x["language"])}"' if r.by_file else "") + " />")
    own = "" if r.by_file else f'sum_files="{r.sums["files"]}" '
    return "\n".join([*out, f"  <total {own}" + " ".join(f'{m}="{r.sums[m]}"' for m in MEASURES) + " />", f"</{kind}>", "</results>"]) + "\n"


def grouped_column(n: Column, mark: str) -> Column:
    """grouped(), for a column."""
    return F.regexp_replace(n.cast("string"), r"(?<=\d)(?=(\d{3})+$)", mark)


def _escaped(path: Column, pairs: tuple[tuple[str, str], ...]) -> Column:
    for old, new in pairs:
        path = F.replace(path, F.lit(old), F.lit(new))
    return path


def file_line(kind: str, mark: str = ",") -> Column:
    """The line of a file (path, language, blank, comment, code) in a report by file: rendered where the rows are."""
    path, language, n = F.col("path"), F.col("language"), {m: F.col(m).cast("string") for m in MEASURES}
    if kind == "csv":
        cell = lambda v: F.when(F.contains(v, F.lit(mark)) | F.contains(v, F.lit('"')) | F.contains(v, F.lit("\n")), F.concat(F.lit('"'), F.replace(v, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(v)
        return F.concat_ws(mark, cell(language), cell(path), *n.values())
    if kind == "md":
        return F.concat_ws("|", path, *n.values())
    if kind == "yaml":
        return F.concat_ws("\n", F.concat(F.lit("'"), _escaped(path, (("'", "''"),)), F.lit("':")), *[F.concat(F.lit(f"  {m}: "), v) for m, v in n.items()], F.concat(F.lit("  language: "), language))
    if kind == "json":
        q = lambda v: F.substring(F.to_json(F.array(v)), F.lit(2), F.length(F.to_json(F.array(v))) - 2)
        return F.concat(q(path), F.lit(": {"), F.concat_ws(", ", *[F.concat(F.lit(f'"{m}": '), v) for m, v in n.items()]), F.lit(', "language": '), q(language), F.lit("}"))
    if kind == "xml":
        q = lambda v: _escaped(v, (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")))
        return F.concat(F.lit('  <file name="'), q(path), F.lit('"'), *[F.concat(F.lit(f' {m}="'), v, F.lit('"')) for m, v in n.items()], F.lit(' language="'), q(language), F.lit('" />'))
    raise ValueError(f"no lines by file in {kind!r}")


def insert_line(style: str = "") -> Column:
    """The insert of a row of the fact table."""

    def shown(name: str, kind: str) -> Column:
        if kind.startswith("varchar"):
            return F.concat(F.lit("'"), F.replace(name, F.lit("'"), F.lit("''")), F.lit("'"))
        return F.format_string("%.6f", name) if kind == "real" else F.col(name).cast("string")

    names = " (" + ", ".join(k for k, _ in FACTS) + ")" if style == "named_columns" else ""
    return F.concat(F.lit(f"insert into t{names} values("), F.concat_ws(", ", *[shown(k, v) for k, v in FACTS]), F.lit(");"))


#: The columns of the two SQL tables.
META = (("id", "integer primary key"), ("timestamp", "varchar(500)"), ("Project", "varchar(500)"), ("elapsed_s", "real"))
FACTS = (("id", "integer"), ("Project", "varchar(500)"), ("Language", "varchar(500)"), ("File", "varchar(500)"), ("File_dirname", "varchar(500)"), ("File_basename", "varchar(500)"), ("nBlank", "integer"), ("nComment", "integer"), ("nCode", "integer"), ("nScaled", "real"))


def sql(meta: dict, rows: list[dict], style: str = "", append: bool = False, batch: int = 10_000) -> str:
    """Inserts of the rows of `metadata` and `t`. style: "", named_columns (no metadata row) or oracle (no transactions)."""
    if style not in ("", "named_columns", "oracle"):
        raise ValueError(f"unknown SQL style {style!r}")
    q = lambda v: "'" + v.replace("'", "''") + "'" if isinstance(v, str) else f"{v:.6f}" if isinstance(v, float) else str(v)
    begin, commit = ([], []) if style == "oracle" else (["begin transaction;"], ["commit;"])
    out = [] if append else [f"create table {t} (" + ", ".join(f"{k} {v}" for k, v in cols) + (", foreign key (id) references metadata (id)" if t == "t" else "") + ");" for t, cols in (("metadata", META), ("t", FACTS))]
    out += begin
    if style != "named_columns":
        out.append("insert into metadata values(" + ", ".join(q(meta[k]) for k, _ in META) + ");")
    names = " (" + ", ".join(k for k, _ in FACTS) + ")" if style == "named_columns" else ""
    for k, x in enumerate(rows):
        if k and k % batch == 0:
            out += commit + begin
        out.append(f"insert into t{names} values(" + ", ".join(q(x[c]) for c, _ in FACTS) + ");")
    return "\n".join([*out, *commit]) + "\n"


FORMATS = {"text": text, "md": markdown, "json": json_text, "yaml": yaml, "csv": csv, "xml": xml}


# --- differences ---------------------------------------------------------------

EDITS = ("same", "modified", "added", "removed")


def diff_text(rows: list[dict], thousands: str = "") -> str:
    """By language, four lines each, then the SUM."""
    names = sorted({x["language"] for x in rows})
    have = {(x["language"], x["disposition"]): x for x in rows}
    cols = ("files", *MEASURES)
    have |= {("SUM", e): {k: sum(x[k] for x in rows if x["disposition"] == e) for k in cols} for e in EDITS}
    out = ["Language".ljust(24) + "".join(c.rjust(14) for c in cols)]
    for n in [*names, "SUM"]:
        out.append(n)
        out += [f" {e}".ljust(24) + "".join(grouped(have.get((n, e), dict.fromkeys(cols, 0))[k], thousands).rjust(14) for k in cols) for e in EDITS]
    return "\n".join(out) + "\n"


def diff_json(rows: list[dict]) -> str:
    """By disposition; rows of zeros are left out; a SUM in each block."""
    cols, out = ("files", *MEASURES), {}
    for e in EDITS:
        mine = [x for x in rows if x["disposition"] == e]
        block = {x.get("path", x["language"]): {"nFiles" if k == "files" else k: x[k] for k in cols if k in x} for x in mine if any(x.get(k) for k in cols)}
        out[e] = block | {"SUM": {"nFiles" if k == "files" else k: sum(x.get(k, 0) for x in mine) for k in cols}}
    return json.dumps(out, indent=1, ensure_ascii=False) + "\n"


def diff_csv(rows: list[dict], mark: str = ",") -> str:
    cols = ("disposition", "language", "files", *MEASURES)
    kept = [x for e in EDITS for x in rows if x["disposition"] == e and any(x[k] for k in cols[2:])]
    return "\n".join([mark.join(cols), *(mark.join(csv_cell(x[k], mark) for k in cols) for x in kept)]) + "\n"


def html_page(name: str, lines: list[str], flags: list[bool]) -> str:
    """An annotated copy: non-blank lines marked code or comment, each kind numbered on its own."""
    numbers, out, k = {True: 0, False: 0}, [], 0
    for x in lines:
        if not x.strip():
            out.append("<br>")
            continue
        numbers[flags[k]] += 1
        out.append(f'<span class="{"code" if flags[k] else "comment"}"><span class="n">{numbers[flags[k]]}</span> {escape(x)}</span>')
        k += 1
    return f"<!DOCTYPE html><html><head><meta charset='utf-8'><title>{escape(name)}</title></head><body><pre>\n" + "\n".join(out) + "\n</pre></body></html>\n"
