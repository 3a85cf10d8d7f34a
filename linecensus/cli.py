"""Command line: python -m linecensus.cli PATH... The options select, count, compare and render."""

from __future__ import annotations

import argparse
import os
import time
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import api
from .functions import native
from .functions.steps import Options
from .functions.sequence import code_flags
from .operators import classify, count, diff, report, select
from .plans import catalog as catalogs
from .plans import render
from .sources import inputs


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="linecensus", description="Counts blank, comment and code lines of source files.")
    p.add_argument("paths", nargs="*")

    def flags(*names: str) -> None:
        for n in names:
            p.add_argument(f"--{n}", action="store_true")

    def values(*names: str, kind: type = str) -> None:
        for n in names:
            p.add_argument(f"--{n}", type=kind)

    flags("by-file", "quiet", "hide-rate", "json", "yaml", "csv", "md", "xml", "sum-one", "html", "original-dir", "sql-append")
    values("report-file", "csv-delimiter", "thousands-delimiter", "by-percent", "summary-cutoff", "xsl", "sql", "sql-project", "sql-style", "diff-timeout", "timeout")
    flags("percent", "fullpath", "no-recurse", "follow-links", "read-binary-files", "skip-win-hidden", "strip-str-comments", "inline", "docstring-as-code", "no-autogen", "autoconf", "ignore-case-ext")
    values("fmt", "processes", kind=int)
    values("max-file-size", kind=float)
    values("exclude-dir", "exclude-ext", "exclude-lang", "include-lang", "include-ext", "match-f", "match-d", "not-match-d", "skip-leading", "lang-no-ext")
    for n in ("not-match-f", "ignore-regex", "force-lang", "script-lang"):
        p.add_argument(f"--{n}", action="append", default=[])
    flags("diff", "count-and-diff", "git", "git-diff-rel", "git-diff-all", "ignore-whitespace", "ignore-case", "include-submodules", "skip-uniqueness")
    values("diff-alignment", "list-file", "vcs", "extract-with", "skip-archive", "sdir", "ignored")
    values("read-lang-def", "force-lang-def", "write-lang-def", "write-lang-def-incl-dup", "explain")
    for n in ("show-lang", "show-ext"):
        p.add_argument(f"--{n}", action="store_true")
    return p


def split_list(text: str | None) -> tuple[str, ...]:
    return tuple(dict.fromkeys(x.strip() for x in (text or "").split(",") if x.strip()))


def catalog_of(a: argparse.Namespace) -> catalogs.Catalog:
    c = catalogs.builtin()
    read = lambda f: (catalogs.from_json if f.endswith(".json") else catalogs.parse)(open(f, encoding="utf-8").read())
    c = c.replaced(read(a.force_lang_def)) if a.force_lang_def else c
    c = c.merged(read(a.read_lang_def)) if a.read_lang_def else c
    for text in a.force_lang:
        language, _, ext = text.partition(",")
        c = c.forced(language, extension=ext or None)
    for text in a.script_lang:
        language, _, program = text.partition(",")
        c = c.forced(language, script=program)
    return c


def options_of(a: argparse.Namespace) -> api.RunOptions:
    n, _, exts = (a.skip_leading or "0").partition(",")
    source = {"recurse": not a.no_recurse, "follow_links": a.follow_links, "exclude_dirs": list(split_list(a.exclude_dir)), "not_match_d": a.not_match_d or "", "listed": bool(a.vcs)}
    return api.RunOptions(
        select.Selection(a.skip_win_hidden, a.match_f or "", tuple(a.not_match_f), a.match_d or "", a.fullpath, split_list(a.exclude_ext), a.max_file_size, a.read_binary_files),
        classify.ClassifyOptions(a.autoconf, a.ignore_case_ext, a.lang_no_ext, a.no_autogen),
        count.CountOptions(Options(a.strip_str_comments, a.inline, a.docstring_as_code, a.no_autogen), int(n), split_list(exts), tuple(a.ignore_regex)),
        split_list(a.include_ext), split_list(a.include_lang), split_list(a.exclude_lang), a.skip_uniqueness, tuple(source.items()),
    )


def paths_of(a: argparse.Namespace, paths: list[str]) -> list[str]:
    """Listed, exported, unpacked or version-controlled inputs as paths."""
    paths = [*paths, *(inputs.list_file(a.list_file) if a.list_file else [])]
    if a.git or a.git_diff_rel or a.git_diff_all or a.diff or a.count_and_diff:
        paths = [inputs.export(p, to=inputs.numbered(a.sdir)) if not os.path.exists(p) and inputs.is_revision(p) else p for p in paths]
    if a.skip_archive:
        import re

        paths = [p for p in paths if not re.search(f"(?:{a.skip_archive})$", p)]
    paths = inputs.expanded(paths, a.sdir, a.extract_with)
    if a.vcs:
        subs = [] if a.include_submodules else [os.path.basename(s) for p in paths if os.path.isdir(os.path.join(p, ".git")) for s in inputs.submodules(p)]
        return inputs.vcs_files(a.vcs, paths, (*split_list(a.exclude_dir), *subs))
    return paths


def _shared(spark: SparkSession, a: argparse.Namespace, paths: list[str]) -> None:
    """Unpacked files must be where executors see them: on a cluster --sdir has to name such a folder."""
    unpacks = a.extract_with or any(inputs.archive_kind(p) for p in paths) or any(not os.path.exists(p) for p in paths)
    if unpacks and not a.sdir and not spark.sparkContext.master.startswith("local"):
        raise SystemExit("archives and revisions need --sdir, a folder that all executors share")


def count_report(spark: SparkSession, a: argparse.Namespace, paths: list[str], c: catalogs.Catalog) -> str:
    began = time.time()
    _shared(spark, a, paths)
    out = api.run(spark, paths_of(a, paths), options_of(a), c)
    counted = out.counted.persist()  # rendered more than once
    try:
        by_file = a.by_file or a.fmt in (3, 4, 5)
        rows = counted if by_file else report.by_language(counted)
        if a.summary_cutoff and not by_file:
            rows = report.cutoff(rows, report.Cutoff.parse(a.summary_cutoff))
        shown = [r.asDict() for r in report.ordered(rows, "path" if by_file else "language").collect()]
        if a.ignored:
            with open(a.ignored, "w", encoding="utf-8") as f:
                f.writelines(f"{r['path']}: {r['reason']}\n" for r in out.ignored.orderBy("path").toLocalIterator())
        if a.html:
            write_html(out.classified, c, options_of(a), a.original_dir)
        seconds = 0.0 if a.hide_rate else time.time() - began
        if a.sql:
            now = int(time.time())
            meta, facts = report.sql_tables(counted, now, a.sql_project or os.getcwd(), datetime.fromtimestamp(now, UTC).strftime("%Y-%m-%d %H:%M:%S"), seconds, c)
            return render.sql(meta.first().asDict(), [r.asDict() for r in facts.orderBy(F.col("nCode").desc(), "File").toLocalIterator()], a.sql_style or "", a.sql_append)
        percent = None
        if a.percent or a.by_percent:
            shares = report.percentages(rows, a.by_percent or "t")
            of = {r["path" if by_file else "language"]: r.asDict() for r in shares.collect()}
            percent = [of[x["path" if by_file else "language"]] for x in shown]  # in the order of the counts
        r = render.Report(shown, by_file, seconds, sum_one=a.sum_one, total=a.fmt in (2, 4), thousands=a.thousands_delimiter or "", percent=percent, percent_of=a.by_percent or "t")
        kind = next((k for k in ("json", "yaml", "csv", "md", "xml") if getattr(a, k)), "xml" if a.xsl else "text")
        return render.csv(r, a.csv_delimiter or ",") if kind == "csv" else render.xml(r, a.xsl) if kind == "xml" else render.FORMATS[kind](r)
    finally:
        counted.unpersist()


def write_html(classified: DataFrame, c: catalogs.Catalog, o: api.RunOptions, beside: bool) -> None:
    """An annotated copy of each file, beside it or here; files that cannot be written are passed over."""

    def write(rows) -> None:
        for r in rows:
            to = f"{r['path']}.html" if beside else f"{r['name']}.html"
            try:
                with open(to, "w", encoding="utf-8") as f:
                    f.write(render.html_page(r["name"], list(r["lines"]), code_flags(list(r["solid"]), list(r["stripped"]))))
            except OSError:
                continue

    count.strip(classified, c, o.counting.filters).select("path", "name", "lines", "solid", "stripped").foreachPartition(write)


def diff_report(spark: SparkSession, a: argparse.Namespace, paths: list[str], c: catalogs.Catalog) -> str:
    _shared(spark, a, paths)
    left, right = ([p] for p in paths[:2])
    o = options_of(a)
    changed = None
    if (a.git_diff_rel or a.git) and not a.git_diff_all and all(inputs.is_revision(p) for p in paths[:2]):
        changed = inputs.changed_files(*paths[:2])
    sides = []
    for side in (left, right):
        roots = paths_of(a, side)
        df = api.run(spark, roots, o, c).classified
        if changed is not None:
            df = diff.only_changed(df, roots[0], spark.createDataFrame([(x,) for x in changed], "path string"))
        sides.append(df)
    got = diff.compare(*sides, c, diff.DiffOptions(a.ignore_whitespace, a.ignore_case, o.counting.filters)).persist()
    try:
        if a.diff_alignment:
            with open(a.diff_alignment, "w", encoding="utf-8") as f:
                f.writelines(f"{r['value']}\n" for r in diff.alignment_lines(got).toLocalIterator())
        if a.by_file and a.json:
            return render.diff_json([r.asDict() for r in diff.by_file(got).orderBy("path").toLocalIterator()])
        rows = [r.asDict() for r in diff.by_language(got).orderBy("language").collect()]
    finally:
        got.unpersist()
    if a.json:
        return render.diff_json(rows)
    return render.diff_csv(rows, a.csv_delimiter or ",") if a.csv else render.diff_text(rows, a.thousands_delimiter or "")


def info(a: argparse.Namespace, c: catalogs.Catalog) -> str | None:
    if a.write_lang_def or a.write_lang_def_incl_dup:
        with open(a.write_lang_def or a.write_lang_def_incl_dup, "w", encoding="utf-8") as f:
            f.write(catalogs.definitions(c, bool(a.write_lang_def_incl_dup)))
        return ""
    if a.show_lang:
        have: dict[str, list[str]] = {}
        for k, v in sorted(c.extensions.items()):
            have.setdefault(v, []).append(k)
        return "".join(f"{n:<26} ({', '.join(have.get(n, []))})\n" for n in sorted(c.languages) if not c.languages[n].pseudo)
    if a.show_ext:
        return "".join(f"{k:<15} -> {v}\n" for k, v in sorted(c.extensions.items()))
    if a.explain:
        entry = c.languages.get(a.explain)
        return "".join(f"    filter {' '.join([n, *x])}\n" for n, x in entry.chain) if entry else f"unknown language {a.explain}\n"
    return None


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> str:
    a = parser().parse_args(argv)
    c = catalog_of(a)
    out = info(a, c)
    if out is None:
        if not (a.paths or a.list_file or a.vcs):
            raise SystemExit("no input")
        spark = spark or SparkSession.builder.appName("linecensus").getOrCreate()
        if a.diff or (a.diff_alignment or a.git_diff_rel or a.git_diff_all) and len(a.paths) > 1 and not a.count_and_diff:
            out = diff_report(spark, a, a.paths, c)
        elif a.count_and_diff:
            out = "".join(count_report(spark, a, [p], c) for p in a.paths[:2]) + diff_report(spark, a, a.paths, c)
        else:
            out = count_report(spark, a, a.paths, c)
    if a.report_file:
        with open(a.report_file, "w", encoding="utf-8") as f:
            f.write(out)
    else:
        print(out, end="")
    return out


if __name__ == "__main__":
    main()
