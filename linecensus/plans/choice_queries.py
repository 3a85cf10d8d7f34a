"""Queries for the resolvers of shared extensions, for names and selection, and their SQL.

Files are made as in step_queries: a line is x, "word" and its letters, which no resolver
scores; every third line, from the first, is a mark of one language, which doc_id picks. So
the SQL need only know which mark a document got.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import classify, count, select
from .catalog import builtin
from .queries import LINES_SQL, QUERIES, SQL, _lines, _read, query
from .step_queries import filled, plain

Marks = list[tuple[str, str]]


def _named(language: str) -> str:
    """A file name that the catalogue gives to an open choice (or language)."""
    c = builtin()
    return next((k for k, v in c.names.items() if v == language), None) or "a." + next(k for k, v in c.extensions.items() if v == language)


def _picked(spark, sf_dir, marks: Marks):
    """documents with `lines`: every third line, from the first, is the mark that doc_id picks."""

    def line(v, i):
        x = plain(v)
        out = x
        for k, (mark, _) in enumerate(marks):
            out = F.when((F.col("doc_id") % len(marks) == k) & (i % 3 == 0), filled(mark, x)).otherwise(out)
        return out

    return _lines(spark, sf_dir).withColumn("lines", F.transform("lines", line))


def _resolver(name: str, choice: str, marks: Marks, no_autogen: bool = False) -> None:
    """marks: (line, SQL of the language that must win; m is the number of lines)."""

    def run(spark, sf_dir):
        df = _picked(spark, sf_dir, marks).withColumn("name", F.lit(_named(choice)))
        return classify.classify(df, o=classify.ClassifyOptions(no_autogen=no_autogen)).select("doc_id", "language", F.col("skip_reason").isNotNull().alias("skipped"))

    QUERIES[name] = run
    cases = " ".join(f"WHEN {k} THEN {want}" for k, (_, want) in enumerate(marks))
    SQL[name] = f"SELECT doc_id, language, language IS NULL AS skipped FROM (SELECT doc_id, CASE doc_id % {len(marks)} {cases} END AS language FROM (SELECT doc_id, count(*) AS m FROM ({LINES_SQL}) GROUP BY doc_id))"


_resolver("resolve_matlab_and_others", "MATLAB/Mathematica/Objective-C/MUMPS/Mercury", [('BeginPackage["~"]', "'Mathematica'"), ('#import "~"', "'Objective-C'"), (" ; ~", "'MUMPS'"), (":- module ~", "'Mercury'"), ("% ~", "'MATLAB'"), ("~", "'MATLAB'")])
_resolver("resolve_php_and_others", "PHP/Pascal/Fortran/Pawn/BitBake/Assembly", [("<?php ~", "'PHP'"), ("end. ~", "'Pascal'"), ("implicit none", "'Fortran 77'"), ("implicit none ! real :: ~", "'Fortran 77'"), ("@~", "'Pawn'"), ("SRC_URI = ~", "'BitBake'"), ("mov ~", "'Assembly'"), ("~", "'Assembly'")])
_resolver("resolve_pascal_puppet", "Pascal/Puppet", [("~ := begin", "'Pascal'"), ("~ => 1", "'Puppet'"), ("~", "'Puppet'")])
_resolver("resolve_perl_prolog", "Perl/Prolog", [("=head1 ~", "'Perl'"), (":- ~.", "'Prolog'"), ("#!/usr/bin/perl ~", "'Perl'"), ("~", "'Prolog'")])
_resolver("resolve_raku_prolog", "Raku/Prolog", [("=head1 ~", "'Raku'"), (":- ~.", "'Prolog'")])
_resolver("resolve_idl_and_others", "IDL/Qt Project/Prolog/ProGuard", [("; ~", "'IDL'"), ("sources = ~", "'Qt Project'"), (":- ~", "'Prolog'"), ("-keep ~", "'ProGuard'"), ("~", "'IDL'")])
_resolver("resolve_fortran_forth", "Fortran 77/Forth", [(": ~", "'Forth'"), ("      program ~", "'Fortran 77'"), ("~", "'Fortran 77'")])
_resolver("resolve_verilog_coq", "Verilog-SystemVerilog/Coq", [("module ~", "'Verilog-SystemVerilog'"), ("Lemma ~", "'Coq'"), ("~", "'Verilog-SystemVerilog'")])
_resolver("resolve_typescript_qt", "TypeScript/Qt Linguist", [("a<message> ~", "'Qt Linguist'"), ("const ~", "'TypeScript'"), ("~", "'TypeScript'")])
_resolver("resolve_glade", "XML-Qt-GTK/Glade", [("<!-- Generated with glade ~ -->", "'Glade'"), ("~", "'XML (Qt/GTK)'")])
_resolver("resolve_csharp_smalltalk", "C#/Smalltalk", [("~!", "'Smalltalk'"), ("using ~", "'C#'"), ("// <auto-generated> ~", "'C# Generated'"), ("~", "'C#'")])
_resolver("resolve_csharp_no_autogen", "C#/Smalltalk", [("~!", "'Smalltalk'"), ("// <auto-generated> ~", "NULL")], no_autogen=True)
_resolver("resolve_basic_tex_apex", "Visual Basic/TeX/Apex Class", [("% ~", "'TeX'"), ("Attribute ~", "'Visual Basic'"), ("~ {", "'Apex Class'"), ("~", "'Apex Class'")])
_resolver("resolve_pascal_pawn", "Pascal/Pawn", [("begin ~", "'Pascal'"), ("@~", "'Pawn'"), ("~", "'Pawn'")])
_resolver("resolve_skill_il", "SKILL/.NET IL", [("; ~", "'SKILL'"), (".class ~", "'.NET IL'"), ("~", "'.NET IL'")])
_resolver("resolve_clojure_cangjie", "Clojure/Cangjie", [("(~", "'Clojure'"), ("import ~", "'Cangjie'"), ("~", "'Cangjie'")])
_resolver("resolve_bitbake", "Unknown/BitBake", [("DEPENDS = ~", "'BitBake'"), ("~", "NULL")])
_resolver("resolve_d_dtrace", "D/dtrace", [("BEGIN ~", "'dtrace'"), ("import ~", "'D'"), ("~", "'D'")])
_resolver("resolve_brainfuck", "Brainfuck", [("++++ ~", "CASE WHEN (m + 2) // 3 > 5 OR 2 * ((m + 2) // 3) > m THEN 'Brainfuck' END"), ("~", "NULL")])
_resolver("resolve_ant", "Ant/XML", [('<project name="~">', "'Ant'"), ("~", "'XML'")])
_resolver("resolve_maven", "Maven/XML", [("<project ~>", "'Maven'"), ("~", "'XML'")])
_resolver("resolve_adso", "ADSO/IDSM", [("~", "'ADSO/IDSM'")])


# --- the cascade of names, forced languages ---------------------------------------------------------


def _texts(spark, sf_dir):
    return _read(spark, sf_dir, "documents")


@query("SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'make' WHEN doc_id % 5 = 1 THEN NULL WHEN doc_id % 5 = 2 THEN 'Rust' WHEN doc_id % 5 = 3 THEN 'Python' ELSE NULL END AS language, CASE WHEN doc_id % 5 = 1 THEN 'listed in Not_Code_Filename: README' WHEN doc_id % 5 = 4 THEN 'language unknown' END AS skip_reason FROM documents")
def classify_cascade(spark, sf_dir):
    """--autoconf drops one .in, --ignore-case-ext lowers extensions, names that are not code are left out, whole names lower-cased."""
    r = F.col("doc_id") % 5
    name = F.when(r == 0, "MAKEFILE.in").when(r == 1, "README.in").when(r == 2, "a.RS").when(r == 3, "b.py.in").otherwise("thing")
    df = _lines(spark, sf_dir, True).withColumns({"name": name, "lines": F.transform("lines", plain)})
    return classify.classify(df, o=classify.ClassifyOptions(autoconf=True, ignore_case_ext=True)).select("doc_id", "language", "skip_reason")


@query("SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'C' END AS language, CASE WHEN doc_id % 2 = 1 THEN 'listed in Not_Code_Extension: zip' END AS skip_reason FROM documents")
def classify_without_extension(spark, sf_dir):
    """--lang-no-ext: for names without a dot that nothing else claims."""
    df = _lines(spark, sf_dir, True).withColumns({"name": F.when(F.col("doc_id") % 2 == 0, "thing").otherwise("thing.zip"), "lines": F.transform("lines", plain)})
    return classify.classify(df, o=classify.ClassifyOptions(lang_no_ext="C")).select("doc_id", "language", "skip_reason")


@query("SELECT doc_id, 'Ada' AS language FROM documents")
def classify_forced(spark, sf_dir):
    """A language forced for everything claims every file, whatever its name."""
    name = F.concat(F.lit("a."), F.element_at(F.array(*map(F.lit, ("py", "zip", "rs", "c~"))), (F.col("doc_id") % 4 + 1).cast("int")))
    df = _lines(spark, sf_dir, True).withColumn("name", name)
    return classify.classify(df, builtin().forced("Ada")).select("doc_id", "language")


# --- selection --------------------------------------------------------------------------------------


def _files(spark, sf_dir):
    """Documents as files: paths from their columns, contents their texts."""
    content = F.col("text").cast("binary")
    name = F.concat(F.when(F.col("doc_id") % 7 == 0, ".").otherwise(""), F.lit("doc"), F.col("doc_id").cast("string"), F.lit("."), F.col("lang"))
    folder = F.concat(F.lit("top/"), F.col("source"))
    cols = {"name": name, "dir": folder, "path": F.concat(folder, F.lit("/"), name), "ext": F.col("lang"), "content": F.when(F.col("doc_id") % 13 == 5, F.lit("").cast("binary")).otherwise(content)}
    df = _texts(spark, sf_dir).withColumns(cols)
    return df.withColumns({"length": F.octet_length("content").cast("long"), "head": F.substring("content", 1, 512), "explicit": F.col("doc_id") % 17 == 0, "error": F.when(F.col("doc_id") % 19 == 0, "unable to stat: gone")})


_FILE_SQL = "SELECT *, CASE WHEN doc_id % 7 = 0 THEN '.' ELSE '' END || 'doc' || doc_id || '.' || lang AS name, 'top/' || source AS dir, doc_id % 17 = 0 AS explicit, CASE WHEN doc_id % 13 = 5 THEN 0 ELSE octet_length(encode(text)) END AS length FROM documents"


def _selected(name: str, cases: str, **options) -> None:
    QUERIES[name] = lambda spark, sf_dir: select.select(_files(spark, sf_dir), select.Selection(**options)).select("doc_id", "reason")
    SQL[name] = f"SELECT doc_id, CASE WHEN doc_id % 19 = 0 THEN 'unable to stat: gone' {cases} WHEN length = 0 THEN 'zero sized file' END AS reason FROM ({_FILE_SQL})"


_selected("select_hidden", "WHEN NOT explicit AND doc_id % 7 = 0 THEN 'hidden file'", skip_hidden=True)
_selected("select_match_f", "WHEN NOT explicit AND NOT regexp_matches(name, '[02468]\\.') THEN 'did not match --match-f'", match_f=r"[02468]\.")
_selected("select_match_fullpath", "WHEN NOT explicit AND NOT regexp_matches(dir || '/' || name, '^top/.*[13579]\\.') THEN 'did not match --match-f' WHEN NOT explicit AND regexp_matches(dir || '/' || name, 'top/[a-m]') THEN 'matched --not-match-f'", match_f=r"^top/.*[13579]\.", not_match_f=("top/[a-m]",), fullpath=True)
_selected("select_match_d", "WHEN NOT explicit AND NOT regexp_matches(dir, '[0-4a-k]$') THEN 'directory did not match --match-d'", match_d="[0-4a-k]$")
_selected("select_exclude_ext", "WHEN lang IN ('en', 'xx') THEN 'excluded extension'", exclude_ext=("en", "xx"))


# --- counting options ---------------------------------------------------------------------------------

_MARKED = f"SELECT doc_id, pos, CASE WHEN pos % 4 = 1 THEN 'm' WHEN pos % 4 = 2 THEN 'b' WHEN pos % 4 = 3 THEN 'i' ELSE 'x' END AS k FROM ({LINES_SQL})"


def _rust(spark, sf_dir):
    """Rust files: by position a comment, a blank line, a line that begins with "use ", code."""

    def line(v, i):
        x = plain(v)
        return F.when(i % 4 == 1, F.concat(F.lit("// "), x)).when(i % 4 == 2, F.lit("  ")).when(i % 4 == 3, F.concat(F.lit("use "), x)).otherwise(x)

    ext = F.when(F.col("doc_id") % 2 == 0, "rs").otherwise("rsx")
    return _lines(spark, sf_dir).withColumns({"lines": F.transform("lines", line), "language": F.lit("Rust"), "name": F.lit("a.rs"), "ext": ext})


def _tallied(name: str, where: str, code: str, o: count.CountOptions) -> None:
    QUERIES[name] = lambda spark, sf_dir: count.count(_rust(spark, sf_dir), o=o).select("doc_id", "blank", "comment", "code")
    SQL[name] = f"SELECT doc_id, {', '.join(f'sum(CASE WHEN {where} AND {test} THEN 1 ELSE 0 END)::BIGINT AS {c}' for c, test in (('blank', 'k = chr(98)'), ('comment', 'k = chr(109)'), ('code', code)))} FROM ({_MARKED}) GROUP BY doc_id"


_tallied("count_skip_leading", "pos >= 3", "k IN (chr(105), chr(120))", count.CountOptions(skip_leading=3))
_tallied("count_skip_leading_ext", "(pos >= 3 OR doc_id % 2 = 1)", "k IN (chr(105), chr(120))", count.CountOptions(skip_leading=3, skip_leading_exts=("rs",)))
_tallied("count_ignore_regex", "TRUE", "k = chr(120)", count.CountOptions(ignore_regex=("^use ", "^import ")))


@query(f"SELECT doc_id, count(*)::BIGINT AS total FROM ({_MARKED}) GROUP BY doc_id")
def count_total_lines(spark, sf_dir):
    """All lines of a file are blank, comment or code."""
    return count.count(_rust(spark, sf_dir)).select("doc_id", (F.col("blank") + F.col("comment") + F.col("code")).alias("total"))
