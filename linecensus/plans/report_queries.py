"""Queries for whole runs, duplicates, comparisons and report lines, and their SQL."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import functions as F

from .. import api
from ..functions import native
from ..functions.sequence import code_flags
from ..functions.steps import expand_tabs
from ..operators import classify, count, dedupe, diff, report, select
from . import render
from .catalog import builtin
from .choice_queries import _MARKED, _rust
from .queries import _DIFF, _TOTALS, LINES_SQL, QUERIES, SQL, _lines, _read, count_files, diff_by_language, query
from .ship import lean, ship
from .step_queries import plain


def _values(rows) -> str:
    q = lambda v: "NULL" if v is None else "'" + v.replace("'", "''") + "'"
    return "(VALUES " + ", ".join("(" + ", ".join(map(q, r)) + ")" for r in rows) + ")"


# --- a whole run over a table of files -------------------------------------------------------------

_RUN_SQL = """
    WITH f AS (SELECT doc_id, 'src/doc' || lpad(doc_id::VARCHAR, 9, '0') || CASE doc_id % 4 WHEN 0 THEN '.rs' WHEN 1 THEN '.py' WHEN 2 THEN '.png' ELSE '.zzz' END AS path, doc_id % 4 AS r, text FROM documents),
    d AS (SELECT *, min(path) OVER (PARTITION BY text) AS low, max(CASE WHEN r IN (0, 1) THEN path END) OVER (PARTITION BY text) AS top FROM f WHERE length(text) > 0),
    k AS (SELECT *, CASE WHEN top > low THEN top ELSE low END AS keep FROM d)"""


def _run(spark, sf_dir):
    name = F.concat(F.format_string("doc%09d", "doc_id"), F.element_at(F.array(*map(F.lit, (".rs", ".py", ".png", ".zzz"))), (F.col("doc_id") % 4 + 1).cast("int")))
    df = _read(spark, sf_dir, "documents").select("doc_id", name.alias("name"), F.concat(F.lit("src/"), name).alias("path"), F.lit("src").alias("dir"), F.substring_index(name, ".", -1).alias("ext"), F.col("text").cast("binary").alias("content"), F.lit(False).alias("explicit"), F.lit(None).cast("string").alias("error"))
    df = df.withColumns({"length": F.octet_length("content").cast("long"), "head": F.substring("content", 1, 512)})
    return api.run_files(df, api.RunOptions(exclude_lang=("Python",)))


@query(_RUN_SQL + " SELECT path, 'Rust' AS language, len(string_split(text, chr(10)))::BIGINT AS total FROM k WHERE path = keep AND r = 0")
def run_counted(spark, sf_dir):
    return _run(spark, sf_dir).counted.select("path", "language", (F.col("blank") + F.col("comment") + F.col("code")).alias("total"))


@query(_RUN_SQL + " SELECT path, CASE WHEN path <> keep THEN 'duplicate of ' || keep WHEN r = 1 THEN 'in --exclude-lang' WHEN r = 2 THEN 'listed in Not_Code_Extension: png' ELSE 'language unknown' END AS reason FROM k WHERE path <> keep OR r <> 0")
def run_ignored(spark, sf_dir):
    """The union of what selection, duplicates, classification and options leave out."""
    return _run(spark, sf_dir).ignored


@query("""
    WITH p AS (SELECT doc_id, text, 'f' || lpad(doc_id::VARCHAR, 9, '0') AS path FROM documents),
    k AS (SELECT path, min(path) OVER (PARTITION BY text) AS low, max(CASE WHEN doc_id % 3 = 1 THEN path END) OVER (PARTITION BY text) AS top FROM p)
    SELECT path, CASE WHEN path <> CASE WHEN top > low THEN top ELSE low END THEN CASE WHEN top > low THEN top ELSE low END END AS duplicate_of FROM k""")
def dedupe_known(spark, sf_dir):
    """Of each content the last file with a known language after the first one is kept."""
    df = _read(spark, sf_dir, "documents").select(F.format_string("f%09d", "doc_id").alias("path"), "text", (F.col("doc_id") % 3 == 1).alias("known"))
    return dedupe.mark_duplicates(df, "text", "known").select("path", "duplicate_of")


# --- comparisons ---------------------------------------------------------------------------------


def _side(spark, sf_dir, folder: str, line, keep=None):
    df = _lines(spark, sf_dir).withColumn("lines", F.flatten(F.transform("lines", line)))
    name = F.concat(F.lit("doc"), F.col("doc_id").cast("string"), F.lit(".rs"))
    return df.select("doc_id", F.concat(F.lit(f"{folder}/"), name).alias("path"), name.alias("name"), F.lit("Rust").alias("language"), "lines")


def _doc_id(c: str = "key"):
    return F.regexp_extract(c, r"doc(\d+)\.rs$", 1).cast("long").alias("doc_id")


def _numbered(v, i):
    return F.concat(i.cast("string"), F.lit(" "), plain(v))


@query(f"""SELECT doc_id, (CASE WHEN doc_id % 2 = 1 THEN sum(s) ELSE 0 END)::BIGINT AS blank_same, 0::BIGINT AS blank_modified, (CASE WHEN doc_id % 2 = 0 THEN greatest(sum(u) - sum(s), 0) ELSE 0 END)::BIGINT AS blank_added, (CASE WHEN doc_id % 2 = 0 THEN greatest(sum(s) - sum(u), 0) ELSE 0 END)::BIGINT AS blank_removed
    FROM (SELECT doc_id, CASE WHEN pos % 4 = 3 THEN 1 ELSE 0 END AS s, CASE WHEN (doc_id // 2 + pos) % 3 = 1 THEN 1 ELSE 0 END AS u FROM ({LINES_SQL})) GROUP BY doc_id""")
def diff_blank_delta(spark, sf_dir):
    """Equal files: all blank lines are the same. Others: only the surplus is added or removed."""
    left = lambda v, i: F.when(i % 4 == 3, F.array(_numbered(v, i), F.lit(" "))).otherwise(F.array(_numbered(v, i)))

    def right(v, i):
        other = F.concat(_numbered(v, i), F.when(i == 0, F.lit(" new")).otherwise(F.lit("")))
        own = F.when((F.floor(F.col("doc_id") / 2) + i) % 3 == 1, F.array(other, F.lit(""))).otherwise(F.array(other))
        return F.when(F.col("doc_id") % 2 == 0, own).otherwise(left(v, i))

    got = diff.compare(_side(spark, sf_dir, "old", left), _side(spark, sf_dir, "new", right), keys=(1, 1))
    return got.select(_doc_id(), *[f"blank_{e}" for e in diff.EDITS])


@query(f"SELECT doc_id, 'modified' AS disposition, count(*)::BIGINT AS code_same, 0::BIGINT AS code_modified, 0::BIGINT AS code_added, 0::BIGINT AS code_removed FROM ({LINES_SQL}) GROUP BY doc_id")
def diff_ignoring_space_and_case(spark, sf_dir):
    """The new side has other spaces and letters in other case: other files, equal lines."""
    left = lambda v, i: F.array(_numbered(v, i))
    right = lambda v, i: F.array(F.concat(F.lit("\t"), F.upper(F.replace(_numbered(v, i), F.lit(" "), F.lit("   ")))))
    got = diff.compare(_side(spark, sf_dir, "old", left), _side(spark, sf_dir, "new", right), o=diff.DiffOptions(True, True), keys=(1, 1))
    return got.select(_doc_id(), "disposition", *[f"code_{e}" for e in diff.EDITS])


@query(f"SELECT doc_id, sum(CASE WHEN k = 'm' THEN 1 ELSE 0 END)::BIGINT AS comments, sum(CASE WHEN k IN ('i', 'x') THEN 1 ELSE 0 END)::BIGINT AS codes FROM ({_MARKED}) GROUP BY doc_id")
def diff_code_flags(spark, sf_dir):
    """Lines told apart as code and comment by comparing a file with its own stripped form."""
    df = count.strip(_rust(spark, sf_dir))

    @F.pandas_udf("array<boolean>")
    @lean
    def flags(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for solid, stripped in batches:
            yield pd.Series([code_flags(list(a), list(b)) for a, b in zip(solid, stripped)])

    of = F.col("flags")
    return df.withColumn("flags", flags("solid", "stripped")).select("doc_id", F.size(F.filter(of, lambda x: ~x)).cast("long").alias("comments"), F.size(F.filter(of, lambda x: x)).cast("long").alias("codes"))


_ONE_SIDED = "SELECT source || '/l' || doc_id || '.rs' AS key, TRUE AS in_left, FALSE AS in_right FROM documents UNION ALL SELECT source || '/r' || doc_id || '.rs' AS key, FALSE AS in_left, TRUE AS in_right FROM documents"


@query(_ONE_SIDED)
def align_without_shared_names(spark, sf_dir):
    """No base name is on both sides: the folders that all paths of a side share are dropped."""
    path = lambda head, letter: F.concat(F.lit(head), F.col("source"), F.lit(f"/{letter}"), F.col("doc_id").cast("string"), F.lit(".rs")).alias("path")
    docs = _read(spark, sf_dir, "documents")
    got = diff.align(docs.select(path("old/deep/", "l")), docs.select(path("new/", "r")))
    return got.select("key", F.col("left_path").isNotNull().alias("in_left"), F.col("right_path").isNotNull().alias("in_right"))


@query("SELECT 'one-' || count(*) || '.c' AS left_path, 'two-' || count(DISTINCT text) || '.c' AS right_path FROM documents")
def align_forced_pair(spark, sf_dir):
    """One file on each side: a pair, whatever their names."""
    docs = _read(spark, sf_dir, "documents")
    one = docs.agg(F.concat(F.lit("one-"), F.count("*").cast("string"), F.lit(".c")).alias("path"))
    two = docs.agg(F.concat(F.lit("two-"), F.countDistinct("text").cast("string"), F.lit(".c")).alias("path"))
    return diff.align(one, two).select("left_path", "right_path")


@query("SELECT 'root/' || source || '/doc' || doc_id AS path FROM documents WHERE n_chars > 1000")
def diff_only_changed(spark, sf_dir):
    """The files that a list of changed paths names."""
    below = F.concat(F.col("source"), F.lit("/doc"), F.col("doc_id").cast("string"))
    docs = _read(spark, sf_dir, "documents")
    return diff.only_changed(docs.select(F.concat(F.lit("root/"), below).alias("path")), "root/", docs.filter("n_chars > 1000").select(below.alias("path")))


@query(f"SELECT 'new/doc' || doc_id || '.rs' AS path, disposition, files, code FROM (SELECT doc_id, d AS disposition, CASE WHEN d = 'added' THEN 1 ELSE 0 END::BIGINT AS files, CASE WHEN d = 'added' THEN count(*) ELSE 0 END::BIGINT AS code FROM ({LINES_SQL}) CROSS JOIN (VALUES ('same'), ('modified'), ('added'), ('removed')) AS v(d) GROUP BY doc_id, d)")
def diff_by_file(spark, sf_dir):
    """Every file is new: four rows for each, three of them empty."""
    new = _side(spark, sf_dir, "new", lambda v, i: F.array(plain(v)))
    return diff.by_file(diff.compare(new.limit(0), new, keys=(1, 1))).select("path", "disposition", "files", "code")


# --- report lines -----------------------------------------------------------------------------------


def _report_rows(spark, sf_dir):
    """Files with names that need escaping, and counts from their texts."""
    path = F.concat(F.lit("a,\"b\" <&'/"), F.col("source"), F.lit("/"), F.col("doc_id").cast("string"))
    n = F.size(F.split("text", "\n", -1)).cast("long")
    return _read(spark, sf_dir, "documents").select(path.alias("path"), F.lit("C/C++ Header").alias("language"), (n % 3).alias("blank"), (n % 5).alias("comment"), n.alias("code"))


_ROWS_SQL = "SELECT 'a,\"b\" <&''/' || source || '/' || doc_id AS p, n % 3 AS b, n % 5 AS m, n AS c FROM (SELECT source, doc_id, len(string_split(text, chr(10))) AS n FROM documents)"
_LINE_SQL = {
    "csv": "'C/C++ Header,\"' || replace(p, '\"', '\"\"') || '\",' || b || ',' || m || ',' || c",
    "md": "p || '|' || b || '|' || m || '|' || c",
    "yaml": "'''' || replace(p, '''', '''''') || ''':' || chr(10) || '  blank: ' || b || chr(10) || '  comment: ' || m || chr(10) || '  code: ' || c || chr(10) || '  language: C/C++ Header'",
    "json": "'\"' || replace(p, '\"', '\\\"') || '\": {\"blank\": ' || b || ', \"comment\": ' || m || ', \"code\": ' || c || ', \"language\": \"C/C++ Header\"}'",
    "xml": "'  <file name=\"' || replace(replace(replace(replace(replace(p, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#x27;') || '\" blank=\"' || b || '\" comment=\"' || m || '\" code=\"' || c || '\" language=\"C/C++ Header\" />'",
}


def _report_line(kind: str, sql: str) -> None:
    QUERIES[f"report_lines_{kind}"] = lambda spark, sf_dir: _report_rows(spark, sf_dir).select(render.file_line(kind).alias("value"))
    SQL[f"report_lines_{kind}"] = f"SELECT {sql} AS value FROM ({_ROWS_SQL})"


for _kind, _sql in _LINE_SQL.items():
    _report_line(_kind, _sql)


@query(f"SELECT 'insert into t values(7, ''it''''s'', ''C/C++ Header'', ''' || replace(p, '''', '''''') || ''', ''' || replace(regexp_replace(p, '/[^/]*$', ''), '''', '''''') || ''', ''' || regexp_extract(p, '[^/]*$') || ''', ' || b || ', ' || m || ', ' || c || ', ' || c || '.000000);' AS value FROM ({_ROWS_SQL})")
def report_lines_sql(spark, sf_dir):
    rows = report.sql_tables(_report_rows(spark, sf_dir), 7, "it's", "2020-01-01 00:00:00", 1.0)[1]
    return rows.select(render.insert_line().alias("value"))


@query("SELECT language, string_agg(key, ', ' ORDER BY key) AS extensions FROM " + _values(sorted(builtin().extensions.items())) + " AS v(key, language) GROUP BY language")
def catalog_extensions(spark, sf_dir):
    return report.extensions(builtin().frame(spark, "extensions"))


# --- scalar functions -------------------------------------------------------------------------------


@query(f"SELECT doc_id, sum(length(line) // 8 * 8 + 8 + 3)::BIGINT AS n FROM (SELECT doc_id, regexp_replace(line, '[^a-z]', '', 'g') AS line FROM ({LINES_SQL})) GROUP BY doc_id")
def expanded_tabs(spark, sf_dir):
    """A tab goes to the next multiple of eight columns."""
    df = _lines(spark, sf_dir)
    ship(spark)

    @F.pandas_udf("long")
    @lean
    def widths(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for lines in batches:
            yield pd.Series([sum(len(expand_tabs(x)) for x in own) for own in lines])

    return df.select("doc_id", widths(F.transform("lines", lambda v: F.concat(F.regexp_replace(v, "[^a-z]", ""), F.lit("\tend")))).alias("n"))


@query("SELECT doc_id, replace(format('{:,}', n_chars * 1000003), ',', '.') AS shown FROM documents")
def grouped_digits(spark, sf_dir):
    return _read(spark, sf_dir, "documents").select("doc_id", render.grouped_column(F.col("n_chars") * 1000003, ".").alias("shown"))


@query("SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN text WHEN 1 THEN text WHEN 2 THEN '' WHEN 3 THEN 'caf' || chr(233) || 'x' WHEN 4 THEN text ELSE text END AS text, CASE WHEN doc_id % 6 = 2 THEN 1 ELSE 0 END::BIGINT AS only_mark FROM documents")
def decoded_texts(spark, sf_dir):
    """Byte order marks off, Latin-1 where the bytes are not UTF-8."""
    r, raw = F.col("doc_id") % 6, F.col("text").cast("binary")
    head = lambda mark: F.concat(F.unhex(F.lit(mark)), raw)
    content = F.when(r == 0, head("EFBBBF")).when(r == 1, head("2B2F76382D")).when(r == 2, F.unhex(F.lit("EFBBBF"))).when(r == 3, F.unhex(F.lit("636166E978"))).when(r == 4, head("0EFEFF")).otherwise(raw)
    df = _read(spark, sf_dir, "documents").select("doc_id", content.alias("content"))
    return df.select("doc_id", native.decoded(F.col("content")).alias("text"), (F.size(native.file_lines(F.col("content"))) == F.size(F.array(F.lit("")))).cast("long").alias("one")).select("doc_id", "text", F.when(r == 2, F.col("one")).otherwise(F.lit(0).cast("long")).alias("only_mark"))


@query(f"SELECT doc_id, sum(length(line))::BIGINT AS n, count(*)::BIGINT AS lines FROM ({LINES_SQL}) GROUP BY doc_id")
def split_line_ends(spark, sf_dir):
    """CR LF and LF end lines; a final one makes no line of its own."""
    df = _read(spark, sf_dir, "documents")
    text = F.concat(F.when(F.col("doc_id") % 2 == 0, F.replace("text", F.lit("\n"), F.lit("\r\n"))).otherwise(F.col("text")), F.when(F.col("doc_id") % 2 == 0, "\r\n").otherwise("\n"))
    lines = native.split_lines(text)
    return df.select("doc_id", F.aggregate(lines, F.lit(0).cast("long"), lambda a, x: a + F.length(x)).alias("n"), F.size(lines).cast("long").alias("lines"))


@query("SELECT doc_id, doc_id % 6 IN (1, 2) AS bad FROM documents")
def binary_texts(spark, sf_dir):
    """Whole documents as files: with a NUL, or with more than a third of odd bytes, in the first block."""
    r, raw = F.col("doc_id") % 6, F.col("text").cast("binary")
    content = F.when(r == 1, F.concat(F.unhex(F.lit("4100")), raw)).when(r == 2, F.concat(F.unhex(F.lit("FF" * 300)), raw)).when(r == 3, F.concat(F.unhex(F.lit("FF" * 4)), F.lit("plain text ").cast("binary"), F.lit("word " * 4).cast("binary"), raw)).otherwise(raw)
    return _read(spark, sf_dir, "documents").select("doc_id", select.looks_binary(F.substring(content, 1, 512)).alias("bad"))


@query("SELECT path, CASE WHEN doc_id % 4 = 3 THEN NULL ELSE 'txt' END AS ext, 'a/' || source AS dir FROM (SELECT doc_id, source, 'a/' || source || '/' || CASE doc_id % 4 WHEN 3 THEN '.hidden' ELSE 'doc' || doc_id || '.tar.txt' END AS path FROM documents)")
def path_parts(spark, sf_dir):
    """Extension and folder of a path; a leading dot begins no extension."""
    name = F.when(F.col("doc_id") % 4 == 3, ".hidden").otherwise(F.concat(F.lit("doc"), F.col("doc_id").cast("string"), F.lit(".tar.txt")))
    df = _read(spark, sf_dir, "documents").select(F.concat(F.lit("a/"), F.col("source"), F.lit("/"), name).alias("path"))
    return df.select("path", native.extension(F.col("path")).alias("ext"), native.folder(F.col("path")).alias("dir"))


# --- whole reports by language: every line and its place -------------------------------------------


def _shown(spark, text: str):
    return spark.createDataFrame(list(enumerate(text.splitlines())), "pos long, value string")


def _whole_report(kind: str, lines: str, **options) -> None:
    """lines: SELECTs of (pos, value) from r (a row per language, k from 1 in order), s (the sums, l languages)."""

    def run(spark, sf_dir):
        totals = report.by_language(count_files(spark, sf_dir))
        rows = [r.asDict() for r in report.ordered(totals).collect()]  # a row per language of the catalogue
        of = options.get("percent_of")
        shares = {r["language"]: r.asDict() for r in report.percentages(totals, of).collect()} if of else {}
        percent = [shares[x["language"]] for x in rows] if of else None
        return _shown(spark, render.FORMATS[kind](render.Report(rows, percent=percent, **options)))

    name = f"report_{kind}" + (f"_percent_{options['percent_of']}" if options else "")
    QUERIES[name] = run
    SQL[name] = f"WITH r AS (SELECT *, row_number() OVER (ORDER BY code DESC, language) AS k FROM ({_TOTALS})), s AS (SELECT sum(files) AS files, sum(blank) AS blank, sum(comment) AS comment, sum(code) AS code, count(*) AS l FROM r) SELECT pos::BIGINT AS pos, value FROM ({lines})"


def _fixed(*values: str, at: int = 0) -> str:
    return " UNION ALL ".join(f"SELECT {at + k} AS pos, '{v}' AS value" for k, v in enumerate(values))


_CELLS = "blank || '{0}' || comment || '{0}' || code"
_whole_report("csv", _fixed("files,language,blank,comment,code") + f" UNION ALL SELECT k, files || ',' || language || ',' || {_CELLS.format(',')} FROM r UNION ALL SELECT l + 1, files || ',SUM,' || {_CELLS.format(',')} FROM s")
_whole_report("md", _fixed("Language|files|blank|comment|code", ":-------|-------:|-------:|-------:|-------:") + f" UNION ALL SELECT k + 1, language || '|' || files || '|' || {_CELLS.format('|')} FROM r UNION ALL SELECT l + 2, 'SUM:|' || files || '|' || {_CELLS.format('|')} FROM s")
_whole_report(
    "yaml",
    _fixed("---", "header:", "  url: linecensus", "  version: 0.1", "  elapsed_seconds: 0.0") + " UNION ALL SELECT 5, '  n_files: ' || files FROM s UNION ALL SELECT 6, '  n_lines: ' || (blank + comment + code) FROM s"
    + "".join(f" UNION ALL SELECT 2 + 5 * k + {j}, {v} FROM r" for j, v in enumerate(("language || ':'", "'  nFiles: ' || files", "'  blank: ' || blank", "'  comment: ' || comment", "'  code: ' || code")))
    + "".join(f" UNION ALL SELECT 7 + 5 * l + {j}, {v} FROM s" for j, v in enumerate(("'SUM:'", "'  blank: ' || blank", "'  comment: ' || comment", "'  code: ' || code", "'  nFiles: ' || files"))),
)
_ATTRIBUTES = "' blank=\"' || blank || '\" comment=\"' || comment || '\" code=\"' || code || '\" />'"
_whole_report(
    "xml",
    _fixed('<?xml version="1.0" encoding="UTF-8"?>', "<results>", "<header>", "  <url>linecensus</url>", "  <version>0.1</version>", "  <elapsed_seconds>0.0</elapsed_seconds>")
    + " UNION ALL SELECT 6, '  <n_files>' || files || '</n_files>' FROM s UNION ALL SELECT 7, '  <n_lines>' || (blank + comment + code) || '</n_lines>' FROM s UNION ALL " + _fixed("</header>", "<languages>", at=8)
    + f" UNION ALL SELECT 9 + k, '  <language name=\"' || language || '\" files_count=\"' || files || '\"' || {_ATTRIBUTES} FROM r UNION ALL SELECT 10 + l, '  <total sum_files=\"' || files || '\"' || {_ATTRIBUTES} FROM s UNION ALL SELECT 11 + l, '</languages>' FROM s UNION ALL SELECT 12 + l, '</results>' FROM s",
)


def _box(first: str, cells: tuple[str, ...]) -> str:
    return f"'│ ' || rpad({first}, 20, ' ') || " + " || ".join(f"' │ ' || lpad({c}::VARCHAR, 12, ' ')" for c in cells) + " || ' │'"


def _table_lines(row: tuple[str, ...], total: tuple[str, ...]) -> str:
    rule = lambda a, b, c: a + b.join(["─" * 22, *["─" * 14] * 4]) + c
    head = "│ " + "Language".ljust(20) + "".join(f" │ {h:>12}" for h in ("files", "blank", "comment", "code")) + " │"
    return _fixed(rule("┌", "┬", "┐"), head, rule("├", "┼", "┤")) + f" UNION ALL SELECT 2 + k, {_box('language', row)} FROM r UNION ALL SELECT 3 + l, '{rule('├', '┼', '┤')}' FROM s UNION ALL SELECT 4 + l, {_box(chr(39) + 'SUM:' + chr(39), total)} FROM s UNION ALL SELECT 5 + l, '{rule('└', '┴', '┘')}' FROM s"


_whole_report("text", _table_lines(*[("files", "blank", "comment", "code")] * 2))
_PERCENT = tuple(f"printf('%.2f', round(100.0 * {m} / (code + comment), 2))" for m in ("blank", "comment", "code"))
_whole_report("text", _table_lines(*[("files", *_PERCENT)] * 2), percent_of="cm")


@query(f"SELECT pos::BIGINT AS pos, value FROM ({_fixed('disposition,language,files,blank,comment,code')} UNION ALL SELECT row_number() OVER (ORDER BY list_position(['same', 'modified', 'added', 'removed'], d)), d || ',Rust,' || files || ',0,0,' || code FROM (SELECT d, coalesce(sum(CASE WHEN disposition = d THEN 1 END), 0)::BIGINT AS files, coalesce(sum(CASE WHEN d = 'same' AND disposition IN ('same', 'modified') THEN n - changed WHEN d = 'modified' AND disposition IN ('same', 'modified') THEN changed WHEN d = disposition THEN n END), 0)::BIGINT AS code FROM ({_DIFF}) CROSS JOIN (VALUES ('same'), ('modified'), ('added'), ('removed')) AS v(d) GROUP BY d) WHERE files > 0 OR code > 0)")
def report_diff_csv(spark, sf_dir):
    rows = [r.asDict() | {"blank": 0, "comment": 0} for r in diff_by_language(spark, sf_dir).collect()]
    return _shown(spark, render.diff_csv(rows))
