import random
import re
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from linecensus.functions import resolve, sequence, steps
from linecensus.functions.patterns import compiled, finder
from linecensus.functions.steps import Context, Options, apply_chain, counted
from linecensus.plans import catalog as cat

C = cat.builtin()


def code(language, source, file="", **options):
    e = C.languages[language]
    return apply_chain(steps.blanks_removed(source.split("\n"), e.continuation), e.chain, Context(language, file, Options(**options)), e.continuation, language in C.script_languages)


@pytest.mark.parametrize(
    ("language", "source", "left"),
    [
        ("C", "/* one\ntwo */\nint x; /* y */", ["int x; "]),
        ("C++", "int a; // note\n// only\nint b;", ["int a; ", "int b;"]),
        ("Python", 'x = 1\n"""doc\nmore"""\n# c\ny = 2', ["x = 1", "y = 2"]),
        ("Bourne Shell", "#!/bin/sh\n# c\nls", ["#!/bin/sh", "ls"]),
        ("HTML", "<p>\n<!-- a\nb -->\n</p>", ["<p>", "</p>"]),
        ("Fortran 77", "C note\n      X = 1\n! n\n* m", ["      X = 1"]),
        ("Fortran 90", "! note\n!omp$ parallel\nx = 1", ["x = 1"]),  # the Fortran 77 step takes directives too
        ("OCaml", "let x = 1 (* a (* b *) c *)\n(* only *)", ["let x = 1 "]),
        ("Haskell", "a -- note\n{- x\ny -}\n{-# PRAGMA #-}\nb", ["a ", "{-# PRAGMA #-}", "b"]),
        ("Lua", "-- c\n--[[ x\ny ]]\nz = 1", ["z = 1"]),
        ("Ruby", "=begin\nx\n=end\ny", ["y"]),
        ("SQL", "-- c\nselect 1 /* x */;", ["select 1 ;"]),
        ("Brainfuck", "hello +[-]\nworld", ["+[-]"]),
        ("Perl", "$x;\n=head1 A\ntext\n=cut\n$y;\n__END__\nz", ["$x;", "$y;"]),
        ("JCL", "//A JOB\n//* note\n//\nrest", ["//A JOB"]),
        ("PowerShell", "<# a\nb #>\nls # x", ["ls # x"]),
        ("RMarkdown", "text\n```{r}\nx <- 1\n```\nmore", ["x <- 1"]),
        ("COBOL", "      * note\n       MOVE A.", ["       MOVE A."]),
        ("Forth", ": sq ( n -- n ) dup * ;", [": sq dup * ;"]),
        ("Elixir", 'a\n@doc """\ntext\n"""\nb', ["a", "b"]),
        ("Haml", "%p\n/\n  hidden\n%b", ["%p", "%b"]),
        ("Pug", "p\n//\n  hidden\nb", ["p", "b"]),
        ("Smarty", "{* a\nb *}\nc", ["c"]),
        ("JSP", "<%-- a\nb --%>\nc", ["c"]),
        ("TLA+", "A == 1 (* x *)\n(* y *)", ["A == 1 "]),
        ("Civet", "###\nx\n###\ny // z\n// w", ["y // z"]),
        ("Jupyter Notebook", '"cell_type": "code",\n"source": [\n"x = 1",\n"# c",\n"\\n",\n]\nrest', ['"x = 1",']),
        ("Elm", "{- a\n{- b -}\nc -}\nd", ["d"]),
        ("ASP", "x ' y\n' z", ["x ' y"]),
        ("APL", "⍝ note\nx", ["x"]),
    ],
)
def test_surviving_lines(language, source, left):
    assert code(language, source) == left


def test_options():
    assert code("Python", "x = 1 # y", inline=True) == ["x = 1 "]
    assert code("Python", '"""doc"""\nx', docstring_as_code=True) == ['"""doc"""', "x"]
    assert code("C++", 'a = "/*";\nb; // "*/"', strip_str_comments=True)[0] == 'a = "xx";'


def test_literate_haskell():
    assert code("Haskell", "prose\n> x = 1\nprose", "a.lhs") == [" x = 1"]
    assert code("Haskell", "prose\n\\begin{code}\nx = 1\n\\end{code}\nprose", "a.lhs") == ["x = 1"]


def test_counts():
    chain = [("call_regexp_common", ["C"])]
    assert counted("/* a */\n\nint x;".split("\n"), chain, Context()) == (1, 1, 1)
    assert counted([], chain, Context()) == (0, 0, 0)
    assert counted(["", "", ""], chain, Context()) == (3, 0, 0)
    assert counted(["/* c */", "int a;", "float b;"], chain, Context(), ignore=("^int",)) == (0, 1, 1)


def test_every_chain_runs():
    for e in C.languages.values():
        if not e.pseudo:
            code(e.name, 'a "b" \'c\' /* d */ // e\n# f\n-- g\n{ h }\n\n<!-- i -->\n"""j"""')


def test_dialects_against_a_scanner():
    def scan(text, pairs, line=None, eat=False):
        out, i = "", 0
        while i < len(text):
            for a, z in pairs:
                if text.startswith(a, i) and (end := text.find(z, i + len(a))) >= 0:
                    i = end + len(z)
                    break
            else:
                if line and text.startswith(line, i):
                    end = text.find("\n", i)
                    i = len(text) if end < 0 else end + eat
                else:
                    out += text[i]
                    i += 1
        return out

    rng = random.Random(3)
    for _ in range(3000):
        t = "".join(rng.choice(["/*", "*/", "//", "\n", "a", "{", "}", "(*", "*)", "--", "<!--", "-->", "é"]) for _ in range(rng.randint(0, 14)))
        assert steps.strip_comments(t, "C") == scan(t, [("/*", "*/")])
        assert steps.strip_comments(t, "C++") == scan(t, [("/*", "*/")], "//", True)
        assert steps.strip_comments(t, "Pascal") == scan(t, [("{", "}"), ("(*", "*)")], "//")
        assert steps.strip_comments(t, "PL/SQL") == scan(t, [("/*", "*/")], "--")
        assert steps.strip_comments(t, "HTML") == scan(t, [("<!--", "-->")])


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from("abcd"), max_size=12), st.lists(st.sampled_from("abcd"), max_size=12))
def test_sdiff_accounts_for_every_line(a, b):
    rows = sequence.sdiff(a, b)
    assert [x for _, x, _ in rows if x is not None] == a
    assert [y for _, _, y in rows if y is not None] == b
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
    assert sum(k == "same" for k, _, _ in rows) == best[-1][-1]


def test_delta():
    assert sequence.delta(list("abcd"), list("aBde")) == (2, 1, 1, 1)
    big = [str(i) for i in range(20_000)]
    assert sequence.delta(big, [*big[:500], "new", *big[501:]]) == (19_999, 1, 0, 0)


def test_catalogue_round_trip_and_edits():
    text = cat.definitions(C)
    again = cat.parse(text)
    assert cat.definitions(cat.Catalog(again.languages, again.extensions, again.names, again.scripts, again.prefixes)) == text
    new = cat.parse("Widget\n    filter remove_matches ^\\s*//\n    extension wdg\nRust\n    filter remove_matches x\n    extension rsx2\n    3rd_gen_scale 9\n")
    merged = C.merged(new)
    assert merged.extensions["wdg"] == "Widget" and merged.languages["Rust"].chain == C.languages["Rust"].chain and merged.extensions["rsx2"] == "Rust"
    assert "py" not in C.replaced(new).extensions
    assert C.forced("Python", extension="jpg").extensions["jpg"] == "Python"
    for bad in ("    filter remove_matches x\n", "A\n    filter nothing x\n", "A\n    odd x\n", "A\n    filter remove_matches\n"):
        with pytest.raises(cat.DefinitionError):
            cat.parse(bad)


@pytest.mark.parametrize(
    ("choice", "lines", "language"),
    [
        ("C#/Smalltalk", ["// <auto-generated>", "using X;"], "C# Generated"), ("C#/Smalltalk", ["x foo!", "y bar]."], "Smalltalk"), ("Perl/Prolog", ["#!/usr/bin/perl"], "Perl"), ("Perl/Prolog", ["a :- b."], "Prolog"),
        ("Raku/Prolog", ["sub x { }"], "Raku"), ("D/dtrace", ["BEGIN {"], "dtrace"), ("D/dtrace", ["x"], "D"), ("Ant/XML", ["<project name='x'>"], "Ant"), ("Ant/XML", ["<x>"], "XML"), ("Maven/XML", ["<project x>"], "Maven"),
        ("XML-Qt-GTK/Glade", ["generated with glade"], "Glade"), ("Visual Basic/TeX/Apex Class", ["% x", "\\y"], "TeX"), ("PHP/Pascal/Fortran/Pawn/BitBake/Assembly", ["implicit none", "integer :: x"], "Fortran 90"), ("PHP/Pascal/Fortran/Pawn/BitBake/Assembly", ["<?php"], "PHP"),
        ("Pascal/Puppet", ["class foo {", "  file { 'x':", "    a => b,"], "Puppet"), ("Pascal/Pawn", ["begin x"], "Pascal"), ("SKILL/.NET IL", [".assembly x"], ".NET IL"), ("Clojure/Cangjie", ["(ns a)"], "Clojure"), ("IDL/Qt Project/Prolog/ProGuard", ["-keep class x"], "ProGuard"),
        ("MATLAB/Mathematica/Objective-C/MUMPS/Mercury", ["#import <x>"], "Objective-C"), ("MATLAB/Mathematica/Objective-C/MUMPS/Mercury", [""], "MATLAB"), ("MATLAB/Mathematica/Objective-C/MUMPS/Mercury", [":- module x."], "Mercury"),
        ("Verilog-SystemVerilog/Coq", ["Theorem x : y."], "Coq"), ("TypeScript/Qt Linguist", ["a<message>"], "Qt Linguist"), ("Fortran 77/Forth", [": x y ;"], "Forth"), ("Unknown/BitBake", ["nothing"], None), ("Brainfuck", ["++++[>+<-]"], "Brainfuck"), ("Brainfuck", ["text"], None),
    ],
)
def test_choices(choice, lines, language):
    assert resolve.resolved(choice, lines)[0] == language


def test_all_patterns_compile():
    for r in resolve.RESOLVERS.values():
        for group in r.groups:
            for rule in group:
                re.compile(steps.compiled(rule[0]).pattern)


def test_resolvers_take_long_lines_in_one_pass():
    """A search for a repetition and what follows it would try every place of a long word, each to its end."""
    began = time.time()
    for r in resolve.RESOLVERS.values():
        resolve.scores(["word" + "a" * 60_000, " " * 60_000], r)
    assert time.time() - began < 10


def test_shorter_patterns_find_what_the_longer_ones_did():
    pick = random.Random(4)
    lines = ["".join(pick.choices(["a", "é", "_", "9", " ", "\t", "=", "[", "]", "<<'", "\\", "#", "%"], k=pick.randint(0, 8))) for _ in range(20_000)]
    for short, long in ((r"\w\s*=\s*\[", r"\w+\s*=\s*\["), (r"\w\[", r"\w+\["), (r"<<'", r"\s*<<'")):
        assert [bool(finder(short)(x)) for x in lines] == [bool(compiled(long).search(x)) for x in lines]
    for p, anchored in ((r"(?i)^\s*(a|b)\b", True), (r"^[|(]a", True), (r"^a\||b", False), (r"^a|^b", False), (r"a^", False)):
        assert (finder(p).__name__ == "match") == anchored
