"""Which of several languages a shared extension means, by scoring its lines.

A resolver is a table: groups of rules, each rule (pattern, points by language, ends the
scan). On a line the first rule of each group that matches counts. `order` breaks ties:
the earliest listed language with the highest score wins. Patterns are fixed values; none
begins with a repetition, which a search would try from every place of a long run.
"""

from __future__ import annotations

from dataclasses import dataclass

from .patterns import compiled, finder

#: The rules of BitBake.
BITBAKE = [
    [(r"(?i)^\s*(SRC_URI|SRC_REV|SUMMARY|LICENSE|DEPENDS|RDEPENDS|LIC_FILES_CHKSUM)\s*=", {"BitBake": 1})],
    [(r"(?i)(\.=|=\.|\?=|\?\?=)", {"BitBake": 1})],
    [(r"^[A-Z0-9_:-]+:[A-Za-z0-9_-]+\s*=", {"BitBake": 1})],
]
SURE = 1e6  # decides alone


@dataclass(frozen=True)
class Resolver:
    order: tuple[str, ...]
    groups: tuple
    first: tuple = ()  # rules for the first line only
    start: tuple = ()  # points before any line
    skip_blank: bool = False
    gap: float | None = None  # ends the scan when the best two differ by more


#: Resolvers whose languages and patterns are the domain's.
RESOLVERS = {
    "MATLAB/Mathematica/Objective-C/MUMPS/Mercury": Resolver(
        ("MATLAB", "MUMPS", "Mathematica", "Mercury", "Objective-C"),
        (
            [
                (r"^\s*(/\*|//)", {"Objective-C": 5, "MATLAB": -5}),
                (r"^:-\s+", {"Mercury": SURE}, True),
                (r"\w\s*=\s*\[", {"MATLAB": 5}),
            ],
            [
                (r"\w\[", {"Mathematica": 2}),
                (r"^\s*\w+\s*=\s*", {"MUMPS": -1}),
                (r"^\s*\.?([^\W\d])\s+([^\W\d])", {"MUMPS": 1}),
                (r"^\s*\.?(\w)\s+(\w)", {}),
                (r"^\s*;", {"MUMPS": 1}),
            ],
            [
                (r"^\s*#(include|import)", {"Objective-C": SURE}, True),
                (r"^\s*@(interface|implementation|protocol|public|protected|private|end)(\s|$)", {"Objective-C": SURE}, True),
                (r"^\s*BeginPackage", {"Mathematica": 2}),
                (r"^\s*\[", {"MATLAB": 5}),
                (r"^\sK(ill)?\s+", {"MUMPS": 5}),
                (r"^\s*function", {"Objective-C": -1, "MATLAB": 1}),
                (r"^\s*%", {"Objective-C": -1, "MATLAB": 1}),
            ],
        ),
        first=((r"^[A-Z]", {"MUMPS": 1}),),
    ),
    "PHP/Pascal/Fortran/Pawn/BitBake/Assembly": Resolver(
        ("Assembly", "BitBake", "Fortran", "PHP", "Pascal", "Pawn"),
        (
            [
                (r"(?i)^\s*<\?php", {"PHP": 100}, True),
                (r"(?i)^\s*end\.", {"Pascal": 100}, True),
                (r"(?i)^\s*implicit\s+(none|real|integer|complex|double)", {"Fortran": 100}),
                (r"(?i)^\s*end;", {"Pascal": 1}, True),
                (r"(?i)^\s*program\b", {"Fortran": 1, "Pascal": 1}),
                (r"(?i)^\s*(subroutine|module|stop)\b", {"Fortran": 1}),
                (r"(?i)^\s*(writeln|begin|procedure|interface|implementation|const)\b", {"Pascal": 1}),
                (r"^\s*(<|\?>)", {"PHP": 1}),
                (r";\s*$", {"Pascal": 1, "PHP": 1}),
                (r"^@|^\s*(Float:|bool:)", {"Pawn": SURE}, True),
                (r"(?i)^\s*(%include|\.include|include)\b", {"Assembly": 100}, True),
            ],
            [(r"(?i)^\s*(SRC_URI|SRC_REV|SUMMARY|LICENSE|DEPENDS|RDEPENDS|LIC_FILES_CHKSUM)\s*=", {"BitBake": 1})],
            [(r"(?i)(\.=|=\.|\?=|\?\?=)", {"BitBake": 1})],
            [(r"^[A-Z0-9_:-]+:[A-Za-z0-9_-]+\s*=", {"BitBake": 1})],
            [(r"(?i)^\s*(mov|push|pop|add|jmp|call|ret)\b", {"Assembly": 1})],
        ),
    ),
    "Pascal/Puppet": Resolver(
        ("Puppet", "Pascal"),
        (
            [
                (r"^\s*#\s+", {"Puppet": 0.001}),
                (r"(?i)\bprogram\s+[A-Za-z]", {"Pascal": 1}),
            ],
            [
                (r"^\s*#\s+", {}),
                (r"(?i)\bunit\s+[A-Za-z]", {"Pascal": 1}),
            ],
            [
                (r"^\s*#\s+", {}),
                (r"(?i)\bmodule\s+[A-Za-z]", {"Pascal": 1}),
            ],
            [
                (r"^\s*#\s+", {}),
                (r"(?i)\bprocedure\b", {"Pascal": 1}),
            ],
            [
                (r"^\s*#\s+", {}),
                (r"(?i)\bfunction\b", {"Pascal": 1}),
            ],
            [
                (r"^\s*#\s+", {}),
                (r"(?i)^\s*interface\s+", {"Pascal": 1}),
            ],
            [
                (r"^\s*#\s+", {}),
                (r"(?i)^\s*implementation\s+", {"Pascal": 1}),
            ],
            [
                (r"^\s*#\s+", {}),
                (r"(?i)^\s*uses\s+", {"Pascal": 1}),
            ],
            [
                (r"^\s*#\s+", {}),
                (r"(?i)(?<!::)\bbegin\b(?!::)", {"Pascal": 1}),
            ],
            [
                (r"^\s*#\s+", {}),
                (r"(?i)(?<!::)\bend\b(?!::)", {"Pascal": 1}),
            ],
            [
                (r"^\s*#\s+", {}),
                (r":=", {"Pascal": 1}),
            ],
            [
                (r"^\s*#\s+", {}),
                (r"<>", {"Pascal": 1}),
            ],
            [
                (r"^\s*#\s+", {}),
                (r"(?i)^\s*\{\$(I|INCLUDE)\s+.*\}", {"Pascal": 1}),
            ],
            [
                (r"^\s*#\s+", {}),
                (r"writeln", {"Pascal": 1}),
            ],
            [
                (r"^\s*#\s+", {}),
                (r"^\s*class\s+(?!.*class\s+operator\s)(?!operator\s)", {"Puppet": 1}),
            ],
            [
                (r"^\s*#\s+", {}),
                (r"^\s*function\s+[a-z][a-z0-9]+::[a-z][a-z0-9]+\s*", {"Puppet": 1}),
            ],
            [
                (r"^\s*#\s+", {}),
                (r"^\s*type\s+[A-Z]\w+::[A-Z]\w+\s+", {"Puppet": 1}),
            ],
            [
                (r"^\s*#\s+", {}),
                (r"^\s*case\s+", {"Puppet": 1}),
            ],
            [
                (r"^\s*#\s+", {}),
                (r"^\s*package\s+", {"Puppet": 1}),
            ],
            [
                (r"^\s*#\s+", {}),
                (r"^\s*file\s+", {"Puppet": 1}),
            ],
            [
                (r"^\s*#\s+", {}),
                (r"^\s*include\s\w+", {"Puppet": 1}),
            ],
            [
                (r"^\s*#\s+", {}),
                (r"^\s*service\s+", {"Puppet": 1}),
            ],
            [
                (r"^\s*#\s+", {}),
                (r"\s\$\w+\s*=\s*\S", {"Puppet": 1}),
            ],
            [
                (r"^\s*#\s+", {}),
                (r"\S\s*=>\s*\S", {"Puppet": 1}),
            ],
        ),
        gap=20,
    ),
    "Lisp/OpenCL": Resolver(
        ("OpenCL", "Lisp"),
        (
            [(r"^\s*;", {"Lisp": 1})],
            [(r"\((def|eval|require|export|let|loop|dec|format)", {"Lisp": 1})],
            [(r"^\s*(int|float|const|\{)", {"OpenCL": 1})],
        ),
    ),
    "Lisp/Julia": Resolver(
        ("Julia", "Lisp"),
        (
            [(r"^\s*;", {"Lisp": 1})],
            [(r"\((def|eval|require|export|let|loop|dec|format)", {"Lisp": 1})],
            [(r"^\s*(function|end|println|for|while)", {"Julia": 1})],
        ),
    ),
    "Perl/Prolog": Resolver(
        ("Prolog", "Perl"),
        (
            [(r"^=(head|over|item|cut)", {"Perl": 1})],
            [(r";\s*$", {"Perl": 1})],
            [(r"(\{|\})", {"Perl": 1})],
            [(r"^\s*sub\s+", {"Perl": 1})],
            [(r"<<'", {"Perl": 1})],
            [(r"\$(\w+->|[_!])", {"Perl": 1})],
            [(r":-", {"Prolog": 1})],
            [
                (r"#", {}),
                (r"\.\s*$", {"Prolog": 1}),
            ],
        ),
        first=((r"^#!.*?\bperl", {"Perl": SURE}, True),),
        skip_blank=True,
    ),
    "IDL/Qt Project/Prolog/ProGuard": Resolver(
        ("IDL", "ProGuard", "Prolog", "Qt Project"),
        (
            [(r"^\s*;", {"IDL": 1})],
            [(r"(?i)plot\(", {"IDL": 1})],
            [(r"(?i)^\s*(qt|configs|sources|template|target|targetpath|subdirs)\b", {"Qt Project": 1})],
            [(r"(?i)qthavemodule", {"Qt Project": 1})],
            [(r"\.\s*$", {"Prolog": 1})],
            [(r":-", {"Prolog": 1})],
            [(r"^\s*#", {"ProGuard": 1})],
            [(r"^-keep", {"ProGuard": 1})],
            [(r"^-(dont)?obfuscate", {"ProGuard": 1})],
        ),
    ),
    "Fortran 77/Forth": Resolver(
        ("Fortran 77", "Forth"),
        (
            [(r"^:\s", {"Forth": 1})],
            [(r"(?i)^([c*][^a-z]|\s{6,}(subroutine|program|end|implicit)\s|\s*!)", {"Fortran 77": 1})],
        ),
    ),
    "F#/Forth": Resolver(
        ("F#", "Forth"),
        (
            [(r"^:\s", {"Forth": 1})],
            [(r"^\s*(#light|import|let|module|namespace|open|type)", {"F#": 1})],
        ),
    ),
    "Verilog-SystemVerilog/Coq": Resolver(
        ("Verilog-SystemVerilog", "Coq"),
        (
            [(r"^\s*(module|begin|input|output|always)", {"Verilog-SystemVerilog": 1})],
            [(r"\b(Inductive|Fixpoint|Definition|Theorem|Lemma|Proof|Qed|forall|Section|Check|Notation|Variable|Goal|Fail|Require|Scheme|Module|Ltac|Set|Unset|Parameter|Coercion|Axiom|Locate|Type|Record|Existing|Class)\b", {"Coq": 1})],
        ),
    ),
    "TypeScript/Qt Linguist": Resolver(
        ("TypeScript", "Qt Linguist"),
        (
            [(r"\b</?(message|source|translation)>", {"Qt Linguist": 1})],
            [(r"^\s*(var|const|let|class|document)\b", {"TypeScript": 1})],
            [(r"[;}]\s*$", {"TypeScript": 1})],
            [(r"^\s*//", {"TypeScript": 1})],
        ),
    ),
    "XML-Qt-GTK/Glade": Resolver(
        ("XML (Qt/GTK)", "Glade"),
        (
            [(r"(?i)generated\s+with\s+glade", {"Glade": 1}, True)],
        ),
    ),
    "C#/Smalltalk": Resolver(
        ("C#", "Smalltalk"),
        (
            [
                (r"[;}{]\s*$", {"C#": 1}),
                (r"^(using|namespace)\s", {"C#": 20}),
                (r"^\s*(public|private|new)\s", {"C#": 20}),
                (r"^\s*\[assembly:", {"C#": 1}),
            ],
            [(r"(!|\]\.)\s*$", {"Smalltalk": 1, "C#": -1})],
        ),
    ),
    "Visual Basic/TeX/Apex Class": Resolver(
        ("Apex Class", "TeX", "Visual Basic"),
        (
            [
                (r"%|\\", {"TeX": 1}),
                (r"(?i)^\s*(public|private)\s", {"Visual Basic": 1, "Apex Class": 1}),
                (r"(?i)^\s*(end|attribute|version)\s", {"Visual Basic": 1}),
            ],
            [
                (r"%|\\", {}),
                (r"[{}]|;\s*$", {"Apex Class": 1}),
            ],
        ),
        skip_blank=True,
    ),
    "Scheme/SaltStack": Resolver(
        ("SaltStack", "Scheme"),
        (
            [
                (r"\{%.*%\}", {"SaltStack": 5}),
                (r"map\.jinja\b", {"SaltStack": 5}),
                (r"\((define|lambda|let|cond|do)\s", {"Scheme": 1}),
            ],
        ),
    ),
    "Pascal/Pawn": Resolver(
        ("Pawn", "Pascal"),
        (
            [
                (r"^\s*(program|begin|end|[Ww]riteln|procedure)\s", {"Pascal": SURE}, True),
                (r"^@|/\*|\*/|^\s*(Float:|bool:)", {"Pawn": SURE}, True),
                (r";\s*$", {"Pawn": 1, "Pascal": 1}),
            ],
        ),
    ),
    "SKILL/.NET IL": Resolver(
        (".NET IL", "SKILL"),
        (
            [
                (r"^\s*;", {"SKILL": 50}),
                (r"^\.(class|assembly|method|custom|entrypoint)", {".NET IL": 50}, True),
                (r"\{\s*$|^\s*\}", {".NET IL": 5}),
                (r"^\s*(procedure|let|foreach)\b", {"SKILL": 1}),
            ],
        ),
    ),
    "Clojure/Cangjie": Resolver(
        ("Cangjie", "Clojure"),
        (
            [
                (r"^\s*(;|\(|\[)", {"Clojure": 50}),
                (r"^(import|func|main)", {"Cangjie": 50}),
                (r"\{\s*$|^\s*\}$", {"Cangjie": 5}),
                (r"^\s*(procedure|let|foreach)\b", {"Clojure": 1}),
            ],
        ),
    ),
    "D/dtrace": Resolver(
        ("D", "dtrace"),
        (
            [
                (r"^\s*(BEGIN|END|dtrace:|profile:|syscall:|proc:|fbt:)", {"dtrace": 1}, True),
                (r"^\s*(module|import)\s+\w", {"D": 1}, True),
            ],
        ),
    ),
    "Ant/XML": Resolver(
        ("XML", "Ant"),
        (
            [(r"^\s*<project\s+", {"Ant": 1, "XML": -1})],
            [(r'xmlns:artifact="antlib:org\.apache\.maven\.artifact\.ant"', {"Ant": 1, "XML": -1})],
        ),
        start=(("XML", 1.0),),
    ),
    "Maven/XML": Resolver(
        ("XML", "Maven"),
        (
            [(r"^\s*<project\s+", {"Maven": 1, "XML": -1})],
        ),
        start=(("XML", 1.0),),
    ),
}


def scores(lines: list[str], r: Resolver) -> dict[str, float]:
    points = dict.fromkeys(r.order, 0.0) | dict(r.start)
    for number, line in enumerate(lines):
        if r.skip_blank and not line.strip():
            continue
        stop = False
        for group in ([*([x] for x in r.first), *r.groups] if not number else r.groups):
            for pattern, gain, *ends in group:
                if finder(pattern)(line):
                    for k, v in gain.items():
                        points[k] += v
                    stop = bool(ends)
                    break
            if stop:
                break
        if stop or r.gap is not None and abs(points[r.order[0]] - points[r.order[1]]) > r.gap:
            break
    return points


def resolved(language: str, lines: list[str], no_autogen: bool = False) -> tuple[str | None, str | None]:
    """(language, reason it is ignored): exactly one is not None."""
    if language == "Brainfuck":
        hits = sum(bool(compiled(r"([+-]{4,}|[\[\]]{4,}|[<>][+-]|<{3,}|^\s*[\[\]]\s*$)").search(x)) for x in lines)
        return (language, None) if hits > 5 or lines and hits / len(lines) > 0.5 else (None, "does not look like Brainfuck")
    if language == "Unknown/BitBake":
        found = sum(scores(lines, Resolver(("BitBake",), tuple(BITBAKE))).values()) > 0
        return ("BitBake", None) if found else (None, "not BitBake")
    if language == "Raku/Prolog":
        name, why = resolved("Perl/Prolog", lines)
        return "Raku" if name == "Perl" else name, why
    if language not in RESOLVERS:
        return language, None
    r = RESOLVERS[language]
    points = scores(lines, r)
    best = max(r.order, key=lambda k: points[k])  # the first of equals
    if best == "Fortran":
        typed = compiled(r"(?i)^\s*(integer|real|complex|double|character|logical|public|private).*?::")
        best = "Fortran 90" if any(typed.search(x) for x in lines) else "Fortran 77"
    if best == "C#" and compiled(r"//\s+<auto-generated>").search("".join(lines[:2])):
        return (None, "auto-generated C# file") if no_autogen else ("C# Generated", None)
    return best, None


def content_needed(language: str) -> bool:
    return language in RESOLVERS or language in ("Brainfuck", "Unknown/BitBake", "Raku/Prolog")


