"""Ordered and weighted text rules, as data, compiled for Arrow functions and rendered for SQL.

A condition is a substring, or a tuple: ("any", c, ...), ("all", c, ...), ("not", c),
("more", a, b) for more occurrences of a than of b, ("starts", s), ("trim", s) for the
trimmed text starting with s, ("lower", c) for the condition on the lower-cased text.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

Condition = str | tuple

#: Points for each language; ties go to the earlier one. Under MIN_CODE points the language is unknown.
CODE: dict[str, list[tuple[int, Condition]]] = {
    "Go": [(3, "package "), (3, "if err != nil"), *((2, w) for w in ("chan ", "defer ", "func ", "go func", "import (", "interface{", "struct {", ":= "))],
    "Python": [(3, ("all", " import ", "from ")), *((3, w) for w in ("__init__", "__name__", "elif ", "self.")), *((2, w) for w in ("async def", "def ")), *((1, w) for w in ("None", "await ", "class ", "import ")), (1, ("any", "False", "True")), (1, ("more", "    ", "\t"))],
    "JavaScript": [*((3, w) for w in ("=> ", "module.exports", "require(")), (3, ("any", "useEffect", "useState")), *((2, w) for w in ("console.log", "const ", "export ", "let ", "undefined")), (2, ("any", ": number", ": string")), *((1, w) for w in ("async ", "function ", "interface ", "null", "var "))],
    "Java": [(5, "public static void main"), *((4, w) for w in ("System.out.println", "import java.", "public class ")), (3, "@Override"), *((2, w) for w in ("implements ", "throws ")), *((1, w) for w in ("extends ", "private "))],
    "C": [*((4, w) for w in ("int main(", "#include <")), *((3, w) for w in ("printf(", "#define ", '#include "')), (3, ("any", "free(", "malloc(")), *((2, w) for w in ("typedef ", "sizeof(")), (1, "->")],
    "C++": [(4, "std::"), (4, ("any", "cin >>", "cout <<")), (4, ("any", "template <", "template<")), *((3, w) for w in ("nullptr", "namespace ")), (3, ("all", "public:", "class ")), (2, "virtual "), (2, ("all", "delete ", "new "))],
    "C#": [*((4, w) for w in ("public async Task", "Console.WriteLine", "using System")), (3, ("any", "[SerializeField]", "[Attribute]")), (3, ("any", "set;", "get;")), (2, ("all", "class ", "namespace ")), (2, ("all", "public ", "=> ")), (1, ("all", "new ", "var "))],
    "Ruby": [(4, ("any", "attr_reader", "attr_accessor")), (3, "puts "), (3, "do |"), (3, ("all", "end", "def ")), (3, ("any", 'require "', "require '")), (2, "module "), (2, ("all", "def ", "@")), (2, ("any", ".map ", ".each ")), (2, ("any", "elsif ", "unless "))],
    "Rust": [*((4, w) for w in ("use std::", "fn main()")), (4, ("any", "print!(", "println!(")), *((3, w) for w in ("pub fn ", "impl ", "mut ")), (3, ("all", "let ", "fn ")), (3, ("all", "=>", "match ")), (3, ("any", "Result<", "Option<")), (3, ("any", "&mut self", "&self")), (2, "unwrap()")],
    "PHP": [(5, "<?php"), (4, ("all", "$this", "->")), (3, ("all", "function ", "$")), (2, "echo "), (2, ("all", "use ", "namespace ")), (1, ("any", "=>", "array("))],
    "Swift": [(5, ("any", "import UIKit", "import Foundation")), (4, ("any", "if let ", "guard ")), (4, ("any", "@IBAction", "@IBOutlet")), (3, ("all", "->", "func ")), (2, ("all", ": ", "let ")), (2, ("all", ": ", "var ")), (2, ("all", ": ", "struct ")), (2, ("all", ("not", "println"), "print("))],
    "Kotlin": [*((4, w) for w in ("companion object", "data class ", "fun main(", "suspend fun ")), (4, ("any", "import android", "import kotlin")), (3, ("all", ": ", "fun ")), (3, ("any", "!!", "?.")), (2, "println("), (1, ("any", "var ", "val "))],
}
MIN_CODE = 3
#: Languages whose score includes another's.
BUILDS_ON = {"C++": "C"}

_spaced = lambda words, extra="": [f" {w} " for w in sorted(words.split())] + sorted(extra.split())
#: One point for each substring that the lower-cased sample holds; ties go to the earlier language. Under MIN_WORDS it is unknown.
WORDS: dict[str, list[str]] = {
    "English": _spaced("a and are as be for have in is it of that the to was with"),
    "Spanish": _spaced("con de el en es la las los para por que un una", "ción ñ"),
    "French": _spaced("avec dans de est et la le les pour que un une", "ç è ê œ"),
    "Portuguese": _spaced("a as com de em não o os para que um uma é", "ã ção"),
    "German": _spaced("auf das der die ein eine für ist mit nicht sich und", "ß ä ö ü"),
    "Italian": _spaced("che con della di i il la le non per sono un una è"),
    "Dutch": _spaced("dat de een en het is met niet op te van voor", "ij oe"),
    "Indonesian": _spaced("adalah dan dari dengan di ini itu ke pada tidak untuk yang", "kan nya"),
}
MIN_WORDS = 3
#: Scripts decide before words do, in this order; a range of code points each (two for none).
SCRIPTS: list[tuple[str, int, int]] = [("Arabic", 0x600, 0x6FF), ("Japanese", 0x3040, 0x30FF), ("Chinese", 0x4E00, 0x9FFF), ("Hindi", 0x900, 0x97F), ("Bengali", 0x980, 0x9FF), ("Russian", 0x400, 0x4FF)]

#: The first rule that holds names the data format; CSV is a rule of its own (see csv_*).
_section = ("any", "\n[", ("trim", "["))
FORMATS: list[tuple[str, Condition]] = [
    ("JSON", ("all", '":', ("any", ("trim", "["), ("trim", "{")))),
    ("XML", ("all", ("trim", "<"), ("any", "<?xml", ("all", ">", "</", ("not", ("lower", ("any", "<!doctype html", "<html"))))))),
    ("YAML", ("all", ": ", ("not", "{"), ("any", "\n- ", "\n  ", ("trim", "---")))),
    ("CSV", ("csv",)),
    ("TOML", ("all", " = ", "[", "]", _section)),
    ("INI", ("all", "=", "[", _section)),
]
_page = ("lower", ("any", "<html", "<!doctype html", ("all", "<body", "<head"), ("all", "</", "<div")))
MARKUP: list[tuple[str, Condition]] = [
    ("HTML", _page),
    ("LaTeX", ("any", "\\section{", "\\usepackage", "\\begin{document}", "\\documentclass")),
    ("RTF", ("starts", "{\\rtf")),
    ("Org", ("any", "#+BEGIN_SRC", "#+TITLE", ("trim", "* "))),
    ("reST", ("rst",)),
    ("AsciiDoc", ("any", "[source,", ":toc:", "\n== ", ("trim", "= "))),
    ("Markdown", ("points", 3, [(3, "```"), (2, "## "), (2, "# "), (2, ("all", "[", "](")), (1, ("any", "__", "**")), (1, ("any", "* ", "- "))])),
]

#: White space at the ends that trimming takes away: that of Unicode.
SPACE = "\t\n\v\f\r \x85\xa0                　"
#: An underline of one of these, longer than three, below a line that isn't empty.
RST_LINE = "=-~^"


def bind(value: Column, fn: Callable[[Column], Column]) -> Column:
    """fn of a value which is evaluated once, however often fn names it (projections alone would be merged)."""
    return F.element_at(F.transform(F.array(value), fn), 1)


Test = Callable[[str, str, str], bool]
_RST = re.compile(rf"[^\n]\n[{SPACE.replace(chr(10), '')}]*(?:{'|'.join(f'\\{c}{{4,}}' for c in RST_LINE)})[{SPACE.replace(chr(10), '')}]*(?:\n|\Z)")


def compiled(c: Condition, form: int = 0) -> Test:
    """A condition as a function of a text, its lower case and its trimmed form. Hundreds of them read a text at the speed of
    substring search; as Catalyst expressions over one text they would be one interpreted lambda."""
    if isinstance(c, str):
        return lambda *t: c in t[form]
    kind, *rest = c
    if kind in ("any", "all"):
        parts = [compiled(x, form) for x in rest]
        return (lambda *t: any(p(*t) for p in parts)) if kind == "any" else (lambda *t: all(p(*t) for p in parts))
    if kind == "not":
        one = compiled(rest[0], form)
        return lambda *t: not one(*t)
    if kind == "lower":
        return compiled(rest[0], 1)
    if kind == "starts":
        return lambda *t: t[form].startswith(rest[0])
    if kind == "trim":
        return lambda *t: t[2].startswith(rest[0])
    if kind == "more":
        return lambda *t: t[form].count(rest[0]) > t[form].count(rest[1])
    if kind == "csv":
        return lambda *t: _csv(t[form])
    if kind == "rst":
        return lambda *t: ".. " in t[form] and _RST.search(t[form]) is not None
    if kind == "points":
        total = points(rest[1], form)
        return lambda *t: total(*t) >= rest[0]
    raise ValueError(kind)


def _csv(text: str) -> bool:
    lines = text.split("\n", 2)
    return len(lines) > 1 and lines[0].count(",") == lines[1].count(",") > 0 and "{" not in lines[0]


def points(rules: list[tuple[int, Condition]], form: int = 0) -> Callable[[str, str, str], int]:
    parts = [(w, compiled(c, form)) for w, c in rules]
    return lambda *t: sum(w for w, p in parts if p(*t))


def first(rules: list[tuple[str, Condition]]) -> Callable[[str, str, str], str]:
    parts = [(name, compiled(c)) for name, c in rules]
    return lambda *t: next((name for name, p in parts if p(*t)), "None")


def best(scores: dict[str, int], least: int) -> str:
    """The earliest name of the highest score, Unknown below least."""
    name = max(scores, key=scores.__getitem__)
    return name if scores[name] >= least else "Unknown"


def forms(text: str) -> tuple[str, str, str]:
    """A text, its lower case and its trimmed form."""
    return text, text.lower(), text.strip(SPACE)


def sql_text(s: str) -> str:
    """A SQL string literal; control characters by chr()."""
    parts, plain = [], ""
    for c in s:
        if ord(c) < 32 or 0x7F <= ord(c) < 0xA0:
            if plain:
                parts.append("'" + plain.replace("'", "''") + "'")
                plain = ""
            parts.append(f"chr({ord(c)})")
        else:
            plain += c
    if plain or not parts:
        parts.append("'" + plain.replace("'", "''") + "'")
    return "(" + " || ".join(parts) + ")" if len(parts) > 1 else parts[0]


class SqlRules:
    """Renders conditions over the SQL expressions of a text, its lower case and its trimmed form."""

    def __init__(self, text: str = "t", low: str = "lo", trimmed: str = "tr"):
        self.text, self.low, self.trimmed = text, low, trimmed

    def condition(self, c: Condition, text: str | None = None) -> str:
        t = text or self.text
        if isinstance(c, str):
            return f"contains({t}, {sql_text(c)})"
        kind, *rest = c
        if kind in ("any", "all"):
            return "(" + (" OR " if kind == "any" else " AND ").join(self.condition(x, text) for x in rest) + ")"
        if kind == "not":
            return f"(NOT {self.condition(rest[0], text)})"
        if kind == "lower":
            return self.condition(rest[0], self.low)
        if kind == "starts":
            return f"starts_with({t}, {sql_text(rest[0])})"
        if kind == "trim":
            return f"starts_with({self.trimmed}, {sql_text(rest[0])})"
        if kind == "more":
            n = lambda x: f"((length({t}) - length(replace({t}, {sql_text(x)}, ''))) / {len(x)})"
            return f"({n(rest[0])} > {n(rest[1])})"
        if kind == "csv":
            line = lambda k: f"split_part({t}, chr(10), {k})"
            commas = lambda x: f"(length({x}) - length(replace({x}, ',', '')))"
            return f"(contains({t}, chr(10)) AND {commas(line(1))} > 0 AND {commas(line(1))} = {commas(line(2))} AND NOT contains({line(1)}, '{{'))"
        if kind == "rst":
            under = "|".join(f"\\{c}{{4,}}" for c in RST_LINE)
            blank = r"[\t\v\f\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
            return f"(contains({t}, '.. ') AND regexp_matches({t}, '[^\\n]\\n{blank}*(?:{under}){blank}*(?:\\n|$)'))"
        if kind == "points":
            return f"({self.points(rest[1])} >= {rest[0]})"
        raise ValueError(kind)

    def points(self, rules: list[tuple[int, Condition]], text: str | None = None) -> str:
        return "(" + " + ".join(f"CASE WHEN {self.condition(c, text)} THEN {w} ELSE 0 END" for w, c in rules) + ")"

    def first(self, rules: list[tuple[str, Condition]]) -> str:
        return "CASE " + " ".join(f"WHEN {self.condition(c)} THEN '{name}'" for name, c in rules) + " ELSE 'None' END"


def sql_best(scores: dict[str, str], least: int) -> str:
    top = f"greatest({', '.join(scores.values())})"
    return f"CASE WHEN {top} < {least} THEN 'Unknown' " + " ".join(f"WHEN {s} = {top} THEN '{n}'" for n, s in scores.items()) + " END"
