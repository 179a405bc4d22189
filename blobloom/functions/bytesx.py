"""Byte views and little-endian readers as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Profiles look at this many leading bytes of a blob; that is their definition.
SAMPLE_BYTES = 8192


def as_bytes(text: Column) -> Column:
    """The UTF-8 bytes of a string column."""
    return F.encode(text, "UTF-8")


def sample(content: Column) -> Column:
    return F.substring(content, 1, SAMPLE_BYTES)


def latin1(content: Column) -> Column:
    """A string with one character for each byte, so that string functions count bytes."""
    return F.decode(content, "ISO-8859-1")


def lenient_text(content: Column) -> Column:
    """The bytes as UTF-8 text; what isn't valid becomes U+FFFD."""
    return F.make_valid_utf8(content.cast("string"))


def le_uint(content: Column, offset: Column | int, size: int) -> Column:
    """The unsigned little-endian number of size bytes (up to 7) at a zero-based offset; null beyond the end."""
    start = (F.lit(offset) if isinstance(offset, int) else offset) + 1
    piece = F.substring(content, start, F.lit(size))
    return F.when(F.octet_length(piece) == size, F.conv(F.hex(F.reverse(latin1(piece)).cast("string")), 16, 10).cast("long")) if size == 1 else F.when(F.octet_length(piece) == size, F.conv(F.hex(F.encode(F.reverse(latin1(piece)), "ISO-8859-1")), 16, 10).cast("long"))


def le_bytes(number: Column, size: int) -> Column:
    """The size low bytes of a number, little-endian."""
    return F.unhex(F.array_join(F.array(*(F.lpad(F.hex(F.shiftrightunsigned(number.cast("long"), 8 * k).bitwiseAND(255)), 2, "0") for k in range(size))), ""))


def glob_regex(pattern: str) -> str | None:
    """The regular expression of a shell glob whose * and ? stay within a path part; None if the glob is malformed."""
    out, i = [], 0
    while i < len(pattern):
        c = pattern[i]
        i += 1
        if c == "*":
            out.append("[^/]*")
        elif c == "?":
            out.append("[^/]")
        elif c == "\\":
            if i == len(pattern):
                return None
            out.append(_literal(pattern[i]))
            i += 1
        elif c == "[":
            negate = pattern[i : i + 1] == "^"
            i += negate
            ranges: list[str] = []
            while True:
                if i >= len(pattern):
                    return None
                if pattern[i] == "]" and ranges:
                    i += 1
                    break
                low, i = _member(pattern, i)
                high = low
                if pattern[i : i + 1] == "-":
                    high, i = _member(pattern, i + 1)
                if low is None or high is None:
                    return None
                ranges.append(f"{_literal(low)}-{_literal(high)}" if low <= high else "")
            inner = "".join(ranges)
            out.append(f"[{'^' if negate else ''}{inner}]" if inner else ("(?s:.)" if negate else r"[^\s\S]"))
        else:
            out.append(_literal(c))
    return "^" + "".join(out) + "$"


def _member(pattern: str, i: int) -> tuple[str | None, int]:
    if i >= len(pattern) or pattern[i] in "-]":
        return None, i + 1
    if pattern[i] == "\\":
        return (pattern[i + 1], i + 2) if i + 1 < len(pattern) else (None, i + 1)
    return pattern[i], i + 1


def _literal(c: str) -> str:
    return "\\" + c if c in r"\.^$|()[]{}*+?-&~#" else c


def matches_any(name: Column, patterns: list[str]) -> Column:
    """Whether the full name or its last part matches one of the globs; malformed globs match nothing."""
    regexes = [r for p in patterns if (r := glob_regex(p))]
    base = F.element_at(F.split(name, "/"), -1)
    hit = F.lit(False)
    for r in regexes:
        hit = hit | name.rlike(r) | base.rlike(r)
    return hit
