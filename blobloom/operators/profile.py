"""Content profiles: metrics of a blob's leading bytes, content labels, and the type derived from them.

A blob's sample (8 KB at most) is measured and labelled by one Arrow function; the type
that follows is a Catalyst expression. Nothing here shuffles.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import bytesx, rules

STATS = T.StructType([T.StructField("entropy", T.DoubleType()), T.StructField("unique_bytes", T.IntegerType()), T.StructField("repetition_rate", T.DoubleType())])


def _views(column: pa.Array) -> list[np.ndarray]:
    return [np.frombuffer(x.as_buffer(), np.uint8) if x.is_valid else np.zeros(0, np.uint8) for x in column]


@F.arrow_udf(T.ArrayType(T.LongType()))
def histogram(content: pa.Array) -> pa.Array:
    """Counts of the 256 byte values."""
    return pa.array([np.bincount(x, minlength=256).tolist() for x in _views(content)], pa.list_(pa.int64()))


def repetition(x: np.ndarray) -> float:
    """The share of 4-byte windows at even offsets that were seen before; 0 below 8 bytes."""
    if len(x) < 8:
        return 0.0
    n = (len(x) - 4) // 2 + 1
    w = np.zeros(n, np.uint32)
    for k in range(4):
        w |= x[k : k + 2 * n : 2][:n].astype(np.uint32) << np.uint32(8 * k)
    return 1.0 - len(np.unique(w)) / n


@F.arrow_udf(STATS)
def byte_stats(content: pa.Array) -> pa.Array:
    out = []
    for x in _views(content):
        c = np.bincount(x, minlength=256)
        p = c[c > 0] / max(len(x), 1)
        out.append((float(-(p * np.log2(p)).sum()) + 0.0, int((c > 0).sum()), repetition(x)))
    e, u, r = zip(*out) if out else ((), (), ())
    return pa.StructArray.from_arrays([pa.array(e, pa.float64()), pa.array(u, pa.int32()), pa.array(r, pa.float64())], ["entropy", "unique_bytes", "repetition_rate"])


def share(l1: Column, chars: str) -> Column:
    """How many of the characters are among chars, as a share (0 of an empty text)."""
    n = F.length(l1) - F.length(F.translate(l1, chars, ""))
    return n / F.greatest(F.length(l1), F.lit(1))


def ascii_ratio(l1: Column) -> Column:
    kept = F.length(F.regexp_replace(l1, r"[^\x20-\x7E\t\n\r]", ""))
    return kept / F.greatest(F.length(l1), F.lit(1))


#: (characters, share that must be passed, tenths); a negative share must not be reached.
CODE_SIGNS = [("{}[]()", 0.02, 3), (";:", 0.01, 2), ("\"'", 0.02, 1), ("\t", 0.02, 2), (" ", -0.12, 1), ("=+-*/<>", 0.01, 1)]


def code_tenths(l1: Column) -> Column:
    """The code score in tenths, 0 to 10."""
    parts = [F.when((share(l1, c) > s) if s > 0 else (share(l1, c) < -s), t).otherwise(0) for c, s, t in CODE_SIGNS]
    return F.when(F.length(l1) > 0, F.least(reduce(add, parts), F.lit(10))).otherwise(0)


_format, _markup = rules.first(rules.FORMATS), rules.first(rules.MARKUP)
_code = {name: rules.points(x) for name, x in rules.CODE.items()}
_words = {name: rules.points([(1, w) for w in words], 1) for name, words in rules.WORDS.items()}
_scripts = [(name, re.compile(f"[{chr(a)}-{chr(b)}]")) for name, a, b in rules.SCRIPTS]


def _code_scores(t: tuple[str, str, str]) -> dict[str, int]:
    own = {name: fn(*t) for name, fn in _code.items()}
    return {name: s + own[rules.BUILDS_ON[name]] if name in rules.BUILDS_ON else s for name, s in own.items()}


def _guess(t: tuple[str, str, str]) -> str:
    return rules.best(_code_scores(t), rules.MIN_CODE)


def _nat_language(t: tuple[str, str, str]) -> str:
    if not t[1].isascii():
        for name, script in _scripts:
            if script.search(t[1]):
                return name
    return rules.best({name: fn(*t) for name, fn in _words.items()}, rules.MIN_WORDS)


def _over(text: pa.Array, fn: Callable[[tuple[str, str, str]], object], kind: pa.DataType) -> pa.Array:
    return pa.array([None if x is None else fn(rules.forms(x)) for x in text.to_pylist()], kind)


@F.arrow_udf(T.StringType())
def data_format(text: pa.Array) -> pa.Array:
    return _over(text, lambda t: _format(*t), pa.string())


@F.arrow_udf(T.StringType())
def markup(text: pa.Array) -> pa.Array:
    return _over(text, lambda t: _markup(*t), pa.string())


@F.arrow_udf(T.StringType())
def nat_language(text: pa.Array) -> pa.Array:
    return _over(text, _nat_language, pa.string())


@F.arrow_udf(T.StringType())
def code_language(text: pa.Array) -> pa.Array:
    return _over(text, _guess, pa.string())


@F.arrow_udf(T.ArrayType(T.StructType([T.StructField("lang", T.StringType()), T.StructField("score", T.IntegerType())])))
def code_scores(text: pa.Array) -> pa.Array:
    """An array of (lang, score)."""
    return _over(text, lambda t: [{"lang": n, "score": s} for n, s in _code_scores(t).items()], pa.list_(pa.struct([("lang", pa.string()), ("score", pa.int32())])))


_MEASURES = T.StructType([*STATS.fields, T.StructField("ascii_ratio", T.DoubleType()), T.StructField("code_tenths", T.IntegerType()), *(T.StructField(x, T.StringType()) for x in ("data_fmt", "markup", "nat_lang", "guess"))])
_plain = np.zeros(256, bool)
_plain[[9, 10, 13, *range(0x20, 0x7F)]] = True
_signs = [([ord(x) for x in chars], s, t) for chars, s, t in CODE_SIGNS]


@F.arrow_udf(_MEASURES)
def measures(content: pa.Array, text: pa.Array) -> pa.Array:
    """Everything that a profile says of a sample and of its text; equal samples of a batch are measured once."""
    out: list[tuple] = []
    seen: dict[tuple[bytes, str], tuple] = {}
    for x, t in zip(_views(content), text.to_pylist()):
        known = x.tobytes(), t
        if known in seen:
            out.append(seen[known])
            continue
        c, n = np.bincount(x, minlength=256), max(len(x), 1)
        p = c[c > 0] / n
        tenths = sum(w for at, s, w in _signs if (c[at].sum() / n > s if s > 0 else c[at].sum() / n < -s)) if len(x) else 0
        f = rules.forms(t)
        out.append((float(-(p * np.log2(p)).sum()) + 0.0, int((c > 0).sum()), repetition(x), float(c[_plain].sum() / n), min(tenths, 10), _format(*f), _markup(*f), _nat_language(f), _guess(f)))
        seen[known] = out[-1]
    cols = list(zip(*out)) or [()] * 9
    kinds = [pa.float64(), pa.int32(), pa.float64(), pa.float64(), pa.int32(), *[pa.string()] * 4]
    return pa.StructArray.from_arrays([pa.array(v, k) for v, k in zip(cols, kinds)], [f.name for f in _MEASURES])


#: The labels of each kind by number; the first is what a kind has for nothing found.
LABELS: dict[str, list[str]] = {
    "type": ["text", "code", "binary", "repetitive", "low-entropy", "random"],
    "language": ["Unknown", *rules.CODE],
    "data_fmt": ["None", *(n for n, _ in rules.FORMATS)],
    "markup": ["None", "HTML", "Markdown", "LaTeX", "RTF", "reST", "AsciiDoc", "Org"],
    "nat_lang": ["Unknown", "English", "Spanish", "French", "Portuguese", "German", "Italian", "Dutch", "Chinese", "Arabic", "Hindi", "Indonesian", "Bengali", "Russian", "Japanese"],
}


def label(kind: str, code: Column) -> Column:
    """The label of a number; beyond those there are it is unknown."""
    names = LABELS[kind]
    return F.coalesce(F.get(F.array(*map(F.lit, names)), F.when(code >= 0, code)), F.lit("unknown" if kind == "type" else "Unknown"))


def content_type() -> Column:
    """The type, from the profile's columns; the first rule that holds."""
    c = F.col
    code = c("code_tenths") >= 4
    rule = [
        (c("n") == 0, "random"), (c("data_fmt") != "None", "code"), ((c("markup") == "HTML") & code, "code"), (c("markup") != "None", "text"),
        ((c("ascii_ratio") > 0.85) & code, "code"), (c("ascii_ratio") > 0.85, "text"), (c("repetition_rate") > 0.3, "repetitive"),
        (c("entropy") < 5, "low-entropy"), ((c("entropy") > 7.5) & (c("unique_bytes") > 250), "random"),
    ]
    out = F.lit("binary")
    for cond, name in reversed(rule):
        out = F.when(cond, name).otherwise(out)
    return out


def profile(df: DataFrame, content: Column, keep: list[str]) -> DataFrame:
    """keep and the whole profile of each blob; null content counts as empty."""
    s = bytesx.sample(F.coalesce(content, F.lit(b"")))
    base = df.select(*keep, s.alias("s"))
    made = base.select(*keep, F.octet_length("s").alias("n"), measures(F.col("s"), bytesx.lenient_text(F.col("s"))).alias("m"))
    wide = made.select(*keep, "n", "m.*")
    typed = wide.withColumn("type", content_type())
    js = (F.col("type") == "code") & (F.col("data_fmt") == "None") & (F.col("markup") == "HTML")
    plain = (F.col("type") == "code") & (F.col("data_fmt") == "None") & (F.col("markup") == "None")
    language = F.when(js, "JavaScript").when(plain, F.col("guess")).otherwise("Unknown")
    return typed.select(*keep, "type", language.alias("language"), "data_fmt", "markup", "nat_lang", "entropy", "ascii_ratio", "unique_bytes", "repetition_rate", (F.col("code_tenths") / 10).alias("code_score"))
