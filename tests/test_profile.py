import math
import random

import pytest
from pyspark.sql import functions as F

from blobloom.functions import bytesx, rules
from blobloom.operators import profile
from blobloom.plans.registry import SNIPPETS
from blobloom.session import prepare
from blobloom.streaming import profiles


def rows_of(spark, blobs):
    return prepare(spark).createDataFrame([(k, bytearray(v) if v is not None else None) for k, v in blobs.items()], "case_id string, content binary")


def whole(spark, blobs):
    return {r.case_id: r for r in profile.profile(rows_of(spark, blobs), F.col("content"), ["case_id"]).collect()}


def slow_stats(x):
    counts = [x.count(b) for b in range(256)]
    e = -sum(c / len(x) * math.log2(c / len(x)) for c in counts if c) if x else 0.0
    windows = [x[i : i + 4] for i in range(0, len(x) - 3, 2)]
    return round(e, 9) + 0.0, sum(c > 0 for c in counts), round(1 - len(set(windows)) / len(windows), 9) if len(x) >= 8 else 0.0


def test_metrics_match_a_slow_twin(spark):
    rng = random.Random(1)
    blobs = {str(i): bytes(rng.choice([rng.randrange(256), 65, 66]) for _ in range(rng.choice([0, 1, 4, 7, 8, 9, 500, 9000]))) for i in range(60)}
    blobs |= {"null": None, "one": b"A" * 100, "all": bytes(range(256)) * 4}
    for k, r in whole(spark, blobs).items():
        s = (blobs[k] or b"")[:8192]
        assert (round(r.entropy, 9) + 0.0, r.unique_bytes, round(r.repetition_rate, 9)) == slow_stats(s)
        kept = sum(32 <= b < 127 or b in b"\t\n\r" for b in s)
        assert r.ascii_ratio == pytest.approx(kept / len(s) if s else 0)


def test_types(spark):
    got = whole(spark, {"empty": b"", "prose": b"The dog was in the yard. " * 30, "bytes": bytes(i * 37 % 256 for i in range(1000)), "noise": random.Random(2).randbytes(8192), "json": b'{"a": {"b": 1}}', "repeat": bytes([200, 201, 202, 203]) * 500, "page": b"<html><body>hello</body></html>", "go": SNIPPETS["go"].encode()})
    assert {k: got[k].type for k in ("empty", "prose", "noise", "json", "repeat")} == {"empty": "random", "prose": "text", "noise": "random", "json": "code", "repeat": "repetitive"}
    assert got["json"].language == "Unknown" and got["page"].markup == "HTML" and got["go"].type == "code" and got["go"].language == "Go"


def test_labels_of_snippets(spark):
    got = whole(spark, {k: v.encode() for k, v in SNIPPETS.items()})
    assert {k: got[k].data_fmt for k in ("json", "toml", "ini", "yaml", "csv", "xml")} == {"json": "JSON", "toml": "TOML", "ini": "INI", "yaml": "YAML", "csv": "CSV", "xml": "XML"}
    assert {k: got[k].markup for k in ("rst", "adoc", "org", "tex", "rtf")} == {"rst": "reST", "adoc": "AsciiDoc", "org": "Org", "tex": "LaTeX", "rtf": "RTF"}


NATURAL = {
    "English": "It was the best of days and it was as good as any that we have had in the city.", "Spanish": "El perro de la casa es para los hijos que viven en una ciudad.",
    "French": "Le chat est dans la maison avec une dame pour les enfants.", "German": "Der Hund ist nicht für die Katze, und das ist auf der Straße schön.",
    "Portuguese": "O menino não é para os dias de uma canção com um amigo.", "Italian": "Il gatto è della casa, non per la città che sono con una.", "Dutch": "Het kind is niet met de hond van een man op te voor zij.",
    "Indonesian": "Ini adalah buku yang tidak untuk dan dari itu dengan pada ke.", "Russian": "Это просто дом", "Chinese": "这是一个房子", "Japanese": "これは家です", "Arabic": "هذا بيت", "Hindi": "यह घर है", "Bengali": "এটি বাড়ি", "Unknown": "zzz",
}


def test_natural_languages(spark):
    got = whole(spark, {k: v.encode() for k, v in NATURAL.items()})
    assert {k: r.nat_lang for k, r in got.items()} == {k: k for k in NATURAL}


def test_sample_ends_within_a_character(spark):
    got = whole(spark, {"cut": ("a" + "é" * 5000).encode(), "bad": b"\xff\xfe the and of \xc3"})
    assert got["cut"].unique_bytes == 3 and got["bad"].unique_bytes > 8


def test_little_endian(spark):
    df = rows_of(spark, {"x": bytes([1, 2, 255, 128, 0, 9])})
    r = df.select(bytesx.le_uint(F.col("content"), 1, 2).alias("a"), bytesx.le_uint(F.col("content"), 2, 4).alias("b"), bytesx.le_uint(F.col("content"), 4, 4).alias("c"), bytesx.le_uint(F.col("content"), 0, 1).alias("d"), F.hex(bytesx.le_bytes(F.lit(258), 4)).alias("e")).first()
    assert (r.a, r.b, r.c, r.d, r.e) == (0xFF02, 0x090080FF, None, 1, "02010000")


@pytest.mark.parametrize("glob, name, hit", [("*.txt", "a.txt", True), ("*.txt", "d/a.txt", True), ("d/*.txt", "d/a.txt", True), ("d/*.txt", "d/e/a.txt", False), ("?.c", "ab.c", False), ("[a-c]x", "bx", True), ("[^a-c]x", "bx", False), ("\\*", "*", True), ("[a", "a", False), ("a+b", "a+b", True), ("[]a]", "]", False)])
def test_globs(spark, glob, name, hit):
    assert spark.createDataFrame([(name,)], "n string").select(bytesx.matches_any(F.col("n"), [glob]).alias("m")).first().m is hit


def test_plan_reads_two_columns_and_does_not_shuffle(spark):
    df = profile.profile(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"), bytesx.as_bytes(F.col("text")), ["doc_id"])
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "ReadSchema: struct<doc_id:bigint,text:string>" in plan


def test_stream_of_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.json").write_text('{"a": 1}')
    (tmp_path / "in/b.txt").write_text("It was the best of the days and that is it. " * 5)
    q = profiles.to_parquet(profiles.profiled(profiles.arriving(prepare(spark), str(tmp_path / "in"))), str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination(120)
    got = {r.path.rsplit("/", 1)[-1]: r for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got["a.json"].data_fmt == "JSON" and got["b.txt"].nat_lang == "English"


def test_windowed_counts(spark):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    got = profiles.format_counts(events, "ts", "props").groupBy("data_fmt").agg(F.sum("n").alias("n")).collect()
    assert [(r.data_fmt, r.n) for r in got] == [("JSON", events.count())]


def test_sql_literals():
    assert rules.sql_text("a'b") == "'a''b'" and rules.sql_text("a\nb") == "('a' || chr(10) || 'b')" and rules.sql_text("") == "''"


def test_label_numbers(spark):
    df = prepare(spark).createDataFrame([(0,), (5,), (6,), (-1,), (99,)], "k int")
    assert [r[0] for r in df.select(profile.label("type", F.col("k"))).collect()] == ["text", "random", "unknown", "unknown", "unknown"]
    assert [r[0] for r in df.select(profile.label("markup", F.col("k"))).collect()] == ["None", "reST", "AsciiDoc", "Unknown", "Unknown"]
    assert [len(v) for v in profile.LABELS.values()] == [6, 13, 7, 8, 15]
