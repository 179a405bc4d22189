import io
import os
import zipfile
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from blobloom.session import prepare
from blobloom.sources import archives, zipformat as zf

TOKENS = {"text": (*(bytes([i]) for i in range(256)), b" the", b"ing ", b"and ")}
T0 = datetime(2023, 5, 6, 7, 8, 10, tzinfo=timezone.utc)
FILES = {"a.txt": b"the thing and the other thing " * 50, "Имя файла.txt": b"x", "dir/b.bin": bytes(range(256)), "empty": b"", "中文/c.json": b'{"a": 1}' * 9}


def manifest(spark, ids=("one", "two")):
    rows = [(i, k, n, "file", bytearray(d), None, T0, 0o644) for i in ids for k, (n, d) in enumerate(FILES.items())]
    rows += [("one", 90, "dir", "dir", None, None, T0, 0o755), ("one", 91, "link", "link", None, "a.txt", None, 0o777)]
    return prepare(spark).createDataFrame(rows, "archive_id string, ordinal int, name string, kind string, content binary, link_target string, mtime timestamp, mode int")


def test_round_trip_and_listing(spark):
    made = archives.pack(archives.encode_entries(manifest(spark), TOKENS)).cache()
    listed = archives.list_entries(made, "archive_id").where("archive_id = 'one'").orderBy("ordinal").collect()
    assert [r.name for r in listed] == [*FILES, "dir/", "link"]
    assert all(r.mtime.replace(tzinfo=None) == listed[0].mtime.replace(tzinfo=None) for r in listed[:-1]) and listed[-1].mtime is None
    assert [r.mode & zf.FILE_TYPE for r in listed[-2:]] == [zf.DIRECTORY, zf.SYMLINK] and listed[0].mode == 0o100644
    got = {r.name: (bytes(r.data), r.error) for r in archives.read_entries(made, "archive_id", TOKENS).where("archive_id = 'one'").collect()}
    assert got == {**{n: (d, None) for n, d in FILES.items()}, "link": (b"a.txt", None)}
    some = archives.read_entries(made, "archive_id", TOKENS, ["*.txt"]).where("archive_id = 'two'").collect()
    assert {r.name for r in some} == {"a.txt", "Имя файла.txt"}
    assert {r.archive_id: (r.entries, r.errors) for r in archives.test_archives(made, "archive_id", TOKENS).collect()} == {"one": (6, 0), "two": (5, 0)}


def test_python_reads_stored_and_deflated(spark):
    made = archives.pack(archives.encode_entries(manifest(spark, ("one",)), TOKENS)).first()
    with zipfile.ZipFile(io.BytesIO(made.content)) as z:
        plain = [i for i in z.infolist() if i.compress_type in (0, 8)]
        assert len(z.infolist()) == 7 and all(z.read(i) == FILES.get(i.filename, b"a.txt" if i.filename == "link" else b"") for i in plain)
        assert z.getinfo("a.txt").date_time == (2023, 5, 6, 7, 8, 10)


def test_reads_what_python_writes(spark):
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w", zipfile.ZIP_DEFLATED) as z:
        for n, d in FILES.items():
            z.writestr(n, d)
        z.comment = b"a comment"
    df = prepare(spark).createDataFrame([(1, bytearray(buf.getvalue()))], "k int, content binary")
    assert {r.name: bytes(r.data) for r in archives.read_entries(df, "k", TOKENS).where("error is null").collect()} == FILES


def test_damage(spark):
    good = bytes(archives.pack(archives.encode_entries(manifest(spark, ("one",)), TOKENS)).first().content)
    cut_directory = bytearray(good)
    second = good.find(zf.CENTRAL, good.find(zf.CENTRAL) + 4)
    cut_directory[second] ^= 1
    flipped = bytearray(good)
    at = good.find(bytes(range(256)))
    flipped[at if at >= 0 else 60] ^= 0xFF
    bad = {"none": None, "short": b"abc", "zeros": zf.LOCAL + b"\0" * 30, "cut": bytes(cut_directory), "flipped": bytes(flipped), "good": good}
    df = prepare(spark).createDataFrame([(k, bytearray(v) if v is not None else None) for k, v in bad.items()], "k string, content binary")
    got = {}
    for r in archives.list_entries(df, "k").collect():
        got.setdefault(r.k, []).append(r)
    assert all(len(got[k]) == 1 and got[k][0].error for k in ("none", "short", "zeros"))
    assert len(got["cut"]) == 1 and got["cut"][0].truncated and len(got["good"]) == 7 and not got["good"][0].truncated
    tested = {r.k: r.errors for r in archives.test_archives(df, "k", TOKENS).collect()}
    assert tested["good"] == 0 and tested["flipped"] == 1


def test_source_files_and_extraction(spark, tmp_path):
    files = archives.write(archives.encode_entries(manifest(spark), TOKENS), f"file://{tmp_path}/zips").collect()
    assert sorted(os.path.basename(r.file) for r in files) == ["one.zip", "two.zip"] and all(os.path.getsize(r.file) == r.size for r in files)
    (tmp_path / "zips/bad.zip").write_bytes(b"not one")
    archives.register(spark)
    rows = spark.read.format("zipdir").load(f"{tmp_path}/zips")
    assert rows.where("error is null").count() == 12 and rows.where("error is not null").count() == 1
    for path, n in ((f"file://{tmp_path}/zips", 12), (f"{tmp_path}/zips/t*.zip", 5), (f"file://{tmp_path}/*/one.zip", 7), (f"{tmp_path}/zips/two.zip", 5), (f"{tmp_path}/none/*.zip", 0)):
        assert spark.read.format("zipdir").load(path).where("error is null").count() == n
    data = spark.read.format("binaryFile").load(f"{tmp_path}/zips/two.zip")
    data.createOrReplaceTempView("z")
    assert spark.sql("SELECT e.name FROM z, LATERAL zip_entries(content) e").count() == 5
    out = archives.read_entries(data, "path", TOKENS)
    first = archives.extract(out, str(tmp_path / "out")).collect()
    assert {r.status for r in first} == {"written"} and (tmp_path / "out/dir/b.bin").read_bytes() == FILES["dir/b.bin"]
    assert {r.status for r in archives.extract(out, str(tmp_path / "out"), "skip").collect()} == {"skipped"}
    assert {r.status for r in archives.extract(out, f"file://{tmp_path}/out", flat=True).where("name not like '%/%'").collect()} == {"exists"}
    assert {r.status for r in archives.extract(out, f"file://{tmp_path}/out", "overwrite").collect()} == {"written"} and not [f for f in os.listdir(tmp_path / "out") if f.endswith(".part")]
    evil = spark.createDataFrame([("../x", bytearray(b"1"), None), ("/abs", bytearray(b"1"), None), ("ok", None, "broken")], "name string, data binary, error string")
    assert {r.name: r.status for r in archives.extract(evil, str(tmp_path / "out")).collect()} == {"../x": "unsafe name", "/abs": "unsafe name", "ok": "broken"}


def test_manifest_of_a_folder(spark, tmp_path):
    (tmp_path / "t/sub").mkdir(parents=True)
    (tmp_path / "t/sub/f.txt").write_text("hello")
    (tmp_path / "t/a").write_text("1")
    os.symlink("a", tmp_path / "t/ln")
    os.symlink("sub", tmp_path / "t/dirlink")
    prepare(spark)
    with pytest.raises(IsADirectoryError):
        archives.manifest(spark, str(tmp_path / "t"))
    followed = archives.manifest(spark, str(tmp_path / "t"), recursive=True).orderBy("ordinal").collect()
    assert [(r.name, r.kind) for r in followed] == [("t/", "dir"), ("t/a", "file"), ("t/ln", "file"), ("t/sub/", "dir"), ("t/sub/f.txt", "file")]
    kept = archives.manifest(spark, str(tmp_path / "t"), recursive=True, links=True)
    assert {(r.name, r.link_target) for r in kept.where("kind = 'link'").collect()} == {("t/ln", "a"), ("t/dirlink", "sub")}
    assert {r.name: bytes(r.content) for r in archives.with_content(kept, str(tmp_path / "t")).where("content is not null").collect()} == {"t/a": b"1", "t/sub/f.txt": b"hello"}


def test_equal_names_null_keys_and_first_headers(spark):
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w", zipfile.ZIP_DEFLATED) as z, pytest.warns(UserWarning):
        z.writestr("a.txt", b"one" * 10)
        z.writestr("a.txt", b"two" * 20)
        z.writestr("b/c.bin", b"x")
    made = archives.pack(archives.encode_entries(manifest(spark, ("one",)), TOKENS)).first().content
    df = spark.createDataFrame([(None, bytearray(buf.getvalue())), (1, bytearray(buf.getvalue())), (1, bytearray(buf.getvalue())), (2, bytearray(made)), (3, bytearray(b"PK")), (4, bytearray(made[:33])), (5, None), (6, bytearray(b"x" * 40))], "k int, content binary")
    got = archives.read_entries(df.where("k is null or k = 1"), "k", TOKENS, ["a.*"]).collect()
    assert sorted((str(r.k), len(r.data)) for r in got) == [("1", 30), ("1", 30), ("1", 60), ("1", 60), ("None", 30), ("None", 60)]
    listed = archives.listing(archives.list_entries(df.where("k is null"), "k"), "k").collect()
    assert sorted((str(r.name), r.n, r.size) for r in listed) == [("None", 3, 91), ("a.txt", 1, 30), ("a.txt", 1, 60), ("b/c.bin", 1, 1)]
    assert {r.name for r in archives.list_entries(df.where("k = 2"), "k", patterns=["*.txt"]).collect()} == {"a.txt", "Имя файла.txt"}
    first = {r.k: r for r in archives.first_entry(df, "k").collect()}
    assert (first[2].name, first[2].size, first[2].mode, first[2].mtime.replace(tzinfo=timezone.utc)) == ("a.txt", len(FILES["a.txt"]), 0o100644, T0)
    assert {k: first[k].error for k in (3, 4, 5, 6)} == {3: "too short", 4: "cut off", 5: "too short", 6: "no local header"} and first[1].crc32 == zipfile.ZipFile(buf).infolist()[0].CRC
    assert all(first[3][c] is None for c in ("name", "size", "mode", "mtime"))


def test_printed_listing(spark):
    made = archives.pack(archives.encode_entries(manifest(spark, ("one",)), TOKENS))
    entries = archives.list_entries(made, "archive_id")
    short = {r.name: r.line for r in archives.printed(archives.listing(entries, "archive_id", ["*.txt"]), "archive_id").collect()}
    assert short["a.txt"] == f"{len(FILES['a.txt']):10d}  a.txt" and short[None].endswith("  2 files")
    full = {r.name: r.line for r in archives.printed(archives.listing(entries, "archive_id", verbose=True), "archive_id", verbose=True).collect()}
    assert "2023-05-06 07:08" in full["a.txt"] and full["empty"].split()[1] == "store" and full[None].endswith("7 files") and len(full) == 8


def test_recorded_vocabulary_is_the_one_used(spark):
    go = "package box\n\nfunc Lid(n int) error {\n\tif err != nil {\n\t\treturn err\n\t}\n\tdefer shut()\n}\n" * 20
    df = spark.createDataFrame([("x", 0, "a.go", "file", bytearray(go.encode()), None, T0, 0o644)], "archive_id string, ordinal int, name string, kind string, content binary, link_target string, mtime timestamp, mode int")
    own = TOKENS | {"go": (*(bytes([i]) for i in range(256)), b"package box", b"func ", b"return err")}
    for have, name in ((TOKENS, "text"), (own, "go")):
        made = archives.encode_entries(df, have)
        assert made.first().vocabulary == name
        # Vocabularies that come later don't change how it is read.
        got = archives.read_entries(archives.pack(made), "archive_id", own).first()
        assert got.error is None and bytes(got.data) == go.encode()


def test_listing_totals(spark):
    e = prepare(spark).createDataFrame([("z", "a", 100, 25), ("z", "b", 10, 40), ("y", "c", 0, 0)], "archive string, name string, size long, comp_size long")
    got = {(r.archive, r.name): (r.n, r.ratio) for r in archives.listing(e, "archive").collect()}
    assert got == {("z", "a"): (1, 75), ("z", "b"): (1, 0), ("z", None): (2, 41), ("y", "c"): (1, 0), ("y", None): (1, 0)}


def test_archive_names(spark):
    df = spark.createDataFrame([("a",), ("b.zip",), ("",)], "n string")
    assert [r[0] for r in df.select(archives.archive_name(F.col("n"))).collect()] == ["a.zip", "b.zip", ".zip"]


def test_fields():
    assert zf.parse_extra(zf.extra_fields(T0, 2)) == (T0, (1, 2, 0, 0))
    assert zf.parse_extra(bytes.fromhex("4E55010001")) == (None, (1, 1, 0, 0)) and zf.parse_extra(b"UT\x09") == (None, None)
    assert zf.from_dos(*zf.dos_time(T0)) == T0 and zf.dos_time(None) == (0, 0) and zf.from_dos(0, 0) is None and zf.from_dos(1 << 9, 0) is None
    assert zf.dos_time(datetime(1900, 1, 2, tzinfo=timezone.utc))[0] >> 9 == 0
    with pytest.raises(zf.Invalid):
        zf.end_record(70_000, 0, 0)


def test_dos_columns(spark):
    df = prepare(spark).createDataFrame([(T0,), (None,)], "t timestamp")
    got = df.select(zf.dos_date_word(F.col("t")).alias("d"), zf.dos_time_word(F.col("t")).alias("c")).collect()
    assert [(r.d, r.c) for r in got] == [zf.dos_time(T0), (0, 0)]
    assert spark.range(1).select(zf.dos_timestamp(F.lit(0), F.lit(0)).alias("a"), zf.dos_timestamp(F.lit(512), F.lit(0)).alias("b")).first() == (None, None)


def test_single_archives_share_batches_and_are_not_shuffled(spark):
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([(i // 2 if i < 40 else None, f"{{\"k\": {i % 7}}}") for i in range(60)], "id long, props string").coalesce(1)
    vocab = {"text": tuple(bytes([i]) for i in range(256))}
    made = archives.single(rows, "id", F.lit("x.json"), F.encode("props", "UTF-8"), vocab)
    assert "Exchange hash" not in made._jdf.queryExecution().toString()
    got = archives.read_entries(made, "archive_id", vocab)
    assert sorted((r.archive_id is None, r.archive_id or 0, bytes(r.data).decode(), r.error) for r in got.collect()) == sorted((r.id is None, r.id or 0, r.props, None) for r in rows.collect())
    sizes = got.select("archive_id").mapInArrow(lambda batches: (b.slice(0, 1) for b in batches), "archive_id long")
    assert sizes.count() < 20
