"""Archives as DataFrames: listing, reading, testing, extracting and writing.

Listing reads a file's directory only. Writing streams: the entries of an archive come
sorted to one task, which appends them to the file one by one, so an archive needs the
memory of an entry. Encoding happens before that, spread over all tasks.
"""

from __future__ import annotations

import os
import re
import stat
import zlib
from collections.abc import Callable, Iterator
from datetime import datetime, timezone

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions import bytesx
from ..functions.bytesx import glob_regex, matches_any
from ..operators import choose, codecs
from . import zipformat as zf

Vocabularies = dict[str, tuple[bytes, ...]]
#: Bytes of a batch that is sent, beyond which no row is added, and rows that are turned into Python objects at a time.
BATCH, SLICE = 4 << 20, 1024


def _column(b: pa.RecordBatch, name: str) -> pa.Array:
    return b.column(b.schema.get_field_index(name))


def located(path: str):
    """(file system, path) of a path or URI on any file system that Arrow knows."""
    import pyarrow.fs as fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


class ZipDirectory(DataSource):
    """spark.read.format("zipdir").load(path or glob): the entries of archives; option mode: permissive or failfast.

    The path may be a URI of a shared file system. One partition for each file. The reader seeks to the directory at the end,
    so a listing reads no entry's bytes."""

    @classmethod
    def name(cls) -> str:
        return "zipdir"

    def schema(self) -> str:
        return "archive string, " + zf.SCHEMA + ", error string"

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return _ZipReader(self.options)


class _ZipReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.strict = options["path"], options.get("mode", "permissive").lower() == "failfast"

    def partitions(self) -> list[InputPartition]:
        import pyarrow.fs as fs

        where, root = located(self.path)
        kind = where.get_file_info([root])[0].type
        if kind == fs.FileType.Directory:
            found = [x.path for x in where.get_file_info(fs.FileSelector(root, recursive=True)) if x.is_file]
        elif kind == fs.FileType.File:
            found = [root]
        else:
            # A glob: everything below the folder that its fixed part names.
            parts = root.split("/")
            fixed = "/".join(parts[: next((i for i, x in enumerate(parts) if any(c in x for c in "*?[")), len(parts))])
            wanted = re.compile(glob_regex(root) or "(?!)")
            found = [x.path for x in where.get_file_info(fs.FileSelector(fixed or "/", allow_not_found=True, recursive=True)) if x.is_file and wanted.search(x.path)]
        return [InputPartition(p) for p in sorted(found)] or [InputPartition("")]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        if not partition.value:
            return
        where, _ = located(self.path)
        with where.open_input_file(partition.value) as f:
            try:
                for e in zf.scan(f.size(), lambda at, n: f.read_at(n, at)):
                    v = e["vocab"]
                    yield (partition.value, *(e[k] for k in ("ordinal", "name", "size", "comp_size", "method", "crc32", "mtime", "mode", "offset")), tuple(v.values()) if v else None, e["truncated"], None)
            except zf.Invalid as e:
                if self.strict:
                    raise
                yield (partition.value, *[None] * 11, str(e))


def list_entries(archives: DataFrame, key: str, content: str = "content", patterns: list[str] | None = None) -> DataFrame:
    """key, the entry's columns and error, for each entry of archives held in a binary column whose name matches; a bad archive
    gives one row."""
    kind = T.StructType.fromDDL(zf.SCHEMA + ", error string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, rows = [], []
            for k, data in zip(_column(b, key).to_pylist(), _column(b, content).to_pylist()):
                try:
                    found = [e | {"error": None} for e in zf.entries(bytes(data or b""))]
                except zf.Invalid as e:
                    found = [{f.name: None for f in kind} | {"error": str(e)}]
                keys += [k] * len(found)
                rows += found
            from pyspark.sql.pandas.types import to_arrow_schema

            arrow = to_arrow_schema(kind)
            yield pa.RecordBatch.from_arrays([pa.array(keys, b.schema.field(key).type), *(pa.array([r[f.name] for r in rows], f.type) for f in arrow)], [key, *arrow.names])

    listed = archives.select(key, content).mapInArrow(run, T.StructType([archives.schema[key], *kind.fields]))
    return listed.where(F.col("error").isNotNull() | matches_any(F.col("name"), patterns)) if patterns else listed


def read_entries(archives: DataFrame, key: str, vocabularies: Vocabularies, patterns: list[str] | None = None, content: str = "content") -> DataFrame:
    """(key, ordinal, name, data, error): the decoded files (no directories) whose name matches; names are filtered before
    anything is decoded, and checksums are verified. One pass over the archives, nothing is shuffled; archives of equal or
    null keys stay apart. What is no archive has no entries."""
    globs = [re.compile(g) for p in patterns or () if (g := glob_regex(p))]

    def wanted(name: str) -> bool:
        return not name.endswith("/") and (not patterns or any(g.search(name) or g.search(name.rsplit("/", 1)[-1]) for g in globs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out, size, kind = [], 0, b.schema.field(key).type
            for k, data in ((k.as_py(), data.as_py()) for k, data in zip(_column(b, key), _column(b, content))):
                data = data or b""
                try:
                    found = [e for e in zf.entries(data) if wanted(e["name"])]
                except zf.Invalid:
                    continue
                for e in found:
                    try:
                        tokens = vocabularies.get(zf.VOCAB_NAMES.get((e["vocab"] or {}).get("prog", 0), "text")) or vocabularies["text"]
                        got = choose.decode(zf.body(data, e), e["method"], tokens)
                        out.append((k, e["ordinal"], e["name"], got, None if zlib.crc32(got) == e["crc32"] else "checksum differs"))
                        size += len(got)
                    except (ValueError, IndexError) as problem:
                        out.append((k, e["ordinal"], e["name"], None, str(problem)))
                    if size > BATCH:
                        yield batch(out, kind)
                        out, size = [], 0
            if out:
                yield batch(out, kind)

    def batch(out: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
        k, o, n, d, x = zip(*out)
        return pa.record_batch([pa.array(k, kind), pa.array(o, pa.int32()), pa.array(n, pa.string()), pa.array(d, pa.binary()), pa.array(x, pa.string())], [key, "ordinal", "name", "data", "error"])

    return archives.select(key, content).mapInArrow(run, T.StructType([archives.schema[key], *T.StructType.fromDDL("ordinal int, name string, data binary, error string").fields]))


def first_entry(archives: DataFrame, key: str, content: str = "content") -> DataFrame:
    """key and what the first local header says (name, size, comp_size, method, crc32, mtime, mode, vocab), from the archive's
    leading bytes; mode is that of the first directory record, 0644 without one. error: too short, no header, or cut off."""
    c = F.col(content)
    u = lambda at, n: bytesx.le_uint(c, at, n)
    n_name, n_extra = u(26, 2), u(28, 2)
    good = F.octet_length(c) >= zf.LOCAL_SIZE
    problem = F.when(c.isNull() | ~good, "too short").when(~zf.is_valid(c), "no local header").when(F.octet_length(c) < zf.LOCAL_SIZE + n_name + n_extra, "cut off")
    made = archives.select(key, c.alias("__c"), problem.alias("error"), u(8, 2).cast("smallint").alias("method"), u(10, 2).cast("int").alias("__time"), u(12, 2).cast("int").alias("__date"), u(14, 4).alias("crc32"), u(18, 4).alias("comp_size"), u(22, 4).alias("size"), F.substring(c, F.lit(zf.LOCAL_SIZE + 1), n_name.cast("int")).cast("string").alias("name"), F.substring(c, (n_name + zf.LOCAL_SIZE + 1).cast("int"), n_extra.cast("int")).alias("__extra"))
    extra = zf.extra_columns(F.col("__extra"))
    mode = zf.first_mode(F.col("__c"))
    out = made.select(key, "name", "size", "comp_size", "method", "crc32", F.coalesce(extra["mtime"], zf.dos_timestamp(F.col("__date"), F.col("__time"))).alias("mtime"), F.coalesce(mode, F.lit(0o644)).alias("mode"), extra["vocab"].alias("vocab"), "error")
    return out.select(key, *(F.when(F.col("error").isNull(), F.col(x)).alias(x) for x in out.columns if x not in (key, "error")), "error")


def test_archives(archives: DataFrame, key: str, vocabularies: Vocabularies, patterns: list[str] | None = None) -> DataFrame:
    """(key, entries, errors) of each archive."""
    return read_entries(archives, key, vocabularies, patterns).groupBy(key).agg(F.count("*").alias("entries"), F.count("error").alias("errors"))


def encode_entries(manifest: DataFrame, vocabularies: Vocabularies) -> DataFrame:
    """The rows of a manifest (archive_id, ordinal, name, kind, content, link_target, mtime, mode), encoded.

    A directory's name ends in a slash and has no data; a link's target is its content, stored."""
    name = F.when((F.col("kind") == "dir") & ~F.endswith("name", F.lit("/")), F.concat("name", F.lit("/"))).otherwise(F.col("name"))
    data = F.when(F.col("kind") == "dir", F.lit(b"")).when(F.col("kind") == "link", F.encode("link_target", "UTF-8")).otherwise(F.coalesce("content", F.lit(b"")))
    full = F.col("mode").bitwiseAND(0o7777).bitwiseOR(F.when(F.col("kind") == "dir", zf.DIRECTORY).when(F.col("kind") == "link", zf.SYMLINK).otherwise(zf.REGULAR))
    rows = manifest.select("archive_id", "ordinal", name.alias("name"), "mtime", full.alias("mode"), "kind", data.alias("data"))
    keep = ["archive_id", "ordinal", "name", "mtime", "mode"]
    files = choose.compress(rows.where("kind = 'file'"), "data", keep, vocabularies, archive=True)
    other = choose.compress(rows.where("kind <> 'file'"), "data", keep, vocabularies, method=codecs.STORE)
    return files.unionByName(other)


def _assemble(rows: Iterator[dict]) -> Iterator[tuple[object, bytes, bool]]:
    """(archive, bytes, last) piece by piece."""
    now, at, directory, n = None, 0, [], 0

    def close() -> tuple[object, bytes, bool]:
        central = b"".join(directory)
        return now[0], central + zf.end_record(n, len(central), at), True

    for r in rows:
        if now is None or now[0] != r["archive_id"]:
            if now is not None:
                yield close()
            now, at, directory, n = (r["archive_id"],), 0, [], 0
        coded = r["method"] in (codecs.RANS_TOKENS, codecs.DEFLATE_TOKENS)
        mtime = r["mtime"]
        mtime = mtime.replace(tzinfo=timezone.utc) if mtime is not None and mtime.tzinfo is None else mtime
        local, central = zf.records(r["name"], r["packed_size"], r["size"], r["method"], r["crc"], mtime, r["mode"], zf.VOCAB_CODES[r["vocabulary"]] if coded else None, at)
        yield now[0], local + bytes(r["packed"]), False
        at += len(local) + r["packed_size"]
        directory.append(central)
        n += 1
    if now is not None:
        yield close()


def _sorted(encoded: DataFrame) -> DataFrame:
    return encoded.repartition("archive_id").sortWithinPartitions("archive_id", "ordinal", "name")


def pack(encoded: DataFrame) -> DataFrame:
    """(archive_id, content): whole archives as cells of up to 2 GB."""
    return _packed(_sorted(encoded), lambda rows: _assemble(rows))


def _packed(rows: DataFrame, assemble: Callable[[Iterator[dict]], Iterator[tuple[object, bytes, bool]]]) -> DataFrame:
    """(archive_id, content) of the pieces that assemble() makes of rows; archives are sent about BATCH bytes at a time."""
    key = rows.schema["archive_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(keys, _arrow(key)), pa.array(made, pa.binary())], ["archive_id", "content"])

        parts: list[bytes] = []
        keys, made, size = [], [], 0
        for k, data, last in assemble(r for b in batches for at in range(0, b.num_rows, SLICE) for r in b.slice(at, SLICE).to_pylist()):
            parts.append(data)
            if last:
                keys.append(k)
                made.append(b"".join(parts))
                size += len(made[-1])
                parts = []
                if size > BATCH or len(keys) >= SLICE:
                    yield batch()
                    keys, made, size = [], [], 0
        if keys:
            yield batch()

    return rows.mapInArrow(run, T.StructType([key, T.StructField("content", T.BinaryType())]))


def single(rows: DataFrame, key: str, name: Column, content: Column, vocabularies: Vocabularies, mtime: Column | None = None) -> DataFrame:
    """(archive_id, content): an archive of one entry for each row. Rows need no others, so nothing is shuffled; equal or null
    keys have an archive for each row."""
    when = F.lit(None).cast("timestamp") if mtime is None else mtime
    entries = encode_entries(rows.select(F.col(key).alias("archive_id"), F.lit(0).alias("ordinal"), name.alias("name"), F.lit("file").alias("kind"), content.alias("content"), F.lit(None).cast("string").alias("link_target"), when.alias("mtime"), F.lit(0o644).alias("mode")), vocabularies)
    return _packed(entries, lambda rows: (piece for r in rows for piece in _assemble(iter([r]))))


def _arrow(field: T.StructField) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(field.dataType)


def write(encoded: DataFrame, folder: str) -> DataFrame:
    """Write each archive to folder/<archive_id>.zip and return (file, size). A file appears under its name when complete."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.fs as fs
        from pyspark import TaskContext

        where, root = fs.FileSystem.from_uri(folder)
        where.create_dir(root, recursive=True)
        attempt = TaskContext.get().taskAttemptId()
        out, size, done = None, 0, []
        for k, data, last in _assemble(r for b in batches for r in b.to_pylist()):
            if not zf.safe_name(str(k)) or "/" in str(k):
                raise zf.Invalid(f"{k} can't name a file")
            name = f"{root}/{k}.zip"
            if out is None:
                out, size = where.open_output_stream(f"{name}.{attempt}.part"), 0
            out.write(data)
            size += len(data)
            if last:
                out.close()
                where.move(f"{name}.{attempt}.part", name)
                out = None
                done.append((name, size))
        yield pa.record_batch([pa.array([d[0] for d in done], pa.string()), pa.array([d[1] for d in done], pa.int64())], ["file", "size"])

    return _sorted(encoded).mapInArrow(run, "file string, size long")


def extract(entries: DataFrame, folder: str, policy: str = "error", flat: bool = False) -> DataFrame:
    """Write decoded entries (name, data, error) below a folder; (name, target, status) of each.

    policy: overwrite, skip or error for files that exist. flat drops the folders of names. Names that would leave the folder
    are rejected. folder may be a URI of a file system that all executors share; a file appears under its name when complete."""
    if policy not in ("overwrite", "skip", "error"):
        raise ValueError(policy)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.fs as fs
        from pyspark import TaskContext

        where, root = located(folder)
        attempt = TaskContext.get().taskAttemptId() if TaskContext.get() else 0
        for b in batches:
            out = []
            for name, data, problem in zip(*(_column(b, c).to_pylist() for c in ("name", "data", "error"))):
                short = name.rsplit("/", 1)[-1] if flat else name
                target = f"{root.rstrip('/')}/{short}"
                if problem is not None or data is None:
                    out.append((name, target, problem or "no data"))
                elif not zf.safe_name(short):
                    out.append((name, target, "unsafe name"))
                elif policy != "overwrite" and where.get_file_info([target])[0].type != fs.FileType.NotFound:
                    out.append((name, target, "skipped" if policy == "skip" else "exists"))
                else:
                    where.create_dir(target.rpartition("/")[0], recursive=True)
                    with where.open_output_stream(f"{target}.{attempt}.part") as f:
                        f.write(data)
                    where.move(f"{target}.{attempt}.part", target)
                    out.append((name, target, "written"))
            n, t, s = zip(*out) if out else ((),) * 3
            yield pa.record_batch([pa.array(n, pa.string()), pa.array(t, pa.string()), pa.array(s, pa.string())], ["name", "target", "status"])

    return entries.select("name", "data", "error").mapInArrow(run, "name string, target string, status string")


def manifest(spark: SparkSession, root: str, recursive: bool = False, links: bool = False) -> DataFrame:
    """Rows (ordinal, path, name, kind, link_target, mtime, mode) of a file or folder, in lexical order.

    A folder needs recursive. With links, symbolic links are entries; else a link to a file is followed and one to a folder
    within the tree is skipped."""
    out: list[tuple] = []

    def add(path: str, name: str) -> None:
        s = os.lstat(path)
        if stat.S_ISLNK(s.st_mode):
            if links:
                out.append((path, name, "link", os.readlink(path), s))
                return
            if os.path.isdir(path) and path != root:
                return
            s = os.stat(path)
        if stat.S_ISDIR(s.st_mode):
            if not recursive:
                raise IsADirectoryError(path)
            out.append((path, name + "/", "dir", None, s))
            for child in sorted(os.listdir(path)):
                add(os.path.join(path, child), f"{name}/{child}")
        else:
            out.append((path, name, "file", None, s))

    add(root, os.path.basename(os.path.normpath(root)))
    rows = [(i, p, n, k, t, datetime.fromtimestamp(int(s.st_mtime), timezone.utc), s.st_mode) for i, (p, n, k, t, s) in enumerate(out)]
    return spark.createDataFrame(rows, "ordinal int, path string, name string, kind string, link_target string, mtime timestamp, mode int")


def with_content(rows: DataFrame, root: str) -> DataFrame:
    """A manifest with the files' bytes, read by Spark's binary source; links and folders have none."""
    spark = rows.sparkSession
    data = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select(F.regexp_replace("path", "^file:/+", "/").alias("path"), "content")
    return rows.join(data, "path", "left").withColumn("content", F.when(F.col("kind") == "file", F.col("content")))


def listing(entries: DataFrame, key: str, patterns: list[str] | None = None, verbose: bool = False) -> DataFrame:
    """(key, name, n, size, comp_size, ratio): each entry and, with a null name, each archive's total; patterns choose entries
    by name. verbose adds method, mtime, crc32 and mode (null in totals).

    An entry's ratio is 0 at least; that of a total may be negative. Entries of equal names stay apart."""
    if patterns:
        entries = entries.where(matches_any(F.col("name"), patterns))
    more = ["method", "mtime", "crc32", "mode"] if verbose else []
    r = zf.ratio(F.col("size"), F.col("comp_size"))
    each = entries.select(key, "name", F.lit(1).cast("long").alias("n"), "size", "comp_size", F.greatest(r, F.lit(0)).alias("ratio"), *more)
    sums = entries.groupBy(key).agg(F.count("*").alias("n"), F.sum("size").alias("size"), F.sum("comp_size").alias("comp_size"))
    total = sums.select(key, F.lit(None).cast("string").alias("name"), "n", "size", "comp_size", r.alias("ratio"), *(F.lit(None).cast(entries.schema[c].dataType).alias(c) for c in more))
    return each.unionByName(total)


#: Width of a listing's columns, as printed.
_LINE = {"size": "%10d", "comp_size": "%10d", "ratio": "%3d%%"}


def printed(listed: DataFrame, key: str, verbose: bool = False) -> DataFrame:
    """(key, name, line): a listing's rows as lines of text; the total's line says how many entries it has."""
    name = F.coalesce("name", F.concat(F.col("n").cast("string"), F.when(F.col("n") == 1, " file").otherwise(" files")))
    if not verbose:
        return listed.select(key, "name", F.format_string("%10d  %s", "size", name).alias("line"))
    when = F.coalesce(F.date_format("mtime", "yyyy-MM-dd HH:mm"), F.lit(" " * 16))
    method = F.coalesce(*(F.when(F.col("method") == k, v) for k, v in choose.NAMES.items()), F.when(F.col("method").isNull(), F.lit("")), F.lit("unknown"))
    crc = F.coalesce(F.lower(F.lpad(F.hex("crc32"), 8, "0")), F.lit(" " * 8))
    return listed.select(key, "name", F.concat_ws("  ", F.format_string(_LINE["size"], "size"), F.rpad(method, 14, " "), F.format_string(_LINE["comp_size"], "comp_size"), F.format_string(_LINE["ratio"], "ratio"), when, crc, name).alias("line"))


def archive_name(name: Column) -> Column:
    """The file name of an archive: .zip is appended unless the name ends in it."""
    return F.when(F.endswith(name, F.lit(".zip")), name).otherwise(F.concat(name, F.lit(".zip")))


def register(spark: SparkSession) -> None:
    """The zipdir source and the zip_entries table function."""
    spark.dataSource.register(ZipDirectory)

    @F.udtf(returnType=zf.SCHEMA)
    class ZipEntries:
        def eval(self, content: bytes):
            for e in zf.entries(bytes(content or b"")):
                v = e["vocab"]
                yield (*(e[k] for k in ("ordinal", "name", "size", "comp_size", "method", "crc32", "mtime", "mode", "offset")), tuple(v.values()) if v else None, e["truncated"])

    spark.udtf.register("zip_entries", ZipEntries)
