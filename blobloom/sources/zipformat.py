"""ZIP-compatible containers: record layouts, a directory scan, and conversions of their fields."""

from __future__ import annotations

import struct
from collections.abc import Callable
from datetime import datetime, timezone

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import bytesx

LOCAL, CENTRAL, END = b"PK\x03\x04", b"PK\x01\x02", b"PK\x05\x06"
LOCAL_SIZE, CENTRAL_SIZE, END_SIZE = 30, 46, 22
VERSION, MADE_BY_UNIX, UTF8_FLAG = 20, 0x0314, 0x0800
TAG_TIME, TAG_VOCAB = 0x5455, 0x554E
MAX_ENTRIES, MAX_FIELD = 0xFFFF, 0xFFFF
FILE_TYPE, REGULAR, DIRECTORY, SYMLINK = 0o170000, 0o100000, 0o040000, 0o120000
#: Numeric codes of vocabularies in the extra field (second byte).
VOCAB_CODES = {"text": 0, "go": 1, "python": 2, "javascript": 3}
VOCAB_NAMES = {v: k for k, v in VOCAB_CODES.items()}
#: What the four bytes of the vocabulary field mean, by number.
CODES: dict[str, list[str]] = {
    "nat": ["unspecified", "en", "es", "fr", "pt", "de", "it", "nl", "zh", "ar", "hi", "id", "bn", "ru", "ja"],
    "prog": ["none", "go", "python", "javascript", "java", "c", "c++", "c#", "ruby", "rust", "php", "swift", "kotlin"],
    "fmt": ["none", "json", "xml", "yaml", "csv", "toml", "ini"],
    "markup": ["none", "html", "markdown", "latex", "rtf", "rst", "asciidoc", "org"],
}
SCHEMA = "ordinal int, name string, size long, comp_size long, method smallint, crc32 long, mtime timestamp, mode int, offset long, vocab struct<nat:tinyint,prog:tinyint,fmt:tinyint,markup:tinyint>, truncated boolean"


class Invalid(ValueError):
    """Bytes that are no archive, or a damaged one."""


def dos_time(t: datetime | None) -> tuple[int, int]:
    """(date, time) words; 0, 0 for no time. Years are kept within 1980 to 2107."""
    if t is None:
        return 0, 0
    year = min(max(t.year, 1980), 2107)
    return (year - 1980) << 9 | t.month << 5 | t.day, t.hour << 11 | t.minute << 5 | t.second // 2


def from_dos(date: int, time: int) -> datetime | None:
    """None for 0, 0 and for fields out of range."""
    try:
        return datetime(1980 + (date >> 9), date >> 5 & 15, date & 31, time >> 11, time >> 5 & 63, (time & 31) * 2, tzinfo=timezone.utc) if date or time else None
    except ValueError:
        return None


def extra_fields(mtime: datetime | None, vocab: int | None) -> bytes:
    out = b""
    if mtime is not None:
        out += struct.pack("<HHBI", TAG_TIME, 5, 1, int(mtime.timestamp()) & 0xFFFFFFFF)
    if vocab is not None:
        out += struct.pack("<HH4B", TAG_VOCAB, 4, 1, vocab, 0, 0)
    return out


def parse_extra(extra: bytes) -> tuple[datetime | None, tuple[int, int, int, int] | None]:
    """(modification time, vocabulary codes); fields that don't fit end the list."""
    mtime, vocab, at = None, None, 0
    while at + 4 <= len(extra):
        tag, size = struct.unpack_from("<HH", extra, at)
        body = extra[at + 4 : at + 4 + size]
        if len(body) < size:
            break
        if tag == TAG_TIME and size >= 5 and body[0] & 1:
            mtime = datetime.fromtimestamp(struct.unpack_from("<I", body, 1)[0], timezone.utc)
        elif tag == TAG_VOCAB and size >= 4:
            vocab = tuple(body[:4])
        elif tag == TAG_VOCAB and size == 1:
            # The old form: one byte for the programming language, natural language English.
            vocab = (1, body[0] if body[0] in (1, 2, 3) else 0, 0, 0)
        at += 4 + size
    return mtime, vocab


def has_non_ascii(name: str) -> bool:
    return not name.isascii()


def records(name: str, data_size: int, size: int, method: int, crc: int, mtime: datetime | None, mode: int, vocab: int | None, offset: int) -> tuple[bytes, bytes]:
    """(local header, central record) of an entry."""
    raw, extra = name.encode(), extra_fields(mtime, vocab)
    if len(raw) > MAX_FIELD or max(data_size, size, offset) > 0xFFFFFFFF:
        raise Invalid("an entry is too large for this format")
    date, time = dos_time(mtime)
    flags = UTF8_FLAG if has_non_ascii(name) else 0
    common = struct.pack("<HHHHHIIIHH", VERSION, flags, method, time, date, crc, data_size, size, len(raw), len(extra))
    local = LOCAL + common + raw + extra
    folder = 0x10 if name.endswith("/") else 0
    central = CENTRAL + struct.pack("<H", MADE_BY_UNIX) + common + struct.pack("<HHHII", 0, 0, 0, (mode & 0xFFFF) << 16 | folder, offset) + raw + extra
    return local, central


def end_record(n: int, size: int, offset: int) -> bytes:
    if n > MAX_ENTRIES:
        raise Invalid("an archive holds at most 65535 entries")
    return END + struct.pack("<HHHHIIH", 0, 0, n, n, size, offset, 0)


def find_end(tail: bytes) -> int:
    """The place of the last end record."""
    if len(tail) < END_SIZE:
        raise Invalid("too short")
    at = tail.rfind(END, 0, len(tail) - END_SIZE + 4)
    if at < 0:
        raise Invalid("no end of a directory")
    return at


def scan(size: int, read: Callable[[int, int], bytes]) -> list[dict]:
    """The directory's entries by reading (offset, length) ranges; what follows a damaged record is left out, and marked
    by truncated on the entries before it."""
    if size < END_SIZE:
        raise Invalid("too short")
    start = max(0, size - END_SIZE - MAX_FIELD)
    tail = read(start, size - start)
    end = find_end(tail)
    n, length, offset = struct.unpack_from("<HII", tail, end + 10)
    if offset > size:
        raise Invalid("the directory lies outside of the file")
    raw, at, out, cut = read(offset, min(length, size - offset)), 0, [], False
    for k in range(n):
        if at + CENTRAL_SIZE > len(raw) or raw[at : at + 4] != CENTRAL:
            cut = True
            break
        made, _, flags, method, time, date, crc, packed, plain, n_name, n_extra, n_comment, _, _, attributes, where = struct.unpack_from("<HHHHHHIIIHHHHHII", raw, at + 4)
        if at + CENTRAL_SIZE + n_name + n_extra + n_comment > len(raw):
            cut = True
            break
        at += CENTRAL_SIZE
        name = raw[at : at + n_name].decode("utf-8", "replace")
        mtime, vocab = parse_extra(raw[at + n_name : at + n_name + n_extra])
        at += n_name + n_extra + n_comment
        mode = attributes >> 16 if made >> 8 == 3 else 0
        if name.endswith("/"):
            mode = mode & ~FILE_TYPE | DIRECTORY
        out.append({"ordinal": k, "name": name, "size": plain, "comp_size": packed, "method": method, "crc32": crc, "mtime": mtime or from_dos(date, time), "mode": mode, "offset": where, "vocab": dict(zip(("nat", "prog", "fmt", "markup"), (v - 256 if v > 127 else v for v in vocab))) if vocab else None})
    return [e | {"truncated": cut} for e in out]


def entries(content: bytes) -> list[dict]:
    return scan(len(content), lambda at, n: content[at : at + n])


def body(content: bytes, entry: dict) -> bytes:
    """The packed bytes of an entry, by its local header."""
    at = entry["offset"]
    if content[at : at + 4] != LOCAL or at + LOCAL_SIZE > len(content):
        raise Invalid("no local header")
    n_name, n_extra = struct.unpack_from("<HH", content, at + 26)
    at += LOCAL_SIZE + n_name + n_extra
    data = content[at : at + entry["comp_size"]]
    if len(data) < entry["comp_size"]:
        raise Invalid("the entry is cut off")
    return data


def safe_name(name: str) -> bool:
    """Whether a name stays within the folder it is extracted to."""
    return bool(name) and not name.startswith(("/", "\\")) and ".." not in name.replace("\\", "/").split("/") and name[1:2] != ":"


# -- the same conversions as column expressions


def is_valid(content: Column) -> Column:
    """Whether the bytes begin with a local header. An archive without entries doesn't."""
    return (F.octet_length(content) >= LOCAL_SIZE) & (F.hex(F.substring(content, 1, 4)) == LOCAL.hex().upper())


def dos_date_word(t: Column) -> Column:
    year = F.least(F.greatest(F.year(t), F.lit(1980)), F.lit(2107))
    return F.coalesce(F.shiftleft(year - 1980, 9) + F.shiftleft(F.month(t), 5) + F.dayofmonth(t), F.lit(0))


def dos_time_word(t: Column) -> Column:
    return F.coalesce(F.shiftleft(F.hour(t), 11) + F.shiftleft(F.minute(t), 5) + F.floor(F.second(t) / 2).cast("int"), F.lit(0))


def dos_timestamp(date: Column, time: Column) -> Column:
    bits = lambda c, shift, mask: F.shiftright(c, shift).bitwiseAND(mask)
    made = F.try_make_timestamp(bits(date, 9, 127) + 1980, bits(date, 5, 15), bits(date, 0, 31), bits(time, 11, 31), bits(time, 5, 63), bits(time, 0, 31) * 2)
    return F.when((date != 0) | (time != 0), made)


def mode_type(mode: Column) -> Column:
    kind = mode.bitwiseAND(FILE_TYPE)
    return F.when(kind == DIRECTORY, "dir").when(kind == SYMLINK, "link").otherwise("file")


_EXTRA = T.StructType([T.StructField("mtime", T.TimestampType()), T.StructField("vocab", T.StructType([T.StructField(k, T.ByteType()) for k in ("nat", "prog", "fmt", "markup")]))])


@F.arrow_udf(_EXTRA)
def extra_columns(extra: pa.Array) -> pa.Array:
    """The modification time and the vocabulary codes of extra fields."""
    found = [parse_extra(x.as_py() or b"") for x in extra]
    codes = [dict(zip(("nat", "prog", "fmt", "markup"), (v - 256 if v > 127 else v for v in x))) if x else None for _, x in found]
    names = pa.struct([(k, pa.int8()) for k in ("nat", "prog", "fmt", "markup")])
    return pa.StructArray.from_arrays([pa.array([t for t, _ in found], pa.timestamp("us", "UTC")), pa.array(codes, names)], ["mtime", "vocab"])


def first_mode(content: Column) -> Column:
    """The mode bits of the first directory record; null if there is none, or if it wasn't made by Unix."""
    at = F.instr(bytesx.latin1(content), CENTRAL.decode("latin-1"))
    made, attributes = bytesx.le_uint(content, at + 3, 2), bytesx.le_uint(content, at + 37, 4)
    return F.when((at > 0) & (F.shiftright(made, 8) == 3), F.shiftright(attributes, 16).cast("int"))


def ratio(size: Column, packed: Column) -> Column:
    """The saved share in whole percent; 0 of nothing. It may be negative."""
    return F.when(size > 0, F.lit(100) - F.floor(packed * 100 / size).cast("long")).otherwise(F.lit(0))
