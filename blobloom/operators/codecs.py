"""Entropy coders and DEFLATE: table arithmetic as SQL expressions, sequential coding as Arrow UDFs.

Range coding (rANS) advances all blobs of an Arrow batch in step, so that its inner
loop is a numpy operation over blobs instead of a Python loop over bytes.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

SCALE_BITS = 14
SCALE = 1 << SCALE_BITS
LOWER = 1 << 23
CHUNK, LEAST_CHUNK = 64 << 10, 4 << 10
STORE, DEFLATE, RANS_TOKENS, DEFLATE_TOKENS = 0, 8, 85, 86


class Damaged(ValueError):
    """Encoded bytes that can't be decoded."""


def deflate(data: bytes) -> bytes:
    z = zlib.compressobj(9, zlib.DEFLATED, -15)
    return z.compress(data) + z.flush()


def inflate(data: bytes) -> bytes:
    z = zlib.decompressobj(-15)
    try:
        out = z.decompress(data) + z.flush()
    except zlib.error as e:
        raise Damaged(str(e)) from None
    if not z.eof:
        raise Damaged("the stream ends early")
    return out


def varints(ids: list[int]) -> bytes:
    out = bytearray()
    for x in ids:
        while x > 127:
            out.append(x & 127 | 128)
            x >>= 7
        out.append(x)
    return bytes(out)


def read_varints(data: bytes) -> list[int]:
    """The ids; a group cut off at the end gives what is there."""
    out, value, shift, open_ = [], 0, 0, False
    for b in data:
        value |= (b & 127) << shift
        shift += 7
        open_ = b > 127
        if not open_:
            out.append(value)
            value = shift = 0
    return [*out, value] if open_ else out


#: Blobs that are coded in step at least; fewer are coded one after another.
FEW = 24
#: Blobs that are coded in step at most; decoding holds a table of SCALE bytes for each.
TOGETHER = 2048
#: Bytes of a batch that an Arrow function turns into Python objects at a time.
PIECE = 8 << 20


def _in_step(blobs: list[bytes], sizes: list[int], code) -> list[bytes]:
    """code() over blobs of like sizes, TOGETHER at a time."""
    order, out = sorted(range(len(blobs)), key=lambda i: -sizes[i]), [b""] * len(blobs)
    for begin in range(0, len(order), TOGETHER):
        some = order[begin : begin + TOGETHER]
        for i, made in zip(some, code([blobs[i] for i in some])):
            out[i] = made
    return out


def frequencies(counts: np.ndarray) -> np.ndarray:
    """Counts scaled to SCALE: floors, at least 1 for what occurs, the difference to the first of the largest.

    All-zero counts give everything to symbol 0."""
    total = int(counts.sum())
    f = np.zeros(256, np.int64)
    if not total:
        f[0] = SCALE
        return f
    f = np.where(counts > 0, np.maximum(1, counts.astype(np.int64) * SCALE // total), 0)
    f[int(f.argmax())] += SCALE - int(f.sum())
    return f


def rans_encode(blobs: list[bytes]) -> list[bytes]:
    """Length (u32), 256 frequencies (u16), state (u32) and bytes of each blob, little-endian; an empty one is 4 zero bytes."""
    return _in_step(blobs, [len(b) for b in blobs], _encode)


def _encode(blobs: list[bytes]) -> list[bytes]:
    out = [b"\0\0\0\0"] * len(blobs)
    live = sorted((i for i, b in enumerate(blobs) if b), key=lambda i: -len(blobs[i]))
    if not live:
        return out
    m, size = len(live), np.array([len(blobs[i]) for i in live])
    freq = np.stack([frequencies(np.bincount(np.frombuffer(blobs[i], np.uint8), minlength=256)) for i in live])
    cum = np.cumsum(freq, 1) - freq
    # Aligned at the ends: the last bytes of all blobs come first.
    flat = np.frombuffer(b"".join(blobs[i] for i in live), np.uint8)
    end = np.cumsum(size)
    state = np.full(m, LOWER, np.int64)
    room = 2 * size + 8
    written, base = np.zeros(int(room.sum()), np.uint8), np.cumsum(room) - room
    used = np.zeros(m, np.int64)
    count = np.searchsorted(-size, -np.arange(1, size[0] + 1), "right")
    alone = int(np.searchsorted(-count, -FEW, "right"))
    row = np.arange(m)
    for k, n in enumerate(count[:alone].tolist()):
        s = flat[end[:n] - (k + 1)]
        x, r = state[:n], row[:n]
        f = freq[r, s]
        top = ((LOWER >> SCALE_BITS) << 8) * f
        while (big := np.flatnonzero(x >= top)).size:
            written[base[big] + used[big]] = x[big] & 255
            used[big] += 1
            x[big] >>= 8
        state[:n] = ((x // f) << SCALE_BITS) + x % f + cum[r, s]
    # Of the few longest what is left, one blob after another.
    for j in np.flatnonzero(size > alone).tolist():
        x, rest = int(state[j]), bytearray()
        f, c = freq[j].tolist(), cum[j].tolist()
        for s in flat[end[j] - size[j] : end[j] - alone][::-1].tolist():
            n = f[s]
            top = ((LOWER >> SCALE_BITS) << 8) * n
            while x >= top:
                rest.append(x & 255)
                x >>= 8
            x = (x // n << SCALE_BITS) + x % n + c[s]
        written[base[j] + used[j] : base[j] + used[j] + len(rest)] = rest
        used[j] += len(rest)
        state[j] = x
    for j, i in enumerate(live):
        out[i] = struct.pack("<I", int(size[j])) + freq[j].astype("<u2").tobytes() + struct.pack("<I", int(state[j])) + written[base[j] : base[j] + used[j]][::-1].tobytes()
    return out


def rans_decode(blobs: list[bytes]) -> list[bytes]:
    return _in_step(blobs, [struct.unpack_from("<I", b)[0] if len(b) > 3 else 0 for b in blobs], _decode)


def _decode(blobs: list[bytes]) -> list[bytes]:
    out = [b""] * len(blobs)
    live = []
    for i, b in enumerate(blobs):
        if len(b) < 4:
            raise Damaged("too short")
        n = struct.unpack_from("<I", b)[0]
        if n:
            if len(b) < 520 or int(np.frombuffer(b, "<u2", 256, 4).sum()) != SCALE:
                raise Damaged("no valid table")
            live.append((n, i))
    live.sort(reverse=True)
    if not live:
        return out
    size = np.array([n for n, _ in live])
    m = len(live)
    freq = np.stack([np.frombuffer(blobs[i], "<u2", 256, 4).astype(np.int64) for _, i in live])
    cum = np.cumsum(freq, 1) - freq
    symbol = np.stack([np.repeat(np.arange(256, dtype=np.uint8), f) for f in freq])
    state = np.array([struct.unpack_from("<I", blobs[i], 516)[0] for _, i in live], np.int64)
    end = np.array([len(blobs[i]) for _, i in live])
    base = np.cumsum(end) - end
    flat = np.frombuffer(b"".join(blobs[i] for _, i in live), np.uint8)
    at = np.full(m, 520, np.int64)
    made, first = np.zeros(int(size.sum()), np.uint8), np.cumsum(size) - size
    row = np.arange(m)
    count = np.searchsorted(-size, -np.arange(1, size[0] + 1), "right")
    alone = int(np.searchsorted(-count, -FEW, "right"))
    for k, n in enumerate(count[:alone].tolist()):
        x, r = state[:n], row[:n]
        slot = x & (SCALE - 1)
        s = symbol[r, slot]
        made[first[:n] + k] = s
        x = freq[r, s] * (x >> SCALE_BITS) + slot - cum[r, s]
        while (low := np.flatnonzero((x < LOWER) & (at[:n] < end[:n]))).size:
            x[low] = x[low] << 8 | flat[base[low] + at[low]]
            at[low] += 1
        state[:n] = x
    for j in np.flatnonzero(size > alone).tolist():
        x, p, b, last = int(state[j]), int(at[j]), blobs[live[j][1]], int(end[j])
        f, c, names, rest = freq[j].tolist(), cum[j].tolist(), symbol[j].tolist(), bytearray()
        for _ in range(int(size[j]) - alone):
            slot = x & (SCALE - 1)
            s = names[slot]
            rest.append(s)
            x = f[s] * (x >> SCALE_BITS) + slot - c[s]
            while x < LOWER and p < last:
                x = x << 8 | b[p]
                p += 1
        made[first[j] + alone : first[j] + size[j]] = rest
        state[j], at[j] = x, p
    if (state != LOWER).any() or (at != end).any():
        raise Damaged("the state doesn't end where it began")
    for j, (n, i) in enumerate(live):
        out[i] = made[first[j] : first[j] + n].tobytes()
    return out


def pieces(content: pa.Array) -> Iterator[pa.Array]:
    """Slices of a binary array of about PIECE bytes each, one row at least."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(content), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    begin = 0
    while begin < len(ends):
        end = max(begin + 1, int(np.searchsorted(ends, (ends[begin - 1] if begin else 0) + PIECE, "right")))
        yield content.slice(begin, end - begin)
        begin = end


def _udf(fn, many: bool = False):
    """An Arrow UDF over BINARY of a function of one blob, or of a list of blobs; null stays null."""

    @F.arrow_udf(T.BinaryType())
    def run(content: pa.Array) -> pa.Array:
        out = []
        for part in pieces(content):
            have = [x.as_py() for x in part if x.is_valid]
            made = iter(fn(have) if many else map(fn, have))
            out.append(pa.array([next(made) if x.is_valid else None for x in part], pa.binary()))
        return pa.concat_arrays(out) if out else pa.array([], pa.binary())

    return run


deflate_raw, inflate_raw = _udf(deflate), _udf(inflate)
rans_pack, rans_unpack = _udf(rans_encode, True), _udf(rans_decode, True)


@F.arrow_udf(T.ArrayType(T.IntegerType()))
def varint_decode(content: pa.Array) -> pa.Array:
    return pa.array([read_varints(x.as_py()) if x.is_valid else None for x in content], pa.list_(pa.int32()))


def rans_table(counts: DataFrame, key: str, symbol: str, n: str) -> DataFrame:
    """(key, symbol, freq, cum): the scaled table of each key's positive counts."""
    per = W.partitionBy(key)
    scaled = counts.where(F.col(n) > 0).withColumn("f", F.greatest(F.lit(1), F.floor(F.col(n) * SCALE / F.sum(n).over(per))).cast("long"))
    ranked = scaled.withColumn("r", F.row_number().over(per.orderBy(F.desc("f"), symbol)))
    fitted = ranked.withColumn("freq", F.when(F.col("r") == 1, F.col("f") + SCALE - F.sum("f").over(per)).otherwise(F.col("f")))
    before = per.orderBy(symbol).rowsBetween(W.unboundedPreceding, -1)
    return fitted.select(key, symbol, "freq", F.coalesce(F.sum("freq").over(before), F.lit(0)).alias("cum"))


def rans_size(table: DataFrame, counts: DataFrame, key: str, symbol: str, n: str) -> DataFrame:
    """(key, size): the estimated bytes of range coding, header included."""
    bits = F.sum(F.col(n) * -F.log2(F.col("freq") / SCALE))
    return counts.join(table, [key, symbol]).groupBy(key).agg((F.ceil(F.round(bits / 8, 6)) + 520).cast("long").alias("size"))


def chunked(df: DataFrame, key: str, content: str, size: int = CHUNK) -> DataFrame:
    """(key, chunk, packed): each blob range-coded in chunks of size bytes, spread over tasks by chunk; an empty blob has one."""
    size = max(size, LEAST_CHUNK)
    n = F.greatest(F.lit(1), F.ceil(F.octet_length(content) / size)).cast("int")
    pieces = df.where(F.col(content).isNotNull()).select(key, content, F.explode(F.sequence(F.lit(0), n - 1)).alias("chunk")).select(key, "chunk", F.substring(F.col(content), F.col("chunk") * size + 1, F.lit(size)).alias("piece"))
    return pieces.repartition(key, "chunk").select(key, "chunk", rans_pack("piece").alias("packed"))


def joined(chunks: DataFrame, key: str) -> DataFrame:
    """(key, content): the blobs of their chunks."""
    parts = chunks.select(key, "chunk", F.hex(rans_unpack("packed")).alias("h")).groupBy(key).agg(F.array_sort(F.collect_list(F.struct("chunk", "h"))).alias("p"))
    return parts.select(key, F.unhex(F.array_join(F.transform("p", lambda p: p["h"]), "")).alias("content"))


def crc32(content: Column) -> Column:
    return F.crc32(content)
