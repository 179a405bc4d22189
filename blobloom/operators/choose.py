"""Method choice: which codecs a blob's type calls for, and the smallest of what they give."""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import codecs, profile
from .vocabulary import trie_of

NAMES = {codecs.STORE: "store", codecs.DEFLATE: "deflate", codecs.RANS_TOKENS: "rans-tokens", codecs.DEFLATE_TOKENS: "deflate-tokens"}
#: Vocabularies by language; others use "text".
OWN_VOCABULARY = {"Go": "go", "Python": "python", "JavaScript": "javascript"}


def vocabulary_name(language: Column, have: Iterable[str] = tuple(OWN_VOCABULARY.values())) -> Column:
    """The vocabulary that blobs of a language are encoded with, of those that there are."""
    out = F.lit("text")
    for name, v in OWN_VOCABULARY.items():
        if v in have:
            out = F.when(language == name, v).otherwise(out)
    return out


def candidates(n: Column, kind: Column, archive: bool = False) -> Column:
    """The methods to try, in the order in which ties are settled. Store is always one (a blob never grows)."""
    store, plain = F.lit(codecs.STORE), F.lit(codecs.DEFLATE)
    coded = [plain, F.lit(codecs.DEFLATE_TOKENS)] if archive else [plain, F.lit(codecs.RANS_TOKENS), F.lit(codecs.DEFLATE_TOKENS)]
    return F.when((n == 0) | (kind == "random"), F.array(store)).when(kind == "text", F.array(plain, F.lit(codecs.DEFLATE_TOKENS), store)).when(kind == "code", F.array(*coded, store)).otherwise(F.array(plain, store))


def encode(data: bytes, method: int, tokens: tuple[bytes, ...]) -> bytes:
    if method == codecs.STORE:
        return data
    if method == codecs.DEFLATE:
        return codecs.deflate(data)
    packed = codecs.varints(trie_of(tokens).encode(data))
    if method == codecs.RANS_TOKENS:
        return codecs.rans_encode([packed])[0]
    if method == codecs.DEFLATE_TOKENS:
        return codecs.deflate(packed)
    raise ValueError(f"unsupported method {method}")


def decode(data: bytes, method: int, tokens: tuple[bytes, ...]) -> bytes:
    if method == codecs.STORE:
        return data
    if method == codecs.DEFLATE:
        return codecs.inflate(data)
    if method not in (codecs.RANS_TOKENS, codecs.DEFLATE_TOKENS):
        raise ValueError(f"unsupported method {method}")
    packed = codecs.rans_decode([data])[0] if method == codecs.RANS_TOKENS else codecs.inflate(data)
    return b"".join(tokens[i] for i in codecs.read_varints(packed) if i < len(tokens))


def compress(df: DataFrame, content: str, keep: list[str], vocabularies: dict[str, tuple[bytes, ...]], method: int | None = None, archive: bool = False) -> DataFrame:
    """keep, with type, vocabulary, method, size, packed, packed_size and crc of each blob.

    method forces one (with the text vocabulary). A blob is encoded by its own candidates only. Vocabularies must cover
    every byte; vocabulary names the one that is used. Null content counts as empty."""
    for name, tokens in vocabularies.items():
        if {bytes([b]) for b in range(256)} - set(tokens):
            raise ValueError(f"vocabulary {name} doesn't cover every byte")
    blob = F.coalesce(F.col(content), F.lit(b""))
    typed = profile.profile(df.select(*keep, blob.alias("__blob")), F.col("__blob"), [*keep, "__blob"])
    known = F.when(F.lit(method is None), vocabulary_name(F.col("language"), vocabularies)).otherwise(F.lit("text"))
    tried = F.array(F.lit(method)) if method is not None else candidates(F.octet_length("__blob"), F.col("type"), archive)
    rows = typed.select(*keep, "__blob", "type", known.alias("vocabulary"), tried.alias("tried"))
    kept = rows.schema.fields[: len(keep)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            # Equal blobs of a batch are encoded once.
            seen: dict[tuple, tuple] = {}
            for data, v, methods in zip(*(b.column(b.schema.get_field_index(c)).to_pylist() for c in ("__blob", "vocabulary", "tried"))):
                data = bytes(data)
                known = data, v, tuple(methods)
                if known not in seen:
                    tokens = vocabularies.get(v) or vocabularies["text"]
                    best = min(((encode(data, m, tokens), m) for m in methods), key=lambda x: len(x[0]))
                    seen[known] = best[1], len(data), best[0], len(best[0]), zlib.crc32(data)
                out.append(seen[known])
            m, n, packed, k, crc = zip(*out) if out else ((),) * 5
            cols = [b.column(i) for i in range(len(keep))] + [b.column(b.schema.get_field_index("type")), b.column(b.schema.get_field_index("vocabulary"))]
            yield pa.record_batch([*cols, pa.array(m, pa.int16()), pa.array(n, pa.int64()), pa.array(packed, pa.binary()), pa.array(k, pa.int64()), pa.array(crc, pa.int64())], [*keep, "type", "vocabulary", "method", "size", "packed", "packed_size", "crc"])

    from pyspark.sql import types as T

    added = T.StructType.fromDDL("type string, vocabulary string, method smallint, size long, packed binary, packed_size long, crc long")
    return rows.mapInArrow(run, T.StructType(kept + added.fields))


def restore(df: DataFrame, keep: list[str], vocabularies: dict[str, tuple[bytes, ...]]) -> DataFrame:
    """keep, content and error (null if the checksum holds) of rows with packed, method, vocabulary and crc."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            content, error = [], []
            for data, m, v, crc in zip(*(b.column(b.schema.get_field_index(c)).to_pylist() for c in ("packed", "method", "vocabulary", "crc"))):
                try:
                    got = decode(bytes(data), m, vocabularies.get(v) or vocabularies["text"])
                    problem = None if zlib.crc32(got) == crc else "checksum differs"
                except (ValueError, IndexError) as e:
                    got, problem = None, str(e)
                content.append(got)
                error.append(problem)
            yield pa.record_batch([*(b.column(b.schema.get_field_index(k)) for k in keep), pa.array(content, pa.binary()), pa.array(error, pa.string())], [*keep, "content", "error"])

    from pyspark.sql import types as T

    return df.mapInArrow(run, T.StructType([df.schema[k] for k in keep] + T.StructType.fromDDL("content binary, error string").fields))


class Compressor:
    """Vocabularies together with what they are for; without any, single bytes are the text vocabulary."""

    def __init__(self, vocabularies: dict[str, tuple[bytes, ...]] | None = None):
        self.vocabularies = {"text": tuple(bytes([i]) for i in range(256))} | (vocabularies or {})

    def compress(self, df: DataFrame, content: str, keep: list[str], method: int | None = None) -> DataFrame:
        return compress(df, content, keep, self.vocabularies, method)

    def decompress(self, df: DataFrame, keep: list[str]) -> DataFrame:
        return restore(df, keep, self.vocabularies)
