"""Token counts of whole texts, huge ones by overlap resynchronisation.

Texts of up to ``CHUNK`` characters are encoded as they are. A longer one becomes
chunks that overlap, each a row of its own, encoded anywhere in the cluster. The
pattern that cuts text before the merges works from left to right and looks ahead
by one character only, so

* a piece that a chunk's encoding finds is a piece of the whole text's, if the
  chunk began at a piece's start and the piece ends ``MARGIN`` characters or more
  before the chunk does (a special string cut by the chunk's end is shorter);
* from a position where both encodings begin a piece, both find the same pieces.

So two chunks splice at any such common boundary in their overlap, and the count
is that of the left chunk before it plus that of the right chunk behind it. By
induction from the first chunk this is the whole text's encoding. Where an overlap
holds no common boundary (say within one word of thousands of characters), that
text is done again with an overlap ``WIDEN`` times as wide; when the overlap
reaches the text's length, it is encoded in one piece. Copies of a huge text are
encoded once.

Counts are those of the named tokenizer without begin, end or other added tokens;
a special string within a text is one token, as is the library's default. Null
counts as empty: 0 bytes, 0 tokens. Rows repeat as they come; other columns are
ignored.
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column, partitions, written

#: Characters of a chunk, and of the overlap of two.
CHUNK, OVERLAP, WIDEN = 32_768, 256, 8
SPECIAL = {"<|endoftext|>": 50256}
MARGIN = max(map(len, SPECIAL)) + 2
LIMIT = 512
_loaded: dict[str, object] = {}


def encoder(path: str, special: dict[str, int] | None = None):
    """The encoding of a rank file (.tiktoken); one for each worker process."""
    import public_tokenizers
    import tiktoken

    if path not in _loaded:
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _loaded[path] = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=SPECIAL if special is None else special)
    return _loaded[path]


def default_path() -> str:
    """The rank file with the vocabulary of byte_bpe_50k.json."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def count(enc, text: str) -> int:
    return len(enc.encode_to_numpy(text, allowed_special="all"))


def pieces(text: str):
    """(start, end) of what the pattern and the special strings cut a text into."""
    import public_tokenizers
    import regex

    if "pattern" not in _loaded:
        _loaded["pattern"] = regex.compile(public_tokenizers.PATTERN)
    at = 0
    while at < len(text):
        cut = min(((k, len(s)) for s in SPECIAL if (k := text.find(s, at)) >= 0), default=(len(text), 0))
        part = text[at : cut[0]]
        for m in _loaded["pattern"].finditer(part):
            yield at + m.start(), at + m.end()
        if cut[1]:
            yield cut[0], cut[0] + cut[1]
        at = cut[0] + cut[1]


def marks(enc, text: str, overlap: int, first: bool, last: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]:
    """(starts and counts before them at the head, the same at the tail, total count) of a chunk.

    Heads are positions where a piece begins within the first overlap characters; tails are such positions within
    the last overlap characters which are proven to be boundaries of the whole text. A position is relative to the chunk."""
    bounds = [s for s, _ in pieces(text)]
    head = [s for s in bounds if s < overlap] if not first else []
    tail = [s for s in bounds if len(text) - overlap <= s <= len(text) - MARGIN] if not last else []
    total = count(enc, text)
    before = {}
    at = n = 0
    for s in head:
        n += count(enc, text[at:s])
        at, before[s] = s, n
    if tail:
        n, at = count(enc, text[: tail[0]]), tail[0]
        for s in tail:
            n += count(enc, text[at:s])
            at, before[s] = s, n
    as_ints = lambda x: np.array(x, np.int64)
    return as_ints(head), as_ints([before[s] for s in head]), as_ints(tail), as_ints([before[s] for s in tail]), total


def _short(path: str) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for b in batches:
            n = [count(enc, t) if t else 0 for t in column(b, "text").to_pylist()]
            yield pa.record_batch([column(b, "doc_id"), column(b, "n_bytes"), pa.array(n, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    return run


def _cut(chunk: int, overlap: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The chunks of each text, in one pass over it, a few at a time."""
        for b in batches:
            for key, text in zip(column(b, "key").to_pylist(), column(b, "text").to_pylist()):
                m = max(1, -(-(len(text) - overlap) // chunk))
                for s in range(0, m, 64):
                    some = range(s, min(m, s + 64))
                    yield pa.record_batch([pa.array([key] * len(some)), pa.array(some, pa.int32()), pa.array([m] * len(some), pa.int32()), pa.array([text[k * chunk : (k + 1) * chunk + overlap] for k in some])], ["key", "k", "m", "piece"])

    return run


def _chunks(path: str, overlap: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for b in batches:
            rows = [marks(enc, t, overlap, k == 0, k == m - 1) for t, k, m in zip(column(b, "piece").to_pylist(), column(b, "k").to_pylist(), column(b, "m").to_pylist())]
            cols = [pa.array([r[i].tobytes() for r in rows], pa.binary()) for i in range(4)]
            yield pa.record_batch([column(b, "key"), column(b, "k"), *cols, pa.array([r[4] for r in rows], pa.int64())], ["key", "k", "head", "head_n", "tail", "tail_n", "total"])

    return run


def _splice(step: int) -> Callable:
    def run(key: tuple, table: pa.Table) -> pa.Table:
        """The count of one text from its chunks; null if two don't align."""
        rows = sorted(table.to_pylist(), key=lambda r: r["k"])
        ints = lambda x: np.frombuffer(x, np.int64)
        n: int | None = rows[0]["total"]
        for left, right in zip(rows, rows[1:]):
            common, i, j = np.intersect1d(ints(left["tail"]) - step, ints(right["head"]), return_indices=True)
            if not len(common):
                n = None
                break
            # The left chunk counts up to the boundary, the right one from it on.
            n += int(ints(left["tail_n"])[i[0]]) - left["total"] + right["total"] - int(ints(right["head_n"])[j[0]])
        return pa.table({"key": pa.array([key[0].as_py()], pa.string()), "n_tokens": pa.array([n], pa.int64())})

    return run


def huge_counts(texts: DataFrame, path: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """(key, n_tokens) of distinct (key, text), by overlapping chunks."""
    done, rest = None, texts
    while True:
        # A chunk's row holds its own characters only; rows move by chunk, so a huge text spreads over tasks.
        rows = rest.select("key", "text").mapInArrow(_cut(chunk, overlap), "key string, k int, m int, piece string")
        spread = rows.repartition(partitions(texts.sparkSession), "key", "k")
        made = spread.mapInArrow(_chunks(path, overlap), "key string, k int, head binary, head_n binary, tail binary, tail_n binary, total long")
        found = written(made.groupBy("key").applyInArrow(_splice(chunk), "key string, n_tokens long"), "counts")
        good = found.where("n_tokens is not null")
        done = good if done is None else done.unionByName(good)
        if not found.where("n_tokens is null").limit(1).count():
            return done
        rest = texts.join(found.where("n_tokens is null").select("key"), "key", "left_semi")
        overlap *= WIDEN
        chunk = max(chunk, 2 * overlap)


def counts(docs: DataFrame, path: str | None = None, limit: int = LIMIT, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """One row for each document: doc_id, n_bytes, n_tokens, over_limit."""
    path = path or default_path()
    texts = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    sized = texts.select("doc_id", "text", F.octet_length("text").cast("long").alias("n_bytes"))
    is_huge = F.length("text") > chunk + overlap
    short = sized.where(~is_huge).mapInArrow(_short(path), "doc_id %s, n_bytes long, n_tokens long" % docs.schema["doc_id"].dataType.simpleString())
    huge = sized.where(is_huge).withColumn("key", F.sha2("text", 256))
    once = written(huge.select("key", "text").dropDuplicates(["key"]), "huge-texts")
    long = huge.select("doc_id", "n_bytes", "key").join(huge_counts(once, path, chunk, overlap), "key").select("doc_id", "n_bytes", "n_tokens")
    return short.unionByName(long).withColumn("over_limit", F.col("n_tokens") > limit)
