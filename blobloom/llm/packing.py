"""Token-id output: best-fit-decreasing packing into fixed-length rows.

Each task encodes its documents, cuts those longer than the capacity into segments
(whole rows, and one remainder), and packs the segments of up to ``SHARD_TOKENS``
tokens at a time: longest first, each into the row with the least room that still
holds it. A segment tree over capacities finds that row in log2(capacity) steps.
Nothing is shuffled, so no key can be hot; a shard holds thousands of rows, so the
rows stay full.

A packed row has
* ``input_ids``: capacity ids, little-endian unsigned integers of ``id_bytes``
  bytes (2, or 4 for vocabularies beyond 65,536), padded at the end with ``pad_id``;
* ``cu_seqlens``: cumulative segment lengths, from 0 to n_tokens;
* ``position_ids``: capacity positions (uint32), counting from 0 in each segment;
* ``doc_ids`` and ``starts``: for each segment its document, and its offset in the
  document's ids. ``unpack`` restores every document from them.

``write_bins`` writes the matrices as raw binary files. Null and empty texts have
no tokens and are in no row. Rows with equal or null ids are segments of their own,
in the order of their texts. Special strings in texts are ordinary text. Other
columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textvec as tv
from . import tokens
from .common import column, lean, slices

CAPACITY = 2048
SHARD_TOKENS = 4_000_000
SCHEMA = "pack_id long, n_segments int, n_tokens int, doc_ids array<long>, starts array<int>, cu_seqlens array<int>, id_bytes int, input_ids binary, position_ids binary"


class Rooms:
    """Rows by the room left in them; a segment tree over rooms 0 to capacity says which rooms exist."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.tree = bytearray(2 * self.size)
        self.rows: list[list[int]] = [[] for _ in range(capacity + 1)]

    def put(self, row: int, room: int) -> None:
        self.rows[room].append(row)
        i = room + self.size
        while i and not self.tree[i]:
            self.tree[i] = 1
            i >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """(row, room) of the least room that is need or more; the row is taken out."""
        tree, i = self.tree, need + self.size
        if not tree[i]:
            # Up to the first subtree to the right that holds a room, then down its left edge.
            while i > 1 and (i & 1 or not tree[i + 1]):
                i >>= 1
            if i <= 1:
                return None
            i += 1
            while i < self.size:
                i = 2 * i if tree[2 * i] else 2 * i + 1
        room = i - self.size
        row = self.rows[room].pop()
        if not self.rows[room]:
            while i and not (i < self.size and (tree[2 * i] or tree[2 * i + 1])):
                tree[i] = 0
                i >>= 1
        return row, room


def pack(lengths: np.ndarray, capacity: int) -> list[list[int]]:
    """The segments of each row, by best fit decreasing; ties go by index."""
    rooms, rows = Rooms(capacity), []
    for k in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[k])
        got = rooms.take(n)
        if got is None:
            rows.append([k])
            if n < capacity:
                rooms.put(len(rows) - 1, capacity - n)
        else:
            rows[got[0]].append(k)
            if got[1] > n:
                rooms.put(got[0], got[1] - n)
    return rows


def _pack(path: str, capacity: int, pad_id: int, id_bytes: int) -> Callable:
    kind = np.dtype("<u2" if id_bytes == 2 else "<u4")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc = tokens.encoder(path)
        made = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 40
        docs: list[tuple[object, np.ndarray]] = []
        held = 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal made, held
            each = np.array([len(x) for _, x in docs], np.int64)
            flat = np.concatenate([x for _, x in docs]) if docs else np.zeros(0, kind)
            base = np.cumsum(each) - each
            parts = -(-each // capacity)
            doc = np.repeat(np.arange(len(docs)), parts)
            start = (np.arange(len(doc)) - np.repeat(np.cumsum(parts) - parts, parts)) * capacity
            length = np.minimum(capacity, each[doc] - start)
            rows = pack(length, capacity)
            ids = [d for d, _ in docs]
            for s in range(0, len(rows), 2048):
                some = rows[s : s + 2048]
                grid = np.full((len(some), capacity), pad_id, kind)
                place = np.zeros((len(some), capacity), "<u4")
                cuts = []
                for r, segments in enumerate(some):
                    at, cut = 0, [0]
                    for k in segments:
                        n, b = int(length[k]), int(base[doc[k]] + start[k])
                        grid[r, at : at + n] = flat[b : b + n]
                        place[r, at : at + n] = steps[:n]
                        at += n
                        cut.append(at)
                    place[r, at:] = steps[: capacity - at]
                    cuts.append(cut)
                ends = np.arange(1, len(some) + 1) * capacity
                yield pa.record_batch(
                    [
                        pa.array(np.arange(made, made + len(some))), pa.array([len(x) for x in some], pa.int32()), pa.array([c[-1] for c in cuts], pa.int32()),
                        pa.array([[ids[doc[k]] for k in x] for x in some], pa.list_(pa.int64())), pa.array([[int(start[k]) for k in x] for x in some], pa.list_(pa.int32())),
                        pa.array(cuts, pa.list_(pa.int32())), pa.array([id_bytes] * len(some), pa.int32()), slices(grid.ravel(), ends), slices(place.ravel(), ends),
                    ],
                    ["pack_id", "n_segments", "n_tokens", "doc_ids", "starts", "cu_seqlens", "id_bytes", "input_ids", "position_ids"],
                )
                made += len(some)
            docs.clear()
            held = 0

        steps = np.arange(capacity, dtype="<u4")
        for b in batches:
            for d, t in zip(column(b, "doc_id").to_pylist(), column(b, "text").to_pylist()):
                if t:
                    x = enc.encode_to_numpy(t, disallowed_special=()).astype(kind)
                    docs.append((d, x))
                    held += len(x)
                    if held > SHARD_TOKENS:
                        yield from flush()
        if docs:
            yield from flush()
        # The worker goes on to other tasks; loading the ranks again takes less than keeping them.
        tokens._loaded.clear()

    return run


def packed(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, pad_id: int = 50256, vocabulary: int = 50257) -> DataFrame:
    """The packed rows of the documents' ids."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(lean(_pack(path or tokens.default_path(), capacity, pad_id, 2 if vocabulary <= 1 << 16 else 4)), SCHEMA)


def unpack(row) -> Iterator[tuple[object, int, np.ndarray]]:
    """(doc_id, start, ids) of each segment of a packed row."""
    ids = np.frombuffer(row["input_ids"], "<u2" if row["id_bytes"] == 2 else "<u4")
    for d, s, a, b in zip(row["doc_ids"], row["starts"], row["cu_seqlens"], row["cu_seqlens"][1:]):
        yield d, s, ids[a:b]


def write_bins(rows: DataFrame, folder: str) -> DataFrame:
    """Write each partition's matrices to folder (any file system that Arrow knows): ids-N.bin, positions-N.bin and
    the segment table segments-N.parquet. Returns (file, n_rows). A task that runs again replaces its own files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.fs as fs
        import pyarrow.parquet as pq
        from pyspark import TaskContext

        where, root = fs.FileSystem.from_uri(folder)
        where.create_dir(root, recursive=True)
        name, n, segments = f"{TaskContext.get().partitionId():06d}", 0, None
        with where.open_output_stream(f"{root}/ids-{name}.bin") as ids, where.open_output_stream(f"{root}/positions-{name}.bin") as places:
            for b in batches:
                table = pa.Table.from_batches([b]).drop_columns(["input_ids", "position_ids"])
                segments = segments or pq.ParquetWriter(f"{root}/segments-{name}.parquet", table.schema, filesystem=where)
                segments.write_table(table)
                ids.write(tv.buffers(column(b, "input_ids"))[0].tobytes())
                places.write(tv.buffers(column(b, "position_ids"))[0].tobytes())
                n += b.num_rows
        if segments:
            segments.close()
        yield pa.record_batch([pa.array([f"{root}/ids-{name}.bin"]), pa.array([n], pa.int64())], ["file", "n_rows"])

    return rows.mapInArrow(run, "file string, n_rows long")

