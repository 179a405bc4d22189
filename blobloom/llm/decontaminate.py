"""Benchmark decontamination with a document-partitioned positional inverted index.

``index`` holds, for every training document, the postings of the test
vocabulary: term and word position. ``search`` turns the postings of a batch of
documents into term lists, starts each test window from its rarest term there,
and intersects the offset-adjusted lists of its other terms, rarest first; what
remains are exact phrase matches. Only windows whose anchor (the term that the fewest
windows have) occurs in the batch are looked at, so the work follows the batch, not
the test set. ``proximity`` finds all terms of a query within a span of words instead.

Words are runs of digits, letters a-z (A-Z folded) and characters beyond ASCII;
they are compared by 64-bit hashes. A window is 13 consecutive words of an item;
an item of fewer words, but not none, is one window. The training side is never
shuffled. The test side is sent to all tasks in blocks of at most ``BLOCK_BYTES`` of
item text, so the size of a broadcast doesn't depend on the benchmark's. One block is
searched as the index is made. For several, the positional index of all terms is
written once (texts are tokenised once), each block reads it, and the spans found are
joined back by row.

Null or empty texts have no words: such a document has n_words 0 and no hits, such
an item no window. Items with equal ids count once; a null id is written as an
empty string. Repeated documents each get a row. Without items nothing is
contaminated. Other columns pass through ``scan`` unchanged, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textvec as tv
from .common import added, column, lean, list_positions, slices, text_of, whole, written

WINDOW = 13
#: UTF-8 bytes of item text that one pass searches for.
BLOCK_BYTES = 8 << 20
_POSTINGS = "n_words long, terms binary, at binary"


class Windows:
    """The distinct windows of items, over a vocabulary of term hashes."""

    def __init__(self, items: list[tuple[object, str | None]], width: int = WINDOW):
        ids = ["" if i is None else str(i) for i, _ in items]
        h, first = tv.words(*tv.buffers(pa.array([t for _, t in items], pa.string())), tv.ALNUM_WORDS)
        self.vocabulary = np.unique(h)
        term = np.searchsorted(self.vocabulary, h).astype(np.int32)
        found: dict[bytes, int] = {}
        owners: list[set[str]] = []
        for i, s, e in zip(ids, first[:-1].tolist(), first[1:].tolist()):
            for k in range(s, max(s + 1, e - width + 1)) if e > s else ():
                w = found.setdefault(term[k : min(k + width, e)].tobytes(), len(owners))
                if w == len(owners):
                    owners.append(set())
                owners[w].add(i)
        self.lengths = np.array([len(w) // 4 for w in found], np.int64)
        self.terms = np.full((len(found), max(1, int(self.lengths.max(initial=0)))), -1, np.int32)
        for k, w in enumerate(found):
            self.terms[k, : len(w) // 4] = np.frombuffer(w, np.int32)
        # Windows by anchor: that of their terms which the fewest windows have.
        use = np.bincount(self.terms[self.terms >= 0], minlength=len(self.vocabulary))
        cost = np.where(self.terms >= 0, use[self.terms], np.iinfo(np.int64).max)
        anchor = self.terms[np.arange(len(found)), cost.argmin(1)] if found else np.zeros(0, np.int32)
        self.by_anchor = np.argsort(anchor, kind="stable")
        self.anchor_first = np.searchsorted(anchor[self.by_anchor], np.arange(len(self.vocabulary) + 1))
        self.items = sorted({i for o in owners for i in o})
        at = {i: k for k, i in enumerate(self.items)}
        self.owner_first = np.cumsum([0, *(len(o) for o in owners)])
        self.owners = np.array([at[i] for o in owners for i in sorted(o)], np.int64)


def _index(vocabulary: np.ndarray | None) -> Callable:
    """Postings of the vocabulary; without one of all terms, as hashes."""
    seen = tv.lookup_filter(vocabulary) if vocabulary is not None else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            data, offs = tv.buffers(text_of(b))
            counts, terms, places = [], [], []
            for i, j in tv.pieces(offs, 1_000_000):
                h, first = tv.words(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i], tv.ALNUM_WORDS)
                if vocabulary is None:
                    own, found = first, h
                else:
                    t = tv.lookup(vocabulary, h, seen)
                    at = np.flatnonzero(t >= 0)
                    own, found = np.searchsorted(at, first), t[at]
                    places.append((at - np.repeat(first[:-1], np.diff(own))).astype(np.int32))
                counts.append(np.stack([np.diff(first), np.diff(own)]))
                terms.append(found)
            n, k = np.concatenate(counts, 1)
            ends = np.cumsum(k)
            at = slices(np.concatenate(places), ends) if places else pa.nulls(b.num_rows, pa.binary())
            yield pa.record_batch([*b.columns, pa.array(n), slices(np.concatenate(terms), ends), at], [*b.schema.names, "n_words", "terms", "at"])

    return run


def matches(w: Windows, tid: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(window, start): every exact occurrence of a window in the words tid; first: where each text begins, and the end."""
    none = np.zeros(0, np.int64)
    at = np.flatnonzero(tid >= 0)
    if not len(at) or not len(w.lengths):
        return none, none
    order = at[np.argsort(tid[at], kind="stable")]
    df = np.bincount(tid[at], minlength=len(w.vocabulary))
    begin = np.cumsum(df) - df
    here = np.flatnonzero(df)
    live = w.by_anchor[list_positions(w.anchor_first[here], w.anchor_first[here + 1] - w.anchor_first[here])]
    live = live[(np.where(w.terms[live] >= 0, df[w.terms[live]], 1) > 0).all(1)]
    if not len(live):
        return none, none
    cost = np.where(w.terms[live] >= 0, df[w.terms[live]], np.iinfo(np.int64).max)
    rank = np.argsort(cost, axis=1, kind="stable")
    n = cost[np.arange(len(cost)), rank[:, 0]]
    win = np.repeat(np.arange(len(live)), n)
    start = order[list_positions(begin[w.terms[live, rank[:, 0]]], n)]
    text = np.searchsorted(first, start, "right") - 1
    start = start - rank[win, 0]
    ok = (start >= first[text]) & (start + w.lengths[live[win]] <= first[text + 1])
    win, start = win[ok], start[ok]
    for k in range(1, w.terms.shape[1]):
        more = w.lengths[live[win]] > k
        o = rank[win, k]
        ok = ~more | (tid[np.where(more, start + o, start)] == w.terms[live[win], o])
        win, start = win[ok], start[ok]
    return live[win], start


def _dense(b: pa.RecordBatch, w: Windows, seen: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The terms at all word positions of a batch, and where each text begins."""
    n = column(b, "n_words").to_numpy(zero_copy_only=False).astype(np.int64)
    first = np.concatenate([[0], np.cumsum(n)])
    terms, offs = tv.buffers(column(b, "terms"))
    if column(b, "at").null_count:
        return tv.lookup(w.vocabulary, terms.view(np.uint64), seen), first
    places, _ = tv.buffers(column(b, "at"))
    tid = np.full(int(first[-1]), -1, np.int32)
    tid[np.repeat(first[:-1], np.diff(offs) // 4) + places.view(np.int32)] = terms.view(np.int32)
    return tid, first


def _found(w: Windows, b: pa.RecordBatch, seen: np.ndarray | None = None) -> Iterator[tuple[int, bytes, list[str]]]:
    """(row, spans, items) of the rows of a batch in which windows occur."""
    tid, first = _dense(b, w, seen)
    win, start = matches(w, tid, first)
    text = np.searchsorted(first, start, "right") - 1
    o = np.argsort(text, kind="stable")
    win, start, text = win[o], start[o], text[o]
    for s, e in zip(*(np.searchsorted(text, np.unique(text), side).tolist() for side in ("left", "right"))):
        i = int(text[s])
        span = np.stack([start[s:e] - first[i], start[s:e] - first[i] + w.lengths[win[s:e]]], 1).astype(np.int32)
        own = np.unique(w.owners[list_positions(w.owner_first[win[s:e]], np.diff(w.owner_first)[win[s:e]])])
        yield i, span.tobytes(), [w.items[k] for k in own]


def _search(w: Windows) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            hits: list[bytes | None] = [None] * b.num_rows
            items: list[list[str] | None] = [None] * b.num_rows
            for i, spans, own in _found(w, b):
                hits[i], items[i] = spans, own
            keep = [c for c in b.schema.names if c not in ("terms", "at")]
            yield pa.record_batch([*(column(b, c) for c in keep), pa.array(hits, pa.binary()), pa.array(items, pa.list_(pa.string()))], [*keep, "hits", "items"])

    return run


def _search_stored(w: Windows) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = tv.lookup_filter(w.vocabulary)
        for b in batches:
            if b.num_rows and (found := list(_found(w, b, seen))):
                i, hits, items = zip(*found)
                yield pa.record_batch([column(b, "row").take(pa.array(i)), pa.array(hits, pa.binary()), pa.array(items, pa.list_(pa.string()))], ["row", "hits", "items"])

    return run


def covered(spans: bytes | None) -> int:
    """Words within at least one of the spans (int32 pairs)."""
    if not spans:
        return 0
    x = np.frombuffer(spans, np.int32).reshape(-1, 2)
    x = x[np.argsort(x[:, 0], kind="stable")]
    top = np.maximum.accumulate(x[:, 1])
    return int(np.maximum(0, top - np.maximum(x[:, 0], np.concatenate([[0], top[:-1]]))).sum())


def _finish(width: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            spans = column(b, "hits").to_pylist()
            hit = [covered(x) for x in spans]
            full = [bool(x) and bool((np.diff(np.frombuffer(x, np.int32).reshape(-1, 2)) >= width).any()) for x in spans]
            items = [sorted(x or ()) for x in column(b, "items").to_pylist()]
            yield pa.record_batch([column(b, "doc"), column(b, "n_words"), pa.array(hit, pa.int64()), pa.array(full, pa.bool_()), pa.array([len(x) for x in items], pa.int64()), pa.array([hashlib.sha256(",".join(x).encode()).hexdigest() for x in items], pa.string())], ["doc", "n_words", "n_hit", "full", "n_items", "sha"])

    return run


def blocks(items: DataFrame, limit: int = BLOCK_BYTES) -> tuple[int, Callable[[int], list[tuple[object, str | None]]]]:
    """(number of blocks of about limit bytes, the items of each)."""
    rows = items.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = -(-total // limit) or 1
    return n, lambda k: [(r[0], r[1]) for r in (rows if n == 1 else rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k)).collect()]


def index(docs: DataFrame, vocabulary: np.ndarray | None = None) -> DataFrame:
    """doc (the whole row), n_words, terms and at: postings of the vocabulary; without one, hashes of all words in order."""
    return whole(docs).mapInArrow(lean(_index(vocabulary)), added(docs, _POSTINGS))


def search(postings: DataFrame, w: Windows) -> DataFrame:
    """The postings' rows with the spans (hits) and items of the windows that occur."""
    kept = [f for f in postings.schema.fields if f.name not in ("terms", "at")]
    return postings.mapInArrow(lean(_search(w)), T.StructType(kept + T.StructType.fromDDL("hits binary, items array<string>").fields))


def scan(docs: DataFrame, items: DataFrame, width: int = WINDOW, limit: int = BLOCK_BYTES) -> DataFrame:
    """doc (the whole row), n_words, n_hit, full (whether a window of width words occurs, not only items that are shorter), n_items
    and sha (of the sorted items)."""
    n, block = blocks(items, limit)
    finish = _finish(width)
    kinds = added(docs, "n_words long, n_hit long, full boolean, n_items long, sha string")
    if n == 1:
        w = Windows(block(0), width)
        # index(), search() and what follows, in one pass of one worker.
        made, looked_up = _index(w.vocabulary), _search(w)
        return whole(docs).mapInArrow(lean(lambda batches: finish(looked_up(made(batches)))), kinds)
    stored = written(index(docs).withColumn("row", F.monotonically_increasing_id()), "positions")
    found = None
    for k in range(n):
        some = written(stored.select("row", "n_words", "terms", "at").mapInArrow(lean(_search_stored(Windows(block(k), width))), "row long, hits binary, items array<string>"), "hits")
        found = some if found is None else found.unionByName(some)
    # Spans and items of a row from all blocks; hits are joined in any order, they are intervals.
    each = found.groupBy("row").agg(F.unhex(F.array_join(F.collect_list(F.hex("hits")), "")).alias("hits"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"))
    out = stored.select("row", "doc", "n_words").join(each, "row", "left").select("doc", "n_words", "hits", "items")
    return out.mapInArrow(lean(finish), kinds)


def contaminated(docs: DataFrame, items: DataFrame, width: int = WINDOW) -> DataFrame:
    """One row for each document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    found = scan(docs.select("doc_id", F.col("text").cast("string").alias("text")), items, width)
    hit = (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))
    return found.select("doc.doc_id", "n_words", "n_hit", "n_items", F.col("sha").alias("items_sha256"), hit.alias("contaminated"))


def proximity(docs: DataFrame, query: str, span: int) -> DataFrame:
    """(doc_id, start, end): for each occurrence of the query's rarest term the least run of at most span words around it
    which holds all its terms, if there is one; end is exclusive."""
    w = Windows([(0, query)], 1 << 30)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            tid, first = _dense(b, w)
            lists = sorted((np.flatnonzero(tid == t) for t in range(len(w.vocabulary))), key=len)
            out: list[tuple[int, int, int]] = []
            for p in lists[0].tolist() if lists else ():
                i = int(np.searchsorted(first, p, "right")) - 1
                lo, hi = max(int(first[i]), p - span + 1), min(int(first[i + 1]), p + span)
                near = [x[np.searchsorted(x, lo) : np.searchsorted(x, hi)] for x in lists[1:]]
                if all(len(x) for x in near):
                    best = None
                    for s in sorted({p, *(int(q) for x in near for q in x if q <= p)}, reverse=True):
                        after = [x[np.searchsorted(x, s) :] for x in near]
                        if all(len(x) for x in after):
                            e = max([p, *(int(x[0]) for x in after)]) + 1
                            if e - s <= span and (best is None or e - s < best[1] - best[0]):
                                best = (s, e)
                    if best:
                        out.append((i, best[0] - int(first[i]), best[1] - int(first[i])))
            ids = column(b, "doc")
            ids = ids.field(ids.type.get_field_index("doc_id"))
            yield pa.record_batch([ids.take(pa.array([x[0] for x in out], pa.int64())), pa.array([x[1] for x in out], pa.int64()), pa.array([x[2] for x in out], pa.int64())], ["doc_id", "start", "end"])

    return index(docs.select("doc_id", "text"), w.vocabulary).mapInArrow(run, T.StructType([docs.schema["doc_id"], *T.StructType.fromDDL("start long, end long").fields]))
