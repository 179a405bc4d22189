"""N-gram Jaccard join: exact, size-aware, heavy-light.

A document's set holds the hashes of its distinct 2-word shingles. Two sets link
when ``100 * |A & B| >= 60 * |A | B|``. The join is exact up to 64-bit shingle
hashes and 128-bit set digests.

* Equal sets collapse into one class, named by a digest of the set. A posting
  names the class (by 64 bits of it), not the document, and a task sends each class once, so copies
  are pre-aggregated before any shuffle and never meet as pairs.
* Shingles are put in one global order, rarest first: by their expected frequency
  (the product of their words' frequencies), or by their known count if that is
  larger. The counts come from all documents: each task sends the words and
  shingles that repeat in it, and the most frequent ``ORDER_SIZE`` of either are
  broadcast (so the size is bounded). The order decides only speed: whatever it
  is, the result is exact.
* Linked sets of sizes n and m share o >= ceil(0.6 max(n, m)) elements, so they
  share at least l of their first n - o + l and m - o + l in that order (prefix
  principle). If one of the shared ones is light (expected in less than ``LIGHT``
  documents), its inverted list has both sets, and light lists are short; so has
  that of a tied one (part of a passage or of copies), and those come last in the
  order. Else the sets share l heavy elements; each set puts its heavy ones into G groups by hash
  and enumerates the 2-subsets of each group. k shared heavy elements fall into
  at most G groups, so they give at least k - G shared 2-subsets. With l = G + r
  the sets share r keys or more in all; pairs that share fewer are dropped before
  they are verified (r is ``evidence``).
* Small sets take G = 1: they enumerate all 2-subsets of a short prefix. Larger
  ones take G in proportion to their size, a power of two, so that the groups of
  two sets nest, and l follows from the largest G of any set they may link with; so they
  mostly scan the lists of their light elements. The boundary between small and
  large minimises the number of keys, from the histogram of sizes over all
  documents.
* A key which that table shows to be hot is split: its sets are hashed into R
  fragments and every pair of fragments is a task of its own, so no task holds
  more than about 2 ``FRAGMENT`` sets of one key. A list that turns out to be longer
  than ``LONG`` all the same (of a key too rare in every task to be counted) isn't
  paired where it is found; its fragments are sent on, pair by pair, in a shuffle of
  their own.
* The number of buckets follows the number of shingles, ``PER_BUCKET`` each, so a
  task's share stays the same as the input grows. The pairs of a bucket do grow; they are made
  and sent ``PAIRS`` at a time. Tasks that verify follow the number of pairs, ``PER_TASK`` each.
* Postings are made, shuffled and paired in ``ROUNDS`` of buckets one after another where
  the input has many (a set's postings take more room, the more buckets they go to), so
  that only one round's are on disk at a time. Only sets of candidate pairs move to be
  verified; texts don't.
* Keys are made for ``TOGETHER`` shingles' sets at a time, and a bucket's postings are sent as
  packed bytes, in the order of the classes.
* Pairs that share one of their sets' least keys are named by that key's bucket
  alone, so near copies don't come from every bucket. Every candidate pair is
  verified once, in the task of one key that both sets hold; a set is sent once to a
  task, not once for each pair.
* A task returns, of the pairs it has verified, each class's number of linked
  documents and a star for each group of linked classes: rows in proportion to
  classes, not to pairs.
* Components come from min-label propagation with pointer jumping over written
  tables.

Null or empty text, or text without words: empty set, n_similar 0, its own
component. Repeated rows of one doc_id count as documents of their own in
n_similar and share their result. Null doc_id: such rows return their set size,
their links, and the component's smallest non-null id (null if there is none).
An empty table gives no rows. Other columns of the input are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textvec as tv
from .common import column, forget, lean, list_positions, partitions, release, slices, squeeze, u64, unsqueeze, written

U64 = np.uint64
#: Entries of the broadcast order table at most (12 bytes each).
ORDER_SIZE = 1 << 20
#: Sets of one fragment of a hot key, and of one list in a task at most.
FRAGMENT = 2048
LONG = 3 * FRAGMENT
#: Shingles for each bucket of postings; some two thirds of them are posted.
PER_BUCKET = 1_500_000
#: Numbers of buckets above which postings are made in one round more.
ROUNDS = (64, 2048)
#: Bits for each set of the filter that tells which documents' sets are sent to be verified, and bits of the filter at most.
FILTER, MOST_BITS = 16, 1 << 26
#: Expected number of documents up to which a shingle is light.
LIGHT = 0.25
#: Sizes among which the boundary between small and large sets is chosen.
MAX_SMALL = 64
#: Keys of a set that go along with each of its postings.
HEADS = 2
#: Evidence of a pair that is named in one bucket only.
ENOUGH = 1 << 20
NO_HEAD = U64((2**32 - 1) << 32)
#: Shingles whose repeats a map task counts at a time, and postings that it gathers before it sends them.
SURVEY, FLUSH = 5_000_000, 2_000_000
#: Shingles of sets whose keys are made together.
TOGETHER = 100_000
#: Pairs that a reduce task makes and sends at a time (of one class more, if it has more), rows of a batch that it sends, and pairs
#: of one key that are verified in one task on average.
PAIRS, SENT, VERIFY = 1_000_000, 100_000, 400_000
#: Found pairs for each task that verifies, so its share stays the same as the input grows.
PER_TASK = 250_000


def required(n: np.ndarray | int) -> np.ndarray | int:
    """The least overlap of a set of size n with any set that it links with."""
    return (6 * n + 9) // 10


def groups(n: int, small: int) -> int:
    """The number of groups into which a set of size n puts its heavy elements."""
    return 1 if n <= small or n < 20 else 1 << ((n // 10).bit_length() - 1)


def matches(n: int, small: int) -> int:
    """How many elements a set of size n shares within its prefix with any set it links with: evidence(n) more than either has groups."""
    return evidence(n) + groups(n * 10 // 6, small)


def evidence(n: np.ndarray | int) -> np.ndarray | int:
    """How many keys a set of size n shares at least with a set it links with, if that one isn't smaller."""
    return 1 + n // 16


class Table:
    """Counts by hash."""

    def __init__(self, key: np.ndarray, n: np.ndarray):
        o = np.argsort(key)
        self.key, self.n = key[o], n[o].astype(np.uint32 if n.max(initial=0) < 1 << 32 else np.int64)
        self.filter = tv.lookup_filter(self.key)

    def of(self, h: np.ndarray) -> np.ndarray:
        """The count of each hash; 0 if the table lacks it."""
        if not len(self.key):
            return np.zeros(len(h), np.int64)
        at = tv.lookup(self.key, h, self.filter)
        return np.where(at >= 0, self.n[at], 0).astype(np.int64)


def shingle_sets(data: np.ndarray, offs: np.ndarray, words: Table | None = None, seen: list[np.ndarray] | None = None) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """(sets, ranks): sorted distinct hashes of each text's 2-word shingles (of its whole word sequence if that is shorter);
    with word counts given, also what each shingle's words let expect of its frequency, as 4 log2. seen gets the words."""
    sets: list[np.ndarray] = []
    ranks: list[np.ndarray] = []
    for i, j in tv.pieces(offs, 400_000):
        h, first = tv.words(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i], tv.SPACE_WORDS)
        pair = tv.mix(h[:-1] * U64(0x9E3779B97F4A7C15) + (h[1:] ^ (h[1:] >> U64(29)))) if len(h) else h
        if seen is not None:
            seen.append(h)
        if words is not None:
            rare = np.log2(np.maximum(words.of(h), 4))
            rank = np.round(4 * (rare[:-1] + rare[1:])).astype(np.int32)
        for s, e in zip(first[:-1].tolist(), first[1:].tolist()):
            if e - s > 1:
                x = pair[s : e - 1]
                o = np.argsort(x)
                x = x[o]
                new = np.concatenate([[True], x[1:] != x[:-1]])
                sets.append(x[new])
                if words is not None:
                    ranks.append(rank[s : e - 1][o[new]])
            else:
                sets.append(tv.mix(h[s:e] + U64(1)))
                if words is not None:
                    ranks.append(np.zeros(e - s, np.int32))
    return sets, ranks


def short(d: bytes) -> int:
    """The first 8 bytes of a digest, as a signed number; it names a class while pairs are collected."""
    return int.from_bytes(d[:8], "little", signed=True) if d else 0


def digest(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else b""


NAMES = ["doc_id", "n_shingles", "digest", "id", "bucket", "keys", "counts"]

# -- pass 1: sizes, digests, words and shingles that repeat within a task


def _repeats(held: list[np.ndarray], parts: int, offset: int) -> pa.RecordBatch | None:
    """Counts of the hashes that occur more than once, by bucket."""
    x = np.concatenate(held)
    held.clear()
    x.sort()
    at = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]])) if len(x) else np.zeros(0, np.int64)
    n = np.diff(np.concatenate([at, [len(x)]]))
    key, n = x[at][n > 1], n[n > 1].astype(np.uint32)
    if not len(key):
        return None
    bucket = (key >> U64(40)) % U64(parts)
    order = np.argsort(bucket, kind="stable")
    key, n, bucket = key[order], n[order], bucket[order]
    ends = np.concatenate([np.flatnonzero(np.diff(bucket)) + 1, [len(key)]])
    m = len(ends)
    return pa.record_batch([pa.nulls(m, pa.int64()), pa.nulls(m, pa.int64()), pa.nulls(m, pa.binary()), pa.nulls(m, pa.int64()), pa.array(bucket[ends - 1].astype(np.int32) + offset), slices(key, ends), slices(n, ends)], NAMES)


def _survey(parts: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[list[np.ndarray], list[np.ndarray]] = ([], [])
        count = 0
        for b in batches:
            m = b.num_rows
            if not m:
                continue
            sets, _ = shingle_sets(*tv.buffers(column(b, "text")), seen=held[1])
            d = [digest(s) for s in sets]
            yield pa.record_batch([column(b, "doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array(d, pa.binary()), pa.array([short(x) for x in d], pa.int64()), pa.nulls(m, pa.int32()), pa.nulls(m, pa.binary()), pa.nulls(m, pa.binary())], NAMES)
            held[0].extend(sets)
            count += sum(map(len, sets))
            if count > SURVEY:
                yield from filter(None, (_repeats(x, parts, k * parts) for k, x in enumerate(held)))
                count = 0
        if held[0]:
            yield from filter(None, (_repeats(x, parts, k * parts) for k, x in enumerate(held)))

    return run


def _frequent(parts: int) -> Callable:
    def run(key: tuple, table: pa.Table) -> pa.Table:
        """Total counts of the hashes of one bucket; those of 8 or more only."""
        k = np.concatenate([u64(x) for x in table["keys"].to_pylist()])
        n = np.concatenate([np.frombuffer(x, np.uint32) for x in table["counts"].to_pylist()])
        uniq, inv = np.unique(k, return_inverse=True)
        total = np.bincount(inv, n, len(uniq)).astype(np.int64)
        keep = total >= 8
        return pa.table({"word": pa.array(np.full(int(keep.sum()), key[0].as_py() >= parts)), "key": uniq[keep].view(np.int64), "n": total[keep]})

    return run


def _top(frequent: DataFrame, word: bool) -> Table:
    got = frequent.where(F.col("word") == word).orderBy(F.desc("n"), "key").limit(ORDER_SIZE).select("key", "n").toArrow()
    return Table(got["key"].to_numpy().astype(np.int64).view(np.uint64), got["n"].to_numpy().astype(np.int64))


def boundary(sizes: list[tuple[int, int]]) -> int:
    """The size up to which sets are small, of the least number of keys if half of a set's elements are heavy."""

    def keys(n: int, small: int) -> float:
        p = min(n, n - required(n) + matches(n, small))
        heavy = max(0.0, p - n / 2)
        return p - heavy + heavy * heavy / 2 / groups(n, small)

    return min(range(MAX_SMALL + 1), key=lambda x: (sum(c * keys(int(n), x) for n, c in sizes if n > 1), x))


# -- pass 2: postings


def _place(parts: int) -> type:
    """The type of a bucket's number."""
    return np.uint16 if parts < 1 << 16 else np.uint32


def _planes(x: np.ndarray) -> list[np.ndarray]:
    """The bytes of numbers, the lowest of all first; they compress better apart."""
    return list(np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T))


def _postings(words: Table, shingles: Table, small: int, parts: int, turn: int = 0, turns: int = 1) -> Callable:
    """Postings of the buckets whose number is turn modulo turns."""
    total = 4 * np.log2(max(1.0, float(words.n.sum())))

    def keys(sets: list[np.ndarray], ranks: list[np.ndarray], digests: list[bytes]) -> list[np.ndarray]:
        """The keys under which each set is posted."""
        s, size = np.concatenate(sets), np.array([len(x) for x in sets])
        doc = np.repeat(np.arange(len(sets)), size)
        count = shingles.of(s)
        expected = (np.concatenate(ranks) - total) / 4
        known = np.log2(np.maximum(count, 1))
        # Far more frequent than its words explain: part of a passage or of copies. Such elements come together, so subsets of
        # them have lists as long as their own; they go last, and are posted by themselves.
        tied = (count > 0) & (known > np.maximum(expected, 0) + 3)
        value = np.where(tied, 1000 + known, np.where(count > 0, np.maximum(expected, known), expected))
        sizes, of = np.unique(size, return_inverse=True)
        prefix = np.array([min(n, n - int(required(n)) + matches(n, small)) for n in sizes.tolist()])[of]
        mask = np.array([groups(n, small) - 1 for n in sizes.tolist()], np.uint64)[of]
        p = np.lexsort(((4 * value).astype(np.int32), doc))[list_positions(np.cumsum(size) - size, prefix)]
        single = tied[p] | (value[p] <= np.log2(LIGHT))
        key, most, own = s[p[single]], count[p[single]], doc[p[single]]
        h, count, doc = s[p[~single]], count[p[~single]], doc[p[~single]]
        group = h & mask[doc]
        o = np.lexsort((h, group, doc))
        h, count, doc, group = h[o], count[o], doc[o], group[o]
        new = np.flatnonzero(np.concatenate([np.ones(min(1, len(h)), bool), (doc[1:] != doc[:-1]) | (group[1:] != group[:-1])]))
        run = np.diff(np.append(new, len(h)))
        at = np.arange(len(h))
        follow = np.repeat(new + run, run) - 1 - at
        i, j = np.repeat(at, follow), list_positions(at + 1, follow)
        key = np.concatenate([key, tv.mix(h[i] * U64(0xD6E8FEB86659FD93) + h[j])])
        most, own = np.concatenate([most, np.minimum(count[i], count[j])]), np.concatenate([own, doc[i]])
        hot = most > 2 * FRAGMENT
        out, owner = [key[~hot]], [own[~hot]]
        for k, c, d in zip(key[hot], most[hot].tolist(), own[hot].tolist()):
            # Every pair of fragments is a list of its own; this set is in those of its fragment.
            x = np.arange(c // FRAGMENT + 1, dtype=np.uint64)
            mine = U64(int.from_bytes(digests[d][:8], "little") % len(x))
            out.append(tv.mix(k + np.minimum(x, mine) * U64(0x9E3779B1) + np.maximum(x, mine) * U64(0x85EBCA77C2B2AE63)))
            owner.append(np.full(len(x), d))
        key, own = np.concatenate(out), np.concatenate(owner)
        return np.split(key[np.argsort(own, kind="stable")], np.cumsum(np.bincount(own, minlength=len(sets)))[:-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, tuple[int, np.ndarray]] = {}
        count = 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal count
            # In the order of the ids, so that steps between them are small.
            ids = np.array([short(d) for d in held], np.int64)
            by = np.argsort(ids)
            ids, size = ids[by], np.array([n for n, _ in held.values()], np.uint32)[by]
            each = list(held.values())
            each = [each[i][1] for i in by.tolist()]
            lens = np.array([len(x) for x in each])
            key = np.concatenate(each)
            held.clear()
            count = 0
            doc = np.repeat(np.arange(len(ids), dtype=np.uint32), lens)
            # A posted key is its bucket and 32 bits; the HEADS least ones of a set go along with it everywhere.
            bucket = (key % U64(parts)).astype(_place(parts))
            key = (key // U64(parts)).astype(np.uint32)
            o = np.lexsort((bucket, key, doc))
            least = list_positions(np.cumsum(lens) - lens, np.minimum(lens, HEADS))
            row, col = np.repeat(np.arange(len(ids)), np.minimum(lens, HEADS)), list_positions(np.zeros(len(ids), np.int64), np.minimum(lens, HEADS))
            head_key, head_bucket = np.full((len(ids), HEADS), 2**32 - 1, np.uint32), np.full((len(ids), HEADS), np.iinfo(_place(parts)).max, _place(parts))
            head_key[row, col], head_bucket[row, col] = key[o][least], bucket[o][least]
            if turns > 1:
                own = bucket % turns == turn
                key, doc, bucket = key[own], doc[own], bucket[own]
            if not len(key):
                return
            o = np.lexsort((doc, bucket))
            key, doc, bucket = key[o], doc[o], bucket[o]
            at = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (bucket[1:] != bucket[:-1])]))
            who = doc[at]
            ends = np.concatenate([np.flatnonzero(np.diff(bucket)) + 1, [len(key)]])
            heads = np.searchsorted(at, ends)
            here = np.diff(np.concatenate([at, [len(key)]]))
            data = []
            for (a, z), (c, e) in zip(zip([0, *heads[:-1].tolist()], heads.tolist()), zip([0, *ends[:-1].tolist()], ends.tolist())):
                some = who[a:z]
                data.append(squeeze(*(x for v in (np.diff(ids[some].view(np.uint64), prepend=U64(0)), size[some], here[a:z].astype(np.uint32), head_key[some].ravel(), head_bucket[some].ravel(), key[c:e]) for x in _planes(v))))
            yield pa.record_batch([pa.array(bucket[ends - 1].astype(np.int32)), pa.array(data, pa.binary())], ["bucket", "data"])

        for b in batches:
            if not b.num_rows:
                continue
            some: dict[bytes, tuple[np.ndarray, np.ndarray]] = {}
            n = 0
            sets, ranks = shingle_sets(*tv.buffers(column(b, "text")), words)
            for i, (s, rank) in enumerate(zip(sets, ranks), 1):
                # A single shingle links with equal sets only: with ceil(0.6 n) = 1 shared element, both sets are that element.
                if len(s) > 1 and (d := digest(s)) not in held and d not in some:
                    some[d] = s, rank
                    n += len(s)
                if some and (n > TOGETHER or i == len(sets)):
                    for d, k in zip(some, keys(*(list(x) for x in zip(*some.values())), list(some))):
                        held[d] = (len(some[d][0]), k)
                        count += len(k)
                    some, n = {}, 0
                    if count > FLUSH:
                        yield from flush()
                        release()
        if held:
            yield from flush()

    return run


Run = tuple[np.ndarray, np.ndarray, np.ndarray]


def _merged(a: Run, b: Run) -> Run:
    """Distinct pairs of two sorted runs (pair, count, key), counts added up."""
    pair, first, back = np.unique(np.concatenate([a[0], b[0]]), return_index=True, return_inverse=True)
    return pair, np.bincount(back, np.concatenate([a[1], b[1]]), len(pair)).astype(np.int64), np.concatenate([a[2], b[2]])[first]


def _gather(runs: list[Run], new: Run) -> None:
    """Add a run; runs of like sizes are merged, so every pair is sorted log times."""
    runs.append(new)
    while len(runs) > 1 and len(runs[-2][0]) < 2 * len(runs[-1][0]):
        b, a = runs.pop(), runs.pop()
        runs.append(_merged(a, b))


def _candidates(parts: int, most: int) -> Callable:
    def run(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Pairs of classes that share a key of this bucket: the first such key, how many, and how many they need in all. Of
        lists of more than ``most`` classes, the fragments instead. All pairs of a class with later ones are made together,
        of so many classes at a time that they are about PAIRS: a bucket's pairs grow with the input, what is held doesn't."""
        kinds = [np.uint64, np.uint32, np.uint32, np.uint32, _place(parts), np.uint32]
        fields: list[list[np.ndarray]] = [[] for _ in kinds]
        for x in (x for batch in batches for x in column(batch, "data").to_pylist()):
            planes = unsqueeze(x)
            for field, kind in zip(fields, kinds):
                width = np.dtype(kind).itemsize
                field.append(np.column_stack(planes[:width]).ravel().view(kind))
                planes = planes[width:]
        ids = np.concatenate([np.cumsum(x, dtype=np.uint64) for x in fields[0]]).view(np.int64)
        size, lens, head_key, head_bucket, k = (np.concatenate(x) for x in fields[1:])
        fields.clear()
        size, lens = size.astype(np.int64), lens.astype(np.int64)
        heads = head_key.astype(np.uint64).reshape(-1, HEADS) << U64(32) | head_bucket.astype(np.uint64).reshape(-1, HEADS)
        # Several tasks may have sent a class; all sent the same keys.
        uniq, first, inv = np.unique(ids, return_index=True, return_inverse=True)
        n, heads = size[first], heads[first]
        once = np.zeros(len(ids), bool)
        once[first] = True
        sent = np.repeat(once, lens)
        doc, k = np.repeat(inv.astype(np.int32), lens)[sent], k[sent]
        o = np.lexsort((doc, k))
        k, doc = k[o], doc[o]
        at = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
        length = np.diff(np.concatenate([at, [len(k)]]))
        bucket = int(key[0].as_py())
        lists = [(int(k[i]), doc[i : i + m]) for i, m in zip(at[length > most].tolist(), length[length > most].tolist())]
        at, length = at[(length > 1) & (length <= most)], length[(length > 1) & (length <= most)]
        # Within a list every member meets those after it; members are taken in the order of their classes.
        rest = list_positions(np.zeros(len(at), np.int64), length)
        mine = list_positions(at, length)
        follow = np.repeat(length, length) - 1 - rest
        whole = np.repeat(length * (length - 1) // 2, length)
        o = np.argsort(doc[mine], kind="stable")
        o = o[follow[o] > 0]
        mine, follow, whole = mine[o], follow[o], whole[o]
        ends = np.flatnonzero(np.diff(doc[mine], append=-1)) + 1
        cut = np.concatenate([[0], np.cumsum(follow)])
        begin = 0
        while begin < len(mine):
            # Up to PAIRS pairs, but never a part of a class: all that it shares with another is counted here.
            fit = np.searchsorted(cut[ends], cut[begin] + PAIRS, "right")
            end = int(ends[max(fit - 1, np.searchsorted(ends, begin, "right"))])
            yield from pairs(mine[begin:end], follow[begin:end], whole[begin:end], uniq, n, heads, doc, k, bucket)
            begin = end
        release()
        rows = []
        for where, members in lists:
            r = -(-len(members) // max(1, most // 4))
            rows += [{"a": i, "b": r, "grp": bucket << 32 | where, "ids": uniq[members[i::r]].tobytes(), "sizes": n[members[i::r]].astype(np.uint32).tobytes()} for i in range(r)]
        yield from pa.Table.from_pylist(rows, _FOUND_ARROW).to_batches()

    def pairs(mine: np.ndarray, follow: np.ndarray, whole: np.ndarray, uniq: np.ndarray, n: np.ndarray, heads: np.ndarray, doc: np.ndarray, k: np.ndarray, bucket: int) -> Iterator[pa.RecordBatch]:
        """The pairs of some postings with the follow ones after each; whole is how many pairs the posting's list has in all."""
        a = np.repeat(np.arange(len(mine)), follow)
        x, y = doc[mine[a]], doc[list_positions(mine + 1, follow)]
        ok = (10 * np.minimum(n[x], n[y]) >= 6 * np.maximum(n[x], n[y])) & (x != y)
        m, a = len(uniq), a[ok]
        best, first, shared = np.unique(x[ok].astype(np.int64) * m + y[ok], return_index=True, return_counts=True)
        where, a = a[first], best // m
        b = best - a * m
        # Two sets with a common key among their least ones meet in its bucket too; only that one names the pair.
        common = np.full(len(a), np.iinfo(np.uint64).max, np.uint64)
        for i in range(HEADS):
            for j in range(HEADS):
                h = heads[a, i]
                common = np.where((h == heads[b, j]) & (h < NO_HEAD), np.minimum(common, h), common)
        one = common < np.iinfo(np.uint64).max
        keep = ~one | ((common & U64(0xFFFFFFFF)) == U64(bucket))
        a, b, one, shared, where = a[keep], b[keep], one[keep], shared[keep], where[keep]
        if not len(a):
            return
        key = k[mine[where]].astype(np.int64)
        # How many pairs a list names in all, by the share of it that has been looked at here.
        _, at, of, each = np.unique(key, return_index=True, return_inverse=True, return_counts=True)
        looked = np.zeros(len(each), np.int64)
        mark = np.searchsorted(key[at], k[mine].astype(np.int64))
        mark[mark == len(each)] = 0
        hit = key[at][mark] == k[mine]
        np.add.at(looked, mark[hit], follow[hit])
        named = each * (whole[where[at]] / np.maximum(looked, 1))
        split = 1 + (named // VERIFY).astype(np.int64)
        fields = [np.minimum(uniq[a], uniq[b]), np.maximum(uniq[a], uniq[b]), (np.int64(bucket) << np.int64(32)) | key, split[of], np.where(one, ENOUGH, shared), evidence(np.minimum(n[a], n[b])).astype(np.int64)]
        for i in range(0, len(a), SENT):
            some = [pa.array(f[i : i + SENT], pa.int64()) for f in fields]
            yield pa.record_batch([*some, *[pa.nulls(len(some[0]), pa.binary())] * 2], _FOUND_ARROW)

    return run


_FOUND = "a long, b long, grp long, split long, shared long, need long, ids binary, sizes binary"
_FOUND_ARROW = pa.schema([*((x, pa.int64()) for x in ("a", "b", "grp", "split", "shared", "need")), ("ids", pa.binary()), ("sizes", pa.binary())])


def _fragments(key: tuple, table: pa.Table) -> pa.Table:
    """Pairs of classes of two fragments of a long list, or within one. They are to be verified whatever else they share."""
    parts = [(np.frombuffer(i, np.int64), np.frombuffer(s, np.uint32).astype(np.int64)) for i, s in zip(table["ids"].to_pylist(), table["sizes"].to_pylist())]
    (x, n), (y, m) = parts[0], parts[-1]
    lo, hi, need = [], [], []
    for i in range(len(x)):
        s = i + 1 if len(parts) == 1 else 0
        ok = 10 * np.minimum(n[i], m[s:]) >= 6 * np.maximum(n[i], m[s:])
        other = y[s:][ok]
        lo.append(np.minimum(x[i], other))
        hi.append(np.maximum(x[i], other))
        need.append(evidence(np.minimum(n[i], m[s:][ok])))
    lo, hi, need = (np.concatenate([np.zeros(0, np.int64), *v]) for v in (lo, hi, need))
    return pa.table({"a": lo, "b": hi, "grp": np.full(len(lo), key[0].as_py()), "split": np.full(len(lo), 1 + len(lo) // VERIFY), "shared": np.full(len(lo), ENOUGH), "need": need.astype(np.int64)})


def _members(marks: np.ndarray) -> Callable:
    """Sets of the documents whose bit is marked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bit = column(b, "bit").to_numpy()
            if not b.num_rows or not (at := np.flatnonzero(marks[bit >> 3] >> (bit & 7) & 1)).size:
                continue
            sets, _ = shingle_sets(*tv.buffers(column(b, "text").take(pa.array(at))))
            yield pa.record_batch([pa.array([digest(s) for s in sets], pa.binary()), slices(np.concatenate(sets), np.cumsum([len(s) for s in sets]))], ["digest", "members"])

    return run


def _marked(rep: DataFrame) -> tuple[int, np.ndarray]:
    """(bits, the filter as bytes) of the documents of rep."""
    bits = 1 << min(MOST_BITS.bit_length() - 1, max(10, (FILTER * rep.count() - 1).bit_length()))
    got = rep.select(_bit("rep", bits).alias("bit")).groupBy(F.shiftright("bit", 3).alias("at")).agg(F.bit_or(F.expr("shiftleft(1, cast(bit & 7 as int))")).alias("m")).toArrow()
    marks = np.zeros(bits >> 3, np.uint8)
    marks[got["at"].to_numpy()] = got["m"].to_numpy()
    return bits, marks


def _bit(name: str, bits: int) -> Column:
    return F.pmod(F.xxhash64(name), F.lit(bits))


def _verify(key: tuple, pairs: pa.Table, sets: pa.Table) -> pa.Table:
    """Of the pairs of one task that link: (class, null, linked documents), and stars (class, class, null) that span them."""
    have: dict[int, list[int]] = {}
    digests, members, copies = sets["digest"].to_pylist(), [u64(m) for m in sets["members"].to_pylist()], np.array(sets["copies"].to_pylist(), np.int64)
    for k, i in enumerate(sets["id"].to_pylist()):
        have.setdefault(i, []).append(k)
    by: dict[int, list[int]] = {}
    for a, b in zip(pairs["a"].to_pylist(), pairs["b"].to_pylist()):
        by.setdefault(a, []).append(b)
    degree, up = np.zeros(len(digests), np.int64), list(range(len(digests)))

    def top(k: int) -> int:
        while up[k] != k:
            up[k] = up[up[k]]
            k = up[k]
        return k

    for a, others in by.items():
        for k in have[a]:
            s = members[k]
            for i in range(0, len(others), 256):
                some = [x for b in others[i : i + 256] for x in have[b]]
                lens = np.array([len(members[x]) for x in some])
                flat = np.concatenate([members[x] for x in some])
                at = np.searchsorted(s, flat)
                at[at == len(s)] = 0
                both = np.add.reduceat((s[at] == flat).astype(np.int64), np.cumsum(lens) - lens)
                for j in np.flatnonzero(100 * both >= 60 * (len(s) + lens - both)).tolist():
                    degree[k] += copies[some[j]]
                    degree[some[j]] += copies[k]
                    x, y = top(k), top(some[j])
                    up[max(x, y)] = min(x, y)
    linked = np.flatnonzero(degree).tolist()
    stars = [(digests[top(k)], digests[k]) for k in linked if top(k) != k]
    rows = [(digests[k], None, int(degree[k])) for k in linked] + [(x, y, None) for x, y in stars]
    return pa.table({n: pa.array([r[i] for r in rows], t) for i, (n, t) in enumerate((("a", pa.binary()), ("b", pa.binary()), ("n", pa.int64())))})


def links(docs: DataFrame, long: int = LONG, turns: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(classes, links): documents (doc_id, n_shingles, digest), and of the links between classes (digest a, null, n), n documents
    of other classes that link with a (several rows of a class add up), and (a, b, null), edges that span the linked classes."""
    spark = docs.sparkSession
    parts = partitions(spark)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    survey = written(texts.mapInArrow(lean(_survey(parts)), "doc_id long, n_shingles long, digest binary, id long, bucket int, keys binary, counts binary"), "shingles")
    classes = survey.where("digest is not null").select("doc_id", "n_shingles", "digest", "id")
    frequent = written(survey.where("keys is not null").select("bucket", "keys", "counts").groupBy("bucket").applyInArrow(_frequent(parts), "word boolean, key long, n long"), "frequent")
    words, shingles = _top(frequent, True), _top(frequent, False)
    forget(frequent)
    sizes = classes.where(F.col("n_shingles") <= 4 * MAX_SMALL).groupBy("n_shingles").count().collect()
    small = boundary([(r[0], r[1]) for r in sizes])
    total = classes.agg(F.sum("n_shingles")).first()[0] or 0
    buckets = max(12, -(-total // PER_BUCKET))
    turns = turns or 1 + sum(buckets > x for x in ROUNDS)
    rounds = []
    for turn in range(turns):
        postings = texts.mapInArrow(lean(_postings(words, shingles, small, buckets, turn, turns)), "bucket int, data binary")
        rounds.append(written(postings.groupBy("bucket").applyInArrow(_candidates(buckets, long), _FOUND), "found"))
    found = reduce(DataFrame.unionByName, rounds)
    tasks = max(4 * parts, found.count() // PER_TASK)
    # Each fragment of a long list goes to all pairs of fragments that it is in.
    cut = found.where("ids is not null")
    twos = cut.select("grp", "ids", "sizes", F.col("a").alias("i"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("b") - 1)).alias("j"))
    more = twos.groupBy("grp", F.least("i", "j").alias("lo"), F.greatest("i", "j").alias("hi")).applyInArrow(_fragments, "a long, b long, grp long, split long, shared long, need long")
    found = found.where("ids is null").select("a", "b", "grp", "split", "shared", "need").unionByName(more)
    # A pair is verified with others of a key that both sets hold, or with a share of them if they are many.
    pairs = written(found.groupBy("a", "b").agg(F.min(F.struct("grp", "split")).alias("at"), F.sum("shared").alias("shared"), F.max("need").alias("need")).where("shared >= need").select("a", "b", F.pmod(F.xxhash64("at.grp", F.pmod("a", "at.split")), F.lit(tasks)).cast("int").alias("task")), "candidates")
    forget(*rounds)
    needed = pairs.select("task", F.explode(F.array("a", "b")).alias("id")).groupBy("id").agg(F.collect_set("task").alias("tasks"))
    # One document stands for each class; only the sets of these move, each once to every task that needs it.
    rep = written(classes.join(needed, "id").groupBy("digest").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.first("id").alias("id"), F.first("tasks").alias("tasks")), "representatives")
    bits, marks = _marked(rep)
    sets = texts.select(_bit("doc_id", bits).alias("bit"), "text").mapInArrow(lean(_members(marks)), "digest binary, members binary")
    full = sets.dropDuplicates(["digest"]).join(rep.drop("rep"), "digest")
    sent = full.select(F.explode("tasks").alias("home"), "digest", "id", "members", "copies")
    out = written(pairs.groupBy("task").cogroup(sent.groupBy("home")).applyInArrow(_verify, "a binary, b binary, n long"), "links")
    forget(pairs, rep)
    return classes, out


def components(edges: DataFrame, limit: int = 200) -> DataFrame:
    """(node, root): the least node that each node of the edges (a, b) reaches, by min-label propagation and pointer jumping."""
    both = edges.select("a", "b").union(edges.select("b", "a"))
    label = label_table = written(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("root")), "labels")
    for _ in range(limit):
        near = both.join(label.select(F.col("node").alias("b"), F.col("root").alias("near")), "b").groupBy(F.col("a").alias("node")).agg(F.min("near").alias("near"))
        step = label.join(near, "node").select("node", "root", F.least("root", "near").alias("low"))
        jump = step.join(label.select(F.col("node").alias("low"), F.col("root").alias("far")), "low", "left")
        after = written(jump.select("node", F.coalesce(F.least("low", "far"), "low").alias("root"), (F.coalesce(F.least("low", "far"), "low") != F.col("root")).alias("moved")), "labels")
        forget(label_table)
        label, label_table = after.select("node", "root"), after
        if not after.where("moved").limit(1).count():
            return label
    raise RuntimeError(f"components did not settle in {limit} rounds")


def near_duplicates(docs: DataFrame, long: int = LONG, turns: int | None = None) -> DataFrame:
    """One row for each document: doc_id, n_shingles, n_similar, component_id, class_id (least doc_id with the same set)."""
    classes, linked = links(docs, long, turns)
    named = written(classes.where("n_shingles > 0").groupBy("digest").agg(F.min("doc_id").alias("class_id"), F.count(F.lit(1)).alias("copies")), "classes")
    # Labels are ids where the class has one; classes of null ids only are named by their digest alone and sort last.
    label = F.concat(F.when(F.col("class_id").isNull(), F.lit("~")).otherwise(F.lit("")), F.coalesce(F.lpad((F.col("class_id").cast("decimal(20,0)") + F.lit("9223372036854775808").cast("decimal(20,0)")).cast("string"), 20, "0"), F.hex("digest")))
    edges = linked.where("b is not null")
    name = lambda x: named.select(F.col("digest").alias(x), label.alias(f"label_{x}"))
    tree = components(edges.join(name("a"), "a").join(name("b"), "b").select(F.col("label_a").alias("a"), F.col("label_b").alias("b")))
    root = tree.select(F.col("node").alias("label"), F.expr("case when root like '~%' then null else cast(cast(root as decimal(20,0)) - 9223372036854775808 as long) end").alias("component"))
    degree = linked.where("b is null").groupBy(F.col("a").alias("digest")).agg(F.sum("n").alias("others"))
    full = named.withColumn("label", label).join(root, "label", "left").join(degree, "digest", "left")
    table = full.select("digest", "class_id", (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n_similar"), F.coalesce("component", "class_id").alias("component_id"))
    found = classes.where("n_shingles > 0").join(table, "digest").select("doc_id", "n_shingles", "n_similar", "component_id", "class_id")
    # Empty sets have one digest and nothing to look up, so they don't meet in one task.
    alone = classes.where("n_shingles = 0").select("doc_id", "n_shingles", F.lit(0).cast("long").alias("n_similar"), F.col("doc_id").alias("component_id"), F.col("doc_id").alias("class_id"))
    return found.unionByName(alone)
