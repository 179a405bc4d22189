"""Language-model scores: a probabilistic suffix tree over words, beside a word unigram base.

Training documents are those whose crc32(doc_id as text) mod ``FOLDS`` is not
``HELD``. Tokens are words between white space, A-Z folded, and one end for each
document.

Tree. A context is the one to ``DEPTH`` words before a token (a document begins with
start symbols). Every context of the training documents is counted, so the tree
grows with the corpus. With N occurrences, T kinds of followers and n of them w, a
context is retained if N >= 2 and

    sum_w n ln(n / N / P(w))  >  sum_w -ln P(w) + T/2 ln N

where P is the distribution of its longest retained suffix: the divergence from that,
times N, must pay for naming the followers and for their shares. Distributions are
smoothed towards P by absolute discounting, (max(n - d, 0) + d T P(w)) / N with
d = ``DISCOUNT``. A token is scored from the longest retained suffix of the words
before it. The root has (c - d0) / N for a word of c training occurrences, d0 =
n1 / (n1 + 2 n2 + 1) from the numbers of words that occur once and twice, and what is left
for a word that training lacks; all such words are one symbol, as in the base.

Where. Words are counted by hash bucket over all training documents. The most
frequent of them (``COMMON`` at most) are broadcast; a block of documents asks the
buckets for the counts of its other words, each once. Blocks are made twice, once to ask
and once to be answered, and hold the same documents both times as long as the rows of
``docs`` come in the same order when they are read again (as those of files do); if not,
that is noticed and an error. Then every token goes, with its
context, to the bucket of the word before it: all contexts that end in that word meet
there, so their statistics, the tests and the scores of all documents come from one
shuffle, and only sums per document go back. A context before more than ``SPLIT`` training
tokens is spread over buckets by the word before it (if it has ``DEPTH`` words, by the
token), so no bucket follows a frequent word. Its followers are counted beforehand, over
all training documents: the one-word contexts first, then the longer ones that these
counts show to be as frequent. Every bucket that has tokens of such a context gets its
counts, so its distribution is that of the whole context, and SPLIT decides speed only.
Numbers of buckets follow the bytes of text.

``hot``, which no query gives, is another model: contexts of words before more than so many
tokens are classes of the word before (and of the one before that, if that is so frequent
too), of about that many tokens each, in the place of the word alone.

A token's log10 probability is rounded to 1e-6, so sums don't depend on how the data
are cut. A null or empty text is its end alone. Rows with equal ids are documents of
their own; a null id is in training. An empty table gives no rows; without training
documents N and V are 0, every token is the unknown symbol, of probability 1. Other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textvec as tv
from .common import column, lean, list_positions, release, slices, squeeze, unsqueeze, u64, written
from .jaccard import Table

U64 = np.uint64
FOLDS, HELD = 7, 2
#: Words that are broadcast at most (18 bytes each).
COMMON = 1 << 19
#: Tokens behind one context from which on it is spread over buckets.
SPLIT = 1 << 20
#: The same of the model of classes.
HOT = 1 << 20
DISCOUNT = 0.7
#: Words of a context at most.
DEPTH = 3
#: Tokens and documents of a block from which on it ends (so it has 2**15 - 1 documents at most), tokens of a bucket of contexts on average, and bytes of
#: text for each bucket of words.
BLOCK, BLOCK_DOCS, BUCKET, WORD_BYTES = 2_200_000, (1 << 14) - 1, 1_500_000, 16_000_000
UNIT = 1e6
#: The token that ends a document, and the symbol before its first; no word has these hashes but by chance of 2**-64.
END_HASH, START_HASH = U64(0x1D0C_E27D), U64(0x57A2_7B1D_0000_0001)
#: What stands for a word in a context: its rank among the most frequent ones, or one of these two, the start and any other.
START, OTHER = 65_534, 65_535
FLUSH = 4_000_000


def _buckets(h: np.ndarray, parts: int) -> np.ndarray:
    return ((h >> U64(32)) * U64(parts) >> U64(32)).astype(np.int32)


def _texts(b: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(hashes of the words, words of each text) of a batch, piece by piece."""
    data, offs = tv.buffers(column(b, "text"))
    for a, b in tv.pieces(offs, 1_000_000):
        for i in range(a, b, BLOCK_DOCS + 1):
            j = min(b, i + BLOCK_DOCS + 1)
            h, first = tv.words(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i], tv.SPACE_WORDS)
            yield h, np.diff(first)


# -- words


def _count(parts: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        n = 0

        def rows() -> pa.RecordBatch:
            key = np.sort(np.concatenate(held))
            held.clear()
            at = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            count = np.diff(np.concatenate([at, [len(key)]]))
            key = key[at]
            bucket = _buckets(key, parts)
            ends = np.concatenate([np.flatnonzero(np.diff(bucket)) + 1, [len(key)]])
            return pa.record_batch([pa.array(bucket[ends - 1]), slices(key, ends), slices(count.astype(np.int64), ends)], ["bucket", "keys", "counts"])

        for b in batches:
            if not b.num_rows:
                continue
            for h, words in _texts(b):
                held += [h, np.full(len(words), END_HASH)]
                n += len(h) + len(words)
            if n > FLUSH:
                yield rows()
                n = 0
        if held:
            yield rows()

    return run


def _sum(key: tuple, table: pa.Table) -> pa.Table:
    """Ascending keys of one bucket with their total counts; over: how many of them have 2**k or more."""
    k = np.concatenate([u64(x) for x in table["keys"].to_pylist()])
    n = np.concatenate([np.frombuffer(x, np.int64) for x in table["counts"].to_pylist()])
    o = np.argsort(k, kind="stable")
    k, n = k[o], n[o]
    at = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
    k, n = k[at], np.add.reduceat(n, at)
    over = [int((n >= 1 << e).sum()) for e in range(48)]
    return pa.table({"bucket": pa.array([key[0].as_py()], pa.int32()), "keys": pa.array([k.tobytes()], pa.binary()), "counts": pa.array([n.tobytes()], pa.binary()), "n": pa.array([int(n.sum())], pa.int64()), "v": pa.array([len(k)], pa.int64()), "n1": pa.array([int((n == 1).sum())], pa.int64()), "n2": pa.array([int((n == 2).sum())], pa.int64()), "over": pa.array([over], pa.list_(pa.int64()))})


class Root:
    """Probabilities of tokens by their counts."""

    def __init__(self, total: int, distinct: int, once: int, twice: int):
        self.total, self.distinct = total, distinct
        self.discount = once / (once + 2 * twice + 1) if once else 0.5
        self.unknown = self.discount * distinct / total if total else 1.0

    def of(self, count: np.ndarray) -> np.ndarray:
        return np.where(count > 0, (count - self.discount) / max(self.total, 1), self.unknown)


# -- blocks of documents

_ASK = "bucket int, block long, mark long, keys binary, numbers binary"
_WHOLE = "block long, mark long, ids array<long>, held binary, n_words binary, words binary, uniq binary, counts binary"


class Common(Table):
    """Counts of the most frequent words, and their ranks."""

    def __init__(self, key: np.ndarray, n: np.ndarray):
        super().__init__(key, n)
        order = np.lexsort((self.key, -self.n.astype(np.int64)))[:START]
        self.rank = np.full(len(self.key), OTHER, np.uint16)
        self.rank[order] = np.arange(len(order))
        self.by_rank = self.n[order].astype(np.int64)

    def ranks(self, h: np.ndarray) -> np.ndarray:
        if not len(self.key):
            return np.full(len(h), OTHER, np.uint16)
        at = tv.lookup(self.key, h, self.filter)
        return np.where(at >= 0, self.rank[at], OTHER).astype(np.uint16)

    def codes(self, h: np.ndarray) -> np.ndarray:
        """What stands for words in a bucket of contexts: ranks, or 31 bits of the hash and one more."""
        r = np.where(h == START_HASH, START, self.ranks(h)).astype(np.int64)
        return np.where(r == OTHER, (h >> U64(32)).astype(np.int64) | 1 << 31, r)


def _mark(uniq: np.ndarray, n: int) -> int:
    """What tells one block from another."""
    return int((tv.mix(uniq).sum(dtype=np.uint64) + U64(n)).astype(np.int64)) if len(uniq) else n


def _blocks(parts: int, top: Common, most: int, ask: bool) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        block = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 32
        ids: list = []
        held: list[np.ndarray] = []
        pieces: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        n = 0

        def asked(uniq: np.ndarray) -> Iterator[pa.RecordBatch]:
            some = np.flatnonzero(top.of(uniq) == 0)
            if len(some):
                # In the order of their hashes, which is that of the buckets.
                some = some[np.argsort(uniq[some])]
                bucket = _buckets(uniq[some], parts)
                ends = np.concatenate([np.flatnonzero(np.diff(bucket)) + 1, [len(bucket)]])
                m = len(ends)
                yield pa.record_batch([pa.array(bucket[ends - 1]), pa.array(np.full(m, block)), pa.array(np.full(m, _mark(uniq, n))), slices(uniq[some], ends), slices(some.astype("<u4"), ends)], ["bucket", "block", "mark", "keys", "numbers"])

        def whole(uniq: np.ndarray, of: np.ndarray) -> pa.RecordBatch:
            edge = np.cumsum([0, *(len(x[1]) for x in pieces)])
            word = np.concatenate([of[a + x[2]] for a, x in zip(edge, pieces)]).astype(np.uint32)
            row = [[block], [_mark(uniq, n)], [ids], [np.concatenate(held).tobytes()], [squeeze(np.concatenate([x[0] for x in pieces]).astype(np.uint32))], [squeeze((word & 0xFFFF).astype(np.uint16), (word >> 16).astype(np.uint16))], [squeeze(uniq)], [squeeze(top.of(uniq))]]
            kinds = [pa.int64(), pa.int64(), pa.list_(pa.int64()), *[pa.binary()] * 5]
            return pa.record_batch([pa.array(x, t) for x, t in zip(row, kinds)], ["block", "mark", "ids", "held", "n_words", "words", "uniq", "counts"])

        def rows() -> Iterator[pa.RecordBatch]:
            nonlocal block
            uniq, of = np.unique(np.concatenate([x[1] for x in pieces]), return_inverse=True)
            # Frequent words have small numbers, which compress well; the end's is the last one.
            n_of = np.zeros(len(uniq), np.int64)
            at = 0
            for _, key, word in pieces:
                n_of += np.bincount(of[at : at + len(key)], np.bincount(word, minlength=len(key)), len(uniq)).astype(np.int64)
                at += len(key)
            by = np.argsort(-n_of, kind="stable")
            place = np.empty(len(uniq), np.uint32)
            place[by] = np.arange(len(uniq), dtype=np.uint32)
            own = np.append(uniq[by], END_HASH)
            if ask:
                yield from asked(own)
            else:
                yield whole(own, place[of])
            pieces.clear()
            block += 1
            ids.clear()
            held.clear()

        for b in batches:
            if not b.num_rows:
                continue
            own, out = column(b, "doc_id").to_pylist(), column(b, "held_out").to_numpy(zero_copy_only=False)
            at = 0
            for h, words in _texts(b):
                m = len(words)
                key, word = np.unique(h, return_inverse=True)
                pieces.append((words, key, word.astype(np.uint32)))
                ids += own[at : at + m]
                held.append(out[at : at + m].astype(np.uint8))
                at += m
                n += len(h) + m
                if n > most or len(ids) > BLOCK_DOCS:
                    yield from rows()
                    n = 0
        if ids:
            yield from rows()

    return run


def _lookup(key: tuple, counts: pa.Table, entries: pa.Table) -> pa.Table:
    """For each block's words of one bucket their counts, by the words' numbers in the block."""
    k = np.concatenate([np.zeros(0, np.uint64), *(u64(x) for x in counts["keys"].to_pylist())])
    n = np.concatenate([np.zeros(0, np.int64), *(np.frombuffer(x, np.int64) for x in counts["counts"].to_pylist())])
    found = []
    for keys in entries["keys"].to_pylist():
        keys = u64(keys)
        c = np.zeros(len(keys), np.int64)
        if len(k):
            at = np.searchsorted(k, keys)
            at[at == len(k)] = 0
            c = np.where(k[at] == keys, n[at], 0)
        found.append(squeeze(c))
    return pa.table({"block": entries["block"], "mark": entries["mark"], "numbers": entries["numbers"], "counts": pa.array(found, pa.binary())})


# -- contexts

_CONTEXT = "bucket int, block long, ids array<long>, docs binary, data binary"


class Level:
    """The contexts of so many words that are spread over buckets: the last word is first in words. up: each one's number in the
    level before, of contexts one word shorter; classes: over how many shares one-word contexts are spread."""

    def __init__(self, words: np.ndarray, before: Level | None = None, classes: np.ndarray | None = None):
        key = self.chained(words)
        o = np.argsort(key)
        self.key, self.words = key[o], words[o]
        self.up = before.find(self.chained(self.words[:, :-1])) if before else np.arange(len(o))
        self.one = before.one[self.up] if before else self.up
        self.classes = classes[o].astype(np.uint64) if classes is not None else None
        self.total, self.kinds, self.keep = np.zeros(len(o)), np.zeros(len(o)), np.zeros(len(o), bool)

    @staticmethod
    def longer(key: np.ndarray, h: np.ndarray) -> np.ndarray:
        return tv.mix(key * U64(0x9E3779B97F4A7C15) + tv.mix(h))

    @classmethod
    def chained(cls, words: np.ndarray) -> np.ndarray:
        key = words[:, 0].copy()
        for x in words.T[1:]:
            key = cls.longer(key, x)
        return key

    def find(self, key: np.ndarray) -> np.ndarray:
        """The context's number, or -1."""
        at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        return np.where(self.key[at] == key, at, -1)

    def settle(self, number: np.ndarray, total: np.ndarray, kinds: np.ndarray, gain: np.ndarray) -> None:
        """Add up what buckets of followers say."""
        self.total, self.kinds, gain = (np.bincount(number, x, len(self.key)) for x in (total, kinds, gain))
        self.keep = (self.total >= 2) & (gain > (self.total + self.kinds / 2) * np.log(np.maximum(self.total, 1)))

    def p(self, number: np.ndarray, n: np.ndarray, parent: np.ndarray) -> np.ndarray:
        """The probability of followers that occur n times."""
        smooth = (np.maximum(n - DISCOUNT, 0) + DISCOUNT * self.kinds[number] * parent) / np.maximum(self.total[number], 1)
        return np.where(self.keep[number], smooth, parent)


def _shifted(word: np.ndarray, n_words: np.ndarray, end: int | np.uint64, start: int | np.uint64, deep: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, token, words before, the nearest first) of each token."""
    size = n_words + 1
    last = np.cumsum(size)
    token = np.full(int(last[-1]), end, word.dtype)
    inner = np.ones(len(token), bool)
    inner[last - 1] = False
    token[inner] = word
    before = np.full((deep, len(token)), start, word.dtype)
    for k in range(deep):
        x = before[k - 1] if k else token
        before[k, 1:] = x[:-1]
        before[k, last[:-1]] = start
        before[k, 0] = start
    return np.repeat(np.arange(len(n_words), dtype=np.uint32), size), token, before


def _spread(levels: list[Level], first: np.ndarray, hashed: Callable) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each level the tokens behind its contexts, and the contexts' numbers. first: the numbers of all tokens in the first
    level; hashed(k, at): the hashes of the words k before the tokens at."""
    at = np.flatnonzero(first >= 0)
    number = first[at]
    for k, level in enumerate(levels):
        if k:
            key = Level.longer(levels[k - 1].key[number], hashed(k, at))
            number = level.find(key)
            at, number = at[number >= 0], number[number >= 0]
        yield at, number


def contexts(word: np.ndarray, n_words: np.ndarray, uniq: np.ndarray, count: np.ndarray, most: int | None = None, levels: list[Level] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray], np.ndarray]:
    """(text, token, context of the word before, numbers of the words before that, whether the first context occurs twice or more in
    training) of each token. uniq and count: hashes and training counts of the words by number, the end's last; the start has the
    number behind them. most: the model of classes; levels: contexts that are spread."""
    end = len(uniq) - 1
    hashes, counts = np.append(uniq, START_HASH), np.append(count, count[end])
    text, token, before = _shifted(word.astype(np.uint32), n_words, end, end + 1, max(3, DEPTH))
    one, two, three = before[:3]
    key = hashes[one]
    if levels:
        far = np.zeros(len(key), np.uint64)
        first = levels[0].find(hashes)[one]
        for k, (at, _) in enumerate(_spread(levels, first, lambda k, at: hashes[before[k][at]])):
            far[at] += tv.mix(hashes[before[k + 1][at] if k + 1 < DEPTH else token[at]] + U64(k))
        hot = np.flatnonzero(first >= 0)
        key[hot] = tv.mix(key[hot] + U64(1) + tv.mix(far[hot]) % levels[0].classes[first[hot]])
    hot = np.flatnonzero(counts[one] > most) if most is not None else np.zeros(0, np.int64)
    if len(hot):
        classes = (-(-counts[one[hot]] // most)).astype(np.uint64)
        far = np.where(counts[two[hot]] > most, tv.mix(hashes[three[hot]] + U64(5)), U64(0))
        key[hot] = tv.mix(key[hot] + U64(1) + tv.mix(hashes[two[hot]] + far) % classes)
    return text, token, key, list(before[1:DEPTH]), counts[one] > 1


# -- followers of contexts that are spread

_ENTRIES = "bucket int, numbers binary, keys binary, counts binary"
_BEHIND = _ENTRIES + ", parents binary, some binary, total binary, kinds binary, gain binary, big binary, big_keys binary"


def _joint(blobs: pa.ChunkedArray, kind: type) -> np.ndarray:
    return np.concatenate([np.zeros(0, kind), *(np.frombuffer(x, kind) for x in blobs.to_pylist())])


def _followers(levels: list[Level], parts: int) -> Callable:
    """Counts of the tokens behind each context of the last level, by the tokens' buckets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        n = 0

        def rows() -> pa.RecordBatch:
            number, key = (np.concatenate(x) for x in zip(*held))
            held.clear()
            o = np.lexsort((number, key))
            number, key = number[o], key[o]
            at = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (number[1:] != number[:-1])]))
            count = np.diff(np.concatenate([at, [len(key)]]))
            number, key = number[at], key[at]
            bucket = _buckets(key, parts)
            ends = np.concatenate([np.flatnonzero(np.diff(bucket)) + 1, [len(key)]])
            return pa.record_batch([pa.array(bucket[ends - 1]), slices(number.astype(np.uint32), ends), slices(key, ends), slices(count.astype(np.int64), ends)], ["bucket", "numbers", "keys", "counts"])

        for b in batches:
            if not b.num_rows:
                continue
            for h, words in _texts(b):
                _, token, before = _shifted(h, words, END_HASH, START_HASH, len(levels))
                *_, (at, number) = _spread(levels, levels[0].find(before[0]), lambda k, at, x=before: x[k][at])
                if len(at):
                    held.append((number, token[at]))
                    n += len(at)
            if n > FLUSH:
                yield rows()
                n = 0
        if held:
            yield rows()

    return run


def _behind(root: Root, levels: list[Level], most: int) -> Callable:
    """Total counts of the followers in one bucket with their probabilities behind the contexts' suffixes, what they add to the
    statistics of each context, and those that occur more than ``most`` times behind one."""

    def run(key: tuple, entries: pa.Table, earlier: pa.Table) -> pa.Table:
        number, h, n = _joint(entries["numbers"], np.uint32).astype(np.int64), _joint(entries["keys"], np.uint64), _joint(entries["counts"], np.int64)
        schema = pa.schema([(c.split()[0], pa.int32() if c.split()[1] == "int" else pa.binary()) for c in _BEHIND.split(", ")])
        if not len(n):
            return schema.empty_table()
        o = np.lexsort((number, h))
        number, h, n = number[o], h[o], n[o]
        at = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (number[1:] != number[:-1])]))
        number, h, n = number[at], h[at], np.add.reduceat(n, at)
        k, c = _joint(earlier["keys"], np.uint64), _joint(earlier["counts"], np.int64)
        if len(levels) > 1:
            up = _joint(earlier["numbers"], np.uint32).astype(np.int64)
            p = levels[-2].p(up, c, _joint(earlier["parents"], np.float64))
            k, wanted = Level.longer(k, up.astype(np.uint64)), Level.longer(h, levels[-1].up[number].astype(np.uint64))
        else:
            p, wanted = root.of(c), h
        o = np.argsort(k)
        at = o[np.searchsorted(k[o], wanted)]
        if (k[at] != wanted).any():
            raise ValueError("the documents were others when they were read again; write them to files first")
        p = p[at]
        some, of, kinds = np.unique(number, return_inverse=True, return_counts=True)
        big = np.flatnonzero(n > most)
        row = [key[0].as_py(), number.astype(np.uint32), h, n, p, some, np.bincount(of, n).astype(np.int64), kinds.astype(np.int64), np.bincount(of, n * np.log(n) - (n - 1) * np.log(p)), number[big], h[big]]
        return pa.table([pa.array([x if i == 0 else x.tobytes()], f.type) for i, (x, f) in enumerate(zip(row, schema))], schema=schema)

    return run


def _levels(train: DataFrame, counts: DataFrame, root: Root, parts: int, most: int) -> tuple[list[Level], list[DataFrame]]:
    """The contexts of more than ``most`` training tokens, settled, and the tables of their followers."""

    def frequent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            k, n = _joint(column(b, "keys"), np.uint64), _joint(column(b, "counts"), np.int64)
            yield pa.record_batch([pa.array([k[n > most].tobytes()], pa.binary()), pa.array([n[n > most].tobytes()], pa.binary())], ["keys", "counts"])

    top = counts.select("keys", "counts").mapInArrow(frequent, "keys binary, counts binary").toArrow()
    key, n = _joint(top["keys"], np.uint64), _joint(top["counts"], np.int64)
    # As many starts as ends.
    start = bool((key == END_HASH).any())
    key[key == END_HASH] = START_HASH
    levels, tables = [], []
    words = key[:, None]
    while len(words) and len(levels) < DEPTH:
        levels.append(Level(words, levels[-1] if levels else None, None if levels else -(-n // most)))
        entries = train.mapInArrow(lean(_followers(levels, parts)), _ENTRIES)
        earlier = tables[-1] if tables else counts
        tables.append(written(entries.groupBy("bucket").cogroup(earlier.groupBy("bucket")).applyInArrow(_behind(root, levels, most), _BEHIND), "followers"))
        got = tables[-1].select("bucket", "some", "total", "kinds", "gain", "big", "big_keys").toArrow().sort_by("bucket")
        levels[-1].settle(_joint(got["some"], np.int64), _joint(got["total"], np.int64), _joint(got["kinds"], np.int64), _joint(got["gain"], np.float64))
        big, h = _joint(got["big"], np.int64), _joint(got["big_keys"], np.uint64)
        big, h = big[h != END_HASH], h[h != END_HASH]
        words = np.column_stack([h, levels[-1].words[big]])
        if start:
            words = np.vstack([words, np.full((1, words.shape[1]), START_HASH)])
    return levels, tables


class Spread:
    """What the buckets of contexts know of those that are spread: their levels, classes, and the words that make them longer."""

    def __init__(self, levels: list[Level], top: Common, parts: int):
        self.levels, self.heads, self.own = levels, np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.longer: list[tuple[np.ndarray, np.ndarray]] = []
        if not levels:
            return
        n = levels[0].classes.astype(np.int64)
        own, share = np.repeat(np.arange(len(n)), n), list_positions(np.zeros(len(n), np.int64), n).astype(np.uint64)
        key = tv.mix(levels[0].words[own, 0] + U64(1) + share)
        bucket = _buckets(key, parts)
        #: Buckets that have shares of each one-word context.
        self.homes = [np.unique(bucket[own == k]).tolist() for k in range(len(n))]
        o = np.argsort(key >> U64(16))
        self.heads, self.own = (key >> U64(16))[o], own[o]
        for level in levels[1:]:
            key = level.up << 32 | top.codes(level.words[:, -1])
            o = np.argsort(key)
            self.longer.append((key[o], o))

    def first(self, heads: np.ndarray) -> np.ndarray:
        return self._find(self.heads, self.own, heads)

    def next(self, k: int, number: np.ndarray, word: np.ndarray) -> np.ndarray:
        """Numbers in level k of contexts of the level before with one more word."""
        if k >= len(self.levels):
            return np.full(len(number), -1)
        return np.where(number >= 0, self._find(*self.longer[k - 1], number << 32 | word), -1)

    @staticmethod
    def _find(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
        if not len(keys):
            return np.full(len(wanted), -1)
        at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
        return np.where(keys[at] == wanted, values[at], -1)


def _lists(k: int, spread: Spread, top: Common) -> Callable:
    """Followers of the contexts of level k for every bucket that has tokens of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            number, n = _joint(column(b, "numbers"), np.uint32).astype(np.int64), _joint(column(b, "counts"), np.int64)
            code, one = top.codes(_joint(column(b, "keys"), np.uint64)), spread.levels[k].one[number]
            o = np.argsort(one, kind="stable")
            one, key, n = one[o], (number << 32 | code)[o], n[o]
            ends = np.flatnonzero(np.diff(one, append=-1)) + 1
            for s, e in zip([0, *ends[:-1].tolist()], ends.tolist()):
                to = spread.homes[one[s]]
                yield pa.record_batch([pa.array(to, pa.int32()), pa.array([k] * len(to), pa.int32()), pa.array([squeeze(key[s:e], n[s:e])] * len(to), pa.binary())], ["to", "level", "data"])

    return run


def _planes(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Low and high bytes of 16-bit numbers, which compress better apart."""
    return (x & 255).astype(np.uint8), (x >> 8).astype(np.uint8)


def _joined(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    return low.astype(np.uint16) | high.astype(np.uint16) << np.uint16(8)


def _send(parts: int, root: Root, hot: int | None, top: Common, levels: list[Level]) -> Callable:
    def run(key: tuple, docs: pa.Table, found: pa.Table) -> pa.Table:
        r0 = docs.to_pylist()[0]
        (n_words,), (low, high), (uniq,), (count,) = (unsqueeze(r0[k]) for k in ("n_words", "words", "uniq", "counts"))
        n_words, count = n_words.astype(np.int64), count.copy()
        asked = np.flatnonzero(count == 0)
        answers = 0
        for mark, numbers, c in zip(found["mark"].to_pylist(), found["numbers"].to_pylist(), found["counts"].to_pylist()):
            if mark != r0["mark"]:
                raise ValueError("the documents came in another order when they were read again; write them to files first")
            numbers = np.frombuffer(numbers, "<u4")
            count[numbers] = unsqueeze(c)[0]
            answers += len(numbers)
        if answers != len(asked):
            raise ValueError("the documents were others when they were read again; write them to files first")
        word = low.astype(np.uint32) | high.astype(np.uint32) << np.uint32(16)
        held = np.frombuffer(r0["held"], np.uint8)
        m, block = len(n_words), r0["of"]
        text, token, at, before, known = contexts(word, n_words, uniq, count, hot, levels)
        logs = np.log10(count + 1.0)
        base = np.bincount(text, logs[token], m) - (n_words + 1) * np.log10(root.total + root.distinct + 1.0)
        n_known = np.bincount(text, count[token] > 0, m).astype(np.int64)
        # Without a context that occurs twice, a token has the root's probability.
        alone = np.round(np.log10(root.of(count)) * UNIT).astype(np.int64)
        score = np.bincount(text, np.where(known, 0, alone[token]), m).astype(np.int64)
        some = np.flatnonzero(known)
        # In the order of the texts within a context, so that steps from text to text are small.
        some = some[np.argsort(at[some], kind="stable")]
        at, before, token = at[some], [x[some] for x in before], token[some]
        code = (text << 1 | held[text])[some].astype(np.uint16)
        del text, some, known
        bucket = _buckets(at, parts)
        ends = np.concatenate([np.flatnonzero(np.diff(bucket)) + 1, [len(bucket)]]) if len(bucket) else np.zeros(0, np.int64)
        rank = np.append(top.ranks(uniq), np.uint16(START))
        hash32, weight = (uniq >> U64(32)).astype(np.uint32), count.astype(np.float32)
        data = []
        for s, e in zip([0, *ends[:-1].tolist()], ends.tolist()):
            h, own = at[s:e], token[s:e]
            new = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
            head = h[new] >> U64(16)
            r_own, farther = rank[own], []
            for x in before:
                r = rank[x[s:e]]
                farther += [*_planes(r), hash32[x[s:e][r == OTHER]]]
            rare = own[r_own == OTHER]
            step = np.diff(code[s:e], prepend=np.uint16(0))
            data.append(squeeze((head >> U64(32)).astype(np.uint16), head.astype(np.uint32), np.diff(np.concatenate([new, [e - s]])).astype(np.uint32), *_planes(r_own), hash32[rare], weight[rare], *_planes(step), *farther))
        k = len(data)
        line = squeeze(held, n_words + 1, n_known, base, score)
        release()
        return pa.table({"bucket": pa.array([-1, *bucket[ends - 1].tolist()], pa.int32()), "block": pa.array([block] * (k + 1), pa.int64()), "ids": pa.array([r0["ids"], *[None] * k], pa.list_(pa.int64())), "docs": pa.array([line, *[None] * k], pa.binary()), "data": pa.array([None, *data], pa.binary())})

    return run


def retained(group: np.ndarray, n: np.ndarray, parent: np.ndarray, groups: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(N, T, retained) of contexts: group, n and the suffix's probability of each follower."""
    seen = n > 0
    g, n, p = group[seen], n[seen], parent[seen]
    total, kinds = np.bincount(g, n, groups), np.bincount(g, minlength=groups)
    # The followers' part of the test, N ln N and T/2 ln N apart.
    gain = np.bincount(g, n * np.log(n) - (n - 1) * np.log(p), groups)
    with np.errstate(divide="ignore", invalid="ignore"):
        keep = (total >= 2) & (gain > (total + kinds / 2) * np.log(np.maximum(total, 1)))
    return total, kinds, keep


def _level(context: np.ndarray, token: np.ndarray, train: np.ndarray, parent: np.ndarray, groups: int, width: int) -> tuple[np.ndarray, tuple]:
    """The probability of each token behind its context, given that behind the context's suffix; and (N, T, retained)."""
    key = context * width + token
    o = np.argsort(key)
    k = key[o]
    new = np.concatenate([[True], k[1:] != k[:-1]])
    of = np.empty(len(key), np.int64)
    of[o] = np.cumsum(new) - 1
    first = o[new]
    n = np.bincount(of, train, len(first))
    group, p = context[first], parent[first]
    total, kinds, keep = retained(group, n, p, groups)
    some = keep[group]
    out = p.copy()
    g = group[some]
    out[some] = (np.maximum(n[some] - DISCOUNT, 0) + DISCOUNT * kinds[g] * p[some]) / total[g]
    return out[of], (total, kinds, keep)


def _score(root: Root, by_rank: np.ndarray, spread: Spread, tree: bool = False) -> Callable:
    common = root.of(by_rank.astype(np.float64))

    def run(key: tuple, table: pa.Table, lists: pa.Table) -> pa.Table:
        if not table.num_rows:
            return pa.table({"block": pa.array([], pa.int64()), "ids": pa.array([], pa.list_(pa.int64())), "docs": pa.array([], pa.binary()), "data": pa.array([], pa.binary())}) if not tree else pa.table({"context": pa.array([], pa.int64()), "before": pa.array([], pa.list_(pa.int64())), "n": pa.array([], pa.int64()), "followers": pa.array([], pa.int64())})
        if key[0].as_py() < 0:
            # What blocks say of their documents goes along to where the sums meet.
            return table.select(["block", "ids", "docs", "data"]) if not tree else pa.table({"context": pa.array([], pa.int64()), "before": pa.array([], pa.list_(pa.int64())), "n": pa.array([], pa.int64()), "followers": pa.array([], pa.int64())})
        parts = [unsqueeze(x) for x in table["data"].to_pylist()]
        heads, of_head = np.unique(np.concatenate([p[0].astype(np.uint64) << U64(32) | p[1] for p in parts]), return_inverse=True)
        rare, first, of_rare = np.unique(np.concatenate([p[5] for p in parts]), return_index=True, return_inverse=True)
        # Words by rank, and behind the ranks the others of this bucket.
        p0 = np.concatenate([common, np.ones(OTHER + 1 - len(common)), root.of(np.concatenate([p[6] for p in parts]).astype(np.float64)[first])])
        context, token, code = [], [], []
        before: list[list[np.ndarray]] = [[] for _ in range(DEPTH - 1)]
        a = b = 0
        for p in parts:
            context.append(np.repeat(of_head[a : a + len(p[0])], p[2]))
            own = _joined(p[3], p[4]).astype(np.int64)
            own[own == OTHER] = of_rare[b : b + len(p[5])] + OTHER + 1
            token.append(own)
            code.append(np.cumsum(_joined(p[7], p[8]), dtype=np.uint16))
            for k, x in enumerate(before):
                low, high, other = p[9 + 3 * k : 12 + 3 * k]
                word = _joined(low, high).astype(np.int64)
                word[word == OTHER] = other | np.uint32(1 << 31)
                x.append(word)
            a, b = a + len(p[0]), b + len(p[5])
        size = [len(c) for c in code]
        context, token = np.concatenate(context), np.concatenate(token)
        train = (np.concatenate(code) & 1) == 0
        codes = np.concatenate([np.arange(OTHER + 1), rare.astype(np.int64) | 1 << 31])
        rows = list(zip(lists["level"].to_pylist(), lists["data"].to_pylist())) if lists is not None else []

        def whole(k: int, number: np.ndarray, p: np.ndarray, stats: tuple, parent: np.ndarray) -> None:
            """Put in the probabilities behind contexts that are spread, of which this bucket has a share."""
            some = np.flatnonzero(number >= 0)
            if not len(some):
                return
            parts = [unsqueeze(x) for at, x in rows if at == k]
            follower, n = (np.concatenate([np.zeros(0, np.int64), *(x[i] for x in parts)]) for i in range(2))
            o = np.argsort(follower, kind="stable")
            found = Spread._find(follower[o], n[o], number[some] << 32 | codes[token[some]])
            p[some] = spread.levels[k].p(number[some], np.maximum(found, 0), parent[some])
            stats[2][context[some]] = False

        p, stats = _level(context, token, train, p0[token], len(heads), len(p0))
        number = spread.first(heads)[context]
        whole(0, number, p, stats, p0[token])
        named, own = heads.view(np.int64).copy(), spread.first(heads)
        if (own >= 0).any():
            named[own >= 0] = (spread.levels[0].words[own[own >= 0], 0] >> U64(16)).view(np.int64)
        kept = [(named, np.zeros((len(heads), 0), np.int64), stats)]
        for depth, x in enumerate(before, 1):
            word, parent = np.concatenate(x), p
            longer, context = np.unique(context << 32 | word, return_inverse=True)
            p, stats = _level(context, token, train, parent, len(longer), len(p0))
            number = spread.next(depth, number, word)
            whole(depth, number, p, stats, parent)
            if tree:
                up = longer >> 32
                kept.append((kept[-1][0][up], np.column_stack([kept[-1][1][up], longer & 0xFFFFFFFF]), stats))
        if tree:
            rows = [(h[s[2]], w[s[2]], *(s[k][s[2]].astype(np.int64) for k in range(2))) for h, w, s in kept]
            words = pa.array([w.tolist() for _, ws, _, _ in rows for w in ws], pa.list_(pa.int64()))
            return pa.table({"context": pa.array(np.concatenate([r[0] for r in rows]), pa.int64()), "before": words, **{k: pa.array(np.concatenate([r[i] for r in rows]), pa.int64()) for k, i in (("n", 2), ("followers", 3))}})
        found, at = [], 0
        units = np.round(np.log10(p) * UNIT).astype(np.int64)
        for c, n in zip(code, size):
            who = c >> 1
            total = np.bincount(who, units[at : at + n]).astype(np.int64)
            some = np.flatnonzero(total)
            total = total[some]
            found.append(squeeze(np.diff(some, prepend=0).astype(np.uint16), total.astype(np.int32) if not len(total) or total.min() > -(2**31) else total))
            at += n
        release()
        return pa.table({"block": table["block"], "ids": table["ids"], "docs": table["docs"], "data": pa.array(found, pa.binary())})

    return run


def _total(root: Root) -> Callable:
    def run(key: tuple, table: pa.Table) -> pa.Table:
        ids, docs = next((i, d) for i, d in zip(table["ids"].to_pylist(), table["docs"].to_pylist()) if d is not None)
        held, n_tokens, n_known, base, score = unsqueeze(docs)
        score = score.copy()
        for x in table["data"].to_pylist():
            if x is not None:
                step, total = unsqueeze(x)
                score[np.cumsum(step, dtype=np.int64)] += total
        return pa.table({"doc_id": pa.array(ids, pa.int64()), "held_out": pa.array(held.astype(bool)), "n_tokens": pa.array(n_tokens), "n_known": pa.array(n_known), "train_tokens": pa.array(np.full(len(ids), root.total)), "base_score": pa.array(np.round(base, 9)), "score": pa.array(score / UNIT)})

    return run


def _sent(docs: DataFrame, common: int, hot: int | None, block: int, split: int) -> tuple[DataFrame, DataFrame | None, Root, Common, Spread]:
    """Tokens with their contexts by bucket, followers of contexts that are spread, the root, the most frequent words, and the
    contexts that are spread."""
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % FOLDS == HELD, F.lit(False))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held.alias("held_out"), F.col("text").cast("string").alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(12, -(-size // WORD_BYTES))
    counts = written(rows.where("not held_out").select("text").mapInArrow(lean(_count(parts)), "bucket int, keys binary, counts binary").groupBy("bucket").applyInArrow(_sum, "bucket int, keys binary, counts binary, n long, v long, n1 long, n2 long, over array<long>"), "word-counts")
    total, distinct, once, twice, *over = counts.agg(*(F.coalesce(F.sum(x), F.lit(0)) for x in ("n", "v", "n1", "n2")), *(F.coalesce(F.sum(F.col("over")[k]), F.lit(0)) for k in range(48))).first()
    root = Root(int(total), int(distinct), int(once), int(twice))
    # The least power of two that COMMON words or fewer reach.
    least = 1 << next(k for k, n in enumerate([*over, 0]) if n <= common)

    def frequent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            k = np.concatenate([np.zeros(0, np.uint64), *(u64(x) for x in column(b, "keys").to_pylist())])
            n = np.concatenate([np.zeros(0, np.int64), *(np.frombuffer(x, np.int64) for x in column(b, "counts").to_pylist())])
            yield pa.record_batch([pa.array([k[n >= least].tobytes()], pa.binary()), pa.array([n[n >= least].tobytes()], pa.binary())], ["keys", "counts"])

    top = counts.select("keys", "counts").mapInArrow(frequent, "keys binary, counts binary").toArrow()
    join = lambda name, kind: np.concatenate([np.zeros(0, kind), *(np.frombuffer(x, kind) for x in top[name].to_pylist())])
    table = Common(join("keys", np.uint64), join("counts", np.int64))
    entries = rows.mapInArrow(lean(_blocks(parts, table, block, True)), _ASK).withColumnRenamed("bucket", "to")
    found = counts.select("bucket", "keys", "counts").groupBy("bucket").cogroup(entries.groupBy("to")).applyInArrow(_lookup, "block long, mark long, numbers binary, counts binary")
    whole = rows.mapInArrow(lean(_blocks(parts, table, block, False)), _WHOLE).withColumnRenamed("block", "of")
    # A token has six bytes or more on average.
    buckets = max(12, -(-size // 6 // BUCKET))
    levels, tables = _levels(rows.where("not held_out").select("text"), counts, root, parts, split) if hot is None else ([], [])
    spread = Spread(levels, table, buckets)
    lists = None
    for k, t in enumerate(tables):
        own = t.select("numbers", "keys", "counts").mapInArrow(_lists(k, spread, table), "to int, level int, data binary")
        lists = lists.unionByName(own) if lists is not None else own
    sent = whole.groupBy("of").cogroup(found.groupBy("block")).applyInArrow(_send(buckets, root, hot, table, levels), _CONTEXT)
    return sent, lists, root, table, spread


def _each(sent: DataFrame, lists: DataFrame | None, fn: Callable, kind: str) -> DataFrame:
    """fn of each bucket of contexts."""
    if lists is not None:
        return sent.groupBy("bucket").cogroup(lists.groupBy("to")).applyInArrow(fn, kind)

    def alone(key: tuple, table: pa.Table) -> pa.Table:
        return fn(key, table, None)

    return sent.groupBy("bucket").applyInArrow(alone, kind)


def scores(docs: DataFrame, common: int = COMMON, hot: int | None = None, block: int = BLOCK, split: int = SPLIT) -> DataFrame:
    """One row for each document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    sent, lists, root, top, spread = _sent(docs, common, hot, block, split)
    sums = _each(sent, lists, _score(root, top.by_rank, spread), "block long, ids array<long>, docs binary, data binary")
    return sums.groupBy("block").applyInArrow(_total(root), "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def tree(docs: DataFrame, common: int = COMMON, hot: int | None = None, block: int = BLOCK, split: int = SPLIT) -> DataFrame:
    """The retained contexts: context (48 bits of the hash of the last word, or of its class), before (ranks or hashes of the
    words before it, the nearest first; none in contexts of one word), n and followers."""
    kind = "context long, before array<long>, n long, followers long"
    sent, lists, root, top, spread = _sent(docs, common, hot, block, split)
    rows = [(int(x.words[i, 0] >> U64(16)), top.codes(x.words[i, 1:]).tolist(), int(x.total[i]), int(x.kinds[i])) for x in spread.levels for i in np.flatnonzero(x.keep)]
    return _each(sent, lists, _score(root, top.by_rank, spread, tree=True), kind).unionByName(docs.sparkSession.createDataFrame(rows, kind))
