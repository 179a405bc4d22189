"""Document fingerprints from prefix polynomial hashes.

``Prefix`` keeps, for a text, two arrays of prefix sums of code point times power,
modulo two primes. From them the hash of any span costs a subtraction and a product,
so span equality is one comparison and the longest common extension of two positions
a binary search.

A fingerprint is the hash of the whole text and a bottom-``SKETCH`` sketch of the
hashes of its spans of ``SPAN`` code points (of the whole text if it is shorter):
length, both residues, and the least distinct span hashes, in hexadecimal. Equal
texts have equal fingerprints. The likeness of two fingerprints is the Jaccard
estimate from the sketches, 1 for equal fingerprints.

``edited`` replaces the last floor(n / 3) code points of a text by the first as many
(or all) of the next document's in descending doc_id (after the last comes the
first). Documents are cut into ranges of ids at quantiles (a bounded list), each text
moves once to the partition of its range, and the first row of each range also to the
range before; within a sorted partition the next row is the next document. A range is
a share of the rows whatever the ids are, unless one id has more rows than a range;
those rows are ordered by text.

A null text counts as empty: the edited text of an empty text is empty, and so are
both fingerprints equal, likeness 1. Null ids come last. Repeated rows follow one
another. A single document is its own next one. An empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column, partitions
from .textvec import mix

P1, P2 = np.uint64(2_147_483_647), np.uint64(2_147_483_629)
B1, B2 = 911_382_323, 972_663_749
SPAN, SKETCH = 8, 64
U64 = np.uint64
_powers: dict[int, np.ndarray] = {}


def powers(base: int, prime: np.uint64, n: int) -> np.ndarray:
    """The first n powers of base modulo prime."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        have = np.ones(1, np.uint64)
        while len(have) < max(n, 4096):
            have = np.concatenate([have, have * U64(pow(base, len(have), int(prime))) % prime])
        _powers[base] = have
    return have[:n]


def points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


class Prefix:
    """Prefix hashes of a text modulo two primes."""

    def __init__(self, x: np.ndarray):
        self.n = len(x)
        c = x.astype(np.uint64) + U64(1)
        self.sums = []
        for base, prime in ((B1, P1), (B2, P2)):
            # Sums of up to 2**33 residues stay below 2**64.
            s = np.zeros(self.n + 1, np.uint64)
            np.cumsum(c * powers(base, prime, self.n) % prime, out=s[1:])
            self.sums.append(s % prime)

    def spans(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """A 62-bit hash of each span; equal spans at different places have equal hashes."""
        out = []
        for (base, prime), s in zip(((B1, P1), (B2, P2)), self.sums):
            raw = (s[end] + prime - s[start]) % prime
            # Shifted to a common place: every hash is multiplied up to the power FAR.
            out.append(raw * inverse(base, prime, self.n + 1)[start] % prime)
        return (out[0] << U64(31)) | out[1]

    def equal(self, a: int, other: Prefix, b: int, length: int) -> bool:
        """Whether length code points from a on equal those of other from b on."""
        if a + length > self.n or b + length > other.n:
            return False
        for (base, prime), s, t in zip(((B1, P1), (B2, P2)), self.sums, other.sums):
            p, q = int(prime), powers(base, prime, max(a, b) + 1)
            # Each difference is multiplied up to the other's place.
            if ((int(s[a + length]) - int(s[a])) * int(q[b]) - (int(t[b + length]) - int(t[b])) * int(q[a])) % p:
                return False
        return True

    def extension(self, a: int, other: Prefix, b: int) -> int:
        """The length of the longest common extension of a and of other's b."""
        low, high = 0, min(self.n - a, other.n - b)
        while low < high:
            mid = (low + high + 1) // 2
            low, high = (mid, high) if self.equal(a, other, b, mid) else (low, mid - 1)
        return low


def inverse(base: int, prime: np.uint64, n: int) -> np.ndarray:
    """The first n powers of the inverse of base modulo prime."""
    return powers(pow(base, -1, int(prime)), prime, n)


def sketch(p: Prefix) -> tuple[np.ndarray, int]:
    """(the least distinct span hashes, hash of the whole text)."""
    n = p.n
    if not n:
        return np.zeros(0, np.uint64), 0
    start = np.arange(max(1, n - SPAN + 1))
    h = mix(p.spans(start, np.minimum(start + SPAN, n)))
    if len(h) > 16 * SKETCH:
        # The least 4 SKETCH mostly hold SKETCH distinct ones; if not, all are sorted.
        few = np.unique(np.partition(h, 4 * SKETCH)[: 4 * SKETCH])
        least = few[:SKETCH] if len(few) >= SKETCH else np.unique(h)[:SKETCH]
    else:
        least = np.unique(h)[:SKETCH]
    return least, int(p.sums[0][n] << U64(31) | p.sums[1][n])


Print = tuple[str, np.ndarray]


def fingerprint(x: np.ndarray | Prefix) -> Print:
    p = x if isinstance(x, Prefix) else Prefix(x)
    least, whole = sketch(p)
    return f"{p.n:x}:{whole:016x}:" + least.astype(">u8").tobytes().hex(), least


def likeness(a: Print, b: Print) -> float:
    """Estimated Jaccard similarity of the texts' spans."""
    if a[0] == b[0]:
        return 1.0
    if not len(a[1]) or not len(b[1]):
        return 0.0
    union = np.union1d(a[1], b[1])
    union = union[:SKETCH] if max(len(a[1]), len(b[1])) >= SKETCH else union
    return len(np.intersect1d(np.intersect1d(union, a[1], True), b[1], True)) / len(union)


def edit(x: np.ndarray, following: np.ndarray) -> np.ndarray:
    k = len(x) // 3
    return np.concatenate([x[: len(x) - k], following[:k]])


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of one sorted partition, ghosts (rows of other ranges) last within theirs: each with the one after it."""
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "same_edited", "same_next"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int64(), pa.int64()]
    last = None
    for b in batches:
        rows: list[tuple] = []
        for part, ghost, d, text in zip(*(column(b, c).to_pylist() for c in ("part", "ghost", "doc_id", "text"))):
            x = points(text)
            prefix = Prefix(x)
            own = fingerprint(prefix)
            if last is not None and last[0] == part and not last[4]:
                changed = edit(last[2], x)
                after = Prefix(changed)
                new = fingerprint(after)
                rows.append((last[1], len(last[2]), hashlib.sha256(changed.tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "surrogatepass")).hexdigest(), last[3][0], new[0], likeness(last[3], new), likeness(last[3], own), last[5].extension(0, after, 0), last[5].extension(0, prefix, 0)))
            last = (part, d, x, own, ghost, prefix)
        cols = list(zip(*rows)) or [()] * 9
        yield pa.record_batch([pa.array(c, k) for c, k in zip(cols, kinds)], names)


def edited(docs: DataFrame, ranges: int | None = None) -> DataFrame:
    """One row for each document: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, and
    same_edited, same_next: from the start, the code points in common with the edited text and with the next document."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    n = ranges or max(1, partitions(spark))
    cuts = sorted(set(rows.where("doc_id is not null").agg(F.percentile_approx("doc_id", [k / n for k in range(1, n)] or [0.5], 10_000)).first()[0] or []))
    # Descending order: part 0 has the largest ids, the last part the nulls and the ids up to the first cut.
    at = F.lit(0)
    number = F.array_size(F.filter(F.lit(cuts), lambda c: c >= F.col("doc_id"))) if cuts else at
    part = F.when(F.col("doc_id").isNull(), F.lit(len(cuts))).otherwise(number).cast("int")
    placed = rows.withColumn("part", part)
    order = F.struct(F.col("doc_id").isNull().alias("a"), F.bitwise_not("doc_id").alias("b"))
    # One entry for each range that has rows: their number is bounded by that of the cuts.
    heads = sorted((r[0], r[1]) for r in placed.groupBy("part").agg(F.min(order).getField("b").alias("b")).select("part", F.bitwise_not("b").alias("head")).collect())
    if not heads:
        return rows.mapInArrow(_pairs_empty, SCHEMA)
    before = {p: heads[i - 1][0] for i, (p, _) in enumerate(heads)}
    head = dict(heads)
    # One list of the ranges' first ids and one of the ranges before them; a range without rows isn't asked for.
    kind = "array<long>"
    of = lambda x: F.get(F.lit([x.get(p) for p in range(len(cuts) + 1)]).cast(kind) if any(v is not None for v in x.values()) else F.array_repeat(F.lit(None).cast("long"), len(cuts) + 1), F.col("part"))
    target = F.when(F.col("doc_id").eqNullSafe(of(head)), of(before).cast("int"))
    both = placed.withColumn("to", F.filter(F.array(F.struct(F.col("part").alias("part"), F.lit(False).alias("ghost")), F.struct(target.alias("part"), F.lit(True).alias("ghost"))), lambda s: s["part"].isNotNull()))
    sent = both.select(F.explode("to").alias("to"), "doc_id", "text").select("to.part", "to.ghost", "doc_id", "text")
    moved = sent.repartitionById(len(cuts) + 1, "part")
    return moved.sortWithinPartitions("part", "ghost", F.desc_nulls_last("doc_id"), "text").mapInArrow(_pairs, SCHEMA)


SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, same_edited long, same_next long"


def _pairs_empty(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return iter(())
