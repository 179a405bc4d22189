"""Mixing sources to target weights by soft domain membership.

A classifier, trained on the labelled table, gives each document's posterior over
the domains ``good``, ``poor`` (quality 0) and ``toxic``. Projected-gradient least
squares then fits nonnegative document rates: the expected tokens of each domain,
sum over documents of rate * tokens * posterior, shall match its target, while
rates stay as near to 1 as that allows. The objective is

    1/2 sum_k ((total_k - target_k) / N)^2 + ridge/2 sum_i n_i/N (rate_i - 1)^2

with N all tokens. In the metric weighted by n_i the gradient for a document is
p_i . e + ridge (rate_i - 1), where e are the domains' relative errors, so a projected
gradient step of length 1 / ridge takes any rate to max(0, 1 - p_i . e / ridge). A plain
step of that length overshoots; each iteration therefore takes it with errors that are
carried on by the curvature of the documents with a positive rate (a matrix of the size
of the domains), halved back while the fixed point is missed by more than before. Every
document has a rate of its own, from its unrounded posterior. An iteration is one
distributed aggregation over the table of posteriors and tokens; only its few sums reach
the driver, and only the last errors are needed to give every document its rate. Some
ten iterations end where totals are within ``TOLERANCE`` of N of the fixed point.

Features of a text, all of them from the whole text: which words occur, and which
beginnings of four bytes, hashed to 2**``BITS`` places, and eight measures of form
(shares of punctuation, digits, capitals, distinct words, and the like). Softmax
regression learns from at most ``LABELLED`` labelled documents, first by a hash of
the id; their ids are broadcast, which that bounds.

Labels: rows with a null id, quality or toxic are left out; if a document has
several, the lowest quality and the highest toxic count. Without any label every
document is ``good``. Null or empty text: 0 tokens, its posterior is that of the
features of an empty text, and it has the rate of that posterior. ``copies`` rounds
the rate: to the whole number within ``SNAP`` of it, so that documents which are nearly
certain to be of a domain share its fate, and else with the fraction of a hash of id and
text; equal rows round alike.
Rows repeat as they come; an empty table gives no rows; other columns pass through, whatever
their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textvec as tv
from .common import added, column, lean, text_of, whole, written

DOMAINS = ("good", "poor", "toxic")
LABELLED = 6000
BITS = 16
FORMS = 8
#: The value of a feature that occurs.
PRESENT = np.float32(0.3)
SIGNAL = 4
RIDGE = 0.002
TOLERANCE = 1e-6
SNAP = 0.15
ROUNDS = 50
#: Gradient steps of the classifier at least.
STEPS = 1500
U64 = np.uint64
_PUNCT = np.zeros(256, bool)
_PUNCT[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True


def features(data: np.ndarray, offs: np.ndarray) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """(distinct feature places, measures of form, tokens) of each text."""
    places: list[np.ndarray] = []
    forms, counts = [], []
    for i, j in tv.pieces(offs, 1_000_000):
        part, o = data[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
        s, e, first = tv.spans(part, o, tv.ALNUM_WORDS)
        h = tv.hash_spans(part, s, e)
        stem = tv.mix(tv.hash_spans(part, s, np.minimum(e, s + 4)) + U64(7))
        mask = U64((1 << BITS) - 1)
        both = np.stack([h & mask, stem & mask], 1).astype(np.int32)
        ws, _, wf = tv.spans(part, o, tv.SPACE_WORDS)
        run = lambda flag: np.diff(np.concatenate([[0], np.cumsum(flag)])[o])
        size = np.maximum(np.diff(o), 1)
        same = np.zeros(len(h), bool)
        same[1:] = h[1:] == h[:-1]
        same = np.diff(np.concatenate([[0], np.cumsum(same)])[first])
        n = np.diff(wf)
        words = np.maximum(np.diff(first), 1)
        distinct = np.zeros(j - i)
        for k, (a, b) in enumerate(zip(first[:-1].tolist(), first[1:].tolist())):
            x = np.unique(both[a:b])
            places.append(x)
            distinct[k] = min(1.0, len(x) / max(1, 2 * (b - a)))
        forms.append(np.stack([run(_PUNCT[part]) / size, run(_DIGIT[part]) / size, run(_UPPER[part]) / size, distinct, same / words, np.diff(first) / np.maximum(n, 1) - 1, np.log1p(n) / 10, np.ones(j - i)], 1))
        counts.append(n)
        del ws
    return places, np.concatenate(forms) if forms else np.zeros((0, FORMS)), np.concatenate(counts) if counts else np.zeros(0, np.int64)


class Classifier:
    """Softmax regression over hashed features."""

    def __init__(self) -> None:
        self.w = np.zeros(((1 << BITS) + FORMS, len(DOMAINS)), np.float32)
        self.scale = np.ones(FORMS, np.float32)

    def fit(self, places: list[np.ndarray], forms: np.ndarray, y: np.ndarray, epochs: int = 10, least: int = STEPS, rate: float = 0.1, decay: float = 3e-4) -> None:
        """AdaGrad on mini-batches. Learned are features of 5 or more documents that occur in a domain's documents more often or
        less often than chance explains (by ``SIGNAL`` standard deviations); the others would add noise by the hundred."""
        if not len(y):
            self.w[-1, 0] = 20.0
            return
        self.scale = (1 / np.maximum(forms.std(0), 1e-3)).astype(np.float32)
        df = np.bincount(np.concatenate(places), minlength=1 << BITS)
        part = np.bincount(y, minlength=len(DOMAINS)) / len(y)
        told = np.zeros(1 << BITS, bool)
        for k in range(len(DOMAINS)):
            own = np.bincount(np.concatenate([np.zeros(0, np.int32), *(p for p, v in zip(places, y) if v == k)]), minlength=1 << BITS)
            told |= np.abs(own - df * part[k]) > SIGNAL * np.sqrt(np.maximum(df * part[k] * (1 - part[k]), 1e-9))
        told &= df > 4
        rng, square = np.random.default_rng(5), np.full_like(self.w, 1e-4)
        rows = [np.concatenate([p[told[p]], (1 << BITS) + np.arange(FORMS)]) for p in places]
        values = [np.concatenate([np.full(len(r) - FORMS, PRESENT, np.float32), f * self.scale]).astype(np.float32) for r, f in zip(rows, forms)]
        for _ in range(max(epochs, -(-least * 32 // len(y)))):
            order = rng.permutation(len(y))
            for s in range(0, len(y), 32):
                b = order[s : s + 32]
                idx, val = np.concatenate([rows[i] for i in b]), np.concatenate([values[i] for i in b])
                owner = np.repeat(np.arange(len(b)), [len(rows[i]) for i in b])
                z = np.zeros((len(b), len(DOMAINS)), np.float32)
                np.add.at(z, owner, self.w[idx] * val[:, None])
                p = np.exp(z - z.max(1, keepdims=True))
                p /= p.sum(1, keepdims=True)
                p[np.arange(len(b)), y[b]] -= 1
                uniq, inv = np.unique(idx, return_inverse=True)
                g = np.zeros((len(uniq), len(DOMAINS)), np.float32)
                np.add.at(g, inv, p[owner] * val[:, None])
                g = g / len(b) + decay * self.w[uniq]
                square[uniq] += g * g
                self.w[uniq] -= rate * g / np.sqrt(square[uniq])

    def posteriors(self, places: list[np.ndarray], forms: np.ndarray) -> np.ndarray:
        """Each row sums to 1; equal texts have equal ones, whatever else is in a batch."""
        z = (forms.astype(np.float32) * self.scale)[:, :, None] * self.w[None, 1 << BITS :]
        z = z.sum(1, dtype=np.float64)
        for i, p in enumerate(places):
            if len(p):
                z[i] += self.w[p].sum(0, dtype=np.float64) * PRESENT
        p = np.exp(z - z.max(1, keepdims=True)) if len(z) else z
        return p / p.sum(1, keepdims=True) if len(z) else p


def train(docs: DataFrame, labels: DataFrame, most: int = LABELLED) -> Classifier:
    """Learn the domains of the labelled documents."""
    one = labels.where("doc_id is not null and quality is not null and toxic is not null").groupBy("doc_id").agg(F.min("quality").alias("__q"), F.max("toxic").alias("__t"))
    # At most `most` rows, so their broadcast is bounded.
    some = one.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(some), "doc_id").select("text", F.when(F.col("__t") > 0, 2).when(F.col("__q") < 1, 1).otherwise(0).alias("y"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            places, forms, _ = features(*tv.buffers(column(b, "text")))
            yield pa.record_batch([pa.array([p.astype(np.int32).tobytes() for p in places], pa.binary()), pa.array([f.astype(np.float64).tobytes() for f in forms], pa.binary()), column(b, "y")], ["places", "forms", "y"])

    got = texts.mapInArrow(run, "places binary, forms binary, y int").orderBy(F.xxhash64("places", "forms"), "places", "y").limit(2 * most).toArrow()
    model = Classifier()
    model.fit([np.frombuffer(x, np.int32) for x in got["places"].to_pylist()], np.array([np.frombuffer(x, np.float64) for x in got["forms"].to_pylist()]).reshape(-1, FORMS), np.array(got["y"].to_pylist(), np.int64))
    return model


def membership(docs: DataFrame, model: Classifier) -> DataFrame:
    """doc (the whole row), n_tokens (words between white space) and p (the posterior, by domain)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            places, forms, n = features(*tv.buffers(text_of(b)))
            p = shared.value.posteriors(places, forms)
            offs = np.arange(0, p.size + 1, len(DOMAINS), dtype=np.int32) if b.num_rows else np.zeros(1, np.int32)
            yield pa.record_batch([b.column(0), pa.array(n.astype(np.int64)), pa.ListArray.from_arrays(offs, p.ravel())], ["doc", "n_tokens", "p"])

    return whole(docs).mapInArrow(lean(run), added(docs, "n_tokens long, p array<double>"))


def rate(errors: np.ndarray, ridge: float) -> F.Column:
    """What a projected-gradient step of length 1 / ridge makes of a rate."""
    push = sum((F.col("p")[k] * F.lit(float(e)) for k, e in enumerate(errors)), F.lit(0.0))
    return F.greatest(F.lit(0.0), 1 - push / F.lit(ridge))


def fit(members: DataFrame, shares: dict[str, float], relative: bool = False, ridge: float = RIDGE, tolerance: float = TOLERANCE, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(errors, totals, targets) for rows (p, n_tokens). shares: targets as parts of all tokens; relative: of what the
    domain has at rate 1."""
    k = len(DOMAINS)
    upper = [(i, j) for i in range(k) for j in range(i, k)]

    def sums(errors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(tokens of each domain at the rates of these errors, curvature of the documents with a positive rate)."""
        x, n, p = F.col("x"), F.col("n_tokens").cast("double"), [F.col("p")[i] for i in range(k)]
        free = F.when(x > 0, n).otherwise(0.0)
        got = members.withColumn("x", rate(errors, ridge)).agg(*(F.coalesce(F.sum(x * n * q), F.lit(0.0)) for q in p), *(F.coalesce(F.sum(free * p[i] * p[j]), F.lit(0.0)) for i, j in upper)).first()
        curve = np.zeros((k, k))
        for (i, j), v in zip(upper, got[k:]):
            curve[i, j] = curve[j, i] = v
        return np.array(got[:k], float), curve

    errors = np.zeros(k)
    total, curve = sums(errors)
    every = float(total.sum())
    target = np.array([shares[d] for d in DOMAINS]) * (total if relative else every)
    if not every:
        return errors, total, target
    miss = (total - target) / every - errors
    for _ in range(rounds):
        if np.abs(miss).max() < tolerance:
            break
        # The errors at which the step would reproduce them, as far as the curvature holds.
        step = np.linalg.solve(np.eye(k) + curve / every / ridge, miss)
        while True:
            after, bend = sums(errors + step)
            left = (after - target) / every - errors - step
            if np.abs(left).sum() < np.abs(miss).sum() or np.abs(step).max() < tolerance * ridge:
                break
            step = step / 2
        errors, total, curve, miss = errors + step, after, bend, left
    return errors, total, target


def with_rates(docs: DataFrame, labels: DataFrame, shares: dict[str, float], keep: list[str], relative: bool = False, ridge: float = RIDGE) -> DataFrame:
    """doc (the columns keep of docs), n_tokens, p, rate and copies."""
    chance = F.pmod(F.xxhash64("doc.doc_id", "doc.text"), F.lit(1 << 20)) / float(1 << 20)
    members = written(membership(docs, train(docs, labels)).select(F.struct(*(F.col("doc")[c].alias(c) for c in keep)).alias("doc"), "n_tokens", "p", chance.alias("chance")), "membership")
    errors, _, _ = fit(members.select("p", "n_tokens"), shares, relative, ridge)
    x = rate(errors, ridge)
    copies = F.when(F.abs(x - F.round(x)) <= SNAP, F.round(x)).otherwise(F.floor(x + F.col("chance"))).cast("int")
    return members.select("doc", "n_tokens", "p", x.alias("rate"), copies.alias("copies"))


#: Production targets of op10, as parts of all tokens: all good ones and a little more, half of the poor, nearly nothing toxic.
SHARES = {"good": 0.92, "poor": 0.06, "toxic": 0.005}


def mixed(docs: DataFrame, labels: DataFrame, shares: dict[str, float] | None = None) -> DataFrame:
    """One row for each document: doc_id, n_tokens, p_good, p_poor, p_toxic, rate, copies."""
    out = with_rates(docs.select("doc_id", F.col("text").cast("string").alias("text")), labels, shares or SHARES, ["doc_id"])
    return out.select("doc.doc_id", "n_tokens", *(F.col("p")[k].alias(f"p_{d}") for k, d in enumerate(DOMAINS)), "rate", "copies")
