"""Language identification by cross-parsing entropy.

For each language a suffix automaton of labelled text recognises all its
substrings. A text is parsed greedily against it: the longest match is one phrase,
then parsing goes on behind it. The language that needs the fewest phrases per
character wins (cross-parsing, an estimate of cross entropy).

Training reads a bounded sample: of each label at most ``SAMPLE_CHARS`` characters,
from documents in the order of a hash of their text, each document giving at most
``PIECE_CHARS``. Only this bounded sample reaches the driver, and the automata's
size follows from it: below 2 * SAMPLE_CHARS * (4 * DENSE + 36) bytes for a language,
which bounds their broadcast.

Each label has an alphabet of its own, of all symbols of its sample. Transitions by its
``DENSE`` - 2 most frequent symbols are a table, the others (nearly all of them in
scripts of many characters) a sorted list; a symbol that the sample lacks is a phrase of
its own.

Prediction covers whole texts, in one parse each. Blocks of ``BLOCK`` characters are
parsed side by side, as numpy vectors, each from its start. Behind the end of a block its
parse goes on into the next one until both begin a phrase at the same place; from there
on they agree, so the phrases before that place come from the one and those behind it
from the other. The count is that of an unbroken parse, whatever BLOCK is.

Letters are lower-cased; runs of anything else count as one blank, and so do words that
hold a digit (unless there are no others). A text that is null or has no letters gives ``und`` and score 0, as does
every text if nothing was learned; equal phrase counts go to the alphabetically first
label. The score is 1 - best / second best (with one label: 1). ``least`` says for texts
of so many letters how many letters a phrase of a text in one of the languages has at
least: it comes from pieces of the sample, parsed by automata of the other pieces. Other
columns pass through ``scan`` unchanged, whatever their names; rows repeat as they come.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import added, column, lean, text_of, whole

SAMPLE_CHARS = 16_384
PIECE_CHARS = 512
#: Symbols of a label that have a column in its table, with the two for symbols outside of it.
DENSE = 64
RARE, NONE = DENSE - 2, DENSE - 1
BLOCK = 4096
#: Characters that are parsed at a time, and blocks that advance in step.
CHARS, STEP = 1 << 20, 512
#: Of the letters a phrase that held-back pieces have at the least.
MARGIN = 0.7
UNKNOWN = "und"


def _letters() -> np.ndarray:
    """For every code point its lower case, 1 for digits, 32 for what is neither."""
    low = np.full(0x110000, 32, np.int32)
    for c in range(0x110000):
        kind = unicodedata.category(chr(c))[0]
        if kind in "LM":
            low[c] = ord(chr(c).lower()[0])
        elif kind == "N":
            low[c] = 1
    return low


_low: list[np.ndarray] = []


def normal(text: str) -> np.ndarray:
    """Code points of the text, lower-cased, with one blank for each run of other characters and words with digits."""
    if not _low:
        _low.append(_letters())
    x = _low[0][np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]
    gap = x == 32
    if (digit := x == 1).any():
        word = np.cumsum(gap)
        all_gap = gap | (np.bincount(word, digit) > 0)[word]
        # A text of such words alone is read without its digits.
        gap = gap | digit if all_gap.all() else all_gap
        x[gap] = 32
    return x[~(gap & np.concatenate([[False], gap[:-1]]))] if len(x) else x


class Automaton:
    """Transitions of the suffix automaton of a symbol sequence, by state; state 0 is the start."""

    def __init__(self, symbols: list[int]):
        move: list[dict[int, int]] = [{}]
        link, length, last = [-1], [0], 0
        for c in symbols:
            new = len(move)
            move.append({})
            length.append(length[last] + 1)
            link.append(0)
            p = last
            while p >= 0 and c not in move[p]:
                move[p][c] = new
                p = link[p]
            if p >= 0:
                q = move[p][c]
                if length[p] + 1 == length[q]:
                    link[new] = q
                else:
                    copy = len(move)
                    move.append(dict(move[q]))
                    length.append(length[p] + 1)
                    link.append(link[q])
                    while p >= 0 and move[p].get(c) == q:
                        move[p][c] = copy
                        p = link[p]
                    link[q] = link[new] = copy
            last = new
        self.move = move


class Model:
    """An automaton for each label."""

    def __init__(self, samples: dict[str, list[str]], judge: bool = True):
        pieces = {k: [np.concatenate([normal(t), [32]]) for t in v] for k, v in sorted(samples.items()) if v}
        self.labels = sorted(pieces)
        texts = {k: np.concatenate(v) for k, v in pieces.items()}
        points = np.unique(np.concatenate(list(texts.values()))) if texts else np.zeros(0, np.int32)
        #: Code points of any label; the place behind the last is that of all others.
        self.points = points.astype(np.int32)
        self.maps = np.full((len(self.labels), len(points) + 1), NONE, np.uint8)
        tables, keys, to = [], [], []
        at = 0
        for i, k in enumerate(self.labels):
            x = np.searchsorted(points, texts[k])
            move = Automaton(x.tolist()).move
            own, count = np.unique(x, return_counts=True)
            self.maps[i, own] = RARE
            own = own[np.argsort(-count, kind="stable")][:RARE]
            self.maps[i, own] = np.arange(len(own))
            table = np.full((len(move), DENSE), -1, np.int32)
            for s, m in enumerate(move):
                for c, t in m.items():
                    if (d := self.maps[i, c]) < RARE:
                        table[s, d] = (at + t) * DENSE
                    else:
                        keys.append(((at + s) * DENSE << 21) | c)
                        to.append((at + t) * DENSE)
            tables.append(table)
            at += len(move)
        self.root = (np.cumsum([0, *(len(t) for t in tables)])[:-1] * DENSE).astype(np.int32)
        #: State and transition are offsets into one table; the sorted list has (state, symbol) of the others.
        self.table = np.concatenate(tables).ravel() if tables else np.zeros(0, np.int32)
        order = np.argsort(np.array(keys, np.int64), kind="stable")
        self.keys, self.to = np.array(keys, np.int64)[order], np.array(to, np.int32)[order]
        self.least = self._judge(pieces) if judge else np.zeros(0)

    def _judge(self, pieces: dict[str, list[np.ndarray]]) -> np.ndarray:
        """By powers of two of letters: the least letters a phrase that texts in a learned language have."""
        out = np.full(10, np.inf)
        if all(len(v) < 2 for v in pieces.values()):
            return np.zeros(10)
        as_text = lambda x: "".join(map(chr, x.tolist()))
        for fold in range(2):
            other = Model({k: [as_text(x) for x in v[1 - fold :: 2]] for k, v in pieces.items()}, judge=False)
            for e in range(10):
                cut = [as_text(x[: 2**e]) for v in pieces.values() for x in v[fold::2]]
                count, letters = other.phrases(cut)
                ok = letters > 0
                if ok.any() and count.shape[1]:
                    out[e] = min(out[e], (letters[ok] / count[ok].min(1)).min())
        # More letters say more: a longer text is not let off more easily than a shorter one.
        return np.maximum.accumulate(np.where(np.isfinite(out), out, 0) * MARGIN)

    def foreign(self, letters: np.ndarray, phrases: np.ndarray) -> np.ndarray:
        """Whether texts of so many letters and phrases are in none of the languages."""
        if not len(self.least):
            return np.zeros(len(letters), bool)
        e = np.minimum(np.log2(np.maximum(letters, 1)).astype(int), len(self.least) - 1)
        return (letters > 0) & (letters < self.least[e] * phrases)

    def _rare(self, state: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        """Transitions by symbols outside of the table; -1 for none."""
        if not len(self.keys):
            return np.full(len(state), -1, np.int32)
        key = state.astype(np.int64) << 21 | symbol
        at = np.searchsorted(self.keys, key)
        at[at == len(self.keys)] = 0
        return np.where(self.keys[at] == key, self.to[at], -1).astype(np.int32)

    def _next(self, label: int, state: int, symbol: int) -> int:
        d = int(self.maps[label, symbol])
        return int(self.table[state + d]) if d != RARE else int(self._rare(np.array([state]), np.array([symbol]))[0])

    def phrases(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(phrases of each text by label, letters of each text)."""
        count = np.zeros((len(texts), len(self.labels)), np.int64)
        letters = np.zeros(len(texts), np.int64)
        owner, blocks = [], []
        for i, t in enumerate(texts):
            x = normal(t)
            letters[i] = int((x != 32).sum())
            if letters[i] and self.labels:
                x = self.symbols(x)
                for k in range(0, len(x), BLOCK):
                    owner.append(i)
                    blocks.append(x[k : k + BLOCK])
        if not blocks:
            return count, letters
        own = np.array(owner)
        many = np.bincount(own, minlength=len(texts)) > 1
        # Of blocks of texts of several: where phrases start, and the state behind the end.
        starts: dict[int, np.ndarray] = {}
        last: dict[int, np.ndarray] = {}
        order = np.argsort(-np.array([len(b) for b in blocks]), kind="stable")
        for s in range(0, len(order), STEP):
            some = order[s : s + STEP]
            found, flags, state = self._parse([blocks[b] for b in some.tolist()], bool(many[own[some]].any()))
            one = ~many[own[some]]
            count[own[some[one]]] = found[:, one].T
            for j in np.flatnonzero(~one).tolist():
                b = int(some[j])
                starts[b], last[b] = flags[: len(blocks[b]), :, j].copy(), state[:, j].copy()
        first = np.searchsorted(own, np.arange(len(texts) + 1))
        for i in np.flatnonzero(many).tolist():
            for k in range(len(self.labels)):
                count[i, k] = self._joined(k, range(int(first[i]), int(first[i + 1])), blocks, starts, last)
        return count, letters

    def symbols(self, x: np.ndarray) -> np.ndarray:
        """Places of code points among those of the labels."""
        at = np.searchsorted(self.points, x)
        at[at == len(self.points)] = 0
        return np.where(self.points[at] == x, at, len(self.points)).astype(np.int32)

    def _parse(self, blocks: list[np.ndarray], keep: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(phrases by label, where they start if they are to be kept, last states) of blocks, the longest first."""
        n = np.array([len(b) for b in blocks])
        points = np.full((int(n[0]), len(blocks)), len(self.points), np.int32)
        for j, b in enumerate(blocks):
            points[: n[j], j] = b
        symbol = self.maps[:, points]
        step, label, lane = np.nonzero((symbol == RARE).transpose(1, 0, 2))
        rare = np.searchsorted(step, np.arange(len(points) + 1)).tolist()
        live = np.searchsorted(-n, -np.arange(1, n[0] + 1), "right")
        root = self.root[:, None]
        state = np.repeat(root, len(blocks), 1)
        found = np.zeros(state.shape, np.int32)
        flags = np.zeros((len(points), *state.shape) if keep else (0, *state.shape), bool)
        for k, m in enumerate(live.tolist()):
            c, now = symbol[:, k, :m], state[:, :m]
            to, again = self.table[now + c], self.table[root + c]
            if rare[k] < rare[k + 1]:
                i, j = label[rare[k] : rare[k + 1]], lane[rare[k] : rare[k + 1]]
                ok = j < m
                i, j = i[ok], j[ok]
                to[i, j], again[i, j] = self._rare(now[i, j], points[k, j]), self._rare(self.root[i], points[k, j])
            # A phrase begins here if the last one can't go on, or if this is the start, or behind a symbol that the label
            # lacks, which is a phrase of its own.
            miss = to < 0
            start = miss | (now == root)
            found[:, :m] += start
            if keep:
                flags[k, :, :m] = start
            state[:, :m] = np.where(miss, np.maximum(again, root), to)
        return found, flags, state

    def _joined(self, label: int, of: range, blocks: list[np.ndarray], starts: dict[int, np.ndarray], last: dict[int, np.ndarray]) -> int:
        """Phrases of a text of several blocks."""
        root, total, b, begin = int(self.root[label]), 0, of[0], 0
        while True:
            total += int(starts[b][begin:, label].sum())
            state, b, met = int(last[b][label]), b + 1, False
            while b < of.stop and not met:
                for p in range(len(blocks[b])):
                    to = self._next(label, state, int(blocks[b][p]))
                    start = to < 0 or state == root
                    met = start and bool(starts[b][p, label])
                    if met:
                        begin = p
                        break
                    total += start
                    state = max(self._next(label, root, int(blocks[b][p])), root) if to < 0 else to
                else:
                    b += 1
            if not met:
                return total

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
        """(label, score, phrases of the best label, letters) of each text, about CHARS characters at a time."""
        cut = np.cumsum([len(t) for t in texts]) // CHARS
        edges = [*np.searchsorted(cut, np.unique(cut)).tolist(), len(texts)]
        counts = [self.phrases(texts[a:b]) for a, b in zip(edges, edges[1:])]
        count = np.concatenate([np.zeros((0, len(self.labels)), np.int64), *(c for c, _ in counts)])
        letters = np.concatenate([np.zeros(0, np.int64), *(n for _, n in counts)])
        score, known = np.zeros(len(texts)), (letters > 0) & bool(self.labels)
        if not self.labels:
            return [UNKNOWN] * len(texts), score, np.zeros(len(texts), np.int64), letters
        two = np.sort(count, 1)
        score[known] = 1.0 if len(self.labels) == 1 else 1 - two[known, 0] / two[known, 1]
        return [self.labels[b] if k else UNKNOWN for b, k in zip(count.argmin(1).tolist(), known.tolist())], score, two[:, 0], letters


def _sample(per_task: int) -> Callable:
    """Of the rows of a task, for each label the first per_task by rank."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[tuple[int, str]]] = {}
        for b in batches:
            for lang, rank, text in zip(column(b, "lang").to_pylist(), column(b, "rank").to_pylist(), column(b, "text").to_pylist()):
                held.setdefault(lang, []).append((rank, text))
            # Copies of a text have one rank, and count once.
            held = {lang: sorted(dict(x).items())[:per_task] for lang, x in held.items()}
        rows = [(lang, rank, text) for lang, x in held.items() for rank, text in x]
        yield pa.record_batch([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.string())], ["lang", "rank", "text"])

    return run


def train(labelled: DataFrame, chars: int = SAMPLE_CHARS) -> Model:
    """Learn from (text, lang), rows without either left out: of each label at most chars characters.

    Tasks keep at most chars / PIECE_CHARS pieces of a label, so what they send doesn't follow the input."""
    most = max(1, chars // PIECE_CHARS)
    rows = labelled.where("text is not null and lang is not null").select(F.col("lang").cast("string").alias("lang"), F.xxhash64("text").alias("rank"), F.col("text").cast("string").alias("text"))
    # A piece from within the text, at a place that its hash chooses.
    rows = rows.select("lang", "rank", F.expr("substring(text, cast(pmod(rank, greatest(length(text) - %d, 0) + 1) as int) + 1, %d)" % (PIECE_CHARS, PIECE_CHARS)).alias("text"))
    first = rows.mapInArrow(_sample(most), "lang string, rank long, text string")
    last = first.repartition("lang").mapInArrow(_sample(most), "lang string, rank long, text string")
    samples: dict[str, list[str]] = {}
    for r in last.orderBy("lang", "rank", "text").collect():
        samples.setdefault(r["lang"], []).append(r["text"])
    return Model(samples)


def scan(docs: DataFrame, model: Model) -> DataFrame:
    """doc (the whole row), lang_pred, score, phrases (of the predicted language), letters, and foreign: in no learned language."""
    # The model goes with the function: what is broadcast would stay with the workers after the stage.
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            pred, score, phrases, letters = model.predict([t or "" for t in text_of(b).to_pylist()])
            yield pa.record_batch([b.column(0), pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(phrases, pa.int64()), pa.array(letters, pa.int64()), pa.array(model.foreign(letters, phrases))], ["doc", "lang_pred", "score", "phrases", "letters", "foreign"])

    return whole(docs).mapInArrow(lean(run), added(docs, "lang_pred string, score double, phrases long, letters long, foreign boolean"))


def fold() -> F.Column:
    """The fold of a document: crc32 of its id as text, modulo 4."""
    return F.crc32(F.col("doc_id").cast("string")) % 4


def identify(docs: DataFrame) -> DataFrame:
    """One row for each document: doc_id, held_out, lang_pred, score. Fold 2 is held out of training."""
    held = F.coalesce(fold() == 2, F.lit(False))
    model = train(docs.where(~held).select("text", "lang"))
    return scan(docs.select("doc_id", held.alias("held_out"), F.col("text").cast("string").alias("text")), model).select("doc.doc_id", "doc.held_out", "lang_pred", "score")
