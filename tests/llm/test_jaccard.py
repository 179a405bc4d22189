import random
import re
import time
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from blobloom.llm import common, jaccard
from blobloom.llm.common import prepare

DOCS = "doc_id long, text string, lang string, digest string, bucket int"


def brute(rows):
    sets = []
    for _, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))
        sets.append({tuple(w[i : i + 2]) for i in range(len(w) - 1)} if len(w) > 1 else {tuple(w)} if w else set())
    n = len(rows)
    link = [[j for j in range(n) if j != i and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 60 * len(sets[i] | sets[j])] for i in range(n)]
    out = []
    for i in range(n):
        seen, todo = {i}, [i]
        while todo:
            for j in link[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        ids = [rows[j][0] for j in seen if rows[j][0] is not None]
        out.append((rows[i][0], len(sets[i]), len(link[i]), min(ids) if ids else None))
    return sorted(out, key=str)


def run(spark, rows, **kw):
    df = prepare(spark).createDataFrame([(d, t, "en", "x", 1) for d, t in rows], DOCS)
    return sorted(((r.doc_id, r.n_shingles, r.n_similar, r.component_id) for r in jaccard.near_duplicates(df, **kw).collect()), key=str)


def fixture():
    rng = random.Random(5)
    vocab = [f"w{i}" for i in range(60)]
    rows = [(0, None), (1, ""), (2, "  \t\n"), (3, "one"), (4, "ONE"), (5, "one two"), (6, "One  Two"), (7, "two one"), (8, "é É"), (9, "É é")]
    for size in (3, 4, 5, 7, 10, 16, 30, 60, 200):
        for _ in range(4):
            base = [rng.choice(vocab) for _ in range(size)]
            for _ in range(5):
                w = list(base)
                for _ in range(rng.randrange(0, 1 + size // 4)):
                    w[rng.randrange(len(w))] = rng.choice(vocab)
                rows.append((len(rows), " ".join(w)))
    return rows + [(500, "x y " * 5000), (501, "x y " * 4000)]


def test_matches_brute_force(spark):
    rows = fixture()
    assert run(spark, rows) == brute(rows)


@pytest.mark.parametrize("small, fragment", [(0, 2), (24, 2), (6, 4096), (64, 1)])
def test_boundary_and_fragments_change_nothing(spark, monkeypatch, small, fragment):
    monkeypatch.setattr(jaccard, "boundary", lambda *a: small)
    monkeypatch.setattr(jaccard, "FRAGMENT", fragment)
    monkeypatch.setattr(jaccard, "LIGHT", 1e-9 if fragment == 2 else 1e9)
    rows = fixture()
    assert run(spark, rows) == brute(rows)


@pytest.mark.parametrize("long", [2, 9])
def test_long_lists_are_cut(spark, long):
    rows = fixture()
    assert run(spark, rows, long=long) == brute(rows)


def test_merging_runs():
    runs = []
    rng = random.Random(1)
    total = {}
    for _ in range(60):
        x = sorted({rng.randrange(500) for _ in range(rng.randrange(1, 40))})
        jaccard._gather(runs, (np.array(x), np.ones(len(x), np.int64), np.array(x, np.uint32)))
        for v in x:
            total[v] = total.get(v, 0) + 1
    while len(runs) > 1:
        b, a = runs.pop(), runs.pop()
        runs.append(jaccard._merged(a, b))
    pair, count, where = runs[0]
    assert dict(zip(pair.tolist(), count.tolist())) == total and where.tolist() == pair.tolist()


def test_repeated_rows_and_null_ids(spark):
    rows = [(7, "a b c d e f"), (7, "a b c d e f"), (None, "a b c d e f"), (None, "p q r s t u v w"), (None, "p q r s t u v x"), (3, "zz")]
    assert run(spark, rows) == brute(rows)


def test_empty(spark):
    assert run(spark, []) == []


def test_boundary_has_the_fewest_keys():
    assert jaccard.boundary([(10, 100)]) == 0
    assert all(jaccard.matches(n, s) >= jaccard.evidence(n) + max(jaccard.groups(n, s), jaccard.groups(m, s)) for s in (0, 24) for n in range(1, 700) for m in range((6 * n + 9) // 10, n * 10 // 6 + 1))


@pytest.mark.parametrize("turns", [2, 5])
def test_rounds_change_nothing(spark, turns):
    rows = fixture()
    assert run(spark, rows, turns=turns) == brute(rows)


def test_what_is_done_leaves_the_disk(spark, tmp_path, monkeypatch):
    shuffles = lambda: {f.getName() for f in spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()) if f.getName().startswith("shuffle_")}
    monkeypatch.setattr(common, "shared_dir", lambda _: f"file://{tmp_path}")
    marked, old = jaccard._marked, set()
    monkeypatch.setattr(jaccard, "_marked", lambda rep: old.update(shuffles()) or marked(rep))
    df = prepare(spark).createDataFrame([(d, t, "en", "x", 1) for d, t in fixture()], DOCS)
    jaccard.links(df)
    assert {p.name.split("-")[0] for p in tmp_path.glob("*/*")} == {"shingles", "links"}
    # Of what was shuffled before sets were sent nothing is left.
    end = time.time() + 10
    while shuffles() & old and time.time() < end:
        time.sleep(0.2)
    assert old and not shuffles() & old


def test_postings_are_packed():
    # Smaller than as plain columns: 26 bytes for each set in a bucket, 4 for each key.
    rng = np.random.default_rng(5)
    texts = [" ".join(map(str, rng.integers(0, 3000, 120))) for _ in range(300)]
    none = jaccard.Table(np.zeros(0, np.uint64), np.zeros(0, np.int64))
    # Among so many words all shingles are light, so they are posted by themselves.
    words = jaccard.Table(np.ones(1, np.uint64), np.full(1, 1 << 40))
    found = list(jaccard._postings(words, none, 20, 40)(iter([pa.record_batch([pa.array(texts)], ["text"])])))
    sets, _ = jaccard.shingle_sets(*jaccard.tv.buffers(pa.array(texts)))
    posted = [len(s) - int(jaccard.required(len(s))) + jaccard.matches(len(s), 20) for s in sets]
    # With keys spread evenly, a set of p keys is in 40 * (1 - (1 - 1 / 40) ** p) buckets.
    plain = sum(26 * 40 * (1 - (1 - 1 / 40) ** p) + 4 * p for p in posted)
    size = sum(b.nbytes for b in found)
    assert size < 0.95 * plain, (size, plain)


@pytest.mark.parametrize("each", [50, 9000, 10**9])
def test_pairs_of_a_bucket_are_made_a_part_at_a_time(monkeypatch, each):
    """All classes of a bucket share three keys: each pair comes once, with all that it shares, however few are made at a time."""
    m = 150
    monkeypatch.setattr(jaccard, "PAIRS", each)
    monkeypatch.setattr(jaccard, "SENT", 500)
    ids = np.sort(np.random.default_rng(3).integers(-(2**62), 2**62, m)).astype(np.int64)
    head = np.full(m * jaccard.HEADS, 2**32 - 1, np.uint32), np.full(m * jaccard.HEADS, 2**16 - 1, np.uint16)
    fields = (np.diff(ids.view(np.uint64), prepend=np.uint64(0)), np.full(m, 40, np.uint32), np.full(m, 3, np.uint32), *head, np.tile(np.array([5, 6, 9], np.uint32), m))
    batch = pa.record_batch([pa.array([2], pa.int32()), pa.array([common.squeeze(*(p for v in fields for p in jaccard._planes(v)))], pa.binary())], ["bucket", "data"])
    made = [b for b in jaccard._candidates(16, 4000)((pa.scalar(2),), iter([batch])) if b.num_rows]
    assert max(b.num_rows for b in made) <= 500
    rows = pa.Table.from_batches(made).to_pylist()
    assert {(r["shared"], r["need"]) for r in rows} == {(3, jaccard.evidence(40))}
    assert sorted((r["a"], r["b"]) for r in rows) == [(int(ids[i]), int(ids[j])) for i in range(m) for j in range(i + 1, m)]


def test_memory_of_a_bucket_is_bounded(monkeypatch):
    peaks = []
    for m in (1000, 3000):
        monkeypatch.setattr(jaccard, "PAIRS", 20_000)
        steps = np.full(m, 7, np.uint64)
        head = np.full(m * jaccard.HEADS, 2**32 - 1, np.uint32), np.full(m * jaccard.HEADS, 2**16 - 1, np.uint16)
        planes = [p for v in (steps, np.full(m, 40, np.uint32), np.full(m, 1, np.uint32), *head, np.full(m, 5, np.uint32)) for p in jaccard._planes(v)]
        batch = pa.record_batch([pa.array([2], pa.int32()), pa.array([common.squeeze(*planes)], pa.binary())], ["bucket", "data"])
        tracemalloc.start()
        n = sum(b.num_rows for b in jaccard._candidates(16, 4000)((pa.scalar(2),), iter([batch])))
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
        assert n == m * (m - 1) // 2
    # Nine times the pairs of three times the classes.
    assert peaks[1] < 3 * peaks[0]
