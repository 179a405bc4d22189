import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from blobloom.llm import scoring as sc
from blobloom.llm import textvec as tv
from blobloom.llm.common import prepare, squeeze, unsqueeze


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def held(i):
    return i is not None and zlib.crc32(str(i).encode()) % 7 == 2


def fixture():
    rng = random.Random(6)
    syll = ["the", "on", "er", "É", "ß", "qu", "9", "x!", "日"]
    rows = [(i, " ".join("".join(rng.choice(syll) for _ in range(rng.randrange(1, 3))) for _ in range(rng.randrange(0, 60)))) for i in range(150)]
    rows += [(i, "a long passage that is said " + rng.choice(["once", "twice"]) + " and then again") for i in range(300, 320)]
    return rows + [(200, None), (201, ""), (202, " \t "), (9, rows[9][1]), (None, "the The on"), (203, "theon er " * 3_000), (204, "a\x00b \x01")]


def number(w):
    return int(tv.hash_spans(np.frombuffer(w.encode(), np.uint8), np.array([0]), np.array([len(w.encode())]))[0]) if w else int(sc.END_HASH)


def slow_scores(rows, hot):
    """The model by its definition: (base, score, retained contexts)."""
    train = [[*words(t), ""] for i, t in rows if not held(i)]
    count = Counter(w for t in train for w in t)
    total, distinct = sum(count.values()), len(count)
    n1, n2 = (sum(n == k for n in count.values()) for k in (1, 2))
    d0 = n1 / (n1 + 2 * n2 + 1)
    root = lambda w: (count[w] - d0) / total if count[w] else d0 * distinct / total
    size = lambda w: count[""] if w is None else count[w]
    code = lambda w: int(sc.START_HASH) if w is None else number(w)

    def suffixes(x, i):
        one, two, three = ((x[i - k] if i >= k else None) for k in (1, 2, 3))
        if size(one) > hot:
            far = int(tv.mix(np.array([code(three)], np.uint64) + np.uint64(5))[0]) if size(two) > hot else 0
            kind = int(tv.mix(np.array([(code(two) + far) % 2**64], np.uint64))[0]) % -(-size(one) // hot)
            return (one, kind), (one, kind, two), (one, kind, two, three)
        return (one,), (one, None, two), (one, None, two, three)

    follow = defaultdict(Counter)
    for x in train:
        for i, w in enumerate(x):
            for s in suffixes(x, i):
                follow[s][w] += 1
    memo = {}

    def dist(s, parent):
        if s not in memo:
            c, n = follow[s], sum(follow[s].values())
            gain = sum(k * math.log(k / n / parent(w)) + math.log(parent(w)) for w, k in c.items())
            memo[s] = n >= 2 and gain > len(c) / 2 * math.log(n)
        if not memo[s]:
            return parent
        c, n = follow[s], sum(follow[s].values())
        return lambda w: (max(c[w] - sc.DISCOUNT, 0) + sc.DISCOUNT * len(c) * parent(w)) / n

    out = []
    for i, t in rows:
        x = [*words(t), ""]
        score = 0.0
        for k, w in enumerate(x):
            p = root
            for s in suffixes(x, k):
                p = dist(s, p)
            score += math.log10(p(w))
        out.append((i, held(i), len(x), sum(count[w] > 0 for w in x), total, round(sum(math.log10((count[w] + 1) / (total + distinct + 1)) for w in x), 5), score))
    return out, {s for s, ok in memo.items() if ok}


@pytest.mark.parametrize("hot", [sc.HOT, 40])
def test_matches_brute_force(spark, hot):
    rows = fixture()
    df = prepare(spark).createDataFrame([(i, t, 0.0) for i, t in rows], "doc_id long, text string, score double")
    got = sc.scores(df, hot=hot).collect()
    want, tree = slow_scores(rows, hot)
    key = lambda r: (str(r[0]), r[2])
    assert sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5)) for r in got), key=key) == sorted((x[:6] for x in want), key=key)
    for g, x in zip(sorted(got, key=lambda r: (str(r.doc_id), r.n_tokens)), sorted(want, key=key)):
        assert abs(g.score - x[6]) <= 1e-6 * (1 + x[2]), (g, x)
    kept = sc.tree(df, hot=hot).collect()
    assert {len(s) for s in tree} == ({1, 3, 4} if hot > 40 else {1, 2, 3, 4}) and len(kept) >= len(tree)
    assert {len(r.before) for r in kept} == {0, 1, 2}
    assert all(r.n >= 2 and 0 < r.followers <= r.n for r in kept)


def test_cuts_leave_scores(spark):
    # Neither the broadcast words nor the blocks change a score.
    rows = fixture()[:60] + [(300, "rareword " * 100)]
    df = prepare(spark).createDataFrame(rows, "doc_id long, text string")
    one = sorted(map(tuple, sc.scores(df).collect()))
    assert sorted(map(tuple, sc.scores(df.repartition(3), common=0).collect())) == one
    assert sorted(map(tuple, sc.scores(df, common=10, block=50).collect())) == one


def test_many_tiny_documents(spark):
    df = prepare(spark).range(40_000).selectExpr("id as doc_id", "cast(id % 3 as string) as text").coalesce(1)
    got = {(r.score, r.n_tokens) for r in sc.scores(df).collect()}
    assert len(got) == 3 and all(n == 2 for _, n in got)


def test_held_out_text_is_better_than_the_base(spark):
    rng = random.Random(2)
    phrases = [" ".join("".join(rng.choice("abcdefgh") for _ in range(4)) for _ in range(6)) for _ in range(200)]
    df = prepare(spark).createDataFrame([(i, " ".join(rng.choice(phrases) for _ in range(20))) for i in range(400)], "doc_id long, text string")
    out = [r for r in sc.scores(df).collect() if r.held_out]
    assert sum(r.score for r in out) > 0.6 * sum(r.base_score for r in out)


def test_twice_is_told_from_once(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(3))
    texts = [" ".join(word() for _ in range(80)) for _ in range(300)]
    rows = [(i, t) for i, t in enumerate([*texts, *texts[:40]]) if not held(i)]
    per = {r.doc_id: r.score / r.n_tokens for r in sc.scores(prepare(spark).createDataFrame(rows, "doc_id long, text string")).collect()}
    twice = {i for i, t in rows if sum(t == u for _, u in rows) > 1}
    assert min(per[i] for i in twice) > max(per[i] for i, _ in rows if i not in twice)


def test_empty_and_untrained(spark):
    df = prepare(spark).createDataFrame([], "doc_id long, text string")
    assert sc.scores(df).collect() == []
    only = next(i for i in range(100) if held(i))
    r = sc.scores(spark.createDataFrame([(only, "a b")], "doc_id long, text string")).collect()[0]
    assert (r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) == (3, 0, 0, 0.0, 0.0)


def test_squeezed_arrays():
    arrays = [np.arange(5, dtype=np.uint64), np.zeros(0, np.float32), np.array([True, False]), np.array([1.5])]
    for a, b in zip(arrays, unsqueeze(squeeze(*arrays))):
        assert a.dtype == b.dtype and a.tolist() == b.tolist()


def test_frequent_contexts_are_whole(spark):
    # Spread over buckets, down to contexts of three words and the starts, a model is the same: that of the definition.
    rows = fixture() + [(400 + i, "on the on the on the on er the") for i in range(60)]
    df = prepare(spark).createDataFrame([(i, t) for i, t in rows], "doc_id long, text string")
    key = lambda r: (str(r[0]), r[2])
    want, tree = slow_scores(rows, 1 << 60)
    kept = None
    for split, common in ((30, 1 << 19), (30, 0), (1 << 60, 1 << 19)):
        got = sorted(sc.scores(df, split=split, common=common).collect(), key=key)
        for g, x in zip(got, sorted(want, key=key), strict=True):
            assert abs(g.score - x[6]) <= 1e-6 * (1 + x[2]), (split, common, g, x)
        if common:
            found = sorted((r.context, tuple(r.before), r.n, r.followers) for r in sc.tree(df, split=split).collect())
            kept = kept or found
            assert found == kept and len(found) == len(set(found)) == len(tree)


def test_query_has_no_switch_by_size(spark, monkeypatch):
    rows = [(i, t) for i, t in fixture() if i is not None]
    df = prepare(spark).createDataFrame(rows, "doc_id long, text string")
    one = sorted((r.doc_id, r.n_tokens, r.score) for r in sc.scores(df).collect())
    for name in ("HOT", "SPLIT"):
        monkeypatch.setattr(sc, name, 40)
    monkeypatch.setattr(sc.scores, "__defaults__", tuple(40 if x == 1 << 20 else x for x in sc.scores.__defaults__))
    other = sorted((r.doc_id, r.n_tokens, r.score) for r in sc.scores(df).collect())
    assert all(a[:2] == b[:2] and abs(a[2] - b[2]) <= 1e-6 * (1 + a[1]) for a, b in zip(one, other, strict=True))
