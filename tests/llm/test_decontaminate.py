import hashlib
import random
import re

from blobloom.llm import decontaminate as dc
from blobloom.llm.common import prepare


def words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def brute(docs, items):
    out = []
    for i, t in docs:
        w, hit, ids = words(t), set(), set()
        for item, text in items:
            v = words(text)
            for k in range(max(1, len(v) - 12)) if v else ():
                x = v[k : k + 13]
                for s in range(len(w) - len(x) + 1):
                    if w[s : s + len(x)] == x:
                        hit.update(range(s, s + len(x)))
                        ids.add("" if item is None else str(item))
        out.append((i, len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=str)


def tables(spark, docs, items):
    return prepare(spark).createDataFrame([(i, t, 1, "x") for i, t in docs], "doc_id long, text string, n_words long, __at string"), spark.createDataFrame(items, "item_id long, text string")


def fixture():
    rng = random.Random(3)
    vocab = [f"w{i}" for i in range(25)] + ["Ünï", "über", "9"]
    items = [(i, " ".join(rng.choice(vocab) for _ in range(n))) for i, n in enumerate([13, 14, 40, 40, 5, 2, 13, 12])] + [(100, None), (101, ""), (None, "W1, w2! w3"), (10, "solo"), (10, "solo")]
    docs = [(0, None), (1, ""), (2, "Solo"), (3, "x-solo-y")]
    for k in range(60):
        w = [rng.choice(vocab) for _ in range(rng.randrange(1, 120))]
        if k % 3:
            v = words(rng.choice(items)[1])
            a = rng.randrange(0, max(1, len(v) - 12))
            w[rng.randrange(len(w)) : 0] = v[a : a + rng.choice([12, 13, 14, 40])]
        docs.append((len(docs), " ".join(w).replace("w1 ", "W1. ")))
    return docs + [(5, docs[5][1]), (None, items[2][1]), (900, " ".join(vocab * 3000) + " " + items[3][1])], items


def test_matches_brute_force(spark):
    docs, items = fixture()
    got = dc.contaminated(*tables(spark, docs, items)).collect()
    assert sorted(map(tuple, got), key=str) == brute(docs, items)


def test_blocks_change_nothing(spark, monkeypatch):
    docs, items = fixture()
    d, i = tables(spark, docs, items)
    # Names of its own may occur among the columns of the documents.
    d = d.selectExpr("doc_id", "text", "n_words as hits", "n_words as n_hit", "doc_id as row", "doc_id as doc")
    one = dc.scan(d, i).collect()
    many = dc.scan(d, i, limit=200).collect()
    assert sorted(map(str, one)) == sorted(map(str, many)) and one[0].doc.hits == 1


def test_empty(spark):
    docs, items = fixture()
    assert dc.contaminated(*tables(spark, [], items)).collect() == []
    assert {r.n_hit for r in dc.contaminated(*tables(spark, docs, [])).collect()} == {0}


def test_proximity(spark):
    docs, _ = tables(spark, [(1, "a b c d e f"), (2, "f a"), (3, "a x x x x x f"), (4, None)], [])
    assert sorted(map(tuple, dc.proximity(docs, "F a", 6).collect())) == [(1, 0, 6), (2, 0, 2)]
