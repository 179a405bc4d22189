"""The pipeline's stages against brute force, on a small corpus of its own."""

import random
import re
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline as cp
from blobloom.llm import mixing, packing, tokens
from blobloom.llm.common import prepare

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def corpus():
    rng = random.Random(12)
    syll = {"en": ["the", "on", "er", "ing", "ou", "st"], "de": ["sch", "ung", "ä", "ein", "ge", "ver"]}
    make = lambda k, n: " ".join("".join(rng.choice(syll[k]) for _ in range(rng.randrange(1, 4))) for _ in range(n))
    items = [(i, make("en", 40)) for i in range(3)]
    rows = []
    for i in range(120):
        k = ("en", "de")[i % 2]
        rows.append((i, make(k, rng.randrange(30, 90)), k))
    near = rows[7][1].split()
    rows += [(200, rows[6][1], "en"), (201, " ".join([*near[:-1], "x"]), "de"), (202, rows[6][1], "en")]
    rows += [(300, make("en", 5) + " " + items[0][1] + " " + make("en", 5), "en"), (301, " ".join(items[1][1].split()[:20]), "en"), (400, "12 34 !!", "en"), (401, None, None), (402, "", "de"), (403, "Это совсем другой язык и другой текст", None)]
    docs = [(i, t, k, f"s{i % 3}", len(t or "")) for i, t, k in rows]
    labels = [(i, 1 if i % 5 else 0, 0) for i in range(0, 120, 2)]
    return docs, items, labels


@pytest.fixture
def folder(spark, tmp_path):
    docs, items, labels = corpus()
    prepare(spark)
    spark.createDataFrame(docs, COLUMNS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    return str(tmp_path)


def test_stages(spark, folder):
    docs, items, _ = corpus()
    table = spark.read.parquet(f"{folder}/documents.parquet")
    kept = cp.keep_languages(spark, table, folder)
    assert kept.columns == table.columns
    assert {r.doc_id for r in kept.collect()} == {d[0] for d in docs} - {400, 401, 402, 403}
    once = cp.drop_near_duplicates(spark, kept, folder)
    text = {d[0]: d[1] for d in docs}
    gone = {r.doc_id for r in kept.collect()} - {r.doc_id for r in once.collect()}
    assert once.columns == table.columns and gone == {200, 201, 202}
    clean = cp.drop_contaminated(spark, once, folder)
    windows = {tuple(words(t)[k : k + 13]) for _, t in items for k in range(len(words(t)) - 12)}

    def bad(t):
        w = words(t)
        hit = {p for k in range(len(w) - 12) if tuple(w[k : k + 13]) in windows for p in range(k, k + 13)}
        return bool(hit) and 20 * len(hit) >= len(w)

    assert {r.doc_id for r in clean.collect()} == {r.doc_id for r in once.collect() if not bad(r.text)}
    assert {300, 301}.isdisjoint(r.doc_id for r in clean.collect())
    mixed = cp.mix(spark, clean, folder)
    assert mixed.columns == table.columns and Counter(map(tuple, mixed.collect())) == slow_mix(spark, clean, folder)
    enc, got = tokens.encoder(tokens.default_path()), {}
    for row in cp.pack(spark, clean, folder).collect():
        for d, s, ids in packing.unpack(row):
            got.setdefault(d, {})[s] = ids.tolist()
    assert {d: [i for s in sorted(x) for i in x[s]] for d, x in got.items()} == {r.doc_id: enc.encode_ordinary(text[r.doc_id]) for r in clean.collect()}


def slow_mix(spark, docs, folder):
    """Rows by copies: rates by plain projected gradient from the posteriors, rounded with each row's fraction."""
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    made = mixing.membership(docs, mixing.train(docs, labels)).selectExpr("doc", "n_tokens", "p", f"pmod(xxhash64(doc.doc_id, doc.text), {1 << 20}) / double({1 << 20}) as chance").collect()
    n, p = np.array([r.n_tokens for r in made], float), np.array([r.p for r in made])
    target, rate = np.array([cp.KEEP[d] for d in mixing.DOMAINS]) * (n @ p), np.ones(len(n))
    for _ in range(60_000):
        e = ((rate * n) @ p - target) / n.sum()
        rate = np.maximum(0, rate - (p @ e + mixing.RIDGE * (rate - 1)) / (1 + mixing.RIDGE))
    near = [abs(x - round(x)) for x in rate]
    # Far enough from where rounding changes, so that the two ways to a rate round alike.
    assert all(abs(d - mixing.SNAP) > 1e-4 and (d <= mixing.SNAP or abs((x + r.chance) % 1 - 0.5) < 0.5 - 1e-4) for x, d, r in zip(rate, near, made))
    copies = [round(x) if d <= mixing.SNAP else int(x + r.chance) for x, d, r in zip(rate, near, made)]
    return Counter({tuple(r.doc): k for k, r in zip(copies, made) if k})


def test_toxic_documents_go(spark, tmp_path):
    rng = random.Random(5)
    vocab = ["".join(rng.choice("aeioubcdfg") for _ in range(rng.randrange(2, 9))) for _ in range(300)]
    docs, labels = [], []
    for i in range(1200):
        w = [rng.choice(vocab) for _ in range(60)]
        if i % 5 == 0:
            for _ in range(6):
                w[rng.randrange(60)] = "vequ" + rng.choice(["s", "ant", "o"])
        docs.append((i, " ".join(w), "en", "s", 1))
        labels.append((i, 1, int(i % 5 == 0)))
    spark.createDataFrame(labels[:900], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    kept = [r.doc_id for r in cp.mix(prepare(spark), spark.createDataFrame(docs, COLUMNS), str(tmp_path)).collect()]
    toxic, clean = ([i for i in range(1200) if (i % 5 == 0) == x] for x in (True, False))
    assert len(set(toxic) & set(kept)) <= 2 and len(set(clean) - set(kept)) <= 5


def test_passages_in_long_documents(spark, folder):
    _, items, _ = corpus()
    passage = items[0][1].split()
    rest = [f"w{i}" for i in range(2000)]
    spark.createDataFrame([*items, (9, "w5 w6")], "item_id long, text string").write.mode("overwrite").parquet(f"{folder}/benchmark.parquet")
    rows = [(1, [*rest, *passage, *rest]), (2, [*rest, *passage[:13], *rest]), (3, [*rest, *passage[:12], *rest]), (4, rest), (5, ["w5", "w6", "w7"])]
    docs = spark.createDataFrame([(i, " ".join(w), "en", "s", 1) for i, w in rows], COLUMNS)
    assert sorted(r.doc_id for r in cp.drop_contaminated(spark, docs, folder).collect()) == [3, 4]


def test_columns_of_any_name(spark, folder):
    table = spark.read.parquet(f"{folder}/documents.parquet").selectExpr("*", "doc_id as n_words", "text as hits", "lang as lang_pred", "1 as p", "2 as doc", "3 as copies", "4 as component_id")
    docs = table
    for _, stage in cp.STAGES[:4]:
        docs = stage(spark, docs, folder)
        assert docs.columns == table.columns
    assert docs.where("doc != 2 or p != 1 or copies != 3 or component_id != 4 or n_words != doc_id").count() == 0 < docs.count()


def test_repeated_rows_and_null_ids(spark, folder):
    rows = [(1, "a b c d e f g h", "en", "s", 1), (1, "a b c d e f g h", "en", "s", 1), (1, "other words are here now", "en", "s", 1), (None, "p q r s t u", "en", "s", 1), (2, None, "en", "s", 0), (2, None, "en", "s", 0)]
    got = cp.drop_near_duplicates(spark, spark.createDataFrame(rows, COLUMNS), folder).collect()
    assert sorted((str(r.doc_id), str(r.text)) for r in got) == [("1", "a b c d e f g h"), ("1", "other words are here now"), ("2", "None"), ("None", "p q r s t u")]


def test_run_and_empty(spark, folder, tmp_path):
    out = cp.run(spark, folder)
    assert out.columns == [f.split()[0] for f in packing.SCHEMA.split(", ")] and 0 < out.count()
    empty = tmp_path / "none"
    for t in ("documents", "benchmark", "labels"):
        spark.read.parquet(f"{folder}/{t}.parquet").where("false").write.parquet(f"{empty}/{t}.parquet")
    assert cp.run(spark, str(empty)).collect() == []
