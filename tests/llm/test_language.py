import random

import numpy as np
import pytest

from blobloom.llm import language as lg
from blobloom.llm.common import prepare


def naive(model_texts, text):
    """Phrases of a text by searching substrings."""
    n = at = 0
    while at < len(text):
        k = 0
        while at + k < len(text) and text[at : at + k + 1] in model_texts:
            k += 1
        at += max(k, 1)
        n += 1
    return n


def sample():
    rng = random.Random(1)
    syll = {"aa": ["ka", "lo", "mi", "tu"], "bb": ["sch", "un", "ge", "er"], "cc": ["ção", "ñe", "que", "os"]}
    make = lambda k, n: " ".join("".join(rng.choice(syll[k]) for _ in range(rng.randrange(1, 4))) for _ in range(n))
    return syll, make


@pytest.mark.parametrize(("block", "dense"), [(4096, 64), (50, 64), (7, 6)])
def test_phrases_match_brute_force(monkeypatch, block, dense):
    # Whole texts, in one parse, however they are cut and whichever symbols have columns.
    _, make = sample()
    for name, value in (("BLOCK", block), ("DENSE", dense), ("RARE", dense - 2), ("NONE", dense - 1)):
        monkeypatch.setattr(lg, name, value)
    samples = {k: [make(k, 60)] for k in ("aa", "bb")}
    model = lg.Model(samples)
    texts = [make("aa", 30), make("bb", 400), "zz!!ka Ünge", "x", make("cc", 5), "", "ka" * 300, samples["aa"][0] * 3]
    count, letters = model.phrases(texts)
    for i, t in enumerate(texts):
        x = "".join(map(chr, lg.normal(t).tolist()))
        for j, k in enumerate(model.labels):
            ref = "".join(map(chr, lg.normal(samples[k][0]).tolist())) + " "
            assert count[i, j] == (naive(ref, x) if letters[i] else 0)


SCRIPTS = {
    "zh": "我们今天去学校学习中文因为老师说学习语言很重要他们昨天在公园里看见很多人天气很好大家都喜欢春天的花和树",
    "ja": "私たちは今日学校へ行って日本語を勉強しますなぜなら先生が言葉を学ぶことは大切だと言ったからです昨日は公園で花を見ました",
    "ko": "우리는 오늘 학교에 가서 한국어를 공부합니다 왜냐하면 선생님이 언어를 배우는 것이 중요하다고 말했기 때문입니다 어제는 공원에서 꽃을 보았습니다",
    "ru": "сегодня мы идём в школу изучать русский язык потому что учитель сказал что учить языки очень важно вчера мы видели цветы в парке",
    "el": "σήμερα πηγαίνουμε στο σχολείο για να μάθουμε ελληνικά γιατί ο δάσκαλος είπε ότι οι γλώσσες είναι σημαντικές",
    "en": "today we go to school to learn a language because the teacher said that learning is important and we saw flowers in the park",
}


def test_every_script_has_its_alphabet():
    model = lg.Model({k: [t] for k, t in SCRIPTS.items()})
    asked = {"zh": "老师今天在学校", "ja": "先生は公園で花を見ました", "ko": "오늘 선생님이 학교에", "ru": "учитель идёт в школу", "el": "ο δάσκαλος στο σχολείο", "en": "the teacher saw the school"}
    pred, score, _, _ = model.predict(list(asked.values()))
    assert pred == list(asked) and (score > 0.2).all()


def test_foreign_texts():
    rng = random.Random(3)
    syll = {"aa": ["ka", "lo", "mi", "tu", "re", "na"], "bb": ["sch", "un", "ge", "er", "ein", "ber"]}
    make = lambda s, n: " ".join("".join(rng.choice(s) for _ in range(rng.randrange(1, 4))) for _ in range(n))
    model = lg.Model({k: [make(v, 80) for _ in range(20)] for k, v in syll.items()})
    foreign = lambda texts: model.foreign(*(lambda r: (r[3], r[2]))(model.predict(texts)))
    clean = [make(v, n) for v in syll.values() for n in (1, 2, 5, 20, 200) for _ in range(20)]
    assert not foreign(clean).any()
    # Short or long, with a key in it: a clean text stays.
    assert not foreign([make(syll["aa"], 6) + " token = 9f8e7d6c5b4a39281706f5e4d3c2b1a0 " + make(syll["aa"], 3)]).any()
    assert foreign([make(["pz", "wy", "cz", "rz", "dą", "ję"], n) for n in (10, 50, 300)]).all()
    assert foreign(["сегодня мы идём в школу"]).all() and foreign(["день"]).all()


def test_held_out_accuracy_and_edge_cases(spark):
    _, make = sample()
    rows = [(i, make(k := ("aa", "bb", "cc")[i % 3], 30), k if i % 7 else None, i) for i in range(300)]
    rows += [(1000, None, "aa", 0), (1001, "", "aa", 0), (1002, "12 !! 34", "aa", 0), (1003, make("bb", 60_000), None, 0), (None, "kalomi", "aa", 0), (5, rows[5][1], "cc", 5)]
    df = prepare(spark).createDataFrame(rows, "doc_id long, text string, lang string, score int")
    got = lg.identify(df).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert all(by[i].lang_pred == ("aa", "bb", "cc")[i % 3] for i in range(300))
    assert {by[i].lang_pred for i in (1000, 1001, 1002)} == {"und"} and by[1003].lang_pred == "bb"
    assert all(0 <= r.score <= 1 for r in got)
    assert sum(r.held_out for r in got) > 20


def test_nothing_learned_and_empty(spark):
    df = prepare(spark).createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")
    assert [(r.lang_pred, r.score) for r in lg.identify(df).collect()] == [("und", 0.0)]
    assert lg.identify(df.where("false")).collect() == []


def test_normal():
    assert lg.normal("A1 b!! Ç").tolist() == [32, 98, 32, 231] and lg.normal("A1").tolist() == [97, 32]
    assert np.array_equal(lg.normal(""), np.zeros(0))
