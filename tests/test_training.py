from blobloom.operators import vocabulary
from blobloom.plans import registry

from test_tokens_and_codecs import slow_train

TEXTS = ["the box of the box by the lid of the box, and the lid there", "aaaa bbbb aaaa abab baba the lid", None, "no no no nono"]


def test_registered_training_ends_by_its_rule(spark, tmp_path):
    spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    want = slow_train([t.encode() for t in TEXTS if t], 1000)
    assert len(want) > 268
    assert [r.token for r in registry.train_bpe(spark, str(tmp_path)).orderBy("rank").collect()] == [t.hex().upper() for t in want]


def test_settled_pairs():
    # ab and cd settle at once; bc shares a symbol with ab.
    assert vocabulary._settled([("ab", 9), ("cd", 8), ("bc", 7), ("ef", 6)], True) == ["ab", "cd"]
    # As frequent as a pair that a merge may remake, so not yet.
    assert vocabulary._settled([("ab", 9), ("cd", 8), ("xa", 8)], True) == ["ab"]
    # What lies behind the pairs looked at may be as frequent.
    assert vocabulary._settled([("ab", 9), ("cd", 8)], False) == ["ab"]
    assert vocabulary._settled([("aa", 9), ("cd", 8)], True) == ["aa"] and vocabulary._settled([("ab", 1)], True) == []
