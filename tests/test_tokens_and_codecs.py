import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from blobloom.operators import choose, codecs, vocabulary
from blobloom.session import prepare

BYTES = tuple(bytes([i]) for i in range(256))
SOME = (*BYTES, b"th", b"he", b"in", b"er", b"the", b"hello", b"help", b"help me")


def blobs():
    rng = random.Random(4)
    return [b"", b"a", b"hello", bytes(range(256)), b"\xaa" * 1000, b"\0" * 50, rng.randbytes(3000), b"the other thing " * 400, "日本 é".encode() * 9] + [bytes(rng.choice(b"abc") for _ in range(rng.randrange(200))) for _ in range(30)]


def slow_encode(data, tokens):
    ids, at = {t: i for i, t in enumerate(tokens)}, 0
    out = []
    while at < len(data):
        n = next((n for n in range(min(12, len(data) - at), 0, -1) if data[at : at + n] in ids), 0)
        out.append(ids[data[at : at + n]] if n else data[at])
        at += n or 1
    return out


def test_longest_match():
    t = vocabulary.Trie(SOME)
    assert t.longest(b"help me", 0) == (7, 263) and t.longest(b"held", 0) == (2, 257) and t.longest(b"x", 1) == (0, -1)


def test_greedy_tokens(spark):
    df = prepare(spark).createDataFrame([(i, bytearray(b)) for i, b in enumerate(blobs())], "id int, b binary")
    rows = df.select("id", vocabulary.encoder(SOME)("b").alias("ids"))
    assert {r.id: list(r.ids) for r in rows.collect()} == {i: slow_encode(b, SOME) for i, b in enumerate(blobs())}
    vocab = spark.createDataFrame([(bytearray(t), i) for i, t in enumerate(SOME)], "token binary, rank int")
    back = {r.id: bytes(r.content) for r in vocabulary.decode(rows.select("id", "ids"), vocab, "id").collect()}
    assert back == dict(enumerate(blobs()))


def test_decode_drops_unknown_ids(spark):
    vocab = vocabulary.basic(prepare(spark))
    df = spark.createDataFrame([(1, [104, 999, 105]), (2, []), (3, [300])], "id int, ids array<int>")
    assert {r.id: bytes(r.content) for r in vocabulary.decode(df, vocab, "id").collect()} == {1: b"hi", 2: b"", 3: b""}


def test_renumber_and_load(spark):
    prepare(spark)
    v = spark.createDataFrame([(bytearray(b"x"), 9), (bytearray(b"a"), 3), (bytearray(b"b"), 3)], "token binary, rank int")
    assert [(bytes(r.token), r.id) for r in vocabulary.renumber(v).orderBy("id").collect()] == [(b"a", 0), (b"b", 1), (b"x", 2)]
    lines = spark.createDataFrame([("eA== 1",), ("",), ("eA== 7",), ("nofields",), ("YQ== 2",)], "value string")
    assert sorted((bytes(r.token), r.rank) for r in vocabulary.load_tiktoken(lines).collect()) == [(b"a", 2), (b"x", 7)]


def slow_train(texts, merges):
    docs, tokens = [list(t) for t in texts], list(BYTES)
    for _ in range(merges):
        n = {}
        for d in docs:
            for p in zip(d, d[1:]):
                n[p] = n.get(p, 0) + 1
        if not n or max(n.values()) < 2:
            break
        best = min(n, key=lambda p: (-n[p], p))
        tokens.append(tokens[best[0]] + tokens[best[1]])
        for k, d in enumerate(docs):
            out, i = [], 0
            while i < len(d):
                if tuple(d[i : i + 2]) == best:
                    out.append(len(tokens) - 1)
                    i += 2
                else:
                    out.append(d[i])
                    i += 1
            docs[k] = out
    return tokens


@pytest.mark.parametrize("texts, merges", [([b"aaabbbaaabbb"], 5), ([b"the other then", b"there he is"], 8), ([], 3), ([b"abc"], 4), ([b"abab"], 0)])
def test_training(spark, texts, merges):
    df = prepare(spark).createDataFrame([(bytearray(t),) for t in texts], "b binary")
    for most in (-1, 1 << 20):
        assert [bytes(r.token) for r in vocabulary.train(df, F.col("b"), merges, local_bytes=most).orderBy("rank").collect()] == slow_train(texts, merges)


VARINTS = [[], [0], [127], [128], [255, 256], [1000, 16383, 16384], [2097151, 2097152, 268435455, 268435456, 2**31 - 1]]


def test_varints(spark):
    df = prepare(spark).createDataFrame([(i, v) for i, v in enumerate(VARINTS)], "id int, v array<int>")
    got = df.select("id", vocabulary.varint_bytes(F.col("v")).alias("b"), vocabulary.varint_size(F.col("v")).alias("n"), codecs.varint_decode(vocabulary.varint_bytes(F.col("v"))).alias("back")).collect()
    for r in got:
        assert bytes(r.b) == codecs.varints(VARINTS[r.id]) and r.n == len(r.b) and list(r.back) == VARINTS[r.id] == codecs.read_varints(bytes(r.b))
    assert codecs.read_varints(b"\x81") == [1]


def test_range_coding():
    packed = codecs.rans_encode(blobs())
    assert codecs.rans_decode(packed) == blobs()
    assert packed[0] == b"\0\0\0\0" and all(len(p) >= 520 for p in packed[1:])
    assert [codecs.rans_encode([b])[0] for b in blobs()] == packed


@pytest.mark.parametrize("bad", [b"", b"\1\0\0", b"\5\0\0\0", b"\5\0\0\0" + b"\0" * 600, codecs.rans_encode([b"hello"])[0][:-1] + b"\7", codecs.rans_encode([b"hello world"])[0] + b"x"])
def test_damaged_range_coding(bad):
    with pytest.raises(codecs.Damaged):
        codecs.rans_decode([bad])


def test_tables_sum_to_scale(spark):
    for counts in (np.ones(256), np.array([10**6, *[1] * 255]), np.zeros(256), np.arange(256)):
        f = codecs.frequencies(counts.astype(np.int64))
        assert f.sum() == codecs.SCALE and ((f > 0) == (counts > 0))[1:].all()
    rows = [(k, s, int(n)) for k, c in ((1, [5, 0, 3]), (2, [1] * 200)) for s, n in enumerate(c)]
    t = codecs.rans_table(prepare(spark).createDataFrame(rows, "k int, s int, n int"), "k", "s", "n").collect()
    for k, size in ((1, 3), (2, 200)):
        f = codecs.frequencies(np.bincount([s for kk, s, n in rows if kk == k for _ in range(n)], minlength=256))
        assert {r.s: r.freq for r in t if r.k == k} == {s: int(f[s]) for s in range(size) if f[s]}
        assert all(r.cum == f[: r.s].sum() for r in t if r.k == k)


def test_udfs_and_chunks(spark):
    df = prepare(spark).createDataFrame([(i, bytearray(b)) for i, b in enumerate([*blobs(), b"x" * 30_000])] + [(99, None)], "id int, b binary")
    r = df.select((codecs.inflate_raw(codecs.deflate_raw("b")) == F.col("b")).alias("d"), (codecs.rans_unpack(codecs.rans_pack("b")) == F.col("b")).alias("r")).collect()
    assert sum(bool(x.d and x.r) for x in r) == len(blobs()) + 1 and sum(x.d is None for x in r) == 1
    chunks = codecs.chunked(df, "id", "b", 5000)
    assert chunks.where(f"id = {len(blobs())}").count() == 6
    assert {x.id: bytes(x.content) for x in codecs.joined(chunks, "id").collect()} == dict(enumerate([*blobs(), b"x" * 30_000]))


def test_damaged_deflate():
    with pytest.raises(codecs.Damaged):
        codecs.inflate(codecs.deflate(b"hello" * 50)[:-3])


def test_method_choice(spark):
    cases = {"empty": b"", "prose": b"the thing is in the other place, he said. " * 40, "code": b'{"a": 1, "b": [1, 2]}' * 30, "noise": random.Random(1).randbytes(8192), "null": None}
    df = prepare(spark).createDataFrame([(k, bytearray(v) if v is not None else None) for k, v in cases.items()], "id string, b binary")
    made = choose.compress(df, "b", ["id"], {"text": SOME})
    got = {r.id: r for r in made.collect()}
    assert got["empty"].method == got["null"].method == got["noise"].method == codecs.STORE
    for k, v in cases.items():
        v = v or b""
        assert got[k].packed_size == len(got[k].packed) <= len(v) and got[k].crc == zlib.crc32(v)
    for k in ("prose", "code"):
        tries = [codecs.DEFLATE, codecs.DEFLATE_TOKENS] + [codecs.RANS_TOKENS] * (k == "code")
        assert got[k].packed_size == min(len(choose.encode(cases[k], m, SOME)) for m in tries)
    back = {r.id: (bytes(r.content), r.error) for r in choose.restore(made, ["id"], {"text": SOME}).collect()}
    assert back == {k: (v or b"", None) for k, v in cases.items()}
    broken = made.withColumn("crc", F.col("crc") + 1)
    assert {r.error for r in choose.restore(broken, ["id"], {"text": SOME}).collect()} == {"checksum differs"}
    with pytest.raises(ValueError):
        choose.compress(df, "b", ["id"], {"text": (b"a",)})


def test_literals(spark):
    df = prepare(spark).createDataFrame([("\\ \" \n\r\t\x01ÿ a",)], "s string")
    assert df.select(vocabulary.escape_literal(F.col("s")).alias("e")).first().e == '\\\\ \\" \\n\\r\\t\\x01\\xff a'


def slow_rans(data):
    """One symbol after another, by the layout's definition."""
    if not data:
        return b"\0\0\0\0"
    f = codecs.frequencies(np.bincount(np.frombuffer(data, np.uint8), minlength=256)).tolist()
    x, out = 1 << 23, []
    for s in reversed(data):
        while x >= ((1 << 23 >> 14) << 8) * f[s]:
            out.append(x & 255)
            x >>= 8
        x = (x // f[s] << 14) + x % f[s] + sum(f[:s])
    return len(data).to_bytes(4, "little") + b"".join(v.to_bytes(2, "little") for v in f) + x.to_bytes(4, "little") + bytes(reversed(out))


def test_range_coder_gives_these_bytes():
    assert codecs.rans_encode(blobs()) == [slow_rans(b) for b in blobs()]
    assert codecs.rans_encode([b"ab"])[0].hex()[-8:] == slow_rans(b"ab").hex()[-8:]


def test_fixed_vectors():
    assert zlib.decompress(codecs.deflate(b"abc" * 9), -15) == b"abc" * 9 and codecs.inflate(bytes.fromhex("4b4c4a06 00".replace(" ", ""))) == b"abc"
    assert codecs.varints([0, 127, 128, 300, 16384]).hex() == "007f8001ac02808001" and codecs.read_varints(bytes.fromhex("007f8001ac02808001")) == [0, 127, 128, 300, 16384]


def test_loading_ranks(spark):
    lines = ["YQ== 5", "", "Yg==", "YWI= 7", "YQ== 2"]
    df = prepare(spark).createDataFrame([(x,) for x in lines], "value string").coalesce(1)
    assert {bytes(r.token): r["rank"] for r in vocabulary.load_tiktoken(df).collect()} == {b"a": 2, b"ab": 7}
    for bad in ("YQ== 5 6", "YQ== x"):
        with pytest.raises(Exception, match="invalid rank"):
            vocabulary.load_tiktoken(spark.createDataFrame([(bad,)], "value string")).collect()


@pytest.mark.parametrize("texts, merges", [([b"aaabbbaaabbb"], 5), ([b"the other then", b"there he is", b""], 30), ([], 3), ([b"abc"], 4), ([b"aaaaaaaab" * 9], 9), ([b"abab"], 0)])
def test_local_training(texts, merges):
    assert list(vocabulary.train_local(texts, merges)) == slow_train(texts, merges)


def test_automaton_is_greedy_longest_match():
    rng = random.Random(1)
    for _ in range(60):
        tokens = [bytes([i]) for i in range(256)] + [bytes(rng.choice(b"abc") for _ in range(rng.randrange(2, 6))) for _ in range(12)]
        trie, data = vocabulary.Trie(tokens), bytes(rng.choice(b"abcd") for _ in range(50))
        fast = trie.encode(data)
        trie.fast = None
        assert fast == trie.encode(data)


def test_pairs_of_a_batch(spark):
    df = prepare(spark).createDataFrame([("aaab",), ("ab",), ("b",), (None,), ("ÿ\x00",)], "z string")
    assert {(r.pair, r.n) for r in vocabulary.pair_counts(df).collect()} == {("aa", 2), ("ab", 2), ("ÿ\x00", 1)}


def test_tokens_table_function(spark):
    vocabulary.register(prepare(spark), SOME)
    got = spark.sql("SELECT place, id, token FROM bpe_tokens(CAST('the thing' AS BINARY))").orderBy("place").collect()
    assert [r.id for r in got] == vocabulary.trie_of(SOME).encode(b"the thing") and b"".join(bytes(r.token) for r in got) == b"the thing"


def test_source_of_a_vocabulary(spark, tmp_path):
    df = prepare(spark).createDataFrame([(bytearray(t), i) for i, t in enumerate([b"a", b'"\\', b"\n\xff"])], "token binary, rank int")
    vocabulary.write_source(df, f"{tmp_path}/v", "mine")
    text = "".join(p.read_text() for p in sorted(tmp_path.glob("v/part-*")))
    assert text == 'mine = {\n    "a": 0,\n    "\\"\\\\": 1,\n    "\\n\\xff": 2,\n}\n'


def test_compressor(spark):
    df = prepare(spark).createDataFrame([(1, bytearray(b"the thing " * 30)), (2, None)], "id int, b binary")
    for engine in (choose.Compressor(), choose.Compressor({"text": SOME})):
        for method in (None, codecs.RANS_TOKENS, codecs.DEFLATE_TOKENS):
            back = engine.decompress(engine.compress(df, "b", ["id"], method), ["id"]).collect()
            assert {r.id: (bytes(r.content), r.error) for r in back} == {1: (b"the thing " * 30, None), 2: (b"", None)}


def test_range_coding_holds_what_it_codes_not_a_rectangle():
    import random
    import tracemalloc

    rng = random.Random(7)
    blobs = [bytes(rng.choices(b"abcde ", k=20_000)), b"", *(bytes(rng.choices(b"abcde ", k=rng.randrange(1, 40))) for _ in range(3000))]
    tracemalloc.start()
    packed = codecs.rans_encode(blobs)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.reset_peak()
    back = codecs.rans_decode(packed)
    peaks = peak, tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert back == blobs and [codecs.rans_encode([b])[0] for b in blobs[:9]] == packed[:9]
    # A grid of 3002 blobs by 20,000 bytes would be 60 MB three times over, tables of all blobs 50 MB.
    assert peaks[0] < 40 << 20 and peaks[1] < 80 << 20


def test_arrow_functions_take_a_batch_in_pieces(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(codecs, "PIECE", 10)
    x = pa.array([b"a" * 4, None, b"b" * 30, b"", b"c" * 5, b"d" * 6, None], pa.binary())
    parts = list(codecs.pieces(x))
    assert pa.concat_arrays(parts).to_pylist() == x.to_pylist() and len(parts) > 2
    assert all(len(p) == 1 or sum(len(v or b"") for v in p.to_pylist()) <= 10 for p in parts)
    assert list(codecs.pieces(x.slice(0, 0))) == []


def test_pairs_are_counted_across_pieces(spark, monkeypatch):
    from collections import Counter

    monkeypatch.setattr(vocabulary, "PIECE", 3)
    texts = ["abcabcabca", "", None, "z", "aaaaaaa", "éÿéÿ", "abĀabĀa", "xy"]
    want = Counter(t[i : i + 2] for t in texts if t for i in range(len(t) - 1))
    # The function is sent to workers as it is here, so the piece is counted in this process.
    run = {}

    class Rows:
        def select(self, text):
            return self

        def mapInArrow(self, fn, schema):
            import pyarrow as pa

            for b in fn(iter([pa.record_batch([pa.array(texts[:5])], ["z"]), pa.record_batch([pa.array(texts[5:])], ["z"])])):
                run.update({p: run.get(p, 0) + n for p, n in zip(b["pair"].to_pylist(), b["n"].to_pylist())})
            return self

        def groupBy(self, *_):
            return self

        agg = groupBy

    vocabulary.pair_counts(Rows())
    assert run == dict(want)


def test_nested_pattern_cuts_like_the_trie(spark):
    from blobloom.functions import bytesx

    few = tuple(w.encode() for w in ("the ", "the", "he", "er", "erth", "ción", "ci", "a.c", "an"))
    rows = [(i, t) for i, t in enumerate(["the theerther", "nación ciao a.c abc", "", "éèthe\nan", "ertherterth"])]
    df = spark.createDataFrame(rows, "i int, t string").select("i", bytesx.latin1(bytesx.as_bytes(F.col("t"))).alias("l1"))
    trie = vocabulary.Trie((*(bytes([i]) for i in range(256)), *few))
    for r in df.select("i", vocabulary.encode_regex(F.col("l1"), few).alias("p"), vocabulary.encode_regex(F.col("l1"), few, False).alias("q")).collect():
        want = [bytes([k]) if k < 256 else few[k - 256] for k in trie.encode(rows[r.i][1].encode())]
        assert [p.encode("latin-1") for p in r.p] == want and [p.encode("latin-1") for p in r.q] == [w for w in want if len(w) > 1]
