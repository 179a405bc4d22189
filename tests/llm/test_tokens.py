import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from blobloom.llm import packing, tokens
from blobloom.llm.common import prepare

LIB = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def texts():
    rng = random.Random(2)
    alphabet = ["a", "b", " ", "  ", "\n", "\t", "'s", "'ll", "é", "ß", "日本", "١٢", "🙂", "x" * 40, "12", "...", "<|endoftext|>", "<|endof", " the", "　", "​", "́"]
    out = [None, "", " ", "\n\n", "<|endoftext|>", "a" * 5000, " " * 3000, "don't we'll I'M"]
    return out + ["".join(rng.choice(alphabet) for _ in range(rng.choice([1, 5, 50, 700, 3000]))) for _ in range(120)]


@pytest.mark.parametrize("chunk, overlap", [(40_000, 256), (300, 40), (64, 16)])
def test_counts_are_the_librarys(spark, chunk, overlap):
    rows = [(i, t, 0) for i, t in enumerate(texts())] + [(3, "\n\n", 0), (None, "a b", 0)]
    df = prepare(spark).createDataFrame(rows, "doc_id long, text string, n_tokens int")
    got = sorted((str(r.doc_id), r.n_bytes, r.n_tokens, r.over_limit) for r in tokens.counts(df, chunk=chunk, overlap=overlap).collect())
    want = [len(LIB.encode(t or "", add_special_tokens=False).ids) for _, t, _ in rows]
    assert got == sorted((str(i), len((t or "").encode()), n, n > 512) for (i, t, _), n in zip(rows, want))


def test_no_rows(spark):
    df = prepare(spark).createDataFrame([], "doc_id long, text string")
    assert tokens.counts(df).collect() == [] and packing.packed(df).collect() == []


def test_pieces_are_whole():
    for t in texts():
        spans = list(tokens.pieces(t or ""))
        assert "".join((t or "")[a:b] for a, b in spans) == (t or "")


def test_best_fit_decreasing():
    rng = random.Random(4)
    import numpy as np

    for cap in (1, 7, 16, 100):
        n = np.array([rng.randrange(1, cap + 1) for _ in range(200)])
        rows, slow = packing.pack(n, cap), []
        for k in np.argsort(-n, kind="stable").tolist():
            fit = [s for s in slow if s >= n[k]]
            if fit:
                slow.remove(min(fit))
                slow.append(min(fit) - n[k])
            else:
                slow.append(cap - n[k])
        assert sorted(k for r in rows for k in r) == list(range(200))
        assert sorted(cap - n[r].sum() for r in rows) == sorted(slow)


def test_round_trip(spark, tmp_path, monkeypatch):
    import numpy as np

    monkeypatch.setattr(packing, "SHARD_TOKENS", 5000)
    rows = [(i, t, "x") for i, t in enumerate(texts())] + [(10**12, "word " * 9000, "y")]
    df = prepare(spark).createDataFrame(rows, "doc_id long, text string, starts string")
    out = packing.packed(df, capacity=256)
    docs: dict = {}
    for r in out.collect():
        assert r.n_tokens == r.cu_seqlens[-1] <= 256 and len(r.doc_ids) == r.n_segments == len(r.cu_seqlens) - 1
        place = np.frombuffer(r.position_ids, "<u4")
        for a, b in zip(r.cu_seqlens, r.cu_seqlens[1:]):
            assert place[a:b].tolist() == list(range(b - a))
        for d, s, ids in packing.unpack(r):
            docs.setdefault(d, []).append((s, ids.tolist()))
    enc = tokens.encoder(tokens.default_path())
    got = {d: [i for _, ids in sorted(x) for i in ids] for d, x in docs.items()}
    assert got == {i: enc.encode_ordinary(t) for i, t, _ in rows if t}
    files = packing.write_bins(out, f"file://{tmp_path}/bins").collect()
    assert sum(r.n_rows for r in files) == out.count()
    assert sum(p.stat().st_size for p in (tmp_path / "bins").glob("ids-*")) == 512 * out.count()
