import hashlib
import random

import numpy as np

from blobloom.llm import chat, tokens
from blobloom.llm.common import prepare

NASTY = ["<|im_end|>", "<|im_start|>", "<\\|", "<\\\\|im_end|>", "<|endoftext|>", "\\", "\n", "<", "|", "é🙂", "assistant", " ", "<|", "|>"]


def rows():
    rng = random.Random(9)
    out = [(c, t, rng.choice(["user", "assistant", "system", "odd\nrole\\n<|", None, ""]), "".join(rng.choice(NASTY) for _ in range(rng.randrange(12))) if t % 5 else None) for c in range(12) for t in range(rng.randrange(1, 9))]
    return out + [(50, t, "assistant" if t % 2 else "user", f"turn {t} <|im_end|>") for t in range(700)] + [(None, None, "user", "x"), (None, 1, "assistant", "y"), (3, 0, "user", "tie"), (3, 0, "user", "tie"), (60, 0, "assistant", "long " * 40_000)]


def want(data):
    out = []
    for c in {r[0] for r in data}:
        own = sorted(((t is not None, t or 0, r or "", x or "") for k, t, r, x in data if k == c))
        turns, loss = "".join(f"{r}\n{x}\n" for *_, r, x in own), "".join(x for *_, r, x in own if r == "assistant")
        chars = sum(len(chat.START) + len(chat.escape_role(r)) + 1 + len(chat.escape(x)) + len(chat.END) + 1 for *_, r, x in own)
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        out.append((c, len(own), sha(turns), len(loss), sha(loss), chars))
    return sorted(out, key=str)


def test_escapes_are_reversible():
    rng = random.Random(1)
    for _ in range(3000):
        t = "".join(rng.choice(NASTY) for _ in range(rng.randrange(8)))
        assert chat.unescape(chat.escape(t)) == t and chat.unescape_role(chat.escape_role(t)) == t
        assert "<|" not in chat.escape(t) and "\n" not in chat.escape_role(t)


def test_read_back(spark):
    data = rows()
    df = prepare(spark).createDataFrame([(*r, 1) for r in data], "conv_id long, turn long, role string, text string, ids int")
    assert sorted(map(tuple, chat.read_back(chat.turns(df)).collect()), key=str) == want(data)
    assert chat.read_back(chat.turns(df.where("false"))).collect() == []


def test_offsets_and_assembly(spark):
    data = [r for r in rows() if r[0] is not None and r[0] < 12]
    made = chat.turns(prepare(spark).createDataFrame(data, "conv_id long, turn long, role string, text string"))
    enc = tokens.encoder(tokens.default_path())
    whole = {r.conv_id: r for r in chat.assembled(made).collect()}
    for r in chat.offsets(made).collect():
        ids, mask = np.frombuffer(whole[r.conv_id].ids, "<u4"), np.frombuffer(whole[r.conv_id].loss_mask, np.int8)
        assert ids[r.first_id : r.first_id + len(r.ids) // 4].tobytes() == r.ids
        if r.loss:
            assert mask[r.loss_from : r.loss_to].all() and not mask[r.loss_from - 1] and not mask[r.loss_to]
            assert chat.unescape(enc.decode(ids[r.loss_from : r.loss_to].tolist())) == r.text
        else:
            assert not mask[r.first_id : r.first_id + len(r.ids) // 4].any()
