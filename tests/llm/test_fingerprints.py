import hashlib
import random

import numpy as np
import pytest

from blobloom.llm import fingerprints as fp
from blobloom.llm.common import prepare


def test_spans_and_extensions():
    rng = random.Random(1)
    for _ in range(40):
        a, b = ("".join(rng.choice("abé") for _ in range(rng.randrange(1, 60))) for _ in range(2))
        x, y = fp.Prefix(fp.points(a)), fp.Prefix(fp.points(b))
        i, j = rng.randrange(len(a)), rng.randrange(len(b))
        n = 0
        while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n]:
            n += 1
        assert x.extension(i, y, j) == n
        k = rng.randrange(0, 6)
        assert x.equal(i, y, j, k) == (i + k <= len(a) and j + k <= len(b) and a[i : i + k] == b[j : j + k])


def test_likeness_estimates_jaccard():
    rng = random.Random(2)
    a = "".join(rng.choice("abcdefghijkl ") for _ in range(3000))
    b = a[:1500] + "".join(rng.choice("abcdefghijkl ") for _ in range(1500))
    grams = lambda t: {t[i : i + fp.SPAN] for i in range(len(t) - fp.SPAN + 1)}
    true = len(grams(a) & grams(b)) / len(grams(a) | grams(b))
    one, two = fp.fingerprint(fp.points(a)), fp.fingerprint(fp.points(b))
    assert abs(fp.likeness(one, two) - true) < 0.2 and fp.likeness(one, one) == 1.0
    short = fp.fingerprint(fp.points("abc")), fp.fingerprint(fp.points("abd"))
    assert fp.likeness(*short) == 0.0 and short[0][0] != short[1][0]


def slow_print(t):
    """(fingerprint, least span hashes) by the definition, in plain integers."""
    mask = 2**64 - 1

    def poly(x):
        one, two = (sum((ord(c) + 1) * pow(b, i, p) for i, c in enumerate(x)) % p for b, p in ((fp.B1, 2**31 - 1), (fp.B2, 2_147_483_629)))
        return one << 31 | two

    def mix(x):
        for m in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
            x = (x ^ x >> 33) * m & mask
        return x ^ x >> 33

    spans = {t[i : i + fp.SPAN] for i in range(max(1, len(t) - fp.SPAN + 1))} if t else set()
    least = sorted({mix(poly(x)) for x in spans})[: fp.SKETCH]
    return f"{len(t):x}:{poly(t) if t else 0:016x}:" + "".join(f"{h:016x}" for h in least), least


def slow_likeness(a, b):
    if a[0] == b[0]:
        return 1.0
    if not a[1] or not b[1]:
        return 0.0
    union = sorted({*a[1], *b[1]})
    union = union[: fp.SKETCH] if max(len(a[1]), len(b[1])) >= fp.SKETCH else union
    return len({*a[1]} & {*b[1]} & {*union}) / len(union)


def common(a, b):
    return next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))


def want(rows):
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1] or ""))
    out = []
    for (d, t), (_, nxt) in zip(order, order[1:] + order[:1]):
        t, nxt = t or "", nxt or ""
        k = len(t) // 3
        edited = t[: len(t) - k] + nxt[:k]
        a, b, c = map(slow_print, (t, edited, nxt))
        out.append((d, len(t), hashlib.sha256(edited.encode()).hexdigest(), a[0], b[0], slow_likeness(a, b), slow_likeness(a, c), common(t, edited), common(t, nxt)))
    return sorted(out, key=str)


def test_likeness_over_many_pairs():
    # Against the true Jaccard similarity of the spans: no bias, and the error of a sample of SKETCH.
    rng = random.Random(9)
    off = []
    for k in range(120):
        a = "".join(rng.choice("abcdefghijkl ") for _ in range(600))
        cut = 600 - rng.randrange(0, 600)
        b = a[:cut] + "".join(rng.choice("abcdefghijkl ") for _ in range(600 - cut))
        x, y = ({t[i : i + fp.SPAN] for i in range(600 - fp.SPAN + 1)} for t in (a, b))
        off.append(fp.likeness(fp.fingerprint(fp.points(a)), fp.fingerprint(fp.points(b))) - len(x & y) / len(x | y))
    assert abs(np.mean(off)) < 0.02 and np.std(off) < 0.07


def test_many_ranges_plan_quickly(spark):
    df = prepare(spark).createDataFrame([(i, f"text {i}") for i in range(700)], "doc_id long, text string")
    assert fp.edited(df, 300).count() == 700


@pytest.mark.parametrize("ranges", [1, 3, 16])
def test_matches_brute_force(spark, ranges):
    rng = random.Random(3)
    rows = [(i * 7 % 101, "".join(rng.choice("abc é日🙂") for _ in range(rng.choice([0, 1, 2, 5, 40, 900])))) for i in range(101)]
    rows += [(None, "null id"), (None, None), (5, "tie b"), (5, "tie a"), (5, "tie a"), (-9, "z" * 3_000), (2**62, None)]
    df = prepare(spark).createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, part int")
    assert sorted(map(tuple, fp.edited(df, ranges).collect()), key=str) == want(rows)


def test_one_and_none(spark):
    df = prepare(spark).createDataFrame([(1, "abcdef")], "doc_id long, text string")
    assert sorted(map(tuple, fp.edited(df).collect())) == want([(1, "abcdef")])
    assert fp.edited(df.where("false")).collect() == []


def test_powers_and_inverses():
    p = fp.powers(fp.B1, fp.P1, 50)
    q = fp.inverse(fp.B1, fp.P1, 50)
    assert ((p * q) % fp.P1 == 1).all() and np.all(p[:1] == 1)
