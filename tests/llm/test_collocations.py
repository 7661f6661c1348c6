"""Collocations: the filter and its permutation, and the phrases against brute force."""
import random
import re
from collections import Counter

import numpy as np
import pytest

from pagelake.llm import collocations as co


@pytest.mark.parametrize("bits", [1, 4, 17, 31, 40, 60])
def test_filter(bits):
    rng = np.random.default_rng(bits)
    left, right = (rng.integers(0, min(1 << bits, 300), 5000) + ((1 << bits) - min(1 << bits, 300)) for _ in range(2))
    left[:700], right[:700] = left[0], right[0]
    back = co.restore(*co.permute(left.astype(np.uint64), right.astype(np.uint64), bits), bits)
    assert (back[0] == left).all() and (back[1] == right).all()
    want = Counter(zip(left.tolist(), right.tolist(), strict=True))
    halves = [co.Filter.of(bits, left[i::2], right[i::2]) for i in range(2)]
    for bucket_bits in (0, min(bits, 4)):
        parts = [[(b, co.Filter.unpack(d)) for b, d in h.pack(bucket_bits)] for h in halves]
        assert all(len({b for b, _ in p}) == len(p) <= 1 << bucket_bits for p in parts)
        assert all((f.left >> np.uint64(bits - bucket_bits) == b).all() for p in parts for b, f in p if bucket_bits)
        fs = [f for p in parts for _, f in p]
        whole, entry = co.Filter.merged(bits, *(np.concatenate([getattr(f, c) for f in fs]) for c in ("left", "right", "counts")))
        assert len(entry) == sum(len(f.left) for f in fs)
        key = co.joint(whole.left, whole.right, bits)
        assert (key[1:] > key[:-1]).all()
        p, s = whole.pairs()
        assert {(int(a), int(b)): int(c) for a, b, c in zip(p, s, whole.counts, strict=True)} == want
    assert list(co.Filter.of(bits, left[:0], right[:0]).pack(0)) == []


def brute(rows, least, covered):
    n, f = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, 6):
                f.update((lang, tuple(w[i : i + k])) for i in range(len(w) - k + 1))
    often = {k: c for k, c in f.items() if c >= least}
    out = set()
    for (lang, w), a in often.items():
        if len(w) < 2:
            continue
        inside = any(g == lang and len(v) > len(w) and 100 * b >= covered * a and any(v[i : i + len(w)] == w for i in range(len(v))) for (g, v), b in often.items())
        if not inside:
            score, _, l, r = min((1000 * a * n[lang] // (f[lang, w[:k]] * f[lang, w[k:]]), k, f[lang, w[:k]], f[lang, w[k:]]) for k in range(1, len(w)))
            out.add((lang, " ".join(w), a, l, r, n[lang], score))
    return out


@pytest.fixture(scope="module")
def texts(rows):
    rng = random.Random(3)
    out = []
    for i in range(300):
        w = []
        for _ in range(rng.randint(0, 40)):
            w += rng.choice([["New", "york", "city"], ["éa", "b"], ["x"], ["x", "x"], ["of", "the"], ["one", "two", "three", "four", "five", "six"], [f"rare{rng.randint(0, 900)}"]])
            if rng.random() < 0.2:
                w[-1] += rng.choice(".,;:!?\n\r\v\f")
        out.append((rng.choice(["en", "en", "en", "de", None, "und"]), rng.choice([" ", "  ", "\t"]).join(w)))
    return out + [("en", None), ("fr", ""), ("en", " . . \n")] + [("zz", "lone words here")] * 30 + [(r[2], r[1]) for r in rows]


@pytest.mark.parametrize("least,covered,size", [(100, 100, 1 << 23), (20, 100, 2000), (5, 60, 500)])
def test_collocations(spark, texts, least, covered, size, monkeypatch):
    monkeypatch.setattr(co, "SHARD_BYTES", size)
    monkeypatch.setattr(co, "BUCKET_WORDS", size)
    monkeypatch.setattr(co, "BROADCAST_BYTES", size - 2000)  # 0 at 2000: the words are joined by a shuffle
    df = spark.createDataFrame([(*t, 1, 2) for t in texts], "lang string, text string, phrase int, shard int").repartition(3)
    got = [tuple(r) for r in co.collocations(df, least, covered).select("lang", "phrase", "a", "l", "r", "n", "score").collect()]
    want = brute(texts, least, covered)
    assert len(got) == len(set(got)) and set(got) == want and want
    best = co.best(co.collocations(df, least, covered), 3).collect()
    by_lang = {}
    for t in sorted(want, key=lambda t: (-t[6], -t[2], t[1].encode())):
        by_lang.setdefault(t[0], []).append(t[1])
    assert {(r.lang, r.rank, r.phrase) for r in best} == {(g, i + 1, p) for g, ps in by_lang.items() for i, p in enumerate(ps[:3])}


def test_products_beyond_64_bits(spark, monkeypatch):
    a, n = 10**14, 10**15
    level = spark.createDataFrame([("en", n, "a b", "b", 1, 1, 2, a, [a + 7, a], [a + 9, a])],
                                  "lang string, n long, phrase string, last string, id long, prefix long, suffix long, f long, heads array<long>, tails array<long>")
    monkeypatch.setattr(co, "frequent_phrases", lambda *x: [level, level])
    r = co.collocations(None).first()
    assert r.score == 1000 * a * n // ((a + 7) * (a + 9))


def test_nothing(spark):
    df = spark.createDataFrame([], "lang string, text string")
    assert co.collocations(df).count() == 0
    assert co.collocations(spark.createDataFrame([("en", "a b")], df.schema)).count() == 0
