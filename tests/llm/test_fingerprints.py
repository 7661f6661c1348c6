"""Fingerprints: the vectorised chunker against a byte-by-byte one, and the query against brute force."""
import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from pagelake.llm import fingerprints as fp
from pagelake.llm import queries


def chunks(text):
    """Byte by byte: the hash is kept mod 2**32, and a chunk ends by the rule of its length."""
    out, h, mine = [], sum(int(fp.GEAR[0]) << j for j in range(32)) % 2**32, b""
    for b in text.encode():
        h = (2 * h + int(fp.GEAR[b])) % 2**32
        mine += bytes([b])
        n = len(mine)
        bits = fp.HARD if n < fp.USUAL else fp.EASY
        if n >= fp.LEAST and h >> (32 - bits) == 0 or n == fp.MOST:
            out.append(mine)
            mine = b""
    return out + [mine] * bool(mine)


def near(a, b):
    a, b = set(chunks(a)), set(chunks(b))
    if not a or not b:
        return float(a == b)
    return sum(len(c) for c in a & b) / sum(len(c) for c in a)


def test_chunks(rows):
    texts = [r[1] or "" for r in rows]
    got = fp.fingerprints(texts)
    for t, g in zip(texts, got, strict=True):
        want = chunks(t)
        assert sorted(g["size"].tolist()) == sorted(len(c) for c in set(want)) and "".join(c.decode("latin1") for c in want) == t.encode().decode("latin1")
        assert (np.diff(g["digest"].astype(object)) > 0).all() if len(g) > 1 else True
    sizes = [len(c) for c in chunks(max(texts, key=len))]
    assert fp.USUAL < np.mean(sizes) < fp.MOST and np.mean(np.array(sizes) == fp.MOST) < 0.02
    assert fp.fingerprints([]) == []


def test_shifts():
    rng = random.Random(4)
    text = " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 9))) for _ in range(800))
    whole = fp.fingerprints([text, "x" + text, text[100:], text + " more", text[::-1]])
    base = whole[0]
    assert all(fp.contained(base, w) > 0.93 for w in whole[1:4]) and fp.contained(base, whole[4]) == 0
    assert fp.contained(whole[2], base) > 0.97
    assert fp.containment(fp.written(whole[2]), fp.written(base)) == fp.contained(whole[2], base)



@pytest.mark.parametrize("size", [1 << 23, 2000])
def test_query(spark, docs, rows, empty, size, monkeypatch):
    monkeypatch.setattr(fp, "GROUP_BYTES", size)
    got = fp.compared(docs, size=size).collect()
    # rows of one id may come in any order: walk the ids down, taking any order that the texts' hashes chose
    ties = {r[0]: r[1] for r in spark.createDataFrame([(r[1] or "",) for r in rows], "t string").selectExpr("t", "xxhash64(t)").collect()}
    order = sorted(((r[0] is None, -(r[0] or 0), ties[r[1] or ""], r[0], r[1] or "") for r in rows))
    want = Counter()
    for i, (*_, doc_id, t) in enumerate(order):
        follows = order[(i + 1) % len(order)][-1]
        half = len(t) // 2
        e = t[: len(t) - half] + follows[:half]
        want[doc_id, len(t), hashlib.sha256(e.encode()).hexdigest(), round(near(t, e), 9), round(near(t, follows), 9)] += 1
    assert Counter((r.doc_id, r.n_chars, r.edited_sha256, round(r.near_edited, 9), round(r.near_next, 9)) for r in got) == want
    same = {}
    for r in got:
        assert same.setdefault(r.edited_sha256, r.edited_fingerprint) == r.edited_fingerprint
    assert fp.compared(empty).count() == 0
    one = fp.compared(docs.where("doc_id = 73")).collect()
    assert [(r.near_next, r.n_chars) for r in one] == [(1.0, 3)]


def test_hot_id_is_split(spark):
    rng = random.Random(8)
    rows = [(7, f"text {i} " + "".join(rng.choice("abc ") for _ in range(200))) for i in range(400)] + [(i, f"other {i}" * 20) for i in range(100)] + [(None, "same")] * 50
    df = spark.createDataFrame(rows, "doc_id int, text string")
    pairs = fp.with_next(df, size=2000)
    got = pairs.collect()
    assert Counter((r.doc_id, r.text) for r in got) == Counter(rows)
    follows = Counter(r.next_text for r in got)
    assert follows == Counter(t for _, t in rows)
    assert len({r[0] for r in pairs.where("doc_id = 7").selectExpr("spark_partition_id()").distinct().collect()}) > 1


def test_whole_rows(docs, rows):
    got = fp.fingerprint(docs)
    assert Counter(tuple(r["row"]) for r in got.collect()) == Counter(rows)
    by = {}
    for r in got.collect():
        assert by.setdefault(r["row"]["text"] or "", r["fingerprint"]) == r["fingerprint"]
    assert by[""] == "" and len(set(by.values())) == len(by)
    assert "op13_document_fingerprints" in queries.QUERIES
