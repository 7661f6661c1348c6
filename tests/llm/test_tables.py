"""Operators that look across rows, against brute force on the fixture with all odd cases."""
import hashlib
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from pagelake.llm import decontaminate, jaccard, mixing, queries, substrings

from .conftest import COMMON

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def folded(text):
    text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text)


ITEMS = [(1, COMMON.upper(), 9), (2, " ".join(COMMON.split()[3:14]), 9), (3, "changed", 9), (4, "b, C; d!", 9), (5, "no such words here at all", 9), (6, None, 9),
         (7, "", 9), (8, " ".join(COMMON.split()[:10]), 9), (8, "a b c d", 9), (None, " ".join(COMMON.split()[20:32]), 9), (1, COMMON.upper(), 9)]


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame(ITEMS, "item_id bigint, text string, doc_id int")


def hits(rows):
    want = Counter()
    windows = defaultdict(set)
    for i, t, _ in ITEMS:
        w = folded(t)
        for s in range(max(len(w) - 9, 1) if w else 0):
            windows[tuple(w[s : s + 10])].add(i)
    sizes = {len(x) for x in windows}
    for i, t, *_ in rows:
        w, covered, found = folded(t), set(), set()
        for n in sizes:
            for s in range(len(w) - n + 1):
                if tuple(w[s : s + n]) in windows:
                    found |= windows[tuple(w[s : s + n])]
                    covered |= set(range(s, s + n))
        want[i, len(w), len(covered), tuple(sorted(str(x) for x in found - {None}))] += 1
    return want


@pytest.mark.parametrize("broadcast", [500_000, 0])
def test_decontamination(docs, rows, items, empty, monkeypatch, broadcast):
    monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", broadcast)
    got = decontaminate.find(docs, items).select("*", decontaminate.hit_words().alias("n_hit"))
    assert Counter((r.doc_id, r.n_words, r.n_hit, tuple(sorted(map(str, r["items"])))) for r in got.collect()) == hits(rows)
    if broadcast:
        clean = decontaminate.remove_contaminated(docs, items)
        want = Counter({k: v for k, v in hits(rows).items() if not k[2]})
        assert clean.columns == docs.columns and Counter(r.doc_id for r in clean.collect()) == Counter(k[0] for k in want.elements())
        assert decontaminate.find(empty, items).count() == 0
        none = decontaminate.find(docs, items.limit(0))
        assert none.count() == len(rows) and none.where(F.size("spans") + F.size("items") > 0).count() == 0


def test_winnowing_covers_every_span(spark):
    import random
    rng = random.Random(2)
    text = " ".join(rng.choice("abcdefgh") for _ in range(400))
    w = text.split()
    df = spark.createDataFrame([(0, text)] + [(s + 1, " ".join(w[s : s + 10])) for s in range(0, 391, 7)], "i int, t string")
    got = {r.i: {x["fp"] for x in r.f} for r in decontaminate.fingerprints(df.select("i", decontaminate.word_hashes(F.col("t")).alias("h")), "h", "f").collect()}
    assert all(got[i] and got[i] & got[0] for i in got)
    assert len(got[0]) < 250


def repeated(rows, span):
    texts = [WORD.findall(t or "") for _, t, *_ in rows]
    n = Counter(tuple(w[s : s + span]) for w in texts for s in range(len(w) - span + 1))
    want = Counter()
    for (i, *_), w in zip(rows, texts, strict=True):
        gone = {p for s in range(len(w) - span + 1) if n[tuple(w[s : s + span])] > 1 for p in range(s, s + span)}
        kept = " ".join(x for p, x in enumerate(w) if p not in gone)
        want[i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()] += 1
    return want


@pytest.mark.parametrize("span", [35, 4])
def test_substring_dedup(docs, rows, empty, span):
    got = substrings.remove(docs, span)
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got.collect()) == repeated(rows, span)
    if span == 35:
        assert substrings.remove(empty).count() == 0


def test_digests_that_share_their_long_part():
    import numpy as np
    pack = lambda x: np.array(x, np.uint32).tobytes()
    known = substrings._twice(pack([[1, 7, 7], [2, 7, 7], [1, 7, 7], [2, 7, 7], [3, 7, 7], [9, 9, 9]]), 12)
    assert substrings._among(pack([[1, 7, 7], [2, 7, 7], [3, 7, 7], [9, 9, 9]]), 12, known).tolist() == [True, True, False, False]


def test_copies_are_told_once():
    import numpy as np
    import pandas as pd
    size, n = 28, 300
    hashes = np.sort(np.random.default_rng(3).integers(0, 1 << 64, size, np.uint64))
    names = ["bucket", "probes", "marks", "owner", "place", "texts"]

    def deal(other, h):
        part = {"_k0": [7, other, 7, 7], "_k1": [8, other, 8, 8], "text": ["a", "b", "a", "a"]}
        part, keys = substrings._once(part)
        assert part["text"] == ["a", "b"] and keys.tolist() == [[7, 8], [other, other]]
        return substrings._deal(h[:, None], 4, 6, np.ones(len(h), bool), np.zeros(len(h), np.int64), np.arange(len(h)) % size, keys)

    for h, sign in ((hashes, 1), (np.concatenate((hashes, hashes)), -1)):
        rows = pd.concat([pd.DataFrame(deal(i + 100, h), columns=names) for i in range(n)])
        rows = rows[rows["place"].str.len() > 0]
        assert (rows["bucket"] * sign >= 0).all()
        # slices that begin with one common text don't meet in one bucket
        assert rows["bucket"].nunique() > 15
        told = [substrings._meet(4)(g) for _, g in rows.groupby("bucket")]
        assert all(len(g) == 1 and len(set(g["at"][0])) == len(g["at"][0]) for g in told)
        assert set(np.concatenate([g["at"][0] for g in told])) == set(range(size))


def test_copies_that_share_an_id(spark, monkeypatch):
    rows = [(i, " ".join(f"w{i}x{j}" for j in range(60))) for i in range(3)]
    rows = rows * 20 + [(None, rows[0][1] + " tail")] * 30 + [(9, "head " + rows[1][1][40:])]
    deal = substrings._deal

    def checked(hashes, width, bits, own, text, place, keys):
        assert len({tuple(k) for k in keys.tolist()}) == len(keys)
        return deal(hashes, width, bits, own, text, place, keys)

    monkeypatch.setattr(substrings, "_deal", checked)
    got = substrings.remove(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(2))
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got.collect()) == repeated(rows, 35)


def similar(rows, k=5, bound=0.8):
    texts = defaultdict(list)
    for i, t, *_ in rows:
        texts[t or ""].append(i)
    sets = {}
    for t in texts:
        w = WORD.findall(t)
        sets[t] = {tuple(w[s : s + k]) for s in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()
    up, links, keys = {t: t for t in texts}, Counter(), list(texts)

    def root(t):
        while up[t] != t:
            t = up[t]
        return t
    for a in range(len(keys)):
        for b in range(a):
            x, y = sets[keys[a]], sets[keys[b]]
            if x and y and len(x & y) >= bound * len(x | y) - 1e-9:
                links.update((keys[a], keys[b]))
                up[root(keys[a])] = root(keys[b])
    least = defaultdict(list)
    for t in texts:
        least[root(t)] += [i for i in texts[t] if i is not None]
    return Counter((i, min(least[root(t)], default=None), links[t], len(texts[t])) for t in texts for i in texts[t]), len(least)


@pytest.mark.parametrize("limit", [4096, 2])
def test_jaccard_join(docs, rows, empty, limit):
    want, classes = similar(rows)
    got = jaccard.join(docs, limit=limit)
    assert Counter(tuple(r) for r in got.collect()) == want
    if limit > 2:
        kept = jaccard.keep_one(docs)
        ids = [r.doc_id for r in kept.collect()]
        assert kept.columns == docs.columns and len(ids) == classes
        assert jaccard.join(empty).count() == 0


@pytest.mark.parametrize("limit", [4096, 2])
def test_jaccard_sets_by_range(docs, rows, limit, monkeypatch):
    import numpy as np
    monkeypatch.setattr(jaccard, "TOKENS", 64)
    links, common, most = jaccard._wide_links, jaccard._common, []
    monkeypatch.setattr(jaccard, "_wide_links", lambda *a: most.append(a[0].agg(F.max("n")).first()[0]) or links(*a))
    got = jaccard.join(docs, limit=limit)
    assert Counter(tuple(r) for r in got.collect()) == similar(rows)[0]
    assert most and most[0] > 1
    # what is held at once stays near the bound, however long the texts are
    sets = [np.sort(np.random.default_rng(i).integers(0, 1 << 64, 5000, np.uint64)) for i in range(2)] * 2
    n, sizes = 50, []
    names = ("path", "block", "two", "_k0", "_k1", "size", "sketch", "before", "half", "tokens", "n")
    sketch = np.ones(jaccard.BINS, np.uint16).tobytes()
    part = dict(zip(names, zip(*((1, 0, False, i, i, 5000, sketch, [], 0, s.tobytes(), n) for i, s in enumerate(sets))), strict=True))
    cut = jaccard._ranges(part)
    each = sorted((dict(zip(cut, v, strict=True)) for v in zip(*cut.values(), strict=True)), key=lambda x: (x["part"], x["_k0"]))
    monkeypatch.setattr(jaccard, "_common", lambda s, pairs: sizes.append(sum(map(len, s))) or common(s, pairs))
    found, = jaccard._links_by_range(iter(each), 0.8)
    assert found["_k0"] == [0, 1, 2, 3] and found["links"] == [1] * 4 and found["r0"] == [0, 1, 0, 1]
    assert len(sizes) == n and sum(sizes) == 20000 and max(sizes) < 2 * 20000 / n


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(50, 60), (61, 50), (62, 61), (70, 71)]
    got = {r.u: r.v for r in jaccard.components(spark.createDataFrame(edges + [(9, 9)], "u bigint, v bigint")).collect()}
    assert got == {i: 0 for i in range(41)} | {50: 50, 60: 50, 61: 50, 62: 50, 70: 70, 71: 70}


def share(children, total):
    """Water-filling by repeated sharing: (cap, weight) -> budgets, before rounding."""
    left, out, open_ = total, {}, dict(children)
    while open_:
        w = sum(x for _, x in open_.values())
        full = [k for k, (c, x) in open_.items() if x and c * w <= x * left]
        if not w or not full:
            out |= {k: x * left // w if w else 0 for k, (c, x) in open_.items()}
            break
        k = min(full, key=lambda k: (open_[k][0] / open_[k][1], k))
        out[k] = open_[k][0]
        left -= out[k]
        del open_[k]
    return out


def mixed(rows, levels, percent, weights, epochs, seed):
    """Counter of (id, text, epoch), from rows (id, text, *levels): budgets by repeated sharing, prefixes by going through them."""
    supply = Counter()
    for _, t, *at in rows:
        supply[tuple(at)] += len(WORD.findall(t or ""))
    budget = {(): sum(supply.values()) * percent // 100}
    for depth, name in enumerate(levels, 1):
        now = {}
        for node, b in budget.items():
            below = Counter()
            for leaf, n in supply.items():
                if leaf[: depth - 1] == node:
                    below[leaf[:depth]] += epochs * n
            now |= share({k: (n, weights.get(name, {}).get(k[-1], 1000)) for k, n in below.items()}, b)
        budget = now
    md5 = lambda x: hashlib.md5(x.encode()).hexdigest()
    want = Counter()
    for leaf, b in budget.items():
        if b <= 0:
            continue
        whole, rest = divmod(b, supply[leaf])
        mine = [(i, t or "") for i, t, *at in rows if tuple(at) == leaf]
        for i, t in mine:
            want.update((i, t, e) for e in range(1, whole + 1))
        run = 0
        for _, i, t in sorted((md5(f"{seed}|{whole + 1}|" + md5(("" if i is None else f"{i}|") + md5(t))), -1 if i is None else i, t) for i, t in mine):
            run += len(WORD.findall(t))
            if run > rest:
                break
            want[None if i == -1 else i, t, whole + 1] += 1
    return want


def of(chosen):
    return Counter((r.doc_id, r.text or "", r["mix"]["epoch"]) for r in chosen.collect())


def test_mixing(docs, rows, empty):
    weights = {"lang": {"de": 100, "": 0}, "source": {"src1": 5000}}
    levels = {"lang": F.col("lang"), "source": F.col("source")}
    out = mixing.mix(docs, levels, 80, weights, max_epochs=2, seed=5)
    assert out.columns == [*docs.columns, "mix"]
    narrow = [(i, t, lang or "", source or "") for i, t, lang, source, *_ in rows]
    assert of(out) == mixed(narrow, levels, 80, weights, 2, 5)
    assert mixing.mix(empty, levels).count() == 0 and mixing.mix(docs, levels, 0).count() == 0


@pytest.mark.parametrize("percent", [1, 33, 50, 150])
def test_mixing_equal_rows(spark, percent):
    """A hundred equal rows: the budget is used up to the last copy that fits; an input column may be called mix."""
    rows = [(1, "one two", "en", "x", "a")] * 100 + [(1, "one two", "en", "x", "b")] * 20 + [(i, "w " * i, "en", "y", "c") for i in range(2, 8)] + [(9, "", "de", "z", "d"), (9, None, "de", "z", "d")]
    df = spark.createDataFrame(rows, "doc_id int, text string, lang string, mix string, other string").repartition(3)
    out = mixing.mix(df, {"lang": F.col("lang")}, percent, {}, max_epochs=2, seed=3)
    assert out.columns == ["doc_id", "text", "lang", "other", "mix"]
    got = of(out)
    assert got == mixed([(i, t, lang) for i, t, lang, *_ in rows], ["lang"], percent, {}, 2, 3)
    per = Counter((r.doc_id, r.text, r.other, r["mix"]["epoch"]) for r in out.collect())
    assert all(n <= Counter(rows_[:2] + rows_[4:] for rows_ in rows)[k[:3]] for k, n in per.items())
    total = sum(len(WORD.findall(r[1] or "")) for r in rows) * percent // 100
    assert 0 <= total - sum(n * len(WORD.findall(k[1])) for k, n in got.items()) < 8


def test_pipeline_stages(spark, docs, rows, tmp_path):
    """Each stage on the fixture, by brute force on its own input."""
    import corpus_pipeline

    sf = str(tmp_path)
    docs.write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(40)], "doc_id bigint, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    spark.createDataFrame([(1, " ".join(COMMON.split()[2:20]))], "item_id bigint, text string").write.parquet(f"{sf}/benchmark.parquet")
    now, seen = spark.read.parquet(f"{sf}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES[:4]:
        after = stage(spark, now, sf)
        after.write.parquet(f"{sf}/{name}.parquet")
        now = spark.read.parquet(f"{sf}/{name}.parquet")
        assert now.columns == docs.columns
        seen.append([tuple(r) for r in now.collect()])
    def passes(t):
        w = WORD.findall(t or "")
        n = Counter(tuple(w[j : j + 5]) for j in range(len(w) - 4))
        again = {p for j in range(len(w) - 4) if n[tuple(w[j : j + 5])] > 1 for p in range(j, j + 5)}
        return len(w) >= 10 and 100 * len(again) <= 20 * len(w)
    assert Counter(seen[0]) == Counter(r for r in rows if passes(r[1]))
    assert len(seen[1]) == similar(seen[0])[1] and not Counter(seen[1]) - Counter(seen[0])
    bad = {tuple(COMMON.split()[s : s + 10]) for s in range(2, 11)}
    def dirty(t):
        w = folded(t)
        return any(tuple(w[s : s + 10]) in bad for s in range(len(w)))
    assert Counter(seen[2]) == Counter(r for r in seen[1] if not dirty(r[1])) and len(seen[2]) < len(seen[1])
    assert len(seen[3]) == len(seen[2]) and not any("hunter22" in r[1] for r in seen[3])
    final = corpus_pipeline.run(spark, sf)
    domain = lambda source: "d" + str(int(re.search("[0-9]+$", source)[0]) % 4) if re.search("[0-9]+$", source or "") else ""
    narrow = [(i, t, domain(source), lang or "", source or "") for i, t, lang, source, *_ in seen[3]]
    assert of(final) == mixed(narrow, ["domain", "lang", "source"], queries.MIX_PERCENT, queries.MIX_WEIGHTS, queries.MIX_EPOCHS, queries.MIX_SEED)
