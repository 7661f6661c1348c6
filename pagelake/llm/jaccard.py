"""Operator 8: n-gram Jaccard self-join by chosen paths.

The set of a text holds the hashes of its ``k``-word shingles (fewer words: one shingle). Texts that are equal come together
first; everything below is between different texts.

* Runs. In each run a text chooses every shingle whose seeded hash lies below 1/(similarity * size), about one, and joins the
  bucket of (run, shingle). Two texts at the wanted similarity share a bucket of a run with probability 1 - 1/e at least;
  the number of runs follows from ``recall``.
* Recursion. A bucket of more than ``limit`` texts is split by further chosen shingles: its members join the buckets of the
  paths (shingle, next shingle), sampled anew for each path from all that they chose. Paths that are still too large hold one
  large group of near copies: they are compared in tasks of two blocks of ``limit`` members, so that no task grows.
  Inside a task, a bucket of more than 128 texts is split again by sampled shingles, the least hash of each of 64 bins: only
  texts that share one of these are paired, unless most of them do.
* Brute force. A pair is dealt with in the first bucket (by key) that both are in, and nowhere else. Sizes and 64-bin
  one-permutation sketches rule out most pairs (a pair at similarity 0.8 stays far above the bound of 0.45); for what is
  left, the shingle sets of the texts concerned are fetched and the similarity is exact. Sets of more than ``TOKENS`` shingles
  together come one range of hashes after another, and the common shingles of each pair are added up: no row grows with the
  length of the texts.

Pairs never become rows: a bucket gives each of its texts a number of links and a tree of links, from which connected
classes are found by large-star and small-star rounds on edges (checkpointed in the shared folder).

Defined results: a null text is empty; texts without words have no shingles and no links, but are copies of each other;
repeated rows are copies; the class id is the least id in the class (null ids last); an empty table gives no rows. Only the
named columns are read; :func:`keep_one` keeps all columns of the rows it keeps.
"""

from __future__ import annotations

from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BASES, Words, materialize, mix, pa_schema, per_batch, range_hashes, row_key, slices

BINS = 64
#: Keys (of 16 bytes, with an id) that may be broadcast: about 100 MB.
BROADCAST_ROWS = 2_000_000
#: Share of sketch bins that agree, below which a pair isn't looked at: 7 standard deviations under 0.8.
SKETCH = 0.45
#: Shingles (of 8 bytes) of a bucket's texts that one row may hold.
TOKENS = 1 << 21
LINKS = "_k0 bigint, _k1 bigint, links bigint, r0 bigint, r1 bigint"


def shingles(texts: list[str | None], k: int) -> tuple[np.ndarray, np.ndarray]:
    """(text number, shingle hash) without repeats, by text."""
    w = Words(texts)
    h = w.hash(BASES[0])
    start = w.windows(k)
    text, hashes = w.doc[start], range_hashes(h, start, start + k, BASES[1])
    size = np.diff(w.first)[: len(texts)]
    short = np.flatnonzero((size > 0) & (size < k))
    text = np.concatenate((text, short))
    hashes = np.concatenate((hashes, range_hashes(h, w.first[short], w.first[short + 1], BASES[1])))
    order = np.lexsort((hashes, text))
    text, hashes = text[order], hashes[order]
    new = np.concatenate(([True], (text[1:] != text[:-1]) | (hashes[1:] != hashes[:-1]))) if len(text) else np.zeros(0, bool)
    return text[new], hashes[new]


def runs_for(recall: float) -> int:
    """Runs after which a pair shares two buckets with probability ``recall``, each run failing with 1/e at most. (Two, since a
    bucket that is too large is split by another one.)"""
    r = 1
    while (1 + r * 1.7) * np.exp(-r) > 1 - recall:
        r += 1
    return r


def _chosen(part: dict, k: int, similarity: float, runs: int) -> dict:
    """size, sketch and chosen keys of every text."""
    n = len(part["text"])
    text, h = shingles(part["text"], k)
    size = np.bincount(text, minlength=n)
    bound = np.minimum(np.float64(1), 1 / (similarity * np.maximum(size, 1)))[text] * 2.0**64
    keys, owner = [], []
    for r in range(runs):
        seed = mix(np.array([r + 1], np.uint64))[0]
        x = mix(h ^ seed)
        take = x.astype(np.float64) < bound
        keys.append(mix(x[take] + np.uint64(r)))
        owner.append(text[take])
    keys, owner = np.concatenate(keys).view(np.int64), np.concatenate(owner)
    order = np.lexsort((keys, owner))
    keys, owner = keys[order], owner[order]
    cut = np.searchsorted(owner, np.arange(n + 1))
    # the least hash of every bin; its low bits, made 1 to 65535, stand for it
    sketch = np.zeros((n, BINS), np.uint16)
    x = mix(h + np.uint64(0x5851F42D4C957F2D))
    place = text * BINS + (x >> np.uint64(58)).astype(np.int64)
    order = np.lexsort((x, place))
    place, x = place[order], x[order]
    first = np.concatenate(([True], place[1:] != place[:-1])) if len(place) else np.zeros(0, bool)
    sketch.reshape(-1)[place[first]] = (x[first] & np.uint64(0xFFFF)).astype(np.int64) % 65535 + 1
    return {"id": part["id"], "_k0": part["_k0"], "_k1": part["_k1"], "size": size,
            "sketch": [s.tobytes() for s in sketch], "keys": [keys[cut[i] : cut[i + 1]] for i in range(n)]}


# -- pairs of a bucket -------------------------------------------------------------------------------------------
# A member is a dict: k (k0, k1), size, sketch, before (its bucket keys before this one), half (its block, or 0),
# and, in the second round, tokens.

def candidate_pairs(members: list[dict], similarity: float, halves: bool) -> np.ndarray:
    """Pairs (i, j), i < j, that first meet in this bucket and may be similar."""
    m = len(members)
    size = np.array([x["size"] for x in members], np.int64)
    half = np.array([x["half"] for x in members])
    sketch = np.frombuffer(b"".join(x["sketch"] for x in members), np.uint16).reshape(m, BINS)
    pairs = _sharing(sketch) if m > 128 else None
    if pairs is None:
        pairs = _all_alike(size, sketch, similarity)
    else:
        i, j, same = pairs
        full = np.packbits(sketch > 0, axis=1).view(np.uint64)[:, 0]
        union = np.bitwise_count(full[i] | full[j])
        a, b = size[i], size[j]
        good = (same >= SKETCH * union) & (np.minimum(a, b) >= similarity * np.maximum(a, b))
        pairs = np.stack((i[good], j[good]), 1)
    if halves:
        pairs = pairs[half[pairs[:, 0]] != half[pairs[:, 1]]]
    return pairs[~_met(members, pairs)]


def _sharing(sketch: np.ndarray):
    """(i, j, bins that agree) of the pairs that agree in a bin, or None if these are a large part of all pairs."""
    m = len(sketch)
    who, place = np.nonzero(sketch)
    key = place.astype(np.int64) << 16 | sketch[who, place]
    order = np.lexsort((who, key))
    who, key = who[order], key[order]
    cut = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1], [True])))
    count = np.diff(cut)
    if (count.astype(float) * (count - 1)).sum() > m * (m - 1.0):
        return None
    codes = []
    for s in np.unique(count[count > 1]).tolist():
        group = who[cut[:-1][count == s][:, None] + np.arange(s)]
        a, b = np.triu_indices(s, 1)
        codes.append((group[:, a].astype(np.int64) * m + group[:, b]).ravel())
    code, same = np.unique(np.concatenate(codes), return_counts=True) if codes else (np.zeros(0, np.int64), np.zeros(0, np.int64))
    return code // m, code % m, same


def _all_alike(size: np.ndarray, sketch: np.ndarray, similarity: float) -> np.ndarray:
    """The pairs (i, j), i < j, of sizes and sketches that allow the similarity."""
    m, out = len(size), []
    order = np.argsort(size, kind="stable")
    sorted_size = size[order]
    # in order of size, the partners of a text are the next ones, up to its size / similarity
    last = np.searchsorted(sorted_size, np.floor(sorted_size / similarity + 1e-9), side="right")
    step = 0
    while step < m:
        n, stop = 0, step
        while stop < m and (stop == step or n + last[stop] - stop <= 65536):
            n += last[stop] - stop
            stop += 1
        i = np.repeat(np.arange(step, stop), last[step:stop] - np.arange(step, stop) - 1)
        j = np.concatenate([np.arange(a + 1, last[a]) for a in range(step, stop)])
        x, y = sketch[order[i]], sketch[order[j]]
        good = ((x == y) & (x > 0)).sum(1) >= SKETCH * ((x > 0) | (y > 0)).sum(1)
        out.append(np.sort(np.stack((order[i[good]], order[j[good]]), 1), axis=1))
        step = stop
    pairs = np.concatenate(out)
    return pairs[np.lexsort((pairs[:, 1], pairs[:, 0]))]


def _met(members: list[dict], pairs: np.ndarray) -> np.ndarray:
    """Which pairs share a bucket before this one."""
    m = len(members)
    keys, at = np.unique(np.concatenate([np.asarray(x["before"], np.int64) for x in members]), return_inverse=True)
    who = np.repeat(np.arange(m), [len(x["before"]) for x in members])
    shared = np.bincount(at, minlength=len(keys)) > 1
    found = np.zeros(len(pairs), bool)
    if not len(pairs) or not shared.any():
        return found
    column, keep = np.cumsum(shared) - 1, shared[at]
    bits = np.zeros((m, int(shared.sum())), bool)
    bits[who[keep], column[at[keep]]] = True
    bits = np.packbits(bits, axis=1)
    step = max(1, (1 << 24) // bits.shape[1])
    for lo in range(0, len(pairs), step):
        found[lo : lo + step] = (bits[pairs[lo : lo + step, 0]] & bits[pairs[lo : lo + step, 1]]).any(1)
    return found


def similar_pairs(members: list[dict], pairs: np.ndarray, similarity: float) -> np.ndarray:
    """Those of the pairs whose sets have the similarity."""
    return pairs[_alike(members, pairs, _common([np.frombuffer(x["tokens"], np.uint64) for x in members], pairs), similarity)]


def _alike(members: list[dict], pairs: np.ndarray, common: np.ndarray, similarity: float) -> np.ndarray:
    size = np.array([x["size"] for x in members], np.int64)
    union = size[pairs[:, 0]] + size[pairs[:, 1]] - common
    return common >= similarity * union - 1e-9


def _common(sets: list[np.ndarray], pairs: np.ndarray) -> np.ndarray:
    """How many shingles the two sets of each pair share."""
    size = np.array([len(s) for s in sets], np.int64)
    if len(pairs) <= 8 * len(sets):
        common = np.array([len(np.intersect1d(sets[i], sets[j], assume_unique=True)) for i, j in pairs.tolist()], np.int64)
    else:
        # products of 0/1 matrices, some thousand shared shingles at a time
        token, who = np.unique(np.concatenate(sets), return_inverse=True)[1], np.repeat(np.arange(len(sets)), size)
        shared = np.bincount(token) > 1
        keep = shared[token]
        token, who = (np.cumsum(shared) - 1)[token[keep]], who[keep]
        order = np.argsort(token, kind="stable")
        token, who = token[order], who[order]
        both = np.zeros((len(sets), len(sets)), np.float32)
        width = 2048
        for lo in range(0, int(token[-1]) + 1 if len(token) else 0, width):
            a, b = np.searchsorted(token, (lo, lo + width))
            x = np.zeros((len(sets), width), np.float32)
            x[who[a:b], token[a:b] - lo] = 1
            both += x @ x.T
        common = both[pairs[:, 0], pairs[:, 1]].astype(np.int64)
    return common


def _in_order(bucket: list[dict]) -> list[dict]:
    return sorted(bucket, key=lambda x: (x["_k0"], x["_k1"]))


def _who_remains(part: dict, similarity: float) -> dict:
    """First round: the texts of each bucket that have a candidate there."""
    fields = ("_k0", "_k1", "size", "sketch", "before", "half")
    out = {"path": [], "block": [], "two": []} | {f: [] for f in fields}
    for path, block, two, bucket in zip(part["path"], part["block"], part["two"], part["members"], strict=True):
        bucket = _in_order(bucket)
        for i in np.unique(candidate_pairs(bucket, similarity, two)).tolist():
            for c, v in (("path", path), ("block", block), ("two", two), *((f, bucket[i][f]) for f in fields)):
                out[c].append(v)
    return out


def _links(part: dict, similarity: float) -> dict:
    """Second round: links of each text in the bucket, and the root of its tree."""
    out = {"_k0": [], "_k1": [], "links": [], "r0": [], "r1": []}
    for two, bucket in zip(part["two"], part["members"], strict=True):
        bucket = _in_order(bucket)
        _tree(bucket, similar_pairs(bucket, candidate_pairs(bucket, similarity, two), similarity), out)
    return out


def _tree(bucket: list[dict], pairs: np.ndarray, out: dict) -> None:
    """Add the rows of a bucket, of which ``pairs`` are linked."""
    if not len(pairs):
        return
    links = np.bincount(pairs.ravel(), minlength=len(bucket))
    root = np.arange(len(bucket))
    while True:  # the least member that is reached
        was = root.copy()
        np.minimum.at(root, pairs[:, 0], was[pairs[:, 1]])
        np.minimum.at(root, pairs[:, 1], was[pairs[:, 0]])
        root = root[root]
        if (root == was).all():
            break
    for i in np.flatnonzero(links).tolist():
        out["_k0"].append(bucket[i]["_k0"])
        out["_k1"].append(bucket[i]["_k1"])
        out["links"].append(int(links[i]))
        out["r0"].append(bucket[root[i]]["_k0"])
        out["r1"].append(bucket[root[i]]["_k1"])


def _ranges(part: dict) -> dict:
    """Each row ``n`` times, with the shingles of one range of hashes."""
    out = {c: [] for c in ("path", "block", "two", "part", "_k0", "_k1", "size", "sketch", "before", "half", "tokens")}
    for i, (n, tokens) in enumerate(zip(part["n"], part["tokens"], strict=True)):
        h = np.frombuffer(tokens, np.uint64)
        which = (mix(h) % np.uint64(n)).astype(np.int64)
        order = np.argsort(which, kind="stable")
        cut = np.searchsorted(which[order], np.arange(n + 1))
        for p in range(n):
            for c in ("path", "block", "two", "_k0", "_k1", "size", "half"):
                out[c].append(part[c][i])
            out["part"].append(p)
            # (what the first range tells isn't repeated)
            out["sketch"].append(part["sketch"][i] if p == 0 else None)
            out["before"].append(part["before"][i] if p == 0 else None)
            out["tokens"].append(h[order[cut[p] : cut[p + 1]]].tobytes())
    return out


def _links_by_range(rows, similarity: float):
    """As :func:`_links`, from rows of :func:`_ranges` in order of bucket, range and text: the sets of one range are held."""
    for (_, _, two), bucket in groupby(rows, key=lambda x: (x["path"], x["block"], x["two"])):
        members = None
        for _, part in groupby(bucket, key=lambda x: x["part"]):
            part = list(part)
            if members is None:
                members = [{c: v for c, v in x.items() if c != "tokens"} for x in part]
                pairs = candidate_pairs(members, similarity, two)
                common = np.zeros(len(pairs), np.int64)
            common += _common([np.frombuffer(x["tokens"], np.uint64) for x in part], pairs)
        out = {"_k0": [], "_k1": [], "links": [], "r0": [], "r1": []}
        _tree(members, pairs[_alike(members, pairs, common, similarity)], out)
        yield out


# -- the join ----------------------------------------------------------------------------------------------------

def join(docs: DataFrame, similarity: float = 0.8, k: int = 5, recall: float = 1 - 1e-6, limit: int = 4096, id_col: str = "doc_id",
         text_col: str = "text") -> DataFrame:
    """(id, class_id, n_links, n_copies) of every row: the class of texts connected by links, the number of different texts at
    the similarity, and the rows with the same text."""
    found = _classes(docs, similarity, k, recall, limit, id_col, text_col)
    return found.select(F.col("id").alias(id_col), "class_id", "n_links", "n_copies")


def _classes(docs: DataFrame, similarity: float, k: int, recall: float, limit: int, id_col: str, text_col: str) -> DataFrame:
    """(id, class_id, n_links, n_copies, _k0, _k1, root): also the key of the text, and the least key of the class."""
    kind = docs.schema[id_col].dataType.simpleString()
    runs = runs_for(recall)
    base = docs.select(F.col(id_col).alias("id"), *row_key(text_col), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    base = _keyed(base)
    signed = materialize(per_batch(base, lambda p: _chosen(p, k, similarity, runs),
                                   f"id {kind}, _k0 bigint, _k1 bigint, size int, sketch binary, keys array<bigint>"), "jaccard-sets")
    key = ["_k0", "_k1"]
    texts = signed.groupBy(*key).agg(F.min("id").alias("one"), F.count(F.lit(1)).alias("copies"), F.first("size").alias("size"),
                                     F.first("sketch").alias("sketch"), F.first("keys").alias("keys"))
    texts = materialize(texts, "jaccard-texts")
    # level 1: keys that different texts share
    rows = texts.select(*key, F.explode_outer("keys").alias("path")).where("path is not null")
    size = rows.groupBy("path").agg(F.count(F.lit(1)).alias("m")).where("m > 1")
    rows = rows.join(size, "path").select(*key, "path", (F.col("m") > limit).alias("large"))
    live = rows.groupBy(*key).agg(F.sort_array(F.collect_set(F.when(~F.col("large"), F.col("path")))).alias("light"),
                                  F.sort_array(F.collect_set(F.when(F.col("large"), F.col("path")))).alias("large"))
    live = materialize(live.join(texts.select(*key, "one", "size", "sketch"), key), "jaccard-live")
    member = lambda before, half: F.struct(*key, "size", "sketch", before.alias("before"), half.alias("half"))
    zero = F.lit(0).cast("long")

    light = live.select("*", F.posexplode_outer("light").alias("i", "path")).where("path is not null")
    light = light.select("path", zero.alias("block"), F.lit(False).alias("two"), member(F.slice("light", F.lit(1), F.col("i")), F.lit(0)).alias("member"), *key)
    # level 2: paths from a large bucket's key through another key of the text, about four for each
    below = lambda x: F.shiftrightunsigned(F.xxhash64("a", x), 1).cast("double") * F.size("keys") < 4 * 2.0**63
    near = F.filter("keys", lambda x: (x != F.col("a")) & below(x))
    deep = live.where(F.size("large") > 0).select(*key, "size", "sketch", "light", F.col("large").alias("keys"), F.explode_outer("large").alias("a"))
    deep = deep.where("a is not null").select(*key, "size", "sketch", "light", F.transform(near, lambda x: F.xxhash64("a", x)).alias("p"))
    deep = deep.groupBy(*key).agg(F.first("size").alias("size"), F.first("sketch").alias("sketch"), F.first("light").alias("light"),
                                  F.array_sort(F.array_distinct(F.flatten(F.collect_list("p")))).alias("p"))
    deep = deep.select("*", F.posexplode_outer("p").alias("i", "path")).where("path is not null")
    deep = deep.join(deep.groupBy("path").agg(F.count(F.lit(1)).alias("m")).where("m > 1"), "path")
    # a path that is still too large: blocks of members, and a task for every two of them (or one with itself)
    blocks = F.ceil(F.col("m") / limit).cast("int")
    mine = F.pmod(F.xxhash64(*key), blocks).cast("int")
    deep = deep.withColumn("n", blocks).withColumn("mine", mine)
    task = F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda b: F.struct((F.least(b, F.col("mine")) * F.col("n") + F.greatest(b, F.col("mine"))).cast("long").alias("block"), (b != F.col("mine")).alias("two")))
    deep = deep.withColumn("before", F.concat("light", F.slice("p", F.lit(1), F.col("i")))).select("path", F.inline_outer(task), member(F.col("before"), F.col("mine")).alias("member"), *key)
    places = light.unionByName(deep)
    found = places.groupBy("path", "block", "two").agg(F.collect_list("member").alias("members")).where(F.size("members") > 1)
    remains = per_batch(found.select("path", "block", "two", "members"), lambda p: _who_remains(p, similarity),
                        "path bigint, block bigint, two boolean, _k0 bigint, _k1 bigint, size int, sketch binary, before array<bigint>, half int")
    remains = materialize(remains, "jaccard-remains")
    # the sets of the texts that remain, from one row with the text; the keys are few beside the texts, which aren't shuffled if a
    # count proves that they can be broadcast
    wanted = materialize(remains.select(*key).distinct().join(texts.select(*key, "one"), key), "jaccard-wanted")
    wanted = F.broadcast(wanted) if wanted.count() <= BROADCAST_ROWS else wanted
    text = base.join(wanted, key).where(F.col("id").eqNullSafe(F.col("one"))).select(*key, "text")

    def sets(part):
        owner, h = shingles(part["text"], k)
        cut = np.searchsorted(owner, np.arange(len(part["text"]) + 1))
        return {"_k0": part["_k0"], "_k1": part["_k1"], "tokens": [h[a:b].tobytes() for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]}

    tokens = per_batch(text, sets, "_k0 bigint, _k1 bigint, tokens binary").dropDuplicates(key)
    bucket = ["path", "block", "two"]
    wide = remains.groupBy(*bucket).agg(F.ceil(F.sum("size") / TOKENS).cast("int").alias("n")).where("n > 1")
    wide = materialize(wide, "jaccard-wide")
    some = not wide.isEmpty()
    narrow = remains.join(wide, bucket, "left_anti") if some else remains
    full = narrow.join(tokens, key).select("path", "block", "two", F.struct(*key, "size", "sketch", "before", "half", "tokens").alias("member"))
    full = full.groupBy(*bucket).agg(F.collect_list("member").alias("members"))
    linked = per_batch(full.select("two", "members"), lambda p: _links(p, similarity), LINKS)
    if some:
        linked = linked.unionByName(_wide_links(remains.join(wide, bucket).join(tokens, key), similarity))
    linked = materialize(linked, "jaccard-links")
    edges = linked.select(F.struct(*key).alias("u"), F.struct(F.col("r0").alias("_k0"), F.col("r1").alias("_k1")).alias("v"))
    label = components(edges).select("u._k0", "u._k1", F.col("v").alias("root"))
    counts = linked.groupBy(*key).agg(F.sum("links").alias("n_links"))
    known = texts.select(*key, "one", "copies").join(counts, key, "left").join(label, key, "left")
    known = known.withColumn("root", F.coalesce("root", F.struct(*key)))
    names = known.groupBy("root").agg(F.min("one").alias("class_id"))
    known = known.join(names, "root").select(*key, "root", "class_id", F.coalesce("n_links", zero).alias("n_links"), F.col("copies").alias("n_copies"))
    return signed.select("id", *key).join(known, key)


def _wide_links(rows: DataFrame, similarity: float) -> DataFrame:
    """LINKS of buckets whose sets don't fit in a row: their members are sorted, not gathered."""
    rows = per_batch(rows.select("path", "block", "two", "n", "_k0", "_k1", "size", "sketch", "before", "half", "tokens"), _ranges,
                     "path bigint, block bigint, two boolean, part int, _k0 bigint, _k1 bigint, size int, sketch binary, before array<bigint>, half int, tokens binary")
    rows = rows.repartition("path", "block", "two").sortWithinPartitions("path", "block", "two", "part", "_k0", "_k1")
    out = pa_schema(rows.sparkSession, LINKS)

    def run(batches):
        each = (x for b in batches for lo, hi in slices(b) for x in b.slice(lo, hi - lo).to_pylist())
        for got in _links_by_range(each, similarity):
            yield pa.RecordBatch.from_arrays([pa.array(got[f.name], type=f.type) for f in out], schema=out)

    return rows.mapInArrow(run, LINKS)


def components(edges: DataFrame) -> DataFrame:
    """(u, v): every node of the edges (u, v), and the least node it is connected with. Rounds of large-star and small-star;
    each is an aggregate and a join, so that no node's neighbours are gathered."""
    edges = materialize(edges.where("u <> v").distinct(), "edges")
    seen = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        edges = materialize(small.where("u <> v").distinct(), "edges")
        now = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if now == seen or not now.n:
            break
        seen = now
    root = edges.select("v").distinct()
    return edges.unionByName(root.select(F.col("v").alias("u"), "v"))


def keep_one(docs: DataFrame, similarity: float = 0.8, k: int = 5, recall: float = 1 - 1e-6, limit: int = 4096, id_col: str = "doc_id",
             text_col: str = "text") -> DataFrame:
    """``docs`` with one row of every class: the one with the least id (null ids last), then the least text key. All columns
    stay."""
    found = materialize(_classes(docs, similarity, k, recall, limit, id_col, text_col), "jaccard-classes")
    order = F.struct(F.col("id").isNull().alias("none"), "id", "_k0", "_k1")
    best = found.groupBy("root").agg(F.min(order).alias("b")).select(F.col("b.id").alias("b_id"), F.col("b._k0").alias("b0"), F.col("b._k1").alias("b1"))
    base = _keyed(docs.select(F.struct("*").alias("_row"), F.col(id_col).alias("id"), *row_key(text_col), F.coalesce(F.col(text_col), F.lit("")).alias("text")))
    kept = base.join(best, F.col("id").eqNullSafe(F.col("b_id")) & (F.col("_k0") == F.col("b0")) & (F.col("_k1") == F.col("b1")))
    # rows that repeat an id with the same text are still together
    times = found.groupBy(F.col("id").alias("t_id"), F.col("_k0").alias("t0"), F.col("_k1").alias("t1")).agg(F.count(F.lit(1)).alias("times")).where("times > 1")
    if times.isEmpty():
        return kept.select("_row.*")
    kept = kept.join(times, F.col("id").eqNullSafe(F.col("t_id")) & (F.col("_k0") == F.col("t0")) & (F.col("_k1") == F.col("t1")), "left")
    more = kept.where("times is not null").dropDuplicates(["id", "_k0", "_k1"])
    return kept.where("times is null").unionByName(more).select("_row.*")


def _keyed(base: DataFrame) -> DataFrame:
    """row_key tells null from empty; both are the empty text here."""
    keys = {c: F.when(F.col("text") == "", F.lit(0).cast("long")).otherwise(F.col(c)) for c in ("_k0", "_k1")}
    return base.withColumns(keys)
