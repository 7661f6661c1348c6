"""Operator 6: removal of repeated word sequences by fixed-block anchors.

A window is ``span`` consecutive words of one text; it is repeated if its word sequence starts anywhere else too. With blocks
of half that length, every window holds one whole block at a multiple of the block length, its anchor.

1. Index and probes: the blocks of every text are indexed, and every rolling window of block length probes them. Both
   are dealt out by hash. Within a slice of texts equal hashes are united first: a block that is repeated in its slice is
   a hit at once, and any hash leaves its slice at most once, however often it occurs. A probe needs no place, just four
   bytes of its hash, in sorted packed arrays; a block that is probed from another place is a hit.
2. Extension: around each hit block the windows of ``span`` words that it anchors are hashed with 96 bits and matched in the
   same way: those found twice are repeated. A false hit of the first step ends here.
3. Neighbouring repeated windows unite to the maximal repeats, whose words are removed.

No pairs of places are made at any step, so that a passage in a third of all texts costs what any other text costs. Equal
texts are known from a count by text key: all windows of such a text are repeated, a slice holds a text once, and one of the
copies stands for them in step 2 (one in each slice, if copies share the least id). The number of hash buckets grows with the words of the table, so that a bucket stays at about ``bucket_words``
entries.

Defined results: a null or empty text has no words; a text of fewer than ``span`` words has no window; rows are never
merged, equal rows are copies of each other (so their windows are repeated); an empty table gives no rows. Only the named
columns are read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BASES, Words, per_batch, range_hashes, row_key

_SPLIT = " \t\n\v\f\r"
PACKED = "bucket int, probes binary, marks binary, owner binary, place binary, texts binary"


def _deal(hashes: np.ndarray, width: int, bits: int, own: np.ndarray, text: np.ndarray, place: np.ndarray, keys: np.ndarray):
    """Rows of PACKED. ``hashes``: (n, words of 64 bits) of all entries; ``own``: the entries whose place is to be told if
    their hash occurs again; ``keys``: the texts, each once. Of each hash, ``width`` bytes below the bucket's bits are kept; ``marks`` has a bit for each,
    set for those of which ``owner`` (number in ``texts``) and ``place`` follow. Entries that occur twice here are hits at
    once: they go to a bucket below 0, to be passed on."""
    out = {"bucket": [], "probes": [], "marks": [], "owner": [], "place": [], "texts": []}
    if not len(hashes):
        return out
    order = np.lexsort(hashes.T[::-1]) if hashes.shape[1] > 1 else np.argsort(hashes[:, 0], kind="stable")
    h = hashes[order]
    new = np.concatenate(([True], (h[1:] != h[:-1]).any(1)))
    group = np.cumsum(new) - 1
    again = np.bincount(group)[group] > 1
    told = own[order]

    def row(bucket, probes, marks, at):
        used, index = np.unique(text[at], return_inverse=True)
        out["bucket"].append(bucket)
        out["probes"].append(probes.tobytes())
        out["marks"].append(np.packbits(marks).tobytes())
        out["owner"].append(index.astype(np.uint16 if len(used) < 1 << 16 else np.uint32).tobytes())
        out["place"].append(place[at].astype(np.uint32).tobytes())
        out["texts"].append(keys[used].tobytes())

    known = order[again & told]
    # by all texts of the slice and the stretch of the text, since a common text may begin many slices, or fill them
    mixed, stretch = int(np.bitwise_xor.reduce(keys[:, 0])), place[known] >> 14
    for i in np.unique(stretch).tolist():
        row(-1 - (mixed + i) % (1 << bits), np.zeros(0, np.uint8), np.zeros(0, bool), known[stretch == i])
    digest, unsure, at = _digest(h[new], width, bits), (told & ~again)[new], order[new]
    cut = np.searchsorted(h[new][:, 0] >> np.uint64(64 - bits), np.arange((1 << bits) + 1, dtype=np.uint64))
    for b in np.flatnonzero(np.diff(cut)).tolist():
        part = slice(cut[b], cut[b + 1])
        row(b, digest[part], unsure[part], at[part][unsure[part]])
    return out


def _once(part: dict) -> tuple[dict, np.ndarray]:
    """The slice with one row for each text key, and the keys."""
    first: dict = {}
    for i, k in enumerate(zip(part["_k0"], part["_k1"], strict=True)):
        first.setdefault(k, i)
    return {c: [v[i] for i in first.values()] for c, v in part.items()}, np.array(list(first), np.int64).reshape(-1, 2)


def _digest(h: np.ndarray, width: int, bits: int) -> np.ndarray:
    """The ``width`` bytes of each hash that follow the bucket's bits: 4, or 12 with the whole second word."""
    head = (h[:, 0] >> np.uint64(32 - bits)).astype(np.uint32)
    if width == 4:
        return head
    return np.stack((head, (h[:, 1] >> np.uint64(32)).astype(np.uint32), h[:, 1].astype(np.uint32)), 1)


def _unpack(packed: bytes, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Digests as (long part, short part)."""
    x = np.frombuffer(packed, np.uint32)
    if width == 4:
        return x, np.zeros(len(x), np.uint8)
    x = x.reshape(-1, 3)
    return x[:, 1].astype(np.uint64) << np.uint64(32) | x[:, 2], x[:, 0]


def _twice(packed: bytes, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The digests that occur more than once, sorted."""
    a, b = _unpack(packed, width)
    order = np.argsort(a, kind="stable") if width == 4 else np.lexsort((b, a))
    a, b = a[order], b[order]
    same = (a[1:] == a[:-1]) & (b[1:] == b[:-1])
    first = same & np.concatenate(([True], ~same[:-1])) if len(same) else same
    return a[1:][first], b[1:][first]


def _among(packed: bytes, width: int, known: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Which digests are known."""
    a, b = _unpack(packed, width)
    ka, kb = known
    found = np.zeros(len(a), bool)
    at = np.searchsorted(ka, a)
    while len(ka):  # one round, but for long parts that several digests share
        ok = (at < len(ka)) & (ka[np.minimum(at, len(ka) - 1)] == a)
        if not ok.any():
            break
        found |= ok & (kb[np.minimum(at, len(ka) - 1)] == b)
        at = np.where(ok, at + 1, len(ka))
    return found


def _meet(width: int):
    """For applyInPandas on a bucket: the places of entries whose hash came from more than one slice, each once for a text key,
    however many slices hold the text."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        twice = _twice(b"".join(rows["probes"]), width) if rows["bucket"].iat[0] >= 0 else None
        keys, places = [np.zeros((0, 2), np.int64)], [np.zeros(0, np.int32)]
        for probes, marks, owner, place, texts in zip(*(rows[c] for c in ("probes", "marks", "owner", "place", "texts")), strict=True):
            where = np.frombuffer(place, np.uint32).astype(np.int32)
            if not len(where):
                continue
            who = np.frombuffer(owner, np.uint16 if len(owner) == 2 * len(where) else np.uint32)
            if twice is not None:
                bits = np.unpackbits(np.frombuffer(marks, np.uint8))[: len(probes) // width].astype(bool)
                hit = _among(probes, width, twice)[bits]
                who, where = who[hit], where[hit]
            keys.append(np.frombuffer(texts, np.int64).reshape(-1, 2)[who])
            places.append(where)
        k, at = np.concatenate(keys), np.concatenate(places)
        order = np.lexsort((at, k[:, 1], k[:, 0]))
        k, at = k[order], at[order]
        other = np.concatenate(([True], (k[1:] != k[:-1]).any(1)))[: len(k)]
        new = other | np.concatenate(([True], at[1:] != at[:-1]))[: len(k)]
        k, at, other = k[new], at[new], other[new]
        cut = np.append(np.flatnonzero(other), len(k))
        lists = [at[lo:hi] for lo, hi in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]
        return pd.DataFrame({"_k0": k[other, 0], "_k1": k[other, 1], "at": pd.Series(lists, dtype=object)})

    return run


def repeats(docs: DataFrame, span: int = 35, id_col: str = "doc_id", text_col: str = "text", bucket_words: int = 8_000_000) -> DataFrame:
    """``docs`` as (id, _k0, _k1, text, copies, at): ``copies`` of the text, and the sorted word numbers where a repeated window
    starts (null for texts with copies, whose windows are all repeated, and for texts without any)."""
    block = (span + 1) // 2
    base = docs.select(F.col(id_col).alias("id"), *row_key(text_col), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    chars = base.agg(F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("n")).first().n
    bits = max(6, int(chars // 6 // bucket_words).bit_length())
    texts = base.groupBy("_k0", "_k1").agg(F.count(F.lit(1)).alias("copies"), F.min("id").alias("one"))

    def probe(part):
        part, keys = _once(part)
        w = Words(part["text"])
        start = w.windows(block)
        text = w.doc[start]
        place = start - w.first[text]
        h = range_hashes(w.hash(BASES[0]), start, start + block, BASES[1])
        return _deal(h[:, None], 4, bits, place % block == 0, text, place, keys)

    hits = per_batch(base.select("_k0", "_k1", "text"), probe, PACKED).groupBy("bucket").applyInPandas(_meet(4), "_k0 bigint, _k1 bigint, at array<int>")
    # (several buckets may tell the same place; a set grows no further than the blocks of its text)
    hits = hits.select("_k0", "_k1", F.explode("at").alias("at")).groupBy("_k0", "_k1").agg(F.collect_set("at").alias("blocks"))
    # one of equal texts stands for all; a text shorter than a window has nothing to extend
    seeds = hits.join(texts, ["_k0", "_k1"]).select("_k0", "_k1", "blocks", "one", "copies")
    # (the row is chosen in the task: as a join key it would part this join's exchange of the texts from the last one's, which is
    # the same and so is done once)
    near = base.join(seeds, ["_k0", "_k1"]).select("_k0", "_k1", "text", "blocks", "copies", F.col("id").cast("string").alias("id"), F.col("one").cast("string").alias("one"))

    def extend(part):
        mine = [i == one for i, one in zip(part["id"], part["one"], strict=True)]
        part = {c: [x for x, ok in zip(v, mine, strict=True) if ok] for c, v in part.items()}
        # (copies under the same id are still together)
        part, keys = _once(part)
        if not part["text"]:
            return _deal(np.zeros((0, 2), np.uint64), 12, bits, *[np.zeros(0, np.int64)] * 4)
        w = Words(part["text"])
        start = w.windows(span)
        text = w.doc[start]
        place = start - w.first[text]
        # the block that anchors a window is the first that begins in it
        anchor = -(-place // block) * block
        at = np.concatenate([np.asarray(b, np.int64) + (t << 32) for t, b in enumerate(part["blocks"])])
        hit = np.isin((text.astype(np.int64) << 32) + anchor, at)
        start, text, place = start[hit], text[hit], place[hit]
        words = [w.hash(b) for b in BASES]
        h = np.stack([range_hashes(x, start, start + span, b) for x, b in zip(words, BASES[::-1], strict=True)], 1)
        # all windows of a text with copies are known to be repeated: it needs no places, so that a place is told by one row only
        return _deal(h, 12, bits, (np.array(part["copies"]) == 1)[text], text, place, keys)

    found = per_batch(near, extend, PACKED).groupBy("bucket").applyInPandas(_meet(12), "_k0 bigint, _k1 bigint, at array<int>")
    found = found.groupBy("_k0", "_k1").agg(F.array_sort(F.flatten(F.collect_list("at"))).alias("at"))
    known = texts.select("_k0", "_k1", "copies").join(found, ["_k0", "_k1"], "left")
    return base.join(known, ["_k0", "_k1"])


def remove(docs: DataFrame, span: int = 35, id_col: str = "doc_id", text_col: str = "text", **settings) -> DataFrame:
    """(id, n_words, n_removed, kept_sha256, kept) of every row: ``kept`` are the words outside all repeated windows, joined by
    a space."""
    kind = docs.schema[id_col].dataType.simpleString()

    def cut(part):
        out = {"id": part["id"], "n_words": [], "n_removed": [], "kept_sha256": [], "kept": []}
        for text, copies, at in zip(part["text"], part["copies"], part["at"], strict=True):
            words = _words(text)
            n = len(words)
            if copies > 1 and n >= span:
                kept = []
            elif at:
                mark = np.zeros(n + 1, np.int64)
                at = np.asarray(at)
                np.add.at(mark, at, 1)
                np.add.at(mark, at + span, -1)
                kept = [words[i] for i in np.flatnonzero(np.cumsum(mark[:n]) == 0).tolist()]
            else:
                kept = words
            joined = " ".join(kept)
            out["n_words"].append(n)
            out["n_removed"].append(n - len(kept))
            out["kept_sha256"].append(hashlib.sha256(joined.encode("utf-8", "surrogatepass")).hexdigest())
            out["kept"].append(joined)
        return out

    found = repeats(docs, span, id_col, text_col, **settings).select("id", "text", "copies", "at")
    return per_batch(found, cut, f"`{id_col}` {kind}, n_words bigint, n_removed bigint, kept_sha256 string, kept string")


_WHITE_ONLY = str.maketrans(dict.fromkeys(_SPLIT, " "))


def _words(text: str) -> list[str]:
    """The runs of anything but ASCII white space (str.split() knows other white space too)."""
    return [w for w in text.translate(_WHITE_ONLY).split(" ") if w]
