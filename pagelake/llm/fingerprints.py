"""Operator 13: document fingerprints by content-defined chunking.

A gear hash runs over the UTF-8 bytes of a text: each byte shifts the hash by one bit and adds its entry of a table, so a place's
hash depends on the 32 bytes before it alone. A chunk ends where the hash has no bit of a mask; the mask is hard (``HARD`` bits) up
to the usual size and easy (``EASY`` bits) beyond it, so that sizes crowd around the usual one (normalised chunking), from ``LEAST``
to ``MOST`` bytes. Boundaries hang on content, not on offsets, and an insertion moves only the chunks around it. The fingerprint is
the set of chunk digests (64 bits) with the chunks' byte lengths, sorted and written as 12 base64 characters each. The containment
of one text in another is the share of its distinct chunks' bytes whose chunks the other has too.

A text is one row, and nothing is shuffled for fingerprints. ``with_next`` pairs each document with the next by falling id: ids
are cut into ranges at their quantiles (an id of many rows is split by content hash), texts move once to their range, each range
is sorted and streamed, and the first text of every range is handed to the range before it.

Defined results: a null text counts as the empty one, whose fingerprint is empty; containment in an equal fingerprint is 1, and of
or in an empty one else 0. Rows of one id are ordered by a hash of their text; a null id comes after all others; after the last row
comes the first, so a single document is its own next. Repeated rows each get their row. Columns other than ``id`` and ``text`` stay
out of the results of ``with_next``. No rows give no rows.
"""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BASES, mix, pa_schema, per_batch, range_hashes, slices

#: Chunk sizes in bytes: no boundary below LEAST, hard ones up to USUAL, easy ones up to MOST (below 256: a length is a byte).
LEAST, USUAL, MOST = 16, 48, 192
HARD, EASY = 7, 4
#: Characters of text that a range of ``with_next`` should hold, and the most ranges there are (larger ones are only longer streams).
RANGE_CHARS, MAX_RANGES = 1 << 23, 10_000
#: Bytes of text that numpy holds at one time (or one text).
GROUP_BYTES = 1 << 19


# -- chunks --------------------------------------------------------------------------------------------------------

#: One 32-bit entry for each byte value, from a rule.
GEAR = (mix(np.arange(1, 257, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32)


def gear_hashes(data: np.ndarray) -> np.ndarray:
    """The gear hash after each byte: sum of GEAR[byte j back] << j over 32 bytes, by doubling the reach five times."""
    h = GEAR[data]
    for reach in (1, 2, 4, 8, 16):
        h[reach:] += h[:-reach] << np.uint32(reach)
    return h


def next_at(hit: np.ndarray) -> np.ndarray:
    """For every place the first place at or after it where ``hit`` holds (its length: none)."""
    n = len(hit)
    at = np.where(hit, np.arange(n, dtype=np.int32), np.int32(n))
    return np.append(np.minimum.accumulate(at[::-1])[::-1], np.int32(n))


def chunk_starts(data: np.ndarray, first: np.ndarray) -> list[list[int]]:
    """The starts of the chunks of each text; text i is data[first[i]:first[i + 1]]. Texts lie behind 32 zero bytes, so that no
    hash sees the text before."""
    n = len(data)
    h = gear_hashes(data)
    top = np.uint32(32)
    hard, easy = next_at((h >> (top - np.uint32(HARD))) == 0), next_at((h >> (top - np.uint32(EASY))) == 0)
    place = np.arange(n, dtype=np.int32)
    one = hard[np.minimum(place + LEAST - 1, n)]
    two = easy[np.minimum(place + USUAL - 1, n)]
    step = np.where(one < place + USUAL - 1, one + 1, np.minimum(two + 1, place + MOST))
    out = []
    for lo, hi in zip(first[::2].tolist(), first[1::2].tolist(), strict=True):
        mine = []
        while lo < hi:
            mine.append(lo)
            lo = step.item(lo)
        out.append(mine)
    return out


def fingerprints(texts: list[str]) -> list[np.ndarray]:
    """For each text its distinct (digest, length) pairs, by digest: arrays of 64-bit digests and lengths. Texts are worked on
    in groups of about GROUP_BYTES."""
    out, group, held = [], [], 0
    for t in texts:
        group.append(t.encode("utf-8", "surrogatepass"))
        held += len(group[-1])
        if held >= GROUP_BYTES:
            out += group_fingerprints(group)
            group, held = [], 0
    return out + group_fingerprints(group)


def group_fingerprints(raw: list[bytes]) -> list[np.ndarray]:
    gap = bytes(32)
    data = np.frombuffer(gap + gap.join(raw), np.uint8)
    sizes = np.array([len(r) for r in raw], np.int64)
    begin = 32 + np.concatenate(([0], np.cumsum(sizes + 32)[:-1])) if len(raw) else np.zeros(0, np.int64)
    starts = chunk_starts(data, np.column_stack((begin, begin + sizes)).ravel())
    flat = np.array([s for mine in starts for s in mine], np.int64)
    counts = np.array([len(mine) for mine in starts], np.int64)
    last = np.cumsum(counts)
    ends = np.append(flat[1:], 0)
    ends[last[counts > 0] - 1] = (begin + sizes)[counts > 0]
    digest = range_hashes(data.astype(np.uint64) + np.uint64(1), flat, ends, BASES[0])
    pairs = np.empty(len(flat), [("digest", ">u8"), ("size", "u1")])
    pairs["digest"], pairs["size"] = digest, ends - flat
    out = []
    for lo, hi in zip((last - counts).tolist(), last.tolist(), strict=True):
        _, one = np.unique(digest[lo:hi], return_index=True)
        out.append(pairs[lo:hi][one])
    return out


def written(pairs: np.ndarray) -> str:
    return base64.b64encode(pairs.tobytes()).decode()


def contained(a: np.ndarray, b: np.ndarray) -> float:
    """Share of a's bytes in chunks that b has too."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    at = np.minimum(np.searchsorted(b["digest"], a["digest"]), len(b) - 1)
    sizes = a["size"].astype(np.int64)
    return float(sizes[b["digest"][at] == a["digest"]].sum() / sizes.sum())


def containment(fingerprint: str, other: str) -> float:
    """The same from two written fingerprints."""
    a, b = (np.frombuffer(base64.b64decode(f), [("digest", ">u8"), ("size", "u1")]) for f in (fingerprint, other))
    return contained(a, b)


def fingerprint(df: DataFrame, text: str = "text") -> DataFrame:
    """All columns of ``df`` as struct ``row``, and ``fingerprint``."""
    packed = df.select(F.struct("*").alias("row"), F.coalesce(text, F.lit("")).alias("said"))
    kind = packed.schema["row"].dataType.simpleString()

    def run(part):
        return {"row": part["row"], "fingerprint": [written(p) for p in fingerprints(part["said"])]}

    return per_batch(packed, run, f"row {kind}, fingerprint string")


# -- each document and the next --------------------------------------------------------------------------------------

def bounds_of(rows: DataFrame, size: int) -> np.ndarray:
    """Bounds that cut the keys into ranges of about ``size`` characters, rising; a key of many ranges is there often."""
    total = rows.agg(F.sum(F.length("text") + 1).alias("n")).first()["n"] or 0
    parts = int(min(MAX_RANGES, max(1, total // size)))
    if parts == 1:
        return np.zeros(0, np.int64)
    shares = F.array(*[F.lit(i / parts) for i in range(1, parts)])
    return np.array(rows.select(F.percentile_approx("key", shares, 10_000).alias("q")).first()["q"], np.int64)


def range_of(bounds: np.ndarray):
    """The range of a row (0: the highest keys). Rows of a key that fills ranges are dealt to these by their tie-break."""
    @F.pandas_udf("int")
    def part(key: pd.Series, tie: pd.Series) -> pd.Series:
        above = len(bounds) - np.searchsorted(bounds, key, "right")
        same = np.searchsorted(bounds, key, "right") - np.searchsorted(bounds, key, "left")
        share = (tie.to_numpy(np.float64) + 2.0**63) / 2.0**64
        return pd.Series(above + np.minimum(same, np.floor(share * (same + 1))).astype(np.int64))

    return part


def with_next(docs: DataFrame, id: str = "doc_id", text: str = "text", size: int = RANGE_CHARS) -> DataFrame:
    """``id``, ``text`` and ``next_text`` (the text of the next document by falling id; after the last: the first), nulls as empty
    texts. Ids are integers."""
    ready, kind = in_ranges(docs, id, text, size)
    ddl = f"`{id}` {kind}, text string, next_text string"
    out = pa_schema(docs.sparkSession, ddl)
    return ready.mapInArrow(lambda batches: (as_batch(rows, out) for rows in follow(batches)), ddl)


def as_batch(columns, out: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, out, strict=True)], schema=out)


def in_ranges(docs: DataFrame, id: str, text: str, size: int) -> tuple[DataFrame, str]:
    """Sorted ranges of rows (part, loan, id, text), each closed by the loan of the next range's first text; and the ids' type."""
    low = -(1 << 63)
    rows = docs.select(F.col(id).alias("id"), F.coalesce(text, F.lit("")).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    rows = rows.select("id", "text", F.coalesce(F.col("id").cast("long"), F.lit(low)).alias("key"), F.xxhash64("text").alias("tie"))
    rows = rows.withColumn("part", range_of(bounds_of(rows, size))("key", "tie"))

    # the first row of each range: -1 - key falls as the key rises, and never overflows
    heads = rows.groupBy("part").agg(F.min(F.struct((-1 - F.col("key")).alias("falling"), "tie")).alias("head")).collect()
    heads = sorted((r["part"], -1 - r["head"]["falling"], r["head"]["tie"]) for r in heads)
    lent = [(k, t, heads[i - 1][0]) for i, (_, k, t) in enumerate(heads)]
    wanted = docs.sparkSession.createDataFrame(lent, "key long, tie long, to int")
    found = rows.drop("part").join(F.broadcast(wanted), ["key", "tie"]).groupBy("to").agg(F.min("text").alias("text"))
    loans = found.select(F.lit(None).cast(kind).alias("id"), "text", F.lit(low).alias("key"), F.lit(0).cast("long").alias("tie"), F.col("to").alias("part"), F.lit(1).alias("loan"))
    ready = (rows.withColumn("loan", F.lit(0)).unionByName(loans).repartition(max(1, len(heads)), "part")
             .sortWithinPartitions("part", "loan", F.desc("key"), "tie", "text").select("part", "loan", "id", "text"))
    return ready, kind


def follow(batches):
    """(ids, texts, next texts) of sorted ranges, in groups of bounded size; a loan ends its range and isn't given out."""
    held, out, size = None, [], 0
    for part in (b.slice(lo, hi - lo) for b in batches for lo, hi in slices(b)):
        for loan, i, t in zip(*(part.column(c).to_pylist() for c in ("loan", "id", "text")), strict=True):
            if held is not None:
                out.append((*held, t))
                size += len(t) + len(held[1])
                if size > GROUP_BYTES:
                    yield tuple(zip(*out, strict=True))
                    out, size = [], 0
            held = None if loan else (i, t)
    if out:
        yield tuple(zip(*out, strict=True))


# -- the edit test -----------------------------------------------------------------------------------------------------

def edited(text: str, following: str) -> str:
    """The last half of the code points replaced by the first as many (or all) of the following text."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def compared(docs: DataFrame, id: str = "doc_id", text: str = "text", size: int = RANGE_CHARS) -> DataFrame:
    """For each document the fingerprints of its text and its edited form, and the containment of the text in that form and in the
    next text."""
    ready, kind = in_ranges(docs, id, text, size)
    ddl = f"`{id}` {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    out = pa_schema(docs.sparkSession, ddl)

    def judged(ids, texts, following):
        changed = [edited(t, f) for t, f in zip(texts, following, strict=True)]
        each = list(dict.fromkeys((*texts, *changed, *following)))
        known = dict(zip(each, fingerprints(each), strict=True))
        return (ids, [len(t) for t in texts], [hashlib.sha256(c.encode()).hexdigest() for c in changed], [written(known[t]) for t in texts], [written(known[c]) for c in changed],
                [contained(known[t], known[c]) for t, c in zip(texts, changed, strict=True)], [contained(known[t], known[f]) for t, f in zip(texts, following, strict=True)])

    return ready.mapInArrow(lambda batches: (as_batch(judged(*rows), out) for rows in follow(batches)), ddl)
