"""Operator 12: collocations counted in quotient filters.

Texts are cut into *shards* of bounded size, inside which words are numbered. Words that reach ``least`` in their language get
corpus-wide ids, and from then on a shard is a list of places with ids. Phrases grow by one word a round: two neighbouring frequent
k-grams, packed as the pair of their ids, are a (k + 1)-gram (for k = 1: of its word ids), and nothing else can reach ``least``, since
no phrase is more frequent than its parts. A shard counts its pairs in a counting quotient filter: a Feistel network permutes the
pair of ids invertibly, the leading bits are the *quotient*, kept as run lengths in unary, and the rest, the full *remainder*, is kept
with a small counter. So a filter is exact, and sorted. Filters are cut by leading bits into buckets, and each bucket merges the sorted
filters of all shards, numbers the pairs that reach ``least``, and tells every shard those of its own pairs. A pair is one entry
for each shard, however often it occurs, so no phrase or language is a hot key, and both a shard and a bucket are bounded.

Shuffles: in each round the places that are left (the first time about the size of the texts, later only frequent phrases), the
filters, and the answers. Every round is kept as Parquet in the shared folder. The frequent phrases with the counts of their leading
and closing parts are then ordinary tables, joined by id.

Defined results: null texts count as empty; a null language is ``und``; empty pieces have no words; repeated rows count each time; an
empty table has no phrases. Of cuts with the same floored score the first counts. Other columns are ignored.
"""

from __future__ import annotations

import math
import struct
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, mix, pa_schema, release, slices

#: Bytes of text in a shard; words of the corpus for each bucket of filters; words of the longest phrase.
SHARD_BYTES, BUCKET_WORDS, LONGEST = 3 << 21, 1 << 21, 5
#: Frequent words are broadcast to the shards' words up to this size, and joined by a shuffle beyond it.
BROADCAST_BYTES = 1 << 25
#: Classes of bytes: part of a word, between words, between pieces.
KIND = np.zeros(256, np.uint8)
KIND[[0x20, 0x09]] = 1
KIND[[*b".,;:!?", 0x0A, 0x0B, 0x0C, 0x0D]] = 2
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


# -- the filter ------------------------------------------------------------------------------------------------------

#: One fixed odd number for each round of the permutation.
ROUNDS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5], np.uint64)


def permute(left: np.ndarray, right: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """A Feistel network on pairs of numbers below 2**bits: one to one, and spread evenly."""
    mask = np.uint64((1 << bits) - 1)
    for salt in ROUNDS:
        left, right = right, left ^ (mix(right + salt) & mask)
    return left, right


def restore(left: np.ndarray, right: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    mask = np.uint64((1 << bits) - 1)
    for salt in ROUNDS[::-1]:
        left, right = right ^ (mix(left + salt) & mask), left
    return left, right


def joint(left: np.ndarray, right: np.ndarray, bits: int) -> np.ndarray:
    """One sortable value for each pair: 64 bits where they hold it, else 16 bytes."""
    if 2 * bits <= 64:
        return (left << np.uint64(bits)) | right
    both = np.empty((len(left), 2), ">u8")
    both[:, 0], both[:, 1] = left, right
    return both.view("S16").ravel()


class Filter:
    """A counting quotient filter of pairs of ids below 2**bits. ``left`` and ``right`` are the permuted halves, ascending, and
    ``counts`` the occurrences; ``pack`` gives the compact form: quotients as unary run lengths, byte-aligned remainders, counters
    of one byte with larger ones behind."""

    HEAD = "<BBqqqq"

    def __init__(self, bits: int, left: np.ndarray, right: np.ndarray, counts: np.ndarray):
        self.bits, self.left, self.right, self.counts = bits, left, right, counts

    @classmethod
    def of(cls, bits: int, left: np.ndarray, right: np.ndarray) -> Filter:
        left, right = permute(left.astype(np.uint64), right.astype(np.uint64), bits)
        return cls.merged(bits, left, right, np.ones(len(left), np.int64))[0]

    @classmethod
    def merged(cls, bits: int, left: np.ndarray, right: np.ndarray, counts: np.ndarray) -> tuple[Filter, np.ndarray]:
        """The filter of sorted runs put together, and the entry that each input entry went to."""
        key = joint(left, right, bits)
        order = np.argsort(key, kind="stable")
        key = key[order]
        new = np.append(True, key[1:] != key[:-1]) if len(key) else np.zeros(0, bool)
        first = np.flatnonzero(new)
        entry = np.empty(len(key), np.int64)
        entry[order] = np.cumsum(new) - 1
        at = order[first]
        return cls(bits, left[at], right[at], np.add.reduceat(counts[order], first) if len(first) else counts), entry

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        return restore(self.left, self.right, self.bits)

    def pack(self, bucket_bits: int) -> Iterable[tuple[int, bytes]]:
        """(bucket, compact filter) for each value of the leading bits that has entries."""
        n = len(self.left)
        if n == 0:
            return
        quotient_bits = min(self.bits, max(bucket_bits, n.bit_length() - 1))
        low_bits = self.bits - quotient_bits
        quotient = (self.left >> np.uint64(low_bits)).astype(np.int64)
        low = self.left & np.uint64((1 << low_bits) - 1)
        bucket = quotient >> (quotient_bits - bucket_bits)
        edge = np.append(np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])), n)
        for lo, hi in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
            q = quotient[lo:hi]
            base, span = int(q[0]), int(q[-1] - q[0]) + 1
            runs = np.bincount(q - base, minlength=span)
            unary = np.ones(hi - lo + span, bool)
            unary[np.cumsum(runs) + np.arange(span)] = False
            counts = self.counts[lo:hi]
            large = counts[counts >= 255]
            yield int(bucket[lo]), b"".join((
                struct.pack(self.HEAD, self.bits, quotient_bits, hi - lo, base, span, len(large)), np.packbits(unary).tobytes(), as_bytes(low[lo:hi], low_bits),
                as_bytes(self.right[lo:hi], self.bits), np.minimum(counts, 255).astype(np.uint8).tobytes(), large.astype("<i8").tobytes()))

    @classmethod
    def unpack(cls, data: bytes) -> Filter:
        bits, quotient_bits, n, base, span, many = struct.unpack_from(cls.HEAD, data)
        low_bits, at = bits - quotient_bits, struct.calcsize(cls.HEAD)
        raw = np.frombuffer(data, np.uint8)
        size = (n + span + 7) // 8
        zeros = np.flatnonzero(np.unpackbits(raw[at : at + size], count=n + span) == 0)
        quotient = np.repeat(base + np.arange(span), np.diff(zeros, prepend=-1) - 1).astype(np.uint64)
        at += size
        low, at = from_bytes(raw, at, n, low_bits)
        right, at = from_bytes(raw, at, n, bits)
        counts = raw[at : at + n].astype(np.int64)
        counts[counts == 255] = np.frombuffer(data, "<i8", many, at + n)
        return cls(bits, (quotient << np.uint64(low_bits)) | low, right, counts)


def as_bytes(values: np.ndarray, bits: int) -> bytes:
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, : (bits + 7) // 8]).tobytes()


def from_bytes(raw: np.ndarray, at: int, n: int, bits: int) -> tuple[np.ndarray, int]:
    width = (bits + 7) // 8
    out = np.zeros((n, 8), np.uint8)
    out[:, :width] = raw[at : at + n * width].reshape(n, width)
    return out.view("<u8").ravel().astype(np.uint64), at + n * width


def squeezed(values: np.ndarray) -> bytes:
    """Non-negative integers as planes of their bytes, lowest first, each compressed: planes of small numbers are nearly empty."""
    planes = np.ascontiguousarray(values.astype("<u8")).view(np.uint8).reshape(-1, 8).T
    width = max(1, (int(values.max(initial=0)).bit_length() + 7) // 8)
    return struct.pack("<BQ", width, len(values)) + pa.compress(np.ascontiguousarray(planes[:width]).tobytes(), "zstd", asbytes=True)


def unsqueezed(data: bytes) -> np.ndarray:
    width, n = struct.unpack_from("<BQ", data)
    planes = np.frombuffer(pa.decompress(data[9:], width * n, "zstd", asbytes=True), np.uint8).reshape(width, n)
    out = np.zeros((n, 8), np.uint8)
    out[:, :width] = planes.T
    return out.view("<i8").ravel()


# -- shards ----------------------------------------------------------------------------------------------------------

def numbered(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, pa.Array, np.ndarray]:
    """(text of each word, its place, distinct words, number of each word). Places of neighbours in one piece differ by one, else
    by more."""
    data = b"\n".join(texts).translate(LOWER) + b"\n"
    raw = np.frombuffer(data, np.uint8)
    kind = KIND[raw]
    inside = kind == 0
    edge = np.diff(np.concatenate(([False], inside)).astype(np.int8))
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    place = np.arange(len(start)) + np.searchsorted(np.flatnonzero(kind == 2), start)
    owner = np.repeat(np.arange(len(texts)), np.diff(np.searchsorted(start, np.concatenate(([0], np.cumsum([len(t) + 1 for t in texts]))))))
    offsets = np.concatenate(([0], np.cumsum(end - start))).astype(np.int32)
    words = pa.Array.from_buffers(pa.binary(), len(start), [None, pa.py_buffer(offsets), pa.py_buffer(raw[inside])]).dictionary_encode()
    return owner, place, words.dictionary, words.indices.to_numpy()


SHARDS = "shard long, places binary, numbers binary, lang string, word string, number int, c long"


def shards(docs: DataFrame, lang: str, text: str) -> DataFrame:
    """For each shard one row with the places of its words and their numbers in the shard, and one for each number with its language,
    word and count."""
    size = SHARD_BYTES
    rows = docs.select(F.coalesce(lang, F.lit("und")).alias("lang"), F.coalesce(text, F.lit("")).alias("text"))
    out = pa_schema(docs.sparkSession, SHARDS)

    def run(batches):
        task, made = TaskContext.get().partitionId(), 0
        langs, texts, held = [], [], 0

        def shard():
            names = list(dict.fromkeys(langs))
            code = {n: i for i, n in enumerate(names)}
            owner, place, words, number = numbered(texts)
            both = np.array([code[n] for n in langs], np.int64)[owner] * max(1, len(words)) + number
            distinct, mine, counts = np.unique(both, return_inverse=True, return_counts=True)
            order = np.argsort(-counts, kind="stable")  # small numbers for frequent words: they compress
            rank = np.empty_like(order)
            rank[order] = np.arange(len(order))
            distinct, mine, counts = distinct[order], rank[mine], counts[order]
            which, word = np.divmod(distinct, max(1, len(words)))
            n, name = len(distinct), task << 24 | made
            yield table([name], [squeezed(np.diff(place, prepend=0))], [squeezed(mine)], [None], [None], [None], [None])
            yield table(np.full(n, name), pa.nulls(n, pa.binary()), pa.nulls(n, pa.binary()), pa.array(names, pa.string()).take(pa.array(which)),
                        words.cast(pa.string()).take(pa.array(word)), np.arange(n, dtype=np.int32), counts)

        def table(*columns):
            return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, out, strict=True)], schema=out)

        for part in (b.slice(lo, hi - lo) for b in batches for lo, hi in slices(b)):
            for n, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                t = t.encode("utf-8", "surrogatepass")
                langs.append(n)
                texts.append(t)
                held += len(t) + 1
                if held >= size:
                    yield from shard()
                    langs, texts, held, made = [], [], 0, made + 1
        if texts:
            yield from shard()

    return rows.mapInArrow(run, SHARDS)


# -- rounds ----------------------------------------------------------------------------------------------------------

#: A round's table: for each shard its places and ids (bucket -1) and the parts of its filter of the next round's pairs.
ROUND = "shard long, bucket int, a binary, b binary"
#: A merge's table: for each bucket its frequent pairs (shard -1) and for each shard those of them that it has.
FOUND = "shard long, prefixes binary, suffixes binary, ids binary, counts binary, top long"


def round_rows(shard: int, places: np.ndarray, ids: np.ndarray, bits: int, bucket_bits: int, last: bool) -> pa.Table:
    rows = [] if last else [(shard, -1, squeezed(np.diff(places, prepend=0)), squeezed(ids))]
    at = neighbours(places)
    rows += [(shard, bucket, data, None) for bucket, data in Filter.of(bits, ids[at], ids[at + 1]).pack(bucket_bits)]
    shard_, bucket, a, b = zip(*rows, strict=True) if rows else ((), (), (), ())
    return pa.table({"shard": pa.array(shard_, pa.int64()), "bucket": pa.array(bucket, pa.int32()), "a": pa.array(a, pa.binary()), "b": pa.array(b, pa.binary())})


def paired(places: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Those that have a neighbour; the others are in no longer phrase."""
    near = np.diff(places) == 1
    keep = np.append(near, False) | np.append(False, near) if len(places) else np.zeros(0, bool)
    return places[keep], ids[keep]


def neighbours(places: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.diff(places) == 1)


def first_round(coded: DataFrame, answers: DataFrame, bits: int, bucket_bits: int) -> DataFrame:
    """Places of frequent words with the words' ids; ``answers``: owner (a shard), number (in the shard), id (0: rare)."""
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if left.num_rows == 0 or right.num_rows == 0:
            return round_rows(0, np.zeros(0, np.int64), np.zeros(0, np.int64), bits, bucket_bits, True)
        row = left.to_pylist()[0]
        places, numbers = np.cumsum(unsqueezed(row["places"])), unsqueezed(row["numbers"])
        ids = np.zeros(int(numbers.max(initial=0)) + 1, np.int64)
        ids[right.column("number").to_numpy()] = right.column("id").to_numpy()
        ids = ids[numbers]
        return round_rows(row["shard"], *paired(places[ids > 0], ids[ids > 0]), bits, bucket_bits, False)

    mine = coded.where(F.col("word").isNull()).select("shard", "places", "numbers")
    return mine.groupBy("shard").cogroup(answers.groupBy("owner")).applyInArrow(run, ROUND)


def next_round(before: DataFrame, found: DataFrame, bits: int, next_bits: int, bucket_bits: int) -> DataFrame:
    """Places of frequent pairs with the pairs' ids, from the places of their parts."""
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if left.num_rows == 0 or right.num_rows == 0:
            return round_rows(0, np.zeros(0, np.int64), np.zeros(0, np.int64), next_bits, bucket_bits, True)
        row = left.to_pylist()[0]
        places, ids = np.cumsum(unsqueezed(row["a"])), unsqueezed(row["b"])
        prefixes, suffixes, named = (np.concatenate([unsqueezed(x) for x in right.column(c).to_pylist()]) for c in ("prefixes", "suffixes", "ids"))
        known = joint(prefixes.astype(np.uint64), suffixes.astype(np.uint64), bits)
        order = np.argsort(known)
        known, named = known[order], named[order]
        at = neighbours(places)
        pairs = joint(ids[at].astype(np.uint64), ids[at + 1].astype(np.uint64), bits)
        slot = np.minimum(np.searchsorted(known, pairs), len(known) - 1)
        hit = known[slot] == pairs
        return round_rows(row["shard"], *paired(places[at[hit]], named[slot[hit]]), next_bits, bucket_bits, False)

    mine = before.where("bucket = -1").select("shard", "a", "b")
    return mine.groupBy("shard").cogroup(found.where("shard >= 0").select("shard", "prefixes", "suffixes", "ids").groupBy("shard")).applyInArrow(run, ROUND)


def merge(rounds: DataFrame, least: int, bucket_bits: int) -> DataFrame:
    """The sorted filters of each bucket merged: pairs that reach ``least``, numbered, and what each shard has of them."""
    out = pa_schema(rounds.sparkSession, FOUND)

    def run(table: pa.Table) -> pa.Table:
        bucket = table.column("bucket")[0].as_py()
        names = table.column("shard").to_numpy()
        filters = [Filter.unpack(d) for d in table.column("a").to_pylist()]
        bits = filters[0].bits
        left, right, counts = (np.concatenate([getattr(f, c) for f in filters]) for c in ("left", "right", "counts"))
        whole, entry = Filter.merged(bits, left, right, counts)
        often = whole.counts >= least
        ids = np.zeros(len(often), np.int64)
        ids[np.argsort(-whole.counts, kind="stable")[: often.sum()]] = (np.arange(often.sum()) + 1) * (1 << bucket_bits) + bucket
        prefix, suffix = whole.pairs()
        rows, at = [], 0
        if often.any():
            rows.append((-1, prefix[often], suffix[often], ids[often], whole.counts[often]))
        for name, f in zip(names.tolist(), filters, strict=True):
            mine = entry[at : at + len(f.left)]
            at += len(mine)
            mine = mine[often[mine]]
            if len(mine):
                rows.append((name, prefix[mine], suffix[mine], ids[mine], None))
        columns = [[r[0] for r in rows], *([None if r[i] is None else squeezed(r[i]) for r in rows] for i in range(1, 5)), [int(r[3].max()) for r in rows]]
        return pa.Table.from_arrays([pa.array(v, f.type) for v, f in zip(columns, out, strict=True)], schema=out)

    return rounds.where("bucket >= 0").select("shard", "bucket", "a").groupBy("bucket").applyInArrow(run, FOUND)


def unpacked(found: DataFrame) -> DataFrame:
    """prefix, suffix, id, f of the frequent pairs."""
    ddl = "prefix long, suffix long, id long, f long"
    out = pa_schema(found.sparkSession, ddl)

    def run(batches):
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                yield pa.RecordBatch.from_arrays([pa.array(unsqueezed(x)) for x in row], schema=out)

    return found.where("shard = -1").select("prefixes", "suffixes", "ids", "counts").mapInArrow(run, ddl)


# -- phrases ---------------------------------------------------------------------------------------------------------

def frequent_phrases(docs: DataFrame, least: int = 100, lang: str = "lang", text: str = "text", longest: int = LONGEST) -> list[DataFrame]:
    """For each length from 1 the phrases that occur ``least`` times or more: lang, n (words of the language), phrase, id, prefix
    and suffix (ids of the parts without the last and the first word), f, heads and tails (counts of the first and last 1, 2, ... words)."""
    coded = materialize(shards(docs, lang, text), "collocations-shards", "zstd")
    words = coded.where(F.col("word").isNotNull()).select("shard", "number", "lang", "word", "c")
    sizes = materialize(words.groupBy("lang").agg(F.sum("c").alias("n")).where(F.col("n") >= least), "collocations-sizes")
    total = sizes.agg(F.sum("n").alias("n")).first()["n"] or 0
    bucket_bits = max(4, math.ceil(math.log2(max(1, total / BUCKET_WORDS))))

    spread = F.pmod(F.xxhash64("lang", "word"), F.lit(1024))
    rank = F.row_number().over(Window.partitionBy("g").orderBy(F.desc("f"), "lang", "word"))  # small ids for frequent words: they compress
    vocabulary = words.groupBy("lang", "word").agg(F.sum("c").alias("f")).where(F.col("f") >= least)
    vocabulary = materialize(vocabulary.withColumn("g", spread).select("lang", "word", "f", (F.col("g") + 1024 * rank.cast("long")).alias("id")), "collocations-words")
    held = vocabulary.agg(F.max("id").alias("top"), F.sum(F.octet_length("lang") + F.octet_length("word") + 64).alias("bytes")).first()
    known = vocabulary.select("lang", "word", "id")
    known = F.broadcast(known) if (held["bytes"] or 0) <= BROADCAST_BYTES else known
    # every number of a shard has its answer, 0 for a rare word: as many rows as there are words, at any size
    answers = words.join(known, ["lang", "word"], "left").select(F.col("shard").alias("owner"), "number", F.coalesce("id", F.lit(0)).alias("id"))

    same = F.array("f")
    level = vocabulary.join(sizes, "lang").select("lang", "n", F.col("word").alias("phrase"), F.col("word").alias("last"), "id", F.lit(None).cast("long").alias("prefix"),
                                                  F.lit(None).cast("long").alias("suffix"), "f", same.alias("heads"), same.alias("tails"))
    levels = [materialize(level, "collocations-1")]
    bits = width(held["top"], bucket_bits)
    rounds = materialize(first_round(coded, answers, bits, bucket_bits), "collocations-round-1", "zstd")
    release(coded)
    for k in range(2, longest + 1):
        found = materialize(merge(rounds, least, bucket_bits), f"collocations-found-{k}", "zstd")
        parts = levels[-1]
        before = parts.select(F.col("id").alias("prefix"), "lang", "n", F.col("phrase").alias("lead"), F.col("heads").alias("h"))
        after = parts.select(F.col("id").alias("suffix"), "last", F.col("tails").alias("t"))
        level = unpacked(found).join(before, "prefix").join(after, "suffix").select(
            "lang", "n", F.concat_ws(" ", "lead", "last").alias("phrase"), "last", "id", "prefix", "suffix", "f", F.concat("h", same).alias("heads"), F.concat("t", same).alias("tails"))
        levels.append(materialize(level, f"collocations-{k}"))
        top = found.agg(F.max("top")).first()[0]
        if k < longest:
            now, bits = bits, width(top, bucket_bits)
            after = materialize(next_round(rounds, found, now, bits, bucket_bits), f"collocations-round-{k}", "zstd")
            release(rounds)
            rounds = after
        release(found)
    release(rounds)
    return levels


def width(top: int | None, bucket_bits: int) -> int:
    return max(bucket_bits, int(top or 0).bit_length(), 1)


def collocations(docs: DataFrame, least: int = 100, covered: int = 100, lang: str = "lang", text: str = "text") -> DataFrame:
    """All candidates of two words and more that no longer one covers (with ``covered`` percent of their count or more): lang, phrase,
    a, l, r, n and score of the weakest cut."""
    levels = frequent_phrases(docs, least, lang, text)
    wide = "decimal(18,0)"
    top = F.lit(1000).cast("decimal(4,0)") * F.col("f").cast(wide) * F.col("n").cast("decimal(16,0)")
    out = None
    for k, level in enumerate(levels[1:], 2):
        cuts = [F.struct(F.expr(f"heads[{j - 1}]").alias("l"), F.expr(f"tails[{k - j - 1}]").alias("r")) for j in range(1, k)]
        cut = F.array_min(F.transform(F.array(*cuts), lambda c, j: F.struct(
            F.call_function("div", F.col("top"), c["l"].cast(wide) * c["r"].cast(wide)).cast("long").alias("score"), j.alias("j"), c["l"].alias("l"), c["r"].alias("r"))))
        scored = level.withColumn("top", top).withColumn("cut", cut)
        if k < len(levels):
            longer = levels[k].select(F.explode(F.array("prefix", "suffix")).alias("id"), F.col("f").alias("longer")).groupBy("id").agg(F.max("longer").alias("longer"))
            scored = scored.join(longer, "id", "left").where(F.col("longer").isNull() | (100 * F.col("longer") < covered * F.col("f")))
        scored = scored.select("lang", "phrase", F.col("f").alias("a"), "cut.l", "cut.r", "n", "cut.score")
        out = scored if out is None else out.unionByName(scored)
    return out


def best(found: DataFrame, top: int) -> DataFrame:
    """The ``top`` best of each language with their rank; first the best of each sixteenth of a language."""
    part = F.pmod(F.xxhash64("phrase"), F.lit(16))
    for keys in (["lang", part], ["lang"]):
        order = Window.partitionBy(*keys).orderBy(F.desc("score"), F.desc("a"), "phrase")
        found = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return found
