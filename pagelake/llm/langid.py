"""Operator 7: language identification by rank-order profiles.

A profile is the ranked list of the most frequent n-grams (1 to ``max_n`` letters of padded, lower-cased words). A
document's own profile, over its whole text, is compared with each language's by the out-of-place distance: the sum
over its n-grams of how far their ranks lie apart, ``top`` where the language's profile lacks the n-gram.

Training counts n-grams in tasks, adds them up in a shuffle on (language, n-gram) and keeps the ``top`` of each
language. Labelled rows beyond about ``per_lang`` for a language are thinned by a hash of the id (a documented bound for
fitting; every row is predicted). The model holds languages x ``top`` n-grams.

Defined results: a null text or one without letters is ``und`` with score 0; so is every row if there is nothing to
learn from; null languages are not learned; distances that tie go to the language first in alphabetical order;
repeated rows give repeated results; an empty table gives no rows. Only the named columns are read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import per_batch

UND = "und"
#: Bits of a code point; three of them fit in a long.
BITS = 21
GAP = ord("_")


def letters(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(letter numbers, text number of each, code point of each letter number) of the lower-cased texts. Number 1 is a
    gap: one for each run of anything but letters, and one around each text. Number 0 is no letter."""
    low = [t.lower() for t in texts]
    code = np.frombuffer(("\0" + "\0".join(low) + "\0").encode("utf-32-le", "surrogatepass"), np.uint32)
    doc = np.repeat(np.arange(len(low) + 1), [len(t) + 1 for t in low] + [1])
    seen = np.flatnonzero(np.bincount(code))
    seen = seen[[chr(c).isalpha() for c in seen.tolist()]]
    number = np.ones(int(code.max()) + 1, np.int64)
    number[seen] = np.arange(2, len(seen) + 2)
    ids = number[code]
    ok = ids > 1
    keep = ok | np.concatenate(([True], ok[:-1] | (doc[1:] != doc[:-1])))
    return ids[keep], doc[keep], np.concatenate(([0, GAP], seen))


def grams(texts: list[str], max_n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, n-gram, count), by text and n-gram. An n-gram is a long of its code points; a gap can be its first
    or last one, but no n-gram is of gaps alone or reaches over one."""
    ids, doc, code = letters(texts)
    bits = max(2, int(len(code) - 1).bit_length())
    found = []
    for n in range(1, min(max_n, len(ids)) + 1):
        size = len(ids) - n + 1
        key = doc[:size].copy()  # a text's closing gap is the next one's opening gap: what counts is where one starts
        for _ in range(max_n - n):
            key <<= bits
        ok = ids[:size] > 1 if n == 1 else np.ones(size, bool)
        for i in range(n):
            c = ids[i : i + size]
            key = key << bits | c
            if 0 < i < n - 1:
                ok &= c > 1
        if n == 2:
            ok &= (ids[:size] > 1) | (ids[1:] > 1)
        found.append(key[ok])
    keys = np.sort(np.concatenate(found)) if found else np.zeros(0, np.int64)
    new = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
    n, keys = np.diff(np.concatenate((new, [len(keys)]))), keys[new]
    gram = np.zeros(len(keys), np.int64)
    for i in range(max_n):
        gram |= code[keys >> (bits * i) & ((1 << bits) - 1)] << (BITS * i)
    return keys >> (bits * max_n), gram, n


@dataclass(frozen=True)
class Model:
    """``profiles``: language -> its n-grams by rank (as longs)."""

    profiles: dict[str, tuple[int, ...]]
    top: int
    max_n: int

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        langs = sorted(self.profiles)
        texts = [t or "" for t in texts]
        out, score = [UND] * len(texts), [0.0] * len(texts)
        if not langs:
            return out, score
        ranked = []
        for lang in langs:
            p = np.array(self.profiles[lang], np.int64)
            order = np.argsort(p)
            ranked.append((p[order], order))
        d, g, n = grams(texts, self.max_n)
        cut = np.searchsorted(d, np.arange(len(texts) + 1))
        for i in range(len(texts)):
            lo, hi = cut[i], cut[i + 1]
            if lo == hi:
                continue
            mine = g[lo:hi][np.argsort(-n[lo:hi], kind="stable")[: self.top]]
            rank = np.arange(len(mine))
            far = []
            for p, order in ranked:
                at = np.minimum(np.searchsorted(p, mine), len(p) - 1)
                far.append(int(np.where(p[at] == mine, np.abs(order[at] - rank), self.top).sum()))
            best = int(np.argmin(far))
            out[i], score[i] = langs[best], 1.0 - far[best] / (self.top * len(mine))
        return out, score


def train(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", id_col: str = "doc_id", top: int = 400,
          max_n: int = 3, per_lang: int = 4000) -> Model:
    """Profiles of the languages of ``docs``, from at most about ``per_lang`` rows each."""
    known = docs.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), F.col(id_col).alias("id")).where(
        F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = {r.lang: r["count"] for r in known.groupBy("lang").count().collect()}
    if not counts:
        return Model({}, top, max_n)
    share = F.lit(1.0)
    for lang, n in sorted(counts.items()):
        if n > per_lang:
            share = F.when(F.col("lang") == lang, F.lit(per_lang / n)).otherwise(share)
    known = known.where(F.pmod(F.xxhash64(F.lit("profile"), F.col("id")), F.lit(1 << 20)) < share * (1 << 20))

    def count(part):
        d, g, n = grams(part["text"], max_n)
        return {"lang": [part["lang"][i] for i in d.tolist()], "gram": g, "n": n}

    # one text for each language of a slice is enough to count
    def pooled(part):
        by: dict[str, list[str]] = {}
        for lang, text in zip(part["lang"], part["text"], strict=True):
            by.setdefault(lang, []).append(text)
        return count({"lang": list(by), "text": ["\n".join(v) for v in by.values()]})

    total = per_batch(known.select("lang", "text"), pooled, "lang string, gram bigint, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    # rank within salted parts first, so that no task sorts a language's whole vocabulary
    part = Window.partitionBy("lang", F.pmod("gram", F.lit(16))).orderBy(F.desc("n"), "gram")
    few = total.withColumn("r", F.row_number().over(part)).where(F.col("r") <= top)
    ranked = few.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))).where(F.col("r") <= top)
    rows = sorted((r.lang, r.r, r.gram) for r in ranked.select("lang", "r", "gram").collect())
    profiles: dict[str, list[int]] = {}
    for lang, _, gram in rows:
        profiles.setdefault(lang, []).append(gram)
    return Model({k: tuple(v) for k, v in profiles.items()}, top, max_n)


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, ``keep`` columns, lang_pred, score) of every row."""
    cols = {id_col: "_id", text_col: "_text"} | {k: f"_keep_{k}" for k in keep}
    kinds = {c: docs.schema[c].dataType.simpleString() for c in (id_col, *keep)}

    def predict(part):
        lang, score = model.predict(part["_text"])
        return {"id": part["_id"]} | {k: part[f"_keep_{k}"] for k in keep} | {"lang_pred": lang, "score": score}

    schema = ", ".join(f"`{c}` {k}" for c, k in kinds.items()) + ", lang_pred string, score double"
    return per_batch(docs.select(*(F.col(c).alias(a) for c, a in cols.items())), predict, schema)
