"""Operator 3: toxicity by a factorization machine over hashed terms.

A term is a lower-cased word (a run of letters and non-ASCII characters) or one of its beginnings (``stems`` bytes long),
hashed; its value is log(1 + count) over the whole text. Score = sigmoid(b + sum w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j): the factors v learn pairs of terms
(an insult with a mention of a group) that a sum of weights misses.

Fitting: labelled rows beyond ``max_rows`` are thinned by a hash of the id (a documented bound). Document frequencies of
the terms by label are added up in Spark; the ``vocabulary`` terms with the highest chi-square become the model's
features, so its size is fixed; only the features of the bounded sample reach the driver, where the factors are fitted
by seeded AdaGrad. Scoring maps over the table: no shuffle.

Defined results: a null or empty text has no terms and gets the score of the bias; labels that are null are not learned;
with no labels, or one kind only, the score is the share of label 1 (0.5 if none); repeated rows give repeated results; an
empty table gives no rows. A row's label counts as often as the row is repeated.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BASES, mix, per_batch, range_hashes

LETTER = np.zeros(256, bool)
LETTER[97:123] = True
LETTER[128:] = True


@dataclass(frozen=True)
class Terms:
    """How texts become hashed terms: ``bits`` of a hash, of whole words and of beginnings of so many bytes."""

    bits: int = 20
    stems: tuple[int, ...] = (3, 4, 5, 6, 7, 8)

    def of(self, texts: list[str | None]):
        """Pairs of arrays (text number, term number), one for each kind of term, by text."""
        raw = [(t or "").lower().encode("utf-8", "surrogatepass") for t in texts]
        b = np.frombuffer(b" ".join(raw) + b" ", np.uint8)
        edge = np.diff(np.concatenate(([False], LETTER[b])).astype(np.int8))
        start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        doc = np.searchsorted(np.cumsum([len(r) + 1 for r in raw]), start, side="right")
        values, mask = b.astype(np.uint64) + np.uint64(1), np.uint64((1 << self.bits) - 1)
        yield doc, (range_hashes(values, start, end, BASES[0]) & mask).astype(np.int64)
        for k in self.stems:
            long = end - start >= k
            s = start[long]
            h = np.zeros(len(s), np.uint64)
            for i in range(k):
                h = h * np.uint64(BASES[1]) + values[s + i]
            yield doc[long], (mix(h + np.uint64(k)) & mask).astype(np.int64)


@dataclass(frozen=True)
class Model:
    terms: Terms
    bias: float
    #: the numbers of the terms that the arrays hold
    vocabulary: np.ndarray
    weights: np.ndarray
    factors: np.ndarray

    def score(self, texts: list[str | None]) -> np.ndarray:
        z = np.full(len(texts), self.bias)
        for d, i, x in features(texts, self.terms, self.vocabulary):
            z[d] = _machine(self.bias, self.weights[i], self.factors[i], x)
        return 1.0 / (1.0 + np.exp(-np.clip(z, -30, 30)))


def features(texts: list[str | None], terms: Terms, vocabulary: np.ndarray):
    """(text number, positions in the vocabulary, values) of every text that has terms of the vocabulary."""
    slot = np.zeros(1 << terms.bits, np.int32)
    slot[vocabulary] = np.arange(1, len(vocabulary) + 1)
    found = []
    for doc, term in terms.of(texts):
        at = slot[term]
        hit = at > 0
        found.append(doc[hit] << 32 | (at[hit] - 1))
    keys, n = np.unique(np.concatenate(found), return_counts=True)
    doc, at, x = keys >> 32, keys & 0xFFFFFFFF, np.log1p(n)
    cut = np.flatnonzero(np.concatenate(([True], doc[1:] != doc[:-1], [True]))) if len(doc) else np.zeros(1, np.int64)
    for lo, hi in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
        yield int(doc[lo]), at[lo:hi], x[lo:hi]


def _machine(bias: float, w: np.ndarray, v: np.ndarray, x: np.ndarray) -> float:
    if not len(x):
        return bias
    s = x @ v
    return float(bias + w @ x + 0.5 * (s @ s - (x * x) @ (v * v).sum(1)))


def train(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", id_col: str = "doc_id", text_col: str = "text",
          max_rows: int = 12_000, vocabulary: int = 2_000, terms: Terms | None = None, factors: int = 4, epochs: int = 8,
          seed: int = 7) -> Model:
    """Fit on the rows of ``docs`` that ``labels`` marks, at most about ``max_rows`` of them."""
    terms = terms or Terms()
    marks = labels.select(F.col(id_col).alias("id"), F.col(label_col).alias("y")).where("id is not null and y is not null")
    n = marks.count()
    share = min(1.0, max_rows / n) if n else 1.0
    few = marks.where(F.pmod(F.xxhash64(F.lit("fit"), "id"), F.lit(1 << 20)) < F.lit(share * (1 << 20)))
    # The sample is bounded by max_rows, so its ids may be broadcast and the texts need no shuffle.
    rows = F.broadcast(few).join(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), "id")
    rows = rows.select(F.col("id").cast("string").alias("id"), (F.col("y") == 1).alias("y"), "text")

    def frequencies(part):
        y = np.array(part["y"], np.int64)
        keys = np.unique(np.concatenate([doc << 32 | term for doc, term in terms.of(part["text"])]))
        doc, term = keys >> 32, keys & 0xFFFFFFFF
        a, both = np.bincount(term[y[doc] == 1], minlength=1 << terms.bits), np.bincount(term, minlength=1 << terms.bits)
        seen = np.flatnonzero(both)
        # term -1 counts the rows
        return {"term": np.append(seen, -1), "a": np.append(a[seen], y.sum()), "b": np.append((both - a)[seen], len(y) - y.sum())}

    seen = per_batch(rows, frequencies, "term bigint, a bigint, b bigint").groupBy("term").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    total = {"a": 0, "b": 0}
    for r in seen.where("term = -1").collect():
        total = {"a": r.a, "b": r.b}
    pos, neg = total["a"], total["b"]
    if not pos or not neg:
        p = min(max(pos / (pos + neg), 1e-9), 1 - 1e-9) if pos + neg else 0.5
        return Model(terms, float(np.log(p / (1 - p))), np.zeros(0, np.int64), np.zeros(0), np.zeros((0, factors)))
    a, b = F.col("a").cast("double"), F.col("b").cast("double")
    c, d = F.lit(float(pos)) - a, F.lit(float(neg)) - b
    chi = (a * d - b * c) * (a * d - b * c) / ((a + b) * (c + d + 1e-9))
    best = np.array([r.term for r in seen.where("term >= 0 and a + b >= 3").orderBy(chi.desc(), "term").limit(vocabulary).select("term").collect()], np.int64)

    def known(part):
        out = {"id": [], "y": [], "at": [], "x": []}
        none = set(range(len(part["id"])))
        for d, i, x in features(part["text"], terms, best):
            none.discard(d)
            for k, v in (("id", part["id"][d]), ("y", part["y"][d]), ("at", i.tolist()), ("x", x.tolist())):
                out[k].append(v)
        for d in sorted(none):
            for k, v in (("id", part["id"][d]), ("y", part["y"][d]), ("at", []), ("x", [])):
                out[k].append(v)
        return out

    data = sorted((r.id, r.y, r.at, r.x) for r in per_batch(rows, known, "id string, y boolean, at array<int>, x array<double>").collect())
    w, v, bias = _fit(len(best), [(float(y), np.array(i, np.int64), np.array(x)) for _, y, i, x in data], pos / (pos + neg), factors, epochs, seed)
    return Model(terms, bias, best, w, v)


def _fit(size: int, rows: list, prior: float, k: int, epochs: int, seed: int) -> tuple[np.ndarray, np.ndarray, float]:
    """AdaGrad on the log loss, one seeded pass after another: (weights, factors, bias)."""
    rng = np.random.default_rng(seed)
    w, v, b = np.zeros(size), rng.normal(0, 0.01, (size, k)), float(np.log(prior / (1 - prior)))
    gw, gv, gb = np.full(size, 1e-6), np.full((size, k), 1e-6), 1e-6
    rate, keep = 0.05, 1e-4
    for _ in range(epochs):
        for r in rng.permutation(len(rows)):
            y, i, x = rows[r]
            vi, wi = v[i], w[i]
            z = _machine(b, wi, vi, x)
            e = 1.0 / (1.0 + np.exp(-np.clip(z, -30, 30))) - y
            gb += e * e
            b -= rate * e / np.sqrt(gb)
            if not len(i):
                continue
            dw = e * x + keep * wi
            dv = e * (x[:, None] * (x @ vi) - (x * x)[:, None] * vi) + keep * vi
            gw[i] += dw * dw
            gv[i] += dv * dv
            w[i] -= rate * dw / np.sqrt(gw[i])
            v[i] -= rate * dv / np.sqrt(gv[i])
    return w, v, float(b)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score, predicted) of every row."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(part):
        s = model.score(part["_text"])
        return {"id": part["_id"], "score": s, "predicted": (s >= 0.5).astype(np.int32)}

    return per_batch(docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")), run, f"`{id_col}` {kind}, score double, predicted int")
