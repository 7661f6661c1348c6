"""Operator 1: quality rules as a learned decision list (DataFrame functions only).

:func:`with_stats` computes the statistics of a whole text within its row: no shuffle, no Python. :func:`learn` runs
sequential covering over the statistics of labelled rows: a rule is a conjunction of thresholds, grown by FOIL gain on one
part of the rows and pruned from its end on the other; rows that an accepted rule covers are set aside and the next rule
is grown. Spark counts the rows by (statistic, bin, label) for every step, so that only counts of a fixed size reach the
driver. :meth:`Rules.verdict` emits the ordered list as one CASE expression.

Fitting uses at most about ``max_rows`` labelled rows, thinned by a hash of the id (a documented bound); every row is
judged.

Defined results: a null or empty text has no words and fails the base rules; null ids or labels are not learned from; with
no labels, or one kind only, the list is empty and the base rules alone decide; repeated rows give repeated results; an
empty table gives no rows; equal gains go to the statistic named first, then to the condition that covers less. Columns of the input never
clash with the statistics: they travel in one struct.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import log2

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.windows import row_barrier
from .common import WHITE, materialize

WINDOW = 5
STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper")

#: What rules may compare: expressions over the columns of STATS.
FEATURES = {
    "words": "cast(n_words as double)",
    "symbols_per_word": "n_symbols / greatest(n_words, 1)",
    "repeated_share": "n_repeat_words / greatest(n_words, 1)",
    "duplicate_lines": "n_dup_lines / greatest(n_lines, 1)",
    "mean_word": "word_chars / greatest(n_words, 1)",
    "upper_share": "n_upper / greatest(word_chars, 1)",
}


def with_stats(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``row`` (a struct of all columns of ``docs``) and the columns of STATS. Each step is a projection of its own, since
    later steps refer to its arrays many times."""
    t = F.coalesce(F.col(text_col), F.lit(""))
    df = docs.select(F.struct("*").alias("row"), t.alias("t"))
    df = df.select("row", "t", F.array_remove(F.split("t", WHITE), "").alias("w"),
                   F.filter(F.split("t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("lines"))
    df = df.select(
        "row", F.size("w").alias("n"), F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace("t", r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        F.length(F.regexp_replace("t", r"[^A-Z]+", "")).cast("long").alias("n_upper"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.transform("w", lambda x: F.xxhash64(x)).alias("h"))
    rest = ["row", "n", "word_chars", "n_symbols", "n_upper", "n_lines", "n_dup_lines"]
    window = F.transform(F.sequence(F.lit(0), F.col("n") - WINDOW), lambda i: F.xxhash64(*(F.get("h", i + j) for j in range(WINDOW))))
    df = df.select(*rest, F.when(F.col("n") >= WINDOW, window).alias("k"))
    # only texts with a repeated window are sorted by (window, place)
    places = F.sort_array(F.transform("k", lambda x, i: F.struct(x.alias("x"), i.alias("i"))))
    df = df.select(*rest, F.when(F.size(F.array_distinct("k")) < F.size("k"), places).alias("s"))
    x = lambda i: F.get("s", i)["x"]
    again = F.filter("s", lambda e, i: (x(i - 1).eqNullSafe(e["x"]) & (i > 0)) | x(i + 1).eqNullSafe(e["x"]))
    df = df.select(*rest, F.sort_array(F.transform(again, lambda e: e["i"])).alias("at"))
    covered = F.transform("at", lambda p, i: F.least(F.lit(WINDOW), F.coalesce(F.get("at", i + 1) - p, F.lit(WINDOW))))
    total = F.coalesce(F.aggregate(covered, F.lit(0), lambda a, b: a + b), F.lit(0))
    return df.select("row", F.col("n").cast("long").alias("n_words"), *rest[2:], total.cast("long").alias("n_repeat_words"))


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


@dataclass(frozen=True)
class Condition:
    """``feature`` <= ``bound``, or above it."""

    feature: str
    above: bool
    bound: float

    def sql(self) -> str:
        return f"({FEATURES[self.feature]}) {'>' if self.above else '<='} {self.bound!r}D"


@dataclass(frozen=True)
class Rules:
    """Ordered conjunctions; a row that one of them covers is rejected."""

    rules: tuple[tuple[Condition, ...], ...]

    def sql(self) -> str:
        """The list as SQL: the number of the first rule that covers a row, or null."""
        if not self.rules:
            return "cast(null as int)"
        return "CASE " + " ".join(f"WHEN {' AND '.join(c.sql() for c in r)} THEN {i}" for i, r in enumerate(self.rules, 1)) + " END"

    def verdict(self) -> Column:
        return F.expr(self.sql())


def learn(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text",
          max_rows: int = 20_000, bins: int = 24, max_rules: int = 10, max_conditions: int = 3, purity: float = 0.97,
          accept: float = 0.9, least: int = 10) -> Rules:
    """The rules that tell label 0 from label 1. A rule needs ``accept`` precision on rows that it wasn't grown on, and
    ``least`` rows that it was."""
    marks = labels.select(F.col(id_col).alias("_id"), F.col(label_col).alias("_y")).where("_id is not null and _y is not null")
    n = marks.count()
    share = min(1.0, max_rows / n) if n else 1.0
    few = marks.where(F.pmod(F.xxhash64(F.lit("rules"), "_id"), F.lit(1 << 20)) < F.lit(share * (1 << 20)))
    # The sample is bounded by max_rows, so its ids may be broadcast and the texts need no shuffle.
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(F.broadcast(few), "_id")
    rows = with_stats(texts, "_text").select(
        (F.col("row._y") == 0).alias("bad"), (F.pmod(F.xxhash64(F.lit("prune"), "row._id"), F.lit(3)) == 0).alias("prune"),
        *(F.expr(e).alias(f) for f, e in FEATURES.items()))
    rows = materialize(rows, "quality")
    marks = [i / (bins + 1) for i in range(1, bins + 1)]
    cuts = rows.groupBy("bad").agg(*(F.percentile_approx(f, marks, 2000).alias(f) for f in FEATURES)).collect()
    if len(cuts) < 2:
        return Rules(())
    bounds = {}
    for f in FEATURES:
        at = sorted({float(f"{v:.4g}") for c in cuts for v in c[f]})
        # bounds half way into the gaps too: where they tell as much apart, they ask for more evidence
        bounds[f] = sorted({*at, *(float(f"{(a + b) / 2:.4g}") for a, b in zip(at, at[1:], strict=False))})
    numbered = [F.expr(f"size(filter(array({', '.join(f'{b!r}D' for b in bounds[f])}), b -> {f} > b))").alias(f) for f in FEATURES]
    rows = materialize(rows.select("bad", "prune", *numbered).groupBy("bad", "prune", *FEATURES).count(), "quality-bins")
    # the bin of a value is the number of bounds below it
    cond = lambda c: f"{c[0]} {'>' if c[1] else '<='} {c[2]}"
    left, done = rows, []
    while len(done) < max_rules:
        rule, inside = [], left.where("not prune")
        while True:
            table = _counts(inside)
            p0 = sum(p for p, _ in table[next(iter(FEATURES))])
            n0 = sum(n for _, n in table[next(iter(FEATURES))])
            if not p0 or len(rule) == max_conditions or p0 >= purity * (p0 + n0):
                break
            each = [(_gain(p, n, p0, n0), -list(FEATURES).index(f), cut if above else -cut, (f, above, cut)) for f, above, cut, p, n in _options(table) if p >= least]
            gain, *_, best = max(each, default=(0, None))
            if gain <= 1e-9:
                break
            rule.append(best)
            inside = inside.where(cond(best))
        if not rule:
            break
        # prune: the beginning of the rule that does best on the other rows
        sums = [F.sum(F.when(F.expr(" and ".join(map(cond, rule[: i + 1]))) & (F.col("bad") == b), F.col("count"))).alias(f"c{i}_{int(b)}")
                for i in range(len(rule)) for b in (True, False)]
        got = left.where("prune").agg(*sums).first()
        worth = [((got[f"c{i}_1"] or 0), (got[f"c{i}_0"] or 0)) for i in range(len(rule))]
        best = max(range(len(rule)), key=lambda i: ((worth[i][0] + 1) / (worth[i][0] + worth[i][1] + 2), -i))
        p, n = worth[best]
        if not p or p < accept * (p + n):
            break
        rule = rule[: best + 1]
        done.append(tuple(Condition(f, above, bounds[f][cut]) for f, above, cut in rule))
        left = left.where(f"not ({' and '.join(map(cond, rule))})")
    return Rules(tuple(done))


def _counts(rows: DataFrame) -> dict[str, dict[int, list[int]]]:
    """For every feature: (bad, good) rows of each bin, as a list of pairs."""
    each = F.explode(F.array(*(F.struct(F.lit(f).alias("f"), F.col(f).alias("b")) for f in FEATURES)))
    got = rows.select(each.alias("e"), "bad", "count").groupBy("e.f", "e.b", "bad").agg(F.sum("count").alias("n")).collect()
    size = max((r.b for r in got), default=0) + 1
    out = {f: [[0, 0] for _ in range(size)] for f in FEATURES}
    for r in got:
        out[r.f][r.b][0 if r.bad else 1] += r.n
    return out


def _options(table):
    """(feature, above, bin, bad, good) of every threshold condition: bin > b, or bin <= b."""
    for f, pairs in table.items():
        p, n = sum(x for x, _ in pairs), sum(x for _, x in pairs)
        a = b = 0
        for cut, (x, y) in enumerate(pairs[:-1]):
            a, b = a + x, b + y
            yield f, False, cut, a, b
            yield f, True, cut, p - a, n - b


def _gain(p: int, n: int, p0: int, n0: int) -> float:
    """FOIL's information gain of narrowing (p0, n0) to (p, n)."""
    return p * (log2(p / (p + n)) - log2(p0 / (p0 + n0))) if p else 0.0


def judge(docs: DataFrame, rules: Rules, text_col: str = "text") -> DataFrame:
    """``row``, the columns of STATS, base_failed, rule (number of the rule that rejects the row, or null), kept."""
    df = with_stats(docs, text_col).withColumn("base_failed", base_failed()).withColumn("rule", rules.verdict())
    return df.withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull())


def keep_good(docs: DataFrame, rules: Rules, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that the base rules and the list keep, with their columns."""
    return row_barrier(judge(docs, rules, text_col).select("row", "kept")).where("kept").select("row.*")
