"""Skew-safe ordered analytics.

A plain ``Window.partitionBy(key)`` sends every row of one key to one task and
sorts it there. When a key may hold a third of all rows that task is the whole
job. The helpers here split each key into bounded buckets along the order
column, compute the per-bucket part with a window over ``(key, bucket)``, and
carry the prefix from earlier buckets with a window over the (tiny) per-bucket
summaries -- a distributed prefix scan. Results equal the single-window form.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Rows of one (key, bucket) group are bounded by the bucket width for unique
# integer order keys; for timestamps the width is in seconds.
DEFAULT_ID_WIDTH = 1 << 16


def _bucket(order_col: str, width: int):
    c = F.col(order_col)
    return F.floor(c.cast("double") / F.lit(width)).cast("bigint")


def row_number_skew_safe(df: DataFrame, keys: list[str], order_col: str, out: str,
                         width: int = DEFAULT_ID_WIDTH) -> DataFrame:
    """``row_number() over (partition by keys order by order_col)`` as bigint."""
    b = df.withColumn("_b", _bucket(order_col, width))
    counts = b.groupBy(*keys, "_b").agg(F.count(F.lit(1)).alias("_n"))
    wk = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offs = counts.select(*keys, "_b", F.coalesce(F.sum("_n").over(wk), F.lit(0)).alias("_off"))
    wb = Window.partitionBy(*keys, "_b").orderBy(order_col)
    return (b.join(offs, [*keys, "_b"], "inner")
            .withColumn(out, (F.row_number().over(wb) + F.col("_off")).cast("bigint"))
            .drop("_b", "_off"))


def running_sum_skew_safe(df: DataFrame, keys: list[str], order_cols: list[str],
                          bucket_col: str, value_col: str, out: str) -> DataFrame:
    """``sum(value) over (partition by keys order by order_cols rows unbounded
    preceding)`` where ``bucket_col`` is a monotone coarsening of the order
    (e.g. the day of a timestamp)."""
    sums = df.groupBy(*keys, bucket_col).agg(F.sum(value_col).alias("_s"))
    wk = Window.partitionBy(*keys).orderBy(bucket_col).rowsBetween(Window.unboundedPreceding, -1)
    offs = sums.select(*keys, bucket_col, F.coalesce(F.sum("_s").over(wk), F.lit(0)).alias("_off"))
    wb = (Window.partitionBy(*keys, bucket_col).orderBy(*order_cols)
          .rowsBetween(Window.unboundedPreceding, 0))
    return (df.join(offs, [*keys, bucket_col], "inner")
            .withColumn(out, F.sum(value_col).over(wb) + F.col("_off"))
            .drop("_off"))


def lag_skew_safe(df: DataFrame, keys: list[str], order_cols: list[str], bucket_col: str,
                  cols: list[str], prefix: str = "prev_") -> DataFrame:
    """``lag(c) over (partition by keys order by order_cols)`` for each c in
    ``cols``, computed per (keys, bucket) plus a hand-over of the previous
    bucket's last row (a max_by aggregate and a window over bucket summaries)."""
    w = Window.partitionBy(*keys, bucket_col).orderBy(*order_cols)
    d = df.withColumn("_rn_b", F.row_number().over(w))
    for c in cols:
        d = d.withColumn(prefix + c, F.lag(c).over(w))
    last = df.groupBy(*keys, bucket_col).agg(
        F.max_by(F.struct(*cols), F.struct(*order_cols)).alias("_last"))
    wk = Window.partitionBy(*keys).orderBy(bucket_col)
    hand = last.select(*keys, bucket_col, F.lag("_last").over(wk).alias("_pl"))
    d = d.join(hand, [*keys, bucket_col], "inner")
    for c in cols:
        d = d.withColumn(prefix + c, F.when(F.col("_rn_b") == 1, F.col("_pl")[c]).otherwise(F.col(prefix + c)))
    return d.drop("_rn_b", "_pl")


def limit_per_group(df: DataFrame, keys: list[str], bucket: list, order: list, n: int) -> DataFrame:
    """The first ``n`` rows of every group by (bucket, order): ``bucket`` and
    ``order`` are lists of (column, ascending). Rows are counted by (keys,
    bucket), running counts over these summaries say in which bucket a group's
    cut lies, and rows are ranked inside single buckets only, so that a hot
    group is spread over its buckets however large ``n`` is."""
    names = [f"_b{i}" for i in range(len(bucket))]
    d = df.withColumns({b: c for b, (c, _) in zip(names, bucket)})
    sort = [F.col(b).asc() if up else F.col(b).desc() for b, (_, up) in zip(names, bucket)]
    counts = d.groupBy(*keys, *names).agg(F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy(*keys).orderBy(*sort).rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("_before", F.coalesce(F.sum("_n").over(w), F.lit(0))).where(F.col("_before") < n).drop("_n")
    right = counts.select(*[F.col(c).alias(f"_r_{c}") for c in (*keys, *names)], "_before")
    same = [F.col(c).eqNullSafe(F.col(f"_r_{c}")) for c in (*keys, *names)]
    on = same[0]
    for x in same[1:]:
        on = on & x
    inside = Window.partitionBy(*keys, *names).orderBy(*[c.asc() if up else c.desc() for c, up in order])
    kept = d.join(right, on).withColumn("_rn", F.row_number().over(inside) + F.col("_before")).where(F.col("_rn") <= n)
    return kept.select(*df.columns)


def row_barrier(df: DataFrame) -> DataFrame:
    """Same rows and columns, evaluated once: the row is emitted through a
    one-element ``inline_outer`` generator. Filters on derived columns above
    it reference generator output, so Catalyst cannot push them below the
    projections (which would re-evaluate large per-row expressions inside
    the pushed predicate)."""
    cols = df.columns
    return df.select(F.inline_outer(F.array(F.struct(*[F.col(f"`{c}`") for c in cols]))))
