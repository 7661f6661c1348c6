"""Statistics (A1-A12), paging (L1-L3) and latest-status.

Aggregates are single ``agg`` calls so Spark plans one partial (map-side) and
one final hash aggregate; global totals never pull rows to the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def count_jobs(jobs: DataFrame, status: str | None = None) -> DataFrame:
    """A1: number of jobs, optionally of one status."""
    j = jobs if status is None else jobs.where(F.col("status") == status)
    return j.agg(F.count(F.lit(1)).cast("bigint").alias("n_jobs"))


def stats(jobs: DataFrame, versions: DataFrame) -> DataFrame:
    """A2: totals of the dashboard header; NULL sums become 0. Two one-row
    aggregates side by side (a 1x1 join, not a data cross product)."""
    a = jobs.agg(F.count(F.lit(1)).cast("bigint").alias("total_jobs"),
                 F.count_if(F.col("status") == "running").cast("bigint").alias("running_jobs"),
                 F.coalesce(F.sum("pages_scraped"), F.lit(0)).cast("bigint").alias("total_pages_scraped"),
                 F.coalesce(F.sum("pages_failed"), F.lit(0)).cast("bigint").alias("total_pages_failed"),
                 F.lit(1).alias("_k"))
    b = versions.agg(F.count(F.lit(1)).cast("bigint").alias("total_versions"), F.lit(1).alias("_k"))
    return a.join(b, "_k").drop("_k")


def scrape_volume(results: DataFrame, as_of: str, days: int) -> DataFrame:
    """A3: results per day over the last ``days`` days, ascending."""
    start = F.to_timestamp(F.lit(as_of)) - F.make_interval(days=F.lit(days))
    return (results.where(F.col("created_at") >= start)
            .groupBy(F.to_date("created_at").alias("date"))
            .agg(F.count(F.lit(1)).cast("bigint").alias("count")))


def category_distribution(bridge: DataFrame, categories: DataFrame) -> DataFrame:
    """A4: results per category; categories without results are absent.
    The bridge is pre-aggregated per category before the join."""
    per = bridge.groupBy("category_id").agg(F.count(F.lit(1)).cast("bigint").alias("count"))
    return per.join(categories.select("category_id", F.col("name").alias("category")), "category_id") \
              .select("category", "count")


def count_logs(logs: DataFrame) -> DataFrame:
    """A5: log rows per job (level ignored)."""
    return logs.groupBy("job_id").agg(F.count(F.lit(1)).cast("bigint").alias("total"))


def job_summary(results: DataFrame) -> DataFrame:
    """Scraped / failed / discovered per job."""
    return results.groupBy("job_id").agg(
        F.count_if(F.col("http_status") < 400).cast("bigint").alias("pages_scraped"),
        F.count_if(F.col("http_status") >= 400).cast("bigint").alias("pages_failed"),
        F.countDistinct("url").cast("bigint").alias("total_pages_discovered"))


def pages_per_second(results: DataFrame) -> DataFrame:
    """round(done / elapsed, 2) when done > 0 and elapsed > 0.5 s, else 0."""
    g = results.groupBy("job_id").agg(
        F.count(F.lit(1)).cast("bigint").alias("done"),
        F.min("created_at").alias("t0"), F.max("created_at").alias("t1"))
    el = (F.unix_micros(F.col("t1").cast("timestamp")) - F.unix_micros(F.col("t0").cast("timestamp"))) / 1e6
    return g.select("job_id", "done", F.round(el, 6).alias("elapsed_s"),
                    F.when((F.col("done") > 0) & (el > 0.5), F.round(F.col("done") / el, 2))
                    .otherwise(F.lit(0.0)).alias("pages_per_second"))


def newest_first(df: DataFrame, ts: str, key: str, limit: int, offset: int = 0,
                 ascending: bool = False) -> DataFrame:
    """L1-L3: order by time (then id), offset, limit -> TakeOrderedAndProject."""
    order = [F.col(ts).asc(), F.col(key).asc()] if ascending else [F.col(ts).desc(), F.col(key).desc()]
    out = df.orderBy(*order)
    if offset:
        out = out.offset(offset)
    return out.limit(limit)


def page_after(df: DataFrame, ts: str, key: str, limit: int, after: tuple | None = None, ascending: bool = False) -> DataFrame:
    """L1-L3 by the last row of the page before, ``after`` = (time, id), in place of an offset: rows beyond it in the order. The
    bound on the time reaches the scan, so files whose statistics lie before the page are skipped and page 10,000 of a table
    that is kept by time reads as little as page 1."""
    if after is not None:
        t, i = F.lit(after[0]).cast(df.schema[ts].dataType), F.lit(after[1]).cast(df.schema[key].dataType)
        c, k = F.col(ts), F.col(key)
        df = df.where(c >= t).where((c > t) | (k > i)) if ascending else df.where(c <= t).where((c < t) | (k < i))
    return newest_first(df, ts, key, limit, ascending=ascending)


def dashboard_metrics(jobs_page: DataFrame) -> DataFrame:
    """Totals over the listed jobs."""
    return jobs_page.agg(
        F.count(F.lit(1)).cast("bigint").alias("jobs"),
        F.count_if(F.col("status") == "running").cast("bigint").alias("running"),
        F.coalesce(F.sum("pages_scraped"), F.lit(0)).cast("bigint").alias("pages_scraped"),
        F.coalesce(F.sum("pages_failed"), F.lit(0)).cast("bigint").alias("pages_failed"))


def volume_scaled(volume: DataFrame, last_n: int = 14) -> DataFrame:
    """A10: last ``last_n`` days with height % of the maximum over the whole
    range. The volume table has one row per day, so the global window is over
    a bounded, tiny input."""
    w_all = Window.partitionBy(F.lit(1))
    w_desc = Window.partitionBy(F.lit(1)).orderBy(F.col("date").desc())
    v = volume.withColumn("_max", F.max("count").over(w_all)).withColumn("_rn", F.row_number().over(w_desc))
    return (v.where(F.col("_rn") <= last_n)
            .select("date", "count",
                    F.when(F.col("_max") > 0, F.round(F.col("count") * 100.0 / F.col("_max"), 2))
                    .otherwise(F.lit(0.0)).alias("height_pct")))


def latest_status(status_log: DataFrame) -> DataFrame:
    """Last status per job by (time, id) -- an aggregate, so partial
    max_by runs map-side and a hot job costs one row per task."""
    return status_log.groupBy("job_id").agg(
        F.max_by("status", F.struct("created_at", "log_id")).alias("status"))


def total_content_bytes(results: DataFrame) -> DataFrame:
    """Sum of stored content lengths."""
    return results.agg(F.coalesce(F.sum("content_length"), F.lit(0)).cast("bigint").alias("total_content_bytes"))


def col_or(c) -> Column:
    return F.col(c) if isinstance(c, str) else c
