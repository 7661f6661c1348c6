"""Crawl over a link graph.

A crawl job is a breadth-first search: the frontier of depth d joins the edge
table on its source, new targets are those not seen by the same job (left
anti join), they become the frontier of depth d+1. Pages up to ``max_depth``
are fetched (their links discovered); links found on a page at ``max_depth``
are counted as discovered but not followed. The page cap keeps the first
``max_pages`` fetched pages by (depth, url) -- a deterministic cut.

The driver only loops over levels; every level is a distributed join whose
result is cut from the lineage with ``checkpoint()`` into the shared
checkpoint folder (``spark.checkpoint.dir``), so a lost executor recomputes at
most one level and the plan does not grow with the depth.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir
from .export import new_table

#: Rows of a frontier that are copied to each task; a larger one is dealt by a shuffle, with the edges.
BROADCAST_FRONTIER = 1_000_000


def crawl(edges: DataFrame, seeds: DataFrame, max_depth: int,
          edge_filter: Callable[[DataFrame], DataFrame] | None = None,
          compact_every: int = 16) -> DataFrame:
    """Multi-job BFS. ``edges(src, dst)``, ``seeds(job_id, url)``. Returns the
    seen set ``(job_id, url, depth)`` including the discovered-only level
    ``max_depth + 1``. ``edge_filter`` sees candidate rows
    ``(job_id, start_url, src, url)`` and keeps the links a job may follow.

    The seen set is the union of the checkpointed levels; it is written anew
    only every ``compact_every`` levels, to keep the plan short. The start
    page travels with the frontier."""
    spark = seeds.sparkSession
    ensure_checkpoint_dir(spark)
    frontier = seeds.select("job_id", "url").distinct().withColumn("start_url", F.col("url")).withColumn("depth", F.lit(0))
    frontier = frontier.checkpoint(eager=True)
    seen = frontier.select("job_id", "url", "depth")
    # The edge table is read at every level: written once, in columns, instead
    # of re-derived from the pages per level.
    path = new_table(spark, "crawl-edges")
    edges.select("src", "dst").write.parquet(path)
    e = spark.read.schema(edges.select("src", "dst").schema).parquet(path)
    size = frontier.count()
    for d in range(max_depth + 1):
        here = frontier.select("job_id", "start_url", F.col("url").alias("src"))
        # a small frontier goes to the edges, so that these are only scanned
        cand = e.join(F.broadcast(here) if size <= BROADCAST_FRONTIER else here, "src") \
            .select("job_id", "start_url", "src", F.col("dst").alias("url"))
        if edge_filter is not None:
            cand = edge_filter(cand)
        # a job may have several start pages: the least one that reaches a page stands for it
        nxt = (cand.groupBy("job_id", "url").agg(F.min("start_url").alias("start_url"))
               .join(seen.select("job_id", "url"), ["job_id", "url"], "left_anti")
               .withColumn("depth", F.lit(d + 1)))
        nxt = nxt.checkpoint(eager=True)
        size = nxt.count()
        if not size:
            break
        seen = seen.unionByName(nxt.select("job_id", "url", "depth"))
        if (d + 1) % compact_every == 0:
            seen = seen.checkpoint(eager=True)
        frontier = nxt
    return seen


def crawl_reach(seen: DataFrame, max_depth: int) -> DataFrame:
    """Fetched pages (depth <= max_depth) with their BFS depth."""
    return seen.where(F.col("depth") <= max_depth)


def frontier_cap(reach: DataFrame, max_pages: int, prefix: int = 32) -> DataFrame:
    """At most ``max_pages`` pages per job, cut by (depth, url). Pages are
    counted by (job, depth, beginning of the url) and ranked inside these
    buckets only, so that a hot job is spread over them."""
    from ..plans.windows import limit_per_group
    bucket = [(F.col("depth"), True), (F.substring("url", 1, prefix), True)]
    return limit_per_group(reach, ["job_id"], bucket, [(F.col("url"), True)], max_pages)


def crawl_discovered(seen: DataFrame) -> DataFrame:
    """Links counted when first seen, per job (beyond max_depth too)."""
    return seen.groupBy("job_id").agg(F.count(F.lit(1)).cast("bigint").alias("discovered"))


def crawl_single(seeds: DataFrame) -> DataFrame:
    """Single mode -- the start page only, one discovered URL."""
    return seeds.select("job_id", "url", F.lit(0).alias("depth"), F.lit(1).cast("bigint").alias("discovered"))
