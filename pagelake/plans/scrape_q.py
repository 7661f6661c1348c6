"""Query: the per-page chain, with its result, version and log rows written and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import export as K
from ..operators import scrape as S
from .detectors_q import responses
from .registry import register


@register("scrape_pages")
def q_scrape_pages(spark, d):
    """One row for every page: its result, its version's blocks, and its number of log rows."""
    path = K.new_table(spark, "scrape")
    S.scrape(responses(spark, d)).write.parquet(path)
    results = spark.read.parquet(path)
    versions = S.first_versions(results).select(F.col("result_id").alias("page_id"), "version_number", "blocks_changed")
    logs = S.logs(results).groupBy(F.col("job_id").alias("page_id")).agg(F.count(F.lit(1)).alias("n_logs"), F.array_join(F.sort_array(F.collect_list("message")), " / ").alias("messages"))
    return results.join(versions, "page_id", "left").join(logs, "page_id").select(
        "page_id", "url", "http_status", "outcome", "error", "page_title", "content_hash", "content_length", F.array_join("labels", "|").alias("labels"),
        "version_number", "blocks_changed", "n_logs", "messages")
