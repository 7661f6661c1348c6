"""The per-page chain from a fetched response to its result, version and log rows, reusing the single operators:
wall -> outcome -> blocks -> classification text -> labels -> result, first version, logs.

Everything up to the labels happens in the page's own row, in one pass over its html; the row is the same for pages that
failed (their content is left out), so that no page is lost on the way.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT, UNCATEGORIZED, EngineConfig
from ..functions.html import page_title, pystrip
from ..functions.jsonx import BLOCK_TYPE, content_hash, content_length
from ..plans.windows import row_barrier
from . import blocks as B
from . import classify as C
from . import detectors as D
from . import export as K

RESULT = ["page_id", "url", "http_status", "outcome", "error", "page_title", "content", "content_hash", "content_length", "labels"]


def scrape(responses: DataFrame, cfg: EngineConfig = DEFAULT, scorer: str = "keyword") -> DataFrame:
    """Results: one row (RESULT) for each response (page_id, url, html, http_status, headers, cookie_names, final_url)."""
    lower = responses.withColumn("_lc", F.lower("html"))
    wall = D.wall_detect("http_status", "headers", "cookie_names", "_lc", "final_url", body_is_lower=True)
    base = row_barrier(lower.withColumn("_w", wall).select("page_id", "url", "html", "http_status", "_w"))
    o = D.fetch_outcome("http_status", F.col("_w"))
    base = base.select("page_id", "url", "http_status", o["outcome"].alias("outcome"), o["error"].alias("error"),
                       page_title("html").alias("page_title"), "html")
    blank = F.coalesce(pystrip(F.col("html")), F.lit("")) == ""
    got = B.extract_blocks(base, ("text",), "html", cfg)
    none = base.where(blank).drop("html").withColumn("blocks", F.array().cast(f"array<{BLOCK_TYPE}>"))
    got = got.unionByName(none)
    ok = F.col("outcome") == "success"
    got = row_barrier(got.withColumn("content", F.when(ok, F.col("blocks"))).withColumn("page_title", F.when(ok, F.col("page_title"))).drop("blocks"))
    got = row_barrier(got.withColumn("_t", C.class_text_service(F.col("page_title"), F.col("content"), cfg.max_words)))
    labels = C.classify_with_scorer(F.col("_t"), scorer, list(cfg.candidate_labels), cfg.confidence_threshold)["labels"]
    found = F.when(F.size(labels) > 0, labels).otherwise(F.array(F.lit(UNCATEGORIZED)))
    return got.withColumn("labels", F.when(ok, found)).withColumn("error", F.when(ok, F.lit(None)).otherwise(F.col("error"))) \
        .withColumn("content_hash", content_hash(F.col("content"))).withColumn("content_length", content_length(F.col("content"))).select(*RESULT)


def first_versions(results: DataFrame) -> DataFrame:
    """The snapshot rows of results with content, as the first version of their page."""
    return results.where(F.size("content") > 0).select(
        "url", F.col("page_id").alias("result_id"), F.lit(1).alias("version_number"), "content_hash", F.lit(True).alias("is_snapshot"),
        F.col("content").alias("full_content"), F.lit("Initial snapshot").alias("change_summary"), F.size("content").alias("blocks_changed"))


def logs(results: DataFrame) -> DataFrame:
    """Log rows of all results: outcome and, for classified ones, their labels."""
    named = F.filter(F.coalesce("labels", F.array().cast("array<string>")), lambda x: x != UNCATEGORIZED)
    return K.outcome_logs(results.select(F.col("page_id").alias("job_id"), "url", "outcome", "error", named.alias("labels")))
