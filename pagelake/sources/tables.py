"""Table sources.

Every source is a lazy ``spark.read.parquet`` scan: the callers' projections
and filters reach the parquet reader (ReadSchema / PushedFilters), so nothing
here selects more than the plan above it asks for.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels",
          "conversations"]


def table_path(sf_dir: str, name: str) -> str:
    return os.path.join(sf_dir, f"{name}.parquet")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One stored table, schema taken from the parquet footer."""
    return spark.read.parquet(table_path(sf_dir, name))


def read_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fetched responses with defaulted response metadata.

    The test table holds ``page_id, url, html``; status, headers, cookies,
    final url and fetch time are filled with the defaults of a plain 200
    response so every detector sees the full response shape.
    """
    p = read_table(spark, sf_dir, "pages")
    cols = set(p.columns)
    return p.select(
        "page_id", "url", "html",
        (F.col("http_status") if "http_status" in cols else F.lit(200)).alias("http_status"),
        (F.col("headers") if "headers" in cols
         else F.create_map().cast("map<string,string>")).alias("headers"),
        (F.col("cookie_names") if "cookie_names" in cols
         else F.array().cast("array<string>")).alias("cookie_names"),
        (F.coalesce(F.col("final_url"), F.col("url")) if "final_url" in cols
         else F.col("url")).alias("final_url"),
    )
