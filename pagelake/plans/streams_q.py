"""Queries: streaming variants (S7, Z1-Z8), each compared with its batch twin."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..streaming import streams as Z
from .blocks_q import SQL_VPAGES, with_blocks_sql
from .registry import register
from .url_links import _links_sql
from ..config import EngineConfig

SQL_LOGS = ("SELECT event_id AS log_id, user_id AS job_id, CASE event_type WHEN 'error' THEN 'error' WHEN 'signup' THEN 'warning' "
            "WHEN 'purchase' THEN 'critical' WHEN 'view' THEN 'debug' ELSE 'info' END AS level, props AS message, ts AS created_at "
            "FROM events")


@register("stream_pages", sql="SELECT page_id, url FROM pages")
def q_stream_pages(spark, d):
    s = Z.read_stream(spark, d, "pages").select("page_id", "url")
    return Z.run(s, "pages")


@register("stream_log_tail", sql=f"SELECT log_id, job_id, level, message, created_at FROM ({SQL_LOGS}) WHERE job_id = 7")
def q_stream_log_tail(spark, d):
    return Z.stream_log_tail(spark, d, 7).withColumn("created_at", F.col("created_at").cast("timestamp_ntz"))


@register("stream_job_status", sql=(f"SELECT job_id, count(*) AS total, count(*) FILTER (WHERE level = 'error') AS errors, "
                                    f"max(created_at) AS last_at FROM ({SQL_LOGS}) GROUP BY job_id"))
def q_stream_job_status(spark, d):
    return Z.stream_job_status(spark, d).withColumn("last_at", F.col("last_at").cast("timestamp_ntz"))


@register("stream_job_finished", sql="SELECT DISTINCT o_orderkey AS job_id, 'completed' AS status, 'job_finished' AS type FROM orders WHERE o_orderstatus = 'F'")
def q_stream_job_finished(spark, d):
    return Z.stream_job_finished(spark, d)


@register("stream_versions", sql=(
    "SELECT url, result_id, CAST(version_number AS INTEGER) AS version_number, content_hash FROM (SELECT *, "
    "sum(chg) OVER (PARTITION BY url ORDER BY created_at, result_id ROWS UNBOUNDED PRECEDING) AS version_number FROM ("
    "SELECT *, CASE WHEN lag(content_hash) OVER (PARTITION BY url ORDER BY created_at, result_id) IS DISTINCT FROM content_hash "
    "THEN 1 ELSE 0 END AS chg FROM (SELECT event_id AS result_id, 'https://site' || CAST(user_id % 40 AS VARCHAR) || '.example.com/p' "
    "AS url, ts AS created_at, sha256(event_type) AS content_hash FROM events))) WHERE chg = 1"))
def q_stream_versions(spark, d):
    return Z.stream_versions(spark, d)


@register("stream_seen_links", sql=f"SELECT DISTINCT link FROM ({_links_sql(EngineConfig())})")
def q_stream_seen_links(spark, d):
    return Z.stream_seen_links(spark, d)


@register("stream_volume", sql="SELECT CAST(ts AS DATE) AS date, count(*) AS count FROM events GROUP BY 1")
def q_stream_volume(spark, d):
    return Z.stream_volume(spark, d)


# the batch rules over the pages as they are
SQL_EXTRACT = with_blocks_sql("SELECT page_id, type, pos, content FROM blocks_ UNION ALL SELECT page_id, 'link', CAST(pos AS INTEGER), link FROM (" + _links_sql(EngineConfig()) + ")") \
    .replace(SQL_VPAGES, "(SELECT page_id, url, html FROM pages)")


@register("stream_extract", sql=SQL_EXTRACT)
def q_stream_extract(spark, d):
    return Z.stream_extract(spark, d)


@register("stream_retention", sql=(f"SELECT log_id, job_id, created_at FROM ({SQL_LOGS}) "
                                   f"WHERE created_at >= TIMESTAMP '2024-01-30 00:00:00' - INTERVAL 10 DAY"))
def q_stream_retention(spark, d):
    return Z.stream_retention(spark, d, "2024-01-30 00:00:00", 10).withColumn(
        "created_at", F.col("created_at").cast("timestamp_ntz"))
