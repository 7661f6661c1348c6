"""Queries: tables changed in place (T1, T2, T10) and pages by their last row (L1-L3), each written to a new folder and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import export as K
from ..operators import stats as A
from ..operators import stored as S
from ..sources import views as V
from .app_tables import AS_OF
from .registry import register

STATUS = "CASE level WHEN 'error' THEN 'failed' WHEN 'critical' THEN 'stopped' END"
SQL_LAST = (f"SELECT job_id, arg_max({STATUS}, (created_at, log_id)) FILTER ({STATUS} IS NOT NULL) AS status, "
            "arg_max(message, (created_at, log_id)) FILTER (level = 'error' AND message IS NOT NULL) AS last_error FROM v_logs GROUP BY job_id")


@register("apply_job_changes", sql=f"SELECT j.job_id, coalesce(c.status, j.status) AS status, c.last_error, j.pages_scraped FROM v_jobs j LEFT JOIN ({SQL_LAST}) c USING (job_id)",
          views=["v_jobs", "v_logs"])
def q_apply_job_changes(spark, d):
    """Every log row is a change of its job; the set is applied twice, which is the same as once."""
    path = K.new_table(spark, "jobs")
    S.write_keyed(V.v_jobs(spark, d).select("job_id", "status", F.lit(None).cast("string").alias("last_error"), "pages_scraped"), path, "job_id")
    level = F.col("level")
    changes = V.v_logs(spark, d).select("job_id", "created_at", "log_id", F.when(level == "error", "failed").when(level == "critical", "stopped").alias("status"),
                                        F.when(level == "error", F.col("message")).alias("last_error"))
    for _ in range(2):
        S.apply_changes(spark, path, changes, "job_id", ["created_at", "log_id"], ["status", "last_error"])
    return S.read_keyed(spark, path)


@register("expire_log_days", sql=f"SELECT log_id, job_id, level, created_at FROM v_logs WHERE created_at >= TIMESTAMP '{AS_OF}' - INTERVAL 10 DAY", views=["v_logs"])
def q_expire_log_days(spark, d):
    path = K.new_table(spark, "logs")
    S.write_days(V.v_logs(spark, d).select("log_id", "job_id", "level", "created_at"), path)
    S.expire(spark, path, AS_OF, 10)
    return spark.read.parquet(path).select("log_id", "job_id", "level", "created_at")


@register("page_jobs_after", sql=("SELECT * FROM v_jobs WHERE created_at < DATE '1998-06-17' OR (created_at = DATE '1998-06-17' AND job_id < 5000) "
                                  "ORDER BY created_at DESC, job_id DESC LIMIT 500"), views=["v_jobs"])
def q_page_jobs_after(spark, d):
    return A.page_after(V.v_jobs(spark, d), "created_at", "job_id", 500, after=("1998-06-17", 5000))


@register("page_logs_after", sql=("SELECT * FROM v_logs WHERE created_at > TIMESTAMP '2024-01-15 12:00:00' OR (created_at = TIMESTAMP '2024-01-15 12:00:00' AND log_id > 100) "
                                  "ORDER BY created_at, log_id LIMIT 1000"), views=["v_logs"])
def q_page_logs_after(spark, d):
    return A.page_after(V.v_logs(spark, d), "created_at", "log_id", 1000, after=("2024-01-15 12:00:00", 100), ascending=True)
