"""Queries: scans (S), filters (F1-F3, F14-F18), table state (T1-T11), joins
(J1-J3), statistics (A1-A12), paging (L1-L3), latest status (W7)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import stats as A
from ..operators import tables as T
from ..sources import views as V
from ..sources.tables import read_pages, read_table
from ..config import DEFAULT as CFG
from .registry import register

AS_OF = "2024-01-30 00:00:00"
DEFAULT_CATEGORIES = {"technology": ["software", "programming", "developer", "api"],
                      "food": ["recipe", "cooking", "restaurant"],
                      "small ring #0": ["ring"]}


# ------------------------------------------------------------------ scans
@register("scan_pages", sql=("SELECT page_id, url, 200 AS http_status, url AS final_url, "
                             "CAST(0 AS INTEGER) AS n_headers, CAST(0 AS INTEGER) AS n_cookies, "
                             "CAST(length(html) AS INTEGER) AS html_chars FROM pages"))
def q_scan_pages(spark, d):
    p = read_pages(spark, d)
    return p.select("page_id", "url", "http_status", "final_url", F.size("headers").alias("n_headers"),
                    F.size("cookie_names").alias("n_cookies"), F.length("html").alias("html_chars"))


@register("scan_tables", sql="SELECT * FROM v_jobs", views=["v_jobs"])
def q_scan_tables(spark, d):
    return V.v_jobs(spark, d)


@register("default_categories", sql=(
    "WITH act AS (SELECT name, keywords FROM v_category_table WHERE is_active), "
    "d AS (SELECT * FROM (VALUES ('technology', 'software|programming|developer|api'), ('food', 'recipe|cooking|restaurant'), "
    "('small ring #0', 'ring')) t(name, kw)) "
    "SELECT name, array_to_string(keywords, '|') AS keywords, 'stored' AS source FROM act UNION ALL "
    "SELECT name, kw AS keywords, 'default' AS source FROM d WHERE lower(name) NOT IN (SELECT lower(name) FROM act)"),
    views=["v_category_table"])
def q_default_categories(spark, d):
    out = T.load_categories(V.v_category_table(spark, d), DEFAULT_CATEGORIES)
    return out.select("name", F.array_join("keywords", "|").alias("keywords"), "source")


@register("scan_by_key", sql="SELECT * FROM v_jobs WHERE job_id = 4242", views=["v_jobs"])
def q_scan_by_key(spark, d):
    return V.v_jobs(spark, d).where(F.col("job_id") == 4242)


@register("scan_category_by_name", sql=(
    "SELECT category_id, name, description FROM v_category_table WHERE lower(name) = lower('Red Widget #1')"),
    views=["v_category_table"])
def q_scan_category_by_name(spark, d):
    c = V.v_category_table(spark, d)
    return c.where(F.lower("name") == F.lower(F.lit("Red Widget #1"))).select("category_id", "name", "description")


# ------------------------------------------------------------------ filters
@register("filter_jobs_status", sql="SELECT * FROM v_jobs WHERE status = 'running'", views=["v_jobs"])
def q_filter_jobs_status(spark, d):
    return V.v_jobs(spark, d).where(F.col("status") == "running")


@register("filter_logs_level", sql="SELECT * FROM v_logs WHERE job_id = 7 AND level = 'error'", views=["v_logs"])
def q_filter_logs_level(spark, d):
    return V.v_logs(spark, d).where((F.col("job_id") == 7) & (F.col("level") == "error"))


@register("filter_active_categories", sql=(
    "SELECT category_id, name FROM v_category_table WHERE is_active"), views=["v_category_table"])
def q_filter_active_categories(spark, d):
    return V.v_category_table(spark, d).where(F.col("is_active")).select("category_id", "name")


SQL_JOB_FILTERS = ("SELECT c_custkey AS job_id, unnest([(c_custkey * 7) % 2000, (c_custkey * 13 + 5) % 2000]) AS category_id "
                   "FROM customer WHERE c_mktsegment = 'BUILDING'")


def _job_filters(spark, d):
    """Each BUILDING customer (job) filters on two categories derived from
    its key (a bounded list per job, no pair-producing join)."""
    c = read_table(spark, d, "customer").where(F.col("c_mktsegment") == "BUILDING")
    k = F.col("c_custkey")
    return c.select(k.alias("job_id"), F.explode(F.array((k * 7) % 2000, (k * 13 + 5) % 2000)).alias("category_id"))


@register("save_filter", sql=(
    f"WITH r AS (SELECT o_orderkey AS result_id, o_custkey AS job_id FROM orders), jf AS ({SQL_JOB_FILTERS}) "
    "SELECT result_id, job_id FROM r WHERE job_id NOT IN (SELECT job_id FROM jf) OR EXISTS ("
    "SELECT 1 FROM v_result_categories b WHERE b.result_id = r.result_id AND ("
    "EXISTS (SELECT 1 FROM jf WHERE jf.job_id = r.job_id AND jf.category_id = b.category_id) OR b.category_id = 0))"),
    views=["v_result_categories"])
def q_save_filter(spark, d):
    o = read_table(spark, d, "orders").select(F.col("o_orderkey").alias("result_id"), F.col("o_custkey").alias("job_id"))
    unc = spark.range(1).select(F.lit(0).cast("bigint").alias("category_id"))  # id of the Uncategorized row
    return T.save_filter(o, V.v_result_categories(spark, d), _job_filters(spark, d), unc)


@register("confidence_filter", sql=(
    "SELECT vec_id, array_to_string(list_transform(list_filter(list_zip(lb, embedding), lambda x: x[2] >= 0.4), "
    "lambda x: x[1]), '|') AS labels FROM (SELECT vec_id, embedding, "
    "list_transform(generate_series(1, len(embedding)), lambda i: 'L' || CAST(i AS VARCHAR)) AS lb FROM embeddings)"))
def q_confidence_filter(spark, d):
    e = read_table(spark, d, "embeddings")
    lb = F.transform(F.sequence(F.lit(1), F.size("embedding")), lambda i: F.concat(F.lit("L"), i.cast("string")))
    kept = T.confidence_filter(lb, F.col("embedding"), 0.4)
    return e.select("vec_id", F.array_join(F.transform(kept, lambda x: x["label"]), "|").alias("labels"))


SQL_JOB_REQ = ("SELECT c_custkey AS job_id, CASE WHEN c_acctbal < 0 THEN '' ELSE c_name END AS name, "
               "CASE WHEN c_mktsegment = 'MACHINERY' THEN '' ELSE 'https://c' || CAST(c_custkey AS VARCHAR) || '.example.com/' END AS start_url, "
               "CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'single' WHEN 'BUILDING' THEN 'rule_based' "
               "WHEN 'FURNITURE' THEN 'infinite' WHEN 'HOUSEHOLD' THEN 'category' ELSE lower(c_mktsegment) END AS crawl_mode, "
               "'pending' AS status FROM customer")


def _job_requests(spark, d):
    c = read_table(spark, d, "customer")
    return c.select(
        F.col("c_custkey").alias("job_id"),
        F.when(F.col("c_acctbal") < 0, F.lit("")).otherwise(F.col("c_name")).alias("name"),
        F.when(F.col("c_mktsegment") == "MACHINERY", F.lit(""))
        .otherwise(F.concat(F.lit("https://c"), F.col("c_custkey").cast("string"), F.lit(".example.com/"))).alias("start_url"),
        F.when(F.col("c_mktsegment") == "AUTOMOBILE", "single").when(F.col("c_mktsegment") == "BUILDING", "rule_based")
        .when(F.col("c_mktsegment") == "FURNITURE", "infinite").when(F.col("c_mktsegment") == "HOUSEHOLD", "category")
        .otherwise(F.lower("c_mktsegment")).alias("crawl_mode"),
        F.lit("pending").alias("status"))


@register("validate_jobs", sql=(
    f"SELECT job_id, len(e) = 0 AS valid, array_to_string(e, '|') AS errors FROM (SELECT job_id, list_filter(["
    "CASE WHEN name IS NULL OR length(name) < 1 THEN 'name: too short' END, "
    "CASE WHEN length(name) > 255 THEN 'name: too long' END, "
    "CASE WHEN start_url IS NULL OR trim(start_url) = '' THEN 'start_url: required' END, "
    "CASE WHEN crawl_mode NOT IN ('single', 'rule_based', 'infinite', 'category') THEN 'crawl_mode: invalid' END, "
    "CASE WHEN status IS NOT NULL AND status NOT IN ('pending', 'running', 'paused', 'completed', 'failed', 'stopped') THEN 'status: invalid' END"
    f"], lambda x: x IS NOT NULL) AS e FROM ({SQL_JOB_REQ}))"))
def q_validate_jobs(spark, d):
    v = T.validate_jobs(_job_requests(spark, d))
    return v.select("job_id", (F.size("errors") == 0).alias("valid"), F.array_join("errors", "|").alias("errors"))


SQL_ACTIONS = ("SELECT job_id, status, CASE WHEN job_id % 3 = 0 THEN 'pause' WHEN job_id % 3 = 1 THEN 'resume' "
               "ELSE 'stop' END AS action FROM v_jobs")


@register("action_allowed", sql=(
    f"SELECT r.job_id, r.status, r.action, t.new_status, t.new_status IS NULL AS rejected FROM ({SQL_ACTIONS}) r "
    "LEFT JOIN (VALUES ('pause', 'running', 'paused'), ('resume', 'paused', 'running'), ('stop', 'running', 'stopped'), "
    "('stop', 'paused', 'stopped')) t(action, status, new_status) ON t.action = r.action AND t.status = r.status"),
    views=["v_jobs"])
def q_action_allowed(spark, d):
    j = V.v_jobs(spark, d)
    req = j.select("job_id", "status", F.when(F.col("job_id") % 3 == 0, "pause").when(F.col("job_id") % 3 == 1, "resume")
                   .otherwise("stop").alias("action"))
    return T.action_allowed(req).select("job_id", "status", "action", "new_status", "rejected")


@register("run_once_guard", sql=(
    "SELECT job_id, status FROM v_jobs WHERE status NOT IN ('completed', 'stopped', 'failed', 'paused')"),
    views=["v_jobs"])
def q_run_once_guard(spark, d):
    return T.run_once_guard(V.v_jobs(spark, d)).select("job_id", "status")


# ------------------------------------------------------------------ table state
SQL_STATUS_CHANGES = ("SELECT job_id, CASE WHEN level = 'error' THEN 'failed' WHEN level = 'critical' THEN 'stopped' END AS status, "
                      "CASE WHEN level IN ('error', 'critical') THEN message END AS last_error FROM ("
                      "SELECT job_id, arg_max(level, (created_at, log_id)) AS level, arg_max(message, (created_at, log_id)) AS message "
                      "FROM v_logs GROUP BY job_id)")


def _status_changes(spark, d):
    lg = V.v_logs(spark, d).groupBy("job_id").agg(
        F.max_by("level", F.struct("created_at", "log_id")).alias("level"),
        F.max_by("message", F.struct("created_at", "log_id")).alias("message"))
    return lg.select("job_id", F.when(F.col("level") == "error", "failed").when(F.col("level") == "critical", "stopped")
                     .alias("status"),
                     F.when(F.col("level").isin("error", "critical"), F.col("message")).alias("last_error"))


@register("upsert_status", sql=(
    f"SELECT j.job_id, coalesce(c.status, j.status) AS status, c.last_error AS last_error FROM v_jobs j "
    f"LEFT JOIN ({SQL_STATUS_CHANGES}) c ON c.job_id = j.job_id"), views=["v_jobs", "v_logs"])
def q_upsert_status(spark, d):
    j = V.v_jobs(spark, d).select("job_id", "status", F.lit(None).cast("string").alias("last_error"))
    return T.upsert_fields(j, _status_changes(spark, d), "job_id", ["status", "last_error"])


SQL_PROGRESS = ("SELECT job_id, CAST(count(*) FILTER (WHERE http_status < 400) AS BIGINT) AS pages_scraped, "
                "CAST(count(*) FILTER (WHERE http_status >= 400) AS BIGINT) AS pages_failed, "
                "CAST(count(DISTINCT url) AS BIGINT) AS total_pages_discovered FROM v_results GROUP BY job_id")


@register("upsert_progress", sql=(
    f"SELECT j.job_id, coalesce(p.pages_scraped, j.pages_scraped) AS pages_scraped, "
    f"coalesce(p.pages_failed, j.pages_failed) AS pages_failed, "
    f"coalesce(p.total_pages_discovered, CAST(0 AS BIGINT)) AS total_pages_discovered FROM v_jobs j "
    f"LEFT JOIN ({SQL_PROGRESS}) p ON p.job_id = j.job_id"), views=["v_jobs", "v_results"])
def q_upsert_progress(spark, d):
    j = V.v_jobs(spark, d).select("job_id", "pages_scraped", "pages_failed",
                                  F.lit(0).cast("bigint").alias("total_pages_discovered"))
    return T.upsert_fields(j, A.job_summary(V.v_results(spark, d)), "job_id",
                           ["pages_scraped", "pages_failed", "total_pages_discovered"])


SQL_FINAL = ("CASE WHEN status IN ('stopped', 'paused') THEN status WHEN pages_failed > 0 AND pages_scraped = 0 "
             "THEN 'failed' ELSE 'completed' END")


@register("final_status", sql=f"SELECT job_id, {SQL_FINAL} AS final_status FROM v_jobs", views=["v_jobs"])
def q_final_status(spark, d):
    j = V.v_jobs(spark, d)
    return j.select("job_id", T.final_status(F.col("status"), F.col("pages_scraped"), F.col("pages_failed"))
                    .alias("final_status"))


@register("final_status_guard", sql=(
    f"SELECT job_id, CASE WHEN status = 'running' THEN {SQL_FINAL} ELSE status END AS status FROM v_jobs"),
    views=["v_jobs"])
def q_final_status_guard(spark, d):
    j = V.v_jobs(spark, d)
    finals = j.select("job_id", T.final_status(F.col("status"), F.col("pages_scraped"), F.col("pages_failed"))
                      .alias("status"))
    return T.final_status_guard(j.select("job_id", "status"), finals)


SQL_DOOMED = "(SELECT user_id FROM events WHERE event_type = 'purchase' AND value > 300)"


# versions hang on results (two of each third one), links on jobs
@register("delete_cascade", sql=(
    f"SELECT 'results' AS tbl, result_id AS id FROM v_results WHERE job_id NOT IN {SQL_DOOMED} "
    f"UNION ALL SELECT 'logs' AS tbl, log_id AS id FROM v_logs WHERE job_id NOT IN {SQL_DOOMED} "
    f"UNION ALL SELECT 'versions' AS tbl, result_id * 10 + v AS id FROM v_results, (SELECT 1 AS v UNION ALL SELECT 2) WHERE result_id % 3 = 0 AND job_id NOT IN {SQL_DOOMED} "
    f"UNION ALL SELECT 'links' AS tbl, event_id AS id FROM events WHERE event_type = 'view' AND user_id NOT IN {SQL_DOOMED}"),
    views=["v_results", "v_logs"])
def q_delete_cascade(spark, d):
    e = read_table(spark, d, "events")
    doomed = e.where((F.col("event_type") == "purchase") & (F.col("value") > 300)).select("user_id")
    results = V.v_results(spark, d)
    versions = results.where("result_id % 3 = 0").select("result_id", F.explode(F.array(F.lit(1), F.lit(2))).alias("v")).select(
        (F.col("result_id") * 10 + F.col("v")).alias("version_id"), F.col("result_id").alias("of_result"))
    links = e.where("event_type = 'view'").select(F.col("event_id").alias("link_id"), F.col("user_id").alias("job_id"))
    out = T.delete_cascade(doomed, {"results": (results, "job_id"), "logs": (V.v_logs(spark, d), "job_id"), "links": (links, "job_id")},
                           {"versions": (versions, "of_result", "results", "result_id")})
    ids = {"results": "result_id", "logs": "log_id", "versions": "version_id", "links": "link_id"}
    parts = [out[t].select(F.lit(t).alias("tbl"), F.col(c).alias("id")) for t, c in ids.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


SQL_DELETE_REQ = "SELECT p_partkey AS category_id FROM part WHERE p_size = 50"


@register("delete_category_guarded", sql=(
    f"SELECT r.category_id, c.name, CAST(coalesce(u.n, 0) AS BIGINT) AS usage_count, "
    f"CASE WHEN c.name IS NULL THEN 'not_found' WHEN lower(c.name) = 'uncategorized' THEN 'protected' "
    f"WHEN coalesce(u.n, 0) > 0 THEN 'in_use' ELSE 'deleted' END AS outcome FROM ({SQL_DELETE_REQ}) r "
    f"LEFT JOIN v_category_table c ON c.category_id = r.category_id "
    f"LEFT JOIN (SELECT category_id, count(*) AS n FROM v_result_categories GROUP BY 1) u ON u.category_id = r.category_id"),
    views=["v_category_table", "v_result_categories"])
def q_delete_category_guarded(spark, d):
    req = read_table(spark, d, "part").where(F.col("p_size") == 50).select(F.col("p_partkey").alias("category_id"))
    return T.delete_category_guarded(V.v_category_table(spark, d), V.v_result_categories(spark, d), req)


SQL_NEW_SETS = ("SELECT o_orderkey AS result_id, coalesce(list(l_partkey) FILTER (WHERE l_returnflag = 'R'), []) AS ids "
                "FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderstatus = 'P' GROUP BY o_orderkey")


@register("replace_assignments", sql=(
    f"SELECT result_id, category_id FROM v_result_categories WHERE result_id NOT IN (SELECT result_id FROM ({SQL_NEW_SETS})) "
    f"UNION SELECT result_id, unnest(ids) AS category_id FROM ({SQL_NEW_SETS})"), views=["v_result_categories"])
def q_replace_assignments(spark, d):
    changed = read_table(spark, d, "orders").where(F.col("o_orderstatus") == "P") \
        .select(F.col("o_orderkey").alias("result_id"))
    li = read_table(spark, d, "lineitem").where(F.col("l_returnflag") == "R") \
        .select(F.col("l_orderkey").alias("result_id"), F.col("l_partkey").alias("category_id"))
    new_links = li.join(changed, "result_id", "left_semi")
    return T.replace_assignments(V.v_result_categories(spark, d), changed, new_links)


SQL_LABELS = ("SELECT CASE WHEN event_id % 2 = 0 THEN upper(event_type) ELSE event_type END AS label, "
              "event_id AS ord FROM events")


@register("get_or_create_categories", sql=(
    "WITH ex AS (SELECT name, description FROM v_category_table UNION ALL SELECT 'View', 'Pages viewed'), "
    f"lab AS ({SQL_LABELS}), first AS (SELECT arg_min(label, ord) AS name FROM lab GROUP BY lower(label)) "
    "SELECT name, description, false AS created FROM ex UNION ALL SELECT name, 'Auto-created by AI classifier' AS description, "
    "true AS created FROM first WHERE lower(name) NOT IN (SELECT lower(name) FROM ex)"), views=["v_category_table"])
def q_get_or_create(spark, d):
    ex = V.v_category_table(spark, d).select("name", "description").unionByName(
        spark.createDataFrame([("View", "Pages viewed")], "name string, description string"))
    e = read_table(spark, d, "events")
    lab = e.select(F.when(F.col("event_id") % 2 == 0, F.upper("event_type")).otherwise(F.col("event_type")).alias("label"),
                   F.col("event_id").alias("ord"))
    return T.get_or_create_categories(ex, lab)


@register("ensure_uncategorized", sql=(
    "SELECT name, description FROM v_category_table UNION ALL SELECT 'Uncategorized', 'Fallback category' "
    "WHERE NOT EXISTS (SELECT 1 FROM v_category_table WHERE lower(name) = 'uncategorized')"),
    views=["v_category_table"])
def q_ensure_uncategorized(spark, d):
    return T.ensure_uncategorized(V.v_category_table(spark, d))


SQL_PATCHES = ("SELECT p_partkey AS category_id, CASE WHEN p_size > 48 THEN upper(p_name) END AS name, "
               "CASE WHEN p_size > 45 THEN p_brand END AS description, CASE WHEN p_size < 3 THEN false END AS is_active "
               "FROM part WHERE p_size > 45 OR p_size < 3")


@register("update_category_fields", sql=(
    "WITH c AS (SELECT category_id, name, description, is_active FROM v_category_table "
    "UNION ALL SELECT -1, 'Uncategorized', 'Fallback category', true), "
    f"p AS ({SQL_PATCHES} UNION ALL SELECT -1, 'Misc', NULL, NULL), "
    "j AS (SELECT c.*, p.name AS pn, p.description AS pd, p.is_active AS pa, "
    "coalesce(lower(c.name) = 'uncategorized' AND p.name IS NOT NULL AND p.name <> c.name, false) AS rejected "
    "FROM c LEFT JOIN p ON p.category_id = c.category_id) "
    "SELECT category_id, CASE WHEN rejected THEN name ELSE coalesce(pn, name) END AS name, "
    "CASE WHEN rejected THEN description ELSE coalesce(pd, description) END AS description, "
    "CASE WHEN rejected THEN is_active ELSE coalesce(pa, is_active) END AS is_active, rejected FROM j"),
    views=["v_category_table"])
def q_update_category_fields(spark, d):
    c = V.v_category_table(spark, d).select("category_id", "name", "description", "is_active").unionByName(
        spark.createDataFrame([(-1, "Uncategorized", "Fallback category", True)],
                              "category_id bigint, name string, description string, is_active boolean"))
    p = read_table(spark, d, "part").where((F.col("p_size") > 45) | (F.col("p_size") < 3)).select(
        F.col("p_partkey").alias("category_id"),
        F.when(F.col("p_size") > 48, F.upper("p_name")).alias("name"),
        F.when(F.col("p_size") > 45, F.col("p_brand")).alias("description"),
        F.when(F.col("p_size") < 3, F.lit(False)).alias("is_active"))
    p = p.unionByName(spark.createDataFrame([(-1, "Misc", None, None)],
                                            "category_id bigint, name string, description string, is_active boolean"))
    return T.update_category_fields(c, p)


@register("log_retention", sql=(
    "SELECT CAST(count(*) FILTER (WHERE created_at >= TIMESTAMP '2024-01-30 00:00:00' - INTERVAL 10 DAY) AS BIGINT) AS kept, "
    "CAST(count(*) FILTER (WHERE NOT (created_at >= TIMESTAMP '2024-01-30 00:00:00' - INTERVAL 10 DAY) OR created_at IS NULL) AS BIGINT) AS deleted "
    "FROM v_logs"), views=["v_logs"])
def q_log_retention(spark, d):
    return T.log_retention_counts(V.v_logs(spark, d), AS_OF, 10)


@register("log_cap_per_job", sql=(
    "SELECT log_id, job_id FROM (SELECT log_id, job_id, row_number() OVER (PARTITION BY job_id ORDER BY created_at DESC, "
    f"log_id DESC) AS rn FROM v_logs) WHERE rn <= {CFG.max_log_entries_per_job}"), views=["v_logs"])
def q_log_cap_per_job(spark, d):
    return T.log_cap_per_job(V.v_logs(spark, d), CFG.max_log_entries_per_job).select("log_id", "job_id")


# ------------------------------------------------------------------ joins
@register("join_result_categories", sql=(
    "SELECT b.result_id, c.name FROM v_result_categories b JOIN v_category_table c ON c.category_id = b.category_id"),
    views=["v_result_categories", "v_category_table"])
def q_join_result_categories(spark, d):
    b = V.v_result_categories(spark, d)
    # categories are bounded by the part dimension; let AQE choose broadcast by its runtime size
    c = V.v_category_table(spark, d).select("category_id", "name")
    return b.join(c, "category_id").select("result_id", "name")


@register("join_category_usage", sql=(
    "SELECT c.category_id, c.name, CAST(count(b.result_id) AS BIGINT) AS usage_count FROM v_category_table c "
    "LEFT JOIN v_result_categories b ON b.category_id = c.category_id GROUP BY c.category_id, c.name"),
    views=["v_result_categories", "v_category_table"])
def q_join_category_usage(spark, d):
    u = V.v_result_categories(spark, d).groupBy("category_id").agg(F.count(F.lit(1)).alias("n"))
    c = V.v_category_table(spark, d).select("category_id", "name")
    return c.join(u, "category_id", "left").select(
        "category_id", "name", F.coalesce("n", F.lit(0)).cast("bigint").alias("usage_count"))


# ------------------------------------------------------------------ stats
@register("count_jobs", sql=(
    "SELECT CAST(count(*) AS BIGINT) AS n_jobs, CAST(count(*) FILTER (WHERE status = 'running') AS BIGINT) AS n_running "
    "FROM v_jobs"), views=["v_jobs"])
def q_count_jobs(spark, d):
    j = V.v_jobs(spark, d)
    return j.agg(F.count(F.lit(1)).cast("bigint").alias("n_jobs"),
                 F.count_if(F.col("status") == "running").cast("bigint").alias("n_running"))


@register("stats", sql=(
    "SELECT CAST(count(*) AS BIGINT) AS total_jobs, CAST(count(*) FILTER (WHERE status = 'running') AS BIGINT) AS running_jobs, "
    "CAST(coalesce(sum(pages_scraped), 0) AS BIGINT) AS total_pages_scraped, CAST(coalesce(sum(pages_failed), 0) AS BIGINT) AS total_pages_failed, "
    "(SELECT CAST(count(*) AS BIGINT) FROM documents) AS total_versions FROM v_jobs"), views=["v_jobs"])
def q_stats(spark, d):
    return A.stats(V.v_jobs(spark, d), read_table(spark, d, "documents").select("doc_id"))


@register("scrape_volume", sql=(
    "SELECT CAST(created_at AS DATE) AS date, CAST(count(*) AS BIGINT) AS count FROM v_results "
    "WHERE created_at >= TIMESTAMP '2024-01-30 00:00:00' - INTERVAL 14 DAY GROUP BY 1"), views=["v_results"])
def q_scrape_volume(spark, d):
    return A.scrape_volume(V.v_results(spark, d), AS_OF, 14)


@register("category_distribution", sql=(
    "SELECT c.name AS category, CAST(count(*) AS BIGINT) AS count FROM v_result_categories b "
    "JOIN v_category_table c ON c.category_id = b.category_id GROUP BY c.category_id, c.name"),
    views=["v_result_categories", "v_category_table"])
def q_category_distribution(spark, d):
    return A.category_distribution(V.v_result_categories(spark, d), V.v_category_table(spark, d))


@register("count_logs", sql="SELECT job_id, CAST(count(*) AS BIGINT) AS total FROM v_logs GROUP BY job_id",
          views=["v_logs"])
def q_count_logs(spark, d):
    return A.count_logs(V.v_logs(spark, d))


@register("job_summary", sql=SQL_PROGRESS, views=["v_results"])
def q_job_summary(spark, d):
    return A.job_summary(V.v_results(spark, d))


@register("pages_per_second", sql=(
    "SELECT job_id, done, round(el, 6) AS elapsed_s, CASE WHEN done > 0 AND el > 0.5 THEN round(done / el, 2) ELSE 0.0 END "
    "AS pages_per_second FROM (SELECT job_id, CAST(count(*) AS BIGINT) AS done, "
    "(epoch_us(max(created_at)) - epoch_us(min(created_at))) / 1e6 AS el FROM v_results GROUP BY job_id)"),
    views=["v_results"])
def q_pages_per_second(spark, d):
    return A.pages_per_second(V.v_results(spark, d))


@register("dashboard_metrics", sql=(
    "SELECT CAST(count(*) AS BIGINT) AS jobs, CAST(count(*) FILTER (WHERE status = 'running') AS BIGINT) AS running, "
    "CAST(coalesce(sum(pages_scraped), 0) AS BIGINT) AS pages_scraped, CAST(coalesce(sum(pages_failed), 0) AS BIGINT) AS pages_failed "
    "FROM (SELECT * FROM v_jobs ORDER BY created_at DESC, job_id DESC LIMIT 50)"), views=["v_jobs"])
def q_dashboard_metrics(spark, d):
    return A.dashboard_metrics(A.newest_first(V.v_jobs(spark, d), "created_at", "job_id", 50))


@register("volume_scaled", sql=(
    "SELECT date, count, CASE WHEN mx > 0 THEN round(count * 100.0 / mx, 2) ELSE 0.0 END AS height_pct FROM ("
    "SELECT date, count, max(count) OVER () AS mx, row_number() OVER (ORDER BY date DESC) AS rn FROM ("
    "SELECT CAST(created_at AS DATE) AS date, CAST(count(*) AS BIGINT) AS count FROM v_results GROUP BY 1)) WHERE rn <= 14"),
    views=["v_results"])
def q_volume_scaled(spark, d):
    r = V.v_results(spark, d)
    vol = r.groupBy(F.to_date("created_at").alias("date")).agg(F.count(F.lit(1)).cast("bigint").alias("count"))
    return A.volume_scaled(vol, 14)


@register("latest_status", sql=(
    "SELECT job_id, arg_max(level, (created_at, log_id)) AS status FROM v_logs GROUP BY job_id"), views=["v_logs"])
def q_latest_status(spark, d):
    return A.latest_status(V.v_logs(spark, d).withColumnRenamed("level", "status"))


# ------------------------------------------------------------------ paging
@register("page_jobs", sql=(
    "SELECT * FROM v_jobs ORDER BY created_at DESC, job_id DESC LIMIT 500 OFFSET 20"), views=["v_jobs"])
def q_page_jobs(spark, d):
    return A.newest_first(V.v_jobs(spark, d), "created_at", "job_id", 500, 20)


@register("page_results", sql=(
    "SELECT * FROM v_results WHERE job_id = 7 ORDER BY created_at DESC, result_id DESC LIMIT 25 OFFSET 5"),
    views=["v_results"])
def q_page_results(spark, d):
    return A.newest_first(V.v_results(spark, d).where(F.col("job_id") == 7), "created_at", "result_id", 25, 5)


@register("page_logs", sql=(
    "SELECT * FROM v_logs WHERE job_id = 7 ORDER BY created_at ASC, log_id ASC LIMIT 1000"), views=["v_logs"])
def q_page_logs(spark, d):
    return A.newest_first(V.v_logs(spark, d).where(F.col("job_id") == 7), "created_at", "log_id", 1000, ascending=True)
