"""Queries: exports and appends (K1-K7), total content bytes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..config import DEFAULT as CFG
from ..functions.html import sql_pystrip as STRIP
from ..functions.jsonx import content_hash, content_length, sql_content_hash, sql_content_length
from ..operators import detectors as D
from ..operators import export as K
from ..operators import versions as X
from ..sources.tables import read_table
from .detectors_q import FETCH_ERR, FETCH_SQL, WALL_SQL, walls
from .registry import register

EXPORT_CAP = CFG.export_cap


def results(spark, d):
    """Stored results: documents as successful scrapes of their source URL,
    content = paragraph blocks, created_at derived from the id."""
    t = read_table(spark, d, "documents")
    c = X.paragraph_blocks(F.col("text"))
    r = t.select(F.col("doc_id").alias("result_id"), F.col("source").alias("job_id"), F.col("source").alias("url"),
                 F.lit(200).alias("http_status"), F.concat(F.lit("Doc "), F.col("doc_id").cast("string")).alias("page_title"),
                 c.alias("content"), F.lit(None).cast("string").alias("error"),
                 (F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
                  + F.make_dt_interval(secs=(F.col("doc_id") * 37.5).cast("decimal(18,6)"))).alias("created_at"))
    return r.withColumn("content_length", content_length(F.col("content"))) \
            .withColumn("content_hash", content_hash(F.col("content")))


SQL_BLOCKS = (f"list_transform(list_filter(string_split(text, chr(10)), lambda x: {STRIP('x')} <> ''), "
              f"lambda x: {{'type': 'paragraph', 'content': x}})")
SQL_RESULTS = (f"SELECT doc_id AS result_id, source AS job_id, source AS url, 200 AS http_status, 'Doc ' || CAST(doc_id AS VARCHAR) "
               f"AS page_title, {SQL_BLOCKS} AS content, CAST(NULL AS VARCHAR) AS error, "
               f"make_timestamp(1704067200000000 + doc_id * 37500000) AS created_at FROM documents")
SQL_ISO = ("strftime(created_at, '%Y-%m-%dT%H:%M:%S') || CASE WHEN epoch_us(created_at) % 1000000 <> 0 THEN '.' || "
           "lpad(CAST(epoch_us(created_at) % 1000000 AS VARCHAR), 6, '0') ELSE '' END || '+00:00'")
SQL_CJSON = ("CASE WHEN coalesce(len(content), 0) > 0 THEN '[' || array_to_string(list_transform(content, lambda b: "
             "'{\"type\": ' || to_json(b.type) || ', \"content\": ' || to_json(b.content) || '}'), ', ') || ']' ELSE '' END")


def through_json(rows, name):
    """Write, and read what was written."""
    path = K.new_table(rows.sparkSession, name)
    K.write_json(rows, path)
    return K.read_json(rows.sparkSession, path, rows.schema)


def through_csv(rows, name):
    path = K.new_table(rows.sparkSession, name)
    K.write_csv(rows, path)
    return K.read_csv(rows.sparkSession, path, rows.schema)


@register("export_json", sql=(
    f"SELECT url, http_status, page_title, CASE WHEN coalesce(len(content), 0) > 0 THEN {SQL_CJSON} END AS content, "
    f"{sql_content_length('content')} AS content_length, {sql_content_hash('content')} AS content_hash, error, "
    f"{SQL_ISO} AS scraped_at FROM ({SQL_RESULTS})"))
def q_export_json(spark, d):
    return through_json(K.export_rows(results(spark, d)), "export-json")


@register("export_csv", sql=(
    f"SELECT url, CAST(http_status AS VARCHAR) AS http_status, coalesce(page_title, '') AS page_title, "
    f"CAST({sql_content_length('content')} AS VARCHAR) AS content_length, coalesce({sql_content_hash('content')}, '') AS content_hash, "
    f"coalesce(error, '') AS error, {SQL_ISO} AS scraped_at, {SQL_CJSON} AS content_blocks FROM ({SQL_RESULTS})"))
def q_export_csv(spark, d):
    return through_csv(K.csv_rows(results(spark, d)), "export-csv")


JOB = "src3"


@register("export_job_json", sql=(
    f"SELECT url, http_status, page_title, CASE WHEN coalesce(len(content), 0) > 0 THEN {SQL_CJSON} END AS content, "
    f"{sql_content_length('content')} AS content_length, error, {SQL_ISO} AS scraped_at FROM ({SQL_RESULTS}) "
    f"WHERE job_id = '{JOB}' ORDER BY created_at DESC, result_id DESC LIMIT {EXPORT_CAP}"))
def q_export_job_json(spark, d):
    return through_json(K.export_rows(K.newest(results(spark, d), JOB, EXPORT_CAP), with_hash=False), "export-job-json")


@register("export_job_csv", sql=(
    f"SELECT url, CAST(http_status AS VARCHAR) AS http_status, coalesce(page_title, '') AS page_title, "
    f"CAST({sql_content_length('content')} AS VARCHAR) AS content_length, coalesce(error, '') AS error, {SQL_ISO} AS scraped_at "
    f"FROM ({SQL_RESULTS}) WHERE job_id = '{JOB}' ORDER BY created_at DESC, result_id DESC LIMIT {EXPORT_CAP}"))
def q_export_job_csv(spark, d):
    return through_csv(K.csv_rows(K.newest(results(spark, d), JOB, EXPORT_CAP), with_hash=False, with_content=False), "export-job-csv")


# the blocks of a text take turns as heading, paragraph, code with and without a language, quote, and empty
@register("export_markdown", sql=(
    "SELECT result_id, array_to_string(list_filter(list_transform(content, lambda b, i: CASE (i - 1) % 6 WHEN 0 THEN repeat('#', (i - 1) % 4 + 1) || ' ' || b.content "
    "WHEN 2 THEN '```' || 'python' || chr(10) || b.content || chr(10) || '```' WHEN 3 THEN '```' || chr(10) || b.content || chr(10) || '```' "
    "WHEN 4 THEN '> ' || b.content WHEN 5 THEN NULL ELSE b.content END), lambda x: x IS NOT NULL), chr(10) || chr(10)) AS markdown "
    f"FROM ({SQL_RESULTS})"))
def q_export_markdown(spark, d):
    r = results(spark, d)
    kinds = F.array(*[F.lit(x) for x in ("heading", "paragraph", "code_block", "code_block", "blockquote", "paragraph")])
    typed = F.transform("content", lambda b, i: b.withField("type", F.element_at(kinds, (i % 6 + 1).cast("int"))).withField("level", (i % 4 + 1).cast("int"))
                        .withField("language", F.when(i % 6 == 2, F.lit("python"))).withField("content", F.when(i % 6 != 5, b["content"]).otherwise(F.lit(""))))
    return r.select("result_id", K.blocks_to_markdown(typed).alias("markdown"))


# every page's fetch as a stored result, two days of them by page id
SQL_STORED = (f"SELECT page_id, url, http_status, CASE WHEN outcome = 'success' THEN NULL ELSE err END AS error, outcome = 'success' AS success, "
              f"CASE WHEN outcome = 'success' THEN html END AS content, CAST(CASE WHEN outcome = 'success' THEN length(html) ELSE 0 END AS BIGINT) AS content_length "
              f"FROM (SELECT w.page_id, p.url, p.html, w.http_status, {FETCH_SQL} AS outcome, {FETCH_ERR} AS err FROM ({WALL_SQL}) w JOIN pages p ON p.page_id = w.page_id)")


@register("append_results", sql=(
    "SELECT page_id, url, http_status, error, success, md5(content) AS content_md5, content_length, "
    f"CAST(DATE '2024-01-01' + CAST(page_id % 2 AS INTEGER) AS DATE) AS day FROM ({SQL_STORED})"))
def q_append_results(spark, d):
    w = walls(spark, d)
    o = D.fetch_outcome("http_status", F.col("w"))
    ok = o["outcome"] == "success"
    fetched = w.select("page_id", "http_status", F.when(ok, F.lit(None)).otherwise(o["error"]).alias("error"), ok.alias("success"))
    body = read_table(spark, d, "pages").select("page_id", "url", "html")
    rows = fetched.join(body, "page_id").select(
        "page_id", "url", "http_status", "error", "success", F.when(F.col("success"), F.col("html")).alias("content"),
        F.when(F.col("success"), F.length("html")).otherwise(0).cast("bigint").alias("content_length"),
        F.date_add(F.lit("2024-01-01").cast("date"), (F.col("page_id") % 2).cast("int")).alias("created_at"))
    path = K.new_table(spark, "results")
    # two appends to one table
    K.append_results(rows.where("page_id % 2 = 0"), path)
    K.append_results(rows.where("page_id % 2 = 1"), path)
    got = K.read_results(spark, path, rows.schema)
    return got.select("page_id", "url", "http_status", "error", "success", F.md5("content").alias("content_md5"), "content_length",
                      F.col("created_at").alias("day"))


# labels of a page by its id: none, one, or two
SQL_LABELS = "CASE page_id % 3 WHEN 1 THEN ['Technology'] WHEN 2 THEN ['Science', 'Health'] ELSE CAST([] AS VARCHAR[]) END"


@register("append_log", sql=(
    f"WITH o AS (SELECT w.page_id, p.url, {SQL_LABELS.replace('page_id', 'w.page_id')} AS labels, {FETCH_SQL} AS outcome, {FETCH_ERR} AS err FROM ({WALL_SQL}) w JOIN pages p ON p.page_id = w.page_id) "
    f"SELECT page_id AS job_id, CASE WHEN outcome = 'success' THEN 'info' ELSE 'error' END AS level, CASE WHEN outcome = 'success' THEN "
    f"'Scraped successfully' || CASE WHEN len(labels) > 0 THEN ' → ' || array_to_string(labels, ', ') ELSE '' END "
    f"ELSE 'Failed: ' || coalesce(err, '?') END AS message, url AS source_url, 'scraper' AS component FROM o UNION ALL "
    f"SELECT page_id, 'info', 'Classified as: ' || array_to_string(labels, ', '), url, 'classifier' FROM o WHERE outcome = 'success' AND len(labels) > 0"))
def q_append_log(spark, d):
    w = walls(spark, d)
    o = D.fetch_outcome("http_status", F.col("w"))
    names = F.when(F.col("page_id") % 3 == 1, F.array(F.lit("Technology"))).when(F.col("page_id") % 3 == 2, F.array(F.lit("Science"), F.lit("Health")))
    urls = read_table(spark, d, "pages").select("page_id", "url")
    x = w.select("page_id", o["outcome"].alias("outcome"), o["error"].alias("error"), names.alias("labels")).join(urls, "page_id")
    logs = K.outcome_logs(x.withColumnRenamed("page_id", "job_id"))
    path = K.new_table(spark, "logs")
    logs.write.mode("append").parquet(path)
    return spark.read.schema(logs.schema).parquet(path).select("job_id", "level", "message", "source_url", "component")


@register("total_content_bytes", sql=(
    f"SELECT CAST(coalesce(sum({sql_content_length('content')}), 0) AS BIGINT) AS total_content_bytes FROM ({SQL_RESULTS})"))
def q_total_content_bytes(spark, d):
    return results(spark, d).agg(F.coalesce(F.sum("content_length"), F.lit(0)).cast("bigint").alias("total_content_bytes"))
