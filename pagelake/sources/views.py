"""Fixture views: the application tables (jobs, logs, results, history, edges,
categories) derived from the driver's parquet tables, so every query's work
grows with the input.

Each view exists twice: as a DataFrame builder (what the library runs) and as
portable SQL text (``VIEW_SQL``) that the DuckDB oracle uses as a CTE.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import read_table


def v_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "pages").select(
        "page_id", "url", "html", F.lit(200).alias("http_status"))


def v_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jobs = orders; pages scraped/failed = their line items.

    Line items are aggregated per order *before* the join (partial + final
    hash aggregate), so the join sees one row per order on both sides.
    """
    o = read_table(spark, sf_dir, "orders")
    li = (read_table(spark, sf_dir, "lineitem")
          .groupBy("l_orderkey")
          .agg(F.count("l_linenumber").alias("n"),
               F.sum(F.when(F.col("l_returnflag") == "R", 1).otherwise(0)).alias("nf")))
    return (o.join(li, o.o_orderkey == li.l_orderkey, "left")
            .select(F.col("o_orderkey").alias("job_id"),
                    F.col("o_orderdate").alias("created_at"),
                    F.when(F.col("o_orderstatus") == "F", "completed")
                     .when(F.col("o_orderstatus") == "O", "running")
                     .otherwise("paused").alias("status"),
                    F.coalesce(F.col("n"), F.lit(0)).cast("bigint").alias("pages_scraped"),
                    F.coalesce(F.col("nf"), F.lit(0)).cast("bigint").alias("pages_failed")))


def v_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read_table(spark, sf_dir, "events")
    lvl = (F.when(F.col("event_type") == "error", "error")
           .when(F.col("event_type") == "signup", "warning")
           .when(F.col("event_type") == "purchase", "critical")
           .when(F.col("event_type") == "view", "debug")
           .otherwise("info"))
    return e.select(F.col("event_id").alias("log_id"), F.col("user_id").alias("job_id"),
                    lvl.alias("level"), F.col("props").alias("message"),
                    F.col("ts").alias("created_at"))


def v_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read_table(spark, sf_dir, "events")
    return e.select(
        F.col("event_id").alias("result_id"), F.col("user_id").alias("job_id"),
        F.concat(F.lit("https://site"), (F.col("user_id") % 40).cast("string"),
                 F.lit(".example.com/p")).alias("url"),
        F.when(F.col("event_type") == "error", 500).otherwise(200).alias("http_status"),
        F.col("event_type").alias("content_key"), F.col("ts").alias("created_at"))


def v_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Result history: documents as successive scrapes of their source URL.

    ``seq`` numbers the snapshots of one URL by doc_id. A source can hold a
    large share of all rows, so the numbering is the skew-safe distributed
    row number of ``plans.windows`` instead of one window per source.
    """
    from ..plans.windows import row_number_skew_safe
    d = read_table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("result_id"), F.col("source").alias("url"), "text")
    return row_number_skew_safe(d, ["url"], "result_id", "seq")


def v_edges_nation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deep fixture graph over nation keys: two out-edges per node."""
    n = read_table(spark, sf_dir, "nation")
    return (n.select(F.col("n_nationkey").alias("src"),
                     F.explode(F.array(F.lit(1), F.lit(2))).alias("k"))
            .select("src", ((F.col("src") * 2 + F.col("k")) % 25).alias("dst")))


def v_category_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored categories: one per part (name unique), keywords = name words."""
    p = read_table(spark, sf_dir, "part")
    return p.select(F.col("p_partkey").alias("category_id"),
                    F.concat(F.col("p_name"), F.lit(" #"), F.col("p_partkey").cast("string")).alias("name"),
                    F.col("p_type").alias("description"),
                    F.split(F.col("p_name"), " ").alias("keywords"),
                    (F.col("p_size") % 4 != 0).alias("is_active"))


# --------------------------------------------------------------------------
# FIXED VALUES -- syllables, function words and languages of the documents, from which the stored categories take keywords and patterns.
# --------------------------------------------------------------------------
SYLLABLES = "th er on in an re nd ti es en ou or st it ha he ed nt ing ea la de ai el ie".split()
SMALL_WORDS = "the of and to in a is that for it de la en que le der die und des les".split()
LANGS = "en fr es de".split()
# --------------------------------------------------------------------------


def v_rule_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored categories with keywords of two and three syllables, phrases, repeated and upper-case ones, and URL patterns
    of every type, blank and unknown ones included."""
    i = F.col("category_id")

    def of(values: list[str], at):
        return F.element_at(F.array(*map(F.lit, values)), (at % len(values) + 1).cast("int"))

    two = F.concat(of(SYLLABLES, i), of(SYLLABLES, F.floor(i / 25)))
    three = F.concat(of(SYLLABLES, i * 7), of(SYLLABLES, F.floor(i / 5)), of(SYLLABLES, F.floor(i / 3)))
    phrase = F.concat(of(SMALL_WORDS, i), F.lit(" "), two)
    start = F.concat(of(SMALL_WORDS, i), F.lit(" "), of(SYLLABLES, i))
    none = F.array().cast("array<string>")
    keywords = F.concat(F.when(i % 3 == 0, F.concat(F.array(two, three), "keywords")).when(i % 3 == 1, F.array(three, phrase)).otherwise(F.array(two, F.upper(three), start)),
                        F.when(i % 41 == 0, F.array(of(SYLLABLES, i))).otherwise(none), F.when(i % 90 == 0, F.array(two)).otherwise(none))
    lang, n = of(LANGS, i), (lambda m: (i % m).cast("string"))
    pattern = F.when(i % 7 == 0, F.concat(F.lit("/"), lang, F.lit("/"), n(97))).when(i % 7 == 1, F.concat(F.lit("https://src"), n(20), F.lit("."), F.upper(lang))) \
        .when(i % 7 == 2, F.concat(F.lit("/"), n(500))).when(i % 7 == 3, F.concat(F.lit("src"), n(20), F.lit("."), lang, F.lit(".example.com"))) \
        .when(i % 7 == 4, F.concat(F.lit("/"), lang, F.lit("/[0-9]*"), n(50), F.lit("$"))).when(i % 7 == 5, F.lit("")).otherwise(F.lit("x"))
    kind = of(["contains", "Starts_With", "ends_with", "domain", "regex", "contains", "like"], i)
    return v_category_table(spark, sf_dir).select("category_id", "name", "is_active", keywords.alias("keywords"), F.array(F.struct(kind.alias("type"), pattern.alias("pattern"))).alias("url_patterns"))


def _sql_of(values: list[str], at: str) -> str:
    return f"([{', '.join(repr(v) for v in values)}])[CAST({at} AS BIGINT) % {len(values)} + 1]"


def _sql_rule_categories() -> str:
    syl = lambda at: _sql_of(SYLLABLES, at)
    two, three = f"{syl('i')} || {syl('i // 25')}", f"{syl('i * 7')} || {syl('i // 5')} || {syl('i // 3')}"
    lang, word = _sql_of(LANGS, "i"), _sql_of(SMALL_WORDS, "i")
    kind = _sql_of(["contains", "Starts_With", "ends_with", "domain", "regex", "contains", "like"], "i")
    return (f"SELECT i AS category_id, name, is_active, list_concat(list_concat(CASE i % 3 WHEN 0 THEN list_concat([{two}, {three}], keywords) WHEN 1 THEN [{three}, {word} || ' ' || {two}] "
            f"ELSE [{two}, upper({three}), {word} || ' ' || {syl('i')}] END, CASE WHEN i % 41 = 0 THEN [{syl('i')}] ELSE []::VARCHAR[] END), CASE WHEN i % 90 = 0 THEN [{two}] ELSE []::VARCHAR[] END) AS keywords, "
            f"[{{'type': {kind}, 'pattern': CASE i % 7 WHEN 0 THEN '/' || {lang} || '/' || (i % 97) WHEN 1 THEN 'https://src' || (i % 20) || '.' || upper({lang}) WHEN 2 THEN '/' || (i % 500) "
            f"WHEN 3 THEN 'src' || (i % 20) || '.' || {lang} || '.example.com' WHEN 4 THEN '/' || {lang} || '/[0-9]*' || (i % 50) || '$' WHEN 5 THEN '' ELSE 'x' END}}] AS url_patterns "
            "FROM (SELECT p_partkey AS i, p_name || ' #' || CAST(p_partkey AS VARCHAR) AS name, string_split(p_name, ' ') AS keywords, (p_size % 4 <> 0) AS is_active FROM part)")


def v_result_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Result -> category bridge (M:N): orders' parts."""
    li = read_table(spark, sf_dir, "lineitem")
    return li.select(F.col("l_orderkey").alias("result_id"), F.col("l_partkey").alias("category_id")).distinct()


# Portable SQL of the same views, used by the DuckDB oracle as CTEs.
VIEW_SQL = {
    "v_pages": "SELECT page_id, url, html, 200 AS http_status FROM pages",
    "v_jobs": ("SELECT o.o_orderkey AS job_id, o.o_orderdate AS created_at, "
               "CASE o.o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'running' ELSE 'paused' END AS status, "
               "CAST(COUNT(l.l_linenumber) AS BIGINT) AS pages_scraped, "
               "CAST(COALESCE(SUM(CASE WHEN l.l_returnflag = 'R' THEN 1 ELSE 0 END), 0) AS BIGINT) AS pages_failed "
               "FROM orders o LEFT JOIN lineitem l ON l.l_orderkey = o.o_orderkey "
               "GROUP BY o.o_orderkey, o.o_orderdate, o.o_orderstatus"),
    "v_logs": ("SELECT event_id AS log_id, user_id AS job_id, CASE event_type WHEN 'error' THEN 'error' "
               "WHEN 'signup' THEN 'warning' WHEN 'purchase' THEN 'critical' WHEN 'view' THEN 'debug' "
               "ELSE 'info' END AS level, props AS message, ts AS created_at FROM events"),
    "v_results": ("SELECT event_id AS result_id, user_id AS job_id, CONCAT('https://site', "
                  "CAST(user_id % 40 AS VARCHAR), '.example.com/p') AS url, "
                  "CASE WHEN event_type = 'error' THEN 500 ELSE 200 END AS http_status, "
                  "event_type AS content_key, ts AS created_at FROM events"),
    "v_history": ("SELECT doc_id AS result_id, source AS url, text, "
                  "CAST(ROW_NUMBER() OVER (PARTITION BY source ORDER BY doc_id) AS BIGINT) AS seq FROM documents"),
    "v_category_table": ("SELECT p_partkey AS category_id, p_name || ' #' || CAST(p_partkey AS VARCHAR) AS name, "
                         "p_type AS description, string_split(p_name, ' ') AS keywords, (p_size % 4 <> 0) AS is_active FROM part"),
    "v_rule_categories": _sql_rule_categories(),
    "v_result_categories": "SELECT DISTINCT l_orderkey AS result_id, l_partkey AS category_id FROM lineitem",
    "v_edges_nation": ("SELECT n_nationkey AS src, (n_nationkey * 2 + k.k) % 25 AS dst FROM nation "
                       "CROSS JOIN (SELECT 1 AS k UNION ALL SELECT 2) k"),
}


def with_views(sql: str, *names: str) -> str:
    """Prefix ``sql`` with the named views as CTEs."""
    ctes = ", ".join(f"{n} AS ({VIEW_SQL[n]})" for n in names)
    return f"WITH {ctes} {sql}" if names else sql
