"""Queries: crawl graph operators (G1 is in url_links), G2-G7 and L6.

Two graphs: the order-part graph of the line items (deep, grows with the
data) and the link graph of the fetched pages (rules, same-host and category
crawls; page links point to unfetched paths, so depth stops at 1)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..config import DEFAULT
from ..functions import rules as R
from ..functions.urls import add_url_join, url_domain
from ..operators import crawl as G
from ..operators import links as L
from ..sources.tables import read_table
from .registry import register
from .windows import row_barrier
from .url_links import _links_sql
from ..config import EngineConfig
from ..functions.urls import sql_domain, sql_normalize

DEEP_MAX_DEPTH = DEFAULT.max_crawl_depth
PAGE_MAX_DEPTH = DEFAULT.max_crawl_depth
CAP = DEFAULT.max_pages_per_job
RULES = [{"type": "contains", "pattern": "/the"}, {"type": "regex", "pattern": r"/[a-z]{2}$"}]
CATEGORY_PATTERNS = [{"type": "domain", "pattern": "example.com"}]


def part_graph(spark, d):
    """Bipartite order <-> part graph, nodes named 'o<key>' / 'p<key>'. Lines are made distinct by their keys, before each
    becomes two edges."""
    li = read_table(spark, d, "lineitem").select("l_orderkey", "l_partkey").distinct()
    o = F.concat(F.lit("o"), F.col("l_orderkey").cast("string"))
    p = F.concat(F.lit("p"), F.col("l_partkey").cast("string"))
    return li.select(o.alias("src"), p.alias("dst")).unionByName(li.select(p.alias("src"), o.alias("dst")))


def deep_seeds(spark, d):
    """One job per order status, seeded at its smallest order."""
    o = read_table(spark, d, "orders")
    return o.groupBy("o_orderstatus").agg(F.min("o_orderkey").alias("k")).select(
        F.col("o_orderstatus").alias("job_id"), F.concat(F.lit("o"), F.col("k").cast("string")).alias("url"))


SQL_GRAPH = ("SELECT DISTINCT src, dst FROM (SELECT 'o' || CAST(l_orderkey AS VARCHAR) AS src, 'p' || CAST(l_partkey AS VARCHAR) AS dst "
             "FROM lineitem UNION ALL SELECT 'p' || CAST(l_partkey AS VARCHAR), 'o' || CAST(l_orderkey AS VARCHAR) FROM lineitem)")
SQL_SEEDS = "SELECT o_orderstatus AS job_id, 'o' || CAST(min(o_orderkey) AS VARCHAR) AS url FROM orders GROUP BY 1"
# every (job, page) once, at the depth where it is first reached
SQL_SEEN = (f"WITH RECURSIVE g AS MATERIALIZED ({SQL_GRAPH}), r(job_id, url, depth) USING KEY (job_id, url) AS (SELECT job_id, url, 0 FROM ({SQL_SEEDS}) "
            f"UNION SELECT r.job_id, g.dst, min(r.depth) + 1 FROM r JOIN g ON g.src = r.url LEFT JOIN recurring.r AS s "
            f"ON s.job_id = r.job_id AND s.url = g.dst WHERE s.url IS NULL AND r.depth <= {DEEP_MAX_DEPTH} GROUP BY r.job_id, g.dst) "
            f"SELECT job_id, url, CAST(depth AS INTEGER) AS depth FROM r")


def deep_seen(spark, d):
    return G.crawl(part_graph(spark, d), deep_seeds(spark, d), DEEP_MAX_DEPTH)


@register("crawl_reach", sql=f"SELECT * FROM ({SQL_SEEN}) WHERE depth <= {DEEP_MAX_DEPTH}")
def q_crawl_reach(spark, d):
    return G.crawl_reach(deep_seen(spark, d), DEEP_MAX_DEPTH)


@register("crawl_discovered", sql=f"SELECT job_id, CAST(count(*) AS BIGINT) AS discovered FROM ({SQL_SEEN}) GROUP BY job_id")
def q_crawl_discovered(spark, d):
    return G.crawl_discovered(deep_seen(spark, d))


@register("frontier_cap", sql=(f"SELECT job_id, url, depth FROM (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY depth, url) "
                               f"AS rn FROM ({SQL_SEEN}) WHERE depth <= {DEEP_MAX_DEPTH}) WHERE rn <= {CAP}"))
def q_frontier_cap(spark, d):
    return G.frontier_cap(G.crawl_reach(deep_seen(spark, d), DEEP_MAX_DEPTH), CAP)


# ---- page link graph --------------------------------------------------------
def page_graph(spark, d):
    return L.link_graph(read_table(spark, d, "pages")).select(F.col("src_url").alias("src"), F.col("dst_url").alias("dst"))


def page_seeds(spark, d):
    p = read_table(spark, d, "pages").select(F.col("page_id").alias("job_id"), "url", F.col("url").alias("href"))
    n = row_barrier(add_url_join(p, "url", "href", "norm", normalize=True).select("job_id", F.col("norm").alias("url")))
    return n.where(F.col("url").isNotNull())


SQL_PAGE_SEEDS = f"SELECT page_id AS job_id, {sql_normalize('url', 'url')} AS url FROM pages"
SQL_PAGE_EDGES = f"SELECT DISTINCT {sql_normalize('url', 'url')} AS src, link AS dst FROM ({_links_sql(EngineConfig())})"


def _sql_page_crawl(cond: str) -> str:
    return (f"SELECT job_id, url, 0 AS depth FROM ({SQL_PAGE_SEEDS}) WHERE url IS NOT NULL UNION "
            f"SELECT s.job_id, e.dst AS url, 1 AS depth FROM ({SQL_PAGE_SEEDS}) s JOIN ({SQL_PAGE_EDGES}) e ON e.src = s.url "
            f"WHERE e.dst <> s.url AND ({cond})")


@register("crawl_single", sql=f"SELECT job_id, url, 0 AS depth, CAST(1 AS BIGINT) AS discovered FROM ({SQL_PAGE_SEEDS}) WHERE url IS NOT NULL")
def q_crawl_single(spark, d):
    return G.crawl_single(page_seeds(spark, d))


@register("crawl_rule_based", sql=_sql_page_crawl(R.sql_rules_any("e.dst", RULES)))
def q_crawl_rule_based(spark, d):
    seen = G.crawl(page_graph(spark, d), page_seeds(spark, d), PAGE_MAX_DEPTH,
                   edge_filter=lambda c: c.where(R.rules_any("url", RULES)))
    return G.crawl_reach(seen, PAGE_MAX_DEPTH)


@register("crawl_infinite", sql=_sql_page_crawl(f"{sql_domain('e.dst')} = {sql_domain('s.url')}"))
def q_crawl_infinite(spark, d):
    seen = G.crawl(page_graph(spark, d), page_seeds(spark, d), PAGE_MAX_DEPTH,
                   edge_filter=lambda c: c.where(url_domain("url") == url_domain("start_url")))
    return G.crawl_reach(seen, PAGE_MAX_DEPTH)


@register("crawl_category", sql=_sql_page_crawl(R.sql_rules_any("e.dst", CATEGORY_PATTERNS)))
def q_crawl_category(spark, d):
    seen = G.crawl(page_graph(spark, d), page_seeds(spark, d), PAGE_MAX_DEPTH,
                   edge_filter=lambda c: c.where(R.rules_any("url", CATEGORY_PATTERNS)))
    return G.crawl_reach(seen, PAGE_MAX_DEPTH)
