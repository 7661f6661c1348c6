"""Queries: URL functions (U1-U5), rule predicates (F4-F13), links (H23, A14,
G1, J8) and the flagship links-per-host report."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..config import DOC_BLOCKED_DOMAINS, DOC_SKIP_EXTENSIONS, EngineConfig
from ..functions import html as H
from ..functions import rules as R
from ..functions import urls as U
from ..operators import links as L
from ..sources.tables import read_table
from .registry import register

# Flagship configuration: the documented block list and skip list.
FLAG_CFG = EngineConfig(blocked_domains=tuple(DOC_BLOCKED_DOMAINS),
                        skip_extensions=tuple(DOC_SKIP_EXTENSIONS))

# Fixture rule sets applied to real page URLs (one per rule type).
RULE_CONTAINS = {"type": "contains", "pattern": "Blog."}
RULE_STARTS = {"type": "starts_with", "pattern": "https://www."}
RULE_ENDS = {"type": "ends_with", "pattern": ".html"}
RULE_REGEX = {"type": "regex", "pattern": r"/(en|fr)/[0-9]+\?page="}
RULE_DOMAIN = {"type": "domain", "pattern": "example.org"}
RULES_ANY = [{"type": "contains", "pattern": "utm_source"}, {"type": "", "pattern": "x"},
             {"type": "domain", "pattern": "example.net"}, {"type": "bogus", "pattern": "a"},
             {"type": "regex", "pattern": "(unclosed"}]

# Raw hrefs of every page, DuckDB side.
SQL_RAW_HREFS = (f"SELECT page_id, url, CAST(p - 1 AS BIGINT) AS pos, href FROM ("
                 f"SELECT page_id, url, unnest(h) AS href, generate_subscripts(h, 1) AS p FROM ("
                 f"SELECT page_id, url, {H.sql_hrefs(H.sql_strip_raw_text('html'))} AS h FROM pages))")


def raw_hrefs(spark, d):
    p = read_table(spark, d, "pages")
    return p.select("page_id", "url", F.posexplode_outer(H.hrefs(H.strip_raw_text("html"))).alias("pos", "href")) \
            .where(F.col("href").isNotNull()).withColumn("pos", F.col("pos").cast("bigint"))


def _links_sql(cfg: EngineConfig, rules=None) -> str:
    n = U.sql_normalize("href", "url")
    cond = (f"link IS NOT NULL AND NOT {R.sql_blocked('link', cfg.blocked_domains)} "
            f"AND NOT {R.sql_skip_ext('link', cfg.skip_extensions)} AND {R.sql_rules_any('link', rules)}")
    return (f"SELECT page_id, url, CAST(row_number() OVER (PARTITION BY page_id ORDER BY p) - 1 AS BIGINT) AS pos, link "
            f"FROM (SELECT page_id, url, link, min(pos) AS p FROM (SELECT page_id, url, pos, {n} AS link "
            f"FROM ({SQL_RAW_HREFS})) WHERE {cond} GROUP BY page_id, url, link)")


@register("links_per_host", sql=(
    f"SELECT {U.sql_domain('link')} AS host, CAST(count(DISTINCT link) AS BIGINT) AS n_links, "
    f"CAST(count(*) AS BIGINT) AS n_refs FROM ({_links_sql(FLAG_CFG)}) GROUP BY 1"))
def q_links_per_host(spark, d):
    return L.links_per_host(read_table(spark, d, "pages"), FLAG_CFG)


# every other page's url, with path parameters in two segments
SQL_PARAM_URL = ("CASE WHEN page_id % 2 = 0 THEN regexp_replace(url, '[?#].*$', '') || '/doc;v=' || page_id || ';w/x.pdf;jsession=' || page_id || ';y?q=1#f' "
                 "ELSE url END")


def param_urls(spark, d):
    more = F.concat(F.regexp_replace("url", "[?#].*$", ""), F.lit("/doc;v="), F.col("page_id").cast("string"), F.lit(";w/x.pdf;jsession="),
                    F.col("page_id").cast("string"), F.lit(";y?q=1#f"))
    return read_table(spark, d, "pages").select("page_id", F.when(F.col("page_id") % 2 == 0, more).otherwise(F.col("url")).alias("url"))


@register("url_parse", sql=(
    f"SELECT page_id, lower({U.sql_part('url', 2)}) AS scheme, {U.sql_part('url', 4)} AS netloc, "
    f"regexp_replace({U.sql_part('url', 5)}, '{U.PARAMS_RE}', '') AS path, regexp_extract({U.sql_part('url', 5)}, '{U.PARAMS_RE}', 1) AS params, "
    f"{U.sql_part('url', 7)} AS query, {U.sql_part('url', 9)} AS fragment FROM (SELECT page_id, {SQL_PARAM_URL} AS url FROM pages)"))
def q_url_parse(spark, d):
    p = param_urls(spark, d).select("page_id", U.url_parse("url").alias("u"))
    return p.select("page_id", "u.scheme", "u.netloc", U.without_params("u.path").alias("path"), U.path_params("u.path").alias("params"),
                    "u.query", "u.fragment")


@register("url_join", sql=f"SELECT page_id, pos, href, {U.sql_join('href', 'url')} AS joined FROM ({SQL_RAW_HREFS})")
def q_url_join(spark, d):
    return U.add_url_join(raw_hrefs(spark, d), "url", "href", "joined").select("page_id", "pos", "href", "joined")


@register("url_normalize", sql=(
    f"SELECT page_id, pos, href, {U.sql_normalize('href', 'url')} AS normalized FROM ({SQL_RAW_HREFS}) "
    f"UNION ALL SELECT page_id, -1 AS pos, url AS href, {U.sql_normalize('url', 'url')} AS normalized FROM pages"))
def q_url_normalize(spark, d):
    h = U.add_url_join(raw_hrefs(spark, d), "url", "href", "normalized", normalize=True)
    own = U.add_url_join(read_table(spark, d, "pages").select(
        "page_id", F.lit(-1).cast("bigint").alias("pos"), "url", F.col("url").alias("href")),
        "url", "href", "normalized", normalize=True)
    cols = ["page_id", "pos", "href", "normalized"]
    return h.select(cols).unionByName(own.select(cols))


@register("url_domain", sql=(
    f"SELECT page_id, {U.sql_domain('url')} AS domain, "
    f"array_to_string(list_filter(regexp_split_to_array({U.sql_domain('url')}, '[.\\-]'), lambda s: s <> ''), '|') AS parts, "
    f"{U.sql_domain('url')} AS session_domain, lower(split_part(split_part(regexp_replace(url, '^https?://', ''), '/', 1), ':', 1)) AS bare_domain "
    f"FROM pages"))
def q_url_domain(spark, d):
    p = read_table(spark, d, "pages")
    dom = U.url_domain("url")
    return p.select("page_id", dom.alias("domain"), F.array_join(U.domain_parts(dom), "|").alias("parts"),
                    U.session_domain("url").alias("session_domain"), U.session_domain(F.regexp_replace("url", "^https?://", "")).alias("bare_domain"))


def _rule_query(key, rule_list):
    @register(key, sql=f"SELECT page_id, url FROM pages WHERE {R.sql_rules_any('url', rule_list)}")
    def q(spark, d):
        return read_table(spark, d, "pages").where(R.rules_any("url", rule_list)).select("page_id", "url")
    return q


_rule_query("url_rule_contains", [RULE_CONTAINS])
_rule_query("url_rule_starts_with", [RULE_STARTS])
_rule_query("url_rule_ends_with", [RULE_ENDS])
_rule_query("url_rule_regex", [RULE_REGEX])
_rule_query("url_rule_domain", [RULE_DOMAIN])
_rule_query("url_rules_any", RULES_ANY)


@register("blocked_domain", sql=(
    f"SELECT page_id, url FROM pages WHERE {R.sql_blocked('url', ['example.com', 'tiontion.example.net'])}"))
def q_blocked(spark, d):
    return read_table(spark, d, "pages").where(
        R.blocked_domain("url", ["example.com", "tiontion.example.net"])).select("page_id", "url")


# The table form: every seventh page's own host is blocked, beside a domain for every customer that no link has.
SQL_BLOCKED_T = (f"SELECT DISTINCT {U.sql_domain('url')} AS domain FROM pages WHERE page_id % 7 = 0 UNION ALL SELECT 'c' || c_custkey || '.example.org' FROM customer")


@register("blocked_domain_table", sql=(
    f"WITH l AS (SELECT page_id, pos, link, {U.sql_domain('link')} AS host FROM ({_links_sql(EngineConfig())})), b AS ({SQL_BLOCKED_T}), "
    "bad AS (SELECT DISTINCT host FROM (SELECT DISTINCT host FROM l) h JOIN b ON h.host = b.domain OR ends_with(h.host, '.' || b.domain)) "
    "SELECT page_id, pos, link FROM l WHERE host NOT IN (SELECT host FROM bad)"))
def q_blocked_table(spark, d):
    own = read_table(spark, d, "pages").where("page_id % 7 = 0").select(U.url_domain("url").alias("domain"))
    more = read_table(spark, d, "customer").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string"), F.lit(".example.org")).alias("domain"))
    links = L.extract_links(read_table(spark, d, "pages")).select("page_id", "pos", "link")
    return L.blocked_by_table(links, own.unionByName(more))


@register("skip_extension", sql=f"SELECT page_id, url FROM pages WHERE {R.sql_skip_ext('url', ['.html', '.pdf'])}")
def q_skip(spark, d):
    return read_table(spark, d, "pages").where(R.skip_extension("url", [".html", ".pdf"])).select("page_id", "url")


@register("valid_url", sql=(
    f"SELECT page_id, pos, href, ({U.sql_part(U.sql_join('href', 'url'), 2)} <> '' AND "
    f"{U.sql_part(U.sql_join('href', 'url'), 4)} <> '') AS is_valid FROM ({SQL_RAW_HREFS})"))
def q_valid(spark, d):
    j = U.add_url_join(raw_hrefs(spark, d), "url", "href", "joined")
    return j.select("page_id", "pos", "href", R.valid_url("joined").alias("is_valid"))


@register("same_domain", sql=(
    f"SELECT page_id, pos, link, ({U.sql_domain('link')} = {U.sql_domain('url')}) AS same FROM ({_links_sql(EngineConfig())})"))
def q_same_domain(spark, d):
    l = L.extract_links(read_table(spark, d, "pages"))
    return l.select("page_id", "pos", "link", R.same_domain("link", "url").alias("same"))


@register("extract_links", sql=_links_sql(FLAG_CFG))
def q_extract_links(spark, d):
    return L.extract_links(read_table(spark, d, "pages"), cfg=FLAG_CFG)


@register("link_counts", sql=(
    f"SELECT page_id, CAST(len({H.sql_hrefs(H.sql_strip_raw_text('html'))}) AS BIGINT) AS raw_count, "
    f"CAST(coalesce(k.n, 0) AS BIGINT) AS kept_count FROM pages LEFT JOIN "
    f"(SELECT page_id AS pid, count(*) AS n FROM ({_links_sql(FLAG_CFG)}) GROUP BY 1) k ON k.pid = pages.page_id"))
def q_link_counts(spark, d):
    return L.link_counts(read_table(spark, d, "pages"), cfg=FLAG_CFG)


@register("link_graph", sql=(
    f"SELECT DISTINCT {U.sql_normalize('url', 'url')} AS src_url, link AS dst_url FROM ({_links_sql(EngineConfig())})"))
def q_link_graph(spark, d):
    return L.link_graph(read_table(spark, d, "pages"))


# ---- J8: rules held in a table, matched per job ------------------------------
def _rules_table(spark, d):
    """Per-page (job) rules derived from the page id: three rule sets and no
    rules at all for every fourth page."""
    p = read_table(spark, d, "pages").select(F.col("page_id").alias("job_id"))
    k = F.col("job_id") % 4
    rules = (F.when(k == 0, F.array(F.struct(F.lit("contains").alias("type"), F.lit("/the").alias("pattern"))))
             .when(k == 1, F.array(F.struct(F.lit("domain").alias("type"), F.lit("example.net").alias("pattern")),
                                   F.struct(F.lit("regex").alias("type"), F.lit("^https://blog").alias("pattern"))))
             .when(k == 2, F.array(F.struct(F.lit("ENDS_WITH").alias("type"), F.lit("s").alias("pattern")),
                                   F.struct(F.lit("regex").alias("type"), F.lit("(bad").alias("pattern")))))
    return p.select("job_id", F.explode_outer(rules).alias("r")).where(F.col("r").isNotNull()).select("job_id", "r.type", "r.pattern")


SQL_RULES_T = ("SELECT job_id, r.type AS type, r.pattern AS pattern FROM (SELECT page_id AS job_id, unnest(CASE page_id % 4 "
               "WHEN 0 THEN [{'type': 'contains', 'pattern': '/the'}] WHEN 1 THEN [{'type': 'domain', 'pattern': 'example.net'}, "
               "{'type': 'regex', 'pattern': '^https://blog'}] WHEN 2 THEN [{'type': 'ENDS_WITH', 'pattern': 's'}, "
               "{'type': 'regex', 'pattern': '(bad'}] END) AS r FROM pages)")


@register("theta_rule_match", sql=(
    f"WITH l AS (SELECT page_id AS job_id, link FROM ({_links_sql(EngineConfig())})), rt AS ({SQL_RULES_T}) "
    f"SELECT job_id, link FROM l WHERE job_id NOT IN (SELECT job_id FROM rt) OR EXISTS (SELECT 1 FROM rt WHERE rt.job_id = l.job_id AND ("
    f"(lower(rt.type) = 'contains' AND contains(lower(l.link), lower(rt.pattern))) OR "
    f"(lower(rt.type) = 'starts_with' AND starts_with(lower(l.link), lower(rt.pattern))) OR "
    f"(lower(rt.type) = 'ends_with' AND ends_with(lower(l.link), lower(rt.pattern))) OR "
    f"(lower(rt.type) = 'domain' AND ({U.sql_domain('lower(l.link)')} = lower(rt.pattern) OR ends_with({U.sql_domain('lower(l.link)')}, '.' || lower(rt.pattern)))) OR "
    f"(lower(rt.type) = 'regex' AND rt.pattern <> '(bad' AND regexp_matches(lower(l.link), rt.pattern, 'i'))))"))
def q_theta_rule_match(spark, d):
    links = L.extract_links(read_table(spark, d, "pages")).select(F.col("page_id").alias("job_id"), "link")
    return L.match_rules_table(links, _rules_table(spark, d)).select("job_id", "link")
