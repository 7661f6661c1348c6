"""Link extraction (H23), link counts (A14), link graph (G1), rule join.

Design: each page's links are resolved, filtered and de-duplicated *inside its
own row* (array HOFs), then exploded. That is narrow work -- no shuffle, no
per-page group to skew -- and the only shuffle left is the anti join against
the seen-set, which is keyed by the link itself.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT, EngineConfig
from ..functions.html import hrefs, strip_raw_text
from ..functions.rules import blocked_domain, rule_predicate, rules_any, skip_extension, valid_url
from ..functions.urls import add_url_join, normalize_array, url_domain
from .patterns import dot_suffixes, match_patterns, salted_join


def kept_links(html, base, rules=None, cfg: EngineConfig = DEFAULT):
    """Array of normalised, valid, unblocked, unskipped, rule-matching links in
    first-occurrence order."""
    norm = normalize_array(hrefs(strip_raw_text(html)), F.col(base) if isinstance(base, str) else base)
    keep = F.filter(norm, lambda u: u.isNotNull() & valid_url(u)
                    & ~blocked_domain(u, cfg.blocked_domains)
                    & ~skip_extension(u, cfg.skip_extensions)
                    & rules_any(u, rules))
    return F.array_distinct(keep)


def extract_links(pages: DataFrame, rules: list[dict] | None = None,
                  seen: DataFrame | None = None, cfg: EngineConfig = DEFAULT) -> DataFrame:
    """(page_id, url, pos, link) -- pos is the first-occurrence order.

    ``seen`` (a column ``link``) drops already known URLs; positions are
    counted before that anti join, as the seen test happens per link."""
    # posexplode_outer: no inferred size(links) > 0 filter evaluating the link
    # pipeline a second time below the projection
    out = pages.select("page_id", "url", F.posexplode_outer(kept_links("html", "url", rules, cfg)).alias("pos", "link")) \
        .where(F.col("link").isNotNull())
    if seen is not None:
        out = out.join(seen.select("link").distinct(), "link", "left_anti")
    return out.select("page_id", "url", F.col("pos").cast("bigint").alias("pos"), "link")


def link_counts(pages: DataFrame, rules=None, cfg: EngineConfig = DEFAULT) -> DataFrame:
    """Raw href count vs kept link count per page (per-row, no shuffle)."""
    return pages.select(
        "page_id",
        F.size(hrefs(strip_raw_text("html"))).cast("bigint").alias("raw_count"),
        F.size(kept_links("html", "url", rules, cfg)).cast("bigint").alias("kept_count"))


def links_per_host(pages: DataFrame, cfg: EngineConfig = DEFAULT) -> DataFrame:
    """Flagship: distinct outgoing links per link host after normalisation and
    blocking. Partial aggregation on (host, link) before the shuffle keeps hot
    hosts from concentrating raw rows."""
    links = extract_links(pages, cfg=cfg)
    return (links.select(url_domain("link").alias("host"), "link")
            .groupBy("host")
            .agg(F.countDistinct("link").cast("bigint").alias("n_links"),
                 F.count(F.lit(1)).cast("bigint").alias("n_refs")))


def link_graph(pages: DataFrame, cfg: EngineConfig = DEFAULT) -> DataFrame:
    """G1: distinct (src_url, dst_url) edges; the source is the page's own
    normalised URL."""
    from ..plans.windows import row_barrier
    l = add_url_join(extract_links(pages, cfg=cfg), "url", "url", "src_url", normalize=True)
    # barrier: the NOT NULL test must not be pushed (with the normalisation
    # substituted into it) below the staged projections
    return (row_barrier(l.select("src_url", F.col("link").alias("dst_url")))
            .where(F.col("src_url").isNotNull())
            .distinct())


def match_rules_table(links: DataFrame, rules: DataFrame) -> DataFrame:
    """Links (job_id, link) kept when any of *their job's* rules (a table
    ``job_id, type, pattern``) matches; jobs without rules keep everything.

    Links and rules meet through the literal index of ``operators.patterns``;
    a job's links are dealt over many tasks, however many it has."""
    named = rules.select("job_id", F.col("pattern").alias("pid"), "type", "pattern").distinct()
    hits = match_patterns(links.select("job_id", F.col("link").alias("s")), named, ("job_id",))
    hits = hits.select("job_id", F.col("s").alias("link")).distinct()
    matched = links.join(hits, ["job_id", "link"], "left_semi")
    no_rules = salted_join(links, rules.select("job_id").distinct(), ["job_id"], F.col("link"), how="left_anti")
    return matched.unionByName(no_rules)


def blocked_by_table(links: DataFrame, blocked: DataFrame, url: str = "link") -> DataFrame:
    """F10 with the blocked domains in a table (``domain``): links whose host is
    neither one of them nor below one. Only distinct hosts are expanded into
    their dot suffixes and compared; the links then meet the few hosts that are
    blocked, each hot host dealt over many tasks. A null link stays."""
    domains = blocked.where(F.length("domain") > 0).select(F.col("domain").alias("suffix")).distinct()
    hosts = links.where(F.col(url).isNotNull()).select(url_domain(url).alias("host")).distinct()
    tails = hosts.select("host", F.explode(dot_suffixes(F.col("host"))).alias("suffix"))
    bad = salted_join(tails, domains, ["suffix"], F.col("host"), how="left_semi").select("host").distinct()
    return salted_join(links.withColumn("host", url_domain(url)), bad, ["host"], F.col(url), how="left_anti").drop("host")


__all__ = ["extract_links", "link_counts", "links_per_host", "link_graph",
           "match_rules_table", "blocked_by_table", "kept_links", "rule_predicate"]
