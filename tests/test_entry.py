"""Driver contract and a brute-force check of the BFS on a small graph."""
import __spark_entry__ as E
from pyspark.sql import functions as F

from pagelake.operators import crawl as G


def test_contract(spark):
    q, s = E.queries(), E.oracle_sql()
    assert set(s) <= set(q) and len(q) > 100
    df = E.entry(spark)
    assert df.columns == ["host", "n_links", "n_refs"] and df.count() > 0


def test_bfs_min_depth(spark):
    edges = [(0, 1), (1, 2), (0, 2), (2, 3), (3, 4), (4, 0), (5, 6)]
    e = spark.createDataFrame([(str(a), str(b)) for a, b in edges], "src string, dst string")
    seeds = spark.createDataFrame([("j", "0")], "job_id string, url string")
    seen = {r.url: r.depth for r in G.crawl(e, seeds, 2).collect()}
    # brute force BFS
    adj, depth, frontier = {}, {"0": 0}, ["0"]
    for a, b in edges:
        adj.setdefault(str(a), []).append(str(b))
    for d in range(3):
        nxt = []
        for u in frontier:
            for v in adj.get(u, []):
                if v not in depth:
                    depth[v] = d + 1
                    nxt.append(v)
        frontier = nxt
    assert seen == depth


def test_some_queries_run(spark, sf):
    for name in ["links_per_host", "wall_detect", "block_headings", "build_versions", "classify_pages", "stream_volume"]:
        assert E.queries()[name](spark, sf).count() >= 0
