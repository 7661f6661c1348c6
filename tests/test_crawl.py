"""The crawl against a breadth-first search in Python, with small and large frontiers."""
import random

import pytest

from pagelake.operators import crawl as G
from pagelake.plans import crawl_q


@pytest.mark.parametrize("most", [1_000_000, 0])
def test_levels(spark, most, monkeypatch):
    monkeypatch.setattr(G, "BROADCAST_FRONTIER", most)
    rng = random.Random(4)
    edges = [(f"n{rng.randint(0, 60)}", f"n{rng.randint(0, 60)}") for _ in range(90)] + [(None, "n1"), ("n1", None), (None, None)] * 2
    seeds = [("a", "n1"), ("a", "n1"), ("b", "n2"), ("b", "n3"), ("c", "nowhere")]
    got = G.crawl(spark.createDataFrame(edges, "src string, dst string"), spark.createDataFrame(seeds, "job_id string, url string"), 3).collect()
    want = {}
    for job in "abc":
        seen = {u: 0 for j, u in seeds if j == job}
        for depth in range(1, 5):
            for v in {v for u, v in edges if u is not None and u in seen and seen[u] == depth - 1}:
                seen.setdefault(v, depth)
        want |= {(job, u): n for u, n in seen.items() if u is not None}
    rows = [((r.job_id, r.url), r.depth) for r in got if r.url is not None]
    assert dict(rows) == want and len(rows) == len(want)


def test_lines_are_distinct_before_they_become_edges(spark, sf):
    plan = crawl_q.part_graph(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(l_orderkey" in plan and "hashpartitioning(src" not in plan
