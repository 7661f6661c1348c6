"""Rules and blocked domains held in tables, against the literal predicates and brute force."""
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from pagelake.functions import rules as R
from pagelake.operators import links as L
from pagelake.operators import patterns as P


def matches(kind, pattern, s):
    kind, low, p = (kind or "").strip().lower(), s.lower(), (pattern or "").lower()
    if not kind or not p:
        return False
    if kind == "regex":
        try:
            return bool(re.search(pattern, low, re.I | re.A))
        except re.error:
            return False
    host = re.sub(r"^[a-z][a-z0-9+.-]*://", "", low).split("/")[0].split("?")[0].split("#")[0].split("@")[-1].split(":")[0] if "//" in low else ""
    return {"contains": p in low, "starts_with": low.startswith(p), "ends_with": low.endswith(p), "domain": host == p or host.endswith("." + p)}.get(kind, False)


def urls(rng, n):
    return [f"http{rng.choice(['', 's'])}://{rng.choice(['www.', '', 'a.b.'])}{rng.choice(['One', 'two', 'three'])}.{rng.choice(['com', 'org', 'co.uk'])}"
            f"{rng.choice(['', ':80'])}/{rng.choice(['x', 'News', 'shop/cart', ''])}{rng.randint(0, 60)}{rng.choice(['', '.html', '?q=1'])}" for _ in range(n)]


PATTERNS = [("contains", p) for p in ("news", "NEWS1", "e", "co", "/shop/cart1", "zzz", "", None, "https://www.one.com/news1")] + \
    [("starts_with", p) for p in ("http", "https://www.", "HTTPS://TWO", "h", "https://" + "x" * 80)] + [("ends_with", p) for p in (".html", "1", "?q=1", "0.HTML")] + \
    [("domain", p) for p in ("one.com", "com", "co.uk", "b.two.org", ".com", "ne.com")] + [("Regex ", p) for p in (r"news\d$", r"^https", r"(one|two)\.com", r"\d\d", "(bad", r"sh[o]p/ca+rt", r"(?P<x>ne)ws")] + \
    [("unknown", "one"), (None, "one"), ("  Contains", "three")]


@pytest.mark.parametrize("by", [(), ("job",)])
def test_match_patterns(spark, by):
    rng = random.Random(1)
    subjects = [(rng.choice([1, 1, 1, 2, 3, None]), u) for u in urls(rng, 300)] + [(1, None), (1, "")]
    patterns = [(rng.choice([1, 1, 2]), f"{i}", t, p) for i, (t, p) in enumerate(PATTERNS)]
    s = spark.createDataFrame(subjects, "job int, s string").repartition(3)
    p = spark.createDataFrame(patterns, "job int, pid string, type string, pattern string")
    got = [tuple(r) for r in P.match_patterns(s, p, by).collect()]
    want = {(*((j,) if by else ()), u, i) for j, u in subjects for k, i, t, x in patterns if u is not None and (not by or j == k) and matches(t, x, u)}
    assert len(got) == len(set(got)) and set(got) == want
    assert P.match_patterns(s, p.limit(0), by).count() == 0 and P.match_patterns(s.limit(0), p, by).count() == 0


def test_required_literal():
    assert [R.required_literal(p) for p in (r"news\d+/item", "a|b", "(abc)+d", "x*yz", r"^Foo$", "[ab]c", "(bad", None, "(?:ab){0,2}q")] == \
        ["/item", "", "abc", "yz", "foo", "c", "", "", "q"]
    assert R.required_literal("é") == ""


def test_hot_job_with_many_rules_runs_in_many_tasks(spark):
    rng = random.Random(2)
    links = [(1, f"https://h{rng.randint(0, 50)}.com/p{i}") for i in range(3000)] + [(i, f"https://x.org/{i}") for i in range(2, 1500)] + [(None, "https://n.org/")]
    rules = [(1, "contains", f"/p{i}7") for i in range(2000)] + [(1, "starts_with", f"https://h{i}.com/p1") for i in range(20)] + [(2, "ends_with", "nope"), (3, "domain", "org")]
    ldf = spark.createDataFrame(links, "job_id int, link string").repartition(4)
    rdf = spark.createDataFrame(rules, "job_id int, type string, pattern string")
    by = {}
    for j, t, p in rules:
        by.setdefault(j, []).append((t, p))
    want = Counter((j, u) for j, u in links if j not in by or any(matches(t, p, u) for t, p in by[j]))
    got = L.match_rules_table(ldf, rdf)
    assert Counter(tuple(r) for r in got.collect()) == want
    pairs = P.match_patterns(ldf.select("job_id", F.col("link").alias("s")), rdf.withColumn("pid", F.col("pattern")), ("job_id",))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        tasks = [r["n"] for r in pairs.where("job_id = 1").groupBy(F.spark_partition_id().alias("t")).agg(F.count("*").alias("n")).collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert len(tasks) >= 6 and max(tasks) < sum(tasks) / 2


def test_blocked_domains_from_a_table(spark):
    rng = random.Random(3)
    links = [(i, u) for i, u in enumerate(urls(rng, 400))] + [(900, None), (901, "no url"), (902, "https://sub.evil.example/x")]
    listed = ["one.com", "co.uk", "evil.example", "two", ""]
    df = spark.createDataFrame(links, "i int, link string").repartition(3)
    bad = spark.createDataFrame([(d,) for d in [*listed, *listed]], "domain string")
    got = Counter(tuple(r) for r in L.blocked_by_table(df, bad).collect())
    literal = df.where(F.col("link").isNull() | ~R.blocked_domain("link", [d for d in listed if d]))
    assert got == Counter(tuple(r) for r in literal.collect()) and 0 < sum(got.values()) < len(links)
    many = spark.range(200_000).select(F.concat(F.lit("d"), F.col("id").cast("string"), F.lit(".net")).alias("domain")).unionByName(bad)
    assert Counter(tuple(r) for r in L.blocked_by_table(df, many).collect()) == got
    assert L.blocked_by_table(df, bad.limit(0)).count() == len(links)
