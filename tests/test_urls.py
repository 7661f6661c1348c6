"""URL normalisation and rules, checked against the standard library on
hand-written cases (the reference's own cases included)."""
from urllib.parse import urljoin, urlparse, urlunparse

from pyspark.sql import functions as F

from pagelake.functions import rules as R
from pagelake.functions import urls as U

BASE = "https://example.com/a/b/page1"
HREFS = ["/page2", "https://example.com/page#section", "https://example.com/page/", "https://EXAMPLE.COM/Page",
         "javascript:void(0)", "mailto:test@example.com", "#top", "tel:123", "page3", "../up", "./same", "?q=1",
         "//other.org/x/", "ftp://files.example.com/f", "http://example.com", "a/../../b/./c/", "/", "data:x",
         "https://example.com/p?utm_source=x#frag", "sub/dir/"]


def py_normalize(href, base):
    if href.startswith(("javascript:", "mailto:", "tel:", "data:", "#")):
        return None
    p = urlparse(urljoin(base, href))
    if p.scheme not in ("http", "https") or not p.netloc:
        return None
    return urlunparse((p.scheme, p.netloc.lower(), p.path.rstrip("/") or "/", p.params, p.query, ""))


def test_normalize_matches_stdlib(spark):
    df = spark.createDataFrame([(h, BASE) for h in HREFS], "href string, base string")
    out = U.add_url_join(df, "base", "href", "n", normalize=True).select("href", "n").collect()
    got = {r.href: r.n for r in out}
    for h in HREFS:
        assert got[h] == py_normalize(h, BASE), h


def test_join_matches_stdlib(spark):
    df = spark.createDataFrame([(h, BASE) for h in HREFS], "href string, base string")
    out = U.add_url_join(df, "base", "href", "j").select("href", "j").collect()
    for r in out:
        assert r.j == urljoin(BASE, r.href), r.href


def test_rules_five_types(spark):
    urls = ["https://example.com/blog/post1", "https://example.com/about", "https://sub.example.org/x.pdf",
            "https://EXAMPLE.com/Shop/item"]
    df = spark.createDataFrame([(u,) for u in urls], "url string")
    cases = [
        ([{"type": "contains", "pattern": "blog"}], [True, False, False, False]),
        ([{"type": "starts_with", "pattern": "https://example.com/"}], [True, True, False, True]),
        ([{"type": "ends_with", "pattern": ".PDF"}], [False, False, True, False]),
        ([{"type": "regex", "pattern": r"/shop/\w+$"}], [False, False, False, True]),
        ([{"type": "regex", "pattern": "(unclosed"}], [False, False, False, False]),
        ([{"type": "domain", "pattern": "example.org"}], [False, False, True, False]),
        ([{"type": "", "pattern": "x"}, {"type": "bogus", "pattern": "a"}], [False, False, False, False]),
        ([], [True, True, True, True]),
    ]
    for rules, expect in cases:
        got = [r.m for r in df.select(R.rules_any("url", rules).alias("m")).collect()]
        assert got == expect, rules


def test_domain_and_blocking(spark):
    df = spark.createDataFrame([("https://m.Facebook.com:8080/x",), ("https://notfacebook.com/",)], "url string")
    r = df.select(U.url_domain("url").alias("d"), R.blocked_domain("url", ["facebook.com"]).alias("b")).collect()
    assert [x.d for x in r] == ["m.facebook.com", "notfacebook.com"]
    assert [x.b for x in r] == [True, False]
