from pagelake.operators import links as L


def test_extract_links_dedup_seen_rules(spark):
    html = ('<html><body><a href="/page1">1</a><a href=" /page1 ">again</a><a href="/blog/a">b</a>'
            '<a href="/blog/b">c</a><!-- <a href="/hidden">x</a> --><a href="mailto:x@y">m</a>'
            '<script>var s = "<a href=\'/js\'>";</script></body></html>')
    pages = spark.createDataFrame([(1, "https://example.com", html)], "page_id long, url string, html string")
    got = [r.link for r in L.extract_links(pages).orderBy("pos").collect()]
    assert got == ["https://example.com/page1", "https://example.com/blog/a", "https://example.com/blog/b"]
    ruled = [r.link for r in L.extract_links(pages, rules=[{"type": "contains", "pattern": "/blog/"}]).collect()]
    assert sorted(ruled) == ["https://example.com/blog/a", "https://example.com/blog/b"]
    seen = spark.createDataFrame([("https://example.com/page1",)], "link string")
    assert "https://example.com/page1" not in [r.link for r in L.extract_links(pages, seen=seen).collect()]
