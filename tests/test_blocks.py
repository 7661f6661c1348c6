"""Extraction on small documents shaped like the reference's test pages."""
import random
import re

from pyspark.sql import functions as F

from pagelake.functions.html import strip_raw_text
from pagelake.operators import blocks as B

ARTICLE = """<html><head><title>T &amp; more</title><style>p{}</style></head><body>
<nav><ul><li><a href="/x">Home</a></li></ul></nav>
<header><p>Site header text here</p></header>
<article><h1>Main <b>Title</b></h1>
<p>This is a long paragraph with enough words to pass every gate in the extractor for sure today.</p>
<p>This is a long paragraph with enough words to pass every gate in the extractor for sure today.</p>
<ul><li>first item</li><li>second <i>item</i></li></ul>
<pre class="language-python">def f(x):
    return x + 1</pre>
<p>Short one with five words</p><p>and another short fragment here</p>
<div class="ad">Buy our sponsored product now</div>
</article><footer>Footer &copy; 2024</footer></body></html>"""


def blocks(spark, html, targets=("text",)):
    df = spark.createDataFrame([(1, "https://example.com/a", html)], "page_id long, url string, html string")
    return B.blocks_relational(B.extract_blocks(df, targets)).orderBy("pos").collect()


def test_article_blocks(spark):
    rows = blocks(spark, ARTICLE)
    types = [r.type for r in rows]
    assert types[0] == "heading" and rows[0].content == "MainTitle" and rows[0].level == 1
    paras = [r.content for r in rows if r.type == "paragraph"]
    assert len([p for p in paras if p.startswith("This is a long")]) == 1          # duplicate dropped
    assert "Short one with five words and another short fragment here" in paras                                  # short fragments merged
    lists = [r for r in rows if r.type == "unordered_list"]
    assert lists and list(lists[0].items) == ["first item", "second item"]
    code = [r for r in rows if r.type == "code_block"]
    assert code and code[0].language == "python" and "return x + 1" in code[0].content
    assert not any("Home" in (r.content or "") for r in rows)                      # nav stripped


def test_targets_and_empty(spark):
    rows = blocks(spark, ARTICLE, ("text", "headers", "footers", "ads"))
    types = [r.type for r in rows]
    assert types[0] == "header_content" and "footer_content" in types and "ad_content" in types
    assert blocks(spark, "   ") == []


def test_code_density_and_language(spark):
    df = spark.createDataFrame([("x = {a: 1}; y = [2, 3]; z = (a || b) && c;",), ("plain words only here and there",),
                                ("SELECT a FROM t WHERE b = 1",)], "t string")
    r = df.select(B.is_code_by_density(F.col("t")).alias("c"), B.guess_language(F.col("t")).alias("l")).collect()
    assert [x.c for x in r] == [True, False, False]
    assert r[2].l == "sql"


FILL = "<p>" + "enough words to pass the gate of the main content here " * 4 + "</p>"


def column(spark, html, stage):
    df = spark.createDataFrame([(1, html)], "page_id long, html string")
    return stage(df).first()


def test_subtrees_end_at_their_own_tag(spark):
    def strip(html, flag):
        return column(spark, html, lambda d: B.strip_elements(d, "html", "out", flag)).out
    by_class = B.class_flag(["sidebar"])
    assert strip('<div class="sidebar"><div>a</div>REST</div>MAIN', by_class) == "MAIN"
    assert strip('<div id="left-Sidebar"><p>x</div><b>y', by_class) == "<b>y"
    assert strip('a<nav>b<nav>c</nav>d</nav>e<br/>f', B.tag_flag(["nav"])) == "ae<br/>f"
    assert strip('<div style="color:red; DISPLAY : none"><div>x</div>y</div>z', B.hidden_flag) == "z"
    # code is never stripped
    kept = '<pre class="sidebar">x</pre><div class="sidebar">if (a[0] == {b: 1}) { c = d[2]; }</div>'
    assert strip(kept + '<div class="sidebar">words only</div>', by_class) == kept


def test_nested_lists_and_containers(spark):
    html = f"<article>{FILL}<ul><li>one<ul><li>in</li></ul>tail</li><li>two</li></ul></article>"
    lists = [list(r["items"]) for r in blocks(spark, html) if r.type == "unordered_list"]
    assert lists == [["one in tail", "two"], ["in"]]
    html = f"<article>{FILL}<ul><li>one<li>two<ol><li>x<li>y</ol></ul></article>"  # no end tags
    lists = [(r.type, list(r["items"])) for r in blocks(spark, html) if r.type.endswith("_list")]
    assert lists == [("unordered_list", ["one", "two x y"]), ("ordered_list", ["x", "y"])]
    html = f"<article>{FILL}<blockquote>Said <p>deep <i>down</i></p> and after <blockquote>inner</blockquote> end</blockquote></article>"
    quotes = [r.content for r in blocks(spark, html) if r.type == "blockquote"]
    assert quotes == ["Said deep down and after inner end", "inner"]


def test_main_content_keeps_all_articles(spark):
    text = "words of this article " * 10
    links = "<a href=/x>" + "more links here " * 20 + "</a>"
    html = f"<body><nav>menu</nav><article><h1>A</h1>{text}</article><article>{text}<article>inner</article></article><article>{links}</article>foot</body>"
    got = column(spark, html, lambda d: B.main_content(d, "html", "out")).out
    assert got.count("words of this article") == 20 and "inner" in got and "more links" not in got and "menu" not in got
    assert column(spark, "<body><article>short</article>x</body>", lambda d: B.main_content(d, "html", "out")).out.endswith("</body>")


def test_ads_inside_ads(spark):
    html = '<div class="ad-box">outer words here <span id="promo1">inner words here</span></div><p class="x">no</p>'
    got = column(spark, html, lambda d: B.target_blocks(d, "html", ["ad"]))._ad
    assert [b.content for b in got] == ["outer words here inner words here", "inner words here"]


def test_ends_of_a_batch_hold_few_objects():
    """A batch of pages is not turned into Python strings and lists as a whole."""
    import tracemalloc

    import pyarrow as pa
    from pagelake.functions import elements_udf as U
    page = ["div", "", "p", "", "/div", "span"] * 100
    keys = pa.array([page, None, [], *[page] * 3000])
    tracemalloc.start()
    got = U.piece_ends.func(keys)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 8_000_000, peak
    assert got.slice(1, 2).to_pylist() == [None, []] and len(got) == 3003
    assert got[0].as_py() == got[3002].as_py() == U.ends_of(page, False)
    assert U.element_ends.func(keys.slice(1, 3)).to_pylist() == [None, [], U.ends_of(page, True)]


def test_ends_of_elements():
    from pagelake.functions.elements_udf import ends_of
    assert ends_of(["div", "", "div", "/div", "/div", ""], True) == [5, 2, 4, 4, 5, 6]
    assert ends_of(["div", "", "div", "/div", "/div", ""], False) == [4, 2, 3, 4, 5, 6]
    assert ends_of(["p", "", "p", "br", "/section", "/p"], True) == [2, 2, 6, 4, 5, 6]
    assert ends_of(["ul", "li", "li", "ul", "li", "/ul", "/ul"], False)[1:3] == [2, 6]
    assert ends_of(["div"] * 50_000, True) == [50_000] * 50_000


def test_post_process_interleave_and_counts_of_all_pages(spark, sf):
    """Order-dependent folds against plain Python over every page."""
    import re
    from collections import Counter, defaultdict
    from pagelake.config import EngineConfig
    from pagelake.operators.links import extract_links
    from pagelake.plans import blocks_q as Q
    from pagelake.streaming import streams as Z

    df = B.with_code_blocks(B.with_text_blocks(Q.elements(spark, sf), Q.CFG), Q.CFG)
    want, counts = {}, []
    for r in df.select("page_id", "_text_raw", "_code").collect():
        out, seen = [], set()
        for b in r._text_raw:
            c = " ".join(b.content.split())
            if not c or c.lower() in seen:
                continue
            seen.add(c.lower())
            last = out[-1] if out else None
            if (b.type == "paragraph" and last and last[0] == "paragraph" and len(last[1].split()) < 15 and len(c.split()) < 15
                    and not re.search(r"[.!?:]$", last[1].rstrip())):
                last[1] += " " + c
            else:
                out.append([b.type, c])
        nt, nc = len(out), len(r._code)
        after = defaultdict(list)
        for k, b in enumerate(r._code):
            after[-(-(k + 1) * nt // (nc + 1)) - 1].append(["code_block", b.content])
        rows = after[-1] + [x for i, t in enumerate(out) for x in [t, *after[i]]]
        want[r.page_id] = [tuple(x) for x in rows if x[1].strip()]
        counts.append((r.page_id, len(want[r.page_id]), sum(x[0] == "code_block" for x in want[r.page_id])))
    got = defaultdict(list)
    for r in B.blocks_relational(Q._blocks(spark, sf)).orderBy("page_id", "pos").collect():
        got[r.page_id].append((r.type, r.content))
    assert dict(got) == want and any(n for _, _, n in counts)
    assert Counter(map(tuple, B.block_type_counts(Q._blocks(spark, sf)).collect())) == Counter(counts)
    # the stream over the plain pages finds what the batch finds
    plain = spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url", "html")
    got = Z.stream_extract(spark, sf)
    batch = B.blocks_relational(B.extract_blocks(plain)).select("page_id", "type", "pos", "content")
    assert Counter(map(tuple, got.where("type <> 'link'").collect())) == Counter(map(tuple, batch.collect()))
    links = extract_links(plain, cfg=EngineConfig()).select("page_id", "pos", "link").collect()
    assert Counter(map(tuple, got.where("type = 'link'").select("page_id", "pos", "content").collect())) == Counter(map(tuple, links)) and links


def scanned(html):
    """The markup rules, a character at a time."""
    out, i = [], 0
    low = html.lower()
    while i < len(html):
        if html[i] != "<":
            out.append(html[i])
            i += 1
            continue
        if html.startswith("<!--", i):
            end = html.find("-->", i + 4)
            i = len(html) if end < 0 else end + 3
            continue
        nxt = html[i + 1 : i + 2]
        if not (nxt.isascii() and nxt.isalpha() or nxt in ("/", "!", "?")) or not nxt:
            out.append("&lt;")
            i += 1
            continue
        j, quote, after_eq = i + 1, "", False
        while j < len(html) and (quote or html[j] != ">"):
            c = html[j]
            if quote:
                quote = "" if c == quote else quote
            elif c in "\"'" and after_eq and c in html[j + 1 :]:
                quote = c
            after_eq = not quote and (c == "=" or after_eq and c.isspace())
            j += 1
        if j >= len(html):
            out.append("&lt;")
            i += 1
            continue
        name = next((n for n in ("script", "style") if low.startswith(n, i + 1) and not (low[i + 1 + len(n)].isalnum() or low[i + 1 + len(n)] == "_")), None)
        if name:
            m = re.compile(f"</{name}\\s*>").search(low, j + 1)
            i = m.end() if m else len(html)
            continue
        out.append("<" + html[i + 1 : j].replace("<", "&lt;").replace(">", "&gt;") + ">")
        i = j + 1
    return "".join(out)


MARKUP = ['<p title="a > b">attr text</p>', "<p title='a > \"b'>x</p> 1 < 2 <b>y</b>", '<script>var s = "<!--"; if (a < b) x("</p>");</script><p>kept</p><!-- gone -->tail', "<!-- open <p>x</p>",
          "<style>a > b {}</style ><STYLE media='x>y'>p{}</STYLE>z", "a<b c", "<a href=x'y>q</a>", "<p it's>fine</p><p it's>more</p>", "<br/><x-y data-a = \"<p>\" b>t</x-y>", "<script src='a>b'>never closed <p>",
          "< p>no tag</ p>", "<!doctype html><?xml a='>'?>t", "<scripty>kept</scripty>", "", "plain", "<", "a <", "<p a=\"unclosed>text</p>", "<p a=\"x\"b='y'>z</p>"]


def test_markup_is_scanned_in_order(spark):
    rng = random.Random(6)
    bits = ["<p", ">", "</p>", "<", '"', "'", "=", " a", "<!--", "-->", "<script>", "</script>", "x", "<b c='", "/>", "&lt;"]
    cases = MARKUP + ["".join(rng.choice(bits) for _ in range(rng.randint(1, 14))) + "'\">" for _ in range(300)]
    df = spark.createDataFrame([(c,) for c in cases], "h string")
    assert [r[0] for r in df.select(strip_raw_text("h")).collect()] == [scanned(c) for c in cases]


def test_quoted_brackets(spark):
    html = "<html><body><article>" + "".join(f'<p title="a > b {i}" data-x=\'<p>\'>attr text {i} with words enough to pass the gate of paragraphs here</p>' for i in range(5)) + "</article></body></html>"
    df = spark.createDataFrame([(1, html)], "page_id long, html string")
    got = [b.content for b in B.extract_blocks(df).first().blocks if b.type == "paragraph"]
    assert got and all(c.startswith("attr text") for c in got)


def test_ends_of_a_batch_are_kept_once():
    """Arrow holds no second copy of a batch's ends, which go into one buffer; null and empty pages, and slices, keep their places."""
    import pyarrow as pa

    from pagelake.functions.elements_udf import ends_of_pages
    pages = [["div", "", "/div"], None, [], ["p", "p"]]
    for shift in (0, 1):
        got = ends_of_pages(pa.array(pages, pa.list_(pa.string())).slice(shift), True)
        assert got.to_pylist() == [[3, 2, 3], None, [], [1, 2]][shift:] and got.type == pa.list_(pa.int32())
    assert ends_of_pages(pa.array([], pa.list_(pa.string())), False).to_pylist() == []
    keys = pa.array([["div", "p", "", "/div"] * 100] * 2000)
    pool, default = pa.proxy_memory_pool(pa.default_memory_pool()), pa.default_memory_pool()
    pa.set_memory_pool(pool)
    try:
        ends = ends_of_pages(keys, True)
    finally:
        pa.set_memory_pool(default)
    n, size, most = len(ends.flatten()), ends.nbytes, pool.max_memory()
    del ends  # before its pool
    assert n == 800_000 and most < size / 2


def test_attributes_are_read_once(spark):
    """A tag's class, an element's density and a block's even text stand once in the plan, however often they are used."""
    df = spark.createDataFrame([('<div class="a HLJS">', "x"), ("<p style='font: Courier'>", "a = {b: [1]};  \\n  c = {d: (2)};"), ("<p>", ""), ("<p>", None), (None, "some plain words, quite a few of them")], "o string, t string")
    got = df.select(B.has_code_class(F.col("o")).alias("k"), B.is_code_by_density(F.col("t")).alias("d"))
    assert [tuple(r) for r in got.collect()] == [(True, False), (True, True), (False, False), (False, None), (None, False)]
    text = got._jdf.queryExecution().optimizedPlan().toString()
    assert text.count("regexp_extract(") <= 6 and text.count("regexp_replace(") <= 1
