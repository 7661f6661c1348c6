"""One synthetic response per wall-cascade branch, plus JS signals."""
from pyspark.sql import functions as F

from pagelake.operators import detectors as D

CASES = [
    (403, {"CF-Ray": "1"}, [], "checking your browser", "https://a.com/", "cloudflare", "skip"),
    (200, {}, ["__cf_bm"], "checking your browser", "https://a.com/", "cloudflare", "skip"),
    (503, {}, [], "ddos-guard", "https://a.com/", "cloudflare", "skip"),
    (200, {}, [], "<div class='g-recaptcha'>", "https://a.com/", "recaptcha", "skip"),
    (200, {}, [], "hcaptcha-challenge", "https://a.com/", "hcaptcha", "skip"),
    (200, {"X-DataDome": "1"}, [], "", "https://a.com/", "datadome", "skip"),
    (401, {}, [], "dd_referrer", "https://a.com/", "datadome", "skip"),
    (403, {}, ["_px3"], "", "https://a.com/", "perimeterx", "skip"),
    (401, {}, [], "PerimeterX", "https://a.com/", "perimeterx", "skip"),
    (429, {"Retry-After": "0"}, [], "", "https://a.com/", "rate_limit", "retry"),
    (403, {}, [], "", "https://a.com/", "ip_ban", "skip"),
    (200, {}, [], "Your session has timed out", "https://a.com/", "session_expired", "login"),
    (200, {}, [], "", "https://a.com/account/login?next=/", "login_wall", "login"),
    (200, {}, [], '<input type="password">', "https://a.com/", "login_wall", "login"),
    (200, {}, [], "Subscribe to read", "https://a.com/", "paywall", "skip"),
    (200, {}, [], "OneTrust banner", "https://a.com/", "cookie_consent", "dismiss"),
    (200, {}, [], "hello", "https://a.com/", "none", "none"),
]


def test_wall_cascade(spark):
    df = spark.createDataFrame([(s, h, c, b, u) for s, h, c, b, u, _, _ in CASES],
                               "s int, h map<string,string>, c array<string>, b string, u string")
    got = df.select(D.wall_detect("s", "h", "c", "b", "u").alias("w")).collect()
    for r, case in zip(got, CASES):
        assert (r.w.wall_type, r.w.action) == (case[5], case[6]), case
    assert got[9].w.retry_after_seconds == 60.0


def test_js_signals(spark):
    html = ('<html><body><div id="root"></div><noscript>You need to enable JavaScript to run this app.</noscript>'
            '<script src="/_next/static/x.js"></script></body></html>')
    df = spark.createDataFrame([(html, {"X-Powered-By": "Next.js"})], "html string, h map<string,string>")
    r = D.js_detect(df, "html", "h", F.lit(0), "j").first().j
    assert "no_content_extracted(+4)" in r.signals and "empty_root_#root(+3)" in r.signals
    assert "noscript_content(+3)" in r.signals and "react:_next/static/(+2)" in r.signals
    assert any(s.startswith("thin_body:") for s in r.signals) and r.needs_js


LONG = "word " * 140
ROOTS = {
    f'<div id="app"><div></div>{LONG}</div>': None,
    f'<div id="root"><div class=x>{LONG}</div></div>': None,
    '<div id="root"><div class=x><div></div></div></div>' + LONG: "empty_root_#root(+3)",
    f'<p title="id=root">a</p><DIV data-x="1" ID=app>x</DIV>{LONG}': "empty_root_#app(+3)",
    f'<div id="root"><p>{LONG}</p></div><div id="app"></div>': "empty_root_#app(+3)",
    f'<!-- <div id="root"></div> --><script>var s = "<div id=root></div>";</script>{LONG}': None,
    f'<div data-a="x > y" id=\'__next\'><divider></divider>short</div>{LONG}': "empty_root_#__next(+3)",
    f'<app-root id="app-root"><app-root>{LONG}</app-root></app-root>': None,
    f'<input id="root">{LONG}': "empty_root_#root(+3)",
    f'<div id="root">unclosed {LONG}': None,
    f'<div id="rooted"></div>{LONG}': None,
}


def test_root_elements_end_by_depth(spark):
    df = spark.createDataFrame([(f"<html><body>{h}</body></html>",) for h in ROOTS], "html string")
    got = [next((s for s in r.js.signals if s.startswith("empty_root")), None) for r in D.js_detect(df, "html").collect()]
    assert got == list(ROOTS.values())


def test_walls_are_worked_out_once(spark, sf):
    """What is asked of an outcome doesn't go below the cascade, and its log rows come from one pass."""
    from pagelake.operators import export as K
    from pagelake.plans.detectors_q import walls
    text = lambda df: df._jdf.queryExecution().optimizedPlan().toString().count("ddos-guard")
    w = walls(spark, sf)
    o = D.fetch_outcome("http_status", F.col("w"))
    assert text(w.where(o["outcome"] == "success")) == text(w) > 0
    rows = [(1, "u", "success", None, ["a", "b"]), (2, "u", "success", "e", []), (3, None, "skip", "e", ["a"]), (4, "u", None, None, None), (None, "u", "success", None, None)]
    logs = K.outcome_logs(spark.createDataFrame(rows, "job_id int, url string, outcome string, error string, labels array<string>"))
    assert "Union" not in logs._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(map(tuple, logs.collect()), key=str) == sorted([
        (1, "info", "Scraped successfully → a, b", "u", "scraper"), (1, "info", "Classified as: a, b", "u", "classifier"), (2, "info", "Scraped successfully", "u", "scraper"),
        (3, "error", "Failed: e", None, "scraper"), (4, "error", "Failed: ?", "u", "scraper"), (None, "info", "Scraped successfully", "u", "scraper")], key=str)
