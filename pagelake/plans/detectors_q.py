"""Queries: wall detection (D1, D2), JS detection (D3), fetch outcome (D4),
render decision (D6), wall summary (D7)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.elements_udf import VOID
from ..functions.html import sql_entity_decode, sql_pystrip, sql_strip_raw_text
from ..operators import detectors as D
from ..sources.tables import read_table
from .registry import register
from .windows import row_barrier


# Bodies by page id, so that every branch has rows: half of the pages carry one pattern of each list in turn, and some are
# empty shells that a script fills.
MARKS = [x for group in (D.CF_BODY, D.RECAPTCHA, D.HCAPTCHA, D.DATADOME, D.PERIMETERX, D.SESSION, D.LOGIN_BODY, D.PAYWALL, D.CONSENT,
                         D.SPA_GLOBALS, D.REACT, D.VUE, D.ANGULAR) for x in group[:2]]
MARKS += [f'<div id="{x}"></div>' for x in D.ROOT_IDS] + ['<noscript>This page needs a script engine to show anything</noscript>', '<i class="a data-v-1f">x</i>']
SHELL = '<html><head><title>t</title></head><body><div id="app"></div><script>window.__NUXT__={}</script></body></html>'


def page_bodies(spark, d):
    p = read_table(spark, d, "pages").select("page_id", "url", "html")
    mark = F.element_at(F.array(*[F.lit(x) for x in MARKS]), (F.floor(F.col("page_id") / 2) % len(MARKS) + 1).cast("int"))
    html = F.when(F.col("page_id") % 13 == 5, F.lit(SHELL)).when(F.col("page_id") % 2 == 0, F.concat("html", F.lit("<p>"), mark, F.lit("</p>"))).otherwise(F.col("html"))
    return p.select("page_id", "url", html.alias("html"))


SQL_MARKS = "[" + ", ".join("'" + x.replace("'", "''") + "'" for x in MARKS) + f"][(page_id // 2) % {len(MARKS)} + 1]"
SQL_BODIES = (f"(SELECT page_id, url, CASE WHEN page_id % 13 = 5 THEN '{SHELL}' WHEN page_id % 2 = 0 THEN html || '<p>' || {SQL_MARKS} || '</p>' "
              "ELSE html END AS html FROM pages)")


def responses(spark, d):
    """Fetched responses over the real pages with response metadata varied by
    page id: blocking statuses, bot-protection headers, cookies and login
    redirects, so every cascade branch has rows at scale."""
    p = page_bodies(spark, d)
    pid = F.col("page_id")
    status = (F.when(pid % 10 == 0, 403).when(pid % 10 == 1, 429).when(pid % 10 == 2, 503)
              .when(pid % 10 == 3, 401).when(pid % 10 == 4, 301).when(pid % 10 == 5, 500).otherwise(200))
    ra = F.when(pid % 3 == 0, "abc").when(pid % 3 == 1, "0").otherwise("120")
    headers = (F.when(pid % 4 == 0, F.create_map(F.lit("CF-Ray"), F.lit("8a1b")))
               .when(pid % 4 == 1, F.create_map(F.lit("Retry-After"), ra))
               .when(pid % 4 == 2, F.create_map(F.lit("X-DataDome"), F.lit("1"), F.lit("X-Powered-By"), F.lit("Next.js")))
               .otherwise(F.create_map().cast("map<string,string>")))
    cookies = (F.when(pid % 6 == 0, F.array(F.lit("__CF_bm"))).when(pid % 6 == 1, F.array(F.lit("_px3")))
               .when(pid % 6 == 2, F.array(F.lit("datadome"))).otherwise(F.array().cast("array<string>")))
    final_url = F.when(pid % 9 == 0, F.concat(F.col("url"), F.lit("/login?next=/"))).otherwise(F.col("url"))
    return p.select("page_id", "url", "html", status.alias("http_status"), headers.alias("headers"),
                    cookies.alias("cookie_names"), final_url.alias("final_url"))


def walls(spark, d):
    """The wall of each response, worked out once, whatever is made of it or asked for above."""
    r = responses(spark, d).withColumn("_lc", F.lower("html"))
    return row_barrier(r.select("page_id", "http_status",
                                D.wall_detect("http_status", "headers", "cookie_names", "_lc", "final_url", body_is_lower=True)
                                .alias("w")))


# ---- DuckDB twin of the response view and the cascade -----------------------
R_SQL = ("SELECT page_id, url, html, lower(html) AS b, "
         "CASE page_id % 10 WHEN 0 THEN 403 WHEN 1 THEN 429 WHEN 2 THEN 503 WHEN 3 THEN 401 WHEN 4 THEN 301 "
         "WHEN 5 THEN 500 ELSE 200 END AS s, page_id % 4 = 0 AS cf_ray, page_id % 4 = 1 AS has_ra, "
         "CASE page_id % 3 WHEN 0 THEN 'abc' WHEN 1 THEN '0' ELSE '120' END AS ra, page_id % 4 = 2 AS dd_h, "
         "page_id % 6 = 0 AS cf_c, page_id % 6 = 1 AS px_c, page_id % 6 = 2 AS dd_c, "
         f"CASE WHEN page_id % 9 = 0 THEN url || '/login?next=/' ELSE url END AS fu FROM {SQL_BODIES}")


def _any(col, pats):
    return "(" + " OR ".join(f"contains({col}, '{p}')" for p in pats) + ")"


RA_VAL = "(CASE WHEN has_ra THEN coalesce(TRY_CAST(ra AS DOUBLE), 60.0) END)"
W_CASE = [
    ("cf_ray AND s IN (403, 429, 503)", "cloudflare", "skip", "high",
     f"CASE WHEN {_any('b', D.CF_BODY)} THEN ['cf-ray header + HTTP ' || s, 'cloudflare challenge body text'] "
     f"ELSE ['cf-ray header + HTTP ' || s] END", "NULL"),
    (f"cf_c AND {_any('b', D.CF_BODY)}", "cloudflare", "skip", "high", "['__cf_bm cookie + challenge body']", "NULL"),
    (f"{_any('b', D.CF_BODY)} AND s IN (403, 503)", "cloudflare", "skip", "medium", "['cloudflare challenge body only']", "NULL"),
    (_any("b", D.RECAPTCHA), "recaptcha", "skip", "high", "['recaptcha scripts/attributes in body']", "NULL"),
    (_any("b", D.HCAPTCHA), "hcaptcha", "skip", "high", "['hcaptcha scripts/attributes in body']", "NULL"),
    ("dd_h OR (dd_c AND s IN (401, 403))", "datadome", "skip", "high", "['datadome header/cookie + HTTP ' || s]", "NULL"),
    (f"{_any('b', D.DATADOME)} AND s IN (401, 403)", "datadome", "skip", "medium", "['datadome body pattern + blocked status']", "NULL"),
    ("px_c AND s IN (401, 403)", "perimeterx", "skip", "high", "['perimeterx cookie + HTTP ' || s]", "NULL"),
    (f"{_any('b', D.PERIMETERX)} AND s IN (401, 403)", "perimeterx", "skip", "medium", "['perimeterx body pattern + blocked status']", "NULL"),
    ("s = 429", "rate_limit", "retry", "high",
     f"['HTTP 429 Too Many Requests (retry-after: ' || coalesce(CAST({RA_VAL} AS VARCHAR), 'None') || 's)']",
     f"CASE WHEN {RA_VAL} IS NULL OR {RA_VAL} = 0 THEN 60.0 ELSE {RA_VAL} END"),
    ("s = 403 AND NOT cf_ray AND NOT dd_h", "ip_ban", "skip", "low", "['HTTP 403 with no known bot-detection headers']", "NULL"),
    (_any("b", D.SESSION), "session_expired", "login", "high", "['session-expired text in body']", "NULL"),
    ("fu IS NOT NULL AND regexp_matches(fu, '(/login|/signin|/sign-in|/auth/|/account/login|[?&]redirect|[?&]next=|[?&]return=)', 'i')",
     "login_wall", "login", "high", "['redirected to login URL: ' || fu]", "NULL"),
    (_any("b", D.LOGIN_BODY), "login_wall", "login", "medium", "['login form detected in body']", "NULL"),
    (_any("b", D.PAYWALL), "paywall", "skip", "medium", "['paywall text detected in body']", "NULL"),
    (_any("b", D.CONSENT), "cookie_consent", "dismiss", "medium", "['cookie consent widget detected']", "NULL"),
]


def _case(field_idx):
    parts = []
    for cond, t, a, c, sig, ra in W_CASE:
        val = {0: f"'{t}'", 1: f"'{a}'", 2: f"'{c}'", 3: sig, 4: ra}[field_idx]
        parts.append(f"WHEN {cond} THEN {val}")
    other = {0: "'none'", 1: "'none'", 2: "'high'", 3: "[]::VARCHAR[]", 4: "NULL"}[field_idx]
    return "CASE " + " ".join(parts) + f" ELSE {other} END"


WALL_SQL = (f"SELECT page_id, s AS http_status, {_case(0)} AS wall_type, {_case(1)} AS action, {_case(2)} AS confidence, "
            f"array_to_string({_case(3)}, '|') AS signals, CAST({_case(4)} AS DOUBLE) AS retry_after_seconds FROM ({R_SQL})")


@register("wall_detect", sql=f"SELECT page_id, wall_type, action, confidence, signals, retry_after_seconds, "
                             f"action <> 'none' AS is_blocked FROM ({WALL_SQL})")
def q_wall_detect(spark, d):
    w = walls(spark, d)
    return w.select("page_id", "w.wall_type", "w.action", "w.confidence",
                    F.array_join("w.signals", "|").alias("signals"), "w.retry_after_seconds", "w.is_blocked")


@register("wall_retry_after", sql=f"SELECT page_id, retry_after_seconds FROM ({WALL_SQL}) WHERE wall_type = 'rate_limit'")
def q_wall_retry_after(spark, d):
    w = walls(spark, d)
    return w.where(F.col("w.wall_type") == "rate_limit").select("page_id", "w.retry_after_seconds")


FETCH_SQL = ("CASE WHEN action = 'skip' THEN 'skip' WHEN action = 'retry' THEN 'retry' WHEN action = 'login' THEN 'login' "
             "WHEN http_status = 200 THEN 'success' WHEN http_status IN (301, 302, 303, 307, 308) THEN 'redirect' "
             "ELSE 'http_error' END")
FETCH_ERR = ("CASE WHEN action = 'skip' THEN 'Wall blocked (' || wall_type || '): ' || replace(signals, '|', '; ') "
             "WHEN action = 'retry' THEN NULL WHEN action = 'login' THEN 'Auth wall (' || wall_type || ') — no valid session. "
             "Add credentials in the UI.' WHEN http_status = 200 THEN NULL WHEN http_status IN (301, 302, 303, 307, 308) "
             "THEN 'Redirect ' || http_status ELSE 'HTTP ' || http_status END")


@register("fetch_outcome", sql=f"SELECT page_id, {FETCH_SQL} AS outcome, {FETCH_ERR} AS error FROM ({WALL_SQL})")
def q_fetch_outcome(spark, d):
    w = walls(spark, d)
    o = D.fetch_outcome("http_status", F.col("w"))
    return w.select("page_id", o["outcome"].alias("outcome"), o["error"].alias("error"))


@register("wall_summary", sql=f"SELECT wall_type, action, CAST(count(*) AS BIGINT) AS count FROM ({WALL_SQL}) GROUP BY 1, 2")
def q_wall_summary(spark, d):
    return D.wall_summary(walls(spark, d).select("w.wall_type", "w.action"))


# ---- JS detection -----------------------------------------------------------
def _sql_text_len(src: str, sep: int) -> str:
    frags = (f"list_filter(list_transform(regexp_split_to_array({src}, '<[^>]*>'), "
             f"lambda fz: {sql_pystrip(sql_entity_decode('fz'))}), lambda fz: fz <> '')")
    return (f"(CASE WHEN len({frags}) > 0 THEN CAST(list_sum(list_transform({frags}, lambda fy: length(fy))) AS INTEGER) "
            f"+ (len({frags}) - 1) * {sep} ELSE 0 END)")


def _sql_body(x: str) -> str:
    region = f"CASE WHEN regexp_matches({x}, '(?i)<body\\b') THEN regexp_extract({x}, '(?is)<body\\b[^>]*>(.*)$', 1) ELSE {x} END"
    return f"regexp_replace({region}, '(?is)</body\\s*>.*$', '')"


def _sql_first(col, pats, prefix, pts):
    expr = "NULL"
    for p in reversed(pats):
        expr = f"CASE WHEN contains({col}, '{p}') THEN '{prefix}:{p}(+{pts})' ELSE {expr} END"
    return expr


#: Per root id the first element with it: tags of its name in page order with their depth, which ends the element.
SQL_ROOTS = ("WITH op AS (SELECT page_id, k, rid, plain, regexp_extract(plain, replace('(?is)<([a-z][a-z0-9-]*)\\s(?:[^>]*?\\s)?id\\s*=\\s*(?:\"RID\"[^>]*|''RID''[^>]*|RID(?:[\\s/][^>]*)?)>', "
             f"'RID', regexp_escape(rid)), 0) AS opener FROM {{PLAIN}} pl, (SELECT unnest([{', '.join(repr(x) for x in D.ROOT_IDS)}]) AS rid, unnest(generate_series(1, {len(D.ROOT_IDS)})) AS k)), "
             "nm AS (SELECT *, lower(regexp_extract(opener, '^<([a-zA-Z][a-zA-Z0-9-]*)', 1)) AS tag, substr(plain, strpos(plain, opener) + length(opener)) AS rest FROM op WHERE opener <> ''), "
             "tg AS (SELECT page_id, k, unnest(regexp_extract_all(rest, '<[^>]*>')) AS t, generate_subscripts(regexp_extract_all(rest, '<[^>]*>'), 1) AS i, tag FROM nm), "
             "dp AS (SELECT page_id, k, i, 1 + sum(CASE WHEN lower(regexp_extract(t, '^</?([a-zA-Z][a-zA-Z0-9-]*)', 1)) <> tag THEN 0 WHEN starts_with(t, '</') THEN -1 ELSE 1 END) "
             "OVER (PARTITION BY page_id, k ORDER BY i) AS depth FROM tg), "
             "ed AS (SELECT page_id, k, min(i) AS last FROM dp WHERE depth = 0 GROUP BY ALL), "
             "tx AS (SELECT nm.page_id, nm.k, nm.rid, nm.tag, array_to_string(list_transform(string_split_regex(rest, '<[^>]*>')[1:coalesce(ed.last, 1000000000)], "
             f"lambda fz: {sql_pystrip(sql_entity_decode('fz'))}), '') AS said FROM nm LEFT JOIN ed USING (page_id, k)) "
             f"SELECT page_id, min_by('empty_root_#' || rid || '(+3)', k) AS root FROM tx WHERE length(said) < 20 OR tag IN ({', '.join(repr(x) for x in sorted(VOID))}) GROUP BY page_id")

JS_SIG_SQL = [
    "CASE WHEN page_id % 7 = 0 THEN 'no_content_extracted(+4)' END",
    "root",
    (f"CASE WHEN list_bool_or(list_transform(regexp_extract_all(plain, '(?is)<noscript\\b[^>]*>(.*?)</noscript\\s*>', 1), "
     f"lambda x: {_sql_text_len('x', 0)} >= 30)) THEN 'noscript_content(+3)' END"),
    _sql_first("html", D.SPA_GLOBALS, "spa_global", 2),
    _sql_first("html", D.REACT, "react", 2),
    _sql_first("html", D.VUE, "vue", 2),
    ("CASE WHEN regexp_matches(plain, '(?i)\\sclass\\s*=\\s*(?:\"(?:[^\"]*\\s)?data-v-|''(?:[^'']*\\s)?data-v-|data-v-)') "
     "THEN 'vue:data-v-attr(+2)' END"),
    _sql_first("html", D.ANGULAR, "angular", 2),
    f"CASE WHEN blen < 150 THEN 'thin_body:' || blen || 'chars(+2)' END",
    "CASE WHEN pb_hit THEN 'x-powered-by:' || pb || '(+1)' END",
]
JS_SQL = (f"WITH plains AS MATERIALIZED (SELECT page_id, html, {sql_strip_raw_text('html')} AS plain FROM {SQL_BODIES}), roots AS MATERIALIZED ({SQL_ROOTS.replace('{PLAIN}', 'plains')}) "
          f"SELECT page_id, sig, CAST(list_sum(list_transform(sig, lambda x: CAST(regexp_extract(x, '\\(\\+([0-9])\\)$', 1) AS INTEGER))) "
          f"AS INTEGER) AS score FROM (SELECT page_id, list_filter([{', '.join(JS_SIG_SQL)}], lambda x: x IS NOT NULL) AS sig "
          f"FROM (SELECT page_id, html, plain, {_sql_text_len(_sql_body('plain'), 1)} AS blen, "
          f"CASE WHEN page_id % 4 = 2 THEN 'next.js' END AS pb, coalesce(page_id % 4 = 2, false) AS pb_hit FROM plains) LEFT JOIN roots USING (page_id))")


def js_scores(spark, d):
    r = responses(spark, d)
    r = r.select("page_id", "html", "headers", "cookie_names", "http_status", "final_url")
    return D.js_detect(r, "html", "headers", F.when(F.col("page_id") % 7 == 0, 0).otherwise(3))


@register("js_detect", sql=(f"SELECT page_id, COALESCE(score, 0) AS score, 5 AS threshold, array_to_string(sig, '|') AS signals, "
                            f"COALESCE(score, 0) >= 5 AS needs_js FROM ({JS_SQL})"))
def q_js_detect(spark, d):
    j = js_scores(spark, d)
    return j.select("page_id", "js.score", "js.threshold", F.array_join("js.signals", "|").alias("signals"), "js.needs_js")


@register("js_mode_decision", sql=(
    f"SELECT j.page_id, j.js_mode, CASE WHEN j.js_mode = 'always' THEN true WHEN w.action = 'dismiss' THEN true "
    f"WHEN j.js_mode = 'auto' THEN COALESCE(j.score, 0) >= 5 ELSE false END AS render FROM ("
    f"SELECT page_id, score, CASE page_id % 3 WHEN 0 THEN 'auto' WHEN 1 THEN 'always' ELSE 'never' END AS js_mode "
    f"FROM ({JS_SQL})) j JOIN ({WALL_SQL}) w ON w.page_id = j.page_id"))
def q_js_mode_decision(spark, d):
    j = js_scores(spark, d).withColumn("_lc", F.lower("html"))
    j = j.withColumn("w", D.wall_detect("http_status", "headers", "cookie_names", "_lc", "final_url", body_is_lower=True))
    mode = F.when(F.col("page_id") % 3 == 0, "auto").when(F.col("page_id") % 3 == 1, "always").otherwise("never")
    j = j.withColumn("js_mode", mode)
    return j.select("page_id", "js_mode",
                    D.js_mode_decision("js_mode", F.col("w"), F.col("html").isNotNull(), F.col("js.needs_js")).alias("render"))
