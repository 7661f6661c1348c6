"""Page-quality detectors: blocking walls (D1, D2), JS-rendered pages (D3),
fetch outcome (D4), render decision (D6), wall summary (D7).

Each detector is an expression over the response row: an ordered
``CASE WHEN`` cascade (evaluated lazily, first match wins) with the body
lower-cased, or its markup made plain, once in a projection below it. No UDF, no shuffle.
"""

from __future__ import annotations

import re
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT, EngineConfig
from ..functions.elements_udf import VOID
from ..functions.html import entity_decode, pystrip, strip_raw_text
from ..plans.windows import row_barrier

# --------------------------------------------------------------------------
# FIXED VALUES -- wall body patterns (matched on the lower-cased body).
# --------------------------------------------------------------------------
CF_BODY = ["checking your browser", "please wait while we check your browser", "ddos-guard",
           "cloudflare ray id", "cf-browser-verification", "enable javascript and cookies to continue",
           "attention required! | cloudflare"]
RECAPTCHA = ["grecaptcha", "recaptcha/api.js", "data-sitekey", "g-recaptcha", "recaptcha.net/recaptcha"]
HCAPTCHA = ["hcaptcha.com/1/api.js", "data-hcaptcha-sitekey", "hcaptcha-challenge"]
DATADOME = ["datadome", "dd_referrer", "device-is-challenged"]
PERIMETERX = ["perimeterx", "_pxhd", "px-captcha", "human.px-cdn.net"]
LOGIN_BODY = ['type="password"', "login-form", "signin-form", "sign-in-form", 'action="/login"',
              'action="/signin"', 'action="/sign-in"', "you must be logged in", "please log in to continue",
              "please sign in to continue", "members only"]
PAYWALL = ["subscribe to read", "subscribe to continue", "subscription required", "become a member to read",
           "this article is for subscribers", "piano.io", "tinypass.com", "unlock this article", "premium content"]
CONSENT = ["cookieconsent", "cookie-consent", "cookie_consent", "gdpr-consent", "cookiebot", "onetrust",
           "onetrust-accept-btn", "cc-allow", "js-cookie-consent", "accept all cookies", "accept cookies"]
SESSION = ["session expired", "session has expired", "your session has timed out", "session timeout",
           "please login again", "token expired", "authentication expired"]
LOGIN_URL_RE = r"(?i)(/login|/signin|/sign-in|/auth/|/account/login|[?&]redirect|[?&]next=|[?&]return=)"
CF_COOKIES = ["__cf_bm", "cf_clearance"]
DD_COOKIES = ["datadome", "_dd_s"]
PX_COOKIES = ["_px3", "_pxhd", "_pxvid"]

# JS signals (case-sensitive on the raw html), in test order.
SPA_GLOBALS = ["window.__INITIAL_STATE__", "window.__NEXT_DATA__", "window.__NUXT__", "window.__REDUX_STATE__",
               "__svelte", "window.__APP_STATE__"]
REACT = ["data-reactroot", "_next/static/", "react.production.min.js"]
VUE = ["vue.min.js", "vue.runtime.min.js", "__vue_store__"]
ANGULAR = ["ng-version", "angular.min.js"]
ROOT_IDS = ["root", "app", "__next", "app-root", "vue-app"]
POWERED_BY = ["next.js", "nuxt", "angular"]
NOSCRIPT_MIN_CHARS = 30
MIN_BODY_TEXT_CHARS = 150
ROOT_MAX_CHARS = 20
# --------------------------------------------------------------------------


def _any_contains(s: Column, pats: list[str]) -> Column:
    return reduce(or_, [s.contains(p) for p in pats])


def _first_contained(s: Column, pats: list[str]) -> Column:
    """First pattern (list order) contained in ``s``, else NULL."""
    out = F.lit(None).cast("string")
    for p in reversed(pats):
        out = F.when(s.contains(p), F.lit(p)).otherwise(out)
    return out


def _wall(t: str, action: str, conf: str, signals: Column, retry: Column | None = None) -> Column:
    return F.struct(F.lit(t).alias("wall_type"), F.lit(action).alias("action"), F.lit(conf).alias("confidence"),
                    signals.alias("signals"),
                    (retry if retry is not None else F.lit(None).cast("double")).alias("retry_after_seconds"),
                    F.lit(action != "none").alias("is_blocked"))


def retry_after(headers_lc: Column) -> tuple[Column, Column]:
    """(parsed header value or NULL, back-off seconds). Unparsable -> 60;
    missing or 0 -> 60."""
    raw = F.element_at(headers_lc, F.lit("retry-after"))
    val = F.when(raw.isNull(), F.lit(None).cast("double")).otherwise(
        F.coalesce(raw.try_cast("double"), F.lit(60.0)))
    secs = F.when(val.isNull() | (val == 0), F.lit(60.0)).otherwise(val)
    return val, secs


def wall_detect(status, headers, cookies, html, final_url, body_is_lower: bool = False) -> Column:
    """struct(wall_type, action, confidence, signals, retry_after_seconds,
    is_blocked) by the 17-step first-match cascade. Pass an already
    lower-cased body (projected once below) with ``body_is_lower``."""
    s = F.col(status) if isinstance(status, str) else status
    h = F.transform_values(F.transform_keys(F.col(headers) if isinstance(headers, str) else headers,
                                            lambda k, v: F.lower(k)), lambda k, v: F.lower(v))
    c = F.transform(F.col(cookies) if isinstance(cookies, str) else cookies, lambda x: F.lower(x))
    b = F.col(html) if isinstance(html, str) else html
    b = b if body_is_lower else F.lower(b)
    fu = F.col(final_url) if isinstance(final_url, str) else final_url

    has_cf_ray = F.map_contains_key(h, "cf-ray")
    has_cf_cookie = F.arrays_overlap(c, F.array(*[F.lit(x) for x in CF_COOKIES]))
    cf_body = _any_contains(b, CF_BODY)
    has_dd_header = F.map_contains_key(h, "x-datadome") | F.map_contains_key(h, "x-dd-b")
    has_dd_cookie = F.arrays_overlap(c, F.array(*[F.lit(x) for x in DD_COOKIES]))
    has_px_cookie = F.arrays_overlap(c, F.array(*[F.lit(x) for x in PX_COOKIES]))
    st = s.cast("string")
    blocked_401_403 = s.isin(401, 403)

    ra_val, ra_secs = retry_after(h)
    ra_text = F.coalesce(ra_val.cast("string"), F.lit("None"))

    cf1_sig = F.when(cf_body, F.array(F.concat(F.lit("cf-ray header + HTTP "), st), F.lit("cloudflare challenge body text"))) \
        .otherwise(F.array(F.concat(F.lit("cf-ray header + HTTP "), st)))
    return (
        F.when(has_cf_ray & s.isin(403, 429, 503), _wall("cloudflare", "skip", "high", cf1_sig))
        .when(has_cf_cookie & cf_body, _wall("cloudflare", "skip", "high", F.array(F.lit("__cf_bm cookie + challenge body"))))
        .when(cf_body & s.isin(403, 503), _wall("cloudflare", "skip", "medium", F.array(F.lit("cloudflare challenge body only"))))
        .when(_any_contains(b, RECAPTCHA), _wall("recaptcha", "skip", "high", F.array(F.lit("recaptcha scripts/attributes in body"))))
        .when(_any_contains(b, HCAPTCHA), _wall("hcaptcha", "skip", "high", F.array(F.lit("hcaptcha scripts/attributes in body"))))
        .when(has_dd_header | (has_dd_cookie & blocked_401_403),
              _wall("datadome", "skip", "high", F.array(F.concat(F.lit("datadome header/cookie + HTTP "), st))))
        .when(_any_contains(b, DATADOME) & blocked_401_403,
              _wall("datadome", "skip", "medium", F.array(F.lit("datadome body pattern + blocked status"))))
        .when(has_px_cookie & blocked_401_403,
              _wall("perimeterx", "skip", "high", F.array(F.concat(F.lit("perimeterx cookie + HTTP "), st))))
        .when(_any_contains(b, PERIMETERX) & blocked_401_403,
              _wall("perimeterx", "skip", "medium", F.array(F.lit("perimeterx body pattern + blocked status"))))
        .when(s == 429, _wall("rate_limit", "retry", "high",
                              F.array(F.concat(F.lit("HTTP 429 Too Many Requests (retry-after: "), ra_text, F.lit("s)"))),
                              ra_secs))
        .when((s == 403) & ~has_cf_ray & ~has_dd_header,
              _wall("ip_ban", "skip", "low", F.array(F.lit("HTTP 403 with no known bot-detection headers"))))
        .when(_any_contains(b, SESSION), _wall("session_expired", "login", "high", F.array(F.lit("session-expired text in body"))))
        .when(fu.isNotNull() & fu.rlike(LOGIN_URL_RE),
              _wall("login_wall", "login", "high", F.array(F.concat(F.lit("redirected to login URL: "), fu))))
        .when(_any_contains(b, LOGIN_BODY), _wall("login_wall", "login", "medium", F.array(F.lit("login form detected in body"))))
        .when(_any_contains(b, PAYWALL), _wall("paywall", "skip", "medium", F.array(F.lit("paywall text detected in body"))))
        .when(_any_contains(b, CONSENT), _wall("cookie_consent", "dismiss", "medium", F.array(F.lit("cookie consent widget detected"))))
        .otherwise(_wall("none", "none", "high", F.array().cast("array<string>")))
    )


def _text_len(fragment_src: Column, sep_len: int) -> Column:
    """Length of ``get_text(strip=True, separator=...)``: fragments between
    tags, entity-decoded and stripped, blanks dropped, joined by a separator
    of ``sep_len`` chars."""
    frags = F.filter(F.transform(F.split(fragment_src, "<[^>]*>"), lambda x: pystrip(entity_decode(x))),
                     lambda x: x != "")
    total = F.aggregate(frags, F.lit(0), lambda acc, x: acc + F.length(x))
    return F.when(F.size(frags) > 0, total + (F.size(frags) - 1) * sep_len).otherwise(F.lit(0))


def _root_opener(rid: str) -> str:
    """Start tag of an element with the id, its name in group 1; markup is plain."""
    return r"""(?is)<([a-z][a-z0-9-]*)\s(?:[^>]*?\s)?id\s*=\s*(?:"RID"[^>]*|'RID'[^>]*|RID(?:[\s/][^>]*)?)>""".replace("RID", re.escape(rid))


def _root_text_len(plain: Column, rid: str) -> Column:
    """Text length of the first element with id=rid (NULL when absent). The element ends where the depth of tags of its own
    name is back at nought, or with the page."""
    opener = F.regexp_extract(plain, _root_opener(rid), 0)
    tag = F.lower(F.regexp_extract(plain, _root_opener(rid), 1))
    # the blank in front keeps the first piece free of a tag
    after = F.concat(F.lit(" "), F.substring(plain, F.position(opener, plain) + F.length(opener), F.length(plain)))
    pieces = F.split(after, F.concat(F.lit("(?i)(?=</?"), tag, F.lit(r"[\s/>])")))
    start = F.struct(F.lit(1).alias("depth"), F.lit(0).alias("i"), F.lit(0).alias("n"))

    def step(acc, x):
        depth = acc["depth"] + F.when(acc["i"] == 0, 0).when(x.startswith("</"), -1).otherwise(1)
        open_ = (acc["depth"] > 0) & (depth > 0)
        return F.struct(F.when(acc["depth"] > 0, depth).otherwise(0).alias("depth"), (acc["i"] + 1).alias("i"), F.when(open_, acc["n"] + 1).otherwise(acc["n"]).alias("n"))
    kept = F.aggregate(pieces, start, step, lambda acc: acc["n"])
    inner = F.array_join(F.slice(pieces, F.lit(1), kept), "")
    return F.when(opener != "", F.when(tag.isin(*sorted(VOID)), F.lit(0)).otherwise(_text_len(inner, 0)))


def body_region(plain: Column) -> Column:
    """Body content of plain markup."""
    after = F.regexp_extract(plain, r"(?is)<body\b[^>]*>(.*)$", 1)
    region = F.when(plain.rlike(r"(?i)<body\b"), after).otherwise(plain)
    return F.regexp_replace(region, r"(?is)</body\s*>.*$", "")


#: Some element with one of the root ids, as far as a glance tells.
ROOT_RE = r"""(?i)\sid\s*=\s*["']?(?:""" + "|".join(re.escape(i) for i in ROOT_IDS) + r""")["'\s/>]"""


def js_detect(df: DataFrame, html: str, headers: str | None = None, n_blocks: Column | None = None, out: str = "js", cfg: EngineConfig = DEFAULT) -> DataFrame:
    """D3: ``out`` = struct(score, threshold, signals, needs_js). The page's markup is made plain once, in a step of its own, and
    everything that concerns elements reads that; the globals are looked for in the page as it is."""
    d = row_barrier(df.withColumn("_plain", strip_raw_text(F.col(html))))
    raw, plain = F.col(html), F.col("_plain")
    root = F.lit(None).cast("string")
    for rid in reversed(ROOT_IDS):
        root = F.when(_root_text_len(plain, rid) < ROOT_MAX_CHARS, F.lit(f"empty_root_#{rid}(+3)")).otherwise(root)
    # Letters and digits outside tags and entities survive decoding and
    # stripping, so they bound the body text length from below: long bodies
    # skip the exact (per-fragment decode) length.
    region = body_region(plain)
    lower_bound = F.length(F.regexp_replace(F.regexp_replace(region, r"<[^>]*>|&[#a-zA-Z0-9]+;", ""), r"[^\p{L}\p{N}]", ""))
    d = row_barrier(d.withColumn("_root", F.when(plain.rlike(ROOT_RE), root)).withColumn(
        "_thin", F.when(lower_bound >= MIN_BODY_TEXT_CHARS, F.lit(MIN_BODY_TEXT_CHARS)).otherwise(_text_len(region, 1))))

    sig: list[tuple[Column, Column]] = []   # (points, signal text or NULL)

    def signal(points: int, text: Column) -> None:
        sig.append((F.when(text.isNotNull(), points), text))
    if n_blocks is not None:
        signal(4, F.when(n_blocks == 0, F.lit("no_content_extracted(+4)")))
    signal(3, F.col("_root"))
    nos = F.regexp_extract_all(plain, F.lit(r"(?is)<noscript\b[^>]*>(.*?)</noscript\s*>"), 1)
    signal(3, F.when(plain.contains("noscript") | plain.contains("NOSCRIPT"), F.when(F.exists(nos, lambda x: _text_len(x, 0) >= NOSCRIPT_MIN_CHARS), F.lit("noscript_content(+3)"))))
    for prefix, pats in (("spa_global", SPA_GLOBALS), ("react", REACT), ("vue", VUE)):
        signal(2, F.concat(F.lit(prefix + ":"), _first_contained(raw, pats), F.lit("(+2)")))
    signal(2, F.when(plain.rlike(r"""(?i)\sclass\s*=\s*(?:"(?:[^"]*\s)?data-v-|'(?:[^']*\s)?data-v-|data-v-)"""), F.lit("vue:data-v-attr(+2)")))
    signal(2, F.concat(F.lit("angular:"), _first_contained(raw, ANGULAR), F.lit("(+2)")))
    signal(2, F.when(F.col("_thin") < MIN_BODY_TEXT_CHARS, F.concat(F.lit("thin_body:"), F.col("_thin").cast("string"), F.lit("chars(+2)"))))
    if headers is not None:
        pb = F.lower(F.element_at(F.transform_keys(F.col(headers), lambda k, v: F.lower(k)), F.lit("x-powered-by")))
        signal(1, F.when(F.coalesce(_any_contains(pb, POWERED_BY), F.lit(False)), F.concat(F.lit("x-powered-by:"), pb, F.lit("(+1)"))))
    score = reduce(lambda a, b: a + b, [F.coalesce(p, F.lit(0)) for p, _ in sig])
    signals = F.filter(F.array(*[t for _, t in sig]), lambda x: x.isNotNull())
    thr = int(cfg.js_detection_threshold)
    res = F.struct(score.cast("int").alias("score"), F.lit(thr).alias("threshold"), signals.alias("signals"), (score >= thr).alias("needs_js"))
    return d.withColumn(out, res).drop("_plain", "_root", "_thin")


def fetch_outcome(status, wall: Column) -> Column:
    """struct(outcome, error) of a fetched response after wall detection."""
    s = F.col(status) if isinstance(status, str) else status
    a, t = wall["action"], wall["wall_type"]
    return (F.when(a == "skip", F.struct(F.lit("skip").alias("outcome"),
                                         F.concat(F.lit("Wall blocked ("), t, F.lit("): "),
                                                  F.array_join(wall["signals"], "; ")).alias("error")))
            .when(a == "retry", F.struct(F.lit("retry").alias("outcome"), F.lit(None).cast("string").alias("error")))
            .when(a == "login", F.struct(F.lit("login").alias("outcome"),
                                         F.concat(F.lit("Auth wall ("), t,
                                                  F.lit(") — no valid session. Add credentials in the UI.")).alias("error")))
            .when(s == 200, F.struct(F.lit("success").alias("outcome"), F.lit(None).cast("string").alias("error")))
            .when(s.isin(301, 302, 303, 307, 308), F.struct(F.lit("redirect").alias("outcome"),
                                                            F.concat(F.lit("Redirect "), s.cast("string")).alias("error")))
            .otherwise(F.struct(F.lit("http_error").alias("outcome"),
                                F.concat(F.lit("HTTP "), s.cast("string")).alias("error"))))


def js_mode_decision(js_mode, wall: Column, has_html: Column, needs_js: Column) -> Column:
    """Render with a browser? always -> yes; dismissable wall -> yes;
    auto -> detector verdict; never -> no."""
    m = F.col(js_mode) if isinstance(js_mode, str) else js_mode
    return (F.when(m == "always", True)
            .when(wall["action"] == "dismiss", True)
            .when((m == "auto") & has_html, needs_js)
            .otherwise(False))


def wall_summary(walls: DataFrame) -> DataFrame:
    """Count per (wall_type, action)."""
    return walls.groupBy("wall_type", "action").agg(F.count(F.lit(1)).cast("bigint").alias("count"))
