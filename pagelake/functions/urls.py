"""URL column functions.

All are pure Column expressions -- they run inside the scan's projection with
no shuffle. Parsing follows RFC 3986 appendix B (one regex), resolution follows
the standard-library ``urljoin`` rules (RFC 3986 section 5.2 merge and
dot-segment removal), including its quirks:

* a href with a different scheme is returned unchanged;
* empty middle segments of a merged relative path are dropped;
* ``..`` above the root is ignored.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# RFC 3986 appendix B, with the scheme restricted to a valid scheme token.
URL_RE = r"^(([A-Za-z][A-Za-z0-9+.\-]*):)?(//([^/?#]*))?([^?#]*)(\?([^#]*))?(#(.*))?$"
SPECIAL_PREFIXES = ["javascript:", "mailto:", "tel:", "data:", "#"]


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def url_parse(u) -> Column:
    """struct(scheme, has_netloc, netloc, path, query, fragment)."""
    u = _c(u)
    return F.struct(
        F.lower(F.regexp_extract(u, URL_RE, 2)).alias("scheme"),
        (F.regexp_extract(u, URL_RE, 3) != "").alias("has_netloc"),
        F.regexp_extract(u, URL_RE, 4).alias("netloc"),
        F.regexp_extract(u, URL_RE, 5).alias("path"),
        F.regexp_extract(u, URL_RE, 7).alias("query"),
        F.regexp_extract(u, URL_RE, 9).alias("fragment"),
    )


def _remove_dot_segments(segs: Column) -> Column:
    folded = F.aggregate(
        segs, F.array().cast("array<string>"),
        lambda acc, s: F.when(s == "..", F.when(F.size(acc) > 0, F.slice(acc, 1, F.size(acc) - 1))
                              .otherwise(acc))
        .when(s == ".", acc)
        .otherwise(F.concat(acc, F.array(s))))
    last = F.element_at(segs, -1)
    folded = F.when(last.isin(".", ".."), F.concat(folded, F.array(F.lit("")))).otherwise(folded)
    joined = F.array_join(folded, "/")
    return F.when(joined == "", F.lit("/")).otherwise(joined)


def _merge_path(bpath: Column, hpath: Column) -> Column:
    bparts = F.split(bpath, "/")
    bdir = F.when(F.element_at(bparts, -1) != "", F.slice(bparts, 1, F.size(bparts) - 1)).otherwise(bparts)
    segs = F.concat(bdir, F.split(hpath, "/"))
    n = F.size(segs)
    middle = F.filter(F.slice(segs, 2, F.greatest(n - 2, F.lit(0))), lambda s: s != "")
    squeezed = F.when(n >= 2, F.concat(F.slice(segs, 1, 1), middle, F.slice(segs, -1, 1))).otherwise(segs)
    rooted = F.split(hpath, "/")
    segs2 = F.when(hpath.startswith("/"), rooted).otherwise(squeezed)
    # Only pay for the fold when a dot segment can be present.
    has_dots = F.exists(segs2, lambda s: s.isin(".", ".."))
    return F.when(has_dots, _remove_dot_segments(segs2)).otherwise(
        F.when(F.array_join(segs2, "/") == "", F.lit("/")).otherwise(F.array_join(segs2, "/")))


def join_from(h: Column, b: Column) -> Column:
    """Resolve parsed href ``h`` against parsed base ``b`` (both ``url_parse``
    structs, passed as column or lambda references so nothing is duplicated).
    Returns struct(scheme, netloc, has_netloc, path, query, fragment)."""
    hs = F.when(h["scheme"] != "", h["scheme"]).otherwise(b["scheme"])
    other_scheme = hs != b["scheme"]
    own_netloc = h["has_netloc"]
    empty_path = h["path"] == ""
    path = (F.when(own_netloc, h["path"])
            .when(empty_path, b["path"])
            .otherwise(_merge_path(b["path"], h["path"])))
    query = F.when(own_netloc | ~empty_path | (h["query"] != ""), h["query"]).otherwise(b["query"])
    netloc = F.when(own_netloc, h["netloc"]).otherwise(b["netloc"])
    return F.struct(
        F.when(other_scheme, h["scheme"]).otherwise(hs).alias("scheme"),
        F.when(other_scheme, h["netloc"]).otherwise(netloc).alias("netloc"),
        F.when(other_scheme, h["has_netloc"]).otherwise(own_netloc | b["has_netloc"]).alias("has_netloc"),
        F.when(other_scheme, h["path"]).otherwise(path).alias("path"),
        F.when(other_scheme, h["query"]).otherwise(query).alias("query"),
        h["fragment"].alias("fragment"),
    )


def _unparse(scheme: Column, has_netloc: Column, netloc: Column, path: Column, query: Column,
             fragment: Column | None = None) -> Column:
    p = F.when(has_netloc & (path != "") & ~path.startswith("/"), F.concat(F.lit("/"), path)).otherwise(path)
    auth = F.when(has_netloc | scheme.isin("http", "https"), F.concat(F.lit("//"), netloc, p)).otherwise(p)
    s = F.when(scheme != "", F.concat(scheme, F.lit(":"), auth)).otherwise(auth)
    s = F.when(query != "", F.concat(s, F.lit("?"), query)).otherwise(s)
    if fragment is not None:
        s = F.when(fragment != "", F.concat(s, F.lit("#"), fragment)).otherwise(s)
    return s


def unparse_joined(j: Column) -> Column:
    """U2 output text of a ``join_from`` struct reference."""
    return _unparse(j["scheme"], j["has_netloc"], j["netloc"], j["path"], j["query"], j["fragment"])


def normalize_joined(href: Column, j: Column) -> Column:
    """U3 from the raw href and its ``join_from`` struct reference."""
    special = F.lit(False)
    for p in SPECIAL_PREFIXES:
        special = special | href.startswith(p)
    path = F.regexp_replace(j["path"], "/+$", "")
    path = F.when(path == "", F.lit("/")).otherwise(path)
    out = _unparse(j["scheme"], F.lit(True), F.lower(j["netloc"]), path, j["query"])
    ok = ~special & j["scheme"].isin("http", "https") & (j["netloc"] != "")
    return F.when(ok, out)


def normalize_array(hrefs: Column, base: Column) -> Column:
    """U3 over an array of hrefs sharing one base, staged with transforms so
    each stage references only fields of the previous one."""
    bp = url_parse(base)
    parsed = F.transform(hrefs, lambda h: F.struct(h.alias("raw"), url_parse(h).alias("p")))
    joined = F.transform(parsed, lambda x: F.struct(x["raw"].alias("raw"), join_from(x["p"], bp).alias("j")))
    return F.transform(joined, lambda x: normalize_joined(x["raw"], x["j"]))


def add_url_join(df, base: str, href: str, out: str, normalize: bool = False):
    """Stage U2/U3 on a DataFrame: parse both, join, then unparse or normalise."""
    df = df.withColumn("_uh", url_parse(href)).withColumn("_ub", url_parse(base))
    df = df.withColumn("_uj", join_from(F.col("_uh"), F.col("_ub")))
    res = normalize_joined(F.col(href), F.col("_uj")) if normalize else unparse_joined(F.col("_uj"))
    return df.withColumn(out, res).drop("_uh", "_ub", "_uj")


def url_normalize(href, base) -> Column:
    """U3 as a single expression. Its tree repeats the parse per field, so
    prefer ``add_url_join`` (staged columns) or ``normalize_array``."""
    h = _c(href)
    return normalize_joined(h, join_from(url_parse(h), url_parse(base)))


def url_domain(u) -> Column:
    """U4: lower-cased netloc up to the first ':'."""
    return F.split(F.lower(url_parse(u)["netloc"]), ":").getItem(0)


def session_domain(u) -> Column:
    """U4 for session matching: the netloc or, without one, the first path
    segment; lower-cased, up to the first ':'."""
    p = url_parse(u)
    host = F.when(p["netloc"] != "", p["netloc"]).otherwise(F.substring_index(p["path"], "/", 1))
    return F.lower(F.substring_index(host, ":", 1))


# A path's parameters: what follows the first ';' of its last segment.
PARAMS_RE = ";([^/]*)$"


def path_params(path) -> Column:
    """The parameters of a path ('' without any)."""
    return F.regexp_extract(_c(path), PARAMS_RE, 1)


def without_params(path) -> Column:
    return F.regexp_replace(_c(path), PARAMS_RE, "")


def domain_parts(host) -> Column:
    """Host split on '.' and '-', empties dropped."""
    return F.filter(F.split(_c(host), r"[.\-]"), lambda s: s != "")


# ---------------------------------------------------------------------------
# DuckDB twins (SQL text) for the oracle.
# ---------------------------------------------------------------------------
SQL_URL_RE = URL_RE.replace("'", "''")


def sql_part(u: str, g: int) -> str:
    return f"regexp_extract({u}, '{SQL_URL_RE}', {g})"


def sql_domain(u: str) -> str:
    return f"split_part(lower({sql_part(u, 4)}), ':', 1)"


def sql_join_parts(href: str, base: str) -> dict:
    """DuckDB twin of ``url_join_parts``: dict of SQL expressions."""
    hs, hn, hnl, hp, hq, hf = (f"lower({sql_part(href, 2)})", sql_part(href, 3), sql_part(href, 4),
                               sql_part(href, 5), sql_part(href, 7), sql_part(href, 9))
    bs, bn, bnl, bp, bq = (f"lower({sql_part(base, 2)})", sql_part(base, 3), sql_part(base, 4),
                           sql_part(base, 5), sql_part(base, 7))
    scheme = f"(CASE WHEN {hs} <> '' THEN {hs} ELSE {bs} END)"
    other = f"({scheme} <> {bs})"
    merged = (f"CASE WHEN starts_with({hp}, '/') THEN string_split({hp}, '/') ELSE "
              f"(SELECT CASE WHEN len(s) >= 2 THEN list_concat(s[1:1], list_filter(s[2:len(s)-1], lambda x: x <> ''), s[len(s):len(s)]) ELSE s END "
              f"FROM (SELECT list_concat(CASE WHEN bp[len(bp)] <> '' THEN bp[1:len(bp)-1] ELSE bp END, string_split({hp}, '/')) AS s "
              f"FROM (SELECT string_split({bp}, '/') AS bp))) END")
    folded = (f"(SELECT CASE WHEN list_contains(segs, '.') OR list_contains(segs, '..') THEN "
              f"(SELECT CASE WHEN j = '' THEN '/' ELSE j END FROM (SELECT array_to_string(CASE WHEN segs[len(segs)] IN ('.', '..') THEN list_append(f, '') ELSE f END, '/') AS j "
              f"FROM (SELECT list_reduce(segs, lambda acc, x: CASE WHEN x = '..' THEN (CASE WHEN len(acc) > 0 THEN acc[1:len(acc)-1] ELSE acc END) "
              f"WHEN x = '.' THEN acc ELSE list_append(acc, x) END, []::VARCHAR[]) AS f))) "
              f"ELSE (CASE WHEN array_to_string(segs, '/') = '' THEN '/' ELSE array_to_string(segs, '/') END) END "
              f"FROM (SELECT {merged} AS segs))")
    path = f"CASE WHEN {hn} <> '' THEN {hp} WHEN {hp} = '' THEN {bp} ELSE {folded} END"
    query = f"CASE WHEN {hn} <> '' OR {hp} <> '' OR {hq} <> '' THEN {hq} ELSE {bq} END"
    netloc = f"CASE WHEN {hn} <> '' THEN {hnl} ELSE {bnl} END"
    return {
        "scheme": f"(CASE WHEN {other} THEN {hs} ELSE {scheme} END)",
        "netloc": f"(CASE WHEN {other} THEN {hnl} ELSE {netloc} END)",
        "has_netloc": f"(CASE WHEN {other} THEN {hn} <> '' ELSE ({hn} <> '' OR {bn} <> '') END)",
        "path": f"(CASE WHEN {other} THEN {hp} ELSE {path} END)",
        "query": f"(CASE WHEN {other} THEN {hq} ELSE {query} END)",
        "fragment": hf,
    }


def _sql_unparse(scheme, has_netloc, netloc, path, query, fragment=None) -> str:
    p = f"(CASE WHEN {has_netloc} AND {path} <> '' AND NOT starts_with({path}, '/') THEN '/' || {path} ELSE {path} END)"
    auth = f"(CASE WHEN {has_netloc} OR {scheme} IN ('http', 'https') THEN '//' || {netloc} || {p} ELSE {p} END)"
    s = f"(CASE WHEN {scheme} <> '' THEN {scheme} || ':' || {auth} ELSE {auth} END)"
    s = f"({s} || CASE WHEN {query} <> '' THEN '?' || {query} ELSE '' END)"
    if fragment is not None:
        s = f"({s} || CASE WHEN {fragment} <> '' THEN '#' || {fragment} ELSE '' END)"
    return s


def sql_join(href: str, base: str) -> str:
    j = sql_join_parts(href, base)
    return _sql_unparse(j["scheme"], j["has_netloc"], j["netloc"], j["path"], j["query"], j["fragment"])


def sql_normalize(href: str, base: str) -> str:
    """DuckDB twin of ``url_normalize``."""
    j = sql_join_parts(href, base)
    p0 = f"regexp_replace({j['path']}, '/+$', '')"
    path = f"(CASE WHEN {p0} = '' THEN '/' ELSE {p0} END)"
    out = _sql_unparse(j["scheme"], "TRUE", f"lower({j['netloc']})", path, j["query"])
    special = " OR ".join(f"starts_with({href}, '{p}')" for p in SPECIAL_PREFIXES)
    return (f"(CASE WHEN NOT ({special}) AND {j['scheme']} IN ('http', 'https') AND {j['netloc']} <> '' "
            f"THEN {out} END)")
