"""Queries: HTML tokens and elements (H1, H2), title (H3), main content and
stripping (H4-H8), blocks (H9-H22), entities (H24), block counts (A13).

The DuckDB twins rebuild the same per-page piece model relationally (pieces
as rows, spans by correlated lookups) -- a different route to the same rows.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..config import DEFAULT
from ..functions import html as H
from ..functions.html import sql_entity_decode as DEC
from ..functions.html import sql_pystrip as STRIP
from ..operators import blocks as B
from ..sources.tables import read_table
from .registry import register

CFG = DEFAULT
WS = H.WS


# ------------------------------------------------------------- inputs
# Every page's article gets elements that its page id chooses, so that all
# rules have rows: nested sidebars, hidden parts, lists in lists, code of every
# tag, headers, ads in ads, quotes, a second article.
EXTRA = [
    '<div class="left sidebar"><div>side @</div>REST @</div><p id="cookie-banner">We use cookies @</p><pre class="sidebar code">kept = {@};</pre>',
    '<div style="display: none"><div>hidden @</div>still hidden</div><ul><li>one @<ul><li>in</li></ul>tail</li><li>two</li></ul><ol><li>first</li></ol>',
    '<pre class="language-python">def f@(x):\n    return x</pre><code class="js">let a = @;</code><samp>out @</samp><kbd>Ctrl-@</kbd><div data-lang="rb">x = {a: [@], b: {c: 1}};</div>',
    '<header><h2>Head @</h2></header><div class="ad-box">Buy item @ now<div class="promo">Promo number @ today</div></div><div class="hljs">SELECT @ FROM t</div>',
    '<section><p>Section @ holds enough words to pass the gate of paragraphs</p><blockquote>Quote @ <p>deep words</p> after</blockquote>end of it</section><noscript>Enable scripts</noscript>',
    '<span class="popup">pop @</span><div style="visibility:hidden">x</div><td class="terminal">$ cd /tmp/@; ls -l | grep "x" > out.txt</td>',
]
SECOND = "<article><h2>Second @</h2><p>Another article @ with quite a few words of its own, more than twenty of them, so that it is kept beside the first one on any page</p></article>"


def pages(spark, d):
    p = read_table(spark, d, "pages").select("page_id", "url", "html")
    extra = F.element_at(F.array(*[F.lit(x) for x in EXTRA]), (F.col("page_id") % len(EXTRA) + 1).cast("int"))
    second = F.when(F.col("page_id") % 4 == 0, F.lit(SECOND)).otherwise(F.lit(""))
    more = F.replace(F.concat(extra, F.lit("</article>"), second), F.lit("@"), F.col("page_id").cast("string"))
    return p.select("page_id", "url", F.replace("html", F.lit("</article>"), more).alias("html"))


def _sql_text(x: str) -> str:
    return " || chr(10) || ".join("'" + part.replace("'", "''") + "'" for part in x.split("\n"))


SQL_EXTRA = "[" + ", ".join(_sql_text(x) for x in EXTRA) + f"][page_id % {len(EXTRA)} + 1]"
SQL_VPAGES = (f"(SELECT page_id, url, replace(html, '</article>', replace({SQL_EXTRA} || '</article>' || CASE WHEN page_id % 4 = 0 THEN {_sql_text(SECOND)} "
              f"ELSE '' END, '@', CAST(page_id AS VARCHAR))) AS html FROM pages)")


def elements(spark, d):
    return B.with_elements(pages(spark, d).where(H.pystrip(F.col("html")) != ""), "html", CFG)


# ------------------------------------------------------------- DuckDB pieces
def q(s: str) -> str:
    return s.replace("'", "''")


def sql_frags(x: str) -> str:
    return (f"list_filter(list_transform(regexp_split_to_array({x}, '<[^>]*>'), lambda fz: {STRIP(DEC('fz'))}), "
            f"lambda fz: fz <> '')")


def sql_format_text(x: str, br: bool = True) -> str:
    y = f"regexp_replace({x}, '(?i)<br\\s*/?>', chr(10), 'g')" if br else x
    return DEC(f"regexp_replace({y}, '<[^>]*>', '', 'g')")


def sql_word_count(s: str) -> str:
    t = STRIP(s)
    return f"(CASE WHEN {t} = '' THEN 0 ELSE len(regexp_split_to_array({t}, '{WS}+')) END)"


def sql_attr(opener: str, pattern: str) -> str:
    p = q(pattern)
    return f"(regexp_extract({opener}, '{p}', 1) || regexp_extract({opener}, '{p}', 2) || regexp_extract({opener}, '{p}', 3))"


def sql_code_class(opener: str) -> str:
    cls = f"lower({sql_attr(opener, B.CLASS_RE)})"
    sty = f"lower({sql_attr(opener, B.STYLE_RE)})"
    return "(" + " OR ".join([f"contains({cls}, '{c}')" for c in B.CODE_CLASSES] +
                             [f"contains({sty}, 'monospace')", f"contains({sty}, 'courier')"]) + ")"


def sql_density_code(t: str) -> str:
    d = f"(length(regexp_replace({t}, '{B.symbol_class(CFG)}', '', 'g')) / length({t}))"
    lines = f"list_filter(string_split({t}, chr(10)), lambda ln: {STRIP('ln')} <> '')"
    ind = (f"(len(list_filter({lines}, lambda ln: starts_with(ln, '  ') OR starts_with(ln, chr(9)))) / "
           f"greatest(len({lines}), 1))")
    low = CFG.min_symbol_density * 0.6
    return (f"(length({STRIP(t)}) >= 20 AND length({t}) > 0 AND ({d} >= {CFG.min_symbol_density!r} OR "
            f"({d} >= {low!r} AND {ind} >= 0.4)))")


def sql_tokens(src: str) -> str:
    """(page_id, x, i, t, key, tag, e) of the tags and texts of rows (page_id, x): e is the place after the element's own end
    tag, matched by the depth of its name (the page's end without one)."""
    return (f"SELECT page_id, x, i, t, key, tag, CASE WHEN key <> '' AND NOT starts_with(key, '/') AND nk = '/' || tag THEN ni + 1 ELSE n END AS e FROM ("
            f"SELECT *, lead(key) OVER lv AS nk, lead(i) OVER lv AS ni, count(*) OVER (PARTITION BY page_id) AS n FROM ("
            f"SELECT *, sum(CASE WHEN key = '' THEN 0 WHEN starts_with(key, '/') THEN -1 ELSE 1 END) OVER (PARTITION BY page_id, tag ORDER BY i) + "
            f"CASE WHEN starts_with(key, '/') THEN 1 ELSE 0 END AS lvl FROM (SELECT *, regexp_replace(key, '^/', '') AS tag FROM ("
            f"SELECT page_id, x, i, t, lower(regexp_extract(t, '{B.KEY_RE}', 1)) AS key FROM (SELECT page_id, x, unnest(tk) AS t, "
            f"generate_subscripts(tk, 1) - 1 AS i FROM (SELECT page_id, x, regexp_extract_all(x, '{B.TOKEN_RE}') AS tk FROM ({src}))))))"
            f" WINDOW lv AS (PARTITION BY page_id, tag, lvl ORDER BY i))")


def sql_inner(tk: str, a: str, e: str) -> str:
    return f"coalesce((SELECT string_agg(z.t, '' ORDER BY z.i) FROM {tk} z WHERE z.page_id = {a}.page_id AND z.i > {a}.i AND z.i < {e}), '')"


def sql_main(src: str) -> str:
    """(page_id, x) -> (page_id, x) of the main content."""
    tlen = lambda x: f"length(regexp_replace({x}, '<[^>]*>', '', 'g'))"
    links = "array_to_string(regexp_extract_all(whole, '(?is)<a\\b[^>]*>.*?</a\\s*>'), '')"
    return (f"WITH tk AS MATERIALIZED ({sql_tokens(src)}), c0 AS (SELECT *, min(CASE tag WHEN 'article' THEN 1 WHEN 'main' THEN 2 ELSE 3 END) OVER (PARTITION BY page_id) AS best, "
            f"CASE tag WHEN 'article' THEN 1 WHEN 'main' THEN 2 ELSE 3 END AS k FROM tk WHERE key IN ('article', 'main', 'body')), "
            f"c1 AS (SELECT * FROM c0 a WHERE k = best AND NOT EXISTS (SELECT 1 FROM c0 b WHERE b.page_id = a.page_id AND b.k = a.k AND b.i < a.i AND a.i < b.e)), "
            f"c2 AS (SELECT a.page_id, a.i, {sql_inner('tk', 'a', 'a.e')} AS whole FROM c1 a), "
            f"c3 AS (SELECT *, {tlen('whole')} - {tlen(links)} AS score FROM c2), "
            f"c4 AS (SELECT *, max(score) OVER (PARTITION BY page_id) AS top FROM c3), "
            f"c5 AS (SELECT page_id, string_agg(regexp_replace(whole, '(?i)</(article|main|body)\\s*>$', ''), '' ORDER BY i) AS m FROM c4 WHERE score * 5 >= top GROUP BY page_id) "
            f"SELECT s.page_id, CASE WHEN length({STRIP("coalesce(m, '')")}) > 100 THEN m ELSE s.x END AS x FROM ({src}) s LEFT JOIN c5 USING (page_id)")


def sql_flag(what: str, key: str = "key", t: str = "t") -> str:
    if what == "tags":
        return f"{key} IN ({', '.join(repr(x) for x in CFG.strip_tags)})"
    if what == "classes" or what == "ads":
        alt = "|".join(x.lower().replace("-", "\\-") for x in (CFG.strip_classes if what == "classes" else sorted(set(B.AD_WORDS))))
        return f"regexp_matches(lower({sql_attr(t, B.CLASS_RE)} || ' ' || {sql_attr(t, B.ID_RE)}), '{alt}')"
    return f"regexp_matches(replace(lower({sql_attr(t, B.STYLE_RE)}), ' ', ''), 'display:none|visibility:hidden')"


def sql_strip(src: str, flag: str) -> str:
    """(page_id, x) -> (page_id, x) without the flagged elements that aren't code."""
    return (f"WITH tk AS MATERIALIZED ({sql_tokens(src)}), fl AS (SELECT a.*, {sql_inner('tk', 'a', 'a.e')} AS inner_html FROM tk a "
            f"WHERE a.key <> '' AND NOT starts_with(a.key, '/') AND ({flag})), "
            f"sp AS (SELECT page_id, i AS s, e FROM (SELECT *, {sql_format_text('inner_html')} AS ft FROM fl) WHERE NOT (key IN ('pre', 'code', 'samp', 'kbd') OR {sql_code_class('t')} "
            f"OR coalesce({sql_density_code('ft')}, false))), "
            f"o AS (SELECT page_id, string_agg(t, '' ORDER BY i) AS x FROM tk WHERE NOT EXISTS (SELECT 1 FROM sp WHERE sp.page_id = tk.page_id AND sp.s <= tk.i AND tk.i < sp.e) GROUP BY page_id) "
            f"SELECT s.page_id, CASE WHEN EXISTS (SELECT 1 FROM sp WHERE sp.page_id = s.page_id) THEN coalesce(o.x, '') ELSE s.x END AS x FROM ({src}) s LEFT JOIN o USING (page_id)")


SQL_RAW = f"SELECT page_id, {H.sql_strip_raw_text('html')} AS x FROM {SQL_VPAGES}"
SQL_FLAGS = f"{sql_flag('tags')} OR {sql_flag('classes')} OR {sql_flag('hidden')}"
SQL_CLEAN = sql_strip(sql_main(SQL_RAW), SQL_FLAGS)


MARK_RE_SQL = q(B.MARK_RE)
CONT = ", ".join(f"'{t}'" for t in B.CONTAINERS)

SQL_PIECES_T = f"""
m AS MATERIALIZED (SELECT c.page_id, c.x AS main FROM ({{MAIN}}) c JOIN {{PAGES}} p USING (page_id) WHERE {{NONBLANK}} <> ''),
pc AS (SELECT page_id, main, string_split(regexp_replace(main, '{MARK_RE_SQL}', chr(1) || '\\1', 'g'), chr(1)) AS parts FROM m),
p0 AS (SELECT page_id, main, len(parts) AS n, CAST(i - 1 AS INTEGER) AS idx, raw,
       CASE WHEN i = 1 THEN '' ELSE lower(regexp_extract(raw, '^<(/?[a-zA-Z0-9]+)', 1)) END AS key,
       CASE WHEN i = 1 THEN '' ELSE regexp_extract(raw, '^(<[^>]*>)', 1) END AS opener
       FROM (SELECT page_id, main, parts, unnest(parts) AS raw, generate_subscripts(parts, 1) AS i FROM pc)),
p1 AS (SELECT *, regexp_replace(key, '^/', '') AS tag, substr(raw, length(opener) + 1) AS body, length(raw) AS rawlen FROM p0),
p2 AS MATERIALIZED (SELECT * EXCLUDE (main), {sql_frags('body')} AS frags, regexp_matches(body, '<[a-zA-Z]') AS has_tags,
       (tag IN ({CONT}) AND NOT starts_with(key, '/')) AS cont, (tag IN ('div', 'p', 'td') AND NOT starts_with(key, '/')) AS pass2 FROM p1),
pl AS (SELECT *, sum(CASE WHEN key = '' THEN 0 WHEN starts_with(key, '/') THEN -1 ELSE 1 END) OVER (PARTITION BY page_id, tag ORDER BY idx)
       + CASE WHEN starts_with(key, '/') THEN 1 ELSE 0 END AS lvl FROM p2),
pm AS (SELECT *, lead(key) OVER lv AS nk, lead(idx) OVER lv AS nidx FROM pl WINDOW lv AS (PARTITION BY page_id, tag, lvl ORDER BY idx)),
p3 AS (SELECT * EXCLUDE (lvl, nk, nidx), CAST(CASE WHEN NOT cont THEN idx + 1 WHEN nk = '/' || tag THEN nidx ELSE n END AS INTEGER) AS e FROM pm),
p4 AS MATERIALIZED (SELECT a.*, (SELECT string_agg(b.raw, '' ORDER BY b.idx) FROM p2 b WHERE b.page_id = a.page_id AND b.idx >= a.idx AND b.idx < a.e) AS span_raw,
       (SELECT flatten(list(b.frags ORDER BY b.idx)) FROM p2 b WHERE b.page_id = a.page_id AND b.idx >= a.idx AND b.idx < a.e) AS span_frags FROM p3 a),
p5 AS (SELECT *, substr(span_raw, length(opener) + 1) AS inner_html FROM p4),
p6 AS (SELECT *, CASE WHEN pass2 OR key = 'pre' THEN {sql_format_text('inner_html')} END AS ctext,
       CASE WHEN key = 'pre' THEN {sql_format_text('inner_html', br=False)} END AS pretext FROM p5),
p7 AS MATERIALIZED (SELECT *, coalesce(pass2 AND ({sql_code_class('opener')} OR {sql_density_code('ctext')}), false) AS is_code FROM p6),
spans AS MATERIALIZED (SELECT page_id, idx AS s, e FROM p7 WHERE is_code OR key = 'pre'),
p8 AS (SELECT a.*, (NOT starts_with(a.key, '/') AND a.key <> '' AND NOT EXISTS (SELECT 1 FROM spans c WHERE c.page_id = a.page_id
       AND c.s <= a.idx AND a.idx < c.e)) AS opener_ok,
       array_to_string(CASE WHEN a.tag = 'p' THEN a.frags ELSE a.span_frags END, ' ') AS ptxt,
       length(array_to_string(CASE WHEN a.tag = 'p' THEN a.frags ELSE a.span_frags END, '')) AS pplain FROM p7 a),
p9 AS MATERIALIZED (SELECT *, {sql_word_count('ptxt')} AS w, CASE WHEN NOT has_tags THEN 1.0 ELSE pplain /
       (CASE WHEN tag = 'p' THEN rawlen + 4 ELSE length(span_raw) + length(tag) + 3 END) END AS dens FROM p8)
"""


SQL_PIECES_T = SQL_PIECES_T.replace("{PAGES}", SQL_VPAGES).replace("{NONBLANK}", STRIP('html'))
SQL_PIECES = SQL_PIECES_T.replace("{MAIN}", SQL_CLEAN)
SQL_PIECES_PAGE = SQL_PIECES_T.replace("{MAIN}", SQL_RAW)


def with_pieces_sql(select: str, whole_page: bool = False) -> str:
    return "WITH " + (SQL_PIECES_PAGE if whole_page else SQL_PIECES).strip() + " " + select


GATE = (f"NOT (w < {CFG.min_block_words} AND tag <> 'blockquote' AND w < {B.MIN_PARAGRAPH_WORDS_HARD}) AND "
        f"NOT (dens < {CFG.min_text_density} AND w < {CFG.min_block_words}) AND ptxt <> ''")


# ------------------------------------------------------------- queries
@register("html_tokens", sql=(
    "SELECT page_id, CAST(p - 1 AS BIGINT) AS pos, CASE WHEN starts_with(t, '</') THEN 'close' WHEN starts_with(t, '<!') "
    "OR starts_with(t, '<?') THEN 'other' WHEN starts_with(t, '<') THEN 'open' ELSE 'text' END AS kind, "
    "lower(regexp_extract(t, '^</?([a-zA-Z][a-zA-Z0-9]*)', 1)) AS tag, CASE WHEN starts_with(t, '<') THEN regexp_extract(t, '^</?[a-zA-Z][a-zA-Z0-9]*(.*?)/?>$', 1) ELSE '' END AS attrs, "
    f"CASE WHEN starts_with(t, '<') THEN '' ELSE {DEC('t')} END AS text FROM ("
    f"SELECT page_id, unnest(tk) AS t, generate_subscripts(tk, 1) AS p FROM (SELECT page_id, "
    f"regexp_extract_all({H.sql_strip_raw_text('html')}, '<[^>]*>|[^<]+') AS tk FROM {SQL_VPAGES}))"))
def q_html_tokens(spark, d):
    t = pages(spark, d).select("page_id", F.posexplode_outer(F.regexp_extract_all(H.strip_raw_text("html"),
                                                                                  F.lit("<[^>]*>|[^<]+"), 0)).alias("pos", "t"))
    t = t.where(F.col("t").isNotNull())
    kind = (F.when(F.col("t").startswith("</"), "close")
            .when(F.col("t").startswith("<!") | F.col("t").startswith("<?"), "other")
            .when(F.col("t").startswith("<"), "open").otherwise("text"))
    return t.select("page_id", F.col("pos").cast("bigint").alias("pos"), kind.alias("kind"),
                    F.lower(F.regexp_extract("t", r"^</?([a-zA-Z][a-zA-Z0-9]*)", 1)).alias("tag"),
                    F.when(F.col("t").startswith("<"), F.regexp_extract("t", r"^</?[a-zA-Z][a-zA-Z0-9]*(.*?)/?>$", 1)).otherwise(F.lit("")).alias("attrs"),
                    F.when(F.col("t").startswith("<"), F.lit("")).otherwise(H.entity_decode("t")).alias("text"))


@register("html_elements", sql=with_pieces_sql(
    "SELECT page_id, idx, tag, e AS end_idx, is_code FROM p9 WHERE key <> '' AND NOT starts_with(key, '/')"))
def q_html_elements(spark, d):
    e = elements(spark, d).select("page_id", F.inline_outer(F.transform("_P", lambda p: F.struct(
        p["idx"].alias("idx"), p["key"].alias("key"), p["tag"].alias("tag"), p["end"].alias("end_idx"),
        p["is_code"].alias("is_code")))))
    return e.where(F.col("idx").isNotNull() & (F.col("key") != "") & ~F.col("key").startswith("/")).drop("key")


@register("page_title", sql=f"SELECT page_id, {H.sql_page_title('html')} AS title FROM pages")
def q_page_title(spark, d):
    return pages(spark, d).select("page_id", H.page_title("html").alias("title"))


def _md5(rows, what, col):
    return rows.select("page_id", F.length(col).alias(f"{what}_chars"), F.md5(col).alias(f"{what}_md5"))


def _sql_md5(what: str, q_: str) -> str:
    return f"SELECT page_id, CAST(length(x) AS INTEGER) AS {what}_chars, md5(x) AS {what}_md5 FROM ({q_})"


def raw_pages(spark, d):
    return pages(spark, d).select("page_id", H.strip_raw_text("html").alias("raw"))


@register("main_content", sql=_sql_md5("main", sql_main(SQL_RAW)))
def q_main_content(spark, d):
    return _md5(B.main_content(raw_pages(spark, d), "raw", "main"), "main", "main")


@register("strip_tags", sql=_sql_md5("left", sql_strip(SQL_RAW, sql_flag("tags"))))
def q_strip_tags(spark, d):
    return _md5(B.strip_elements(raw_pages(spark, d), "raw", "left", B.tag_flag(CFG.strip_tags), CFG), "left", "left")


@register("strip_classes", sql=_sql_md5("left", sql_strip(SQL_RAW, sql_flag("classes"))))
def q_strip_classes(spark, d):
    return _md5(B.strip_elements(raw_pages(spark, d), "raw", "left", B.class_flag(CFG.strip_classes), CFG), "left", "left")


@register("strip_hidden", sql=_sql_md5("left", sql_strip(SQL_RAW, sql_flag("hidden"))))
def q_strip_hidden(spark, d):
    return _md5(B.strip_elements(raw_pages(spark, d), "raw", "left", B.hidden_flag, CFG), "left", "left")


@register("strip_comments", sql=("SELECT page_id, CAST(length(regexp_replace(html, '(?s)<!--.*?-->', '', 'g')) AS INTEGER) AS chars, "
                                 f"CAST(len(regexp_extract_all(html, '(?s)<!--.*?-->')) AS INTEGER) AS n_comments FROM {SQL_VPAGES}"))
def q_strip_comments(spark, d):
    return pages(spark, d).select("page_id", F.length(H.strip_comments("html")).alias("chars"),
                                  F.size(F.regexp_extract_all("html", F.lit(H.COMMENT_RE), 0)).alias("n_comments"))


def _text_raw(spark, d):
    return B.with_text_blocks(elements(spark, d), CFG).select("page_id", F.inline_outer("_text_raw")) \
        .where(F.col("pos").isNotNull())


@register("block_headings", sql=with_pieces_sql(
    "SELECT page_id, idx AS pos, CAST(substr(tag, 2, 1) AS INTEGER) AS level, array_to_string(frags, '') AS content "
    "FROM p9 WHERE opener_ok AND tag IN ('h1', 'h2', 'h3', 'h4', 'h5', 'h6') AND len(frags) > 0"))
def q_block_headings(spark, d):
    t = _text_raw(spark, d).where(F.col("type") == "heading")
    return t.select("page_id", "pos", "level", "content")


@register("block_paragraphs", sql=with_pieces_sql(
    "SELECT page_id, idx AS pos, CASE WHEN tag = 'blockquote' THEN 'blockquote' ELSE 'paragraph' END AS type, ptxt AS content "
    f"FROM p9 WHERE opener_ok AND tag IN ('p', 'article', 'section', 'blockquote') AND {GATE}"))
def q_block_paragraphs(spark, d):
    t = _text_raw(spark, d).where(F.col("type").isin("paragraph", "blockquote"))
    return t.select("page_id", "pos", "type", "content")


SQL_ITEMS = ("(SELECT list(array_to_string((SELECT flatten(list(c.frags ORDER BY c.idx)) FROM p9 c WHERE c.page_id = b.page_id "
             "AND c.idx >= b.idx AND c.idx < least(b.e, a.e)), ' ') ORDER BY b.idx) FROM p9 b WHERE b.page_id = a.page_id "
             "AND b.key = 'li' AND b.idx > a.idx AND b.idx < a.e AND NOT EXISTS (SELECT 1 FROM p9 r WHERE r.page_id = a.page_id AND r.key IN ('ul', 'ol') "
             "AND r.idx > a.idx AND r.idx < b.idx AND b.idx < r.e))")


@register("block_lists", sql=with_pieces_sql(
    "SELECT page_id, pos, type, array_to_string(list_transform(items, lambda s: '• ' || s), chr(10)) AS content, "
    "array_to_string(items, '|') AS items FROM (SELECT a.page_id, a.idx AS pos, CASE WHEN a.tag = 'ol' THEN 'ordered_list' "
    f"ELSE 'unordered_list' END AS type, list_filter({SQL_ITEMS}, lambda s: s <> '') AS items FROM p9 a "
    "WHERE a.opener_ok AND a.tag IN ('ul', 'ol')) WHERE len(items) > 0"))
def q_block_lists(spark, d):
    t = _text_raw(spark, d).where(F.col("type").isin("ordered_list", "unordered_list"))
    return t.select("page_id", "pos", "type", "content", F.array_join("items", "|").alias("items"))


@register("text_density", sql=with_pieces_sql(
    "SELECT page_id, idx, tag, round(dens, 6) AS density, CAST(w AS INTEGER) AS words FROM p9 "
    "WHERE opener_ok AND tag IN ('p', 'article', 'section', 'blockquote')"))
def q_text_density(spark, d):
    e = B.with_text_blocks(elements(spark, d), CFG)
    x = e.select("page_id", F.inline_outer(F.transform("_P", lambda p: F.struct(
        p["idx"].alias("idx"), p["tag"].alias("tag"), p["dens"].alias("dens"), p["w"].alias("words"),
        p["opener_ok"].alias("ok")))))
    return x.where(F.col("idx").isNotNull() & F.col("ok") & F.col("tag").isin("p", "article", "section", "blockquote")).select(
        "page_id", "idx", "tag", F.round("dens", 6).alias("density"), F.col("words").cast("int").alias("words"))


@register("code_density", sql=with_pieces_sql(
    "SELECT page_id, idx, tag, is_code, round(length(regexp_replace(ctext, '" + B.symbol_class(CFG) +
    "', '', 'g')) / length(ctext), 6) AS density FROM p9 WHERE pass2 AND length(ctext) > 0"))
def q_code_density(spark, d):
    x = elements(spark, d).select("page_id", F.inline_outer(F.transform("_P", lambda p: F.struct(
        p["idx"].alias("idx"), p["tag"].alias("tag"), p["is_code"].alias("is_code"), p["ctext"].alias("ctext"),
        p["pass2"].alias("pass2")))))
    return x.where(F.col("idx").isNotNull() & F.col("pass2") & (F.length("ctext") > 0)).select(
        "page_id", "idx", "tag", "is_code", F.round(B.symbol_density(F.col("ctext"), CFG), 6).alias("density"))


@register("code_class", sql=with_pieces_sql(
    f"SELECT page_id, idx, tag, {sql_code_class('opener')} AS code_class FROM p9 WHERE key <> '' AND NOT starts_with(key, '/')"))
def q_code_class(spark, d):
    x = elements(spark, d).select("page_id", F.inline_outer(F.transform("_P", lambda p: F.struct(
        p["idx"].alias("idx"), p["tag"].alias("tag"), p["key"].alias("key"), B.has_code_class(p["opener"]).alias("code_class")))))
    return x.where(F.col("idx").isNotNull() & (F.col("key") != "") & ~F.col("key").startswith("/")) \
        .select("page_id", "idx", "tag", "code_class")


def _code(spark, d):
    return B.with_code_blocks(elements(spark, d), CFG)


SQL_GUESS = "CASE " + " ".join(
    f"WHEN regexp_matches(first10, '{q(p)}') THEN '{lang}'" for lang, p in B.LANG_HEURISTICS) + \
    " WHEN (starts_with(st, '{') AND ends_with(st, '}')) OR (starts_with(st, '[') AND ends_with(st, ']')) THEN 'json' ELSE 'unknown' END"


def _sql_alias(x: str) -> str:
    names = "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in B.LANGUAGE_ALIASES.items()) + "}"
    return f"coalesce({names}[{STRIP(x)}], 'unknown')"


SQL_LANG_CLASSES = f"list_filter(regexp_split_to_array(lower({sql_attr('opener', B.CLASS_RE)}), '\\s+'), lambda c: c <> '')"
SQL_LANG_PREF = ("list_filter(list_transform(cls, lambda c: CASE " + " ".join(
    f"WHEN starts_with(c, '{x}') AND length(c) > {len(x)} THEN substr(c, {len(x) + 1})" for x in B.LANG_PREFIXES) + " END), lambda y: y IS NOT NULL)[1]")
SQL_DATA = [sql_attr('opener', rf"""(?is)\s{a}\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""") for a in ("data-language", "data-lang")]


@register("code_language", sql=with_pieces_sql(
    f"SELECT page_id, idx, CASE WHEN pref IS NOT NULL THEN {_sql_alias('pref')} WHEN named IS NOT NULL THEN named WHEN dl <> '' THEN {_sql_alias('lower(dl)')} "
    f"ELSE {SQL_GUESS} END AS language FROM (SELECT *, {SQL_LANG_PREF} AS pref, list_filter(list_transform(cls, lambda c: {_sql_alias('c')}), "
    f"lambda y: y <> 'unknown')[1] AS named FROM (SELECT page_id, idx, {SQL_LANG_CLASSES} AS cls, CASE WHEN {SQL_DATA[0]} <> '' THEN {SQL_DATA[0]} ELSE {SQL_DATA[1]} END AS dl, "
    + STRIP('ctext') + " AS st, lower(array_to_string((string_split(" + STRIP('ctext') + ", chr(10)))[1:10], chr(10))) AS first10 FROM p9 "
    "WHERE (is_code OR key = 'pre') AND NOT EXISTS (SELECT 1 FROM spans c WHERE c.page_id = p9.page_id AND c.s < p9.idx AND p9.idx < c.e) "
    "AND " + STRIP('ctext') + " <> ''))"))
def q_code_language(spark, d):
    e = elements(spark, d)
    hits = e.select("page_id", F.inline_outer(F.transform(F.filter("_P", lambda p: (p["is_code"] | (p["key"] == "pre")) & ~B._in_code(
        F.col("_code_spans"), p["idx"], strict=True) & (H.pystrip(p["ctext"]) != "")), lambda p: F.struct(
        p["idx"].alias("idx"), p["opener"].alias("opener"), p["ctext"].alias("text"))))).where(F.col("idx").isNotNull())
    return hits.select("page_id", "idx", B.code_language(F.col("opener"), F.col("text")).alias("language"))


def _sql_code_tags() -> str:
    rest, parts = "regexp_replace(main, '(?is)<pre\\b[^>]*>.*?</pre\\s*>', '', 'g')", []
    for k, t in enumerate(("code", "samp", "kbd"), 1):
        parts.append(f"SELECT page_id, {k} AS k, unnest(regexp_extract_all({rest}, '(?is)<{t}\\b[^>]*>(.*?)</{t}\\s*>', 1)) AS x FROM m")
        rest = f"regexp_replace({rest}, '(?is)<{t}\\b[^>]*>.*?</{t}\\s*>', '', 'g')"
    return " UNION ALL ".join(parts)


@register("code_tags", sql=with_pieces_sql(
    "SELECT page_id, CAST(0 AS INTEGER) AS pass, pretext AS content FROM p9 WHERE key = 'pre' AND " + STRIP('pretext') + " <> '' "
    "UNION ALL SELECT page_id, CAST(k AS INTEGER) AS pass, txt AS content FROM (" + _sql_code_tags() + ") "
    ", LATERAL (SELECT " + sql_format_text('x') + " AS txt) WHERE " + STRIP('txt') + " <> ''"))
def q_code_tags(spark, d):
    c = _code(spark, d).select("page_id", F.inline_outer("_C")).where(F.col("text").isNotNull())
    return c.where(F.col("pass") < 4).select("page_id", F.col("pass").cast("int").alias("pass"), F.col("text").alias("content"))


def _targets(spark, d, kind):
    t = B.target_blocks(pages(spark, d).select("page_id", "html"), "html", [kind])
    return t.select("page_id", F.inline_outer(F.transform(f"_{kind}", lambda b: F.struct(
        b["type"].alias("type"), b["content"].alias("content"))))).where(F.col("type").isNotNull())


def _sql_target(kind: str, flag: str, least: int) -> str:
    return (f"WITH tk AS MATERIALIZED ({sql_tokens(SQL_RAW)}) SELECT page_id, '{kind}_content' AS type, txt AS content FROM (SELECT a.page_id, "
            f"array_to_string({sql_frags('inner_html')}, ' ') AS txt FROM (SELECT a.*, {sql_inner('tk', 'a', 'a.e')} AS inner_html FROM tk a "
            f"WHERE a.key <> '' AND NOT starts_with(a.key, '/') AND {flag}) a) WHERE length(txt) > {least}")


@register("target_headers", sql=_sql_target("header", "a.key = 'header'", 0))
def q_target_headers(spark, d):
    return _targets(spark, d, "header")


@register("target_footers", sql=_sql_target("footer", "a.key = 'footer'", 0))
def q_target_footers(spark, d):
    return _targets(spark, d, "footer")


@register("target_ads", sql=_sql_target("ad", sql_flag("ads", "a.key", "a.t"), B.AD_MIN_CHARS))
def q_target_ads(spark, d):
    return _targets(spark, d, "ad")


# decimal and hexadecimal numbers that grow with the page id (some are no characters), names, and a reference to an ampersand
SQL_REFS = ("concat('caf&eacute; &#', page_id * 97, ';&#X', to_hex(page_id * 4099), ';&#x0000', to_hex(page_id % 90 + 33), "
            "'; &#38;lt; &nosuch; &#99999999999999999999; &amp;amp; ', url)")


@register("entity_decode", sql=f"SELECT page_id, {DEC('o')} AS odd, {DEC('t')} AS title FROM (SELECT page_id, {SQL_REFS} AS o, "
                               "regexp_extract(html, '(?is)<title[^>]*>(.*?)</title', 1) AS t FROM pages)")
def q_entity_decode(spark, d):
    odd = F.concat(F.lit("caf&eacute; &#"), (F.col("page_id") * 97).cast("string"), F.lit(";&#X"), F.hex(F.col("page_id") * 4099), F.lit(";&#x0000"),
                   F.hex(F.col("page_id") % 90 + 33), F.lit("; &#38;lt; &nosuch; &#99999999999999999999; &amp;amp; "), F.col("url"))
    return pages(spark, d).select("page_id", H.entity_decode(odd).alias("odd"),
                                  H.entity_decode(F.regexp_extract("html", r"(?is)<title[^>]*>(.*?)</title", 1)).alias("title"))


def _blocks(spark, d, targets=("text",)):
    return B.extract_blocks(pages(spark, d), targets, "html", CFG)


def _sql_code_in_order() -> str:
    """Code of each page in pass order: (page_id, k, o, x)."""
    rest, parts = "regexp_replace(main, '(?is)<pre\\b[^>]*>.*?</pre\\s*>', '', 'g')", ["SELECT page_id, 0 AS k, idx AS o, pretext AS x FROM p9 WHERE key = 'pre'"]
    for k, t in enumerate(("code", "samp", "kbd"), 1):
        found = f"regexp_extract_all({rest}, '(?is)<{t}\\b[^>]*>(.*?)</{t}\\s*>', 1)"
        parts.append(f"SELECT page_id, {k}, o, {sql_format_text('y')} FROM (SELECT page_id, unnest({found}) AS y, generate_subscripts({found}, 1) AS o FROM m)")
        rest = f"regexp_replace({rest}, '(?is)<{t}\\b[^>]*>.*?</{t}\\s*>', '', 'g')"
    parts.append("SELECT page_id, 4, idx, ctext FROM p9 WHERE is_code AND NOT EXISTS (SELECT 1 FROM spans c WHERE c.page_id = p9.page_id AND c.s < p9.idx AND p9.idx < c.e)")
    return " UNION ALL ".join(parts)


# Text blocks after the rules of H17: the first of equal texts stays, and a walk over a page's blocks in order merges each short paragraph
# with the short one before it (g numbers what is left). Code block k comes after text block i, the first with (i + 1)(C + 1) >= (k + 1) T.
SQL_BLOCKS = (f"""
raw_ AS (SELECT page_id, idx, 'heading' AS type, array_to_string(frags, '') AS content FROM p9 WHERE opener_ok AND tag IN ('h1', 'h2', 'h3', 'h4', 'h5', 'h6') AND len(frags) > 0
  UNION ALL SELECT page_id, idx, CASE WHEN tag = 'blockquote' THEN 'blockquote' ELSE 'paragraph' END, ptxt FROM p9 WHERE opener_ok AND tag IN ('p', 'article', 'section', 'blockquote') AND {GATE}
  UNION ALL SELECT page_id, idx, type, array_to_string(list_transform(items, lambda s: '• ' || s), chr(10)) FROM (SELECT a.page_id, a.idx, CASE WHEN a.tag = 'ol' THEN 'ordered_list'
    ELSE 'unordered_list' END AS type, list_filter({SQL_ITEMS}, lambda s: s <> '') AS items FROM p9 a WHERE a.opener_ok AND a.tag IN ('ul', 'ol')) WHERE len(items) > 0),
even_ AS (SELECT page_id, idx, type, {STRIP(f"regexp_replace(content, '{WS}+', ' ', 'g')")} AS c FROM raw_),
once_ AS (SELECT * FROM even_ WHERE c <> '' QUALIFY row_number() OVER (PARTITION BY page_id, lower(c) ORDER BY idx) = 1),
row_ AS MATERIALIZED (SELECT *, {sql_word_count('c')} AS w, row_number() OVER (PARTITION BY page_id ORDER BY idx) AS n FROM once_),
walk_ AS (SELECT page_id, n, CAST(1 AS BIGINT) AS g, idx AS pos, type, c, w FROM row_ WHERE n = 1 UNION ALL
  SELECT page_id, n, CASE WHEN joins THEN g ELSE g + 1 END, CASE WHEN joins THEN pos ELSE idx END, type, CASE WHEN joins THEN before || ' ' || c ELSE c END, CASE WHEN joins THEN bw + w ELSE w END FROM (
  SELECT x.page_id, x.n, y.g, y.pos, x.idx, x.type, y.c AS before, x.c, y.w AS bw, x.w, x.type = 'paragraph' AND y.type = 'paragraph' AND y.w < {B.MERGE_MAX_WORDS} AND x.w < {B.MERGE_MAX_WORDS}
    AND right(y.c, 1) NOT IN ('.', '!', '?', ':') AS joins FROM walk_ y JOIN row_ x ON x.page_id = y.page_id AND x.n = y.n + 1) z),
text_ AS (SELECT page_id, g - 1 AS i, pos, type, c AS content FROM walk_ QUALIFY row_number() OVER (PARTITION BY page_id, g ORDER BY n DESC) = 1),
code_ AS (SELECT page_id, x, row_number() OVER (PARTITION BY page_id ORDER BY k, o) - 1 AS k FROM ({_sql_code_in_order()}) WHERE {STRIP('x')} <> ''),
size_ AS (SELECT page_id, (SELECT count(*) FROM text_ t WHERE t.page_id = m.page_id) AS nt, (SELECT count(*) FROM code_ t WHERE t.page_id = m.page_id) AS nc FROM m),
all_ AS (SELECT page_id, i AS a, 0 AS b, 0 AS k, type, content FROM text_ UNION ALL
  SELECT page_id, ((k + 1) * nt + nc) // (nc + 1) - 1, 1, k, 'code_block', x FROM code_ JOIN size_ USING (page_id)),
blocks_ AS (SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY a, b, k) - 1 AS INTEGER) AS pos, type, content FROM all_)""")


def with_blocks_sql(select: str) -> str:
    return "WITH RECURSIVE " + SQL_PIECES.strip() + "," + SQL_BLOCKS + " " + select


@register("post_process_blocks", sql=with_blocks_sql("SELECT page_id, CAST(pos AS INTEGER) AS pos, type, content FROM text_"))
def q_post_process(spark, d):
    e = B.with_text_blocks(elements(spark, d), CFG)
    return e.select("page_id", F.inline_outer(F.transform(B.post_process(F.col("_text_raw")), lambda b: F.struct(
        b["pos"].alias("pos"), b["type"].alias("type"), b["content"].alias("content"))))).where(F.col("pos").isNotNull())


@register("interleave_blocks", sql=with_blocks_sql("SELECT page_id, pos, type FROM blocks_"))
def q_interleave(spark, d):
    b = _blocks(spark, d)
    return B.blocks_relational(b).select("page_id", "pos", "type")


@register("extract_blocks")
def q_extract_blocks(spark, d):
    return B.blocks_relational(_blocks(spark, d, ("text", "headers", "footers", "ads")))


@register("block_type_counts", sql=with_blocks_sql("SELECT page_id, CAST(nt + nc AS BIGINT) AS block_count, CAST(nc AS BIGINT) AS code_blocks FROM size_"))
def q_block_type_counts(spark, d):
    return B.block_type_counts(_blocks(spark, d))


@register("range_containment", sql=with_pieces_sql(
    "SELECT page_id, idx, tag, CAST(len(span_frags) AS INTEGER) AS n_text, e - idx AS n_pieces FROM p9 "
    "WHERE cont", whole_page=True))
def q_range_containment(spark, d):
    """Text fragments contained in each element span -- computed in the
    page's row from the span bounds (no page_id x range pair join)."""
    e = B.with_elements(pages(spark, d).where(H.pystrip(F.col("html")) != ""), "html", CFG, main_only=False)
    x = e.select("page_id", F.inline_outer(F.transform("_P", lambda p: F.struct(
        p["idx"].alias("idx"), p["tag"].alias("tag"), p["key"].alias("key"), F.size(p["span_frags"]).alias("n_text"),
        (p["end"] - p["idx"]).alias("n_pieces")))))
    return x.where(F.col("idx").isNotNull() & F.col("tag").isin(*B.CONTAINERS) & ~F.col("key").startswith("/")) \
        .select("page_id", "idx", "tag", "n_text", "n_pieces")
