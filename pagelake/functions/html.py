"""Per-row HTML expressions (H3, H8, H24 and the href scan of H23).

These never tokenise: one regex pass per concern over the row's own html, so
they run inside the scan stage with no shuffle and parallelise per page.
"""

from __future__ import annotations

import json
from html.entities import name2codepoint

from pyspark.sql import Column
from pyspark.sql import functions as F

# Named references: those of HTML 4 and XHTML, from the standard library's table.
NAMED_ENTITIES = {name: chr(code) for name, code in sorted(name2codepoint.items())} | {"apos": "'"}
# A reference: decimal, hexadecimal or named, ended by a semicolon.
REFERENCE_RE = r"&(?:#[0-9]+|#[xX][0-9a-fA-F]+|[a-zA-Z][a-zA-Z0-9]*);"
REPLACEMENT = "\ufffd"

COMMENT_RE = r"(?s)<!--.*?-->"
# The rest of a tag after its name: quoted values hold any character. (The possessive forms keep the matcher from trying other
# readings of a tag that never ends.)
_REST = r"""[^>=]*+(?:=\s*+(?:"[^"]*"|'[^']*')?+[^>=]*+)*+>"""
# What the scan of a page's markup meets, in this order.
SCAN_RE = (r"(?is)<!--.*?(?:-->|\z)|<script\b" + _REST + r".*?(?:</script\s*>|\z)|<style\b" + _REST + r".*?(?:</style\s*>|\z)"
           r"|<[a-z/!?]" + _REST + r"|[^<]+|<")
DROPPED_RE = r"(?i)^<(?:!--|(?:script|style)\b)"
SCRIPT_RE = r"(?is)<script\b[^>]*>.*?</script\s*>"
STYLE_RE = r"(?is)<style\b[^>]*>.*?</style\s*>"
TITLE_RE = r"(?is)<title\b[^>]*>(.*?)</title\s*>"
HREF_RE = r"""(?i)<a\s(?:[^>]*?\s)?href\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)"""
# Python's str.strip()/split() and re's \s also treat these Unicode spaces as
# whitespace (the no-break space is what &nbsp; decodes to).
WS = r"[\s\x{0085}\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{001C}-\x{001F}]"
PYSTRIP_RE = "^" + WS + "+|" + WS + "+$"
# The characters of WS.
WS_CHARS = "".join(map(chr, [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def once(value: Column, use) -> Column:
    """``use(value)`` with ``value`` worked out once, however often ``use`` names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _code_point(digits: Column, base: int) -> Column:
    """The character with a number; one that is no character (too large, zero,
    or half of a pair) becomes the replacement character."""
    short = F.regexp_replace(digits, "^0+", "")
    n = F.when(F.length(short).between(1, 7), F.conv(short, base, 10).cast("int"))
    ok = n.between(1, 0xD7FF) | n.between(0xE000, 0x10FFFF)
    return F.when(ok, F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32")).otherwise(F.lit(REPLACEMENT))


def _reference(ref: Column) -> Column:
    """One reference, decoded; an unknown name stays as it is."""
    names = F.from_json(F.lit(json.dumps(NAMED_ENTITIES)), "map<string,string>")  # one literal, folded once
    body = F.substring(ref, 2, F.length(ref) - 2)
    return (F.when(body.rlike("^#[xX]"), _code_point(F.substring(body, 3, F.length(body)), 16))
            .when(body.startswith("#"), _code_point(F.substring(body, 2, F.length(body)), 10))
            .otherwise(F.coalesce(F.try_element_at(names, body), ref)))


def entity_decode(s) -> Column:
    """Decode numeric (decimal and hex) and named references, in one pass:
    what a reference stands for is not looked at again."""
    s = _c(s)
    parts = F.split(s, REFERENCE_RE, -1)
    refs = F.regexp_extract_all(s, F.lit(REFERENCE_RE), 0)
    both = F.zip_with(parts, refs, lambda p, r: F.concat(p, F.coalesce(F.when(r.isNotNull(), _reference(r)), F.lit(""))))
    return F.when(s.contains("&"), F.array_join(both, "")).otherwise(s)


def pystrip(s) -> Column:
    """``str.strip()``: whitespace (incl. no-break space) off both ends; only the ends are looked at."""
    return F.trim(_c(s), F.lit(WS_CHARS))


def strip_comments(html) -> Column:
    """H8: drop ``<!-- ... -->``."""
    return F.regexp_replace(_c(html), COMMENT_RE, "")


def strip_raw_text(html) -> Column:
    """Step 1 of the token model, a scan of the markup in document order: comments, scripts and styles removed (an unclosed one goes on
    to the end), and what is left made plain: ``<`` and ``>`` inside a tag, as in quoted values, and a ``<`` that starts no tag are
    written as references. Afterwards every ``<[^>]*>`` is one tag."""
    def plain(t):
        inner = F.substring(t, F.lit(2), F.length(t) - 2)
        escaped = F.concat(F.lit("<"), F.replace(F.replace(inner, F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;")), F.lit(">"))
        return (F.when(~t.startswith("<"), t).when(t == "<", F.lit("&lt;")).when(t.rlike(DROPPED_RE), F.lit(""))
                .when(inner.contains("<") | inner.contains(">"), escaped).otherwise(t))
    return F.array_join(F.transform(F.regexp_extract_all(_c(html), F.lit(SCAN_RE), 0), plain), "")


def page_title(html) -> Column:
    """H3: stripped text of the first <title>, NULL when there is none."""
    h = _c(html)
    raw = F.regexp_extract(h, TITLE_RE, 1)
    txt = pystrip(entity_decode(F.regexp_replace(raw, r"<[^>]*>", "")))
    return F.when(h.rlike(r"(?is)<title\b[^>]*>.*?</title\s*>"), txt)


def hrefs(html) -> Column:
    """Raw href values of <a> tags in document order (entity-decoded, stripped,
    blanks dropped)."""
    raw = F.regexp_extract_all(_c(html), F.lit(HREF_RE), 1)
    unq = F.transform(raw, lambda x: pystrip(entity_decode(F.regexp_replace(x, r"""^["']|["']$""", ""))))
    return F.filter(unq, lambda x: x != "")


# ---------------------------------------------------------------------------
# DuckDB twins.
# ---------------------------------------------------------------------------
def _sql_code_point(n: str) -> str:
    ok = f"({n} BETWEEN 1 AND 55295 OR {n} BETWEEN 57344 AND 1114111)"
    return f"CASE WHEN {ok} THEN chr(CAST({n} AS INTEGER)) ELSE '{REPLACEMENT}' END"


def sql_entity_decode(s: str) -> str:
    quote = lambda x: "'" + x.replace("'", "''") + "'"
    names = "MAP {" + ", ".join(f"{quote(k)}: {quote(v)}" for k, v in NAMED_ENTITIES.items()) + "}"
    # digits beyond what a number type holds are no character
    dec = _sql_code_point("TRY_CAST(substr(rf, 3, length(rf) - 3) AS BIGINT)")
    hexa = _sql_code_point("TRY_CAST('0x' || right('0' || ltrim(substr(rf, 4, length(rf) - 4), '0'), greatest(15, length(ltrim(substr(rf, 4, length(rf) - 4), '0')))) AS BIGINT)")
    one = (f"CASE WHEN regexp_matches(rf, '^&#[xX]') THEN {hexa} WHEN starts_with(rf, '&#') THEN {dec} "
           f"ELSE coalesce({names}[substr(rf, 2, length(rf) - 2)], rf) END")
    refs = f"list_transform(regexp_extract_all({s}, '{REFERENCE_RE}'), lambda rf: {one})"
    parts = f"string_split_regex({s}, '{REFERENCE_RE}')"
    return (f"CASE WHEN contains({s}, '&') THEN array_to_string(list_transform(list_zip({parts}, {refs}), "
            f"lambda zp: zp[1] || coalesce(zp[2], '')), '') ELSE {s} END")


def sql_pystrip(s: str) -> str:
    return f"regexp_replace({s}, '{PYSTRIP_RE}', '', 'g')"


def sql_strip_raw_text(h: str) -> str:
    scan = SCAN_RE.replace("*+", "*").replace("?+", "?").replace("'", "''")
    inner = "substr(mt, 2, length(mt) - 2)"
    return (f"array_to_string(list_transform(regexp_extract_all({h}, '{scan}'), lambda mt: CASE WHEN NOT starts_with(mt, '<') THEN mt WHEN mt = '<' THEN '&lt;' "
            f"WHEN regexp_matches(mt, '{DROPPED_RE}') THEN '' ELSE '<' || replace(replace({inner}, '<', '&lt;'), '>', '&gt;') || '>' END), '')")


def sql_hrefs(h: str) -> str:
    pat = HREF_RE.replace("'", "''")
    raw = f"regexp_extract_all({h}, '{pat}', 1)"
    unquote = "regexp_replace(x, '^[\"'']|[\"'']$', '', 'g')"
    unq = f"list_transform({raw}, lambda x: {sql_pystrip(sql_entity_decode(unquote))})"
    return f"list_filter({unq}, lambda x: x <> '')"


def sql_page_title(h: str) -> str:
    raw = f"regexp_extract({h}, '(?is)<title\\b[^>]*>(.*?)</title\\s*>', 1)"
    txt = sql_pystrip(sql_entity_decode(f"regexp_replace({raw}, '<[^>]*>', '', 'g')"))
    return f"CASE WHEN regexp_matches({h}, '(?is)<title\\b[^>]*>.*?</title\\s*>') THEN {txt} END"
