"""URL rule predicates.

Rules are configuration (a job holds a handful), so they compile on the driver
into one static boolean Column -- no join, no UDF. Rules held in a table go
through ``operators.links.match_rules_table`` instead (J8).
"""

from __future__ import annotations

import re
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from .urls import PARAMS_RE, url_domain, url_parse, without_params

RULE_TYPES = ["contains", "starts_with", "ends_with", "regex", "domain"]


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def java_regex(pattern: str | None) -> str | None:
    """A rule's pattern in the dialect that runs it, or None if the pattern is invalid or uses what that dialect lacks.
    Named groups are written ``(?<g1x>``, back references ``\\k<g1x>``, and the end of text ``\\z``."""
    pattern = pattern or ""
    try:
        names = sorted(re.compile(pattern).groupindex)
    except re.error:
        return None
    safe = {n: f"g{i}x" for i, n in enumerate(names)}
    out, i, in_class = [], 0, False
    while i < len(pattern):
        c = pattern[i]
        if c == "\\":
            out.append("\\z" if pattern[i : i + 2] == "\\Z" and not in_class else pattern[i : i + 2])
            i += 2
            continue
        m = None if in_class else _NAMED.match(pattern, i)
        if m:
            if m[1] is None:
                return None  # a conditional group
            out.append(f"(?<{safe[m[2]]}>" if m[1] == "P<" else f"\\k<{safe[m[2]]}>")
            i = m.end()
            continue
        if in_class and c in "[&":
            out.append("\\")  # nested classes and intersections are plain characters in a rule
        if c == "[" and not in_class:
            in_class = True
            out.append(c)
            i += 1
            if pattern[i : i + 1] == "^":
                out.append("^")
                i += 1
            if pattern[i : i + 1] == "]":
                out.append("\\]")
                i += 1
            continue
        if c == "]" and in_class:
            in_class = False
        out.append(c)
        i += 1
    return "".join(out)


_NAMED = re.compile(r"\(\?(?:(P<|P=)(\w+)[>)]|\()")


def regex_is_valid(pattern: str) -> bool:
    return java_regex(pattern) is not None


def required_literal(pattern: str | None) -> str:
    """The longest run of plain ASCII characters, lower-cased, that every match of a regex holds ('' if none is sure)."""
    from re import _constants as K
    from re import _parser

    best = ""

    def walk(items) -> None:
        nonlocal best
        run = ""
        for op, arg in items:
            if op is K.LITERAL and arg < 128:
                run += chr(arg).lower()
            elif op is not K.AT:
                best, run = max(best, run, key=len), ""
                if op is K.SUBPATTERN:
                    walk(arg[3])
                elif op in (K.MAX_REPEAT, K.MIN_REPEAT, K.POSSESSIVE_REPEAT) and arg[0] > 0:
                    walk(arg[2])
                elif op is K.ATOMIC_GROUP:
                    walk(arg)
        best = max(best, run, key=len)

    try:
        walk(_parser.parse(pattern or ""))
    except re.error:
        return ""
    return best


def rule_predicate(url, rule_type: str, pattern: str) -> Column:
    """One rule over a URL column. Type and pattern are lower-cased; the URL is
    matched lower-cased. Regex rules search case-insensitively with the
    pattern as written (lower-casing a pattern would turn ``\\D`` into ``\\d``);
    an invalid pattern never matches."""
    u = F.lower(_c(url))
    t = (rule_type or "").strip().lower()
    raw = pattern or ""
    p = raw.lower()
    if not t or not p:
        return F.lit(False)
    if t == "contains":
        return u.contains(p)
    if t == "starts_with":
        return u.startswith(p)
    if t == "ends_with":
        return u.endswith(p)
    if t == "regex":
        java = java_regex(raw)
        return F.lit(False) if java is None else u.rlike("(?i)" + java)
    if t == "domain":
        host = url_domain(u)
        return (host == p) | host.endswith("." + p)
    return F.lit(False)


def rules_any(url, rules: list[dict] | None) -> Column:
    """OR over rules; an empty (or missing) rule list keeps everything."""
    if not rules:
        return F.lit(True)
    # cheap string tests first, the regex last (OR short-circuits left to right)
    ordered = sorted(rules, key=lambda r: (r.get("type") or "").strip().lower() == "regex")
    return reduce(or_, [rule_predicate(url, r.get("type", ""), r.get("pattern", "")) for r in ordered])


def blocked_domain(url, blocked: list[str] | tuple[str, ...]) -> Column:
    """host equal to, or a sub-domain of, any blocked domain."""
    if not blocked:
        return F.lit(False)
    host = url_domain(url)
    return reduce(or_, [(host == b) | host.endswith("." + b) for b in blocked])


def skip_extension(url, exts: list[str] | tuple[str, ...]) -> Column:
    """lower-cased path ends with any skipped extension."""
    if not exts:
        return F.lit(False)
    path = F.lower(without_params(url_parse(url)["path"]))
    return reduce(or_, [path.endswith(e) for e in exts])


def valid_url(url) -> Column:
    """scheme and host present."""
    p = url_parse(url)
    return (p["scheme"] != "") & (p["netloc"] != "")


def same_domain(u1, u2) -> Column:
    """equal hosts."""
    return url_domain(u1) == url_domain(u2)


# ---------------------------------------------------------------------------
# DuckDB twins.
# ---------------------------------------------------------------------------
def sql_rule(u: str, rule_type: str, pattern: str) -> str:
    from .urls import sql_domain
    t = (rule_type or "").strip().lower()
    p = (pattern or "").lower().replace("'", "''")
    lu = f"lower({u})"
    if not t or not p:
        return "FALSE"
    if t == "contains":
        return f"contains({lu}, '{p}')"
    if t == "starts_with":
        return f"starts_with({lu}, '{p}')"
    if t == "ends_with":
        return f"ends_with({lu}, '{p}')"
    if t == "regex":
        if not regex_is_valid(pattern):
            return "FALSE"
        return f"regexp_matches({lu}, '{pattern}', 'i')"
    if t == "domain":
        h = sql_domain(lu)
        return f"({h} = '{p}' OR ends_with({h}, '.{p}'))"
    return "FALSE"


def sql_rules_any(u: str, rules: list[dict] | None) -> str:
    if not rules:
        return "TRUE"
    return "(" + " OR ".join(sql_rule(u, r.get("type", ""), r.get("pattern", "")) for r in rules) + ")"


def sql_blocked(u: str, blocked) -> str:
    from .urls import sql_domain
    if not blocked:
        return "FALSE"
    h = sql_domain(u)
    return "(" + " OR ".join(f"{h} = '{b}' OR ends_with({h}, '.{b}')" for b in blocked) + ")"


def sql_skip_ext(u: str, exts) -> str:
    from .urls import sql_part
    if not exts:
        return "FALSE"
    p = f"lower(regexp_replace({sql_part(u, 5)}, '{PARAMS_RE}', ''))"
    return "(" + " OR ".join(f"ends_with({p}, '{e}')" for e in exts) + ")"
