"""HTML -> typed content blocks.

Per-row design. A page's html is cleaned (comments, scripts, styles, stripped
subtrees), reduced to its main content and split at block-level tags into an
ordered array of *pieces*: piece k starts with the k-th block-level tag and
runs to the next one. Every block rule is an array expression over that one
row's pieces:

* a ``p`` ends at the next block-level tag (the HTML paragraph rule);
* containers (section, blockquote, lists, div, pre ...) end at their own end
  tag, found by a stack over the tag names (``functions.elements_udf``, the
  one step that is a pandas UDF: it sees tag names, no text);
* text of an element = its text fragments, entity-decoded and stripped.

Cleaning (stripped tags, classes, hidden elements) and the choice of the main
content work the same way on the page's single tags.

No shuffle, no per-page group: a page is one row from scan to output, so a
huge page costs one task and skew across pages cannot arise.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import AD_WORDS, DEFAULT, EngineConfig
from ..functions.elements_udf import element_ends, piece_ends
from ..functions.html import WS, entity_decode, once, pystrip, strip_raw_text
from ..functions.jsonx import BLOCK_TYPE
from ..plans.windows import row_barrier

# --------------------------------------------------------------------------
# FIXED VALUES
# --------------------------------------------------------------------------
BLOCK_TAGS = ["p", "h1", "h2", "h3", "h4", "h5", "h6", "ul", "ol", "li", "div", "article", "section",
              "blockquote", "header", "footer", "nav", "aside", "main", "pre", "table", "tr", "td", "th",
              "thead", "tbody", "form", "body", "html", "head", "figure", "figcaption", "hr", "dl", "dt",
              "dd", "address", "fieldset", "details", "summary", "noscript", "iframe", "title"]
CODE_CLASSES = ["highlight", "code", "syntax", "prism", "hljs", "codehilite", "sourcecode", "listing",
                "mono", "monospace", "console", "terminal", "shell", "bash", "language-", "lang-"]
LANG_PREFIXES = ["language-", "lang-", "highlight-"]
LANGUAGE_ALIASES = {
    "py": "python", "python": "python", "python3": "python", "js": "javascript", "javascript": "javascript",
    "jsx": "javascript", "ts": "typescript", "typescript": "typescript", "tsx": "typescript", "rb": "ruby",
    "ruby": "ruby", "sh": "bash", "bash": "bash", "shell": "bash", "zsh": "bash", "css": "css", "html": "html",
    "xml": "xml", "json": "json", "yaml": "yaml", "yml": "yaml", "sql": "sql", "java": "java", "c": "c",
    "cpp": "cpp", "c++": "cpp", "csharp": "csharp", "cs": "csharp", "go": "go", "golang": "go", "rust": "rust",
    "rs": "rust", "php": "php", "swift": "swift", "kotlin": "kotlin", "kt": "kotlin", "scala": "scala", "r": "r",
    "dart": "dart", "lua": "lua", "perl": "perl", "powershell": "powershell", "ps1": "powershell",
    "dockerfile": "dockerfile", "docker": "dockerfile", "makefile": "makefile", "make": "makefile",
    "toml": "toml", "ini": "ini", "conf": "ini", "md": "markdown", "markdown": "markdown",
    "plaintext": "plaintext", "text": "plaintext", "txt": "plaintext",
}
# content heuristics, tried in order on the first ten lines, lower-cased
LANG_HEURISTICS = [
    ("python", r"(?m)^(def |class |import |from .+ import |if __name__)"),
    ("javascript", r"(const |let |var |function |=>|require\(|import .+ from)"),
    ("html", r"(?i)<(!DOCTYPE|html|head|body|div|span|p )"),
    ("css", r"[{}\s]*(margin|padding|display|font-size|color)\s*:"),
    ("sql", r"(?im)^(SELECT|INSERT|UPDATE|DELETE|CREATE|ALTER|DROP)\s"),
    ("bash", r"(?m)^(#!/bin/|apt-get|sudo |echo |export |cd |ls |mkdir )"),
]
MIN_PARAGRAPH_WORDS_HARD = 5
MERGE_MAX_WORDS = 15
MAIN_MIN_CHARS = 100
AD_MIN_CHARS = 10
# --------------------------------------------------------------------------

MARK_RE = r"(?i)(</?(?:" + "|".join(BLOCK_TAGS) + r")\b[^>]*>)"
MARK = "\u0001"
CLASS_RE = r"""(?is)\sclass\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""
ID_RE = r"""(?is)\sid\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""
STYLE_RE = r"""(?is)\sstyle\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def attr(opener: Column, pattern: str) -> Column:
    """Attribute value of an opening tag ('' when absent)."""
    return F.concat(F.regexp_extract(opener, pattern, 1), F.regexp_extract(opener, pattern, 2),
                    F.regexp_extract(opener, pattern, 3))


def word_count(s: Column) -> Column:
    """V2: ``len(s.split())`` -- 0 for blank text."""
    return once(pystrip(s), lambda t: F.when(t == "", F.lit(0)).otherwise(F.size(F.split(t, WS + "+"))))


def collapse_ws(s: Column) -> Column:
    """V1: runs of whitespace -> one space, stripped."""
    return pystrip(F.regexp_replace(s, WS + "+", " "))


def frags(x: Column) -> Column:
    """Text fragments between tags: entity-decoded, stripped, blanks dropped."""
    return F.filter(F.transform(F.split(x, "<[^>]*>"), lambda f: pystrip(entity_decode(f))), lambda f: f != "")


def format_text(x: Column, br_newline: bool = True) -> Column:
    """Text with whitespace kept: tags dropped (``<br>`` -> newline unless in
    ``pre``), entities decoded."""
    y = F.regexp_replace(x, r"(?i)<br\s*/?>", "\n") if br_newline else x
    return entity_decode(F.regexp_replace(y, "<[^>]*>", ""))


def symbol_class(cfg: EngineConfig = DEFAULT) -> str:
    """Negated character class of the code symbols; brackets escaped and '-'
    last, so the same text works in Java regex and RE2."""
    chars = cfg.symbol_chars
    body = "".join(ch for ch in chars if ch not in "]-^\\[")
    esc = ("\\]" if "]" in chars else "") + ("\\[" if "[" in chars else "") + ("\\^" if "^" in chars else "")
    return "[^" + esc + body + ("-" if "-" in chars else "") + "]"


def symbol_density(text: Column, cfg: EngineConfig = DEFAULT) -> Column:
    """V4: share of characters in the code-symbol set."""
    cls = symbol_class(cfg)
    return F.length(F.regexp_replace(text, cls, "")) / F.length(text)


def indent_ratio(text: Column) -> Column:
    """V4: indented (two spaces or a tab) lines among non-blank lines."""
    lines = F.filter(F.split(text, "\n"), lambda ln: pystrip(ln) != "")
    return once(lines, lambda x: F.size(F.filter(x, lambda ln: ln.startswith("  ") | ln.startswith("\t"))) / F.greatest(F.size(x), F.lit(1)))


def is_code_by_density(text: Column, cfg: EngineConfig = DEFAULT) -> Column:
    """>= 20 stripped chars and density >= d, or >= 0.6 d with >= 40 %
    indented lines."""
    ok = (F.length(pystrip(text)) >= 20) & (F.length(text) > 0)
    return ok & once(symbol_density(text, cfg), lambda d: (d >= cfg.min_symbol_density) |
                     ((d >= cfg.min_symbol_density * 0.6) & (indent_ratio(text) >= 0.4)))


def has_code_class(opener: Column) -> Column:
    """A code class substring, or an inline monospace / courier font."""
    def named(cls):
        hit = F.lit(False)
        for p in CODE_CLASSES:
            hit = hit | cls.contains(p)
        return hit
    return once(F.lower(attr(opener, CLASS_RE)), named) | \
        once(F.lower(attr(opener, STYLE_RE)), lambda style: style.contains("monospace") | style.contains("courier"))


def language_alias(raw: Column) -> Column:
    """V5: alias map lookup, 'unknown' otherwise."""
    m = F.create_map(*[F.lit(x) for kv in LANGUAGE_ALIASES.items() for x in kv])
    return F.coalesce(F.element_at(m, pystrip(raw)), F.lit("unknown"))


def guess_language(text: Column) -> Column:
    """Content heuristics over the first ten lines, lower-cased."""
    first = F.lower(F.array_join(F.slice(F.split(pystrip(text), "\n"), 1, 10), "\n"))
    st = pystrip(text)
    out = F.when((st.startswith("{") & st.endswith("}")) | (st.startswith("[") & st.endswith("]")),
                 F.lit("json")).otherwise(F.lit("unknown"))
    for lang, pat in reversed(LANG_HEURISTICS):
        out = F.when(first.rlike(pat), F.lit(lang)).otherwise(out)
    return out


def code_language(opener: Column, text: Column) -> Column:
    """Class prefix -> class name -> data-language/data-lang -> content."""
    classes = F.filter(F.split(F.lower(attr(opener, CLASS_RE)), r"\s+"), lambda c: c != "")
    pref = F.transform(classes, lambda c: F.coalesce(
        *[F.when(c.startswith(p) & (F.length(c) > len(p)), F.substring(c, len(p) + 1, 1 << 30)) for p in LANG_PREFIXES]))
    first_pref = F.try_element_at(F.filter(pref, lambda x: x.isNotNull()), F.lit(1))
    named = F.try_element_at(F.filter(F.transform(classes, language_alias), lambda x: x != "unknown"), F.lit(1))
    dl = attr(opener, r"""(?is)\sdata-language\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
    dl2 = attr(opener, r"""(?is)\sdata-lang\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
    data_lang = F.when(dl != "", dl).when(dl2 != "", dl2)
    return (F.when(first_pref.isNotNull(), language_alias(first_pref))
            .when(named.isNotNull(), named)
            .when(data_lang.isNotNull(), language_alias(F.lower(data_lang)))
            .otherwise(guess_language(text)))


def _block(type_: Column | str, content: Column, level=None, language=None, items=None, pos=None) -> Column:
    t = F.lit(type_) if isinstance(type_, str) else type_
    return F.struct(t.alias("type"), content.alias("content"),
                    (level if level is not None else F.lit(None).cast("int")).alias("level"),
                    (language if language is not None else F.lit(None).cast("string")).alias("language"),
                    (items if items is not None else F.lit(None).cast("array<string>")).alias("items"),
                    (pos if pos is not None else F.lit(0)).cast("int").alias("pos"))


# ------------------------------------------------------------------ cleaning
TOKEN_RE = "<[^>]*>|[^<]+|<"
KEY_RE = r"^<(/?[a-zA-Z][a-zA-Z0-9]*)"


def with_tokens(df: DataFrame, src: str) -> DataFrame:
    """``_tok`` (tags and texts of ``src``), ``_key`` (``div``, ``/div`` or ''
    for each) and ``_end`` (where the element that starts there ends)."""
    df = df.withColumn("_tok", F.regexp_extract_all(F.col(src), F.lit(TOKEN_RE), 0))
    df = df.withColumn("_key", F.transform("_tok", lambda t: F.lower(F.regexp_extract(t, KEY_RE, 1))))
    return row_barrier(df.withColumn("_end", element_ends("_key")))


def _spans(flag) -> Column:
    """Elements whose (key, start tag) are flagged: structs (s, e, opener, inner)."""
    each = F.transform("_tok", lambda t, i: F.when(
        (F.get("_key", i) != "") & ~F.get("_key", i).startswith("/") & flag(F.get("_key", i), t),
        F.struct(i.alias("s"), F.get("_end", i).alias("e"), F.get("_key", i).alias("key"), t.alias("opener"))))
    found = F.filter(each, lambda x: x.isNotNull())
    return F.transform(found, lambda x: x.withField("inner", F.array_join(F.slice("_tok", x["s"] + 2, F.greatest(x["e"] - x["s"] - 1, F.lit(0))), "")))


CODE_TAGS = ["pre", "code", "samp", "kbd"]


def is_code_element(key: Column, opener: Column, inner: Column, cfg: EngineConfig = DEFAULT) -> Column:
    """Code by tag, by class, or by the density of its text: never stripped."""
    return key.isin(*CODE_TAGS) | has_code_class(opener) | is_code_by_density(format_text(inner), cfg)


def tag_flag(tags):
    return lambda key, opener: key.isin(*tags)


def class_flag(names):
    """H6: a class or the id contains a name."""
    alt = "|".join(re.escape(n.lower()) for n in names)
    return lambda key, opener: F.lower(F.concat(attr(opener, CLASS_RE), F.lit(" "), attr(opener, ID_RE))).rlike(alt) if names else F.lit(False)


def hidden_flag(key, opener):
    """H7: inline display:none or visibility:hidden."""
    return F.replace(F.lower(attr(opener, STYLE_RE)), F.lit(" "), F.lit("")).rlike("display:none|visibility:hidden")


def strip_elements(df: DataFrame, src: str, out: str, flag, cfg: EngineConfig = DEFAULT) -> DataFrame:
    """H5-H7: ``src`` without the flagged elements, whole subtrees by their own
    end tag; code elements are spared."""
    keep = [c for c in df.columns if c != out]
    d = with_tokens(df, src)
    d = d.withColumn("_sp", F.filter(_spans(flag), lambda x: ~is_code_element(x["key"], x["opener"], x["inner"], cfg)))
    d = d.withColumn("_sp", F.transform("_sp", lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"))))
    left = F.filter("_tok", lambda t, i: ~F.exists("_sp", lambda x: (x["s"] <= i) & (i < x["e"])))
    return d.select(*keep, F.when(F.size("_sp") > 0, F.array_join(left, "")).otherwise(F.col(src)).alias(out))


def main_content(df: DataFrame, src: str, out: str) -> DataFrame:
    """H4: the main content of ``src``. Candidates are the outermost articles
    (or, without any, main elements, or else the body); their score is text
    length x (1 - share of link text). All candidates with a fifth of the best
    score are kept, in page order; the whole document when they hold 100
    characters or less."""
    keep = [c for c in df.columns if c != out]
    d = with_tokens(df, src).withColumn("_all", _spans(tag_flag(["article", "main", "body"])))
    for tag in ("article", "main", "body"):
        d = d.withColumn(f"_{tag}", F.expr(f"filter(_all, x -> x.key = '{tag}')"))
    pick = F.when(F.size("_article") > 0, F.col("_article")).when(F.size("_main") > 0, F.col("_main")).otherwise(F.col("_body"))
    d = d.withColumn("_cand", pick)
    d = d.withColumn("_cand", F.filter("_cand", lambda x: ~F.exists("_cand", lambda y: (y["s"] < x["s"]) & (x["s"] < y["e"]))))

    def text_len(x):
        return F.length(F.regexp_replace(x, "<[^>]*>", ""))

    def inner(x):  # without the end tag, if there is one
        return F.regexp_replace(x["inner"], "(?i)</(article|main|body)\\s*>$", "")
    links = lambda x: text_len(F.array_join(F.regexp_extract_all(x, F.lit(r"(?is)<a\b[^>]*>.*?</a\s*>"), 0), ""))
    d = d.withColumn("_cand", F.transform("_cand", lambda x: F.struct(inner(x).alias("x"), (text_len(x["inner"]) - links(x["inner"])).alias("score"))))
    d = d.withColumn("_top", F.array_max(F.transform("_cand", lambda x: x["score"])))
    d = d.withColumn("_m", F.array_join(F.transform(F.filter("_cand", lambda x: x["score"] * 5 >= F.col("_top")), lambda x: x["x"]), ""))
    return d.select(*keep, F.when(F.length(pystrip(F.col("_m"))) > MAIN_MIN_CHARS, F.col("_m")).otherwise(F.col(src)).alias(out))


def clean_main(df: DataFrame, html_col: str, out: str, cfg: EngineConfig = DEFAULT) -> DataFrame:
    """Main content without comments, scripts, styles, stripped tags and
    classes, and hidden elements."""
    d = df.withColumn("_raw", strip_raw_text(F.col(html_col)))
    d = main_content(d, "_raw", out)
    flags = [tag_flag(cfg.strip_tags), class_flag(cfg.strip_classes), hidden_flag]
    d = strip_elements(d, out, out, lambda k, o: flags[0](k, o) | flags[1](k, o) | flags[2](k, o), cfg)
    return d.drop("_raw")


# ------------------------------------------------------------------ pieces
def _add_fields(df: DataFrame, col: str, **fields) -> DataFrame:
    """One staged pass over an array of structs adding fields computed from
    the element (each later pass sees plain field references, so expression
    trees stay linear in size)."""
    def f(p):
        out = p
        for name, fn in fields.items():
            out = out.withField(name, fn(p))
        return out
    return df.withColumn(col, F.transform(F.col(col), f))


def with_pieces(df: DataFrame, src: str, col: str = "_P") -> DataFrame:
    """H1 (block level): ordered pieces of ``src`` split before every
    block-level tag: (idx, key like 'p' / '/p', tag, opener, body)."""
    parts = F.split(F.regexp_replace(F.col(src), MARK_RE, MARK + "$1"), MARK)

    def one(x, i):
        key = F.when(i == 0, F.lit("")).otherwise(F.lower(F.regexp_extract(x, r"^<(/?[a-zA-Z0-9]+)", 1)))
        opener = F.when(i == 0, F.lit("")).otherwise(F.regexp_extract(x, r"^(<[^>]*>)", 1))
        return F.struct(i.alias("idx"), key.alias("key"), opener.alias("opener"), F.length(x).alias("rawlen"), x.alias("raw"))
    df = df.withColumn(col, F.transform(parts, one))
    df = _add_fields(df, col, tag=lambda p: F.regexp_replace(p["key"], "^/", ""),
                     body=lambda p: F.substring(p["raw"], F.length(p["opener"]) + 1, 1 << 30))
    df = _add_fields(df, col, frags=lambda p: frags(p["body"]), has_tags=lambda p: p["body"].rlike("<[a-zA-Z]"))
    return df


CONTAINERS = ["div", "td", "section", "blockquote", "ul", "ol", "article", "pre", "li", "header", "footer"]


def with_elements(df: DataFrame, html_col: str = "html", cfg: EngineConfig = DEFAULT,
                  main_only: bool = True) -> DataFrame:
    """Stage the per-row element model on ``_P``: span ends, span text, pass-2
    code verdicts; and ``_code_spans``. ``main_only=False`` models the whole
    page (comments, scripts and styles removed)."""
    df = clean_main(df, html_col, "_main", cfg) if main_only else df.withColumn("_main", strip_raw_text(F.col(html_col)))
    df = with_pieces(df, "_main")
    df = df.withColumn("_K", F.transform("_P", lambda p: p["key"]))
    df = row_barrier(df.withColumn("_E", piece_ends("_K")))

    def end(p):
        cont = p["tag"].isin(*CONTAINERS) & ~p["key"].startswith("/")
        return F.when(cont, F.get("_E", p["idx"])).otherwise(p["idx"] + 1)
    df = _add_fields(df, "_P", end=end)
    df = df.withColumn("_PR", F.transform("_P", lambda p: p["raw"])).withColumn(
        "_PF", F.transform("_P", lambda p: p["frags"]))

    def span_raw(p):
        return F.array_join(F.slice(F.col("_PR"), p["idx"] + 1, F.greatest(p["end"] - p["idx"], F.lit(1))), "")

    def span_frags(p):
        return F.flatten(F.slice(F.col("_PF"), p["idx"] + 1, F.greatest(p["end"] - p["idx"], F.lit(1))))
    df = _add_fields(df, "_P", span_raw=span_raw, span_frags=span_frags,
                     pass2=lambda p: p["tag"].isin("div", "p", "td") & ~p["key"].startswith("/"))
    df = _add_fields(df, "_P", inner=lambda p: F.substring(p["span_raw"], F.length(p["opener"]) + 1, 1 << 30))
    df = _add_fields(df, "_P", ctext=lambda p: F.when(p["pass2"] | (p["key"] == "pre"),
                                                      format_text(p["inner"], br_newline=True)),
                     pretext=lambda p: F.when(p["key"] == "pre", format_text(p["inner"], br_newline=False)))
    df = _add_fields(df, "_P", is_code=lambda p: p["pass2"] & (has_code_class(p["opener"]) |
                                                               is_code_by_density(p["ctext"], cfg)))
    spans = F.filter(F.col("_P"), lambda p: p["is_code"] | (p["key"] == "pre"))
    return df.withColumn("_code_spans", F.transform(spans, lambda p: F.struct(p["idx"].alias("s"), p["end"].alias("e"))))


def _in_code(spans: Column, i: Column, strict: bool = False) -> Column:
    if strict:
        return F.exists(spans, lambda s: (s["s"] < i) & (i < s["e"]))
    return F.exists(spans, lambda s: (s["s"] <= i) & (i < s["e"]))


# ------------------------------------------------------------------ blocks
def with_text_blocks(df: DataFrame, cfg: EngineConfig = DEFAULT, out: str = "_text_raw") -> DataFrame:
    """Headings, paragraph-like blocks and lists, document order."""
    spans = F.col("_code_spans")
    df = _add_fields(df, "_P", opener_ok=lambda p: ~p["key"].startswith("/") & (p["key"] != "") &
                     ~_in_code(spans, p["idx"]),
                     ptxt=lambda p: F.array_join(F.when(p["tag"] == "p", p["frags"]).otherwise(p["span_frags"]), " "),
                     pplain=lambda p: F.length(F.array_join(F.when(p["tag"] == "p", p["frags"]).otherwise(p["span_frags"]), "")))
    df = _add_fields(df, "_P", w=lambda p: word_count(p["ptxt"]),
                     dens=lambda p: F.when(~p["has_tags"], F.lit(1.0)).otherwise(
                         p["pplain"] / F.when(p["tag"] == "p", p["rawlen"] + 4)
                         .otherwise(F.length(p["span_raw"]) + F.length(p["tag"]) + 3)))
    P = F.col("_P")

    df = df.withColumn("_L", F.filter(P, lambda p: p["key"].isin("ul", "ol")))

    def items(p):
        # items of this list, not of a list inside it
        lis = F.filter(P, lambda q: (q["key"] == "li") & (q["idx"] > p["idx"]) & (q["idx"] < p["end"])
                       & ~F.exists("_L", lambda r: (r["idx"] > p["idx"]) & (r["idx"] < q["idx"]) & (q["idx"] < r["end"])))
        txt = F.transform(lis, lambda q: F.array_join(F.flatten(F.slice(F.col("_PF"), q["idx"] + 1,
                                                                          F.greatest(F.least(q["end"], p["end"]) - q["idx"], F.lit(1)))), " "))
        return F.filter(txt, lambda x: x != "")
    df = _add_fields(df, "_P", items=lambda p: F.when(p["tag"].isin("ul", "ol") & p["opener_ok"], items(p)))

    def one(p):
        i, tag, w = p["idx"], p["tag"], p["w"]
        gate = ~((w < cfg.min_block_words) & (tag != "blockquote") & (w < MIN_PARAGRAPH_WORDS_HARD)) & \
            ~((p["dens"] < cfg.min_text_density) & (w < cfg.min_block_words)) & (p["ptxt"] != "")
        head = _block("heading", F.array_join(p["frags"], ""), level=F.substring(tag, 2, 1).cast("int"), pos=i)
        para = _block(F.when(tag == "blockquote", "blockquote").otherwise("paragraph"), p["ptxt"], pos=i)
        lst = _block(F.when(tag == "ol", "ordered_list").otherwise("unordered_list"),
                     F.array_join(F.transform(p["items"], lambda s: F.concat(F.lit("• "), s)), "\n"),
                     items=p["items"], pos=i)
        ok = p["opener_ok"]
        return (F.when(ok & tag.isin("h1", "h2", "h3", "h4", "h5", "h6") & (F.size(p["frags"]) > 0), head)
                .when(ok & tag.isin("p", "article", "section", "blockquote") & gate, para)
                .when(ok & tag.isin("ul", "ol") & (F.size(p["items"]) > 0), lst))
    return df.withColumn(out, F.filter(F.transform(P, one), lambda b: b.isNotNull()))


def _lang_fields(df: DataFrame, col: str, opener: str, text: str) -> DataFrame:
    """Stage H16 on an array of structs with ``opener`` and ``text`` fields."""
    df = _add_fields(df, col,
                     _cls=lambda e: F.filter(F.split(F.lower(attr(e[opener], CLASS_RE)), r"\s+"), lambda c: c != ""),
                     _dl=lambda e: F.concat(attr(e[opener], r"""(?is)\sdata-language\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""),
                                            F.lit("|"),
                                            attr(e[opener], r"""(?is)\sdata-lang\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")),
                     _st=lambda e: pystrip(e[text]))
    df = _add_fields(df, col,
                     _first=lambda e: F.lower(F.array_join(F.slice(F.split(e["_st"], "\n"), 1, 10), "\n")),
                     _pref=lambda e: F.try_element_at(F.filter(F.transform(e["_cls"], lambda c: F.coalesce(
                         *[F.when(c.startswith(p) & (F.length(c) > len(p)), F.substring(c, len(p) + 1, 1 << 30))
                           for p in LANG_PREFIXES])), lambda x: x.isNotNull()), F.lit(1)),
                     _named=lambda e: F.try_element_at(F.filter(F.transform(e["_cls"], language_alias),
                                                               lambda x: x != "unknown"), F.lit(1)))

    def lang(e):
        dl = F.split(e["_dl"], r"\|")
        data_lang = F.when(dl[0] != "", dl[0]).when(dl[1] != "", dl[1])
        st = e["_st"]
        guess = F.when((st.startswith("{") & st.endswith("}")) | (st.startswith("[") & st.endswith("]")),
                       F.lit("json")).otherwise(F.lit("unknown"))
        for lg, pat in reversed(LANG_HEURISTICS):
            guess = F.when(e["_first"].rlike(pat), F.lit(lg)).otherwise(guess)
        return (F.when(e["_pref"].isNotNull(), language_alias(e["_pref"]))
                .when(e["_named"].isNotNull(), e["_named"])
                .when(data_lang.isNotNull(), language_alias(F.lower(data_lang)))
                .otherwise(guess))
    return _add_fields(df, col, language=lang)


def with_code_blocks(df: DataFrame, cfg: EngineConfig = DEFAULT, out: str = "_code") -> DataFrame:
    """Pass 1 (pre, then code, samp, kbd outside earlier hits), then
    pass 2 (div/p/td by class or density, outermost wins) in document order."""
    spans = F.col("_code_spans")
    pres = F.transform(F.filter("_P", lambda p: p["key"] == "pre"),
                       lambda p: F.struct(p["opener"].alias("opener"), p["pretext"].alias("text"), F.lit(0).alias("pass")))
    rest = F.regexp_replace(F.col("_main"), r"(?is)<pre\b[^>]*>.*?</pre\s*>", "")
    parts = [pres]
    for k, t in enumerate(("code", "samp", "kbd"), start=1):
        pat = rf"(?is)<{t}\b([^>]*)>(.*?)</{t}\s*>"
        z = F.arrays_zip(F.regexp_extract_all(rest, F.lit(pat), 1).alias("o"),
                         F.regexp_extract_all(rest, F.lit(pat), 2).alias("x"))
        parts.append(F.transform(z, lambda e: F.struct(F.concat(F.lit("<x "), e["o"], F.lit(">")).alias("opener"),
                                                       format_text(e["x"]).alias("text"), F.lit(k).alias("pass"))))
        rest = F.regexp_replace(rest, pat, "")
    hits = F.filter("_P", lambda p: p["is_code"] & ~_in_code(spans, p["idx"], strict=True))
    parts.append(F.transform(hits, lambda p: F.struct(p["opener"].alias("opener"), p["ctext"].alias("text"),
                                                      F.lit(4).alias("pass"))))
    df = df.withColumn("_C", F.filter(F.concat(*parts), lambda e: pystrip(e["text"]) != ""))
    df = _lang_fields(df, "_C", "opener", "text")
    return df.withColumn(out, F.transform("_C", lambda e: _block("code_block", e["text"], language=e["language"])))


def post_process(blocks: Column) -> Column:
    """Collapse whitespace, drop empties, drop case-insensitive repeats
    (first kept), merge consecutive short paragraphs. Order-dependent, so one
    in-row fold."""
    init = F.struct(F.array().cast(f"array<{BLOCK_TYPE_POS}>").alias("out"),
                    F.array().cast("array<string>").alias("seen"))

    def step(acc, b):
        return once(collapse_ws(b["content"]), lambda c: one(acc, b, c))

    def one(acc, b, c):
        key = F.lower(c)
        out, seen = acc["out"], acc["seen"]
        last = F.try_element_at(out, F.lit(-1))
        merge = (b["type"] == "paragraph") & (F.size(out) > 0) & (last["type"] == "paragraph") & \
            (word_count(last["content"]) < MERGE_MAX_WORDS) & (word_count(c) < MERGE_MAX_WORDS) & \
            ~F.regexp_replace(last["content"], WS + "+$", "").rlike(r"[.!?:]$")
        merged_last = last.withField("content", F.concat(last["content"], F.lit(" "), c))
        new_out = F.when(merge, F.concat(F.slice(out, 1, F.size(out) - 1), F.array(merged_last))) \
            .otherwise(F.concat(out, F.array(b.withField("content", c))))
        skip = (c == "") | F.array_contains(seen, key)
        return F.when(skip, acc).otherwise(F.struct(new_out.alias("out"), F.concat(seen, F.array(key)).alias("seen")))
    return F.aggregate(blocks, init, step, lambda acc: acc["out"])


BLOCK_TYPE_POS = "struct<type:string,content:string,level:int,language:string,items:array<string>,pos:int>"


def interleave(text: Column, code: Column) -> Column:
    """Code block k goes after text block ceil((k+1) T / (C+1)) - 1."""
    nt, nc = F.size(text), F.size(code)
    tk = F.transform(text, lambda b, i: F.struct(i.alias("a"), F.lit(0).alias("b"), F.lit(0).alias("c"), b.alias("blk")))
    ck = F.transform(code, lambda b, k: F.struct(
        (F.floor(((k + 1) * nt + nc) / (nc + 1)) - 1).cast("int").alias("a"), F.lit(1).alias("b"), k.alias("c"),
        b.alias("blk")))
    return F.transform(F.array_sort(F.concat(tk, ck)), lambda x: x["blk"])


def target_blocks(df: DataFrame, html_col: str, kinds: list[str]) -> DataFrame:
    """``_header`` / ``_footer``, the texts of these elements; H21:
    ``_ad``, elements whose class or id contains an ad word, with a text longer
    than 10 characters (an ad inside an ad is one of its own)."""
    keep = df.columns
    d = with_tokens(df.withColumn("_raw", strip_raw_text(F.col(html_col))), "_raw")
    out = []
    for kind in kinds:
        flag = tag_flag([kind]) if kind != "ad" else class_flag(sorted(set(AD_WORDS)))
        least = 0 if kind != "ad" else AD_MIN_CHARS
        txt = F.transform(_spans(flag), lambda x: F.array_join(frags(x["inner"]), " "))
        out.append(F.transform(F.filter(txt, _longer(least)), _target(f"{kind}_content")).alias(f"_{kind}"))
    return d.select(*keep, *out)


def _longer(least: int):
    return lambda x: F.length(x) > least


def _target(name: str):
    return lambda x: _block(name, x, pos=F.lit(-1))


def extract_blocks(pages: DataFrame, targets=("text",), html_col: str = "html",
                   cfg: EngineConfig = DEFAULT) -> DataFrame:
    """Pages -> (page_id, ..., blocks array) with header/footer/ad
    targets; blank html gives no row."""
    targets = list(targets) or ["text"]
    df = pages.where(pystrip(F.col(html_col)) != "")
    kinds = [kind for target, kind in (("headers", "header"), ("footers", "footer"), ("ads", "ad")) if target in targets]
    if kinds:
        df = target_blocks(df, html_col, kinds)
    df = with_elements(df, html_col, cfg)
    df = with_text_blocks(df, cfg)
    df = df.withColumn("_text", post_process(F.col("_text_raw")))
    df = with_code_blocks(df, cfg)
    blocks = interleave(F.col("_text"), F.col("_code"))
    if "headers" in targets:
        blocks = F.concat(F.col("_header"), blocks)
    if "footers" in targets:
        blocks = F.concat(blocks, F.col("_footer"))
    if "ads" in targets:
        blocks = F.concat(blocks, F.col("_ad"))
    df = df.withColumn("_all", blocks)
    out = F.transform(F.filter("_all", lambda b: pystrip(b["content"]) != ""), lambda b: b.dropFields("pos"))
    keep = [c for c in pages.columns if c != html_col]
    return df.select(*keep, out.alias("blocks"))


def blocks_relational(blocks_df: DataFrame, key: str = "page_id") -> DataFrame:
    """Relational form: (page_id, pos, type, content, level, language, items)."""
    # inline (not posexplode + field access): the generator emits the fields
    # directly, so no nested-field rewrite reaches back into the extraction.
    withpos = F.transform("blocks", lambda b, i: F.struct(i.alias("pos"), b["type"].alias("type"),
                                                          b["content"].alias("content"), b["level"].alias("level"),
                                                          b["language"].alias("language"), b["items"].alias("items")))
    # inline_outer: a plain inline/explode makes Spark infer size(arr) > 0 and
    # push it below the projections, re-evaluating the extraction there.
    return blocks_df.select(key, F.inline_outer(withpos)).where(F.col("pos").isNotNull())


def block_type_counts(blocks_df: DataFrame, key: str = "page_id") -> DataFrame:
    """Blocks and code blocks per page (per row, no shuffle)."""
    return blocks_df.select(key, F.size("blocks").cast("bigint").alias("block_count"),
                            F.size(F.filter("blocks", lambda b: b["type"] == "code_block")).cast("bigint")
                            .alias("code_blocks"))
