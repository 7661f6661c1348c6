"""Classification.

The rule classifier here scores every page against a configuration-sized list
of categories *inside the page's row*: keyword counts are array filters over
the page's own word array, URL patterns and domain tests are static predicates.
No pair table (page x category) is ever formed and nothing is shuffled. A
stored category table of any size goes through ``category_index``, and so does
a list too long to be part of a plan.

The one extension point is the scorer (C12): a name picks a Column builder;
the native keyword scorer and ``none`` are pure expressions, model scorers are
Iterator pandas UDFs registered by name.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import add, or_

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import DEFAULT, EngineConfig
from ..functions.html import WS, once, pystrip
from ..functions.rules import rule_predicate
from ..functions.urls import url_domain

MAX_INLINE_CATEGORIES = 5000
# --------------------------------------------------------------------------
# FIXED VALUES -- signal weights, prompt template, limits.
# --------------------------------------------------------------------------
W_URL, W_KEYWORD, W_DOMAIN = 0.3, 0.5, 0.2
COVERAGE_W, DENSITY_W = 0.7, 0.3
PROMPT_TEMPLATE = (
    "You are a content classifier. Classify the following text into one or "
    "more of these categories: {labels}.\n\n"
    "Respond ONLY with a JSON object in this exact format, no other text:\n"
    '{{"labels": ["Category1", "Category2"], "scores": [0.9, 0.7]}}\n\n'
    "Only include categories you are confident about (score >= 0.4). "
    "If none fit, return empty arrays: {{\"labels\": [], \"scores\": []}}.\n\n"
    "Text to classify:\n{text}"
)
# --------------------------------------------------------------------------

CLASS_RESULT = "struct<labels:array<string>,scores:array<double>,primary_label:string,primary_score:double,error:string>"


def words_of(text: Column) -> Column:
    """Whitespace tokens (``str.split()``), empty for blank text."""
    t = pystrip(text)
    return F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, WS + "+"))


def flatten_text(blocks: Column) -> Column:
    """Non-empty block contents joined by one space."""
    return F.array_join(F.filter(F.transform(blocks, lambda b: b["content"]),
                                 lambda c: c.isNotNull() & (c != "")), " ")


def _eq(v: str):
    return lambda w: w == v


def _has(v: str):
    return lambda p: p.contains(v)


def score_url(url: Column, patterns: list[dict]) -> Column:
    """1.0 when any url pattern matches."""
    if not patterns:
        return F.lit(0.0)
    return F.when(reduce(or_, [rule_predicate(url, p.get("type", ""), p.get("pattern", "")) for p in patterns]),
                  F.lit(1.0)).otherwise(F.lit(0.0))


def score_keywords(text_lc: Column, words_lc: Column, keywords: list[str], known: Column | None = None) -> Column:
    """coverage*0.7 + min(matches per 100 words, 1)*0.3, capped at 1.
    Single words count by token equality, phrases by substring count.
    ``known``, if given, holds those of the words that are keywords at all, so
    that the text's words aren't gone through for every keyword."""
    if not keywords:
        return F.lit(0.0)
    counts = []
    for k in keywords:
        kl = k.lower()
        if " " in kl:
            c = ((F.length(text_lc) - F.length(F.replace(text_lc, F.lit(kl), F.lit("")))) / F.lit(len(kl))).cast("int") \
                if kl else F.lit(0)
        else:
            c = F.size(F.filter(words_lc if known is None else known, _eq(kl)))
        counts.append((kl, c))
    total = reduce(add, [c for _, c in counts])
    distinct = sorted({kl for kl, _ in counts})
    matched = reduce(add, [F.when(reduce(or_, [c > 0 for k2, c in counts if k2 == kl]), 1).otherwise(0)
                           for kl in distinct])
    n = F.size(words_lc)
    cov = matched / F.lit(len(keywords))
    dens = F.least(total / (n / 100.0), F.lit(1.0))
    score = F.least(cov * COVERAGE_W + dens * DENSITY_W, F.lit(1.0))
    return F.when((n == 0) | (total == 0), F.lit(0.0)).otherwise(score)


def score_domain(host_parts: Column, keywords: list[str]) -> Column:
    """C4: 1.0 when a keyword is a substring of any host part; a blank one never is."""
    keywords = [k for k in keywords if k]
    if not keywords:
        return F.lit(0.0)
    hit = reduce(or_, [F.exists(host_parts, _has(k.lower())) for k in keywords])
    return F.when(hit, F.lit(1.0)).otherwise(F.lit(0.0))


def score_categories(df: DataFrame, url_col: str, text_col: str, categories: list[dict]) -> DataFrame:
    """``scores`` per row, a struct for each category in order: (ord, name,
    score, url_pattern, keyword_frequency, domain_match). For lists short enough
    to be part of the plan; a category table goes through ``category_index``."""
    d = df.withColumn("_tl", F.lower(F.col(text_col))).withColumn("_wl", words_of(F.col("_tl"))) \
        .withColumn("_hp", F.filter(F.split(url_domain(F.lower(F.col(url_col))), r"[.\-]"), lambda s: s != ""))
    single = sorted({k.lower() for c in categories for k in c.get("keywords") or [] if " " not in k})
    d = d.withColumn("_kw", F.filter("_wl", lambda w: w.isin(single)) if single else F.array().cast("array<string>"))
    scored = []
    for i, c in enumerate(categories):
        kw = list(c.get("keywords") or [])
        u = score_url(F.col(url_col), list(c.get("url_patterns") or []))
        k = score_keywords(F.col("_tl"), F.col("_wl"), kw, F.col("_kw"))
        dm = score_domain(F.col("_hp"), kw)
        scored.append(F.struct(F.lit(i).alias("ord"), F.lit(c["name"]).alias("name"),
                               (u * W_URL + k * W_KEYWORD + dm * W_DOMAIN).alias("score"),
                               u.alias("url_pattern"), k.alias("keyword_frequency"), dm.alias("domain_match")))
    return d.withColumn("scores", F.array(*scored) if scored else F.array().cast(SCORE_TYPE)).drop("_tl", "_wl", "_hp", "_kw")


SCORE_TYPE = "array<struct<ord:int,name:string,score:double,url_pattern:double,keyword_frequency:double,domain_match:double>>"


def classify_pages(df: DataFrame, url_col: str, text_col: str, categories: list[dict],
                   cfg: EngineConfig = DEFAULT) -> DataFrame:
    """Best category per row -> struct(category_name, confidence,
    url_pattern, keyword_frequency, domain_match) or NULL. Categories:
    dicts (name, keywords, url_patterns) in order; ties go to the first. A list
    of more than MAX_INLINE_CATEGORIES becomes a table."""
    if len(categories) > MAX_INLINE_CATEGORIES:
        return _classify_by_long_list(df, url_col, text_col, categories, cfg)
    d = score_categories(df, url_col, text_col, categories).withColumnRenamed("scores", "_sc")
    best = F.try_element_at(F.array_sort(F.filter("_sc", lambda s: s["score"] > 0),
                                         lambda a, b: F.when(a["score"] > b["score"], -1)
                                         .when(a["score"] < b["score"], 1)
                                         .otherwise(a["ord"] - b["ord"])), F.lit(1))
    ok = best.isNotNull() & (best["score"] >= cfg.rule_min_confidence) & (pystrip(F.col(text_col)) != "")
    res = F.when(ok, F.struct(best["name"].alias("category_name"), F.round(best["score"], 4).alias("confidence"),
                              best["url_pattern"].alias("url_pattern"),
                              best["keyword_frequency"].alias("keyword_frequency"),
                              best["domain_match"].alias("domain_match")))
    from ..plans.windows import row_barrier
    return row_barrier(d.withColumn("classification", res).drop("_sc"))


def _classify_by_long_list(df: DataFrame, url_col: str, text_col: str, categories: list[dict], cfg: EngineConfig) -> DataFrame:
    """The same through the category table; pages with equal url and text share one classification."""
    from .category_index import classify_by_table
    rows = [(i, f"{i:09d}", c["name"], list(c.get("keywords") or []), [(p.get("type"), p.get("pattern")) for p in c.get("url_patterns") or []]) for i, c in enumerate(categories)]
    table = df.sparkSession.createDataFrame(rows, "category_id long, name string, spelled string, keywords array<string>, url_patterns array<struct<type:string,pattern:string>>")
    key = F.struct(*[F.xxhash64(F.lit(salt), F.col(url_col), F.col(url_col).isNull(), F.col(text_col)).alias(salt) for salt in ("a", "b")])
    keyed = df.withColumn("_key", key)
    pages = keyed.select("_key", F.col(url_col).alias("_url"), F.col(text_col).alias("_text")).dropDuplicates(["_key"])
    best = classify_by_table(pages, table, "_key", "_url", "_text", cfg).join(F.broadcast(table.select("category_id", "spelled")), "category_id")
    best = best.select("_key", F.struct(F.col("spelled").alias("category_name"), "confidence", "url_pattern", "keyword_frequency", "domain_match").alias("classification"))
    return keyed.join(best, "_key", "left").drop("_key")


def class_text_service(title: Column, blocks: Column, max_words: int) -> Column:
    """Title then non-code blocks within one word budget. The blocks' texts are split up to the budget only. A missing title, or a
    block without content, uses the budget up."""
    texts = F.transform(F.filter(blocks, lambda b: ~F.coalesce(b["type"] == "code_block", F.lit(False))), lambda b: b["content"])
    body = F.get(F.transform(F.array(texts), lambda t: F.array_join(F.when(
        F.exists(t, lambda c: c.isNull()), F.slice(t, 1, F.array_position(F.transform(t, lambda c: c.isNull()), True).cast("int") - 1)).otherwise(t), " ")), F.lit(0))
    none = F.array().cast("array<string>")
    # the last part of a split with a limit is the rest of the text
    first = F.get(F.transform(F.array(pystrip(body)), lambda t: F.when(t == "", none).otherwise(F.slice(F.split(t, WS + "+", max_words + 1), 1, max_words))), F.lit(0))
    return F.when(title.isNull() & blocks.isNotNull(), F.lit("")).otherwise(F.array_join(F.slice(F.concat(words_of(title), first), 1, max_words), " "))


def class_text_worker(title: Column, blocks: Column, max_words: int) -> Column:
    """Title outside the budget; every block (code too) counts."""
    init = F.struct(F.array().cast("array<string>").alias("parts"), F.lit(0).alias("n"), F.lit(False).alias("stop"))

    def step(acc, b):
        w = words_of(F.coalesce(b["content"], F.lit("")))
        rem = F.lit(max_words) - acc["n"]
        stop = acc["stop"] | (rem <= 0)
        nxt = F.struct(F.concat(acc["parts"], F.array(F.array_join(F.slice(w, 1, F.greatest(rem, F.lit(0))), " "))).alias("parts"),
                       (acc["n"] + F.least(F.size(w), rem)).alias("n"), F.lit(False).alias("stop"))
        return F.when(stop, acc.withField("stop", F.lit(True))).otherwise(nxt)
    body = F.aggregate(blocks, init, step, lambda acc: F.array_join(acc["parts"], " "))
    return pystrip(F.concat(F.coalesce(title, F.lit("")), F.lit(" "), body))


def truncate_words(text: Column, n: int) -> Column:
    """First ``n`` words, text unchanged when it has at most ``n``."""
    w = words_of(text)
    return F.when(F.size(w) <= n, text).otherwise(F.array_join(F.slice(w, 1, n), " "))


def candidate_labels(raw: Column) -> Column:
    """C11: comma list -> stripped labels, blanks dropped."""
    return F.filter(F.transform(F.split(raw, ","), lambda x: pystrip(x)), lambda x: x != "")


# ------------------------------------------------------------------ scorers
def _result(labels: Column, scores: Column, threshold: float, error: Column | None = None) -> Column:
    """F15 + stable sort by score desc + primary."""
    z = F.filter(F.arrays_zip(labels.alias("label"), scores.alias("score")), lambda x: x["score"] >= threshold)
    zi = F.transform(z, lambda x, i: F.struct(x["label"].alias("label"), x["score"].alias("score"), i.alias("i")))
    srt = F.array_sort(zi, lambda a, b: F.when(a["score"] > b["score"], -1).when(a["score"] < b["score"], 1)
                       .otherwise(a["i"] - b["i"]))
    err = error if error is not None else F.lit(None).cast("string")

    def parts(srt):
        lab = F.transform(srt, lambda x: x["label"])
        sc = F.transform(srt, lambda x: x["score"].cast("double"))
        return F.struct(lab.alias("labels"), sc.alias("scores"), F.try_element_at(lab, F.lit(1)).alias("primary_label"),
                        F.try_element_at(sc, F.lit(1)).alias("primary_score"), err.alias("error"))
    return once(srt, parts)


def _empty_result(error: Column | None = None) -> Column:
    return F.struct(F.array().cast("array<string>").alias("labels"), F.array().cast("array<double>").alias("scores"),
                    F.lit(None).cast("string").alias("primary_label"), F.lit(None).cast("double").alias("primary_score"),
                    (error if error is not None else F.lit(None).cast("string")).alias("error"))


def keyword_scorer(text: Column, labels: list[str], threshold: float) -> Column:
    """Native deterministic scorer: occurrences of the lower-cased label in
    the lower-cased text, a third of a point each, capped at 1."""

    def score(t, label):
        found = (F.length(t) - F.length(F.replace(t, F.lit(label.lower()), F.lit("")))) / F.lit(max(len(label), 1))
        return F.when(F.contains(t, F.lit(label.lower())), F.least(found / 3.0, F.lit(1.0))).otherwise(F.lit(0.0))
    # the text is lower-cased once for all labels
    scores = F.get(F.transform(F.array(F.lower(text)), lambda t: F.array(*[score(t, l) for l in labels])), F.lit(0))
    return _result(F.array(*[F.lit(l) for l in labels]), scores, threshold)


_PANDAS_SCORERS: dict[str, Callable] = {}


def register_scorer(name: str, fn: Callable[..., pd.DataFrame], loader: Callable[[], object] | None = None) -> bool:
    """Register a pandas scorer: (texts, labels[, what the loader returns]) ->
    frame with list columns ``labels`` and ``scores``. Names are
    case-insensitive; a second registration of a name is ignored (returns
    False)."""
    key = name.strip().lower()
    if key in _PANDAS_SCORERS or key in ("none", "keyword"):
        return False
    _PANDAS_SCORERS[key] = (fn, loader)
    return True


def classify_with_scorer(text: Column, scorer: str, labels: list[str], threshold: float) -> Column:
    """Blank text or no labels -> empty; unknown name -> the null scorer."""
    key = (scorer or "none").strip().lower()
    blank = pystrip(F.coalesce(text, F.lit(""))) == ""
    if not labels or key == "none" or (key != "keyword" and key not in _PANDAS_SCORERS):
        return _empty_result()
    if key == "keyword":
        return F.when(blank, _empty_result()).otherwise(keyword_scorer(text, labels, threshold))
    from .scorer_udf import make_scorer_udf
    fn, loader = _PANDAS_SCORERS[key]
    r = make_scorer_udf(fn, labels, loader)(text)
    return F.when(blank, _empty_result()).otherwise(
        F.when(r["error"].isNotNull(), _empty_result(r["error"])).otherwise(_result(r["labels"], r["scores"], threshold)))


# ------------------------------------------------------------------ LLM text
def llm_prompt(text: Column, labels: list[str], max_chars: int = 3000) -> Column:
    """C14: template filled; text cut at ``max_chars`` plus '...'."""
    head, tail = PROMPT_TEMPLATE.split("{text}")
    head = head.replace("{labels}", ", ".join(labels)).replace("{{", "{").replace("}}", "}")
    cut = F.when(F.length(text) > max_chars, F.concat(F.substring(text, 1, max_chars), F.lit("..."))).otherwise(text)
    return F.concat(F.lit(head), cut, F.lit(tail))


def llm_request_body(prompt: Column, model: str, api_format: str) -> Column:
    """Request JSON for the chat or the generate format."""
    if api_format == "openai_chat":
        return F.to_json(F.struct(F.lit(model).alias("model"),
                                  F.array(F.struct(F.lit("user").alias("role"), prompt.alias("content"))).alias("messages"),
                                  F.lit(0.0).alias("temperature"), F.lit(False).alias("stream")))
    return F.to_json(F.struct(F.lit(model).alias("model"), prompt.alias("prompt"), F.lit(False).alias("stream"),
                              F.struct(F.lit(0.0).alias("temperature")).alias("options")))


def llm_response_text(body: Column, api_format: str) -> Column:
    """Generated text of a response body."""
    if api_format == "openai_chat":
        return F.get_json_object(body, "$.choices[0].message.content")
    return F.get_json_object(body, "$.response")


def llm_json_extract(text: Column) -> Column:
    """C17: JSON object text: fence stripped, whole text if it is an object,
    else the first brace block (one nesting level) if that parses."""
    def unfenced(c):
        inner = F.when(F.instr(c, "\n") > 0, F.substring(c, F.instr(c, "\n") + 1, 1 << 30)).otherwise(c)
        cut = once(inner, lambda x: pystrip(F.when(x.endswith("```"), F.substring(x, F.lit(1), F.length(x) - 3)).otherwise(x)))
        return F.when(c.startswith("```"), cut).otherwise(c)

    def found(body):
        is_obj = F.get_json_object(body, "$").isNotNull() & body.startswith("{")
        block = F.regexp_extract(body, r"(?s)\{[^{}]*(?:\{[^{}]*\}[^{}]*)*\}", 0)
        return F.when(is_obj, body).otherwise(once(block, lambda x: F.when((x != "") & F.get_json_object(x, "$").isNotNull(), x)))
    return F.when(text.isNull() | (text == ""), F.lit(None)).otherwise(once(pystrip(text), lambda c: once(unfenced(c), found)))


def llm_parse_labels(obj_text: Column, candidates: list[str]) -> Column:
    """Keep candidate labels (case-insensitive, canonical spelling),
    score default 1.0, clamp to [0, 1], stable sort by score desc."""
    canon = F.create_map(*[x for c in candidates for x in (F.lit(c.strip().lower()), F.lit(c))])

    def kept(raw_l, raw_s):
        pairs = F.transform(raw_l, lambda l, i: F.struct(
            F.element_at(canon, F.lower(pystrip(l))).alias("label"),
            F.when(i < F.size(raw_s), F.coalesce(F.element_at(raw_s, i + 1).try_cast("double"), F.lit(1.0)))
            .otherwise(F.lit(1.0)).alias("s")))
        return F.filter(pairs, lambda p: p["label"].isNotNull())

    def named(pairs):
        return _result(F.transform(pairs, lambda p: p["label"]), F.transform(pairs, lambda p: F.greatest(F.lit(0.0), F.least(F.lit(1.0), p["s"]))), -1.0)

    def result(parsed):
        return F.when(parsed.isNull() | parsed["labels"].isNull(), _empty_result(F.lit("no_json"))).otherwise(once(kept(parsed["labels"], parsed["scores"]), named))
    return F.when(obj_text.isNull(), _empty_result(F.lit("no_json"))).otherwise(once(F.from_json(obj_text, "struct<labels:array<string>,scores:array<string>>"), result))
