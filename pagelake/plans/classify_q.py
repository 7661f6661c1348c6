"""Queries: rule classifier over the stored category table (C1-C7), classification text (C8-C11), scorers
(C12), LLM prompt/response columns (C14-C18), category resolution (C19).

Input: every document as a fetched page -- url from its source and language,
title, paragraph blocks from its lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..config import DEFAULT
from ..functions.html import sql_pystrip as STRIP
from ..functions.urls import sql_domain
from ..operators import category_index as I
from ..operators import classify as C
from ..operators import versions as X
from ..sources import views as V
from ..sources.tables import read_table
from .blocks_q import WS
from .registry import register

CFG = DEFAULT
LABELS = list(CFG.candidate_labels)


def _sql_label(i: str) -> str:
    return f"([{', '.join(repr(x) for x in LABELS)}])[{i} + 1]"


#: Categories of the configuration, which come after the stored ones: name -> keywords. Their ids are below 0.
DEFAULTS = {"technology": ["software", "programming", "api"], "articles": ["the", "la", "der"], "small words": ["of the", "de la", "und"]}


def docs(spark, d, parts: int | None = None):
    """(doc_id, url, title, text, blocks), in ``parts`` partitions if given."""
    t = read_table(spark, d, "documents")
    t = t.repartition(parts) if parts else t
    return t.select("doc_id",
                    F.concat(F.lit("https://"), F.col("source"), F.lit("."), F.col("lang"), F.lit(".example.com/"),
                             F.col("lang"), F.lit("/"), F.col("doc_id").cast("string")).alias("url"),
                    F.concat(F.lit("Doc "), F.col("doc_id").cast("string")).alias("title"),
                    "text", X.paragraph_blocks(F.col("text")).alias("blocks"))


# ---- DuckDB twins -------------------------------------------------------------
SQL_LINES = f"list_filter(string_split(text, chr(10)), lambda x: {STRIP('x')} <> '')"
SQL_DOCS = ("SELECT doc_id, 'https://' || source || '.' || lang || '.example.com/' || lang || '/' || CAST(doc_id AS VARCHAR) "
            f"AS url, 'Doc ' || CAST(doc_id AS VARCHAR) AS title, text, {SQL_LINES} AS lines FROM documents")
SQL_FLAT = "array_to_string(lines, ' ')"


def sql_words(t: str) -> str:
    s = STRIP(t)
    return f"(CASE WHEN {s} = '' THEN []::VARCHAR[] ELSE regexp_split_to_array({s}, '{WS}+') END)"


SQL_CATS = ("cats AS (SELECT category_id, name, keywords, url_patterns, FALSE AS is_default FROM v_rule_categories WHERE is_active UNION ALL "
            + " UNION ALL ".join(f"SELECT {-i - 1}, '{n}', {ks!r}, [], TRUE" for i, (n, ks) in enumerate(DEFAULTS.items())) + ")")
SQL_KEYS = ("keys AS (SELECT category_id, n, lower(k) AS k, count(*) AS weight FROM (SELECT category_id, len(keywords) AS n, unnest(keywords) AS k FROM cats) WHERE k <> '' GROUP BY ALL)")
SQL_PAGES = (f"pages_ AS (SELECT doc_id, url, tl, {sql_words('tl')} AS wl, list_filter(regexp_split_to_array({sql_domain('lower(url)')}, '[.\\-]'), lambda s: s <> '') AS hp "
             f"FROM (SELECT doc_id, url, lower({SQL_FLAT}) AS tl FROM ({SQL_DOCS})) WHERE {STRIP('tl')} <> '')")
SQL_URL = (f"u_ AS (SELECT DISTINCT doc_id, category_id FROM (SELECT doc_id, lower(url) AS lu, {sql_domain('lower(url)')} AS host FROM pages_), "
           "(SELECT category_id, lower(p.type) AS t, lower(p.pattern) AS v, p.pattern AS raw FROM (SELECT category_id, unnest(url_patterns) AS p FROM cats)) WHERE v <> '' AND CASE t "
           "WHEN 'contains' THEN contains(lu, v) WHEN 'starts_with' THEN starts_with(lu, v) WHEN 'ends_with' THEN ends_with(lu, v) "
           "WHEN 'domain' THEN host = v OR ends_with(host, '.' || v) WHEN 'regex' THEN regexp_matches(lu, raw, 'i') ELSE FALSE END)")
SQL_KEY = ("hits AS (SELECT doc_id, w AS k, count(*) AS c FROM (SELECT doc_id, unnest(wl) AS w FROM pages_) GROUP BY ALL UNION ALL "
           "SELECT doc_id, k, CAST((length(tl) - length(replace(tl, k, ''))) / length(k) AS BIGINT) FROM pages_, (SELECT DISTINCT k FROM keys WHERE contains(k, ' ')) WHERE contains(tl, k)), "
           f"k_ AS (SELECT doc_id, category_id, least(any_value(matched) / n * {C.COVERAGE_W} + least(any_value(total) / (any_value(len(wl)) / 100.0), 1.0) * {C.DENSITY_W}, 1.0) AS k FROM "
           "(SELECT doc_id, category_id, n, count(*) AS matched, sum(c * weight) AS total FROM hits JOIN keys USING (k) GROUP BY ALL) JOIN pages_ USING (doc_id) GROUP BY doc_id, category_id, n)")
SQL_DOM = ("d_ AS (SELECT DISTINCT doc_id, category_id FROM (SELECT doc_id, unnest(hp) AS part FROM pages_) JOIN (SELECT DISTINCT part, category_id FROM "
           "(SELECT DISTINCT unnest(hp) AS part FROM pages_), keys WHERE contains(part, k)) USING (part))")
SQL_SCORES = (f"WITH {SQL_CATS}, {SQL_KEYS}, {SQL_PAGES}, {SQL_URL}, {SQL_KEY}, {SQL_DOM}, s_ AS (SELECT doc_id, category_id, name, is_default, "
              f"u * {C.W_URL} + k * {C.W_KEYWORD} + d * {C.W_DOMAIN} AS score, u AS url_pattern, k AS keyword_frequency, d AS domain_match FROM "
              "(SELECT doc_id, category_id, max(u) AS u, max(k) AS k, max(d) AS d FROM (SELECT doc_id, category_id, 1.0::DOUBLE AS u, 0.0::DOUBLE AS k, 0.0::DOUBLE AS d FROM u_ "
              "UNION ALL SELECT doc_id, category_id, 0.0, k, 0.0 FROM k_ UNION ALL SELECT doc_id, category_id, 0.0, 0.0, 1.0 FROM d_) GROUP BY ALL) JOIN cats USING (category_id)), "
              f"best AS (SELECT * FROM s_ WHERE score >= {CFG.rule_min_confidence} QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, is_default, name, category_id) = 1)")


def stored_categories(spark, d):
    """Active stored categories, then those of the configuration whose name isn't stored."""
    stored = V.v_rule_categories(spark, d).where("is_active").select("category_id", "name", "keywords", "url_patterns", F.lit(False).alias("is_default"))
    rows = [(-i - 1, n, ks, [], True) for i, (n, ks) in enumerate(DEFAULTS.items())]
    more = spark.createDataFrame(rows, "category_id long, name string, keywords array<string>, url_patterns array<struct<type:string,pattern:string>>, is_default boolean")
    names = stored.select(F.lower("name").alias("_k"))
    return stored.unionByName(more.join(names, F.lower(more["name"]) == F.col("_k"), "left_anti"))


def flat_docs(spark, d):
    """The documents' rows are dealt over all cores first: a file is often one row group."""
    return docs(spark, d, 4 * spark.sparkContext.defaultParallelism).select("doc_id", "url", C.flatten_text(F.col("blocks")).alias("flat"))


def classified(spark, d):
    return I.classify_by_table(flat_docs(spark, d), stored_categories(spark, d), "doc_id", "url", "flat", CFG)


@register("flatten_text", sql=f"SELECT doc_id, {SQL_FLAT} AS text FROM ({SQL_DOCS})")
def q_flatten_text(spark, d):
    return docs(spark, d).select("doc_id", C.flatten_text(F.col("blocks")).alias("text"))


@register("score_url", sql=f"WITH {SQL_CATS}, {SQL_PAGES}, {SQL_URL} SELECT doc_id, category_id, 1.0::DOUBLE AS url_pattern FROM u_", views=["v_rule_categories"])
def q_score_url(spark, d):
    pages = I.prepared(flat_docs(spark, d), "doc_id", "url", "flat")
    return I.url_signal(pages, stored_categories(spark, d)).select(F.col("id").alias("doc_id"), "category_id", F.lit(1.0).alias("url_pattern"))


@register("score_keywords", sql=f"WITH {SQL_CATS}, {SQL_KEYS}, {SQL_PAGES}, {SQL_KEY} SELECT doc_id, category_id, round(k, 6) AS keyword_frequency FROM k_", views=["v_rule_categories"])
def q_score_keywords(spark, d):
    pages = I.prepared(flat_docs(spark, d), "doc_id", "url", "flat")
    return I.keyword_signal(pages, I.keyword_index(stored_categories(spark, d)), digits=6).select(F.col("id").alias("doc_id"), "category_id", "keyword_frequency")


@register("score_domain", sql=f"WITH {SQL_CATS}, {SQL_KEYS}, {SQL_PAGES}, {SQL_DOM} SELECT doc_id, category_id, 1.0::DOUBLE AS domain_match FROM d_", views=["v_rule_categories"])
def q_score_domain(spark, d):
    pages = I.prepared(flat_docs(spark, d), "doc_id", "url", "flat")
    return I.domain_signal(pages, I.keyword_index(stored_categories(spark, d))).select(F.col("id").alias("doc_id"), "category_id", F.lit(1.0).alias("domain_match"))


@register("score_category", sql=SQL_SCORES + " SELECT doc_id, category_id, name, score, url_pattern, round(keyword_frequency, 9) AS keyword_frequency, domain_match FROM s_",
          views=["v_rule_categories"])
def q_score_category(spark, d):
    s = I.score_by_table(flat_docs(spark, d), stored_categories(spark, d), "doc_id", "url", "flat", digits=9)
    return s.select("doc_id", "category_id", "name", "score", "url_pattern", "keyword_frequency", "domain_match")


@register("classify_pages", sql=SQL_SCORES + " SELECT doc_id, category_id, name AS category_name, round(score, 4) AS confidence, url_pattern, round(keyword_frequency, 6) AS keyword_frequency, "
          "domain_match FROM best", views=["v_rule_categories"])
def q_classify_pages(spark, d):
    return classified(spark, d).withColumn("keyword_frequency", F.round("keyword_frequency", 6))


@register("classify_batch", sql=SQL_SCORES + f" SELECT doc_id, name AS category_name, round(score, 4) AS confidence FROM documents LEFT JOIN best USING (doc_id)", views=["v_rule_categories"])
def q_classify_batch(spark, d):
    items = read_table(spark, d, "documents").select("doc_id")
    return items.join(classified(spark, d), "doc_id", "left").select("doc_id", "category_name", "confidence")


SQL_BLOCK_WORDS = f"flatten(list_transform(lines, lambda ln: {sql_words('ln')}))"


@register("class_text_service", sql=(
    f"SELECT doc_id, array_to_string(list_concat({sql_words('title')}, {SQL_BLOCK_WORDS})[1:{CFG.max_words}], ' ') AS text "
    f"FROM ({SQL_DOCS})"))
def q_class_text_service(spark, d):
    t = docs(spark, d)
    return t.select("doc_id", C.class_text_service(F.col("title"), F.col("blocks"), CFG.max_words).alias("text"))


@register("class_text_worker", sql=(
    f"SELECT doc_id, {STRIP(chr(40) + 'title || ' + chr(39) + ' ' + chr(39) + ' || array_to_string(' + SQL_BLOCK_WORDS + '[1:' + str(CFG.max_words) + '], ' + chr(39) + ' ' + chr(39) + ')' + chr(41))} AS text "
    f"FROM ({SQL_DOCS})"))
def q_class_text_worker(spark, d):
    t = docs(spark, d)
    return t.select("doc_id", C.class_text_worker(F.col("title"), F.col("blocks"), CFG.max_words).alias("text"))


@register("truncate_words", sql=(
    f"SELECT doc_id, CASE WHEN len({sql_words('text')}) <= {CFG.max_words} THEN text ELSE "
    f"array_to_string({sql_words('text')}[1:{CFG.max_words}], ' ') END AS text FROM documents"))
def q_truncate_words(spark, d):
    t = read_table(spark, d, "documents")
    return t.select("doc_id", C.truncate_words(F.col("text"), CFG.max_words).alias("text"))


SQL_RAW_LABELS = "p_name || ', ' || p_brand || ',, ' || p_type || ' ,'"


@register("candidate_labels", sql=(
    f"SELECT p_partkey, array_to_string(list_filter(list_transform(string_split({SQL_RAW_LABELS}, ','), lambda x: {STRIP('x')}), "
    f"lambda x: x <> ''), '|') AS labels FROM part"))
def q_candidate_labels(spark, d):
    p = read_table(spark, d, "part")
    raw = F.concat(F.col("p_name"), F.lit(", "), F.col("p_brand"), F.lit(",, "), F.col("p_type"), F.lit(" ,"))
    return p.select("p_partkey", F.array_join(C.candidate_labels(raw), "|").alias("labels"))


def _sql_kw_scorer(t: str) -> str:
    scores = ", ".join(
        f"{{'l': '{l}', 's': least(((length({t}) - length(replace({t}, '{l.lower()}', ''))) / {max(len(l), 1)}) / 3.0, 1.0), 'i': {i}}}"
        for i, l in enumerate(LABELS))
    return (f"list_sort(list_transform(list_filter([{scores}], lambda x: x.s >= {CFG.confidence_threshold}), "
            f"lambda x: {{'neg': -x.s, 'i': x.i, 'l': x.l}}))")


SQL_SCORER = (f"SELECT doc_id, CASE WHEN {STRIP('txt')} = '' THEN ({_sql_kw_scorer('lower(txt)')})[1:0] ELSE {_sql_kw_scorer('lower(txt)')} END AS r FROM ("
              f"SELECT doc_id, array_to_string(list_concat({sql_words('title')}, {SQL_BLOCK_WORDS})[1:{CFG.max_words}], ' ') AS txt "
              f"FROM ({SQL_DOCS}))")


def _scored(spark, d, scorer="keyword"):
    t = docs(spark, d).withColumn("txt", C.class_text_service(F.col("title"), F.col("blocks"), CFG.max_words))
    return t.withColumn("r", C.classify_with_scorer(F.col("txt"), scorer, LABELS, CFG.confidence_threshold))


@register("classify_with_scorer", sql=(
    f"SELECT doc_id, array_to_string(list_transform(r, lambda x: x.l), '|') AS labels, "
    f"array_to_string(list_transform(r, lambda x: CAST(round(-x.neg, 6) AS VARCHAR)), '|') AS scores, "
    f"r[1].l AS primary_label FROM ({SQL_SCORER})"))
def q_classify_with_scorer(spark, d):
    s = _scored(spark, d)
    return s.select("doc_id", F.array_join("r.labels", "|").alias("labels"),
                    F.array_join(F.transform("r.scores", lambda x: F.round(x, 6).cast("string")), "|").alias("scores"),
                    F.col("r.primary_label").alias("primary_label"))


def _pandas_keyword(texts, labels):
    import pandas as pd
    low = texts.fillna("").str.lower()
    rows_l, rows_s = [], []
    for t in low:
        sc = [min(t.count(l.lower()) / 3.0, 1.0) for l in labels]
        rows_l.append(list(labels))
        rows_s.append(sc)
    return pd.DataFrame({"labels": rows_l, "scores": rows_s})


C.register_scorer("pandas-keyword", _pandas_keyword)


@register("classify_with_scorer_pandas")
def q_classify_with_scorer_pandas(spark, d):
    s = _scored(spark, d, "PANDAS-KEYWORD")
    return s.select("doc_id", F.array_join("r.labels", "|").alias("labels"), F.col("r.primary_label").alias("primary_label"))


@register("llm_prompt", sql=(
    "SELECT doc_id, '" + C.PROMPT_TEMPLATE.split("{text}")[0].replace("{labels}", ", ".join(LABELS)).replace("{{", "{")
    .replace("}}", "}").replace("'", "''") + "' || CASE WHEN length(text) > 3000 THEN substr(text, 1, 3000) || '...' ELSE text END "
    "AS prompt FROM documents"))
def q_llm_prompt(spark, d):
    t = read_table(spark, d, "documents")
    return t.select("doc_id", C.llm_prompt(F.col("text"), LABELS, CFG.llm_max_chars).alias("prompt"))


@register("llm_request_body", sql=(
    "SELECT conv_id, turn, CAST(to_json({'model': 'classifier', 'messages': [{'role': 'user', 'content': text}], 'temperature': 0.0, "
    "'stream': false}) AS VARCHAR) AS chat, CAST(to_json({'model': 'classifier', 'prompt': text, 'stream': false, "
    "'options': {'temperature': 0.0}}) AS VARCHAR) AS generate FROM conversations"))
def q_llm_request_body(spark, d):
    t = read_table(spark, d, "conversations")
    return t.select("conv_id", "turn", C.llm_request_body(F.col("text"), "classifier", "openai_chat").alias("chat"),
                    C.llm_request_body(F.col("text"), "classifier", "generate").alias("generate"))


@register("llm_response_text", sql=(
    "SELECT conv_id, turn, json_extract_string(to_json({'choices': [{'message': {'content': text}}]}), '$.choices[0].message.content') "
    "AS chat, json_extract_string(to_json({'response': text}), '$.response') AS generate FROM conversations"))
def q_llm_response_text(spark, d):
    t = read_table(spark, d, "conversations")
    chat = F.to_json(F.struct(F.array(F.struct(F.struct(F.col("text").alias("content")).alias("message"))).alias("choices")))
    gen = F.to_json(F.struct(F.col("text").alias("response")))
    return t.select("conv_id", "turn", C.llm_response_text(chat, "openai_chat").alias("chat"),
                    C.llm_response_text(gen, "generate").alias("generate"))


def _responses(spark, d):
    """Model responses derived from conversation turns: plain JSON, fenced,
    embedded in prose, or no JSON at all, labels picked by conversation id."""
    t = read_table(spark, d, "conversations")
    n = len(LABELS)
    l1 = F.element_at(F.array(*[F.lit(x) for x in LABELS]), (F.col("conv_id") % n + 1).cast("int"))
    l2 = F.upper(F.element_at(F.array(*[F.lit(x) for x in LABELS]), ((F.col("conv_id") * 7) % n + 1).cast("int")))
    obj = F.concat(F.lit('{"labels": ["'), l1, F.lit('", "'), l2, F.lit('", "Unknown"], "scores": [0.55, '),
                   ((F.col("turn") % 5) / 4.0).cast("string"), F.lit(', "x"]}'))
    k = F.col("turn") % 4
    resp = (F.when(k == 0, obj).when(k == 1, F.concat(F.lit("```json\n"), obj, F.lit("\n```")))
            .when(k == 2, F.concat(F.lit("Sure. "), obj, F.lit(" Thanks."))).otherwise(F.col("text")))
    return t.select("conv_id", "turn", resp.alias("resp"))


SQL_RESP = ("SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN obj WHEN 1 THEN '```json' || chr(10) || obj || chr(10) || '```' "
            "WHEN 2 THEN 'Sure. ' || obj || ' Thanks.' ELSE text END AS resp FROM (SELECT conv_id, turn, text, "
            "'{\"labels\": [\"' || (" + "[" + ", ".join(f"'{x}'" for x in LABELS) + f"])[conv_id % {len(LABELS)} + 1] || '\", \"' || "
            "upper((" + "[" + ", ".join(f"'{x}'" for x in LABELS) + f"])[(conv_id * 7) % {len(LABELS)} + 1]) || "
            "'\", \"Unknown\"], \"scores\": [0.55, ' || CAST((turn % 5) / 4.0 AS VARCHAR) || ', \"x\"]}' AS obj FROM conversations)")
SQL_EXTRACT = (f"SELECT conv_id, turn, CASE WHEN resp IS NULL OR resp = '' THEN NULL WHEN json_valid(body) AND starts_with(body, '{{') "
               f"THEN body WHEN blk <> '' AND json_valid(blk) THEN blk END AS obj FROM (SELECT *, regexp_extract(body, "
               f"'(?s)\\{{[^{{}}]*(?:\\{{[^{{}}]*\\}}[^{{}}]*)*\\}}', 0) AS blk FROM (SELECT *, CASE WHEN fenced THEN {STRIP('b2')} ELSE b2 END AS body "
               f"FROM (SELECT *, CASE WHEN fenced AND ends_with(b1, '```') THEN substr(b1, 1, length(b1) - 3) ELSE b1 END AS b2 FROM ("
               f"SELECT *, CASE WHEN fenced AND strpos(c, chr(10)) > 0 THEN substr(c, strpos(c, chr(10)) + 1) ELSE c END AS b1 FROM ("
               f"SELECT conv_id, turn, resp, {STRIP('resp')} AS c, starts_with({STRIP('resp')}, '```') AS fenced FROM ({SQL_RESP}))))))")


@register("llm_json_extract", sql=SQL_EXTRACT)
def q_llm_json_extract(spark, d):
    r = _responses(spark, d)
    return r.select("conv_id", "turn", C.llm_json_extract(F.col("resp")).alias("obj"))


SQL_CANON = "CASE lower(" + STRIP("lb") + ") " + " ".join(f"WHEN '{x.lower()}' THEN '{x}'" for x in LABELS) + " END"
SQL_PARSE = (
    "SELECT conv_id, turn, CASE WHEN bad THEN '' ELSE array_to_string(list_transform(srt, lambda z: z.l), '|') END AS labels, "
    "CASE WHEN bad THEN '' ELSE array_to_string(list_transform(srt, lambda z: CAST(z.s AS VARCHAR)), '|') END AS scores, "
    "CASE WHEN bad THEN NULL ELSE srt[1].l END AS primary_label, CASE WHEN bad THEN 'no_json' END AS error FROM ("
    "SELECT *, list_sort(list_transform(list_filter(pairs, lambda z: z.l IS NOT NULL), "
    "lambda z: {'neg': -z.s, 'i': z.i, 'l': z.l, 's': z.s})) AS srt FROM ("
    f"SELECT *, list_transform(p.labels, lambda lb, i: {{'l': {SQL_CANON}, 's': greatest(0.0, least(1.0, CASE WHEN i <= len(p.scores) "
    "THEN coalesce(TRY_CAST(p.scores[i] AS DOUBLE), 1.0) ELSE 1.0 END)), 'i': i}) AS pairs FROM ("
    "SELECT *, obj IS NULL OR p IS NULL OR p.labels IS NULL AS bad FROM (SELECT conv_id, turn, obj, "
    "json_transform(obj, '{\"labels\": [\"VARCHAR\"], \"scores\": [\"VARCHAR\"]}') AS p FROM (" + SQL_EXTRACT + ")))))")


@register("llm_parse_labels", sql=SQL_PARSE)
def q_llm_parse_labels(spark, d):
    r = _responses(spark, d).withColumn("obj", C.llm_json_extract(F.col("resp")))
    p = r.withColumn("res", C.llm_parse_labels(F.col("obj"), LABELS))
    return p.select("conv_id", "turn", F.array_join("res.labels", "|").alias("labels"),
                    F.array_join(F.transform("res.scores", lambda x: x.cast("string")), "|").alias("scores"),
                    F.col("res.primary_label").alias("primary_label"), F.col("res.error").alias("error"))


SQL_ASKED = (f"asked AS (SELECT conv_id, turn, unnest(r) AS label, unnest(generate_series(0, len(r) - 1)) AS pos FROM (SELECT conv_id, turn, CASE WHEN labels = '' THEN ['Uncategorized'] "
             f"ELSE string_split(labels, '|') END AS r FROM ({SQL_PARSE}))), "
             # the stored names: the table's, and every fourth candidate label in capitals
             "names AS (SELECT category_id, name FROM v_category_table UNION ALL SELECT 1000000000 + p_partkey, upper(l) FROM (SELECT p_partkey, "
             + _sql_label("p_partkey") + " AS l FROM part WHERE p_partkey < 25 AND p_partkey % 4 = 0)), "
             "have AS (SELECT lower(name) AS k, min(category_id) AS category_id, min_by(name, category_id) AS name FROM names GROUP BY 1), "
             "spelled AS (SELECT lower(label) AS k, min_by(label, (conv_id, turn, pos)) AS label FROM asked GROUP BY 1)")


@register("resolve_categories", sql=f"WITH {SQL_ASKED} SELECT a.conv_id, a.turn, CAST(a.pos AS BIGINT) AS pos, coalesce(h.category_id, -CAST('0x' || substr(md5(s.k), 1, 15) AS BIGINT) - 1) AS category_id, "
          "coalesce(h.name, s.label) AS name, h.category_id IS NULL AS created FROM asked a JOIN spelled s ON s.k = lower(a.label) LEFT JOIN have h ON h.k = s.k", views=["v_category_table"])
def q_resolve_categories(spark, d):
    r = _responses(spark, d).withColumn("res", C.llm_parse_labels(C.llm_json_extract(F.col("resp")), LABELS))
    rows, _ = I.resolve_labels(r.select(F.struct("conv_id", "turn").alias("response"), F.col("res.labels").alias("labels")), stored_names(spark, d), "response")
    return rows.select("response.conv_id", "response.turn", "pos", "category_id", "name", "created")


def stored_names(spark, d):
    """The category table's names, and every fourth candidate label in capitals."""
    part = read_table(spark, d, "part").where("p_partkey < 25 and p_partkey % 4 = 0")
    label = F.element_at(F.array(*map(F.lit, LABELS)), (F.col("p_partkey") + 1).cast("int"))
    return V.v_category_table(spark, d).select("category_id", "name").unionByName(part.select((1_000_000_000 + F.col("p_partkey")).alias("category_id"), F.upper(label).alias("name")))
