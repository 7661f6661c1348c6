"""The registered queries of this subpackage: each applies one operator, with production parameters, to its whole table
and derives the agreed digest columns from the operator's results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, collocations, decontaminate, fingerprints, html_main, jaccard, langid, mixing, quality, secrets, substrings, toxicity, whitening
from .common import read

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def crc_of_id() -> Column:
    return F.crc32(F.col("doc_id").cast("string"))


# -- 1 -----------------------------------------------------------------------------------------------------------

@query
def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    rules = quality.learn(docs, read(spark, sf_dir, "labels"))
    return quality.judge(docs, rules).select(F.col("row.doc_id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines",
                                             "n_repeat_words", "base_failed", "kept")


# -- 2 -----------------------------------------------------------------------------------------------------------

@query
def op2_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = [r.kind for r in secrets.BASE]
    found = secrets.scan(read(spark, sf_dir, "documents")).withColumn("b", F.filter("spans", lambda s: s["kind"].isin(base)))

    def joined(spans: str) -> Column:
        return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))

    def count(kind: str) -> Column:
        return F.size(F.filter("b", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", *map(count, base), F.sha2(joined("b"), 256).alias("base_sha256"), joined("spans").alias("spans"))


# -- 3 -----------------------------------------------------------------------------------------------------------

@query
def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = F.coalesce(crc_of_id() % 5 == 0, F.lit(False))
    learnt = read(spark, sf_dir, "labels").where(~held_out)
    model = toxicity.train(docs.where(~held_out), learnt)
    return toxicity.score(docs, model).select("doc_id", held_out.alias("held_out"), "score", "predicted")


# -- 4 -----------------------------------------------------------------------------------------------------------

@query
def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    listed = F.array_join(F.sort_array(F.transform("items", lambda i: i.cast("string"))), ",")
    return found.select("doc_id", "n_words", decontaminate.hit_words().alias("n_hit"), F.size("items").cast("long").alias("n_items"),
                        F.sha2(listed, 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"))


ORACLE_SQL["op4_decontamination"] = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bi AS (SELECT item_id, w, unnest(generate_series(1, greatest(len(w) - 9, 1))) AS s FROM b WHERE len(w) > 0),
bw AS (SELECT DISTINCT item_id, array_to_string(w[s:s + 9], ' ') AS t, least(len(w), 10) AS n FROM bi),
ln AS (SELECT DISTINCT n FROM bw),
di AS (SELECT r, n, unnest(generate_series(1, len(w) - n + 1)) AS s, unnest([array_to_string(w[x:x + n - 1], ' ') for x in generate_series(1, len(w) - n + 1)]) AS t FROM d, ln WHERE len(w) >= n),
h AS (SELECT r, s, di.n, item_id FROM di JOIN bw ON bw.n = di.n AND bw.t = di.t),
p AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(generate_series(s, s + n - 1)) AS p FROM h) GROUP BY r),
i AS (SELECT r, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM h GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN p USING (r) LEFT JOIN i USING (r)"""


# -- 5 -----------------------------------------------------------------------------------------------------------

CHAT_BUDGET, CHAT_HISTORY = 1024, 256


@query
def op5_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    odd = f"{chat.END}{chat.START}assistant ok"
    more = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"),
                                 F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(odd).alias("text"))
    back = chat.read_back(chat.windows(turns.unionByName(more), CHAT_BUDGET, CHAT_HISTORY))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    each = F.sort_array(F.collect_list(F.struct("start", said.alias("said"), F.array_join("targets", "").alias("loss"))))
    got = back.groupBy("conv_id").agg(each.alias("w"), F.sum(F.size("turns")).alias("n_turns"), F.sum("chars").alias("formatted_chars"))
    joined = lambda part: F.array_join(F.transform("w", lambda w: w[part]), "")
    got = got.select("conv_id", "n_turns", joined("said").alias("said"), joined("loss").alias("loss"), "formatted_chars")
    return got.select("conv_id", "n_turns", F.sha2("said", 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"),
                      F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars")


ORACLE_SQL["op5_chat_formatting"] = f"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS said FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok' UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'),
n AS (SELECT *, CAST(ceil(length(said) / 4.0) AS BIGINT) + 4 AS size, 24 + length(replace(replace(role, '<|', '<||'), chr(10), '<|n|>')) + length(replace(said, '<|', '<||')) AS chars,
  row_number() OVER w AS rn FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, said)),
p AS (SELECT *, sum(size) OVER (PARTITION BY conv_id ORDER BY rn) - size AS a FROM n),
c AS (SELECT *, a // {CHAT_BUDGET} AS cell, (a + size - 1) // {CHAT_BUDGET} > a // {CHAT_BUDGET} AS crossing FROM p),
s AS (SELECT *, min(a) OVER w AS start, max(a + size) OVER w AS stop, max(a + size) OVER (PARTITION BY conv_id) AS total FROM c WINDOW w AS (PARTITION BY conv_id, cell, crossing))
SELECT conv_id, CAST(count(*) AS BIGINT) AS n_turns, sha256(string_agg(role || chr(10) || said || chr(10), '' ORDER BY rn)) AS turns_sha256,
  CAST(coalesce(sum(length(said)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(said, '' ORDER BY rn) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(chars) + coalesce(sum(chars) FILTER (stop < total AND stop - a <= {CHAT_HISTORY} AND NOT (a = 0 AND role = 'system')), 0)
   + coalesce(max(chars) FILTER (a = 0 AND role = 'system'), 0) * (count(DISTINCT start) - 1) AS BIGINT) AS formatted_chars
FROM s GROUP BY conv_id"""


# -- 6 -----------------------------------------------------------------------------------------------------------

@query
def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.remove(read(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


ORACLE_SQL["op6_substring_dedup"] = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
x AS (SELECT r, unnest(generate_series(1, len(w) - 34)) AS s, unnest([md5(array_to_string(w[i:i + 34], ' ')) for i in generate_series(1, len(w) - 34)]) AS h FROM d WHERE len(w) >= 35),
t AS (SELECT h FROM x GROUP BY h HAVING count(*) > 1),
p AS (SELECT DISTINCT r, unnest(generate_series(s, s + 34)) AS p FROM x JOIN t USING (h)),
c AS (SELECT r, list(p) AS ps, count(*) AS n FROM p GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_removed,
  sha256(CASE WHEN n IS NULL THEN array_to_string(w, ' ') ELSE coalesce((SELECT string_agg(v, ' ' ORDER BY i) FROM (SELECT unnest(w) AS v, unnest(generate_series(1, len(w))) AS i) u WHERE NOT list_contains(ps, i)), '') END) AS kept_sha256
FROM d LEFT JOIN c USING (r)"""


# -- 7 -----------------------------------------------------------------------------------------------------------

@query
def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = F.coalesce(crc_of_id() % 4 == 2, F.lit(False))
    model = langid.train(docs.where(~held_out))
    return langid.identify(docs, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


# -- 8 -----------------------------------------------------------------------------------------------------------

@query
def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(read(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_links", "n_copies")


# -- 9 -----------------------------------------------------------------------------------------------------------

@query
def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_main.extract(read(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


# -- 10 ----------------------------------------------------------------------------------------------------------

#: Production parameters of the mix: thousandths by level; what isn't named weighs 1000.
MIX_WEIGHTS = {"domain": {"d0": 500, "d1": 2000}, "lang": {"en": 1500, "es": 4000}, "source": {"src3": 3000, "src7": 250}}
MIX_PERCENT, MIX_EPOCHS, MIX_SEED = 60, 3, 17


def domain() -> Column:
    """Sources are dealt to four domains by their number."""
    return F.concat(F.lit("d"), (F.regexp_extract("source", "([0-9]+)$", 1).try_cast("long") % 4).cast("string"))


def mix_levels() -> dict[str, Column]:
    return {"domain": domain(), "lang": F.col("lang"), "source": F.col("source")}


def mixed(docs: DataFrame) -> DataFrame:
    return mixing.mix(docs, mix_levels(), MIX_PERCENT, MIX_WEIGHTS, MIX_EPOCHS, MIX_SEED)


@query
def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = mixed(read(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"))
    return got.select("doc_id", F.col("mix.epoch").alias("epoch"), F.col("mix.n_tokens").alias("n_tokens"), F.col("mix.domain").alias("domain"), "lang", "source")


def _mix_sql() -> str:
    def weight(level: str) -> str:
        return f"CASE c.{level} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in MIX_WEIGHTS[level].items()) + " ELSE 1000 END"

    levels, parts, above = ["domain", "lang", "source"], [], None
    for depth, level in enumerate(levels, 1):
        at = ", ".join(f"c.{x}" for x in levels[:depth])
        same = " AND ".join(f"c.{x} = p.{x}" for x in levels[: depth - 1])
        total = f"(SELECT (sum(supply) * {MIX_PERCENT}) // 100 FROM caps)" if above is None else "any_value(p.budget)"
        join = "" if above is None else f"JOIN {above} p ON {same}"
        by = ", ".join(levels[: depth - 1]) or "1"
        ratio = f"CASE WHEN weight > 0 THEN cap::DOUBLE / weight ELSE 'inf'::DOUBLE END, {level}"
        parts.append(f"""n{depth} AS (SELECT {at}, sum(c.cap) AS cap, sum(c.supply) AS supply, {weight(level)} AS weight, {total} AS total FROM caps c {join} GROUP BY {at}),
s{depth} AS (SELECT *, coalesce(sum(cap) OVER (PARTITION BY {by} ORDER BY {ratio} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used,
 sum(weight) OVER (PARTITION BY {by} ORDER BY {ratio} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS ws,
 row_number() OVER (PARTITION BY {by} ORDER BY {ratio}) AS rn FROM n{depth}),
f{depth} AS (SELECT *, weight > 0 AND cap::HUGEINT * ws <= weight::HUGEINT * (total - used) AS filled FROM s{depth}),
g{depth} AS (SELECT *, first_value(used) OVER w AS u0, first_value(ws) OVER w AS w0 FROM f{depth} WINDOW w AS (PARTITION BY {by}, filled ORDER BY rn)),
b{depth} AS (SELECT {', '.join(levels[:depth])}, supply, CASE WHEN filled THEN cap ELSE least(cap, CASE WHEN w0 > 0 THEN weight::HUGEINT * greatest(total - u0, 0) // w0 ELSE 0 END) END AS budget FROM g{depth})""")
        above = f"b{depth}"
    return f"""WITH docs AS (SELECT doc_id, coalesce('d' || (regexp_extract(source, '([0-9]+)$', 1)::BIGINT % 4)::VARCHAR, '') AS domain, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
 len(regexp_extract_all(text, '[^\x20\x09-\x0D]+'))::BIGINT AS n, md5(concat_ws('|', doc_id::VARCHAR, md5(coalesce(text, '')))) AS key FROM documents),
caps AS (SELECT domain, lang, source, sum(n)::BIGINT AS supply, sum(n)::BIGINT * {MIX_EPOCHS} AS cap FROM docs GROUP BY ALL), {', '.join(parts)},
plan AS (SELECT domain, lang, source, (budget // supply)::BIGINT AS whole, (budget % supply)::BIGINT AS rest FROM b3 WHERE budget > 0),
o AS (SELECT d.*, whole, rest, md5(concat_ws('|', '{MIX_SEED}', (whole + 1)::VARCHAR, key)) AS ord FROM docs d JOIN plan USING (domain, lang, source)),
t AS (SELECT *, whole + CASE WHEN sum(n) OVER (PARTITION BY domain, lang, source ORDER BY ord ROWS UNBOUNDED PRECEDING) <= rest THEN 1 ELSE 0 END AS epochs FROM o)
SELECT doc_id, unnest(generate_series(1, epochs))::BIGINT AS epoch, n AS n_tokens, domain, lang, source FROM t WHERE epochs > 0"""


ORACLE_SQL["op10_mixing"] = _mix_sql()


# -- 11 ----------------------------------------------------------------------------------------------------------

@query
def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    model = whitening.fit(vectors, components=16)
    got = whitening.project(vectors, model)
    if model is None:
        model = whitening.NONE
    shares = F.array(*[F.lit(float(x)) for x in model.explained]).cast("array<double>")
    each = got.select("*", F.posexplode("whitened").alias("i", "w"))
    return each.select("vec_id", (F.col("i") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", F.col("w").alias("whitened"),
                       F.get(shares, F.col("i")).alias("explained"), F.lit(model.identity_error).alias("identity_error"), "deviation_exact")


# -- 13 ----------------------------------------------------------------------------------------------------------

@query
def op13_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.compared(read(spark, sf_dir, "documents"))


# -- 12 ----------------------------------------------------------------------------------------------------------

@query
def op12_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = collocations.best(collocations.collocations(read(spark, sf_dir, "documents"), 100, 100), 2000)
    return found.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


ORACLE_SQL["op12_phrase_collocations"] = r"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]') AS ps FROM documents),
p AS (SELECT lang, regexp_extract_all(p, '[^\x20\x09]+') AS w FROM (SELECT lang, unnest(ps) AS p FROM d) u),
n AS (SELECT lang, sum(len(w))::BIGINT AS n FROM p GROUP BY lang),
g AS (SELECT lang, k, array_to_string(w[s:s + k - 1], ' ') AS t FROM (SELECT lang, w, k, unnest(generate_series(1, len(w) - k + 1)) AS s FROM p, (VALUES (1), (2), (3), (4), (5)) v(k) WHERE len(w) >= k) x),
f AS (SELECT lang, k, t, count(*) AS f, string_split(t, ' ') AS w FROM g GROUP BY lang, k, t HAVING count(*) >= 100),
c AS (SELECT lang, k, t, w, f AS a, unnest(generate_series(1, k - 1)) AS j FROM f WHERE k > 1),
x AS (SELECT c.lang, c.k, c.t, c.a, c.j, l.f AS l, r.f AS r, n.n, (1000::HUGEINT * c.a * n.n // (l.f::HUGEINT * r.f))::BIGINT AS score FROM c JOIN n ON n.lang = c.lang
  JOIN f l ON l.lang = c.lang AND l.t = array_to_string(c.w[1:c.j], ' ') JOIN f r ON r.lang = c.lang AND r.t = array_to_string(c.w[c.j + 1:], ' ')),
y AS (SELECT * FROM x QUALIFY row_number() OVER (PARTITION BY lang, t ORDER BY score, j) = 1),
sub AS (SELECT DISTINCT lang, array_to_string(w[s:s + m - 1], ' ') AS t, a FROM (SELECT lang, w, f AS a, m, unnest(generate_series(1, k - m + 1)) AS s FROM f, (VALUES (2), (3), (4)) v(m) WHERE m < k) z),
kept AS (SELECT * FROM y WHERE NOT EXISTS (SELECT 1 FROM sub WHERE sub.lang = y.lang AND sub.t = y.t AND 100 * sub.a >= 100 * y.a))
SELECT lang, rank, t AS phrase, a, l, r, n, score FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, t) AS rank FROM kept) z WHERE rank <= 2000"""
