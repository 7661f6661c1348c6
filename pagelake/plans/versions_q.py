"""Queries: content hash/length (X1, X2), diffs (X3-X7), versions (X8, X9,
X11, W1, W2) and the version/result join (J1) over the document history."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.html import sql_pystrip
from ..functions.jsonx import content_hash, content_length, sql_content_hash, sql_content_length
from ..operators import versions as X
from ..plans.windows import DEFAULT_ID_WIDTH, lag_skew_safe
from ..sources import views as V
from ..sources.tables import read_table
from .registry import register

VIEWS = ["v_history"]


def history(spark, d):
    """(result_id, url, seq, content, _bucket): every document as one scrape of
    its source URL; the bucket coarsens the history order for the skew-safe
    scans."""
    h = V.v_history(spark, d)
    return h.select("result_id", "url", "seq", X.paragraph_blocks(F.col("text")).alias("content"),
                    F.floor(F.col("seq") / F.lit(DEFAULT_ID_WIDTH)).cast("bigint").alias("_bucket"))


def pairs(spark, d):
    """Consecutive non-empty snapshots of a URL: (prev_content, content)."""
    h = history(spark, d).where(F.size("content") > 0)
    return lag_skew_safe(h, ["url"], ["seq", "result_id"], "_bucket", ["content"]) \
        .where(F.col("prev_content").isNotNull())


def versions(spark, d):
    return X.build_versions(history(spark, d), "url", ("seq", "result_id"), "_bucket")


# ---- DuckDB side -------------------------------------------------------------
SQL_BLOCKS = (f"list_transform(list_filter(string_split(text, chr(10)), lambda x: {sql_pystrip('x')} <> ''), "
              f"lambda x: {{'type': 'paragraph', 'content': x}})")
SQL_HIST = f"SELECT result_id, url, seq, {SQL_BLOCKS} AS blocks FROM v_history"
SQL_PAIRS = (f"SELECT * FROM (SELECT result_id, url, seq, blocks AS new, lag(blocks) OVER (PARTITION BY url ORDER BY seq, result_id) "
             f"AS old FROM ({SQL_HIST}) WHERE len(blocks) > 0) WHERE old IS NOT NULL")
SQL_FLAGS = (f"SELECT *, CAST(sum(chg) OVER (PARTITION BY url ORDER BY seq, result_id ROWS UNBOUNDED PRECEDING) AS INTEGER) "
             f"AS version_number FROM (SELECT *, CASE WHEN prev_hash IS NULL OR prev_hash <> content_hash THEN 1 ELSE 0 END AS chg "
             f"FROM (SELECT *, lag(content_hash) OVER (PARTITION BY url ORDER BY seq, result_id) AS prev_hash, "
             f"lag(blocks) OVER (PARTITION BY url ORDER BY seq, result_id) AS prev_blocks FROM ("
             f"SELECT *, {sql_content_hash('blocks')} AS content_hash FROM ({SQL_HIST}) WHERE len(blocks) > 0)))")
POS_ADDED = "greatest(len(new) - len(old), 0)"
POS_REMOVED = "greatest(len(old) - len(new), 0)"
POS_MODS = "list_filter(range(least(len(old), len(new))), lambda i: old[i + 1] IS DISTINCT FROM new[i + 1])"
OK = "list_transform(old, lambda b: b.content)"
NK = "list_transform(new, lambda b: b.content)"
C_ADDED = f"len(list_filter(list_distinct({NK}), lambda k: NOT list_contains({OK}, k)))"
C_REMOVED = f"len(list_filter(list_distinct({OK}), lambda k: NOT list_contains({NK}, k)))"
C_MODS = (f"list_filter(range(least(len(old), len(new))), lambda i: NOT (old[i + 1].content = new[i + 1].content AND "
          f"old[i + 1].type = new[i + 1].type) AND list_contains({NK}, old[i + 1].content) AND list_contains({OK}, new[i + 1].content))")


@register("content_hash", sql=f"SELECT result_id, url, {sql_content_hash('blocks')} AS content_hash FROM ({SQL_HIST})",
          views=VIEWS)
def q_content_hash(spark, d):
    return history(spark, d).select("result_id", "url", content_hash(F.col("content")).alias("content_hash"))


@register("content_length", sql=f"SELECT result_id, {sql_content_length('blocks')} AS content_length FROM ({SQL_HIST})",
          views=VIEWS)
def q_content_length(spark, d):
    return history(spark, d).select("result_id", content_length(F.col("content")).alias("content_length"))


@register("diff_positional", sql=(
    f"SELECT result_id, CAST({POS_ADDED} AS INTEGER) AS n_added, CAST({POS_REMOVED} AS INTEGER) AS n_removed, "
    f"CAST(len({POS_MODS}) AS INTEGER) AS n_modified, array_to_string({POS_MODS}, ',') AS modified_idx FROM ({SQL_PAIRS})"),
    views=VIEWS)
def q_diff_positional(spark, d):
    p = pairs(spark, d).withColumn("df", X.diff_positional(F.col("prev_content"), F.col("content")))
    return p.select("result_id", F.size("df.added").alias("n_added"), F.size("df.removed").alias("n_removed"),
                    F.size("df.modified").alias("n_modified"),
                    F.array_join(F.transform("df.modified", lambda m: m["index"].cast("string")), ",").alias("modified_idx"))


@register("diff_by_content", sql=(
    f"SELECT result_id, CAST({C_ADDED} AS INTEGER) AS n_added, CAST({C_REMOVED} AS INTEGER) AS n_removed, "
    f"CAST(len({C_MODS}) AS INTEGER) AS n_modified, array_to_string({C_MODS}, ',') AS modified_idx FROM ({SQL_PAIRS})"),
    views=VIEWS)
def q_diff_by_content(spark, d):
    p = pairs(spark, d).withColumn("df", X.diff_by_content(F.col("prev_content"), F.col("content")))
    return p.select("result_id", F.size("df.added").alias("n_added"), F.size("df.removed").alias("n_removed"),
                    F.size("df.modified").alias("n_modified"),
                    F.array_join(F.transform("df.modified", lambda m: m["index"].cast("string")), ",").alias("modified_idx"))


# apply(old, diff_by_content(old, new)) in DuckDB: replace modified indexes,
# drop removed texts, append added blocks (first-seen order, last block wins).
SQL_APPLIED = (
    f"list_concat(list_filter(list_transform(old, lambda b, j: CASE WHEN list_contains({C_MODS}, j - 1) THEN new[j] ELSE b END), "
    f"lambda b: NOT (list_contains({OK}, b.content) AND NOT list_contains({NK}, b.content))), "
    f"list_transform(list_filter(list_transform(new, lambda b, j: {{'b': b, 'j': j}}), lambda x: NOT list_contains({OK}, x.b.content) "
    f"AND list_position({NK}, x.b.content) = x.j), lambda x: new[len(new) - list_position(list_reverse({NK}), x.b.content) + 1]))")


@register("apply_diff", sql=(
    f"SELECT result_id, CAST(len(a) AS INTEGER) AS n_blocks, {sql_content_hash('a')} AS applied_hash, "
    f"{sql_content_hash('a')} = {sql_content_hash('new')} AS equals_new FROM (SELECT result_id, new, {SQL_APPLIED} AS a "
    f"FROM ({SQL_PAIRS}))"), views=VIEWS)
def q_apply_diff(spark, d):
    p = pairs(spark, d)
    a = X.apply_diff(F.col("prev_content"), X.diff_by_content(F.col("prev_content"), F.col("content")))
    p = p.withColumn("a", a)
    return p.select("result_id", F.size("a").alias("n_blocks"), content_hash(F.col("a")).alias("applied_hash"),
                    (content_hash(F.col("a")) == content_hash(F.col("content"))).alias("equals_new"))


@register("diff_has_changes", sql=(
    f"SELECT result_id, ({C_ADDED} > 0 OR {C_REMOVED} > 0 OR len({C_MODS}) > 0) AS has_changes FROM ({SQL_PAIRS})"),
    views=VIEWS)
def q_diff_has_changes(spark, d):
    p = pairs(spark, d)
    return p.select("result_id", X.has_changes(X.diff_by_content(F.col("prev_content"), F.col("content"))).alias("has_changes"))


@register("diff_summary", sql=(
    f"SELECT result_id, CASE WHEN a + r + m = 0 THEN 'No changes' ELSE CAST(a + r + m AS VARCHAR) || ' block(s) changed: ' || "
    f"concat_ws(', ', CASE WHEN a > 0 THEN a || ' added' END, CASE WHEN r > 0 THEN r || ' removed' END, "
    f"CASE WHEN m > 0 THEN m || ' modified' END) END AS summary FROM (SELECT result_id, {C_ADDED} AS a, {C_REMOVED} AS r, "
    f"len({C_MODS}) AS m FROM ({SQL_PAIRS}))"), views=VIEWS)
def q_diff_summary(spark, d):
    p = pairs(spark, d)
    return p.select("result_id", X.diff_summary(X.diff_by_content(F.col("prev_content"), F.col("content"))).alias("summary"))


SQL_VERSIONS = (f"SELECT url, result_id, seq, version_number, content_hash, prev_hash IS NULL AS is_snapshot, "
                f"CASE WHEN prev_hash IS NULL THEN 'Initial snapshot' ELSE CAST(n AS VARCHAR) || ' block(s) changed' END AS change_summary, "
                f"CAST(CASE WHEN prev_hash IS NULL THEN len(blocks) ELSE n END AS INTEGER) AS blocks_changed FROM ("
                f"SELECT *, (SELECT greatest(len(new) - len(old), 0) + greatest(len(old) - len(new), 0) + len({POS_MODS}) "
                f"FROM (SELECT prev_blocks AS old, blocks AS new)) AS n FROM ({SQL_FLAGS})) WHERE chg = 1")


@register("build_versions", sql=SQL_VERSIONS, views=VIEWS)
def q_build_versions(spark, d):
    return versions(spark, d).select("url", "result_id", "seq", "version_number", "content_hash", "is_snapshot",
                                     "change_summary", "blocks_changed")


@register("version_number", sql=f"SELECT result_id, url, version_number FROM ({SQL_FLAGS})", views=VIEWS)
def q_version_number(spark, d):
    h = X.with_change_flags(history(spark, d), "url", ["seq", "result_id"], "_bucket")
    return h.select("result_id", "url", "version_number")


@register("latest_version", sql=(
    f"SELECT url, max(version_number) AS version_number, arg_max(content_hash, version_number) AS content_hash, "
    f"arg_max(result_id, version_number) AS result_id FROM ({SQL_VERSIONS}) GROUP BY url"), views=VIEWS)
def q_latest_version(spark, d):
    return X.latest_version(versions(spark, d))


@register("changed_pages", sql=(
    f"SELECT url, result_id FROM (SELECT url, result_id, prev_hash, content_hash, row_number() OVER "
    f"(PARTITION BY url ORDER BY seq DESC, result_id DESC) AS rn FROM ({SQL_FLAGS})) "
    f"WHERE rn = 1 AND prev_hash IS NOT NULL AND prev_hash <> content_hash"), views=VIEWS)
def q_changed_pages(spark, d):
    h = X.with_change_flags(history(spark, d), "url", ["seq", "result_id"], "_bucket")
    last = h.groupBy("url").agg(F.max_by(F.struct("result_id", "prev_content_hash", "content_hash"),
                                         F.struct("seq", "result_id")).alias("l"))
    return last.where(F.col("l.prev_content_hash").isNotNull() & (F.col("l.prev_content_hash") != F.col("l.content_hash"))) \
        .select("url", F.col("l.result_id").alias("result_id"))


SNAPSHOT_EVERY = 16


@register("reconstruct_version", sql=f"SELECT url, version_number, content_hash AS rebuilt_hash FROM ({SQL_VERSIONS})", views=VIEWS)
def q_reconstruct_version(spark, d):
    """The stored rows alone go into the fold: the hash of what comes out must be the hash of the content that went in."""
    v = X.build_versions(history(spark, d), snapshot_every=SNAPSHOT_EVERY).select(
        "url", "version_number", "content_hash", "is_snapshot", "full_content", "diff_content")
    return X.reconstruct_versions(v, snapshot_every=SNAPSHOT_EVERY).select("url", "version_number", content_hash(F.col("rebuilt")).alias("rebuilt_hash"))


@register("join_version_result", sql=(
    f"SELECT v.url, v.version_number, v.result_id, d.lang, d.n_chars FROM ({SQL_VERSIONS}) v "
    f"JOIN documents d ON d.doc_id = v.result_id"), views=VIEWS)
def q_join_version_result(spark, d):
    v = versions(spark, d).select("url", "version_number", "result_id")
    docs = read_table(spark, d, "documents").select(F.col("doc_id").alias("result_id"), "lang", "n_chars")
    return v.join(docs, "result_id").select("url", "version_number", "result_id", "lang", "n_chars")
