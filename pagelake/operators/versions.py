"""Content versioning and diffs.

A result history (url, order, content blocks) becomes versions: the first
non-empty content of a URL is a snapshot, every later row whose hash differs
from the previous stored hash is a diff version. "Previous" is a lag over the
URL's history, computed with the bucketed skew-safe scan so one URL with a
huge history never lands in one task. Diffs are in-row array expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.jsonx import BLOCK_TYPE, content_hash
from ..functions.html import pystrip
from ..plans.windows import lag_skew_safe, running_sum_skew_safe
from ..session import ensure_checkpoint_dir



def _empty_blocks() -> Column:
    return F.array().cast(f"array<{BLOCK_TYPE}>")
MOD_TYPE = f"array<struct<index:int,old:{BLOCK_TYPE},new:{BLOCK_TYPE}>>"


def paragraph_blocks(text: Column) -> Column:
    """Fixture content: non-blank lines of a text as paragraph blocks."""
    lines = F.filter(F.split(text, "\n"), lambda x: pystrip(x) != "")
    return F.transform(lines, lambda x: F.struct(
        F.lit("paragraph").alias("type"), x.alias("content"), F.lit(None).cast("int").alias("level"),
        F.lit(None).cast("string").alias("language"), F.lit(None).cast("array<string>").alias("items")))


def diff_positional(old: Column, new: Column) -> Column:
    """added = new tail, removed = old tail, modified = same index with a
    different block."""
    no, nn = F.size(old), F.size(new)
    added = F.when(nn > no, F.slice(new, no + 1, nn - no)).otherwise(_empty_blocks())
    removed = F.when(no > nn, F.slice(old, nn + 1, no - nn)).otherwise(_empty_blocks())
    m = F.least(no, nn)
    mods = F.filter(
        F.transform(F.sequence(F.lit(0), F.greatest(m - 1, F.lit(0))),
                    lambda i: F.struct(i.alias("index"), F.get(old, i).alias("old"), F.get(new, i).alias("new"))),
        lambda x: ~x["old"].eqNullSafe(x["new"]))
    modified = F.when(m > 0, mods).otherwise(F.array().cast(MOD_TYPE))
    return F.struct(added.alias("added"), removed.alias("removed"), modified.alias("modified"))


def diff_by_content(old: Column, new: Column) -> Column:
    """added/removed by content text (distinct, first-seen order, last
    block of a text wins); modified only at indexes where both texts survive
    on the other side (reordering or type change)."""
    texts = F.struct(F.transform(old, lambda b: b["content"]).alias("ok"), F.transform(new, lambda b: b["content"]).alias("nk"))
    # the lists of texts are made once, not for every block they are compared with
    return F.get(F.transform(F.array(texts), lambda t: _diff_of_texts(old, new, t["ok"], t["nk"])), F.lit(0))


def _diff_of_texts(old: Column, new: Column, ok: Column, nk: Column) -> Column:
    def only(one, other, blocks):
        keys = F.filter(F.array_except(one, other), lambda k: k.isNotNull())
        return F.transform(keys, lambda k: F.element_at(F.filter(blocks, lambda b: b["content"] == k), -1))
    removed, added = only(ok, nk, old), only(nk, ok, new)
    m = F.least(F.size(old), F.size(new))

    def keep(x):
        o, n = x["old"], x["new"]
        same = (o["content"] == n["content"]) & (o["type"] == n["type"])
        return ~same & F.array_contains(nk, o["content"]) & F.array_contains(ok, n["content"])
    mods = F.filter(F.transform(F.sequence(F.lit(0), F.greatest(m - 1, F.lit(0))),
                                lambda i: F.struct(i.alias("index"), F.get(old, i).alias("old"),
                                                   F.get(new, i).alias("new"))), keep)
    modified = F.when(m > 0, mods).otherwise(F.array().cast(MOD_TYPE))
    return F.struct(added.alias("added"), removed.alias("removed"), modified.alias("modified"))


def apply_diff(content: Column, diff: Column) -> Column:
    """Replace modified indexes, drop blocks whose text is in removed,
    append added (not an exact inverse, by design of the format)."""
    def applied(d):
        mods = d["d"]["modified"]
        replaced = F.when(F.size(mods) == 0, content).otherwise(F.transform(content, lambda b, i: F.coalesce(
            F.try_element_at(F.filter(mods, lambda m: m["index"] == i), F.lit(-1))["new"], b)))
        kept = F.filter(replaced, lambda b: ~F.array_contains(d["gone"], b["content"]))
        return F.concat(kept, d["d"]["added"])
    # the diff and its removed texts are made once, not for every block
    first = F.transform(F.array(diff), lambda d: F.struct(d.alias("d"), F.transform(d["removed"], lambda b: b["content"]).alias("gone")))
    return F.get(F.transform(first, applied), F.lit(0))


def apply_positional(content: Column, diff: Column) -> Column:
    """Exact inverse of ``diff_positional``: removed blocks are the tail, so
    they are dropped by position."""
    mods = diff["modified"]
    replaced = F.transform(content, lambda b, i: F.coalesce(
        F.try_element_at(F.filter(mods, lambda m: m["index"] == i), F.lit(-1))["new"], b))
    keep_n = F.greatest(F.size(content) - F.size(diff["removed"]), F.lit(0))
    return F.concat(F.slice(replaced, 1, keep_n), diff["added"])


def has_changes(diff: Column) -> Column:
    """X6."""
    return (F.size(diff["added"]) > 0) | (F.size(diff["removed"]) > 0) | (F.size(diff["modified"]) > 0)


def diff_summary(diff: Column) -> Column:
    """X7: "N block(s) changed: a added, b removed, c modified" / "No changes"."""
    a, r, m = F.size(diff["added"]), F.size(diff["removed"]), F.size(diff["modified"])
    parts = F.concat_ws(", ", F.when(a > 0, F.concat(a.cast("string"), F.lit(" added"))),
                        F.when(r > 0, F.concat(r.cast("string"), F.lit(" removed"))),
                        F.when(m > 0, F.concat(m.cast("string"), F.lit(" modified"))))
    return F.when(a + r + m == 0, F.lit("No changes")).otherwise(
        F.concat((a + r + m).cast("string"), F.lit(" block(s) changed: "), parts))


def with_change_flags(history: DataFrame, key: str, order_cols: list[str], bucket_col: str) -> DataFrame:
    """W1 input: non-empty rows as (key, result_id, order, bucket, hash), the
    hash and id of the row before, whether the content changed, and the
    running version number. The contents are hashed once; the windows see the
    narrow rows only, which are cut from their lineage (they are read several
    times)."""
    ensure_checkpoint_dir(history.sparkSession)
    cols = list(dict.fromkeys([key, "result_id", *order_cols, bucket_col]))
    h = history.where(F.coalesce(F.size("content"), F.lit(0)) > 0) \
        .select(*cols, content_hash(F.col("content")).alias("content_hash")).checkpoint(eager=True)
    h = lag_skew_safe(h, [key], order_cols, bucket_col, ["content_hash", "result_id"])
    h = h.withColumn("_chg", F.when(F.col("prev_content_hash").isNull() |
                                    (F.col("prev_content_hash") != F.col("content_hash")), 1).otherwise(0))
    h = running_sum_skew_safe(h, [key], order_cols, bucket_col, "_chg", "version_number")
    return h.withColumn("version_number", F.col("version_number").cast("int"))


def build_versions(history: DataFrame, key: str = "url", order_cols=("seq", "result_id"),
                   bucket_col: str = "_bucket", snapshot_every: int | None = None) -> DataFrame:
    """Versions (url, result_id, version_number, content_hash, is_snapshot,
    full_content, diff, change_summary, blocks_changed). Later versions are
    diffed against the real previous content (a reconstructable chain). The
    first version is a snapshot; with ``snapshot_every``, so is the first of
    every so many versions, which bounds what a reconstruction folds."""
    h = with_change_flags(history, key, list(order_cols), bucket_col).where(F.col("_chg") == 1)
    # contents come by id, for changed rows and the rows before them
    now = history.select("result_id", "content")
    before = history.select(F.col("result_id").alias("prev_result_id"), F.col("content").alias("prev_content"))
    h = h.join(now, "result_id").join(before, "prev_result_id", "left")
    snap = F.col("prev_content_hash").isNull()
    if snapshot_every:
        snap = snap | ((F.col("version_number") - 1) % snapshot_every == 0)
    diff = diff_positional(F.col("prev_content"), F.col("content"))
    n = F.size(diff["added"]) + F.size(diff["removed"]) + F.size(diff["modified"])
    return h.select(
        key, "result_id", *[c for c in order_cols if c not in (key, "result_id")], "version_number", "content_hash",
        snap.alias("is_snapshot"),
        F.when(snap, F.col("content")).alias("full_content"),
        F.when(~snap, diff).alias("diff_content"),
        F.when(snap, F.lit("Initial snapshot")).otherwise(F.concat(n.cast("string"), F.lit(" block(s) changed")))
        .alias("change_summary"),
        F.when(snap, F.size("content")).otherwise(n).cast("int").alias("blocks_changed"))


def reconstruct_versions(versions: DataFrame, key: str = "url", snapshot_every: int = 16) -> DataFrame:
    """The content of every version, rebuilt from what is stored:
    snapshots (``full_content``) and diffs. Versions are gathered by (url,
    snapshot), at most ``snapshot_every`` of them, and their diffs are folded
    onto the snapshot in order: (url, version_number, content_hash, rebuilt)."""
    chain = F.floor((F.col("version_number") - 1) / snapshot_every)
    step = F.struct("version_number", "content_hash", "diff_content")
    got = versions.groupBy(key, chain.alias("_chain")).agg(
        F.max_by("full_content", F.col("is_snapshot").cast("int")).alias("_snap"),
        F.sort_array(F.collect_list(F.struct("version_number", "content_hash"))).alias("_v"),
        F.collect_list(step).alias("_d"))
    diffs = F.array_sort("_d", lambda x, y: x["version_number"] - y["version_number"])
    got = got.select(key, "_snap", "_v", diffs.alias("_d"))
    fold = F.aggregate(F.filter("_d", lambda x: x["diff_content"].isNotNull()), F.array("_snap"),
                       lambda a, x: F.concat(a, F.array(apply_positional(F.element_at(a, -1), x["diff_content"]))))
    got = got.select(key, "_v", fold.alias("_all"))
    each = F.transform("_v", lambda v, i: F.struct(v["version_number"].alias("version_number"), v["content_hash"].alias("content_hash"),
                                                   F.get("_all", i).alias("rebuilt")))
    return got.select(key, F.inline_outer(each)).where(F.col("version_number").isNotNull())


def latest_version(versions: DataFrame, key: str = "url") -> DataFrame:
    """Newest version per URL (max_by aggregate: partial per task)."""
    return versions.groupBy(key).agg(
        F.max("version_number").alias("version_number"),
        F.max_by("content_hash", "version_number").alias("content_hash"),
        F.max_by("result_id", "version_number").alias("result_id"))
