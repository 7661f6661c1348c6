"""Table-state maintenance (T1-T11) and job/category predicates.

Plain parquet has no row-level ACID, so every "update" is snapshot in ->
snapshot out: joins keyed by the table's id plus ``coalesce(new, old)``.
Small dimension sides (transition table, protected names) are literals or
broadcasts of a proven size; everything else is a keyed shuffle join.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import (AUTO_CREATED_DESCRIPTION, CRAWL_MODES, DEFAULT, JOB_STATUSES,
                      JS_MODES, UNCATEGORIZED, EngineConfig)
from ..plans.windows import limit_per_group

TERMINAL_OR_PAUSED = ["completed", "stopped", "failed", "paused"]

# --------------------------------------------------------------------------
# FIXED VALUES -- job control transitions: (action, from status, to status).
# --------------------------------------------------------------------------
TRANSITIONS = [("pause", "running", "paused"), ("resume", "paused", "running"),
               ("stop", "running", "stopped"), ("stop", "paused", "stopped")]
# --------------------------------------------------------------------------


def upsert_fields(base: DataFrame, changes: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Apply one change row per key; only non-null change fields win."""
    ch = changes.select(key, *[F.col(f).alias(f"_new_{f}") for f in fields])
    j = base.join(ch, key, "left")
    for f in fields:
        j = j.withColumn(f, F.coalesce(F.col(f"_new_{f}"), F.col(f)))
    return j.drop(*[f"_new_{f}" for f in fields])


def final_status(status: Column, scraped: Column, failed: Column) -> Column:
    """stopped/paused kept; failed when failures and nothing scraped."""
    return (F.when(status.isin("stopped", "paused"), status)
            .when((failed > 0) & (scraped == 0), F.lit("failed"))
            .otherwise(F.lit("completed")))


def final_status_guard(jobs: DataFrame, finals: DataFrame, key: str = "job_id") -> DataFrame:
    """Write the final status only where the current one is 'running'."""
    f = finals.select(key, F.col("status").alias("_final"))
    return (jobs.join(f, key, "left")
            .withColumn("status", F.when((F.col("status") == "running") & F.col("_final").isNotNull(),
                                         F.col("_final")).otherwise(F.col("status")))
            .drop("_final"))


def delete_cascade(doomed: DataFrame, children: dict[str, tuple[DataFrame, str]],
                   grandchildren: dict[str, tuple[DataFrame, str, str, str]] | None = None) -> dict[str, DataFrame]:
    """T4: remove the doomed parent ids from every child table, and the rows
    that hang on removed child rows (left anti down the FK chain).
    ``children`` maps table name -> (df, fk column); ``grandchildren`` maps
    table name -> (df, fk column, child table, its id column)."""
    ids = doomed.select(F.col(doomed.columns[0]).alias("_id")).distinct()
    out = {name: df.join(ids, df[fk] == ids["_id"], "left_anti") for name, (df, fk) in children.items()}
    for name, (df, fk, child, key) in (grandchildren or {}).items():
        rows, parent = children[child]
        gone = rows.join(ids, rows[parent] == ids["_id"], "left_semi").select(F.col(key).alias("_gone"))
        out[name] = df.join(gone, df[fk] == gone["_gone"], "left_anti")
    return out


def delete_category_guarded(categories: DataFrame, bridge: DataFrame, requests: DataFrame) -> DataFrame:
    """T5: per delete request -> outcome. Protected name or in use -> rejected
    with the usage count; otherwise deleted."""
    usage = bridge.groupBy("category_id").agg(F.count(F.lit(1)).cast("bigint").alias("usage_count"))
    r = (requests.join(categories.select("category_id", "name"), "category_id", "left")
         .join(usage, "category_id", "left")
         .withColumn("usage_count", F.coalesce("usage_count", F.lit(0).cast("bigint"))))
    outcome = (F.when(F.col("name").isNull(), F.lit("not_found"))
               .when(F.lower("name") == UNCATEGORIZED.lower(), F.lit("protected"))
               .when(F.col("usage_count") > 0, F.lit("in_use"))
               .otherwise(F.lit("deleted")))
    return r.select("category_id", "name", "usage_count", outcome.alias("outcome"))


def replace_assignments(bridge: DataFrame, changed: DataFrame, new_links: DataFrame) -> DataFrame:
    """For every result in ``changed`` (result_id) drop all old links and
    insert its rows of ``new_links`` (result_id, category_id); a changed
    result without new rows is cleared. Rows, not per-result arrays, so no
    result's set is ever gathered into one row."""
    kept = bridge.join(changed.select("result_id").distinct(), "result_id", "left_anti")
    return kept.unionByName(new_links.select("result_id", "category_id").distinct())


def get_or_create_categories(existing: DataFrame, labels: DataFrame) -> DataFrame:
    """Labels (label, ord) -> category rows. Missing names (case-insensitive)
    are created once, spelled as their first appearance, with the auto-created
    description. Returns (name, description, created)."""
    first = (labels.withColumn("_k", F.lower("label"))
             .groupBy("_k").agg(F.min_by("label", "ord").alias("name")))
    have = existing.select(F.lower("name").alias("_k")).distinct()
    new = (first.join(have, "_k", "left_anti")
           .select("name", F.lit(AUTO_CREATED_DESCRIPTION).alias("description"), F.lit(True).alias("created")))
    old = existing.select("name", "description", F.lit(False).alias("created"))
    return old.unionByName(new)


def ensure_uncategorized(categories: DataFrame) -> DataFrame:
    """Add the fallback row when no category has that name."""
    spark = categories.sparkSession
    row = spark.createDataFrame([(UNCATEGORIZED, "Fallback category")], "name string, description string")
    missing = row.join(categories.select(F.lower("name").alias("_k")),
                       F.lower(row["name"]) == F.col("_k"), "left_anti")
    return categories.select("name", "description").unionByName(missing)


def update_category_fields(categories: DataFrame, patches: DataFrame,
                           fields=("name", "description", "is_active")) -> DataFrame:
    """Non-null patch; renaming the protected row is rejected (the patch
    row is kept unapplied and flagged)."""
    p = patches.select("category_id", *[F.col(f).alias(f"_p_{f}") for f in fields])
    j = categories.join(p, "category_id", "left")
    rejected = (F.lower("name") == UNCATEGORIZED.lower()) & F.col("_p_name").isNotNull() & \
        (F.col("_p_name") != F.col("name"))
    j = j.withColumn("rejected", F.coalesce(rejected, F.lit(False)))
    for f in fields:
        j = j.withColumn(f, F.when(F.col("rejected"), F.col(f)).otherwise(F.coalesce(F.col(f"_p_{f}"), F.col(f))))
    return j.drop(*[f"_p_{f}" for f in fields])


def log_retention(logs: DataFrame, as_of: str, days: int) -> tuple[DataFrame, DataFrame]:
    """(kept rows, one-row deleted count)."""
    cutoff = F.to_timestamp(F.lit(as_of)) - F.make_interval(days=F.lit(days))
    kept = logs.where(F.col("created_at") >= cutoff)
    deleted = logs.where(~(F.col("created_at") >= cutoff) | F.col("created_at").isNull()) \
        .agg(F.count(F.lit(1)).cast("bigint").alias("deleted"))
    return kept, deleted


def log_retention_counts(logs: DataFrame, as_of: str, days: int) -> DataFrame:
    """T10 as counts: kept and deleted rows in one pass."""
    cutoff = F.to_timestamp(F.lit(as_of)) - F.make_interval(days=F.lit(days))
    old = F.coalesce(F.col("created_at") < cutoff, F.lit(True))
    return logs.agg(F.count_if(~old).cast("bigint").alias("kept"), F.count_if(old).cast("bigint").alias("deleted"))


def log_cap_per_job(logs: DataFrame, cap: int) -> DataFrame:
    """Newest ``cap`` entries per job. Entries are counted by job and hour
    and ranked only within an hour, so a hot job is spread over its hours
    (Spark limits groups before the shuffle only for caps up to 1000)."""
    hour = F.date_trunc("hour", F.col("created_at"))
    return limit_per_group(logs, ["job_id"], [(hour, False)], [(F.col("created_at"), False), (F.col("log_id"), False)], cap)


# -------------------------------------------------------------------- F14-F18
def save_filter(results: DataFrame, assigned: DataFrame, job_filters: DataFrame,
                uncategorized_ids: DataFrame) -> DataFrame:
    """keep a result if its job has no filter, or any assigned category is
    Uncategorized or in the job's filter list (semi joins, no per-row arrays)."""
    no_filter = results.join(job_filters.select("job_id").distinct(), "job_id", "left_anti")
    ra = results.select("result_id", "job_id").join(assigned, "result_id")
    hit_filter = ra.join(job_filters, ["job_id", "category_id"], "left_semi")
    hit_unc = ra.join(uncategorized_ids, "category_id", "left_semi")
    ok_ids = hit_filter.select("result_id").unionByName(hit_unc.select("result_id")).distinct()
    with_filter = results.join(job_filters.select("job_id").distinct(), "job_id", "left_semi") \
        .join(ok_ids, "result_id", "left_semi")
    return no_filter.unionByName(with_filter)


def confidence_filter(labels: Column, scores: Column, threshold: float) -> Column:
    """zipped (label, score) pairs with score >= threshold."""
    z = F.arrays_zip(labels.alias("label"), scores.alias("score"))
    return F.filter(z, lambda x: x["score"] >= F.lit(threshold))


def validate_jobs(jobs: DataFrame) -> DataFrame:
    """F16: errors array (empty = valid) for name, start_url, crawl_mode,
    status and, where given, js_mode."""
    checks = [
        F.when(F.col("name").isNull() | (F.length("name") < 1), F.lit("name: too short")),
        F.when(F.length("name") > 255, F.lit("name: too long")),
        F.when(F.col("start_url").isNull() | (F.trim("start_url") == ""), F.lit("start_url: required")),
        F.when(~F.col("crawl_mode").isin(*CRAWL_MODES), F.lit("crawl_mode: invalid")),
        F.when(F.col("status").isNotNull() & ~F.col("status").isin(*JOB_STATUSES), F.lit("status: invalid")),
    ]
    if "js_mode" in jobs.columns:  # left out of a request, it is the default one
        checks.append(F.when(F.col("js_mode").isNotNull() & ~F.col("js_mode").isin(*JS_MODES), F.lit("js_mode: invalid")))
    return jobs.withColumn("errors", F.filter(F.array(*checks), lambda e: e.isNotNull()))


def action_allowed(requests: DataFrame) -> DataFrame:
    """(status, action) -> new status, or rejected. The 4-row transition
    table is a literal broadcast."""
    spark = requests.sparkSession
    t = F.broadcast(spark.createDataFrame(TRANSITIONS, "action string, status string, new_status string"))
    j = requests.join(t, ["action", "status"], "left")
    return j.withColumn("rejected", F.col("new_status").isNull())


def run_once_guard(jobs: DataFrame) -> DataFrame:
    """drop jobs already finished or paused."""
    return jobs.where(~F.col("status").isin(*TERMINAL_OR_PAUSED))


def load_categories(stored: DataFrame, defaults: dict, cfg: EngineConfig = DEFAULT) -> DataFrame:
    """Active stored categories plus config defaults whose name
    (case-insensitive) is not stored. Returns (name, keywords, source)."""
    spark = stored.sparkSession
    act = stored.where(F.col("is_active")).select("name", "keywords", F.lit("stored").alias("source"))
    d = spark.createDataFrame([(k, list(v)) for k, v in defaults.items()], "name string, keywords array<string>")
    extra = (d.join(act.select(F.lower("name").alias("_k")), F.lower(d["name"]) == F.col("_k"), "left_anti")
             .select("name", "keywords", F.lit("default").alias("source")))
    return act.unionByName(extra)


__all__ = [n for n in dir() if not n.startswith("_") and n not in ("F", "Window", "reduce")]
