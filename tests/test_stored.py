"""Tables changed in place: only touched folders are written, and doing it again changes nothing."""
import os
import random
from collections import Counter

from pyspark.sql import functions as F

from pagelake.operators import stats as A
from pagelake.operators import stored as S
from pagelake.operators import tables as T


def files(path):
    return {os.path.join(r, f): os.stat(os.path.join(r, f)).st_mtime_ns for r, _, fs in os.walk(path) for f in fs if f.endswith(".parquet")}


def test_changes_touch_their_buckets_alone(spark, tmp_path):
    rng = random.Random(1)
    path = f"{tmp_path}/jobs"
    rows = [(i, "running", None, i) for i in range(500)]
    S.write_keyed(spark.createDataFrame(rows, "job_id long, status string, err string, pages int"), path, "job_id", 16)
    before = files(path)
    keys = [3, 17, 17, 400, 9999]
    changes = [(k, t, rng.choice([None, "failed", "stopped"]), rng.choice([None, f"e{t}"])) for t, k in enumerate(keys * 3)]
    cdf = spark.createDataFrame(changes, "job_id long, seq int, status string, err string")
    touched = S.apply_changes(spark, path, cdf, "job_id", ["seq"], ["status", "err"], 16)
    want = {i: [s, e, p] for i, s, e, p in rows}
    for k, _, s, e in changes:
        if k in want:
            want[k][0], want[k][1] = s or want[k][0], e or want[k][1]
    read = lambda: {r.job_id: [r.status, r.err, r.pages] for r in S.read_keyed(spark, path).collect()}
    assert read() == want and len(touched) <= 4
    after = files(path)
    same = [f for f in before if f"_bucket={int(f.split('_bucket=')[1].split('/')[0])}" not in {f"_bucket={b}" for b in touched}]
    assert same and all(after[f] == before[f] for f in same) and not any(f"_bucket={b}/" in f for f in set(before) & set(after) for b in touched)
    S.apply_changes(spark, path, cdf, "job_id", ["seq"], ["status", "err"], 16)
    assert read() == want
    assert S.apply_changes(spark, path, cdf.limit(0), "job_id", ["seq"], ["status", "err"], 16) == [] and read() == want
    assert not [f for f in os.listdir(tmp_path) if "staged" in f]


def test_whole_days_are_dropped(spark, tmp_path):
    path = f"{tmp_path}/logs"
    logs = spark.range(2000).select(F.col("id").alias("log_id"), F.when(F.col("id") % 50 != 7, F.timestamp_seconds(1_700_000_000 + F.col("id") * 1000)).alias("created_at"))
    S.write_days(logs, path)
    before = files(path)
    done = S.expire(spark, path, "2023-12-01 12:00:00", 10)
    cutoff = F.lit("2023-11-21 12:00:00").cast("timestamp")
    left = spark.read.parquet(path)
    assert Counter(r.log_id for r in left.collect()) == Counter(r.log_id for r in logs.where(F.col("created_at") >= cutoff).collect())
    assert done["deleted"] == 2000 - left.count() and done["days_dropped"] > 5 and done["days_rewritten"] == 1
    after = files(path)
    assert all(after[f] == t for f, t in before.items() if f in after) and all("day=2023-11-21" in f for f in set(after) - set(before))
    assert S.expire(spark, path, "2023-12-01 12:00:00", 10) == {"days_dropped": 0, "days_rewritten": 0, "deleted": 0}


def test_pages_by_their_last_row(spark, tmp_path):
    rows = [(i, (i * 7) % 50) for i in range(300)]
    df = spark.createDataFrame(rows, "id int, t int")
    for ascending in (False, True):
        after, got = None, []
        while True:
            page = A.page_after(df, "t", "id", 40, after, ascending).collect()
            if not page:
                break
            got += [(r.t, r.id) for r in page]
            after = (page[-1].t, page[-1].id)
        assert got == sorted(((t, i) for i, t in rows), reverse=not ascending)
    df.write.parquet(f"{tmp_path}/rows")
    plan = A.page_after(spark.read.parquet(f"{tmp_path}/rows"), "t", "id", 5, (10, 3))._jdf.queryExecution().executedPlan().toString()
    assert "LessThanOrEqual(t,10)" in plan


def test_js_mode_is_checked(spark):
    jobs = spark.createDataFrame([("a", "u", "single", None, m) for m in (None, "auto", "sometimes")], "name string, start_url string, crawl_mode string, status string, js_mode string")
    assert [r.errors for r in T.validate_jobs(jobs).collect()] == [[], [], ["js_mode: invalid"]]
    assert T.validate_jobs(jobs.drop("js_mode")).where(F.size("errors") > 0).count() == 0
