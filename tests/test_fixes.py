"""Cases that once broke a job or cut its result."""
import re

import pandas as pd
import pytest
from pyspark.sql import functions as F

from pagelake.functions import html as H
from pagelake.functions import rules as R
from pagelake.functions import urls as U
from pagelake.operators import classify as C
from pagelake.operators import links as L
from pagelake.operators import versions as X
from pagelake.plans.windows import limit_per_group
from pagelake.streaming import streams as Z


def one(spark, value, fn):
    return spark.createDataFrame([(value,)], "s string").select(fn(F.col("s")).alias("x")).first().x


def test_references(spark):
    cases = {"a&#9999999;b": "a�b", "&#X41;&#x0042;&#067;": "ABC", "&#38;lt;": "&lt;", "caf&eacute; &Uuml;ber &ntilde;": "café Über ñ",
             "&#xD800;&#0;": "��", "&nosuch; &amp;amp; & &;": "&nosuch; &amp; & &;", "&#99999999999999999999;": "�", "plain": "plain", "&#128512;": "😀"}
    for text, want in cases.items():
        assert one(spark, text, H.entity_decode) == want


def test_rule_patterns(spark):
    ok = {r"(?P<n>a)b": "ab", r"(?P<x_y>a)(?P=x_y)": "aa", r"^x\Z": "x", r"[[a]b": "[b", r"[]a]": "]", r"[^]]+$": "q", r"a&&b": "a&&b", r"[a&&b]": "&"}
    for pattern, text in ok.items():
        assert re.search(pattern, text) and one(spark, text, lambda c, p=pattern: R.rule_predicate(c, "regex", p)) is True, pattern
    for pattern in (r"(a", r"(a)?(?(1)b|c)", ""):
        assert one(spark, "abc", lambda c, p=pattern: R.rule_predicate(c, "regex", p)) is False
    links = spark.createDataFrame([(1, "http://h/ab"), (2, "http://h/x"), (3, "http://h/y")], "job_id int, link string")
    rules = spark.createDataFrame([(1, "regex", r"(?P<n>a)b"), (2, "regex", "(broken"), (2, "regex", None)], "job_id int, type string, pattern string")
    assert {r.job_id for r in L.match_rules_table(links, rules).collect()} == {1, 3}


def test_url_parameters(spark):
    assert one(spark, "/a;x=1/b;y=2;z", U.path_params) == "y=2;z" and one(spark, "/a;x=1/b", U.path_params) == ""
    assert one(spark, "/a;x=1/b;y=2;z", U.without_params) == "/a;x=1/b"
    assert one(spark, "http://h/file.PDF;v=1?x", lambda c: R.skip_extension(c, [".pdf"])) is True
    assert one(spark, "Host.example/x", U.session_domain) == "host.example" and one(spark, "http://A.b:80/x", U.session_domain) == "a.b"


def test_scorer_loses_only_the_rows_that_fail(spark):
    loads = []

    def load():
        loads.append(1)
        return "model"

    def score(texts, labels, model):
        assert model == "model"
        if texts.str.contains("bad").any():
            raise ValueError("no " + "x" * 300)
        return pd.DataFrame({"labels": [list(labels)] * len(texts), "scores": [[0.9] * len(labels)] * len(texts)})

    C.register_scorer("picky", score, load)
    df = spark.createDataFrame([(i, "bad" if i % 4 == 0 else "fine") for i in range(12)], "i int, t string").coalesce(1)
    got = {r.i: r.c for r in df.select("i", C.classify_with_scorer(F.col("t"), "Picky", ["a"], 0.4).alias("c")).collect()}
    assert [i for i in got if got[i].labels != ["a"]] == [0, 4, 8] and len(got[0].error) > 300 and got[1].error is None


def test_limit_per_group(spark):
    rows = [(g, i * 7 % 50, i) for g in (1, 2, None) for i in range(200)] + [(3, None, 5), (3, 1, 6)]
    df = spark.createDataFrame(rows, "g int, b int, i int")
    for n in (1, 60, 1000):
        got = limit_per_group(df, ["g"], [(F.col("b"), False)], [(F.col("b"), False), (F.col("i"), True)], n)
        plan = got._jdf.queryExecution().executedPlan().toString()
        want = []
        for g in (1, 2, None, 3):
            mine = sorted((r for r in rows if r[0] == g), key=lambda r: (r[1] is None, -(r[1] or 0), r[2]))
            want += mine[:n]
        assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))
        assert "Window" in plan and got.columns == df.columns


def test_versions_are_rebuilt_from_what_is_stored(spark):
    import random
    rng = random.Random(8)
    rows = []
    for url in ("a", "b"):
        content = ["x"]
        for seq in range(40):
            k = rng.randint(0, 3)
            content = content[: len(content) - k] + [rng.choice("pqr") for _ in range(rng.randint(0, 3))] if rng.random() < 0.7 else content
            rows.append((url, seq, f"{url}{seq}", "\n".join(content) or "z"))
    df = spark.createDataFrame(rows, "url string, seq long, result_id string, text string").select(
        "url", "seq", "result_id", X.paragraph_blocks(F.col("text")).alias("content"), F.lit(0).cast("long").alias("_bucket"))
    for every in (4, 1000):
        stored = X.build_versions(df, snapshot_every=every).select("url", "version_number", "content_hash", "is_snapshot", "full_content", "diff_content")
        got = X.reconstruct_versions(stored, snapshot_every=every).select("version_number", "content_hash", X.content_hash(F.col("rebuilt")).alias("h")).collect()
        assert got and all(r.content_hash == r.h for r in got)
        assert stored.where("is_snapshot").count() == sum(1 for r in got if (r.version_number - 1) % every == 0)
        assert stored.where("not is_snapshot and full_content is not null").count() == 0


def test_streams_resume_and_keep_order(spark, tmp_path):
    """Shuffled files and small chunks give what one ordered pass gives; a second run goes on where the first ended."""
    events = [(i, f"2024-01-01 00:{i // 60:02d}:{i % 60:02d}", i % 3, "ab"[(i // 4) % 2]) for i in range(240)]
    df = spark.createDataFrame(events, "event_id long, ts string, user_id long, event_type string").withColumn("ts", F.col("ts").cast("timestamp"))
    df.orderBy(F.rand(3)).coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = sorted((r.url, r.version_number, r.result_id) for r in Z.stream_versions(spark, str(tmp_path)).collect())
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    want = []
    for u in range(3):
        last, n = None, 0
        for i, _, user, kind in events:
            if user == u and kind != last:
                last, n = kind, n + 1
                want.append((f"https://site{u}.example.com/p", n, i))
    assert got == sorted(want)

    def seen(run_id):
        s = Z.read_stream(spark, str(tmp_path), "events").select("user_id")
        return Z.run(s, "resume", batch_fn=Z.write_new(["user_id"]), run_id=run_id).drop("batch_id")

    run_id = f"test-{tmp_path.name}"
    assert sorted(r.user_id for r in seen(run_id).collect()) == [0, 1, 2]
    spark.createDataFrame([(500, 9, "a"), (501, 2, "a")], "event_id long, user_id long, event_type string").withColumn(
        "ts", F.lit("2024-02-01").cast("timestamp")).select("event_id", "ts", "user_id", "event_type").write.mode("append").parquet(f"{tmp_path}/events.parquet")
    assert sorted(r.user_id for r in seen(run_id).collect()) == [0, 1, 2, 9]


def test_reading_a_broken_sink_is_an_error(spark, tmp_path):
    spark.createDataFrame([(1,)], "x long").write.parquet(f"{tmp_path}/t.parquet")

    def fail(df, bid, out):
        raise ValueError("sink is broken")

    with pytest.raises(Exception, match="sink is broken"):
        Z.run(Z.read_stream(spark, str(tmp_path), "t"), "broken", batch_fn=fail)
