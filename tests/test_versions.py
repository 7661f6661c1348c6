"""Diffs and versions: the reference's diff cases as data, plus invariants."""
from pyspark.sql import functions as F

from pagelake.functions.jsonx import BLOCK_TYPE, canonical_json, content_hash
from pagelake.operators import versions as X
from pagelake.plans.windows import lag_skew_safe, row_number_skew_safe, running_sum_skew_safe

SCHEMA = f"id int, old array<{BLOCK_TYPE}>, new array<{BLOCK_TYPE}>"


def b(t, c):
    return (t, c, None, None, None)


def test_content_diff_cases(spark):
    rows = [
        (1, [b("paragraph", "a")], [b("paragraph", "a"), b("paragraph", "b")]),      # added
        (2, [b("paragraph", "a"), b("paragraph", "b")], [b("paragraph", "a")]),      # removed
        (3, [b("paragraph", "a"), b("paragraph", "b")], [b("paragraph", "b"), b("paragraph", "a")]),  # reordered
        (4, [b("paragraph", "a")], [b("heading", "a")]),                              # type change
        (5, [], []),
    ]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("d", X.diff_by_content(F.col("old"), F.col("new")))
    r = {x.id: x for x in df.select("id", F.size("d.added").alias("a"), F.size("d.removed").alias("r"),
                                     F.size("d.modified").alias("m"),
                                     X.diff_summary(F.col("d")).alias("s"), X.has_changes(F.col("d")).alias("h")).collect()}
    assert (r[1].a, r[1].r, r[1].m) == (1, 0, 0)
    assert (r[2].a, r[2].r, r[2].m) == (0, 1, 0)
    assert (r[3].a, r[3].r, r[3].m) == (0, 0, 2)
    assert (r[4].a, r[4].r, r[4].m) == (0, 0, 1)
    assert r[5].s == "No changes" and r[5].h is False
    assert r[1].s == "1 block(s) changed: 1 added"


def test_positional_diff_roundtrip(spark):
    rows = [(1, [b("paragraph", "a"), b("paragraph", "b"), b("paragraph", "c")], [b("paragraph", "a"), b("heading", "x")]),
            (2, [b("paragraph", "a")], [b("paragraph", "z"), b("paragraph", "a"), b("paragraph", "a")])]
    df = spark.createDataFrame(rows, SCHEMA)
    out = df.select((content_hash(X.apply_positional(F.col("old"), X.diff_positional(F.col("old"), F.col("new"))))
                     == content_hash(F.col("new"))).alias("ok")).collect()
    assert all(r.ok for r in out)


def test_canonical_json_matches_python(spark):
    import hashlib
    import json
    blocks = [{"type": "heading", "content": 'Tit"le é', "level": 2}, {"type": "paragraph", "content": "a\nb\tc"}]
    rows = [(1, [(x["type"], x["content"], x.get("level"), None, None) for x in blocks], [])]
    r = spark.createDataFrame(rows, SCHEMA).select(canonical_json(F.col("old")).alias("j"),
                                                   content_hash(F.col("old")).alias("h")).first()
    py = json.dumps(blocks, sort_keys=True, ensure_ascii=False)
    assert r.j == py
    assert r.h == hashlib.sha256(py.encode()).hexdigest()


def test_skew_safe_windows_equal_plain(spark):
    from pyspark.sql import Window
    data = [(k, i, (i * 7) % 5) for k in ("hot", "cold") for i in range(200 if k == "hot" else 20)]
    df = spark.createDataFrame(data, "k string, i long, v long")
    w = Window.partitionBy("k").orderBy("i")
    plain = df.select("k", "i", F.row_number().over(w).alias("rn"), F.lag("v").over(w).alias("pv"),
                      F.sum("v").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("rs"))
    b_ = df.withColumn("_b", F.floor(F.col("i") / 16))
    skew = row_number_skew_safe(df, ["k"], "i", "rn", width=16)
    lag = lag_skew_safe(b_, ["k"], ["i"], "_b", ["v"])
    rs = running_sum_skew_safe(b_, ["k"], ["i"], "_b", "v", "rs")
    got = skew.join(lag.select("k", "i", F.col("prev_v").alias("pv")), ["k", "i"]).join(rs.select("k", "i", "rs"), ["k", "i"])
    assert sorted(map(tuple, plain.collect())) == sorted(map(tuple, got.select("k", "i", "rn", "pv", "rs").collect()))


def test_versions_follow_code_rules(spark):
    hist = [("u", 1, 1, [b("paragraph", "a")]), ("u", 2, 2, [b("paragraph", "a")]), ("u", 3, 3, [b("paragraph", "b")]),
            ("u", 4, 4, []), ("u", 5, 5, [b("paragraph", "a")])]
    df = spark.createDataFrame(hist, f"url string, result_id long, seq long, content array<{BLOCK_TYPE}>") \
        .withColumn("_bucket", F.lit(0))
    v = X.build_versions(df).orderBy("version_number").collect()
    assert [r.result_id for r in v] == [1, 3, 5]
    assert [r.version_number for r in v] == [1, 2, 3]
    assert v[0].change_summary == "Initial snapshot" and v[1].change_summary == "1 block(s) changed"


def test_texts_of_a_diff_are_gathered_once(spark):
    """The blocks' texts are bound before they are compared: no list is made inside a comparison with a block."""
    n = 300

    def lines(first):
        return F.transform(F.sequence(F.lit(0), F.lit(n)), lambda i: F.struct(
            F.lit("paragraph").alias("type"), F.concat(F.lit("line "), (i * 2 + first).cast("string")).alias("content"), F.lit(None).cast("int").alias("level"),
            F.lit(None).cast("string").alias("language"), F.lit(None).cast("array<string>").alias("items")))
    df = spark.range(1).select(lines(F.col("id")).alias("old"), lines(F.col("id") + 1).alias("new"))
    diff = X.diff_by_content(F.col("old"), F.col("new"))
    got = df.select(diff.alias("d"), X.apply_diff(F.col("old"), diff).alias("a"), "new")
    assert tuple(got.select(F.size("d.added"), F.size("d.removed"), F.size("d.modified"), F.col("a") == F.col("new")).first()) == (n + 1, n + 1, 0, True)
    assert "array_contains(transform(" not in got._jdf.queryExecution().analyzed().toString()
