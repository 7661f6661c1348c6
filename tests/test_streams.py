"""Streaming equals batch across several micro-batches (state carried)."""
import hashlib
import os
import tempfile

import pandas as pd

from pagelake.streaming import streams as Z


def test_stateful_versions_across_batches(spark, sf):
    ev = spark.read.parquet(os.path.join(sf, "events.parquet")).toPandas().sort_values(["ts", "event_id"])
    d = tempfile.mkdtemp(prefix="pagelake-test-")
    folder = os.path.join(d, "events.parquet")
    step = len(ev) // 3 + 1
    for start in range(0, len(ev), step):                   # three time-ordered files -> three batches
        spark.createDataFrame(ev.iloc[start:start + step]).coalesce(1).write.mode("append").parquet(folder)
    got = Z.stream_versions(spark, d).toPandas()
    # brute force: per URL in time order, a new version whenever the hash changes
    ev["url"] = "https://site" + (ev.user_id % 40).astype(str) + ".example.com/p"
    ev["h"] = ev.event_type.map(lambda t: hashlib.sha256(t.encode()).hexdigest())
    exp = []
    for url, g in ev.groupby("url"):
        last, v = None, 0
        for r in g.itertuples():
            if r.h != last:
                v, last = v + 1, r.h
                exp.append((url, r.event_id, v))
    exp = sorted(exp)
    assert sorted(zip(got.url, got.result_id, got.version_number)) == exp


def test_extract_takes_many_files_at_once(spark, monkeypatch, tmp_path):
    rows = [(i, f"https://a.org/{i}", f"<h1>Title {i}</h1><p>Some longer paragraph number {i}.</p><a href='/x{i}'>x</a>") for i in range(5)]
    for r in rows:
        spark.createDataFrame([r], "page_id long, url string, html string").coalesce(1).write.mode("append").parquet(str(tmp_path / "pages.parquet"))
    monkeypatch.setattr(Z, "stream_dir", lambda *a: str(tmp_path / "stream"))
    got = Z.stream_extract(spark, str(tmp_path)).collect()
    assert sorted((r.page_id, r.content) for r in got if r.type == "link") == [(i, f"https://a.org/x{i}") for i in range(5)]
    assert {r.page_id for r in got if r.type != "link"} == set(range(5))
    assert [f for f in os.listdir(tmp_path / "stream" / "checkpoint" / "commits") if f.isdigit()] == ["0"]      # one micro-batch
