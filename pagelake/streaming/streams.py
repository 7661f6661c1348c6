"""Structured Streaming variants.

Sources are file streams over the table folders; sinks are parquet folders
(append) or ``foreachBatch`` upserts, both under the shared checkpoint folder
(``spark.checkpoint.dir``) with their own checkpoint locations; a query that is
given a run id resumes from the offsets of its earlier runs, and no result
passes through driver memory.
``run`` drives a query with ``trigger(availableNow=True)`` (all available
input, then stop) and returns the sink as a DataFrame.
"""

from __future__ import annotations

import os
import uuid

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from ..session import ensure_checkpoint_dir


#: Compressed size of the page files that a micro-batch of ``stream_extract`` takes (at least one file).
EXTRACT_BYTES = 256 << 20


def stream_dir(spark: SparkSession, name: str, run_id: str | None = None) -> str:
    """The folder of a stream's sink and checkpoint: the same for the same
    ``run_id``, a new one without."""
    base = ensure_checkpoint_dir(spark)
    return os.path.join(base, "streams", f"{name}-{run_id or uuid.uuid4().hex[:12]}")


def read_stream(spark: SparkSession, sf_dir: str, table: str, max_files: int = 1, max_bytes: int | None = None) -> DataFrame:
    """Incremental source over one table's files (schema fixed up front,
    ``maxFilesPerTrigger`` bounds each micro-batch, or ``maxBytesPerTrigger``
    where ``max_bytes`` is given)."""
    path = os.path.join(sf_dir, f"{table}.parquet")
    schema = spark.read.parquet(path).schema
    reader = spark.readStream.schema(schema)
    reader = reader.option("maxBytesPerTrigger", max_bytes) if max_bytes else reader.option("maxFilesPerTrigger", max_files)
    if os.path.isdir(path):
        return reader.parquet(path)
    return reader.option("pathGlobFilter", f"{table}.parquet").parquet(sf_dir)


def run(sdf: DataFrame, name: str, mode: str = "append", batch_fn=None, run_id: str | None = None) -> DataFrame:
    """Run to completion over the available input; return the sink. With a
    ``run_id`` the query goes on from the offsets of its earlier runs."""
    spark = sdf.sparkSession
    base = stream_dir(spark, name, run_id)
    out, ck = os.path.join(base, "out"), os.path.join(base, "checkpoint")
    w = sdf.writeStream.option("checkpointLocation", ck).trigger(availableNow=True)
    if batch_fn is None:
        q = w.format("parquet").option("path", out).outputMode("append").start()
    else:
        q = w.outputMode(mode).foreachBatch(lambda df, bid: batch_fn(df, bid, out)).start()
    q.awaitTermination()
    if q.exception() is not None:
        raise q.exception()
    schema = sdf.schema if batch_fn is None else sdf.schema.add("batch_id", "long")
    folder = spark._jvm.org.apache.hadoop.fs.Path(out)
    written = folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder)
    return spark.read.schema(schema).parquet(out) if written else spark.createDataFrame([], schema)


def write_batch(df: DataFrame, bid: int, out: str) -> None:
    """Idempotent micro-batch write: batch ``bid`` owns the folder
    ``batch_id=<bid>`` and overwrites it, so a batch replayed after a failure
    replaces its own output instead of duplicating it."""
    df.write.mode("overwrite").parquet(os.path.join(out, f"batch_id={bid}"))


def latest_per_key(sink: DataFrame, keys: list[str]) -> DataFrame:
    """Collapse an upsert log (rows tagged with ``batch_id``) to the newest
    row per key -- an aggregate, partial per task."""
    vals = [c for c in sink.columns if c not in keys and c != "batch_id"]
    return sink.groupBy(*keys).agg(F.max_by(F.struct(*vals), "batch_id").alias("_v")).select(*keys, "_v.*")


def logs_stream(spark, sf_dir: str) -> DataFrame:
    e = read_stream(spark, sf_dir, "events")
    lvl = (F.when(F.col("event_type") == "error", "error").when(F.col("event_type") == "signup", "warning")
           .when(F.col("event_type") == "purchase", "critical").when(F.col("event_type") == "view", "debug")
           .otherwise("info"))
    return e.select(F.col("event_id").alias("log_id"), F.col("user_id").alias("job_id"), lvl.alias("level"),
                    F.col("props").alias("message"), F.col("ts").cast("timestamp").alias("created_at"))


def stream_log_tail(spark, sf_dir: str, job_id: int) -> DataFrame:
    """New log rows of one job; each batch written in (time, id) order."""
    s = logs_stream(spark, sf_dir).where(F.col("job_id") == job_id)

    def fb(df, bid, out):
        write_batch(df.orderBy("created_at", "log_id"), bid, out)
    return run(s, "log_tail", batch_fn=fb).drop("batch_id")


def stream_job_status(spark, sf_dir: str) -> DataFrame:
    """Running counters per job (update mode, upserted per batch)."""
    s = logs_stream(spark, sf_dir).groupBy("job_id").agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.col("level") == "error").alias("errors"),
        F.max("created_at").alias("last_at"))
    return latest_per_key(run(s, "job_status", mode="update", batch_fn=write_batch), ["job_id"])


def write_new(keys: list[str]):
    """A batch function that writes the rows whose keys no earlier batch wrote:
    what was seen is kept in the sink, not in the state of an operator, and
    never expires. A batch that is run again leaves its own rows out of what
    was seen."""
    def fb(df, bid, out):
        spark = df.sparkSession
        folder = spark._jvm.org.apache.hadoop.fs.Path(out)
        rows = df.dropDuplicates(keys)
        if folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
            seen = spark.read.schema(df.schema.add("batch_id", "long")).parquet(out).where(F.col("batch_id") < bid)
            rows = rows.join(seen.select(*keys), keys, "left_anti")
        write_batch(rows, bid, out)
    return fb


def stream_job_finished(spark, sf_dir: str) -> DataFrame:
    """Z3: one message for each job, when its terminal status arrives."""
    s = (read_stream(spark, sf_dir, "orders").where(F.col("o_orderstatus") == "F")
         .select(F.col("o_orderkey").alias("job_id"), F.lit("completed").alias("status"), F.lit("job_finished").alias("type")))
    return run(s, "job_finished", batch_fn=write_new(["job_id"])).drop("batch_id")


def _version_state(key, pdfs, state):
    """Z4 state function: last hash and version number per URL."""
    last_hash, version = (state.get if state.exists else (None, 0))
    # A URL's rows of one batch may come in several chunks: order them together.
    rows = pd.concat(list(pdfs)).sort_values(["created_at", "result_id"])
    hashes = rows["content_hash"].fillna("")
    new = rows[hashes != hashes.shift(1, fill_value=last_hash or "")]
    numbers = range(int(version) + 1, int(version) + 1 + len(new))
    state.update((rows["content_hash"].iloc[-1], int(version) + len(new)))
    yield pd.DataFrame({"url": key[0], "result_id": new["result_id"], "version_number": list(numbers), "content_hash": new["content_hash"]})


def stream_versions(spark, sf_dir: str) -> DataFrame:
    """Stateful versioning keyed by URL (applyInPandasWithState); equal to
    the batch version numbering when event time follows arrival."""
    e = read_stream(spark, sf_dir, "events")
    r = e.select(F.col("event_id").alias("result_id"),
                 F.concat(F.lit("https://site"), (F.col("user_id") % 40).cast("string"), F.lit(".example.com/p")).alias("url"),
                 F.col("ts").cast("timestamp").alias("created_at"),
                 F.sha2(F.col("event_type"), 256).alias("content_hash"))
    out = r.groupBy("url").applyInPandasWithState(
        _version_state, "url string, result_id long, version_number int, content_hash string",
        "last_hash string, version int", "append", GroupStateTimeout.NoTimeout)
    return run(out, "versions")


def stream_seen_links(spark, sf_dir: str) -> DataFrame:
    """Distinct discovered links over a pages stream; the links seen are
    the sink's own rows."""
    from ..config import EngineConfig
    from ..operators.links import extract_links
    p = read_stream(spark, sf_dir, "pages")
    links = extract_links(p.select("page_id", "url", "html"), cfg=EngineConfig()).select("link")
    return run(links, "seen_links", batch_fn=write_new(["link"])).drop("batch_id")


def stream_volume(spark, sf_dir: str) -> DataFrame:
    """Daily result counts, live: tumbling 1-day windows on event time
    with a watermark, update mode upserted per batch."""
    e = read_stream(spark, sf_dir, "events").select(F.col("ts").cast("timestamp").alias("created_at"))
    s = e.withWatermark("created_at", "2 days").groupBy(F.window("created_at", "1 day")).agg(
        F.count(F.lit(1)).alias("count"))
    # epoch-day of the window start: independent of the session time zone
    s = s.select(F.date_from_unix_date(F.floor(F.unix_seconds(F.col("window.start")) / 86400).cast("int")).alias("date"),
                 "count")
    return latest_per_key(run(s, "volume", mode="update", batch_fn=write_batch), ["date"])


def stream_extract(spark, sf_dir: str) -> DataFrame:
    """Pages stream -> blocks and links (stateless, same Column functions):
    (page_id, type, pos, content), links with type ``link``. A micro-batch
    takes files up to ``EXTRACT_BYTES`` and deals their pages over all cores:
    one file is often one row group, which one task would work through."""
    from ..config import EngineConfig
    from ..operators.blocks import blocks_relational, extract_blocks
    from ..operators.links import extract_links
    p = read_stream(spark, sf_dir, "pages", max_bytes=EXTRACT_BYTES).select("page_id", "url", "html")
    p = p.repartition(4 * spark.sparkContext.defaultParallelism)
    blocks = blocks_relational(extract_blocks(p)).select("page_id", "type", F.col("pos").cast("int").alias("pos"), "content")
    links = extract_links(p, cfg=EngineConfig()).select("page_id", F.lit("link").alias("type"), F.col("pos").cast("int").alias("pos"), F.col("link").alias("content"))
    return run(blocks.unionByName(links), "extract")


def stream_retention(spark, sf_dir: str, as_of: str, days: int) -> DataFrame:
    """The log stream with rows older than ``as_of - days`` expired."""
    cutoff = F.to_timestamp(F.lit(as_of)) - F.make_interval(days=F.lit(days))
    s = logs_stream(spark, sf_dir).where(F.col("created_at") >= cutoff).select("log_id", "job_id", "created_at")
    return run(s, "retention")
