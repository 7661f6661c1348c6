"""Tables kept as folders and changed in place: T1, T2, T9 written back, T10 by whole days.

A keyed table lies in hash buckets of its key (one folder each). A set of changes is brought down to the last value of each field of
each key, only buckets that hold a changed key are read, and only these are written again (dynamic partition overwrite, from a
staged copy, so that nothing is read and replaced at once). Applying the same changes again changes nothing, which is also how a
run that was cut off is finished. A log table lies in folders by day: retention drops whole days by their names and rewrites the one
day that the cut-off falls into.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS = 64


def bucket_of(key: str, buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def folders(spark: SparkSession, path: str, column: str) -> dict[str, str]:
    """Values of a partition column and their folders, by listing alone."""
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    names = [s.getPath() for s in fs.listStatus(root) if s.isDirectory()]
    return {p.getName().split("=", 1)[1]: p.toString() for p in names if p.getName().startswith(f"{column}=")}


def remove(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(p, True)


def replace_partitions(rows: DataFrame, path: str, column: str) -> None:
    """Write the partitions that ``rows`` has in place of those of ``path``; the others stay as they are."""
    spark, staged = rows.sparkSession, f"{path}-staged-{uuid.uuid4().hex}"
    rows.write.partitionBy(column).parquet(staged)
    again = spark.read.schema(rows.schema).parquet(staged)
    again.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(column).parquet(path)
    remove(spark, staged)


# -- keyed tables ----------------------------------------------------------------------------------------------------

def write_keyed(df: DataFrame, path: str, key: str, buckets: int = BUCKETS) -> None:
    df.withColumn("_bucket", bucket_of(key, buckets)).repartition(buckets, "_bucket").write.partitionBy("_bucket").parquet(path)


def read_keyed(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).drop("_bucket")


def last_changes(changes: DataFrame, key: str, order: list[str], fields: list[str]) -> DataFrame:
    """For each key the last value of each field that isn't null."""
    last = [F.max_by(f, F.when(F.col(f).isNotNull(), F.struct(*order))).alias(f"_new_{f}") for f in fields]
    return changes.groupBy(key).agg(*last)


def apply_changes(spark: SparkSession, path: str, changes: DataFrame, key: str, order: list[str], fields: list[str], buckets: int = BUCKETS) -> list[int]:
    """T1/T2/T9 in place: rows of the table take the last non-null value of each changed field; keys that it doesn't have are left
    out. Returns the buckets that were written."""
    last = last_changes(changes, key, order, fields).withColumn("_bucket", bucket_of(key, buckets))
    touched = sorted(r[0] for r in last.select("_bucket").distinct().collect())  # at most ``buckets`` numbers
    if not touched:
        return []
    table = spark.read.parquet(path).where(F.col("_bucket").isin(touched))
    joined = table.join(last.drop("_bucket"), key, "left")
    new = [F.coalesce(f"_new_{c}", c).alias(c) if c in fields else F.col(c) for c in table.columns]
    replace_partitions(joined.select(*new).repartition(len(touched), "_bucket"), path, "_bucket")
    return touched


# -- logs by day -----------------------------------------------------------------------------------------------------

def write_days(df: DataFrame, path: str, time: str = "created_at") -> None:
    """Rows by day; a busy day is dealt to several files."""
    salt = F.pmod(F.xxhash64(*df.columns), F.lit(8))
    df.withColumn("day", F.to_date(time)).repartition("day", salt).write.mode("append").partitionBy("day").parquet(path)


def expire(spark: SparkSession, path: str, as_of: str, days: int, time: str = "created_at") -> dict[str, int]:
    """T10 in place: rows before ``as_of`` - ``days`` (or without a time) go. Returns days dropped, days rewritten and rows deleted."""
    cutoff = spark.range(1).select((F.to_timestamp(F.lit(as_of)) - F.make_interval(days=F.lit(days))).cast("string").alias("c")).first()["c"]
    edge, old = cutoff[:10], {d: f for d, f in folders(spark, path, "day").items() if d < cutoff[:10] or d == "__HIVE_DEFAULT_PARTITION__"}
    table = spark.read.parquet(path)
    gone = table.where((F.col("day") < F.lit(edge).cast("date")) | F.col("day").isNull()).count() if old else 0  # row counts of file footers
    here = table.where(F.col("day") == F.lit(edge).cast("date"))
    stays = F.col(time) >= F.lit(cutoff).cast(table.schema[time].dataType)
    counts = here.agg(F.count(F.lit(1)).alias("n"), F.count_if(stays).alias("kept")).first()
    for folder in old.values():
        remove(spark, folder)
    if counts["kept"] < counts["n"]:
        if counts["kept"]:
            replace_partitions(here.where(stays), path, "day")
        else:
            remove(spark, folders(spark, path, "day")[edge])
    return {"days_dropped": len(old), "days_rewritten": int(counts["kept"] < counts["n"]), "deleted": gone + counts["n"] - counts["kept"]}
