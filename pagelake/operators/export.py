"""Sinks (K1-K7): JSON / CSV / Markdown exports, result and log appends.

Exports are projections written by Spark's own writers, partitioned like the
data (JSON Lines, not one in-memory document); the job export keeps its
newest-N cut as a top-k (TakeOrderedAndProject), not a global sort. Every
writer has a reader that gives the written rows back.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.jsonx import BLOCK_TYPE
from ..functions.jsonx import q as jq
from ..plans.windows import row_barrier
from ..session import ensure_checkpoint_dir


def iso_timestamp(ts: Column) -> Column:
    """V9: ``datetime.isoformat()`` of a UTC timestamp: fraction only when
    non-zero, offset ``+00:00``."""
    t = ts.cast("timestamp")
    us = F.unix_micros(t) % 1_000_000
    frac = F.when(us != 0, F.concat(F.lit("."), F.lpad(us.cast("string"), 6, "0"))).otherwise(F.lit(""))
    return F.when(ts.isNotNull(), F.concat(F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss"), frac, F.lit("+00:00")))


def block_json_plain(b: Column) -> Column:
    """One block as ``json.dumps`` writes it: keys in field order, NULL
    fields absent, ", " / ": " separators."""
    items = F.concat(F.lit("["), F.array_join(F.transform(b["items"], jq), ", "), F.lit("]"))
    parts = F.array(
        F.when(b["type"].isNotNull(), F.concat(F.lit('"type": '), jq(b["type"]))),
        F.when(b["content"].isNotNull(), F.concat(F.lit('"content": '), jq(b["content"]))),
        F.when(b["level"].isNotNull(), F.concat(F.lit('"level": '), b["level"].cast("string"))),
        F.when(b["language"].isNotNull(), F.concat(F.lit('"language": '), jq(b["language"]))),
        F.when(b["items"].isNotNull(), F.concat(F.lit('"items": '), items)),
    )
    return F.concat(F.lit("{"), F.array_join(parts, ", "), F.lit("}"))


def content_json(blocks: Column) -> Column:
    """Content as JSON text ('' for none), as the CSV export writes it."""
    txt = F.concat(F.lit("["), F.array_join(F.transform(blocks, block_json_plain), ", "), F.lit("]"))
    return F.when(F.coalesce(F.size(blocks), F.lit(0)) > 0, txt).otherwise(F.lit(""))


def export_rows(results: DataFrame, with_hash: bool = True, with_content: bool = True) -> DataFrame:
    """K1/K3: the export projection (url, http_status, page_title, content,
    content_length, content_hash, error, scraped_at)."""
    cols = [F.col("url"), F.col("http_status"), F.col("page_title")]
    if with_content:
        cols.append(F.when(F.coalesce(F.size("content"), F.lit(0)) > 0, content_json(F.col("content"))).alias("content"))
    cols.append(F.col("content_length"))
    if with_hash:
        cols.append(F.col("content_hash"))
    cols += [F.col("error"), iso_timestamp(F.col("created_at")).alias("scraped_at")]
    return results.select(*cols)


def csv_rows(results: DataFrame, with_hash: bool = True, with_content: bool = True) -> DataFrame:
    """K2/K4: CSV columns, NULL -> '' (0 status too, as ``x or ''`` does)."""
    cols = [F.col("url"),
            F.when(F.coalesce(F.col("http_status"), F.lit(0)) == 0, F.lit("")).otherwise(F.col("http_status").cast("string"))
            .alias("http_status"),
            F.coalesce(F.col("page_title"), F.lit("")).alias("page_title"),
            F.col("content_length").cast("string").alias("content_length")]
    if with_hash:
        cols.append(F.coalesce(F.col("content_hash"), F.lit("")).alias("content_hash"))
    cols += [F.coalesce(F.col("error"), F.lit("")).alias("error"),
             F.coalesce(iso_timestamp(F.col("created_at")), F.lit("")).alias("scraped_at")]
    if with_content:
        cols.append(content_json(F.col("content")).alias("content_blocks"))
    return results.select(*cols)


def json_lines(rows: DataFrame) -> DataFrame:
    """One JSON object for each export row, as one text column: null fields are
    kept, ``content`` (JSON text) becomes a value."""
    def value(c: str) -> Column:
        v = F.col(c) if c == "content" else jq(F.col(c)) if dict(rows.dtypes)[c] == "string" else F.col(c).cast("string")
        return F.concat(F.lit(f'"{c}": '), F.when(F.col(c).isNotNull(), v).otherwise(F.lit("null")))
    return rows.select(F.concat(F.lit("{"), F.concat_ws(", ", *[value(c) for c in rows.columns]), F.lit("}")).alias("value"))


def write_json(rows: DataFrame, path: str, mode: str = "overwrite") -> None:
    """K1 writer: JSON Lines with null fields kept and content as a value."""
    json_lines(rows).write.mode(mode).text(path)


def read_json(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """What :func:`write_json` wrote; ``content`` is read as blocks and shown
    as JSON text again."""
    blocks = f"array<{BLOCK_TYPE}>"
    fields = [T.StructField(f.name, T._parse_datatype_string(blocks) if f.name == "content" else f.dataType) for f in schema]
    got = spark.read.schema(T.StructType(fields)).json(path)
    if "content" in got.columns:
        got = got.withColumn("content", F.when(F.col("content").isNotNull(), content_json(F.col("content"))))
    return got


def write_csv(rows: DataFrame, path: str, mode: str = "overwrite") -> None:
    """K2 writer: header, minimal quoting with doubled quotes, empty strings
    kept empty."""
    rows.write.mode(mode).option("header", True).option("escape", '"').option("emptyValue", "").csv(path)


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """What :func:`write_csv` wrote (an empty field is an empty string)."""
    got = spark.read.schema(schema).option("header", True).option("escape", '"').option("multiLine", True).csv(path)
    return got.na.fill("")


def newest(results: DataFrame, job_id, cap: int) -> DataFrame:
    """K3/K4 input: one job's newest ``cap`` results (id breaks ties)."""
    return results.where(F.col("job_id") == F.lit(job_id)) \
        .orderBy(F.col("created_at").desc(), F.col("result_id").desc()).limit(cap)


def blocks_to_markdown(blocks: Column) -> Column:
    """K5: headings as '#'*level, fenced code with its language, '> '
    quotes, other text as is; blank line between blocks."""
    def md(b):
        lvl = F.coalesce(b["level"], F.lit(1))
        return (F.when(b["type"] == "heading", F.concat(F.repeat(F.lit("#"), lvl), F.lit(" "), b["content"]))
                .when(b["type"] == "code_block", F.concat(F.lit("```"), F.coalesce(b["language"], F.lit("")), F.lit("\n"),
                                                          b["content"], F.lit("\n```")))
                .when(b["type"] == "blockquote", F.concat(F.lit("> "), b["content"]))
                .otherwise(b["content"]))
    kept = F.filter(blocks, lambda b: b["content"].isNotNull() & (b["content"] != ""))
    return F.array_join(F.transform(kept, md), "\n\n")


def append_results(rows: DataFrame, path: str) -> None:
    """K6 writer: append to the results table (parquet, partitioned by day)."""
    rows.withColumn("day", F.to_date("created_at")).write.mode("append").partitionBy("day").parquet(path)


def read_results(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The results table, without its partition column."""
    return spark.read.schema(schema).parquet(path)


def new_table(spark: SparkSession, name: str) -> str:
    """A new folder below the shared one."""
    return f"{ensure_checkpoint_dir(spark)}/tables/{name}-{uuid.uuid4().hex}"


# FIXED VALUES -- the log texts of a page outcome are behaviour.
def outcome_logs(outcomes: DataFrame) -> DataFrame:
    """K7: one log row per page outcome, and one for a success with labels."""
    labels = F.coalesce(F.col("labels"), F.array().cast("array<string>")) if "labels" in outcomes.columns \
        else F.array().cast("array<string>")
    ok_msg = F.when(F.size(labels) > 0, F.concat(F.lit("Scraped successfully → "), F.array_join(labels, ", "))) \
        .otherwise(F.lit("Scraped successfully"))
    level = F.when(F.col("outcome") == "success", F.lit("info")).otherwise(F.lit("error"))
    msg = F.when(F.col("outcome") == "success", ok_msg).otherwise(
        F.concat(F.lit("Failed: "), F.coalesce(F.col("error"), F.lit("?"))))

    def log(level, message, component):
        return F.struct(level.alias("level"), message.alias("message"), F.col("url").alias("source_url"), F.lit(component).alias("component"))
    base = log(level, msg, "scraper")
    classified = log(F.lit("info"), F.concat(F.lit("Classified as: "), F.array_join(labels, ", ")), "classifier")
    both = (F.col("outcome") == "success") & (F.size(labels) > 0)
    # an outcome's rows come from one pass over the outcomes, which are worked out before
    return row_barrier(outcomes).select("job_id", F.inline(F.when(both, F.array(base, classified)).otherwise(F.array(base))))
