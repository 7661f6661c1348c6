"""Operator 4: benchmark decontamination by winnowing (DataFrame functions only).

Words are runs of digits, letters and non-ASCII characters, A-Z folded. Of every ``SPAN - GRAM + 1`` neighbouring hashes of
``GRAM`` words the least is a fingerprint, so that any shared span of ``SPAN`` words shares a fingerprint, at the same place of
the span. Fingerprints of documents and items are joined; each hit is extended with the words around it: the windows of
``SPAN`` words that contain it are looked up among the items' windows. Items of fewer words are one window of their own
length, looked up at every place. Fingerprints and windows of the items are broadcast if a count proves that they are
few, else the same joins shuffle.

(Arrays are taken apart by the outer generators: for the inner ones Spark infers a filter on the size and moves it below the
projections, which would compute the whole array again inside the filter.)

The fingerprints of a document are computed inside its row and leave it as narrow rows; the text isn't shuffled. What meets
again for a document is its hits, pre-aggregated.

Defined results: a null or empty text has no words, in documents and items; rows with equal (id, text) share one result,
returned once for each; null item ids make words hit but aren't listed; repeated items count once; an empty table gives no
rows, an empty benchmark no hits. Only the named columns are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import row_key

#: Words of a window and of a fingerprint.
SPAN, GRAM = 10, 5
SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Item rows that may be broadcast: 40 MB at most.
BROADCAST_ROWS = 500_000


def word_hashes(text: Column) -> Column:
    words = F.array_remove(F.split(F.coalesce(text, F.lit("")), SEPARATORS), "")
    return F.transform(words, lambda w: F.xxhash64(F.when(w.rlike("[A-Z]"), F.translate(w, UPPER, LOWER)).otherwise(w)))


def window_hashes(array: str, size: int) -> Column:
    """A hash of each ``size`` neighbours of an array column; empty if it has fewer."""
    at = F.sequence(F.lit(0), F.size(array) - size)
    return F.when(F.size(array) >= size, F.transform(at, lambda i: F.xxhash64(*(F.get(array, i + j) for j in range(size))))).otherwise(
        F.array().cast("array<bigint>"))


def fingerprints(df: DataFrame, hashes: str, out: str) -> DataFrame:
    """Adds the winnowed fingerprints of the array column ``hashes``: array<struct<fp, pos>>, by place."""
    names = df.columns
    df = df.withColumn("_g", window_hashes(hashes, GRAM))
    df = df.select(*names, F.transform("_g", lambda x, i: F.struct(x.alias("fp"), i.alias("pos"))).alias("_p"))
    width = SPAN - GRAM + 1
    least = F.transform(F.sequence(F.lit(1), F.size("_p") - (width - 1)), lambda i: F.array_min(F.slice("_p", i, width)))
    df = df.select(*names, F.when(F.size("_p") >= width, least).otherwise(F.array().cast("array<struct<fp:bigint,pos:int>>")).alias("_m"))
    # the places of the least never go back, so that repeats are neighbours
    return df.select(*names, F.filter("_m", lambda x, i: (i == 0) | (x["pos"] != F.get("_m", i - 1)["pos"])).alias(out))


def few(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def find(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
         item_text_col: str = "text") -> DataFrame:
    """(id, n_words, spans array<struct<start, n>>, items array) of every row: the document windows (first word, words) that
    are a window of an item, and the ids of the items with such windows."""
    bench = items.select(F.col(item_col).alias("item"), word_hashes(F.col(item_text_col)).alias("h")).where(F.size("h") > 0).distinct()
    long, short = bench.where(F.size("h") >= SPAN), bench.where(F.size("h") < SPAN)
    marks = fingerprints(long, "h", "f").select(F.explode_outer("f.fp").alias("fp")).where("fp is not null").distinct().withColumn("hit", F.lit(True))
    sizes = [r.n for r in short.select(F.size("h").alias("n")).distinct().orderBy("n").collect()]  # 1 to SPAN - 1
    windows = long.select("item", F.explode_outer(window_hashes("h", SPAN)).alias("w")).withColumn("n", F.lit(SPAN))
    for n in sizes:
        windows = windows.unionByName(short.where(F.size("h") == n).select("item", F.explode_outer(window_hashes("h", n)).alias("w"), F.lit(n).alias("n")))
    windows = few(windows.groupBy("w", "n").agg(F.collect_set("item").alias("items")))

    df = docs.select(F.col(id_col).alias("id"), *row_key(id_col, text_col), word_hashes(F.col(text_col)).alias("h"))
    df = fingerprints(df, "h", "f")
    # the words that any window around the fingerprint can hold, and the place of the first
    start = lambda p: F.greatest(p - (SPAN - GRAM), F.lit(0))
    around = F.transform("f", lambda x: F.struct(x["fp"].alias("fp"), start(x["pos"]).alias("start"), F.lit(SPAN).alias("n"),
                                                 F.slice("h", start(x["pos"]) + 1, x["pos"] + SPAN - start(x["pos"])).alias("words")))
    # one mark for every row, so that rows without hits stay; its key spreads in a shuffle
    none = F.array().cast("array<bigint>")
    mark = F.array(F.struct(F.xxhash64("_k0", "_k1").alias("fp"), F.lit(-1).alias("start"), F.size("h").alias("n"), none.alias("words")))
    df = df.select("id", "_k0", "_k1", "h", F.concat(mark, around).alias("parts"), *(window_hashes("h", n).alias(f"_s{n}") for n in sizes))
    if sizes:  # windows of short items are looked up at every place, by their own hash
        every = [F.expr(f"transform(_s{n}, (w, i) -> struct(w as fp, i as start, {n} as n, cast(array() as array<bigint>) as words))") for n in sizes]
        df = df.withColumn("parts", F.concat("parts", *every))
    rows = df.select("id", "_k0", "_k1", F.inline_outer("parts"))
    rows = rows.join(few(marks), "fp", "left").where(F.col("hit") | (F.col("start") < 0) | (F.col("n") < SPAN))
    # extend: all windows of a hit; a short window is its own; a mark has none
    whole = F.transform(window_hashes("words", SPAN), lambda w, i: F.struct(w.alias("w"), (F.col("start") + i).alias("at")))
    tried = F.when(F.col("start") < 0, F.array(F.struct(F.col("fp").alias("w"), F.lit(-1).alias("at")))).when(
        F.col("n") == SPAN, whole).otherwise(F.array(F.struct(F.col("fp").alias("w"), F.col("start").alias("at"))))
    rows = rows.select("id", "_k0", "_k1", "n", tried.alias("tried")).select("id", "_k0", "_k1", "n", F.inline_outer("tried"))
    found = rows.join(windows, ["w", "n"], "left").where(F.col("items").isNotNull() | (F.col("at") < 0))
    got = found.groupBy("id", "_k0", "_k1").agg(
        F.sum(F.when(F.col("at") < 0, 1)).alias("copies"), F.max(F.when(F.col("at") < 0, F.col("n"))).alias("n_words"),
        F.sort_array(F.collect_set(F.when(F.col("at") >= 0, F.struct(F.col("at").alias("start"), "n")))).alias("spans"),
        F.array_distinct(F.flatten(F.collect_set(F.when(F.col("at") >= 0, F.col("items"))))).alias("items"))
    # equal rows came together; each gets the result
    got = got.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return got.select(F.col("id").alias(id_col), F.col("n_words").cast("long").alias("n_words"), "spans", "items")


def hit_words(spans: str = "spans") -> Column:
    """The number of words that the spans cover."""
    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("end"))

    def add(a: Column, s: Column) -> Column:
        end = (s["start"] + s["n"]).cast("long")
        return F.struct((a["n"] + F.greatest(end - F.greatest(a["end"], s["start"].cast("long")), F.lit(0).cast("long"))).alias("n"),
                        F.greatest(a["end"], end).alias("end"))

    return F.aggregate(spans, zero, add)["n"]


def remove_contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", **columns: str) -> DataFrame:
    """``docs`` without the rows that hold a window of an item, with all their columns. Only the keys of contaminated rows meet
    the documents again."""
    key = row_key(id_col, text_col)
    hit = find(docs.select(F.struct(*key).alias("_key"), text_col), items, "_key", text_col, **columns).where(F.size("spans") > 0)
    hit = hit.select("_key").distinct()
    names = docs.columns
    marked = docs.select(F.struct("*").alias("_row"), F.struct(*key).alias("_key"))
    return marked.join(hit, "_key", "left_anti").select(*(F.col("_row")[n].alias(n) for n in names))
