"""Operator 5: chat formatting in budgeted windows (DataFrame functions only).

A turn is written ``<|im_start|>role\\ntext<|im_end|>\\n``. Inside roles and texts every ``<|`` becomes ``<||`` (and a line
break in a role ``<|n|>``), which no control string contains, so that the format can be read back exactly.

Windows are cut by prefix sums of turn tokens: the running total says in which stretch of ``budget`` tokens a turn begins and
ends; turns inside one stretch share a window, a turn that crosses into the next stretch gets its own. So windows hold whole
turns and never more new tokens than the budget, but for a single longer turn, which is kept whole. Each window starts with the
conversation's system turn (its first turn, if that has the role ``system``), then repeats the turns of the window before it
that lie within its last ``history`` tokens, then has its new turns. The loss mask covers the texts of new assistant turns
only: every assistant text is a target exactly once.

Running totals are prefix scans over (conversation, block of turns), so that a conversation with a third of all rows is
split; a window is the only group that is gathered, and its size is bounded by budget and history.

Defined results: a null text is empty, a null role the empty role; turns are put in order by turn (nulls first), then role,
then text, and repeated rows are turns of their own; null conversation ids form one conversation; an empty table gives
no rows. Only the named columns are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
#: Turns of a block of the prefix scans.
BLOCK = 256
#: Estimated characters of a token; markers and role count as so many tokens.
CHARS, MARKS = 4, 4


def escape(c: Column) -> Column:
    return F.replace(c, F.lit("<|"), F.lit("<||"))


def unescape(c: Column) -> Column:
    return F.replace(c, F.lit("<||"), F.lit("<|"))


def escape_role(c: Column) -> Column:
    return F.replace(escape(c), F.lit("\n"), F.lit("<|n|>"))


def unescape_role(c: Column) -> Column:
    return unescape(F.replace(c, F.lit("<|n|>"), F.lit("\n")))


def running(df: DataFrame, value: Column, order: list[str], out: str) -> DataFrame:
    """Adds the sum of ``value`` over the rows before each row of its ``conv``, by (block, order): a window inside each block,
    and one over a single row for each block."""
    df = df.withColumn(out, value)
    sums = df.groupBy(F.col("conv").alias("_c"), F.col("block").alias("_b")).agg(F.sum(out).alias("_s"))
    over = Window.partitionBy("_c").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("_c", "_b", F.coalesce(F.sum("_s").over(over), F.lit(0)).alias("_o"))
    inside = Window.partitionBy("conv", "block").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    df = df.withColumn(out, F.coalesce(F.sum(out).over(inside), F.lit(0)))
    both = df.join(sums, F.col("conv").eqNullSafe(F.col("_c")) & F.col("block").eqNullSafe(F.col("_b")))
    return both.withColumn(out, F.col(out) + F.col("_o")).drop("_c", "_b", "_o")


def windows(turns: DataFrame, budget: int = 1024, history: int = 256, id_col: str = "conv_id", turn_col: str = "turn",
            role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(id, start, text, n_repeated, n_new, loss array<struct<start, end>>), a row for each window: ``start`` orders the windows
    of a conversation; the first ``n_repeated`` turns of ``text`` are the system turn and history, the next ``n_new`` are
    new; ``loss`` holds the code points of the targets, end exclusive."""
    df = turns.select(
        F.col(id_col).alias("conv"), F.col(turn_col).alias("turn"), F.floor(F.col(turn_col) / BLOCK).alias("block"),
        F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("said"))
    size = (F.ceil(F.length("said") / CHARS) + MARKS).cast("long")
    df = running(df, size, ["turn", "role", "said"], "at").withColumn("end", F.col("at") + size)
    # the first turn, if it is the system's, belongs to every window and is new in none but the first
    df = df.withColumn("cell", F.floor(F.col("at") / budget)).withColumn("crossing", F.floor((F.col("end") - 1) / budget) > F.col("cell"))
    # a window: turns of one cell; those before a crossing turn share it, the crossing turn is alone
    spans = df.groupBy("conv", "cell", "crossing").agg(F.min("at").alias("start"), F.max("end").alias("stop"))
    spans = spans.select(F.col("conv").alias("c2"), F.col("cell").alias("cell2"), F.col("crossing").alias("crossing2"), "start", "stop")
    df = df.join(spans, F.col("conv").eqNullSafe(F.col("c2")) & (F.col("cell") == F.col("cell2")) & (F.col("crossing") == F.col("crossing2")))
    body = F.concat(F.lit(START), escape_role(F.col("role")), F.lit("\n"), escape(F.col("said")), F.lit(f"{END}\n"))
    df = df.select("conv", "at", "start", "stop", body.alias("body"),
                   (F.length(F.lit(START)) + F.length(escape_role(F.col("role"))) + 1).alias("head"),
                   F.length(escape(F.col("said"))).alias("n"), (F.col("role") == "assistant").alias("target"), (F.col("role") == "system").alias("system"))
    system = df.where("at = 0 and system").select(F.col("conv").alias("c3"), F.col("body").alias("system_body"))
    # each turn in its own window, and as history in the window that starts where its own one ends
    own = F.struct(F.col("start"), F.lit(1).alias("new"))
    after = F.struct(F.col("stop").alias("start"), F.lit(0).alias("new"))
    close = (F.col("stop") - F.col("at") <= history) & ~(F.col("system") & (F.col("at") == 0))
    df = df.withColumn("place", F.explode(F.when(close, F.array(own, after)).otherwise(F.array(own))))
    turn = F.struct("at", F.col("place.new").alias("new"), "body", "head", "n", "target")
    got = df.groupBy("conv", F.col("place.start").alias("start")).agg(F.sort_array(F.collect_list(turn)).alias("t")).where(F.exists("t", lambda x: x["new"] == 1))
    got = got.join(system, F.col("conv").eqNullSafe(F.col("c3")), "left")
    lead = F.when((F.col("start") > 0) & F.col("system_body").isNotNull(), F.col("system_body"))
    got = got.select("conv", "start", "t", lead.alias("lead"))
    # where each turn begins: a running sum of lengths over the few turns of a window
    begin = F.aggregate("t", F.array(F.length(F.coalesce("lead", F.lit("")))), lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + F.length(x["body"]))))
    got = got.withColumn("begin", begin)
    loss = F.filter(F.transform("t", lambda x, i: F.struct((F.get("begin", i) + x["head"]).cast("long").alias("start"), (F.get("begin", i) + x["head"] + x["n"]).cast("long").alias("end"),
                                                           (x["target"] & (x["new"] == 1)).alias("on"))), lambda s: s["on"])
    repeated = F.size(F.filter("t", lambda x: x["new"] == 0)) + F.when(F.col("lead").isNotNull(), 1).otherwise(0)
    return got.select(
        F.col("conv").alias(id_col), "start", F.concat(F.coalesce("lead", F.lit("")), F.array_join(F.transform("t", lambda x: x["body"]), "")).alias("text"),
        repeated.cast("long").alias("n_repeated"), F.size(F.filter("t", lambda x: x["new"] == 1)).cast("long").alias("n_new"),
        F.transform(loss, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))).alias("loss"))


def read_back(formatted: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """From windows alone: (id, start, turns array<struct<role, text>> of the new turns, targets array<string>, chars)."""
    pieces = F.slice(F.split("text", "<\\|im_start\\|>"), F.lit(2), F.size(F.split("text", "<\\|im_start\\|>")))
    new = F.slice("pieces", F.col("n_repeated") + 1, F.greatest(F.col("n_new"), F.lit(0)))
    role = lambda p: F.substring_index(p, "\n", 1)

    def turn(p: Column) -> Column:
        said = F.substring(p, F.length(role(p)) + 2, F.length(p) - F.length(role(p)) - 2 - len(END))
        return F.struct(unescape_role(role(p)).alias("role"), unescape(said).alias("text"))

    target = F.transform("loss", lambda s: unescape(F.substring(F.col("text"), (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int"))))
    df = formatted.select(id_col, "start", pieces.alias("pieces"), "n_repeated", "n_new", target.alias("targets"), F.length("text").cast("long").alias("chars"))
    return df.select(id_col, "start", F.transform(new, turn).alias("turns"), "targets", "chars")
