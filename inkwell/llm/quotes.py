"""Quotation linking: conversations in reply order, without the quotes; DataFrame functions only.

A line that begins with ``>`` marks is quoted at a level, the number of marks.
Consecutive lines of one level are a passage; its text, lower-cased and with
white space collapsed, is hashed.  A message offers the hashes of its own words
(lines at level 0): the whole, each paragraph, each line.  A passage links to
the first message of its conversation that offers its hash and is older, else
(``cross``) to the first such message of any other conversation.  A passage
that fits nowhere as a whole is tried line by line.

The parent of a message is the latest message of its conversation that it
quotes at its shallowest linked level; a message that quotes nobody begins a
thread.  Threads are found by pointer jumping, so a chain of n replies takes
log2(n) joins.  ``(conv_id, thread, turn)`` is the reply order: a parent always
comes before its replies.

The offers of one hash are reduced to those of its two first conversations
before any join, so a passage that very many messages share stays one row, and
a conversation that offers it too late itself still finds the other.

Defined results: null text is empty; a line of marks alone ends no passage of
its level; rows repeated in (conv_id, turn) are all kept, the least text of
them is what others can quote; an attribution line ("... wrote:") right above a
quote goes with the quote.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkwell.llm._spill import written

MARKS = r"^[ \t]*((?:>[ \t]?)+)"
WROTE = r"(?i)\bwrote:[ \t]*$"


def normal(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


def level(line: Column) -> Column:
    marks = F.regexp_extract(line, MARKS, 1)
    return F.length(marks) - F.length(F.replace(marks, F.lit(">"), F.lit("")))


def own_text(text: Column) -> Column:
    """The lines at level 0, without attributions right above a quote, joined and trimmed."""
    lines = F.split(F.coalesce(text, F.lit("")), "\n")
    bare = F.filter(lines, lambda x: ~x.rlike(MARKS))
    quoted = F.coalesce(text, F.lit("")).rlike(r"(?m)" + MARKS)
    pairs = F.arrays_zip(lines.alias("l"), F.slice(lines, 2, F.size(lines)).alias("m"))
    clean = F.transform(F.filter(pairs, lambda p: ~p["l"].rlike(MARKS) & ~(p["l"].rlike(WROTE) & F.coalesce(p["m"], F.lit("")).rlike(MARKS))), lambda p: p["l"])
    body = F.when(quoted, F.array_join(clean, "\n")).otherwise(F.array_join(bare, "\n"))
    return F.regexp_replace(body, r"^\s+|\s+$", "")


def passages(messages: DataFrame) -> DataFrame:
    """conv_id, turn, level, ord, hash, lines (array of hashes): the quoted passages of distinct messages."""
    lines = messages.where(F.col("text").rlike(r"(?m)" + MARKS)).select("conv_id", "turn", "text").distinct()
    lines = lines.select("conv_id", "turn", F.xxhash64("text").alias("_m"), F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    lines = lines.withColumn("level", level(F.col("line"))).withColumn("said", normal(F.regexp_replace("line", MARKS, "")))
    one = Window.partitionBy("conv_id", "turn", "_m").orderBy("pos")
    lines = lines.withColumn("_new", (F.coalesce(F.lag("level").over(one), F.lit(-1)) != F.col("level")).cast("int")).withColumn("ord", F.sum("_new").over(one))
    runs = lines.where("level > 0").groupBy("conv_id", "turn", "_m", "ord", "level").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "said"))), lambda x: x["said"]).alias("said"))
    runs = runs.withColumn("said", F.filter("said", lambda x: x != "")).where(F.size("said") > 0)
    return runs.select("conv_id", "turn", "level", "ord", F.md5(F.array_join("said", " ").cast("binary")).alias("hash"), F.transform("said", lambda x: F.md5(x.cast("binary"))).alias("lines"))


def offers(messages: DataFrame) -> DataFrame:
    """conv_id, turn, hash: what each message can be quoted by."""
    body = messages.groupBy("conv_id", "turn").agg(F.min(own_text(F.col("text"))).alias("body"))
    parts = F.concat(F.array("body"), F.split("body", r"\n[ \t]*\n"), F.split("body", "\n"))
    parts = F.array_distinct(F.filter(F.transform(parts, normal), lambda x: x != ""))
    return body.select("conv_id", "turn", F.explode(F.transform(parts, lambda x: F.md5(x.cast("binary")))).alias("hash"))


def link(messages: DataFrame) -> DataFrame:
    """One row per quoted passage: conv_id, turn, level, ord, hash, to_conv, to_turn (null where nothing fits), cross."""
    quoted = written(passages(messages), "passages")
    asked = quoted.select("hash").unionByName(quoted.select(F.explode("lines").alias("hash"))).distinct()
    offered = offers(messages).join(asked, "hash", "left_semi")
    here = written(offered.groupBy("conv_id", "hash").agg(F.min("turn").alias("first")), "offers")
    # two conversations of each hash, so that each asker finds one that isn't its own; the limit is applied before rows move
    rank = F.row_number().over(Window.partitionBy("hash").orderBy("conv_id"))
    two = here.where("conv_id is not null").withColumn("_r", rank).where("_r <= 2")
    anywhere = two.groupBy("hash").agg(F.array_sort(F.collect_list(F.struct("conv_id", "first"))).alias("any"))

    def fit(asks: DataFrame) -> DataFrame:
        own = asks.join(here, ["conv_id", "hash"], "left").withColumn("first", F.when(F.col("first") < F.col("turn"), F.col("first")))
        own = own.join(anywhere, "hash", "left").withColumn("any", F.get(F.filter("any", lambda x: x["conv_id"] != F.col("conv_id")), F.lit(0)))
        other = F.col("first").isNull() & F.col("any").isNotNull()
        return own.select(*asks.columns, F.when(other, F.col("any.conv_id")).when(F.col("first").isNotNull(), F.col("conv_id")).alias("to_conv"), F.when(other, F.col("any.first")).otherwise(F.col("first")).alias("to_turn"))

    whole = written(fit(quoted), "whole")
    key = ["conv_id", "turn", "level", "ord"]
    lines = fit(whole.where("to_conv is null").select(*key, F.explode("lines").alias("hash")))
    votes = lines.where("to_conv is not null").groupBy(*key, "to_conv", "to_turn").agg(F.count(F.lit(1)).alias("n"))
    voted = votes.groupBy(*key).agg(F.min(F.struct((F.col("to_conv") != F.col("conv_id")).alias("c"), (-F.col("n")).alias("v"), "to_conv", "to_turn")).alias("b"))
    out = whole.join(voted.select(*key, F.col("b.to_conv").alias("_c"), F.col("b.to_turn").alias("_t")), key, "left")
    to = F.coalesce("to_conv", "_c")
    return out.select(*key, "hash", to.alias("to_conv"), F.coalesce("to_turn", "_t").alias("to_turn"), F.coalesce(to != F.col("conv_id"), F.lit(False)).alias("cross"))


def threads(parents: DataFrame, rounds: int = 40) -> DataFrame:
    """(conv_id, turn, thread, depth) of every message with a parent, by pointer jumping over (conv_id, turn, parent)."""
    now = written(parents.select("conv_id", "turn", F.col("parent").alias("thread"), F.lit(1).cast("long").alias("depth")), "threads")
    for _ in range(rounds):
        up = now.select("conv_id", F.col("turn").alias("thread"), F.col("thread").alias("_up"), F.col("depth").alias("_more"))
        step = now.join(up, ["conv_id", "thread"], "left")
        if step.where("_up is not null").isEmpty():
            return now
        now = written(step.select("conv_id", "turn", F.coalesce("_up", "thread").alias("thread"), (F.col("depth") + F.coalesce("_more", F.lit(0))).alias("depth")), "threads")
    raise RuntimeError(f"threads did not settle in {rounds} rounds")


def conversations(messages: DataFrame) -> DataFrame:
    """``messages`` (conv_id, turn, role, text and any other columns) as reply-ordered conversations.

    ``text`` becomes the message's own words; adds quote_levels, n_passages,
    n_linked, n_cross, parent, thread and depth.  The order is
    ``(conv_id, thread, turn)``; see :func:`in_order`.
    """
    new = ["quote_levels", "n_passages", "n_linked", "n_cross", "parent", "thread", "depth"]
    kept = messages.drop(*new)
    links = written(link(messages), "links")
    inside = links.where("to_conv is not null and not cross")
    parents = inside.groupBy("conv_id", "turn").agg(F.min(F.struct("level", (-F.col("to_turn")).alias("t"))).alias("b")).select("conv_id", "turn", (-F.col("b.t")).alias("parent"))
    parents = written(parents, "parents")
    sums = links.groupBy("conv_id", "turn").agg(
        F.max("level").cast("long").alias("quote_levels"), F.count(F.lit(1)).alias("n_passages"), F.count("to_conv").alias("n_linked"), F.count(F.when(F.col("cross"), 1)).alias("n_cross")
    )
    out = kept.join(sums, ["conv_id", "turn"], "left").join(parents, ["conv_id", "turn"], "left").join(threads(parents), ["conv_id", "turn"], "left")
    zero = {c: F.coalesce(c, F.lit(0).cast("long")) for c in ("quote_levels", "n_passages", "n_linked", "n_cross", "depth")}
    return out.withColumns(zero | {"thread": F.coalesce("thread", "turn"), "text": own_text(F.col("text"))}).select(*kept.columns, *new)


def in_order(found: DataFrame) -> DataFrame:
    """The rows of :func:`conversations` range-partitioned and sorted in reply order."""
    width = int(found.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return found.repartitionByRange(width, "conv_id", "thread", "turn").sortWithinPartitions("conv_id", "thread", "turn")
