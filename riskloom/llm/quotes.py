"""Reply-ordered conversations without quotes.

A message's lines carry nested quote marks (``>``).  Runs of lines at one
level are quoted passages; a passage, and each of its lines, is normalised
(marks off, lower case, white space collapsed) and hashed.  The same hashes of
what every message says itself (its whole text, paragraphs and lines) lead to
the message that said it first in that conversation.  A message replies to the
origin of its outermost quote that can be found, a whole passage before a
line.  Following replies upward gives the thread; conversations are ordered by
thread, then turn, so that every reply follows what it answers.

DataFrame operations only.  Origins are reduced to one row per conversation
and hash before the join, so a phrase that everybody repeats is one row, and
its quotes a skewed join side that is split.  Positions come from one range
sort and per-partition offsets: no task holds a whole conversation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.llm.tables import written

MARKS = r"^((?:[ \t]*>)+)"
MESSAGE = ["conv_id", "turn", "role", "text"]


def quote_level(line: Column) -> Column:
    return F.length(F.regexp_replace(F.regexp_extract(line, MARKS, 1), "[^>]", ""))


def without_marks(line: Column) -> Column:
    return F.regexp_replace(line, MARKS + r"[ \t]?", "")


def normalised(text: Column) -> Column:
    """Lower case, white space collapsed to single spaces, ends trimmed."""
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


def own_text(text: Column) -> Column:
    """The text without quoted lines, blank lines at the ends cut."""
    lines = F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: quote_level(x) == 0)
    return F.regexp_replace(F.array_join(lines, "\n"), r"^\s*\n|\s+$", "")


def _hash(text: Column) -> Column:
    return F.md5(normalised(text))


def passages(messages: DataFrame) -> DataFrame:
    """Quoted passages and lines: the message's conv_id, turn and ``key``, then
    level, run (number of the passage in the message), line (-1: the whole
    passage) and hash."""
    lines = (messages.where(F.col("text").rlike(r"(?m)" + MARKS)).select("conv_id", "turn", "key", F.posexplode(F.split("text", "\n")).alias("line", "raw"))
             .withColumn("level", quote_level(F.col("raw"))).withColumn("body", without_marks(F.col("raw"))))
    w = Window.partitionBy("conv_id", "turn", "key").orderBy("line")  # the lines of one message
    lines = (lines.withColumn("new", (F.col("level") != F.coalesce(F.lag("level").over(w), F.lit(-1))).cast("int"))
             .withColumn("run", F.sum("new").over(w)).where("level > 0"))
    whole = (lines.groupBy("conv_id", "turn", "key", "level", "run")
             .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "body"))), lambda x: x["body"]), "\n").alias("body"))
             .withColumn("line", F.lit(-1)))
    cols = ["conv_id", "turn", "key", "level", "run", "line"]
    every = whole.select(*cols, "body").unionByName(lines.select(*cols, "body"))
    return every.where(F.length(normalised(F.col("body"))) > 0).select(*cols, _hash(F.col("body")).alias("hash"))


def origins(messages: DataFrame) -> DataFrame:
    """conv_id, hash and the first turn that says it: whole texts, paragraphs
    and lines of the messages themselves."""
    own = F.col("own")
    said = F.concat(F.array(own), F.split(own, r"\n\s*\n"), F.split(own, "\n"))
    return (messages.select("conv_id", "turn", F.explode(F.array_distinct(said)).alias("body"))
            .where(F.length(normalised(F.col("body"))) > 0)
            .groupBy("conv_id", _hash(F.col("body")).alias("hash")).agg(F.min("turn").alias("origin")))


def links(messages: DataFrame) -> DataFrame:
    """conv_id, turn, key and parent_turn of the messages that quote an earlier one."""
    quoted = passages(messages)
    said = origins(messages.join(quoted.select("conv_id").distinct(), "conv_id", "left_semi"))
    found = quoted.join(said, ["conv_id", "hash"]).where("origin < turn")
    best = F.min(F.struct("level", F.when(F.col("line") < 0, 0).otherwise(1).alias("part"), "run", "line", "origin"))
    return found.groupBy("conv_id", "turn", "key").agg(best.alias("b")).select("conv_id", "turn", "key", F.col("b.origin").alias("parent_turn"))


def thread_roots(parents: DataFrame, most_rounds: int = 40) -> DataFrame:
    """conv_id, turn, root: the top of the chain of parents, by pointer
    doubling (the rounds grow with the logarithm of the longest chain)."""
    up = written(parents.groupBy("conv_id", "turn").agg(F.min("parent_turn").alias("root")), "reply-roots")
    for _ in range(most_rounds):
        higher = up.select("conv_id", F.col("turn").alias("root"), F.col("root").alias("higher"))
        new = written(up.join(higher, ["conv_id", "root"], "left"), "reply-roots")
        if new.where("higher IS NOT NULL").isEmpty():
            return up
        up = new.select("conv_id", "turn", F.coalesce("higher", "root").alias("root"))
    raise RuntimeError(f"reply chains longer than 2 ** {most_rounds}")


def positions(rows: DataFrame, group: str, order: list[Column]) -> DataFrame:
    """``rows`` with ``position``: 1-based in the group by ``order``.  One range
    sort over all rows; a group that fills many partitions stays in many."""
    keys = [F.col(group).asc_nulls_first(), *order]
    ranged = rows.repartitionByRange(*keys).sortWithinPartitions(*keys)
    numbered = written(ranged.withColumn("_at", F.monotonically_increasing_id()), "reply-order").withColumn("_part", F.shiftright("_at", 33))
    per = numbered.groupBy(F.col(group).alias("_g"), F.col("_part").alias("_p")).agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("_g").orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)  # a row per partition
    per = per.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    joined = numbered.join(per, F.col(group).eqNullSafe(F.col("_g")) & (F.col("_part") == F.col("_p")))
    return joined.withColumn("position", F.col("_at") - F.col("_first") + F.col("_before") + 1).drop("_at", "_part", "_g", "_p", "_first", "_n", "_before")


def reply_threads(conversations: DataFrame) -> DataFrame:
    """One row per different message: conv_id, turn, role, own_text (without
    quotes), quote_depth, parent_turn (null: quotes nothing that can be found),
    thread_turn (the top of its chain), position in the conversation and copies.

    Equal rows are one message with their number as ``copies``; several
    messages of one turn are ordered by role, then text.  A null text is empty.
    Messages without conv_id or turn are kept but not linked, and come first.
    An empty table gives no rows; extra columns are ignored.
    """
    rows = conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("role").cast("string"),
                                F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    key = F.md5(F.concat_ws("\0", F.coalesce("role", F.lit("\1")), "text"))
    messages = rows.groupBy("conv_id", "turn", "role", "text").agg(F.count(F.lit(1)).alias("copies")).withColumn("key", key)
    lines = F.split("text", "\n")
    messages = written(messages.withColumn("own", own_text(F.col("text"))).withColumn(
        "quote_depth", F.array_max(F.transform(lines, quote_level))), "messages")
    parents = written(links(messages.where("conv_id IS NOT NULL AND turn IS NOT NULL")), "reply-links")
    roots = thread_roots(parents).withColumnRenamed("root", "thread_turn")
    out = (messages.join(parents, ["conv_id", "turn", "key"], "left").join(roots, ["conv_id", "turn"], "left")
           .withColumn("thread_turn", F.when(F.col("parent_turn").isNull(), F.col("turn")).otherwise(F.col("thread_turn"))))
    order = [F.col(c).asc_nulls_first() for c in ("thread_turn", "turn", "role", "text")]
    return positions(out, "conv_id", order).select("conv_id", "turn", "role", F.col("own").alias("own_text"), "quote_depth",
                                                   "parent_turn", "thread_turn", "position", "copies")
