"""Chat formatting of reply trees, with DataFrame operations only.

Messages name their parents. Self-joins enumerate every path from a root to a leaf:
a table of jumps doubles its reach with each join, and each leaf's known ancestors
double with it, so a path of n messages takes log2(n) joins. Branches are ranked by
score, and each chosen path is formatted as one conversation.

A turn is ``### role: text</turn>`` and a line feed. Inside texts and roles the
control strings are escaped so that none is left: a backslash is doubled, ``###`` is
written ``\\h``, ``</turn>`` is ``\\e``, and a colon in a role ``\\c``. The loss mask is spans of code
points of the formatted string, one for each text of a trained role.

Defined results: a null text or role is the empty string; a message whose parent is
not there is a root; repeated messages (same tree and id) are all followed, so a
child of both has a path through each; messages on a cycle, or below one, have no
path and give no row; an empty table gives none. Extra columns are not carried.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm.common import cut

HEAD, END = "### ", "</turn>\n"


def escape(text: Column, role: bool = False) -> Column:
    out = F.replace(F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("###"), F.lit("\\h")), F.lit("</turn>"), F.lit("\\e"))
    return F.replace(out, F.lit(":"), F.lit("\\c")) if role else out


def unescape(text: Column) -> Column:
    """Pairs of backslashes are split off first, from the left; a backslash that is left begins another escape."""
    undone = F.transform(F.split(text, r"\\\\", -1), lambda p: F.replace(F.replace(F.replace(p, F.lit("\\h"), F.lit("###")), F.lit("\\e"), F.lit("</turn>")), F.lit("\\c"), F.lit(":")))
    return F.array_join(undone, "\\")


def paths(messages: DataFrame) -> DataFrame:
    """messages: tree, id, parent (null for a root). Returns tree, leaf, id, up: each leaf's messages and how far above it they are.

    Rows are keyed by tree and id; the number of result rows is the length of all paths.
    """
    links = messages.select("tree", "id", "parent")
    known = links.select("tree", F.col("id").alias("parent"), F.lit(True).alias("found")).distinct()
    links = links.join(known, ["tree", "parent"], "left").select("tree", "id", F.when(F.col("found"), F.col("parent")).alias("jump"))
    links = cut(links)
    leaves = links.join(links.select("tree", F.col("jump").alias("id")).where(F.col("id").isNotNull()).distinct(), ["tree", "id"], "left_anti").select("tree", F.col("id").alias("leaf"), "id", F.lit(0).cast("long").alias("up")).distinct()
    reached, jump, step, most = cut(leaves), links.distinct(), 1, None
    while not jump.where(F.col("jump").isNotNull()).isEmpty():
        if most is None:
            most = links.count()
        if step > most:  # only what hangs on a cycle still jumps
            rootless = jump.where(F.col("jump").isNotNull()).select("tree", F.col("id").alias("leaf")).distinct()
            return reached.join(rootless, ["tree", "leaf"], "left_anti")
        up = jump.where(F.col("jump").isNotNull())
        further = reached.join(up, ["tree", "id"]).select("tree", "leaf", F.col("jump").alias("id"), (F.col("up") + step).alias("up"))
        reached = cut(reached.unionByName(further))
        then = up.select("tree", F.col("id").alias("jump"), F.col("jump").alias("then"))
        jump, step = cut(up.join(then, ["tree", "jump"]).select("tree", "id", F.col("then").alias("jump"))), step * 2
    return reached


def format_trees(messages: DataFrame, keep: int | None = None, trained: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """messages: tree, id, parent, role, text, score. Returns tree, leaf, rank, score, formatted and mask.

    A path's score is the sum of its messages' (null: 0). Paths of a tree are ranked by
    score, ties to the longer path, then the smaller leaf; keep takes the first so many.
    """
    texts = messages.select("tree", "id", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score"))
    found = paths(messages)
    if keep is not None:
        ranked = found.join(texts.select("tree", "id", "score"), ["tree", "id"]).groupBy("tree", "leaf").agg(F.sum("score").alias("total"), F.count("*").alias("n"))
        best = ranked.withColumn("k", F.row_number().over(Window.partitionBy("tree").orderBy(F.desc("total"), F.desc("n"), "leaf"))).where(F.col("k") <= keep)
        found = found.join(best.select("tree", "leaf"), ["tree", "leaf"], "left_semi")
    turn = F.struct((-F.col("up")).alias("at"), F.col("role"), F.col("text"))
    whole = found.join(texts, ["tree", "id"]).groupBy("tree", "leaf").agg(F.array_sort(F.collect_list(turn)).alias("turns"), F.sum("score").alias("score"))
    parts = F.transform("turns", lambda t: F.struct(F.concat(F.lit(HEAD), escape(t["role"], True), F.lit(": ")).alias("head"), escape(t["text"]).alias("body"), t["role"].alias("role")))
    whole = whole.withColumn("parts", parts)
    sizes = F.transform("parts", lambda p: F.struct(F.length(p["head"]).alias("head"), F.length(p["body"]).alias("body"), p["role"].isin(*trained).alias("on")))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))

    def grow(acc: Column, s: Column) -> Column:
        begin = acc["at"] + s["head"]
        span = F.struct(begin.alias("start"), (begin + s["body"]).alias("end"))
        return F.struct((begin + s["body"] + len(END)).alias("at"), F.when(s["on"], F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"]).alias("spans"))

    mask = F.aggregate(sizes, start, grow, lambda acc: acc["spans"])
    out = whole.select("tree", "leaf", "score", F.size("turns").alias("n_turns"), F.array_join(F.transform("parts", lambda p: F.concat(p["head"], p["body"], F.lit(END))), "").alias("formatted"), mask.alias("mask"))
    return out.withColumn("rank", F.row_number().over(Window.partitionBy("tree").orderBy(F.desc("score"), F.desc("n_turns"), "leaf"))).drop("n_turns")


def read_back(formatted: Column) -> Column:
    """The turns of a formatted conversation: an array of role and text."""
    pieces = F.filter(F.split(formatted, "</turn>\n", -1), lambda p: p != "")

    def turn(p: Column) -> Column:
        at = F.instr(p, ": ")
        return F.struct(unescape(F.substring(p, F.lit(len(HEAD) + 1), at - len(HEAD) - 1)).alias("role"), unescape(F.substring(p, at + 2, F.length(p))).alias("text"))

    return F.transform(pieces, turn)


def loss_text(formatted: Column, mask: Column) -> Column:
    """All text under the mask, unescaped span by span."""
    return F.array_join(F.transform(mask, lambda s: unescape(F.substring(formatted, s["start"] + 1, s["end"] - s["start"]))), "")


def from_turns(conversations: DataFrame) -> DataFrame:
    """Rows of conv_id, turn, role and text as messages of a tree in which each turn answers the one before.

    Turns that tie are ordered by role and text; a repeated row is a turn of its own.
    """
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = conversations.select("conv_id", "turn", "role", "text").withColumn("id", F.row_number().over(order).cast("long"))
    tree = F.coalesce(F.concat(F.lit("c"), F.col("conv_id").cast("string")), F.lit("null"))
    return rows.select(tree.alias("tree"), "conv_id", "id", F.when(F.col("id") > 1, F.col("id") - 1).alias("parent"), "role", "text", F.lit(0.0).alias("score"))
