"""Chat formatting from reply trees.

Messages name their parent. Self-joins that double their reach find each message's depth and the sum of scores to its root
in rounds that grow with the logarithm of the depth; leaves are ranked by that score and the chosen ones are walked back to
the root by the same jumps. Each chosen path becomes one conversation in this template, with the code point spans of the
assistant's texts as loss mask:

    ### role
    text</turn>

Inside roles and texts a backslash is written ``\\e``, ``###`` as ``\\h``, ``</turn>`` as ``\\t`` and, in roles, a line end
as ``\\n``. A backslash is only ever followed by one of these letters, so both the split into turns and the way back are unique.

Scale: joins are on (tree, message), so a tree with a third of all messages is many tasks until its text is put together,
which is one value by definition. Only chosen paths are enumerated.

Defined cases: null roles and texts are empty. A parent that is not in the tree makes a root. Messages on a cycle have no
root and are left out. Repeated ids within a tree keep the smallest (role, text). Extra columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliospark.operators.shared import materialise

HEAD, STOP = "### ", "</turn>\n"


def escaped(text: Column) -> Column:
    text = F.replace(F.coalesce(text, F.lit("")), F.lit("\\"), F.lit("\\e"))
    return F.replace(F.replace(text, F.lit("###"), F.lit("\\h")), F.lit("</turn>"), F.lit("\\t"))


def unescaped(text: Column) -> Column:
    text = F.replace(F.replace(text, F.lit("\\h"), F.lit("###")), F.lit("\\t"), F.lit("</turn>"))
    return F.replace(text, F.lit("\\e"), F.lit("\\"))


def _role(role: Column) -> Column:
    return F.replace(escaped(role), F.lit("\n"), F.lit("\\n"))


def paths(messages: DataFrame, keep: int = 1) -> DataFrame:
    """``(tree, leaf, depth, role, text)``: the turns of the ``keep`` best root-to-leaf paths of each tree.

    ``messages`` are ``(tree, node, parent, score, role, text)``; a path's score is the sum over its messages, ties go to
    the deeper and then to the smaller leaf.
    """
    once = Window.partitionBy("tree", "node").orderBy("role", "text")
    known = materialise(messages.where("tree IS NOT NULL AND node IS NOT NULL").withColumn("_n", F.row_number().over(once)).where("_n = 1").drop("_n"))
    ids = known.select("tree", F.col("node").alias("parent"))
    linked = known.join(ids, ["tree", "parent"], "left_semi").select("tree", "node", "parent")
    jump = materialise(
        known.select("tree", "node", F.coalesce("score", F.lit(0.0)).cast("double").alias("total"))
        .join(linked, ["tree", "node"], "left").select("tree", "node", F.col("parent").alias("up"), F.lit(1).cast("long").alias("hops"), "total"))
    done, reach, jumps, most = [jump.where("up IS NULL")], jump.where("up IS NOT NULL"), [], jump.count()
    while 1 << len(jumps) <= 2 * most and not reach.isEmpty():  # only messages still short of their root jump on
        jumps.append(reach)
        above = reduce(DataFrame.union, [*done, reach]).select("tree", F.col("node").alias("up"), F.col("up").alias("next"), F.col("hops").alias("more"), F.col("total").alias("plus"))
        jump = materialise(reach.join(above, ["tree", "up"]).select(
            "tree", "node", F.col("next").alias("up"), (F.col("hops") + F.col("more")).alias("hops"), (F.col("total") + F.col("plus")).alias("total")))
        done.append(jump.where("up IS NULL"))
        reach = jump.where("up IS NOT NULL")
    rooted = reduce(DataFrame.union, done).select("tree", "node", "hops", "total")
    leaves = rooted.join(linked.select("tree", F.col("parent").alias("node")), ["tree", "node"], "left_anti")
    rank = Window.partitionBy("tree").orderBy(F.desc("total"), F.desc("hops"), "node")
    chosen = leaves.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= keep)
    walk = materialise(chosen.select("tree", F.col("node").alias("leaf"), "node"))
    for step in reversed(jumps):
        up = walk.join(step.select("tree", "node", "up"), ["tree", "node"])
        walk = materialise(walk.union(up.select("tree", "leaf", F.col("up").alias("node"))))
    turns = walk.join(rooted.select("tree", "node", "hops"), ["tree", "node"]).join(known, ["tree", "node"])
    return turns.select("tree", "leaf", F.col("hops").alias("depth"), "role", "text")


def formatted(turns: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """``(tree, leaf, text, loss)``: one text for each path and the spans of the loss mask, ends exclusive."""
    head = F.concat(F.lit(HEAD), _role(F.coalesce("role", F.lit(""))), F.lit("\n"))
    body = escaped(F.col("text"))
    rows = turns.select("tree", "leaf", "depth", (F.col("role") == loss_role).alias("masked"), head.alias("head"), body.alias("body"))
    rows = rows.withColumn("segment", F.concat("head", "body", F.lit(STOP)))
    order = Window.partitionBy("tree", "leaf").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    start = F.sum(F.length("segment")).over(order) - F.length("segment") + F.length("head")
    rows = rows.select("tree", "leaf", "depth", "segment", "masked", start.alias("start"), (start + F.length("body")).alias("stop"))
    whole = rows.groupBy("tree", "leaf").agg(F.sort_array(F.collect_list(F.struct("depth", "segment", "masked", "start", "stop"))).alias("s"))
    masked = F.transform(F.filter("s", lambda x: F.coalesce(x["masked"], F.lit(False))), lambda x: F.struct(x["start"].alias("start"), x["stop"].alias("stop")))
    return whole.select("tree", "leaf", F.array_join(F.transform("s", lambda x: x["segment"]), "").alias("text"), masked.alias("loss"))


def turns_of(text: Column) -> Column:
    """The ``(role, text)`` of each turn of a formatted text."""
    parts = F.filter(F.split(text, STOP), lambda p: p != "")  # a turn is never empty; after the last one nothing is left
    at = lambda p: F.instr(p, "\n")
    role = lambda p: unescaped(F.replace(F.substring(p, F.lit(len(HEAD) + 1), at(p) - len(HEAD) - 1), F.lit("\\n"), F.lit("\n")))
    body = lambda p: unescaped(F.substring(p, at(p) + 1, F.length(p)))
    return F.transform(parts, lambda p: F.struct(role(p).alias("role"), body(p).alias("text")))


def masked_text(text: Column, loss: Column) -> Column:
    """All text under the mask, as it was before it was escaped."""
    return F.array_join(F.transform(loss, lambda s: unescaped(F.substring(text, s["start"] + 1, s["stop"] - s["start"]))), "")
