"""Chat formatting of reply trees, with DataFrame functions only.

A message names its parent. Root-to-leaf paths come from self-joins that double their reach each
round, so a thread of n messages takes log2 n of them; branches are ranked by score, and each chosen
path is written as one conversation.

The template is ``<|turn|>role<|says|>text<|end|>``. Control strings inside roles and texts, its own
and the common ones of other templates, get a backslash after their first character, and one more if
they have some already, so that taking one away gives back the text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tessera.llm.common import stored

TURN, SAYS, END = "<|turn|>", "<|says|>", "<|end|>"
#: What opens a control string, and what completes one.
CONTROLS = r"(\||/?s>|/?INST\]|/?SYS>>)"
OPENERS = r"([<\[])"


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, OPENERS + r"(\\*)" + CONTROLS, r"$1\\$2$3")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, OPENERS + r"\\(\\*)" + CONTROLS, "$1$2$3")


def _rooted(links: DataFrame) -> DataFrame:
    """``links(tree, node, over, score)`` -> ``(tree, node, depth, total)`` of nodes that reach a root: depth, and the sum of scores from the root on, by doubling."""
    depth = F.when(F.col("over").isNull(), 0).otherwise(1).cast("long")
    reach = stored(links.select("tree", "node", F.col("over").alias("far"), depth.alias("depth"), F.col("score").alias("total")), "reach")
    rounds, most = 0, links.count().bit_length() + 1
    while rounds < most and not reach.where("far is not null").isEmpty():
        # Only nodes still below their root go on; those that reached it are looked up, not joined again.
        step = reach.select("tree", F.col("node").alias("far"), F.col("far").alias("further"), F.col("depth").alias("more"), F.col("total").alias("plus"))
        moved = reach.where("far is not null").join(step, ["tree", "far"])
        moved = moved.select("tree", "node", F.col("further").alias("far"), (F.col("depth") + F.col("more")).alias("depth"), (F.col("total") + F.col("plus")).alias("total"))
        reach = stored(reach.where("far is null").unionByName(moved), "reach")
        rounds += 1
    return reach.where("far is null").select("tree", "node", "depth", "total")


def paths(messages: DataFrame, best: int | None = None) -> DataFrame:
    """``messages(tree, node, parent, score)`` -> ``(tree, leaf, rank, node, up)``: the ancestors of the ``best`` leaves of each tree, the leaf itself at 0.

    Leaves rank by the mean score of their path, summed while depths are found, before any path is
    enumerated. ``node`` is unique in its tree. A parent that isn't in the tree makes a root; nodes
    that reach no root, being in a ring, and what hangs on them, are on no path.
    """
    nodes = messages.select("tree", "node", "parent", "score")
    known = nodes.select("tree", F.col("node").alias("parent"), F.lit(True).alias("is_node"))
    links = nodes.join(known, ["tree", "parent"], "left").select("tree", "node", F.when(F.col("is_node"), F.col("parent")).alias("over"), "score")
    links = stored(links, "links")
    parents = links.where("over is not null").select("tree", F.col("over").alias("node")).distinct()
    leaves = _rooted(links).join(parents, ["tree", "node"], "left_anti").select("tree", F.col("node").alias("leaf"), "depth", (F.col("total") / (F.col("depth") + 1)).alias("mean"))
    # A tree has as many rows here as leaves, without texts.
    leaves = leaves.withColumn("rank", F.row_number().over(W.partitionBy("tree").orderBy(F.desc("mean"), "leaf")))
    leaves = leaves if best is None else leaves.where(F.col("rank") <= best)
    leaves = stored(leaves, "leaves")
    out = leaves.select("tree", "leaf", "rank", F.col("leaf").alias("node"), F.lit(0).cast("long").alias("up"))
    jump, width = links.where("over is not null").select("tree", "node", "over"), 1
    deepest = leaves.agg(F.max("depth")).first()[0] or 0
    while width <= deepest:
        out = stored(out.unionByName(out.join(jump, ["tree", "node"]).select("tree", "leaf", "rank", F.col("over").alias("node"), (F.col("up") + width).alias("up"))), "paths")
        width *= 2
        if width <= deepest:
            on = jump.select("tree", F.col("node").alias("over"), F.col("over").alias("further"))
            jump = stored(jump.join(on, ["tree", "over"]).select("tree", "node", F.col("further").alias("over")), "jump")
    return out


def conversations(messages: DataFrame, best: int | None = 1, learned: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """``messages(tree, node, parent, role, text, score)`` -> ``(tree, leaf, rank, turns, formatted, mask)``.

    One row for each root-to-leaf path among the ``best`` of its tree (None: all) by the mean score of
    its messages, higher first, ties by the smaller leaf. ``mask``: spans (start from 0, length) of
    ``formatted`` that a loss is taken over, the texts of ``learned`` roles as they stand there,
    empty ones included. Null role or text is as empty, null score as zero; a null tree is a tree of
    its own; of repeated (tree, node) rows the least by parent, role, text and score counts; texts may
    be of any length, all of a path's being one row; other columns are not read; an empty table gives
    no rows.
    """
    rows = messages.select("tree", "node", "parent", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score"))
    rows = rows.withColumn("tree", F.coalesce(F.concat(F.lit("="), F.col("tree").cast("string")), F.lit("")))
    rows = rows.groupBy("tree", "node").agg(F.min(F.struct("parent", "role", "text", "score")).alias("m")).select("tree", "node", "m.*")
    steps = paths(rows, best).join(rows.select("tree", "node", "role", "text"), ["tree", "node"])
    text = escaped(F.col("text"))
    before = F.concat(F.lit(TURN), escaped(F.col("role")), F.lit(SAYS))
    turn = F.struct((-F.col("up")).alias("at"), F.concat(before, text, F.lit(END)).alias("line"), F.col("role").isin(*learned).alias("learn"), (F.col("past") + F.length(before)).alias("start"), F.length(text).alias("length"))
    past = F.sum(F.length(F.concat(before, text, F.lit(END)))).over(W.partitionBy("tree", "leaf", "rank").orderBy(F.desc("up")).rowsBetween(W.unboundedPreceding, -1))
    whole = steps.withColumn("past", F.coalesce(past, F.lit(0))).groupBy("tree", "leaf", "rank").agg(F.count(F.lit(1)).alias("turns"), F.sort_array(F.collect_list(turn)).alias("lines"))
    mask = F.transform(F.filter("lines", lambda x: x.learn), lambda x: F.struct(x.start.cast("long").alias("start"), x.length.cast("long").alias("length")))
    tree = F.when(F.col("tree") != "", F.col("tree").substr(F.lit(2), F.length("tree"))).alias("tree")
    return whole.select(tree, "leaf", "rank", "turns", F.array_join("lines.line", "").alias("formatted"), mask.alias("mask"))


def masked(formatted: Column, mask: Column) -> Column:
    """The texts under a mask, unescaped, one after the other."""
    return F.array_join(F.transform(mask, lambda m: unescaped(formatted.substr((m.start + 1).cast("int"), m.length.cast("int")))), "")


def parsed(formatted: Column) -> Column:
    """Turns of a formatted conversation as an array of (role, text), unescaped."""
    pieces = F.split(formatted, r"<\|end\|>")
    lines = F.slice(pieces, F.lit(1), F.size(pieces) - 1)
    cut = F.length(F.lit(TURN))
    return F.transform(lines, lambda x: F.struct(unescaped(F.substring_index(x, SAYS, 1).substr(cut + 1, F.length(x))).alias("role"), unescaped(F.substring_index(x, SAYS, -1)).alias("text")))
