"""Chat formatting: reply trees become conversations under a template with escaped texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from veilspark.llm.common import stored

#: The marks of the template (fixed values).
START, END = "<|im_start|>", "<|im_end|>"


def escaped(text: Column) -> Column:
    """No ``<|`` is left: each run ``<``, backslashes, ``|`` gets one more backslash. Null is empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"<(\\*)\|", r"<$1\\|")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\\\|", r"<$1|")


def _role(role: Column) -> Column:
    """Roles stand on one line: backslashes and line breaks are written with a backslash."""
    return escaped(F.replace(F.replace(F.coalesce(role, F.lit("")), F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")))


def _role_back(role: Column) -> Column:
    parts = F.split(unescaped(role), r"\\\\")
    return F.array_join(F.transform(parts, lambda p: F.replace(p, F.lit("\\n"), F.lit("\n"))), "\\")


def reply_paths(nodes: DataFrame, branches: int | None = None) -> DataFrame:
    """``(tree_id, leaf_id, rank, node_id, depth)``: the nodes on each root-to-leaf path, root at depth 0.

    ``nodes`` has ``tree_id, node_id, parent_id, score``; (tree_id, node_id) names a node. A node whose parent
    is null or isn't in the tree is a root; a node that nobody replies to is a leaf. Rank 1 is the path of the
    highest mean score (null counts 0), ties to the smaller leaf; ``branches`` keeps that many paths per tree.
    Nodes with null ids and nodes on a cycle of parents have no root and are on no path.

    Paths grow by doubling: round k joins the nodes 2**k steps up, so a chain of n turns takes log2(n)
    self-joins over narrow rows. Every join is on (tree, node): a large tree is dealt over many tasks.
    """
    own = nodes.select("tree_id", "node_id", "parent_id", F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score"))
    own = own.where("tree_id is not null and node_id is not null")
    parents = own.select("tree_id", F.col("node_id").alias("parent_id"))
    up = own.join(parents, ["tree_id", "parent_id"], "left_semi").where("parent_id != node_id")
    jumps = stored(up.select("tree_id", "node_id", F.col("parent_id").alias("up")), "jumps")
    replied = up.select("tree_id", F.col("parent_id").alias("node_id"))
    leaves = own.join(replied, ["tree_id", "node_id"], "left_anti")
    largest = own.groupBy("tree_id").count().agg(F.max("count")).first()[0] or 0
    paths = leaves.select("tree_id", F.col("node_id").alias("leaf_id"), "node_id", F.lit(0).cast("bigint").alias("above"))
    paths, steps = stored(paths, "paths"), jumps
    # Steps that are left once they pass over more nodes than a tree has go round a cycle.
    for k in range(int(largest).bit_length()):
        if jumps.isEmpty():
            break
        higher = paths.join(jumps, ["tree_id", "node_id"]).select("tree_id", "leaf_id", F.col("up").alias("node_id"), (F.col("above") + (1 << k)).alias("above"))
        paths = stored(paths.union(higher), "paths")
        next_up = jumps.select("tree_id", F.col("node_id").alias("low"), F.col("up").alias("node_id"))
        jumps = stored(next_up.join(jumps, ["tree_id", "node_id"]).select("tree_id", F.col("low").alias("node_id"), "up"), "jumps")
    answers = steps.select("tree_id", "node_id", F.lit(True).alias("answers"))
    scored = paths.join(own.select("tree_id", "node_id", "score"), ["tree_id", "node_id"]).join(answers, ["tree_id", "node_id"], "left")
    ends = scored.groupBy("tree_id", "leaf_id").agg(F.max("above").alias("top"), F.avg("score").alias("score"), F.bool_or(F.col("answers").isNull()).alias("rooted"))
    ends = ends.where("rooted").drop("rooted")
    order = Window.partitionBy("tree_id").orderBy(F.desc("score"), "leaf_id")
    ends = ends.withColumn("rank", F.row_number().over(order)).drop("score")
    if branches is not None:
        ends = ends.where(F.col("rank") <= branches)
    return paths.join(ends, ["tree_id", "leaf_id"]).select("tree_id", "leaf_id", "rank", "node_id", (F.col("top") - F.col("above")).alias("depth"))


def formatted_trees(nodes: DataFrame, branches: int | None = None) -> DataFrame:
    """``(tree_id, leaf_id, rank, formatted)``: each chosen root-to-leaf path as one conversation.

    ``nodes`` has ``tree_id, node_id, parent_id, role, text, score``. A turn is the start mark, the role, a line
    break, the text, the end mark and a line break. Null roles and texts are empty. The text of a turn is shuffled
    once for all paths that it is on; one conversation is one row.
    """
    turns = reply_paths(nodes, branches).join(nodes.select("tree_id", "node_id", "role", "text"), ["tree_id", "node_id"])
    turn = F.concat(F.lit(START), _role(F.col("role")), F.lit("\n"), escaped(F.col("text")), F.lit(END + "\n"))
    paths = turns.groupBy("tree_id", "leaf_id").agg(F.first("rank").alias("rank"), F.array_sort(F.collect_list(F.struct("depth", turn.alias("turn")))).alias("turns"))
    return paths.select("tree_id", "leaf_id", "rank", F.array_join(F.col("turns.turn"), "").alias("formatted"))


def parsed(formatted: Column) -> Column:
    """The turns read back from a formatted conversation: an array of (role, text)."""
    parts = F.slice(F.split(formatted, r"<\|im_start\|>"), 2, 1 << 30)
    turn = F.transform(parts, lambda p: F.substring_index(p, END, 1))
    split = lambda t: F.struct(
        _role_back(F.substring_index(t, "\n", 1)).alias("role"), unescaped(F.substring(t, F.instr(t, "\n") + 1, F.length(t))).alias("text")
    )
    return F.transform(turn, split)


def loss_text(turns: Column, role: str = "assistant") -> Column:
    """All text under the loss mask, unescaped: the texts of ``role``, in order, nothing between."""
    return F.array_join(F.transform(F.filter(turns, lambda t: t["role"] == role), lambda t: t["text"]), "")


def chains(turns: DataFrame, key: str = "conv_id", order: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Rows by turn as reply trees without branches: each row answers the one before it.

    Rows with the same turn follow by role and text, nulls first; repeated rows stay. A null key is a
    conversation of its own kind and is left out, since no tree can be named by it.
    """
    by = Window.partitionBy(key).orderBy(*[F.asc_nulls_first(c) for c in (order, role, text)])
    rows = turns.where(F.col(key).isNotNull()).select(F.col(key).alias("tree_id"), F.row_number().over(by).cast("bigint").alias("node_id"), F.col(role).alias("role"), F.col(text).alias("text"))
    return rows.withColumn("parent_id", F.when(F.col("node_id") > 1, F.col("node_id") - 1)).withColumn("score", F.lit(0.0))
