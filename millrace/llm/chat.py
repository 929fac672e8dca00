"""Chat formatting of reply trees.

Messages form trees by their parents. Pointer doubling (self-joins in which every
message learns its ancestor 1, 2, 4, ... steps up) gives depths and branch scores in
as many joins as the logarithm of the depth; the same ancestor tables, taken from the
longest jump down, enumerate the messages on the chosen root-to-leaf paths. Each
chosen path is formatted as one conversation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .tables import stored

#: The template: what opens a turn before and after the role, and what closes it.
OPEN, OPENED, CLOSE = "<|turn:", "|>\n", "<|end|>\n"
#: Characters that begin any control string, and their escapes; the escape character first.
ESCAPES = (("\\", "\\b"), ("<", "\\l"), ("[", "\\k"))


def escaped(text: Column) -> Column:
    """Text without any control string of this or another bracketed template."""
    for char, code in ESCAPES:
        text = F.replace(text, F.lit(char), F.lit(code))
    return text


def unescaped(text: Column) -> Column:
    for char, code in reversed(ESCAPES):
        text = F.replace(text, F.lit(code), F.lit(char))
    return text


def branches(nodes: DataFrame, top: int = 1) -> DataFrame:
    """Root-to-leaf paths of (tree, node, parent, score): rows (tree, branch, node, up).

    Branches are ranked in a tree by the sum of their messages' scores, then by the
    smaller leaf; the ``top`` best are returned, ``up`` counting steps from the leaf.
    A parent that doesn't exist makes its child a root; messages on a cycle belong to
    no root and are left out. Keys may not be null. No path is held in a row.
    """
    nodes = stored(nodes.select("tree", "node", "parent", F.coalesce("score", F.lit(0.0)).alias("score")), "messages")
    known = nodes.select("tree", F.col("node").alias("parent")).distinct().withColumn("known", F.lit(True))
    linked = nodes.join(known, ["tree", "parent"], "left").withColumn("above", F.when(F.col("known"), F.col("parent")))
    replied = linked.filter(F.col("above").isNotNull()).select("tree", F.col("above").alias("node")).distinct().withColumn("replied", F.lit(True))
    state = linked.join(replied, ["tree", "node"], "left").select("tree", "node", "above", "score", F.col("replied").isNull().alias("leaf"))
    state = stored(state, "linked")
    # Rows without an ancestor left are done; only open ones are joined again. Whether a message
    # is a leaf travels with it, so no join is repeated for every part of what is done.
    closed = state.filter(F.col("above").isNull())
    opened = state.filter(F.col("above").isNotNull())
    jumps, deepest = [], nodes.count()
    while opened.take(1) and 1 << len(jumps) <= deepest:  # what is open after that is on a cycle
        jumps.append(opened.select("tree", F.col("node").alias("at"), "above"))
        up = closed.unionByName(opened).select("tree", F.col("node").alias("above"), F.col("above").alias("further"), F.col("score").alias("plus"))
        moved = opened.join(up, ["tree", "above"]).select(
            "tree", "node", F.col("further").alias("above"), (F.col("score") + F.col("plus")).alias("score"), "leaf"
        )
        moved = stored(moved, "moved")
        closed = closed.unionByName(moved.filter(F.col("above").isNull()))
        opened = moved.filter(F.col("above").isNotNull())
    leaves = closed.filter("leaf").drop("leaf")
    best = F.row_number().over(W.partitionBy("tree").orderBy(F.desc("score"), "node"))
    paths = leaves.withColumn("branch", best).filter(F.col("branch") <= top).select("tree", "branch", "node", F.lit(0).cast("long").alias("up"))
    for k in range(len(jumps) - 1, -1, -1):
        met = paths.join(jumps[k].withColumnRenamed("at", "node"), ["tree", "node"], "left")
        here = F.struct(F.col("node"), F.col("up"))
        there = F.struct(F.col("above").alias("node"), (F.col("up") + (1 << k)).alias("up"))
        met = met.select("tree", "branch", F.explode(F.when(F.col("above").isNull(), F.array(here)).otherwise(F.array(here, there))).alias("x"))
        paths = met.select("tree", "branch", "x.node", "x.up")
        if k and k % 6 == 0:
            paths = stored(paths, "paths")
    return paths


def format_turns(turns: DataFrame) -> DataFrame:
    """Formats rows (tree, branch, up, role, text) as one row per (tree, branch).

    ``formatted`` is the text; ``turns`` its number; ``loss`` the loss mask, for each
    assistant turn (turn, turn_start, start, end) in code points of ``formatted``, end
    exclusive. Null roles and texts are empty.
    """
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    head = F.concat(F.lit(OPEN), escaped(role), F.lit(OPENED))
    pieces = turns.select("tree", "branch", "up", (role == "assistant").alias("learnt"), head.alias("head"), escaped(text).alias("body"))
    pieces = pieces.withColumn("piece", F.concat("head", "body", F.lit(CLOSE)))
    order = W.partitionBy("tree", "branch").orderBy(F.desc("up"))
    before = F.coalesce(F.sum(F.char_length("piece")).over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    pieces = pieces.withColumns({"turn": F.row_number().over(order) - 1, "turn_start": before})
    start = F.col("turn_start") + F.char_length("head")
    span = F.struct("turn", "turn_start", start.alias("start"), (start + F.char_length("body")).alias("end"))
    listed = F.sort_array(F.collect_list(F.struct("turn", "piece", F.when(F.col("learnt"), span).alias("span"))))
    return pieces.groupBy("tree", "branch").agg(listed.alias("rows")).select(
        "tree", "branch",
        F.array_join(F.col("rows.piece"), "").alias("formatted"),
        F.filter(F.col("rows.span"), lambda s: s.isNotNull()).alias("loss"),
    )


def read_formatted(formatted: DataFrame) -> DataFrame:
    """Reads conversations back: adds ``turns`` (role, text) and ``learnt``, the texts under the mask."""
    quoted = F.lit(r"(?<=\Q" + CLOSE + r"\E)")
    pieces = F.filter(F.split("formatted", quoted, -1), lambda p: p != "")
    out = formatted.withColumn("pieces", pieces)
    opened = F.lit(OPENED)
    turns = F.transform(
        "pieces",
        lambda p: F.struct(
            unescaped(F.substr(p, F.lit(len(OPEN) + 1), F.position(opened, p) - 1 - len(OPEN))).alias("role"),
            unescaped(F.substr(p, F.position(opened, p) + len(OPENED), F.char_length(p) - F.position(opened, p) - len(OPENED) + 1 - len(CLOSE))).alias("text"),
        ),
    )
    learnt = F.transform("loss", lambda s: unescaped(F.substr(F.col("pieces")[s["turn"]], (s["start"] - s["turn_start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int"))))
    return out.withColumns({"turns": turns, "learnt": learnt}).drop("pieces")


def conversation_trees(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) as messages: each turn replies to the one before it.

    Rows with a null conv_id are one conversation; equal turns are ordered by role and
    text, and repeated rows stay as turns of their own.
    """
    order = W.partitionBy("conv_id").orderBy("turn", "role", "text")
    return rows.withColumn("node", F.row_number().over(order).cast("long")).select(
        "conv_id", F.coalesce(F.col("conv_id").cast("string"), F.lit("none")).alias("tree"), "node", (F.col("node") - 1).alias("parent"), F.lit(1.0).alias("score"), "role", "text"
    )


def chat_conversations(messages: DataFrame, top: int = 1) -> DataFrame:
    """Formats the ``top`` best branches of each tree of (tree, node, parent, score, role, text)."""
    chosen = branches(messages, top)
    return format_turns(chosen.join(messages.select("tree", "node", "role", "text"), ["tree", "node"]))
