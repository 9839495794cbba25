"""Reply trees as conversations.

A message answers another, so messages form trees. A path from a root to a leaf is one conversation.
Paths are found by self-joins that double their reach each time: after r of them every message
knows the one 2**r above it, and the sum of the scores up to there. Branches are ranked by their
leaf's mean score, and the chosen paths are written out by the same steps the other way round, each
join halving what a row still stands for. A tree of n messages in a row takes 2 log2(n) joins, and
no tree is ever together before its paths are formatted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skyframe.llm.tables import stored

OPEN, CLOSE = "<turn>", "</turn>\n"
ASSISTANT = "assistant"


def escaped(text: Column) -> Column:
    """A text in which no turn begins or ends: a backslash goes into each `<turn` and `</turn`,
    and one more into each that has some already."""
    return F.regexp_replace(text, r"<(\\*)(/?turn)", r"<\\$1$2")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)(/?turn)", r"<$1$2")


def escaped_role(role: Column) -> Column:
    """A role on one line: backslash and newline as \\b and \\n."""
    return escaped(F.replace(F.replace(role, F.lit("\\"), F.lit("\\b")), F.lit("\n"), F.lit("\\n")))


def unescaped_role(role: Column) -> Column:
    return F.replace(F.replace(unescaped(role), F.lit("\\n"), F.lit("\n")), F.lit("\\b"), F.lit("\\"))


def _jumps(nodes: DataFrame) -> list[DataFrame]:
    """Tables (tree, node, up, steps, total): by 2**r, who is that far above each message, or null,
    how many messages from it up to before there, and the sum of their scores."""
    known = nodes.select("tree", F.col("node").alias("up"))
    linked = nodes.select("tree", "node", F.col("parent").alias("up"), "score")
    # A message whose parent is not there is a root.
    real = linked.join(known, ["tree", "up"], "left_semi").select("tree", "node", "up", "score")
    roots = linked.join(known, ["tree", "up"], "left_anti").select("tree", "node", F.lit(None).cast("bigint").alias("up"), "score")
    level = real.unionByName(roots).select("tree", "node", "up", F.lit(1).cast("bigint").alias("steps"), F.col("score").alias("total"))
    levels = [stored(level, "jump")]
    size = None
    while True:
        level = levels[-1]
        open_ = level.where("up IS NOT NULL")
        left = open_.count()
        if not left:
            return levels
        size = size or level.count()
        if 2 ** (len(levels) - 1) > size:
            # Still someone above after more steps than there are messages: replies in a circle.
            levels[-1] = stored(level.where("up IS NULL"), "jump")
            return levels
        above = level.select("tree", F.col("node").alias("up"), F.col("up").alias("next"), F.col("steps").alias("more"), F.col("total").alias("extra"))
        further = open_.join(above, ["tree", "up"]).select(
            "tree", "node", F.col("next").alias("up"), (F.col("steps") + F.col("more")).alias("steps"), (F.col("total") + F.col("extra")).alias("total")
        )
        levels.append(stored(level.where("up IS NULL").unionByName(further), "jump"))


def branches(nodes: DataFrame, keep: int | None = None) -> DataFrame:
    """(tree, leaf, rank, branch_score, node, at): the messages of the `keep` best paths of each
    tree, all if it is None, with their place from 0 at the root.

    `nodes` has tree, node (a bigint, unique in its tree), parent (null for a root) and score; a
    null score is 0. A path's score is the mean of its messages'; ties go to the smaller leaf. A
    parent that is not there makes a root. Replies in a circle have no root, and no path.
    """
    nodes = stored(nodes.withColumn("score", F.coalesce(F.col("score").cast("double"), F.lit(0.0))), "messages")
    levels = _jumps(nodes)
    parents = nodes.where("parent IS NOT NULL").select("tree", F.col("parent").alias("node"))
    leaves = levels[-1].join(parents, ["tree", "node"], "left_anti")
    leaves = leaves.select("tree", F.col("node").alias("leaf"), "steps", (F.col("total") / F.col("steps")).alias("branch_score"))
    order = Window.partitionBy("tree").orderBy(F.desc("branch_score"), "leaf")
    ranked = leaves.withColumn("rank", F.row_number().over(order))
    if keep is not None:
        ranked = ranked.where(F.col("rank") <= keep)
    # A row stands for `left` messages from `node` upwards, the lowest of them at place `at`.
    paths = ranked.select("tree", "leaf", "rank", "branch_score", F.col("leaf").alias("node"), F.col("steps").alias("left"), (F.col("steps") - 1).alias("at"))
    for r in range(len(levels) - 2, -1, -1):
        far = F.lit(2**r).cast("bigint")
        jump = levels[r].where("up IS NOT NULL").select("tree", "node", "up")
        first = F.struct("node", F.least("left", far).alias("left"), "at")
        second = F.struct(F.col("up").alias("node"), (F.col("left") - far).alias("left"), (F.col("at") - far).alias("at"))
        both = F.when(F.col("left") > far, F.array(first, second)).otherwise(F.array(first))
        paths = paths.join(jump, ["tree", "node"], "left").select("tree", "leaf", "rank", "branch_score", F.explode(both).alias("part"))
        paths = paths.select("tree", "leaf", "rank", "branch_score", "part.*")
    return paths.drop("left")


def format_branches(nodes: DataFrame, keep: int | None = None) -> DataFrame:
    """(tree, leaf, rank, branch_score, formatted, loss_spans): each chosen path as one text.

    `nodes` as for `branches`, with role and text besides; null ones count as empty. A turn is
    `<turn>`, the role, a newline, the text and `</turn>` with a newline; what looks like that in a
    text or role is escaped, reversibly. `loss_spans` are (start, stop) in code points of every
    assistant's text, in order. An empty table gives an empty one.
    """
    role, text = (F.coalesce(F.col(name).cast("string"), F.lit("")) for name in ("role", "text"))
    turns = nodes.select(
        "tree", "node", F.concat(F.lit(OPEN), escaped_role(role), F.lit("\n")).alias("head"), escaped(text).alias("body"), (role == ASSISTANT).alias("speaks")
    )
    paths = branches(nodes.drop("role", "text"), keep).join(turns, ["tree", "node"])
    sizes = {name: F.char_length(name).cast("bigint") for name in ("head", "body")}
    turn = sizes["head"] + sizes["body"] + len(CLOSE)
    path = Window.partitionBy("tree", "leaf").orderBy("at")
    begin = F.sum(turn).over(path) - turn + sizes["head"]
    placed = paths.withColumn("start", begin).select(
        "tree", "leaf", "rank", "branch_score", "at",
        F.concat("head", "body", F.lit(CLOSE)).alias("turn"),
        F.when(F.col("speaks"), F.struct("start", (F.col("start") + sizes["body"]).alias("stop"))).alias("span"),
    )
    whole = placed.groupBy("tree", "leaf", "rank", "branch_score").agg(F.array_sort(F.collect_list(F.struct("at", "turn", "span"))).alias("turns"))
    return whole.select(
        "tree", "leaf", "rank", "branch_score",
        F.array_join("turns.turn", "").alias("formatted"),
        F.filter("turns.span", lambda span: span.isNotNull()).alias("loss_spans"),
    )


def parsed(formatted: Column) -> Column:
    """The turns of a formatted conversation again, as structs of role and text."""
    pieces = F.split(formatted, CLOSE, -1)
    inner = F.slice(pieces, 1, F.size(pieces) - 1)

    def turn(piece: Column) -> Column:
        role = F.substring_index(piece, "\n", 1)
        return F.struct(
            unescaped_role(F.substr(role, F.lit(len(OPEN) + 1))).alias("role"),
            unescaped(F.substr(piece, F.char_length(role) + 2)).alias("text"),
        )

    return F.transform(inner, turn)


def masked_texts(formatted: Column, spans: Column) -> Column:
    """The texts under the loss mask, as they were before they were escaped."""
    return F.transform(spans, lambda s: unescaped(F.substr(formatted, (s["start"] + 1).cast("int"), (s["stop"] - s["start"]).cast("int"))))


def conversation_nodes(conversations: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) as trees of one path: each turn answers the one before.

    Turns that share a number follow each other by role and text, null first. Rows without a
    conversation are one conversation of their own.
    """
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    node = F.row_number().over(order).cast("bigint")
    rows = conversations.select("conv_id", "role", "text", node.alias("node"))
    parent = F.when(F.col("node") > 1, F.col("node") - 1)
    # Null is a tree too, which an equality join would lose.
    return rows.select(F.struct("conv_id", F.col("conv_id").isNull().alias("none")).alias("tree"), "node", parent.alias("parent"), F.lit(0.0).alias("score"), "role", "text")
