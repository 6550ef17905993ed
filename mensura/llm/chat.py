"""Chat formatting of reply trees, with DataFrame operations only.

Messages point to the message they answer. Self-joins that double the distance each time sum the scores between
each leaf and its root, so a tree of depth d takes log2(d) joins; each leaf is one root-to-leaf path. Paths of a tree
are ranked by the mean score of their messages; the same joins list the messages of the chosen paths, and each is
formatted as one conversation.

Template: every turn is an opening mark, the escaped text, a closing mark. In texts a backslash becomes \\b, an
opening angle bracket \\l and an opening square bracket \\q, so no control string can appear in them
and reading back is exact.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

# The control strings of the template. Other roles are written between <| and |>.
_OPEN = {"user": "[INST] ", "system": "<<SYS>> ", "assistant": "<s> "}
_CLOSE = {"user": " [/INST]", "system": " <</SYS>>", "assistant": " </s>"}
_OTHER_CLOSE = " <|end|>"


def escaped(text: Column) -> Column:
    for plain, code in (("\\", "\\b"), ("<", "\\l"), ("[", "\\q")):
        text = F.replace(text, F.lit(plain), F.lit(code))
    return text


def unescaped(text: Column) -> Column:
    for plain, code in (("<", "\\l"), ("[", "\\q"), ("\\", "\\b")):
        text = F.replace(text, F.lit(code), F.lit(plain))
    return text


def _mark(role: Column, marks: dict[str, str], other: Column) -> Column:
    out = F.when(F.lit(False), other)
    for name, mark in marks.items():
        out = out.when(role == name, F.lit(mark))
    return out.otherwise(other)


def climb(messages: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """(tree, leaf, mean) of every leaf below a root, and the steps (tree, node, ahead) over 1, 2, 4, ... messages.

    ``messages`` has tree, node, parent, score; a node without a known parent is a root. Each round doubles how far a
    node sees and adds up the scores on the way, so leaves are judged before any path is listed. No way up is longer
    than the largest tree has messages: what has not met a root by then answers itself in a cycle, and no path holds it.
    """
    known = messages.select("tree", F.col("node").alias("parent"), F.lit(True).alias("known"))
    state = messages.select("tree", "node", "parent", "score").join(known, ["tree", "parent"], "left")
    state = stored(state.select("tree", "node", F.when(F.col("known"), F.col("parent")).alias("ahead"),
                                F.col("score").alias("total"), F.lit(1).cast("long").alias("n")), "climb")
    inner = state.select("tree", F.col("ahead").alias("node")).distinct()
    arrived, under_way, levels, reach = [state.where("ahead is null")], state.where("ahead is not null"), [], 1
    most = messages.groupBy("tree").count().agg(F.max("count")).first()[0] or 0
    while reach < most and not under_way.isEmpty():
        levels.append(under_way.select("tree", "node", "ahead"))
        above = reduce(DataFrame.unionByName, arrived, under_way).select(
            "tree", F.col("node").alias("ahead"), F.col("ahead").alias("next"), F.col("total").alias("more"), F.col("n").alias("further"))
        # Only nodes that have not met their root are joined and written again.
        moved = stored(under_way.join(above, ["tree", "ahead"]).select(
            "tree", "node", F.col("next").alias("ahead"), (F.col("total") + F.col("more")).alias("total"), (F.col("n") + F.col("further")).alias("n")), "climb")
        arrived.append(moved.where("ahead is null"))
        under_way = moved.where("ahead is not null")
        reach *= 2
    leaves = reduce(DataFrame.unionByName, arrived).join(inner, ["tree", "node"], "left_anti")
    return leaves.select("tree", F.col("node").alias("leaf"), (F.col("total") / F.col("n")).alias("mean")), levels


def leaf_paths(leaves: DataFrame, levels: list[DataFrame]) -> DataFrame:
    """``leaves`` (tree, leaf, ...) with node and above for every message on their paths, the leaf itself at above = 0.

    Ancestors at distance 1, 2, 4, ... are joined to what is already on the path.
    """
    paths, reach = leaves.withColumn("node", F.col("leaf")).withColumn("above", F.lit(0).cast("long")), 1
    for steps in levels:
        further = paths.join(steps, ["tree", "node"]).withColumn("node", F.col("ahead")).withColumn("above", F.col("above") + reach)
        paths = stored(paths.unionByName(further.select(*paths.columns)), "paths")
        reach *= 2
    return paths


def format_reply_trees(messages: DataFrame, best: int = 1) -> DataFrame:
    """(tree, path, formatted, loss) for the ``best`` paths of each tree, the best first.

    ``messages`` has tree, node (string or number), parent, role, text, score. Ties of mean scores go to the
    smaller leaf; null scores count as 0, null roles and texts are empty. Of rows that repeat a node the smallest counts
    (by parent, role, text, score); rows without tree or node, and messages that answer themselves, directly or over
    others, are on no path. loss holds the (start, length) places of assistant texts in ``formatted``, counted in
    characters from 0.
    """
    said = F.struct("parent", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"),
                    F.coalesce("score", F.lit(0.0)).cast("double").alias("score"))
    messages = messages.where("tree is not null and node is not null").groupBy("tree", "node").agg(F.min(said).alias("m"))
    messages = stored(messages.select("tree", "node", "m.*"), "messages")
    leaves, levels = climb(messages)
    # The best few of each tree are kept while aggregating, so a tree of any size is no window.
    ranked = leaves.groupBy("tree").agg(F.min_by("leaf", F.struct(-F.col("mean"), "leaf")).alias("leaf")).withColumn(
        "path", F.lit(1)) if best == 1 else _ranked(leaves, best)
    turns = leaf_paths(stored(ranked, "chosen"), levels).join(messages.select("tree", "node", "role", "text"), ["tree", "node"])
    turns = turns.groupBy("tree", "path").agg(F.sort_array(F.collect_list(F.struct((-F.col("above")).alias("place"), "role", "text"))).alias("turns"))
    return turns.select("tree", "path", *_formatted(F.col("turns")))


def _ranked(leaves: DataFrame, best: int) -> DataFrame:
    from pyspark.sql import Window

    order = Window.partitionBy("tree").orderBy(F.desc("mean"), "leaf")
    return leaves.withColumn("path", F.row_number().over(order)).where(F.col("path") <= best).select("tree", "leaf", "path")


def _formatted(turns: Column) -> tuple[Column, Column]:
    other = lambda role: F.concat(F.lit("<|"), F.replace(escaped(role), F.lit("|"), F.lit("\\p")), F.lit("|> "))
    start = lambda t: _mark(t["role"], _OPEN, other(t["role"]))
    close = lambda t: _mark(t["role"], _CLOSE, F.lit(_OTHER_CLOSE))
    pieces = F.transform(turns, lambda t: F.concat(start(t), escaped(t["text"]), close(t)))
    begin = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("loss"))

    def add(state, t):
        head, body = F.length(start(t)), F.length(escaped(t["text"]))
        span = F.array(F.struct((state["at"] + head).alias("start"), body.alias("length")))
        return F.struct((state["at"] + head + body + F.length(close(t))).alias("at"),
                        F.when(t["role"] == "assistant", F.concat(state["loss"], span)).otherwise(state["loss"]).alias("loss"))

    return F.array_join(pieces, "").alias("formatted"), F.aggregate(turns, begin, add, lambda s: s["loss"]).alias("loss")


def read_back(formatted: Column) -> Column:
    """The (role, text) turns of a formatted conversation."""
    # A closing mark ends a turn: the text before it holds no bracket that is not escaped.
    ends = r"(?<= \[/INST\])|(?<= </s>)|(?<= <</SYS>>)|(?<= <\|end\|>)"
    turns = F.filter(F.split(formatted, ends), lambda t: t != "")

    def turn(t: Column) -> Column:
        role = F.when(F.lit(False), F.lit(""))
        body = F.when(F.lit(False), F.lit(""))
        for name, mark in _OPEN.items():
            role = role.when(F.startswith(t, F.lit(mark)), F.lit(name))
            body = body.when(F.startswith(t, F.lit(mark)), F.substr(t, F.lit(len(mark) + 1), F.length(t) - len(mark) - len(_CLOSE[name])))
        own = F.substring_index(F.substr(t, F.lit(3)), "|", 1)
        role = role.otherwise(unescaped(F.replace(own, F.lit("\\p"), F.lit("|"))))
        head = F.length(own) + 5
        body = body.otherwise(F.substr(t, head + 1, F.length(t) - head - len(_OTHER_CLOSE)))
        return F.struct(role.alias("role"), unescaped(body).alias("text"))

    return F.transform(turns, turn)


def loss_text(formatted: Column, loss: Column) -> Column:
    """All text under the loss mask, unescaped, nothing between."""
    return F.array_join(F.transform(loss, lambda s: unescaped(F.substr(formatted, s["start"] + 1, s["length"]))), "")


def conversations_as_trees(conversations: DataFrame) -> DataFrame:
    """Messages of linear conversations (conv_id, turn, role, text): each turn answers the one before.

    Turns that tie are ordered by role and text; a null conv_id is a conversation of its own. Other columns
    are ignored.
    """
    from pyspark.sql import Window

    order = Window.partitionBy("tree").orderBy("turn", "role", "text")
    rows = conversations.select(F.coalesce(F.col("conv_id").cast("string"), F.lit("")).alias("tree"), "turn", "role", "text")
    rows = rows.withColumn("node", F.row_number().over(order).cast("long"))
    parent = F.when(F.col("node") > 1, F.col("node") - 1)
    return rows.select("tree", "node", parent.alias("parent"), "role", "text", F.lit(0.0).alias("score"))


def chat_digests(conversations: DataFrame, best: int = 1) -> DataFrame:
    """What the formatted conversations say when they are read back, one row per chosen path.

    (conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, formatted). No rows, no rows.
    """
    out = format_reply_trees(conversations_as_trees(conversations), best)
    turns, loss = read_back(F.col("formatted")), loss_text(F.col("formatted"), F.col("loss"))
    out = out.withColumn("turns", turns).withColumn("masked", loss)
    line = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return out.select(
        F.when(F.col("tree") != "", F.col("tree")).cast("long").alias("conv_id"), F.size("turns").cast("long").alias("n_turns"),
        F.sha2(line.cast("binary"), 256).alias("turns_sha256"), F.length("masked").cast("long").alias("loss_chars"),
        F.sha2(F.col("masked").cast("binary"), 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"), "formatted")
