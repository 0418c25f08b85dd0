"""Reply trees formatted as conversations, by DataFrame operations only.

Messages (tree, id, parent, role, text, score) form trees. Ancestor links are doubled by self-joins, so that a path of n
messages takes about log2(n) joins of narrow rows; each leaf is a branch, ranked in its tree by the mean score of its
path, and the messages of the chosen branches are found by jumping along the same doubled links.

Template: each turn is ``<s>[INST]role[/INST]text</s>``. In roles and texts a backslash becomes two, and a control string
gets a backslash after its first character, so none is left whole and the change is undone exactly.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sidetrace.llm.common import prepare, text_or_empty

BEGIN, HEAD, BODY, END = "<s>", "[INST]", "[/INST]", "</s>"
CONTROLS = (BEGIN, HEAD, BODY, END)


def escape(text: Column) -> Column:
    doubled = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    return reduce(lambda t, c: F.replace(t, F.lit(c), F.lit(c[0] + "\\" + c[1:])), CONTROLS, doubled)


def unescape(text: Column) -> Column:
    return F.when(F.contains(text, F.lit("\\")), F.regexp_replace(text, r"(?s)\\(.)", "$1")).otherwise(text)


def paths(messages: DataFrame, top: int = 1) -> DataFrame:
    """Rows (tree, leaf, rank, depth, id) of the messages on the ``top`` best branches of each tree, the root at depth 0.

    A parent that is null, absent or the message itself makes a root; messages on or below a cycle have no root and are
    left out. Rows without tree or id are left out; of rows that repeat an id in a tree, the smallest by parent, role,
    text and score counts. Null scores count as 0; ties go to the smaller leaf id. No messages give no rows.
    """
    prepare(messages.sparkSession)
    nodes = messages.where("tree is not null and id is not null").groupBy("tree", "id").agg(F.min(F.struct("parent", F.coalesce("score", F.lit(0.0)).alias("score"))).alias("m")).select("tree", "id", "m.*")
    known = nodes.select("tree", F.col("id").alias("parent"), F.lit(True).alias("known"))
    nodes = nodes.join(known, ["tree", "parent"], "left").select("tree", "id", F.when(F.col("known") & (F.col("parent") != F.col("id")), F.col("parent")).alias("parent"), "score").checkpoint()
    longest = nodes.groupBy("tree").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    # up: the ancestor 2^k above; done: what lies from the message up to just below that ancestor
    level = nodes.select("tree", "id", F.col("parent").alias("up"), F.col("score").alias("total"), F.lit(1).cast("long").alias("n"))
    jumps = []
    for _ in range(max(1, (longest - 1).bit_length())):
        jumps.append(level.select("tree", "id", "up").where("up is not null"))
        if jumps[-1].isEmpty():
            break
        above = level.select("tree", F.col("id").alias("up"), F.col("up").alias("up2"), F.col("total").alias("total2"), F.col("n").alias("n2"))
        level = level.where("up is not null").join(above, ["tree", "up"]).select("tree", "id", F.col("up2").alias("up"), (F.col("total") + F.col("total2")).alias("total"), (F.col("n") + F.col("n2")).alias("n")).union(level.where("up is null")).checkpoint()
    parents = nodes.where("parent is not null").select("tree", F.col("parent").alias("id")).distinct()
    leaves = level.where("up is null").join(parents, ["tree", "id"], "left_anti")
    best = Window.partitionBy("tree").orderBy(F.desc(F.col("total") / F.col("n")), "id")
    at = leaves.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top).select("tree", F.col("id").alias("leaf"), "rank", "n", "id", F.lit(0).cast("long").alias("above"))
    for k, jump in enumerate(jumps):
        higher = at.join(jump, ["tree", "id"]).select("tree", "leaf", "rank", "n", F.col("up").alias("id"), (F.col("above") + (1 << k)).alias("above"))
        at = at.union(higher).checkpoint() if k + 1 < len(jumps) else at.union(higher)
    return at.select("tree", "leaf", "rank", (F.col("n") - 1 - F.col("above")).alias("depth"), "id")


def format_paths(messages: DataFrame, chosen: DataFrame) -> DataFrame:
    """One row for each chosen branch: tree, leaf, rank, formatted, loss (spans of the assistant texts in formatted, in code points from 0)."""
    first = messages.where("tree is not null and id is not null").groupBy("tree", "id").agg(F.min(F.struct("parent", "role", "text")).alias("m")).select("tree", "id", "m.role", "m.text")
    turns = chosen.join(first, ["tree", "id"])
    head = F.concat(F.lit(BEGIN + HEAD), escape(text_or_empty("role")), F.lit(BODY))
    body = escape(text_or_empty("text"))
    turns = turns.select("tree", "leaf", "rank", "depth", F.concat(head, body, F.lit(END)).alias("turn"), F.length(head).alias("skip"), F.length(body).alias("size"), (text_or_empty("role") == "assistant").alias("learn"))
    before = Window.partitionBy("tree", "leaf").orderBy("depth").rowsBetween(Window.unboundedPreceding, -1)
    turns = turns.withColumn("at", F.coalesce(F.sum(F.length("turn")).over(before), F.lit(0)) + F.col("skip"))
    rows = turns.groupBy("tree", "leaf", "rank").agg(F.array_sort(F.collect_list(F.struct("depth", "turn", "at", "size", "learn"))).alias("turns"))
    spans = F.transform(F.filter("turns", lambda t: t["learn"]), lambda t: F.struct(t["at"].cast("long").alias("start"), t["size"].cast("long").alias("length")))
    return rows.select("tree", "leaf", "rank", F.array_join(F.col("turns.turn"), "").alias("formatted"), spans.alias("loss"))


def format_trees(messages: DataFrame, top: int = 1) -> DataFrame:
    """The ``top`` best branches of each reply tree as conversations; see paths and format_paths."""
    return format_paths(messages, paths(messages, top))


def read_back(formatted: DataFrame) -> DataFrame:
    """Adds turns (array of role, text) and learned (the texts under the loss mask), both from the formatted string alone."""
    pieces = F.filter(F.split("formatted", re.escape(END)), lambda p: p != "")
    inner = F.transform(pieces, lambda p: F.substring(p, len(BEGIN + HEAD) + 1, 2147483647))
    turns = F.transform(inner, lambda p: F.struct(unescape(F.substring_index(p, BODY, 1)).alias("role"), unescape(F.substring(p, F.length(F.substring_index(p, BODY, 1)) + len(BODY) + 1, F.lit(2147483647))).alias("text")))
    learned = F.transform("loss", lambda s: unescape(F.substring(F.col("formatted"), s["start"].cast("int") + 1, s["length"].cast("int"))))
    return formatted.withColumn("turns", turns).withColumn("learned", learned)


def conversation_messages(conversations: DataFrame) -> DataFrame:
    """Linear conversations (conv_id, turn, role, text) as reply trees: each row answers the one before it by turn, role and text.

    The trees are named by texts, so that the rows without conv_id are a conversation of their own; see conversation_id.
    """
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    place = conversations.select("conv_id", "turn", "role", "text").withColumn("id", F.row_number().over(order).cast("long"))
    return place.select(F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit("null")).alias("tree"), "id", F.when(F.col("id") > 1, F.col("id") - 1).alias("parent"), "role", "text", F.lit(0.0).alias("score"))


def conversation_id(tree: Column) -> Column:
    """The conv_id of a tree of conversation_messages; null for that of the rows without one."""
    return F.when(F.startswith(tree, F.lit("=")), F.substring(tree, 2, 2147483647)).cast("long")


def digests(formatted: DataFrame) -> DataFrame:
    """Per conversation, read back from the formatted string: turns and their digest, the learned text's length and digest, and the length of all."""
    back = read_back(formatted)
    turns = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    learned = F.array_join("learned", "")
    return back.select(
        conversation_id(F.col("tree")).alias("conv_id"), F.size("turns").cast("long").alias("n_turns"), F.sha2(turns, 256).alias("turns_sha256"), F.length(learned).cast("long").alias("loss_chars"),
        F.sha2(learned, 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )
