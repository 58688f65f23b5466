"""Conversations from reply trees: paths from root to leaf by repeated self-joins, branches ranked by score, paths formatted as chats. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skyhue.llm.tables import staged

#: Control strings that begin and end a turn of each role; other roles stand inside their turn, before NAMED.
MARKS = {"system": ("<<SYS>>", "<</SYS>>"), "user": ("[INST]", "[/INST]"), "assistant": ("<s>", "</s>")}
OTHER, NAMED = ("[ROLE]", "[/ROLE]"), "[AS]"
#: A control string with any number of backslashes behind its first character. A text's have one or more, the template's none.
CONTROL = r"([<\[])(\\*)(/?s>|</?SYS>>|/?INST\]|/?ROLE\]|AS\])"
SALTS = 16


def escaped(text: Column) -> Column:
    """The text with one backslash more in each of its control strings."""
    return F.regexp_replace(text, CONTROL, r"$1\\$2$3")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, CONTROL.replace(r"(\\*)", r"\\(\\*)"), "$1$2$3")


def chains(rows: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Conversations that are lists of turns as messages (conversation, id, parent, role, text), each one a reply to the turn before.

    Turns that share a number follow by role and text, nulls first; null conversations are one. Rows are put in order by ranges of the whole key, so that
    a conversation of any length is dealt out; ids count up in that order.
    """
    plain = rows.select(F.col(conversation).alias("conversation"), F.col(turn).alias("turn"), F.col(role).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    key = [F.col(c).asc_nulls_first() for c in plain.columns]
    placed = staged(plain.repartitionByRange(*key).sortWithinPartitions(*key).withColumn("id", F.monotonically_increasing_id()))
    ends = placed.groupBy(F.shiftright("id", 33).alias("part")).agg(F.min("id").alias("id"), F.max("id").alias("last"))
    ends = ends.select("id", F.lag("last").over(Window.orderBy("id")).alias("before"), F.lit(True).alias("first"))  # a row for each task
    heads = placed.groupBy("conversation").agg(F.min("id").alias("id")).select("id", F.lit(True).alias("head"))
    linked = placed.join(ends, "id", "left").join(heads, "id", "left")
    parent = F.when(F.col("head").isNull(), F.when(F.col("first"), F.col("before")).otherwise(F.col("id") - 1))
    return linked.select("conversation", "id", parent.alias("parent"), "role", "text")


def paths(messages: DataFrame, branches: int | None = 1, id: str = "id", parent: str = "parent", role: str = "role", text: str = "text", score: Column | None = None, name: str | None = None) -> DataFrame:
    """The chosen root-to-leaf paths of reply trees, a row for each of their messages: tree, branch (from 1), leaf, place (from 0), message, name, role, text.

    Each round of self-joins doubles how far a message that hasn't met its root sees towards it, and adds up the scores on the way: after log2(depth) rounds each
    knows its root, depth and the sum. A tree's leaves are ranked by mean score along their path (ties: deeper first, then the smaller message number), and the best
    `branches` of them chosen, all if None (branch is null then). Chosen paths are unfolded by the same links, longest first, so that no more rows are made than paths have messages.

    score: of a message, 0 if not given or null. name: a column of messages to carry along, null if not given. `message` and `leaf` are numbers given to rows here; `tree` is the root's. A message without
    a parent, or whose parent isn't in the table, is a root. Of rows that repeat an id, the first (by role, text, score) is the one replied to, and
    the others are leaves; so are rows without an id. Messages that reply to each other in a circle, and replies to those, have no root and give no rows. Null texts are empty;
    no messages give no paths. Further columns aren't read, so their names can't clash.
    """
    value = F.coalesce((F.lit(0.0) if score is None else score).cast("double"), F.lit(0.0))
    plain = messages.select(F.col(id).alias("id"), F.col(parent).alias("parent"), F.col(role).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"), value.alias("score"), (F.col(name) if name else F.lit(None).cast("string")).alias("name"))
    rows = staged(plain.withColumn("message", F.monotonically_increasing_id()))
    told = F.min(F.struct("role", "text", "score", "message"))["message"]
    first = rows.where("id IS NOT NULL").groupBy("id").agg(told.alias("up"))
    told_parent = rows.select("message", "parent", "score").where("parent IS NOT NULL").join(first.withColumnRenamed("id", "parent"), "parent", "left").drop("parent")
    links = told_parent.unionByName(rows.where("parent IS NULL").select("message", F.lit(None).cast("long").alias("up"), "score"))
    root = F.when(F.col("up").isNull(), F.col("message")).alias("tree")
    seen = [staged(links.select("message", "up", F.lit(1).cast("long").alias("steps"), "score", root))]
    count, reach = rows.count(), 1
    # seen[k]: the message 2^k steps up, or null and the tree where the root is nearer; steps and score: of the messages from here to before that one
    while reach <= count and not seen[-1].where("up IS NOT NULL").isEmpty():
        far = seen[-1].select(F.col("message").alias("up"), F.col("up").alias("next"), F.col("steps").alias("more_steps"), F.col("score").alias("more"), F.col("tree").alias("found"))
        on = seen[-1].where("up IS NOT NULL").drop("tree").join(far, "up")
        on = on.select("message", F.col("next").alias("up"), (F.col("steps") + F.col("more_steps")).alias("steps"), (F.col("score") + F.col("more")).alias("score"), F.col("found").alias("tree"))
        seen.append(staged(seen[-1].where("up IS NULL").unionByName(on)))
        reach *= 2
    chosen = _chosen(links, seen[-1], branches)
    return _unfolded(chosen, seen).join(rows.select("message", "name", "role", "text"), "message").select("tree", "branch", "leaf", "place", "message", "name", "role", "text")


def _chosen(links: DataFrame, whole: DataFrame, branches: int | None) -> DataFrame:
    answered = links.where("up IS NOT NULL").select(F.col("up").alias("message")).distinct()
    leaves = whole.where("up IS NULL").select("tree", "message", "steps", (F.col("score") / F.col("steps")).alias("mean")).join(answered, "message", "left_anti")
    if branches is None:
        return staged(leaves.select("tree", F.lit(None).cast("int").alias("branch"), F.col("message").alias("leaf"), "steps"))
    order = (F.col("mean").desc(), F.col("steps").desc(), "message")
    best = leaves.withColumn("salt", F.pmod(F.xxhash64("message"), F.lit(SALTS)))
    best = best.withColumn("branch", F.row_number().over(Window.partitionBy("tree", "salt").orderBy(*order))).where(F.col("branch") <= branches)
    best = best.withColumn("branch", F.row_number().over(Window.partitionBy("tree").orderBy(*order))).where(F.col("branch") <= branches)
    return staged(best.select("tree", "branch", F.col("message").alias("leaf"), "steps"))


def _unfolded(chosen: DataFrame, seen: list[DataFrame]) -> DataFrame:
    """A row for each message of the chosen paths. A row stands for the `size` messages from `message` up; one of more than 2^k is cut where that link leads."""
    at = chosen.select("tree", "branch", "leaf", F.col("leaf").alias("message"), (F.col("steps") - 1).alias("place"), F.col("steps").alias("size"))
    for k in range(len(seen) - 2, -1, -1):
        far = 2**k
        long = at.where(F.col("size") > far).join(seen[k].select("message", "up"), "message")
        lower = F.struct("message", "place", F.lit(far).cast("long").alias("size"))
        upper = F.struct(F.col("up").alias("message"), (F.col("place") - far).alias("place"), (F.col("size") - far).alias("size"))
        cut = long.select("tree", "branch", "leaf", F.explode(F.array(lower, upper)).alias("x")).select("tree", "branch", "leaf", "x.*")
        at = staged(at.where(F.col("size") <= far).unionByName(cut))
    return at.drop("size")


def turn(role: Column, text: Column) -> Column:
    """A turn in three parts: what begins it, its escaped text, what ends it."""
    begin, end = F.concat(F.lit(OTHER[0] + " "), escaped(F.coalesce(role, F.lit(""))), F.lit(f" {NAMED} ")), F.lit(f" {OTHER[1]}")
    for name, (a, b) in MARKS.items():
        begin, end = F.when(role == name, F.lit(a + " ")).otherwise(begin), F.when(role == name, F.lit(" " + b)).otherwise(end)
    return F.struct(begin.alias("begin"), escaped(text).alias("text"), end.alias("end"))


def formatted(paths: DataFrame, learn: str = "assistant") -> DataFrame:
    """tree, branch, leaf, name (the root's), n_turns, segments (text, loss): rows of `paths` as one conversation for each path, in order of place.

    A conversation is the segments' texts, one behind the other; those with loss are what is learnt from: the texts of the role `learn`, without marks.
    Control strings inside texts and role names are escaped, so the marks of turns are the template's alone. A path is one row by its nature.
    """
    t = turn(F.col("role"), F.col("text"))
    cells = F.struct("place", "name", t.alias("t"), F.coalesce(F.col("role") == learn, F.lit(False)).alias("loss"))
    whole = paths.groupBy("tree", "branch", "leaf").agg(F.sort_array(F.collect_list(cells)).alias("cells"))
    one = lambda text, loss: F.struct(text.alias("text"), loss.alias("loss"))
    parts = F.flatten(F.transform("cells", lambda c: F.array(one(c["t"]["begin"], F.lit(False)), one(c["t"]["text"], c["loss"]), one(c["t"]["end"], F.lit(False)))))
    return whole.select("tree", "branch", "leaf", F.get("cells", F.lit(0))["name"].alias("name"), F.size("cells").cast("long").alias("n_turns"), parts.alias("segments"))


def whole_text(segments: Column) -> Column:
    return F.array_join(F.transform(segments, lambda s: s["text"]), "")


def learnt(segments: Column) -> Column:
    """The texts under the loss mask, unescaped."""
    return F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescaped(s["text"]))


def turns(text: Column) -> Column:
    """The turns (role, text) of a formatted conversation, told by its marks alone."""
    ends = [b for _, b in MARKS.values()] + [OTHER[1]]
    quoted = "|".join(x.replace("[", r"\[").replace("]", r"\]") for x in ends)

    def one(piece: Column) -> Column:
        inner = lambda a, b: F.substring(piece, F.lit(len(a) + 2), F.length(piece) - len(a) - len(b) - 2)
        body = inner(*OTHER)
        role, said = F.substring_index(body, f" {NAMED} ", 1), F.substring(body, F.length(F.substring_index(body, f" {NAMED} ", 1)) + len(NAMED) + 3, F.length(body))
        found = F.struct(unescaped(role).alias("role"), unescaped(said).alias("text"))
        for name, (a, b) in MARKS.items():
            found = F.when(F.startswith(piece, F.lit(a + " ")), F.struct(F.lit(name).alias("role"), unescaped(inner(a, b)).alias("text"))).otherwise(found)
        return found

    return F.transform(F.filter(F.split(text, rf"(?<=[>\]])(?<={quoted})"), lambda x: x != ""), one)
