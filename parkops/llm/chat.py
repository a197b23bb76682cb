"""Chat formatting of reply trees.

Messages point at the message they answer.  Iterative self-joins double each
message's jump to its ancestors, so depth and score of every root-to-leaf path
are known after a logarithmic number of joins; each root's paths are ranked by
score; walking the same jumps down again lists the messages of the chosen paths.
Each chosen path is written as one conversation.
"""

from __future__ import annotations

import hashlib
import re
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

#: The marks of the template, and the control strings that texts may not hold.
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
CONTROL = [OPEN, CLOSE, "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>"]
_TAILS = "|".join(re.escape(c[1:]) for c in CONTROL)
_RAW = rf"([<\[])(\\*)({_TAILS})"       # a control string, with any backslashes after its first character
_ESCAPED = rf"([<\[])\\(\\*)({_TAILS})"


def escape(text: Column) -> Column:
    """Put one more backslash behind the first character of every control string."""
    return F.regexp_replace(text, F.lit(_RAW), F.lit(r"$1\\$2$3"))


def unescape(text: str) -> str:
    return re.sub(_ESCAPED, r"\1\2\3", text)


def escape_role(role: Column) -> Column:
    """A role stands in the head line: line ends and backslashes are escaped too."""
    return escape(F.replace(F.replace(role, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


def chosen_paths(messages: DataFrame, top: int = 1) -> DataFrame:
    """Messages of each root's ``top`` best paths: ``tree, branch, depth, msg``.

    ``messages``: ``msg`` (unique long), ``parent`` (null for a root), ``score``.  A
    path scores the mean of its messages; ties go to the smaller leaf.  Messages
    whose parent is missing are roots.  Messages on a cycle reach no root and are left out."""
    up = messages.select("msg", "parent", F.coalesce("score", F.lit(0.0)).cast("double").alias("score"))
    ids = up.select(F.col("msg").alias("parent"), F.lit(True).alias("_there"))
    up = up.join(ids, "parent", "left").select(
        "msg", F.when(F.col("_there"), F.col("parent")).alias("jump"), F.col("score").alias("sum"), F.lit(1).cast("long").alias("depth"),
        F.col("msg").alias("top"))
    up = materialize(up, "replies")
    leaves = up.select("msg").join(up.select(F.col("jump").alias("msg")).where("msg IS NOT NULL").distinct(), "msg", "left_anti")
    # level k: the ancestor 2^k above (null past the root); sum, number and topmost of the messages below that one.
    # A message whose root is reached is done and takes no part in further levels
    levels, total, done = [up], up.count(), up.where("jump IS NULL")
    while 2 ** (len(levels) - 1) <= total and levels[-1].where("jump IS NOT NULL").limit(1).count():
        low = levels[-1].where("jump IS NOT NULL")
        high = low.unionByName(done).select(F.col("msg").alias("_m"), F.col("jump").alias("_jump"), F.col("sum").alias("_sum"),
                                            F.col("depth").alias("_depth"), F.col("top").alias("_top"))
        levels.append(materialize(low.join(high, low["jump"] == high["_m"]).select(
            "msg", F.col("_jump").alias("jump"), (F.col("sum") + F.col("_sum")).alias("sum"),
            (F.col("depth") + F.col("_depth")).alias("depth"), F.col("_top").alias("top")), "replies"))
        done = done.unionByName(levels[-1].where("jump IS NULL"))
    root = materialize(leaves.join(done, "msg").select(F.col("msg").alias("leaf"), F.col("top").alias("tree"),
                                                       (F.col("sum") / F.col("depth")).alias("score"), "depth"), "paths")
    # rank the leaves of a root; a root's best ones of salted groups meet in the last window
    best = [F.col("score").desc(), F.col("leaf")]
    some = root.withColumn("_r", F.row_number().over(Window.partitionBy("tree", F.pmod(F.xxhash64("leaf"), F.lit(32))).orderBy(*best)))
    ranked = some.where(F.col("_r") <= top).withColumn("branch", F.row_number().over(Window.partitionBy("tree").orderBy(*best)))
    ranked = ranked.where(F.col("branch") <= top)
    # all messages of a chosen path: each level's jump doubles what is there
    walk = materialize(ranked.select("tree", "branch", F.col("leaf").alias("msg"), "depth"), "walk")
    for k in reversed(range(len(levels) - 1)):
        hop = levels[k].where("jump IS NOT NULL").select("msg", "jump")
        more = walk.join(hop, "msg").select("tree", "branch", F.col("jump").alias("msg"), (F.col("depth") - 2 ** k).alias("depth"))
        walk = materialize(walk.unionByName(more), "walk")   # read twice by the next round
    return walk


def render(turns: DataFrame, by: list[str], order: str) -> DataFrame:
    """One row per ``by``: ``formatted`` and ``loss_spans`` (array of ``start, end``,
    code points, of assistant texts).  ``turns``: ``role``, ``text``, ``order``.

    A conversation is one row of the result, so its turns meet in one task; no
    task holds more than single conversations."""
    body = escape(F.coalesce("text", F.lit("")))
    role = F.coalesce("role", F.lit(""))
    one = F.struct(F.col(order).alias("at"), F.concat(F.lit(OPEN), escape_role(role), F.lit("\n")).alias("head"), body.alias("body"),
                   (role == "assistant").alias("learn"))
    rows = turns.groupBy(*by).agg(F.array_sort(F.collect_list(one)).alias("turns"))
    tail = CLOSE + "\n"
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("out"))

    def step(a: Column, t: Column) -> Column:
        start = a["at"] + F.length(t["head"])
        end = start + F.length(t["body"])
        span = F.array(F.struct(start.alias("start"), end.alias("end")))
        return F.struct((end + len(tail)).alias("at"), F.when(t["learn"], F.concat(a["out"], span)).otherwise(a["out"]).alias("out"))

    return rows.select(*by, F.array_join(F.transform("turns", lambda t: F.concat(t["head"], t["body"], F.lit(tail))), "").alias("formatted"),
                       F.aggregate("turns", zero, step, lambda a: a["out"]).alias("loss_spans"))


def format_conversations(df: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``conv_id, formatted, loss_spans`` of tables with one row per turn: each turn
    answers the one before it (a tree with one path).

    Turns that tie come by role and text; null turns first; null ids are one
    conversation; null role or text: empty; repeated rows are turns of their
    own; empty table: no rows; other columns are ignored, whatever their names."""
    rows = df.select(F.col(conv_id).alias("conv_id"), F.col(turn).alias("turn"), F.col(role).alias("role"), F.col(text).alias("text"))
    rows = materialize(rows.withColumn("msg", F.monotonically_increasing_id()), "turns")
    before = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text", "msg")
    replies = rows.withColumn("parent", F.lag("msg").over(before)).select("msg", "parent", F.lit(1.0).alias("score"))
    path = chosen_paths(replies).select("msg", "depth")
    return render(rows.join(path, "msg"), ["conv_id"], "depth")


def read_back(formatted: str, spans: list) -> tuple[list[tuple[str, str]], str]:
    """``(turns, learned)`` of a formatted conversation: roles and texts, and what
    stands under the loss mask, unescaped."""
    turns = []
    for part in formatted.split(OPEN)[1:]:
        head, _, rest = part.partition("\n")
        turns.append((unescape_role(head), unescape(rest[:-len(CLOSE) - 1])))
    return turns, "".join(unescape(formatted[s["start"]:s["end"]]) for s in spans)


def _digests(formatted: pd.Series, spans: pd.Series) -> pd.DataFrame:
    """What the output says when it is read back."""
    rows = []
    for text, mask in zip(formatted, spans):
        turns, learned = read_back(text, mask)
        whole = "".join(f"{role}\n{said}\n" for role, said in turns)
        rows.append((len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(learned),
                     hashlib.sha256(learned.encode()).hexdigest(), len(text)))
    return pd.DataFrame(rows, columns=["n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])


def digests(formatted: str = "formatted", spans: str = "loss_spans") -> Column:
    """Struct of what the output says when it is read back."""
    return F.pandas_udf(_digests, "n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")(
        formatted, spans)
