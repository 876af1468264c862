"""Logged conversations collapsed to the longest ones and rendered for training.

A log holds a conversation again after every turn. Each turn is hashed with its place; running
sums of these hashes identify every prefix of every conversation. A conversation whose whole
hash is a prefix of a longer one is dropped by an anti-join, of equal ones the first is kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varloom.llm.common import running_sum
from varloom.plans.scale import cut_lineage

OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"


def prefixes(df: DataFrame, *, conversation: str, turn: str, role: str, text: str) -> DataFrame:
    """(c, place, role, text, h1, h2): turns in order with the hashes of their prefixes.

    Turns are ordered by number, role and text, a NULL number first; rows that repeat another
    one count once. A NULL conversation is a conversation; NULL roles and texts are empty.
    """
    empty = F.lit("")
    turns = df.select(
        F.col(conversation).alias("c"),
        F.col(turn).alias("t"),
        F.coalesce(F.col(role).cast("string"), empty).alias("role"),
        F.coalesce(F.col(text).cast("string"), empty).alias("text"),
    ).distinct()
    turns = turns.withColumn("one", F.lit(1))
    order = ["t", "role", "text"]
    turns = running_sum(turns, order, {"place": "one"}, ["c"])
    for k in (1, 2):  # sums of 64-bit numbers, so decimals that cannot overflow
        own = F.xxhash64(F.lit(k), "place", "role", "text").cast("decimal(20,0)")
        turns = turns.withColumn(f"x{k}", own)
    turns = running_sum(turns, ["place"], {"h1": "x1", "h2": "x2"}, ["c"])
    return turns.select("c", "place", "role", "text", "h1", "h2")


def render(
    df: DataFrame,
    *,
    conversation: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
) -> DataFrame:
    """(conversation, n_turns, rendered): one row for each maximal conversation.

    A conversation is left out if its turns (role and text, in order) begin a longer one, or
    equal those of one with a smaller id, NULL being the smallest. Each turn is written as
    <|im_start|>role, a line break, its text, and <|im_end|>; texts are not changed. Odd rows
    are treated as ``prefixes`` says; other columns are not read; an empty table gives no rows.
    """
    turns = cut_lineage(
        prefixes(df, conversation=conversation, turn=turn, role=role, text=text)
    )
    whole = turns.groupBy("c").agg(F.max(F.struct("place", "h1", "h2")).alias("e"))
    whole = cut_lineage(whole.select("c", "e.*"))
    equal = whole.groupBy("place", "h1", "h2").agg(F.min(F.struct("c")).alias("first"))
    lengths = whole.select(F.col("c").alias("c2"), F.col("place").alias("n"))
    inner = turns.join(lengths, F.col("c").eqNullSafe(F.col("c2"))).where("place < n")
    inner = inner.select("place", "h1", "h2").distinct()
    kept = equal.join(inner, ["place", "h1", "h2"], "left_anti")
    kept = cut_lineage(kept.select(F.col("first.c").alias("c2"), F.col("place").alias("n")))
    said = F.concat(F.lit(OPEN), "role", F.lit("\n"), "text", F.lit(CLOSE))
    own = turns.join(kept, F.col("c").eqNullSafe(F.col("c2")))
    own = own.groupBy("c", "n").agg(
        F.sort_array(F.collect_list(F.struct("place", said.alias("said")))).alias("all")
    )
    return own.select(
        F.col("c").alias(conversation),
        F.col("n").cast("long").alias("n_turns"),
        F.array_join(F.col("all.said"), "").alias("rendered"),
    )
