"""Collapse cumulative snapshots of logged conversations, then render what is left.

A chat service that logs the whole history with every request leaves each conversation many
times, as ever longer prefixes. A rolling hash names every turn prefix; a conversation whose
whole hash is a proper prefix of another goes by an anti-join, and of conversations equal in
content the smallest id stays. Only hashes are compared, so text is shuffled once to bring a
conversation's turns together.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from tidemark.llm.common import stored

CHATML = ("<|im_start|>", "\n", "<|im_end|>\n")


def gather_turns(rows: DataFrame) -> DataFrame:
    """One row per conversation: key, conv_id and its turns in order.

    Turns are ordered by turn, role and text, null turns first; rows repeated exactly count once. A row
    without conv_id cannot be tied to others and is a conversation of one turn. A null role or text
    is an empty one, as both are rendered alike. A conversation is
    one output record and is held by one task, like any other record.
    """
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    own = F.sha2(F.to_json(turn), 256)
    key = F.coalesce(F.concat(F.lit("c"), F.col("conv_id").cast("string")), F.concat(F.lit("n"), own))
    return (rows.select(key.alias("key"), "conv_id", turn.alias("t"))
            .groupBy("key").agg(F.first("conv_id").alias("conv_id"), F.sort_array(F.collect_set("t")).alias("turns")))


def prefix_hashes(conversations: DataFrame) -> DataFrame:
    """(key, conv_id, n, length, a, b): 128 bits naming the first ``length`` of ``n`` turns."""

    def mark(t, i, salt):
        return F.xxhash64(F.lit(salt), i, t["role"], t["text"])

    marks = F.transform("turns", lambda t, i: F.struct(mark(t, i, 1).alias("a"), mark(t, i, 2).alias("b")))
    turns = conversations.select("key", "conv_id", F.size("turns").alias("n"), F.posexplode(marks).alias("pos", "m"))
    # Each mark holds its place, so the exclusive or of the first marks names the sequence.
    rolling = W.partitionBy("key").orderBy("pos").rowsBetween(W.unboundedPreceding, W.currentRow)
    return turns.select("key", "conv_id", "n", (F.col("pos") + 1).alias("length"),
                        F.bit_xor("m.a").over(rolling).alias("a"), F.bit_xor("m.b").over(rolling).alias("b"))


def maximal_conversations(conversations: DataFrame) -> DataFrame:
    """(key, n_copies) of conversations that no longer one starts with, one for each content."""
    prefixes = prefix_hashes(conversations)
    whole = (prefixes.filter(F.col("length") == F.col("n")).groupBy("a", "b", "length")
             .agg(F.min(F.struct(F.col("conv_id").isNull().alias("x"), "conv_id", "key")).alias("first"), F.count(F.lit(1)).alias("n_copies")))
    # Distinct first: a greeting that opens a third of all conversations is one row.
    shorter = prefixes.filter(F.col("length") < F.col("n")).select("a", "b", "length").distinct()
    return whole.join(shorter, ["a", "b", "length"], "left_anti").select("first.key", "n_copies")


def render(turns, marks=CHATML):
    """A column of turns as one ChatML string; a null role or text is empty."""
    start, middle, end = (F.lit(m) for m in marks)
    lines = F.transform(turns, lambda t: F.concat(start, F.coalesce(t["role"], F.lit("")), middle, F.coalesce(t["text"], F.lit("")), end))
    return F.array_join(lines, "")


def format_chats(spark: SparkSession, rows: DataFrame) -> DataFrame:
    """Maximal conversations as text: conv_id, n_turns, n_copies (conversations of that very content), text."""
    conversations = stored(spark, gather_turns(rows), "turns")
    kept = maximal_conversations(conversations)
    return (conversations.join(kept, "key")
            .select("conv_id", F.size("turns").alias("n_turns"), "n_copies", render(F.col("turns")).alias("text")))
