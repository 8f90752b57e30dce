"""Chat logs: snapshots of growing conversations collapse to the longest, which are
rendered with a chat template. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Text around a turn's role and words.
OPEN, MIDDLE, CLOSE = "<|im_start|>", "\n", "<|im_end|>\n"


def prefixes(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """A row for each turn with the rolling hash of the conversation up to it: conv_id,
    position (from 1), h1, h2, last. Turns are taken by turn, then role and text (nulls
    first). Each turn is hashed with its position by two seeds, and the exclusive or of
    the hashes so far is the prefix's, 128 bits in all."""
    t = turns.select(F.col(conv_id).alias("conv_id"), F.col(turn).alias("turn"), F.col(role).cast("string").alias("role"), F.col(text).cast("string").alias("text"))
    own = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    content = [F.col("role").isNull(), F.coalesce("role", F.lit("")), F.col("text").isNull(), F.coalesce("text", F.lit(""))]
    t = t.withColumns({"position": F.row_number().over(own), "last": F.lead(F.lit(1)).over(own).isNull()})
    for k in (1, 2):
        t = t.withColumn(f"h{k}", F.xxhash64(F.lit(k), "position", *content))
    so_far = own.rowsBetween(Window.unboundedPreceding, 0)
    return t.select("conv_id", "position", "last", *[F.bit_xor(f"h{k}").over(so_far).alias(f"h{k}") for k in (1, 2)])


def collapse(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Conversations that are a prefix of no longer one: conv_id, n_turns, n_logs. Of equal
    ones the least conv_id stays (a null id only if all are) and n_logs counts them.
    Prefixes are made distinct before the anti-join, combined before each shuffle, so a
    first turn or a conversation that fills the log is a few rows there."""
    p = prefixes(turns, conv_id, turn, role, text)
    whole = p.where("last").groupBy("position", "h1", "h2").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_logs"))
    inner = p.where("not last").select("position", "h1", "h2").distinct()
    return whole.join(inner, ["position", "h1", "h2"], "left_anti").select("conv_id", F.col("position").cast("long").alias("n_turns"), "n_logs")


def render(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Maximal conversations as text: conv_id, n_turns, n_logs, text.

    Each turn is rendered between the marks of the template, a null role or text as
    empty. Rows with a null conv_id are one conversation. Repeated rows are turns of their
    own, as are rows with the same or a null turn; ties are ordered by role and text. An
    empty table gives no rows; other columns are not read. A conversation is one row of
    the result, so its own turns must fit one; no other group is gathered.
    """
    kept = collapse(turns, conv_id, turn, role, text)
    t = turns.select(F.col(conv_id).alias("_id"), F.struct(F.col(turn).alias("turn"), F.col(role).cast("string").alias("role"), F.col(text).cast("string").alias("text")).alias("_turn"))
    joined = t.join(kept, F.col("_id").eqNullSafe(F.col("conv_id")))
    show = lambda x: F.concat(F.lit(OPEN), F.coalesce(x["role"], F.lit("")), F.lit(MIDDLE), F.coalesce(x["text"], F.lit("")), F.lit(CLOSE))
    turns_ = F.sort_array(F.collect_list("_turn"))
    return joined.groupBy("conv_id", "n_turns", "n_logs").agg(F.array_join(F.transform(turns_, show), "").alias("text"))
