"""The prefix trie of conversations, by partition refinement.

All conversations begin in one class, the root. Turn after turn each class splits by the
next turn; a class is a node, named by 128 bits rolled over its turns. A class that has
become a single conversation is retired: its other turns are a chain of nodes of which
all is known, and they are never grouped again. Rounds take 4, 4, 8, 16 ... turns, so a
log of long growing snapshots takes a handful, and turns grouped after their class was
single are at most as many as those before.

Folding back needs no walk over levels. Each node has one representative, its least
member, and stands once on that member's path; a path summed from its end gives what lies
below each of its nodes on it alone, and the members of a node together have its subtree.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumigrid.llm.shared import table

#: Turns of the first round.
STRIDE = 4
KEY = ["depth", "h1", "h2"]


@dataclass
class Trie:
    """nodes: conv_id (least member), depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens, n_ends, h1, h2 (its name with depth), turn_conv_id, turn_position (where
    its last turn was taken from). ends: conv_id, depth, h1, h2 of each conversation's
    last node."""

    nodes: DataFrame
    ends: DataFrame


def numbered(rows: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Turns with their position in a conversation, from 1: conv_id, position, role, text.
    Ordered by turn (null first), then role and text; a null role or text is empty. Rows
    without a conv_id belong to no conversation and are left out. Repeated rows are turns
    of their own; other columns are not read."""
    own = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    whole = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(to) for c, to in ((role, "role"), (text, "text"))]
    t = rows.select(F.col(f"`{conv_id}`").alias("conv_id"), F.col(f"`{turn}`").alias("turn"), *whole).where("conv_id is not null")
    return t.select("conv_id", F.row_number().over(own).alias("position"), "role", "text")


def marked(turns: DataFrame) -> DataFrame:
    """Turns by 128 bits of role and text, and the text's UTF-8 bytes: conv_id, position,
    t1, t2, bytes, turn_conv_id, turn_position."""
    bits = [F.xxhash64(F.lit(k), "role", "text").alias(f"t{k}") for k in (1, 2)]
    place = [F.col("conv_id").alias("turn_conv_id"), F.col("position").alias("turn_position")]
    return turns.select("conv_id", "position", *bits, F.octet_length("text").cast("long").alias("bytes"), *place)


def spliced(turns: DataFrame, heads: DataFrame) -> DataFrame:
    """Conversations rebuilt of marked turns: for each row of `heads` (conv_id, base, h; a
    row for a conversation) the first h turns of `base`, then the own turns after h."""
    size = turns.groupBy(F.col("conv_id").alias("base")).agg(F.count("*").alias("n"))
    h = heads.join(size, "base", "left").withColumn("taken", F.least("h", F.coalesce("n", F.lit(0))))
    first = turns.withColumnRenamed("conv_id", "base").join(h, "base").where("position <= h")
    rest = turns.join(h, "conv_id").where("position > h").withColumn("position", F.col("taken") + F.col("position") - F.col("h"))
    return first.select(turns.columns).unionByName(rest.select(turns.columns))


def build(turns: DataFrame, conversations: DataFrame | None = None, stride: int = STRIDE) -> Trie:
    """The trie of marked turns, whose positions go from 1 without a gap.
    `conversations` (conv_id, distinct) names all conversations where some have no turn.

    Equal conversations end in one node; no conversation at all has no node. Everything is
    counted by class with partial sums, so a first turn, or copies of one conversation,
    that fill the log are a row a task; nodes with over a thousand children (and over a
    hundred thousandth of all nodes, so at most 100,000) are sent to their children, and
    others joined. A conversation's own turns are one window. Tables of hashes, never of
    texts, are written for each round.
    """
    ids = turns.select("conv_id").distinct() if conversations is None else conversations
    own = Window.partitionBy("conv_id")
    so_far = own.orderBy("position").rowsBetween(Window.unboundedPreceding, 0)
    names = [F.xxhash64(F.lit(k), "position", "t1", "t2").alias(f"x{k}") for k in (1, 2)]
    t = turns.select("*", *names)
    t = t.withColumns({"h1": F.bit_xor("x1").over(so_far), "h2": F.bit_xor("x2").over(so_far), "n": F.count("*").over(own)})
    shown = ["conv_id", "depth", "h1", "h2", "p1", "p2", "bytes", "n", "turn_conv_id", "turn_position"]
    t = t.withColumns({"depth": F.col("position").cast("long"), "p1": F.col("h1").bitwiseXOR(F.col("x1")), "p2": F.col("h2").bitwiseXOR(F.col("x2"))}).select(shown)
    size = turns.groupBy("conv_id").agg(F.count("*").alias("n"))
    nothing = {c: F.lit(None).cast(t.schema[c].dataType) for c in ("p1", "p2", "turn_conv_id", "turn_position")}
    root = ids.join(size, "conv_id", "left").withColumns({"n": F.coalesce("n", F.lit(0)), **{c: F.lit(0).cast("long") for c in ("depth", "h1", "h2", "bytes")}, **nothing})
    paths = table(t.unionByName(root.select(shown)), "paths")

    rounds, gone = [], paths.select("conv_id", F.col("depth").alias("at")).where("false")
    low, high = 0, stride
    while True:
        active = paths.where(F.col("depth").between(low, high)).join(gone, "conv_id", "left_anti")
        of_it = {c: F.min_by(c, "conv_id").alias(c) for c in ("p1", "p2", "bytes", "turn_conv_id", "turn_position")}
        split = active.groupBy(KEY).agg(F.count("*").alias("n_convs"), F.min("conv_id").alias("conv_id"), F.count_if(F.col("depth") == F.col("n")).alias("n_ends"), *of_it.values())
        classes = table(split, "classes")
        rounds.append(classes)
        last = classes.where((F.col("depth") == high) & (F.col("n_ends") < F.col("n_convs")))
        gone = gone.unionByName(last.where("n_convs = 1").select("conv_id", F.lit(high).cast("long").alias("at")))
        if last.where("n_convs > 1").isEmpty():
            break
        low, high = high + 1, high * 2
    classes = reduce(DataFrame.unionByName, rounds)

    # fold back: what each node adds, on its representative's path, from the end of it
    step = classes.select("conv_id", "depth", ((F.col("n_convs") - 1) * F.col("bytes")).alias("saves"), (F.col("n_ends") == F.col("n_convs")).cast("long").alias("leaf"))
    walked = paths.select("conv_id", *KEY).join(gone, "conv_id", "left").where("at is null or depth <= at").join(step, ["conv_id", "depth"], "left")
    below = own.orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, 0)
    tail = F.coalesce((F.col("depth") == F.col("at")).cast("long"), F.lit(0))  # a chain follows, and has a leaf
    folded = walked.select(*KEY, F.sum(F.coalesce("leaf", F.lit(0)) + tail).over(below).alias("n_leaves"), F.sum(F.coalesce("saves", F.lit(0))).over(below).alias("saved_tokens"))
    children = classes.where("depth > 0").select((F.col("depth") - 1).alias("depth"), F.col("p1").alias("h1"), F.col("p2").alias("h2"), F.lit(1).alias("children"))
    parts = classes.unionByName(folded, allowMissingColumns=True).unionByName(children, allowMissingColumns=True)
    one = [F.max(c).alias(c) for c in ("conv_id", "n_convs", "n_ends", "p1", "p2", "turn_conv_id", "turn_position")]
    all_of = [F.sum(c).alias(c) for c in ("n_leaves", "saved_tokens", "children")]
    n_children = F.when(F.col("n_convs") == 1, 1 - F.col("n_ends")).otherwise(F.coalesce("children", F.lit(0)))
    shared = table(parts.groupBy(KEY).agg(*one, *all_of).withColumn("n_children", n_children).drop("children"), "nodes")

    up = shared.select((F.col("depth") + 1).alias("depth"), F.col("h1").alias("p1"), F.col("h2").alias("p2"), F.col("conv_id").alias("parent_conv_id"), "n_children")
    many = F.col("n_children") > max(1000, shared.count() // 100_000)
    of = ["depth", "p1", "p2"]
    hot = F.broadcast(up.where(many).drop("n_children"))
    placed = shared.join(hot, of).unionByName(shared.join(hot, of, "left_anti").join(up.where(~many).drop("n_children"), of, "left"))
    chain = paths.join(gone, "conv_id").where("depth > at")
    chained = chain.select(
        *KEY, "conv_id", F.col("conv_id").alias("parent_conv_id"), F.lit(1).cast("long").alias("n_convs"), (F.col("depth") < F.col("n")).cast("long").alias("n_children"),
        F.lit(1).cast("long").alias("n_leaves"), F.lit(0).cast("long").alias("saved_tokens"), (F.col("depth") == F.col("n")).cast("long").alias("n_ends"), "turn_conv_id", "turn_position",
    )
    out = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "n_ends", "h1", "h2", "turn_conv_id", "turn_position"]
    return Trie(placed.select(out).unionByName(chained.select(out)), paths.where("depth = n").select("conv_id", *KEY))


def with_turns(nodes: DataFrame, turns: DataFrame) -> DataFrame:
    """Nodes with the role and text of their last turn (null for the root), from numbered turns."""
    said = turns.select(F.col("conv_id").alias("turn_conv_id"), F.col("position").alias("turn_position"), "role", "text")
    return nodes.join(said, ["turn_conv_id", "turn_position"], "left")


def digests(ends: DataFrame) -> DataFrame:
    """For each node where conversations end, the SHA-256 of their conv_ids in ascending
    order, comma-joined: depth, h1, h2, ends_sha256. A digest is sequential, so ids of a
    node are streamed in order through one task: eight bytes each, none held."""
    rows = ends.select(*KEY, "conv_id").repartition(*KEY).sortWithinPartitions(*KEY, "conv_id")

    def run(batches):
        now, sha = None, None

        def out():
            values = [*[[k] for k in now], [sha.hexdigest()]]
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, (pa.int64(), pa.int64(), pa.int64(), pa.string()))], names=[*KEY, "ends_sha256"])

        for batch in batches:
            d, a, b, ids = (batch.column(k).to_numpy() for k in range(4))
            edges = np.flatnonzero((d[1:] != d[:-1]) | (a[1:] != a[:-1]) | (b[1:] != b[:-1])) + 1
            for low, high in zip([0, *edges.tolist()], [*edges.tolist(), len(d)]):
                if high == low:
                    continue
                key, joined = (int(d[low]), int(a[low]), int(b[low])), ",".join(map(str, ids[low:high].tolist()))
                if key == now:
                    sha.update(b",")
                else:
                    if now is not None:
                        yield out()
                    now, sha = key, hashlib.sha256()
                sha.update(joined.encode())
        if now is not None:
            yield out()

    return rows.mapInArrow(run, "depth long, h1 long, h2 long, ends_sha256 string")
