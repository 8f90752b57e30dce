"""Approximate nearest neighbours by learned partitions.

A bounded sample gives a neighbour graph, which is cut into parts of equal size with few
edges between them. A small classifier learns a vector's part from the parts of its
neighbours; it sends every vector of the table to one part and every query to several, the
most probable. How many is set so that sample vectors find nearly all of their neighbours.
A table of more parts than one classifier tells apart has two levels: each part of the
first is cut and learnt again, from its own sample, in the task that holds it.
Queries and candidates of a part meet in blocks of bounded size and are ranked by their
exact cosine.
"""

from __future__ import annotations

import pickle
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumigrid.llm.shared import table

#: Vectors that a graph and its classifier are fitted to, at most.
SAMPLE = 8192
#: Vectors of a part, on average, and of a block of it.
PART, BLOCK = 2048, 4096
#: Parts that one classifier tells apart. Two levels make their square, for 134 million
#: vectors; of a larger table parts grow and are compared in more blocks.
MOST_PARTS = 256
NEIGHBOURS = 10
#: The share of sample neighbours that must be within reach.
REACH = 0.94


def parts_of(n: int, part: int) -> int:
    """Parts for n vectors, a power of two: of `part` vectors at most on average, and eight
    at least where that leaves eight vectors to each."""
    return 2 ** max(1 if n < 64 else 3, int(np.ceil(np.log2(max(n / part, 1)))))


def vectors(df: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    """id and v (doubles) of the vectors that take part: a row's id is not null, its vector
    is not null or zero, has no null or non-finite component and the most frequent length.
    Repeated rows are one."""
    v = df.select(F.col(vec_id).cast("long").alias("id"), F.col(embedding).cast("array<double>").alias("v")).where("id is not null and v is not null")
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    v = v.where(fine)
    length = v.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return v.where(F.size("v") == (length.n if length else 0)).distinct()


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def neighbour_graph(x: np.ndarray, k: int) -> np.ndarray:
    """The k nearest others of each row of unit vectors."""
    out = np.zeros((len(x), k), np.int64)
    for low in range(0, len(x), 512):
        s = x[low : low + 512] @ x.T
        s[np.arange(len(s)), low + np.arange(len(s))] = -np.inf
        out[low : low + 512] = np.argpartition(-s, k - 1, axis=1)[:, :k]
    return out


def balanced_parts(x: np.ndarray, near: np.ndarray, parts: int, rounds: int = 15) -> np.ndarray:
    """A part for each vector: halves are halved along their main axis, then vectors move
    to the part of most of their neighbours, best gains first, while it has room."""
    part = np.zeros(len(x), np.int64)
    made = 1
    while made < parts:
        for p in range(made):
            mine = np.flatnonzero(part == p)
            centred = x[mine] - x[mine].mean(axis=0)
            axis = np.linalg.svd(centred[:4000], full_matrices=False)[2][0]
            part[mine[np.argsort(centred @ axis, kind="stable")[len(mine) // 2 :]]] = p + made
        made *= 2
    room = int(np.ceil(1.05 * len(x) / parts))
    rows = np.repeat(np.arange(len(x)), near.shape[1])
    for _ in range(rounds):
        votes = np.zeros((len(x), parts))
        np.add.at(votes, (rows, part[near.reshape(-1)]), 1)
        np.add.at(votes, (near.reshape(-1), part[rows]), 1)
        want = votes.argmax(axis=1)
        gain = votes[np.arange(len(x)), want] - votes[np.arange(len(x)), part]
        size, moved = np.bincount(part, minlength=parts), 0
        for i in np.argsort(-gain, kind="stable")[: (gain > 0).sum()]:
            if size[want[i]] < room:
                size[part[i]] -= 1
                size[want[i]] += 1
                part[i] = want[i]
                moved += 1
        if not moved:
            break
    return part


@dataclass
class Router:
    """A classifier of one hidden layer, and how many parts a query goes to."""

    weights: list[np.ndarray]
    parts: int
    probes: int

    def order(self, x: np.ndarray) -> np.ndarray:
        """Parts of unit vectors, most probable first."""
        if self.parts == 1:
            return np.zeros((len(x), 1), np.int64)
        a, b, c, d = self.weights
        return np.argsort(-(np.maximum(x @ a + b, 0) @ c + d), axis=1, kind="stable")


def fit(sample: np.ndarray, parts: int, seed: int = 0, hidden: int = 128, epochs: int = 40, rate: float = 3e-3) -> Router:
    """A router from sample vectors: Adam on the cross-entropy of the part of a vector and
    of its neighbours. A tenth of the sample only sets the number of probes."""
    x = unit(sample)
    rng = np.random.default_rng(seed)
    parts = min(parts, 2 ** int(np.log2(max(len(x), 1))))  # a vector for each part at least
    if parts == 1:
        return Router([np.zeros((x.shape[1], 1)), np.zeros(1), np.zeros((1, 1)), np.zeros(1)], 1, 1)
    near = neighbour_graph(x, min(NEIGHBOURS, len(x) - 1))
    part = balanced_parts(x, near, parts)
    goal = np.zeros((len(x), parts))
    np.add.at(goal, (np.repeat(np.arange(len(x)), near.shape[1]), part[near.reshape(-1)]), 1)
    goal[np.arange(len(x)), part] += 2
    goal /= goal.sum(axis=1, keepdims=True)
    w = [rng.normal(0, (2 / x.shape[1]) ** 0.5, (x.shape[1], hidden)), np.zeros(hidden), rng.normal(0, hidden**-0.5, (hidden, parts)), np.zeros(parts)]
    m, v, step = [np.zeros_like(a) for a in w], [np.zeros_like(a) for a in w], 0
    order = rng.permutation(len(x))
    check, learn = order[: len(x) // 10], order[len(x) // 10 :]
    for _ in range(epochs):
        for rows in np.array_split(rng.permutation(learn), max(1, len(learn) // 256)):
            h = x[rows] @ w[0] + w[1]
            z = np.maximum(h, 0) @ w[2] + w[3]
            p = np.exp(z - z.max(axis=1, keepdims=True))
            dz = (p / p.sum(axis=1, keepdims=True) - goal[rows]) / len(rows)
            dh = dz @ w[2].T * (h > 0)
            step += 1
            for i, g in enumerate((x[rows].T @ dh, dh.sum(axis=0), np.maximum(h, 0).T @ dz, dz.sum(axis=0))):
                m[i] = 0.9 * m[i] + 0.1 * g
                v[i] = 0.999 * v[i] + 0.001 * g * g
                w[i] -= rate * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)
    router = Router(w, parts, parts)
    home = router.order(x)[:, 0]
    place = np.argsort(router.order(x[check]), axis=1)  # when each part is probed
    when = np.take_along_axis(place, home[near[check, :5]], axis=1)
    for probes in range(1, parts + 1):
        if when.size and (when < probes).mean() >= REACH:
            router.probes = probes
            break
    return router


def _cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    norm = lambda x: np.sqrt((x * x).sum(axis=1))
    return (a * b).sum(axis=1) / (norm(a) * norm(b))


def fit_parts(rows: DataFrame, router: Router, parts: int, n: int, sample: int) -> dict[int, Router]:
    """A router of `parts` parts for each part of `router`, each from about `sample` of the
    part's vectors; MOST_PARTS routers at most come to the driver, of a few hundred KB."""
    drawn = rows.where(F.pmod(F.xxhash64("id", F.lit(7)), F.lit(1_000_000)) < int(min(1.0, sample * router.parts / n) * 1_000_000))
    held = drawn.mapInArrow(routed(router, 1), ROUTED)

    def learn(key, group):
        found = fit(np.stack(group["v"].to_numpy()[:sample]), parts)
        made = pickle.dumps(Router([w.astype(np.float32) for w in found.weights], found.parts, found.probes))
        return pd.DataFrame({"part": [int(key[0])], "router": [made]})

    return {r.part: pickle.loads(r.router) for r in held.groupBy("part").applyInPandas(learn, "part int, router binary").collect()}


ROUTED = "id long, v array<double>, part int"


def matrix(column) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def routed(router: Router, probes: int, within=None):
    """A function that sends vectors of Arrow batches to their most probable parts. within:
    a broadcast of routers for each part's own parts; probes = 0 stands for each router's
    own number."""

    def run(batches):
        below = within.value if within else {}
        wide = max((r.parts for r in below.values()), default=1)
        for b in batches:
            if not b.num_rows:
                continue
            x = unit(matrix(b.column(1)))
            to = router.order(x)[:, : probes or router.probes]
            rows, parts = np.repeat(np.arange(len(x)), to.shape[1]), to.reshape(-1)
            if below:
                chosen = []
                for p in np.unique(parts).tolist():
                    mine = rows[parts == p]
                    own = below.get(p)  # a part that the sample had nothing of is one part
                    inner = own.order(x[mine])[:, : probes or own.probes] if own else np.zeros((len(mine), 1), np.int64)
                    chosen.append((np.repeat(mine, inner.shape[1]), p * wide + inner.reshape(-1)))
                rows, parts = (np.concatenate(c) for c in zip(*chosen))
            again = pa.array(rows)
            yield pa.RecordBatch.from_arrays([b.column(0).take(again), b.column(1).take(again), pa.array(parts.astype(np.int32))], names=["id", "v", "part"])

    return run


def search(df: DataFrame, queries: DataFrame, k: int = 5, vec_id: str = "vec_id", embedding: str = "embedding", sample: int = SAMPLE, part: int = PART, most: int = MOST_PARTS) -> DataFrame:
    """The k nearest rows of `df` found for each row of `queries`: query_id, rank (from 1),
    vec_id, score, the cosine in double precision, largest first, ties to the smaller id.
    A row of the query's id is no candidate. With k candidates or fewer, all are found.

    Vectors that are null, zero, or hold null or non-finite components take no part, nor do
    rows without an id or with a vector of another length than most. Of equal vectors only
    the k + 1 of least id can be among the nearest, so others are left out before anything
    is compared; that also splits a vector that fills a third of the table. Every other row
    is indexed. Empty tables give no rows; repeated rows are one, other columns are not read.
    """
    spark = df.sparkSession
    rows = vectors(df, vec_id, embedding)
    same = Window.partitionBy("v").orderBy("id")
    rows = table(rows.withColumn("nth", F.row_number().over(same)).where(F.col("nth") <= k + 1).drop("nth"), "vectors")
    n = rows.count()
    asked = queries.select(F.col(vec_id).cast("long").alias("id"), F.col(embedding).alias("v"))
    asked = vectors(asked, "id", "v")
    drawn = rows.orderBy(F.xxhash64("id", "v")).limit(sample).collect()  # bounded by `sample`
    parts = parts_of(n, part)
    router = fit(np.array([r.v for r in drawn]), min(parts, most)) if drawn else Router([], 1, 1)
    within = spark.sparkContext.broadcast(fit_parts(rows, router, min(parts // most, most), n, sample)) if parts > most else None

    held = rows.mapInArrow(routed(router, 1, within), ROUTED)
    blocks = held.groupBy("part").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    held = held.join(F.broadcast(blocks), "part")  # a row for each of most * most parts at most
    held = held.select("part", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int").alias("block"), F.lit(0).alias("asks"), "id", "v")
    sent = asked.mapInArrow(routed(router, 0, within), ROUTED).join(F.broadcast(blocks), "part")
    sent = sent.select("part", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(1).alias("asks"), "id", "v")

    def rank(batches):
        ids, vs, now, ready = [], [], None, None
        for b in batches:
            group = np.stack([np.asarray(b.column(c)) for c in range(3)], axis=1)
            cuts = [0, *((group[1:] != group[:-1]).any(axis=1).nonzero()[0] + 1).tolist(), len(group)]
            for low, high in zip(cuts, cuts[1:]):
                if high == low:
                    continue
                key, asks = tuple(group[low, :2]), group[low, 2]
                if key != now:
                    now, ids, vs, ready = key, [], [], None
                part_ids, part_vs = np.asarray(b.column(3))[low:high], matrix(b.column(4).slice(low, high - low))
                if not asks:
                    ids.append(part_ids)
                    vs.append(part_vs)
                    continue
                if not ids:
                    continue
                if ready is None:
                    every, table_ = np.concatenate(ids), np.concatenate(vs)
                    ready = (every, table_, unit(table_))
                every, table_, normed = ready
                for at in range(0, len(part_ids), 256):
                    q_ids, q = part_ids[at : at + 256], part_vs[at : at + 256]
                    near = unit(q) @ normed.T
                    near[q_ids[:, None] == every[None, :]] = -np.inf
                    m = min(k, near.shape[1])
                    least = -np.partition(-near, m - 1, axis=1)[:, m - 1] - 1e-9
                    i, j = np.nonzero((near >= least[:, None]) & (near > -np.inf))
                    score = _cosine(q[i], table_[j])
                    order = np.lexsort((every[j], -score, i))
                    i, j, score = i[order], j[order], score[order]
                    nth = np.arange(len(i)) - np.searchsorted(i, i)
                    best = nth < k
                    yield pa.RecordBatch.from_arrays([pa.array(q_ids[i[best]]), pa.array(every[j[best]]), pa.array(score[best])], names=["query_id", "vec_id", "score"])

    met = held.unionByName(sent).repartition("part", "block").sortWithinPartitions("part", "block", "asks", "id")
    found = met.mapInArrow(rank, "query_id long, vec_id long, score double")
    own = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(own)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
