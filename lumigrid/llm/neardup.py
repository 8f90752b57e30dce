"""Near-duplicate documents: DartMinHash signatures, banded, and exact checks in blocks.

A document is a weighted set: its shingles of five words, each weighing as often as it
stands there. Darts are thrown at the plane of weight and rank of every shingle, by
hashing, so that all documents see the same darts; a document is hit by the darts below
its weight. The earliest dart (by rank) of each coordinate is the signature: two
documents agree in a coordinate with the probability of their weighted Jaccard similarity.
Documents that agree in all coordinates of a band share a bucket, and all texts of a
bucket are compared exactly, block against block, in tasks that return no more links than
join their texts. Linked texts are one class.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumigrid.llm.append import append
from lumigrid.llm.shared import table
from lumigrid.llm.words import mix, shingles, slices, words

WORDS = 5
SIMILARITY = 0.8
#: 32 bands of 4 coordinates: a pair at 0.8 shares no bucket with probability 5e-8.
BANDS, ROWS = 32, 4
#: Texts of a bucket's block, on average.
BLOCK = 512
#: Bytes of text that are signed at once: a word of it takes some hundred bytes meanwhile.
SLICE = 1 << 19

_FINEST = 14  # ranks below 2**-14 are one cell; each further cell doubles the rank
_U = np.uint64


def _uniform(x: np.ndarray) -> np.ndarray:
    return (x >> _U(11)).astype(np.float64) * 2.0**-53


def _poisson(mean: float) -> np.ndarray:
    """The distribution function of a Poisson variable, as far as it differs from 1."""
    n = np.arange(int(mean + 12 * math.sqrt(mean) + 30))
    return np.cumsum(np.exp(n * math.log(mean) - mean - np.r_[0, np.cumsum(np.log(n[1:]))]))


class Darts:
    """Signatures of k coordinates for weighted sets."""

    def __init__(self, k: int):
        self.k = k
        self.density = k * math.log(k) + 2 * k  # darts that a set is hit by, on average
        self.cells: dict[tuple[int, int], np.ndarray] = {}

    def _thrown(self, key: np.ndarray, wide: int, high: int) -> np.ndarray:
        """How many darts each element has in a cell of weights and ranks."""
        area = self.density * max(1, 2 ** (wide - 1)) * 2.0 ** (high - _FINEST - (high > 0))
        if (wide, high) not in self.cells:
            self.cells[wide, high] = _poisson(area)
        return np.searchsorted(self.cells[wide, high], _uniform(key))

    def signatures(self, element: np.ndarray, weight: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
        """k values for each of n sets; all are given, as each has an element at least.
        element, weight and owner (rising) tell the sets' elements."""
        out = np.zeros((n, self.k), np.uint64)
        total = np.bincount(owner, weight, minlength=n)
        todo = np.flatnonzero(total > 0)
        limit = np.where(total > 0, 1.25 / np.maximum(total, 1e-300), 0)
        while len(todo):
            mine = np.isin(owner, todo) if len(todo) < n else np.ones(len(owner), bool)
            best = self._earliest(element[mine], weight[mine], owner[mine], limit, n, out)
            todo = todo[~best[todo].all(axis=1)]
            limit[todo] *= 2  # a coordinate without a dart: throw further
        return out

    def _earliest(self, element, weight, owner, limit, n, out) -> np.ndarray:
        ids, ranks, owners = [], [], []
        wide_most = int(np.ceil(np.log2(max(weight.max(initial=1.0), 1.0))))
        reach = limit[owner]
        for wide in range(wide_most + 1):
            low, width = (0.0, 1.0) if wide == 0 else (2.0 ** (wide - 1), 2.0 ** (wide - 1))
            e = np.flatnonzero(weight > low)
            for high in range(_FINEST + 64):
                start, size = (0.0, 2.0**-_FINEST) if high == 0 else (2.0 ** (high - 1 - _FINEST), 2.0 ** (high - 1 - _FINEST))
                e = e[reach[e] > start]
                if not len(e):
                    break
                cell = mix(element[e] ^ _U((wide * 1000003 + high * 7919 + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
                count = self._thrown(cell, wide, high)
                some = count > 0
                many = count[some]
                number = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
                dart = mix(np.repeat(cell[some], many) + (number.astype(np.uint64) + _U(1)) * _U(0xD1342543DE82EF95))
                at = np.repeat(e[some], many)
                rank = start + size * _uniform(mix(dart ^ _U(0x5851F42D4C957F2D)))
                keep = rank <= reach[at]
                if wide or (weight < 1).any():
                    keep &= low + width * _uniform(mix(dart ^ _U(0x2545F4914F6CDD1D))) <= weight[at]
                ids.append(dart[keep])
                ranks.append(rank[keep])
                owners.append(owner[at[keep]])
        ids, ranks, owners = np.concatenate(ids), np.concatenate(ranks), np.concatenate(owners)
        slot = owners * self.k + (mix(ids ^ _U(0xA0761D6478BD642F)) % _U(self.k)).astype(np.int64)
        order = np.argsort(ranks, kind="stable")[::-1]  # the last write, of the least rank, stays
        found = np.zeros(n * self.k, bool)
        found[slot] = True
        out.reshape(-1)[slot[order]] = ids[order]
        return found.reshape(n, self.k)


def band_keys(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    keys = np.zeros((len(signature), bands), np.uint64)
    for r in range(rows):
        keys = mix(keys + signature[:, r::rows][:, :bands] + _U(r + 1))
    return mix(keys ^ np.arange(1, bands + 1, dtype=np.uint64)).view(np.int64)


def elements(column: pa.Array, n_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each text, how often they stand there, and the text."""
    key, text = shingles(words(column), n_words)
    if not len(key):
        return key, np.zeros(0), text
    order = np.lexsort((key, text))
    key, text = key[order], text[order]
    first = np.r_[True, (key[1:] != key[:-1]) | (text[1:] != text[:-1])]
    at = np.flatnonzero(first)
    return key[at], np.diff(np.r_[at, len(key)]).astype(np.float64), text[at]


def sign(df: DataFrame, text: str, n_words: int, bands: int, rows: int) -> DataFrame:
    """`df` with `keys`, the bucket of each band; empty for a text without words."""

    def make():
        darts = Darts(bands * rows)

        def compute(column):
            key, weight, owner = elements(column, n_words)
            keys = band_keys(darts.signatures(key, weight, owner, len(column)), bands, rows)
            some = np.bincount(owner, minlength=len(column)) > 0
            ends = np.r_[0, np.cumsum(some * bands)].astype(np.int32)
            return [pa.ListArray.from_arrays(ends, keys[some].reshape(-1))]

        return compute

    return append(df, text, "keys array<long>", make, limit=SLICE)


def similar_pairs(column: pa.Array, ids: np.ndarray, n_words: int, least: float) -> list[tuple[int, int]]:
    """Links that join the texts of a block pair: a spanning forest of all pairs whose
    weighted Jaccard similarity is `least` or more. Exact, by counting common shingles;
    the k-th standing of a shingle counts as an element of its own."""
    key, weight, owner = elements(column, n_words)
    n = len(column)
    times = weight.astype(np.int64)
    nth = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
    key, owner = mix(np.repeat(key, times) + nth.astype(np.uint64) * _U(0x9E3779B97F4A7C15)), np.repeat(owner, times)
    size = np.bincount(owner, minlength=n)
    order = np.argsort(key, kind="stable")
    key, owner = key[order], owner[order]
    edge = np.flatnonzero(np.r_[True, key[1:] != key[:-1], True])
    run = np.diff(edge)
    common, waiting, held = np.zeros(n * n, np.int64), [], 0
    for length in np.unique(run[run > 1]).tolist():
        members = owner[edge[:-1][run == length][:, None] + np.arange(length)]
        for block in np.array_split(members, max(1, members.size * length // (1 << 20))):
            waiting.append((block[:, :, None] * n + block[:, None, :]).reshape(-1))
            held += waiting[-1].size
            if held >= 1 << 21:
                common += np.bincount(np.concatenate(waiting), minlength=n * n)
                waiting, held = [], 0
    if waiting:
        common += np.bincount(np.concatenate(waiting), minlength=n * n)
    common = common.reshape(n, n)
    union = size[:, None] + size[None, :] - common
    linked = (common >= least * union - 1e-9) & (common > 0)
    root = np.arange(n)
    links = []
    for i, j in zip(*np.nonzero(np.triu(linked, 1)), strict=True):
        a, b = root[i], root[j]
        if a != b:
            root[root == b] = a
            links.append((int(ids[i]), int(ids[j])))
    return links


def links(docs: DataFrame, buckets: DataFrame, n_words: int, least: float, block: int) -> DataFrame:
    """Links (a, b) between texts of one bucket. buckets: key, id, t1, t2. docs: id, t1, t2,
    text. A text is told by t1 and t2, and stands for its id in the links."""
    mark = F.xxhash64("t1", "t2")
    sizes = buckets.groupBy("key").agg(F.count("*").alias("n"), F.bit_xor(mark).alias("x"), F.bit_xor(F.xxhash64(mark, F.lit(1))).alias("y")).where("n > 1")
    # buckets of other bands with the very same texts need no second look
    chosen = sizes.groupBy("n", "x", "y").agg(F.min("key").alias("key")).select("key", F.ceil(F.col("n") / block).cast("int").alias("blocks"))
    held = buckets.join(chosen, "key").withColumn("own", F.pmod(mark, F.col("blocks")).cast("int"))
    held = held.select("key", "id", "t1", "t2", "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    held = held.select("id", "t1", "t2", F.col("key").alias("unit"), F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
    texts = docs.join(held, ["id", "t1", "t2"]).select("unit", "i", "j", "id", "t1", "t2", "text")
    order = ["unit", "i", "j", "id", "t1", "t2"]

    def run(batches):
        waiting, at = [], None

        def close():
            t = pa.Table.from_batches(waiting).combine_chunks()
            who = np.stack([t[c].to_numpy() for c in ("id", "t1", "t2")], axis=1)
            first = np.flatnonzero(np.r_[True, (who[1:] != who[:-1]).any(axis=1)])
            made = similar_pairs(t["text"].combine_chunks().take(pa.array(first)), who[first, 0], n_words, least)
            return pa.RecordBatch.from_arrays([pa.array([a for a, _ in made], pa.int64()), pa.array([b for _, b in made], pa.int64())], names=["a", "b"])

        for piece in slices(batches, "text"):
            where = np.stack([np.asarray(piece.column(k)) for k in range(3)], axis=1)
            cuts = np.flatnonzero((where[1:] != where[:-1]).any(axis=1)) + 1
            for low, high in zip([0, *cuts.tolist()], [*cuts.tolist(), len(where)], strict=True):
                if at is not None and (where[low] != at).any():
                    yield close()
                    waiting = []
                at = where[low]
                waiting.append(piece.slice(low, high - low))
        if waiting:
            yield close()

    return texts.repartition("unit", "i", "j").sortWithinPartitions(*order).mapInArrow(run, "a long, b long")


def _with_least(edges: DataFrame, least: DataFrame, many: int) -> DataFrame:
    """`edges` (u, v) with m of `least` (u, m, n). A vertex of more than `many` edges does
    not bring them into one task: such vertices, few as they need so many edges each, are
    sent to all."""
    hot = F.broadcast(least.where(F.col("n") > many).select("u", "m"))
    cold = least.where(F.col("n") <= many).select("u", "m")
    return edges.join(hot, "u").unionByName(edges.join(F.broadcast(hot.select("u")), "u", "left_anti").join(cold, "u"))


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """The component of each vertex of `edges` (a, b): id, class_id (the least vertex).

    Large-star and small-star steps in turn until nothing changes. Each step takes the
    least neighbour by an aggregate that is combined before its shuffle, and is written to
    the shared folder, so that a lost executor costs one step. Vertices of more than
    1,000 edges, and of more than a hundred thousandth of all, are joined by sending them:
    200,000 of them at most, as each edge has two ends.
    """
    now = table(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), name)
    mark = lambda e: e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
    seen = mark(now)
    while True:
        many = max(1000, seen[0] // 100_000)
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n")
        large = _with_least(both, least, many).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        small_least = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        joined = _with_least(large, small_least, many)
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small_least.select("u", F.col("m").alias("v")))
        now = table(small.where("u <> v").distinct(), name)
        found = mark(now)
        if found == seen:
            break
        seen = found
    return now.select(F.col("u").alias("id"), F.col("v").alias("class_id")).unionByName(now.select(F.col("v").alias("id"), F.col("v").alias("class_id")).distinct())


def classes(df: DataFrame, doc_id: str = "doc_id", text: str = "text", n_words: int = WORDS, similarity: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS, block: int = BLOCK) -> DataFrame:
    """doc_id and class_id, the least doc_id of its class, for each row of `df`.

    Two texts are linked if they are equal, or if they share a bucket and their weighted
    Jaccard similarity of shingles is at least `similarity`; classes are what links
    connect. Equal texts are one text before anything is compared, and buckets are cut
    into block pairs, so that no task gathers a group, however large. A text of fewer than
    five words is one shingle; one without words (null is empty) only equals itself. Rows
    of one doc_id are one document, so all their texts are in its class. Rows with a null
    doc_id have a null class. An empty table gives no rows; other columns are not read.
    """
    docs = df.select(F.col(doc_id).cast("long").alias("id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    same = [F.xxhash64("text").alias("t1"), F.xxhash64(F.lit(1), "text").alias("t2")]
    named = docs.where("id is not null").select("id", *same, "text")
    signed = sign(named, "text", n_words, bands, rows).drop("text")
    # a text stands for the least id that has it
    texts = table(signed.groupBy("t1", "t2").agg(F.min("id").alias("id"), F.first("keys").alias("keys")), "texts")
    buckets = texts.select("id", "t1", "t2", F.explode("keys").alias("key"))
    shared = buckets.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    buckets = table(buckets.join(shared, "key"), "buckets")
    # ids with several texts join what these stand for
    pair = F.struct("t1", "t2")
    several = named.groupBy("id").agg(F.min(pair).alias("low"), F.max(pair).alias("high")).where("low <> high").select(F.col("id").alias("own"))
    theirs = named.select(F.col("id").alias("own"), "t1", "t2").join(several, "own").join(texts.select("t1", "t2", "id"), ["t1", "t2"])
    found = components(links(named, buckets, n_words, similarity, block).unionByName(theirs.select(F.col("own").alias("a"), F.col("id").alias("b"))))
    mapped = texts.join(found, "id", "left").select("t1", "t2", F.coalesce("class_id", "id").alias("class_id"))
    out = named.select("id", "t1", "t2").join(mapped, ["t1", "t2"]).select(F.col("id").alias("doc_id"), "class_id")
    return out.unionByName(docs.where("id is null").select(F.col("id").alias("doc_id"), F.col("id").alias("class_id")))


def deduplicate(df: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """One document of each class, that of the least doc_id, with df's own columns. Of
    several rows of it the one whose text has the least hash stays, of equal texts the one
    with the least hash of all columns (but maps), so a retry keeps the same. Rows with a
    null doc_id stay."""
    kept = classes(df, doc_id, text, **options).where("doc_id = class_id").select(F.col("doc_id").alias("_kept")).distinct()
    hashed = [F.col(f"`{f.name}`") for f in df.schema.fields if "map<" not in f.dataType.simpleString()]
    order = F.struct(F.xxhash64(F.col(f"`{text}`").cast("string")), F.xxhash64(*hashed))
    mine = [F.min_by(F.struct(*[F.col(f"`{c}`") for c in df.columns]), order).alias("_row")]
    one = df.where(F.col(doc_id).isNotNull()).join(kept, F.col(doc_id) == F.col("_kept"), "left_semi").groupBy(doc_id).agg(*mine).select("_row.*")
    return one.unionByName(df.where(F.col(doc_id).isNull()))
