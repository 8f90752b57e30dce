"""SentencePiece encoding and decoding as relations.

Texts are cut where no piece of the model reaches over: between two characters that stand
side by side in no piece. The distinct units of the corpus are exploded into substrings of
bounded length and equi-joined with the piece table: the lattice. The edges of each unit,
grouped, are folded over its positions by Spark's higher-order ``aggregate``, Viterbi's way:
each position keeps the best path to it, which ends with one edge and goes on from the best
path to where that edge starts.

* Unigram models: the best path has the highest sum of scores.
* BPE models: the pieces of a text's beginning are a path too, and it is the only one of
  which no two neighbours would have been merged otherwise. So a step goes over an edge if
  the edge's piece stands beside the path's last piece as the merges would leave both; the
  ids are those of the library.

Ids of units that many blocks of documents have are read by every task; there are at most
SHARE times as many of them as units in the largest block, whatever the corpus. Those of
other units are written beside the blocks that have them (see blocks.py).
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumigrid.llm.blocks import blocked, by_block, read_beside, write_beside
from lumigrid.llm.shared import at, shared_dir, table
from lumigrid.llm.units import Memo, Units
from lumigrid.llm.words import rolling_keys, slices, small_batches, utf8

SPACE = "▁"
#: Characters of a unit that goes through the lattice. The fold's work grows with their
#: square; a longer unit is encoded by the library.
LONGEST = 256
#: A unit in one of SHARE blocks or more is read by all tasks.
SHARE = 3
#: Units of blocks, of which many are alike, in a task of the lattice, and tasks at most;
#: beyond that tasks are larger and spill.
UNITS, TASKS = 10_000, 20_000
#: Bytes of text that are cut into units at once, and that are encoded at once.
SLICE, CODED = 1 << 20, 1 << 18
UNIGRAM, BPE = 1, 2
NORMAL, UNKNOWN, USER, BYTE = 1, 2, 4, 6
#: Bits of a rank in a number that holds two, and the rank of what never happens.
RANK = 20
NEVER = (1 << RANK) - 1


@dataclass
class Pieces:
    """A model's table of pieces, and what else its file says."""

    rows: list[tuple[str, int, float, int]]
    kind: int
    dummy_prefix: bool
    path: str = ""

    @classmethod
    def load(cls, path: str) -> Pieces:
        from sentencepiece import sentencepiece_model_pb2

        with open(path, "rb") as f:
            model = sentencepiece_model_pb2.ModelProto.FromString(f.read())
        how = model.normalizer_spec
        if how.precompiled_charsmap or how.remove_extra_whitespaces or not how.escape_whitespaces or model.trainer_spec.model_type not in (UNIGRAM, BPE):
            raise ValueError("only unigram and BPE models that leave characters and spaces as they are")
        return cls([(p.piece, k, p.score, p.type) for k, p in enumerate(model.pieces)], model.trainer_spec.model_type, how.add_dummy_prefix, path)

    def __post_init__(self):
        words = [p.replace(SPACE, " ") for p, _, _, t in self.rows if t in (NORMAL, USER)]
        if any(re.search("[^ ] ", w) for w in words):
            raise ValueError("a piece holds a space after another character")
        self.longest = max(map(len, words), default=1)
        self.bytes = {int(p[3:5], 16): k for p, k, _, t in self.rows if t == BYTE}
        self.unknown = next((k for _, k, _, t in self.rows if t == UNKNOWN), 0)
        pairs = {(ord(a), ord(b)) for w in words for a, b in zip(w, w[1:])}
        self.plain = np.zeros(1 << 16, bool)  # pairs of ASCII characters that stand in a piece
        for a, b in pairs:
            if a < 128 and b < 128:
                self.plain[a << 8 | b] = True
        self.pairs = np.array(sorted((a << 21) | b for a, b in pairs) or [-1], np.int64)

    def cuts(self, data: np.ndarray) -> np.ndarray:
        """Whether a unit begins at each byte: a character that stands in no piece after
        the character before it."""
        cut = np.zeros(len(data), bool)
        cut[1:] = ~self.plain[data[:-1].astype(np.uint16) << 8 | data[1:]]
        wide = data >= 128
        if wide.any():
            cut[(data & 0xC0) == 0x80] = False
            near = np.flatnonzero(cut[1:] & (wide[1:] | wide[:-1])) + 1  # characters beside one outside ASCII
            key = _code(data, _begin(data, near - 1)) << 21 | _code(data, near)
            cut[near] = self.pairs[np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)] != key
        return cut

    def units(self, column: pa.Array) -> Units:
        """The units of texts, with spaces as spaces. They joined are the normalized texts."""
        data, at_ = utf8(pc.replace_substring(column, SPACE, " "))
        if self.dummy_prefix:
            full = at_[:-1] < at_[1:]
            data, at_ = np.insert(data, at_[:-1][full], 32), at_ + np.r_[0, np.cumsum(full)]
        return Units(data, at_, self.cuts(data))

    def frame(self, spark: SparkSession) -> DataFrame:
        """piece, id, and of unigram models cost, of BPE models rank (1 for the best score)
        and right and left, the spines() of its end and start; as many rows as the
        vocabulary."""
        words = [(p, k, float(s)) for p, k, s, t in self.rows if t in (NORMAL, USER)]
        rank = {s: r for r, s in enumerate(sorted({s for *_, s in words}, reverse=True), 1)}
        ranks = {p: rank[s] for p, _, s in words}
        if self.kind == UNIGRAM:
            return spark.createDataFrame([(p, k, -s) for p, k, s in words], "piece string, id int, cost double")
        return spark.createDataFrame([(p, k, rank[s], *(spines(p, ranks) if len(p) > 1 else (None, None))) for p, k, s in words], "piece string, id int, rank int, right array<long>, left array<long>")

    def spelled(self) -> tuple[np.ndarray, np.ndarray]:
        """The bytes that ids decode to, joined, and the n+1 offsets of the ids in them."""
        out = [bytes([int(p[3:5], 16)]) if t == BYTE else p.replace(SPACE, " ").encode() if t in (NORMAL, USER) else " ⁇ ".encode() if t == UNKNOWN else b"" for p, _, _, t in self.rows]
        return np.frombuffer(b"".join(out), np.uint8), np.r_[0, np.cumsum([len(x) for x in out])]

    def long_unit(self, library, unit: str) -> list[int]:
        """Ids of a unit that is too long for the lattice, by the library."""
        if unit.startswith(" ") and self.dummy_prefix:
            return library.encode(unit[1:])
        if not self.dummy_prefix:
            return library.encode(unit)
        return library.encode("\n" + unit)[len(library.encode("\n")) :]


def _begin(data: np.ndarray, at_: np.ndarray) -> np.ndarray:
    """Where the characters begin that hold these bytes."""
    for _ in range(3):
        at_ = np.where((data[at_] & 0xC0) == 0x80, at_ - 1, at_)
    return at_


def _code(data: np.ndarray, at_: np.ndarray) -> np.ndarray:
    """The code points of the characters that begin at these bytes of UTF-8."""
    b = [data[np.minimum(at_ + k, len(data) - 1)].astype(np.int64) for k in range(4)]
    two = (b[0] & 0x1F) << 6 | (b[1] & 0x3F)
    three = (b[0] & 0x0F) << 12 | (b[1] & 0x3F) << 6 | (b[2] & 0x3F)
    four = (b[0] & 0x07) << 18 | (b[1] & 0x3F) << 12 | (b[2] & 0x3F) << 6 | (b[3] & 0x3F)
    return np.where(b[0] < 0x80, b[0], np.where(b[0] < 0xE0, two, np.where(b[0] < 0xF0, three, four)))


def spines(piece: str, ranks: dict[str, int]) -> tuple[list[int], list[int]]:
    """When BPE, while it makes a piece, has a piece of each size at its end, and at its
    start: the rank of the merge that makes that piece above the rank of the next one there,
    which takes it in; -1 for sizes that it never has."""
    parts, last = list(piece), 0
    sides = [(1, 0)], [(1, 0)]
    while len(parts) > 1:
        rank, k = min(((ranks[a + b], k) for k, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ranks), default=(0, 0))
        if rank == 0 or rank < last:
            raise ValueError(f"the merges of {piece} do not make it, or not in the order of their ranks")
        last = rank
        parts[k : k + 2] = [parts[k] + parts[k + 1]]
        for side, there in zip(sides, (k == len(parts) - 1, k == 0)):
            if there:
                side.append((len(parts[k]), rank))
    out = [-1] * len(piece), [-1] * len(piece)
    for times, side in zip(out, sides):
        for (size, made), (_, taken) in zip(side, [*side[1:], (0, NEVER)]):
            times[size - 1] = made << RANK | taken
    return out


# ---- the lattice -------------------------------------------------------------------


def lattice(units: DataFrame, pieces: Pieces) -> DataFrame:
    """`units` (distinct `unit`, of LONGEST characters at most, other columns) with `edges`,
    sorted by end, then start: one for each substring that is a piece, and for each
    character that is none. The rows of a unit stay where it is: the explode and the join
    with the vocabulary, which is sent, keep its partitioning. Other columns travel on one
    row of each unit."""
    n = F.length("unit")
    # a number that rises keeps the rows of a unit together: they are in its order already
    start = units.withColumn("nth", F.monotonically_increasing_id()).withColumn("start", F.explode(F.sequence(F.lit(0), n - 1)))
    both = start.withColumn("size", F.explode(F.sequence(F.lit(1), F.least(F.lit(pieces.longest), n - F.col("start")))))
    both = both.withColumn("piece", F.substring("unit", F.col("start") + 1, F.col("size")))
    # the piece table is as large as the vocabulary, whatever the corpus
    found = both.join(F.broadcast(pieces.frame(units.sparkSession)), "piece", "left").where(F.col("id").isNotNull() | (F.col("size") == 1))
    if pieces.bytes:
        text, first = F.hex(F.encode("piece", "UTF-8")), min(pieces.bytes.values())
        bare = F.transform(F.sequence(F.lit(0), (F.length(text) / 2 - 1).cast("int")), lambda k: F.conv(F.substring(text, k * 2 + 1, F.lit(2)), 16, 10).cast("int") + first)
    else:
        bare = F.array(F.lit(pieces.unknown))
    if pieces.kind == UNIGRAM:
        worst = min((s for _, _, s, t in pieces.rows if t == NORMAL), default=0.0)
        more = [F.coalesce("cost", F.lit(10.0 - worst)).alias("cost")]
    else:
        more = [F.coalesce("rank", F.lit(NEVER)).alias("rank"), "right", "left"]
    edge = F.struct((F.col("start") + F.col("size")).alias("end"), "start", "id", F.when(F.col("id").isNull(), bare).alias("bare"), *more)
    others = [c for c in units.columns if c != "unit"]
    once = (F.col("start") == 0) & (F.col("size") == 1)
    found = found.select("nth", "unit", edge.alias("edge"), *[F.when(once, F.col(c)).alias(c) for c in others])
    grouped = found.groupBy("nth", "unit").agg(F.sort_array(F.collect_list("edge")).alias("edges"), *[F.first(c, ignorenulls=True).alias(c) for c in others])
    return grouped.drop("nth")


def _never_merged(last, edge, wide):
    """Whether BPE leaves the pieces `last` and `edge` side by side: no piece that crosses
    the place between them could be merged while both its halves stand there. A half stands
    from its own merge to the next one at its side; of merges of one rank the leftmost goes
    first, so a tie with the left half's side is lost and one with the right half's is won."""
    made = lambda x: F.call_function("shiftright", x, F.lit(RANK))
    taken = lambda x: x.bitwiseAND(F.lit(NEVER))

    def merges(c):
        at_ = lambda times, size: F.coalesce(F.get(times, size - 1), F.lit(NEVER).cast("long"))
        left, right = at_(last["right"], edge["start"] - c["start"]), at_(edge["left"], c["end"] - edge["start"])
        # most pieces fail at the first two: their halves never stand there
        return (left >= 0) & (right >= 0) & (c["rank"] < taken(left)) & (c["rank"] <= taken(right)) & (made(right) < taken(left)) & (made(left) <= taken(right))

    inside = lambda c: (c["start"] < edge["start"]) & (c["end"] > edge["start"]) & (c["start"] >= last["start"]) & (c["end"] <= edge["end"])
    return ~F.exists(wide, lambda c: inside(c) & merges(c))


def viterbi(edges, wide, kind: int):
    """The ids of the best path through a unit. Edges come by their end, then start; the
    state has for each position the last edge of the best path to it, the path's ids and,
    for unigram models, its cost. Of equal costs that path stays whose last piece begins
    first; of BPE pieces that end at a position just one can follow the path before it."""
    none = F.array().cast("array<int>")
    held = ("cost", F.lit(0.0)) if kind == UNIGRAM else ("right", F.array().cast("array<long>"))
    state = lambda start, ids, value: F.array(F.struct(start.alias("start"), ids.alias("ids"), value.alias(held[0])))

    def step(best, e):
        before = F.get(best, e["start"])
        ids = F.when(e["bare"].isNull(), F.array_append(before["ids"], e["id"])).otherwise(F.concat(before["ids"], e["bare"]))
        if kind == BPE:
            # one edge to each end fits, and those of one character come last: when no other
            # did, they do. An array of one binds a name to what would be found anew at each use
            fits = (e["start"] == 0) | (e["end"] - e["start"] == 1) | F.exists(F.array(before), lambda last: _never_merged(last, e, wide))
            return F.when((F.size(best) == e["end"]) & fits, F.array_append(best, F.get(state(e["start"], ids, e["right"]), 0))).otherwise(best)
        cost = before["cost"] + e["cost"]
        return (
            F.when(F.size(best) == e["end"], F.concat(best, state(e["start"], ids, cost)))
            .when(cost < F.get(best, e["end"])["cost"], F.concat(F.slice(best, F.lit(1), e["end"]), state(e["start"], ids, cost)))
            .otherwise(best)
        )

    return F.aggregate(edges, state(F.lit(0), none, held[1]), step, lambda best: F.element_at(best, -1)["ids"])


def encode_units(units: DataFrame, pieces: Pieces) -> DataFrame:
    """`units` with `ids`. `unit` is distinct, with spaces as the model's mark."""
    # a fold over an array of one binds a name to a value; a column used once would be put
    # where it is used, inside the fold, and be found anew for each edge
    bind = lambda value, then: F.aggregate(F.array(value), F.lit(None).cast("array<int>"), lambda _, x: then(x))
    if pieces.kind == BPE:
        # what a step looks at of the edges that can reach over a place: of those of more than
        # one character three numbers, as lists for each place would be copied whole
        wide = F.transform(F.filter("edges", lambda e: e["end"] - e["start"] > 1), lambda e: F.struct(e["start"].alias("start"), e["end"].alias("end"), e["rank"].alias("rank")))
        ids = bind(wide, lambda wide: viterbi(F.col("edges"), wide, BPE))
    else:
        ids = viterbi(F.col("edges"), None, UNIGRAM)
    return lattice(units, pieces).select("unit", ids.alias("ids"), *[c for c in units.columns if c != "unit"])


# ---- documents ---------------------------------------------------------------------


def block_units(rows: DataFrame, pieces: Pieces) -> DataFrame:
    """block and unit: each unit of at most LONGEST characters, once in each run of rows of
    a block. A unit whose 64-bit key another of the run has may be left out; encode() then
    gives it to the library."""

    def run(batches):
        now, seen = None, Memo()
        for block, whole in by_block(batches):
            if block != now:
                now = block
                seen.clear()
            for piece in slices([whole], "text", SLICE):
                units = pieces.units(piece.column(piece.schema.get_field_index("text")))
                first = seen.missing(units.key)
                seen.add(units.key[first], np.zeros(0, np.int32), np.zeros(len(first), np.int32))
                first = first[units.end[first] - units.start[first] <= 4 * LONGEST]
                texts = [u.decode().replace(" ", SPACE) for u in units.texts(first)]
                out = [u for u in texts if len(u) <= LONGEST]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(out), block)), pa.array(out, pa.string())], names=["block", "unit"])

    return rows.select("block", "text").mapInArrow(run, "block long, unit string")


def _learn(memo: Memo, found: pa.Table) -> None:
    if not found.num_rows:
        return
    unit, ids = (pa.concat_arrays(found[c].chunks) for c in ("unit", "ids"))
    data, ends = utf8(pc.replace_substring(unit, SPACE, " "))
    keys, first = np.unique(rolling_keys(data, ends[:-1], ends[1:]), return_index=True)
    ids = ids.take(pa.array(first))
    memo.add(keys, ids.flatten().to_numpy(), pc.list_value_length(ids).to_numpy())


def encode(docs: DataFrame, pieces: Pieces, text: str = "text") -> DataFrame:
    """`docs` with ids (array<int>) and round_trip, whether they decode to the text again.

    Ids equal those of the sentencepiece library. A null text is empty and has no ids; an
    empty table gives no rows. Texts of any length are encoded whole; a unit of more than
    LONGEST characters is encoded by the library. Repeated rows get equal ids; columns named
    as a result are replaced. Texts do not move; only distinct units and their ids are
    shuffled.
    """
    small_batches(docs)
    names = {f.name: f"_own_{i}" for i, f in enumerate(docs.schema.fields) if f.name.lower() not in ("ids", "round_trip")}
    schema = docs.select(*[f"`{n}`" for n in names]).schema.add("ids", T.ArrayType(T.IntegerType())).add("round_trip", T.BooleanType())
    rows = blocked(docs.select(F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"), *[F.col(f"`{k}`").alias(v) for k, v in names.items()]))
    units = table(block_units(rows, pieces), "units")
    n_units, n_blocks = units.agg(F.count("*"), F.count_distinct("block")).first()
    spread = max(2, -(-n_blocks // SHARE))
    # few units a task, as each of them has many edges there
    dealt = units.select("unit").repartition(min(n_units // UNITS + 1, TASKS), "unit")
    coded = table(encode_units(dealt.groupBy("unit").agg(F.count("*").alias("n")), pieces), "coded")
    common = shared_dir(docs.sparkSession, "common")
    coded.where(F.col("n") >= spread).select("unit", "ids").write.parquet(common)
    rare = coded.where(F.col("n") < spread).select("unit", "ids")
    own = write_beside(units.join(rare.hint("shuffle_hash"), "unit").select("block", "unit", "ids"), "own", "unit", rows.select("block").distinct())
    spelled = pieces.spelled()

    def run(batches):
        library = []

        def by_library(unit: bytes) -> list[int]:
            if not library:
                import sentencepiece

                library.append(sentencepiece.SentencePieceProcessor(model_file=pieces.path))
            return pieces.long_unit(library[0], unit.decode())

        now, memo = None, Memo(most=1 << 31)  # holds the units of all and of one block
        everywhere = None
        for block, whole in by_block(batches):
            if everywhere is None:
                store, path = at(common)
                everywhere = pq.read_table(path, filesystem=store)
            if block != now:
                now = block
                memo.clear()
                _learn(memo, pa.concat_tables([everywhere, read_beside(own, block, "unit").select(["unit", "ids"]).cast(everywhere.schema)]))
            for piece in slices([whole], "text", CODED):
                column = piece.column(piece.schema.get_field_index("text"))
                units = pieces.units(column)
                new = memo.missing(units.key)  # too long for the lattice, or of another's key
                if len(new):
                    lists = [by_library(u) for u in units.texts(new)]
                    memo.add(units.key[new], np.concatenate(lists), np.array([len(x) for x in lists]))
                ids, size = memo.ids(units.key)
                ends = np.r_[0, np.cumsum(size)][units.first]
                same = round_trips(ids, ends, units, spelled) & ~pc.match_substring(column, SPACE).to_numpy(zero_copy_only=False)
                own_columns = [piece.column(piece.schema.get_field_index(n)) for n in names.values()]
                yield pa.RecordBatch.from_arrays([*own_columns, pa.ListArray.from_arrays(ends.astype(np.int32), ids), pa.array(same)], names=schema.names)

    return rows.mapInArrow(run, schema)


def spell(ids: np.ndarray, spelled: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of ids, one after another, and the n+1 offsets of the ids in them."""
    data, begin = spelled
    size = (begin[1:] - begin[:-1])[ids]
    ends = np.r_[0, np.cumsum(size)]
    return data[np.repeat(begin[ids] - ends[:-1], size) + np.arange(ends[-1])], ends


def round_trips(ids: np.ndarray, ends: np.ndarray, units: Units, spelled) -> np.ndarray:
    """Whether the ids ids[ends[i]:ends[i+1]] decode to the normalized text i again."""
    out, at_ = spell(ids, spelled)
    was, now = np.r_[units.start, len(units.data)][units.first], at_[ends]
    same = np.diff(was) == np.diff(now)
    if same.all():
        wrong = np.r_[0, np.cumsum(out != units.data)]
        return wrong[now[1:]] == wrong[now[:-1]]
    for k in np.flatnonzero(same).tolist():
        same[k] = (out[now[k] : now[k + 1]] == units.data[was[k] : was[k + 1]]).all()
    return same


def decode(df: DataFrame, pieces: Pieces, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """`df` with the text of its ids; null where they are null. Bytes that are not UTF-8
    become replacement characters, ids that are null or outside the table nothing. An empty
    table gives no rows; a column named as the result is replaced."""
    spelled = pieces.spelled()
    cut = 1 if pieces.dummy_prefix else 0

    def run(batches):
        for batch in batches:
            lists = batch.column(batch.schema.get_field_index(ids)).cast(pa.list_(pa.int64()))
            size = pc.fill_null(pc.list_value_length(lists), 0).to_numpy()
            flat = lists.flatten().fill_null(-1).to_numpy()
            known = (flat >= 0) & (flat < len(spelled[1]) - 1)
            out, at_ = spell(flat[known], spelled)
            ends = at_[np.r_[0, np.cumsum(known)][np.r_[0, np.cumsum(size)]]].tolist()
            raw = [None if not there else out[a:b].tobytes() for a, b, there in zip(ends, ends[1:], lists.is_valid().to_pylist(), strict=False)]
            texts = [None if b is None else (b[cut:] if b[:1] == b" " else b).decode("utf-8", "replace") for b in raw]
            kept = [k for k, n in enumerate(batch.schema.names) if n != text]
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in kept], pa.array(texts, pa.string())], names=[*[batch.schema.names[k] for k in kept], text])

    return df.mapInArrow(run, df.drop(text).schema.add(text, T.StringType()))
