"""Points that are near each other, without a shuffle of pairs.

Points are dealt to blocks of some radii a side, those beside a border also to the blocks
beyond it. So a block has all that is near its own points, and a task compares, in small
squares, what came to its blocks: a few thousand rows and the pairs of a few points at once,
however many pairs there are."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import product

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Axes that squares and blocks use; distances use all.
GRID_AXES = 3
#: Squares a side of a block, as a power of two, and pairs that are compared at once.
BITS, PAIRS = 4, 1 << 19
SIDE = 1 << BITS
ASKS, IS_THERE = 1, 2


def dealt(points: DataFrame, radius: float, by: list[str], axes: tuple[str, ...], asking: DataFrame | None = None, asks: Column | None = None) -> DataFrame:
    """`points` by blocks (_b0, _b1 ..), with _role: whether a row asks for what is near it,
    and whether it is there to be found. Points ask themselves (where `asks` holds), or the
    rows of `asking` do. Rows with a null key or without a finite place
    take no part."""
    side, grid = radius * (1 + 1e-9), axes[:GRID_AXES]  # a hair wider, as quotients are rounded

    def placed(df: DataFrame) -> DataFrame:
        df = df.dropna(subset=by)
        for a in axes:
            df = df.where(F.col(a).isNotNull() & ~F.isnan(a) & (F.abs(a) != float("inf")))
        return df.withColumns({f"_b{k}": F.floor(F.col(a) / side) + SIDE // 2 for k, a in enumerate(grid)})

    names = [f"_b{k}" for k in range(len(grid))]
    own = lambda df: {n: F.shiftright(n, BITS) for n in names}
    out = placed(points)
    home = F.struct(*[F.shiftright(n, BITS).alias(n) for n in names])
    out = out.withColumn("_home", home)
    for n in names:
        out = out.withColumn(n, F.explode(F.sequence(F.shiftright(F.col(n) - 1, BITS), F.shiftright(F.col(n) + 1, BITS))))
    at_home = F.struct(*names) == F.col("_home")
    if asking is None:
        ask = at_home & F.coalesce(asks, F.lit(False)) if asks is not None else at_home
        out = out.withColumn("_role", F.when(ask, ASKS | IS_THERE).otherwise(IS_THERE)).drop("_home")
    else:
        queries = placed(asking)
        queries = queries.withColumns(own(queries)).withColumn("_role", F.lit(ASKS))
        out = out.withColumn("_role", F.lit(IS_THERE)).drop("_home").unionByName(queries, allowMissingColumns=True)
    keys = [*by, *names]
    return out.repartition(*keys).sortWithinPartitions(*keys)


def _starts(batch: pa.RecordBatch | pa.Table, keys: list[str]) -> np.ndarray:
    """Whether each row but the first begins another group."""
    new = np.zeros(max(batch.num_rows - 1, 0), bool)
    for k in keys:
        column = batch.column(k)
        column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
        code = column.dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
        new |= code[1:] != code[:-1]
    return new


def _groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Sorted rows as tables of whole groups."""
    held, last = [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        ends = [tuple(batch.column(k)[i].as_py() for k in keys) for i in (0, batch.num_rows - 1)]
        begins = np.flatnonzero(_starts(batch, keys))
        cut = int(begins[-1]) + 1 if len(begins) else (0 if last not in (None, ends[0]) else -1)
        if cut >= 0:
            done = [*held, batch.slice(0, cut)]
            if sum(b.num_rows for b in done):
                yield pa.Table.from_batches(done).combine_chunks()
            held = [batch.slice(cut)]
        else:
            held.append(batch)
        last = ends[1]
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


class Block:
    """Some whole blocks in a task: columns, and what is near any place in them."""

    def __init__(self, table: pa.Table, keys: list[str], radius: float, axes: tuple[str, ...]):
        self.table, self.radius, self.axes = table, radius, axes
        self.group = np.r_[0, np.cumsum(_starts(table, keys))]
        self.role = self.numbers("_role")
        self.at = [self.numbers(a).astype(float) for a in axes]
        self.side = radius * (1 + 1e-9)
        self.home = [self.numbers(f"_b{k}") << BITS for k in range(min(len(axes), GRID_AXES))]
        there = np.flatnonzero(self.role & IS_THERE)
        key = self.keys(self.at, np.arange(table.num_rows))[there]
        order = np.argsort(key, kind="stable")
        self.there, self.sorted = there[order], key[order]
        self.asking = np.flatnonzero(self.role & ASKS)

    def numbers(self, name: str) -> np.ndarray:
        return self.table.column(name).combine_chunks().to_numpy(zero_copy_only=False)

    def rows(self, names: list[str], rows: np.ndarray) -> dict[str, pa.Array]:
        """The columns of rows, by name."""
        return {n: self.table.column(n).combine_chunks().take(pa.array(rows)) for n in names}

    def ranks(self, name: str) -> np.ndarray:
        """The place of each row's value in their order."""
        out = np.empty(self.table.num_rows, np.int64)
        out[pc.sort_indices(self.table.column(name)).to_numpy()] = np.arange(len(out))
        return out

    def squares(self, at: list[np.ndarray], rows: np.ndarray) -> list[np.ndarray]:
        """The square of places, counted from the home blocks of rows; 0 .. SIDE - 1 is inside."""
        return [np.floor(x / self.side).astype(np.int64) + SIDE // 2 - h[rows] for x, h in zip(at, self.home)]

    def keys(self, at: list[np.ndarray], rows: np.ndarray) -> np.ndarray:
        key = self.group[rows].astype(np.int64)
        for s in self.squares(at, rows):
            key = key * (SIDE + 4) + s + 2
        return key

    def near(self, at: list[np.ndarray], rows: np.ndarray, keep: Callable[[np.ndarray], np.ndarray] | None = None) -> Iterator[tuple[slice, np.ndarray, np.ndarray, np.ndarray]]:
        """For places (in the home blocks of rows) which of them, by slices: pairs of a
        place's number in its slice, ascending, and the row near it, and their squared distance."""
        keep = keep or (lambda d2: d2 <= self.radius * self.radius)
        key, n = self.keys(at, rows), len(rows)
        steps = list(product((-1, 0, 1), repeat=len(self.home) - 1))
        low, high = np.empty((n, len(steps)), np.int64), np.empty((n, len(steps)), np.int64)
        for k, step in enumerate(steps):
            shift = 0
            for s in step:
                shift = shift * (SIDE + 4) + s
            middle = key + shift * (SIDE + 4)
            low[:, k], high[:, k] = np.searchsorted(self.sorted, middle - 1), np.searchsorted(self.sorted, middle + 1, side="right")
        counts = high - low
        total = counts.sum(1)
        so_far, a = np.r_[0, np.cumsum(total)], 0
        while a < n:
            b = max(int(np.searchsorted(so_far, so_far[a] + PAIRS, side="right")) - 1, a + 1)
            each = counts[a:b].ravel()
            first = np.cumsum(each) - each
            two = self.there[np.repeat(low[a:b].ravel() - first, each) + np.arange(each.sum())]
            one = np.repeat(np.arange(b - a), total[a:b])
            d2 = np.zeros(len(one))
            for x, p in zip(at, self.at):
                step = x[a:b][one] - p[two]
                d2 += step * step
            found = np.flatnonzero(keep(d2))
            yield slice(a, b), one[found], two[found], d2[found]
            a = b

    def asked(self, keep: Callable[[np.ndarray], np.ndarray] | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """near() for the rows that ask: (their rows, number among these, row near, distance)."""
        for part, one, two, d2 in self.near([x[self.asking] for x in self.at], self.asking, keep):
            yield self.asking[part], one, two, d2


def lists(one: np.ndarray, n: int, values: pa.Array) -> pa.ListArray:
    """`values` as lists, by the ascending numbers of n rows."""
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(one, np.arange(n + 1)), pa.int32()), values)


def merged(part: np.ndarray, one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """Numbers that name the least of what is connected, after pairs are joined."""
    while len(one):
        a, b = part[one], part[two]
        apart = a != b
        if not apart.any():
            break
        one, two, a, b = one[apart], two[apart], a[apart], b[apart]
        np.minimum.at(part, np.maximum(a, b), np.minimum(a, b))
        while (part[part] != part).any():
            part = part[part]
    return part


def run(frame: DataFrame, radius: float, by: list[str], axes: tuple[str, ...], made: Callable[[Block], Iterator[dict]], fields: dict[str, T.DataType]) -> DataFrame:
    """What `made` gives for the blocks of a dealt() table: columns by name."""
    keys = [*by, *[f"_b{k}" for k in range(min(len(axes), GRID_AXES))]]
    schema = T.StructType([T.StructField(n, t) for n, t in fields.items()])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _groups(batches, keys):
            for columns in made(Block(table, keys, radius, axes)):
                arrays = [c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in columns.values()]
                yield pa.RecordBatch.from_arrays(arrays, names=list(columns))

    return frame.mapInArrow(work, schema)
