"""Joins of long texts with what belongs to them, without moving the texts.

A block is a fixed range of rows of one file, so a row's block is the same however a job
splits its input. What an earlier job has found out for a block is written by Spark as one
partition of a table in the shared folder, and a task that reads rows of the block again
opens that partition beside them. So only the narrow side of such a join is shuffled.
Every block gets a partition, so a block without one is an error and not "nothing found".
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumigrid.llm.shared import at, shared_dir, table

#: Rows of a block.
ROWS = 16_384


def blocked(docs: DataFrame, rows: int = ROWS) -> DataFrame:
    """`docs` with `block`, a number of the file and range of rows that holds each row.
    Rows whose file is not known (they come from a shuffle, or from no file) are written to
    a table first."""
    try:
        place = docs.metadataColumn("_metadata")
        return docs.withColumn("block", F.xxhash64(place["file_path"], F.floor(place["row_index"] / rows)))
    except AnalysisException:  # no such column
        return blocked(table(docs, "docs"), rows)


def write_beside(rows: DataFrame, name: str, order: str, every: DataFrame | None = None) -> str:
    """Writes the rows of each block, in the order of a column, to a partition of its own;
    the folder. Blocks of `every` (block) get one even if it is empty; the column of the
    order is then never null in `rows`."""
    folder = shared_dir(rows.sparkSession, name)
    if every is not None:
        rows = rows.where(F.col(order).isNotNull()).unionByName(every.select("block"), allowMissingColumns=True)
    rows.repartition("block").sortWithinPartitions("block", order).write.partitionBy("block").parquet(folder)
    return folder


def read_beside(folder: str, block: int, order: str) -> pa.Table:
    """What was written for a block; an error where nothing was."""
    store, path = at(f"{folder}/block={block}")
    if store.get_file_info(path).type.name != "Directory":
        raise ValueError(f"nothing was written for block {block}: the input has changed between two reads")
    found = pq.read_table(path, filesystem=store, partitioning=None)
    return found.filter(pc.is_valid(found[order])).combine_chunks()


def by_block(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.RecordBatch]]:
    """The batches, cut where the block changes."""
    for batch in batches:
        blocks = batch.column(batch.schema.get_field_index("block")).to_numpy()
        edges = [0, *((blocks[1:] != blocks[:-1]).nonzero()[0] + 1).tolist(), len(blocks)]
        for low, high in zip(edges, edges[1:]):
            if high > low:
                yield int(blocks[low]), batch.slice(low, high - low)


def without(docs: DataFrame, rejected: DataFrame, key: str) -> DataFrame:
    """The rows of `docs` (blocked, with a column `key`) whose key is not among the rows
    of `rejected` (block, key) for their block."""
    folder = write_beside(rejected.select("block", key).distinct(), "rejected", key, docs.select("block").distinct())

    def run(batches):
        now, gone = None, pa.array([], pa.int64())
        for block, piece in by_block(batches):
            if block != now:
                now, gone = block, read_beside(folder, block, key)[key].combine_chunks()
            yield piece.filter(pc.invert(pc.is_in(piece.column(piece.schema.get_field_index(key)), gone)))

    return docs.mapInArrow(run, docs.schema)
