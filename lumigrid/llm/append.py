"""Columns computed from a text column by whole Arrow batches."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from lumigrid.llm.words import SLICE_BYTES, slices, small_batches


def append(df: DataFrame, text: str, ddl: str, make: Callable[[], Callable[[pa.Array], list]], limit: int = SLICE_BYTES) -> DataFrame:
    """Every row of `df` with the columns `ddl` that the function returned by `make`
    computes from `text`. `make` runs once in each task. No shuffle. An input column
    whose name, by any case, is one of the new ones is replaced."""
    small_batches(df)
    new = T.StructType.fromDDL(ddl)
    names = {f.name.lower() for f in new}
    kept = [f for f in df.schema.fields if f.name.lower() not in names or f.name == text]
    out = T.StructType([*[f for f in kept if f.name.lower() not in names], *new.fields])
    source = df.select(*[F.col(f"`{f.name}`") for f in kept]).withColumn(text, F.col(f"`{text}`").cast("string"))
    order = [f.name for f in kept if f.name.lower() not in names]
    types = [f.type for f in to_arrow_schema(new)]

    def run(batches):
        compute = make()
        for piece in slices(batches, text, limit):
            made = compute(piece.column(piece.schema.get_field_index(text)))
            made = [x if isinstance(x, pa.Array) else pa.array(x, t) for x, t in zip(made, types, strict=True)]
            yield pa.RecordBatch.from_arrays([*[piece.column(n) for n in order], *made], names=[*order, *new.names])

    return source.mapInArrow(run, out)
