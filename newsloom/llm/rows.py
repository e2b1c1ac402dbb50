"""Rows passed through Python whole, with one more column."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql.types import DataType, StructField, StructType

from . import words


def unused(docs: DataFrame, name: str) -> str:
    """``name``, made longer until ``docs`` has no such column."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name += "_"
    return name


def with_column(docs: DataFrame, name: str, kind: DataType,
                start: Callable[[], Callable[[words.Block], pa.Array]], lower: bool = False) -> DataFrame:
    """All columns of ``docs`` and ``name``, made from blocks of the column text.

    ``start`` is called once per task and gives the function of a block.  Narrow; rows need no key.
    A text column of another name or type isn't looked for; ``name`` must be new.
    """
    if name in docs.columns:
        raise ValueError(f"{name} is a column already")
    at = docs.columns.index("text")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = start()
        for batch in batches:
            texts = batch.column(at)
            for block in words.blocks(pc.utf8_lower(texts) if lower else texts):
                part = batch.slice(block.rows.start, block.count)
                yield pa.RecordBatch.from_arrays([*part.columns, made(block)], names=[*part.schema.names, name])

    return docs.mapInArrow(read, StructType([*docs.schema.fields, StructField(name, kind)]))
