"""Tables written to the folder every executor shares."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallystone.session import written as written


def unused(frame: DataFrame, name: str) -> str:
    """``name``, or the first of its kind that is no column of ``frame`` yet."""
    taken = {column.lower() for column in frame.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def own_columns(frame: DataFrame, alias: str | None = None) -> list[Column]:
    """The columns of ``frame`` as they are called, under ``alias`` if there is one, whatever their names hold."""
    names = [f"`{name.replace('`', '``')}`" for name in frame.columns]
    return [F.col(f"{alias}.{name}" if alias else name) for name in names]


def map_rows(frame: DataFrame, change: Callable[[pa.RecordBatch, int], pa.RecordBatch]) -> DataFrame:
    """Arrow batches of all columns, whatever their names hold, through ``change``.

    It gets a batch and the place of the column ``text`` in it.
    """
    text = frame.columns.index("text")
    plain = frame.toDF(*(f"c{k}" for k in range(len(frame.columns))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield change(batch, text)

    return plain.mapInArrow(run, plain.schema).toDF(*frame.columns)
