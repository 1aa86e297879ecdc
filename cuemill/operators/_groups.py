"""Groups of rows streamed through Python: sorted partitions, one group at a time, no frame per group."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import IntegerType, StructField, StructType

OUT_ROWS = 10_000


def _stream(df: DataFrame, keys: list[str], order: list[str], walk: Callable[[Iterator[tuple]], Iterator[tuple]], out_type: StructType) -> DataFrame:
    """Deal df by keys, sort, and walk the rows of each partition; walk gives output tuples."""
    arrow = to_arrow_schema(out_type)

    def run(batches):
        rows = (row for b in batches for row in zip(*(c.to_pylist() for c in b.columns), strict=True))
        out = []

        def pack():
            cols = list(zip(*out, strict=True))
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, arrow, strict=True)], schema=arrow)

        for row in walk(rows):
            out.append(row)
            if len(out) >= OUT_ROWS:
                yield pack()
        if out:
            yield pack()

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, out_type)


def stream_groups(df: DataFrame, keys: list[str], order: list[str], work: Callable[[list[tuple]], Iterable[tuple]], schema: str) -> DataFrame:
    """Apply work to the rows (tuples of df's columns, sorted by order) of each group; it gives output tuples."""
    at = [df.columns.index(k) for k in keys]

    def walk(stream):
        now, rows = None, []
        for row in stream:
            key = tuple(row[i] for i in at)
            if key != now:
                if rows:
                    yield from work(rows)
                now, rows = key, []
            rows.append(row)
        if rows:
            yield from work(rows)

    return _stream(df, keys, order, walk, StructType.fromDDL(schema))


def stream_parts(df: DataFrame, keys: list[str], order: list[str], first: Callable, step: Callable, cut: Callable) -> DataFrame:
    """df with part: the number of the segment inside keys, from 0.

    A segment's state is first(row) of its first row, then step(state, row); cut(state, row) ends it before row.
    Rows are tuples of df's columns.  One state is held, however long a group is, and work is linear."""
    at = [df.columns.index(k) for k in keys]

    def walk(stream):
        now, state, part = None, None, 0
        for row in stream:
            key = tuple(row[i] for i in at)
            if key != now:
                now, state, part = key, first(row), 0
            elif cut(state, row):
                state, part = first(row), part + 1
            else:
                state = step(state, row)
            yield (*row, part)

    return _stream(df, keys, order, walk, StructType([*df.schema.fields, StructField("part", IntegerType())]))
