"""Run a per-row function over Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

#: Rows that are turned into Python values at a time; keeps a task's memory to a few texts.
ROWS = 512


def arrow_schema(schema: StructType) -> pa.Schema:
    kinds = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string(), "double": pa.float64(), "boolean": pa.bool_(), "binary": pa.binary()}
    return pa.schema([(f.name, kinds[f.dataType.simpleString()]) for f in schema])


def map_rows(df: DataFrame, make: Callable[[], Callable], schema: str) -> DataFrame:
    """`make()` is called once in each task and gives the function from a row's values to an output tuple."""
    parsed = StructType.fromDDL(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, row = arrow_schema(parsed), make()
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                rows = [row(*x) for x in zip(*(c.to_pylist() for c in part.columns))]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), out)], schema=out)

    return df.mapInArrow(run, parsed)
