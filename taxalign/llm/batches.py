"""Arrow batches for Python stages, bounded by bytes rather than rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Rows in an Arrow batch: whole texts may be very long, so few of them travel at once.
ROWS_PER_BATCH = 256
#: Bytes of text that a step holds at a time inside a task (a longer text comes alone).
BYTES_PER_STEP = 1 << 21


def with_small_batches(df: DataFrame) -> DataFrame:
    """Have the session send rows to Python workers in small batches."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ROWS_PER_BATCH))
    return df


def map_arrow(df: DataFrame, f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    return with_small_batches(df).mapInArrow(f, schema)


def arrow_type(df: DataFrame, name: str) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(df.schema[name].dataType)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string column and where each text begins (one more than texts); null is empty."""
    column = column.fill_null("").cast(pa.large_string())
    n, shift = len(column), column.offset
    begins = np.frombuffer(column.buffers()[1], np.int64, n + 1 + shift)[shift:] if n else np.zeros(1, np.int64)
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[begins[0]:begins[-1]], begins - begins[0]


def steps(batches: Iterator[pa.RecordBatch], text: int) -> Iterator[pa.RecordBatch]:
    """The same rows, with at most ``BYTES_PER_STEP`` of text at a time (or one row)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, begins = utf8(batch.column(text))
        start = 0
        while start < batch.num_rows:
            stop = int(np.searchsorted(begins, begins[start] + BYTES_PER_STEP, "right")) - 1
            stop = min(max(stop, start + 1), batch.num_rows)
            yield batch.slice(start, stop - start)
            start = stop
