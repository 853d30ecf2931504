"""Terms of a text, and counts of small integers over a whole column.

A term is a longest run of digits, letters a-z and bytes from 0x80 on, after A-Z have been
lower-cased; every other byte separates.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from taxalign.llm.batches import map_arrow

_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 0x80 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def terms(text: bytes) -> list[bytes]:
    return text.translate(_FOLD).split()


def texts(column: pa.Array) -> list[bytes]:
    """The texts of a string column as bytes; null is empty."""
    return column.fill_null("").cast(pa.large_string()).cast(pa.large_binary()).to_pylist()


def ragged(values: list[np.ndarray]) -> pa.ListArray:
    """A list column from one array per row."""
    ends = np.cumsum([0, *map(len, values)])
    flat = np.concatenate(values) if values else np.zeros(0, np.int32)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int32()))


def counts(df: DataFrame, column: str, size: int) -> np.ndarray:
    """How often each of 0 … size - 1 occurs in a column of integer lists.

    A task adds up its rows in one array, so what is shuffled and what comes to the driver
    is bounded by ``size``.
    """

    def add(batches):
        total = np.zeros(size, np.int64)
        for batch in batches:
            total += np.bincount(batch.column(0).flatten().to_numpy(), minlength=size)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at])], ["slot", "n"])

    out = np.zeros(size, np.int64)
    for row in map_arrow(df.select(column), add, "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n")).collect():
        out[row["slot"]] = row["n"]
    return out
