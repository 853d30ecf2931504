"""Hash values that any SQL engine can compute."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bits of ``row_hash``: fifteen hexadecimal digits of an MD5.
BITS = 60


def row_hash(key: str) -> Column:
    """Sixty evenly spread bits of a row's key; null counts as the word null."""
    return F.conv(F.substring(F.md5(F.coalesce(F.col(f"`{key}`").cast("string"), F.lit("null")).cast("binary")), 1, 15), 16, 10).cast("long")
