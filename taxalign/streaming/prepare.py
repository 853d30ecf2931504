"""Cleaning and parsing of a stream of checklist rows.

Every rule here looks at one row, so the batch functions apply as they are and the query
holds no state.  The parser's output is a static table, which each batch of rows is joined
to.  Keys are not minted: whether a key is a repeat is known only at the end.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators import clean as C
from ..operators.names import extract_names, join_gnparse, parse_names
from ..operators.tree import with_columns_present


def prepare_stream(df: DataFrame, managed: str | None = None, parsed: DataFrame | None = None) -> DataFrame:
    """Rows with ``name_to_parse`` and ``parts``; with ``parsed``, the parser's forms count."""
    rows = with_columns_present(C.fill_missing(C.normalize_headers(df)))
    rows = C.clean_names(C.normalize_accepted(C.drop_senior_synonyms(rows)))
    if managed:
        prefix, column = managed.split(":")
        rows = C.add_managed_id(rows, prefix, column)
    if parsed is not None:
        rows = join_gnparse(rows, parsed)
    return parse_names(extract_names(rows))


def write_prepared(prepared: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append what has arrived to Parquet files, then stop.

    The checkpoint folder remembers what is done: a query started again with it goes on
    after the last batch that was committed, and the sink lists each batch once.
    """
    return prepared.writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path)
