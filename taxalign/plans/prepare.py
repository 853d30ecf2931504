"""From a raw archive to a prepared checklist, by way of an external name parser.

The parser works on files: ``hand_over`` writes the lines for it, and ``prepare`` takes its
output up again.  Rows without a parser result are parsed by rule.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators import clean as C, names as NM
from ..sources import readers


def cleaned(raw: DataFrame, managed: str | None = None) -> DataFrame:
    return C.clean(raw, managed=managed)


def hand_over(rows: DataFrame, path: str) -> None:
    """Write the distinct lines for the parser, one name a line."""
    NM.extract_names(rows).filter("name_to_parse <> ''").select("name_to_parse").distinct().write.text(path)


def prepare(rows: DataFrame, parsed: DataFrame) -> DataFrame:
    """Cleaned rows with the parser's forms and the ``parts`` of their names."""
    return NM.parse_names(NM.join_gnparse(rows, parsed))


def prepare_from_file(spark: SparkSession, rows: DataFrame, parser_file: str) -> DataFrame:
    return prepare(rows, readers.read_gnparse(spark, parser_file))
