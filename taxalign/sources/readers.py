"""Tables from files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..functions import rcc5
from ..operators.clean import fill_missing, normalize_headers
from ..staging import stage

# Columns of the name parser's output.
GNPARSE = "Id Verbatim Cardinality CanonicalStem CanonicalSimple CanonicalFull Authorship Year Quality".split()
# Headers of a curated diff and what they become.
DIFF_HEADERS = {"MDDv1.10_Name": "A name", "MDDv1.11_Name": "B name", "Category": "category"}


# -- quoted CSV in splits ---------------------------------------------------------------------
#
# A line break inside quotes doesn't end a record, and whether a line begins inside quotes
# depends on all lines before it.  Each line is a function on the two states (inside,
# outside): it keeps the state, turns it round, or ends in one state whatever it began in.
# Functions compose, so a split needs to know only what the splits before it come to.


def _unquoted(text: Column) -> Column:
    """``text`` without its whole quoted fields; a field left open stays, with its quote."""
    return F.regexp_replace(F.replace(text, F.lit('""'), F.lit("")), '(^|,)"[^"]*"[^,]*', "$1")


def _left_open(text: Column) -> Column:
    return _unquoted(text).rlike('(^|,)"')


_SPLIT = ["file", "split"]


def _state_before(rows: DataFrame, by: list[str], order: str, start: Column | None = None) -> Column:
    """Whether a row (with ``turns``, ``ends``) begins inside quotes.

    The last row before it that ends in one state says where counting begins, and each row
    since that turns the state changes it; where there is none, ``start`` does (or outside).
    """
    before = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    turned = F.coalesce(F.sum(F.col("turns").cast("int")).over(before), F.lit(0))
    known = F.last(F.col("_known"), ignorenulls=True).over(before)
    begun = F.coalesce(known["state"], start if start is not None else F.lit(False))
    odd = (turned - F.coalesce(known["turned"], F.lit(0))) % 2 == 1
    return begun != odd


def _with_known(rows: DataFrame, by: list[str], order: str) -> DataFrame:
    upto = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    turned = F.sum(F.col("turns").cast("int")).over(upto)
    return rows.withColumn("_known", F.when(F.col("ends").isNotNull(), F.struct(F.col("ends").alias("state"), turned.alias("turned"))))


def csv_records(spark: SparkSession, path: str) -> DataFrame:
    """(_ord, header, value): the records of quoted CSV files, line breaks in values and all.

    ``header`` marks the first record of a file.  Files are read in splits; lines are numbered
    within their split, a table with one row per split carries states and records on from
    one to the next, and only lines of records that go on over lines are brought together.
    ``_ord`` is the place of a record's first line.  A quote that is never closed makes the
    rest of its file one record.
    """
    lines = spark.read.option("lineSep", "\n").text(path).select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("n"))
    out, inside = _left_open(F.col("value")), _left_open(F.concat(F.lit('"'), "value"))
    lines = lines.withColumns({"_out": out, "_in": inside}).withColumns({
        "turns": F.col("_out") & ~F.col("_in"), "ends": F.when(F.col("_out") == F.col("_in"), F.col("_out"))}).drop("_out", "_in")
    # what a split does to the state: one row each
    marked = _with_known(lines.filter("turns or ends is not null").select(*_SPLIT, "n", "turns", "ends"), _SPLIT, "n")
    per_split = marked.groupBy(*_SPLIT).agg(F.sum(F.col("turns").cast("int")).alias("_turned"), F.max_by("_known", F.when(F.col("_known").isNotNull(), F.col("n"))).alias("_last"))
    every = lines.select(*_SPLIT).distinct().join(per_split, _SPLIT, "left").withColumn("_turned", F.coalesce("_turned", F.lit(0)))
    odd = (F.col("_turned") - F.coalesce("_last.turned", F.lit(0))) % 2 == 1
    every = every.withColumns({"turns": F.col("_last").isNull() & odd, "ends": F.when(F.col("_last").isNotNull(), F.col("_last.state") != odd)})
    every = _with_known(every, ["file"], "split")
    starts = stage(every.select(*_SPLIT, _state_before(every, ["file"], "split").alias("start")), "splits")
    # lines that begin a record, and the record of each line
    placed = _with_known(lines, _SPLIT, "n").join(starts, _SPLIT)
    placed = placed.withColumn("begins", ~_state_before(placed, _SPLIT, "n", F.col("start")))
    upto = Window.partitionBy(*_SPLIT).orderBy("n").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    following = F.lead("begins").over(Window.partitionBy(*_SPLIT).orderBy("n"))
    own = F.last(F.when(F.col("begins"), F.col("n")), ignorenulls=True).over(upto)
    placed = stage(placed.select(*_SPLIT, "n", "value", own.alias("record"), (F.col("begins") & following).alias("whole")), "lines")
    # a record that goes on over a split: its first line is the last that began before
    begun = placed.groupBy(*_SPLIT).agg(F.max("record").alias("record"))
    earlier = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    carried = begun.select(*_SPLIT, F.last("record", ignorenulls=True).over(earlier).alias("_carried"))
    whole = F.coalesce("whole", F.lit(False))
    several = placed.filter(~whole).join(carried, _SPLIT).withColumn("record", F.coalesce("record", "_carried"))
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("split", "n", "value"))), lambda x: x["value"]), "\n")
    joined = several.groupBy("file", "record").agg(text.alias("value"))
    records = placed.filter(whole).select("file", "record", "value").unionByName(joined)
    heads = placed.filter("split = 0").groupBy("file").agg(F.min("record").alias("_head"))
    return records.join(F.broadcast(heads), "file").select(
        F.col("record").alias("_ord"), (F.col("record") == F.col("_head")).alias("header"), F.regexp_replace("value", "\r$", "").alias("value"))


def read_quoted(spark: SparkSession, path: str) -> DataFrame:
    """CSV with quotes, split among tasks; values may hold line breaks.

    If every line is a record, Spark's reader takes the lines as they are.
    """
    unsure = _left_open(F.col("value")) | F.col("value").rlike('(^|,)""[^",]')
    if spark.read.text(path).filter(unsure).isEmpty():
        return spark.read.csv(path, header=True, quote='"', escape='"')
    records = csv_records(spark, path)
    # the reader takes the header apart; the first file's names count
    names = spark.read.csv(path, header=True, quote='"', escape='"', multiLine=True).columns
    schema = ", ".join(f"`{n.replace('`', '``')}` string" for n in names)
    parsed = F.from_csv("value", schema, {"quote": '"', "escape": '"', "multiLine": "true"})
    return records.filter(~F.col("header") & (F.col("value") != "")).select("_ord", parsed.alias("r")).select("r.*", "_ord")


def ragged_quoted(spark: SparkSession, path: str) -> DataFrame:
    """(trimmed, short): records of a quoted file with too many or too few fields."""
    records = csv_records(spark, path).filter("value <> ''").withColumn("_n", F.size(F.split(_unquoted(F.col("value")), ",", -1)))
    width = records.filter("header").agg(F.max("_n")).first()[0] or 0
    return records.filter("not header").agg(F.count_if(F.col("_n") > width).alias("trimmed"), F.count_if(F.col("_n") < width).alias("short"))


def read_checklist(spark: SparkSession, path: str) -> DataFrame:
    """A checklist with ``_ord``, all values strings, absent values ''.

    CSV when the name contains `.csv`, Parquet for `.parquet`, else tab-separated text
    without quoting.
    """
    if ".parquet" in path:
        raw = spark.read.parquet(path)
    elif ".csv" in path:
        raw = read_quoted(spark, path)
    else:
        raw = spark.read.csv(path, header=True, sep="\t", quote="")
    out = fill_missing(normalize_headers(raw))
    return out if "_ord" in out.columns else out.withColumn("_ord", F.monotonically_increasing_id())


def ragged_counts(spark: SparkSession, path: str, sep: str = "\t") -> DataFrame:
    """(trimmed, short): lines of an unquoted file with too many or too few fields.

    The reader itself cuts long lines and fills short ones.
    """
    width = len(spark.read.csv(path, header=True, sep=sep, quote="").columns)
    n = F.size(F.split("value", F.concat(F.lit("\\Q"), F.lit(sep), F.lit("\\E")), -1))
    return spark.read.text(path).agg(F.count_if(n > width).alias("trimmed"), F.count_if(n < width).alias("short"))


def read_gnparse(spark: SparkSession, path: str) -> DataFrame:
    out = read_quoted(spark, path).drop("_ord")
    if out.columns != GNPARSE:
        raise ValueError(f"expected the columns {GNPARSE}, got {out.columns}")
    return fill_missing(out)


def dump_fields(lines: DataFrame, names: list[str], *more: str) -> DataFrame:
    """Fields of tab-separated dump lines, where a bar stands between any two; ``more`` columns stay."""
    cells = F.split("value", "\t")
    return lines.select(*[F.coalesce(F.try_element_at(cells, F.lit(2 * i + 1)), F.lit("")).alias(n) for i, n in enumerate(names)], *more)


def read_ncbi(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """nodes, names and merged ids of a taxonomy dump.

    ``_ord`` of a name is its place: file, beginning of the split, and place in the split.
    """
    def lines(name: str) -> DataFrame:
        return spark.read.text(f"{folder}/{name}.dmp")
    place = F.struct("_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id().alias("n"))
    return (dump_fields(lines("nodes"), ["tax_id", "parent_tax_id", "rank"]),
            dump_fields(lines("names").select("value", place.alias("_ord")), ["tax_id", "name_txt", "unique_name", "name_class"], "_ord"),
            dump_fields(lines("merged"), ["old_tax_id", "new_tax_id"]))


def read_diff(df: DataFrame) -> DataFrame:
    """A curated or computed diff with `A name`, `B name` and `category`.

    A relation that says one side does not hold the name blanks that side.
    """
    out = fill_missing(df.withColumnsRenamed(DIFF_HEADERS))
    relation = F.col("rcc5") if "rcc5" in out.columns else F.lit("")

    def name(column: str, absent: int):
        text = F.translate(column, "_", " ")
        return F.when((text == "NA") | (relation == rcc5.symbol_of(absent)), "").otherwise(text)

    return out.withColumns({"A name": name("A name", rcc5.GT | rcc5.DISJOINT),
                            "B name": name("B name", rcc5.LT | rcc5.DISJOINT)})
