"""Exact duplicates by distributed radix partitioning, most significant bytes first.

Texts that share all bytes so far form a group.  Each round splits the open groups by the
next block of bytes: an aggregate counts (group, block, whether the text ends there), a join
hands each row its new group, named after its first row, and groups of one row, or whose
texts have ended, are done.  Rows carry only the bytes not yet compared.  Blocks grow
sixteenfold, so the number of rounds follows the logarithm of the longest repeated text.
Equality is settled by the bytes themselves; the digest in the result is only reported.

Before the first round a bitmap of bounded size marks where the hashes of first blocks fall
that occur more than once.  Rows outside it share their first block with no other row: they
are groups of one and carry no text into a shuffle.  Rows inside it go through the rounds,
so the bitmap spares work and decides nothing.

A group of copies may hold any share of the rows: it costs one partial count per task, and
the join back has one row per key on its other side, so adaptive execution can split it.

Defined results: null counts as the empty text; runs of white space count as one space;
of equal texts the smallest ``doc_id`` stays (null only when there is no other); when rows
repeat that id, one of them stays.  An empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from taxalign.llm.tables import drop, write

#: Bytes of the first block, the factor between blocks, and the largest block.
FIRST, GROWTH, MOST = 512, 16, 1 << 22
#: Bits of the bitmap of first blocks: as many for each row, and these at least and at most (32 MB).
PER_ROW, FEWEST, MOST_BITS = 64, 20, 28
#: Bits in one value of the bitmap (Spark's bitmap functions have as many).
CHUNK_BITS = 15


def normalised(text: str) -> Column:
    return F.regexp_replace(F.coalesce(F.col(f"`{text}`"), F.lit("")), "[ \\t-\\r]+", " ")


def _place(bits: int) -> Column:
    """Where a row's first block falls in a bitmap of 2 ** ``bits`` bits."""
    return F.shiftrightunsigned(F.xxhash64(F.substring("bytes", 1, FIRST)), 64 - bits)


def _staged(df: DataFrame, key: str, text: str, *more: Column) -> DataFrame:
    """(row, id, bytes, …) of all rows; ``bytes`` is null where no other row has the first block."""
    rows = df.select(F.col(f"`{key}`").alias("id"), normalised(text).cast("binary").alias("bytes"), *more)
    bits = min(max((PER_ROW * df.count()).bit_length(), FEWEST), MOST_BITS)
    met = rows.groupBy(_place(bits).alias("place")).agg(F.count("*").alias("n")).where("n > 1")
    bitmap = met.groupBy(F.shiftright("place", CHUNK_BITS).alias("chunk")).agg(
        F.bitmap_construct_agg(F.col("place").bitwiseAND(F.lit((1 << CHUNK_BITS) - 1))).alias("bitmap"))
    at = _place(bits)
    byte = F.shiftright(at.bitwiseAND(F.lit((1 << CHUNK_BITS) - 1)), 3).cast("int") + 1
    value = F.conv(F.hex(F.substring(F.col("bitmap"), byte, F.lit(1))), 16, 10).cast("int")
    met = F.coalesce(F.getbit(value.cast("long"), at.bitwiseAND(F.lit(7)).cast("int")) == 1, F.lit(False))
    # the bitmap has 2 ** MOST_BITS bits at most, whatever the table
    found = rows.withColumn("chunk", F.shiftright(at, CHUNK_BITS)).join(F.broadcast(bitmap), "chunk", "left")
    found = found.withColumn("bytes", F.when(met, F.col("bytes"))).drop("chunk", "bitmap")
    return write(found.withColumn("row", F.monotonically_increasing_id()), "rows")


def _settled(staged: DataFrame, *also: str) -> DataFrame:
    """(row, id, keep_id, keep_row, n, …) of every staged row: the row that stays of its group, and the group's size."""
    alone = ["id", F.col("id").alias("keep_id"), F.col("row").alias("keep_row"), F.lit(1).cast("long").alias("n")]
    done = staged.where("bytes is null").select("row", *alone, *also)
    active = staged.where("bytes is not null").select("row", "id", *also, F.lit(0).cast("long").alias("group"), F.col("bytes").alias("rest"))
    width = FIRST
    while True:
        cut = active.withColumns({"block": F.substring("rest", 1, width), "ended": F.octet_length("rest") <= width})
        # null ids come last
        first = F.min(F.struct(F.col("id").isNull().alias("nameless"), "id", "row")).alias("first")
        groups = write(cut.groupBy("group", "block", "ended").agg(F.count("*").alias("n"), first).where("n > 1"), "groups")
        # a merge join at every size: its large side can be split where one group is hot
        split = cut.join(groups.hint("merge"), ["group", "block", "ended"], "left")
        goes_on = F.col("n").isNotNull() & ~F.col("ended")
        split = write(split.select(
            "row", "id", *also, F.when(F.col("n").isNull(), F.col("id")).otherwise(F.col("first.id")).alias("keep_id"),
            F.coalesce("first.row", "row").alias("keep_row"), F.coalesce("n", F.lit(1)).alias("n"),
            F.when(goes_on, F.expr(f"substring(rest, {width + 1})")).alias("rest")), "split")
        drop(groups)
        done = done.unionByName(split.where("rest is null").select("row", "id", "keep_id", "keep_row", "n", *also))
        active = split.where("rest is not null").select("row", "id", *also, F.col("keep_row").alias("group"), "rest")
        if active.isEmpty():
            return done
        width = min(width * GROWTH, MOST)


def exact_groups(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, keep_id, group_size, kept, text_sha256: one row per row of ``df``."""
    staged = _staged(df, key, text, F.sha2(normalised(text).cast("binary"), 256).alias("sha"))
    return _settled(staged, "sha").select(
        F.col("id").alias(key), "keep_id", F.col("n").alias("group_size"),
        (F.col("row") == F.col("keep_row")).alias("kept"), F.col("sha").alias("text_sha256"))


def drop_copies(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``df`` that stay: one of each group of equal texts, as it was."""
    staged = _staged(df, key, text, F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("whole"))
    stays = _settled(staged).where("row = keep_row").select("row")
    alone = staged.where("bytes is null").select("whole.*")
    others = staged.where("bytes is not null").join(stays.hint("merge"), "row", "left_semi")
    return alone.unionByName(others.select("whole.*"))
