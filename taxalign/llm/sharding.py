"""Sharding by extendible hashing.

A directory maps leading bits of a row's hash to a shard.  It begins with one bucket over
all rows; a bucket whose rows outgrow the byte limit splits on the next bit, the others
stay.  A round counts bytes by ``STEP`` further bits of the buckets still open and sums
them up to every depth in between, so it makes up to ``STEP`` splits; each row then meets
its shard by a join on the bits of the round.  Only rows of open buckets go on.

Defined results: null and empty texts have 0 bytes.  A row larger than the limit is a shard
of its own.  The bits of a key are followed by bits of the row's place in the staged table,
so rows that repeat an id split too.  An empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from taxalign.llm.hashing import BITS, row_hash
from taxalign.llm.tables import write

LIMIT = 16 << 20
STEP = 10


def _placed(df: DataFrame, key: str, text: str, limit: int, *also: Column) -> DataFrame:
    """(id, n_bytes, shard, depth, b, n) of every row, and what is carried along."""
    size = F.coalesce(F.octet_length(F.col(f"`{text}`")), F.lit(0)).cast("long")
    rows = write(df.select(F.col(f"`{key}`").alias("id"), size.alias("n_bytes"), row_hash(key).alias("hash"), *also), "rows")
    carried = rows.columns[3:]
    # further bits for rows whose keys agree: staged, so that every reader sees the same
    rows = write(rows.withColumn("tie", F.conv(F.substring(F.md5(F.monotonically_increasing_id().cast("string").cast("binary")), 1, 15), 16, 10).cast("long")), "rows")
    done, used, prefix, active = [], 0, F.lit(""), rows.withColumn("open", F.lit(""))
    while True:
        word, at = ("hash", used) if used < BITS else ("tie", used - BITS)
        bits = F.lpad(F.bin(F.shiftright(word, BITS - at - STEP).bitwiseAND(F.lit((1 << STEP) - 1))), STEP, "0")
        keyed = active.withColumn("bits", F.concat("open", bits))
        fine = keyed.groupBy("bits").agg(F.sum("n_bytes").alias("b"), F.count("*").alias("n"))
        depths = F.explode(F.sequence(F.lit(used if used == 0 else used + 1), F.lit(used + STEP)))
        sums = fine.withColumn("depth", depths).groupBy("depth", F.expr("substring(bits, 1, depth)").alias("shard")).agg(F.sum("b").alias("b"), F.sum("n").alias("n"))
        last = used + STEP >= 2 * BITS
        fits = sums.where((F.col("b") <= limit) | (F.col("n") == 1) | (F.lit(last) & (F.col("depth") == used + STEP)))
        covers = fine.select("bits", depths.alias("depth")).withColumn("shard", F.expr("substring(bits, 1, depth)")).join(fits, ["depth", "shard"])
        directory = write(covers.groupBy("bits").agg(F.min_by(F.struct("shard", "depth", "b", "n"), "depth").alias("at")), "directory")
        found = keyed.join(directory, "bits", "left")
        done.append(found.where("at is not null").select("id", "n_bytes", *carried, "at.*"))
        if fine.join(directory, "bits", "left_anti").isEmpty():
            break
        active = write(found.where("at is null").select("id", "n_bytes", *carried, "hash", "tie", F.col("bits").alias("open")), "open")
        used += STEP
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out


def shards(df: DataFrame, key: str = "doc_id", text: str = "text", limit: int = LIMIT) -> DataFrame:
    """``key``, n_bytes, shard (its leading bits as a string), depth, shard_bytes, shard_rows."""
    out = _placed(df, key, text, limit)
    return out.select(F.col("id").alias(key), "n_bytes", "shard", "depth", F.col("b").alias("shard_bytes"), F.col("n").alias("shard_rows"))


def write_shards(df: DataFrame, path: str, key: str = "doc_id", text: str = "text", limit: int = LIMIT) -> DataFrame:
    """Write ``df`` with one folder ``shard=…`` per shard; return the assignment.

    Whole rows go along to their shards, so rows that repeat a key are written once each.  A
    column of ``df`` named shard gives way to the folder's.
    """
    whole = F.struct(*[F.col(f"`{c}`") for c in df.columns if c.lower() != "shard"]).alias("whole")
    placed = write(_placed(df, key, text, limit, whole), "placed")
    name = F.concat(F.lit("s"), "shard").alias("shard")
    placed.select("whole.*", name).repartition("shard").write.partitionBy("shard").parquet(path)
    return placed.select(F.col("id").alias(key), "n_bytes", "shard", "depth", F.col("b").alias("shard_bytes"), F.col("n").alias("shard_rows"))


def oracle(limit: int = LIMIT) -> str:
    """DuckDB SQL of ``shards`` over ``documents``, whose ids don't repeat."""
    return f"""
WITH rows AS (
  SELECT doc_id, CAST(coalesce(octet_length(encode(text)), 0) AS BIGINT) AS n_bytes,
         CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 15) AS BIGINT) AS hash
  FROM documents),
depths AS (SELECT unnest(range(0, 61)) AS depth),
sums AS (
  SELECT d.depth, r.hash >> (60 - d.depth) AS lead, sum(r.n_bytes) AS b, count(*) AS n
  FROM rows r, depths d GROUP BY ALL HAVING sum(r.n_bytes) <= {limit} OR count(*) = 1),
placed AS (
  SELECT r.doc_id, r.n_bytes, r.hash, min(s.depth) AS depth
  FROM rows r JOIN sums s ON r.hash >> (60 - s.depth) = s.lead GROUP BY ALL)
SELECT p.doc_id, p.n_bytes, substr(lpad(bin(p.hash), 60, '0'), 1, p.depth) AS shard, CAST(p.depth AS INTEGER) AS depth,
       CAST(s.b AS BIGINT) AS shard_bytes, CAST(s.n AS BIGINT) AS shard_rows
FROM placed p JOIN sums s ON s.depth = p.depth AND p.hash >> (60 - s.depth) = s.lead
"""
