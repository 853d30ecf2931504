"""Mixing sources to target weights by hash-threshold histograms.

*Targets.*  The sources share ``total`` times all words by weight; a target stops at
``most`` times its source's words and the excess is reshared by weight until none is
above.  That fixed point is ``min(cap, level * weight)`` for one common level, which a few
aggregates over the table of sources find.

*Selection.*  Every row has a hash of its key.  A source whose target is ``f + r`` times
its words takes each row ``f`` times, and once more where the hash is at or below the
source's threshold for the rest.  Budgets nest: a larger target never drops a row that a
smaller one takes.  The threshold comes from a histogram of words by source and leading
hash bits: the bucket where the running sum passes the budget is the boundary, and only
its rows are counted again by further bits, until it holds one hash value.  That last row
is taken when this brings the sum nearer the budget.  Nothing is sorted, and a source that
holds most rows costs a bounded histogram row per bucket and task.

Defined results: a null text has size 0; null is a source of its own, last in order; rows
that repeat an id share its hash and are taken together; a source without words has target
0 and takes nothing; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from taxalign.llm.hashing import BITS, row_hash
from taxalign.llm.tables import drop, fresh, write
from taxalign.operators.numbering import number_within

#: Bits of the hash that a histogram resolves.
STEP = 12
WORD = "[^ \\t-\\r]+"


def n_words(text: str) -> Column:
    return F.regexp_count(F.coalesce(F.col(f"`{text}`"), F.lit("")), F.lit(WORD)).cast("long")


def _source_key(source: str) -> list[Column]:
    col = F.col(f"`{source}`").cast("string")
    return [F.coalesce(col, F.lit("")).alias("source"), col.isNull().alias("nameless")]


_KEY = ["source", "nameless"]


def targets(sizes: DataFrame, weights: tuple[float, ...], total: float, most: float) -> DataFrame:
    """One row per source: source_size, weight, target."""
    sources = sizes.groupBy(*_KEY).agg(F.sum("size").alias("source_size"))
    sources = number_within(sources.withColumn("one", F.lit(1)), ["one"], ["nameless", "source"], "place")
    place = (F.col("place") - 1) % len(weights)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place + 1).cast("int"))
    sources = write(sources.select(*_KEY, "source_size", weight.alias("weight")).withColumn("cap", F.col("source_size") * float(most)), "sources")
    level = None
    while True:
        capped = F.lit(False) if level is None else F.col("cap") <= F.col("weight") * level
        words, held, open_ = sources.agg(F.sum("source_size"), F.sum(F.when(capped, F.col("cap"))), F.sum(F.when(~capped, F.col("weight")))).first()
        if not open_ or not words:
            break
        following = (total * words - (held or 0.0)) / open_
        if following == level:
            break
        level = following
    share = F.col("cap") if not words or not open_ else F.least(F.col("cap"), F.col("weight") * level)
    return sources.withColumn("target", share)


def thresholds(sizes: DataFrame, sources: DataFrame) -> DataFrame:
    """Adds full (times every row is taken) and threshold (highest hash taken once more)."""
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    state = sources.withColumn("full", whole).withColumn("rest", F.col("target") - F.col("full") * F.col("source_size"))
    state = state.withColumns({"prefix": F.lit(0).cast("long"), "before": F.lit(0).cast("long"), "threshold": F.lit(None).cast("long")})
    settled = []
    for used in range(STEP, BITS + 1, STEP):
        state = write(state, "budgets")
        rows = sizes.join(state.select(*_KEY, "prefix"), _KEY).where(F.shiftright("hash", BITS - used + STEP) == F.col("prefix"))
        bucket = F.shiftright("hash", BITS - used).alias("bucket")
        hist = rows.groupBy(*_KEY, bucket).agg(F.sum("size").alias("words"), F.min("hash").alias("low"), F.max("hash").alias("high"))
        running = Window.partitionBy(*_KEY).orderBy("bucket")  # 2 ** STEP rows of a source at most
        hist = hist.withColumn("upto", F.sum("words").over(running)).join(state, _KEY)
        over = hist.where(F.col("before") + F.col("upto") > F.col("rest"))
        edge = over.groupBy(*_KEY).agg(F.min_by(F.struct("bucket", "words", "low", "high", "upto"), "bucket").alias("edge"))
        state = state.join(edge, _KEY, "left").withColumn("below", F.col("before") + F.col("edge.upto") - F.col("edge.words"))
        last = F.col("edge.low") == F.col("edge.high")
        nearer = F.col("below") + F.col("edge.words") / 2 <= F.col("rest")
        state = write(state.withColumn("threshold", F.when(F.col("edge").isNull(), (1 << BITS) - 1).when(last, F.when(nearer, F.col("edge.low")).otherwise(F.col("edge.low") - 1))), "edges")
        keep = [*_KEY, "source_size", "target", "full", "threshold"]
        settled.append(state.where("threshold is not null").select(*keep))
        state = state.where("threshold is null").select(*_KEY, "source_size", "weight", "cap", "target", "full", "rest", F.col("edge.bucket").alias("prefix"), F.col("below").alias("before"), "threshold")
        if state.isEmpty():
            break
    out = settled[0]
    for part in settled[1:]:
        out = out.unionByName(part)
    return write(out, "thresholds")


def plan(df: DataFrame, key: str, text: str, source: str, weights: tuple[float, ...], total: float, most: float) -> tuple[DataFrame, DataFrame]:
    """Sizes and hashes of the rows, and the sources with their thresholds."""
    sizes = write(df.select(F.col(f"`{key}`").alias("id"), *_source_key(source), n_words(text).alias("size"), row_hash(key).alias("hash")), "sizes")
    return sizes, thresholds(sizes, targets(sizes, weights, total, most))


def _times() -> Column:
    return F.col("full") + (F.col("hash") <= F.col("threshold")).cast("long")


def mix(df: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source",
        weights: tuple[float, ...] = (3.0, 1.0, 2.0), total: float = 1.5, most: float = 2.0) -> DataFrame:
    """``key``, size, source_size, target, taken of every row."""
    sizes, sources = plan(df, key, text, source, weights, total, most)
    rows = sizes.join(sources, _KEY)
    return rows.select(F.col("id").alias(key), "size", "source_size", "target", (F.col("size") * _times()).alias("taken"))


def mixed_rows(df: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source",
               weights: tuple[float, ...] = (3.0, 1.0, 2.0), total: float = 1.5, most: float = 2.0) -> DataFrame:
    """The mix itself: every row of ``df`` as often as it is taken, its columns as they were."""
    _, sources = plan(df, key, text, source, weights, total, most)
    mark = fresh(df, "mix_")
    names = {c: mark + c for c in (*_KEY, "full", "threshold")}
    sources = sources.select(*[F.col(c).alias(n) for c, n in names.items()])
    rows = df.withColumns({names[c]: e for c, e in zip(_KEY, _source_key(source))}).join(sources, [names[c] for c in _KEY])
    times = F.col(names["full"]) + (row_hash(key) <= F.col(names["threshold"])).cast("long")
    rows = rows.withColumn(f"{mark}times", times)
    copies = F.explode(F.expr(f"case when {mark}times > 0 then sequence(1L, {mark}times) end"))
    return rows.withColumn(f"{mark}copy", copies).select(*[F.col(f"`{c}`") for c in df.columns])


ORACLE = r"""
WITH RECURSIVE sizes AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 15) AS BIGINT) AS hash
  FROM documents),
by_source AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sizes GROUP BY source),
sources AS (
  SELECT *, CAST([3, 1, 2][CAST((row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 AS INTEGER) + 1] AS DOUBLE) AS weight,
         source_size * CAST(2 AS DOUBLE) AS cap FROM by_source),
levels AS (
  SELECT 0 AS round, CAST(0 AS DOUBLE) AS level
  UNION ALL
  SELECT round + 1, (SELECT (CAST(1.5 AS DOUBLE) * sum(s.source_size) - coalesce(sum(s.cap) FILTER (round > 0 AND s.cap <= s.weight * level), 0))
                            / sum(s.weight) FILTER (NOT (round > 0 AND s.cap <= s.weight * level)) FROM sources s)
  FROM levels WHERE round < 30),
plan AS (
  SELECT source, source_size, least(cap, weight * (SELECT max(level) FROM levels)) AS target FROM sources),
parts AS (
  SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS whole FROM plan),
summed AS (
  SELECT z.*, p.source_size, p.target, p.whole, p.target - p.whole * p.source_size AS rest,
         sum(size) OVER (PARTITION BY z.source ORDER BY hash) AS upto,
         sum(size) OVER (PARTITION BY z.source, hash) AS own
  FROM sizes z JOIN parts p ON z.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, size, source_size, target,
       CAST(size * (whole + CASE WHEN upto <= rest OR (upto - own <= rest AND upto - own + own / 2.0 <= rest) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM summed
"""
