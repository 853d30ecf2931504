"""Importance resampling towards a target distribution.

*Array-scored weights.*  A feature is a run of words, its bucket the CRC-32 of its bytes
modulo ``buckets``.  Both tables are counted by bucket once; the log ratio of target to raw
frequency of every bucket, its gain, is an array of ``buckets`` numbers that tasks look
features up in.  A document's weight is the floored mean of its gains.  Gumbel noise from a
hash of the id makes the highest scores a draw without replacement.

*Distributed quickselect.*  The order is by score downwards, then id (null last), then the
row's place in the staged table, so keys are unique.  Each round takes a few random rows of
the interval that is still open as pivots, counts exactly how many rows lie before, at and
after each, and narrows the interval to the gap that holds the k-th key.  A round is one
scan with one row of counts per task; their number grows with the logarithm of the rows.
Only the winners are sorted: a range-partitioned sort, numbered by its partitions' sizes.

Defined results: a null text has no words; a document without features has weight 0; a null
id hashes as the empty word; rows that repeat an id share its noise and are drawn each on
its own.  Documents with fewer than ``least_words`` words are scored but never drawn.  With
an empty target table all documents are compared to a flat target.  An empty table gives an
empty table.
"""

from __future__ import annotations

import functools
import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from taxalign.llm.batches import map_arrow, steps
from taxalign.llm.tables import drop, write
from taxalign.llm.terms import counts, ragged, terms, texts

#: Rows taken as pivots in a round of the quickselect.
PIVOTS = 15
#: Features whose bucket a task remembers at a time.
REMEMBERED = 1 << 19


class _Buckets(dict):
    """Bucket of each feature, computed when first asked for."""

    def __init__(self, size: int):
        super().__init__()
        self.size = size

    def __missing__(self, feature: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        found = self[feature] = zlib.crc32(feature) % self.size
        return found


def features(words: list[bytes], shortest: int, longest: int) -> list[bytes]:
    """All runs of ``shortest`` to ``longest`` words, joined by one space."""
    out = list(words) if shortest == 1 else []
    for n in range(max(shortest, 2), longest + 1):
        out += [b" ".join(words[i:i + n]) for i in range(len(words) - n + 1)]
    return out


def hashed(rows: DataFrame, shortest: int, longest: int, buckets: int) -> DataFrame:
    """``rows``, whose last column is a text, with n_words and the buckets of its features in its place."""
    columns, last = rows.columns[:-1], len(rows.columns) - 1

    def run(batches):
        bucket = _Buckets(buckets)
        for batch in steps(batches, last):
            words = [terms(x) for x in texts(batch.column(last))]
            found = [np.fromiter(map(bucket.__getitem__, features(w, shortest, longest)), np.int32) for w in words]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:last], pa.array([len(w) for w in words], pa.int64()), ragged(found)], [*columns, "n_words", "buckets"])

    kinds = "".join(f"{f.name} {f.dataType.simpleString()}, " for f in rows.schema.fields[:last])
    return map_arrow(rows, run, f"{kinds}n_words long, buckets array<int>")


def gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Log ratio of target to raw frequency of each bucket, in thousandths, floored."""
    size = len(raw)
    all_raw, all_target = float(raw.sum() + size), float(target.sum() + size)
    return np.array([math.floor(1000 * math.log(float(t + 1) * all_raw / (float(s + 1) * all_target)))
                     for s, t in zip(raw.tolist(), target.tolist())], np.int64)


def weighted(rows: DataFrame, gain: np.ndarray) -> DataFrame:
    """(row, id, n_words, n_features, weight) of rows with buckets."""

    def run(batches):
        for batch in batches:
            lists = batch.column(3)
            sizes = np.diff(lists.offsets.to_numpy())
            sums = np.concatenate([[0], np.cumsum(gain[lists.flatten().to_numpy()])])
            ends = np.cumsum(sizes)
            weight = (sums[ends] - sums[ends - sizes]) // np.maximum(sizes, 1)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(sizes, pa.int64()), pa.array(weight, pa.int64())], names)

    names = ["row", "id", "n_words", "n_features", "weight"]
    kind = rows.schema["id"].dataType.simpleString()
    return map_arrow(rows.select("row", "id", "n_words", "buckets"), run, f"row long, id {kind}, n_words long, n_features long, weight long")


def noise(key: str, seed: int) -> Column:
    """Gumbel noise of a row's key, in thousandths, floored."""
    word = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(word.cast("binary"), 256), 1, 8), 16, 10).cast("long")
    even = (h.cast("double") + 0.5) / 4294967296.0
    return F.floor(F.lit(-1000.0) * F.log(-F.log(even))).cast("long")


_KEY = ["score", "id", "row"]


def _before(pivot: Row) -> Column:
    """Whether a row comes before the pivot: score downwards, id upwards with null last, row."""
    score, row = F.lit(pivot["score"]), F.lit(pivot["row"])
    if pivot["id"] is None:
        smaller, same = F.col("id").isNotNull(), F.col("id").isNull()
    else:
        smaller, same = F.coalesce(F.col("id") < F.lit(pivot["id"]), F.lit(False)), F.col("id").eqNullSafe(F.lit(pivot["id"]))
    return (F.col("score") > score) | ((F.col("score") == score) & (smaller | (same & (F.col("row") < row))))


def _compare(x: Row, y: Row) -> int:
    """Negative if x comes before y."""
    if x["score"] != y["score"]:
        return -1 if x["score"] > y["score"] else 1
    if x["id"] != y["id"]:
        return -1 if y["id"] is None or (x["id"] is not None and x["id"] < y["id"]) else 1
    return -1 if x["row"] < y["row"] else int(x["row"] > y["row"])


def kth(rows: DataFrame, k: int) -> Row:
    """The k-th key (score, id, row) of ``rows``, counted from 1; there are at least k."""
    low = high = None  # keys outside the open interval
    passed, turn = 0, 0  # rows at or before ``low``
    while True:
        inside = rows
        if low is not None:
            inside = inside.where((F.col("score") <= low["score"]) & ~_before(low) & (F.col("row") != low["row"]))
        if high is not None:
            inside = inside.where((F.col("score") >= high["score"]) & _before(high))
        pivots = inside.select(*_KEY).orderBy(F.xxhash64("row", F.lit(turn))).limit(PIVOTS).collect()
        pivots.sort(key=functools.cmp_to_key(_compare))
        parts = inside.agg(*[F.count_if(_before(p)).alias(f"before{i}") for i, p in enumerate(pivots)]).first()
        nearest = low, passed
        for i, pivot in enumerate(pivots):
            place = passed + parts[f"before{i}"] + 1
            if place == k:
                return pivot
            if place > k:
                high = pivot
                break
            nearest = pivot, place
        low, passed = nearest
        turn += 1


def ranked(rows: DataFrame) -> DataFrame:
    """``rows`` with ``rank`` 1, 2, 3 … by score downwards, id, row."""
    order = [F.col("score").desc(), F.col("id").asc_nulls_last(), F.col("row")]
    ordered = write(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id()), "winners")
    part = F.shiftright("at", 33)
    sizes = ordered.groupBy(part.alias("part")).agg(F.count("*").alias("n"))
    # one row per partition of the sort: the window and the broadcast are bounded by these
    before = F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sizes.select("part", F.coalesce(before, F.lit(0)).alias("offset"))
    place = F.col("offset") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    return ordered.withColumn("part", part).join(F.broadcast(offsets), "part").withColumn("rank", place).drop("part", "offset", "at")


def resample(df: DataFrame, target: DataFrame, key: str = "doc_id", text: str = "text", shortest: int = 1, longest: int = 1,
             buckets: int = 10_000, least_words: int = 20, percent: int = 10, seed: int = 2024) -> DataFrame:
    """``key``, n_features, weight, score and rank (null if not drawn) of every row of ``df``."""
    content = F.col(f"`{text}`").alias("text")
    rows = hashed(df.select(F.col(f"`{key}`").alias("id"), content), shortest, longest, buckets)
    rows = write(rows.withColumn("row", F.monotonically_increasing_id()), "features")
    aimed = hashed(target.select(content), shortest, longest, buckets)
    gain = gains(counts(rows, "buckets", buckets), counts(aimed, "buckets", buckets))
    scored = write(weighted(rows, gain).withColumn("score", F.col("weight") + noise("id", seed)), "scored")
    drop(rows)
    able = scored.where(F.col("n_words") >= least_words)
    k = percent * able.count() // 100
    columns = [F.col("id").alias(key), "n_features", "weight", "score"]
    if not k:
        return scored.select(*columns, F.lit(None).cast("long").alias("rank"))
    last = kth(able, k)
    drawn = (F.col("n_words") >= least_words) & (_before(last) | (F.col("row") == last["row"]))
    return ranked(scored.where(drawn)).select(*columns, "rank").unionByName(
        scored.where(~drawn).select(*columns, F.lit(None).cast("long").alias("rank")))


def oracle(buckets: int = 10_000, least_words: int = 20, percent: int = 10, seed: int = 2024) -> str:
    """DuckDB SQL of ``resample`` over ``documents`` and ``benchmark``, for single words.

    CRC-32 goes byte by byte over the distinct words, through its table of 256 values,
    each of which is eight shifts of its index.
    """
    step = "xor(c >> 1, CASE WHEN c & 1 = 1 THEN 3988292384 ELSE 0 END)"
    return rf"""
WITH RECURSIVE shifts AS (
  SELECT CAST(i AS BIGINT) AS i, CAST(i AS BIGINT) AS c, 0 AS n FROM range(256) t(i)
  UNION ALL SELECT i, {step}, n + 1 FROM shifts WHERE n < 8),
crc AS (SELECT list(c ORDER BY i) AS t FROM shifts WHERE n = 8),
docs AS (
  SELECT row_number() OVER () AS row, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
  FROM documents),
aims AS (
  SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word
  FROM benchmark),
used AS (SELECT row, unnest(words) AS word FROM docs),
hexed AS (SELECT word, hex(encode(word)) AS h FROM (SELECT word FROM used UNION SELECT word FROM aims)),
hashed AS (
  SELECT word, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(len(h) // 2), lambda i: CAST('0x' || substr(h, CAST(2 * i + 1 AS INTEGER), 2) AS BIGINT))),
                               lambda c, b: xor(c >> 8, t[CAST((xor(c, b) & 255) + 1 AS INTEGER)])), 4294967295) % {buckets} AS bucket FROM hexed, crc),
raw AS (SELECT bucket, count(*) AS s FROM used JOIN hashed USING (word) GROUP BY bucket),
aimed AS (SELECT bucket, count(*) AS t FROM aims JOIN hashed USING (word) GROUP BY bucket),
totals AS (SELECT (SELECT coalesce(sum(s), 0) FROM raw) AS s_all, (SELECT coalesce(sum(t), 0) FROM aimed) AS t_all),
gains AS (
  SELECT bucket, CAST(floor(1000 * ln(CAST(coalesce(t, 0) + 1 AS DOUBLE) * CAST(s_all + {buckets} AS DOUBLE)
                      / (CAST(s + 1 AS DOUBLE) * CAST(t_all + {buckets} AS DOUBLE)))) AS BIGINT) AS gain
  FROM raw LEFT JOIN aimed USING (bucket), totals),
sums AS (SELECT row, CAST(sum(gain) AS BIGINT) AS gain, count(*) AS n FROM used JOIN hashed USING (word) JOIN gains USING (bucket) GROUP BY row),
scored AS (
  SELECT d.row, d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_features, CAST(coalesce(floor(CAST(s.gain AS DOUBLE) / n), 0) AS BIGINT) AS weight,
         CAST('0x' || substr(sha256('{seed}:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) AS h
  FROM docs d LEFT JOIN sums s USING (row)),
final AS (SELECT row, doc_id, n_features, weight, weight + CAST(floor(-1000 * ln(-ln((h + CAST(0.5 AS DOUBLE)) / CAST(4294967296 AS DOUBLE)))) AS BIGINT) AS score FROM scored),
placed AS (
  SELECT row, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST, row) AS rank, count(*) OVER () AS n
  FROM final WHERE n_features >= {least_words})
SELECT f.doc_id, f.n_features, f.weight, f.score, CASE WHEN p.rank <= {percent} * p.n // 100 THEN p.rank END AS rank
FROM final f LEFT JOIN placed p USING (row)
"""
