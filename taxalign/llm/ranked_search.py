"""Ranked lexical search by accumulator-limited term-at-a-time.

The query set is a table of texts, each its own query against all documents.  It is worked
off in blocks of ``BLOCK`` bytes, so that the terms of a block may be broadcast.

1. *Postings.*  One pass over the documents keeps, of each, its length and the block's terms
   in it with their counts.  The numbers of documents and terms, and the documents of each
   term, are added up from these.
2. *Term at a time.*  A task takes its documents in chunks of ``CHUNK`` postings, turned into
   one list per term.  A query's terms are worked off rarest first: a list adds the term's
   share to the accumulators of its documents.  A term's bound is its largest share in the
   chunk.  Once the bounds of all remaining terms together are below the k-th best partial
   score, no new accumulator is made, since it could not get there; the accumulators that
   there are go on to be updated, so the scores of all that may rank are exact.  The best
   of earlier chunks count towards the k-th score.
3. *Merge.*  Each task hands on k rows per query at most; they are ranked in lanes first and
   then over the lanes, so that no task gets all rows of a query.

Integer arithmetic throughout, but for the logarithm of a weight.

Defined results: a null text has no terms, whether document or query, and such a query has
no rows; rows that repeat a document id or an item id are ranked each on its own; null
document ids come last among equal scores.  An empty table gives an empty table.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from taxalign.llm.batches import arrow_type, map_arrow, steps
from taxalign.llm.tables import write
from taxalign.llm.terms import counts, ragged, terms, texts

#: Bytes of query text in a block, postings in a chunk, lanes of the merge.
BLOCK, CHUNK, LANES = 1 << 20, 1 << 21, 16


def blocks(items: DataFrame) -> list[DataFrame]:
    """``items`` in parts of at most ``BLOCK`` bytes of text each, or of one row."""
    size = F.coalesce(F.octet_length("text"), F.lit(0))
    total = items.agg(F.sum(size)).first()[0] or 0
    n = max(1, -(-total // BLOCK))
    while True:
        part = F.pmod(F.xxhash64("row"), F.lit(n))
        over = items.groupBy(part.alias("part")).agg(F.sum(size).alias("b"), F.count("*").alias("rows"))
        if over.where((F.col("b") > BLOCK) & (F.col("rows") > 1)).isEmpty():
            return [items.where(part == i) for i in range(n)]
        n *= 2


def postings(docs: DataFrame, vocabulary) -> DataFrame:
    """(id, n, terms, tfs): each document's length and its terms of the vocabulary; none are left out."""

    def run(batches):
        number = vocabulary.value
        for batch in steps(batches, 1):
            lengths, found, often = [], [], []
            for text in texts(batch.column(1)):
                words = terms(text)
                tf = Counter(filter(number.__contains__, words))
                lengths.append(len(words))
                found.append(np.fromiter(map(number.__getitem__, tf), np.int32, len(tf)))
                often.append(np.fromiter(tf.values(), np.int32, len(tf)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lengths, pa.int64()), ragged(found), ragged(often)], ["id", "n", "terms", "tfs"])

    kind = docs.schema["id"].dataType.simpleString()
    return map_arrow(docs, run, f"id {kind}, n long, terms array<int>, tfs array<int>")


def best_of(scores: np.ndarray, k: int) -> int:
    """The k-th largest of ``scores``, 0 if there are fewer."""
    return int(np.partition(scores, len(scores) - k)[len(scores) - k]) if len(scores) >= k else 0


def accumulate(query: list[tuple[int, int]], lists: dict[int, tuple[np.ndarray, np.ndarray]], n_docs: int, k: int, held: np.ndarray) -> np.ndarray:
    """Scores of a chunk's documents for one query: exact where they may be among the k best.

    ``query`` has (term, weight) rarest first, ``lists`` the documents and shares of each
    term, ``held`` the scores that the query has found in earlier chunks.
    """
    present = [(weight, *lists[term]) for term, weight in query if term in lists]
    bounds = np.cumsum([weight * int(shares.max()) for weight, _, shares in reversed(present)])[::-1] if present else ()
    scores = np.zeros(n_docs, np.int64)
    live, floor = None, best_of(held, k)
    for bound, (weight, docs, shares) in zip(bounds, present):
        if live is None:
            if floor <= bound < scores.max(initial=0):  # else the k-th score can't be above the bound, or is known to be
                floor = best_of(np.concatenate([held, scores[scores > 0]]), k)
            if bound < floor:
                live = scores > 0
        if live is None:
            scores[docs] += weight * shares
        else:
            known = live[docs]
            scores[docs[known]] += weight * shares[known]
    return scores


def _searched(rows: DataFrame, queries, k: int, stats: tuple[int, int]) -> DataFrame:
    """(item, id, score): the best k of each task for each query."""
    n_all, l_all = stats
    kind = rows.schema["id"].dataType.simpleString()
    id_type = arrow_type(rows, "id")

    def chunks(batches):
        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += len(batch.column(2).flatten())
            if size >= CHUNK:
                yield pa.Table.from_batches(held).combine_chunks()
                held, size = [], 0
        if size:
            yield pa.Table.from_batches(held).combine_chunks()

    def by_term(table):
        """The documents of each term in a chunk, with their shares."""
        n, found, often = (table.column(i).combine_chunks() for i in (1, 2, 3))
        n = n.to_numpy()
        docs = np.repeat(np.arange(len(n)), np.diff(found.offsets.to_numpy()))
        term, tf = found.flatten().to_numpy(), often.flatten().to_numpy().astype(np.int64)
        m = 100 - 50 + (50 * n * n_all) // l_all
        shares = (1_000_000_000 * tf) // (1000 * tf + 20 * m[docs])
        order = np.argsort(term, kind="stable")
        cuts = np.flatnonzero(np.diff(term[order])) + 1
        return {int(term[part[0]]): (docs[part], shares[part]) for part in np.split(order, cuts)}

    def run(batches):
        best: dict[int, list[tuple]] = {}
        for table in chunks(batches):
            lists, ids = by_term(table), table.column(0)
            for item, query in queries.value:
                held = best.get(item, [])
                scores = accumulate(query, lists, table.num_rows, k, np.array([-s for s, *_ in held], np.int64))
                at = np.flatnonzero(scores)
                at = at[scores[at] >= best_of(scores[at], k)]
                found = [(-int(scores[i]), (x := ids[int(i)].as_py()) is None, x) for i in at]
                if found:
                    best[item] = sorted(held + found, key=lambda r: (r[0], r[1], 0 if r[1] else r[2]))[:k]
        for item, found in best.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([item] * len(found), pa.int64()), pa.array([x for *_, x in found], id_type), pa.array([-s for s, *_ in found], pa.int64())],
                ["item", "id", "score"])

    return map_arrow(rows, run, f"item long, id {kind}, score long")


def _ranks(found: DataFrame, k: int) -> DataFrame:
    """The k best rows of each item with their rank, by lanes and then over these."""
    order = [F.col("score").desc(), F.col("id").asc_nulls_last()]
    lane = F.pmod(F.xxhash64("id", "score"), F.lit(LANES))
    rows = found.withColumn("lane", lane)
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("item", "lane").orderBy(*order))).where(F.col("rank") <= k)
    return rows.drop("lane").withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).where(F.col("rank") <= k)


def search(df: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text", k: int = 50) -> DataFrame:
    """``item_key``, rank, ``key``, score: the ``k`` best documents of ``df`` for each row of ``items``."""
    spark = df.sparkSession
    docs = df.select(F.col(f"`{key}`").alias("id"), F.col(f"`{text}`").alias("text"))
    asked = items.select(F.col(f"`{item_key}`").alias("item_key"), F.col(f"`{item_text}`").alias("text"))
    asked = write(asked.withColumn("row", F.monotonically_increasing_id()), "items")
    out = None
    for block in blocks(asked):
        queries = [(r["row"], sorted(set(terms((r["text"] or "").encode())))) for r in block.select("row", "text").collect()]
        number = {term: i for i, term in enumerate(sorted({t for _, found in queries for t in found}))}
        vocabulary = spark.sparkContext.broadcast(number)
        rows = write(postings(docs, vocabulary), "postings")
        n_all, l_all = rows.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
        df_of = counts(rows, "terms", len(number))
        weight = [math.floor(1000 * math.log((2 * n_all + 2) / (2 * int(d) + 1))) for d in df_of]
        plans = [(row, [(number[t], weight[number[t]]) for t in sorted(found, key=lambda t: (df_of[number[t]], t))]) for row, found in queries]
        plans = spark.sparkContext.broadcast(plans)
        best = _ranks(_searched(rows.where(F.size("terms") > 0), plans, k, (n_all, max(l_all, 1))), k)
        best = write(best.join(block.select(F.col("row").alias("item"), "item_key"), "item"), "ranked")
        out = best if out is None else out.unionByName(best)
        vocabulary.unpersist()
        plans.unpersist()
    return out.select(F.col("item_key").alias(item_key), F.col("rank").cast("int").alias("rank"), F.col("id").alias(key), "score")


ORACLE = r"""
WITH docs AS (
  SELECT row_number() OVER () AS row, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t
  FROM documents),
items AS (
  SELECT item_id, unnest(list_distinct(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'))) AS term
  FROM benchmark),
lengths AS (SELECT row, doc_id, CAST(len(t) AS BIGINT) AS n FROM docs),
stats AS (SELECT count(*) FILTER (n > 0) AS n_all, CAST(sum(n) AS BIGINT) AS l_all FROM lengths),
used AS (SELECT row, term, count(*) AS tf FROM (SELECT row, unnest(t) AS term FROM docs) GROUP BY row, term),
weights AS (
  SELECT term, CAST(floor(1000 * ln(CAST(2 * n_all + 2 AS DOUBLE) / CAST(2 * df + 1 AS DOUBLE))) AS BIGINT) AS w
  FROM (SELECT term, count(*) AS df FROM used GROUP BY term), stats),
shares AS (
  SELECT u.row, u.term, w.w * ((1000000000 * u.tf) // (1000 * u.tf + 20 * (50 + (50 * l.n * s.n_all) // s.l_all))) AS share
  FROM used u JOIN weights w USING (term) JOIN lengths l USING (row), stats s),
scores AS (SELECT i.item_id, h.row, CAST(sum(h.share) AS BIGINT) AS score FROM items i JOIN shares h USING (term) GROUP BY ALL HAVING sum(h.share) > 0),
placed AS (
  SELECT item_id, doc_id, score, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS INTEGER) AS rank
  FROM scores JOIN lengths USING (row))
SELECT item_id, rank, doc_id, score FROM placed WHERE rank <= 50
"""
